"""Shared parts of the operators: scratch tables in the shared folder, column annotation, label folds."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

FOLDS = 5


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a temporary one serves local sessions; a cluster needs it."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir") or spark.conf.get("pressleaf.scratch", None)
    if not base:
        if not re.match(r"local(\[|$)", conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="pressleaf-")
        spark.conf.set("pressleaf.scratch", base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/pressleaf/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop.getParent())
    fs.deleteOnExit(hadoop)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here, lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.scratch_path = path
    return made


def discard(*made: DataFrame) -> None:
    """Removes the tables of cut() that no later plan reads."""
    for df in made:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def release() -> None:
    """Gives back a worker's free memory, as the next task may run in another one."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for the fold that learning never sees; a null id belongs to it."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % FOLDS, F.lit(0)) == 0


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """Drops columns that clash with result names, whatever their case."""
    taken = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def slices(batch: pa.RecordBatch, most: int = 2 << 20):
    """Parts of a batch of about `most` bytes, so that what is made of one stays small."""
    step = max(1, int(batch.num_rows * most / max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def annotate(
    df: DataFrame,
    fields: list[T.StructField],
    of_batch: Callable[[pa.RecordBatch], dict[str, list | pa.Array]],
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """Adds columns that of_batch computes from each Arrow batch; input columns of the same names go first."""
    df = without(df, [f.name for f in fields])
    kept = [f for f in df.schema.fields if f.name not in drop]
    schema = T.StructType(kept + fields)
    arrow = to_arrow_schema(schema)
    names = [f.name for f in kept]

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            made = of_batch(batch)
            columns = [batch.column(n) for n in names]
            for f in fields:
                kind = arrow.field(f.name).type
                got = made[f.name]
                columns.append(got.cast(kind) if isinstance(got, pa.Array) else pa.array(got, type=kind))
            yield pa.RecordBatch.from_arrays(
                [c.cast(arrow.field(i).type) for i, c in enumerate(columns)], names=arrow.names
            )
        release()

    return df.mapInArrow(run, schema)


def where_texts(df: DataFrame, decide: Callable[[list[str | None]], list[bool]]) -> DataFrame:
    """The rows of df whose text decide() accepts; nothing but texts goes to Python, and only decisions come back."""

    def accepted(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for whole in texts:
            made = []
            for a, b in chunks(pc.binary_length(whole).fill_null(0).to_pylist(), 2 << 20):
                made += decide(whole.slice(a, b - a).to_pylist())
            yield pa.array(made, pa.bool_())
        release()

    return df.where(F.arrow_udf(accepted, T.BooleanType())(F.col("text")))


def chunks(sizes: list[int], most: int):
    """(start, stop) ranges of rows that together hold at most `most` units, one row at least."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
