"""Writers of bundled pages, and the readers that make a catalog of files."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressleaf.functions import markup, media


def with_paths(bundled: DataFrame, template: str, output_format: str, timestamp: str) -> DataFrame:
    title = F.coalesce(F.col("title"), F.lit(""))
    return bundled.withColumn("path", markup.output_path_col(F.lit(template), title, output_format, timestamp))


def write(bundled: DataFrame, path: str) -> None:
    """One row for each page; parquet keeps pages of any encoding as they are."""
    bundled.write.parquet(path)


def write_files(bundled: DataFrame, folder: str, template: str, output_format: str, timestamp: str) -> DataFrame:
    """Writes every page's content to its path below folder (a URI that driver and executors share); gives path and bytes.

    Of pages with the same path the one with the largest page_id is written; pages without content are left out. A file is
    written under a name of its own and then renamed, so a lost executor leaves no half file.
    """
    pages = with_paths(bundled, template, output_format, timestamp).where("content is not null")
    last = pages.groupBy("path").agg(F.max_by("content", "page_id").alias("content"))

    def run(batches):
        import uuid

        from pyarrow import fs

        place, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                parts = [p for p in path.split("/") if p not in ("", ".", "..")]
                target = "/".join([root, *parts])
                place.create_dir(target.rpartition("/")[0], recursive=True)
                own = f"{target.rpartition('/')[0]}/.{uuid.uuid4().hex}"
                with place.open_output_stream(own) as out:
                    out.write(content.as_buffer())
                place.move(own, target)
            sizes = [len(c.as_buffer()) for c in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), pa.array(sizes, pa.int64())], names=["path", "bytes"])

    return last.mapInArrow(run, "path string, bytes bigint")


def file_assets(spark: SparkSession, path: str) -> DataFrame:
    """The files below a path as an asset table."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    url = F.regexp_replace("path", "^file:/+", "file:///")
    kind = media.sniff_col(F.col("content"))
    named = media.by_name_col(F.substring_index("path", "/", -1))
    return files.select(
        url.alias("url_key"), url.alias("final_url"), F.when(kind != "", kind).otherwise(named).alias("media_type"), F.lit("").alias("charset"), F.col("content").alias("data")
    )
