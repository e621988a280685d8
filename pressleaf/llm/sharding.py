"""Contiguous byte-balanced shards from global prefix sums.

Rows are range-partitioned by id and written once (narrow columns only); each partition's total gives the
offset of the next, so a row's global prefix is its partition's offset plus a running sum inside the partition.
A row belongs to the shard in which the middle of its byte range falls, so every shard's total is within one
row's size of the target. The law is `bytes`.

Defined results: null text has no bytes and crc32 0; every row counts one byte more than its text; null ids come
first; equal ids are ordered by size, then crc32, and equal rows in any order; an empty table gives an empty
result; input columns named like a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pressleaf.llm.common import cut, table

ORDER = ("doc_id", "size", "text_crc32")


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard (from 0), slot (place in the shard, gapless from 0), grown_shard."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32")
    )
    spread = narrow.repartitionByRange(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *ORDER)
    parts = cut(spread.withColumn("part", F.spark_partition_id()), "shard-sizes")
    # one row for each partition: bounded by the number of partitions, not by the data
    totals = parts.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).orderBy("part").collect()
    offsets, at_byte, at_row = [], 0, 0
    for r in totals:
        offsets.append((r["part"], at_byte, at_row))
        at_byte, at_row = at_byte + r["bytes"], at_row + r["rows"]
    offset = docs.sparkSession.createDataFrame(offsets, "part int, byte0 long, row0 long")
    inside = Window.partitionBy("part").orderBy(*ORDER)
    running = parts.select(
        "*",
        (F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("before"),
        F.row_number().over(inside).alias("place"),
    ).join(F.broadcast(offset), "part")
    dealt = running.select(
        *ORDER,
        F.expr(f"cast(({shards} * (2 * (byte0 + before) + size)) div {2 * max(1, at_byte)} as int)").alias("shard"),
        (F.col("row0") + F.col("place") - 1).alias("row"),
    )
    # `shards` rows at most
    first = dealt.groupBy("shard").agg(F.min("row").alias("first"))
    return dealt.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("row") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


