"""Stage functions of the corpus pipeline: each takes (spark, docs, sf_dir) and gives the documents that stay.

Defined results: all columns stay as they are, whatever their names beside doc_id and text. A null id is no id: its row is
judged like any other. Null and empty texts and texts without a letter go in the language stage; by itself the toxicity
stage keeps them (no evidence) and the near-duplicate stage too (they are linked with nothing), and packing makes one piece of
each. Repeated rows are judged alike, and the near-duplicate stage keeps one of them; of several texts under one id each is a
document of its own. Of a group the row with the smallest id stays, one with an id before one without, ties to the smaller
hash of the text. Very long texts are judged whole. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressleaf.llm import langid, neardup, packing, toxicity
from pressleaf.llm.common import table, where_texts


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found stay, those in several languages too."""
    model = langid.train(docs)
    return where_texts(docs, lambda texts: [lang != langid.UNKNOWN for lang in langid.languages_of(model, texts)[0]])


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic stay."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scorer = toxicity.Scorer(model)
    return where_texts(docs, lambda texts: [score < toxicity.TOXIC for score, _ in scorer(texts)])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that with the smallest id."""
    once, many = neardup.survivors(docs)
    same = lambda keys: F.col("doc_id").cast("long").eqNullSafe(keys["__id"]) & (F.xxhash64("text") == keys["__t"])
    rows = docs.join(once, same(once), "left_semi")
    # rows that share id and text can't be told apart by a key
    return rows.unionByName(docs.join(many, same(many), "left_semi").dropDuplicates(["doc_id", "text"]))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of the documents with its sequence and place."""
    return packing.packed(docs)
