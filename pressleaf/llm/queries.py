"""Registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from pressleaf.llm import langid, media, minhash_sql, mtree, neardup, packing, rans, sharding, toxicity, unigram, warc

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_topk": mtree.query,
    "op3_neardup": neardup.query,
    "op4_sharding": sharding.query,
    "op5_warc": warc.query,
    "op6_sampling": unigram.query,
    "op7_packing": packing.query,
    "op8_media": media.query,
    "op9_token_files": rans.query,
    "op10_language": langid.query,
}

SQL = {"op2_topk": mtree.SQL, "op3_neardup": minhash_sql.SQL, "op5_warc": warc.SQL}
