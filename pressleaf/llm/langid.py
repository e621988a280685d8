"""Language identification by multilingual mixture inference.

Every document is a mixture of languages. Each word (run of letters) has a likelihood under each learned
language, the product of its byte trigrams' likelihoods; expectation-maximisation estimates the document's
language proportions, and a greedy search keeps a language set only while the log likelihood gains more than
the penalty of one more proportion.

Defined results: null text or text without a letter gives `und`, score 0; ties go to the language that sorts
first; repeated rows get equal answers; an empty table gives an empty result; without any learned language
everything is `und`. Very long texts are read whole. Input columns named like a result column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressleaf.llm.common import annotate, chunks, held_out, slices

BUCKETS = 1 << 16
UNKNOWN = "und"
#: Bytes of text handled at once in a task.
CHUNK = 1 << 20

_FOLD = np.zeros(256, np.uint32)
_FOLD[128:] = np.arange(128, 256)
for _c in range(26):
    _FOLD[65 + _c] = _FOLD[97 + _c] = 97 + _c


@dataclass(frozen=True)
class LanguageModel:
    """Trigram log likelihoods by language (len(languages) x BUCKETS)."""

    languages: tuple[str, ...]
    logp: np.ndarray


def _trigrams(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes (0 for what is no letter), bucket of the trigram that ends at each place, and whether it counts."""
    c = _FOLD[np.frombuffer(data, np.uint8)]
    prev = np.zeros_like(c)
    prev[1:] = c[:-1]
    prev2 = np.zeros_like(c)
    prev2[2:] = c[:-2]
    prev2[prev == 0] = 0
    h = (c * np.uint32(0x9E3779B1)) ^ (prev * np.uint32(0x85EBCA6B)) ^ (prev2 * np.uint32(0xC2B2AE35))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h >>= np.uint32(16)
    return c, h, (c != 0) | (prev != 0)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def train(docs: DataFrame, per_language: int = 4000, smoothing: float = 0.5) -> LanguageModel:
    """Learns from a bounded sample of the rows outside the held-out fold that have a language.

    per_language bounds the sample: about that many documents of each language, chosen by a hash of their id.
    """
    known = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = tuple(sorted(sizes))
    if not languages:
        return LanguageModel((), np.zeros((0, BUCKETS), np.float32))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    limit = F.create_map(
        *[F.lit(x) for lang in languages for x in (lang, int(min(1.0, per_language / sizes[lang]) * (1 << 30)))]
    )[F.col("lang")]
    sample = known.where(place < limit).select("text", "lang")

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in (part for whole in batches for part in slices(whole)):
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _, h, used = _trigrams(b"\0" + text.encode("utf-8", "surrogatepass") + b"\0")
                if lang not in total:
                    total[lang] = np.zeros(BUCKETS, np.int64)
                total[lang] += np.bincount(h[used], minlength=BUCKETS)
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())],
                names=["lang", "bucket", "n"],
            )

    rows = (
        sample.mapInArrow(count, "lang string, bucket int, n bigint")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    counts = np.zeros((len(languages), BUCKETS))
    code = {lang: i for i, lang in enumerate(languages)}
    counts[rows["lang"].map(code).to_numpy(int), rows["bucket"].to_numpy(int)] = rows["n"].to_numpy(float)
    seen = max(1, int((counts.sum(0) > 0).sum()))
    logp = np.log((counts + smoothing) / (counts.sum(1, keepdims=True) + smoothing * seen))
    return LanguageModel(languages, logp.astype(np.float32))


def _mixture(words: np.ndarray, starts: np.ndarray, doc: np.ndarray, allowed: np.ndarray, rounds: int):
    """EM over words x languages likelihoods; returns proportions and log likelihood of each document."""
    weight = allowed / allowed.sum(1, keepdims=True)
    count = np.diff(np.append(starts, len(words)))[:, None]
    for _ in range(rounds):
        part = words * weight[doc]
        part /= np.maximum(part.sum(1, keepdims=True), 1e-30)
        weight = np.add.reduceat(part, starts, axis=0) / count
    like = np.add.reduceat(np.log(np.maximum((words * weight[doc]).sum(1), 1e-30)), starts)
    return weight, like


def infer(model: LanguageModel, texts: list[bytes], rounds: int = 8, penalty: float = 1.0):
    """For each text the proportions of its selected language set (zeros where no word has letters)."""
    k = len(model.languages)
    out = np.zeros((len(texts), k))
    data = b"\0" + b"\0".join(texts) + b"\0"
    c, h, used = _trigrams(data)
    begin = np.flatnonzero((c[1:] != 0) & (c[:-1] == 0)) + 1
    if not len(begin) or not k:
        return out
    ends = 1 + np.cumsum(np.array([len(t) + 1 for t in texts]))
    doc_of = np.searchsorted(ends, begin, side="right")
    logs = np.empty((len(begin), k))
    for i in range(k):
        logs[:, i] = np.add.reduceat(np.where(used, model.logp[i][h], np.float32(0)), begin)
    present, starts = np.unique(doc_of, return_index=True)
    alone = np.add.reduceat(logs, starts, axis=0)
    best = alone.argmax(1)
    out[present, best] = 1.0
    if k == 1:
        return out
    top = logs.max(1, keepdims=True)
    words = np.exp(np.maximum(logs - top, -60.0))
    size = np.diff(np.append(starts, len(begin)))
    base = np.add.reduceat(top[:, 0], starts)
    everything, full = _mixture(words, starts, np.repeat(np.arange(len(present)), size), np.ones((len(present), k)), rounds)
    order = np.argsort(-everything, axis=1, kind="stable")
    current = alone.max(1)
    cost = penalty * 0.5 * np.log(np.maximum(size, 2)) + 2.0
    live = np.flatnonzero(full + base - current > cost)
    for m in range(2, k + 1):
        if not len(live):
            break
        allowed = np.zeros((len(live), k))
        np.put_along_axis(allowed, order[live, :m], 1.0, axis=1)
        keep = np.concatenate([np.arange(starts[d], starts[d] + size[d]) for d in live])
        first = np.concatenate([[0], np.cumsum(size[live])[:-1]])
        weight, like = _mixture(words[keep], first, np.repeat(np.arange(len(live)), size[live]), allowed, rounds)
        gain = like + base[live] - current[live]
        won = gain > cost[live]
        out[present[live[won]]] = weight[won]
        current[live[won]] += gain[won]
        live = live[won]
    return out


def languages_of(model: LanguageModel, texts: list[str | None]) -> tuple[list[str], list[float], list[list[tuple[str, float]]]]:
    """Language, score (its share) and selected languages with their shares of each text."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    names, scores, sets = [], [], []
    for a, b in chunks([len(r) for r in raw], CHUNK):
        for share, text in zip(infer(model, raw[a:b]), texts[a:b], strict=True):
            found = len(share) and share.max() > 0 and has_letter(text)
            names.append(model.languages[int(share.argmax())] if found else UNKNOWN)
            scores.append(min(1.0, float(share.max())) if found else 0.0)
            sets.append([(model.languages[i], float(share[i])) for i in np.flatnonzero(share)] if found else [])
    return names, scores, sets


def identify(docs: DataFrame, model: LanguageModel, drop: tuple[str, ...] = ()) -> DataFrame:
    """Adds lang_pred, score (share of the predicted language) and languages (the selected set with shares)."""
    fields = [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("languages", T.MapType(T.StringType(), T.DoubleType())),
    ]

    def of_batch(batch: pa.RecordBatch) -> dict:
        return dict(zip(("lang_pred", "score", "languages"), languages_of(model, batch.column("text").to_pylist()), strict=True))

    return annotate(docs, fields, of_batch, drop)


def query(spark, sf_dir: str) -> DataFrame:
    from pressleaf.llm.common import table

    docs = table(spark, sf_dir, "documents")
    model = train(docs)
    found = identify(docs.select("doc_id", "text"), model, drop=("text",))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "languages")
