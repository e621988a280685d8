"""Toxicity by maximum-scoring segment search.

Tokens get log-odds of toxic against clean text under a Dirichlet prior, less a constant drift. One linear
scan per document finds all maximal scoring segments; extreme-value statistics (lambda from the clean token
distribution, K from clean documents' best segments) turn each into an expected number of chance passages.
The evidence of all significant passages of a document is mapped to a probability by a one-variable logistic
fit on the same bounded sample of labelled rows.

Defined results: null or empty texts have no passage and get the probability of zero evidence; repeated rows
get equal answers; with one class only, or no labels, the score is the smoothed rate of the labels seen;
contradicting labels of a document count as toxic; input columns named like a result column are replaced; very long texts
are scored whole; tokens of equal significance are taken in the order of their text (max_tokens of them at most, a parameter);
an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressleaf.llm.common import annotate, cut, held_out, table

_WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the word beginnings that are tokens beside the word itself ("root*"), for inflected words.
ROOTS = (4, 5, 6, 7)
#: Most words whose score a task remembers.
REMEMBERED = 300_000
#: Texts of this score or more are predicted to be toxic.
TOXIC = 0.5


@dataclass(frozen=True)
class ToxicityModel:
    """scores: by token its score, drift included, and its significance; rest: the score of any other token."""

    scores: dict[str, tuple[float, float]] = field(default_factory=dict)
    rest: float = -0.5
    lam: float = 1.0
    log_k: float = 0.0
    significance: float = 0.05
    slope: float = 0.0
    offset: float = 0.0


def tokens(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def units(word: str) -> list[str]:
    """The word and its beginnings, the most specific first."""
    return [word, *(word[:n] + "*" for n in reversed(ROOTS) if len(word) > n)]


class _Scores(dict):
    """Score of a word: that of its most significant unit in the table, else the rest's."""

    def __init__(self, table: dict[str, tuple[float, float]], rest: float):
        super().__init__()
        self.table, self.rest = table, rest

    def __missing__(self, word: str) -> float:
        known = [self.table[u] for u in units(word) if u in self.table]
        found = max(known, key=lambda x: x[1])[0] if known else self.rest
        if len(self) < REMEMBERED:
            self[word] = found
        return found


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, stop, score), left to right, in linear time.

    Candidates are kept on a stack with the cumulative score before and after each; a new one is merged with the
    nearest earlier candidate that starts lower, if that one also ends lower.
    """
    positive = np.flatnonzero(scores > 0)
    if not len(positive):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[list] = []  # start, stop, before, after, index of the nearest candidate that starts lower
    for i in positive.tolist():
        now = [i, i + 1, float(total[i]), float(total[i + 1]), -1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= now[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= now[3]:
                now[4] = j
                stack.append(now)
                break
            now[0], now[2] = stack[j][0], stack[j][2]
            del stack[j:]
    return [(s[0], s[1], s[3] - s[2]) for s in stack]


def token_scores(model: ToxicityModel) -> _Scores:
    return _Scores(model.scores, model.rest)


def passages(model: ToxicityModel, text: str | None, score_of: _Scores | None = None) -> list[tuple[int, int, float, float]]:
    """Significant passages as (first token, token after the last, score, expected number by chance)."""
    words = tokens(text)
    if not words or not model.scores:
        return []
    score_of = token_scores(model) if score_of is None else score_of
    scores = np.fromiter(map(score_of.__getitem__, words), float, len(words))
    found = []
    for a, b, s in maximal_segments(scores):
        expected = math.exp(min(50.0, model.log_k + math.log(len(words)) - model.lam * s))
        if expected <= model.significance:
            found.append((a, b, s, expected))
    return found


def evidence(found: list[tuple[int, int, float, float]]) -> float:
    return math.log1p(sum(-math.log(max(p[3], 1e-300)) for p in found))


def probability(model: ToxicityModel, x: float) -> float:
    return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, model.slope * x + model.offset))))


def _sample(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """About per_class labelled documents of each class, outside the held-out fold, chosen by a hash of the id."""
    known = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rate = {y: min(1.0, per_class / n) for y, n in sizes.items()}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    limit = F.when(F.col("toxic") == 1, int(rate.get(1, 0) * (1 << 30))).otherwise(int(rate.get(0, 0) * (1 << 30)))
    weight = F.when(F.col("toxic") == 1, 1 / rate.get(1, 1)).otherwise(1 / rate.get(0, 1))
    picked = known.where(place < limit).withColumn("weight", weight.cast("double"))
    # the sample is bounded by 2 * per_class rows of three numbers, so it may be broadcast
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")


def _copy_key(words: list[str]) -> int:
    """Smallest hash of the text's 5-word shingles: near copies mostly share it."""
    import xxhash

    last = max(1, len(words) - 4)
    return min(xxhash.xxh3_64_intdigest(" ".join(words[i : i + 5])) >> 1 for i in range(last))


def _count_tokens(sample: DataFrame, min_weight: float) -> list:
    """Token weights by class; a group of near copies counts as one document."""

    def key(batch: pa.RecordBatch) -> dict:
        return {"copy_key": [_copy_key(tokens(t)) for t in batch.column("text").to_pylist()]}

    keyed = cut(annotate(sample, [T.StructField("copy_key", T.LongType())], key), "toxic-sample")
    # bounded like the sample itself
    groups = keyed.groupBy("copy_key").agg((1.0 / F.count("*")).alias("share"))
    weighted = keyed.join(F.broadcast(groups), "copy_key").select("text", "toxic", "share")

    def count(batches):
        total: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, y, share in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                into = total[y]
                for w, n in Counter(tokens(text)).items():
                    into[w] += n * share
        for into in total:
            for w, n in list(into.items()):
                for u in units(w)[1:]:
                    into[u] += n
        words = list(total[0].keys() | total[1].keys())
        for i in range(0, len(words), 50_000):
            part = words[i : i + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.string()), pa.array([total[1][w] for w in part], pa.float64()), pa.array([total[0][w] for w in part], pa.float64())],
                names=["token", "toxic", "clean"],
            )

    counts = weighted.mapInArrow(count, "token string, toxic double, clean double")
    counts = cut(counts.groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "toxic-tokens")
    sums = counts.where(~F.col("token").endswith("*")).agg(F.sum("toxic"), F.sum("clean")).first()
    return keyed, counts.where(F.col("toxic") + F.col("clean") >= min_weight), float(sums[0] or 0), float(sums[1] or 0)


def train(
    docs: DataFrame,
    labels: DataFrame,
    per_class: int = 8000,
    prior: float = 200.0,
    drift: float = 0.5,
    min_weight: float = 3.0,
    min_z: float = 3.0,
    max_tokens: int = 50_000,
) -> ToxicityModel:
    """Learns from a bounded, documented sample: per_class labelled documents of each class."""
    keyed, counts, n1, n0 = _count_tokens(_sample(docs, labels, per_class), min_weight)
    share = (F.col("toxic") + F.col("clean")) / (n1 + n0 or 1.0)
    a1, a0 = F.col("toxic") + prior * share, F.col("clean") + prior * share
    odds = F.log(a1 / (n1 + prior - a1)) - F.log(a0 / (n0 + prior - a0))
    z = odds / F.sqrt(1 / a1 + 1 / a0)
    rows = (
        counts.select("token", odds.alias("odds"), z.alias("z"), (a0 / (n0 + prior)).alias("p0"))
        .where(F.abs("z") >= min_z)
        .orderBy(F.desc(F.abs("z")), "token")
        .limit(max_tokens)
        .collect()
        if n1 and n0
        else []
    )
    scores = {r["token"]: (r["odds"] - drift, abs(r["z"])) for r in rows}
    # what a more significant shorter root stands for is counted for the background with that root
    own = {
        t for t, (_, z) in scores.items() if all(scores[u][1] <= z for u in units(t.rstrip("*"))[1:] if u != t and u in scores)
    }
    p0 = np.array([r["p0"] for r in rows if r["token"] in own])
    s = np.array([r["odds"] - drift for r in rows if r["token"] in own])
    lam = 1.0
    if len(s) and (s > 0).any():
        low, high = 0.0, 20.0
        for _ in range(60):
            lam = (low + high) / 2
            mean = float((p0 * np.exp(np.minimum(lam * s, 600.0))).sum()) + max(0.0, 1 - p0.sum()) * math.exp(-lam * drift)
            low, high = (lam, high) if mean < 1 else (low, lam)
    model = ToxicityModel(scores, -drift, lam)

    fields = [T.StructField("best", T.DoubleType()), T.StructField("n_tokens", T.LongType())]

    def best(batch: pa.RecordBatch) -> dict:
        top, n, score_of = [], [], token_scores(model)
        for text in batch.column("text").to_pylist():
            words = tokens(text)
            found = maximal_segments(np.fromiter(map(score_of.__getitem__, words), float, len(words)))
            top.append(max((p[2] for p in found), default=0.0))
            n.append(len(words))
        return {"best": top, "n_tokens": n}

    seen = annotate(keyed, fields, best, drop=("text",)).where("toxic = 0").select("best", "n_tokens").toPandas()
    level = seen["best"][seen["best"] > 0]
    at = float(level.median()) if len(level) else 1.0
    over = float((seen["best"] >= at).sum()) + 0.5
    log_k = math.log(over / max(1.0, float(seen["n_tokens"].sum()))) + lam * at
    model = ToxicityModel(scores, -drift, lam, log_k)

    def features(batch: pa.RecordBatch) -> dict:
        score_of = token_scores(model)
        return {"x": [evidence(passages(model, t, score_of)) for t in batch.column("text").to_pylist()]}

    fit = annotate(keyed, [T.StructField("x", T.DoubleType())], features, drop=("text",)).select("x", "toxic", "weight").toPandas()
    slope, offset = _logistic(fit["x"].to_numpy(float), fit["toxic"].to_numpy(float), fit["weight"].to_numpy(float))
    return ToxicityModel(scores, -drift, lam, log_k, model.significance, slope, offset)


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope (0 at least) and offset by Newton steps; without two classes the smoothed rate alone."""
    rate = ((w * y).sum() + 0.5) / (w.sum() + 1.0)
    offset, slope = math.log(rate / (1 - rate)), 0.0
    if not len(x) or y.min() == y.max() or x.max() == x.min():
        return slope, offset
    w = w / w.mean()
    m = np.stack([x, np.ones_like(x)], 1)
    beta = np.array([0.0, offset])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(m @ beta, -40, 40)))
        g = m.T @ (w * (y - p)) - ridge * beta
        h = (m * (w * p * (1 - p))[:, None]).T @ m + ridge * np.eye(2)
        step = np.linalg.solve(h, g)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return max(0.0, float(beta[0])), float(beta[1])


class Scorer:
    """(score, passages) of texts; a task's words are remembered, and nothing of that is sent along."""

    def __init__(self, model: ToxicityModel):
        self.model, self.remembered = model, None

    def __getstate__(self) -> dict:
        return {"model": self.model, "remembered": None}

    def __call__(self, texts: list[str | None]) -> list[tuple[float, list[tuple[int, int, float, float]]]]:
        if self.remembered is None:
            self.remembered = token_scores(self.model)
        found = [passages(self.model, t, self.remembered) for t in texts]
        return [(probability(self.model, evidence(p)), p) for p in found]


def score(docs: DataFrame, model: ToxicityModel, drop: tuple[str, ...] = ()) -> DataFrame:
    """Adds score, predicted and passages (token spans with score and expected number by chance)."""
    span = T.StructType(
        [
            T.StructField("start", T.IntegerType()),
            T.StructField("stop", T.IntegerType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("expected", T.DoubleType()),
        ]
    )
    fields = [
        T.StructField("score", T.DoubleType()),
        T.StructField("predicted", T.IntegerType()),
        T.StructField("passages", T.ArrayType(span)),
    ]
    keys = ("start", "stop", "score", "expected")
    scorer = Scorer(model)

    def of_batch(batch: pa.RecordBatch) -> dict:
        found = scorer(batch.column("text").to_pylist())
        return {
            "score": [s for s, _ in found],
            "predicted": [int(s >= TOXIC) for s, _ in found],
            "passages": [[dict(zip(keys, p, strict=True)) for p in ps] for _, ps in found],
        }

    return annotate(docs, fields, of_batch, drop)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score(docs.select("doc_id", "text"), model, drop=("text",))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted", "passages")
