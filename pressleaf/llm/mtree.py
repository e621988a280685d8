"""Exact top-k inner-product search with M-trees.

Integer vectors of norm at most R become points (x, sqrt(R^2 - |x|^2)); for a query (q, 0) the squared distance is
|q|^2 + R^2 - 2 q.x, so the nearest points have the highest inner products and a metric tree finds them exactly.

Equal vectors are one object that carries its k + 1 smallest ids. Objects are dealt to the nearest of a bounded number
of pivots, crowded pivots are split by a hash, and every such shard is an M-tree of its own: pages of routing objects with
covering radii and stored distances to the parent object. A query first searches its home shard; the k-th score found
there bounds the distance, and it goes on only to shards whose covering ball reaches within it. In a tree the page with
the least possible distance to any query of a block is opened first, for all queries that it may concern, and the triangle
inequality on stored distances rules out pages and entries before their own distance is computed.

Defined results: null vectors, vectors with null or non-finite components, and null ids take no part; shorter vectors
count as padded with zeros; repeated rows of one id count once; ties go to the smaller id; with fewer than k candidates
all are returned; vectors of any length are taken whole; other columns, whatever their names, are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pressleaf.llm.common import cut, table

#: Entries of a leaf page and of an inner page.
LEAF, FANOUT = 128, 8
#: Pivots at most, objects of a shard, queries of a block, and salts of a crowded vector's ids.
PIVOTS, SHARD, BLOCK, SALTS = 32, 16384, 4096, 64


@dataclass
class Node:
    """A page: its routing object, covering radius and distance to the parent's routing object."""

    routing: int
    radius: float
    to_parent: float
    children: list  # of Node
    entries: np.ndarray | None = None  # leaf: numbers of objects
    stored: np.ndarray | None = None  # leaf: their distances to the routing object


class MTree:
    """A bulk-loaded M-tree over integer vectors (n x d); r2 must be at least every squared norm."""

    def __init__(self, vectors: np.ndarray, r2: float, seed: int = 0):
        self.ints = vectors
        self.exact = vectors.size == 0 or float(np.abs(vectors).max()) ** 2 * max(1, vectors.shape[1]) < 2.0**50
        self.points = vectors.astype(np.float64)
        self.r2 = float(r2)
        self.last = np.sqrt(np.maximum(self.r2 - (self.points**2).sum(1), 0.0))
        self.rng = np.random.default_rng(seed)
        self.computed = 0
        everything = np.arange(len(vectors))
        self.root = self._build(everything, 0, 0.0) if len(vectors) else None

    def _between(self, i: int, others: np.ndarray) -> np.ndarray:
        d = ((self.points[others] - self.points[i]) ** 2).sum(1) + (self.last[others] - self.last[i]) ** 2
        return np.sqrt(d)

    def _build(self, members: np.ndarray, routing: int, to_parent: float) -> Node:
        d = self._between(routing, members)
        radius = float(d.max())
        if len(members) <= LEAF or radius == 0.0:
            return Node(routing, radius, to_parent, [], members, d)
        chosen = members[self.rng.choice(len(members), min(FANOUT, len(members)), replace=False)]
        away = np.stack([self._between(c, members) for c in chosen])
        nearest = away.argmin(0)
        parts = [np.flatnonzero(nearest == i) for i in range(len(chosen))]
        if max(map(len, parts)) == len(members):  # nothing was told apart; even halves still are smaller
            parts = np.array_split(np.arange(len(members)), 2)
            chosen = np.array([members[p[0]] for p in parts])
        node = Node(routing, radius, to_parent, [])
        for c, p in zip(chosen, parts, strict=True):
            if len(p):
                node.children.append(self._build(members[p], int(c), float(self._between(routing, np.array([c]))[0])))
        return node

    def search(self, query: np.ndarray, ids: list, k: int, least: int | None = None) -> list[tuple[int, int]]:
        """The k best (score, id), ids[i] being the ids of object i; scores below `least` may be left out."""
        return self.search_all(query[None, :], ids, k, [least])[0]

    def search_all(self, queries: np.ndarray, ids: list, k: int, least: list[int | None]) -> list[list[tuple[int, int]]]:
        """search() of each query. Queries share the walk: the page with the least possible distance to any of them is
        opened first, once, for those queries alone whose own limit it may be within."""
        n = len(queries)
        best: list[list[tuple[int, int]]] = [[] for _ in range(n)]  # heaps of (score, -id): the worst first
        if self.root is None or not n:
            return best
        q = queries.astype(np.float64)
        q2 = (q**2).sum(1)
        slack = 1e-6 * (np.sqrt(q2) + np.sqrt(self.r2) + 1.0)
        floors = np.array([-(2**63) if x is None else x for x in least], np.int64)
        limit = np.full(n, np.inf)
        bounded = np.flatnonzero([x is not None for x in least])

        def bound(who: np.ndarray) -> None:
            limit[who] = np.sqrt(np.maximum(0.0, q2[who] + self.r2 - 2.0 * floors[who])) + slack[who]

        def away(i: int, who: np.ndarray) -> np.ndarray:
            self.computed += len(who)
            return np.sqrt(np.maximum(0.0, q2[who] + self.r2 - 2.0 * (q[who] @ self.points[i])))

        bound(bounded)
        who = np.arange(n)
        d = away(self.root.routing, who)
        low = np.maximum(0.0, d - self.root.radius)
        todo = [(float(low.min()), 0, self.root, who, d, low)]
        count = 1
        while todo:
            _, _, node, who, d, low = heapq.heappop(todo)
            still = low <= limit[who]
            if not still.any():
                continue
            who, d, low = who[still], d[still], low[still]
            if node.entries is None:
                for child in node.children:
                    near = np.abs(d - child.to_parent) - child.radius <= limit[who]  # by stored distances
                    some = who[near]
                    if not len(some):
                        continue
                    dc = away(child.routing, some)
                    lc = np.maximum(low[near], dc - child.radius)
                    reached = lc <= limit[some]
                    if reached.any():
                        lc = lc[reached]
                        heapq.heappush(todo, (float(lc.min()), count, child, some[reached], dc[reached], lc))
                        count += 1
                continue
            near = np.abs(d[:, None] - node.stored[None, :]) <= limit[who][:, None]
            columns = near.any(0)
            if not columns.any():
                continue
            inside = node.entries[columns]
            self.computed += len(who) * len(inside)
            scores = (q[who] @ self.points[inside].T).astype(np.int64) if self.exact else queries[who] @ self.ints[inside].T
            row, col = np.nonzero(scores >= floors[who][:, None])
            if not len(row):
                continue
            for w, i, s in zip(who[row].tolist(), inside[col].tolist(), scores[row, col].tolist(), strict=True):
                heap = best[w]
                if len(heap) == k and s < heap[0][0]:
                    continue
                for name in ids[i]:
                    if len(heap) < k:
                        heapq.heappush(heap, (s, -name))
                    elif (s, -name) > heap[0]:
                        heapq.heapreplace(heap, (s, -name))
                    else:
                        break  # the ids ascend
            changed = [w for w in np.unique(who[row]).tolist() if len(best[w]) == k and best[w][0][0] > floors[w]]
            if changed:
                floors[changed] = [best[w][0][0] for w in changed]
                bound(np.array(changed))
        return [sorted(((s, -x) for s, x in heap), key=lambda x: (-x[0], x[1])) for heap in best]


def quantised(vectors: DataFrame, column: str = "embedding", factor: float = 64.0) -> DataFrame:
    """vec_id and vec (floor of factor times each component, as long) of the vectors that take part."""
    wrong = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col(column).isNotNull() & ~F.coalesce(wrong, F.lit(True))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(column, lambda x: F.floor(x.cast("double") * factor).cast("long")).alias("vec")
    )


def objects(rows: DataFrame, k: int) -> DataFrame:
    """One row for each distinct vector: vec, name (its smallest id) and ids (its k smallest, ascending)."""
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).alias("salt")
    part = Window.partitionBy("vec", "salt").orderBy("vec_id")
    least = rows.dropDuplicates(["vec_id", "vec"]).select("*", salt).withColumn("n", F.row_number().over(part)).where(F.col("n") <= k)
    lists = least.groupBy("vec", "salt").agg(F.collect_list("vec_id").alias("ids"))  # k ids at most
    whole = lists.groupBy("vec").agg(F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, k).alias("ids"))  # SALTS lists at most
    return whole.select("vec", F.element_at("ids", 1).alias("name"), "ids")


def _padded(vectors, dim: int) -> np.ndarray:
    out = np.zeros((len(vectors), dim), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _distances(x: np.ndarray, pivots: np.ndarray, r2: float, query: bool) -> np.ndarray:
    """Distances of points (or queries) to the pivots, all mapped as above."""
    x, p = x.astype(np.float64), pivots.astype(np.float64)
    x2, p2 = (x**2).sum(1), (p**2).sum(1)
    lx = np.zeros(len(x)) if query else np.sqrt(np.maximum(r2 - x2, 0.0))
    lp = np.sqrt(np.maximum(r2 - p2, 0.0))
    d = x2[:, None] + p2[None, :] - 2.0 * (x @ p.T) + (lx[:, None] - lp[None, :]) ** 2
    return np.sqrt(np.maximum(d, 0.0))


def search(rows: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """rows: vec_id and vec. For ids divisible by `every`: query_id, rank, vec_id and score of the k best other rows."""
    spark = rows.sparkSession
    most = k + 1  # the query's own row may be among them
    rows = cut(rows, "knn-rows")
    whole = cut(objects(rows, most), "knn-objects")
    facts = whole.agg(
        F.max(F.size("vec")).alias("dim"),
        F.max(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x)).alias("r2"),
    ).first()
    empty = "query_id bigint, rank int, vec_id bigint, score bigint"
    if facts["dim"] is None:
        return spark.createDataFrame([], empty)
    dim, r2 = max(1, facts["dim"]), float(facts["r2"])
    # PIVOTS vectors at most
    pivots = _padded([r["vec"] for r in whole.orderBy(F.xxhash64("vec"), "name").limit(PIVOTS).select("vec").collect()], dim)

    def to_nearest(batches):
        for pdf in batches:
            d = _distances(_padded(pdf["vec"], dim), pivots, r2, False)
            pdf = pdf.assign(pivot=d.argmin(1).astype(np.int32), away=d.min(1))
            yield pdf[["name", "vec", "ids", "pivot", "away"]]

    placed = cut(
        whole.mapInPandas(to_nearest, "name bigint, vec array<bigint>, ids array<bigint>, pivot int, away double"), "knn-placed"
    )
    # one row for each pivot
    crowd = {r["pivot"]: (-(-r["n"] // SHARD), r["radius"]) for r in placed.groupBy("pivot").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()}

    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "vec")
    queries = cut(asked.select("vec").distinct().join(whole.select("vec", "name"), "vec").select(F.col("name").alias("query"), "vec"), "knn-queries")
    blocks = max(1, -(-queries.count() // BLOCK))
    block = F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("block")
    salts = F.create_map(*[F.lit(x) for p, (n, _) in crowd.items() for x in (p, n)])[F.col("pivot")]
    shards = placed.select(
        "pivot",
        F.pmod(F.xxhash64("name"), salts).cast("int").alias("salt"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        "name", "vec", "ids",
    )
    used = np.array(sorted(crowd))
    radius = np.array([crowd[p][1] for p in used])
    split = [crowd[p][0] for p in used]

    def home(batches):
        for pdf in batches:
            d = _distances(_padded(pdf["vec"], dim), pivots[used], r2, True)
            near = d.argmin(1)
            yield pdf.assign(pivot=used[near].astype(np.int32), salt=np.array([q % split[n] for q, n in zip(pdf["query"], near, strict=True)], np.int32))[
                ["query", "vec", "pivot", "salt"]
            ]

    def in_tree(key, objs: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = {"query": [], "score": [], "vec_id": []}
        if len(objs) and len(asks):
            objs = objs.sort_values("name")
            tree = MTree(_padded(objs["vec"], dim), r2, seed=int(key[0]) * 1009 + int(key[1]))
            ids = [list(map(int, x)) for x in objs["ids"]]
            floors = [None if f is None or f != f else int(f) for f in asks["floor"].tolist()] if "floor" in asks else [None] * len(asks)
            for q, found in zip(asks["query"].tolist(), tree.search_all(_padded(asks["vec"], dim), ids, most, floors), strict=True):
                out["query"] += [q] * len(found)
                out["score"] += [s for s, _ in found]
                out["vec_id"] += [n for _, n in found]
        return pd.DataFrame(out).astype("int64")

    by = ("pivot", "salt", "block")
    hit = "query bigint, score bigint, vec_id bigint"
    homes = cut(queries.mapInPandas(home, "query bigint, vec array<bigint>, pivot int, salt int").select("*", block), "knn-homes")
    near = cut(shards.groupBy(*by).cogroup(homes.groupBy(*by)).applyInPandas(in_tree, hit), "knn-near")

    # the k-th score of the home shard bounds the distance; without so many rows there is no bound yet
    floors = near.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= most)
    bounded = homes.join(floors.select("query", F.col("least").alias("floor")), "query", "left")

    def onward(batches):
        for pdf in batches:
            v = _padded(pdf["vec"], dim)
            d = _distances(v, pivots[used], r2, True)
            floor = pdf["floor"].astype("Float64").to_numpy(dtype=float, na_value=np.nan)
            q2 = (v.astype(float) ** 2).sum(1)
            limit = np.sqrt(np.maximum(q2 + r2 - 2.0 * floor, 0.0)) + 1e-6 * (np.sqrt(q2) + np.sqrt(r2) + 1.0)
            limit[np.isnan(floor)] = np.inf
            row, col = np.nonzero(d - radius[None, :] <= limit[:, None])
            take = np.repeat(np.arange(len(row)), [split[c] for c in col])
            salt = np.concatenate([np.arange(split[c]) for c in col]) if len(col) else np.zeros(0, int)
            row, col = row[take], col[take]
            own = (used[col] == pdf["pivot"].to_numpy()[row]) & (salt == pdf["salt"].to_numpy()[row])
            row, col, salt = row[~own], col[~own], salt[~own]
            for a in range(0, len(row), 20_000):
                r = row[a : a + 20_000]
                yield pd.DataFrame(
                    {"query": pdf["query"].to_numpy()[r], "vec": pdf["vec"].to_numpy()[r], "floor": floor[r], "pivot": used[col[a : a + 20_000]], "salt": salt[a : a + 20_000]}
                )

    sent = bounded.mapInPandas(onward, "query bigint, vec array<bigint>, floor double, pivot int, salt int").select("*", block)
    far = shards.groupBy(*by).cogroup(sent.groupBy(*by)).applyInPandas(in_tree, hit)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    top = near.unionByName(far).withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    lists = top.groupBy("query").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("low"), "vec_id"))).alias("found"))
    found = cut(queries.join(lists, "query").select("vec", "found"), "knn-found")
    own = F.filter("found", lambda x: x["vec_id"] != F.col("query_id"))
    return (
        asked.dropDuplicates(["vec_id", "vec"])
        .select(F.col("vec_id").alias("query_id"), "vec")
        .join(found, "vec")
        .select("query_id", F.posexplode(F.slice(own, 1, k)).alias("at", "x"))
        .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.low")).alias("score"))
    )


def query(spark, sf_dir: str) -> DataFrame:
    return search(quantised(table(spark, sf_dir, "embeddings")))


SQL = """
WITH v AS (
  SELECT DISTINCT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT)) AS vec
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), e AS (
  SELECT vec_id, unnest(vec) AS x, unnest(range(len(vec))) AS i FROM v
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, sum(q.x * c.x) AS score
  FROM e q JOIN e c ON q.i = c.i AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 20 = 0
  GROUP BY 1, 2
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 20
"""
