"""Near-duplicate groups by SuperMinHash, banding, exact verification and union-find grouping.

Texts with the same set are one node, named by 128 bits of its hash and its size, so exact copies never meet in a bucket.
Nodes of a bucket are first linked to the bucket's centre, each link confirmed on the full sets (intersection * 100 >=
union * 75); groups of the confirmed links are joined by large and small stars. Up to here the work within a group is linear
in its size. Buckets whose nodes then still belong to several groups are compared exactly, those of the same nodes once,
with their full sets in cells of bounded size: that takes the square of such a bucket's number of nodes, spread over tasks;
pairs within a group are passed over, and only links that join groups leave a cell. No link that banding finds is lost.

Joins by a key that may be hot (bucket, node, group, centre) are merge joins, which the adaptive planner splits, or dealt
out by a salt whose number follows the key's size.

With 32 bands of 4 slots a pair at a similarity of exactly 0.75 is missed with a chance of 5e-6.

Defined results: null texts and texts without words have an empty set and are linked with nothing; fewer than five
words are one shingle; a null id is in its group but never names it, unless the group has no other; repeated rows have
equal results; several texts under one id are documents of their own; equal similarities need no rule, as every link
counts; very long texts are hashed whole, in blocks; other columns, whatever their names, are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressleaf.llm import minhash
from pressleaf.llm.common import annotate, chunks, cut, discard, release, slices, table
from pressleaf.llm.components import components

#: Bytes of text hashed at once in a task, nodes of one side of a cell, and shingles beside one centre in a task.
CHUNK, CELL, BESIDE = 2 << 20, 512, 1 << 20


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _rows(docs: DataFrame) -> DataFrame:
    """Rows are told apart by id and text; t is the text's hash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")


def features(docs: DataFrame) -> DataFrame:
    """doc_id, t, n_shingles, the set's name (h1, h2, null for an empty set) and bands of every document."""
    fields = [
        T.StructField("n_shingles", T.LongType()),
        T.StructField("h1", T.LongType()),
        T.StructField("h2", T.LongType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
    ]

    def of_batch(batch: pa.RecordBatch) -> dict:
        raw = [_raw(t) for t in batch.column("text").to_pylist()]
        out: dict[str, list] = {f.name: [] for f in fields}
        for a, b in chunks([len(r) for r in raw], CHUNK):
            sets = minhash.shingle_sets(raw[a:b])
            keys = minhash.band_keys(minhash.signatures(sets))
            for i, s in enumerate(sets):
                name = minhash.name_of(s) if len(s) else (None, None)
                for column, value in zip(out, (len(s), *name, keys[i] if len(s) else None), strict=True):
                    out[column].append(value)
        return out

    return annotate(_rows(docs), fields, of_batch, drop=("text",))


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= 75 * (len(a) + len(b) - common)


def shingles_of(wanted: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """node and shingles (its whole set) of the wanted nodes, from the text of one of their rows."""
    reps = wanted.join(nodes, "node").select("node", "h1", "h2", F.col("rep").alias("__rep"), F.col("rep_t").alias("__t"))
    source = _rows(docs)
    same = source["doc_id"].eqNullSafe(reps["__rep"]) & (source["t"] == reps["__t"])
    texts = source.join(reps.hint("merge"), same).select("node", "h1", "h2", "text")

    def run(batches):
        done = set()  # a task gives each of its nodes once, however often the row is repeated
        for batch in (part for whole in batches for part in slices(whole, CHUNK)):
            rows = []
            sets = minhash.shingle_sets([_raw(t) for t in batch.column(3).to_pylist()])
            for node, h1, h2, found in zip(*(batch.column(i).to_pylist() for i in range(3)), sets, strict=True):
                if node not in done and (h1, h2) == minhash.name_of(found):
                    done.add(node)
                    rows.append((node, found.tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], names=["node", "shingles"])
        release()

    return cut(texts.mapInArrow(run, "node bigint, shingles binary"), "neardup-sets")


def verified(pairs: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough.

    A task gets the set of v once and then those of its partners; a v with many of them is dealt to several tasks.
    """
    sized = pairs.join(nodes.select(F.col("node").alias("u"), "size"), "u")
    hubs = cut(sized.groupBy("v").agg(F.ceil(F.sum("size") / BESIDE).cast("int").alias("salts")), "neardup-hubs")
    centres = hubs.join(sets.withColumnRenamed("node", "v"), "v").select(
        "v", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("u"), "shingles"
    )
    partners = pairs.join(hubs.hint("merge"), "v").join(sets.withColumnRenamed("node", "u"), "u")
    partners = partners.select("v", F.pmod(F.xxhash64("u"), F.col("salts")).cast("int").alias("salt"), "u", "shingles")

    def confirm(batches):
        held = None
        for batch in batches:
            kept = []
            for v, u, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                found = np.frombuffer(x.as_py(), np.uint64)
                if u is None:
                    held = found
                elif _similar(found, held):
                    kept.append((u, v))
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in kept], pa.int64()), pa.array([v for _, v in kept], pa.int64())], names=["u", "v"])
        release()

    stream = centres.unionByName(partners).repartition("v", "salt").sortWithinPartitions("v", "salt", F.col("u").asc_nulls_first())
    return stream.mapInArrow(confirm, "u bigint, v bigint")


def cell_links(sets: list[np.ndarray], component: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the cell's groups as far as any similar pair of a left and a right node joins them.

    Intersections are counted exactly, a node at a time, from the lists of the nodes that hold each shingle; pairs that
    belong together already need no link, so there are fewer links than nodes.
    """
    n = len(sets)
    size = np.array([len(x) for x in sets])
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), size)
    holders = owner[np.argsort(code, kind="stable")]
    count = np.bincount(code)
    first = np.cumsum(count) - count
    begin = np.cumsum(size) - size
    group = np.unique(component, return_inverse=True)[1]
    links = []
    for i in range(n):
        other = (left if right[i] else np.zeros(n, bool)) | (right if left[i] else np.zeros(n, bool))
        other = other & (group != group[i]) & (np.arange(n) > i)
        other &= 100 * np.minimum(size, size[i]) >= 75 * np.maximum(size, size[i])
        if not other.any():
            continue
        mine = code[begin[i] : begin[i] + size[i]]
        lens = count[mine]
        places = np.repeat(first[mine] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
        common = np.bincount(holders[places], minlength=n)
        for j in np.flatnonzero(other & (100 * common >= 75 * (size + size[i] - common))).tolist():
            if group[j] != group[i]:
                links.append((i, j))
                group[group == group[j]] = group[i]
    return links


def _cells(members: DataFrame) -> DataFrame:
    """(u, v) links between groups of one bucket, found in cells of CELL x CELL nodes.

    members: key, node, component, shingles, n (nodes of the bucket).
    """
    parts = F.ceil(F.col("n") / CELL)
    mine = F.pmod(F.xxhash64("node"), parts)
    dealt = members.withColumn("mine", mine.cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), (parts - 1).cast("int"))))
    cells = dealt.select(
        "key", F.least("mine", "other").alias("row"), F.greatest("mine", "other").alias("col"), "mine", "node", "component", "shingles"
    )

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        mine = group["mine"].to_numpy()
        node = group["node"].to_numpy(np.int64)
        sets = [np.frombuffer(x, np.uint64) for x in group["shingles"]]
        left, right = mine == group["row"].iloc[0], mine == group["col"].iloc[0]
        found = cell_links(sets, group["component"].to_numpy(np.int64), left, right)
        return pd.DataFrame({"u": node[[i for i, _ in found]], "v": node[[j for _, j in found]]})

    return cells.groupBy("key", "row", "col").applyInPandas(compare, "u bigint, v bigint")


def _labelled(docs: DataFrame) -> DataFrame:
    """doc_id, t, n_shingles and, for sets that aren't empty, component (a node) and component_id of every document."""
    made = cut(features(docs), "neardup-features")
    # one row of each node stands for it; numbers of nodes are fixed as they are written
    nodes = (
        made.where("h1 is not null")
        .groupBy("h1", "h2", F.col("n_shingles").alias("size"))
        .agg(F.min("doc_id").alias("rep"), F.min_by("t", F.coalesce("doc_id", F.lit((1 << 63) - 1))).alias("rep_t"))
    )
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()), "neardup-nodes")
    names = [made[c] == nodes[c] for c in ("h1", "h2")]
    one = made.join(nodes, [*names, made["doc_id"].eqNullSafe(nodes["rep"]), made["t"] == nodes["rep_t"]])
    rows = one.select(F.explode("bands").alias("key"), "node")
    buckets = cut(rows.groupBy("key").agg(F.min("node").alias("centre"), F.max("node").alias("last"), F.count("*").alias("n")).where("centre <> last"), "neardup-buckets")
    members = cut(rows.join(buckets.hint("merge"), "key").select("key", "n", "node", "centre"), "neardup-members")
    pairs = cut(members.where("node <> centre").select(F.col("node").alias("u"), F.col("centre").alias("v")).distinct(), "neardup-pairs")
    sets = shingles_of(members.select("node").distinct(), nodes, docs)
    links = cut(verified(pairs, nodes, sets), "neardup-links")
    joined = cut(components(links), "neardup-components")

    # buckets of several groups; where there were two nodes only, their one pair is settled
    rows = members.where("n > 2").join(joined, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    several = rows.groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"),
        F.min("node").alias("first"), F.max("node").alias("last"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"),
    )
    # buckets of the same nodes are compared once
    several = several.where("low <> high").groupBy("n", "first", "last", "sum").agg(F.min("key").alias("key")).select("key", "n")
    opened = cut(rows.join(several.hint("merge"), "key"), "neardup-open")
    discard(buckets, members, pairs)
    if opened.head(1):
        more = cut(_cells(opened.join(sets, "node")), "neardup-crossing")
        # the groups so far are stars already, so few rounds are left
        stars = joined.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))
        joined = cut(components(stars.unionByName(more)), "neardup-components")
        discard(more)
    discard(opened, sets)

    named = nodes.join(joined, "node", "left").select("h1", "h2", "rep", F.coalesce("component", "node").alias("component"))
    least = cut(named.groupBy("component").agg(F.min("rep").alias("component_id")), "neardup-least")
    final = cut(named.join(least.hint("merge"), "component").select("h1", "h2", "component", "component_id"), "neardup-names")
    return made.join(final.hint("merge"), ["h1", "h2"], "left").select("doc_id", "t", "n_shingles", "component", "component_id")


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    empty = F.col("component").isNull()
    name = F.when(empty, F.col("doc_id")).otherwise(F.col("component_id"))
    return _labelled(docs).select("doc_id", "n_shingles", name.alias("component_id"), (empty | F.col("doc_id").eqNullSafe(name)).alias("kept"))


def survivors(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keys (__id, __t: the text's hash) of the rows that stay when each group keeps one; the second table has those of repeated rows."""
    rows = _labelled(docs).groupBy(F.col("doc_id").alias("__id"), F.col("t").alias("__t")).agg(F.first("component").alias("component"), F.count("*").alias("n"))
    rows = cut(rows, "neardup-rows")
    best = F.min(F.struct(F.col("__id").isNull().alias("none"), "__id", "__t", "n")).alias("best")
    chosen = rows.where("component is not null").groupBy("component").agg(best).select("best.*")
    keys = chosen.select("__id", "__t", "n").unionByName(rows.where("component is null").select("__id", "__t", F.lit(1).cast("long").alias("n")))
    keys = cut(keys, "neardup-kept")
    return tuple(cut(keys.where(which).select("__id", "__t"), "neardup-kept") for which in ("n = 1", "n > 1"))


def query(spark, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))
