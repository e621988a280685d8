"""Best-fit packing of documents into sequences by a grouping genetic algorithm on islands.

Documents are tokenised and cut into pieces: only documents longer than a sequence are cut, their first piece is the
shorter one, and full pieces are sequences of their own. The rest is dealt into blocks of bounded size. Each block is
evolved on several islands (tasks of their own): an individual is a grouping of the block's pieces into bins; crossover
injects whole well-filled bins of one parent into the other, removes the bins that hold duplicates, and puts displaced
pieces back by best fit, largest first. Between epochs every island gets the elite of its neighbour; the best individual
of a block wins. Bins that stay badly filled are pooled across blocks and packed once more.

Defined results: null text is empty, and an empty text is one piece that holds the end id alone; repeated rows are
packed each by itself; equal lengths are interchangeable, so ties are settled by the row's number; other columns, whatever
their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressleaf.llm.common import cut, release, slices, table
from pressleaf.llm.tokens import encoder

CAPACITY = 1024
#: Children of an island in each epoch.
ROUNDS = 20
#: Bytes of text tokenised at once in a task.
CHUNK = 2 << 20


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k.json", ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if wanted, ids (little-endian unsigned 32-bit) of every piece."""
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 6 if ids else 5]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(kinds)]

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, CHUNK)):
            rows = []
            texts = batch.column(1).to_pylist()
            for doc, data in zip(batch.column(0).to_pylist(), encoder(vocabulary).batch(texts), strict=True):
                n, at = len(data) // 4, 0
                stop = n % capacity or capacity
                k = 0
                while at < n:
                    own = data[4 * at : 4 * stop]
                    rows.append((doc, k, at, stop - at, zlib.crc32(own), own)[: len(kinds)])
                    at, stop, k = stop, stop + capacity, k + 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        release()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * ids)


def best_fit(lengths: list[int], capacity: int, rooms: list[int] | None = None) -> tuple[list[int], list[int]]:
    """Best fit in the given order: the bin of each piece and the room left in each bin (rooms: of bins there already)."""
    left = list(rooms or [])
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i, r in enumerate(left):
        by_room[r].append(i)
        mask |= 1 << r
    out = []
    for n in lengths:
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            i = by_room[room].pop()
            if not by_room[room]:
                mask ^= 1 << room
        else:
            i, room = len(left), capacity
            left.append(capacity)
        left[i] = room = room - n
        by_room[room].append(i)
        mask |= 1 << room
        out.append(i)
    return out, left


def _fitness(bins: np.ndarray, lengths: np.ndarray) -> tuple[int, float]:
    """Fewer bins first, then fuller ones (sum of squared fills)."""
    fill = np.bincount(bins, weights=lengths)
    return -len(fill), float((fill * fill).sum())


def crossover(a: np.ndarray, b: np.ndarray, lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """A child of a that has got well-filled bins of b whole."""
    fill = np.bincount(b, weights=lengths)
    good = np.flatnonzero(fill >= capacity - rng.integers(0, 2 + capacity // 128))
    if not len(good):
        good = fill.argsort()[-max(1, len(fill) // 10) :]
    chosen = np.zeros(len(fill), bool)
    chosen[rng.choice(good, max(1, int(len(good) * rng.uniform(0.2, 0.6))), replace=False)] = True
    injected = chosen[b]
    broken = np.zeros(a.max() + 1, bool)
    broken[a[injected]] = True  # bins of a that hold an injected piece go; their other pieces are displaced
    kept = ~injected & ~broken[a]
    fills = np.bincount(a[kept], weights=lengths[kept], minlength=len(broken))
    # a few of the emptiest bins are opened too, so that displaced pieces can be combined anew
    open_bins = np.flatnonzero((fills > 0) & (fills < 0.97 * capacity))
    if len(open_bins):
        opened = np.zeros(len(broken), bool)
        opened[open_bins] = True
        kept &= ~opened[a]
    child = np.full(len(a), -1)
    _, child[injected] = np.unique(b[injected], return_inverse=True)
    base = int(child.max()) + 1
    if kept.any():
        _, renamed = np.unique(a[kept], return_inverse=True)
        child[kept] = base + renamed
        base = int(child.max()) + 1
    lost = np.flatnonzero(child < 0)
    if len(lost):
        rooms = (capacity - np.bincount(child[child >= 0], weights=lengths[child >= 0], minlength=base)).astype(int).tolist()
        order = lost[np.argsort(-lengths[lost] + rng.uniform(-8, 8, len(lost)), kind="stable")]
        child[order], _ = best_fit(lengths[order].tolist(), capacity, rooms)
    return child


def evolve(lengths: np.ndarray, seed: int, capacity: int = CAPACITY, elite: np.ndarray | None = None, size: int = 4, rounds: int = ROUNDS) -> np.ndarray:
    """Bin of each piece after some generations on one island; lengths must be in 1..capacity."""
    rng = np.random.default_rng(seed)
    population = []
    for i in range(size - (elite is not None)):
        noise = 0.0 if i == 0 else rng.uniform(-12, 12, len(lengths))
        order = np.argsort(-lengths + noise, kind="stable")
        bins = np.empty(len(lengths), int)
        bins[order], _ = best_fit(lengths[order].tolist(), capacity)
        population.append(bins)
    if elite is not None:
        population.append(elite)
    scored = sorted(((_fitness(p, lengths), i) for i, p in enumerate(population)), reverse=True)
    population = [population[i] for _, i in scored]
    least = -(-int(lengths.sum()) // capacity)
    for _ in range(rounds):
        if -_fitness(population[0], lengths)[0] <= least:
            break
        i, j = rng.choice(len(population), 2, replace=False) if len(population) > 1 else (0, 0)
        child = crossover(population[i], population[j], lengths, capacity, rng)
        population.append(child)
        population.sort(key=lambda p: _fitness(p, lengths), reverse=True)
        population = population[:size]
    return population[0]


def _epoch(rows: DataFrame, capacity: int, rounds: int, salt: int) -> DataFrame:
    """Evolves each (block, island); a `bin` in the rows is the migrated elite."""
    migrated = "bin" in rows.columns

    def island(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("uid", kind="stable")
        lengths = group["length"].to_numpy(np.int64)
        elite = np.unique(group["bin"].to_numpy(), return_inverse=True)[1] if migrated else None
        seed = [salt, int(group["block"].iloc[0]) & 0x7FFFFFFF, int(group["island"].iloc[0])]
        bins = evolve(lengths, seed, capacity, elite, rounds=rounds)
        _, bins = np.unique(bins, return_inverse=True)
        count, squares = _fitness(bins, lengths)
        return group[["uid", "length", "block", "island"]].assign(bin=bins.astype(np.int64), bins=-count, squares=squares)

    schema = "uid bigint, length bigint, block bigint, island int, bin bigint, bins bigint, squares double"
    return rows.groupBy("block", "island").applyInPandas(island, schema)


def _pack_blocks(items: DataFrame, capacity: int, block: int, islands: int, rounds: int, salt: int) -> DataFrame:
    """uid, length, group: the winning grouping of each block of about `block` items."""
    n = items.count()
    blocks = max(1, round(n / block))
    dealt = items.select("uid", "length", F.pmod(F.xxhash64("uid", F.lit(salt)), F.lit(blocks)).alias("block"))
    rows = dealt.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
    first = cut(_epoch(rows, capacity, rounds, salt), "pack-islands")
    if islands > 1:
        # migration: an island's elite goes on in its neighbour's next epoch
        moved = first.withColumn("island", ((F.col("island") + 1) % islands).cast("int")).drop("bins", "squares")
        first = cut(_epoch(moved, capacity, rounds, salt + 1), "pack-islands")
    # one row for each block and island
    best = (
        first.groupBy("block", "island")
        .agg(F.first("bins").alias("bins"), F.first("squares").alias("squares"))
        .groupBy("block")
        .agg(F.min_by("island", F.struct("bins", -F.col("squares"), "island")).alias("island"))
    )
    return first.join(best, ["block", "island"]).select("uid", "length", "block", "bin")


def pack(items: DataFrame, capacity: int = CAPACITY, block: int = 4096, islands: int = 3, rounds: int = ROUNDS) -> DataFrame:
    """uid, length of pieces (1..capacity) -> uid, sequence_id, offset. sequence_id is the smallest uid in the sequence."""
    short = items.where(F.col("length") < capacity).select("uid", "length")
    full = items.where(F.col("length") == capacity).select("uid", F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    first = _pack_blocks(short, capacity, block, islands, rounds, 1)
    fills = first.groupBy("block", "bin").agg(F.sum("length").alias("fill"), F.min("uid").alias("sequence_id"))
    grouped = cut(first.join(fills, ["block", "bin"]), "pack-first")
    # badly filled bins of all blocks are pooled and packed anew
    poor = F.col("fill") < int(0.985 * capacity)
    second = _pack_blocks(grouped.where(poor), capacity, 4 * block, islands, rounds, 11)
    named = second.groupBy("block", "bin").agg(F.min("uid").alias("sequence_id"))
    again = second.join(named, ["block", "bin"]).select("uid", "length", "sequence_id")
    every = grouped.where(~poor).select("uid", "length", "sequence_id").unionByName(again)
    # a sequence holds at most `capacity` pieces, so its window is bounded
    from pyspark.sql.window import Window

    place = Window.partitionBy("sequence_id").orderBy("uid")
    offset = F.sum("length").over(place.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")
    return every.select("uid", "sequence_id", offset.alias("offset")).unionByName(full)


def packed(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of docs with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = cut(pieces(docs, capacity, ids=False).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    return rows.join(pack(rows, capacity), "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def query(spark, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
