"""Token-id files by a static range asymmetric numeral system.

A file holds segments. A segment has one frequency table, counted over all of its ids and shared by its blocks, an
index of documents, and independent blocks. A block's ids are dealt to LANES interleaved states; a renormalisation
moves 32-bit words. The block directory holds checkpoints (place, ids, words and final states) and a checksum for each
block, so that any block can be decoded by itself, in parallel with the others.

Segment layout (little-endian): magic `RANS2\\0`, u32 documents, u32 symbols, u32 blocks, u64 ids; documents' ids (i64),
whether they are null (u8) and lengths (u32); symbols (u32) and their frequencies (u32, adding up to 2**SCALE); for each block u32 ids, u32 words,
u32 crc32 of its ids; then each block's LANES states (u64) and words (u32). A u64 length stands before each segment and
a u32 crc32 of the segment behind it.

Defined results: null text is empty; an empty text holds the end id alone; a null id is kept as null; repeated rows and
equal ids are kept in order of their text's digest; other columns, whatever their names, are not read; an empty table gives no
file and an empty result.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressleaf.llm.common import chunks, cut, release, scratch, slices, table
from pressleaf.llm.tokens import encoder

MAGIC = b"RANS2\0"
SCALE = 20
LANES = 1024
#: Ids in a block and in a segment, at most (a document of more ids is a segment of its own).
BLOCK, SEGMENT = 1 << 18, 1 << 21
#: Ids after which a file is ended.
FILE = 1 << 24
LOW = 1 << 31


def frequencies(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Counts scaled to add up to 2**scale, 1 at least each."""
    total = 1 << scale
    if len(counts) > total:
        raise ValueError("more symbols than slots")
    freq = np.maximum(1, counts.astype(np.float64) * (total / counts.sum())).astype(np.int64)
    rest = total - int(freq.sum())
    order = np.argsort(-freq, kind="stable")
    if rest > 0:
        freq[order[0]] += rest
    for i in order:  # takes what rounding up has given too much, from the most frequent
        if rest >= 0:
            break
        taken = min(int(freq[i]) - 1, -rest)
        freq[i] -= taken
        rest += taken
    return freq


def encode_block(ids: np.ndarray, freq: np.ndarray, start: np.ndarray, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """States of the lanes and the words, in the order in which the decoder wants them. ids are symbol numbers."""
    rows = -(-len(ids) // LANES)
    state = np.full(LANES, LOW, np.uint64)
    words: list[np.ndarray] = []
    shift, s32 = np.uint64(scale), np.uint64(32)
    limit = np.uint64((LOW >> scale) << 32)
    for r in range(rows - 1, -1, -1):
        part = ids[r * LANES : (r + 1) * LANES]
        f, c = freq[part], start[part]
        x = state[: len(part)]
        over = x >= limit * f
        if over.any():
            words.append((x[over] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
            x = np.where(over, x >> s32, x)
        q = x // f
        state[: len(part)] = (q << shift) + (x - q * f) + c
    return state, np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)


def decode_block(n: int, state: np.ndarray, words: np.ndarray, freq: np.ndarray, start: np.ndarray, symbol: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """symbol: by slot its symbol number."""
    state = state.copy()
    out = np.empty(n, np.int64)
    at, mask, shift, s32 = 0, np.uint64((1 << scale) - 1), np.uint64(scale), np.uint64(32)
    low = np.uint64(LOW)
    for r in range(0, n, LANES):
        m = min(LANES, n - r)
        x = state[:m]
        slot = x & mask
        s = symbol[slot]
        out[r : r + m] = s
        x = freq[s] * (x >> shift) + slot - start[s]
        under = np.flatnonzero(x < low)
        if len(under):
            if at + len(under) > len(words):
                raise ValueError("block too short")
            x[under] = (x[under] << s32) | words[at : at + len(under)]
            at += len(under)
        state[:m] = x
    if at != len(words) or (state != low).any():
        raise ValueError("block does not end where it should")
    return out


def _tables(freq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return freq.astype(np.uint64), np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)


def encode_segment(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """doc_ids and, for each, its ids as little-endian unsigned 32-bit integers."""
    every = np.frombuffer(b"".join(ids), "<u4")
    counts = np.bincount(every)
    symbols = np.flatnonzero(counts)
    number = np.zeros(len(counts), np.int64)
    number[symbols] = np.arange(len(symbols))
    table = frequencies(counts[symbols])
    freq, start = _tables(table)
    dense = number[every]
    directory, bodies = [], []
    for a in range(0, len(every), BLOCK):
        state, words = encode_block(dense[a : a + BLOCK], freq, start)
        directory.append(struct.pack("<III", len(every[a : a + BLOCK]), len(words), zlib.crc32(every[a : a + BLOCK].tobytes())))
        bodies.append(state.astype("<u8").tobytes() + words.astype("<u4").tobytes())
    return b"".join(
        [
            MAGIC,
            struct.pack("<IIIQ", len(doc_ids), len(symbols), len(bodies), len(every)),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            bytes(d is None for d in doc_ids),
            np.array([len(x) // 4 for x in ids], "<u4").tobytes(),
            symbols.astype("<u4").tobytes(),
            table.astype("<u4").tobytes(),
            *directory,
            *bodies,
        ]
    )


class Segment:
    """A segment's tables and directory; block(i) decodes one block by itself."""

    def __init__(self, data: bytes):
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a segment")
        self.data, at = data, len(MAGIC)
        docs, count, blocks, self.total = struct.unpack_from("<IIIQ", data, at)
        at += 20

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(data, kind, n, at)
            at += got.nbytes
            return got

        names, missing = take("<i8", docs).tolist(), take("u1", docs).tolist()
        self.doc_ids = [None if none else d for d, none in zip(names, missing, strict=True)]
        self.sizes, self.symbols = take("<u4", docs).astype(np.int64), take("<u4", count)
        table = take("<u4", count).astype(np.int64)
        self.freq, self.start = _tables(table)
        self.slots = np.repeat(np.arange(count), table)
        self.directory = take("<u4", 3 * blocks).reshape(-1, 3).astype(np.int64)
        lengths = 8 * LANES + 4 * self.directory[:, 1]
        self.places = at + np.cumsum(lengths) - lengths

    def block(self, i: int) -> np.ndarray:
        n, words, crc = self.directory[i].tolist()
        at = int(self.places[i])
        state = np.frombuffer(self.data, "<u8", LANES, at).astype(np.uint64)
        body = np.frombuffer(self.data, "<u4", words, at + 8 * LANES).astype(np.uint64)
        got = self.symbols[decode_block(n, state, body, self.freq, self.start, self.slots)]
        if zlib.crc32(got.tobytes()) != crc:
            raise ValueError("a block's checksum differs")
        return got


def decode_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, their lengths, and all ids one after another."""
    found = Segment(data)
    parts = [found.block(i) for i in range(len(found.directory))]
    every = np.concatenate(parts) if parts else np.zeros(0, "<u4")
    if len(every) != found.total:
        raise ValueError("ids are missing")
    return found.doc_ids, found.sizes, every


def segments(data: bytes):
    """The segments of a file's bytes; raises ValueError on damage."""
    at = 0
    while at < len(data):
        (size,) = struct.unpack_from("<Q", data, at)
        part = data[at + 8 : at + 8 + size]
        if len(part) != size or struct.unpack_from("<I", data, at + 8 + size)[0] != zlib.crc32(part):
            raise ValueError("a segment's checksum differs")
        yield decode_segment(part)
        at += 12 + size


def write(docs: DataFrame, path: str, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """Writes the files of each range of ids, in ascending order of id and name; returns (file, docs, ids).

    A file ends with the segment that brings it to FILE ids or more, so that one fits a task's memory. A file is written under a name of its own by each attempt and then renamed, so a lost executor leaves no half file.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("digest", F.xxhash64("text"))
    ordered = source.repartitionByRange(parts, "doc_id", "digest").sortWithinPartitions("doc_id", "digest").select("doc_id", "text")

    def run(batches):
        import uuid

        from pyarrow import fs
        from pyspark import TaskContext

        place, folder = fs.FileSystem.from_uri(path)
        held: list[tuple[int | None, bytes]] = []
        out, own, number, size, n_docs, n_ids = None, "", 0, 0, 0, 0

        def flush():
            data = encode_segment([d for d, _ in held], [x for _, x in held])
            out.write(struct.pack("<Q", len(data)) + data + struct.pack("<I", zlib.crc32(data)))
            held.clear()

        def end():
            name = f"ids-{TaskContext.get().partitionId():06d}-{number:06d}.rans"
            out.close()
            place.move(own, f"{folder}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n_docs], pa.int64()), pa.array([n_ids], pa.int64())], names=["file", "docs", "ids"])

        for batch in (part for whole in batches for part in slices(whole, 2 << 20)):
            for d, x in zip(batch.column(0).to_pylist(), encoder(vocabulary).batch(batch.column(1).to_pylist()), strict=True):
                if held and size + len(x) // 4 > SEGMENT:
                    flush()
                    size = 0
                    if n_ids >= FILE:
                        yield end()
                        out, number, n_docs, n_ids = None, number + 1, 0, 0
                if out is None:
                    place.create_dir(folder, recursive=True)
                    own = f"{folder}/.{uuid.uuid4().hex}"
                    out = place.open_output_stream(own)
                held.append((d, x))
                size += len(x) // 4
                n_docs, n_ids = n_docs + 1, n_ids + len(x) // 4
        if out is not None:
            if held:
                flush()
            yield end()
        release()

    return cut(ordered.mapInArrow(run, "file string, docs bigint, ids bigint"), "rans-files")


def read(spark: SparkSession, path: str) -> DataFrame:
    """file, doc_id, place (ids before it in the file), ids (little-endian unsigned 32-bit), in the files' order."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                before = 0
                for docs, sizes, every in segments(content.as_py()):
                    place = np.concatenate([[0], np.cumsum(sizes)])
                    data = every.astype("<u4").tobytes()
                    for a, b in chunks(sizes.tolist(), 1 << 20):
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([name.rpartition("/")[2]] * (b - a)),
                                pa.array(docs[a:b], pa.int64()),
                                pa.array(before + place[a:b], pa.int64()),
                                pa.array([data[4 * place[i] : 4 * place[i + 1]] for i in range(a, b)], pa.binary()),
                            ],
                            names=["file", "doc_id", "place", "ids"],
                        )
                    before += int(place[-1])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.rans").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, doc_id bigint, place bigint, ids binary")


def query(spark, sf_dir: str) -> DataFrame:
    path = scratch(spark, "rans")
    # one row for each file: bounded by the number of partitions
    made = sorted((r["file"], r["ids"]) for r in write(table(spark, sf_dir, "documents"), path).collect())
    offsets, at = [], 0
    for name, n in made:
        offsets.append((name, at))
        at += n
    if not offsets:
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    first = spark.createDataFrame(offsets, "file string, before bigint")
    rows = read(spark, path).select("file", "doc_id", "place", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    return rows.join(F.broadcast(first), "file").select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")
