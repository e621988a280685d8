"""AVI motion-JPEG columns: a lossless byte store, a RIFF/JPEG reader and shot detection.

Store: a payload becomes frames of 192 samples. A sample is one 8x8 block whose DC coefficient alone is set (quantiser
8), so a baseline JPEG frame holds it without loss and any decoder shows 16 x 12 flat squares. All frames of a payload go
into one RIFF AVI stream (fourcc MJPG) with an `idx1` index.

Reader: walks the RIFF chunks, takes frame places from `idx1` (or from the movi list where the index is missing or
wrong), decodes the intra frames' DC planes, and cuts shots where the histogram difference of neighbouring frames rises
above an adaptive threshold (mean and deviation of the differences around it).

Defined results: null text counts as empty, an empty text is one frame of spaces; equal texts give equal values;
repeated rows are handled each by itself; a very long text is one long clip, handled in runs of frames; an empty table
gives an empty result; input columns named like a result column are replaced.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressleaf.llm.common import annotate, chunks, table

WIDTH, HEIGHT = 16, 12  # samples; 8 pixels each way
UNIT = WIDTH * HEIGHT
FPS = 25
#: Frames coded at once.
RUN = 8192

#: DC table: categories 0..8 as 4-bit codes 0..8; AC table: the end of a block as the 1-bit code 0.
_HEAD = (
    b"\xff\xd8"
    + b"\xff\xdb" + struct.pack(">HB", 67, 0) + b"\x08" + b"\x01" * 63
    + b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, HEIGHT * 8, WIDTH * 8, 1) + b"\x01\x11\x00"
    + b"\xff\xc4" + struct.pack(">HB", 3 + 16 + 9, 0x00) + bytes([0, 0, 0, 9] + [0] * 12) + bytes(range(9))
    + b"\xff\xc4" + struct.pack(">HB", 3 + 16 + 1, 0x10) + bytes([1] + [0] * 15) + b"\x00"
    + b"\xff\xda" + struct.pack(">HB", 8, 1) + b"\x01\x00" + b"\x00\x3f\x00"
)
_TAIL = b"\xff\xd9"
_CATEGORY = np.array([int(x).bit_length() for x in range(256)], np.int64)


def payload(text: str | None) -> bytes:
    """UTF-8 bytes with bytes 32 up to a positive multiple of 192."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b" " * (-len(data) % UNIT if data else UNIT)


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """Entropy-coded scans (stuffed) of frames x UNIT samples."""
    frames = len(samples)
    v = samples.astype(np.int64) - 128
    diff = np.diff(v, axis=1, prepend=0)
    size = _CATEGORY[np.abs(diff)]
    value = np.where(diff < 0, diff + (1 << size) - 1, diff)
    # category (4 bits), value (size bits), end of block (one 0 bit)
    word = (((size << size) | value) << 1).ravel()
    width = (size + 5).ravel()
    stop = np.cumsum((size + 5), axis=1)
    total = stop[:, -1]
    bytes_of = (total + 7) // 8
    base = np.concatenate([[0], np.cumsum(bytes_of)])
    at = (base[:-1, None] * 8 + stop).ravel() - width
    out = np.zeros(int(base[-1]) + 4, np.uint8)
    shifted = word << (32 - width - (at & 7))
    place = at >> 3
    for k in range(3):  # a symbol of 13 bits at most touches three bytes
        part = (shifted >> (24 - 8 * k)) & 0xFF
        hit = np.flatnonzero(part)
        out += np.bincount(place[hit] + k, weights=part[hit], minlength=len(out)).astype(np.uint8)
    pad = (bytes_of * 8 - total).astype(np.int64)
    out[base[1:] - 1] |= ((1 << pad) - 1).astype(np.uint8)
    out = out[:-4]
    full = np.flatnonzero(out == 0xFF)
    if len(full):
        base = base + np.searchsorted(full, base, side="left")
        out = np.insert(out, full + 1, 0)
    data = out.tobytes()
    return [data[base[i] : base[i + 1]] for i in range(frames)]


def decode_scans(scans: list[bytes]) -> np.ndarray:
    """The samples of scans made with the tables above, all frames in step; raises ValueError on damage."""
    joined = np.frombuffer(b"".join(scans), np.uint8)
    base = np.concatenate([[0], np.cumsum([len(s) for s in scans])]).astype(np.int64)
    stuffed = np.flatnonzero((joined[1:] == 0) & (joined[:-1] == 0xFF)) + 1
    data = np.delete(joined, stuffed) if len(stuffed) else joined
    base = base - np.searchsorted(stuffed, base, side="left")
    data = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.int64)
    window = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    at, limit = base[:-1] * 8, base[1:] * 8
    out = np.empty((len(scans), UNIT), np.int64)
    last = np.zeros(len(scans), np.int64)
    top = len(window) - 1
    for k in range(UNIT):
        bits = (window[np.minimum(at >> 3, top)] << (at & 7)) & 0xFFFFFFFF
        size = bits >> 28
        if size.max(initial=0) > 8:
            raise ValueError("no such category")
        value = (bits >> (28 - size)) & ((1 << size) - 1)
        last = last + np.where((size > 0) & (value >> np.maximum(size - 1, 0) == 0), value - (1 << size) + 1, value)
        out[:, k] = last
        at = at + size + 5
    if (at > limit).any():
        raise ValueError("scan too short")
    return (out + 128).astype(np.uint8)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return kind + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)


def _list(kind: bytes, data: bytes) -> bytes:
    return _chunk(b"LIST", kind + data)


def to_avi(scans: list[bytes]) -> bytes:
    """One AVI file of the frames."""
    frames = [_HEAD + s + _TAIL for s in scans]
    most = max(map(len, frames))
    w, h, n = WIDTH * 8, HEIGHT * 8, len(frames)
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, n, 0, 1, most, w, h, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, FPS, 0, n, most, 0xFFFFFFFF, 0, 0, 0, w, h)
    strf = struct.pack("<IiiHH4sIiiII", 40, w, h, 1, 24, b"MJPG", w * h * 3, 0, 0, 0, 0)
    header = _list(b"hdrl", _chunk(b"avih", avih) + _list(b"strl", _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    body, index, at = [], [], 4
    for f in frames:
        made = _chunk(b"00dc", f)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        body.append(made)
        at += len(made)
    riff = b"AVI " + header + _list(b"movi", b"".join(body)) + _chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(riff)) + riff


def _walk(data: bytes, at: int, stop: int):
    while at + 8 <= stop:
        kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        yield kind, at + 8, min(at + 8 + size, stop)
        at += 8 + size + (size & 1)


def parse_avi(data: bytes) -> tuple[float, list[tuple[int, int]]]:
    """Frames a second and (start, stop) of every video frame; raises ValueError if it is no AVI."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    fps, movi, index = float(FPS), None, b""
    for kind, a, b in _walk(data, 12, len(data)):
        if kind == b"LIST" and data[a : a + 4] == b"hdrl":
            for k, x, _ in _walk(data, a + 4, b):
                if k == b"avih":
                    micros = struct.unpack_from("<I", data, x)[0]
                    fps = 1e6 / micros if micros else fps
        elif kind == b"LIST" and data[a : a + 4] == b"movi":
            movi = (a, b)
        elif kind == b"idx1":
            index = data[a:b]
    if movi is None:
        return fps, []
    frames = []
    for name, _, at, size in struct.iter_unpack("<4sIII", index[: len(index) // 16 * 16]):
        if name[2:] in (b"dc", b"db"):
            start = movi[0] + at + 8
            if data[start - 8 : start - 4] != name or start + size > movi[1]:
                frames = []
                break
            frames.append((start, start + size))
    if not frames:
        frames = [(a, b) for kind, a, b in _walk(data, movi[0] + 4, movi[1]) if kind[2:] in (b"dc", b"db")]
    return fps, frames


def read_samples(data: bytes) -> tuple[float, np.ndarray]:
    """Frames a second and the frames' DC planes (frames x UNIT)."""
    fps, places = parse_avi(data)
    scans = []
    for a, b in places:
        if data[a : a + len(_HEAD)] != _HEAD or data[b - 2 : b] != _TAIL:
            raise ValueError("a frame of another JPEG profile")
        scans.append(data[a + len(_HEAD) : b - 2])
    runs = [decode_scans(scans[i : i + RUN]) for i in range(0, len(scans), RUN)]
    return fps, np.concatenate(runs) if runs else np.zeros((0, UNIT), np.uint8)


def shots(samples: np.ndarray, bins: int = 16, span: int = 8, factor: float = 3.0) -> list[tuple[int, int]]:
    """(first frame, frame after the last) of each shot.

    A cut stands where the L1 difference of neighbouring luminance histograms exceeds the mean plus `factor`
    deviations of the differences within `span` frames on both sides (itself left out), and is the largest of them.
    """
    n = len(samples)
    if n < 3:
        return [(0, n)] if n else []
    level = samples >> (8 - bins.bit_length() + 1)
    hist = np.bincount((np.arange(n)[:, None] * bins + level).ravel(), minlength=n * bins).reshape(n, bins)
    d = np.abs(np.diff(hist, axis=0)).sum(1) / (2.0 * samples.shape[1])
    m = len(d)
    sums = np.concatenate([[0.0], np.cumsum(d)])
    squares = np.concatenate([[0.0], np.cumsum(d * d)])
    low, high = np.maximum(np.arange(m) - span, 0), np.minimum(np.arange(m) + span + 1, m)
    count = np.maximum(high - low - 1, 1)
    mean = (sums[high] - sums[low] - d) / count
    dev = np.sqrt(np.maximum((squares[high] - squares[low] - d * d) / count - mean * mean, 0.0))
    peak = (d >= np.append(d[1:], -1)) & (d > np.insert(d[:-1], 0, -1))
    cuts = np.flatnonzero(peak & (d > mean + factor * dev + 0.02)) + 1
    edges = [0, *cuts.tolist(), n]
    return list(zip(edges[:-1], edges[1:], strict=True))


def store(docs: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """Adds n_bytes and media (the AVI file of the row's text)."""
    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]

    def of_batch(batch: pa.RecordBatch) -> dict:
        texts = batch.column("text").to_pylist()
        data = [payload(t) for t in texts]
        media: list[bytes] = []
        for a, b in chunks([len(x) // UNIT for x in data], RUN):
            samples = np.frombuffer(b"".join(data[a:b]), np.uint8).reshape(-1, UNIT)
            scans: list[bytes] = []
            for i in range(0, len(samples), RUN):
                scans += encode_frames(samples[i : i + RUN])
            at = 0
            for x in data[a:b]:
                n = len(x) // UNIT
                media.append(to_avi(scans[at : at + n]))
                at += n
        return {"n_bytes": [len((t or "").encode("utf-8", "surrogatepass")) for t in texts], "media": pa.array(media, pa.binary())}

    return annotate(docs, fields, of_batch, drop)


_CLIP = T.ArrayType(
    T.StructType(
        [
            T.StructField("clip", T.IntegerType()),
            T.StructField("first_frame", T.IntegerType()),
            T.StructField("frames", T.IntegerType()),
            T.StructField("start_s", T.DoubleType()),
            T.StructField("end_s", T.DoubleType()),
            T.StructField("mean_level", T.DoubleType()),
        ]
    )
)


def read_back(stored: DataFrame, drop: tuple[str, ...] = ("media",)) -> DataFrame:
    """Adds what the stored media hold: payload size and digests, media size and digest, and timed clips."""
    fields = [
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()),
        T.StructField("media_sha256", T.StringType()),
        T.StructField("clips", _CLIP),
    ]

    def of_batch(batch: pa.RecordBatch) -> dict:
        media = batch.column("media").to_pylist()
        parsed = [parse_avi(m) for m in media]
        out: dict[str, list] = {f.name: [] for f in fields}
        for a, b in chunks([len(p[1]) for p in parsed], RUN):
            scans, sizes = [], []
            for m, (_, places) in zip(media[a:b], parsed[a:b], strict=True):
                sizes.append(len(places))
                for x, y in places:
                    if m[x : x + len(_HEAD)] != _HEAD or m[y - 2 : y] != _TAIL:
                        raise ValueError("a frame of another JPEG profile")
                    scans.append(m[x + len(_HEAD) : y - 2])
            planes = np.concatenate([decode_scans(scans[i : i + RUN]) for i in range(0, len(scans), RUN)])
            at = 0
            for m, (fps, _), n in zip(media[a:b], parsed[a:b], sizes, strict=True):
                own = planes[at : at + n]
                at += n
                data = own.tobytes()
                out["payload_bytes"].append(len(data))
                out["payload_sha256"].append(hashlib.sha256(data).hexdigest())
                out["tail_crc32"].append(zlib.crc32(data[-16:]))
                out["media_bytes"].append(len(m))
                out["media_sha256"].append(hashlib.sha256(m).hexdigest())
                out["clips"].append(
                    [
                        {"clip": i, "first_frame": x, "frames": y - x, "start_s": x / fps, "end_s": y / fps, "mean_level": float(own[x:y].mean())}
                        for i, (x, y) in enumerate(shots(own))
                    ]
                )
        return out

    return annotate(stored, fields, of_batch, drop)


def clips(media: DataFrame) -> DataFrame:
    """One row for each shot of rows that read_back gave."""
    return media.select("*", F.inline("clips")).drop("clips")


def query(spark, sf_dir: str) -> DataFrame:
    stored = store(table(spark, sf_dir, "documents").select("doc_id", "text"), drop=("text",))
    back = read_back(stored)
    feature = F.concat_ws(
        ";",
        F.concat(F.lit("shots="), F.size("clips")),
        F.array_join(F.transform("clips", lambda c: F.concat_ws(":", c["first_frame"], c["frames"], F.format_number(c["mean_level"], 3))), ","),
    )
    return back.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature")
    )
