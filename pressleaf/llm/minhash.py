"""SuperMinHash signatures of word-shingle sets, vectorised over many texts at once.

A text's set is made of 64-bit hashes of its distinct 5-word shingles. In a signature, element by element, wave j of an
element's own random permutation gives slot p_j the rank j + r_j; a slot keeps the least rank. Ranks of wave j are in
[j, j + 1), so once every slot of a text is filled no later wave can lower one, and the text stops early.
"""

from __future__ import annotations

import numpy as np
import xxhash

SLOTS, ROWS = 128, 4
BANDS = SLOTS // ROWS
WORDS = 5

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_STEP = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(1, 257, dtype=np.uint64)
_LOWER[65:91] = _LOWER[97:123]
_BLOCK = 1 << 20
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit hashes (xor-shift and multiply)."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, _BLOCK + 1)
        made = []
        for base in (_BASE, _INVERSE):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            made.append(np.cumprod(x, dtype=np.uint64))
        if n > 4 * _BLOCK:  # a single huge word; not kept
            return made[0], made[1]
        _powers[:] = made
    return _powers[0], _powers[1]


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of one block; no word crosses its ends."""
    edge = np.diff(np.concatenate([[True], _SPACE[data], [True]]).astype(np.int8))
    start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _power(len(data) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LOWER[data] * up[: len(data)], dtype=np.uint64)])
    h = (total[stop] - total[start]) * down[start]
    return start, mix(h + (stop - start).astype(np.uint64) * _STEP[0])


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word, block by block so that long texts need no more memory than their words."""
    whole = np.frombuffer(data, np.uint8)
    if len(whole) <= 2 * _BLOCK:
        return _words(whole)
    starts, hashes, at = [], [], 0
    while at < len(whole):
        end = min(at + _BLOCK, len(whole))
        if end < len(whole):
            spaces = np.flatnonzero(_SPACE[whole[at:end]])
            while not len(spaces) and end < len(whole):
                more = min(end + _BLOCK, len(whole))
                spaces = np.flatnonzero(_SPACE[whole[end:more]]) + (end - at)
                end = more
            if len(spaces) and end < len(whole):
                end = at + int(spaces[-1]) + 1
        s, h = _words(whole[at:end])
        starts.append(s + at)
        hashes.append(h)
        at = end
    return np.concatenate(starts), np.concatenate(hashes)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    start, w = word_hashes(b" ".join(texts))
    ends = np.cumsum([len(t) + 1 for t in texts])
    at = np.concatenate([[0], np.searchsorted(start, ends, side="left")])
    if len(w) >= WORDS:
        n = len(w) - WORDS + 1
        s = np.zeros(n, np.uint64)
        for k in range(WORDS):
            s += w[k : n + k] * _STEP[k]
        s = mix(s)
    out = []
    for i in range(len(texts)):
        a, b = int(at[i]), int(at[i + 1])
        if b - a >= WORDS:
            out.append(np.unique(s[a : b - WORDS + 1]))
        elif b > a:
            out.append(np.array([xxhash.xxh3_64_intdigest(w[a:b].tobytes(), seed=b - a)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _draw(h: np.ndarray, j: int) -> np.ndarray:
    """The element's j-th random number: the rank's fraction in the upper half, the place in the lower."""
    return mix(h + _U(((j + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))


def _place(u: np.ndarray, j: int, slots: int) -> np.ndarray:
    return (_U(j) + (((u & _U(0xFFFFFFFF)) * _U(slots - j)) >> _U(32))).astype(np.int64)


def signatures(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """Ranks (wave in the upper 32 bits, fraction below) of every slot; all ones for empty sets."""
    size = np.array([len(s) for s in sets])
    sig = np.full((len(sets), slots), 0xFFFFFFFFFFFFFFFF, np.uint64)
    flat = sig.reshape(-1)
    live = np.flatnonzero(size)
    if not len(live):
        return sig
    h = np.concatenate([sets[i] for i in live])
    doc = np.repeat(live, size[live])
    first = p = None
    for j in range(slots):
        u = _draw(h, j)
        k = _place(u, j, slots)
        if j == 0:
            slot = first = k
        elif j == 1:  # after wave 0, places 0 and `first` are exchanged
            slot = np.where(k == first, 0, k)
        else:
            rows = np.arange(len(h))
            if p is None:
                p = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(h), 1))
                for t, place in ((0, first), (1, second)):
                    p[:, t], p[rows, place] = p[rows, place], p[:, t].copy()
            slot = p[rows, k].astype(np.int64)
            p[rows, k] = p[:, j]
            p[:, j] = slot
        if j == 1:
            second = k
        np.minimum.at(flat, doc * slots + slot, (_U(j) << _U(32)) | (u >> _U(32)))
        open_ = (sig[live] == _U(0xFFFFFFFFFFFFFFFF)).any(1)
        if not open_.all():
            live = live[open_]
            if not len(live):
                break
            wanted = np.zeros(len(sets), bool)
            wanted[live] = True
            keep = wanted[doc]
            h, doc, first = h[keep], doc[keep], first[keep]
            if j >= 1:
                second = second[keep]
            if p is not None:
                p = p[keep]
    return sig


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A hash of each band of `rows` slots, with the band's number in it."""
    bands = sig.reshape(len(sig), -1, rows)
    key = np.arange(bands.shape[1], dtype=np.uint64)[None, :] * _STEP[4] + _STEP[3]
    for r in range(rows):
        key = mix(key ^ (bands[:, :, r] * _STEP[r]))
    return key.astype(np.int64)


def name_of(shingles: np.ndarray) -> tuple[int, int]:
    """A 128-bit name of a set, as two signed 64-bit numbers."""
    name = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return (name >> 64) - (1 << 63), (name & 0xFFFFFFFFFFFFFFFF) - (1 << 63)
