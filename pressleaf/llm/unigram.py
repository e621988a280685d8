"""SentencePiece sampling without replacement, and decoding.

A text's lattice has an edge for every vocabulary piece (byte pieces for characters without one). Pieces get unigram
weights from their ranks by Zipf's law, since the public vocabulary was made by merges and states ranks only. Segmentations
are sampled without replacement by a perturbed A* search: the tree of prefixes is opened from the top; a node's value is
the largest Gumbel-perturbed log probability among the segmentations below it. The best node is popped, its argmax path is
completed, and the subtrees beside that path enter the queue with Gumbels truncated at the path's value; so segmentations
come out distinct and in order of their perturbed values. With the value that follows the last emitted one as threshold,
every sample carries its inclusion score 1 - exp(-exp(log p - threshold)).

No piece crosses the start of a run of word marks, a line end, or the place between a letter and a mark of punctuation
(checked against the vocabulary when it is loaded), so the lattice is a chain of small lattices, one for each unit between
such places, that are built once each and remembered.

Random numbers are a hash of the seed, the row's key, the sample and the place, so results don't depend on partitions.

Defined results: null text counts as empty; an empty text has the empty segmentation alone, at log probability 0; texts
with fewer than k segmentations give all of them, inclusion 1; a null key counts as 0; rows with equal key and text get
equal samples; `▁` in a text decodes as a space; very long texts are sampled whole; other columns, whatever their names, are
not read; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressleaf.llm.common import chunks, table
from pressleaf.llm.minhash import mix

MARK = "▁"
#: Characters of text sampled at once in a task; lattices that a worker remembers, and the longest such unit.
CHUNK, REMEMBERED, LONGEST = 1 << 21, 300_000, 48
#: Samples of a text at most.
MOST = 16
_PUNCTUATION, _LETTER = ".,;:!?", r"[^\W\d_]"
_U = np.uint64
_GOLD, _STEP, _PLACE = _U(0x9E3779B97F4A7C15), _U(0xD1342543DE82EF95), _U(0xA0761D6478BD642F)


class Vocabulary:
    def __init__(self, name: str = "piece_bpe_32k.model"):
        import public_tokenizers
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.byte_of = {i: int(self.pieces[i][3:5], 16) for i in range(n) if model.is_byte(i)}
        self.of_byte = {b: i for i, b in self.byte_of.items()}
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        whole = math.log(sum(1.0 / (r + 1) for r in range(len(plain))))
        self.weight = {self.pieces[i]: (-math.log(r + 1) - whole, i) for r, i in enumerate(plain)}
        self.byte_weight = -math.log(len(plain)) - whole
        self.longest = max(map(len, self.weight))
        # where a unit may end: checked, so that another vocabulary is cut less finely instead of wrongly
        pairs = {(a, b) for p in self.weight for a, b in zip(p, p[1:])}
        if any(b == MARK and a != MARK for a, b in pairs) or any("\n" in x for x in pairs):
            raise ValueError("pieces cross word marks or line ends")
        self._trie()
        letter = re.compile(_LETTER).match
        stops = "".join(c for c in _PUNCTUATION if not any(b == c and letter(a) for a, b in pairs))
        self.units = self._units(stops)

    def _units(self, stops: str):
        """The function that splits a text into units; `stops` begin one wherever they follow a letter."""
        if not stops:
            return re.compile(f"{MARK}+[^{MARK}\n]*|\n+|[^{MARK}\n]+").findall
        run = f"[^{MARK}\n{stops}]*"
        rest = f"{run}(?:(?<!{_LETTER})[{stops}]+{run})*"
        return re.compile(f"{MARK}+{rest}|\n+|[^{MARK}\n]{rest}").findall

    def _trie(self) -> None:
        """Transitions (state and code point -> state) as sorted keys; the piece of each state, -1 for none."""
        states: dict[str, int] = {"": 0}
        keys, to = [], []
        for p in self.weight:
            for n in range(1, len(p) + 1):
                if p[:n] not in states:
                    states[p[:n]] = len(states)
                    keys.append(states[p[: n - 1]] << 21 | ord(p[n - 1]))
                    to.append(states[p[:n]])
        order = np.argsort(keys)
        self.keys, self.next = np.array(keys, np.int64)[order], np.array(to, np.int64)[order]
        self.roots = np.full(1 << 21, -1, np.int32)  # the root's transitions by code point
        begin = (self.keys >> 21) == 0
        self.roots[self.keys[begin]] = self.next[begin]
        self.ends = np.full(len(states), -1, np.int32)
        self.worth = np.zeros(len(states))
        for p, (w, i) in self.weight.items():
            self.ends[states[p]], self.worth[states[p]] = i, w

    def decode(self, ids) -> str:
        """The text of a segmentation of any text."""
        raw = bytearray()
        for i in ids:
            raw += bytes([self.byte_of[i]]) if i in self.byte_of else self.pieces[i].encode("utf-8", "surrogatepass")
        text = raw.decode("utf-8", "surrogatepass").replace(MARK, " ")
        return text[1:]


class Lattices:
    """Unit lattices as flat arrays; a node is a place in a unit, its edges are pieces."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.unit: dict[str, int] = {}  # start node
        self.bytes: list[tuple[int, ...]] = []
        self.nodes = self.edges = 0
        self.first = np.zeros(1 << 20, np.int64)  # first edge of a node; ends have none
        self.cum = np.zeros(1 << 21)  # cumulative probability among the node's edges
        self.logp = np.zeros(1 << 21)
        self.piece = np.zeros(1 << 21, np.int32)  # negative: bytes
        self.to = np.zeros(1 << 21, np.int32)  # -1: end of the unit

    def _room(self, nodes: int, edges: int) -> None:
        """Grows the arrays; zeros that were never written take no memory."""

        def grown(old: np.ndarray, used: int, more: int) -> np.ndarray:
            new = np.zeros(max(2 * len(old), used + more), old.dtype)
            new[:used] = old[:used]
            return new

        if self.nodes + nodes + 2 > len(self.first):
            self.first = grown(self.first, self.nodes + 1, nodes + 2)
        if self.edges + edges > len(self.cum):
            for name in ("cum", "logp", "piece", "to"):
                setattr(self, name, grown(getattr(self, name), self.edges, edges))

    def _bytes(self, char: str) -> int:
        """The piece of a one-byte character, or a negative number that stands for its bytes."""
        raw = char.encode("utf-8", "surrogatepass")
        if len(raw) == 1:
            return self.v.of_byte[raw[0]]
        self.bytes.append(tuple(self.v.of_byte[b] for b in raw))
        return -len(self.bytes)

    def _add(self, s: str) -> int:
        weight, longest, n = self.v.weight, self.v.longest, len(s)
        beta = [0.0] * (n + 1)
        made = [()] * n
        for i in range(n - 1, -1, -1):
            found = []
            for j in range(i + 1, min(n, i + longest) + 1):
                w = weight.get(s[i:j])
                if w is not None:
                    found.append((w[0] + beta[j], w[1], j))
                elif j == i + 1:
                    found.append((self.v.byte_weight * len(s[i].encode("utf-8", "surrogatepass")) + beta[j], self._bytes(s[i]), j))
            top = max(x[0] for x in found)
            total = sum(math.exp(x[0] - top) for x in found)
            beta[i] = top + math.log(total)
            made[i] = tuple(sorted(found, reverse=True))
        self._room(n, sum(map(len, made)))
        base, e = self.nodes, self.edges
        first, cum, logp, piece, to = self.first, self.cum, self.logp, self.piece, self.to
        for i, found in enumerate(made):
            first[base + i] = e
            total = 0.0
            for x, p, j in found:
                lp = min(0.0, x - beta[i])
                total += math.exp(lp)
                cum[e], logp[e], piece[e], to[e] = total, lp, p, base + j if j < n else -1
                e += 1
            cum[e - 1] = 1.0
        self.nodes, self.edges = base + n, e
        first[self.nodes] = e
        return base

    def _add_many(self, units: list[str]) -> None:
        """Adds units of LONGEST characters at most, all at once, with the sums that _add makes."""
        v = self.v
        text = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        sizes = np.array([len(u) for u in units])
        stop = np.repeat(np.cumsum(sizes), sizes)
        n = len(text)
        src, dst, piece, worth = [], [], [], []
        at, single = np.arange(n), np.zeros(n, bool)
        for t in range(v.longest):
            if t == 0:
                state = v.roots[text].astype(np.int64)
                ok = state >= 0
                at, state = at[ok], state[ok]
            else:
                key = state << 21 | text[at + t]
                found = np.minimum(np.searchsorted(v.keys, key), len(v.keys) - 1)
                ok = v.keys[found] == key
                at, state = at[ok], v.next[found[ok]]
            hit = v.ends[state] >= 0
            src.append(at[hit])
            dst.append(at[hit] + t + 1)
            piece.append(v.ends[state[hit]])
            worth.append(v.worth[state[hit]])
            if t == 0:
                single[at[hit]] = True
            more = at + t + 1 < stop[at]
            at, state = at[more], state[more]
            if not len(at):
                break
        lone = np.flatnonzero(~single)
        if len(lone):  # characters without a piece: their bytes
            chars = [chr(c) for c in text[lone].tolist()]
            src.append(lone)
            dst.append(lone + 1)
            piece.append(np.array([self._bytes(c) for c in chars], np.int32))
            worth.append(np.array([v.byte_weight * len(c.encode("utf-8", "surrogatepass")) for c in chars]))
        src, dst, piece, worth = map(np.concatenate, (src, dst, piece, worth))
        order = np.argsort(src * (v.longest + 1) + dst - src, kind="stable")  # runs that are sorted already
        src, dst, piece, worth = src[order], dst[order], piece[order], worth[order]
        first = np.searchsorted(src, np.arange(n + 1))
        # backwards, all places that are equally far from their unit's end together
        away = stop - np.arange(n)
        beta = np.zeros(n + 1)
        by = np.argsort(away, kind="stable")
        bounds = np.searchsorted(away[by], np.arange(1, away.max() + 2))
        ended = dst == stop[src]
        for d in range(len(bounds) - 1):
            nodes = by[bounds[d] : bounds[d + 1]]
            if not len(nodes):
                continue
            count = first[nodes + 1] - first[nodes]
            offset = np.cumsum(count) - count
            e = np.repeat(first[nodes] - offset, count) + np.arange(count.sum())
            x = worth[e] + np.where(ended[e], 0.0, beta[dst[e]])
            worth[e] = x
            top = np.maximum.reduceat(x, offset)
            beta[nodes] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, count)), offset))
        logp = np.minimum(0.0, worth - beta[src])
        # the likeliest edge of a node first
        likeliest = np.flatnonzero(logp == np.maximum.reduceat(logp, first[:-1])[src])
        likeliest = likeliest[np.unique(src[likeliest], return_index=True)[1]]
        place = 2 * src + 1
        place[likeliest] -= 1
        order = np.argsort(place, kind="stable")
        logp, piece, dst, ended = logp[order], piece[order], dst[order], ended[order]
        cum, at = np.exp(logp), first[:-1]
        for r in range(1, v.longest + 1):  # node by node, so that a sum never depends on the units before
            at = at[first[src[at] + 1] > at + 1] + 1
            if not len(at):
                break
            cum[at] += cum[at - 1]
        cum[first[1:] - 1] = 1.0
        self._room(n, len(src))
        base, e0 = self.nodes, self.edges
        self.first[base : base + n + 1] = e0 + first
        self.cum[e0 : e0 + len(src)] = cum
        self.logp[e0 : e0 + len(src)] = logp
        self.piece[e0 : e0 + len(src)] = piece
        self.to[e0 : e0 + len(src)] = np.where(ended, -1, dst + base)
        starts = (np.cumsum(sizes) - sizes + base).tolist()
        self.unit.update(zip(units, starts, strict=True))
        self.nodes, self.edges = base + n, e0 + len(src)

    def starts(self, texts: list[str | None]) -> list[np.ndarray]:
        """Start nodes of each text's units."""
        split = [self.v.units(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        new = set().union(*split).difference(self.unit)
        short = [p for p in new if len(p) <= LONGEST]
        if short:
            self._add_many(short)
        if len(short) < len(new):
            for p in new.difference(short):
                self.unit[p] = self._add(p)
        get = self.unit.__getitem__
        return [np.fromiter(map(get, units), np.int64, len(units)) for units in split]

    def forget(self) -> None:
        """Starts anew when what is remembered has grown past its bound."""
        if len(self.unit) > REMEMBERED or self.nodes > 16 * REMEMBERED:
            self.unit.clear()
            self.bytes.clear()
            self.nodes = self.edges = 0

    def walk(self, start: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Samples a path through each unit from its node: (unit's number, edge) in order."""
        node, who, step = start, np.arange(len(start)), 0
        whos, edges = [], []
        cum = self.cum
        while len(node):
            u = (mix(key + _times(0, step, _STEP)) >> _U(11)).astype(np.float64) * 2.0**-53
            e = self.first[node]
            beyond = np.flatnonzero(u >= cum[e])  # a node's likeliest edge comes first, so few go on
            while len(beyond):
                e[beyond] += 1
                beyond = beyond[u[beyond] >= cum[e[beyond]]]
            whos.append(who)
            edges.append(e)
            node = self.to[e]
            on = node >= 0
            node, who, key, step = node[on], who[on], key[on], step + 1
        if not whos:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        who, edge = np.concatenate(whos), np.concatenate(edges)
        order = np.argsort(who, kind="stable")
        return who[order], edge[order]

    def ids(self, edges: np.ndarray) -> np.ndarray:
        piece = self.piece[edges]
        if (piece >= 0).all():
            return piece
        out: list[int] = []
        for p in piece.tolist():
            out += (p,) if p >= 0 else self.bytes[-p - 1]
        return np.array(out, np.int32)


def _node_of(lat: Lattices, edge: np.ndarray) -> np.ndarray:
    return np.searchsorted(lat.first[: lat.nodes + 1], edge, side="right") - 1


class _Text:
    """The search tree of one text: emitted paths and the queue of subtrees beside them."""

    def __init__(self, starts: np.ndarray, key: int):
        self.starts, self.key = starts, key
        self.paths: list[tuple[np.ndarray, np.ndarray, float, float]] = []  # unit of each edge, edges, log p, value
        self.queue: list = []  # (-value, number, path, place, edges already taken there)
        self.count = 0
        self.rest: np.ndarray | None = None

    def push(self, path: int, at: np.ndarray, values: np.ndarray) -> None:
        """Queues the subtrees beside a path at these places. Only as many as can still be popped matter, the largest."""
        edges = self.paths[path][1]
        best = np.argpartition(-values, MOST - 1)[:MOST] if len(values) > MOST else np.arange(len(values))
        for place, value in zip(at[best].tolist(), values[best].tolist(), strict=True):
            self.count += 1
            heapq.heappush(self.queue, (-value, self.count, path, place, (int(edges[place]),)))


#: Share of a node's mass from which the subtrees beside a path are queued in any case. Fainter ones are queued where fewer
#: than MOST others are: else they would have to beat MOST subtrees that are likelier by orders of magnitude.
CLEAR = 1e-12


def _beside(trees: list[tuple[_Text, int]], lat: Lattices, sample: int) -> None:
    """Queues the subtrees beside each text's newest path from its place on, their values truncated at the path's."""
    lps = [lat.logp[t.paths[-1][1]] for t, _ in trees]
    sizes = [len(x) for x in lps]
    lp = np.concatenate(lps)
    before = np.concatenate([np.cumsum(x) for x in lps]) - lp
    place = np.concatenate([np.arange(n) for n in sizes])
    other = -np.expm1(lp)
    who = np.repeat(np.arange(len(trees)), sizes)
    within = place >= np.repeat([begin for _, begin in trees], sizes)
    clear = within & (other > CLEAR)
    # texts with few clear places get the faint ones too, with their edges' own sums: no segmentation is lost
    few = np.bincount(who[clear], minlength=len(trees)) < MOST
    faint = np.flatnonzero(within & ~clear & few[who])
    if len(faint):
        edges = np.concatenate([t.paths[-1][1] for t, _ in trees])[faint]
        node = _node_of(lat, edges)
        begin, lens = lat.first[node], lat.first[node + 1] - lat.first[node]
        starts = np.cumsum(lens) - lens
        options = np.repeat(begin - starts, lens) + np.arange(lens.sum())
        other[faint] = np.add.reduceat(np.where(options == np.repeat(edges, lens), 0.0, np.exp(lat.logp[options])), starts)
        clear[faint] = other[faint] > 0
    kept = np.flatnonzero(clear)
    who, place = who[kept], place[kept]
    keys = np.array([_times(t.key, sample, _GOLD) for t, _ in trees], np.uint64)
    bounds = np.array([t.paths[-1][3] for t, _ in trees])
    values = _truncated(before[kept] + np.log(other[kept]), bounds[who], _uniform(keys[who], place.astype(np.uint64)))
    stops = np.searchsorted(who, np.arange(len(trees) + 1)).tolist()
    for (t, _), a, b in zip(trees, stops, stops[1:], strict=False):
        t.push(len(t.paths) - 1, place[a:b], values[a:b])


def _times(key: int, n: int, factor) -> np.uint64:
    """key + n * factor, modulo 2**64."""
    return _U((key + n * int(factor)) & ((1 << 64) - 1))


def _uniform(key, place: np.ndarray) -> np.ndarray:
    x = mix(mix(place * _PLACE) ^ key)
    return ((x >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def _truncated(location, bound: float, u):
    """A Gumbel of this location, given that it is below the bound."""
    return -np.logaddexp(-bound, -location + np.log(-np.log(u)))


def sample_texts(lat: Lattices, texts: list[str | None], keys: list[int], k: int, seed: int = 0) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text its k samples (ids, log p, perturbed value, inclusion), the best value first."""
    if k > MOST:
        raise ValueError(f"k is {MOST} at most")
    keys = mix(np.array([(key + seed * 0x9E3779B97F4A7C15) & (1 << 64) - 1 for key in keys], np.uint64))
    trees = [_Text(starts, key) for starts, key in zip(lat.starts(texts), keys.tolist(), strict=True)]
    tops = (-np.log(-np.log(_uniform(keys, np.zeros(len(keys), np.uint64))))).tolist()
    for sample in range(k):
        # every text's next path: a kept beginning, and units still to be walked
        wanted, heads, begins, keyed = [], [], [], []
        for t, top in zip(trees, tops, strict=True):
            if sample == 0:
                heads.append((np.zeros(0, np.int64), np.zeros(0, np.int64), top, 0))
                begin, first = 0, None
            elif not t.queue:
                heads.append(None)
                continue
            else:
                low, _, path, place, taken = heapq.heappop(t.queue)
                value = -low
                units, edges, _, _ = t.paths[path]
                node = int(_node_of(lat, edges[place : place + 1])[0])
                options = np.arange(lat.first[node], lat.first[node + 1])
                options = options[~np.isin(options, taken)]
                p = np.exp(lat.logp[options])
                u = _uniform(_times(t.key, sample, _GOLD), np.array([place + (1 << 40), place + (2 << 40)], np.uint64))
                e = int(options[min(np.searchsorted(np.cumsum(p), u[0] * p.sum(), side="right"), len(options) - 1)])
                left = float(p[options != e].sum())
                if left > 0:
                    location = float(lat.logp[edges[:place]].sum()) + math.log(left)
                    t.count += 1
                    heapq.heappush(t.queue, (-float(_truncated(location, value, u[1])), t.count, path, place, (*taken, e)))
                unit = int(units[place])
                heads.append((np.append(units[:place], unit), np.append(edges[:place], e), value, place + 1))
                begin, first = unit + 1, int(lat.to[e])
            starts = t.starts[begin:]
            number = np.arange(begin, len(t.starts), dtype=np.uint64)
            if first is not None and first >= 0:
                starts, number = np.append(first, starts), np.append(np.array([begin - 1], np.uint64), number)
            wanted.append(starts)
            begins.append(number)
            keyed.append(_times(t.key, sample + 1, _STEP))
        if not wanted:
            break
        number = np.concatenate(begins)
        keyed = np.repeat(np.array(keyed, np.uint64), [len(x) for x in begins])
        who, edge = lat.walk(np.concatenate(wanted), mix(keyed + number * _GOLD))
        unit = number.astype(np.int64)[who]
        ends = np.searchsorted(who, np.cumsum([len(x) for x in wanted]), side="left")
        at = 0
        i = 0
        live = []
        for t, head in zip(trees, heads, strict=True):
            if head is None:
                continue
            stop = int(ends[i])
            i += 1
            units = np.concatenate([head[0], unit[at:stop]])
            edges = np.concatenate([head[1], edge[at:stop]])
            at = stop
            t.paths.append((units, edges, float(lat.logp[edges].sum()), head[2]))
            live.append((t, head[3]))
        _beside(live, lat, sample + 1)
    out = []
    for t in trees:
        threshold = -t.queue[0][0] if t.queue else -math.inf
        out.append(
            [
                (lat.ids(edges), logp, value, 1.0 if threshold == -math.inf else -math.expm1(-math.exp(min(700.0, logp - threshold))))
                for _, edges, logp, value in t.paths
            ]
        )
    return out


_lattices: dict[str, Lattices] = {}


def lattices(vocabulary: str = "piece_bpe_32k.model") -> Lattices:
    """The worker's lattices, kept between tasks."""
    if vocabulary not in _lattices:
        _lattices[vocabulary] = Lattices(Vocabulary(vocabulary))
    return _lattices[vocabulary]


def sample(docs: DataFrame, k: int = 2, seed: int = 0, vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, rank (from 1), ids (little-endian unsigned 32-bit), log_prob, perturbed and inclusion."""

    def run(batches):
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in chunks([len(t or "") for t in texts], CHUNK):
                lat = lattices(vocabulary)
                got = sample_texts(lat, texts[a:b], [(n or 0) & ((1 << 64) - 1) for n in names[a:b]], k, seed)
                rows = [(n, r + 1, s[0].astype("<u4").tobytes(), *s[1:]) for n, found in zip(names[a:b], got, strict=True) for r, s in enumerate(found)]
                lat.forget()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=columns)

    columns = ["doc_id", "rank", "ids", "log_prob", "perturbed", "inclusion"]
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.float64(), pa.float64(), pa.float64()]
    schema = "doc_id bigint, rank int, ids binary, log_prob double, perturbed double, inclusion double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def decode(samples: DataFrame, vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    """Adds text, the decoded ids."""
    from pyspark.sql import types as T

    from pressleaf.llm.common import annotate

    def of_batch(batch: pa.RecordBatch) -> dict:
        v = lattices(vocabulary).v
        return {"text": [v.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in batch.column("ids").to_pylist()]}

    return annotate(samples, [T.StructField("text", T.StringType())], of_batch)


def query(spark, sf_dir: str) -> DataFrame:
    made = sample(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "rank", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), "log_prob", "perturbed", "inclusion"
    )
