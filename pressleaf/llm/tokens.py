"""Token ids of whole texts by a public byte-level BPE vocabulary of the tokenizers library.

Ids equal those of the library's own call on the whole text, added tokens included. A text is cut around added tokens,
the library's pre-tokenisation pattern splits the rest into pieces, and each distinct piece is encoded once by the library
and its ids are remembered in the task, so frequent words cost a lookup (no merge of the vocabulary crosses a piece).
"""

from __future__ import annotations

import re
import struct

END = 2
#: Pieces whose ids a worker remembers, and the longest piece that is remembered.
REMEMBERED, LONGEST = 550_000, 64
#: So many pieces are remembered when first met, the others when met again.
FIRST = 350_000
#: Marks for pieces met once; pieces of one mark are taken for each other, which only costs memory.
SEEN = 1 << 23
#: The library's pattern for texts of Latin letters without digits outside ASCII; other texts take its own pattern.
_LATIN = re.compile(r" ?[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^\sA-Za-z0-9\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ]+|\s+(?!\S)|\s+").findall
_OTHER = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbeɐ-\U0010ffff]").search


def _latin(text: str) -> bool:
    """True if _OTHER finds nothing; a few plain searches tell that sooner where a byte holds each character."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return not _OTHER(text)
    return not any(c in text for c in ("\x1c\x1d\x1e\x1f" if text.isascii() else "\x1c\x1d\x1e\x1f\xb2\xb3\xb9\xbc\xbd\xbe"))


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, vocabulary: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        if self.tokenizer.normalizer is not None:
            raise ValueError("unsupported: a vocabulary with a normalizer")
        #: The same model for text that is already one piece.
        self.whole = Tokenizer(self.tokenizer.model)
        self.whole.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.pattern = regex.compile(public_tokenizers.PATTERN).findall
        self.known: dict[str, bytes] = {}
        for i, token in self.tokenizer.get_added_tokens_decoder().items():
            if token.lstrip or token.rstrip or token.single_word or token.normalized:
                raise ValueError(f"unsupported added token {token.content!r}")
            self.known[token.content] = i.to_bytes(4, "little")
        #: Marks pieces met before: most rare words never come again.
        self.seen = bytearray(SEEN)
        self.added = tuple(self.known)
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split

    def _split(self, text: str) -> list[str]:
        return (_LATIN if _latin(text) else self.pattern)(text)

    def pieces(self, text: str) -> list[str]:
        if any(a in text for a in self.added):
            return [p for i, part in enumerate(self.cut(text)) for p in ([part] if i % 2 else self._split(part))]
        return self._split(text)

    def _ids(self, pieces: list[str]) -> list[bytes]:
        found = self.whole.encode_batch_fast(pieces, add_special_tokens=False)
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in (e.ids for e in found)]

    def batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, the end id included; null counts as empty."""
        known = self.known
        split = [self.pieces(t) if t else [] for t in texts]
        # each piece is looked up once; only the gaps are filled afterwards
        found = [list(map(known.get, pieces)) for pieces in split]
        gaps = [[i for i, ids in enumerate(row) if ids is None] if None in row else () for row in found]
        fresh = list({pieces[i] for pieces, at in zip(split, gaps, strict=True) for i in at})
        new = dict(zip(fresh, self._ids(fresh), strict=True))
        if len(known) < REMEMBERED:
            for piece, ids in new.items():
                at = hash(piece) % SEEN
                if (self.seen[at] or len(known) < FIRST) and len(piece) <= LONGEST:
                    known[piece] = ids
                self.seen[at] = 1
        end = END.to_bytes(4, "little")
        made = []
        for pieces, row, at in zip(split, found, gaps, strict=True):
            for i in at:
                row[i] = new[pieces[i]]
            row.append(end)
            made.append(b"".join(row))
        return made


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str = "byte_bpe_50k.json") -> Encoder:
    """The worker's encoder, kept between tasks."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]
