"""Style sheets: a tokenizer and the rewrite that puts fetched resources in place of their addresses."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

from pressleaf.functions import markup

_ESCAPE = r"\\(?:[0-9A-Fa-f]{1,6}(?:\r\n|[ \t\r\n\f])?|[^\n\r\f0-9A-Fa-f])"
_NAME_CHAR = rf"(?:[A-Za-z0-9_\-]|[^\x00-\x7f]|{_ESCAPE})"
_IDENT = rf"(?:--|-?(?:[A-Za-z_]|[^\x00-\x7f]|{_ESCAPE})){_NAME_CHAR}*"
_NUMBER = r"[+\-]?(?:[0-9]+\.[0-9]+|\.[0-9]+|[0-9]+)(?:[eE][+\-]?[0-9]+)?"
_TOKEN = re.compile(
    rf"""(?P<comment>/\*.*?(?:\*/|$))|(?P<space>[ \t\r\n\f]+)|(?P<cdo><!--)|(?P<cdc>-->)
    |(?P<string>"(?:[^"\\\n\r\f]|\\(?:\r\n|.))*(?:"|$)|'(?:[^'\\\n\r\f]|\\(?:\r\n|.))*(?:'|$))
    |(?P<badstring>"(?:[^"\\\n\r\f]|\\.)*|'(?:[^'\\\n\r\f]|\\.)*)
    |(?P<url>[uU][rR][lL]\([ \t\r\n\f]*(?P<address>(?:[^"'()\\ \t\r\n\f]|{_ESCAPE})*)[ \t\r\n\f]*(?:\)|$))
    |(?P<badurl>[uU][rR][lL]\([ \t\r\n\f]*(?!["' \t\r\n\f])(?:[^)\\]|\\.)*(?:\)|$))
    |(?P<dimension>(?P<dnum>(?>{_NUMBER}))(?P<unit>{_IDENT}))|(?P<percent>(?P<pnum>(?>{_NUMBER}))%)|(?P<number>{_NUMBER})
    |(?P<function>(?P<fname>{_IDENT})\()|(?P<at>@(?P<aname>{_IDENT}))|(?P<ident>{_IDENT})
    |(?P<hash>\#(?P<hname>{_NAME_CHAR}+))|(?P<match>[~|^$*]=)|(?P<open>[(\[{{])|(?P<close>[)\]}}])|(?P<delim>.)""",
    re.VERBOSE | re.DOTALL,
)
_CLOSER = {"(": ")", "[": "]", "{": "}"}


def unescape(text: str) -> str:
    def one(m: re.Match) -> str:
        body = m[1]
        if re.match(r"[0-9A-Fa-f]", body):
            code = int(body.strip(), 16)
            return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd"
        return "" if body in ("\n", "\r\n", "\r", "\f") else body

    return re.sub(r"\\([0-9A-Fa-f]{1,6}(?:\r\n|[ \t\r\n\f])?|\r\n|.)", one, text, flags=re.DOTALL)


def ident(text: str) -> str:
    """A name as CSS writes it."""
    out = []
    for i, c in enumerate(text):
        if c.isdigit() and c.isascii() and (i == 0 or i == 1 and text[0] == "-"):
            out.append(f"\\{ord(c):x} ")
        elif c.isascii() and not (c.isalnum() or c in "-_"):
            out.append(f"\\{ord(c):x} " if ord(c) < 32 or ord(c) == 127 else f"\\{c}")
        elif text == "-":
            out.append("\\-")
        else:
            out.append(c)
    return "".join(out).rstrip()


def quote(text: str) -> str:
    return '"' + re.sub(r"[\x00-\x1f\x7f]", lambda m: f"\\{ord(m[0]):x} ", text.replace("\\", "\\\\").replace('"', '\\"')) + '"'


@lru_cache(4096)
def number(text: str) -> str:
    """The number as a 32-bit float prints; a written plus stays."""
    value = np.float32(text)
    shown = np.format_float_positional(value, unique=True, trim="-") if np.isfinite(value) else text
    return ("+" if text[0] == "+" else "") + ("0" if shown == "-0" else shown)


@dataclass
class _Block:
    """An open block: what closes it, what goes around it, and the at-rule, property and function it stands in."""

    closer: str | None
    before: str
    after: str
    rule: str
    prop: str
    function: str
    dropped: bool = False
    out: list[str] = field(default_factory=list)

    def __post_init__(self):
        self.now = self.rule  # the at-rule whose statement goes on

    def made(self) -> str:
        made = "".join(self.out)
        return made if made.strip(" \t\n\r\f") else ""


class _Rewriter:
    """fetch(address, imported): the replacement address, or None to drop it; imported sheets come rewritten."""

    def __init__(self, text: str, fetch: Callable[[str, bool], str | None], no_images: bool, no_fonts: bool):
        self.text = text
        self.fetch, self.no_images, self.no_fonts = fetch, no_images, no_fonts

    def run(self) -> str:
        """Blocks are kept on a stack of their own, so that deeply nested ones are no trouble."""
        blocks = [_Block(None, "", "", "", "", "")]

        def close() -> None:
            b = blocks.pop()
            if b.dropped:
                blocks[-1].now = ""
            else:
                blocks[-1].out.append(b.before + b.made() + b.after)

        for m in _TOKEN.finditer(self.text):
            b = blocks[-1]
            kind, text = m.lastgroup, m[0]
            if kind == "close":
                if text == b.closer:
                    close()
                else:
                    b.out.append(text)
            elif kind == "open":
                dropped = self.no_fonts and b.now == "font-face"
                blocks.append(_Block(_CLOSER[text], text, _CLOSER[text], b.rule, b.prop, b.function, dropped))
            elif kind == "function":
                name = unescape(m["fname"])
                blocks.append(_Block(")", ident(name) + "(", ")", b.now, b.prop, name))
            elif kind == "ident":
                b.now, b.prop = "", unescape(text)
                b.out.append(ident(b.prop))
            elif kind == "at":
                b.now = unescape(m["aname"])
                if not (self.no_fonts and b.now == "font-face"):
                    b.out.append("@" + b.now)
            elif kind == "hash":
                name = unescape(m["hname"])
                if re.fullmatch(_IDENT, m["hname"]):
                    b.now = ""
                    b.out.append("#" + ident(name))
                else:
                    b.out.append("#" + name)
            elif kind == "string":
                value = unescape(text[1:-1] if len(text) > 1 and text[-1] == text[0] else text[1:])
                imported = b.now == "import"
                b.out.append(self.address(value, imported, b.prop) if imported or b.function == "url" else quote(value))
            elif kind == "url":
                value = unescape(m["address"])
                got = self.address(value, b.now == "import", b.prop) if value else ""
                b.out.append(text if value.startswith("#") else f"url({got})")
            elif kind in ("number", "percent", "dimension"):
                lead = number(m["dnum"] or m["pnum"] or m["number"])
                b.out.append(lead + ("%" if kind == "percent" else unescape(m["unit"]) if kind == "dimension" else ""))
            elif kind not in ("badstring", "badurl"):
                if text in ("*", ";"):  # a new selector or statement: no at-rule goes on
                    b.now = "" if text == "*" or b.now != "font-face" else b.now
                b.out.append(text)
        while len(blocks) > 1:
            close()
        return blocks[0].made()

    def address(self, value: str, imported: bool, prop: str) -> str:
        if not value:
            return "''" if imported else ""
        if value.startswith("#"):
            return quote(value)
        if not imported and self.no_images and markup.is_image_property(prop):
            return quote(markup.EMPTY_IMAGE)
        got = self.fetch(value, imported)
        return "" if got is None else quote(got)


def rewrite(text: str, fetch: Callable[[str, bool], str | None], no_images: bool = False, no_fonts: bool = False) -> str:
    return _Rewriter(text, fetch, no_images, no_fonts).run()


def references(text: str) -> list[tuple[str, bool]]:
    """(address, imported) of everything the sheet refers to."""
    found: list[tuple[str, bool]] = []

    def note(address: str, imported: bool) -> None:
        found.append((address, imported))

    rewrite(text, note)
    return found
