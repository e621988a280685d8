"""URLs after the WHATWG rules (the parts that page archiving needs), domain rules and data: URLs."""

from __future__ import annotations

import base64
import binascii
import ipaddress
import re
from dataclasses import dataclass, replace
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressleaf.functions import media

SPECIAL = {"http": "80", "https": "443", "ftp": "21", "ws": "80", "wss": "443", "file": ""}
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*:")
_DRIVE = re.compile(r"[A-Za-z][:|]$")
_CONTROLS = "".join(map(chr, range(33)))
_BREAKS = re.compile(r"[\t\n\r]")
_PLACE = re.compile(r"(\[[^\]]*\]|[^:]*)(?::([0-9]*))?")
#: Characters that are percent-encoded beside controls and what is outside ASCII.
_PATH, _QUERY, _FRAGMENT, _USER = ' "#<>?`{}', ' "#<>', ' "<>`', ' "#<>?`{}/:;=@[\\]^|'
#: Texts that are none of these characters in any set.
_PLAIN = re.compile(r"[A-Za-z0-9._~!$&()*+,%\-]*")


@dataclass(frozen=True)
class Url:
    scheme: str
    path: str
    host: str | None = None
    userinfo: str = ""
    port: str = ""
    query: str | None = None
    fragment: str | None = None
    opaque: bool = False

    def __str__(self) -> str:
        authority = ""
        if self.host is not None:
            at = f"{self.userinfo}@" if self.userinfo else ""
            authority = f"//{at}{self.host}{':' + self.port if self.port else ''}"
        query = "" if self.query is None else f"?{self.query}"
        return f"{self.scheme}:{authority}{self.path}{query}{'' if self.fragment is None else '#' + self.fragment}"


def _encode(text: str, extra: str) -> str:
    if _PLAIN.fullmatch(text) or text.isascii() and text.isprintable() and not any(c in text for c in extra):
        return text
    return "".join(
        c if " " <= c <= "~" and c not in extra else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in text
    )


@lru_cache(1024)
def _host(text: str) -> str | None:
    if text.startswith("["):
        try:
            return f"[{ipaddress.IPv6Address(text[1:-1]).compressed}]" if text.endswith("]") else None
        except ValueError:
            return None
    if not text:
        return None
    try:
        decoded = re.sub(r"((?:%[0-9A-Fa-f]{2})+)", lambda m: bytes.fromhex(m[1].replace("%", "")).decode("utf-8"), text)
        host = decoded.lower() if decoded.isascii() else decoded.lower().encode("idna").decode()
    except (UnicodeError, ValueError):
        return None
    return None if re.search(r"[\x00-\x20#/<>?@\\^|%:]", host) else host


def _segments(path: str, base: list[str], file: bool) -> list[str]:
    out = list(base)
    parts = path.split("/")
    for i, part in enumerate(parts):
        low = part.lower().replace("%2e", ".")
        last = i == len(parts) - 1
        if low == "..":
            if out and not (file and len(out) == 1 and _DRIVE.match(out[0])):
                out.pop()
            if last:
                out.append("")
        elif low == ".":
            if last:
                out.append("")
        else:
            out.append(_encode(part, _PATH))
    return out


def parse(text: str, base: Url | None = None) -> Url | None:
    """The URL, resolved against a base if it is relative; None if it is none."""
    text = _BREAKS.sub("", text.strip(_CONTROLS))
    found = _SCHEME.match(text)
    rest, fragment = text, None
    if "#" in rest:
        rest, _, fragment = rest.partition("#")
        fragment = _encode(fragment, _FRAGMENT)
    if found and found.end() <= len(rest):
        scheme, rest = found[0][:-1].lower(), rest[found.end() :]
        if scheme in SPECIAL:
            rest = _slashes(rest)
            if scheme != "file":
                if base and base.scheme == scheme and not rest.startswith("/"):
                    return _relative(rest, base, fragment)
                return _authority(scheme, rest.lstrip("/"), fragment)
            return _file(rest, base if base and base.scheme == "file" else None, fragment)
        query = None
        if "?" in rest:
            rest, _, query = rest.partition("?")
            query = _encode(query, _QUERY)
        if rest.startswith("//"):
            host, slash, path = rest[2:].partition("/")
            return Url(scheme, slash + path, host, query=query, fragment=fragment)
        if rest.startswith("/"):
            return Url(scheme, "/" + "/".join(_segments(rest[1:], [], False)), query=query, fragment=fragment)
        return Url(scheme, _encode(rest, ""), query=query, fragment=fragment, opaque=True)
    if base is None:
        return None
    if base.opaque:
        return replace(base, fragment=fragment) if not rest and fragment is not None else None
    if base.scheme in SPECIAL:
        rest = _slashes(rest)
    if base.scheme == "file":
        return _file(rest, base, fragment)
    return _relative(rest, base, fragment)


def _slashes(rest: str) -> str:
    head, mark, query = rest.partition("?")
    return head.replace("\\", "/") + mark + query


def _query(text: str | None, scheme: str) -> str | None:
    return None if text is None else _encode(text, _QUERY + ("'" if scheme in SPECIAL else ""))


def _split_query(rest: str) -> tuple[str, str | None]:
    head, mark, query = rest.partition("?")
    return head, query if mark else None


def _authority(scheme: str, rest: str, fragment: str | None) -> Url | None:
    head, query = _split_query(rest)
    authority, slash, path = head.partition("/")
    user, at, place = authority.rpartition("@")
    found = _PLACE.fullmatch(place)
    host = _host(found[1]) if found else None
    if not host or (found[2] and int(found[2]) > 65535):
        return None
    port = str(int(found[2])) if found[2] else ""
    name, colon, word = user.partition(":")
    userinfo = (_encode(name, _USER) + (":" + _encode(word, _USER) if colon and word else "")) if at else ""
    return Url(
        scheme, "/" + "/".join(_segments(path, [], False)), host, userinfo, "" if port == SPECIAL[scheme] else port, _query(query, scheme), fragment
    )


def _file(rest: str, base: Url | None, fragment: str | None) -> Url | None:
    head, query = _split_query(rest)
    host, start = "", []
    if head.startswith("//"):
        host, slash, path = head[2:].partition("/")
        if _DRIVE.match(host):
            host, path = "", head[2:]
        host = "" if host.lower() == "localhost" else host
        if host and (host := _host(host)) is None:
            return None
        path = path.lstrip("/") if not host else path
    elif head.startswith("/"):
        path = head[1:]
        host = base.host or "" if base else ""
    elif base:
        host, start, path = base.host or "", base.path.split("/")[1:], head
        if not head:
            keep = base.query if query is None else _query(query, "file")
            return replace(base, query=keep, fragment=fragment)
        start = start[:-1]
    else:
        path = head
    return Url("file", "/" + "/".join(_segments(path, start, True)), host, query=_query(query, "file"), fragment=fragment)


def _relative(rest: str, base: Url, fragment: str | None) -> Url | None:
    if rest.startswith("//"):
        return _authority(base.scheme, rest.lstrip("/"), fragment) if base.scheme in SPECIAL else parse(f"{base.scheme}:{rest}")
    head, query = _split_query(rest)
    if not head:
        return replace(base, query=base.query if query is None else _query(query, base.scheme), fragment=fragment)
    start = [] if head.startswith("/") else base.path.split("/")[1:-1]
    path = "/" + "/".join(_segments(head.removeprefix("/"), start, False))
    return replace(base, path=path, query=_query(query, base.scheme), fragment=fragment)


def resolve(base: str, ref: str) -> str:
    """ref against base; `data:,` where that gives no URL."""
    found = parse(ref, _base(base))
    return str(found) if found else "data:,"


@lru_cache(64)
def _base(base: str) -> Url | None:
    """A page's references have the same few bases."""
    return parse(base)


def clean(url: str) -> str:
    return url.partition("#")[0]


def referer(url: str) -> str:
    found = parse(url)
    return str(replace(found, userinfo="", fragment=None)) if found else clean(url)


def referer_for(parent: str | None, url: str) -> str | None:
    """What a request for url states as its referer: the parent, if that is on the web and another address."""
    if parent is None or not parent.startswith(("http:", "https:")) or parent == url:
        return None
    return referer(parent)


def has_protocol(text: str) -> bool:
    return parse(text) is not None


def within_domain(domain: str, pattern: str) -> bool:
    """Whether a domain is the pattern's, or with a leading dot one of its parts at any depth."""
    if pattern == "":
        return False
    if pattern == ".":
        return True
    d, p = domain.lower().rstrip("."), pattern.lower().rstrip(".")
    return ("." + d).endswith(p) if p.startswith(".") else d == p


def data_url(media_type: str, charset: str, data: bytes, final_url: str = "") -> str:
    """A base64 data: URL; an empty media type is detected, US-ASCII isn't stated."""
    media_type = media_type or media.detect(data, final_url)
    charset = charset.strip()
    stated = f";charset={charset}" if charset and charset.lower() != "us-ascii" else ""
    return f"data:{media_type}{stated};base64,{base64.b64encode(data).decode()}"


def percent_decode(text: str) -> bytes:
    return re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: bytes.fromhex(m[1].decode()), text.encode("utf-8", "replace"))


def parse_data_url(url: str) -> tuple[str, str, bytes]:
    """Media type, charset and bytes of a data: URL; query and fragment aren't part of the data."""
    path = url.partition("#")[0].partition("?")[0].partition(":")[2]
    head, _, body = path.partition(",")
    media_type, charset, in_base64 = media.content_type(head)
    data = percent_decode(body)
    if in_base64:
        try:
            data = base64.b64decode(data.decode("utf-8", "replace"), validate=True)
        except (binascii.Error, ValueError):
            data = b""
    return media_type, charset, data


def clean_col(url: Column) -> Column:
    return F.regexp_replace(url, "(?s)#.*$", "")


def referer_col(url: Column) -> Column:
    return F.regexp_replace(clean_col(url), r"^([a-z][a-z0-9+.\-]*://)[^/?#]*@", "$1")


def within_domain_col(domain: Column, pattern: Column) -> Column:
    d, p = F.rtrim(F.lower(domain), F.lit(".")), F.rtrim(F.lower(pattern), F.lit("."))
    return (
        F.when(pattern == "", False)
        .when(pattern == ".", True)
        .when(p.startswith("."), F.concat(F.lit("."), d).endswith(p))
        .otherwise(d == p)
    )


def base64_col(data: Column) -> Column:
    """Base64 without the line ends that Spark may put in."""
    return F.regexp_replace(F.base64(data), "\r\n", "")


def data_url_col(media_type: Column, charset: Column, data: Column) -> Column:
    name = F.trim(charset)
    stated = F.when((name == "") | (F.lower(name) == "us-ascii"), "").otherwise(F.concat(F.lit(";charset="), name))
    return F.concat(F.lit("data:"), media_type, stated, F.lit(";base64,"), base64_col(data))
