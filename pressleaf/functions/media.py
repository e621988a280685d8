"""Media types by signature and by name, content-type values, and character sets."""

from __future__ import annotations

import codecs
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Beginnings of files and their media types, in this order; dots in them are plain bytes.
SIGNATURES = (
    (b"GIF87a", "image/gif"),
    (b"GIF89a", "image/gif"),
    (b"\xff\xd8\xff", "image/jpeg"),
    (b"\x89PNG\r\n\x1a\n", "image/png"),
    (b"<svg ", "image/svg+xml"),
    (b"RIFF....WEBPVP8 ", "image/webp"),
    (b"\x00\x00\x01\x00", "image/x-icon"),
    (b"ID3", "audio/mpeg"),
    (b"\xff\x0e", "audio/mpeg"),
    (b"\xff\x0f", "audio/mpeg"),
    (b"OggS", "audio/ogg"),
    (b"RIFF....WAVEfmt ", "audio/wav"),
    (b"fLaC", "audio/x-flac"),
    (b"RIFF....AVI LIST", "video/avi"),
    (b"....ftyp", "video/mp4"),
    (b"\x00\x00\x01\x0b", "video/mpeg"),
    (b"....moov", "video/quicktime"),
    (b"\x1a\x45\xdf\xa3", "video/webm"),
)
# Media types by file name ending.
BY_NAME = {
    "avi": "video/avi", "bmp": "image/bmp", "css": "text/css", "flac": "audio/flac", "gif": "image/gif",
    "htm": "text/html", "html": "text/html", "ico": "image/x-icon", "jpeg": "image/jpeg", "jpg": "image/jpeg",
    "js": "text/javascript", "json": "application/json", "jsonld": "application/ld+json", "mp3": "audio/mpeg",
    "mp4": "video/mp4", "m4v": "video/mp4", "ogg": "audio/ogg", "ogv": "video/ogg", "pdf": "application/pdf",
    "png": "image/png", "svg": "image/svg+xml", "swf": "application/x-shockwave-flash", "tif": "image/tiff",
    "tiff": "image/tiff", "txt": "text/plain", "wav": "audio/wav", "webp": "image/webp", "woff": "font/woff",
    "woff2": "font/woff2", "xhtml": "application/xhtml+xml", "xml": "text/xml",
}
# Media types of plain text beside text/*.
PLAINTEXT = (
    "application/javascript", "application/json", "application/ld+json", "application/x-sh", "application/xhtml+xml",
    "application/xml", "application/vnd.mozilla.xul+xml", "image/svg+xml",
)
HTML = ("text/html", "application/xhtml+xml")


def by_name(name: str) -> str:
    return BY_NAME.get(name.lower().rpartition(".")[2], "")


def detect(data: bytes, url: str = "", wildcard: bool = False) -> str:
    """By the data's beginning, then by the URL's last segment; wildcard: dots of a signature stand for any byte."""
    for sign, kind in SIGNATURES:
        head = data[: len(sign)]
        if head == sign or wildcard and len(head) == len(sign) and all(s in (46, h) for s, h in zip(sign, head, strict=True)):
            return kind
    path = re.sub(r"^[A-Za-z][A-Za-z0-9+.\-]*:(//[^/?#]*)?", "", url).partition("#")[0].partition("?")[0]
    return by_name(path.rpartition("/")[2])


def content_type(value: str) -> tuple[str, str, bool]:
    """Media type, charset and whether base64 is stated."""
    media_type, charset, in_base64 = "text/plain", "US-ASCII", False
    for i, item in enumerate(value.split(";")):
        item = item.strip()
        if i == 0:
            media_type = item or media_type
        elif item.lower() == "base64":
            in_base64 = True
        elif item.startswith("charset="):
            charset = item[8:]
    return media_type, charset, in_base64


def is_plaintext(media_type: str) -> bool:
    return media_type.lower().startswith("text/") or media_type.lower() in PLAINTEXT


# Labels of character sets on the web, by Python's codec. Labels that follow a rule are added below.
_LABELS = {
    "utf-8": "unicode-1-1-utf-8 unicode11utf8 unicode20utf8 utf-8 utf8 x-unicode20utf8",
    "cp866": "866 cp866 csibm866 ibm866",
    "iso8859-2": "csisolatin2 iso-ir-101 iso_8859-2:1987 l2 latin2",
    "iso8859-3": "csisolatin3 iso-ir-109 iso_8859-3:1988 l3 latin3",
    "iso8859-4": "csisolatin4 iso-ir-110 iso_8859-4:1988 l4 latin4",
    "iso8859-5": "csisolatincyrillic cyrillic iso-ir-144 iso_8859-5:1988",
    "iso8859-6": "arabic asmo-708 csiso88596e csiso88596i csisolatinarabic ecma-114 iso-8859-6-e iso-8859-6-i iso-ir-127 iso_8859-6:1987",
    "iso8859-7": "csisolatingreek ecma-118 elot_928 greek greek8 iso-ir-126 iso_8859-7:1987 sun_eu_greek",
    "iso8859-8": "csiso88598e csisolatinhebrew hebrew iso-8859-8-e iso-ir-138 iso_8859-8:1988 visual csiso88598i iso-8859-8-i logical",
    "iso8859-10": "csisolatin6 iso-8859-10 iso-ir-157 iso8859-10 iso885910 l6 latin6",
    "iso8859-13": "iso-8859-13 iso8859-13 iso885913",
    "iso8859-14": "iso-8859-14 iso8859-14 iso885914",
    "iso8859-15": "csisolatin9 iso-8859-15 iso8859-15 iso885915 iso_8859-15 l9",
    "iso8859-16": "iso-8859-16",
    "koi8-r": "cskoi8r koi koi8 koi8-r koi8_r",
    "koi8-u": "koi8-ru koi8-u",
    "mac-roman": "csmacintosh mac macintosh x-mac-roman",
    "cp874": "dos-874 iso-8859-11 iso8859-11 iso885911 tis-620 windows-874",
    "cp1252": "ansi_x3.4-1968 ascii cp819 csisolatin1 ibm819 iso-ir-100 iso_8859-1:1987 l1 latin1 us-ascii",
    "cp1254": "csisolatin5 iso-ir-148 iso_8859-9:1989 l5 latin5",
    "mac-cyrillic": "x-mac-cyrillic x-mac-ukrainian",
    "gbk": "chinese csgb2312 csiso58gb231280 gb2312 gb_2312 gb_2312-80 gbk iso-ir-58 x-gbk",
    "gb18030": "gb18030",
    "big5hkscs": "big5 big5-hkscs cn-big5 csbig5 x-x-big5",
    "euc_jp": "cseucpkdfmtjapanese euc-jp x-euc-jp",
    "iso2022_jp": "csiso2022jp iso-2022-jp",
    "cp932": "csshiftjis ms932 ms_kanji shift-jis shift_jis sjis windows-31j x-sjis",
    "cp949": "cseuckr csksc56011987 euc-kr iso-ir-149 korean ks_c_5601-1987 ks_c_5601-1989 ksc5601 ksc_5601 windows-949",
    "utf-16-be": "unicodefffe utf-16be",
    "utf-16-le": "csunicode iso-10646-ucs-2 ucs-2 unicode unicodefeff utf-16 utf-16le",
    "x-user-defined": "x-user-defined",
}
CODECS = {label: name for name, labels in _LABELS.items() for label in labels.split()}
# the parts of ISO 8859 that have four spellings each, the first and the ninth read as Windows sets, and the Windows sets themselves
for _n in range(1, 10):
    for _spelling in ("iso-8859-%d", "iso8859-%d", "iso8859%d", "iso_8859-%d"):
        CODECS[_spelling % _n] = {1: "cp1252", 9: "cp1254"}.get(_n, f"iso8859-{_n}")
for _n in range(1250, 1259):
    for _spelling in ("cp%d", "windows-%d", "x-cp%d"):
        CODECS[_spelling % _n] = f"cp{_n}"
#: Labels of sets that must not be decoded; any text in them reads as one U+FFFD.
REPLACED = ("csiso2022kr", "hz-gb-2312", "iso-2022-cn", "iso-2022-cn-ext", "iso-2022-kr", "replacement")


def _undefined(error: UnicodeError) -> tuple[str, int]:
    """Bytes that a Windows set leaves open: controls below 0xA0, U+FFFD above."""
    if not isinstance(error, UnicodeDecodeError):
        raise error
    byte = error.object[error.start]
    return (chr(byte) if 0x80 <= byte < 0xA0 else "\ufffd"), error.start + 1


codecs.register_error("pressleaf-windows", _undefined)


def codec(label: str) -> str | None:
    """The codec for a label as the web uses it; None if the web has no such label or doesn't decode it."""
    return CODECS.get(label.strip("\t\n\f\r ").lower())


def decode(data: bytes, label: str) -> str:
    """A byte order mark decides, then the label, else UTF-8; bad bytes become U+FFFD."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xfe\xff", "utf-16-be"), (b"\xff\xfe", "utf-16-le")):
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace")
    if label.strip("\t\n\f\r ").lower() in REPLACED:
        return "\ufffd" if data else ""
    name = codec(label) or "utf-8"
    if name == "x-user-defined":
        return "".join(chr(b if b < 128 else 0xF700 + b) for b in data)
    return data.decode(name, "pressleaf-windows" if name.startswith(("cp125", "cp874")) else "replace")


def encode(text: str, label: str) -> bytes:
    """What the character set lacks becomes a numeric reference; UTF-16 labels and unknown ones give UTF-8."""
    name = codec(label) or "utf-8"
    if name == "x-user-defined":
        return b"".join(bytes([ord(c) & 0xFF]) if ord(c) < 128 or 0xF780 <= ord(c) <= 0xF7FF else b"&#%d;" % ord(c) for c in text)
    return text.encode("utf-8" if name.startswith("utf-16") else name, "xmlcharrefreplace")


def sniff_col(data: Column) -> Column:
    out = None
    for sign, kind in SIGNATURES:
        hit = F.startswith(data, F.lit(bytearray(sign)))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("")


def by_name_col(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in BY_NAME.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.substring_index(F.lower(name), ".", -1)), F.lit(""))


def is_plaintext_col(media_type: Column) -> Column:
    return F.lower(media_type).startswith("text/") | F.lower(media_type).isin(*PLAINTEXT)


def content_type_col(value: Column) -> Column:
    """STRUCT<media_type, charset, is_base64>."""
    items = F.transform(F.split(value, ";"), lambda x: F.trim(x))
    sets = F.filter(F.slice(items, 2, 1 << 20), lambda x: x.startswith("charset="))
    return F.struct(
        F.coalesce(F.nullif(F.element_at(items, 1), F.lit("")), F.lit("text/plain")).alias("media_type"),
        F.when(F.size(sets) > 0, F.substring(F.try_element_at(sets, F.lit(-1)), 9, 1 << 20)).otherwise("US-ASCII").alias("charset"),
        F.exists(F.slice(items, 2, 1 << 20), lambda x: F.lower(x) == "base64").alias("is_base64"),
    )
