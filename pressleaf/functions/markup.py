"""Text functions of the page engine: policies, paths, comments, srcset, integrity and fixed name lists."""

from __future__ import annotations

import base64
import hashlib
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressleaf.options import Options

PRODUCT = "pressleaf v0.1"
# Fixed value: the picture that stands for a removed one (13 x 13 transparent PNG).
EMPTY_IMAGE = (
    "data:image/png,%89PNG%0D%0A%1A%0A%00%00%00%0DIHDR%00%00%00%0D%00%00%00%0D%08%04%00%00%00%D8%E2%2C%F7%00%00%00%11IDATx%DAcd%C0"
    "%09%18G%A5%28%96%02%00%0A%F8%00%0E%CB%8A%EB%16%00%00%00%00IEND%AEB%60%82"
)
# Event handler attributes of the HTML standard.
EVENTS = (
    "onabort", "onauxclick", "onblur", "oncancel", "oncanplay", "oncanplaythrough", "onchange", "onclick", "onclose",
    "oncontextmenu", "oncuechange", "ondblclick", "ondrag", "ondragend", "ondragenter", "ondragexit", "ondragleave", "ondragover",
    "ondragstart", "ondrop", "ondurationchange", "onemptied", "onended", "onerror", "onfocus", "onformdata", "oninput",
    "oninvalid", "onkeydown", "onkeypress", "onkeyup", "onload", "onloadeddata", "onloadedmetadata", "onloadstart", "onmousedown",
    "onmouseenter", "onmouseleave", "onmousemove", "onmouseout", "onmouseover", "onmouseup", "onwheel", "onpause", "onplay",
    "onplaying", "onprogress", "onratechange", "onreset", "onresize", "onscroll", "onsecuritypolicyviolation", "onseeked",
    "onseeking", "onselect", "onslotchange", "onstalled", "onsubmit", "onsuspend", "ontimeupdate", "ontoggle", "onvolumechange",
    "onwaiting", "onwebkitanimationend", "onwebkitanimationiteration", "onwebkitanimationstart", "onwebkittransitionend",
    "onafterprint", "onbeforeprint", "onbeforeunload", "onhashchange", "onlanguagechange", "onmessage", "onmessageerror",
    "onoffline", "ononline", "onpagehide", "onpageshow", "onpopstate", "onrejectionhandled", "onstorage", "onunhandledrejection",
    "onunload", "oncut", "oncopy", "onpaste",
)
# CSS properties whose url() is a picture; the last six belong to @counter-style.
IMAGE_PROPERTIES = (
    "background", "background-image", "border-image", "border-image-source", "content", "cursor", "list-style",
    "list-style-image", "mask", "mask-image", "additive-symbols", "negative", "pad", "prefix", "suffix", "symbols",
)
LINK_TYPES = ("alternate", "dns-prefetch", "preload", "stylesheet", "icon", "apple-touch-icon")
FAVICONS = ("icon", "shortcut icon")
# The frame of an MHTML file.
MHTML_HEAD = (
    'MIME-Version: 1.0\r\nContent-Type: multipart/related; boundary="----=_NextPart_000_0000"\r\n\r\n'
    '------=_NextPart_000_0000\r\nContent-Type: text/html; charset="utf-8"\r\nContent-Location: http://example.com/\r\n\r\n'
)
MHTML_TAIL = "\r\n------=_NextPart_000_0000--\r\n"
#: Flag, and what it adds to the content security policy, in this order.
POLICY = (
    ("isolate", "default-src 'unsafe-eval' 'unsafe-inline' data:;"),
    ("no_css", "style-src 'none';"),
    ("no_fonts", "font-src 'none';"),
    ("no_frames", "frame-src 'none'; child-src 'none';"),
    ("no_js", "script-src 'none';"),
    ("no_images", "img-src data:;"),
)
#: Characters of a title and what stands for them in a path, in this order.
TITLE_MAP = (("/", "_"), ("\\", "_"), ("<", "["), (">", "]"), (":", " - "), ('"', ""), ("|", "-"), ("?", ""))


def policy(options: Options) -> str:
    return " ".join(text for flag, text in POLICY if getattr(options, flag))


def policy_col(flags: dict[str, Column]) -> Column:
    return F.concat_ws(" ", *[F.when(flags[flag], text) for flag, text in POLICY if flag in flags])


def link_types(rel: str) -> list[str]:
    return [x for x in rel.lower().split() if x in LINK_TYPES]


def link_types_col(rel: Column) -> Column:
    return F.filter(F.split(F.trim(F.lower(rel)), r"\s+"), lambda x: x.isin(*LINK_TYPES))


def is_favicon(rel: str) -> bool:
    return rel.lower() in FAVICONS


def is_event_handler(name: str) -> bool:
    return name.lower() in EVENTS


def is_image_property(name: str) -> bool:
    return name.lower() in IMAGE_PROPERTIES


def srcset(value: str) -> list[tuple[str, str]]:
    """(path, descriptor) of each candidate; a descriptor may be glued to the next path by a comma."""
    out: list[tuple[str, str]] = []
    text = value
    while text := text.lstrip(" \t\n\f\r,"):
        path = re.match(r"[^ \t\n\f\r]+", text)[0]
        text = text[len(path) :]
        if path.endswith(","):
            out.append((path.rstrip(","), ""))
            continue
        text = text.lstrip(" \t\n\f\r")
        descriptor = re.match(r"[^ \t\n\f\r,]*", text)[0]
        text = text[len(descriptor) :]
        out.append((path, descriptor))
        text = text.lstrip(" \t\n\f\r").removeprefix(",")
    return out


def integrity_holds(data: bytes, integrity: str) -> bool:
    kind, dash, value = integrity.partition("-")
    if not dash or kind not in ("sha256", "sha384", "sha512"):
        return False
    return base64.b64encode(hashlib.new(kind, data).digest()).decode() == value


def metadata_comment(url: str, timestamp: str) -> str:
    from pressleaf.functions import urls

    found = urls.parse(url)
    source = urls.referer(url) if found and found.scheme in ("http", "https") else "local source"
    return f"<!-- Saved from {source} at {timestamp} using {PRODUCT} -->"


def output_path(template: str, title: str, output_format: str, timestamp: str) -> str:
    for a, b in TITLE_MAP:
        title = title.replace(a, b)
    short, long = ("mht", "mhtml") if output_format == "mhtml" else ("htm", "html")
    path = template.replace("%timestamp%", timestamp.replace(":", "_")).replace("%title%", title.lstrip("."))
    return path.replace("%ext%", short).replace("%extension%", long)


def output_path_col(template: Column, title: Column, output_format: str, timestamp: str) -> Column:
    for a, b in TITLE_MAP:
        title = F.replace(title, F.lit(a), F.lit(b))
    short, long = ("mht", "mhtml") if output_format == "mhtml" else ("htm", "html")
    out = F.replace(template, F.lit("%timestamp%"), F.lit(timestamp.replace(":", "_")))
    out = F.replace(out, F.lit("%title%"), F.ltrim(title, F.lit(".")))
    return F.replace(F.replace(out, F.lit("%ext%"), F.lit(short)), F.lit("%extension%"), F.lit(long))


def unwrap_noscript(html: str) -> str:
    return re.sub(r"<(/?noscript[^>]*)>", r"<!--\1-->", html)


def unwrap_noscript_col(html: Column) -> Column:
    return F.regexp_replace(html, "<(/?noscript[^>]*)>", "<!--$1-->")


def escape_script(text: str) -> str:
    return text.replace("</script>", "<\\/script>")


def mhtml(html: str) -> str:
    return MHTML_HEAD + html + MHTML_TAIL
