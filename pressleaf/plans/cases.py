"""Literal cases of the page engine's rules, each with what it must give; the SQL twins state the same values."""

from __future__ import annotations

from pressleaf.functions import markup
from pressleaf.sources import html as dom
from pressleaf.sources import targets

SRCSETS = (
    ("one.png 1x, two.png 2x", "one.png 1x|two.png 2x"), ("one.png", "one.png "), ("one.png,two.png 2x", "one.png,two.png 2x"),
    ("s.png 1x,m.png 2x,l.png 3x", "s.png 1x|m.png 2x|l.png 3x"), ("one.png odd, two.png 100w", "one.png odd|two.png 100w"), ("", ""),
    ("one.png, two.png", "one.png |two.png "), (" , one.png  2x ", "one.png 2x"),
)
#: Every address comes back in capitals, one that is gone is dropped.
SHEETS = (
    ("", ""), (" \n ", ""), ("/* a */", "/* a */"), ("@charset 'utf-8';", '@charset "utf-8";'), ('@import "a.css";', '@import "A.CSS";'),
    ("@import 'a.css' screen;", '@import "A.CSS" screen;'), ("@import url(a.css);", '@import url("A.CSS");'), ('@import url("a.css");', '@import url("A.CSS");'),
    ("@import '';", "@import '';"), ("p{background:url(x.png)}", 'p{background:url("X.PNG")}'), ("p{background:url('x.png')}", 'p{background:url("X.PNG")}'),
    ("p{background:url(#s)}", "p{background:url(#s)}"), ("p{background:url(gone.png)}", "p{background:url()}"), ("p{background:url()}", "p{background:url()}"),
    ("p{width:calc(1px + 2.50em)}", "p{width:calc(1px + 2.5em)}"), ("p{margin:+.5px -0 1e2px 07%}", "p{margin:+0.5px 0 100px 7%}"),
    ("#a1 .b[c='d']>e~f{g:h!important}", '#a1 .b[c="d"]>e~f{g:h!important}'), ("p{color:#1fA}", "p{color:#1fA}"),
    ("p{content:'\\201C x'}", 'p{content:"“x"}'.replace("“x", "“ x".replace(" ", "", 1)) if False else 'p{content:"“x"}'),
    ("a{b:url(x y)}", "a{b:}"), ("<!-- a{} -->", "<!-- a{} -->"), ("a{b:(c", "a{b:(c)}"), ("a}b", "a}b"), ("--x:{y:1}", "--x:{y:1}"),
)
BARE_SHEETS = (
    ("p{background:url(x.png)}", f'p{{background:url("{markup.EMPTY_IMAGE}")}}'), ("p{behavior:url(x.htc)}", 'p{behavior:url("x.htc")}'),
    ("@font-face{font-family:a;src:url(a.woff)}p{color:red}", "p{color:red}"), ("@import 'a.css';", '@import "a.css";'),
    ("@counter-style c{symbols:url(1.png) url(2.png)}", f'@counter-style c{{symbols:url("{markup.EMPTY_IMAGE}") url("{markup.EMPTY_IMAGE}")}}'),
)
#: base, a space, reference
RESOLVE = (
    ("https://t.example a/b.html", "https://t.example/a/b.html"), ("https://t.example/x/ ../y", "https://t.example/y"),
    ("https://t.example //o.example/z", "https://o.example/z"), ("data:text/html,x //o.example/z", "data:,"), ("file:///home/i.html a\\b.png", "file:///home/a/b.png"),
    ("https://t.example/x /für", "https://t.example/f%C3%BCr"), ("https://t.example/x?q#f ?r", "https://t.example/x?r"), ("https://t.example/x #g", "https://t.example/x#g"),
    ("https://t.example/x HTTP://A.Example:80/./b/../c", "http://a.example/c"), ("http://t.example/d/ mailto:a@b", "mailto:a@b"),
    ("http://t.example/a/b/c ./../d?e=f g", "http://t.example/a/d?e=f%20g"), ("file:///a/b.html //c.html", "file://c.html/"),
)
TARGETS = (
    ("", "error: no target specified"), ("https://t.example", "https://t.example/"), ("data:text/html,x", "data:text/html,x"), ("t.example/no-such", "http://t.example/no-such"),
    ("ftp://t.example/", 'error: unsupported target URL scheme "ftp"'), ("mailto:a@b", 'error: unsupported target URL scheme "mailto"'), ("/", 'error: local target "/" is not a file'),
)
#: label and bytes
CHARSETS = (
    ("utf-8 c3a9ff", "é�"), ("UTF8 efbbbf61", "a"), ("us-ascii e980", "é€"), ("latin1 81", "\x81"), ("iso-8859-9 fd", "ı"), ("shift_jis 93fa", "日"), ("gb2312 d6d0", "中"),
    ("big5 a4a4", "中"), ("euc-kr b0a1", "가"), ("koi8-ru c1", "а"), ("windows-874 a1", "ก"), ("x-user-defined 80", ""), ("iso-8859-8-i e0", "א"), ("hex 6162", "ab"),
    ("rot13 6162", "ab"), ("replacement 6162", "�"), ("utf-16 61003000", "a0"), ("ucs-2 6100", "a"), ("x-cp1252 80", "€"), ("iso88591 e9", "é"), ("none 61", "a"),
    ("windows-1253 aa", "�"), ("utf-8 feff0061", "a"), ("Windows-1251 e0", "а"),
)
ENCODED = (("latin1 é€ж", "e9802623313037383b"), ("utf-16 é", "c3a9"), ("gbk 中", "d6d0"), ("none é", "c3a9"))
LABELS = tuple((x, "True") for x in ("utf-8", " UTF8\n", "csisolatin1", "iso_8859-1", "cp819", "x-sjis", "unicode", "l9", "ibm866")) + tuple(
    (x, "False") for x in ("hex", "zlib", "rot13", "idna", "undefined", "unicode_escape", "base64", "punycode", "utf-7", "utf_8", "", "iso-2022-kr", "cp437")
)
IDENTS = (("a", 'a "a"'), ("\\31 0", '\\31 0 "\\\\31 0"'), ("a\\:b", 'a\\:b "a\\\\:b"'), ("-", '\\- "-"'), ("é", 'é "é"'), ("a\\9", 'a\\9 "a\\\\9"'))
TREES = (
    ("", "<html><head></head><body></body></html>"), ("<div><P></P></div>", "<html><head></head><body><div><p></p></div></body></html>"),
    ("<p>a<i>b<p>c", "<html><head></head><body><p>a<i>b</i></p><p><i>c</i></p></body></html>"), ("<b><b><b><b>x<p>y", "<html><head></head><body><b><b><b><b>x<p>y</p></b></b></b></b></body></html>"),
    ("<p><b><b><b><b>x<p>y", "<html><head></head><body><p><b><b><b><b>x</b></b></b></b></p><p><b><b><b>y</b></b></b></p></body></html>"),
    ("<ul><li>1<li>2</ul>", "<html><head></head><body><ul><li>1</li><li>2</li></ul></body></html>"), ("&lt;&eacute;&amp", "<html><head></head><body>&lt;é&amp;</body></html>"),
    ("<table><td>1<td>2</table>", "<html><head></head><body><table><tbody><tr><td>1</td><td>2</td></tr></tbody></table></body></html>"),
    ("<!doctype HTML><title>a</title>x", "<!DOCTYPE html><html><head><title>a</title></head><body>x</body></html>"), ("<script>a<b</script>", "<html><head><script>a<b</script></head><body></body></html>"),
    ("<a title='\"'>&nbsp;</a>", '<html><head></head><body><a title="&quot;">&nbsp;</a></body></html>'), ("<svg><lineargradient/></svg>", "<html><head></head><body><svg><linearGradient></linearGradient></svg></body></html>"),
)
PATHS = (
    ("html/body/svg/defs/symbol <svg><defs><symbol id=a></symbol><symbol id=b></symbol></defs><symbol id=c></symbol></svg>", "a|b|c"),
    ("HTML/Head/Link <link id=x><p><link id=y>", "x"), ("html/body/em <p><em id=z></em>", ""),
)
#: action and page
WRITERS = (
    ("icon <p>", '<html><head><link rel="icon" href="data:,i"></link></head><body><p></p></body></html>'), ("base <base href=a>", '<html><head><base href="/n/"></head><body></body></html>'),
    ("base <p>", '<html><head><base href="/n/"></base></head><body><p></p></body></html>'), ("charset <meta charset=a>", '<html><head><meta charset="utf-8"></head><body></body></html>'),
    ("charset <meta http-equiv=Content-Type content=x>", '<html><head><meta http-equiv="Content-Type" content="text/html;charset=utf-8"></head><body></body></html>'),
    ("charset <p>", '<html><head><meta charset="utf-8"></meta></head><body><p></p></body></html>'), ("robots <meta name=ROBOTS content=all>", '<html><head><meta name="ROBOTS" content="none"></head><body></body></html>'),
    ("robots <p>", '<html><head><meta name="robots" content="none"></meta></head><body><p></p></body></html>'),
)


def target_or_error(text: str) -> str:
    try:
        return targets.resolve(text)
    except ValueError as e:
        return f"error: {e}"


def written(case: str) -> str:
    action, _, page = case.partition(" ")
    tree = dom.parse(page)
    {"icon": lambda: dom.add_favicon(tree, "data:,i"), "base": lambda: dom.set_base_url(tree, "/n/"), "charset": lambda: dom.set_charset(tree, "utf-8"), "robots": lambda: dom.set_robots(tree, "none")}[action]()
    return dom.serialize(tree)


_AT = "http://t.example"
#: address, media type, content
CATALOG = (
    (f"{_AT}/p.png", "image/png", "P"), (f"{_AT}/s.css", "text/css", "a{b:url(p.png)}"), (f"{_AT}/j.js", "text/javascript", "j()"), (f"{_AT}/m.mp3", "audio/mpeg", "M"),
    (f"{_AT}/v.mp4", "video/mp4", "V"), (f"{_AT}/f.html", "text/html", "<p>f"), (f"{_AT}/i.svg", "image/svg+xml", '<svg><defs><symbol id="x"><g></g></symbol></defs></svg>'),
)
_P, _M, _V, _F = "data:image/png;base64,UA==", "data:audio/mpeg;base64,TQ==", "data:video/mp4;base64,Vg==", "data:text/html;base64,PGh0bWw+PGhlYWQ+PC9oZWFkPjxib2R5PjxwPmY8L3A+PC9ib2R5PjwvaHRtbD4="
_S = "data:text/css;base64,YXtiOnVybCgiZGF0YTppbWFnZS9wbmc7YmFzZTY0LFVBPT0iKX0="
_ROBOTS = '<meta name="robots" content="none"></meta>'


def _page(body: str, head: str = "", flag: str = "") -> str:
    policy = f'<meta http-equiv="Content-Security-Policy" content="{dict(markup.POLICY)[flag]}"></meta>' if flag else ""
    return f"<html><head>{policy}{head}{_ROBOTS}</head><body>{body}</body></html>\n"


#: name, option flags, page, document
WALKS = (
    ("meta refresh", "", '<meta http-equiv="Refresh" content="1">', _page("", '<meta content="1">')),
    ("icon", "", '<link rel="icon" href="/p.png">', _page("", f'<link rel="icon" href="{_P}">')),
    ("icon dropped", "no_images", '<link rel="apple-touch-icon" href="/p.png">', _page("", '<link rel="apple-touch-icon">', "no_images")),
    ("sheet", "", '<link rel="stylesheet" href="/s.css">', _page("", f'<link rel="stylesheet" href="{_S}">')),
    ("sheet dropped", "no_css", '<link rel="stylesheet" href="/s.css" integrity="x">', _page("", '<link rel="stylesheet">', "no_css")),
    ("sheet of wrong digest", "", '<link rel="stylesheet" href="/s.css" integrity="sha256-x">', _page("", '<link rel="stylesheet" href="/s.css">')),
    ("preload", "", '<link rel="preload" href="/x">', _page("", '<link href="/x">')),
    ("other link", "", '<link rel="next" href="x">', _page("", f'<link rel="next" href="{_AT}/d/x">')),
    ("base", "", '<base href="/b/"><a href="c">d</a>', _page(f'<a href="{_AT}/b/c">d</a>', f'<base href="{_AT}/b/">')),
    ("background", "", '<body background="/p.png">', _page("").replace("<body>", f'<body background="{_P}">')),
    ("background dropped", "no_images", '<body background="/p.png">', _page("", "", "no_images")),
    ("img", "", '<img src="/p.png"><img data-src="/p.png"><img><img src="/none.png">', _page(f'<img src="{_P}"><img data-src="/p.png" src="{_P}"><img src=""><img src="{_AT}/none.png">')),
    ("img dropped", "no_images", '<img src="/p.png">', _page(f'<img src="{markup.EMPTY_IMAGE}">', "", "no_images")),
    ("srcset", "", '<img src="/p.png" srcset="/p.png 1x, /none.png 2x">', _page(f'<img src="{_P}" srcset="{_P} 1x, {_AT}/none.png 2x">')),
    ("input image", "", '<input type="Image" src="/p.png"><input type="image" src="">', _page(f'<input type="Image" src="{_P}"><input type="image" src="">')),
    ("svg dropped", "no_images", "<svg><g></g></svg>", _page("<svg></svg>", "", "no_images")),
    ("svg image", "", '<svg><image href="/p.png"/></svg>', _page(f'<svg><image href="{_P}"></image></svg>')),
    ("use symbol", "", '<svg><use href="/i.svg#x"/></svg>', _page('<svg><use href="#x"><symbol id="x"><g></g></symbol></use></svg>')),
    ("use inside", "", '<svg><use href="#y"/></svg>', _page('<svg><use href="#y"></use></svg>')),
    ("source", "", '<audio><source src="/m.mp3"></audio><video><source src="/v.mp4"></video>', _page(f'<audio><source src="{_M}"></audio><video><source src="{_V}"></video>')),
    ("picture source", "", '<picture><source srcset="/p.png 2x"></picture>', _page(f'<picture><source srcset="{_P} 2x"></picture>')),
    ("links", "", '<a href="x">1</a><a href="#y">2</a><area href="//o.example/z"><a href="mailto:q">3</a>', _page(f'<a href="{_AT}/d/x">1</a><a href="#y">2</a><area href="http://o.example/z"><a href="mailto:q">3</a>')),
    ("javascript link", "no_js", '<a href="javascript:f()">1</a>', _page('<a href="javascript:;">1</a>', "", "no_js")),
    ("script", "", '<script src="/j.js"></script>', _page("", "<script>j()</script>")),
    ("module", "", '<script type="module" src="/j.js"></script>', _page("", '<script type="module" src="data:module;base64,aigp"></script>')),
    ("script dropped", "no_js", '<script src="/j.js">k()</script>', _page("", "<script></script>", "no_js")),
    ("style", "", "<style>a{b:url(/p.png)}</style>", _page("", f'<style>a{{b:url("{_P}")}}</style>')),
    ("style dropped", "no_css", "<style>a{b:c}</style><p style='d:e'>", _page("<p></p>", "<style></style>", "no_css")),
    ("form", "", '<form action="x"></form>', _page(f'<form action="{_AT}/d/x"></form>')),
    ("frame", "", '<iframe src="/f.html#q"></iframe>', _page(f'<iframe src="{_F}#q"></iframe>')),
    ("frame dropped", "no_frames", '<iframe src="/f.html"></iframe>', _page('<iframe src=""></iframe>', "", "no_frames")),
    ("audio", "", '<audio src="/m.mp3"></audio>', _page(f'<audio src="{_M}"></audio>')),
    ("audio dropped", "no_audio", '<audio src="/m.mp3"><source src="/m.mp3"></audio>', _page("<audio><source></audio>")),
    ("video", "", '<video src="/v.mp4" poster="/p.png"></video>', _page(f'<video src="{_V}" poster="{_P}"></video>')),
    ("video dropped", "no_video", '<video src="/v.mp4"></video>', _page("<video></video>")),
    ("noscript", "", '<body><noscript><img src="/p.png"></noscript>', _page(f'<noscript><img src="{_P}"></noscript>')),
    ("noscript unwrapped", "unwrap_noscript", '<body><noscript><i>a</i></noscript>', _page("<!--noscript--><i>a</i><!--/noscript-->")),
    ("style attribute", "", '<p style="background:url(/p.png)">', _page('<p style="background:url(&quot;' + _P + '&quot;)"></p>')),
    ("handlers", "no_js", '<p onclick="f()" onfoo="g()">', _page('<p onfoo="g()"></p>', "", "no_js")),
    ("other tags", "", "<p title=x>a<em>b</em>", _page('<p title="x">a<em>b</em></p>')),
)
