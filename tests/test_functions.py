import pytest

from pressleaf.functions import css, markup, media, urls
from pressleaf.options import Options


@pytest.mark.parametrize(
    "base, href, expected",
    [
        ("https://www.example.org", "a/b.html", "https://www.example.org/a/b.html"),
        ("https://www.example.org", "../a/b.html", "https://www.example.org/a/b.html"),
        ("https://www.example.org/x/y?z", "?q", "https://www.example.org/x/y?q"),
        ("https://www.example.org", "//other.org/t.png", "https://other.org/t.png"),
        ("data:text/html,x", "//other.org/t", "data:,"),
        ("data:text/html,x", "file:///etc/passwd", "file:///etc/passwd"),
        ("file:///home/u/i.html", "img\\l.png", "file:///home/u/img/l.png"),
        ("file:\\\\\\home\\u\\i.html", "l.png", "file:///home/u/l.png"),
        ("file:///tmp/a.html", "//local-file.html", "file://local-file.html/"),
        ("https://EXAMPLE.org:443/a", "/für x", "https://example.org/f%C3%BCr%20x"),
    ],
)
def test_resolve(base, href, expected):
    assert urls.resolve(base, href) == expected


@pytest.mark.parametrize(
    "domain, pattern, expected",
    [("a.b.c", "b.c", False), ("a.b.c", ".b.c", True), ("b.c", ".b.c", True), ("xb.c", ".b.c", False), ("B.C.", "b.c", True), ("a", "", False), ("a", ".", True)],
)
def test_within_domain(domain, pattern, expected):
    assert urls.within_domain(domain, pattern) is expected


def test_domain_columns_agree(spark):
    from pyspark.sql import functions as F

    rows = [(d, p) for d in ("a.b.c", "b.c", "xb.c", "B.C.", "") for p in ("", ".", "b.c", ".b.c", "C", ".c.")]
    df = spark.createDataFrame(rows, "d string, p string")
    for r in df.select("d", "p", urls.within_domain_col(F.col("d"), F.col("p")).alias("x")).collect():
        assert r["x"] == urls.within_domain(r["d"], r["p"]), r


def test_data_urls():
    assert urls.parse_data_url("data:text/html;base64,VGVzdA==") == ("text/html", "US-ASCII", b"Test")
    assert urls.parse_data_url("data:,a%20b+c") == ("text/plain", "US-ASCII", b"a b+c")
    assert urls.parse_data_url("data:text/plain;base64,bad!") == ("text/plain", "US-ASCII", b"")
    for data in (b"", b"x", bytes(range(256))):
        made = urls.data_url("a/b", "utf-8", data)
        assert urls.parse_data_url(made) == ("a/b", "utf-8", data)


def test_media_types():
    assert media.detect(b"GIF89a123") == "image/gif"
    assert media.detect(b"", "https://x.de/a.CSS?x#y") == "text/css"
    assert media.detect(b"RIFF1234WEBPVP8 ") == ""
    assert media.detect(b"RIFF1234WEBPVP8 ", wildcard=True) == "image/webp"
    assert media.by_name("css") == "text/css"
    assert media.content_type("text/html; charset=a;charset=b;BASE64") == ("text/html", "b", True)
    assert media.encode("ü☃", "iso-8859-1") == b"\xfc&#9731;"
    assert media.decode(b"\x80", "US-ASCII") == "€"


def test_srcset_ends():
    assert markup.srcset("a.png foo, b.png") == [("a.png", "foo"), ("b.png", "")]
    assert markup.srcset("s.png 1x,m.png 2x") == [("s.png", "1x"), ("m.png", "2x")]
    assert markup.srcset(" , ,") == []


def test_markup():
    assert markup.policy(Options(no_css=True, no_images=True)) == "style-src 'none'; img-src data:;"
    assert markup.output_path("%title%.%extension%", "..a/b:c", "html", "") == "a_b - c.html"
    assert markup.link_types(" Shortcut ICON x ") == ["icon"]
    assert markup.integrity_holds(b"abc", "sha256-ungWv48Bz+pBQUDeXa4iI7ADYaOWF3qctBD/YfIAFa0=")
    assert not markup.integrity_holds(b"abc", "SHA256-ungWv48Bz+pBQUDeXa4iI7ADYaOWF3qctBD/YfIAFa0=")
    assert markup.metadata_comment("https://u:p@x.de/a#b", "T").startswith("<!-- Saved from https://x.de/a at T")
    assert "local source" in markup.metadata_comment("file:///x", "T")


@pytest.mark.parametrize(
    "text, expected",
    [
        ("\t \t ", ""),
        ("a{w:99.998%; m:-20px; h: calc(100vh - 10pt);t: rotate(+45deg) .5em 3e2}", "a{w:99.998%; m:-20px; h: calc(100vh - 10pt);t: rotate(+45deg) 0.5em 300}"),
        ("#id.class:not(:nth-child(3n+0)) {\n b: url(#x)}\nhtml > body {}", None),
        ('[data-value~="foo"] {\n /* x */ }', None),
        (".is\\:good:hover { color: green }", None),
        ("@charset 'UTF-8';", '@charset "UTF-8";'),
        (".a{width: 500px\\9;}", ".a{width: 500px\t;}"),
    ],
)
def test_css(text, expected):
    assert css.rewrite(text, lambda a, i: a) == (text if expected is None else expected)


def test_css_fonts_and_images():
    out = css.rewrite("@font-face {\n src: url(a.woff);\n}\n*{c:d}", lambda a, i: a, no_fonts=True)
    assert out == " \n*{c:d}"
    out = css.rewrite("p{background: url(a.png)} q{src: url(b)}", lambda a, i: f"!{a}", no_images=True)
    assert out == f'p{{background: url("{markup.EMPTY_IMAGE}")}} q{{src: url("!b")}}'
    assert css.references("@import 'a'; @import url(b); p{x:url('c')}") == [("a", True), ("b", True), ("c", False)]
