import pyarrow as pa
import pytest

from pressleaf.functions import urls
from pressleaf.operators.bundle import Asset, bundle, needed_assets, references, rewrite_page
from pressleaf.options import Options
from pressleaf.sources import cookies, html


@pytest.mark.parametrize(
    "text, expected",
    [
        ("<div><P></P></div>", "<html><head></head><body><div><p></p></div></body></html>"),
        ('<frameset><frame src=""></frameset>', '<html><head></head><frameset><frame src=""></frameset></html>'),
        ('<body background="a" background="b"></body>', '<html><head></head><body background="a"></body></html>'),
        ("<p>a<b>c<p>d", "<html><head></head><body><p>a<b>c</b></p><p><b>d</b></p></body></html>"),
        ("<table><tr><td>1<td>2</table>", "<html><head></head><body><table><tbody><tr><td>1</td><td>2</td></tr></tbody></table></body></html>"),
        ("<a href=1>x<div>y</a>z</div>", '<html><head></head><body><a href="1">x</a><div><a href="1">y</a>z</div></body></html>'),
        ("", "<html><head></head><body></body></html>"),
        ('<script>var t="</p>"</script>', '<html><head><script>var t="</p>"</script></head><body></body></html>'),
    ],
)
def test_trees(text, expected):
    tree = html.parse(text)
    assert html.serialize(tree) == expected
    assert html.serialize(html.parse(expected)) == expected


def test_extractors():
    tree = html.parse('<base href=""><title>a &amp; b</title><meta http-equiv=Content-Type content="text/html;charset=x"><link rel="Icon"><meta name=Robots content=all>')
    assert (html.base_url(tree), html.title(tree), html.charset(tree), html.has_favicon(tree), html.robots(tree)) == ("", "a & b", "x", True, "all")
    html.set_charset(tree, "utf-8")
    html.set_base_url(tree, "http://x/")
    html.set_robots(tree, "none")
    assert html.serialize(tree).count("none") == 1 and 'content="text/html;charset=utf-8"' in html.serialize(tree)


def plain(text, catalog=None, **flags):
    made, _, log = rewrite_page(text, "http://localhost/p", (catalog or {}).get, Options(no_metadata=True, **flags))
    return made.decode(), log


def test_rules():
    assert '<link rel="stylesheet">' in plain('<link rel="stylesheet" href="main.css">', no_css=True)[0]
    assert "onclick" not in plain('<div onClick="void(0)"></div>', no_js=True)[0]
    assert '<meta content="2">' in plain('<meta http-equiv="Refresh" content="2"/>')[0]
    assert 'href="http://localhost/x"' in plain('<a href="/x">y</a>')[0]
    assert 'href="#x"' in plain('<a href="#x">y</a>')[0]
    assert "<iframe src=\"\"></iframe>" in plain('<iframe src="http://a.b"></iframe>', no_frames=True)[0]
    assert 'src="http://localhost/i.png"' in plain('<img src="i.png">')[0]


def test_cycles_end():
    catalog = {
        "http://localhost/a.css": Asset(b"@import 'b.css';", "http://localhost/a.css", "text/css"),
        "http://localhost/b.css": Asset(b"@import 'a.css';", "http://localhost/b.css", "text/css"),
        "http://localhost/f": Asset(b"<iframe src=f></iframe>", "http://localhost/f", "text/html"),
    }
    made, _ = plain("<link rel=stylesheet href=a.css><iframe src=f></iframe>", catalog)
    assert made.count("data:text/css") == 1


def test_integrity():
    catalog = {"http://localhost/s.js": Asset(b"x", "http://localhost/s.js", "text/javascript")}
    assert '<script src="s.js"></script>' in plain('<script src="s.js" integrity="sha256-bad"></script>', catalog)[0]
    assert "<script>x</script>" in plain('<script src="s.js"></script>', catalog)[0]


def test_nothing_left_to_fetch():
    catalog = {"http://localhost/i.png": Asset(b"\x89PNG\r\n\x1a\n", "http://localhost/i.png")}
    once, _ = plain("<img src=i.png><style>p{background:url(i.png)}</style>", catalog)
    assert references(once, "http://localhost/p") == ["http://localhost/favicon.ico"]


def test_bundle_tables(spark):
    pages = spark.createDataFrame(
        [(1, "http://x.de/p", "<title>T</title><link rel=stylesheet href=a.css><img src=no.png>"), (2, None, None), (3, "", "")],
        "page_id long, url string, html string",
    )
    assets = spark.createDataFrame(
        [("http://x.de/a.css", None, "text/css", None, bytearray(b"@import 'b.css';")), ("http://x.de/b.css", None, None, None, bytearray(b"p{}"))],
        "url_key string, final_url string, media_type string, charset string, data binary",
    )
    assert {(r[0], r[1]) for r in needed_assets(pages, assets).select("page_id", "url_key").collect()} == {(1, "http://x.de/a.css"), (1, "http://x.de/b.css")}
    rows = {r["page_id"]: r for r in bundle(pages, assets).collect()}
    assert rows[1]["title"] == "T" and b"data:text/css" in rows[1]["content"] and b"http://x.de/no.png" in rows[1]["content"]
    assert all(r["error"] is None for r in rows.values()) and len(rows) == 3
    assert bundle(pages.where("false"), assets).count() == 0


def test_cookies(spark):
    lines = ["# HTTP Cookie File", "X.org\tTRUE\t/\tFALSE\t0\ta\tb", "x\ty", "z.org\tTRUE\t/\tFALSE\tno\ta\tb"]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no int, value string")
    assert [r["domain"] for r in cookies.parse(df).collect()] == ["x.org"]
    with pytest.raises(ValueError):
        cookies.parse(df.where("line_no > 0").withColumn("line_no", df["line_no"] - 1)).collect()
    assert cookies.parse(df.where("false")).count() == 0


def test_entry_without_llm(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "page_titles" in names and set(__spark_entry__.oracle_sql()) <= set(names)


def test_css_rewrite_takes_every_block(spark, tmp_path):
    from pressleaf.plans import catalogue

    rows = [(1, "u", "<style>a{}</style><p><style media=x>b{}\n</style>"), (2, "u", "<p>"), (3, "u", None), (4, "u", "<style>c{}</style>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = {r["page_id"]: r["css"] for r in catalogue.QUERIES["css_rewrite"](spark, str(tmp_path)).collect()}
    assert "a{" in found[1] and "b{" in found[1] and found[2] == "" and "c{" in found[4]


def test_nested_assets_of_any_type(spark):
    """What a sheet, an import or a frame needs comes along whatever media type they were served as."""
    page = "<link rel=stylesheet href=a><iframe src=f></iframe><link rel=stylesheet href=t>"
    rows = [("a", "text/plain", b"@import 'b';p{background:url(i)}"), ("b", "application/octet-stream", b"q{background:url(j)}"), ("f", "text/plain", b"<img src=k>"), ("t", "TEXT/CSS", b"p{background:url(l)}")]
    rows += [(n, "image/png", b"\x89PNG\r\n\x1a\n") for n in "ijkl"]
    assets = spark.createDataFrame([(f"http://x.de/{n}", None, kind, None, bytearray(data)) for n, kind, data in rows], "url_key string, final_url string, media_type string, charset string, data binary")
    pages = spark.createDataFrame([(1, "http://x.de/p", page)], "page_id long, url string, html string")
    assert sorted(r["url_key"][-1] for r in needed_assets(pages, assets).collect()) == sorted("abftijkl")
    (row,) = bundle(pages, assets).collect()
    assert row["error"] is None and b"http://x.de/" not in row["content"].partition(b"\n")[2]


def test_tasks_hold_slices(spark, monkeypatch):
    """A batch of many pages is worked through in small pieces, whatever its rows; none is lost, and the order stays."""
    runs, page = [], spark.createDataFrame([(1, "http://x.de/", "")], "page_id long, url string, html string")
    monkeypatch.setattr(type(page), "mapInArrow", lambda self, f, *a, **k: runs.append(f) or self)
    bundle(page)
    asset = {"url_key": "http://x.de/i.png", "final_url": None, "media_type": "image/png", "charset": None, "data": b"P"}
    rows = [
        {"page_id": i, "url": "http://x.de/", "html": f"<img src=i.png><p>{'x' * 20_000}", "media_type": None, "charset": None, "assets": [asset] if i % 2 else None}
        for i in range(400)
    ]
    kinds = {"page_id": pa.int64(), **dict.fromkeys(("url", "html", "media_type", "charset"), pa.string())}
    assets = pa.list_(pa.struct([(k, pa.binary() if k == "data" else pa.string()) for k in asset]))
    made = list(runs[0](iter([pa.RecordBatch.from_pylist(rows, pa.schema([*kinds.items(), ("assets", assets)]))])))
    assert len(made) >= 4 and max(x.nbytes for x in made) < 3 << 20
    back = [x for batch in made for x in batch.to_pylist()]
    assert [x["page_id"] for x in back] == list(range(400))
    assert all((b"base64,UA==" in x["content"]) == bool(x["page_id"] % 2) for x in back)
    assert [x["log"][0]["status"] for x in back[:2]] == ["not found", "ok"]


def test_references_do_no_other_work(monkeypatch):
    """What a page refers to is listed without writing it, and a base is parsed once, not once for each link."""
    parsed, parse = [], urls.parse
    monkeypatch.setattr(urls, "parse", lambda *a: parsed.append(a) or parse(*a))
    monkeypatch.setattr(html, "serialize", lambda node: pytest.fail("written"))
    page = "".join(f'<a href="/{i}">x</a>' for i in range(100))
    assert references(f"<img src=i.png>{page}", "http://once.example/p/") == ["http://once.example/p/i.png", "http://once.example/favicon.ico"]
    assert len(parsed) < 220  # a link's own address, once to see whether it is whole and once against the base
