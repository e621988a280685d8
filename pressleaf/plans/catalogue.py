"""Registered queries of the page engine, each with its SQL twin where SQL has the means.

Every query reads its whole table. Rows that the tables lack (cookies, srcset, content types) are literal and stated once
for both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pressleaf.functions import css, markup, media, urls
from pressleaf.operators.bundle import bundle, last_assets, needed_assets, page_references
from pressleaf.operators.nodes import dom_nodes
from pressleaf.options import Options
from pressleaf.plans import cases, documents
from pressleaf.sources import cookies as cookie_file
from pressleaf.sources import html as dom
from pressleaf.sources import sinks, store

QUERIES: dict = {}
SQL: dict[str, str] = {}

STAMP = "2025-01-01T00:00:00Z"
NOW = 1_750_000_000
ORIGIN = "^(https?://[^/?#]+)"
HREF = '<a href="([^"]*)"'
CONTENT_TYPES = (
    "text/html", "text/html;charset=utf-8", "text/html; charset=iso-8859-1;base64", "", ";base64", "image/png;BASE64",
    "text/css;charset=a;charset=b", "application/json; Charset=x", "text/plain;charset=US-ASCII",
)
RELS = ("stylesheet", "alternate stylesheet", "shortcut icon", " ICON ", "preload", "dns-prefetch", "apple-touch-icon", "something", "icon foo")
PATTERNS = (".example.com", "example.com", "", ".", ".com", "example.org.", ".org")
NAMES = ("onclick", "onClick", "href", "onfoo", "background-image", "Content", "symbols", "color", "onload", "width")
SCRIPTS = ("var a='</script>'", "x", "</SCRIPT></script></script>", "")
NOSCRIPTS = ("<noscript>a</noscript>", "<p><noscript class=\"x\">b</noscript>", "<p>none</p>")
MEDIA_NAMES = ("a.png", "b.JPG", "css", "x.tar.gz", "", "font.woff2", "dir.v1/none", "m.m4v")
HEADS = (b"GIF89a..", b"\x89PNG\r\n\x1a\n00", b"<svg xmlns", b"RIFF....WAVEfmt ", b"\x00\x00\x01\x00", b"plain", b"....ftypmp42")
COOKIES = (
    "# Netscape HTTP Cookie File",
    ".example.com\tTRUE\t/\tFALSE\t0\ta\t1",
    "example.org\tFALSE\t/docs\tTRUE\t1900000000\tb\t2",
    "# a comment",
    "broken line",
    "old.example.com\tFALSE\t/\tFALSE\t1\tc\t3",
    "www.example.com\tFALSE\t/p\tFALSE\t0\td\t4",
    "bad.example.com\tTRUE\t/\tFALSE\tsoon\te\t5",
)
IMPORTS = (("a.css", "b.css"), ("b.css", "c.css"), ("c.css", "a.css"), ("x.css", "y.css"))


def register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def literal(spark: SparkSession, values, name: str = "x") -> DataFrame:
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")


def _sql_rows(values, name: str = "x") -> str:
    quoted = ", ".join(f"({i}, '{v.replace(chr(39), chr(39) * 2)}')" for i, v in enumerate(values))
    return f"(SELECT * FROM (VALUES {quoted}) AS t(i, {name}))"


def _case(expr: str, pairs, other: str) -> str:
    return f"CASE {' '.join(f'WHEN {expr} = {chr(39)}{k}{chr(39)} THEN {chr(39)}{v}{chr(39)}' for k, v in pairs)} ELSE {other} END"


def _in(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def links(df: DataFrame) -> DataFrame:
    found = F.posexplode(F.regexp_extract_all("html", F.lit(HREF), 1)).alias("seq", "href")
    return df.select("page_id", "url", found).withColumn("target", F.concat(F.regexp_extract("url", ORIGIN, 1), "href"))


_LINKS = f"""(SELECT page_id, url, CAST(i - 1 AS INTEGER) AS seq, h[i] AS href, regexp_extract(url, '{ORIGIN}', 1) || h[i] AS target
  FROM (SELECT page_id, url, h, unnest(range(1, len(h) + 1)) AS i FROM (SELECT page_id, url, regexp_extract_all(html, '{HREF}', 1) AS h FROM pages)))"""


def _regex_query(name: str, pattern: str, out: str):
    register(name, f"SELECT page_id, nullif(regexp_extract(html, '{pattern}', 1), '') AS {out} FROM pages")(
        lambda spark, d: pages(spark, d).select("page_id", F.nullif(F.regexp_extract("html", pattern, 1), F.lit("")).alias(out))
    )


_regex_query("page_titles", "<title>([^<]*)</title>", "title")
_regex_query("page_charset", '<meta charset="([^"]*)"', "charset")
_regex_query("page_lang", '<html lang="([^"]*)"', "lang")
_regex_query("page_base", '<base href="([^"]*)"', "base")
_regex_query("robots_meta", '<meta name="robots" content="([^"]*)"', "robots")


@register("page_has_favicon", "SELECT page_id, regexp_matches(html, '<link[^>]* rel=\"(icon|shortcut icon)\"') AS has_favicon FROM pages")
def _(spark, d):
    return pages(spark, d).select("page_id", F.col("html").rlike('<link[^>]* rel="(icon|shortcut icon)"').alias("has_favicon"))


@register("clean_urls", "SELECT page_id, regexp_replace(url, '#.*$', '') AS url FROM pages")
def _(spark, d):
    return pages(spark, d).select("page_id", urls.clean_col(F.col("url")).alias("url"))


_USER = "'https://user:pw@' || regexp_replace(url, '^https?://', '')"


@register("referer_urls", f"SELECT page_id, regexp_replace(regexp_replace({_USER}, '#.*$', ''), '^([a-z][a-z0-9+.\\-]*://)[^/?#]*@', '\\1') AS referer FROM pages")
def _(spark, d):
    given = F.concat(F.lit("https://user:pw@"), F.regexp_replace("url", "^https?://", ""))
    return pages(spark, d).select("page_id", urls.referer_col(given).alias("referer"))


_PARTS = {"scheme": "^([a-z]+):", "host": "^[a-z]+://([^/?#:]*)", "path": "^[a-z]+://[^/?#]*([^?#]*)", "query": r"\?([^#]*)", "fragment": "#(.*)$"}


@register("url_parts", f"SELECT page_id, {', '.join(f'regexp_extract(url, {chr(39)}{p}{chr(39)}, 1) AS {n}' for n, p in _PARTS.items())} FROM pages")
def _(spark, d):
    return pages(spark, d).select("page_id", *[F.regexp_extract("url", p, 1).alias(n) for n, p in _PARTS.items()])


@register(
    "media_type_by_name",
    f"""SELECT page_id, {_case("split_part(lower(n), '.', -1)", media.BY_NAME.items(), "''")} AS media_type FROM (
    SELECT page_id, regexp_extract(url, '([^/?#]*)([?#].*)?$', 1) AS n FROM pages)""",
)
def _(spark, d):
    return pages(spark, d).select("page_id", media.by_name_col(F.regexp_extract("url", "([^/?#]*)([?#].*)?$", 1)).alias("media_type"))


@register("media_type_names", f"SELECT i, {_case(chr(39).join(['split_part(lower(x), ', '.', ', -1)']), media.BY_NAME.items(), chr(39) * 2)} AS media_type FROM {_sql_rows(MEDIA_NAMES)}")
def _(spark, d):
    return literal(spark, MEDIA_NAMES).select("i", media.by_name_col(F.col("x")).alias("media_type"))


_SNIFF = "CASE " + " ".join(f"WHEN starts_with(h, '{s.hex().upper()}') THEN '{k}'" for s, k in media.SIGNATURES) + " ELSE '' END"


@register("media_type_sniff", f"SELECT i, {_SNIFF} AS media_type FROM {_sql_rows([x.hex().upper() for x in HEADS], 'h')}")
def _(spark, d):
    return literal(spark, [x.hex() for x in HEADS], "h").select("i", media.sniff_col(F.unhex("h")).alias("media_type"))


@register("page_media_type", f"SELECT page_id, {_SNIFF} AS media_type FROM (SELECT page_id, hex(left(html, 16)) AS h FROM pages)")
def _(spark, d):
    return pages(spark, d).select("page_id", media.sniff_col(F.substring("html", 1, 16).cast("binary")).alias("media_type"))


_ITEMS = "list_transform(string_split(x, ';'), lambda v: trim(v))"


@register(
    "content_type_parse",
    f"""SELECT i, coalesce(nullif(p[1], ''), 'text/plain') AS media_type,
    CASE WHEN len(s) > 0 THEN substr(s[len(s)], 9) ELSE 'US-ASCII' END AS charset,
    len(list_filter(p[2:], lambda v: lower(v) = 'base64')) > 0 AS is_base64
    FROM (SELECT i, p, list_filter(p[2:], lambda v: starts_with(v, 'charset=')) AS s FROM (SELECT i, {_ITEMS} AS p FROM {_sql_rows(CONTENT_TYPES)}))""",
)
def _(spark, d):
    return literal(spark, CONTENT_TYPES).select("i", media.content_type_col(F.col("x")).alias("c")).select("i", "c.*")


@register("extract_links", f"SELECT page_id, seq, href FROM {_LINKS}")
def _(spark, d):
    return links(pages(spark, d)).select("page_id", "seq", "href")


@register("resolve_links_root_relative", f"SELECT page_id, seq, target FROM {_LINKS}")
def _(spark, d):
    return links(pages(spark, d)).select("page_id", "seq", "target")


@register("link_protocol_flags", f"SELECT page_id, seq, regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.\\-]*:') AS has_protocol FROM {_LINKS}")
def _(spark, d):
    return links(pages(spark, d)).select("page_id", "seq", F.trim("href").rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:").alias("has_protocol"))


@register("links_per_page", f"SELECT page_id, CAST(count(*) AS BIGINT) AS links, CAST(count(DISTINCT href) AS BIGINT) AS targets FROM {_LINKS} GROUP BY page_id")
def _(spark, d):
    return links(pages(spark, d)).groupBy("page_id").agg(F.count("*").alias("links"), F.countDistinct("href").alias("targets"))


@register("top_link_targets", f"SELECT href, CAST(count(*) AS BIGINT) AS n FROM {_LINKS} GROUP BY href ORDER BY n DESC, href LIMIT 20")
def _(spark, d):
    return links(pages(spark, d)).groupBy("href").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "href").limit(20)


@register("distinct_urls", f"SELECT target, min(page_id) AS first_page FROM {_LINKS} GROUP BY target")
def _(spark, d):
    return links(pages(spark, d)).groupBy("target").agg(F.min("page_id").alias("first_page"))


@register("first_link", f"SELECT page_id, arg_min(href, seq) AS href FROM {_LINKS} GROUP BY page_id")
def _(spark, d):
    return links(pages(spark, d)).groupBy("page_id").agg(F.min_by("href", "seq").alias("href"))


@register("last_link", f"SELECT page_id, arg_max(href, seq) AS href FROM {_LINKS} GROUP BY page_id")
def _(spark, d):
    return links(pages(spark, d)).groupBy("page_id").agg(F.max_by("href", "seq").alias("href"))


_HOST = "regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)"


def _hosts(spark, d):
    return pages(spark, d).select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#:]*)", 1).alias("host"))


@register("domain_allow", f"SELECT page_id, host FROM (SELECT page_id, {_HOST} AS host FROM pages) WHERE ends_with('.' || lower(host), '.example.com')")
def _(spark, d):
    return _hosts(spark, d).where(urls.within_domain_col(F.col("host"), F.lit(".example.com")))


@register("domain_deny", f"SELECT page_id, host FROM (SELECT page_id, {_HOST} AS host FROM pages) WHERE NOT ends_with('.' || lower(host), '.example.com')")
def _(spark, d):
    return _hosts(spark, d).where(~urls.within_domain_col(F.col("host"), F.lit(".example.com")))


_WITHIN = """CASE WHEN p = '' THEN false WHEN p = '.' THEN true
  WHEN starts_with(p, '.') THEN ends_with('.' || rtrim(lower(host), '.'), rtrim(lower(p), '.'))
  ELSE rtrim(lower(host), '.') = rtrim(lower(p), '.') END"""


@register("domain_match_matrix", f"SELECT page_id, p, {_WITHIN} AS matched FROM (SELECT page_id, {_HOST} AS host FROM pages) CROSS JOIN {_sql_rows(PATTERNS, 'p')} q")
def _(spark, d):
    # a fixed handful of patterns, put beside each row without a join
    rows = _hosts(spark, d).withColumn("p", F.explode(F.array(*map(F.lit, PATTERNS))))
    return rows.select("page_id", "p", urls.within_domain_col(F.col("host"), F.col("p")).alias("matched"))


_KEYS = "(SELECT DISTINCT regexp_replace(url, '#.*$', '') AS k FROM pages)"


@register("internal_link_join", f"SELECT l.page_id, l.seq, l.target, k.k IS NOT NULL AS found FROM {_LINKS} l LEFT JOIN {_KEYS} k ON l.target = k.k")
def _(spark, d):
    keys = pages(spark, d).select(urls.clean_col(F.col("url")).alias("k")).distinct()
    found = links(pages(spark, d)).join(keys, F.col("target") == F.col("k"), "left")
    return found.select("page_id", "seq", "target", F.col("k").isNotNull().alias("found"))


@register("missing_assets", f"SELECT page_id, seq, target FROM {_LINKS} WHERE target NOT IN (SELECT k FROM {_KEYS})")
def _(spark, d):
    keys = pages(spark, d).select(urls.clean_col(F.col("url")).alias("k")).distinct()
    return links(pages(spark, d)).join(keys, F.col("target") == F.col("k"), "left_anti").select("page_id", "seq", "target")


@register("asset_catalog_sha256", "SELECT page_id, base64(unhex(sha256(html))) AS digest, CAST(strlen(html) AS BIGINT) AS bytes FROM pages")
def _(spark, d):
    data = F.col("html").cast("binary")
    return pages(spark, d).select("page_id", urls.base64_col(F.unhex(F.sha2(data, 256))).alias("digest"), F.octet_length(data).cast("long").alias("bytes"))


@register("integrity_check", "SELECT page_id, page_id % 4 = 0 AS holds FROM pages")
def _(spark, d):
    """Right digests on every fourth page; on the others one of another kind, an unknown one, or two at once."""
    digest = F.concat(F.lit("sha256-"), urls.base64_col(F.unhex(F.sha2(F.col("html").cast("binary"), 256))))
    kind = F.col("page_id") % 4
    stated = F.when(kind == 0, digest).when(kind == 1, F.replace(digest, F.lit("sha256"), F.lit("sha512"))).when(kind == 2, F.replace(digest, F.lit("sha256"), F.lit("SHA256"))).otherwise(F.concat_ws(" ", digest, digest))
    run = F.pandas_udf(lambda h, i: h.combine(i, lambda x, y: markup.integrity_holds(x.encode(), y)), "boolean")
    return pages(spark, d).select("page_id", run("html", stated).alias("holds"))


@register("data_url_encode", "SELECT page_id, 'data:text/html;charset=utf-8;base64,' || base64(encode(html)) AS data_url FROM pages")
def _(spark, d):
    return pages(spark, d).select("page_id", urls.data_url_col(F.lit("text/html"), F.lit(" utf-8 "), F.col("html").cast("binary")).alias("data_url"))


@register("data_url_roundtrip", "SELECT page_id, 'text/html' AS media_type, 'utf-8' AS charset, sha256(html) AS digest FROM pages")
def _(spark, d):
    made = pages(spark, d).select("page_id", urls.data_url_col(F.lit("text/html"), F.lit("utf-8"), F.col("html").cast("binary")).alias("u"))

    @F.pandas_udf("media_type string, charset string, data binary")
    def parse(u):
        import pandas as pd

        return pd.DataFrame([urls.parse_data_url(x) for x in u], columns=["media_type", "charset", "data"])

    parse = parse.asNondeterministic()  # once for each row, not once for each field
    back = made.select("page_id", parse("u").alias("p"))
    return back.select("page_id", "p.media_type", "p.charset", F.sha2("p.data", 256).alias("digest"))


for _name, _tag in (("strip_js_raw", "script"), ("strip_css_raw", "style")):
    register(_name, f"SELECT page_id, sha256(regexp_replace(html, '(<{_tag}[^>]*>).*?(</{_tag}>)', '\\1\\2', 'gs')) AS digest FROM pages")(
        lambda spark, d, tag=_tag: pages(spark, d).select(
            "page_id", F.sha2(F.regexp_replace("html", f"(?s)(<{tag}[^>]*>).*?(</{tag}>)", "$1$2").cast("binary"), 256).alias("digest")
        )
    )


@register("event_handler_attrs", f"SELECT i, x, lower(x) IN ({_in(markup.EVENTS)}) AS handler FROM {_sql_rows(NAMES)}")
def _(spark, d):
    return literal(spark, NAMES).select("i", "x", F.lower("x").isin(*markup.EVENTS).alias("handler"))


@register("css_image_props", f"SELECT i, x, lower(x) IN ({_in(markup.IMAGE_PROPERTIES)}) AS image FROM {_sql_rows(NAMES)}")
def _(spark, d):
    return literal(spark, NAMES).select("i", "x", F.lower("x").isin(*markup.IMAGE_PROPERTIES).alias("image"))


@register(
    "rel_types",
    f"""SELECT i, array_to_string(list_filter(regexp_split_to_array(trim(lower(x)), '\\s+'), lambda v: v IN ({_in(markup.LINK_TYPES)})), ',') AS kinds,
    trim(lower(x)) IN ({_in(markup.FAVICONS)}) AS favicon FROM {_sql_rows(RELS)}""",
)
def _(spark, d):
    x = F.col("x")
    return literal(spark, RELS).select("i", F.array_join(markup.link_types_col(x), ",").alias("kinds"), F.trim(F.lower(x)).isin(*markup.FAVICONS).alias("favicon"))


_FLAGS = [f for f, _ in markup.POLICY]


@register(
    "csp_variants",
    "SELECT CAST(n AS INTEGER) AS n, concat_ws(' ', "
    + ", ".join(f"CASE WHEN (n >> {i}) & 1 = 1 THEN '{t.replace(chr(39), chr(39) * 2)}' END" for i, (_, t) in enumerate(markup.POLICY))
    + f") AS policy FROM (SELECT unnest(range({1 << len(_FLAGS)})) AS n)",
)
def _(spark, d):
    flags = {f: F.shiftright("n", i).bitwiseAND(1) == 1 for i, f in enumerate(_FLAGS)}
    return spark.range(1 << len(_FLAGS)).select(F.col("id").cast("int").alias("n")).select("n", markup.policy_col(flags).alias("policy"))


@register("metadata_comment", f"SELECT page_id, '<!-- Saved from ' || regexp_replace(url, '#.*$', '') || ' at {STAMP} using {markup.PRODUCT} -->' AS comment FROM pages")
def _(spark, d):
    return pages(spark, d).select("page_id", F.concat(F.lit("<!-- Saved from "), urls.referer_col(F.col("url")), F.lit(f" at {STAMP} using {markup.PRODUCT} -->")).alias("comment"))


def _titles_sql(parsed: bool = False) -> str:
    out = "replace(title, '&amp;', '&')" if parsed else "regexp_extract(html, '<title>([^<]*)</title>', 1)"
    for a, b in markup.TITLE_MAP:
        out = f"replace({out}, '{a}', '{b}')"
    if parsed:
        return f"ltrim({out}, '.') || '.htm'"
    return f"'out/' || ltrim({out}, '.') || '-{STAMP.replace(':', '_')}.html'"


@register("output_paths", f"SELECT page_id, {_titles_sql()} AS path FROM pages")
def _(spark, d):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return pages(spark, d).select("page_id", markup.output_path_col(F.lit("out/%title%-%timestamp%.%extension%"), title, "html", STAMP).alias("path"))


@register("noscript_unwrap", f"SELECT i, regexp_replace(x, '<(/?noscript[^>]*)>', '<!--\\1-->', 'g') AS html FROM {_sql_rows(NOSCRIPTS)}")
def _(spark, d):
    return literal(spark, NOSCRIPTS).select("i", markup.unwrap_noscript_col(F.col("x")).alias("html"))


@register("html_gate", f"SELECT i, lower(x) IN ({_in(media.HTML)}) AS processed FROM {_sql_rows(('text/html', 'TEXT/HTML', 'application/xhtml+xml', 'image/png', ''))}")
def _(spark, d):
    return literal(spark, ("text/html", "TEXT/HTML", "application/xhtml+xml", "image/png", "")).select("i", F.lower("x").isin(*media.HTML).alias("processed"))


_Q = lambda s: s.replace("'", "''").replace("\r\n", "' || chr(13) || chr(10) || '")


@register("mhtml_wrap", f"SELECT page_id, sha256('{_Q(markup.MHTML_HEAD)}' || html || '{_Q(markup.MHTML_TAIL)}') AS digest FROM pages")
def _(spark, d):
    return pages(spark, d).select("page_id", F.sha2(F.concat(F.lit(markup.MHTML_HEAD), "html", F.lit(markup.MHTML_TAIL)).cast("binary"), 256).alias("digest"))


_COOKIE_SQL = f"""(SELECT line_no, lower(p[1]) AS domain, p[2] = 'TRUE' AS include_subdomains, p[3] AS path, p[4] = 'TRUE' AS https_only,
  TRY_CAST(p[5] AS BIGINT) AS expires, p[6] AS name, p[7] AS value
  FROM (SELECT i AS line_no, string_split(x, chr(9)) AS p, x FROM {_sql_rows(COOKIES)})
  WHERE line_no > 0 AND NOT starts_with(x, '#') AND len(p) = 7 AND TRY_CAST(p[5] AS BIGINT) IS NOT NULL)"""


def _cookies(spark) -> DataFrame:
    return cookie_file.parse(literal(spark, COOKIES, "value").withColumnRenamed("i", "line_no"))


@register("cookie_parse", f"SELECT * FROM {_COOKIE_SQL}")
def _(spark, d):
    return _cookies(spark)


@register(
    "cookie_match",
    f"""SELECT page_id, name, value FROM (
    SELECT r.page_id, c.name, c.value, row_number() OVER (PARTITION BY r.page_id ORDER BY c.line_no DESC) AS n
    FROM (SELECT page_id, regexp_extract(url, '^([a-z]+):', 1) AS scheme, lower({_HOST}) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS rp FROM pages) r
    JOIN {_COOKIE_SQL} c ON (scheme = 'https' OR scheme = 'http' AND NOT c.https_only)
    AND (CASE WHEN starts_with(c.domain, '.') AND c.include_subdomains THEN ends_with(host, c.domain) OR host = substr(c.domain, 2, greatest(length(c.domain) - 2, 0)) ELSE host = c.domain END)
    AND (lower(rp) = lower(c.path) OR starts_with(rp, c.path)) AND NOT (c.expires <> 0 AND c.expires < {NOW})) WHERE n = 1""",
)
def _(spark, d):
    parts = pages(spark, d).select(
        F.col("page_id").alias("request_id"),
        *[F.regexp_extract("url", _PARTS[k], 1).alias(n) for k, n in (("scheme", "scheme"), ("host", "host"), ("path", "request_path"))],
    )
    return cookie_file.chosen(parts, _cookies(spark), NOW).withColumnRenamed("request_id", "page_id")


@register("script_close_escape", f"SELECT i, replace(x, '</script>', '<\\/script>') AS script FROM {_sql_rows(SCRIPTS)}")
def _(spark, d):
    return literal(spark, SCRIPTS).select("i", F.replace("x", F.lit("</script>"), F.lit("<\\/script>")).alias("script"))


@register("plaintext_types", f"SELECT i, starts_with(lower(x), 'text/') OR lower(x) IN ({_in(media.PLAINTEXT)}) AS plaintext FROM {_sql_rows(('text/css', 'IMAGE/svg+xml', 'image/png', 'application/json', ''))}")
def _(spark, d):
    return literal(spark, ("text/css", "IMAGE/svg+xml", "image/png", "application/json", "")).select("i", media.is_plaintext_col(F.col("x")).alias("plaintext"))


@register(
    "css_import_closure",
    f"""WITH RECURSIVE e(a, b) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in IMPORTS)}),
    r(a, b, depth) AS (SELECT a, b, 1 FROM e UNION SELECT r.a, e.b, depth + 1 FROM r JOIN e ON r.b = e.a WHERE depth < 8)
    SELECT a AS sheet, b AS imported, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY a, b""",
)
def _(spark, d):
    edges = spark.createDataFrame(list(IMPORTS), "a string, b string")
    level = every = edges.withColumn("depth", F.lit(1))
    for depth in range(2, 9):
        level = level.alias("l").join(edges.alias("e"), F.col("l.b") == F.col("e.a")).select("l.a", "e.b").distinct().withColumn("depth", F.lit(depth))
        every = every.unionByName(level)
    return every.groupBy(F.col("a").alias("sheet"), F.col("b").alias("imported")).agg(F.min("depth").cast("int").alias("depth"))


@register("asset_upsert", f"SELECT href, arg_max(page_id, {{'a': page_id, 'b': seq}}) AS last_page FROM {_LINKS} GROUP BY href")
def _(spark, d):
    """The last row of each address by the order of arrival, here page and place."""
    rows = links(pages(spark, d)).select(F.col("href").alias("url_key"), F.struct("page_id", "seq").alias("seq"), F.col("page_id").cast("string").alias("final_url"))
    rows = rows.withColumns({"media_type": F.lit(""), "charset": F.lit(""), "data": F.lit(b"")})
    return last_assets(rows).select(F.col("url_key").alias("href"), F.col("a.final_url").cast("long").alias("last_page"))


@register("link_order", f"SELECT page_id, string_agg(href, ', ' ORDER BY seq) AS hrefs FROM {_LINKS} GROUP BY page_id")
def _(spark, d):
    return pages(spark, d).select("page_id", F.array_join(F.regexp_extract_all("html", F.lit(HREF), 1), ", ").alias("hrefs")).where("hrefs <> ''")


def _expected(names: str, rows) -> str:
    """Literal cases with what they must give, as SQL."""
    shown = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(shown, r)) + ')' for r in rows)}) AS t({names})"


def _cases(name: str, rows, f, out: str = "found"):
    """A query that applies f to literal texts; rows are (text, what must come out)."""

    def run(spark, d):
        apply = F.pandas_udf(lambda s: s.map(f), "string")
        return literal(spark, [r[0] for r in rows]).select("i", apply("x").alias(out))

    register(name, _expected(f"i, {out}", [(i, r[1]) for i, r in enumerate(rows)]))(run)


_cases("srcset_items", cases.SRCSETS, lambda v: "|".join(f"{a} {b}" for a, b in markup.srcset(v)))
_cases("css_cases", cases.SHEETS, lambda v: css.rewrite(v, lambda address, imported: None if "gone" in address else address.upper()), "css")
_cases("css_no_images_no_fonts", cases.BARE_SHEETS, lambda v: css.rewrite(v, lambda address, imported: address, True, True), "css")
_cases("resolve_urls", cases.RESOLVE, lambda v: urls.resolve(*v.split(" ", 1)), "url")
_cases("target_urls", cases.TARGETS, cases.target_or_error, "url")
_cases("charset_decode", cases.CHARSETS, lambda v: media.decode(bytes.fromhex(v.split(" ")[1]), v.split(" ")[0]))
_cases("charset_encode", cases.ENCODED, lambda v: media.encode(v.split(" ", 1)[1], v.split(" ")[0]).hex())
_cases("charset_labels", cases.LABELS, lambda v: str(media.codec(v) is not None))
_cases("css_names", cases.IDENTS, lambda v: css.ident(css.unescape(v)) + " " + css.quote(v))
_cases("tree_cases", cases.TREES, lambda v: dom.serialize(dom.parse(v)), "html")
_cases("path_find", cases.PATHS, lambda v: "|".join(n.get("id") or "" for n in dom.find_nodes(dom.parse(v.split(" ", 1)[1]), v.split(" ", 1)[0].split("/"))))
_cases("head_writers", cases.WRITERS, cases.written, "html")


@register("walk_cases", _expected("name, html", [(name, made) for name, _, _, made in cases.WALKS]))
def _(spark, d):
    """One small page for each rule of the rewriter, bundled with a small catalog and the options of the case."""
    assets = spark.createDataFrame([(k, k, t, "", bytearray(x, "utf-8")) for k, t, x in cases.CATALOG], "url_key string, final_url string, media_type string, charset string, data binary")
    out = None
    for flags in sorted({c[1] for c in cases.WALKS}):
        mine = [(i, "http://t.example/d/", html) for i, (_, f, html, _) in enumerate(cases.WALKS) if f == flags]
        named = spark.createDataFrame([(i, name) for i, (name, f, _, _) in enumerate(cases.WALKS) if f == flags], "page_id long, name string")
        made = bundle(spark.createDataFrame(mine, "page_id long, url string, html string"), assets, Options(no_metadata=True, **dict.fromkeys(flags.split(), True)))
        some = made.join(named, "page_id").select("name", F.coalesce("error", F.decode("content", "UTF-8")).alias("html"))
        out = some if out is None else out.unionByName(some)
    return out


@register("links_resolved", f"SELECT page_id, seq, regexp_extract(url, '{ORIGIN}', 1) || {documents.percent('href')} AS target FROM {_LINKS}")
def _(spark, d):
    run = F.pandas_udf(lambda b, r: b.combine(r, urls.resolve), "string")
    return links(pages(spark, d)).select("page_id", "seq", run("url", "href").alias("target"))


_SHAPES = {"link": "href", "page": "url", "padded": "concat('  ', url, ' ')", "host": "concat('//', href)", "mail": "concat('mailto:', href)", "none": "''"}


@register(
    "has_protocol",
    "SELECT page_id, seq, shape, shape IN ('page', 'padded', 'mail') AS has_protocol FROM (SELECT page_id, seq, unnest(["
    + ", ".join(f"'{k}'" for k in _SHAPES) + f"]) AS shape FROM {_LINKS})",
)
def _(spark, d):
    run = F.pandas_udf(lambda s: s.map(urls.has_protocol), "boolean")
    shapes = F.explode(F.array(*[F.struct(F.lit(k).alias("shape"), F.expr(v).alias("x")) for k, v in _SHAPES.items()])).alias("s")
    return links(pages(spark, d)).select("page_id", "seq", shapes).select("page_id", "seq", "s.shape", run("s.x").alias("has_protocol"))


@register("referer_rule", f"SELECT page_id, seq, CASE WHEN seq % 3 = 0 THEN NULL WHEN seq % 3 = 1 AND url = target THEN NULL ELSE regexp_replace(url, '#.*$', '') END AS referer FROM {_LINKS}")
def _(spark, d):
    run = F.pandas_udf(lambda p, u: p.combine(u, urls.referer_for), "string")
    rows = links(pages(spark, d)).withColumn("parent", F.when(F.col("seq") % 3 == 0, "file:///a.html").otherwise(F.col("url")))
    return rows.select("page_id", "seq", run("parent", "target").alias("referer"))


def _rich_pages(spark, d) -> DataFrame:
    """Every second page with a base, a robots rule and an icon in its head."""
    more = '<head><base href="/b/"><meta name="Robots" content="all"><link rel=" Shortcut ICON " href="/f.ico">'
    return pages(spark, d).withColumn("html", F.when(F.col("page_id") % 2 == 0, F.col("html")).otherwise(F.replace("html", F.lit("<head>"), F.lit(more))))


@register(
    "dom_facts",
    f"""SELECT page_id, CASE WHEN page_id % 2 = 1 THEN '/b/' END AS base, regexp_extract(html, '<meta charset="([^"]*)"', 1) AS charset,
    CASE WHEN page_id % 2 = 1 THEN 'all' END AS robots, replace(title, '&amp;', '&') AS title, page_id % 2 = 1 AS has_favicon FROM {documents.PARTS}""",
)
def _(spark, d):
    def facts(texts):
        import pandas as pd

        trees = [dom.parse(t) for t in texts]
        return pd.DataFrame([(dom.base_url(t), dom.charset(t), dom.robots(t), dom.title(t), dom.has_favicon(t)) for t in trees], columns=["base", "charset", "robots", "title", "has_favicon"])

    run = F.pandas_udf(facts, "base string, charset string, robots string, title string, has_favicon boolean").asNondeterministic()
    return _rich_pages(spark, d).select("page_id", run("html").alias("f")).select("page_id", "f.*")


@register("dom_links", f"SELECT page_id, CAST(seq AS BIGINT) AS seq, {documents.text('href')} AS href FROM {_LINKS}".replace("'&amp;', 'g'", "'&', 'g'"))
def _(spark, d):
    """Links of the tree, in document order, by node accessors' columns."""
    a = dom_nodes(pages(spark, d)).where("name = 'a'").select("page_id", "node_id", F.filter("attrs", lambda x: x["name"] == "href")[0]["value"].alias("href"))
    place = Window.partitionBy("page_id").orderBy("node_id")
    return a.select("page_id", (F.row_number().over(place) - 1).cast("long").alias("seq"), "href")


@register("dom_nodes")
def _(spark, d):
    return dom_nodes(pages(spark, d))


@register("dom_element_counts", documents.COUNTS)
def _(spark, d):
    return dom_nodes(pages(spark, d)).where("kind = 'element'").groupBy("page_id", "name").agg(F.count("*").alias("n"))


@register("dom_link_parents", f"SELECT 'li' AS parent, CAST(count(*) AS BIGINT) AS links FROM {_LINKS}")
def _(spark, d):
    nodes = dom_nodes(pages(spark, d))
    a = nodes.where("name = 'a'").select("page_id", "parent_id")
    return a.join(nodes.select("page_id", F.col("node_id").alias("parent_id"), F.col("name").alias("parent")), ["page_id", "parent_id"]).groupBy("parent").agg(F.count("*").alias("links"))


ICON = "00000100"


def _icons(spark, d) -> DataFrame:
    """An asset table derived from the pages: every site's favicon and a picture for every linked address."""
    made = links(pages(spark, d)).select(urls.clean_col(F.col("target")).alias("url_key")).distinct()
    icons = pages(spark, d).select(F.concat(F.regexp_extract("url", ORIGIN, 1), F.lit("/favicon.ico")).alias("url_key")).distinct()
    return made.unionByName(icons).select(
        "url_key", F.col("url_key").alias("final_url"), F.lit("image/x-icon").alias("media_type"), F.lit("").alias("charset"), F.unhex(F.lit(ICON)).alias("data")
    )


def _bundled(name: str, options: Options, with_assets: bool = False, **twin):
    def run(spark, d):
        made = bundle(pages(spark, d), _icons(spark, d) if with_assets else None, options)
        content = F.decode("content", "ISO-8859-1") if options.encoding else F.decode("content", "UTF-8")
        return made.select("page_id", "url", "title", F.length("content").cast("long").alias("bytes"), F.sha2(content.cast("binary"), 256).alias("digest"), "error")

    register(name, documents.bundled(None if options.no_metadata else STAMP, **twin))(run)


_POLICY = dict(markup.POLICY)
_LINK_ICON = '<link rel="icon" href="data:image/x-icon;base64,AAABAA=="></link>'
_bundled("bundle_html", Options(timestamp=STAMP), True, links=_LINK_ICON)
_bundled("bundle_no_js", Options(no_js=True, timestamp=STAMP), policy=_POLICY["no_js"], js=False)
_bundled("bundle_no_css", Options(no_css=True, no_fonts=True, timestamp=STAMP), policy=f"{_POLICY['no_css']} {_POLICY['no_fonts']}", css=False)
_bundled("bundle_no_media", Options(no_images=True, no_audio=True, no_video=True, no_frames=True, timestamp=STAMP), policy=f"{_POLICY['no_frames']} {_POLICY['no_images']}")
_bundled("bundle_isolated", Options(isolate=True, unwrap_noscript=True, no_metadata=True), policy=_POLICY["isolate"])
_bundled("bundle_mhtml", Options(output_format="mhtml", timestamp=STAMP), mhtml=True, policy=_POLICY["no_js"], js=False)
_bundled("encode_output", Options(encoding="iso-8859-1", no_metadata=True), charset="iso-8859-1", chars=True)

SITE = '<link rel="stylesheet" href="/site.css"><script src="/site.js"></script></head>'
FRAME = '<iframe src="/frame.html#f"></iframe><img src="/pic.png"></article>'
#: What every site has: path, media type, content. The sheet imports another, that one shows the picture, as the frame does.
SITE_FILES = (
    ("/site.css", "text/css", "@import 'more.css';p{color:red}"), ("/more.css", "text/plain", "b{background:url(pic.png)}"),
    ("/site.js", "text/javascript", "f('</script>')"), ("/frame.html", "text/html", '<p><img src="pic.png">'), ("/pic.png", "image/png", "PNG"),
)


def _site_pages(spark, d) -> DataFrame:
    """Every page with a sheet, a script, a frame and a picture of its site."""
    html = F.replace(F.replace("html", F.lit("</head>"), F.lit(SITE)), F.lit("</article>"), F.lit(FRAME))
    return pages(spark, d).withColumn("html", html)


def _site_assets(spark, d) -> DataFrame:
    files = F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("path", "media_type", "text"), x, strict=True)]) for x in SITE_FILES])).alias("f")
    sites = pages(spark, d).select(F.regexp_extract("url", ORIGIN, 1).alias("origin")).distinct().select("origin", files)
    key = F.concat("origin", "f.path")
    return sites.select(key.alias("url_key"), key.alias("final_url"), "f.media_type", F.lit("").alias("charset"), F.col("f.text").cast("binary").alias("data"))


def _data_url(media_type: str, text: str) -> str:
    return f"'data:{media_type};base64,' || base64(encode({text}))"


_PIC = _data_url("image/png", "'PNG'")
_MORE = _data_url("text/css", f"""'b{{background:url("' || {_PIC} || '")}}'""")
_SHEET = _data_url("text/css", f"""'@import "' || {_MORE} || '";p{{color:red}}'""")
_FRAME = _data_url("text/html", f"""'<html><head></head><body><p><img src="' || {_PIC} || '"></p></body></html>'""")
@register("bundle_site", f"SELECT page_id, CAST(7 AS BIGINT) AS answered, {_SHEET} AS sheet, 'f(''<\\/script>'')' AS script, {_FRAME} || '#f' AS frame, {_PIC} AS picture FROM pages")
def _(spark, d):
    """Sheets with imports, scripts, frames and pictures, nested, embedded in every page: what the tree of the made document holds."""
    made = bundle(_site_pages(spark, d), _site_assets(spark, d), Options(timestamp=STAMP))
    answered = F.size(F.filter("log", lambda x: x["status"] == "ok")).cast("long").alias("answered")
    content = F.decode("content", "UTF-8")
    attr = lambda pattern, n: F.regexp_extract(content, pattern, 1).alias(n)
    return made.select(
        "page_id", answered, attr('<link rel="stylesheet" href="([^"]*)">', "sheet"), attr("<script>(f[^<]*<\\\\/script>'[)])</script>", "script"),
        attr('<iframe src="([^"]*)"></iframe>', "frame"), attr('</iframe><img src="([^"]*)">', "picture"),
    )


_ICONS = f"SELECT page_id, CAST(0 AS INTEGER) AS seq, regexp_extract(url, '{ORIGIN}', 1) || '/favicon.ico' AS url_key FROM pages"


@register("page_references", _ICONS)
def _(spark, d):
    return page_references(pages(spark, d))


@register(
    "needed_assets",
    "SELECT page_id, regexp_extract(url, '" + ORIGIN + "', 1) || path AS url_key FROM pages CROSS JOIN (VALUES "
    + ", ".join(f"('{x[0]}')" for x in SITE_FILES) + ") AS f(path)",
)
def _(spark, d):
    return needed_assets(_site_pages(spark, d), _site_assets(spark, d))


@register(
    "fetch_log",
    f"""SELECT page_id, CAST(i - 1 AS INTEGER) AS seq, regexp_extract(url, '{ORIGIN}', 1) || p[i] AS url, CASE WHEN p[i] = '/favicon.ico' THEN 'not found' ELSE 'ok' END AS status
    FROM (SELECT page_id, url, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT page_id, url,
      ['/site.css', '/more.css', '/pic.png', '/site.js', '/frame.html#f', '/pic.png', '/pic.png', '/favicon.ico'] AS p FROM pages))""",
)
def _(spark, d):
    made = bundle(_site_pages(spark, d), _site_assets(spark, d), Options(timestamp=STAMP))
    return made.select("page_id", F.posexplode("log").alias("seq", "x")).select("page_id", "seq", "x.url", "x.status")


@register("html_gate_bundle", "SELECT page_id, CASE WHEN page_id % 3 > 0 THEN sha256(html) END AS digest, page_id % 3 = 0 AS processed FROM pages")
def _(spark, d):
    """Pages of another media type than HTML pass as they are."""
    kind = F.when(F.col("page_id") % 3 == 0, "TEXT/html").when(F.col("page_id") % 3 == 1, "text/plain").otherwise("image/svg+xml")
    made = bundle(pages(spark, d).withColumn("media_type", kind), None, Options(timestamp=STAMP))
    return made.select("page_id", F.when(F.col("title").isNull(), F.sha2("content", 256)).alias("digest"), F.col("title").isNotNull().alias("processed"))


@register("output_files", f"SELECT page_id, {_titles_sql(True)} AS path FROM {documents.PARTS}")
def _(spark, d):
    made = bundle(pages(spark, d), None, Options(timestamp=STAMP))
    return sinks.with_paths(made, "%title%.%ext%", "html", STAMP).select("page_id", "path")


_MORE_CSS = "@import 'x.css';a{background:url(i.png);color:#FFF}"


@register("css_rewrite", """SELECT page_id, style || chr(10) || '@import "x.css";a{background:url("i.png");color:#FFF}' AS css FROM """ + documents.PARTS)
def _(spark, d):
    def run(blocks) -> str | None:
        return None if blocks is None else "\n".join(css.rewrite(text, lambda address, imported: address) for text in blocks)

    html = F.replace("html", F.lit("</head>"), F.lit(f"<style>{_MORE_CSS}</style></head>"))
    sheets = F.regexp_extract_all(html, F.lit("(?s)<style[^>]*>(.*?)</style>"), 1)
    return pages(spark, d).select("page_id", F.pandas_udf(lambda s: s.map(run), T.StringType())(sheets).alias("css"))


@register("asset_store", "SELECT regexp_replace(url, '#.*$', '') AS url_key, arg_max(sha256(html), (page_id % 2) * 1000000000000 + page_id) AS digest, CAST(max(page_id % 2) AS BIGINT) AS last_put FROM pages GROUP BY 1")
def _(spark, d):
    """Pages put into a store as assets, those of odd ids after the others, and read back."""
    import uuid

    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    held = store.AssetStore(spark, f"{base.rstrip('/')}/asset-store-{uuid.uuid4().hex}")
    one = pages(spark, d).withColumn("url_key", urls.clean_col(F.col("url"))).groupBy("url_key", (F.col("page_id") % 2).alias("odd")).agg(F.max_by("html", "page_id").alias("html"))
    rows = one.select("url_key", F.col("url_key").alias("final_url"), F.lit("text/html").alias("media_type"), F.lit("").alias("charset"), F.col("html").cast("binary").alias("data"), "odd")
    for odd in (0, 1):
        held.put(rows.where(F.col("odd") == odd))
    last = held.rows().groupBy("url_key").agg(F.max("seq").cast("long").alias("last_put"))
    return held.get().join(last, "url_key").select("url_key", F.sha2("data", 256).alias("digest"), "last_put")


@register("hosts_ranked", f"SELECT host, CAST(count(*) AS BIGINT) AS n, CAST(rank() OVER (ORDER BY count(*) DESC) AS INTEGER) AS place FROM (SELECT {_HOST} AS host FROM pages) GROUP BY host")
def _(spark, d):
    counts = _hosts(spark, d).groupBy("host").agg(F.count("*").alias("n"))
    # ranks come from the counts' own table, one row for each count, so no row of the hosts is sorted in one task
    levels = counts.groupBy("n").agg(F.count("*").alias("hosts"))
    above = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    ranked = levels.select("n", (F.coalesce(F.sum("hosts").over(above), F.lit(0)) + 1).cast("int").alias("place"))
    return counts.join(ranked, "n").select("host", "n", "place")
