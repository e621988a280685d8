"""Bundling: every reference of a page replaced by the asset it names.

`rewrite_page` works on one page and a catalog of its assets; `references` lists what a page, a frame or a sheet refers to;
`bundle` puts them together for tables: references are resolved set by set, level by level, against the asset table, and
each page then is rewritten once with the assets that it needs.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache
from itertools import accumulate, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressleaf.functions import css, markup, media, urls
from pressleaf.options import Options
from pressleaf.sources import html as dom

#: Pages that one copy of an asset's bytes serves.
USERS = 10_000
#: Bytes of a table's rows that a task holds as Python objects at once; a row is never cut.
SLICE = 2 << 20
#: Script types that are inlined as text.
PLAIN_SCRIPTS = (None, "text/javascript", "application/javascript")


@dataclass(frozen=True)
class Asset:
    data: bytes
    final_url: str
    media_type: str = ""
    charset: str = ""


#: (key, parent) -> the asset, or None if there is none.
Lookup = Callable[[str], Asset | None]


class Session:
    """One page's rewrite: options, lookup and the log of what was asked for."""

    def __init__(self, lookup: Lookup, options: Options):
        self.lookup, self.options = lookup, options
        self.log: list[tuple[str, str]] = []
        #: What was asked for as a "sheet", "import", "frame" or "" (anything else), each once, in order.
        self.uses: dict[tuple[str, str], None] = {}

    def allowed(self, url: str) -> bool:
        if not self.options.domains:
            return True
        found = urls.parse(url)
        hit = any(urls.within_domain(found.host or "", p.strip()) for p in self.options.domains)
        return hit != self.options.blacklist_domains

    def retrieve(self, parent: str, url: str, use: str = "") -> Asset | None:
        if url.startswith("data:"):
            media_type, charset, data = urls.parse_data_url(url)
            return Asset(data, url, media_type, charset)
        if url.startswith("file:") and not parent.startswith("file:"):
            self.log.append((url, "security error"))
            return None
        key = urls.clean(url)
        self.uses.setdefault((key, use))
        found = self.lookup(key)
        if found is None or url.startswith("http") and not self.allowed(url):
            self.log.append((url, "not found" if found is None else "domain not allowed"))
            return None
        self.log.append((url, "ok"))
        if found.media_type and found.final_url:
            return found
        kind = found.media_type or media.detect(found.data, found.final_url or key)
        return replace(found, media_type=kind, final_url=found.final_url or key)


def _fragment(url: str) -> str:
    _, mark, rest = url.partition("#")
    return mark + rest


def _fallback(url: str) -> str | None:
    return url if url.startswith(("http:", "https:")) else None


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most SLICE bytes or one row, so that memory doesn't grow with a batch's rows."""
    for batch in batches:
        todo = [batch]
        while todo:
            piece = todo.pop()
            if piece.num_rows > 1 and piece.nbytes > SLICE:
                half = piece.num_rows // 2
                todo += [piece.slice(half), piece.slice(0, half)]
            else:
                yield piece


def embed_css(session: Session, document_url: str, text: str, depth: int = 0, above: tuple[str, ...] = ()) -> str:
    def fetch(address: str, imported: bool) -> str | None:
        full = urls.resolve(document_url, address)
        got = session.retrieve(document_url, full, "import" if imported else "")
        if got is None:
            return _fallback(full)
        data, charset = got.data, got.charset
        if imported:
            key = urls.clean(full)
            if depth >= session.options.max_depth or key in above:
                return _fallback(full)
            data = embed_css(session, got.final_url, data.decode("utf-8", "replace"), depth + 1, (*above, key)).encode()
        return urls.data_url("text/css" if imported else got.media_type, charset, data, got.final_url) + _fragment(full)

    return css.rewrite(text, fetch, session.options.no_images, session.options.no_fonts)


def embed_srcset(session: Session, document_url: str, value: str) -> str:
    out = []
    for path, descriptor in markup.srcset(value):
        if session.options.no_images:
            shown = markup.EMPTY_IMAGE
        else:
            full = urls.resolve(document_url, path)
            got = session.retrieve(document_url, full)
            shown = urls.data_url(got.media_type, got.charset, got.data, got.final_url) + _fragment(full) if got else _fallback(full) or markup.EMPTY_IMAGE
        out.append(f"{shown} {descriptor}".rstrip())
    return ", ".join(out)


class _Walk:
    def __init__(self, session: Session, url: str, depth: int, above: tuple[str, ...]):
        self.s, self.o, self.url, self.depth, self.above = session, session.options, url, depth, above

    def embed(self, node: dom.Node, attr: str, value: str) -> None:
        full, name = urls.resolve(self.url, value), node.name
        sheet = name == "link" and "stylesheet" in markup.link_types(node.get("rel") or "")
        got = self.s.retrieve(self.url, full, "sheet" if sheet else "frame" if name in ("frame", "iframe") else "")
        if got is None:
            node.set(attr, _fallback(full))
            return
        if name in ("link", "script"):
            stated = node.get("integrity")
            node.set("integrity", None)
            if stated and not markup.integrity_holds(got.data, stated):
                return
        if sheet:
            text = embed_css(self.s, got.final_url, media.decode(got.data, got.charset), 0, (urls.clean(full),))
            node.set(attr, urls.data_url(got.media_type, got.charset, text.encode(), got.final_url))
        elif name in ("frame", "iframe"):
            if self.depth >= self.o.max_depth or urls.clean(full) in self.above:
                node.set(attr, _fallback(full))
                return
            inner = dom.parse(media.decode(got.data, got.charset))
            _Walk(self.s, got.final_url, self.depth + 1, (*self.above, urls.clean(full))).tree(inner)
            made = finish(inner, self.o).encode()
            node.set(attr, urls.data_url(got.media_type, got.charset, made, got.final_url) + _fragment(full))
        elif name == "script" and node.get("type") in PLAIN_SCRIPTS:
            node.append(dom.Node("text", text=markup.escape_script(got.data.decode("utf-8", "replace"))))
            node.set(attr, None)
        elif name == "script":
            node.set(attr, urls.data_url(node.get("type"), got.charset, got.data, got.final_url))
        else:
            node.set(attr, urls.data_url(got.media_type, got.charset, got.data, got.final_url) + _fragment(full))

    def tree(self, node: dom.Node) -> None:
        todo = [node]
        while todo:
            x = todo.pop()
            if x.kind == "element":
                rule = _rule(x.name)
                if rule:
                    rule(self, x)
                style = x.get("style") if x.attrs else None
                if style is not None:
                    x.set("style", None if self.o.no_css else embed_css(self.s, self.url, style))
                if self.o.no_js and x.attrs:
                    x.attrs = [a for a in x.attrs if not markup.is_event_handler(a[0])]
            if x.name != "template":
                todo += reversed(x.children)

    def absolute(self, x: dom.Node, attr: str) -> None:
        if (value := x.get(attr)) is not None:
            x.set(attr, urls.resolve(self.url, value))

    def media_of(self, x: dom.Node, attr: str, drop: bool, blank: bool = False) -> None:
        value = x.get(attr)
        if value is None:
            return
        if drop:
            x.set(attr, markup.EMPTY_IMAGE if blank else None)
        else:
            self.embed(x, attr, value)

    def on_meta(self, x):
        if (x.get("http-equiv") or "").lower() in ("refresh", "location"):
            x.set("http-equiv", None)

    def on_link(self, x):
        kinds, href = markup.link_types(x.get("rel") or ""), x.get("href")
        if "icon" in kinds or "apple-touch-icon" in kinds:
            if href is not None:
                x.set("href", None)
                if not self.o.no_images and href:
                    x.set("href", href)
                    self.embed(x, "href", href)
        elif "stylesheet" in kinds:
            if self.o.no_css:
                x.set("href", None)
                x.set("integrity", None)
            elif href:
                self.embed(x, "href", href)
        elif "preload" in kinds or "dns-prefetch" in kinds:
            x.set("rel", None)
        elif href is not None:
            x.set("href", urls.resolve(self.url, href))

    def on_base(self, x):
        if self.url.startswith("http"):
            self.absolute(x, "href")

    def on_body(self, x):
        value = x.get("background")
        if value is not None:
            if self.o.no_images or not value:
                x.set("background", None)
            else:
                self.embed(x, "background", value)

    def on_img(self, x):
        src, lazy, many = x.get("src"), x.get("data-src"), x.get("srcset")
        if self.o.no_images:
            for name, value in (("src", src), ("data-src", lazy)):
                if value is not None:
                    x.set(name, markup.EMPTY_IMAGE)
        elif not src and not lazy:
            x.set("src", "")
        else:
            self.embed(x, "src", lazy or src)
        if many:
            x.set("srcset", embed_srcset(self.s, self.url, many))

    def on_input(self, x):
        if (x.get("type") or "").lower() == "image" and (src := x.get("src")) is not None:
            if not src:
                x.set("src", "")
            else:
                self.media_of(x, "src", self.o.no_images, True)

    def on_svg(self, x):
        if self.o.no_images:
            x.children = []

    def on_image(self, x):
        for name in ("href", "xlink:href"):
            if any(a[0] == name for a in x.attrs):
                self.media_of(x, name, self.o.no_images)

    def on_use(self, x):
        name = next((a[0] for a in x.attrs if a[0] in ("href", "xlink:href")), None)
        if name is None:
            return
        value = x.get(name)
        if self.o.no_images:
            x.set(name, None)
            return
        if value.startswith("#"):
            return
        full = urls.resolve(self.url, value)
        got = self.s.retrieve(self.url, full)
        if got is None:
            x.set(name, full)
            return
        if got.media_type != "image/svg+xml":
            x.set(name, urls.data_url(got.media_type, got.charset, got.data, got.final_url))
            return
        tree = dom.parse(media.decode(got.data, got.charset))
        mark = _fragment(full)[1:]
        if mark:
            symbol = dom.Node("element", "symbol", [["id", mark]], foreign=True)
            match = next((s for s in dom.find_nodes(tree, ["html", "body", "svg", "defs", "symbol"]) if s.get("id") == mark), None)
            if match:
                for c in match.children:
                    symbol.append(c)
                x.set(name, "#" + mark)
            x.append(symbol)
        elif root := dom.element(tree, "html", "body", "svg"):
            for c in root.children:
                x.append(c)
            x.set(name, None)

    def on_source(self, x):
        parent = x.parent.name if x.parent else ""
        if parent in ("audio", "video"):
            self.media_of(x, "src", self.o.no_audio if parent == "audio" else self.o.no_video)
        elif parent == "picture" and (many := x.get("srcset")):
            x.set("srcset", markup.EMPTY_IMAGE if self.o.no_images else embed_srcset(self.s, self.url, many))

    def on_a(self, x):
        href = x.get("href")
        if href is None:
            return
        if href.strip().startswith("javascript:"):
            if self.o.no_js:
                x.set("href", "javascript:;")
        elif not href.startswith("#") and not urls.has_protocol(href):
            x.set("href", urls.resolve(self.url, href))

    on_area = on_a

    def on_script(self, x):
        src = x.get("src")
        if self.o.no_js:
            x.children = []
            if src:
                x.set("src", None)
                x.set("integrity", None)
        elif src:
            self.embed(x, "src", src)

    def on_style(self, x):
        if self.o.no_css:
            x.children = []
        for c in x.children:
            c.text = embed_css(self.s, self.url, c.text)

    def on_form(self, x):
        self.absolute(x, "action")

    def on_iframe(self, x):
        if (src := x.get("src")) is not None:
            if self.o.no_frames:
                x.set("src", "")
            elif src.strip():
                self.embed(x, "src", src)

    on_frame = on_iframe

    def on_audio(self, x):
        self.media_of(x, "src", self.o.no_audio)

    def on_video(self, x):
        self.media_of(x, "src", self.o.no_video)
        if x.get("poster"):
            self.media_of(x, "poster", self.o.no_images, True)

    def on_noscript(self, x):
        for c in x.children:
            if c.kind == "text":
                inner = dom.parse(c.text)
                _Walk(self.s, self.url, self.depth, self.above).tree(inner)
                body = dom.element(inner, "html", "body")
                c.text = "".join(map(dom.serialize, body.children)) if body else ""


@lru_cache(1024)
def _rule(name: str) -> Callable[[_Walk, dom.Node], None] | None:
    return getattr(_Walk, "on_" + name.lower().replace("-", "_"), None)


def finish(document: dom.Node, options: Options) -> str:
    dom.add_policy(document, markup.policy(options))
    text = dom.serialize(document)
    return markup.unwrap_noscript(text) if options.unwrap_noscript else text


def rewrite_page(html: str | bytes, url: str | None, lookup: Lookup, options: Options | None = None, charset: str = "utf-8"):
    """(content, title, log): the self-contained page as bytes."""
    options = options or Options()
    if options.encoding and media.codec(options.encoding) is None:
        raise ValueError(f'unknown encoding "{options.encoding}"')
    return _rewritten(html, url, Session(lookup, options), charset)


def _walked(html: str | bytes, url: str | None, session: Session, charset: str = "utf-8") -> tuple[dom.Node, str]:
    """The page's tree with everything embedded that it asks the catalog for, and the charset it was read with."""
    options = session.options
    text = media.decode(html, charset) if isinstance(html, bytes) else html
    document = dom.parse(text)
    stated = dom.charset(document)
    if isinstance(html, bytes) and stated and media.codec(stated) and media.codec(stated) != media.codec(charset):
        charset = stated
        document = dom.parse(media.decode(html, charset))
    target = url or "data:text/html,"
    base, own = target, dom.base_url(document)
    if options.base_url:
        given = urls.parse(options.base_url)
        if given and (given.scheme != "file" or target.startswith("file:")):
            base = str(given)
    elif own:
        base = urls.resolve(target, own)
    _Walk(session, base, 0, (urls.clean(target),)).tree(document)
    if options.base_url is not None:
        dom.set_base_url(document, options.base_url)
    if not options.no_images and base.startswith("http") and target.startswith("http") and not dom.has_favicon(document):
        place = urls.resolve(base, "/favicon.ico")
        if got := session.retrieve(target, place):
            dom.add_favicon(document, urls.data_url(got.media_type, got.charset, got.data, got.final_url))
    return document, charset


def _rewritten(html: str | bytes, url: str | None, session: Session, charset: str = "utf-8"):
    options = session.options
    document, charset = _walked(html, url, session, charset)
    dom.set_robots(document, "none")
    if options.encoding:
        dom.set_charset(document, options.encoding)
        charset = options.encoding
    title = dom.title(document)
    made = finish(document, options)
    if not options.no_metadata and url:
        made = markup.metadata_comment(url, options.timestamp) + "\n" + made
    if options.output_format == "mhtml":
        return media.encode(markup.mhtml(made), charset if isinstance(html, bytes) or options.encoding else "utf-8"), title, session.log
    if not made.endswith("\n"):
        made += "\n"
    return media.encode(made, charset if isinstance(html, bytes) or options.encoding else "utf-8"), title, session.log


def _nothing(key: str) -> None:
    return None


def page_uses(html: str | bytes, url: str | None, options: Options | None = None, charset: str | None = None) -> list[tuple[str, str]]:
    """Cleaned addresses that the page asks the catalog for and what as, each pair once, in order."""
    session = Session(_nothing, options or Options())
    with contextlib.suppress(Exception):  # what a broken page asks for up to there; its error is told where it is rewritten
        _walked(html, url, session, charset or "utf-8")
    return list(session.uses)


def references(html: str, url: str | None, options: Options | None = None) -> list[str]:
    """Cleaned addresses that the page asks the catalog for, each once, in order."""
    return list(dict.fromkeys(key for key, _ in page_uses(html, url, options)))


def asset_uses(asset: Asset, use: str, options: Options | None = None) -> list[tuple[str, str]]:
    """What an asset refers to in turn, read as the rewriter reads it: by its use, whatever its media type."""
    session = Session(_nothing, options or Options())
    with contextlib.suppress(Exception):
        if use == "frame":
            _Walk(session, asset.final_url, 0, ()).tree(dom.parse(media.decode(asset.data, asset.charset)))
        elif use:
            embed_css(session, asset.final_url, asset.data.decode("utf-8", "replace") if use == "import" else media.decode(asset.data, asset.charset))
    return list(session.uses)


def _sources(pages: DataFrame) -> DataFrame:
    """page_id, url, html (text or bytes), media_type and charset; the last two may be missing: HTML, UTF-8."""
    optional = [(F.col(c) if c in pages.columns else F.lit(None).cast("string")).alias(c) for c in ("media_type", "charset")]
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", *optional)


def is_html(media_type: str | None) -> bool:
    """Other types are passed through as they are."""
    return not media_type or media_type.lower() in media.HTML


def _uses_of(batch: pa.RecordBatch, options: Options):
    for page, url, html, kind, charset in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        if is_html(kind):
            yield page, page_uses(html or "", url, options, charset)


def page_references(pages: DataFrame, options: Options | None = None) -> DataFrame:
    """page_id, seq, url_key of what every page refers to; null html and other media types refer to nothing."""
    options = options or Options()

    def run(batches):
        for batch in slices(batches):
            rows = [(page, i, key) for page, uses in _uses_of(batch, options) for i, key in enumerate(dict.fromkeys(k for k, _ in uses))]
            kinds = {"page_id": pa.int64(), "seq": pa.int32(), "url_key": pa.string()}
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], names=list(kinds))

    return _sources(pages).mapInArrow(run, "page_id bigint, seq int, url_key string")


def _kept(df: DataFrame) -> DataFrame:
    """A checkpoint where the session has a folder for them, else a cached table."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def needed_assets(pages: DataFrame, assets: DataFrame, options: Options | None = None) -> DataFrame:
    """(page_id, url_key) of all assets a page needs, through imports and frames, level by level.

    Of the assets' bytes only those of sheets and frames are read before the last join, each once for each use.
    """
    options = options or Options()

    def of_pages(batches):
        for batch in slices(batches):
            rows = [(page, *x) for page, uses in _uses_of(batch, options) for x in uses]
            kinds = (pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["page_id", "url_key", "use"])

    def of_assets(batches):
        for batch in slices(batches):
            rows = []
            for key, final, charset, data, use in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                rows += [(key, use, *x) for x in asset_uses(Asset(data or b"", final or key, "", charset or ""), use, options)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(4)], names=["from_key", "from_use", "to_key", "to_use"])

    known = assets.select("url_key").distinct()
    bytes_of = assets.select("url_key", "final_url", "charset", "data")
    level = _sources(pages).mapInArrow(of_pages, "page_id bigint, url_key string, use string")
    every = level = _kept(level.distinct().join(known, "url_key", "left_semi").select("page_id", "url_key", "use"))
    for _ in range(options.max_depth):
        inner = level.where("use <> ''")
        if not inner.head(1):
            break
        edges = bytes_of.join(inner.select("url_key", "use").distinct(), "url_key").select("url_key", "final_url", "charset", "data", "use")
        edges = edges.mapInArrow(of_assets, "from_key string, from_use string, to_key string, to_use string").distinct()
        level = _kept(
            inner.join(edges, (inner["url_key"] == edges["from_key"]) & (inner["use"] == edges["from_use"]))
            .select("page_id", F.col("to_key").alias("url_key"), F.col("to_use").alias("use"))
            .distinct()
            .join(known, "url_key", "left_semi")
            .join(every, ["page_id", "url_key", "use"], "left_anti")
            .select("page_id", "url_key", "use")
        )
        every = every.unionByName(level)
    return every.select("page_id", "url_key").distinct()


def _catalogs(column: pa.ListArray) -> Iterator[dict[str, Asset]]:
    """Each row's assets by key, read field by field."""
    rows = zip(*(x.to_pylist() for x in column.flatten().flatten()), strict=True)
    for n in column.value_lengths().to_pylist():
        yield {key: Asset(data or b"", final or key, kind or "", charset or "") for key, final, kind, charset, data in islice(rows, n or 0)}


def _log_column(logs: list) -> pa.ListArray:
    starts = pa.array([0, *accumulate(map(len, logs))], pa.int32())
    parts = [pa.array([x[i] for log in logs for x in log], pa.string()) for i in (0, 1)]
    return pa.ListArray.from_arrays(starts, pa.StructArray.from_arrays(parts, names=["url", "status"]))


def last_assets(assets: DataFrame) -> DataFrame:
    """One row for each url_key: the last one by `seq` (order of arrival), where there is such a column; ties go to the greatest row."""
    order = [F.col("seq")] if "seq" in assets.columns else []
    return assets.groupBy("url_key").agg(F.max(F.struct(*order, "final_url", "media_type", "charset", "data")).alias("a"))


def bundle(pages: DataFrame, assets: DataFrame | None = None, options: Options | None = None) -> DataFrame:
    """page_id, url, title, content, error and log (what was asked for, and how that went) of every page.

    An error of a page stays in its row. Pages of another media type than HTML are passed through, without a title.
    MHTML output drops scripts.
    """
    options = options or Options()
    if options.output_format == "mhtml":
        options = replace(options, no_js=True)
    source = _sources(pages)
    if assets is None:
        source = source.withColumn("assets", F.lit(None).cast("array<struct<url_key:string,final_url:string,media_type:string,charset:string,data:binary>>"))
    else:
        needed = needed_assets(pages, assets, options)
        # an asset that many pages need goes to several tasks
        counts = needed.groupBy("url_key").agg(F.ceil(F.count("*") / USERS).cast("int").alias("salts"))
        one = last_assets(assets).join(counts, "url_key").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        wanted = needed.join(counts, "url_key").withColumn("salt", F.pmod(F.xxhash64("page_id"), F.col("salts")).cast("int")).drop("salts")
        # a page's assets end up in its one output row, so they have to fit there anyway
        lists = (
            wanted.join(one, ["url_key", "salt"])
            .groupBy(F.col("page_id").alias("__page"))
            .agg(F.collect_list(F.struct("url_key", "a.final_url", "a.media_type", "a.charset", "a.data")).alias("assets"))
        )
        source = source.join(lists, F.col("page_id").eqNullSafe(F.col("__page")), "left").drop("__page")

    def run(batches):
        for batch in slices(batches):
            rows = []
            for page, url, html, kind, charset, catalog in zip(*(c.to_pylist() for c in batch.columns[:5]), _catalogs(batch.column(5)), strict=True):
                content = title = error = log = None
                try:
                    if is_html(kind):
                        content, title, log = rewrite_page(html or "", url, catalog.get, options, charset or "utf-8")
                    else:
                        content = html.encode() if isinstance(html, str) else html
                except Exception as e:  # a broken page must not fail the job
                    error = f"{type(e).__name__}: {e}"
                rows.append((page, url, title, content, error, log or ()))
            kinds = {"page_id": pa.int64(), "url": pa.string(), "title": pa.string(), "content": pa.binary(), "error": pa.string()}
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())]
            yield pa.RecordBatch.from_arrays([*columns, _log_column([r[5] for r in rows])], names=[*kinds, "log"])

    return source.mapInArrow(run, "page_id bigint, url string, title string, content binary, error string, log array<struct<url:string,status:string>>")
