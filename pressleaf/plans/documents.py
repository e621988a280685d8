"""SQL twins of whole bundled documents.

The pages of the test tables have one form: a head of charset, title, style and script, a list of links, a comment, an
advertisement, an article of a heading and paragraphs, and a footer. Some paragraphs begin with a `<b>` that is never
closed, so HTML opens it again in each later paragraph and in the footer, three times at most. The SQL below cuts a page
into these parts and writes what a browser's tree of it serialises to, without parsing.
"""

from __future__ import annotations

from pressleaf.functions import markup

ORIGIN = "^(https?://[^/?#]+)"


def text(x: str) -> str:
    """Text as a serialised tree has it; the pages use four entities, some of them cut off."""
    for entity, shown in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"')):
        x = f"replace({x}, '{entity}', '{shown}')"
    return f"regexp_replace({x}, '&(amp;?)?', '&amp;', 'g')"


def percent(x: str) -> str:
    return f"array_to_string(list_transform(string_split({x}, ''), lambda c: CASE WHEN unicode(c) > 126 THEN url_encode(c) ELSE c END), '')"


#: One row a page: its parts.
PARTS = f"""(SELECT page_id, url, html, regexp_extract(url, '{ORIGIN}', 1) AS origin,
  regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, {text("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS title,
  regexp_extract(html, '<style>([^<]*)</style>', 1) AS style, regexp_extract(html, '<script>(.*?)</script>', 1, 's') AS script,
  regexp_extract_all(html, '<li><a href="([^"]*)">[^<]*</a></li>', 1) AS hrefs,
  regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1) AS names,
  regexp_extract(html, '<!--([^>]*)-->', 1) AS comment, {text("regexp_extract(html, '<div class=" + chr(34) + "ad" + chr(34) + ">([^<]*)</div>', 1)")} AS ad,
  {text("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")} AS h1,
  string_split(regexp_extract(html, '</h1>(.*?)</article>', 1, 's'), '<p>')[2:] AS paragraphs,
  {text("regexp_extract(html, '<footer>([^<]*)</footer>', 1)")} AS footer FROM pages)"""

_OPEN = "least(len(list_filter(paragraphs[1:i - 1], lambda x: starts_with(x, '<b>'))), 3)"
_BODY = text("replace(replace(replace(p, '<b>', ''), '<br>', ''), '</p>', '')")
_PARAGRAPH = f"""'<p>' || CASE WHEN starts_with(p, '<b>')
  THEN repeat('<b>', {_OPEN} + 1) || {_BODY} || '<br>' || repeat('</b>', {_OPEN} + 1)
  WHEN p IN ('', '</p>') THEN '' ELSE repeat('<b>', {_OPEN}) || {_BODY} || repeat('</b>', {_OPEN}) END || '</p>'"""
_LEFT = "least(len(list_filter(paragraphs, lambda x: starts_with(x, '<b>'))), 3)"


def document(policy: str = "", css: bool = True, js: bool = True, links: str = "", charset: str = "utf-8") -> str:
    """An SQL expression over PARTS: the document, without the metadata and the line end."""
    meta = f'<meta http-equiv="Content-Security-Policy" content="{policy}"></meta>'.replace("'", "''") if policy else ""
    anchors = f"""array_to_string(list_transform(range(1, len(hrefs) + 1),
      lambda i: '<li><a href="' || origin || {percent("hrefs[i]")} || '">' || {text("names[i]")} || '</a></li>'), '')"""
    body = f"array_to_string(list_transform(paragraphs, lambda p, i: {_PARAGRAPH}), '')"
    return f"""'<!DOCTYPE html><html lang="' || lang || '"><head>{meta}<meta charset="{charset}"><title>' || title || '</title><style>' || {"style" if css else "''"}
      || '</style><script>' || {"script" if js else "''"} || '</script>{links}<meta name="robots" content="none"></meta></head><body><nav><ul>' || {anchors}
      || '</ul></nav><!--' || comment || '--><div class="ad">' || ad || '</div><article><h1>' || h1 || '</h1>' || {body}
      || '</article><footer>' || repeat('<b>', {_LEFT}) || footer || repeat('</b>', {_LEFT}) || '</footer></body></html>'"""


def bundled(stamp: str | None, mhtml: bool = False, chars: bool = False, **parts) -> str:
    """SQL of page_id, url, title, bytes, digest and error of every bundled page; chars: one byte a character."""
    whole = document(**parts)
    if stamp:
        whole = f"'<!-- Saved from ' || regexp_replace(url, '#.*$', '') || ' at {stamp} using {markup.PRODUCT} -->' || chr(10) || {whole}"
    crlf = lambda s: s.replace("'", "''").replace("\r\n", "' || chr(13) || chr(10) || '")
    whole = f"'{crlf(markup.MHTML_HEAD)}' || {whole} || '{crlf(markup.MHTML_TAIL)}'" if mhtml else f"{whole} || chr(10)"
    return f"""SELECT page_id, url, replace(title, '&amp;', '&') AS title, CAST({"length" if chars else "strlen"}(made) AS BIGINT) AS bytes, sha256(made) AS digest,
      CAST(NULL AS VARCHAR) AS error FROM (SELECT page_id, url, title, {whole} AS made FROM {PARTS})"""


#: Elements of each page's tree by name.
COUNTS = f"""SELECT page_id, name, CAST(n AS BIGINT) AS n FROM (SELECT page_id, unnest(['html', 'head', 'body', 'meta', 'title', 'style', 'script', 'nav', 'ul', 'li', 'a',
    'div', 'article', 'h1', 'p', 'b', 'br', 'footer']) AS name, unnest([1, 1, 1, 1, 1, 1, 1, 1, 1, len(hrefs), len(hrefs), 1, 1, 1, len(paragraphs),
    CAST(list_sum(list_transform(paragraphs, lambda p, i: CASE WHEN starts_with(p, '<b>') THEN {_OPEN} + 1 WHEN p IN ('', '</p>') THEN 0 ELSE {_OPEN} END)) AS BIGINT) + {_LEFT},
    len(list_filter(paragraphs, lambda p: starts_with(p, '<b>'))), 1]) AS n FROM {PARTS}) WHERE n > 0"""
