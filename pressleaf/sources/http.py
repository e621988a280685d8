"""A live source: addresses are fetched once each, by the executors, into an asset table.

Credentials in an address are sent as basic authentication and never stand in a result; proxies are those of the
environment. Errors stay in their row, so a fetch that fails costs no other.
"""

from __future__ import annotations

import base64
import ssl
import urllib.error
import urllib.request
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressleaf.functions import markup, media, urls
from pressleaf.options import Options
from pressleaf.sources.cookies import header

#: Seconds after which a fetch is given up where the options state none.
TIMEOUT = 600


def fetch(url: str, parent: str | None, options: Options, cookies: list[dict] = (), now: int = 0) -> tuple[str, str, str, bytes]:
    """(final address, media type, charset, data); raises ValueError or OSError."""
    found = urls.parse(url)
    if found is None or found.scheme not in ("http", "https"):
        raise ValueError("not an address of the web")
    if options.domains:
        hit = any(urls.within_domain(found.host or "", p.strip()) for p in options.domains)
        if hit == options.blacklist_domains:
            raise ValueError("domain not allowed")
    headers = {"User-Agent": options.user_agent or markup.PRODUCT}
    if found.userinfo:
        plain = urls.percent_decode(found.userinfo if ":" in found.userinfo else found.userinfo + ":")
        headers["Authorization"] = "Basic " + base64.b64encode(plain).decode()
    if cookie := header(cookies, url, now):
        headers["Cookie"] = cookie
    if source := urls.referer_for(parent, url):
        headers["Referer"] = source
    context = ssl._create_unverified_context() if options.insecure else None
    request = urllib.request.Request(str(replace(found, userinfo="", fragment=None)), headers=headers)
    try:
        answer = urllib.request.urlopen(request, timeout=options.timeout or TIMEOUT, context=context)  # noqa: S310
    except urllib.error.HTTPError as e:
        answer = e
    with answer:
        if answer.status != 200 and not options.ignore_errors:
            raise ValueError(f"status {answer.status}")
        stated = answer.headers.get("Content-Type")
        media_type, charset, _ = media.content_type(stated) if stated else ("", "", False)
        try:
            data = answer.read()
        except OSError:
            data = b""
        return answer.geturl(), media_type, charset, data


def fetch_assets(requests: DataFrame, options: Options | None = None, cookies: list[dict] = (), now: int = 0) -> DataFrame:
    """requests: url_key and parent -> the asset table's columns and error; each address once, for its least parent.

    A row is stored under the address that answered; a redirected one has its own row too.
    """
    options = options or Options()

    def run(batches):
        for batch in batches:
            rows = []
            for key, parent in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    final, media_type, charset, data = fetch(key, parent, options, cookies, now)
                except (ValueError, OSError) as e:
                    rows.append((key, None, None, None, None, f"{type(e).__name__}: {e}"))
                    continue
                final = urls.clean(final)
                rows += [(k, final, media_type, charset, data, None) for k in dict.fromkeys((key, final))]
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.string())
            names = ["url_key", "final_url", "media_type", "charset", "data", "error"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    once = requests.groupBy("url_key").agg(F.min("parent").alias("parent"))
    return once.mapInArrow(run, "url_key string, final_url string, media_type string, charset string, data binary, error string")
