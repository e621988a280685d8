"""Cookie files and the choice of a cookie for an address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressleaf.functions import urls

HEADERS = ("# HTTP Cookie File", "# Netscape HTTP Cookie File")


def parse(lines: DataFrame) -> DataFrame:
    """lines: line_no (from 0) and value. Rows without seven fields, comments and bad expiries are left out.

    A first line that is no header raises ValueError; no lines give no cookies.
    """
    first = lines.where("line_no = 0").head(1)
    if first and first[0]["value"] not in HEADERS:
        raise ValueError("not a cookie file")
    part = F.split("value", "\t")
    rows = lines.where((F.col("line_no") > 0) & ~F.col("value").startswith("#") & (F.size(part) == 7))
    return rows.select(
        "line_no",
        F.lower(part[0]).alias("domain"),
        (part[1] == "TRUE").alias("include_subdomains"),
        part[2].alias("path"),
        (part[3] == "TRUE").alias("https_only"),
        F.expr("try_cast(split(value, '\t')[4] as bigint)").alias("expires"),
        part[5].alias("name"),
        part[6].alias("value"),
    ).where(F.col("expires").isNotNull())


def expired(now: int) -> Column:
    return (F.col("expires") != 0) & (F.col("expires") < now)


def matches(scheme: Column, host: Column, path: Column) -> Column:
    """Whether the cookie in the row is for the address. A dotted domain doesn't match its own apex."""
    host = F.lower(host)
    secure = (scheme == "https") | ((scheme == "http") & ~F.col("https_only"))
    inner = F.expr("substring(domain, 2, greatest(length(domain) - 2, 0))")
    by_host = F.when(F.col("domain").startswith(".") & F.col("include_subdomains"), host.endswith(F.col("domain")) | (host == inner)).otherwise(
        host == F.col("domain")
    )
    by_path = (F.lower(path) == F.lower("path")) | path.startswith(F.col("path"))
    return secure & by_host & by_path


def header(cookies: list[dict], url: str, now: int) -> str | None:
    """name=value of the last cookie (rows as parse() gives them) for the address."""
    found = urls.parse(url)
    if found is None or found.scheme not in ("http", "https"):
        return None
    host, path, last = (found.host or "").lower(), found.path, None
    for c in sorted(cookies, key=lambda c: c["line_no"]):
        domain = c["domain"]
        dotted = domain.startswith(".") and c["include_subdomains"]
        by_host = host.endswith(domain) or host == domain[1:-1] if dotted else host == domain
        by_path = path.lower() == c["path"].lower() or path.startswith(c["path"])
        old = c["expires"] != 0 and c["expires"] < now
        if by_host and by_path and not old and (found.scheme == "https" or not c["https_only"]):
            last = f"{c['name']}={c['value']}"
    return last


def chosen(requests: DataFrame, cookies: DataFrame, now: int) -> DataFrame:
    """requests: request_id, scheme, host, request_path. The last matching cookie of the file for each.

    A request meets the cookies of its host and of each ending of it, so both sides are joined by a key.
    """
    host = F.lower("host")
    endings = F.transform(F.sequence(F.lit(1), F.size(F.split(host, r"\."))), lambda i: F.concat(F.lit("."), F.call_function("substring_index", host, F.lit("."), -i)))
    asked = requests.withColumn("__key", F.explode(F.array_union(F.array(F.concat(F.lit("="), host)), endings)))
    inner = F.expr("concat('=', substring(domain, 2, greatest(length(domain) - 2, 0)))")
    dotted = F.col("domain").startswith(".") & F.col("include_subdomains")
    keys = F.when(dotted, F.array(F.col("domain"), inner)).otherwise(F.array(F.concat(F.lit("="), "domain")))
    known = cookies.where(~expired(now)).withColumn("__key", F.explode(keys))
    found = asked.join(known, "__key").where(matches(F.col("scheme"), F.col("host"), F.col("request_path")))
    last = found.groupBy("request_id").agg(F.max_by(F.struct("name", "value"), "line_no").alias("c"))
    return last.select("request_id", "c.name", "c.value")
