"""WARC archives of pages: a writer through the text sink and a salvage reader.

Writer: one record per page; of pages with equal payloads the one with the largest id is a `response`, the others
are `revisit` records that refer to it and hold no payload. Records are written by Spark's text sink with the
record separator as line end, so any file system that Spark knows will do.

Reader: walks the members (gzip) or records of each file and checks version line, headers, length, separator and
digest. After a failed check it searches for the next place that starts a valid record, goes on there, and logs
the bytes between as a quarantined gap.

Defined results: null html is an empty payload; null url leaves out the target; null ids come back null and only
refer, unless all ids of a payload are null, when all are responses; rows that repeat the largest id with the same
payload are all responses; other columns, whatever their names, are not read; a page may be as long as a text of Spark may,
and a file of records_per_file of them must fit a task's memory; an empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressleaf.llm.common import cut, scratch, table

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
SEPARATOR = "\r\n\r\n"
RECORD = "urn:pressleaf:page:"
#: Slots of the filter that tells repeated payloads from single ones before any text is shuffled.
SLOTS = 1 << 20
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_START = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")


def base32(hex40: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hex: eight groups of 20 bits, four letters each."""
    letters = []
    for i in range(8):
        bits = F.conv(F.substring(hex40, 5 * i + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            letters.append(F.substring(F.lit(ALPHABET), F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*letters)


def _http(length: Column) -> Column:
    return F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), length.cast("string"), F.lit(SEPARATOR))


def records(pages: DataFrame, date: str = "2025-01-01T00:00:00Z") -> DataFrame:
    """page_id and record: the whole record as text, without the separator that ends it."""
    html = F.coalesce(F.col("html"), F.lit(""))
    base = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    # only payloads that occur more than once need a partner; their digests alone are grouped
    repeated = cut(
        base.groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("kept")).where("n > 1").select("digest", "kept"),
        "warc-repeated",
    )
    # a page whose slot no repeated payload has is surely single and needn't be shuffled; SLOTS numbers at most
    slot = F.pmod(F.xxhash64("digest"), F.lit(SLOTS)).cast("int")
    slots = F.broadcast(repeated.select(slot.alias("slot")).distinct())
    marked = base.withColumn("slot", slot)
    single = marked.join(slots, "slot", "left_anti").withColumn("kept", F.lit(None).cast("long"))
    paired = single.unionByName(marked.join(slots, "slot", "left_semi").join(repeated.hint("merge"), "digest", "left"))
    revisit = F.col("kept").isNotNull() & ~F.col("kept").eqNullSafe(F.col("page_id"))
    length = F.octet_length(F.col("html").cast("binary"))
    head = _http(length)
    # nothing may break a header line
    target = F.regexp_replace(F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20"), "^$", "about:blank")
    block = F.when(revisit, head).otherwise(F.concat(head, F.col("html")))
    lines = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit(f"WARC-Record-ID: <{RECORD}"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), target),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit(f"WARC-Refers-To: <{RECORD}"), F.col("kept").cast("string"), F.lit(">"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32(F.col("digest"))),
        F.concat(F.lit("WARC-Block-Digest: sha1:"), base32(F.sha1(block.cast("binary")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block.cast("binary")).cast("string")),
    )
    return paired.select("page_id", F.concat(lines, F.lit(SEPARATOR), block).alias("record"))


def write(pages: DataFrame, path: str, records_per_file: int = 2000) -> None:
    """Writes the archive files; a file holds records_per_file records at most, so that one fits a task's memory."""
    records(pages).select(F.col("record").alias("value")).write.option("lineSep", SEPARATOR).option(
        "maxRecordsPerFile", records_per_file
    ).text(path)


def _parse(data: bytes, at: int):
    """(record, end) of a valid record at this place; None if a check fails."""
    version = _VERSION.match(data, at)
    if not version:
        return None
    end = data.find(b"\r\n\r\n", version.end() - 2)
    if end < 0:
        return None
    headers = {}
    for line in data[version.end() : end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not length.isdigit():
        return None
    start, stop = end + 4, end + 4 + int(length)
    if data[stop : stop + 4] != b"\r\n\r\n":
        return None
    block = data[start:stop]
    if not _matches(block, headers.get("warc-block-digest")):
        return None
    payload = block.partition(b"\r\n\r\n")[2] if "application/http" in headers.get("content-type", "") else block
    if headers.get("warc-type") == "response" and not _matches(payload, headers.get("warc-payload-digest")):
        return None
    return (headers, block, payload), stop + 4


def _matches(data: bytes, digest: str | None) -> bool:
    """Whether a labelled SHA-1 holds; digests that are missing or of another kind aren't checked."""
    kind, _, value = (digest or "").partition(":")
    return kind.lower() != "sha1" or base64.b32encode(hashlib.sha1(data).digest()).decode() == value.upper()


def _member(data: bytes, at: int):
    """(plain bytes, end, state) of a gzip member as far as it can be read; the state is "whole", "short" where the data
    end first, "trailer" where only checksum or size fail, and "broken" where the compressed bytes can't be read on."""
    view, parts, unzip, place, step = memoryview(data), [], zlib.decompressobj(31), at, 1 << 16
    while place < len(data):
        before = unzip.copy() if step > 1 else None
        try:
            parts.append(unzip.decompress(view[place : place + step]))
        except zlib.error as e:
            if step > 1:  # byte by byte up to the damage
                unzip, step = before, 1
                continue
            checked = next((n for what, n in (("data check", 4), ("length check", 8)) if what in str(e)), 0)
            return b"".join(parts), place + 1 - checked, "trailer" if checked else "broken"
        place = min(place + step, len(data))
        if unzip.eof:
            return b"".join(parts), place - len(unzip.unused_data), "whole"
    parts.append(unzip.flush())
    return b"".join(parts), len(data), "short"


def _proven(headers: dict) -> bool:
    """Whether a record that passed its checks had a digest of its whole block among them."""
    return headers.get("warc-block-digest", "").lower().startswith("sha1:")


def salvage(data: bytes):
    """Yields ("record", offset, end, headers, block, payload) and ("gap", offset, end, None, None, None) in file order.

    Records and gaps inside a gzip member have the offsets of the member; a damaged member gives the records that could be
    read, up to the next valid place, and is a gap besides. Where its compressed bytes are wrong, only records with a
    block digest count; a member of one record that fails in checksum or size alone is a gap alone.
    """
    at, bad = 0, None
    held = []  # records of damaged members within the gap
    while at < len(data):
        got, end = [], None
        if data.startswith(b"\x1f\x8b\x08", at):
            plain, stop, state = _member(data, at)
            inner = list(salvage(plain))
            records = [x for x in inner if x[0] == "record"]
            if state == "whole":
                if records or not inner:
                    got, end = [(x[0], *x[3:]) for x in inner], stop
            elif state != "trailer" or len(inner) > 1:
                for _, a, b, *rest in records:
                    # what is stored without compression is found by the search
                    if (state == "short" or _proven(rest[0])) and data.find(plain[a:b], at + 1, stop) < 0:
                        held.append((at, *rest))
        elif parsed := _parse(data, at):
            got, end = [("record", *parsed[0])], parsed[1]
        if end is None:
            bad = at if bad is None else bad
            found = _START.search(data, at + 1)
            at = found.start() if found else len(data)
            continue
        if bad is not None:
            for start, *rest in held:
                yield "record", start, at, *rest
            yield "gap", bad, at, None, None, None
            bad, held = None, []
        for kind, headers, block, payload in got:
            yield kind, at, end, headers, block, payload
        at = end
    if bad is not None:
        for start, *rest in held:
            yield "record", start, len(data), *rest
        yield "gap", bad, len(data), None, None, None


_NAMES = ["file", "kind", "offset", "length", "headers", "payload_bytes", "payload"]
_SCHEMA = "file string, kind string, offset bigint, length bigint, headers map<string,string>, payload_bytes bigint, payload binary"
_STATED = re.compile(rb"\r\ncontent-length: *([0-9]+)\r\n", re.IGNORECASE)


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records and gaps of all files below path, each file by one task.

    payload_bytes is the length of the full payload, which a revisit states in its HTTP head.
    """

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, size = [], 0
                for kind, at, end, headers, block, payload in salvage(content.as_py()):
                    full = None
                    if kind == "record":
                        stated = _STATED.search(block[: len(block) - len(payload)]) if headers.get("warc-type") == "revisit" else None
                        full = int(stated[1]) if stated else len(payload)
                    rows.append((name, kind, at, end - at, list((headers or {}).items()), full, payload if with_payload else None))
                    size += len(payload or b"")
                    if size > 4 << 20:
                        yield _rows(rows)
                        rows, size = [], 0
                if rows:
                    yield _rows(rows)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, _SCHEMA)


def _rows(rows: list) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=_NAMES)


def _page(header: str) -> Column:
    return F.expr(f"try_cast(nullif(regexp_extract(headers['{header}'], '^<{RECORD}(-?[0-9]+)>$', 1), '') as bigint)")


def query(spark, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    # what was written here must come back whole
    whole = F.when(F.col("kind") == "record", True).otherwise(F.raise_error(F.concat(F.lit("damaged archive: "), "file")).cast("boolean"))
    return read(spark, path, with_payload=False).where(whole).select(
        _page("warc-record-id").alias("page_id"),
        "payload_bytes",
        F.regexp_replace(F.col("headers")["warc-payload-digest"], "^sha1:", "").alias("payload_digest"),
        F.col("headers")["warc-type"].alias("record_type"),
        _page("warc-refers-to").alias("refers_to"),
    )


#: The base32 letters of a SHA-1: eight groups of five hex digits, four letters each.
SQL = f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), k AS (
  SELECT h, max(page_id) AS kept FROM p GROUP BY h
)
SELECT p.page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('{ALPHABET}',
    CAST((CAST('0x' || substr(p.h, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN kept IS NOT DISTINCT FROM p.page_id OR kept IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN kept IS NOT DISTINCT FROM p.page_id OR kept IS NULL THEN NULL ELSE kept END AS refers_to
FROM p JOIN k ON p.h = k.h
"""
