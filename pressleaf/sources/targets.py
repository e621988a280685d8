"""What a user names as a target, and the page rows that come of it."""

from __future__ import annotations

import os
import sys
from pathlib import Path
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession

from pressleaf.functions import urls

SCHEMES = ("data", "file", "http", "https")
PAGES = "page_id bigint, url string, html binary, media_type string, charset string"


def resolve(target: str) -> str:
    """The address of a target: an address of a known scheme, a file's path, or a host without its scheme."""
    if not target:
        raise ValueError("no target specified")
    found = urls.parse(target)
    if found is not None:
        if found.scheme not in SCHEMES:
            raise ValueError(f'unsupported target URL scheme "{found.scheme}"')
        return str(found)
    if os.path.isfile(target):
        return str(urls.parse(Path(target).resolve().as_uri()))
    if os.path.exists(target):
        raise ValueError(f'local target "{target}" is not a file')
    return str(urls.parse("http://" + target) or "http://" + target)


def stdin_page(spark: SparkSession, stream: BinaryIO | None = None) -> DataFrame:
    """One page without an address: what standard input holds, up to where reading it fails."""
    stream = stream or sys.stdin.buffer
    parts = []
    try:
        while part := stream.read(1 << 20):
            parts.append(part)
    except OSError:
        pass
    return spark.createDataFrame([(0, None, b"".join(parts), None, None)], PAGES)
