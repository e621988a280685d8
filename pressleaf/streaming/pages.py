"""Bundling on a stream: the per-page transform has no state, so it runs as it is; addresses are told apart within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pressleaf.operators.bundle import bundle
from pressleaf.options import Options


def bundle_stream(pages: DataFrame, options: Options | None = None) -> DataFrame:
    """pages: a streaming page_id, url, html; append mode."""
    return bundle(pages, None, options)


def first_seen(pages: DataFrame, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each address once within the watermark."""
    return pages.withWatermark(time, late).dropDuplicatesWithinWatermark(["url"])
