"""The node table: every page's tree in document order."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from pressleaf.sources import html as dom

_ATTRS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))


def dom_nodes(pages: DataFrame) -> DataFrame:
    """page_id, node_id (document order), parent_id, depth, kind, name, attrs, text."""

    def run(batches):
        for batch in batches:
            for page, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, todo = [], [(dom.parse(html or ""), None, 0)]
                while todo:
                    node, parent, depth = todo.pop()
                    at = len(rows)
                    rows.append((page, at, parent, depth, node.kind, node.name or None, [{"name": k, "value": v} for k, v in node.attrs], node.text or None))
                    todo += [(c, at, depth + 1) for c in reversed(node.children)]
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), _ATTRS, pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                    names=["page_id", "node_id", "parent_id", "depth", "kind", "name", "attrs", "text"],
                )

    return pages.select("page_id", "html").mapInArrow(
        run,
        "page_id bigint, node_id int, parent_id int, depth int, kind string, name string, attrs array<struct<name:string,value:string>>, text string",
    )
