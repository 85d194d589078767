"""JSON text to tagged lines, through Arrow batches."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, functions as F


def _tagged(value, tag: str) -> str:
    if isinstance(value, dict):
        children = value.items()
    elif isinstance(value, list):
        children = ((f"{tag}_{place}", item) for place, item in enumerate(value))
    else:
        return f"<{tag}>{value}</{tag}>"
    return "\n".join(_tagged(child, name) for name, child in children)


def tagged_lines(text: str | None) -> str | None:
    """Tagged lines of one JSON text; NULL when it does not parse as a single value."""
    if text is None:
        return None
    try:
        return _tagged(json.loads(text), "").strip()
    except (ValueError, RecursionError):
        return None


def json_to_tags(text: Column) -> Column:
    @F.arrow_udf("string")
    def convert(batch: pa.Array) -> pa.Array:
        return pa.array([tagged_lines(t) for t in batch.to_pylist()], pa.string())

    return convert(text)
