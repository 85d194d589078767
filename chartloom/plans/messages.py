"""Batch plan of the message pipeline: message texts to all segment tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from chartloom.operators.messages import (
    explode_segments, flatten_messages, of_kind, parse_messages, typed_segments, with_kind,
)
from chartloom.schemas import SEGMENT_FIELD_NUMBERS
from chartloom.sinks.tables import overwrite_folder


def build_segment_tables(
    messages: DataFrame, target: str, segments: Iterable[str] = tuple(SEGMENT_FIELD_NUMBERS)
) -> dict[str, DataFrame]:
    """Parse once, store the segments by kind, and give every typed table as a pruned read."""
    exploded = explode_segments(flatten_messages(parse_messages(messages)))
    stored = overwrite_folder(with_kind(exploded), f"{target}/gold_all", "segment_kind")
    tables = {f"gold_{s.lower()}": typed_segments(of_kind(stored, s), s) for s in segments}
    return {"gold_all": stored.drop("segment_kind"), **tables}
