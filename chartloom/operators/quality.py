"""Quality aggregates and gates over parsed documents."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, functions as F

from chartloom.functions.text import percentage
from chartloom.operators.documents import SUCCESS


class QualityError(RuntimeError):
    """Too many documents failed to parse or came out empty."""


def _counts() -> list[Column]:
    status = F.col("parser_status")
    return [
        F.count("*").alias("documents"),
        F.count_if(status == SUCCESS).alias("parsed"),
        F.count_if(status != SUCCESS).alias("failed"),
        F.count_if((status == SUCCESS) & (F.col("content") == "")).alias("empty"),
    ]


def observe_quality(docs: DataFrame, name: str = "parsed documents") -> tuple[DataFrame, Observation]:
    """The documents, and counts that the first job over them gathers as it goes."""
    observation = Observation(name)
    return docs.observe(observation, *_counts()), observation


def quality_summary(docs: DataFrame) -> DataFrame:
    """One row with all counts and shares, from one pass over status and emptiness."""
    counts = docs.agg(*_counts())
    total = F.col("documents")
    return counts.select(
        "*",
        percentage(F.col("failed"), total).alias("failed_percent"),
        percentage(F.col("empty"), total).alias("empty_percent"),
        F.concat_ws(" / ", F.col("parsed").cast("string"), total.cast("string")).alias("summary"),
    )


def check_counts(counts: Mapping[str, int], max_failed_percent: float = 0.0, max_empty_percent: float = 0.0) -> None:
    """Raise when a share of faults is above its limit. A limit of 0 allows no faulty document at all."""
    total = counts["documents"]
    for kind, limit in (("failed", max_failed_percent), ("empty", max_empty_percent)):
        found = counts[kind]
        if found and found * 100.0 / total > limit:
            raise QualityError(f"{found} of {total} documents {kind}: {round(found / total, 2) * 100}%")


def quality_gate(
    docs: DataFrame, max_failed_percent: float = 0.0, max_empty_percent: float = 0.0
) -> DataFrame:
    """Pass stored documents on, or raise as ``check_counts`` does, from one aggregate over them. A job that
    writes them can gather the counts itself, see ``observe_quality``."""
    check_counts(quality_summary(docs).first().asDict(), max_failed_percent, max_empty_percent)
    return docs
