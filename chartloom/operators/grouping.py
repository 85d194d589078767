"""Ordered text assembly per group, safe for groups that hold much of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BLOCK_ROWS = 4096


def _joined(entries: Column, separator: str) -> Column:
    return F.array_join(F.transform(F.sort_array(entries), lambda e: e["text"]), separator)


def assemble_text(
    df: DataFrame, keys: list[str], order: list[str], text: Column, separator: str,
    name: str, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Join the texts of each group in ``order``, whose last column holds running numbers.

    Runs of ``block_rows`` consecutive numbers are joined first, each as a group of its own, so a
    huge group is spread over the cluster; then the few block texts of a group are joined.
    """
    coarse, number = order[:-1], order[-1]
    entry = F.struct(F.col(number).alias("place"), F.coalesce(text, F.lit("")).alias("text"))
    blocks = (
        df.withColumn("__block", F.floor(F.col(number) / block_rows))
        .groupBy(*keys, *coarse, "__block")
        .agg(_joined(F.collect_list(entry), separator).alias("text"))
    )
    block = F.struct(*coarse, "__block", "text")
    return blocks.groupBy(*keys).agg(_joined(F.collect_list(block), separator).alias(name))


def assemble_messages(
    lines: DataFrame, order: tuple[str, ...] = ("line_no",), separator: str = "\r"
) -> DataFrame:
    """``(file_path, ..., value)`` rows to one message text per file, in the order of ``order``."""
    return assemble_text(lines, ["file_path"], list(order), F.col("value"), separator, "value")
