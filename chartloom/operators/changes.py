"""Keyed-table operators: key collapse, snapshot diff, change log, upsert."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from chartloom.operators.chunks import CHUNK_KEY, CHUNK_TEXT, all_but

INSERT, UPDATE, DELETE = "insert", "update", "delete"


def collapse_keys(chunks: DataFrame, key: str = CHUNK_KEY) -> DataFrame:
    """One row per key: of equal chunks, the one whose other columns sort first wins.

    The minimum is taken before the shuffle too, so a chunk copied into a third of all documents
    leaves each task as a single row.
    """
    others = [c for c in chunks.columns if c != key]
    ordered = sorted(others, key=lambda c: (c == CHUNK_TEXT, c != "doc_uri"))
    winner = F.min(F.struct(*ordered)).alias("winner")
    return (
        chunks.groupBy(key).agg(winner).select(key, *[F.col("winner")[c].alias(c) for c in others])
    )


def diff_snapshots(old: DataFrame, new: DataFrame, key: str = CHUNK_KEY) -> DataFrame:
    """Change rows from ``old`` to ``new``: ``change_type`` and the new row, key only for deletes.

    Both sides must hold each key once. Only key and a hash of the rest of ``old`` are shuffled.
    """
    others = [c for c in new.columns if c != key]
    missing = set(others) - set(old.columns)
    if missing:
        raise ValueError(f"the old snapshot lacks columns {sorted(missing)}")

    def payload() -> Column:
        return F.sha2(F.to_json(F.struct(*others), {"ignoreNullFields": "false"}), 256)

    before = old.select(F.col(key).alias("__old_key"), payload().alias("__old_hash"))
    after = new.withColumn("__new_hash", payload())
    joined = after.join(before, after[key] == before["__old_key"], "full_outer")
    change = (
        F.when(F.col("__old_key").isNull(), INSERT)
        .when(F.col(key).isNull(), DELETE)
        .when(F.col("__old_hash") != F.col("__new_hash"), UPDATE)
    )
    return joined.select(
        change.alias("change_type"), F.coalesce(F.col(key), F.col("__old_key")).alias(key), *others
    ).filter(F.col("change_type").isNotNull())


def apply_changes(table: DataFrame, changes: DataFrame, key: str = CHUNK_KEY) -> DataFrame:
    """The table after its changes, in one join: a changed key takes its new row or leaves, the others
    stay. ``changes`` holds each key once."""
    new = changes.select(F.col(key).alias("__key"), F.struct("change_type", *all_but(table, key)).alias("__new"))
    joined = table.join(new, table[key] == new["__key"], "full_outer")
    changed = F.col("__new").isNotNull()
    columns = [F.when(changed, F.col("__new")[c]).otherwise(F.col(c)).alias(c) for c in table.columns if c != key]
    kept = joined.filter(~changed | (F.col("__new.change_type") != DELETE))
    return kept.select(F.coalesce(F.col(key), F.col("__key")).alias(key), *columns).select(*table.columns)


def rows_to_embed(chunks: DataFrame, index: DataFrame, key: str = CHUNK_KEY) -> DataFrame:
    """Rows whose key the index lacks."""
    return chunks.join(index.select(key), key, "left_anti")


def kept_rows(index: DataFrame, chunks: DataFrame, key: str = CHUNK_KEY) -> DataFrame:
    """Rows of the index whose key is still in the source."""
    return index.join(chunks.select(key), key, "left_semi")


def sync_index(
    index: DataFrame, chunks: DataFrame, embed: Callable[[DataFrame], DataFrame], key: str = CHUNK_KEY
) -> DataFrame:
    """The index for these chunks. Keys already embedded keep their vector; only new ones run the
    embedder."""
    source = collapse_keys(chunks, key).select(key, CHUNK_TEXT)
    fresh = embed(rows_to_embed(source, index, key))
    return kept_rows(index, source, key).unionByName(fresh.select(index.columns))


def latest_by_key(log: DataFrame, key: str, version: str = "batch_id") -> DataFrame:
    """Current rows of a change log: the latest row per key, without deleted keys."""
    others = [c for c in log.columns if c not in (key, version)]
    latest = F.max_by(F.struct(*others), version).alias("latest")
    current = log.groupBy(key).agg(latest).select(
        key, *[F.col("latest")[c].alias(c) for c in others]
    )
    if "change_type" not in others:
        return current
    return current.filter(F.col("change_type") != DELETE).drop("change_type")
