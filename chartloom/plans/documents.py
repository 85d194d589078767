"""Batch plan of the document pipeline: files to parsed table, chunk table and index."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from chartloom.functions.chunking import DEFAULT_OVERLAP, DEFAULT_SIZE, recursive_chunker
from chartloom.functions.embedding import with_embedding
from chartloom.operators.changes import collapse_keys, sync_index
from chartloom.operators.chunks import CHUNK_TEXT, apply_chunker
from chartloom.operators.documents import parse_files, spread
from chartloom.operators.quality import check_counts, observe_quality
from chartloom.sinks.tables import overwrite_folder
from chartloom.sources.files import binary_files


def build_document_tables(
    spark: SparkSession,
    source: str,
    target: str,
    size: int = DEFAULT_SIZE,
    overlap: int = DEFAULT_OVERLAP,
    hooks: Mapping[str, Callable[[bytes], str]] | None = None,
    partitions: int | None = None,
    max_failed_percent: float = 0.0,
    max_empty_percent: float = 0.0,
) -> tuple[DataFrame, DataFrame]:
    """Parsed documents and chunks of a folder of files; see ``store_document_tables``."""
    files = spread(binary_files(spark, source, require_any=True), partitions)
    chunker = recursive_chunker(size, overlap)
    return store_document_tables(
        files, target, lambda docs: apply_chunker(docs, chunker), hooks, max_failed_percent, max_empty_percent
    )


def store_document_tables(
    files: DataFrame,
    target: str,
    cut: Callable[[DataFrame], DataFrame],
    hooks: Mapping[str, Callable[[bytes], str]] | None = None,
    max_failed_percent: float = 0.0,
    max_empty_percent: float = 0.0,
) -> tuple[DataFrame, DataFrame]:
    """Parsed documents and chunks of file rows, each stored before the next stage reads it.

    The job that writes the documents counts the faults, so the gate before the chunks reads nothing.
    """
    parsed, counts = observe_quality(parse_files(files, hooks))
    docs = overwrite_folder(parsed, f"{target}/parsed_docs")
    check_counts(counts.get, max_failed_percent, max_empty_percent)
    return docs, overwrite_folder(cut(docs), f"{target}/chunked_docs")


def embed_chunks(chunks: DataFrame) -> DataFrame:
    return with_embedding(chunks, CHUNK_TEXT)


def build_index(
    chunks: DataFrame, target: str, version: int,
    previous: DataFrame | None = None,
    embed: Callable[[DataFrame], DataFrame] = embed_chunks,
) -> DataFrame:
    """Store one version of the index. Vectors of keys in ``previous`` are taken over; without it
    the index is rebuilt from nothing."""
    if previous is None:
        index = embed(collapse_keys(chunks).select("chunk_id", CHUNK_TEXT))
    else:
        index = sync_index(previous, chunks, embed)
    return overwrite_folder(index, f"{target}/index/version={version}")
