"""Chunk operators: parsed documents to keyed chunks, and checks of chunk sizes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from chartloom.functions.chunking import check_chunk_sizes, word_windows, words
from chartloom.functions.text import percentage

CHUNK_KEY, CHUNK_TEXT = "chunk_id", "content_chunked"


def all_but(df: DataFrame, *left_out: str) -> list[str]:
    return [c for c in df.columns if c not in left_out]


def _keyed_chunks(docs: DataFrame, chunks: Column, carried: list[str], position: str | None = None) -> DataFrame:
    """With ``position`` the place of each chunk in its document is a column of that name."""
    generated = F.posexplode(chunks).alias(position, CHUNK_TEXT) if position else F.explode(chunks).alias(CHUNK_TEXT)
    placed = [position] if position else []
    return docs.select(*carried, generated).select(F.md5(CHUNK_TEXT).alias(CHUNK_KEY), CHUNK_TEXT, *carried, *placed)


def chunk_fixed(
    docs: DataFrame, size: int, overlap: int = 0,
    carried: Iterable[str] | None = None, column: str = "content",
) -> DataFrame:
    """Fixed windows of words, JVM side. Documents without words drop out."""
    names = all_but(docs, column) if carried is None else list(carried)
    return _keyed_chunks(docs, word_windows(F.col(column), size, overlap), names)


def _few_bytes(texts: pa.Array, most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Start and length of slices of about ``most`` bytes, one text at least."""
    start = held = 0
    for i, size in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        held += size
        if held >= most:
            yield start, i + 1 - start
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts) - start


def apply_chunker(
    docs: DataFrame, chunker: Callable[[str], list[str]],
    carried: Iterable[str] | None = None, column: str = "content", position: str | None = None,
) -> DataFrame:
    """Any function from text to chunks, run over Arrow batches."""
    names = all_but(docs, column) if carried is None else list(carried)
    kind = pa.list_(pa.string())

    @F.arrow_udf("array<string>")
    def cut(texts: pa.Array) -> pa.Array:
        # A few texts at a time become Python objects; their chunks go back to Arrow before the next ones.
        parts = (texts.slice(*at).to_pylist() for at in _few_bytes(texts))
        return pa.concat_arrays([pa.array([None if t is None else chunker(t) for t in part], kind) for part in parts] or [pa.array([], kind)])

    return _keyed_chunks(docs, cut(column), names, position)


def oversize_chunks(
    chunks: DataFrame, window: int, tokens: Callable[[Column], Column] | None = None
) -> DataFrame:
    """Chunks longer than the model's context window, by a token count (words by default)."""
    count = tokens(F.col(CHUNK_TEXT)) if tokens else F.size(words(F.col(CHUNK_TEXT)))
    return chunks.withColumn("tokens", count).filter(F.col("tokens") > window)


def window_usage(size: Column, overlap: Column, window: Column) -> Column:
    """Percent of the context window that a chunk and its overlap fill."""
    return percentage(size + overlap, window)


def check_sizes(size: int, overlap: int, window: int) -> None:
    check_chunk_sizes(size, overlap, window)
