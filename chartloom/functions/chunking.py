"""Splitting one text into chunks: fixed word windows and the recursive splitter."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

from pyspark.sql import Column, functions as F

from chartloom.functions.text import bind

# Where the recursive splitter cuts, coarsest first; the last one cuts anywhere.
SEPARATORS = ("\n\n", "\n", " ", "")

# Context window in tokens of each known embedding model.
CONTEXT_WINDOWS = {
    "gte-large-en-v1.5": 8192,
    "bge-large-en-v1.5": 512,
    "bge_large_en_v1_5": 512,
    "text-embedding-ada-002": 8192,
    "text-embedding-3-small": 8192,
    "text-embedding-3-large": 8192,
}

DEFAULT_SIZE, DEFAULT_OVERLAP = 1024, 256


def check_chunk_sizes(size: int, overlap: int, window: int | None = None) -> None:
    """Refuse sizes that cannot work; ``window`` is the embedding model's context window."""
    if window is not None and size + overlap > window:
        raise ValueError(
            f"chunk size {size} plus overlap {overlap} exceeds the context window of {window} tokens"
        )
    if overlap > size:
        raise ValueError(f"overlap {overlap} exceeds chunk size {size}")


def context_window(model: str) -> int:
    if model not in CONTEXT_WINDOWS:
        raise ValueError(f"unknown embedding model {model}; known are {sorted(CONTEXT_WINDOWS)}")
    return CONTEXT_WINDOWS[model]


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_windows(text: Column, size: int, overlap: int = 0) -> Column:
    """Array of windows of ``size`` words, each starting ``size - overlap`` after the one before."""
    check_chunk_sizes(size, overlap)
    step = size - overlap
    if step <= 0:
        raise ValueError("the overlap must be smaller than the window")

    def windows(tokens: Column) -> Column:
        starts = F.sequence(
            F.lit(0), F.greatest(F.size(tokens) - overlap - 1, F.lit(0)), F.lit(step)
        )
        cut = F.transform(
            starts, lambda s: F.array_join(F.slice(tokens, s + 1, F.lit(size)), " ")
        )
        return F.when(F.size(tokens) > 0, cut)

    return bind(words(text), windows)


def word_count(text: str) -> int:
    return len(text.split())


# Characters of an unbroken run that count as one word.
RUN_CHARS = 32


def word_or_run_count(text: str) -> int:
    """Words, long ones once for each ``RUN_CHARS``: a run without blanks has a size too."""
    return sum(max(1, -(-len(word) // RUN_CHARS)) for word in text.split())


def recursive_chunker(
    size: int = DEFAULT_SIZE,
    overlap: int = 0,
    length: Callable[[str], int] = word_or_run_count,
    separators: tuple[str, ...] = SEPARATORS,
) -> Callable[[str], list[str]]:
    """A function from text to chunks of at most ``size``, cut at the coarsest separator that works.

    Neighboring pieces are packed up to ``size``; a chunk repeats at most ``overlap`` from the end
    of the one before. ``length`` measures text, in words and parts of long ones
    unless a tokenizer is plugged in.
    """
    check_chunk_sizes(size, overlap)

    def cut(text: str, separator: str) -> list[str]:
        # The separator stays at the front of the piece that follows it.
        if not separator:
            return list(text)
        first, *others = text.split(separator)
        return [p for p in (first, *(separator + o for o in others)) if p]

    def runs(text: str, level: int) -> Iterator[list[tuple[str, int]]]:
        """Runs of neighboring pieces that fit, with the oversize pieces between them cut finer."""
        while separators[level] and separators[level] not in text and level + 1 < len(separators):
            level += 1
        run: list[tuple[str, int]] = []
        for piece in cut(text, separators[level]):
            measured = length(piece)
            if measured < size:
                run.append((piece, measured))
                continue
            if run:
                yield run
                run = []
            if level + 1 < len(separators):
                yield from runs(piece, level + 1)
            else:
                yield [(piece, measured)]
        if run:
            yield run

    def pack(run: list[tuple[str, int]]) -> Iterator[str]:
        held: deque[tuple[str, int]] = deque()
        total = 0
        for piece, measured in run:
            if held and total + measured > size:
                yield "".join(p for p, _ in held)
                while held and total and (total > overlap or total + measured > size):
                    total -= held.popleft()[1]
            held.append((piece, measured))
            total += measured
        if held:
            yield "".join(p for p, _ in held)

    def chunks(text: str) -> list[str]:
        if length(text) <= size:
            return [whole] if (whole := text.strip()) else []
        found = (c.strip() for run in runs(text, 0) for c in pack(run))
        return [c for c in found if c]

    return chunks


def model_chunker(
    model: str, size: int | None = None, overlap: int = 0,
    length: Callable[[str], int] = word_count,
) -> Callable[[str], list[str]]:
    """Recursive chunker for an embedding model: without a size, chunks fill its context window."""
    window = context_window(model)
    size = size or window
    check_chunk_sizes(size, overlap, window)
    return recursive_chunker(size, overlap, length)
