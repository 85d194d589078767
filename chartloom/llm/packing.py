"""Packing of token sequences by a configuration linear program over the histogram of lengths.

A configuration says how many pieces of each length share one sequence. The program asks for the fewest
sequences whose configurations cover the histogram; multiplicative weights solve it: lengths that are
less covered weigh more, a knapsack over the weights prices the best configuration, and a part of the
histogram is given to it. Shares are rounded down to whole sequences that use no more pieces than
there are, what is left is solved again, and the last rest, with the lengths too rare for shares of
sequences, goes by best fit over the histogram. The driver sees the histogram only (as many numbers as
a sequence has tokens); pieces find their place from their rank among those of their length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from chartloom.llm.common import give_back, slices, small_batches, stored, text_of
from chartloom.llm.tokens import forget_words, id_bytes, tokenizer_kind

CAPACITY = 2_048
#: Rounds of weights and knapsacks in each solution, solutions of what rounding leaves, shrinking of weights.
ROUNDS = 150
SOLUTIONS = 3
STEP = 0.125
#: Power of a piece's length in its worth.
LONGER = 1.05
#: How full a configuration must be to be used; the one that leaves the fewest sequences is taken.
FULL = (0.999, 0.995, 0.99, 0.98, 0.96, 0.9)

Configuration = tuple[tuple[int, int], ...]  # (length, pieces of it), longest first


def knapsack(lengths: np.ndarray, values: np.ndarray, capacity: int) -> dict[int, int]:
    """Pieces of each length with the largest value that fit; lengths ascend."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    fitting = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(int(lengths[0]), capacity + 1):
        k = fitting[room]
        worth = best[room - lengths[:k]] + values[:k]
        at = int(worth.argmax())
        if worth[at] > best[room - 1]:
            best[room], choice[room] = worth[at], at
        else:
            best[room] = best[room - 1]
    taken: dict[int, int] = defaultdict(int)
    room = capacity
    while room > 0:
        if choice[room] < 0 or best[room] == best[room - 1]:
            room -= 1
            continue
        length = int(lengths[choice[room]])
        taken[length] += 1
        room -= length
    return dict(taken)


def _shares(left: dict[int, int], capacity: int, rounds: int) -> list[tuple[Configuration, float]]:
    """Configurations and how many sequences of each the program asks for, most first."""
    lengths = np.array(sorted(l for l, n in left.items() if n >= capacity // l and n > 1), np.int64)
    if not len(lengths):
        return []
    counts = np.array([left[int(l)] for l in lengths], float)
    weights, covered = np.ones(len(lengths)), np.zeros(len(lengths))
    index = {int(l): i for i, l in enumerate(lengths)}
    shares: dict[Configuration, float] = defaultdict(float)
    for _ in range(rounds):
        # A piece is worth its share of a sequence, long ones a little more since they are harder to place,
        # and less as its length gets covered.
        taken = knapsack(lengths, (lengths / capacity) ** LONGER * weights, capacity)
        at = np.array([index[l] for l in taken])
        many = np.array(list(taken.values()), float)
        share = float((counts[at] / many).min())
        shares[tuple(sorted(taken.items(), reverse=True))] += share
        covered[at] += share * many / counts[at]
        weights[at] *= np.exp(-STEP * share * many / counts[at])
    scale = float((covered * counts * lengths).sum() / (counts * lengths).sum())
    return sorted(((c, share / max(scale, 1.0)) for c, share in shares.items()), key=lambda x: (-x[1], x[0]))


def _rounded(shares: list[tuple[Configuration, float]], left: dict[int, int], capacity: int, full: float) -> list[tuple[Configuration, int]]:
    """Whole sequences of the configurations that are full enough, within what is left, which they use up."""
    solution = []
    for configuration, share in shares:
        if sum(length * many for length, many in configuration) < full * capacity:
            continue
        whole = min([int(share), *(left[l] // many for l, many in configuration)])
        if whole > 0:
            solution.append((configuration, whole))
            for length, many in configuration:
                left[length] -= whole * many
    return solution


def _best_fit(left: dict[int, int], capacity: int) -> list[tuple[Configuration, int]]:
    """Longest lengths first, each into the fullest sequences that have room; equal ones in one go."""
    open_: dict[int, dict[Configuration, int]] = defaultdict(dict)  # by room

    def put(room, configuration, many):
        open_[room][configuration] = open_[room].get(configuration, 0) + many

    for length in sorted((l for l, n in left.items() if n), reverse=True):
        n = left[length]
        for room in range(length, capacity):
            while n and open_.get(room):
                configuration, there = open_[room].popitem()
                fit = min(room // length, max(1, n // there))
                used = min(there, n // fit)
                if used < there:
                    put(room, configuration, there - used)
                put(room - fit * length, configuration + ((length, fit),), used)
                n -= used * fit
        fit = capacity // length
        if n // fit:
            put(capacity - fit * length, ((length, fit),), n // fit)
        if n % fit:
            put(capacity - n % fit * length, ((length, n % fit),), 1)
    return [(configuration, many) for group in open_.values() for configuration, many in group.items()]


def solve_histogram(
    histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS
) -> list[tuple[Configuration, int]]:
    """Configurations and how many sequences have them; they use every piece once."""
    left = dict(histogram)
    solution = []
    if left.get(capacity):
        solution.append((((capacity, 1),), left.pop(capacity)))
    shares = _shares(left, capacity, rounds)
    tries = []
    for full in FULL if shares else ():
        rest = dict(left)
        found = _rounded(shares, rest, capacity, full)
        tries.append((sequences(found) + sequences(_best_fit(rest, capacity)), -full, found, rest))
    found, rest, plain = [], left, _best_fit(dict(left), capacity)
    if tries:
        _, full, found, rest = min(tries, key=lambda x: x[:2])
        one = found + _best_fit(dict(rest), capacity)
        for _ in range(SOLUTIONS - 1):
            more = _rounded(_shares(rest, capacity, rounds), rest, capacity, -full)
            if not more:
                break
            found += more
        plain = min(found + _best_fit(dict(rest), capacity), one, plain, key=sequences)
    return solution + plain


def sequences(solution: list[tuple[Configuration, int]]) -> int:
    return sum(many for _, many in solution)


def least_sequences(histogram: dict[int, int], capacity: int = CAPACITY) -> int:
    """A bound that no packing goes below: by tokens, and by pieces of more than half a sequence, to which only
    pieces that still fit are added."""
    total = sum(length * n for length, n in histogram.items())
    best = -(-total // capacity)
    # Pieces longer than capacity - a are alone with pieces up to a; those over half are one to a sequence.
    for a in range(0, capacity // 2 + 1, max(1, capacity // 64)):
        alone = sum(n for length, n in histogram.items() if length > capacity - a)
        halves = sum(n for length, n in histogram.items() if capacity // 2 < length <= capacity - a)
        room = halves * capacity - sum(length * n for length, n in histogram.items() if capacity // 2 < length <= capacity - a)
        small = sum(length * n for length, n in histogram.items() if a <= length <= capacity // 2)
        best = max(best, alone + halves + max(0, -(-(small - room) // capacity)))
    return best


def _pieces(path: str, kind: str, capacity: int, end_id: int):
    """Cuts each text's ids, and ranks pieces among those of their length and task."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]):
        part = TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch in batches:
            keys, texts = batch.column("key").to_pylist(), batch.column("text").to_pylist()
            for start, stop in slices(texts, 500_000):
                out = [[], [], [], [], [], []]
                for key, ids in zip(keys[start:stop], id_bytes(path, kind, texts[start:stop])):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        n = len(own) // 4
                        for column, value in zip(out, (key, piece, at // 4, n, zlib.crc32(own), seen[n])):
                            column.append(value)
                        seen[n] += 1
                kinds = (batch.schema.field("key").type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(column, kind) for column, kind in zip(out, kinds)), pa.array([part] * len(out[0]), pa.int32())],
                    ["key", "piece", "start", "length", "ids_crc32", "rank", "part"],
                )
        if kind == "words":
            forget_words(path)
        give_back()

    return run


def _places(solution: list[tuple[Configuration, int]]):
    """Sequence and offset of the pieces of each length, by rank."""
    blocks: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for configuration, many in solution:
        offset = 0
        for length, pieces in configuration:
            blocks[length].append((used[length], pieces, sequence, offset))
            used[length] += pieces * many
            offset += pieces * length
        sequence += many
    tables = {length: np.array(rows, np.int64).T for length, rows in blocks.items()}

    def run(batches):
        for batch in batches:
            lengths, ranks = batch.column("length").to_numpy(), batch.column("place").to_numpy()
            sequences, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for length in np.unique(lengths):
                own = np.flatnonzero(lengths == length)
                first, pieces, base, offset = tables[int(length)]
                at = np.searchsorted(first, ranks[own], side="right") - 1
                within = ranks[own] - first[at]
                sequences[own] = base[at] + within // pieces[at]
                offsets[own] = offset[at] + within % pieces[at] * length
            names = [name for name in batch.schema.names if name != "place"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(name) for name in names), pa.array(sequences), pa.array(offsets)],
                [*names, "sequence_id", "offset"],
            )

    return run


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    capacity: int = CAPACITY,
    end_id: int = 0,
    rounds: int = ROUNDS,
) -> DataFrame:
    """``<id>, piece, start, length, ids_crc32, sequence_id, offset`` of every piece.

    A document is the ids of its text and ``end_id``; only one of more than ``capacity`` ids is cut, into
    full pieces and a last one. Null and empty texts are one piece of ``end_id`` alone; null ids and
    repeated rows are packed like any other; an empty table has no pieces. Pieces of a sequence are
    gapless from 0. Other columns are not looked at.
    """
    with small_batches(docs.sparkSession):
        return _pack_documents(docs, tokenizer, id_column, text_column, capacity, end_id, rounds)


def _pack_documents(docs, tokenizer, id_column, text_column, capacity, end_id, rounds) -> DataFrame:
    kind = tokenizer_kind(tokenizer)
    id_type = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("key"), text_of(text_column).alias("text"))
    fields = f"key {id_type}, piece int, start long, length long, ids_crc32 long"
    pieces = stored(
        rows.mapInArrow(_pieces(tokenizer, kind, capacity, end_id), f"{fields}, rank long, part int"), "pieces"
    )
    counts = pieces.groupBy("length", "part").agg((F.max("rank") + 1).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "length-starts")
    histogram = {row[0]: row[1] for row in starts.groupBy("length").agg(F.sum("n")).collect()}
    solution = solve_histogram(histogram, capacity, rounds)
    return (
        pieces.join(starts.select("length", "part", "before"), ["length", "part"])
        .select("key", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank")).alias("place"))
        .mapInArrow(_places(solution), f"{fields}, sequence_id long, offset long")
        .withColumnRenamed("key", id_column)
    )
