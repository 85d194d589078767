"""Benchmark decontamination by latent semantic retrieval.

Texts become numbers of the benchmark's words (all others are one unknown word), stored once; document
frequencies are counted over all of them. The TF-IDF passages of the benchmark are factorised by a
distributed randomised SVD: tasks multiply their passages with a random basis, the driver orthonormalises
the sums, and the rank grows until the space holds a stated share of the passages' norm. Every window of every
text is projected to that space and compared with every benchmark item, long ones passage by passage;
candidates by cosine, and by runs of words that they share, are checked by the longest common subsequence of words with the item, and by the
item's answer, its last sentence, so that paraphrases with words changed are found and chance is not.
A benchmark of any size is searched in parts of a bounded number of words, each with a space of its own.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chartloom.llm.common import slices, small_batches, stored, text_of

BLOCK = 16  # words; a window is two blocks
#: Least rank, doubled until the space holds this share of the squared norm of the passages.
RANK, NORM_SHARE = 256, 0.8
POWER_ROUNDS = 2
COSINE = 0.15
#: Words of a run that makes a candidate whatever its cosine is, and of how many runs of an item one has to be there.
#: A whole copy has all of them.
GRAM, ONE_OF = 3, 10
#: Aligned share of an item's words that is a leak by itself, and with that share of its answer.
SHARE, SHARE_WITH_ANSWER, ANSWER = 0.8, 0.6, 0.5
#: Items of up to so many words are one vector, longer ones one for each passage.
WHOLE_ITEM = 4 * BLOCK
#: Bytes of different item texts in a part, about; a part goes to the driver and to all tasks.
PART_BYTES = 100_000
#: Scores (4 bytes each) that a task holds at once.
MOST_SCORES = 8_000_000


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def _encode(vocabulary: dict[bytes, int]):
    """Word numbers of each text, the unknown word being the last number."""
    unknown = len(vocabulary)
    kind = "<u2" if unknown < 65_536 else "<u4"

    def run(batches):
        get = vocabulary.get
        for batch in batches:
            texts, keys = batch.column("text").to_pylist(), batch.column("key")
            for start, end in slices(texts):
                packed = []
                for text in texts[start:end]:
                    words = _words(text)
                    packed.append(np.fromiter((get(w, unknown) for w in words), kind, len(words)).tobytes())
                yield pa.RecordBatch.from_arrays([keys.slice(start, end - start), pa.array(packed, pa.binary())], ["key", "words"])

    return run


def _frequencies(n_terms: int, kind: str):
    def run(batches):
        counts = np.zeros(n_terms + 1, np.int64)
        for batch in batches:
            for raw in batch.column("words").to_pylist():
                counts[np.unique(np.frombuffer(raw, kind))] += 1
        term = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(term.astype(np.int64)), pa.array(counts[term])], ["term", "n"])

    return run


def _passages(ids: np.ndarray) -> list[np.ndarray]:
    if len(ids) <= 2 * BLOCK:
        return [ids] if len(ids) else []
    return [ids[i : i + 2 * BLOCK] for i in range(0, len(ids) - BLOCK, BLOCK)]


def _times_basis(basis: np.ndarray, idf: np.ndarray, kind: str):
    """Sums of ``x (x' basis)`` over the passages x of the rows, by term."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for raw in batch.column("words").to_pylist():
                for passage in _passages(np.frombuffer(raw, kind)):
                    terms, counts = np.unique(passage, return_counts=True)
                    x = counts * idf[terms]
                    x /= np.linalg.norm(x) or 1.0
                    along = x @ basis[terms]
                    for term, value in zip(terms.tolist(), x):
                        sums[term] = sums.get(term, 0.0) + value * along
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["term", "sums"]
            )

    return run


def _add_up(batches):
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for term, raw in zip(batch.column("term").to_pylist(), batch.column("sums").to_pylist()):
            sums[term] = sums.get(term, 0.0) + np.frombuffer(raw)
    if sums:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["term", "sums"]
        )


def latent_basis(
    passages: DataFrame, idf: np.ndarray, kind: str, rank: int = RANK, n_passages: int | None = None, norm_share: float = NORM_SHARE
) -> np.ndarray:
    """Right singular vectors (terms x rank) of the TF-IDF passages of ``words``, by randomised SVD. With the number
    of passages the rank doubles until they hold ``norm_share`` of the squared norm, which is one for each."""
    while True:
        basis, held = _basis_of_rank(passages, idf, kind, rank)
        if n_passages is None or held >= norm_share * n_passages or rank >= min(len(idf), n_passages):
            return basis
        rank *= 2


def _basis_of_rank(passages: DataFrame, idf: np.ndarray, kind: str, rank: int) -> tuple[np.ndarray, float]:
    n = len(idf)
    rank = min(rank, n)
    basis = np.linalg.qr(np.random.default_rng(7).standard_normal((n, rank)))[0]
    for _ in range(POWER_ROUNDS + 1):
        rows = (
            passages.mapInArrow(_times_basis(basis, idf, kind), "term long, sums binary")
            .repartition("term").mapInArrow(_add_up, "term long, sums binary").collect()  # one row a term
        )
        product = np.zeros((n, rank))
        for term, raw in rows:
            product[term] = np.frombuffer(raw)
        gram = basis.T @ product
        previous, basis = basis, np.linalg.qr(product)[0]
    values, vectors = np.linalg.eigh(gram)
    order = np.argsort(-values)
    return previous @ vectors[:, order[values[order] > 1e-9]], float(values.sum())


def common_words(item: np.ndarray, region: np.ndarray, unknown: int) -> tuple[int, int, int]:
    """Longest common subsequence of the words but the unknown one; start and end of it in the region."""
    best = np.zeros(len(region) + 1, np.int64)
    start = np.full(len(region) + 1, -1, np.int64)  # where the subsequence up to here begins
    places = np.arange(len(region))
    for word in item:
        if word == unknown:
            continue
        at = np.flatnonzero(region == word)
        if not len(at):
            continue
        gain = best[at] + 1
        begin = np.where(best[at] > 0, start[at], places[at])
        better = gain > best[at + 1]
        new, from_ = best.copy(), start.copy()
        new[at[better] + 1], from_[at[better] + 1] = gain[better], begin[better]
        top = np.maximum.accumulate(new)
        leader = np.maximum.accumulate(np.where(new == top, np.arange(len(new)), 0))
        best, start = top, from_[leader]
    length = int(best[-1])
    end = int(np.flatnonzero(best == length)[0]) if length else 0
    return length, int(start[end]), end


def _runs(ids: np.ndarray, size: int, unknown: int) -> np.ndarray:
    """Each run of ``size`` words as one number: three fit for two million different words."""
    total = ids[: max(0, len(ids) - size + 1)].astype(np.int64)
    for j in range(1, size):
        total = total * (unknown + 2) + ids[j : len(ids) - size + 1 + j]
    return total


def shared_runs(items: list[np.ndarray], unknown: int):
    """By size the sorted runs of the items with the items that have them, and the runs that each item needs.
    Items shorter than ``GRAM`` are one run."""
    tables, needed = [], np.zeros(len(items), np.int64)
    for size in range(1, GRAM + 1):
        own = [(i, np.unique(_runs(ids, size, unknown))) for i, ids in enumerate(items) if min(len(ids), GRAM) == size]
        if own:
            runs = np.concatenate([r for _, r in own])
            of = np.repeat(np.array([i for i, _ in own]), [len(r) for _, r in own])
            order = np.argsort(runs, kind="stable")
            tables.append((size, runs[order], of[order]))
            for i, r in own:
                needed[i] = max(1, len(r) // ONE_OF)
    return tables, needed


def _sharing(ids: np.ndarray, tables, needed, unknown: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and items of the runs that a text shares with items, of items of which it has enough runs."""
    places, found, votes = [], [], np.zeros(len(needed), np.int64)
    for size, runs, of in tables:
        mine = _runs(ids, size, unknown)
        low = np.searchsorted(runs, mine)
        at = np.flatnonzero(runs[np.minimum(low, len(runs) - 1)] == mine)
        if not len(at):
            continue
        low, high = low[at], np.searchsorted(runs, mine[at], side="right")
        n = high - low
        entry = np.repeat(low - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        votes += np.bincount(of[np.unique(entry)], minlength=len(needed))  # distinct runs of each item
        places.append(np.repeat(at, n))
        found.append(of[entry])
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    places, found = np.concatenate(places), np.concatenate(found)
    enough = votes[found] >= needed[found]
    return places[enough], found[enough]


def _search(projection, weights2, items, latent, item_of, kind, unknown, cosine):
    """``latent`` holds the items' vectors, ``item_of`` the item of each."""
    rank = projection.shape[1]
    tables, needed = shared_runs([words for words, _ in items], unknown)
    step = min(4_096, max(64, MOST_SCORES // max(1, len(latent))))
    met = np.zeros(unknown + 2, bool)

    def can_share(words: np.ndarray, region: np.ndarray) -> bool:
        """Whether the region has enough of the item's words for a leak, in any order."""
        met[region] = True
        many = int(met[words].sum())
        met[region] = False
        return many >= SHARE_WITH_ANSWER * len(words)

    def leaks(ids: np.ndarray):
        n = len(ids)
        blocks = max(2, -(-n // BLOCK))
        padded = np.full(blocks * BLOCK, unknown + 1)
        padded[:n] = ids
        hits: dict[int, list[tuple[float, int]]] = {}
        places, sharing = _sharing(ids, tables, needed, unknown)
        shared = np.unique(np.stack((np.minimum(places // BLOCK, blocks - 2), sharing)), axis=1)
        for first in range(0, blocks - 1, step):  # so that a huge text is never projected at once
            last = min(first + step + 1, blocks)
            part = padded[first * BLOCK : last * BLOCK]
            sums = projection[part].reshape(last - first, BLOCK, rank).sum(axis=1)
            mass = weights2[part].reshape(last - first, BLOCK).sum(axis=1)
            windows, norms = sums[:-1] + sums[1:], np.sqrt(np.maximum(mass[:-1] + mass[1:], 1e-12))
            scores = windows @ latent.T
            scores /= norms[:, None].astype(np.float32)
            window, vector = np.nonzero(scores >= cosine)
            for at, item, score in zip((first + window).tolist(), item_of[vector].tolist(), scores[window, vector].tolist()):
                hits.setdefault(item, []).append((score, at))
            here = shared[:, (shared[0] >= first) & (shared[0] < last - 1)]
            for at, item in zip(here[0].tolist(), here[1].tolist()):
                of = np.searchsorted(item_of, (item, item + 1))
                hits.setdefault(item, []).append((float(scores[at - first, of[0] : of[1]].max()), at))
        for item, windows in hits.items():
            words, answer = items[item]
            best = None
            # Windows in a row are one region, which reaches an item's length to both sides.
            windows.sort(key=lambda x: x[1])
            regions: list[list[float]] = []
            for score, window in windows:
                if regions and window - regions[-1][1] <= 2:
                    regions[-1][1], regions[-1][2] = window, max(regions[-1][2], score)
                else:
                    regions.append([window, window, score])
            for low, high, score in regions:
                start = max(0, int(low) * BLOCK - len(words))
                region = ids[start : int(high) * BLOCK + 2 * BLOCK + len(words)]
                if not can_share(words, region):
                    continue
                common, begin, end = common_words(words, region, unknown)
                share = common / len(words)
                if share < SHARE_WITH_ANSWER:
                    continue
                told = common_words(answer, region[begin:end], unknown)[0] / len(answer)
                if share >= SHARE or told >= ANSWER:
                    best = max(best or (0.0,), (share, told, score, start + begin, start + end))
            if best:
                yield item, best

    def run(batches):
        for batch in batches:
            rows = []
            for key, raw in zip(batch.column("key").to_pylist(), batch.column("words").to_pylist()):
                rows += [(key, item, *best) for item, best in leaks(np.frombuffer(raw, kind).astype(np.int64))]
            if rows:
                kinds = (batch.schema.field("key").type, pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["key", "item", "share", "answer", "cosine", "start_word", "end_word"]
                )

    return run


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    cosine: float = COSINE,
    rank: int = RANK,
) -> DataFrame:
    """``<id>, <item>, lcs_share, answer_share, cosine, start_word, end_word``: the best place of each benchmark
    item that a text holds, in its words or with some of them changed.

    Null and empty texts hold nothing; null and empty items are held by nothing; null ids and repeated rows
    are searched like any other; an empty benchmark finds nothing. Other columns are not looked at.
    ``rank`` is the least one of the latent space. The texts are read once for each part of the benchmark.
    """
    with small_batches(docs.sparkSession):
        return _find_leaks(docs, benchmark, id_column, text_column, item_column, item_text_column, cosine, rank)


def _find_leaks(docs, benchmark, id_column, text_column, item_column, item_text_column, cosine, rank) -> DataFrame:
    spark = docs.sparkSession
    id_type = docs.schema[id_column].dataType.simpleString()
    item_type = benchmark.schema[item_column].dataType.simpleString()
    schema = f"{id_column} {id_type}, {item_column} {item_type}, lcs_share double, answer_share double, cosine double, start_word long, end_word long"
    rows = docs.select(F.col(id_column).alias("key"), text_of(text_column).alias("text"))
    asked = benchmark.select(F.col(item_column).alias("name"), F.col(item_text_column).alias("text")).where("text is not null")
    asked = stored(asked.withColumn("digest", F.sha2("text", 256)), "benchmark-items")
    texts = stored(asked.select("digest", "text").dropDuplicates(["digest"]), "benchmark-texts")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts, found = -(-size // PART_BYTES), []
    for part in range(parts):
        own = texts.where(F.pmod(F.xxhash64("digest"), F.lit(parts)) == part)
        hits = _part_leaks(spark, rows, own, id_type, cosine, rank)
        if hits is not None:
            found.append(stored(hits, "part-leaks"))
    if not found:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, found).join(asked.select("digest", "name"), "digest").select(
        F.col("key").alias(id_column), F.col("name").alias(item_column), F.round("share", 6).alias("lcs_share"),
        F.round("answer", 6).alias("answer_share"), F.round("cosine", 4).alias("cosine"), "start_word", "end_word",
    )


def _part_leaks(spark, rows, texts, id_type, cosine, rank) -> DataFrame | None:
    """``key, digest, share, answer, cosine, start_word, end_word`` of the leaks of a part of the item texts."""
    found = sorted((digest, text, _words(text)) for digest, text in texts.collect())  # about PART_BYTES
    found = [(digest, text, words) for digest, text, words in found if words]
    if not found:
        return None
    vocabulary = {word: i for i, word in enumerate(sorted({w for _, _, words in found for w in words}))}
    unknown = len(vocabulary)
    kind = "<u2" if unknown < 65_536 else "<u4"
    encoded = stored(rows.mapInArrow(_encode(vocabulary), f"key {id_type}, words binary"), "encoded-texts")
    counted = encoded.mapInArrow(_frequencies(unknown, kind), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    total, counts = encoded.count(), np.zeros(unknown + 1)
    for term, n in counted:  # one row a term
        counts[term] = n
    idf = np.log((total + 1) / (counts + 1)) + 0.1
    idf[unknown] = np.log(total + 1) + 0.1  # each unknown word is taken for a rare one
    items = []
    for _, text, words in found:
        sentences = [s for s in re.split(r"(?<=[.!?])\s+", text) if s.split()]
        items.append((np.array([vocabulary[w] for w in words]), np.array([vocabulary[w] for w in _words(sentences[-1])])))
    passages = texts.select(F.lit(0).alias("key"), "text").mapInArrow(_encode(vocabulary), "key int, words binary")
    n_passages = sum(len(_passages(ids)) for ids, _ in items)
    basis = latent_basis(stored(passages, "benchmark-passages"), idf[:unknown], kind, rank, n_passages)
    projection = np.zeros((unknown + 2, basis.shape[1]), np.float32)  # unknown words and padding have no part in it
    projection[:unknown] = idf[:unknown, None] * basis
    latent, item_of = [], []
    for item, (ids, _) in enumerate(items):
        for passage in [ids] if len(ids) <= WHOLE_ITEM else _passages(ids):
            along = projection[passage].sum(axis=0)
            latent.append(along / (np.linalg.norm(along) or 1.0))
            item_of.append(item)
    hits = encoded.mapInArrow(
        _search(projection, np.append(idf**2, 0.0), items, np.array(latent, np.float32), np.array(item_of), kind, unknown, cosine),
        f"key {id_type}, item long, share double, answer double, cosine double, start_word long, end_word long",
    )
    digests = spark.createDataFrame([(i, digest) for i, (digest, _, _) in enumerate(found)], "item long, digest string")
    return hits.join(F.broadcast(digests), "item").drop("item")
