"""Language identification by rank-order profiles of character n-grams.

A profile lists the most frequent n-grams (one to three characters, word ends included) of a language in
order of frequency. A text goes to the language whose profile is nearest to its own by out-of-place
distance: the sum, over the text's profile, of how far each n-gram is from its place in the language's
profile, and the profile length for n-grams that are not in it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from chartloom.llm.common import give_back, slices, text_of, worker_store

PROFILE = 300
UNKNOWN = "und"
#: Distinct n-grams that a task holds before it passes their counts on.
MOST_HELD = 500_000


def held_out(id_column: str) -> Column:
    """crc32 of the id as text divides by 5: these documents are never learnt from."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _letters() -> np.ndarray:
    return worker_store(
        "letters", lambda: np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    )


def gram_keys(text: str) -> np.ndarray:
    """All n-grams of a text as integers: 21 bits a character, 1 for a word end, 0 for no character."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    codes = np.concatenate(([1], np.where(_letters()[codes], codes, 1), [1]))
    ends = codes == 1
    codes = codes[~(ends & np.concatenate(([False], ends[:-1])))]
    if len(codes) < 3:
        return np.empty(0, np.int64)
    inner = codes != 1
    one = codes[inner] << 42
    two = (codes[:-1] << 42) | (codes[1:] << 21)
    three = ((codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:])[inner[1:-1]]
    return np.concatenate((one, two, three))


def _tally(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[at], np.diff(np.append(at, len(keys)))


def text_profile(text: str, length: int) -> np.ndarray:
    """The most frequent n-grams, equal counts in order of their keys."""
    keys = gram_keys(text)
    if not len(keys):
        return keys
    keys, counts = _tally(keys)
    return keys[np.argsort(-counts, kind="stable")[:length]]


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def rows():
        for lang, (keys, counts) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys), pa.array(counts)], ["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
        for start, end in slices(texts, 300_000):
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(langs[start:end], texts[start:end]):
                by_lang.setdefault(lang, []).append(text)
            for lang, some in by_lang.items():
                keys = gram_keys("\n".join(some))
                if not len(keys):
                    continue
                keys, counts = _tally(keys)
                if lang in held:
                    more, n = held[lang]
                    keys, back = np.unique(np.concatenate((more, keys)), return_inverse=True)
                    counts = np.bincount(back, np.concatenate((n, counts))).astype(np.int64)
                held[lang] = keys, counts
            if sum(len(keys) for keys, _ in held.values()) > MOST_HELD:
                yield from rows()
    yield from rows()
    give_back()


def learn_profiles(
    docs: DataFrame, lang_column: str = "lang", text_column: str = "text", length: int = PROFILE
) -> dict[str, list[int]]:
    """Profile of each language from all given documents; rows without a language or text are left out.

    The driver gets ``length`` n-grams for each language.
    """
    counted = (
        docs.select(F.col(lang_column).cast("string").alias("lang"), F.col(text_column).alias("text"))
        .where("lang is not null and text is not null")
        .mapInArrow(_count_grams, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    ranked = counted.withColumn("place", place).where(F.col("place") <= length)
    profiles: dict[str, dict[int, int]] = {}
    for lang, gram, place in ranked.select("lang", "gram", "place").collect():
        profiles.setdefault(lang, {})[place] = gram
    return {lang: [grams[i] for i in sorted(grams)] for lang, grams in sorted(profiles.items())}


def _predictor(profiles: dict[str, list[int]], length: int):
    langs = list(profiles)
    grams = np.unique(np.array([g for p in profiles.values() for g in p], np.int64))
    places = np.full((len(langs), len(grams) + 1), -1, np.int64)
    for i, profile in enumerate(profiles.values()):
        places[i, np.searchsorted(grams, np.array(profile, np.int64))] = np.arange(len(profile))

    def predict(text: str) -> tuple[str, float]:
        own = text_profile(text, length)
        if not len(own) or not langs:
            return UNKNOWN, 0.0
        at = np.searchsorted(grams, own)
        at[(at == len(grams)) | (grams[np.minimum(at, len(grams) - 1)] != own)] = len(grams)
        theirs = places[:, at]
        apart = np.where(theirs >= 0, np.minimum(np.abs(theirs - np.arange(len(own))), length), length).sum(axis=1)
        best = int(apart.argmin())
        return langs[best], 1.0 - float(apart[best]) / (length * len(own))

    return predict


def _nearest(profiles: dict[str, list[int]], length: int):
    predict = _predictor(profiles, length)

    def run(batches):
        for batch in batches:
            predicted = [predict(str(text)) for text in batch.column("text")]
            rest = [name for name in batch.schema.names if name != "text"]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(name) for name in rest),
                    pa.array([p[0] for p in predicted], pa.string()),
                    pa.array([p[1] for p in predicted], pa.float64()),
                ],
                [*rest, "lang_pred", "score"],
            )

    return run


def language_column(profiles: dict[str, list[int]], text_column: str = "text", length: int = PROFILE) -> Column:
    """Struct ``lang_pred, score`` of each text, as ``identify`` gives them; the other columns stay in the JVM."""
    predict = _predictor(profiles, length)

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def run(texts: pa.Array) -> pa.Array:
        found = [predict(str(text)) for text in texts]
        return pa.StructArray.from_arrays(
            [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["lang_pred", "score"]
        )

    return run(text_of(text_column))


def identify(
    docs: DataFrame,
    profiles: dict[str, list[int]],
    text_column: str = "text",
    carry: dict[str, Column] | None = None,
    length: int = PROFILE,
) -> DataFrame:
    """The columns of ``carry``, ``lang_pred`` and ``score`` of every row.

    ``score`` is 1 less the out-of-place distance divided by the largest possible one. Null and empty
    texts, texts without a letter, and all texts when no profile was learnt get ``und`` and 0; equal
    distances go to the language first in the alphabet. Ids may be null and rows may repeat.
    """
    carry = carry if carry is not None else {"doc_id": F.col("doc_id")}
    rows = docs.select(*(column.alias(name) for name, column in carry.items()), text_of(text_column).alias("text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("text").schema)
    return rows.mapInArrow(_nearest(profiles, length), f"{fields}, lang_pred string, score double")


def identify_languages(docs: DataFrame, id_column: str = "doc_id", length: int = PROFILE) -> DataFrame:
    """``<id>, held_out, lang_pred, score``, learnt from the labelled documents that are not held out."""
    learnt_from = docs.where(F.col(id_column).isNotNull() & ~held_out(id_column))
    profiles = learn_profiles(learnt_from, length=length)
    return identify(docs, profiles, carry={id_column: F.col(id_column), "held_out": held_out(id_column)}, length=length)
