"""Token counts of whole texts, huge ones by overlap resynchronisation.

Texts up to ``chunk_chars`` are encoded whole, each in its task. A longer text is cut into chunks that
reach ``overlap_chars`` into the next one, and the chunks are encoded with offsets in as many tasks. Two
neighbours are spliced at the first place in their overlap where both have a token boundary and which
is proven stable: a character that isn't white space before it and white space after it. No split piece
of a byte-level or word tokenizer reaches over such a place, whatever text surrounds it, so the tokens
behind it are those of the whole text. A text with an overlap without such a place goes again with an
overlap four times as wide, until the overlap is as long as the text, which is then encoded in one.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chartloom.llm.common import WHITE, slices, stored, text_of
from chartloom.llm.tokens import count_tokens as counts_of, load_tokenizer, tokenizer_kind

CHUNK_CHARS = 65_536
OVERLAP_CHARS = 1_024
STABLE = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])")


def splice_place(head: str, starts: set[int]) -> int:
    """First place of ``head`` that is a token boundary and proven stable; -1 if there is none."""
    for match in STABLE.finditer(head):
        if match.start() in starts:
            return match.start()
    return -1


def _count_rows(path: str, kind: str):
    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            counts = []
            for start, end in slices(texts, 500_000):
                counts += counts_of(path, kind, texts[start:end])
            keys = [batch.column(name) for name in batch.schema.names if name != "text"]
            names = [name for name in batch.schema.names if name != "text"]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(counts, pa.int64())], [*names, "n_tokens"])

    return run


def _count_chunks(path: str):
    """Tokens of a chunk between its two splices; null where an overlap has no stable place."""

    def run(batches):
        tokenizer = load_tokenizer(path)

        def starts_of(text):
            return [a for a, _ in tokenizer.encode(text, add_special_tokens=False).offsets]

        for batch in batches:
            counts = []
            for text, first, length, overlap in zip(
                *(batch.column(x).to_pylist() for x in ("text", "first", "length", "overlap"))
            ):
                starts = starts_of(text)
                here, end = set(starts), len(text)
                begin = 0 if first else splice_place(text[:overlap], here)
                if length < len(text):  # not the last chunk
                    head = text[length : length + overlap]
                    place = splice_place(head, set(starts_of(head)))
                    end = length + place if place >= 0 and length + place in here else -1
                counts.append(None if begin < 0 or end < 0 else sum(begin <= s < end for s in starts))
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"]
            )

    return run


def _huge_counts(texts: DataFrame, path: str, chunk_chars: int, overlap_chars: int) -> DataFrame:
    """``digest, n_tokens`` of distinct huge texts (``digest, text``)."""
    spark, done, overlap = texts.sparkSession, [], overlap_chars
    left, longest = texts, None
    while True:
        # Chunks of a text stay longer than the overlap, and one chunk holds what is no longer than it.
        size = max(chunk_chars, overlap)
        chunks = left.select(
            "digest", F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(size))).alias("start"), "text"
        ).select(
            "digest",
            F.substring("text", F.col("start") + 1, F.lit(size + overlap)).alias("text"),
            (F.col("start") == 0).alias("first"),
            F.least(F.lit(size), F.length("text") - F.col("start")).alias("length"),
            F.lit(overlap).alias("overlap"),
        )
        counted = stored(
            chunks.repartition("digest", "first", "length", F.xxhash64("text"))
            .mapInArrow(_count_chunks(path), "digest string, n_tokens long")
            .groupBy("digest")
            .agg(F.sum("n_tokens").alias("n_tokens"), (F.count("*") == F.count("n_tokens")).alias("whole")),
            "token-chunks",
        )
        done.append(counted.where("whole").select("digest", "n_tokens"))
        if counted.where("not whole").isEmpty():
            break
        left = texts.join(counted.where("not whole").select("digest"), "digest", "left_semi")
        overlap *= 4
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result


def count_tokens(
    docs: DataFrame,
    tokenizer: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    chunk_chars: int = CHUNK_CHARS,
    overlap_chars: int = OVERLAP_CHARS,
) -> DataFrame:
    """``<id>, n_bytes, n_tokens`` of every row, without begin, end or added special tokens.

    Null and empty texts have 0 bytes and 0 tokens; null ids and repeated rows give a row each; other
    columns are not looked at. ``tokenizer`` is a path to a ``.json`` (tokenizers) or ``.model``
    (sentencepiece) file that all executors have. Only tokenizers that split at white space are
    chunked; texts of others are encoded whole, however long.
    """
    kind = tokenizer_kind(tokenizer)
    rows = docs.select(
        F.col(id_column).alias("key"), text_of(text_column).alias("text")
    ).withColumn("n_bytes", F.octet_length("text").cast("long"))
    schema = f"key {docs.schema[id_column].dataType.simpleString()}, n_bytes long, n_tokens long"
    chunked = kind in ("pieces", "words")
    ordinary = rows.where(F.length("text") <= chunk_chars) if chunked else rows
    counted = ordinary.select("key", "n_bytes", "text").mapInArrow(_count_rows(tokenizer, kind), schema)
    if chunked:
        huge = rows.where(F.length("text") > chunk_chars).withColumn("digest", F.sha2("text", 256))
        texts = stored(huge.select("digest", "text").dropDuplicates(["digest"]), "huge-texts")
        if not texts.isEmpty():
            by_text = _huge_counts(texts, tokenizer, chunk_chars, overlap_chars)
            counted = counted.unionByName(
                huge.select("key", "n_bytes", "digest").join(by_text, "digest", "left").drop("digest")
            )
    return counted.withColumnRenamed("key", id_column)
