"""Window and recursive chunks, keys, sizes."""

import hashlib

import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from chartloom.functions.chunking import check_chunk_sizes, model_chunker, recursive_chunker, word_or_run_count
from chartloom.operators import chunks
from chartloom.operators.changes import collapse_keys


def windows(tokens, size, overlap):
    found, start = [], 0
    while tokens:
        found.append(" ".join(tokens[start : start + size]))
        start += size - overlap
        if start + overlap >= len(tokens):
            return found
    return found


@pytest.mark.parametrize("size, overlap", [(1, 0), (3, 0), (4, 1), (5, 4), (50, 10)])
def test_fixed_windows_match_plain_python(spark, size, overlap):
    texts = ["", "  ", "a", "a b c", " a\tb\nc d  e f g h ", " ".join(map(str, range(37)))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, content string")
    got = [
        (r["doc_id"], r["content_chunked"], r["chunk_id"])
        for r in chunks.chunk_fixed(docs, size, overlap).collect()
    ]
    expected = [
        (i, c, hashlib.md5(c.encode()).hexdigest())
        for i, t in enumerate(texts) for c in windows(t.split(), size, overlap)
    ]
    assert sorted(got) == sorted(expected)


def test_windows_without_overlap_join_back(spark):
    text = " ".join(map(str, range(101)))
    docs = spark.createDataFrame([(text,)], "content string")
    joined = " ".join(r["content_chunked"] for r in chunks.chunk_fixed(docs, 7).collect())
    assert joined == text


TEXTS = st.text(alphabet="ab \n", max_size=400)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 12), st.integers(0, 12))
def test_recursive_chunks_fit_and_lose_no_word(text, size, overlap):
    overlap = min(overlap, size)
    found = recursive_chunker(size, overlap)(text)
    assert all(0 < len(c.split()) <= size for c in found)
    if overlap == 0 and size > 1:
        assert " ".join(found).split() == text.split()
    for word in text.split():
        assert any(word in c for c in found) or size == 1


@settings(max_examples=100, deadline=None)
@given(TEXTS, st.integers(2, 30), st.integers(0, 10))
def test_recursive_chunks_by_characters(text, size, overlap):
    found = recursive_chunker(size, min(overlap, size), length=len)(text)
    assert all(0 < len(c) <= size for c in found)


def test_recursive_chunks_prefer_coarse_cuts():
    text = "one two\n\nthree four five\n\nsix"
    assert recursive_chunker(4)(text) == ["one two", "three four five\n\nsix"]
    assert recursive_chunker(3)(text) == ["one two", "three four five", "six"]


def test_recursive_overlap_repeats_the_end():
    assert recursive_chunker(3, 1)("a b c d e") == ["a b c", "c d e"]


def test_apply_chunker_keeps_columns_and_skips_empty(spark):
    docs = spark.createDataFrame(
        [("u1", "a b c d", "S"), ("u2", "", "S"), ("u3", None, "S")],
        "doc_uri string, content string, parser_status string",
    )
    result = chunks.apply_chunker(docs, recursive_chunker(2))
    assert result.columns == ["chunk_id", "content_chunked", "doc_uri", "parser_status"]
    assert sorted(r["content_chunked"] for r in result.collect()) == ["a b", "c d"]


def test_size_checks(spark):
    check_chunk_sizes(400, 112, 512)
    with pytest.raises(ValueError, match="context window"):
        check_chunk_sizes(500, 100, 512)
    with pytest.raises(ValueError, match="exceeds chunk size"):
        check_chunk_sizes(10, 11)
    docs = spark.createDataFrame([("a b c d e",)], "content string")
    large = chunks.oversize_chunks(chunks.chunk_fixed(docs, 3), 2)
    assert [(r["content_chunked"], r["tokens"]) for r in large.collect()] == [("a b c", 3)]
    used = docs.select(chunks.window_usage(F.lit(1024), F.lit(256), F.lit(8192))).first()[0]
    assert used == round((1024 + 256) / 8192, 2) * 100


def test_collapse_keeps_the_first_source(spark):
    docs = spark.createDataFrame(
        [("u3", "same"), ("u1", "same"), ("u2", "other")], "doc_uri string, content string"
    )
    rows = collapse_keys(chunks.chunk_fixed(docs, 5)).collect()
    assert sorted((r["content_chunked"], r["doc_uri"]) for r in rows) == [("other", "u2"), ("same", "u1")]


def test_model_chunker():
    text = " ".join(map(str, range(600)))
    assert [len(c.split()) for c in model_chunker("bge-large-en-v1.5")(text)] == [512, 88]
    assert len(model_chunker("gte-large-en-v1.5", 200)(text)) == 3
    with pytest.raises(ValueError, match="context window"):
        model_chunker("bge-large-en-v1.5", 500, 100)
    with pytest.raises(ValueError, match="unknown embedding model"):
        model_chunker("nothing")


def test_runs_without_blanks_are_cut():
    text = "x" * 10_000 + " " + "word " * 50
    found = recursive_chunker(20)(text)
    assert max(word_or_run_count(chunk) for chunk in found) <= 20
    assert "".join(found).replace(" ", "") == text.replace(" ", "")


def test_texts_are_cut_a_few_bytes_at_a_time():
    texts = pa.array(["aaaa", None, "", "bbbbbbb", "c", None])
    assert list(chunks._few_bytes(texts, 4)) == [(0, 1), (1, 3), (4, 2)]
    assert list(chunks._few_bytes(texts.slice(2, 3), 100)) == [(0, 3)]
    assert list(chunks._few_bytes(texts.slice(0, 0))) == []
