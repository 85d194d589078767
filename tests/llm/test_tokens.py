import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from chartloom.llm.packing import knapsack, pack_documents, solve_histogram
from chartloom.llm.queries import tokenizer_path
from chartloom.llm.token_counts import count_tokens, splice_place
from chartloom.llm.tokens import PieceCounts, WordIds

BYTES, WORDS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")


def odd_texts(n):
    rnd = random.Random(3)
    parts = list("abcXYZ éÉßçσΣİıñ.,,..  \n\n\t \u00a0\u2003\u3000\x1c\x1f\x85'sS'tll0123½²一二ا́̇-_!?#$%|") + [
        "<|endoftext|>", "<|startoftext|>", "'re", " the ", " and.", "’s"
    ]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


def test_pieces_and_words_are_those_of_the_library():
    texts = odd_texts(5_000)
    whole = Tokenizer.from_file(BYTES).encode_batch_fast(texts, add_special_tokens=False)
    assert PieceCounts(BYTES).counts(texts) == [len(e.ids) for e in whole]
    whole = Tokenizer.from_file(WORDS).encode_batch_fast(texts, add_special_tokens=False)
    assert WordIds(WORDS).ids(texts) == [np.array(e.ids, "<u4").tobytes() for e in whole]


def test_splice_place():
    assert splice_place("ab cd", {2}) == 2
    assert splice_place("ab cd", {1}) == -1
    assert splice_place("abcd", {0, 1, 2}) == -1


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_chunked_counts_are_whole_counts(spark, make_docs, path):
    words = " ".join(odd_texts(400))
    rows = [(1, words), (2, None), (3, ""), (None, "a b"), (1, words), (4, "x" * 3_000), (5, "ab " * 2_000 + "y" * 900), (6, "one two")]
    expected = sorted(
        (k or -1, len((t or "").encode()), len(Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids)) for k, t in rows
    )
    got = count_tokens(make_docs(rows), path, chunk_chars=500, overlap_chars=16)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens"]
    assert sorted((r[0] or -1, r[1], r[2]) for r in got.collect()) == expected


def test_counts_of_other_tokenizers_and_no_rows(spark, make_docs):
    model = tokenizer_path("piece_bpe_32k.model")
    assert [r.n_tokens > 0 for r in count_tokens(make_docs([(1, "a word or two")]), model).collect()] == [True]
    assert count_tokens(make_docs([]), BYTES).count() == 0


def test_knapsack_is_best():
    rnd = random.Random(5)
    for _ in range(20):
        lengths = np.array(sorted(rnd.sample(range(1, 30), 5)))
        values = np.array([rnd.random() for _ in lengths])
        best = [0.0] * 41
        for room in range(1, 41):
            best[room] = max([best[room - 1], *(best[room - l] + v for l, v in zip(lengths, values) if l <= room)])
        taken = knapsack(lengths, values, 40)
        assert sum(l * k for l, k in taken.items()) <= 40
        assert sum(values[list(lengths).index(l)] * k for l, k in taken.items()) == pytest.approx(best[40])


@pytest.mark.parametrize("n", [0, 1, 40, 4_000])
def test_solution_uses_every_piece_once(n):
    rnd = random.Random(n)
    histogram = defaultdict(int)
    for _ in range(n):
        histogram[min(256, 1 + int(rnd.expovariate(1 / 60)))] += 1
    used, sequences = defaultdict(int), 0
    for configuration, many in solve_histogram(dict(histogram), 256):
        assert sum(length * k for length, k in configuration) <= 256
        sequences += many
        for length, k in configuration:
            used[length] += k * many
    assert dict(used) == dict(histogram)
    least = -(-sum(length * k for length, k in histogram.items()) // 256)
    assert least <= sequences <= least * 1.01 + 2


def test_packed_pieces(spark, make_docs):
    rows = [(i, " ".join(odd_texts(i % 40))) for i in range(80)] + [(None, None), (3, ""), (200, "word " * 700)]
    got = pack_documents(make_docs(rows), WORDS, capacity=64)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    library, expected = Tokenizer.from_file(WORDS), []
    for key, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        for piece, at in enumerate(range(0, len(ids), 64)):
            part = np.array(ids[at : at + 64], "<u4")
            expected.append((str(key), piece, at, len(part), zlib.crc32(part.tobytes())))
    pieces = got.collect()
    assert sorted((str(r[0]), *r[1:5]) for r in pieces) == sorted(expected)
    sequences = defaultdict(list)
    for r in pieces:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert pack_documents(make_docs([]), WORDS).count() == 0


def test_known_words_are_looked_up_and_not_gone_over(monkeypatch):
    class Known(dict):
        def keys(self):
            raise AssertionError("all that is known was gone over")

    words = WordIds(WORDS)
    words.known = Known()
    texts = ["two words, two.", "two more words and l'été 12 猫"]
    for text in [*texts, *texts]:
        expected = Tokenizer.from_file(WORDS).encode(text, add_special_tokens=False).ids
        assert words.ids([text]) == [np.array(expected, "<u4").tobytes()]


def test_a_worker_forgets_words_after_a_task(monkeypatch):
    import pyarrow as pa

    from chartloom.llm import packing
    from chartloom.llm.common import worker_store

    class Context:
        get = classmethod(lambda cls: cls())
        partitionId = lambda self: 0

    monkeypatch.setattr(packing, "TaskContext", Context)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["some words"])], ["key", "text"])
    rows = [row for out in packing._pieces(WORDS, "words", 2_048, 0)(iter([batch])) for row in out.to_pylist()]
    assert len(rows) == 1 and not worker_store(f"ids {WORDS}", dict).known
