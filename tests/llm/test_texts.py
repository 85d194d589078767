import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartloom.llm.decontaminate import common_words, find_leaks, latent_basis
from chartloom.llm.language_id import gram_keys, identify_languages, learn_profiles, text_profile
from chartloom.llm.license_scan import NOTICES, paragraphs, scan_licences
from chartloom.session import read_table

MEDIUM = "/root/testdata/sf0.01"


def test_languages_of_held_out_documents(spark):
    docs = read_table(spark, MEDIUM, "documents")
    got = identify_languages(docs)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = got.join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98


def test_odd_texts_and_languages(make_docs):
    rows = [(i, "the cat and the dog " * 5, "en") for i in range(12)] + [(i, "le chat et le chien été " * 5, "fr") for i in range(12, 24)]
    odd = [(30, None, "en"), (31, "", None), (32, "123 %%% \n", "fr"), (None, "le chat et le chien", "fr"), (33, "THE CAT", None), (33, "THE CAT", None)]
    odd += [(34, "日本語", None), (35, "the dog " * 200_000, None)]
    got = sorted(((-1 if r.doc_id is None else r.doc_id, r.lang_pred) for r in identify_languages(make_docs(rows + odd)).collect()))
    assert dict(got[1:])[35] == "en" and [p for k, p in got if k in (30, 31, 32)] == ["und"] * 3
    assert [p for k, p in got if k == 33] == ["en", "en"] and got[0] == (-1, "fr")
    assert all(p == ("en" if k < 12 else "fr") for k, p in got if 0 <= k < 24)
    assert {r.lang_pred for r in identify_languages(make_docs([(1, "word", None)])).collect()} == {"und"}
    assert identify_languages(make_docs([])).count() == 0


def test_profiles_rank_by_count_then_gram(make_docs):
    text = "ab ab ba"
    keys = gram_keys(text).tolist()
    order = sorted(set(keys), key=lambda k: (-keys.count(k), k))
    assert text_profile(text, 5).tolist() == order[:5]
    assert learn_profiles(make_docs([(1, text, "xx")]), length=5) == {"xx": order[:5]}


def by_hand(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_common_words():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = rng.integers(0, 8, rng.integers(1, 15)), rng.integers(0, 9, rng.integers(0, 25))
        length, start, end = common_words(a, b, 99)
        assert length == by_hand(a.tolist(), b.tolist())
        if length:
            assert 0 <= start < end <= len(b) and by_hand(a.tolist(), b[start:end].tolist()) == length


def test_basis_spans_the_passages(spark):
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 60, 30).astype("<u2") for _ in range(20)]
    frame = spark.createDataFrame([(t.tobytes(),) for t in texts], "words binary")
    basis = latent_basis(frame, np.ones(60), "<u2", 20)
    rows = np.array([np.bincount(t, minlength=60) for t in texts], float)
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    assert np.allclose(basis.T @ basis, np.eye(basis.shape[1]), atol=1e-6)
    assert np.linalg.norm(rows @ basis, axis=1) == pytest.approx(np.ones(20), abs=1e-6)


def test_leaks_of_whole_items_are_all_found(spark):
    docs, benchmark = read_table(spark, MEDIUM, "documents"), read_table(spark, MEDIUM, "benchmark")
    got = {(r.doc_id, r.item_id) for r in find_leaks(docs, benchmark).collect()}
    items = benchmark.collect()
    whole = {(d.doc_id, b.item_id) for d in docs.collect() for b in items if b.text in d.text}
    assert whole and whole <= got and len(got - whole) <= 0.05 * len(whole)


def test_paraphrases_and_odd_items(spark, make_docs):
    benchmark = read_table(spark, MEDIUM, "benchmark").orderBy("item_id").limit(6)
    texts = {r.item_id: r.text for r in benchmark.collect()}
    some = texts[0].split()
    changed = " ".join("other" if i % 7 == 3 else w for i, w in enumerate(some))
    filler = "nothing that any item says stands here at all " * 12
    rows = [(1, filler + changed + " " + filler), (2, filler), (3, None), (4, ""), (None, texts[1]), (5, " ".join(some[: len(some) // 3]))]
    rows += [(6, texts[2].upper()), (6, texts[2].upper())]
    odd = benchmark.unionByName(spark.createDataFrame([(90, None), (91, ""), (None, texts[1])], benchmark.schema)).withColumn("key", F.lit(1))
    got = sorted((str(r.doc_id), str(r.item_id)) for r in find_leaks(make_docs(rows), odd).collect())
    assert got == sorted([("1", "0"), ("None", "1"), ("None", "None"), ("6", "2"), ("6", "2")])
    assert find_leaks(make_docs([]), benchmark).count() == 0
    assert find_leaks(make_docs(rows), benchmark.limit(0)).count() == 0


def test_licence_lines_are_found_and_others_not(spark):
    docs = read_table(spark, MEDIUM, "documents")
    found = scan_licences(docs)
    got = {(r.doc_id, r.paragraph): r for r in found.collect()}
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "line"))
    known = lines.where("lower(line) rlike 'licen|rights reserved'").collect()
    assert known and {(r.doc_id, r.paragraph) for r in known} == set(got)
    assert all(r.confirmed for r in got.values())


def test_licences_of_odd_rows(make_docs):
    plain = [(i, "some ordinary words that nobody licenses\nand a second line") for i in range(30)]
    rows = plain + [(40, None), (41, ""), (None, "Released under the MIT License"), (42, "x " * 500 + NOTICES["apache"][0] + " y" * 500)]
    rows += [(43, "All rights reserved."), (43, "All rights reserved.")]
    got = sorted((str(r.doc_id), r.family) for r in scan_licences(make_docs(rows)).select("doc_id", "family").distinct().collect())
    assert got == [("42", "apache"), ("43", "proprietary"), ("None", "mit")]
    assert scan_licences(make_docs(rows)).where("doc_id = 43").count() == 2
    assert paragraphs(make_docs([(1, "a b\n\n \nc")]).select(F.col("doc_id").alias("key"), "text")).count() == 2


def test_whole_copies_of_a_mixed_benchmark_are_found_without_the_cosine(spark, make_docs):
    import random

    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    sizes = [1, 2, 3, 12, 12, 30, 300, 2_500] * 3
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate(sizes)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    around = lambda n: " ".join("x" + word() for _ in range(n))
    rows = [(100 + i, f"{around(77)} {text} {around(50)}") for i, text in items]
    for options in ({"cosine": 2.0}, {}):  # no cosine is 2
        got = {(x.doc_id, x.item_id) for x in find_leaks(make_docs(rows), benchmark, **options).collect()}
        assert {(100 + i, i) for i, _ in items} <= got


def test_paraphrases_are_found_beside_long_items(spark):
    """Every third word changed, items of 12 to 1,500 words in several parts; unlike texts hold nothing."""
    import random

    from chartloom.llm.decontaminate import find_leaks

    rng = random.Random(5)
    lexicon = ["".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(6_000)]
    sizes = [12] * 40 + [40] * 40 + [300] * 15 + [1_500] * 12

    def prose(n):
        words = rng.choices(lexicon, k=n)
        return [w + "." if i % 9 == 8 or i == n - 1 else w for i, w in enumerate(words)]

    items = [prose(n) for n in sizes]
    rows = []
    for i, words in enumerate(items):
        changed = [rng.choice(lexicon) if j % 3 == 2 else w for j, w in enumerate(words)]
        rows.append((i, " ".join(prose(60) + changed + prose(60))))
    rows += [(1_000 + i, " ".join(prose(300))) for i in range(60)] + [(None, " ".join(items[50])), (2_000, None)]
    bench = [(i, " ".join(words)) for i, words in enumerate(items)] + [(900, " ".join(items[50])), (901, None), (902, " ")]
    found = {
        (row.doc_id, row.item_id)
        for row in find_leaks(
            spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
        ).collect()
    }
    for size in set(sizes):
        of = [i for i, n in enumerate(sizes) if n == size]
        hits = sum((i, i) in found for i in of)
        print(size, hits, len(of))
        assert hits >= 0.9 * len(of), size
    assert {(None, 50), (None, 900)} <= found
    assert not any(doc is not None and doc >= 1_000 for doc, _ in found)
