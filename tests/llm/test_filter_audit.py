import random
from collections import Counter
from itertools import permutations

import pytest

from chartloom.llm.filter_audit import audit_filters, audit_orders, failure_counts, lehmer_rank, removal_intervals

DOCS, LABELS = "doc_id long, text string, lang string, mask int, n_chars long", "doc_id long, quality int, toxic int"


def test_rank_is_the_place_in_lexicographic_order():
    for n in range(1, 7):
        assert [lehmer_rank(order) for order in permutations(range(n))] == list(range(len(list(permutations(range(n))))))


@pytest.mark.parametrize("n", [1, 3, 5])
def test_intervals_cover_each_order_at_its_step_once(n):
    for mask in range(1, 1 << n):
        own = [(step, low, high) for m, step, low, high in removal_intervals(n) if m == mask]
        for rank, order in enumerate(permutations(range(n))):
            first = next(step for step, i in enumerate(order, 1) if mask >> i & 1)
            assert [step for step, low, high in own if low <= rank < high] == [first]


def texts(seed=4):
    rnd = random.Random(seed)
    words = ["plain", "Word", "words", "UPPER", "a|b", "#tag", "and", "so", "on"]
    made = [" ".join(rnd.choices(words, k=rnd.choice([0, 3, 150, 210]))) for _ in range(60)]
    made += [" ".join(f"{w}{i}" for i in range(230) for w in ("x",)) for _ in range(4)]
    made += ["", None, "\t\n", "a\x0bb\x0cc\xa0d", "x " * 50_000]
    return made + made[:20] + made[:3]


def brute(docs, labels):
    fails, first = [], {}
    for i, text, *_ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    for i, text, lang, *_ in docs:
        t = text or ""
        words = [w for w in t.encode().split()]
        bad = set()
        bad |= {"A"} if len(words) < 200 else set()
        bad |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        bad |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t) else set()
        bad |= {"D"} if any(c in "#$%&*|" for c in t) else set()
        bad |= {"E"} if i is not None and i > first[t] else set()
        own = [row for row in labels if row[0] == i and i is not None]
        fails.append((lang or "", bad, any(r[1] == 1 for r in own), any(r[2] == 1 for r in own)))
    rows = []
    for part in {f[0] for f in fails}:
        own, shapley, found = [f[1:] for f in fails if f[0] == part], Counter(), []
        for order in permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [f for f in left if letter in f[0]]
                left = [f for f in left if letter not in f[0]]
                shapley[letter] += len(gone)
                found.append((
                    part, "".join(order), step, len(left), len(gone), sum(letter in f[0] for f in own) - len(gone),
                    sum(f[0] == {letter} for f in own), sum(f[1] for f in gone), sum(f[2] for f in gone), letter,
                ))
        rows += [(*row[:-1], shapley[row[-1]]) for row in found]
    return sorted(rows)


def test_audit_equals_applying_every_order(spark):
    rnd = random.Random(9)
    docs = [
        (None if i % 17 == 5 else i if i % 13 else 7, text, rnd.choice(["en", "de", None, ""]), 1, 1) for i, text in enumerate(texts())
    ]
    docs += docs[:5]  # whole rows again
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in range(0, 90, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    result = audit_filters(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(tuple(r[n] for n in names) for r in result.collect()) == brute(docs, labels)


def test_no_documents_and_other_filters(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert audit_filters(docs, labels).count() == 0
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "abc", "en", 0, 0), (2, "x", "en", 0, 0)], DOCS)
    counts = failure_counts(docs, labels, {"L": F.length("text") > 2, "X": F.col("text") == "x"}, duplicates="")
    rows = {(r.filter_order, r.step): (r.kept, r.removed, r.shapley) for r in audit_orders(counts, "LX").collect()}
    assert rows == {("LX", 1): (1, 1, 2), ("LX", 2): (0, 1, 2), ("XL", 1): (1, 1, 2), ("XL", 2): (0, 1, 2)}
    with pytest.raises(ValueError):
        audit_orders(counts, "AA")
