import hashlib
import random
import re
import struct
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from chartloom.llm import substring_dedup
from chartloom.llm.components import components
from chartloom.llm.fingerprints import GRAM, WINDOW, fingerprint_edits
from chartloom.llm.jaccard_join import near_copies
from chartloom.llm.substring_dedup import align, chains, cut_passages, remove_passages, repeated_passages
from chartloom.session import read_table

rnd = random.Random(11)


def prose(n, r=rnd):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


def edited(text, edits, r=rnd):
    words = text.split()
    for at in r.sample(range(len(words)), edits):
        words[at] = "changed" + str(r.random())
    return " ".join(words)


@pytest.fixture(scope="module")
def copies():
    """Exact and near copies, a large group of near copies of which most link with few, passages, odd rows."""
    bases = [prose(n) for n in (3, 5, 30, 80, 150, 400)]
    texts = bases + [b.upper() for b in bases] + bases
    texts += [edited(bases[4], n % 9) for n in range(150)]
    texts += [edited(bases[5], n) for n in range(0, 60, 3)]
    passage = prose(70)
    texts += [f"{prose(60)} {passage} {prose(40)}" for _ in range(40)]
    texts += [None, "", " \n\t", "one", "ONE", "one two", None]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    return rows + [(None, bases[3]), (None, ""), (rows[3][0], bases[3])]


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_copies_against_brute_force(make_docs, copies):
    got = near_copies(make_docs(copies))
    assert got.columns == ["doc_id", "n_shingles", "digest", "component_id"]
    sets = [shingles(t) for _, t in copies]
    parent = list(range(len(copies)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                parent[top(i)] = top(j)
    smallest = defaultdict(lambda: 1 << 60)
    for i, (key, _) in enumerate(copies):
        if key is not None:
            smallest[top(i)] = min(smallest[top(i)], key)
    expected = []
    for i, (key, _) in enumerate(copies):
        own = key if not sets[i] else smallest[top(i)]
        expected.append((str(key), len(sets[i]), str(own)))
    assert sorted((str(r[0]), r[1], str(r[3])) for r in got.collect()) == sorted(expected)


def test_near_copies_of_nothing(make_docs):
    assert near_copies(make_docs([])).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, 101), (102, 101), (7, 7)]
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {**{i: 0 for i in range(21)}, 100: 100, 101: 100, 102: 100}


def test_chains_skip_what_is_out_of_order():
    anchors = np.array([(0, 50, 10), (12, 62, 10), (15, 5, 8), (30, 80, 10), (500, 90, 10)])
    assert chains(anchors)[0] == [0, 1, 3]
    assert sorted(i for chain in chains(anchors) for i in chain) == [0, 1, 2, 3, 4]


def test_alignment_extends_and_counts():
    a = np.arange(60, dtype=np.uint32)
    b = a.copy()
    b[30] = 999
    assert align(a, b, np.array([(5, 5, 10), (40, 40, 10)])) == (0, 60, 0, 60, 59)


def test_repeated_passages(spark, make_docs):
    passage = prose(70)
    fuzzy = edited(passage, 3)
    rows = [(i, f"{prose(50)} {passage if i % 2 else fuzzy} {prose(30)}") for i in range(1, 12)]
    clean = [(i, prose(200)) for i in range(20, 40)] + [(40, "the same short line here " * 2), (41, "the same short line here " * 2)]
    odd = [(50, None), (51, ""), (None, passage), (52, passage.upper()), (53, "the " * 300), (53, "the " * 300)]
    docs = make_docs(rows + clean + odd)
    got = repeated_passages(docs).collect()
    assert {r.doc_id for r in got} == {*range(2, 12), 52}
    assert all(r.first_doc_id < r.doc_id for r in got)
    words = {k: (t or "").lower().split() for k, t in rows + clean + odd if k is not None}
    wanted = (set(passage.split()), set(fuzzy.split()))
    for r in got:
        span = words[r.doc_id][r.start_word : r.end_word]
        assert len(span) >= 50 and r.identity >= 0.8
        assert any(len(set(span) & w) >= 0.7 * len(w) for w in wanted)
    left = {r.doc_id: r.text for r in remove_passages(docs, repeated_passages(docs)).where("doc_id is not null").collect()}
    assert left[1] == rows[0][1] and 52 not in left and left[51] == "" and left[50] is None
    assert all(78 <= len(left[i].split()) <= 100 for i in range(2, 12))
    assert all(left[k] == t for k, t in clean)
    assert repeated_passages(make_docs([])).count() == 0


def test_recall_of_fuzzy_passages(make_docs):
    r = random.Random(5)
    rows, planted = [], {}
    for length in (50, 60, 100):
        for percent in (80, 85, 90, 95):
            for _ in range(10):
                passage, key = prose(length, r), 2 * len(planted)
                rows.append((key, f"{prose(60, r)} {passage} {prose(60, r)}"))
                rows.append((key + 1, f"{prose(80, r)} {edited(passage, length * (100 - percent) // 100, r)} {prose(80, r)}"))
                planted[key + 1] = (80, 80 + length)
    found = defaultdict(int)
    for x in repeated_passages(make_docs(rows)).collect():
        assert (x.doc_id, x.first_doc_id) == (x.first_doc_id + 1, x.doc_id - 1) and x.identity >= 0.8
        low, high = planted[x.doc_id]
        found[x.doc_id] = max(found[x.doc_id], min(x.end_word, high) - max(x.start_word, low))
    assert sum(found[k] >= 0.8 * (b - a) for k, (a, b) in planted.items()) >= 0.98 * len(planted)


def test_passages_made_of_parts_of_different_documents(make_docs):
    r = random.Random(7)
    rows, planted = [], []
    for sizes in [(25, 25), (33, 33), (40, 40), (49, 49), (30, 30, 30), (20, 45, 20)] * 3:
        parts, key = [prose(n, r) for n in sizes], 10 * len(planted)
        rows += [(key + i, f"{prose(30, r)} {part} {prose(30, r)}") for i, part in enumerate(parts)]
        rows += [(key + i, f"{prose(30 + i, r)} {' '.join(parts)} {prose(30, r)}") for i in (5, 6)]
        planted.append((key + 6, key + 5, 36, 36 + sum(sizes)))
    got = repeated_passages(make_docs(rows)).collect()
    for doc, first, low, high in planted:
        assert any((x.doc_id, x.first_doc_id) == (doc, first) and x.start_word <= low and x.end_word >= high for x in got)


def test_passages_with_words_left_out_and_a_far_chance_match(make_docs):
    r = random.Random(6)
    words, more = prose(70, r).split(), prose(12, r)
    fewer = [w for i, w in enumerate(words) if i % 9]
    rows = [(1, f"{' '.join(words)} {prose(60, r)} {more} {prose(9, r)}"), (2, f"{' '.join(fewer)} {prose(60, r)} {more} {prose(9, r)}")]
    got = repeated_passages(make_docs(rows)).collect()
    assert [r.doc_id for r in got] == [2] and got[0].start_word <= 2 and 58 <= got[0].end_word <= 75


def test_long_copies_are_whole_passages(make_docs):
    text = prose(30_000)
    got = repeated_passages(make_docs([(2, text), (1, text)])).collect()
    assert [(r.doc_id, r.start_word, r.end_word, r.first_doc_id) for r in got] == [(2, 0, 30_000, 1)]


def test_cut_passages():
    assert cut_passages("a b\nc d e\nf", [(2, 4)]) == "a b\ne\nf"
    assert cut_passages("a b", [(0, 2)]) == ""
    assert cut_passages("a b c d", [(0, 2), (1, 3), (9, 12)]) == "d"


def kept(text):
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", (text or "").lower()) if w]
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    if not hashes:
        return []
    if len(hashes) < GRAM:
        signed = (str(h - (1 << 64) if h >> 63 else h) for h in hashes)
        runs = [xxhash.xxh64_intdigest(" ".join(signed).encode(), 42)]
    else:
        runs = []
        for i in range(len(hashes) - GRAM + 1):
            value = 42
            for h in hashes[i : i + GRAM]:
                value = xxhash.xxh64_intdigest(struct.pack("<Q", h), value)
            runs.append(value)
    runs, found = [r >> 27 for r in runs], []
    for i in range(max(1, len(runs) - WINDOW + 1)):
        window = runs[i : i + WINDOW]
        at = max(j for j, r in enumerate(window) if r == min(window)) + i
        if not found or found[-1][1] != at:
            found.append((runs[at], at))
    return found


def alike(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def check_fingerprints(docs, rows):
    rows = sorted(((k, t or "") for k, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    expected = []
    for i, (key, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        cut = len(text) // 3
        new = text[: len(text) - cut] + after[:cut]
        digest = hashlib.sha256(new.encode()).hexdigest()
        near = round(alike(kept(text), kept(new)), 9), round(alike(kept(text), kept(after)), 9)
        expected.append(str((key, len(text), digest, kept(text), kept(new), *near)))
    got = fingerprint_edits(docs)
    found = [
        str((r.doc_id, r.n_chars, r.edited_sha256, [tuple(x) for x in r.fingerprint], [tuple(x) for x in r.edited_fingerprint], round(r.near_edited, 9), round(r.near_next, 9)))
        for r in got.collect()
    ]
    assert sorted(found) == sorted(expected)


def test_fingerprints_against_brute_force(make_docs, copies):
    check_fingerprints(make_docs(copies), copies)
    rows = [(i * i * 1_000_003, prose(n)) for i, n in enumerate((0, 1, 4, 5, 20, 21, 300))] + [(-5, "été " * 40), (8, None)]
    check_fingerprints(make_docs(rows), rows)
    check_fingerprints(make_docs(rows[:1]), rows[:1])
    assert fingerprint_edits(make_docs([])).count() == 0


def test_fingerprints_of_the_documents_table(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    check_fingerprints(docs, [(r.doc_id, r.text) for r in docs.collect()])


def test_fingerprints_run_without_python(make_docs, copies):
    plan = fingerprint_edits(make_docs(copies))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_near_copies_do_not_depend_on_buckets(make_docs, copies, monkeypatch):
    """Many small buckets in a partition, and lots of a few tokens, give the same classes and components."""
    whole = sorted(map(str, near_copies(make_docs(copies)).collect()))
    monkeypatch.setattr("chartloom.llm.jaccard_join.BUCKET_BYTES", 2_000)
    assert sorted(map(str, near_copies(make_docs(copies)).collect())) == whole


def test_may_hold_never_refuses_a_passage():
    from chartloom.llm.substring_dedup import may_hold

    r = random.Random(4)
    for _ in range(300):
        n = r.randint(50, 120)
        passage = np.array([r.randrange(5_000) for _ in range(n)], np.uint32)
        other = passage.copy()
        other[r.sample(range(n), int(n * 0.2))] += 10_000
        around = lambda: np.array([r.randrange(20_000, 90_000) for _ in range(r.randint(0, 90))], np.uint32)
        assert may_hold(np.concatenate([around(), passage, around()]), np.concatenate([around(), other, around()]), 50, 0.8)
    assert not may_hold(np.arange(200, dtype=np.uint32), np.arange(1_000, 1_200, dtype=np.uint32), 50, 0.8)
    assert not may_hold(np.arange(49, dtype=np.uint32), np.arange(49, dtype=np.uint32), 50, 0.8)


def test_a_task_holds_one_bucket_at_a_time():
    buckets = [[1, 1, 2], [2, 2], [], [5], [7, 7]]
    batches = [pa.RecordBatch.from_arrays([pa.array(b, pa.int32())], ["bucket"]) for b in buckets]

    def part(held):
        yield [v for batch in held for v in batch.column("bucket").to_pylist()]

    assert list(substring_dedup._by_bucket(part)(iter(batches))) == [[1, 1], [2, 2, 2], [5], [7, 7]]
    assert list(substring_dedup._by_bucket(part)(iter([]))) == []


def test_extensions_made_together_against_a_table():
    from chartloom.llm.substring_dedup import BAND, extensions

    r = np.random.default_rng(5)
    pairs = [(r.integers(0, 4, int(n)), r.integers(0, 4, int(m))) for n, m in r.integers(0, 30, (60, 2))]
    for n in (3, 40, 200):  # the same words with some left out or put in
        words = r.integers(0, 1 << 32, n)
        pairs.append((words, np.insert(np.delete(words, n // 3), n // 2, 7)))
    for (a, b), (aligned, taken, value) in zip(pairs, extensions(pairs, 0.65)):
        a = a[:128]
        assert len(aligned) == len(taken) == len(value) == len(a) + 1
        table = {(0, j): 0 for j in range(-BAND, BAND + 1)}
        for i in range(1, len(a) + 1):
            for j in range(i - BAND, i + BAND + 1):
                same = 0 < j <= len(b) and a[i - 1] == b[j - 1]
                table[i, j] = max(table.get((i - 1, j - 1), 0) + same, table.get((i - 1, j), 0), table.get((i, j - 1), 0))
        for i in range(len(a) + 1):
            values = [table[i, j] - 0.65 * max(i, j) for j in range(i - BAND, i + BAND + 1) if 0 <= j <= len(b)]
            if values:
                assert value[i] == max(values) == aligned[i] - 0.65 * max(i, taken[i]) and aligned[i] == table[i, taken[i]]
            else:
                assert np.isneginf(value[i])


def test_chains_of_a_batch_are_extended_together(monkeypatch):
    from chartloom.llm.substring_dedup import _align_rows, align

    calls, made = [], substring_dedup.extensions
    monkeypatch.setattr(substring_dedup, "extensions", lambda pairs, worth: calls.append(len(pairs)) or made(pairs, worth))
    r = np.random.default_rng(6)
    rows, expected = [], []
    for doc in range(50):
        a = r.integers(0, 1 << 32, 120).astype("<u4")
        b = a.copy()
        b[r.choice(120, 4, replace=False)] = 1
        start = next(x for x in range(20, 100) if (a[x : x + 6] == b[x : x + 6]).all())
        anchors = np.array([[start, start, 6]], "<i4")
        rows.append((doc, 1000, 0, 0, anchors.tobytes(), a.tobytes(), b.tobytes()))
        expected.append(align(a, b, anchors)[:4])
    names = ["doc", "other", "low", "other_low", "anchors", "words", "other_words"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
    calls.clear()
    found = [tuple(row.values()) for out in _align_rows(50, 0.8)(iter([batch])) for row in out.to_pylist()]
    assert [(row[1], row[2], row[4], row[5]) for row in found] == expected
    assert calls[0] == 100 and len(calls) <= 2


def test_tasks_give_their_memory_back(monkeypatch):
    from chartloom.llm import jaccard_join

    given = []
    for module in (jaccard_join, substring_dedup):
        monkeypatch.setattr(module, "give_back", lambda: given.append(1))
    tasks = [jaccard_join._sets(True), jaccard_join._by_set, jaccard_join._index(80, 3), jaccard_join._verify(80)]
    tasks += [substring_dedup._as_seeds(8), substring_dedup._slice_rows, substring_dedup._align_rows(50, 0.8)]
    for n, task in enumerate(tasks, 1):
        assert list(task(iter([]))) == [] and len(given) == n


@pytest.mark.parametrize("held", [2, 90])
def test_a_passage_whose_seeds_have_other_first_holders(make_docs, monkeypatch, held):
    """Every few words of a passage stand in a document of their own before two fuzzy copies of it come: the copies
    share no seed's first holder and no 50 words. With many holders of a part, these are compared in blocks."""
    monkeypatch.setattr(substring_dedup, "BLOCK", 40, raising=False)
    r = random.Random(9)
    passage = prose(63, r).split()
    rows = []
    for at in range(0, 63, 7):
        for n in range(held if at == 14 else 2):
            rows.append((len(rows), f"{prose(20, r)} {' '.join(passage[max(0, at - 4) : at + 9])} {prose(20, r)}"))
    copies = []
    for changed in (3, 20, 41):
        words = list(passage)
        for at in (changed, changed + 9, changed + 18):
            words[at] = prose(1, r) + "x"
        copies.append((1_000 + changed, f"{prose(30, r)} {' '.join(words)} {prose(30, r)}"))
    got = repeated_passages(make_docs(rows + copies)).collect()
    assert {(x.doc_id, x.first_doc_id) for x in got} >= {(1_020, 1_003), (1_041, 1_003)}
    assert {x.doc_id for x in got} == {1_020, 1_041}
    assert all(x.identity >= 0.8 and x.end_word - x.start_word >= 50 for x in got)
    assert all(x.start_word <= 33 and x.end_word >= 90 for x in got if x.first_doc_id == 1_003)
