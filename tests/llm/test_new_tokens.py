import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from chartloom.llm.bpe_transducer import MergeRules, Transducer, Utf8Stream, read_ranks
from chartloom.llm.byte_bpe import TextEncoder, decode_documents, encode_documents
from chartloom.llm.token_alignment import TokenizerPair, align_tokenizers, byte_level_alphabet

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
FIRST, SECOND = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LETTERS = "ab cdeé日 \n\t'sll0123.., ́😀aaaa   ingtheTHE\r▁ "


def odd_texts(seed: int, n: int) -> list:
    rnd = random.Random(seed)
    texts = ["", None, " ", "  ", "\n", "word ", " word", "a\r\nb;\r\n", "<|endoftext|></s>", "x" * 3_000, " " * 700 + "a", "a▁b"]
    for i in range(n):
        text = "".join(rnd.choice(LETTERS) for _ in range(rnd.randint(0, 80)))
        if i % 5 == 0:
            text += "".join(chr(rnd.choice([rnd.randint(32, 0x2FF), rnd.randint(0x300, 0xD7FF), rnd.randint(0xE000, 0x1FFFF)])) for _ in range(20))
        texts.append(text)
    return texts


def library():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})


def brute_merge(ranks, string):
    parts = [string[i : i + 1] for i in range(len(string))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@pytest.mark.parametrize("seed", range(6))
def test_transducer_equals_merging_for_any_ranks(seed):
    """Vocabularies of random strings, whose merges are not in the order of their lengths."""
    rnd = random.Random(seed)
    words = {bytes(rnd.choices(b"abc", k=rnd.randint(2, 6))) for _ in range(40)}
    order = [bytes([b]) for b in range(256)] + rnd.sample(sorted(words), len(words))
    ranks = {token: i for i, token in enumerate(order)}
    machine, few = Transducer(ranks), Transducer(ranks, most_states=5)
    strings = [bytes(rnd.choices(b"abcd", k=rnd.randint(0, 30))) for _ in range(300)]
    ids, bounds = machine.encode_many(b"".join(strings), np.array(list(map(len, strings))))
    parts = [part.tolist() for part in np.split(ids, bounds[:-1])]
    assert parts == [[ranks[s]] if s in ranks else brute_merge(ranks, s) for s in strings]
    for _ in range(100):
        string = bytes(rnd.choices(b"abcd", k=rnd.randint(1, 30)))
        expected = [ranks[string]] if string in ranks else brute_merge(ranks, string)
        assert machine.encode(string) == expected
        assert few.encode(string) == expected
        assert list(machine.stream([string[:7], string[7:]])) == expected


def test_bytes_without_token_are_refused():
    with pytest.raises(ValueError):
        MergeRules({b"a": 0})


def test_transducer_emits_after_bounded_lookahead():
    ranks = read_ranks(RANKS)
    machine, longest, taken = Transducer(ranks), max(map(len, ranks)), 0

    def letters():
        nonlocal taken
        for byte in b"internationalisation" * 500:
            taken += 1
            yield bytes([byte])

    given, ahead = 0, 0
    sizes = machine.rules.bytes_of
    for token in machine.stream(letters()):
        given += len(sizes[token])
        ahead = max(ahead, taken - given)
    assert ahead <= 2 * longest + 64


def test_utf8_stream_equals_decoding_at_once():
    rnd = random.Random(3)
    for _ in range(3_000):
        data = bytes(rnd.choice([0x41, 0x80, 0x9F, 0xA0, 0xBF, 0xC2, 0xE0, 0xED, 0xE2, 0xF0, 0xF4, 0xF5, 0xFF]) for _ in range(rnd.randint(0, 12)))
        stream, at, shown = Utf8Stream(), 0, ""
        while at < len(data):
            step = rnd.randint(1, 4)
            shown += stream.feed(data[at : at + step])
            at += step
        assert shown + stream.finish() == data.decode("utf-8", "replace")


def test_encode_and_decode_equal_the_library(spark):
    texts, encoder = odd_texts(11, 600), library()
    docs = spark.createDataFrame([(i if i % 50 else None, t, t) for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    encoded = encode_documents(docs, RANKS, public_tokenizers.PATTERN)
    assert encoded.columns == ["doc_id", "ids"]
    rows = decode_documents(encoded, RANKS).collect()
    assert sorted((list(r.ids), r.text) for r in rows) == sorted((encoder.encode_ordinary(t or ""), t or "") for t in texts)


def test_long_text_is_cut_where_no_match_reaches_over(monkeypatch):
    monkeypatch.setattr("chartloom.llm.byte_bpe.BLOCK_CHARS", 50)
    encoder = TextEncoder(RANKS, public_tokenizers.PATTERN)
    text = " ".join(t for t in odd_texts(5, 200) if t)
    assert np.frombuffer(encoder.encode(text), "<i4").tolist() == library().encode_ordinary(text)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert decode_documents(encode_documents(docs, RANKS, public_tokenizers.PATTERN), RANKS).count() == 0
    assert align_tokenizers(docs, FIRST, SECOND).count() == 0


def brute_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a_tok, b_tok = Tokenizer.from_file(FIRST), sentencepiece.SentencePieceProcessor(model_file=SECOND)
    a_tok.encode_special_tokens = True
    alphabet = byte_level_alphabet()
    found, holders = [], defaultdict(set)
    for row, text in enumerate(texts):
        groups, links = [], []
        if text:
            a = a_tok.encode(" " + text, add_special_tokens=False).ids
            b = b_tok.encode(text)
            a_bytes = [bytes(alphabet[c] for c in a_tok.id_to_token(i)) for i in a]
            pieces = [b_tok.id_to_piece(i) for i in b]
            b_bytes = [bytes([int(p[3:5], 16)]) if b_tok.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces)]
            if b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
                ends = lambda parts: [sum(map(len, parts[: i + 1])) for i in range(len(parts))]
                ends_a, ends_b = ends(a_bytes), ends(b_bytes)
                start = 0
                for end in sorted(set(ends_a) & set(ends_b)):
                    group = [[i for i, e in zip(ids, at) if start < e <= end] for ids, at in ((a, ends_a), (b, ends_b))]
                    groups.append(group)
                    links += [(x, y) for x in group[0] for y in group[1]]
                    start = end
        for link in set(links):
            holders[link].add(row)
        found.append((groups, links))
    count = Counter({link: len(rows) for link, rows in holders.items()})
    highest = defaultdict(int)
    for (x, _), n in count.items():
        highest[x] = max(highest[x], n)
    rows = []
    for groups, links in found:
        shown = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        rows.append((
            sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links),
            sum(count[x] == highest[x[0]] for x in links), sum(count[x] for x in links),
            hashlib.sha256(shown.encode()).hexdigest() if groups else "",
        ))
    return rows


@pytest.mark.parametrize("block_rows", [7, 8_192])
def test_alignment_equals_brute_force(spark, monkeypatch, block_rows):
    monkeypatch.setattr("chartloom.llm.token_alignment.BLOCK_ROWS", block_rows)
    texts = odd_texts(7, 250)
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_a int").repartition(3)
    rows = align_tokenizers(docs, FIRST, SECOND).orderBy("doc_id").collect()
    assert [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in rows] == brute_alignment(texts)


def test_alignment_shows_groups_and_takes_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")
    rows = align_tokenizers(docs, FIRST, SECOND, show_groups=True).collect()
    assert [r.doc_id for r in rows] == [None, None] and rows[0].groups == rows[1].groups
    assert rows[0].count_sum == 2 * rows[0].n_links and "|" in rows[0].groups


def test_identity_map_holds_equal_bytes():
    pair = TokenizerPair(FIRST, SECOND)
    for i, other in enumerate(pair.identity.tolist()):
        assert other < 0 or pair.first_bytes[i] == pair.second_bytes[other]
    assert (pair.identity >= 0).sum() > 5_000


def test_distinct_values():
    from chartloom.llm.token_alignment import _distinct

    for values in ([], [3], [5, 1, 5, 5, 2], list(range(9)) * 3):
        assert _distinct(np.array(values, np.int64)).tolist() == sorted(set(values))
