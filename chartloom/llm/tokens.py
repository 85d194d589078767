"""Token ids and counts by the installed tokenizer libraries, inside tasks.

A byte-level or word tokenizer splits text before its merges, and no split piece reaches over a place
where a character that isn't white space is followed by white space. Texts are cut there, and each
worker keeps what the library gave for the pieces it has met (bounded, then started anew), so that
frequent words are encoded once. Pieces are encoded by the library, many in one call.
"""

from __future__ import annotations

import json
import re

import numpy as np

from chartloom.llm.common import WHITE, worker_store

MOST_PIECES = 300_000
#: Words of which ``WordIds`` keeps the ids (about 200 bytes each).
MOST_WORDS = 450_000
PIECES = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
WORDS = re.compile(f"[^{WHITE}]+")
#: Texts that need the patterns above: characters beyond Latin letters and marks, blanks in a row or at an end.
NOT_PLAIN = re.compile("[^!-~¡-ſ \n]| [ \n]|\n |^ | $")
#: Texts whose words can't be lower-cased and cut by the string methods.
NOT_LATIN = re.compile("[^\t-\r -~¡-ſ]")


def tokenizer_kind(path: str) -> str:
    """``pieces``: byte-level, white space kept with the next word; ``words``: white space dropped;
    ``whole``: anything else, encoded text by text."""
    if path.endswith(".model"):
        return "sentencepiece"
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    split = spec.get("pre_tokenizer") or {}
    kept = (split.get("type"), split.get("use_regex"), split.get("add_prefix_space"))
    if kept == ("ByteLevel", True, False) and not spec.get("normalizer"):
        return "pieces"
    kinds = [x.get("type") for x in split.get("pretokenizers", [])]
    ends = spec["model"].get("end_of_word_suffix")
    if kinds == ["Split", "ByteLevel"] and ends and split["pretokenizers"][0].get("invert"):
        return "words"
    return "whole"


def load_tokenizer(path: str):
    def make():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)

    return worker_store(f"tokenizer {path}", make)


def stems_of(words: set[str]) -> tuple[list[str], dict[str, str], list[str]]:
    """Words of Latin letters only; words that are such a stem and a full stop or comma, which is a token
    of its own behind a letter and before white space; all others."""
    plain, tailed, rest = [], {}, []
    for word in words:
        if word.isalpha():
            plain.append(word)
        elif word[-1:] in (".", ",") and word[:-1].isalpha():
            tailed[word] = word[:-1]
        else:
            rest.append(word)
    return plain, tailed, rest


class PieceCounts:
    """Number of tokens of each piece, for byte-level tokenizers."""

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        self.spaced: dict[str, int] = {}  # of a word behind one blank
        self.other: dict[str, int] = {}  # of a piece as it is
        vocabulary = self.tokenizer.get_vocab()
        self.starts = np.zeros(max(vocabulary.values()) + 1, bool)
        self.starts[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True

    def counts(self, texts: list[str]) -> list[int]:
        split, plain = [], []
        for text in texts:
            if NOT_PLAIN.search(text):
                split.append((PIECES.findall(text), ()))
            else:
                words = text.split(" ")
                split.append((words[:1] if text else (), words[1:]))
                plain.append(words[1:])
        self.learn_other(set().union(*(pieces for pieces, _ in split)))
        self.learn_spaced(set().union(*plain))
        other, spaced = self.other.__getitem__, self.spaced.__getitem__
        return [sum(map(other, a)) + sum(map(spaced, b)) for a, b in split]

    def learn_other(self, pieces: set[str]) -> None:
        if len(self.other) > MOST_PIECES // 4:
            self.other.clear()
        new = list(pieces - self.other.keys())
        self.other.update(zip(new, map(len, self.tokenizer.encode_batch_fast(new, add_special_tokens=False))))

    def learn_spaced(self, words: set[str]) -> None:
        if len(self.spaced) > MOST_PIECES:
            self.spaced.clear()
        known = self.spaced
        plain, tailed, rest = stems_of(words - known.keys())
        plain = list(set(plain).union(stem for stem in tailed.values() if stem not in known))
        if plain:  # one blank each, so every word starts at a token that starts with a blank
            ids = self.tokenizer.encode_batch_fast([" " + " ".join(plain)], add_special_tokens=False)[0].ids
            at = np.flatnonzero(self.starts[ids])
            if len(at) != len(plain):
                raise ValueError("the tokenizer doesn't start every word at its blank")
            known.update(zip(plain, np.diff(np.append(at, len(ids))).tolist()))
        for word, stem in tailed.items():
            known[word] = known[stem] + 1
        encoded = self.tokenizer.encode_batch_fast([" " + word for word in rest], add_special_tokens=False)
        known.update(zip(rest, map(len, encoded)))


class WordIds:
    """Ids of each word as little-endian unsigned 32-bit bytes, for tokenizers that drop white space."""

    def __init__(self, path: str):
        from tokenizers import normalizers, pre_tokenizers

        self.tokenizer, self.known = load_tokenizer(path), {}

        def make():
            from tokenizers import Tokenizer

            plain = Tokenizer.from_file(path)  # for lower-case letters only, where it gives the same ids
            plain.normalizer = normalizers.Sequence([])
            plain.pre_tokenizer = pre_tokenizers.Sequence(
                [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
            )
            return plain

        self.plain = worker_store(f"letters {path}", make)
        vocabulary, suffix = self.tokenizer.get_vocab(), self.tokenizer.model.end_of_word_suffix
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.marks = {
            mark: np.array(self.tokenizer.encode(mark, add_special_tokens=False).ids, "<u4").tobytes() for mark in ".,"
        }

    def ids(self, texts: list[str]) -> list[bytes]:
        latin, other = [], []
        split = []
        for text in texts:
            if NOT_LATIN.search(text):
                split.append(WORDS.findall(text))
                other.append(split[-1])
            else:  # here lower-casing and white space are the same to Python and to the tokenizer
                split.append(text.lower().split())
                latin.append(split[-1])
        self.learn(set().union(*latin), set().union(*other))
        known = self.known.__getitem__
        return [b"".join(map(known, words)) for words in split]

    def learn(self, latin: set[str], other: set[str]) -> None:
        if len(self.known) > MOST_WORDS:
            self.known.clear()
        known = self.known
        # ``set - known.keys()`` would go over all that is known.
        rest = list(other.difference(known))
        plain, tailed, more = stems_of(latin.difference(known, other))
        rest += more
        plain = list(set(plain).union(stem for stem in tailed.values() if stem not in known))
        if plain:  # every word ends at a token that ends words
            ids = np.array(self.plain.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids, "<u4")
            ends = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            if len(ends) != len(plain):
                raise ValueError("the tokenizer doesn't end every word at a token of its own")
            raw = ids.tobytes()
            known.update(zip(plain, [raw[start:end] for start, end in zip([0, *ends], ends)]))
        for word, stem in tailed.items():
            known[word] = known[stem] + self.marks[word[-1]]
        for word, encoded in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            known[word] = np.array(encoded.ids, "<u4").tobytes()


def whole_ids(path: str, texts: list[str]) -> list[list[int]]:
    """Ids text by text, for every other tokenizer."""
    if path.endswith(".model"):

        def make():
            import sentencepiece

            return sentencepiece.SentencePieceProcessor(model_file=path)

        return worker_store(f"pieces {path}", make).encode(texts, num_threads=1)
    return [x.ids for x in load_tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]


def count_tokens(path: str, kind: str, texts: list[str]) -> list[int]:
    if kind == "pieces":
        return worker_store(f"counts {path}", lambda: PieceCounts(path)).counts(texts)
    if kind == "words":
        return [len(ids) // 4 for ids in id_bytes(path, kind, texts)]
    return [len(ids) for ids in whole_ids(path, texts)]


def id_bytes(path: str, kind: str, texts: list[str]) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit bytes."""
    if kind == "words":
        return worker_store(f"ids {path}", lambda: WordIds(path)).ids(texts)
    return [np.array(ids, "<u4").tobytes() for ids in whole_ids(path, texts)]


def forget_words(path: str) -> None:
    """Empties what ``id_bytes`` keeps of words. A worker that waits for its next task would hold it for all others."""
    worker_store(f"ids {path}", lambda: WordIds(path)).known.clear()
