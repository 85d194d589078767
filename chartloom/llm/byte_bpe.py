"""Byte-level BPE of whole texts, there and back, by a transducer that learns its states in each worker.

A text is cut where white space follows another character: no match of a split pattern like the usual
ones reaches over such a place. Each worker keeps the ids of the strings between two cuts that it has
met (bounded, then started anew); new ones are split by the pattern and their matches go through the
transducer. Decoding joins the bytes of tokens block by block, through a UTF-8 state that survives
between blocks, so neither direction holds more than a block of a long text as Python objects.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chartloom.llm.bpe_transducer import Transducer, Utf8Stream, read_ranks
from chartloom.llm.common import WHITE, give_back, slices, text_of, worker_store

MOST_KEPT, LONGEST_KEPT = 100_000, 48
BLOCK_CHARS, BLOCK_IDS = 400_000, 200_000
STRINGS = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
CUT = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])")


def blocks(text: str, size: int) -> Iterator[str]:
    """The text in parts of about ``size``, cut where no match reaches over."""
    start = 0
    while len(text) - start > size:
        found = CUT.search(text, start + size)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:] if start else text


def unknown_characters(pattern: str) -> dict[int, int]:
    """Letters and digits of newer Unicode than the reference encoder knows, to a character that is neither.

    The encoder itself tells them: in a vocabulary that has ``a`` and the letter, or ``1`` and the
    digit, as a token, that string is one token exactly if the encoder doesn't split it.
    """
    import regex
    import tiktoken

    letter, digit = regex.compile(r"[\p{L}\p{N}]"), regex.compile(r"\p{N}")
    young = letter.findall("".join(c for c in map(chr, range(128, 0x110000)) if unicodedata.category(c) == "Cn"))
    pairs = {("1" if digit.match(c) else "a") + c: c for c in young}
    ranks = {bytes([byte]): byte for byte in range(256)}
    ranks |= {pair.encode(): 256 + i for i, pair in enumerate(pairs)}
    encoder = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return {ord(c): 0x378 for pair, c in pairs.items() if len(encoder.encode_ordinary(pair)) > 1}


class TextEncoder:
    """Ids of texts as bytes of 32-bit numbers."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.split = regex.compile(pattern)
        self.unknown = unknown_characters(pattern)
        self.newer = set(map(chr, self.unknown))
        self.transducer = Transducer(read_ranks(path))
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        return self.encode_texts([text])[0]

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. The new strings of all texts, or of a block of a long one, are merged together."""
        if all(len(text) <= BLOCK_CHARS for text in texts):
            return self._blocks(texts)
        return [b"".join(part for block in blocks(text, BLOCK_CHARS) for part in self._blocks([block])) for text in texts]

    def _matches(self, string: str) -> list[str]:
        if string.isascii() or self.newer.isdisjoint(string):
            return self.split.findall(string)
        return [string[m.start() : m.end()] for m in self.split.finditer(string.translate(self.unknown))]

    def _blocks(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > MOST_KEPT:
            self.known.clear()
        split = [STRINGS.findall(text) for text in texts]
        new = list(set().union(*split).difference(self.known))
        self._learn(new)
        encoded = [b"".join(map(self.known.__getitem__, strings)) for strings in split]
        for string in new:
            if len(string) > LONGEST_KEPT:
                del self.known[string]
        return encoded

    def _learn(self, strings: list[str]) -> None:
        """New strings in one run of the pattern: one behind the other is cut like each by itself, if each starts
        with white space and ends with something else. The few others go one by one."""
        plain, odd = [], []
        for string in strings:
            fits = len(string) <= LONGEST_KEPT and string[0].isspace() and not string[-1].isspace()
            (plain if fits and (string.isascii() or self.newer.isdisjoint(string)) else odd).append(string)
        matches = self.split.findall("".join(plain))
        pieces = list(map(str.encode, matches))
        ids, bounds = self.transducer.encode_many(b"".join(pieces), np.fromiter(map(len, pieces), np.int64, len(pieces)))
        match_ends = np.cumsum(np.fromiter(map(len, matches), np.int64, len(matches)))
        string_ends = np.cumsum(np.fromiter(map(len, plain), np.int64, len(plain)))
        ends = (4 * bounds[np.searchsorted(match_ends, string_ends)]).tolist() if plain else []
        raw = ids.tobytes()
        self.known.update((string, raw[start:end]) for string, start, end in zip(plain, [0, *ends], ends))
        for string in odd:
            found = array("i")
            for match in self._matches(string):
                found.extend(self.transducer.stream([match.encode()]))
            self.known[string] = found.tobytes()


def _encode_rows(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]):
        encoder = worker_store(f"transducer {path} {pattern}", lambda: TextEncoder(path, pattern))
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for start, end in slices(texts, 500_000):
                encoded = encoder.encode_texts(texts[start:end])
                offsets = np.concatenate([[0], np.cumsum([len(ids) // 4 for ids in encoded])]).astype(np.int32)
                values = np.frombuffer(b"".join(encoded), np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("key")[start:end], ids], ["key", "ids"])
        give_back()

    return run


def encode_documents(
    docs: DataFrame, ranks: str, pattern: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``<id>, ids`` of every row: the tokens of the whole text, each match of ``pattern`` merged by itself.

    ``ranks`` is the path of a ``.tiktoken`` file that all executors have, which must hold all 256 bytes;
    ``pattern`` must match every character and none of its matches may go on with white space behind
    another character. Special tokens are ordinary text. Null and empty texts have no ids; null ids and
    repeated rows give a row each; an empty table gives none. Other columns are not looked at.
    """
    rows = docs.select(F.col(id_column).alias("key"), text_of(text_column).alias("text"))
    schema = f"key {docs.schema[id_column].dataType.simpleString()}, ids array<int>"
    return rows.mapInArrow(_encode_rows(ranks, pattern), schema).withColumnRenamed("key", id_column)


def _token_list(path: str) -> list[bytes | None]:
    ranks = read_ranks(path)
    tokens: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


def _decode_rows(path: str, column: str):
    def run(batches: Iterator[pa.RecordBatch]):
        tokens = worker_store(f"tokens {path}", lambda: _token_list(path))
        for batch in batches:
            lists, texts = batch.column(column), []
            for row in range(len(lists)):
                if not lists[row].is_valid:
                    texts.append(None)
                    continue
                ids, stream, parts = lists[row].values, Utf8Stream(), []
                for start in range(0, len(ids), BLOCK_IDS):
                    block = ids.slice(start, BLOCK_IDS).to_numpy().tolist()
                    parts.append(stream.feed(b"".join(map(tokens.__getitem__, block))))
                texts.append("".join(parts) + stream.finish())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])
        give_back()

    return run


def decode_documents(encoded: DataFrame, ranks: str, ids_column: str = "ids") -> DataFrame:
    """The rows with the ``text`` of their ids; a column ``text`` there is replaced.

    Bytes that are no UTF-8, which only ids that no text was encoded to can make, become U+FFFD. Null ids give
    a null text, no ids the empty one; an id without a token fails.
    """
    kept = encoded.drop("text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(_decode_rows(ranks, ids_column), f"{fields}, text string")
