"""Alignment of two tokenizers over whole texts, and how often their ids stand for each other.

A text's tokens under both tokenizers cover the same bytes. Offsets where tokens of both end cut them into
groups, and every pair of ids in a group is a link. Most groups are one token of each, of the same
bytes: an array over the first vocabulary says which id of the second has an id's bytes, and links of
such pairs are counted in a vector as long as the vocabulary. Only the other pairs, of irregular groups, are
shuffled as pairs.

Texts are cut where neither tokenizer has a token that reaches over. Tasks gather documents into blocks of
bounded text and align each string between two cuts once a block: the new strings stand in a row, both
tokenizers encode the row, and the common ends of their tokens are those of the strings. A block keeps
which strings each of its documents has, and sends each of its irregular pairs once, with the number of its
documents that have it. The counts come back to the blocks the same way, so no document is tokenized
twice and no row of a frequent pair stands for one document.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from chartloom.llm.byte_bpe import blocks
from chartloom.llm.common import WHITE, give_back, slices, small_batches, stored, text_of, worker_store
from chartloom.llm.tokens import tokenizer_kind

BLOCK_CHARS, BLOCK_ROWS = 4_000_000, 8_192
#: Text that is cut at once, strings that stand in a row, and the longest of them.
SLICE_CHARS, ROW_CHARS, LONGEST_PLAIN = 500_000, 50_000, 48
#: An id pair is one number: the first id, then 24 bits of the second.
SECOND_BITS = 24
BLANK = "▁"


def byte_level_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 characters
    stand for themselves, the other bytes in order for those from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [byte for byte in range(256) if byte not in set(own)]
    return {chr(byte): byte for byte in own} | {chr(256 + i): byte for i, byte in enumerate(rest)}


class TokenizerPair:
    """Both tokenizers, the bytes of their tokens, and the strings between safe cuts."""

    def __init__(self, first: str, second: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(first)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=second)
        alphabet, vocabulary = byte_level_alphabet(), self.first.get_vocab()
        self.first_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            if all(c in alphabet for c in token):
                self.first_bytes[i] = bytes(alphabet[c] for c in token)
        sp, pieces = self.second, []
        self.second_bytes = [b""] * sp.get_piece_size()
        same: dict[bytes, int] = {}
        for i in sorted(range(sp.get_piece_size()), key=sp.is_byte):  # pieces go before single bytes
            if sp.is_control(i) or sp.is_unknown(i):
                continue
            piece = sp.id_to_piece(i)
            if not sp.is_byte(i):
                pieces.append(piece)
            self.second_bytes[i] = bytes([int(piece[3:5], 16)]) if sp.is_byte(i) else piece.replace(BLANK, " ").encode()
            same.setdefault(self.second_bytes[i], i)
        self.identity = np.array([same.get(token, -1) if token else -1 for token in self.first_bytes], np.int64)
        self.blank_id = sp.piece_to_id(BLANK)
        self.safe = self._safe_cuts(pieces) if tokenizer_kind(first) == "pieces" else ""
        if self.safe:
            self.strings = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
            unsafe = "".join(c for c in map(chr, range(0x3001)) if re.match(f"[{WHITE}]", c) and c not in self.safe)
            self.unsafe = re.compile(f"[{unsafe}]") if unsafe else None
            self.cut = re.compile(f"(?<=[^{WHITE}])(?=[{self.safe}])")
        self.first_sizes = np.array(list(map(len, self.first_bytes)))
        self.second_sizes = np.array(list(map(len, self.second_bytes)))

    @staticmethod
    def _safe_cuts(pieces: list[str]) -> str:
        """White space that no piece has behind another character, nor, but for the blank, behind a blank."""
        inner = set()
        for piece in pieces:
            for before, c in zip(piece, piece[1:]):
                if c == BLANK and before != BLANK and not re.match(f"[{WHITE}]", before):
                    return ""
                if c != BLANK:
                    inner.add(c)
        return " " + "".join(c for c in map(chr, range(0x3001)) if c != " " and re.match(f"[{WHITE}]", c) and c not in inner)

    def split(self, text: str) -> list[str]:
        """The strings of a text that starts with a blank."""
        if not self.safe:
            return [text]
        if self.unsafe and self.unsafe.search(text):
            return self.cut.split(text)
        return self.strings.findall(text)

    def _second_ids(self, strings: list[str]) -> list[list[int]]:
        """The library puts a blank before each string, which stands for the string's own first one."""
        found = self.second.encode([s[1:] if s[0] == " " else s for s in strings], num_threads=1)
        return [
            ([self.blank_id] if s == " " else ids) if s[0] == " " else ids[1:] for s, ids in zip(strings, found)
        ]

    def rows(self, strings: list[str]) -> tuple[list[list[str]], list[str]]:
        """Strings that may stand in rows, one behind the other, and those that go by themselves."""
        rows, odd, size = [[]], [], 0
        for s in strings:
            if not self.safe or len(s) > LONGEST_PLAIN or s[0] not in self.safe or s[-1].isspace() or BLANK in s:
                odd.append(s)
                continue
            rows[-1].append(s)
            size += len(s)
            if size > ROW_CHARS:
                rows.append([])
                size = 0
        return [row for row in rows if row], odd

    def row_ids(self, row: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a row under both tokenizers; None if they don't give its bytes."""
        a = self.first.encode_batch_fast([row], add_special_tokens=False)[0].ids
        b = self._second_ids([row])[0]
        raw = row.encode()
        if b"".join(map(self.first_bytes.__getitem__, a)) != raw or b"".join(map(self.second_bytes.__getitem__, b)) != raw:
            return None
        return np.array(a), np.array(b)

    def one_by_one(self, strings: list[str]) -> list[tuple | None]:
        first = self.first.encode_batch_fast(strings, add_special_tokens=False)
        return [self.align(s, a.ids, b) for s, a, b in zip(strings, first, self._second_ids(strings))]

    def align(self, string: str, a: list[int], b: list[int]) -> tuple | None:
        """Counts, groups as text and links of a string; None where tokens don't give its bytes."""
        a_bytes, b_bytes = [self.first_bytes[i] for i in a], [self.second_bytes[i] for i in b]
        raw = string.encode()
        if b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
            return None
        shown, alike, pairs, links = [], Counter(), Counter(), 0
        i = j = 0
        while i < len(a):
            at_a, at_b, end_a, end_b = i, j, len(a_bytes[i]), len(b_bytes[j])
            i, j = i + 1, j + 1
            while end_a != end_b:
                if end_a < end_b:
                    end_a += len(a_bytes[i])
                    i += 1
                else:
                    end_b += len(b_bytes[j])
                    j += 1
            own_a, own_b = a[at_a:i], b[at_b:j]
            shown.append(f"{','.join(map(str, own_a))}|{','.join(map(str, own_b))}")
            links += len(own_a) * len(own_b)
            if len(own_a) == len(own_b) == 1 and self.identity[own_a[0]] == own_b[0]:
                alike[own_a[0]] += 1
                continue
            many_b = Counter(own_b).items()
            for x, n in Counter(own_a).items():
                for y, m in many_b:
                    if self.identity[x] == y:
                        alike[x] += n * m
                    else:
                        pairs[x << SECOND_BITS | y] += n * m
        return len(a), len(b), len(shown), links, ";".join(shown), alike, pairs


def _by_string(entries: list[tuple[np.ndarray, np.ndarray, np.ndarray]], strings: int) -> list[np.ndarray]:
    """Ends of the strings' entries, and the values and counts in order of the strings."""
    nothing = np.zeros(0, np.int64)
    string, value, count = (np.concatenate([nothing, *column]).astype(np.int64) for column in zip(*entries)) if entries else [nothing] * 3
    order = np.argsort(string, kind="stable")
    return [np.cumsum(np.bincount(string, minlength=strings)), value[order], count[order]]


def _expand(ends: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the entries of the picked rows, and which pick each is of."""
    starts = np.concatenate([[0], ends[:-1]])
    sizes = ends[picks] - starts[picks]
    owner = np.repeat(np.arange(len(picks)), sizes)
    return np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[picks][owner], owner


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return np.diff(total[np.concatenate([[0], ends])])


def _packed(arrays: list[np.ndarray]) -> bytes:
    """Arrays of small numbers, byte by byte so that the high bytes vanish, compressed."""
    parts = [np.array([len(arrays), *map(len, arrays)], "<i8").tobytes()]
    parts += [np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for x in arrays]
    raw = b"".join(parts)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(body: bytes) -> list[np.ndarray]:
    raw = pa.decompress(body[8:], int.from_bytes(body[:8], "little"), codec="zstd", asbytes=True)
    many = int.from_bytes(raw[:8], "little")
    sizes = np.frombuffer(raw, "<i8", many, 8).tolist()
    found, at = [], 8 * (many + 1)
    for size in sizes:
        planes = np.frombuffer(raw, np.uint8, 4 * size, at).reshape(4, size)
        found.append(np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64))
        at += 4 * size
    return found


def _distinct(values: np.ndarray) -> np.ndarray:
    """Sorted different values; ``np.unique`` hashes them, which takes longer for many."""
    values = np.sort(values)
    return values[np.append(values[:1] == values[:1], values[1:] != values[:-1])]


class _Block:
    """Documents of one block, and the strings that they are made of."""

    def __init__(self, pair: TokenizerPair, show: bool):
        self.pair, self.show = pair, show
        self.places: dict[str, int] = {}
        self.sizes: list[np.ndarray] = []
        self.shown: list[str | None] = []
        self.alike, self.pairs = [], []  # string, id or pair, count
        self.keys, self.groups, self.strings, self.counts = [], [], [], []
        self.chars = 0

    def add(self, keys: list, texts: list[str]) -> None:
        """Documents whose texts are a slice together, or a longer one by itself."""
        self.keys += keys
        self.chars += sum(map(len, texts))
        if len(texts) > 1 or not self.pair.safe or len(texts[0]) <= SLICE_CHARS:
            split = [self.pair.split(" " + text) if text else [] for text in texts]
            self._learn(split)
            for strings in split:
                self._finish([list(map(self.places.__getitem__, strings))])
            return

        def parts():
            for part in blocks(" " + texts[0], SLICE_CHARS):
                strings = self.pair.split(part)
                self._learn([strings])
                yield list(map(self.places.__getitem__, strings))

        self._finish(parts())

    def _finish(self, parts) -> None:
        """One document from the places of its strings, which come in parts."""
        once, held, lines, digest, broken = None, Counter(), [], hashlib.sha256(), False
        for places in parts:
            shown = list(map(self.shown.__getitem__, places))
            broken = broken or None in shown
            if broken or not shown:
                continue
            line = ";".join(shown)
            lines.append(line) if self.show else digest.update((line if once is None and not held else ";" + line).encode())
            found = np.unique(np.array(places), return_counts=True)
            if once is None and not held:
                once = found
                continue
            # Most documents are one part and need no dictionary.
            for places, counts in (once, found) if once else (found,):
                held.update(dict(zip(places.tolist(), counts.tolist())))
            once = None
        if broken or not (once or held):
            own = np.empty(0, np.int64), np.empty(0, np.int64)
        elif once:
            own = once
        else:
            own = np.array(sorted(held.items()), np.int64).T
        shown = ";".join(lines) if self.show else digest.hexdigest()
        self.groups.append(shown if len(own[0]) else "")
        self.strings.append(own[0])
        self.counts.append(own[1])

    def _learn(self, split: list[list[str]]) -> None:
        rows, odd = self.pair.rows(list(set().union(*split).difference(self.places)))
        for row in rows:
            ids = self.pair.row_ids("".join(row))
            if ids is None or not self._learn_row(row, *ids):
                odd += row
        if odd:
            self._learn_odd(odd)

    def _place(self, strings: list[str]) -> int:
        start = len(self.places)
        self.places.update(zip(strings, range(start, start + len(strings))))
        return start

    def _learn_odd(self, strings: list[str]) -> None:
        start = self._place(strings)
        sizes = np.zeros((len(strings), 4), np.int64)
        for i, record in enumerate(self.pair.one_by_one(strings)):
            self.shown.append(record and record[4])
            if record:
                sizes[i] = record[:4]
                for entries, held in ((self.alike, record[5]), (self.pairs, record[6])):
                    entries.append((np.full(len(held), start + i), np.array(list(held), np.int64), np.array(list(held.values()), np.int64)))
        self.sizes.append(sizes)

    def _learn_row(self, row: list[str], a: np.ndarray, b: np.ndarray) -> bool:
        pair = self.pair
        ends_a, ends_b = np.cumsum(pair.first_sizes[a]), np.cumsum(pair.second_sizes[b])
        ends = np.intersect1d(ends_a, ends_b, assume_unique=True)
        string_ends = np.cumsum([len(s.encode()) for s in row])
        last = np.searchsorted(ends, string_ends)
        if not np.array_equal(ends[np.minimum(last, len(ends) - 1)], string_ends):
            return False
        start = self._place(row)
        groups = np.diff(last + 1, prepend=0)
        string = np.repeat(np.arange(len(row)), groups)
        to_a, to_b = np.searchsorted(ends_a, ends) + 1, np.searchsorted(ends_b, ends) + 1
        n_a, n_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
        columns = [np.bincount(string, weights, len(row)) for weights in (n_a, n_b, None, n_a * n_b)]
        self.sizes.append(np.stack(columns, axis=1).astype(np.int64))
        x, y = a[to_a - 1], b[to_b - 1]
        single = (n_a == 1) & (n_b == 1)
        same = single & (pair.identity[x] == y)
        ones = lambda at: np.ones(len(at), np.int64)
        self.alike.append((start + string[same], x[same], ones(x[same])))
        other = single & ~same
        self.pairs.append((start + string[other], x[other] << SECOND_BITS | y[other], ones(x[other])))
        texts = list(map("%d|%d".__mod__, zip(x.tolist(), y.tolist())))
        found = ([], []), ([], [])
        for at in np.flatnonzero(~single).tolist():
            own_a, own_b = a[to_a[at] - n_a[at] : to_a[at]].tolist(), b[to_b[at] - n_b[at] : to_b[at]].tolist()
            texts[at] = f"{','.join(map(str, own_a))}|{','.join(map(str, own_b))}"
            for i in own_a:
                for j in own_b:
                    alike = int(pair.identity[i] == j)
                    found[alike][0].append(start + string[at])
                    found[alike][1].append(i if alike else i << SECOND_BITS | j)
        for entries, (own, values) in zip((self.pairs, self.alike), found):
            entries.append((np.array(own, np.int64), np.array(values, np.int64), ones(own)))
        bounds = (last + 1).tolist()
        self.shown += [";".join(texts[low:high]) for low, high in zip([0, *bounds], bounds)]
        return True

    def close(self, name: str, identity: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray]:
        """The block's row, its irregular pairs and how many of its documents have each."""
        sizes = np.concatenate([np.zeros((0, 4), np.int64), *self.sizes])
        alike_ends, alike, alike_n = _by_string(self.alike, len(sizes))
        pair_ends, pairs, pair_n = _by_string(self.pairs, len(sizes))
        keys, slots = np.unique(pairs, return_inverse=True)
        ends = np.cumsum([len(x) for x in self.strings], dtype=np.int64)
        strings, counts = np.concatenate(self.strings), np.concatenate(self.counts)
        document = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
        at, owner = _expand(alike_ends, strings)
        held = _distinct(document[owner] * len(identity) + alike[at]) % len(identity)
        identity += np.bincount(held, minlength=len(identity))
        at, owner = _expand(pair_ends, strings)
        held = _distinct(document[owner] * max(1, len(keys)) + slots[at]) % max(1, len(keys))
        # Places of strings ascend in a document; their steps are small numbers.
        steps = np.diff(strings, prepend=0)
        begins = np.concatenate([[0], ends[:-1]])[np.diff(np.concatenate([[0], ends])) > 0]
        steps[begins] = strings[begins]
        row = {
            "block": name,
            "docs": [
                dict(zip(("key", "n_a", "n_b", "n_groups", "n_links", "groups"), values))
                for values in zip(self.keys, *(_sums(sizes[strings, i] * counts, ends).tolist() for i in range(4)), self.groups)
            ],
            "body": _packed([ends, steps, counts, alike_ends, alike, alike_n, pair_ends, slots, pair_n, keys >> SECOND_BITS]),
        }
        return row, keys, np.bincount(held, minlength=len(keys))


def _scan(first: str, second: str, show: bool, schema: pa.Schema):
    """Rows of three kinds: blocks, their irregular pairs, and at a task's end its identity counts."""

    def run(batches: Iterator[pa.RecordBatch]):
        pair = worker_store(f"pair {first} {second}", lambda: TokenizerPair(first, second))
        task, number = TaskContext.get().partitionId(), 0
        identity, block = np.zeros(len(pair.first_bytes), np.int64), _Block(pair, show)

        def closed(block, number):
            row, keys, held = block.close(f"{task}-{number}", identity)
            yield pa.RecordBatch.from_pylist([row | {"kind": 0}], schema)
            columns = {
                "kind": pa.array(np.ones(len(keys), np.int8)), "block": pa.array([row["block"]] * len(keys)),
                "slot": pa.array(np.arange(len(keys)), pa.int32()), "pair": pa.array(keys), "n": pa.array(held.astype(np.int64)),
            }
            yield pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(len(keys), f.type)) for f in schema], schema=schema)

        for batch in batches:
            keys, texts = batch.column("key").to_pylist(), batch.column("text").to_pylist()
            for start, end in slices(texts, SLICE_CHARS):
                long = [i for i in range(start, end) if len(texts[i]) > SLICE_CHARS]
                short = [i for i in range(start, end) if len(texts[i]) <= SLICE_CHARS]
                for own in [short, *([i] for i in long)]:
                    if own:
                        block.add([keys[i] for i in own], [texts[i] for i in own])
                if block.chars >= BLOCK_CHARS or len(block.keys) >= BLOCK_ROWS:
                    yield from closed(block, number)
                    block, number = _Block(pair, show), number + 1
        if block.keys:
            yield from closed(block, number)
        ids = np.flatnonzero(identity)
        columns = {"kind": pa.array(np.full(len(ids), 2, np.int8)), "pair": pa.array(ids), "n": pa.array(identity[ids])}
        yield pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(len(ids), f.type)) for f in schema], schema=schema)
        give_back()

    return run


def _finish(identity: dict[int, int], highest: dict[int, int], schema: pa.Schema):
    """Counts of a block's documents from the counts of its pairs; both dictionaries are as long as the
    first vocabulary at most."""
    size = 1 + max([0, *identity, *highest])
    same, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    same[list(identity)] = list(identity.values())
    best[list(highest)] = list(highest.values())

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                body = batch.column("body")[row].as_py()
                ends, steps, counts, alike_ends, alike, alike_n, pair_ends, slots, pair_n, pair_first = _unpacked(body)
                sizes = np.diff(np.concatenate([[0], ends]))
                total = np.cumsum(steps)
                base = np.concatenate([[0], total])[np.concatenate([[0], ends[:-1]])]
                strings = total - np.repeat(base, sizes)
                pair_counts = np.zeros(len(pair_first), np.int64)
                found = batch.column("found")[row].values
                if found is not None and len(found):
                    pair_counts[found.field("slot").to_numpy()] = found.field("n").to_numpy()
                alike_counts = same[alike]
                top = pair_counts == best[pair_first]
                each_sum = _sums(alike_n * alike_counts, alike_ends) + _sums(pair_n * pair_counts[slots], pair_ends)
                each_best = _sums(alike_n * (alike_counts == best[alike]), alike_ends) + _sums(pair_n * top[slots], pair_ends)
                docs = batch.column("docs")[row].values
                columns = [docs.field(i) for i in range(len(docs.type))]
                columns += [pa.array(_sums(each[strings] * counts, ends)) for each in (each_best, each_sum)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
        give_back()

    return run


def align_tokenizers(
    docs: DataFrame, first: str, second: str, id_column: str = "doc_id", text_column: str = "text", show_groups: bool = False
) -> DataFrame:
    """``<id>, n_a, n_b, n_groups, n_links, n_best, count_sum, groups`` of every row.

    ``first`` is a byte-level ``.json`` file (tokenizers) that encodes a blank and the text, ``second`` a
    ``.model`` file (sentencepiece) with byte fallback that puts the blank there itself; strings of special tokens are
    plain text. ``groups`` is the sha256 of the groups as ``a1,a2|b1;a3|b2``, or that text with
    ``show_groups``. The count of an id pair is the number of rows of the table that hold it linked;
    ``count_sum`` adds the counts of a row's links, ``n_best`` counts the links whose pair has the highest count of
    its first id. Texts that are null, empty or whose tokens don't give back their bytes have zeros and an empty
    ``groups``. Null ids and repeated rows are rows like any other; an empty table gives none. Other columns
    are not looked at. A text without a safe cut is one string, however long.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_column].dataType.simpleString()
    fields = f"key {id_type}, n_a long, n_b long, n_groups long, n_links long"
    kinds = f"kind byte, block string, slot int, pair long, n long, docs array<struct<{fields.replace(' ', ':').replace(',:', ',')},groups:string>>, body binary"
    rows = docs.select(F.col(id_column).alias("key"), text_of(text_column).alias("text"))
    with small_batches(spark, 1_000):
        scanned = stored(rows.mapInArrow(_scan(first, second, show_groups, _arrow(spark, kinds)), kinds), "aligned")
    pairs = scanned.where("kind = 1").select("block", "slot", "pair", "n")
    counts = stored(pairs.groupBy("pair").agg(F.sum("n").alias("total")), "pair-counts")
    # Both have an entry for each id of the first vocabulary at most.
    identity = dict(scanned.where("kind = 2").groupBy("pair").agg(F.sum("n")).collect())
    irregular = dict(counts.groupBy(F.shiftright("pair", SECOND_BITS)).agg(F.max("total")).collect())
    highest = {i: max(identity.get(i, 0), irregular.get(i, 0)) for i in identity.keys() | irregular.keys()}
    found = pairs.join(counts, "pair").groupBy("block").agg(F.collect_list(F.struct("slot", F.col("total").alias("n"))).alias("found"))
    whole = scanned.where("kind = 0").select("block", "docs", "body").join(found, "block", "left").select("docs", "body", "found")
    result = f"{fields}, groups string, n_best long, count_sum long"
    with small_batches(spark, 4):
        return stored(whole.mapInArrow(_finish(identity, highest, _arrow(spark, result)), result), "alignment").withColumnRenamed("key", id_column)


def _arrow(spark, fields: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(fields))
