"""Exact Jaccard join of documents on word shingles, with filters under several global token orders.

1. Each text becomes its set of shingle hashes. Copies of a set are one class from here on.
2. First filter, in order of hash: of a set of ``n`` shingles the first ``n - ceil(t n) + k`` must share
   ``k`` with any set it links with, ``k`` a share of ``n``. Sets without so many shared ones link with
   nothing. A token is shared when two different sets have it; tokens that a task meets twice are known
   to be shared at once, so a frequent one leaves each task as a single mark.
3. Over the rest, tokens are counted, and the sets of which less than ``t`` is shared go too. The others
   are indexed by their first ``n - ceil(t n) + 1`` tokens under each of several orders: rare ones first,
   equal counts by another mixing of the hash in each order. A link must share a token under all of them.
4. Sets that share a first token are verified against one hub of the token, which joins groups of
   near copies by as many links as they have members. Only tokens that then still reach over several
   components give pairs, and only of sets that can still link when it is the first token they share;
   pairs found under every order are verified. So no group is expanded into its
   pairs, and yet two linked sets are always in one component.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from chartloom.llm.common import binary_views, give_back, parts_of, small_batches, stored, text_of
from chartloom.llm.components import components
from chartloom.llm.shingles import mixed, shingle_set

PERCENT = 80
#: Share of a set that the first filter asks to be shared, in percent.
ASKED = 10
ORDERS = 3
#: Tokens that a task holds before it passes them on.
MOST_HELD = 400_000
#: Text bytes of a bucket, which a task sorts in memory, about; most buckets of a partition.
BUCKET_BYTES, MOST_BUCKETS = 4_000_000, 256
#: Sets of one batch that share a token, from which it counts as frequent everywhere.
FREQUENT = 64
#: Ids that may be broadcast (8 bytes each); more of them are joined by a shuffle.
MOST_BROADCAST = 1_000_000


def least_shared(n, percent: int = PERCENT):
    """Smallest number of shared tokens that a link of a set of ``n`` needs."""
    return -(-percent * n // 100)


def _asked(n):
    return -(-ASKED * n // 100)


def signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64).view(np.int64)


def _sets(with_sets: bool):
    """``key, text`` to ``key, n, digest, ref`` and the tokens: all, or those of the first filter."""

    def run(batches):
        for batch in batches:
            for part in parts_of(batch, "text"):
                sizes, digests, refs, tokens = [], [], [], []
                for text in part.column("text").to_pylist():
                    own = shingle_set(text)
                    raw, n = own.tobytes(), len(own)
                    sizes.append(n)
                    digests.append(xxhash.xxh3_128_hexdigest(raw))
                    refs.append(xxhash.xxh3_64_intdigest(raw))
                    tokens.append(raw if with_sets else own[: n - least_shared(n) + _asked(n)].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("key"),
                        pa.array(sizes, pa.int64()),
                        pa.array(digests),
                        pa.array(signed(np.array(refs, np.uint64))),
                        pa.array(tokens, pa.binary()),
                    ],
                    ["key", "n", "digest", "ref", "tokens"],
                )
        give_back()

    return run


def _shared_rows(tokens: np.ndarray, refs: np.ndarray, from_count: int):
    """Sorted distinct (token, ref) pairs and, for each, how many refs its token has."""
    order = np.lexsort((refs, tokens))
    tokens, refs = tokens[order], refs[order]
    if len(tokens):
        new = np.concatenate(([True], (tokens[1:] != tokens[:-1]) | (refs[1:] != refs[:-1])))
        tokens, refs = tokens[new], refs[new]
    first = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1]))) if len(tokens) else np.empty(0, int)
    counts = np.diff(np.append(first, len(tokens)))
    return tokens, refs, np.repeat(counts, counts)


_DEALT = "bucket int, key_rows binary, tokens binary, refs binary, runs binary, marked binary"


def _runs(refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate(([True], refs[1:] != refs[:-1]))) if len(refs) else np.empty(0, int)
    return refs[first], np.diff(np.append(first, len(refs))).astype("<u4")


def _deal(buckets: int, from_count: int):
    """Packs (token, ref) pairs by bucket of the token. Tokens that ``from_count`` refs of a batch have
    are only marked in their bucket; what their refs get for it goes along as finished rows."""

    def flush(held):
        tokens = np.concatenate([np.frombuffer(raw, np.uint64) for _, raw in held])
        refs = np.repeat(np.array([ref for ref, _ in held], np.int64), [len(raw) // 8 for _, raw in held])
        tokens, refs, counts = _shared_rows(tokens, refs, from_count)
        frequent = counts >= from_count
        marked = np.unique(tokens[frequent])
        done = np.argsort(refs[frequent], kind="stable")
        done_refs, done_runs = _runs(refs[frequent][done])
        done_tokens = tokens[frequent][done]
        tokens, refs = tokens[~frequent], refs[~frequent]
        bucket = (tokens % np.uint64(buckets)).astype(np.int32)
        order = np.lexsort((tokens, refs, bucket))
        bucket, tokens, refs = bucket[order], tokens[order], refs[order]
        ends = np.searchsorted(bucket, np.arange(buckets + 1))
        marked_bucket = (marked % np.uint64(buckets)).astype(np.int32)
        spread = np.argsort(marked_bucket, kind="stable")
        marked, marked_ends = marked[spread], np.searchsorted(marked_bucket[spread], np.arange(buckets + 1))
        for b in range(buckets):
            part = slice(ends[b], ends[b + 1])
            marks = marked[marked_ends[b] : marked_ends[b + 1]]
            if ends[b] == ends[b + 1] and not len(marks):
                continue
            of, runs = _runs(refs[part])
            yield b, None, tokens[part].tobytes(), of.tobytes(), runs.tobytes(), marks.tobytes()
        if len(done_refs):
            yield int(done_refs[0] % buckets), b"", done_tokens.tobytes(), done_refs.tobytes(), done_runs.tobytes(), None

    def batch_of(rows):
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])],
            ["bucket", "key_rows", "tokens", "refs", "runs", "marked"],
        )

    def run(batches: Iterator[pa.RecordBatch]):
        held, size = [], 0
        for batch in batches:
            for ref, raw in ((r, b) for p in parts_of(batch, "tokens") for r, b in zip(p.column("ref").to_pylist(), p.column("tokens").to_pylist())):
                held.append((ref, raw))
                size += len(raw) // 8
                if size > MOST_HELD:
                    if rows := list(flush(held)):
                        yield batch_of(rows)
                    held, size = [], 0
        if held and (rows := list(flush(held))):
            yield batch_of(rows)
        give_back()

    return run


def _bucket_rows(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[list[tuple]]:
    """The rows of one bucket at a time, of batches sorted by bucket."""
    held, of = [], None
    for batch in batches:
        for bucket, *row in zip(*(batch.column(x).to_pylist() for x in ("bucket", *columns))):
            if bucket != of and held:
                yield held
                held = []
            of = bucket
            held.append(row)
    if held:
        yield held


def _joined(parts: list[bytes], kind) -> np.ndarray:
    return np.frombuffer(b"".join(parts), kind)


def _count_tokens(keep_tokens: bool, buckets: int = 1):
    """Of each ref of a partition's buckets: how many of its tokens are shared, or which and how often.
    A marked token counts as ``2 ** 31 - 1``, wherever it is met. Buckets are sorted one at a time; what
    they give is passed on in lots of ``MOST_HELD``."""
    most = 2**31 - 1

    def shared_of(rows):
        own = [row for row in rows if row[0] is None]
        refs = np.repeat(_joined([row[2] for row in own], np.int64), _joined([row[3] for row in own], "<u4"))
        tokens, refs, counts = _shared_rows(_joined([row[1] for row in own], np.uint64), refs, 2)
        marks = np.unique(_joined([row[4] for row in own if row[4]], np.uint64))
        if len(marks) and len(tokens):
            counts = np.where(np.isin(tokens, marks), most, counts)
        shared = counts >= 2
        done = [row for row in rows if row[0] is not None]
        tokens = np.concatenate([tokens[shared], _joined([row[1] for row in done], np.uint64)])
        refs = np.concatenate([refs[shared], np.repeat(_joined([row[2] for row in done], np.int64), _joined([row[3] for row in done], "<u4"))])
        counts = np.concatenate([counts[shared], np.full(len(tokens) - int(shared.sum()), most)]).astype("<u4")
        return refs, tokens, counts

    def totals(held):
        refs = np.concatenate([of for of, _ in held])
        runs = np.concatenate([n for _, n in held])
        order = np.argsort(refs, kind="stable")
        of, _ = _runs(refs[order])
        sums = np.add.reduceat(runs[order], np.searchsorted(refs[order], of))
        return pa.RecordBatch.from_arrays([pa.array(of), pa.array(sums.astype(np.int64))], ["ref", "shared"])

    def by_home(held):
        refs, tokens, counts = (np.concatenate(x) for x in zip(*held))
        home = (refs % buckets).astype(np.int32)
        order = np.lexsort((refs, home))
        ends = np.searchsorted(home[order], np.arange(buckets + 1))
        rows = [[], [], [], []]
        for b in np.flatnonzero(np.diff(ends)):
            part = order[ends[b] : ends[b + 1]]
            for column, value in zip(rows, (int(b), refs[part].tobytes(), tokens[part].tobytes(), counts[part].tobytes())):
                column.append(value)
        return pa.RecordBatch.from_arrays(
            [pa.array(rows[0], pa.int32()), *(pa.array(c, pa.binary()) for c in rows[1:])], ["bucket", "refs", "tokens", "counts"]
        )

    def run(batches: Iterator[pa.RecordBatch]):
        held, size, pass_on = [], 0, by_home if keep_tokens else totals
        for rows in _bucket_rows(batches, ("key_rows", "tokens", "refs", "runs", "marked")):
            refs, tokens, counts = shared_of(rows)
            if not len(refs):
                continue
            held.append((refs, tokens, counts) if keep_tokens else _runs(np.sort(refs)))
            size += len(held[-1][0])
            if size > MOST_HELD:
                yield pass_on(held)
                held, size = [], 0
        if held:
            yield pass_on(held)
        give_back()

    return run


def _by_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The packed parts of each of a partition's buckets, a row for each set."""
    for rows in _bucket_rows(batches, ("refs", "tokens", "counts")):
        refs, tokens, counts = (_joined([row[i] for row in rows], kind) for i, kind in enumerate((np.int64, np.uint64, "<u4")))
        order = np.argsort(refs, kind="stable")
        of, runs = _runs(refs[order])
        tokens, counts = tokens[order], counts[order]
        ends = np.concatenate(([0], np.cumsum(runs, dtype=np.int64)))
        for start in range(0, len(of), 2_000):
            some = range(start, min(start + 2_000, len(of)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(of[start : start + 2_000]),
                    pa.array(runs[start : start + 2_000].astype(np.int64)),
                    pa.array([tokens[ends[i] : ends[i + 1]].tobytes() for i in some], pa.binary()),
                    pa.array([counts[ends[i] : ends[i + 1]].tobytes() for i in some], pa.binary()),
                ],
                ["ref", "shared", "tokens", "counts"],
            )
    give_back()


def _index(percent: int, orders: int):
    """The first tokens of each set under each order."""

    def run(batches):
        for batch in batches:
            out = [[], [], [], [], [], []]
            for ref, n, packed, counts in zip(*(batch.column(x).to_pylist() for x in ("ref", "n", "tokens", "counts"))):
                tokens, rarity = np.frombuffer(packed, np.uint64), np.frombuffer(counts, "<u4")
                most = n - least_shared(n, percent) + 1 - (n - len(tokens))  # tokens of no other set come first
                if most <= 0:
                    continue
                for order in range(orders):
                    chosen = tokens[np.lexsort((mixed(tokens, order + 1), rarity))[:most]]
                    out[0].append(np.full(len(chosen), order, np.int32))
                    out[1].append(signed(chosen))
                    out[2].append(np.full(len(chosen), ref, np.int64))
                    out[3].append(np.full(len(chosen), n, np.int64))
                    out[4].append(np.full(len(chosen), len(tokens), np.int64))
                    out[5].append(np.arange(len(chosen)) + (n - len(tokens)))
            if out[0]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in out], ["ord", "token", "ref", "n", "shared", "place"]
                )
        give_back()

    return run


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            linked = []
            for a, b in zip(binary_views(batch.column("left"), np.uint64), binary_views(batch.column("right"), np.uint64)):
                both = len(np.intersect1d(a, b, assume_unique=True))
                linked.append(100 * both >= percent * (len(a) + len(b) - both))
            mask = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])
        give_back()

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left = sets.select(F.col("ref").alias("a"), F.col("tokens").alias("left"))
    right = sets.select(F.col("ref").alias("b"), F.col("tokens").alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(_verify(percent), "a long, b long")


def _fits(a: str, b: str, percent: int):
    """Whether two sets can link of which this token is the first that they share: they share at most
    what either shares with any other set, and what is left of both from the token's place on; the rest of
    both is in their union."""
    behind = F.least(F.col(f"{a}n") - F.col(f"{a}place"), F.col(f"{b}n") - F.col(f"{b}place"))
    most = F.least(f"{a}shared", f"{b}shared", behind)
    return 100 * most >= percent * (F.col(f"{a}n") + F.col(f"{b}n") - most)


def link_sets(candidates: DataFrame, sets: DataFrame, percent: int, orders: int) -> DataFrame:
    """Verified links ``a, b`` that join all linked sets, from an index ``ord, token, ref, n, shared, place``."""
    columns = ("ord", "token", "ref", "n", "shared", "place")
    first = candidates.where("ord = 0")
    links = None
    labelled = first.withColumn("component", F.col("ref"))
    # A hub for each token that reaches over components: the set with the least of its own, then any.
    for rank in ((F.col("n") - F.col("shared"), F.col("ref")), (F.xxhash64("ref"), F.col("ref"))):
        tops = labelled.groupBy("token").agg(
            F.min(F.struct(rank[0].alias("by"), rank[1].alias("ref"), "n", "shared", "place", "component")).alias("hub"),
            F.min("component").alias("low"),
            F.max("component").alias("high"),
        ).where("low <> high")
        spokes = (
            labelled.join(tops.select("token", *(F.col(f"hub.{c}").alias(f"hub_{c}") for c in ("ref", "n", "shared", "place", "component"))), "token")
            .where((F.col("component") != F.col("hub_component")) & _fits("", "hub_", percent))
            .groupBy(F.col("ref").alias("a"), F.col("hub_ref").alias("b"))
            .agg(F.count("*").alias("votes"))
            .groupBy("a")
            .agg(F.max_by("b", F.struct("votes", "b")).alias("b"))
        )
        found = stored(_verified(spokes, sets, percent), "spokes")
        links = found if links is None else links.unionByName(found)
        labels = components(links)
        labelled = first.join(labels, first.ref == labels.node, "left").select(*columns, F.coalesce("component", "ref").alias("component"))
    everywhere = candidates.join(labels, candidates.ref == labels.node, "left").select(
        *columns, F.coalesce("component", "ref").alias("component")
    )
    apart = everywhere.groupBy("ord", "token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    left = stored(everywhere.join(apart.select("ord", "token"), ["ord", "token"], "left_semi"), "apart")
    right = left.select("ord", "token", *(F.col(x).alias(f"other_{x}") for x in ("ref", "n", "shared", "place", "component")))
    pairs = [
        left.where(F.col("ord") == order)
        .join(right.where(F.col("ord") == order), ["ord", "token"])
        .where((F.col("ref") < F.col("other_ref")) & (F.col("component") != F.col("other_component")) & _fits("", "other_", percent))
        .select(F.col("ref").alias("a"), F.col("other_ref").alias("b"))
        .distinct()
        for order in range(orders)
    ]
    crossing = _verified(reduce(lambda x, y: x.join(y, ["a", "b"], "left_semi"), pairs), sets, percent)
    return links.unionByName(stored(crossing, "crossing"))


def near_copies(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    percent: int = PERCENT,
    orders: int = ORDERS,
) -> DataFrame:
    """``<id>, n_shingles, digest, component_id`` of every row.

    Documents link when ``100 * shared >= percent * united`` over their distinct five-word shingles;
    a text of fewer words is one shingle. ``component_id`` is the smallest id reachable by links, its
    own for texts without words (null and empty ones), which link with nothing. Null ids are never the
    smallest unless there is no other; rows with equal ids or texts keep a row each. ``digest`` is the
    class of equal sets. Other columns are not looked at.
    """
    with small_batches(docs.sparkSession):
        return _near_copies(docs, id_column, text_column, percent, orders)


def _near_copies(docs, id_column, text_column, percent, orders) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).cast("long").alias("key"), text_of(text_column).alias("text"))
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(parts, min(-(-size // BUCKET_BYTES), MOST_BUCKETS * parts))

    def by_bucket(df):  # sorted by the JVM, which spills, so that a task holds one bucket
        return df.repartition(parts, "bucket").sortWithinPartitions("bucket")

    schema = "key long, n long, digest string, ref long, tokens binary"
    # The sets' rows and the packed tokens travel together: one pass over the texts.
    dealt = rows.mapInArrow(_sets_and_deal(buckets), f"key long, n long, digest string, ref long, {_DEALT}")
    signed_sets = stored(by_bucket(dealt).mapInArrow(_pass_and_count(), "key long, n long, digest string, ref long, shared long"), "shingle-sets")
    sizes = signed_sets.where("n is not null")
    classes = stored(sizes.groupBy("digest").agg(F.min("key").alias("first"), F.first("n").alias("n"), F.first("ref").alias("ref")), "set-classes")
    shared = signed_sets.where("shared is not null").groupBy("ref").agg(F.sum("shared").alias("shared"))
    least = F.ceil(F.lit(percent) * F.col("n") / 100)
    hopeful = stored(
        classes.where("n > 0").join(shared, "ref").where(F.col("shared") >= F.ceil(F.lit(ASKED) * least / 100)).select("ref", "first"),
        "hopeful-sets",
    )
    ids = hopeful.select(F.col("first").alias("key"))
    ids = F.broadcast(ids) if hopeful.count() <= MOST_BROADCAST else ids
    chosen = rows.join(ids.distinct(), rows.key.eqNullSafe(ids.key), "left_semi")
    sets = stored(
        chosen.mapInArrow(_sets(True), schema).join(hopeful.select("ref"), "ref", "left_semi").dropDuplicates(["ref"]).select("ref", "n", "tokens"),
        "hopeful-tokens",
    )
    found = by_bucket(sets.select("ref", "tokens").mapInArrow(_deal(buckets, FREQUENT), _DEALT)).mapInArrow(
        _count_tokens(True, buckets), "bucket int, refs binary, tokens binary, counts binary"
    )
    counted = by_bucket(found).mapInArrow(_by_set, "ref long, shared long, tokens binary, counts binary")
    candidates = stored(
        sets.select("ref", "n").join(counted, "ref").where(F.col("shared") >= least).select("ref", "n", "tokens", "counts")
        .mapInArrow(_index(percent, orders), "ord int, token long, ref long, n long, shared long, place long"),
        "first-tokens",
    )
    links = link_sets(candidates, sets, percent, orders)
    labels = components(links)
    of_class = classes.join(labels, classes.ref == labels.node, "left").select(
        "digest", "first", "n", F.coalesce("component", "ref").alias("component")
    )
    smallest = of_class.groupBy("component").agg(F.min("first").alias("component_id"))
    of_class = of_class.join(smallest, "component").select("digest", "component_id")
    return sizes.select("key", "n", "digest").join(of_class, "digest").select(
        F.col("key").alias(id_column),
        F.col("n").alias("n_shingles"),
        "digest",
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key")).alias("component_id"),
    )


def _sets_and_deal(buckets: int):
    """One pass over the texts: a row for each text, and the packed tokens of the first filter."""
    sets, deal = _sets(False), _deal(buckets, 2)

    def run(batches):
        fields = [("key", pa.int64()), ("n", pa.int64()), ("digest", pa.string()), ("ref", pa.int64()), ("bucket", pa.int32())]
        fields += [(x, pa.binary()) for x in ("key_rows", "tokens", "refs", "runs", "marked")]

        def padded(batch, **more):
            have = {name: batch.column(name) for name in batch.schema.names} | more
            return pa.RecordBatch.from_arrays(
                [have.get(name, pa.nulls(batch.num_rows, kind)) for name, kind in fields], [name for name, _ in fields]
            )

        passed = []

        def through():
            for batch in sets(batches):
                spread = pa.array((batch.column("ref").to_numpy() % buckets).astype(np.int32))
                passed.append(padded(batch.drop_columns(["tokens"]), bucket=spread))
                yield batch

        for packed in deal(through()):
            yield from passed
            passed.clear()
            yield padded(packed)
        yield from passed

    return run


def _pass_and_count():
    """Lets the rows of texts through and counts the shared tokens of the packed ones."""
    count = _count_tokens(False)

    def run(batches):
        passed = []

        def packed():
            for batch in batches:
                is_set = pc.is_valid(batch.column("n"))
                own = batch.filter(is_set)
                if own.num_rows:
                    passed.append(own.select(["key", "n", "digest", "ref"]))
                yield batch.filter(pc.invert(is_set))

        names = ["key", "n", "digest", "ref", "shared"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

        def let_through():
            for own in passed:
                yield pa.RecordBatch.from_arrays([*(own.column(x) for x in names[:4]), pa.nulls(own.num_rows, pa.int64())], names)
            passed.clear()

        for counted in count(packed()):
            yield from let_through()
            have = {"ref": counted.column("ref"), "shared": counted.column("shared")}
            yield pa.RecordBatch.from_arrays([have.get(x, pa.nulls(counted.num_rows, k)) for x, k in zip(names, kinds)], names)
        yield from let_through()

    return run
