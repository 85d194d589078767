"""Document fingerprints by winnowing, with DataFrame functions only.

A text is a sequence of words, lower-cased and cut at white space. Each run of ``GRAM`` words has a rolling
hash, made from the hashes of its words; of each ``WINDOW`` runs in a row the smallest is kept, the
rightmost one of equal ones, with its position. Two texts that share ``GRAM + WINDOW - 1`` words in a row
therefore share a kept hash. A text of fewer words is one run; one of fewer runs is one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from chartloom.functions.text import bind
from chartloom.llm.common import stored, text_of

GRAM = 5
#: A power of two.
WINDOW = 16
#: A kept run is one number: 37 bits of its hash, then 26 bits that grow towards the left.
PLACES = 1 << 26
#: Documents in a run of the order by id, about.
RUN = 4_096


def word_list(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda word: word != "")


def _packed(words: Column, gram: int) -> Column:
    """Each run of words as one number, smallest hash first and rightmost first among equals."""

    def runs(hashes):
        n = F.size(hashes)
        one_run = F.xxhash64(F.array_join(hashes.cast("array<string>"), " "))
        at = lambda i, j: F.get(hashes, i + j)
        pack = lambda value, i: F.shiftrightunsigned(value, 27) * PLACES + (PLACES - 1 - F.least(i, F.lit(PLACES - 1)))
        return (
            F.when(n == 0, F.array().cast("array<bigint>"))
            .when(n < gram, F.array(pack(one_run, F.lit(0))))
            .otherwise(
                F.transform(
                    F.sequence(F.lit(0), F.greatest(n - gram, F.lit(0))),
                    lambda i: pack(F.xxhash64(*(at(i, j) for j in range(gram))), i),
                )
            )
        )

    return bind(F.transform(words, lambda word: F.xxhash64(word)), runs)


def _smallest_of_windows(packed: Column, window: int) -> Column:
    """Minima of all full windows, by doubling their width; of all runs when there are fewer."""

    def doubled(values: Column, width: int) -> Column:
        if width == window:
            full = F.greatest(F.size(values) - (window - 1), F.least(F.size(values), F.lit(1)))
            return F.array_distinct(F.slice(values, 1, full))
        # The shifted array ends early; least() skips the missing values.
        wider = lambda v: F.zip_with(v, F.slice(v, width + 1, F.greatest(F.size(v) - width, F.lit(0))), lambda a, b: F.least(a, b))
        return bind(wider(values), lambda v: doubled(v, 2 * width))

    return bind(packed, lambda values: doubled(values, 1))


def winnowed(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """Kept runs of a text in order of position, packed."""
    return _smallest_of_windows(_packed(word_list(text), gram), window)


def unpacked(kept: Column) -> Column:
    return F.transform(
        kept,
        lambda v: F.struct(
            F.shiftright(v, 26).alias("hash"), (PLACES - 1 - v.bitwiseAND(PLACES - 1)).cast("int").alias("position")
        ),
    )


def hashes_of(kept: Column) -> Column:
    return F.array_distinct(F.transform(kept, lambda v: F.shiftright(v, 26)))


def likeness(left: Column, right: Column) -> Column:
    """Shared share of two sets of hashes; two empty ones are alike."""

    def of_sizes(both):
        union = F.size(left) + F.size(right) - both
        return F.when(union == 0, F.lit(1.0)).otherwise(both / union)

    return bind(F.size(F.array_intersect(left, right)), of_sizes)


def with_next_document(docs: DataFrame) -> DataFrame:
    """``key, text`` with the text and kept runs of the next document in descending order of ``key``.

    The ids are cut into runs of about ``RUN`` documents, which are sorted in tasks of their own; only
    the top document of each run is sent to the run above it, whose last document it follows.
    """
    spark = docs.sparkSession
    n, low, high = docs.agg(F.count("*"), F.min("key"), F.max("key")).first()
    width = max(1, RUN * ((high or 0) - (low or 0) + 1) // max(n, 1))
    keyed = docs.withColumn(
        "run", F.coalesce(F.floor((F.col("key") - F.lit(low or 0)) / F.lit(width)), F.lit(-1)).cast("long")
    )
    runs = keyed.groupBy("run").agg(F.max("key").alias("key")).withColumn("many", F.floor(F.col("run") / RUN))
    within = Window.partitionBy("many").orderBy("run")
    runs = runs.select("run", "key", "many", F.lead("run").over(within).alias("above"))
    # What stands above the last run of each ``RUN`` runs; as many rows as there are ``RUN * RUN`` documents.
    bounds = runs.groupBy("many").agg(F.min("run").alias("first"))
    outer = Window.orderBy("many")
    whole = Window.orderBy("many").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bounds = bounds.select("many", F.coalesce(F.lead("first").over(outer), F.first("first").over(whole)).alias("outside"))
    # Stored, so that its size is known before the join: Spark broadcasts it up to its own limit only.
    heads = stored(runs.join(bounds, "many").select("key", F.coalesce("above", "outside").alias("to")), "run-tops")
    tops = keyed.alias("d").join(heads.alias("h"), F.col("d.key").eqNullSafe(F.col("h.key"))).select(
        "d.key", "text", F.col("to").alias("run"), F.lit(True).alias("is_top")
    )
    placed = keyed.select("key", "text", "run", F.lit(False).alias("is_top")).unionByName(tops)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = placed.repartition(partitions, "run").withColumn("kept", winnowed(F.col("text")))
    order = Window.partitionBy("run").orderBy("is_top", F.desc_nulls_last("key"), F.desc("text"))
    return placed.select(
        "key", "text", "kept", "is_top", F.lead("text").over(order).alias("next_text"), F.lead("kept").over(order).alias("next_kept")
    ).where(~F.col("is_top"))


def fingerprint_edits(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprint of every text and of its edited text, and how alike they and the next text are.

    The edited text has its last third (of the code points, rounded down) replaced by as many first code
    points of the next document in descending order of id, or by all of them; the first document follows
    the last. Null texts are empty. Null ids come last, equal ids in descending order of their texts, so
    repeated rows follow each other; a lone document follows itself. A text without words has an empty
    fingerprint, and two empty ones are alike (1). Other columns are not looked at.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("key"), text_of(text_column).alias("text"))
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))

    def figures(changed):
        def compared(changed_kept):
            own = lambda body: bind(hashes_of(F.col("kept")), body)
            return own(
                lambda h: F.struct(
                    F.sha2(changed.cast("binary"), 256).alias("sha256"),
                    unpacked(changed_kept).alias("fingerprint"),
                    likeness(h, hashes_of(changed_kept)).alias("near_edited"),
                    likeness(h, hashes_of(F.col("next_kept"))).alias("near_next"),
                )
            )

        return bind(winnowed(changed), compared)

    return (
        with_next_document(rows)
        .select("key", n.cast("long").alias("n_chars"), unpacked(F.col("kept")).alias("fingerprint"), bind(edited, figures).alias("f"))
        .select(
            F.col("key").alias(id_column),
            "n_chars",
            F.col("f.sha256").alias("edited_sha256"),
            "fingerprint",
            F.col("f.fingerprint").alias("edited_fingerprint"),
            F.col("f.near_edited").alias("near_edited"),
            F.col("f.near_next").alias("near_next"),
        )
    )
