"""What each of several filters removes under every order of applying them, without trying the orders.

A document counts by the set of filters that it fails, its mask. Orders are ranked lexicographically by
their Lehmer code, so all orders that begin alike are one interval of ranks. A mask is removed at step
``s`` by filter ``f`` exactly in the orders that begin with ``s - 1`` filters outside the mask and then
``f``: a few intervals for each mask. A count is added at the start of each interval and taken off behind
its end, and prefix sums over the ranks give the removals of every order and step. The documents are read
once; what follows works on a count for each part and mask, whatever the number of documents.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window, functions as F

from chartloom.llm.common import stored, text_of

WHITE_RUN = r"[\x20\x09-\x0D]+"


def text_failures(text: Column) -> dict[str, Column]:
    """The failure conditions that look at one text only, by letter."""
    words = F.filter(F.split(text, WHITE_RUN), lambda word: word != "")
    capitals = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 3 * F.char_length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def lehmer_rank(order: tuple[int, ...]) -> int:
    """Place of a permutation of ``0 ... n - 1`` among all in lexicographic order."""
    n = len(order)
    return sum(
        sum(later < item for later in order[at + 1 :]) * math.factorial(n - 1 - at) for at, item in enumerate(order)
    )


def removal_intervals(n: int) -> list[tuple[int, int, int, int]]:
    """``(mask, step, first rank, rank behind the last)`` of every beginning that removes a mask.

    Bit ``i`` of a mask is the ``i``-th filter. The beginnings of ``s`` filters are the same for all tables,
    so the list depends on the number of filters only; for five it has 840 entries.
    """
    found = []
    for step in range(1, n + 1):
        width = math.factorial(n - step)
        for beginning in permutations(range(n), step):
            rest = tuple(i for i in range(n) if i not in beginning)
            first = lehmer_rank(beginning + rest)
            for mask in range(1, 1 << n):
                if mask >> beginning[-1] & 1 and not any(mask >> i & 1 for i in beginning[:-1]):
                    found.append((mask, step, first, first + width))
    return found


def failure_counts(
    docs: DataFrame,
    labels: DataFrame,
    failures: Mapping[str, Column] | None = None,
    duplicates: str = "E",
    id_column: str = "doc_id",
    text_column: str = "text",
    part_column: str = "lang",
) -> DataFrame:
    """``part, mask, n, good, toxic``: documents of each part that fail exactly the filters of a mask, and
    how many of them are labelled good and toxic.

    ``failures`` maps letters, in order, to conditions over the column ``text``; ``duplicates`` is the letter
    of the filter that fails rows whose text a smaller id has anywhere in the table (none: leave it
    out with an empty string). Null texts are empty and equal to empty ones, null parts are the empty
    string. A null condition passes. Rows with a null id have no label and count as not
    repeated, since no id is smaller; rows that repeat an id are counted each, and don't repeat one another.
    Of several label rows of an id, any good and any toxic one counts.
    """
    failures = dict(failures or text_failures(F.col("text")))
    letters = [*failures, *([duplicates] if duplicates else [])]
    own = sum(F.when(condition, 1 << i).otherwise(0) for i, condition in enumerate(failures.values()))
    facts = docs.select(
        F.col(id_column).alias("id"), F.coalesce(F.col(part_column).cast("string"), F.lit("")).alias("part"),
        text_of(text_column).alias("text"),
    ).select("id", "part", F.sha2("text", 256).alias("digest"), F.lit(own).cast("int").alias("mask"))
    # Labels of an id in one row; copies of a text collapse before the digest is a key.
    labelled = labels.where(F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("label_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    known = facts.where("id is not null").join(labelled, F.col("id") == F.col("label_id"), "left").drop("label_id")
    groups = ["digest", "part", "mask", "good", "toxic"]
    # One row for each id first: a text's smallest id may stand in several rows.
    by_id = known.fillna(False, ["good", "toxic"]).groupBy("id", *groups).agg(F.count("*").alias("n"))
    least = F.min(F.struct("id", "n"))
    by_text = by_id.groupBy(*groups).agg(F.sum("n").alias("n"), least.alias("least"))
    # A text has a row for each part and label only, however many copies it has.
    same_text = Window.partitionBy("digest")
    first = F.when(F.col("least.id") == F.min("least.id").over(same_text), F.col("least.n")).otherwise(0)
    by_text = by_text.withColumn("first", first)
    if duplicates:
        bit = 1 << (len(letters) - 1)
        either = F.explode(
            F.array(
                F.struct(F.col("mask"), F.col("first").alias("n")),
                F.struct((F.col("mask") + bit).alias("mask"), (F.col("n") - F.col("first")).alias("n")),
            )
        ).alias("counted")
        by_text = by_text.select("part", "good", "toxic", either).select("part", "good", "toxic", "counted.mask", "counted.n")
    nameless = facts.where("id is null").groupBy("part", "mask").agg(F.count("*").alias("n")).select(
        "part", F.lit(False).alias("good"), F.lit(False).alias("toxic"), "mask", "n"
    )
    rows = by_text.select("part", "good", "toxic", "mask", "n").unionByName(nameless).where("n > 0")
    share = lambda flag: F.sum(F.when(flag, F.col("n")).otherwise(0))
    return rows.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), share(F.col("good")).alias("good"), share(F.col("toxic")).alias("toxic")
    )


def audit_orders(counts: DataFrame, letters: str) -> DataFrame:
    """One row for each part, order of the filters and step, from ``part, mask, n, good, toxic``.

    ``filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley`` as
    documents of the part: kept after the step and removed by its filter; failing that filter but removed
    before; failing it alone; labelled good or toxic and removed here; removed by that filter, at any step,
    summed over all orders. An empty table has no parts and no rows. Up to seven filters.
    """
    n = len(letters)
    if not 0 < n <= 7 or len(set(letters)) != n:
        raise ValueError("one to seven filters with a letter each")
    spark = counts.sparkSession
    # Tables of these sizes: a row for each beginning of an order, and one for each order.
    intervals = spark.createDataFrame(removal_intervals(n), "mask int, step int, low int, high int")
    orders = spark.createDataFrame(
        [(rank, "".join(order)) for rank, order in enumerate(permutations(letters))], "rank int, filter_order string"
    )
    ends = F.explode(F.array(F.struct(F.col("low").alias("rank"), F.lit(1).alias("sign")), F.struct(F.col("high").alias("rank"), F.lit(-1).alias("sign"))))
    differences = (
        counts.join(F.broadcast(intervals), "mask")
        .select("part", "step", "n", "good", "toxic", ends.alias("end"))
        .groupBy("part", "step", F.col("end.rank").alias("rank"))
        .agg(*(F.sum(F.col("end.sign") * F.col(x)).alias(f"d_{x}") for x in ("n", "good", "toxic")))
    )
    steps = F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step")
    ranks = F.explode(F.sequence(F.lit(0), F.lit(math.factorial(n) - 1))).alias("rank")
    grid = counts.select("part").distinct().select("part", steps).select("part", "step", ranks).join(F.broadcast(orders), "rank")
    along = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    removals = grid.join(differences, ["part", "step", "rank"], "left").select(
        "part", "step", "rank", "filter_order", F.substring(F.col("filter_order"), F.col("step"), F.lit(1)).alias("letter"),
        *(F.sum(F.coalesce(f"d_{x}", F.lit(0))).over(along).alias(name) for x, name in
          (("n", "removed"), ("good", "good_lost"), ("toxic", "toxic_lost"))),
    )
    fails = counts.groupBy("part").agg(
        F.sum("n").alias("documents"),
        F.map_from_arrays(
            F.array(*(F.lit(letter) for letter in letters)),
            F.array(*(F.struct(
                F.sum(F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.col("n")).otherwise(0)).alias("any"),
                F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0)).alias("only"),
            ) for i in range(n))),
        ).alias("fails"),
    )
    before = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    by_letter = Window.partitionBy("part", "letter")
    return removals.join(fails, "part").select(
        "part", "filter_order", "step",
        (F.col("documents") - F.sum("removed").over(before)).alias("kept"),
        "removed",
        (F.col("fails")[F.col("letter")]["any"] - F.col("removed")).alias("redundant"),
        F.col("fails")[F.col("letter")]["only"].alias("unique_fails"),
        "good_lost", "toxic_lost",
        F.sum("removed").over(by_letter).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters A to E over whole texts, by language; see ``failure_counts`` on odd rows."""
    return audit_orders(stored(failure_counts(docs, labels), "failure-counts"), "ABCDE")


#: The same by brute force: every document under every order.
AUDIT_SQL = r"""
WITH facts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), firsts AS (
  SELECT t AS first_text, min(doc_id) AS first_id FROM facts GROUP BY t
), worded AS (
  SELECT f.*, first_id, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM facts f JOIN firsts ON t = first_text
), marked AS (
  SELECT doc_id, part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
         100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) AS c,
         regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > first_id, false) AS e
  FROM worded
), known AS (
  SELECT doc_id AS label_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
         max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id
), docs AS (
  SELECT part, (CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END
         || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END) AS failed,
         count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(bad, 0)) AS bad
  FROM marked LEFT JOIN known ON doc_id = label_id GROUP BY 1, 2
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f
), orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.f <> b.f AND a.f <> c.f AND a.f <> d.f AND a.f <> e.f AND b.f <> c.f AND b.f <> d.f AND b.f <> e.f
    AND c.f <> d.f AND c.f <> e.f AND d.f <> e.f
), steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS earlier
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), judged AS (
  SELECT part, filter_order, step, f, n, good, bad, failed,
         translate(failed, earlier, '') <> failed AS gone, contains(failed, f) AS fails
  FROM docs, steps
), audited AS (
  SELECT part, filter_order, step, f,
         sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN gone AND fails THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN failed = f THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN NOT gone AND fails THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN NOT gone AND fails THEN bad ELSE 0 END) AS toxic_lost
  FROM judged GROUP BY 1, 2, 3, 4
)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM audited
"""
