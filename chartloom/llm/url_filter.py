"""URL verdicts: explicit rules first, gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

Rule = tuple[str, str, str]  # host, path, verdict

#: Labelled URLs that the trees are fitted on, at most; the smallest hashes of the distinct URLs.
MOST_LABELLED = 20_000
TREES = 12
DEPTH = 4
FEATURES = [
    "url_length", "host_length", "path_length", "depth", "host_labels", "digit_ratio", "host_digits", "hyphens",
    "entropy", "n_parameters", "n_escapes", "has_fragment", "is_https", "suffix_share", "suffix_allowed",
]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    rest = F.substring_index(F.substring_index(F.substring_index(_after(url), "/", 1), "?", 1), "#", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    after = F.substring_index(F.substring_index(_after(url), "?", 1), "#", 1)
    return F.substr(after, F.length(F.substring_index(after, "/", 1)) + 1)


def _after(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct ``rule, verdict`` of the longest rule that fits; null if none does."""
    fitting = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        fitting = F.when(
            fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        ).otherwise(fitting)
    return fitting


def _entropy(text: Column) -> Column:
    """Bits per character."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.greatest(F.size(chars), F.lit(1))

    def bits(total, char):
        share = F.size(F.filter(chars, lambda other: other == char)) / n
        return total - share * F.log2(share)

    return F.aggregate(F.array_distinct(chars), F.lit(0.0), bits)


def lexical_features(urls: DataFrame) -> DataFrame:
    """Adds the lexical columns of ``FEATURES`` (but the two of the suffix) to ``url, host, path``."""
    url, host, path = F.col("url"), F.col("host"), F.col("path")
    query = F.substring_index(F.when(F.locate("?", url) > 0, F.substr(url, F.locate("?", url) + 1)).otherwise(""), "#", 1)
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    return urls.withColumns({
        "url_length": F.length(url).cast("double"),
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "depth": count(path, "/[^/]"),
        "host_labels": count(host, "[^.]+"),
        "digit_ratio": count(url, "[0-9]") / F.greatest(F.length(url), F.lit(1)),
        "host_digits": count(host, "[0-9]"),
        "hyphens": count(url, "-"),
        "entropy": _entropy(F.concat(host, path)),
        "n_parameters": count(query, "[^&]+"),
        "n_escapes": count(url, "%[0-9A-Fa-f]{2}"),
        "has_fragment": (F.locate("#", url) > 0).cast("double"),
        "is_https": F.startswith(F.lower(url), F.lit("https:")).cast("double"),
        "suffix": F.substring_index(host, ".", -1),
    })


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    id_column: str = "page_id",
    url_column: str = "url",
    most_labelled: int = MOST_LABELLED,
) -> DataFrame:
    """``<id>, host, path, rule, verdict, block_score`` of every row.

    A rule fits its host and all subdomains when the path starts with the rule's path; the longest
    rule wins. URLs that a rule judges are the labelled ones: suffix statistics come from all of them,
    and the trees are fitted on at most ``most_labelled`` distinct ones. URLs without a rule get the
    trees' verdict. If the labelled URLs hold one verdict or none, that one (or ``allow``) goes to the
    rest. A null URL, or one without ``://``, has an empty host and path and is judged by the trees
    like any other; repeated rows and null ids keep a row each; other columns are not looked at.
    """
    judged = pages.select(F.col(id_column).alias("key"), F.coalesce(F.col(url_column), F.lit("")).alias("url")).select(
        "key", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    )
    judged = judged.withColumn("fitting", rule_for(F.col("host"), F.col("path"), rules))
    featured = lexical_features(judged).withColumn(
        "label", F.when(F.col("fitting.verdict") == "block", 1.0).when(F.col("fitting").isNotNull(), 0.0)
    )
    # One row for each suffix; top-level domains are a bounded set of names, junk ones are rare rows.
    suffixes = featured.groupBy("suffix").agg(
        F.count("*").alias("n"), F.count("label").alias("n_labelled"), F.sum("label").alias("n_blocked")
    )
    total = suffixes.agg(F.sum("n").alias("total"))
    suffixes = suffixes.crossJoin(F.broadcast(total)).select(
        "suffix",
        (F.col("n") / F.col("total")).alias("suffix_share"),
        ((F.col("n_labelled") - F.coalesce("n_blocked", F.lit(0.0)) + 1) / (F.col("n_labelled") + 2)).alias("suffix_allowed"),
    )
    joined = featured.join(suffixes, "suffix", "left")
    labelled = (
        joined.where("label is not null").dropDuplicates(["url"]).orderBy(F.xxhash64("url"), "url").limit(most_labelled)
    )
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep")
    training = assembler.transform(labelled).select("label", "features").coalesce(4).cache()
    try:
        classes = sorted(row[0] for row in training.select("label").distinct().collect())
        if len(classes) < 2:
            score = F.lit(classes[0] if classes else 0.0)
            scored = joined.withColumn("block_score", score)
        else:
            model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, maxBins=32).fit(training)
            model.setPredictionCol("").setRawPredictionCol("")
            scored = model.transform(assembler.transform(joined)).withColumn(
                "block_score", vector_to_array("probability")[1]
            )
    finally:
        training.unpersist()
    return scored.select(
        F.col("key").alias(id_column),
        "host",
        "path",
        F.col("fitting.rule").alias("rule"),
        F.coalesce("fitting.verdict", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")).alias("verdict"),
        F.round("block_score", 6).alias("block_score"),
    )
