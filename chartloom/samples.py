"""Messages and document files derived from the test tables, with column expressions only.

Every order becomes one message and every document one file row; the variants below change how
some of them are written (faults, repeats, other line ends) and drop none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chartloom.operators.documents import spread
from chartloom.session import read_table

LINE_ORDER = [
    "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]

HEADERLESS, NO_TEXT, SECOND_PATIENT, REPEATED_FIELD = 97, 101, 83, 89
CUSTOM_SEGMENT, NEWLINE_ENDS, LONG_VISIT, CONTACT = 79, 73, 71, 5


def _every(number: int) -> Column:
    return F.col("o_orderkey") % number == 0


def _line(*fields) -> Column:
    return F.concat_ws("|", *[F.lit(f) if isinstance(f, str) else f for f in fields])


def order_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(o_orderkey, lines ARRAY<STRING>)``: the message lines of every order, in order."""
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    items = (
        read_table(spark, sf_dir, "lineitem")
        .select("l_orderkey", *LINE_ORDER)
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        # Dealt as rows: arrays collected before the shuffle hold next to nothing each and are sorted on disk.
        .repartition("l_orderkey")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(
            F.sort_array(F.collect_list(F.struct(*LINE_ORDER, "p_name", "p_type"))).alias("items")
        )
    )
    customer = read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment"
    )
    orders = (
        read_table(spark, sf_dir, "orders")
        .join(customer, "o_custkey")
        .join(items, "o_orderkey", "left")
    )

    key = F.col("o_orderkey").cast("string")
    patient = F.col("o_custkey").cast("string")
    when = F.date_format("o_orderdate", "yyyyMMddHHmmss")
    items_col = F.coalesce("items", F.array())
    patient_tail = F.when(_every(REPEATED_FIELD), F.lit("a~b")).otherwise(F.col("c_mktsegment"))

    def optional(condition: Column, line: Column) -> Column:
        return F.when(condition, F.array(line)).otherwise(F.array().cast("array<string>"))

    observations = F.transform(
        items_col,
        lambda item, i: _line(
            "OBX", (i + 1).cast("string"), "NM", item["l_partkey"].cast("string"), "",
            item["l_quantity"].cast("bigint").cast("string"),
        ),
    )
    allergies = F.filter(
        F.transform(
            items_col,
            lambda item, i: F.when(
                item["l_returnflag"] == "R",
                _line("AL1", (i + 1).cast("string"), "DA", item["p_name"]),
            ),
        ),
        lambda line: line.isNotNull(),
    )
    long_visit = _line("PV1", *[f"v{n}" for n in range(1, 55)])
    lines = F.concat(
        optional(
            ~_every(HEADERLESS),
            _line("MSH", "^~\\&", "SRC", "FAC", "DST", "DFAC", when, "", "ADT^A01", key, "P", "2.5"),
        ),
        F.array(_line("EVN", "A01", when)),
        F.array(
            _line("PID", "1", "", patient, "", F.col("c_name"), "", "", "", "", "", patient_tail)
        ),
        optional(
            _every(SECOND_PATIENT),
            _line("PID", "2", "", F.concat(patient, F.lit("-2")), "", F.col("c_name")),
        ),
        F.array(
            F.when(_every(LONG_VISIT), long_visit).otherwise(
                _line("PV1", "1", F.col("o_orderstatus"), F.col("o_orderpriority"))
            )
        ),
        optional(
            F.size(items_col) > 0,
            _line("OBR", "1", key, "", F.get(items_col, F.lit(0))["p_type"]),
        ),
        observations,
        optional(_every(CONTACT), _line("CTI", key)),
        allergies,
        optional(_every(CUSTOM_SEGMENT), _line("ZZZ", "custom", key)),
    )
    return orders.select("o_orderkey", lines.alias("lines"))


def message_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(file_path, value)``: one message text per order, in the shape of the raw table."""
    joined = F.when(_every(NEWLINE_ENDS), F.array_join("lines", "\n")).otherwise(
        F.array_join("lines", "\r")
    )
    return order_messages(spark, sf_dir).select(
        F.concat(F.lit("/landing/part-00"), F.col("o_orderkey").cast("string")).alias("file_path"),
        F.when(~_every(NO_TEXT), joined).alias("value"),
    )


def message_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(file_path, line_no, value)``: the lines of every message as rows of their own."""
    return order_messages(spark, sf_dir).select(
        F.concat(F.lit("/landing/part-00"), F.col("o_orderkey").cast("string")).alias("file_path"),
        F.posexplode("lines").alias("line_no", "value"),
    )


def supplier_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(name, value)``: one short message per supplier, for tests with one file per message."""
    key = F.col("s_suppkey").cast("string")
    lines = F.array(
        _line("MSH", "^~\\&", "SRC", "FAC", "DST", "DFAC", "20240101", "", "ADT^A04", key),
        _line("PID", "1", "", key, "", F.col("s_name")),
        _line("PV1", "1", "N", F.col("s_nationkey").cast("string")),
    )
    return read_table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("part-00"), key).alias("name"), F.array_join(lines, "\n").alias("value")
    )


def supplier_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(file_path, line_no, n_lines, value)``: the same messages as lines."""
    lines = F.split("value", "\n")
    return supplier_messages(spark, sf_dir).select(
        F.col("name").alias("file_path"), F.size(lines).cast("long").alias("n_lines"), F.posexplode(lines).alias("line_no", "value")
    ).select("file_path", F.col("line_no").cast("long").alias("line_no"), "n_lines", "value")


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(path, modificationTime, length, content)``, one row per document, as a file scan gives."""
    doc = F.col("doc_id")
    extension = F.element_at(
        F.array(*[F.lit(e) for e in (".txt", ".md", ".TXT", ".xyz")]), (doc % 4 + 1).cast("int")
    )
    content = (
        F.when(doc % 31 == 0, F.unhex(F.lit("FF41")))
        .when(doc % 29 == 0, F.encode(F.lit(" \n\t "), "UTF-8"))
        .otherwise(F.encode("text", "UTF-8"))
    )
    return _file_rows(read_table(spark, sf_dir, "documents"), "d", doc, extension, content)


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return _file_rows(pages, "p", F.col("page_id"), F.lit(".html"), F.encode("html", "UTF-8"))


def event_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events")
    return _file_rows(events, "e", F.col("event_id"), F.lit(".json"), F.encode("props", "UTF-8"))


def _file_rows(df: DataFrame, prefix: str, number: Column, extension: Column, content: Column):
    return df.select(
        F.concat(
            F.lit(f"file:/in/{prefix}"), number.cast("string"), extension
        ).alias("path"),
        F.to_timestamp(F.lit("2024-01-01 00:00:00")).alias("modificationTime"),
        F.octet_length(content).cast("bigint").alias("length"),
        content.alias("content"),
    )


def document_snapshot(spark: SparkSession, sf_dir: str, version: int) -> DataFrame:
    """Parsed-document rows of two deliveries of the whole document table.

    The first lacks the Spanish documents and the second the German ones; the second has revised
    French texts and a later delivery time for English documents with a quality label.
    """
    docs = spread(read_table(spark, sf_dir, "documents"))
    first, second = F.lit("2024-01-01 00:00:00"), F.lit("2024-02-01 00:00:00")
    if version == 1:
        kept = docs.filter(F.col("lang") != "es").withColumn("delivered", first)
    else:
        labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
        kept = (
            docs.filter(F.col("lang") != "de")
            .join(labels, "doc_id", "left")
            .withColumn(
                "text",
                F.when(F.col("lang") == "fr", F.concat(F.lit("revised "), F.col("text")))
                .otherwise(F.col("text")),
            )
            .withColumn(
                "delivered",
                F.when((F.col("lang") == "en") & F.col("quality").isNotNull(), second)
                .otherwise(first),
            )
        )
    return kept.select(
        F.col("text").alias("content"),
        F.lit("SUCCESS").alias("parser_status"),
        F.concat(F.lit("/docs/"), F.col("doc_id").cast("string")).alias("doc_uri"),
        F.to_timestamp("delivered").alias("last_modified"),
    )
