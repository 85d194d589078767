"""Document operators: file rows to text by file type, with faults as rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, functions as F, types as T

from chartloom.functions.html import html_to_markdown
from chartloom.functions.json_tags import json_to_tags
from chartloom.functions.text import file_extension, strip, uri_path, utf8_text
from chartloom.schemas import PARSED_DOCUMENT_SCHEMA

SUCCESS = "SUCCESS"
FAULT_PREFIX = "An error occurred: "

TEXT_EXTENSIONS = [".txt", ".md"]
HTML_EXTENSIONS = [".html"]
JSON_EXTENSIONS = [".json", ".jsonl"]

Parser = Callable[..., Mapping]


def spread(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """Spread the rows of a scan before costly work on each of them.

    A scan of fewer files than the cluster has cores is repartitioned. A larger one stays as the reader
    cut it, since spreading it would only shuffle its bytes. A count given is used as it is. Only the
    list of files is looked at; no plan is run. The rows are the same either way.
    """
    if partitions:
        return rows.repartition(partitions)
    if rows.isStreaming:
        return rows
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if len(rows.inputFiles()) < cores else rows


def parse_files(files: DataFrame, hooks: Mapping[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """``content, parser_status, doc_uri, last_modified`` for file rows.

    Text, markdown, HTML and JSON files are handled here; ``hooks`` maps further extensions, such as
    ``.pdf``, to a function from bytes to text. A file that fails keeps its row: empty content, the
    reason as status, the raw path and no time.
    """
    hooks = dict(hooks or {})
    typed = files.withColumn("__ext", file_extension(F.col("path")))
    ext = F.col("__ext")
    # Only JSON rows go through the Python worker; a stream keeps one branch.
    if not files.isStreaming:
        is_json = F.coalesce(ext.isin(JSON_EXTENSIONS), F.lit(False))
        return _parsed_rows(typed.filter(~is_json), hooks, False).unionByName(_parsed_rows(typed.filter(is_json), {}, True))
    return _parsed_rows(typed, hooks, True)


def _parsed_rows(typed: DataFrame, hooks: Mapping[str, Callable[[bytes], str]], with_json: bool) -> DataFrame:
    """The rows of ``parse_files`` with their ``__ext``."""
    ext = F.col("__ext")
    decoded_types = TEXT_EXTENSIONS + HTML_EXTENSIONS + JSON_EXTENSIONS
    staged = typed.withColumn(
        "__text", F.when(ext.isin(decoded_types), utf8_text(F.col("content")))
    )
    text = F.col("__text")
    tags = json_to_tags(F.when(ext.isin(JSON_EXTENSIONS), text)) if with_json else F.lit(None).cast("string")
    staged = staged.withColumn("__tags", tags)
    parsed = (
        F.when(ext.isin(TEXT_EXTENSIONS), strip(text))
        .when(ext.isin(HTML_EXTENSIONS), html_to_markdown(text))
        .when(ext.isin(JSON_EXTENSIONS), F.col("__tags"))
    )
    fault = F.when(
        ~ext.isin(decoded_types + list(hooks)),
        F.concat(F.lit("no parser for "), F.col("path")),
    ).when(F.col("content").isNull(), "the file has no content")
    fault = fault.when(
        ext.isin(decoded_types) & text.isNull(), "the bytes are not UTF-8 text"
    ).when(ext.isin(JSON_EXTENSIONS) & F.col("__tags").isNull(), "the text is not one JSON value")
    for number, (extension, hook) in enumerate(hooks.items()):
        name = f"__hook{number}"
        staged = staged.withColumn(
            name, _guarded_hook(hook)(F.when(ext == extension, F.col("content")))
        )
        parsed = parsed.when(ext == extension, strip(F.col(name)["text"]))
        fault = fault.when((ext == extension) & F.col(name)["fault"].isNotNull(), F.col(name)["fault"])

    outcome = staged.select(
        "path", "modificationTime", fault.alias("__fault"), parsed.alias("__parsed")
    )
    failed = F.col("__fault").isNotNull()
    return outcome.select(
        F.when(failed, "").otherwise(F.col("__parsed")).alias("content"),
        F.when(failed, F.concat(F.lit(FAULT_PREFIX), F.col("__fault")))
        .otherwise(SUCCESS).alias("parser_status"),
        F.when(failed, F.col("path")).otherwise(uri_path(F.col("path"))).alias("doc_uri"),
        F.when(~failed, F.col("modificationTime")).alias("last_modified"),
    )


def _guarded_hook(hook: Callable[[bytes], str]):
    def run(content):
        if content is None:
            return None
        try:
            return {"text": hook(bytes(content))}
        except Exception as error:
            return {"fault": f"{type(error).__name__}: {error}"}

    return F.udf(run, "struct<text: string, fault: string>", useArrow=True)


def apply_parser(
    files: DataFrame, parser: Parser, schema: T.StructType = PARSED_DOCUMENT_SCHEMA
) -> DataFrame:
    """Run a user parser on every file row and show its fields as columns.

    The parser gets the row as one mapping with ``path, modificationTime, length, content`` and returns
    the fields of a parsed document; a row whose status isn't SUCCESS, or for which the parser raises,
    becomes a fault row with the raw path.
    """
    outcome = T.StructType([T.StructField("parsed", schema), T.StructField("fault", T.StringType())])

    def run(row):
        try:
            fields = dict(parser(row))
        except Exception as error:
            return None, f"{type(error).__name__}: {error}"
        return fields, None

    called = F.udf(run, outcome, useArrow=True)
    tried = files.select("path", called(F.struct("path", "modificationTime", "length", "content")).alias("outcome"))
    found, status = F.col("outcome.parsed"), F.col("outcome.parsed.parser_status")
    fault = F.coalesce("outcome.fault", F.when(F.coalesce(status, F.lit("")) != SUCCESS, F.coalesce(status, F.lit("no status"))))
    stated = {
        "content": F.lit(""), "doc_uri": F.col("path"), "parser_status": F.concat(F.lit(FAULT_PREFIX), fault),
    }
    faulty = fault.isNotNull()
    return tried.select(
        *[
            F.when(faulty, stated.get(f.name, F.lit(None).cast(f.dataType))).otherwise(found[f.name]).alias(f.name)
            for f in schema.fields
        ]
    )


def struct_columns(df: DataFrame, name: str, schema: T.StructType) -> DataFrame:
    return df.select(*[F.col(name)[field].alias(field) for field in schema.fieldNames()])


def parsed_ok(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("parser_status") == SUCCESS)


def parse_failures(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("parser_status") != SUCCESS)


def empty_successes(docs: DataFrame) -> DataFrame:
    return parsed_ok(docs).filter(F.col("content") == "")
