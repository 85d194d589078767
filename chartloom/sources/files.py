"""File sources: message files, line files, whole binary files; batch and streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


LINE_ORDER = ("block_start", "line_id")


def _text_reader(spark: SparkSession, streaming: bool, name_glob: str | None, per_trigger: int | None):
    reader = spark.readStream if streaming else spark.read
    reader = reader.option("recursiveFileLookup", "true")
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    if streaming and per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader


def message_files(
    spark: SparkSession, path: str, streaming: bool = False,
    name_glob: str | None = None, per_trigger: int | None = None,
) -> DataFrame:
    """``(file_path, value)``, one row per file, its lines in order. Needs no shuffle and no state."""
    reader = _text_reader(spark, streaming, name_glob, per_trigger)
    return reader.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file_path"), "value"
    )


def line_files(
    spark: SparkSession, path: str, streaming: bool = False,
    name_glob: str | None = None, per_trigger: int | None = None,
) -> DataFrame:
    """``(file_path, block_start, value)``, one row per line; ``block_start`` is the start of the
    split that the line was read in."""
    reader = _text_reader(spark, streaming, name_glob, per_trigger)
    return reader.text(path).select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        "value",
    )


def number_lines(lines: DataFrame) -> DataFrame:
    """Add ``line_id``, which grows along each split, so that ``LINE_ORDER`` is the order of a
    file's lines. Apply it to lines as they were read, or to a micro-batch of them."""
    return lines.withColumn("line_id", F.monotonically_increasing_id())


def without_names(df: DataFrame, part: str, path: str = "file_path") -> DataFrame:
    """Leave out the files whose name holds ``part``."""
    return df.filter(~file_name(F.col(path)).contains(part))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def binary_files(
    spark: SparkSession, path: str, name_glob: str | None = None, require_any: bool = False
) -> DataFrame:
    """``(path, modificationTime, length, content)``; content is read only when it is selected."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    files = reader.load(path)
    if require_any and files.select("path").isEmpty():
        raise FileNotFoundError(f"{path} holds no files")
    return files


def file_listing(
    spark: SparkSession, path: str, name_glob: str | None = None, leave_out: str | None = None
) -> DataFrame:
    """Name, size and time of the files, without reading them."""
    files = binary_files(spark, path, name_glob)
    if leave_out:
        files = without_names(files, leave_out, "path")
    return files.select(
        file_name(F.col("path")).alias("file_name"), "path", "length", "modificationTime"
    )
