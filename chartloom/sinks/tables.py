"""Table sinks: overwrite with reread, append-only streams, change log of a keyed table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

#: Of stored texts, which it makes smaller than the default does.
COMPRESSION = "zstd"


def overwrite_table(df: DataFrame, name: str) -> DataFrame:
    """Replace a catalog table, schema included, and read it back as the next stage's input."""
    df.write.mode("overwrite").saveAsTable(name)
    return df.sparkSession.table(name)


def overwrite_folder(df: DataFrame, path: str, partition_by: str | None = None) -> DataFrame:
    """Replace a parquet folder and read it back; later steps start from the stored rows.

    With ``partition_by`` the rows are gathered by its values first, so that not every task writes
    a small file for each. The rebalance splits values that hold much of the table.
    """
    if partition_by:
        gathered = df.hint("rebalance", F.col(partition_by))
        gathered.write.mode("overwrite").partitionBy(partition_by).parquet(path, compression=COMPRESSION)
    else:
        df.write.mode("overwrite").parquet(path, compression=COMPRESSION)
    return df.sparkSession.read.parquet(path)


def overwrite_parts(df: DataFrame, path: str, partition_by: str, most_parts: int, row_group_bytes: int = 16 << 20) -> DataFrame:
    """The same for a column of at most ``most_parts`` values: a task keeps a file open for each of them, so rows are
    neither shuffled nor sorted. With more values the rest of a task's rows is sorted, as Spark does."""
    conf = df.sparkSession.conf
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(name)
    conf.set(name, str(most_parts))
    try:
        writer = df.write.mode("overwrite").partitionBy(partition_by).option("parquet.block.size", row_group_bytes)
        writer.parquet(path, compression=COMPRESSION)
    finally:
        conf.set(name, before)
    return df.sparkSession.read.parquet(path)


def lookup_folder(df: DataFrame, path: str, key: str, row_group_bytes: int = 16 << 20) -> DataFrame:
    """Replace a parquet folder laid out for lookups by ``key`` and read it back.

    Files hold ranges of the key and are sorted by it, so the statistics of files and row groups leave one or
    two of them for a value; bloom filters leave none for values that are missing. A hash of the other
    columns is part of the range, so a value that holds much of the table is spread over several files.
    """
    others = [F.col(c) for c in df.columns if c != key and df.schema[c].dataType.typeName() != "map"]
    (
        df.repartitionByRange(F.col(key), F.xxhash64(*others))
        .sortWithinPartitions(key)
        .write.mode("overwrite")
        .option(f"parquet.bloom.filter.enabled#{key}", "true")
        .option("parquet.block.size", row_group_bytes)
        .parquet(path)
    )
    return df.sparkSession.read.schema(df.schema).parquet(path)


def start_append(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to a parquet folder: what is there now, then stop."""
    return (
        df.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def start_append_table(df: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    return (
        df.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .toTable(name)
    )


def preview(df: DataFrame, rows: int = 20) -> DataFrame:
    return df.limit(rows)


def write_batch_folder(df: DataFrame, path: str, batch_id: int) -> None:
    """Write one micro-batch to its own folder. A retried batch replaces its folder, so every
    batch counts once."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_batch_folders(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
