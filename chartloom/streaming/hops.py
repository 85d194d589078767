"""Streaming message pipeline: raw, bronze, silver and segment tables as append-only hops.

Every hop is one stateless query with its own checkpoint. It processes what has arrived since its
last run and stops, so the same calls serve a schedule or a backfill.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from chartloom.operators.changes import DELETE, INSERT, collapse_keys, latest_by_key, rows_to_embed
from chartloom.operators.chunks import CHUNK_KEY, CHUNK_TEXT
from chartloom.operators.grouping import assemble_messages
from chartloom.operators.messages import (
    explode_segments, flatten_messages, of_kind, parse_messages, segment_table, typed_segments, with_kind,
)
from chartloom.schemas import SEGMENT_FIELD_NUMBERS
from chartloom.sinks.index_store import BUCKETS, IndexStore
from chartloom.sinks.tables import overwrite_parts, read_batch_folders, start_append, write_batch_folder
from chartloom.streaming.assembly import FileAssembler
from chartloom.sources.files import LINE_ORDER, message_files, number_lines
from chartloom.sources.tables import stream_folder


class MessageStreams:
    """The tables of the message pipeline under one folder."""

    def __init__(self, spark: SparkSession, root: str, per_trigger: int | None = None):
        self.spark, self.root, self.per_trigger = spark, root, per_trigger

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def run(self, name: str, stream: DataFrame) -> None:
        start_append(stream, self.path(name), self.path(f"_checkpoints/{name}")).awaitTermination()

    def stream(self, name: str) -> DataFrame:
        """A written table as a stream, with the declared schema of its hop, so that it can start before
        there are files. Other tables take theirs from the stored files."""
        schema = self.schemas().get(name) or self.read(name).schema
        return stream_folder(self.spark, self.path(name), schema, self.per_trigger)

    def schemas(self) -> dict:
        """Schemas of the hops, from the operators themselves; no file is read."""
        raw = self.spark.createDataFrame([], "file_path string, value string")
        bronze = parse_messages(raw)
        silver = flatten_messages(bronze)
        frames = {"raw_data": raw, "bronze": bronze, "silver": silver, "gold_all": explode_segments(silver)}
        return {name: frame.schema for name, frame in frames.items()}

    def read(self, name: str) -> DataFrame:
        """A written table; one that no file has reached yet is empty."""
        schema = self.schemas().get(name)
        return (self.spark.read.schema(schema) if schema else self.spark.read).parquet(self.path(name))

    def ingest(self, landing: str, name_glob: str | None = None) -> None:
        files = message_files(self.spark, landing, True, name_glob, self.per_trigger)
        self.run("raw_data", files)

    def bronze(self, raw: DataFrame | None = None) -> None:
        """Parse the raw table, or another stream of ``(file_path, value)``."""
        self.run("bronze", parse_messages(self.stream("raw_data") if raw is None else raw))

    def silver(self) -> None:
        self.run("silver", flatten_messages(self.stream("bronze")))

    def gold_all(self) -> None:
        self.run("gold_all", explode_segments(self.stream("silver")))

    def gold(self, segment: str) -> None:
        self.run(f"gold_{segment.lower()}", segment_table(self.stream("silver"), segment))

    def run_all(self, segments: Iterable[str] = tuple(SEGMENT_FIELD_NUMBERS)) -> None:
        self.bronze()
        self.silver()
        self.gold_all()
        for segment in segments:
            self.gold(segment)

    def fan_out(self) -> None:
        """All segment tables from one read of silver: segments laid out by kind, so that reading
        one typed table touches only its own folder."""

        def write(batch: DataFrame, batch_id: int) -> None:
            segments, folder = with_kind(explode_segments(batch)), f"{self.path('segments')}/batch_id={batch_id}"
            overwrite_parts(segments, folder, "segment_kind", len(SEGMENT_FIELD_NUMBERS) + 1)

        run_batches(self.stream("silver"), write, self.path("_checkpoints/segments"))

    def fanned_segments(self) -> DataFrame:
        return self.spark.read.parquet(self.path("segments"))

    def fanned(self, segment: str) -> DataFrame:
        return typed_segments(of_kind(self.fanned_segments(), segment), segment)


def run_batches(
    stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> None:
    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """State of the streams started inside lies in RocksDB, not in the executors' heap, and a batch adds its changes."""
    settings = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    }
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def assemble_stream(lines: DataFrame, path: str, checkpoint: str, separator: str = "\r") -> None:
    """Grow message texts from a stream of ``(file_path, line_no, value)`` lines.

    A file's lines may come in several batches, so the lines of all files stay in the state: use
    whole-file reading where it is possible. Every batch writes the texts it changed, and
    ``assembled`` reads the latest one of each file.
    """
    entries = F.collect_list(F.struct("line_no", "value")).alias("entries")
    grouped = lines.groupBy("file_path").agg(entries)
    text = F.array_join(F.transform(F.sort_array("entries"), lambda e: e["value"]), separator)

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch_folder(batch.select("file_path", text.alias("value")), path, batch_id)

    with rocksdb_state(lines.sparkSession):
        run_batches(grouped, write, checkpoint, "update")


def assemble_whole_files(lines: DataFrame, path: str, checkpoint: str) -> None:
    """The same without state, for sources that deliver all lines of a file in one batch, as file
    sources do."""

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch_folder(assemble_messages(number_lines(batch), LINE_ORDER), path, batch_id)

    run_batches(lines, write, checkpoint)


def assembled(spark: SparkSession, path: str) -> DataFrame:
    return latest_by_key(read_batch_folders(spark, path), "file_path")


INDEX_LOG_SCHEMA = "change_type string, chunk_id string, content_chunked string, embedding array<float>"


def index_store(spark: SparkSession, path: str, buckets: int = BUCKETS) -> IndexStore:
    return IndexStore(spark, path, INDEX_LOG_SCHEMA, CHUNK_KEY, buckets)


def sync_index_stream(
    chunks: DataFrame, path: str, checkpoint: str, embed: Callable[[DataFrame], DataFrame],
    buckets: int = BUCKETS, compact_every: int = 8,
) -> None:
    """Keep an index in step with a stream of chunks, or of change rows of a chunk table.

    A key is its content's hash, so only keys that the index lacks are embedded, and an update of other
    columns needs nothing; rows of type ``delete`` take their keys out. Within a batch a key that is
    still inserted or updated stays. A batch compares its keys with their buckets of the index only; a
    retried batch leaves its own changes out and replaces them. After ``compact_every`` batches the log
    is folded into a new base.
    """
    spark = chunks.sparkSession
    changing = "change_type" in chunks.columns
    store = index_store(spark, path, buckets)

    def write(batch: DataFrame, batch_id: int) -> None:
        if store.behind(batch_id) >= compact_every:
            store.compact(batch_id)
        delivered = batch.filter(F.col("change_type") != DELETE) if changing else batch
        source = collapse_keys(delivered.select(CHUNK_KEY, CHUNK_TEXT), CHUNK_KEY)
        known = store.current(batch_id, store.buckets_of(delivered), columns=[CHUNK_KEY])
        rows = embed(rows_to_embed(source, known)).select(
            F.lit(INSERT).alias("change_type"), CHUNK_KEY, CHUNK_TEXT, F.col("embedding").cast("array<float>").alias("embedding")
        )
        if changing:
            gone = batch.filter(F.col("change_type") == DELETE).select(CHUNK_KEY).distinct()
            gone = gone.join(source.select(CHUNK_KEY), CHUNK_KEY, "left_anti").select(
                F.lit(DELETE).alias("change_type"), CHUNK_KEY, F.lit(None).cast("string").alias(CHUNK_TEXT),
                F.lit(None).cast("array<float>").alias("embedding"),
            )
            rows = rows.unionByName(gone)
        store.write_batch(rows, batch_id)

    run_batches(chunks, write, checkpoint)


def read_index(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The rows after the last batch whose changes are there, or their key and some ``columns``."""
    store = index_store(spark, path)
    return store.current(store.batches(), columns=columns)


def assemble_complete_stream(
    lines: DataFrame, path: str, checkpoint: str, separator: str = "\r", quiet_ms: int | None = None
) -> DataFrame:
    """Message texts of files whose lines come in any order and in several batches, each written once.

    ``lines`` are ``(file_path, line_no, n_lines, value)``. A file's lines wait in a list state; when
    ``n_lines`` different ones are there, or, with ``quiet_ms``, when none came for so long, the text is
    written and the state is freed, so it holds open files only. A line that comes twice counts once; lines
    that come after their file was written begin it anew and are not written until they are complete. A file
    that went quiet has ``complete`` false. The state lies in RocksDB under the checkpoint.
    """
    spark = lines.sparkSession
    texts = (
        lines.select("file_path", "line_no", "n_lines", "value")
        .groupBy("file_path")
        .transformWithState(
            statefulProcessor=FileAssembler(separator, quiet_ms),
            outputStructType="file_path string, value string, complete boolean",
            outputMode="Append",
            timeMode="ProcessingTime" if quiet_ms else "None",
        )
    )
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        start_append(texts, path, checkpoint).awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.schema(texts.schema).parquet(path)
