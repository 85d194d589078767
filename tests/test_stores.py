"""Index store, change feed, lookup tables and stateful assembly."""

import re

import pytest
from pyspark.sql import functions as F

from chartloom.operators import changes, documents, quality
from chartloom.plans.documents import store_document_tables
from chartloom.sinks.change_feed import ChangeFeed, replayed
from chartloom.sinks.index_store import IndexStore
from chartloom.sinks.tables import lookup_folder, overwrite_parts
from chartloom.sources.tables import stream_folder
from chartloom.streaming import hops

LOG = "change_type string, chunk_id string, v int"


def keys(df):
    return sorted(tuple(r) for r in df.select("chunk_id", "v").collect())


def test_store_folds_batches_and_reads_their_buckets_only(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"), LOG, "chunk_id", buckets=4)
    assert store.current(0).count() == 0 and store.batches() == 0
    deliveries = [
        [("insert", c, 0) for c in "abcdefgh"], [("delete", "a", None), ("insert", "b", 1)], [], [("insert", "a", 3)],
    ]
    for number, rows in enumerate(deliveries):
        store.write_batch(spark.createDataFrame(rows, LOG), number)
    expected = sorted([("a", 3), ("b", 1), *((c, 0) for c in "cdefgh")])
    assert keys(store.current(store.batches())) == expected
    assert ("a", 0) not in keys(store.current(2)) and ("b", 1) in keys(store.current(2))
    store.compact(3)
    store.compact(3)
    assert [tuple(r) for r in store.versions().orderBy("version").collect()] == [(0, -1), (1, 2)]
    again = IndexStore(spark, str(tmp_path / "index"), LOG, "chunk_id")
    assert again.buckets == 4 and keys(again.current(again.batches())) == expected
    with pytest.raises(ValueError):
        again.current(1)
    # A batch of one key reads the folder of its bucket in base and log, and neither older folders.
    one = spark.createDataFrame([("a",)], "chunk_id string")
    part = again.current(4, again.buckets_of(one))
    files = part.inputFiles()
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert ("a", 3) in keys(part) and len(keys(part)) < 8
    assert not any("batch_id=0" in f or "batch_id=1" in f or "version=0" in f for f in files)
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)


def test_retried_batch_counts_once(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"), LOG, "chunk_id", buckets=2)
    for rows in ([("insert", "a", 1), ("insert", "b", 1)], [("insert", "a", 2)]):
        store.write_batch(spark.createDataFrame(rows, LOG), 0)
    assert keys(store.current(1)) == [("a", 2)]


def test_change_feed_in_batch_and_stream(spark, tmp_path):
    feed = ChangeFeed(spark, str(tmp_path / "feed"), "chunk_id")
    schema = "chunk_id string, v int, note string"
    versions = [
        [("a", 1, None), ("b", 1, "x"), ("c", 1, None)], [("a", 1, None), ("b", 2, "x"), ("d", 1, None)],
        [("a", 1, "now"), ("b", 2, "x"), ("d", 1, None)],
    ]
    assert feed.version() == 0
    assert [feed.commit(spark.createDataFrame(rows, schema)) for rows in versions] == [1, 2, 3]
    second = sorted((r.change_type, r.chunk_id, r.v) for r in feed.changes(2, 2).collect())
    assert second == [("delete", "c", 1), ("insert", "d", 1), ("update_postimage", "b", 2), ("update_preimage", "b", 1)]
    assert {(r.change_type, r.note) for r in feed.changes(3, 9).collect()} == {("update_preimage", None), ("update_postimage", "now")}
    for last in (1, 2, 3):
        built = replayed(feed.changes(1, last), "chunk_id").select("chunk_id", "v", "note")
        assert sorted(map(str, built.collect())) == sorted(map(str, feed.snapshot(last).collect()))
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    feed.stream(2).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
    feed.commit(spark.createDataFrame(versions[0], schema))
    feed.stream(2).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
    streamed = spark.read.schema(feed.changes(1, 4).schema).parquet(out)
    assert sorted(map(str, streamed.collect())) == sorted(map(str, feed.changes(2, 4).collect()))


def test_store_carries_only_the_columns_asked_for(spark, tmp_path):
    schema = "change_type string, chunk_id string, v int, note string"
    store = IndexStore(spark, str(tmp_path / "index"), schema, "chunk_id", buckets=2)
    store.write_batch(spark.createDataFrame([("insert", "a", 1, "x"), ("insert", "b", 1, "y"), ("insert", "c", 1, "z")], schema), 0)
    store.compact(1)
    store.write_batch(spark.createDataFrame([("delete", "a", None, None), ("insert", "b", 2, "w")], schema), 1)
    known, values = store.current(2, columns=["chunk_id"]), store.current(2, columns=["v"])
    assert known.columns == ["chunk_id"] and sorted(r[0] for r in known.collect()) == ["b", "c"]
    assert keys(values) == [("b", 2), ("c", 1)]
    assert "note" not in values._jdf.queryExecution().executedPlan().toString()


def test_batch_compares_keys_without_texts_and_vectors(spark, tmp_path, monkeypatch):
    """What an index batch asks of the index is its keys."""
    asked = []
    current = IndexStore.current
    monkeypatch.setattr(
        IndexStore, "current", lambda self, *at, **options: asked.append(current(self, *at, **options)) or asked[-1]
    )
    root = str(tmp_path)
    for number, chunk in enumerate(["a", "b"]):
        spark.createDataFrame([(chunk, f"text {chunk}")], "chunk_id string, content_chunked string").write.mode("append").parquet(f"{root}/chunks")
        rows = stream_folder(spark, f"{root}/chunks", spark.read.parquet(f"{root}/chunks").schema)
        embed = lambda df: df.withColumn("embedding", F.array(F.lit(1.0)))
        hops.sync_index_stream(rows, f"{root}/index", f"{root}/checkpoint", embed, buckets=2)
    assert len(asked) == 2
    assert "embedding" not in asked[1]._jdf.queryExecution().executedPlan().toString()
    found = hops.read_index(spark, f"{root}/index", ["content_chunked"])
    assert sorted(tuple(r) for r in found.collect()) == [("a", "text a"), ("b", "text b")]


def test_replay_leaves_the_rows_of_deletions_behind(spark):
    changes = spark.createDataFrame(
        [("insert", "a", "x", 1), ("insert", "b", "y", 1), ("delete", "a", "x", 2), ("insert", "a", "z", 3), ("delete", "b", "y", 3)],
        "change_type string, chunk_id string, note string, version int",
    )
    rows = replayed(changes, "chunk_id")
    assert [tuple(r) for r in rows.collect()] == [("a", "z")]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"CASE WHEN NOT \(change_type#\d+ = delete\) THEN note", plan)


def test_upsert_takes_each_change_once(spark):
    table = spark.createDataFrame([("a", 1, None), ("b", 1, "x"), ("c", 1, "y")], "chunk_id string, v int, note string")
    diff = spark.createDataFrame(
        [("update", "a", None, None), ("delete", "b", None, None), ("insert", "d", 4, "z")], "change_type string, chunk_id string, v int, note string"
    )
    after = changes.apply_changes(table, diff)
    assert after.columns == table.columns
    assert sorted(map(tuple, after.collect())) == [("a", None, None), ("c", 1, "y"), ("d", 4, "z")]


def test_lookup_reads_few_files_and_rows(spark, tmp_path):
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), F.col("id").cast("string"))).alias("patient_id"), "id"
    )
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        table = lookup_folder(rows, str(tmp_path / "lookup"), "patient_id")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    by_file = table.groupBy(F.col("_metadata.file_name").alias("file")).agg(
        F.min("patient_id").alias("low"), F.max("patient_id").alias("high"), F.count("*").alias("n")
    ).collect()
    assert len(by_file) == 16 and max(r.n for r in by_file) < 2_500  # the hot value is in several files
    found = table.where("patient_id = 'p101'")
    assert [r.id for r in found.collect()] == [101]
    assert sum(r.low <= "p101" <= r.high for r in by_file) == 1
    scans = found._jdf.queryExecution().executedPlan().collectLeaves()
    assert scans.apply(0).metrics().get("numOutputRows").get().value() < 2_500  # one row group


def test_gate_counts_come_from_the_write(spark, tmp_path):
    files = spark.createDataFrame(
        [("file:/a.txt", b"one two"), ("file:/b.txt", b""), ("file:/c.bin", b"x")], "path string, content binary"
    ).withColumn("modificationTime", F.to_timestamp(F.lit("2024-01-01 00:00:00"))).withColumn("length", F.lit(1))
    cut = lambda docs: docs.select("doc_uri")
    with pytest.raises(quality.QualityError, match="1 of 3 documents failed"):
        store_document_tables(files, str(tmp_path / "a"), cut)
    with pytest.raises(quality.QualityError, match="1 of 3 documents empty"):
        store_document_tables(files, str(tmp_path / "b"), cut, max_failed_percent=50)
    docs, _ = store_document_tables(files, str(tmp_path / "c"), cut, max_failed_percent=50, max_empty_percent=50)
    parsed, counts = quality.observe_quality(documents.parse_files(files))
    parsed.write.format("noop").mode("overwrite").save()
    assert counts.get == {k: v for k, v in quality.quality_summary(docs).first().asDict().items() if k in counts.get}


def lines_of(spark, *batches):
    return [spark.createDataFrame(rows, "file_path string, line_no long, n_lines long, value string") for rows in batches]


def test_assembly_frees_the_state_of_written_files(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("lines", "texts", "checkpoint"))
    batches = lines_of(
        spark, [("f", 1, 3, "b"), ("g", 0, 1, "x"), ("h", 1, 2, "late")], [("f", 1, 3, "b"), ("f", 0, 3, None)],
        [("f", 2, 3, "c"), ("h", 0, 2, "early")],
    )
    sizes = []
    for rows in batches:
        rows.coalesce(1).write.mode("append").parquet(folder)
        texts = hops.assemble_complete_stream(stream_folder(spark, folder, rows.schema), out, checkpoint)
        state = spark.read.format("statestore").load(checkpoint, stateVarName="lines")
        sizes.append(state.count())
    assert sorted(map(tuple, texts.collect())) == [("f", "\rb\rc", True), ("g", "x", True), ("h", "early\rlate", True)]
    assert sizes[-1] == 0 and max(sizes) > 0


def test_stored_tables_are_compressed_with_zstd(spark, tmp_path):
    feed = ChangeFeed(spark, str(tmp_path / "feed"), "chunk_id")
    feed.commit(spark.createDataFrame([("a", 1)], "chunk_id string, v int"))
    store = IndexStore(spark, str(tmp_path / "index"), LOG, "chunk_id", buckets=2)
    store.write_batch(spark.createDataFrame([("insert", "a", 1)], LOG), 0)
    for table in (feed.snapshot(), feed.changes(1, 1), store.current(1)):
        assert all(f.endswith(".zstd.parquet") for f in table.inputFiles() if "version=0" not in f)


def test_parts_of_few_values_are_written_by_each_task(spark, tmp_path):
    rows = spark.range(60, numPartitions=3).select("id", F.when(F.col("id") % 2 == 0, "a").when(F.col("id") % 3 == 0, "b").alias("kind"))
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    for most in (3, 1):
        back = overwrite_parts(rows, str(tmp_path / str(most)), "kind", most)
        assert sorted(map(str, back.select("id", "kind").collect())) == sorted(map(str, rows.collect()))
        assert len(list((tmp_path / str(most)).rglob("*.parquet"))) == 9
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
