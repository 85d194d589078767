"""Streams give what the batch gives, and a second run takes only what is new."""

import os

import pytest
from pyspark.sql import functions as F

from chartloom.catalog import queries
from chartloom.functions.embedding import with_embedding
from chartloom.operators import messages as msg
from chartloom.plans.documents import build_document_tables, build_index
from chartloom.plans.messages import build_segment_tables
from chartloom.sinks import tables as sinks
from chartloom.sources import tables as sources
from chartloom.sources.files import LINE_ORDER, line_files, message_files, number_lines
from chartloom.operators.grouping import assemble_messages
from chartloom.streaming import hops

HEAD = "MSH|^~\\&|A|B|C|D|2024||ADT^A01|7|P|2.5"


def land(folder, name, patient, ends="\n"):
    folder.mkdir(exist_ok=True)
    lines = [HEAD, f"PID|1||{patient}||N", f"AL1|1|DA|nuts {patient}", f"AL1|2|DA|milk {patient}"]
    (folder / name).write_bytes(ends.join(lines).encode())


def rows(df):
    return sorted(map(str, df.collect()))


def test_hops_equal_batch_and_take_new_files_only(spark, tmp_path):
    landing = tmp_path / "landing"
    land(landing, "part-001", "p1")
    land(landing, "part-002", "p2", "\r\n")
    land(landing, "other-003", "p3")
    (landing / "part-004").write_text("no header here")
    streams = hops.MessageStreams(spark, str(tmp_path / "out"), per_trigger=1)
    streams.ingest(str(landing), name_glob="part-00*")
    streams.run_all(["AL1", "PID"])
    files = message_files(spark, str(landing), name_glob="part-00*")
    flat = msg.flatten_messages(msg.parse_messages(files))
    assert rows(streams.read("gold_all")) == rows(msg.explode_segments(flat))
    assert rows(streams.read("gold_al1")) == rows(msg.segment_table(flat, "AL1"))
    assert streams.read("gold_all").filter("segment_id = 'ERROR'").count() == 1

    land(landing, "part-005", "p5")
    streams.ingest(str(landing), name_glob="part-00*")
    streams.run_all(["AL1", "PID"])
    patients = [r["patient_id"] for r in streams.read("gold_pid").orderBy("patient_id").collect()]
    assert patients == ["p1", "p2", "p5"]

    streams.fan_out()
    assert rows(streams.fanned("AL1")) == rows(streams.read("gold_al1"))
    plan = streams.fanned("AL1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(segment_kind" in plan


def test_lines_are_put_together_in_order(spark, tmp_path):
    landing = tmp_path / "landing"
    for n in range(3):
        land(landing, f"part-00{n}", f"p{n}")
    lines = line_files(spark, str(landing))
    whole = assemble_messages(number_lines(lines), LINE_ORDER)
    expected = {
        r["file_path"]: r["value"].replace("\n", "\r")
        for r in message_files(spark, str(landing)).collect()
    }
    assert {r["file_path"]: r["value"] for r in whole.collect()} == expected
    out, checkpoint = str(tmp_path / "texts"), str(tmp_path / "checkpoint")
    stream = line_files(spark, str(landing), streaming=True, per_trigger=2)
    hops.assemble_whole_files(stream, out, checkpoint)
    got = {r["file_path"]: r["value"] for r in hops.assembled(spark, out).collect()}
    assert got == expected


def test_stateful_assembly_grows_texts(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("lines", "texts", "checkpoint"))
    schema = "file_path string, line_no long, value string"
    for batch in ([("f", 1, "b"), ("f", 0, "a")], [("f", 2, "c"), ("g", 0, "x")]):
        spark.createDataFrame(batch, schema).write.mode("append").parquet(folder)
        stored = spark.read.parquet(folder).schema
        stream = sources.stream_folder(spark, folder, stored)
        hops.assemble_stream(stream, out, checkpoint)
    got = {r["file_path"]: r["value"] for r in hops.assembled(spark, out).collect()}
    assert got == {"f": "a\rb\rc", "g": "x"}


def test_assembly_state_lies_on_disk(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("lines", "texts", "checkpoint"))
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.createDataFrame([("f", 0, "a")], "file_path string, line_no long, value string").write.parquet(folder)
    hops.assemble_stream(sources.stream_folder(spark, folder, spark.read.parquet(folder).schema), out, checkpoint)
    kinds = {path.suffix for path in (tmp_path / "checkpoint" / "state").rglob("*") if not path.name.startswith(".")}
    assert ".delta" not in kinds and kinds & {".changelog", ".zip"}
    assert spark.conf.get(name) == before


def test_index_stream_embeds_each_key_once(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("chunks", "index", "checkpoint"))
    seen = []

    def embed(df):
        seen.append(sorted(r["chunk_id"] for r in df.collect()))
        return with_embedding(df)

    schema = "chunk_id string, content_chunked string, doc_uri string"
    for batch in ([("a", "A", "u"), ("a", "A", "v"), ("b", "B", "u")], [("b", "B", "w"), ("c", "C", "w")]):
        spark.createDataFrame(batch, schema).write.mode("append").parquet(folder)
        stored = spark.read.parquet(folder).schema
        hops.sync_index_stream(sources.stream_folder(spark, folder, stored), out, checkpoint, embed)
    assert seen == [["a", "b"], ["c"]]
    assert sorted(r["chunk_id"] for r in hops.read_index(spark, out).collect()) == ["a", "b", "c"]


def test_batch_plan_of_segment_tables(spark, tmp_path):
    landing = tmp_path / "landing"
    land(landing, "part-001", "p1")
    files = message_files(spark, str(landing))
    built = build_segment_tables(files, str(tmp_path / "out"), ["AL1"])
    flat = msg.flatten_messages(msg.parse_messages(files))
    assert rows(built["gold_al1"]) == rows(msg.segment_table(flat, "AL1"))
    assert built["gold_all"].count() == 4


def test_batch_plan_of_documents(spark, tmp_path):
    source = tmp_path / "docs"
    source.mkdir()
    (source / "a.txt").write_text("one two three four")
    (source / "b.html").write_text("<p>five six</p>")
    docs, chunks = build_document_tables(spark, str(source), str(tmp_path / "out"), size=2, overlap=0)
    assert docs.count() == 2
    index = build_index(chunks, str(tmp_path / "out"), 1)
    assert index.count() == 3
    (source / "c.md").write_text("seven")
    _, chunks = build_document_tables(spark, str(source), str(tmp_path / "out2"), size=2, overlap=0)
    assert build_index(chunks, str(tmp_path / "out"), 2, previous=index).count() == 4
    (source / "d.bin").write_text("x")
    with pytest.raises(RuntimeError, match="1 of 4 documents failed"):
        build_document_tables(spark, str(source), str(tmp_path / "out3"))


def test_catalog_tables(spark, tmp_path):
    spark.sql("DROP TABLE IF EXISTS chartloom_first")
    spark.sql("DROP TABLE IF EXISTS chartloom_second")
    location = str(tmp_path / "t")
    first = spark.range(3).write.option("path", location).mode("overwrite")
    first.saveAsTable("chartloom_first")
    assert sources.table(spark, "chartloom_first").count() == 3
    stream = sources.stream_table(spark, "chartloom_first").withColumn("twice", F.col("id") * 2)
    spark.sql(f"CREATE TABLE chartloom_second (id LONG, twice LONG) USING parquet LOCATION '{tmp_path}/s'")
    sinks.start_append_table(stream, "chartloom_second", str(tmp_path / "c")).awaitTermination()
    assert sorted(r["twice"] for r in sinks.preview(spark.table("chartloom_second"), 5).collect()) == [0, 2, 4]
    spark.sql("DROP TABLE chartloom_first")
    spark.sql("DROP TABLE chartloom_second")


def test_hops_start_before_there_are_files(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    streams = hops.MessageStreams(spark, str(tmp_path / "tables"))
    streams.ingest(str(landing))
    streams.bronze()
    streams.silver()
    streams.gold_all()
    land(landing, "part-001", "p1")
    streams.ingest(str(landing))
    streams.bronze()
    streams.silver()
    streams.gold_all()
    flat = msg.flatten_messages(msg.parse_messages(message_files(spark, str(landing))))
    assert rows(streams.read("gold_all")) == rows(msg.explode_segments(flat))


def test_segment_tables_survive_any_line(spark, tmp_path):
    header = "MSH|^~\\&|S|F|D|DF|20240101||ADT^A01|1|P|2.5"
    junk = [f"J{i:03d}|x" for i in range(60)]
    text = "\r".join([header, "|starts empty", "x" * 400, *junk, "AL1|1|DA|nuts"])
    frame = spark.createDataFrame([("f", text)], "file_path string, value string")
    exploded = msg.explode_segments(msg.flatten_messages(msg.parse_messages(frame)))
    built = build_segment_tables(frame, str(tmp_path / "batch"))
    assert rows(built["gold_all"].select(exploded.columns)) == rows(exploded)
    assert "" in {r["segment_id"] for r in built["gold_all"].collect()}
    frame.write.parquet(str(tmp_path / "in"))
    streams = hops.MessageStreams(spark, str(tmp_path / "stream"))
    streams.bronze(sources.stream_folder(spark, str(tmp_path / "in"), frame.schema))
    streams.silver()
    streams.fan_out()
    assert rows(streams.fanned_segments().select(exploded.columns)) == rows(exploded)
    assert [r["AL1_3"] for r in streams.fanned("AL1").collect()] == ["nuts"]


def test_index_follows_deletes_and_updates(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / x) for x in "fox")
    schema = "change_type string, chunk_id string, content_chunked string"
    seen = []

    def embed(df):
        seen.append(sorted(r["chunk_id"] for r in df.collect()))
        return df.withColumn("embedding", F.array(F.lit(1.0).cast("float")))

    deliveries = (
        [("insert", "a", "A"), ("insert", "b", "B")],
        [("delete", "a", None), ("update", "b", "B"), ("insert", "c", "C")],
        [("insert", "a", "A"), ("delete", "c", None)],
    )
    for batch in deliveries:
        spark.createDataFrame(batch, schema).write.mode("append").parquet(folder)
        stored = spark.read.parquet(folder).schema
        hops.sync_index_stream(sources.stream_folder(spark, folder, stored), out, checkpoint, embed)
    assert seen == [["a", "b"], ["c"], ["a"]]
    assert sorted(r["chunk_id"] for r in hops.read_index(spark, out).collect()) == ["a", "b"]


def test_overwritten_table_takes_a_new_schema(spark, tmp_path):
    spark.sql("DROP TABLE IF EXISTS chartloom_changing")
    sinks.overwrite_table(spark.range(2), "chartloom_changing")
    again = sinks.overwrite_table(spark.range(3).selectExpr("id AS other", "'x' AS text"), "chartloom_changing")
    assert again.columns == ["other", "text"] and again.count() == 3
    spark.sql("DROP TABLE chartloom_changing")


def test_landed_files_lie_in_one_folder_and_are_written_by_several_tasks(spark, sf_dir, tmp_path):
    landing = queries._supplier_landing(spark, sf_dir, str(tmp_path))
    names = [n for n in os.listdir(landing) if n.startswith("part-")]
    assert all(os.path.isfile(f"{landing}/{n}") for n in names)
    assert len(names) == spark.read.parquet(f"{sf_dir}/supplier.parquet").count()
    assert len({n[:10] for n in names}) > 1


def test_rows_of_one_name_share_a_file(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x\ny"), ("b", "z"), ("a", "w"), (None, "n"), (None, None)], "name string, value string").coalesce(1)
    queries._land(spark, rows, str(tmp_path / "landing"))
    found = [r.value for r in spark.read.text(str(tmp_path / "landing"), wholetext=True).collect()]
    assert sorted(found) == ["n\n\n", "x\ny\nw\n", "z\n"]
