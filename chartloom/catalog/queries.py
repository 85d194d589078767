"""Registered queries: every operator over whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chartloom import samples
from chartloom.functions.chunking import recursive_chunker
from chartloom.functions.embedding import DIMENSIONS, hashed_embedding, md5_number, with_embedding
from chartloom.functions.html import html_to_markdown
from chartloom.functions.json_tags import json_to_tags
from chartloom.functions.text import file_extension
from chartloom.operators import changes, chunks, coding, conversations, documents, grouping
from chartloom.operators import messages as msg
from chartloom.operators import quality, similarity
from chartloom.operators.vector_index import VectorIndex, build_index, compared_rows, open_index, topk_indexed, topk_pruned
from chartloom.plans.documents import build_index as plan_index, store_document_tables
from chartloom.schemas import MESSAGE_KEYS, SEGMENT_FIELD_NUMBERS
from chartloom.session import read_table, scratch_folder
from chartloom.sinks.change_feed import ChangeFeed, replayed
from chartloom.sinks.tables import COMPRESSION
from chartloom.sources.files import line_files
from chartloom.sources.tables import stream_folder
from chartloom.streaming import hops

Query = Callable[[SparkSession, str], DataFrame]

PATIENT = "17"
CHUNK_SIZE, CHUNK_OVERLAP = 64, 16
RECURSIVE_SIZE, RECURSIVE_OVERLAP = 128, 32
WINDOW = 60
NEIGHBORS = 5
CODES_PER_ALLERGY = 3

_REGISTRY: dict[str, Query] = {}


def _query(function: Query) -> Query:
    _REGISTRY[function.__name__] = function
    return function


def all_queries() -> dict[str, Query]:
    return dict(_REGISTRY)


_STORED: dict[tuple[str, str, str], str] = {}


def _stored(
    spark: SparkSession, sf_dir: str, name: str, build: Callable[[SparkSession, str], DataFrame]
) -> DataFrame:
    """A table made from the test tables, stored the first time a session asks for it.

    It stands for the landed input of the message queries, which a pipeline finds stored too.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        path = scratch_folder(spark, name)
        build(spark, sf_dir).write.parquet(path, compression=COMPRESSION)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One message text per order."""
    return documents.spread(_stored(spark, sf_dir, "raw_data", samples.message_texts))


def _raw_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _stored(spark, sf_dir, "raw_data", samples.message_texts)
    path = _STORED[(spark.sparkContext.applicationId, sf_dir, "raw_data")]
    return stream_folder(spark, path, stored.schema, per_trigger=1_000)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir, "raw_lines", samples.message_lines)


def store_message_input(spark: SparkSession, sf_dir: str) -> None:
    """Make and store the input of the message queries ahead of them."""
    _stored(spark, sf_dir, "raw_data", samples.message_texts)
    _lines(spark, sf_dir)


def _flat(spark: SparkSession, sf_dir: str, provenance: tuple[str, ...] = ()) -> DataFrame:
    return msg.flatten_messages(msg.parse_messages(_raw(spark, sf_dir)), provenance)


def _allergies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return msg.segment_table_from_text(_raw(spark, sf_dir), "AL1")


def _allergy_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The allergy table, laid out for lookups and stored once a session."""
    key = (spark.sparkContext.applicationId, sf_dir, "gold-al1")
    if key not in _STORED:
        path = scratch_folder(spark, "gold-al1")
        coding.store_allergies(_allergies(spark, sf_dir), path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


# Messages


@_query
def message_assemble(spark, sf_dir):
    return grouping.assemble_messages(_lines(spark, sf_dir))


@_query
def message_parse_header(spark, sf_dir):
    return _flat(spark, sf_dir, ("file_path",)).select(
        "file_path", *MESSAGE_KEYS, "patient_name"
    )


def _field_text() -> Column:
    """The whole field map as lines ``name=value``, in order of their names."""
    entries = F.zip_with(F.map_keys("fields"), F.map_values("fields"), lambda key, value: F.concat(key, F.lit("="), value))
    return F.array_join(F.sort_array(entries), "\n")


@_query
def gold_all(spark, sf_dir):
    """Every segment with its fields, as text because maps can't be compared, and their number."""
    return msg.explode_segments(_flat(spark, sf_dir)).select(
        *MESSAGE_KEYS, "segment_id", F.size("fields").alias("filled_fields"), _field_text().alias("fields")
    )


@_query
def gold_all_fields(spark, sf_dir):
    """Every segment with a sum of its whole field map, entries in order of their names."""
    return msg.explode_segments(_flat(spark, sf_dir)).select(
        *MESSAGE_KEYS, "segment_id", F.md5(_field_text().cast("binary")).alias("fields_md5")
    )


def _segment_counts(segments: DataFrame) -> DataFrame:
    return segments.groupBy("segment_id").agg(
        F.count("*").alias("n_rows"), F.sum(F.size("fields")).alias("filled_fields")
    )


@_query
def gold_all_counts(spark, sf_dir):
    return _segment_counts(msg.explode_segments(_flat(spark, sf_dir)))


def _gold(segment: str) -> Query:
    def run(spark, sf_dir):
        return msg.segment_table_from_text(_raw(spark, sf_dir), segment)

    return run


for _segment in SEGMENT_FIELD_NUMBERS:
    _REGISTRY[f"gold_{_segment.lower()}"] = _gold(_segment)


@_query
def gold_obx_from_silver(spark, sf_dir):
    """The typed table from parsed field maps instead of straight from text."""
    return msg.segment_table(_flat(spark, sf_dir), "OBX")


@_query
def message_errors(spark, sf_dir):
    return msg.message_errors(_flat(spark, sf_dir, ("file_path",)), ("file_path",))


@_query
def message_error_report(spark, sf_dir):
    return msg.error_report(msg.text_faults(_raw(spark, sf_dir)))


@_query
def repeated_field_last_wins(spark, sf_dir):
    """Messages whose patient line repeats a field: the map holds the last repetition."""
    flat = _flat(spark, sf_dir, ("file_path",))
    segments = msg.explode_segments(flat, ("file_path",))
    return segments.filter(
        (F.col("segment_id") == "PID") & (F.col("fields")["PID_11"] == "b")
    ).select("file_path", F.col("fields")["PID_11"].alias("last_repetition"))


@_query
def patient_allergies(spark, sf_dir):
    return coding.allergies_of(_allergy_table(spark, sf_dir), PATIENT)


@_query
def customer_allergies(spark, sf_dir):
    patients = read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("patient_id")
    )
    found = coding.allergies_of_patients(_allergies(spark, sf_dir), patients)
    return found.select("patient_id", "message_datetime", "AL1_1", "AL1_3")


@_query
def allergies_by_patient(spark, sf_dir):
    return coding.allergies_by_patient(_allergies(spark, sf_dir)).select(
        "patient_id",
        F.array_join("allergies", "; ").alias("allergies"),
        F.size("allergies").cast("bigint").alias("n_allergies"),
    )


@_query
def distinct_allergies(spark, sf_dir):
    return coding.distinct_allergies(_allergies(spark, sf_dir))


# Streams


def _streams(spark: SparkSession, label: str) -> hops.MessageStreams:
    return hops.MessageStreams(spark, scratch_folder(spark, label), per_trigger=1_000)


@_query
def stream_gold_al1(spark, sf_dir):
    streams = _streams(spark, "gold-al1")
    streams.run("gold_al1", msg.segment_table_from_text(_raw_stream(spark, sf_dir), "AL1"))
    return streams.read("gold_al1")


@_query
def stream_multi_hop(spark, sf_dir):
    streams = _streams(spark, "multi-hop")
    streams.bronze(_raw_stream(spark, sf_dir))
    streams.silver()
    streams.gold_all()
    return streams.read("gold_all").select(
        *MESSAGE_KEYS, "segment_id", F.size("fields").alias("filled_fields")
    )


@_query
def stream_fanout(spark, sf_dir):
    streams = _streams(spark, "fan-out")
    streams.bronze(_raw_stream(spark, sf_dir))
    streams.silver()
    streams.fan_out()
    return _segment_counts(streams.fanned_segments())


def _land(spark: SparkSession, rows: DataFrame, landing: str) -> str:
    """One text file for each name, or for its rows in one scan task, in one folder. The files are opened by all
    tasks and each is moved once, by its task."""
    placed = rows.withColumns({"__task": F.spark_partition_id(), "__at": F.monotonically_increasing_id()})
    # By ranges, of which the first has rows: an empty first task would leave an empty file.
    dealt = placed.repartitionByRange(4 * spark.sparkContext.defaultParallelism, "name")
    entries = F.sort_array(F.collect_list(F.struct("__at", F.coalesce("value", F.lit("")).alias("value"))))
    texts = dealt.groupBy("name", "__task").agg(F.array_join(F.transform(entries, lambda e: e["value"]), "\n").alias("value"))
    writer = texts.select("value").write.option("maxRecordsPerFile", 1)
    writer.option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(landing)
    return landing


def _supplier_landing(spark: SparkSession, sf_dir: str, root: str) -> str:
    return _land(spark, samples.supplier_messages(spark, sf_dir), f"{root}/landing")


@_query
def stream_message_files(spark, sf_dir):
    """One text file per supplier message, picked up by the file source as whole files."""
    streams = hops.MessageStreams(spark, scratch_folder(spark, "files"), per_trigger=10_000)
    streams.ingest(_supplier_landing(spark, sf_dir, streams.root), name_glob="part-*.txt")
    streams.run("gold_pid", msg.segment_table_from_text(streams.stream("raw_data"), "PID"))
    return streams.read("gold_pid").select(*MESSAGE_KEYS, "PID_1", "PID_3", "PID_5")


@_query
def stream_line_files(spark, sf_dir):
    """The same files read line by line and put together again within each micro-batch."""
    root = scratch_folder(spark, "lines")
    landing = _supplier_landing(spark, sf_dir, root)
    lines = line_files(spark, landing, streaming=True, name_glob="part-*.txt", per_trigger=10_000)
    hops.assemble_whole_files(lines, f"{root}/texts", f"{root}/checkpoint")
    return hops.assembled(spark, f"{root}/texts").select("value")


@_query
def stream_assemble_upsert(spark, sf_dir):
    root = scratch_folder(spark, "assemble")
    stored = _lines(spark, sf_dir)
    path = _STORED[(spark.sparkContext.applicationId, sf_dir, "raw_lines")]
    lines = stream_folder(spark, path, stored.schema, per_trigger=4)
    hops.assemble_stream(lines, f"{root}/texts", f"{root}/checkpoint")
    return hops.assembled(spark, f"{root}/texts")


@_query
def stream_index_sync(spark, sf_dir):
    """Two deliveries reach the index as change rows; keys that the second one lacks leave it."""
    root = scratch_folder(spark, "index")
    old, new = _snapshot(spark, sf_dir, 1), _snapshot(spark, sf_dir, 2)
    for delivery in (changes.diff_snapshots(old.limit(0), old), changes.diff_snapshots(old, new)):
        delivery.write.mode("append").parquet(f"{root}/changes")
        schema = spark.read.parquet(f"{root}/changes").schema
        hops.sync_index_stream(
            stream_folder(spark, f"{root}/changes", schema), f"{root}/index",
            f"{root}/checkpoint", lambda rows: with_embedding(rows, token_hash=md5_number),
        )
    weights = F.posexplode("embedding").alias("slot", "weight")
    return hops.read_index(spark, f"{root}/index", ["embedding"]).select("chunk_id", weights).filter(F.col("weight") != 0).select(
        "chunk_id", F.col("slot").cast("bigint").alias("slot"), F.round(F.col("weight").cast("double"), 5).alias("weight")
    )


@_query
def stream_index_compacted(spark, sf_dir):
    """The change rows of two deliveries in twenty batches; the index log is folded in between."""
    root = scratch_folder(spark, "index-batches")
    old, new = _snapshot(spark, sf_dir, 1), _snapshot(spark, sf_dir, 2)
    changed = f"{root}/changes"
    for delivery in (changes.diff_snapshots(old.limit(0), old), changes.diff_snapshots(old, new)):
        delivery.repartition(10, F.xxhash64("chunk_id")).write.mode("append").parquet(changed)
    rows = stream_folder(spark, changed, spark.read.parquet(changed).schema, per_trigger=1)
    hops.sync_index_stream(
        rows, f"{root}/index", f"{root}/checkpoint", lambda df: with_embedding(df, token_hash=md5_number),
        buckets=8, compact_every=6,
    )
    return hops.read_index(spark, f"{root}/index", ["content_chunked"]).select("chunk_id", "content_chunked")


@_query
def stream_assemble_complete(spark, sf_dir):
    """Message lines that arrive one of each file at a time; a text is written when its file is complete."""
    root = scratch_folder(spark, "complete")
    lines = samples.supplier_lines(spark, sf_dir)
    for number in (2, 0, 1):
        lines.filter(F.col("line_no") == number).coalesce(1).write.mode("append").parquet(f"{root}/lines")
    stream = stream_folder(spark, f"{root}/lines", lines.schema, per_trigger=1)
    return hops.assemble_complete_stream(stream, f"{root}/texts", f"{root}/checkpoint")


# Documents


def _shown(docs: DataFrame) -> DataFrame:
    time = F.date_format("last_modified", "yyyy-MM-dd HH:mm:ss").alias("last_modified")
    return docs.select("content", "parser_status", "doc_uri", time)


@_query
def doc_parse_text(spark, sf_dir):
    return _shown(documents.parse_files(samples.document_files(spark, sf_dir)))


@_query
def doc_success_filter(spark, sf_dir):
    docs = documents.parse_files(samples.document_files(spark, sf_dir))
    return documents.parsed_ok(docs).select("doc_uri", F.length("content").alias("n_chars"))


@_query
def doc_dispatch(spark, sf_dir):
    files = (
        samples.document_files(spark, sf_dir)
        .unionByName(samples.page_files(spark, sf_dir))
        .unionByName(samples.event_files(spark, sf_dir))
    )
    docs = documents.parse_files(files)
    ok = F.col("parser_status") == documents.SUCCESS
    return docs.groupBy(file_extension(F.col("doc_uri")).alias("extension"), ok.alias("parsed")).agg(
        F.count("*").alias("files")
    )


@_query
def html_markdown(spark, sf_dir):
    return documents.spread(read_table(spark, sf_dir, "pages")).select(
        "page_id", html_to_markdown(F.col("html")).alias("markdown")
    )


@_query
def html_round_trip(spark, sf_dir):
    """Texts wrapped into pages, a lone ``<`` between their words: every word has to come back."""
    docs = documents.spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    body = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit(" "), F.lit(" < "))
    page = F.concat(F.lit("<html><BODY><OL><LI>"), body, F.lit("</LI></OL></BODY></html>"))
    shown = F.regexp_replace(F.replace(html_to_markdown(page), F.lit("\\"), F.lit("")), r"^1\. ", "")
    words = F.filter(F.split(shown, r"[ \t\r\n]+"), lambda word: word != "")
    return docs.select("doc_id", words.alias("words")).select(
        "doc_id", F.size("words").cast("bigint").alias("n_words"), F.md5(F.array_join("words", " ").cast("binary")).alias("words_md5")
    )


@_query
def json_tags(spark, sf_dir):
    return read_table(spark, sf_dir, "events").select(
        "event_id", json_to_tags(F.col("props")).alias("tags")
    )


@_query
def parse_quality(spark, sf_dir):
    docs = documents.parse_files(samples.document_files(spark, sf_dir))
    return quality.quality_summary(docs)


# Chunks and changes


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    return documents.spread(docs)


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.chunk_fixed(_documents(spark, sf_dir), CHUNK_SIZE, CHUNK_OVERLAP)


def _snapshot_chunks(spark: SparkSession, sf_dir: str, version: int) -> DataFrame:
    snapshot = samples.document_snapshot(spark, sf_dir, version)
    return chunks.chunk_fixed(snapshot, CHUNK_SIZE, CHUNK_OVERLAP)


def _snapshot(spark: SparkSession, sf_dir: str, version: int) -> DataFrame:
    """The stored, keyed chunk table of one delivery."""

    def build(spark, sf_dir):
        return changes.collapse_keys(_snapshot_chunks(spark, sf_dir, version))

    return _stored(spark, sf_dir, f"chunks-{version}", build)


@_query
def chunk_fixed(spark, sf_dir):
    return _chunks(spark, sf_dir)


@_query
def chunk_recursive(spark, sf_dir):
    chunker = recursive_chunker(RECURSIVE_SIZE, RECURSIVE_OVERLAP)
    return chunks.apply_chunker(_documents(spark, sf_dir), chunker)


@_query
def chunk_recursive_words(spark, sf_dir):
    """Without overlap the chunks of a document hold its words, each once."""
    cut = chunks.apply_chunker(_documents(spark, sf_dir), recursive_chunker(RECURSIVE_SIZE))
    words = F.explode(F.filter(F.split("content_chunked", r"\s+"), lambda word: word != "")).alias("word")
    return cut.select("doc_id", words).groupBy("doc_id").agg(
        F.count("*").alias("n_words"), F.count_distinct("word").alias("n_distinct")
    )


@_query
def chunk_recursive_order(spark, sf_dir):
    """Without overlap the chunks of a document hold its words in their order."""
    cut = chunks.apply_chunker(_documents(spark, sf_dir), recursive_chunker(RECURSIVE_SIZE), position="position")
    words = F.filter(F.split("content_chunked", r"\s+"), lambda word: word != "")
    entries = F.sort_array(F.collect_list(F.struct("position", words.alias("words"))))
    joined = cut.groupBy("doc_id").agg(F.flatten(F.transform(entries, lambda e: e["words"])).alias("words"))
    return joined.select("doc_id", F.md5(F.array_join("words", " ").cast("binary")).alias("words_md5"))


@_query
def chunk_recursive_sizes(spark, sf_dir):
    """Documents that have chunks, and how many chunks are above the size."""
    cut = chunks.apply_chunker(_documents(spark, sf_dir), recursive_chunker(RECURSIVE_SIZE, RECURSIVE_OVERLAP))
    above = F.size(F.split("content_chunked", r"\s+")) > RECURSIVE_SIZE
    return cut.groupBy().agg(
        F.count_distinct("doc_id").alias("documents"), F.coalesce(F.sum(above.cast("bigint")), F.lit(0)).alias("oversize")
    )


@_query
def chunk_oversize(spark, sf_dir):
    return chunks.oversize_chunks(_chunks(spark, sf_dir), WINDOW).select(
        "chunk_id", "doc_id", F.col("tokens").cast("bigint").alias("tokens")
    )


@_query
def chunk_window_usage(spark, sf_dir):
    """Share of a 512-token window that each chunk and the overlap fill."""
    sized = chunks.oversize_chunks(_chunks(spark, sf_dir), 0)
    usage = chunks.window_usage(F.col("tokens"), F.lit(CHUNK_OVERLAP), F.lit(512))
    return sized.groupBy(usage.alias("usage_percent")).agg(F.count("*").alias("chunks"))


@_query
def chunk_key_dedup(spark, sf_dir):
    return changes.collapse_keys(_chunks(spark, sf_dir))


@_query
def chunk_diff(spark, sf_dir):
    diff = changes.diff_snapshots(_snapshot(spark, sf_dir, 1), _snapshot(spark, sf_dir, 2))
    return diff.select("change_type", "chunk_id", "doc_uri")


@_query
def index_upsert(spark, sf_dir):
    """The first snapshot with the changes of the second applied."""
    old, new = _snapshot(spark, sf_dir, 1), _snapshot(spark, sf_dir, 2)
    after = changes.apply_changes(old, changes.diff_snapshots(old, new))
    time = F.date_format("last_modified", "yyyy-MM-dd HH:mm:ss").alias("last_modified")
    return after.select("chunk_id", "content_chunked", "doc_uri", time)


@_query
def embed_only_new(spark, sf_dir):
    old, new = _snapshot(spark, sf_dir, 1), _snapshot(spark, sf_dir, 2)
    return changes.rows_to_embed(new, old).select("chunk_id", "content_chunked")


@_query
def index_kept(spark, sf_dir):
    old, new = _snapshot(spark, sf_dir, 1), _snapshot(spark, sf_dir, 2)
    return changes.kept_rows(old, new).select("chunk_id", "content_chunked")


@_query
def document_index(spark, sf_dir):
    """Files to parsed table, gate, chunks with all carried columns and index: a row for each chunk of
    each document and nonzero slot of its vector."""
    root = scratch_folder(spark, "document-index")
    files = samples.document_files(spark, sf_dir)
    cut = lambda docs: chunks.chunk_fixed(docs, CHUNK_SIZE, CHUNK_OVERLAP)
    _, cut_docs = store_document_tables(files, root, cut, max_failed_percent=100, max_empty_percent=100)
    index = plan_index(cut_docs, root, 1, embed=lambda df: with_embedding(df, token_hash=md5_number))
    time = F.date_format("last_modified", "yyyy-MM-dd HH:mm:ss").alias("last_modified")
    slots = index.select("chunk_id", F.posexplode("embedding").alias("slot", "weight")).filter(F.col("weight") != 0)
    return cut_docs.select("chunk_id", "parser_status", "doc_uri", time, F.length("content_chunked").alias("n_chars")).join(slots, "chunk_id").withColumns(
        {"slot": F.col("slot").cast("bigint"), "weight": F.round(F.col("weight").cast("double"), 5)}
    )


@_query
def change_feed_replay(spark, sf_dir):
    """Three versions of the chunk table in a change feed: the last one rebuilt from the changes."""
    feed = ChangeFeed(spark, scratch_folder(spark, "feed"), "chunk_id")
    first, second = _snapshot(spark, sf_dir, 1), _snapshot(spark, sf_dir, 2)
    for snapshot in (first, second, first.filter(F.col("doc_uri").endswith("7"))):
        feed.commit(snapshot)
    time = F.date_format("last_modified", "yyyy-MM-dd HH:mm:ss").alias("last_modified")
    return replayed(feed.changes(1, 3), "chunk_id").select("chunk_id", "content_chunked", "doc_uri", time)


@_query
def change_feed_counts(spark, sf_dir):
    """Rows of each kind in each version of the feed, pre- and post-images of updates included."""
    feed = ChangeFeed(spark, scratch_folder(spark, "feed"), "chunk_id")
    for version in (1, 2):
        feed.commit(_snapshot(spark, sf_dir, version))
    return feed.changes(1, 2).groupBy("version", "change_type").agg(F.count("*").alias("n_rows"))


# Vectors


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings")


def _neighbors(search, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    found = search(queries, corpus, NEIGHBORS + 1, query_id="vec_id", corpus_id="vec_id")
    return similarity.without_self(found, NEIGHBORS, "vec_id", "near_vec_id")


@_query
def vector_topk(spark, sf_dir):
    """Nearest other vectors of every vector."""
    vectors = _vectors(spark, sf_dir)
    return _neighbors(similarity.topk_similar, vectors, vectors)


@_query
def vector_topk_filtered(spark, sf_dir):
    """The same among vectors of the upper labels, a predicate on the corpus."""
    vectors = _vectors(spark, sf_dir)
    return _neighbors(similarity.topk_similar, vectors, vectors.filter(F.col("label") >= 5))


@_query
def vector_topk_approx(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    return _neighbors(similarity.topk_approximate, vectors, vectors)


@_query
def vector_topk_approx_recall(spark, sf_dir):
    """Of the approximate search with its own parameters: queries with all their neighbors, and whether
    at least 0.9 of the exact neighbors are among them."""
    vectors = _vectors(spark, sf_dir)
    near = _neighbors(similarity.topk_approximate, vectors, vectors)
    exact = _neighbors(similarity.topk_similar, vectors, vectors)
    found = near.select("vec_id", "near_vec_id", F.col("score").alias("near_score"))
    both = exact.join(found, ["vec_id", "near_vec_id"], "left")
    return both.agg(
        F.count_distinct("vec_id").alias("queries"),
        (F.count("near_score") / F.count("*") >= 0.9).alias("recall_reached"),
        F.coalesce(F.max(F.abs(F.col("near_score") - F.col("score"))) < 1e-9, F.lit(True)).alias("scores_exact"),
    )


# Vector index


def _chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct chunks of all documents with their embeddings, and the first document of each."""

    def build(spark, sf_dir):
        keyed = changes.collapse_keys(_chunks(spark, sf_dir))
        return with_embedding(keyed, token_hash=md5_number).select("chunk_id", "doc_id", "embedding")

    return _stored(spark, sf_dir, "chunk-vectors", build)


def _chunk_index(spark: SparkSession, sf_dir: str) -> VectorIndex:
    key = (spark.sparkContext.applicationId, sf_dir, "chunk-index")
    if key not in _STORED:
        path = scratch_folder(spark, "chunk-index")
        build_index(_chunk_vectors(spark, sf_dir), path, neighbors=NEIGHBORS)
        _STORED[key] = path
    return open_index(spark, _STORED[key])


def _chunk_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: chunks of documents whose id is divisible by 100."""
    asked = _chunk_vectors(spark, sf_dir).filter(F.col("doc_id") % 100 == 0)
    return asked.select(F.col("chunk_id").alias("query_id"), "embedding")


@_query
def chunk_neighbors_approx(spark, sf_dir):
    """Nearest chunks in the probed cells, with the share of all chunks that each query was compared with."""
    index, asked = _chunk_index(spark, sf_dir), _chunk_queries(spark, sf_dir)
    found = similarity.without_self(topk_indexed(asked, index, NEIGHBORS + 1), NEIGHBORS, "query_id", "chunk_id")
    share = compared_rows(asked, index, NEIGHBORS + 1).select(
        "query_id", (F.col("compared") / int(index.rows.sum())).alias("compared_share")
    )
    return found.join(share, "query_id")


@_query
def chunk_neighbors_exact(spark, sf_dir):
    """Nearest chunks of all; cells that can't hold one are left out."""
    index, asked = _chunk_index(spark, sf_dir), _chunk_queries(spark, sf_dir)
    return similarity.without_self(topk_pruned(asked, index, NEIGHBORS + 1), NEIGHBORS, "query_id", "chunk_id")


@_query
def chunk_neighbors_recall(spark, sf_dir):
    """Of the search in cells: its queries, whether 0.9 of the exact neighbors are found, whether less than
    a fifth of the chunks was compared for it, and whether its scores are exact."""
    index, asked = _chunk_index(spark, sf_dir), _chunk_queries(spark, sf_dir)
    near = similarity.without_self(topk_indexed(asked, index, NEIGHBORS + 1), NEIGHBORS, "query_id", "chunk_id")
    exact = similarity.without_self(
        similarity.topk_similar(asked, _chunk_vectors(spark, sf_dir), NEIGHBORS + 1), NEIGHBORS, "query_id", "chunk_id"
    )
    both = exact.join(near.select("query_id", "chunk_id", F.col("score").alias("near_score")), ["query_id", "chunk_id"], "left")
    share = compared_rows(asked, index, NEIGHBORS + 1).agg((F.avg("compared") / int(index.rows.sum())).alias("share"))
    return both.agg(
        F.count_distinct("query_id").alias("queries"),
        (F.count("near_score") / F.count("*") >= 0.9).alias("recall_reached"),
        F.coalesce(F.max(F.abs(F.col("near_score") - F.col("score"))) < 1e-9, F.lit(True)).alias("scores_exact"),
    ).join(share.select((F.col("share") < 0.2).alias("share_below_fifth")))


@_query
def embed_hash(spark, sf_dir):
    """Weights of the hashed embedding of every document, one row per nonzero slot."""
    embedded = _documents(spark, sf_dir).select(
        "doc_id",
        F.posexplode(hashed_embedding(F.col("content"), DIMENSIONS, md5_number)).alias("slot", "weight"),
    )
    return embedded.filter(F.col("weight") != 0).select(
        "doc_id", F.col("slot").cast("bigint").alias("slot"),
        F.round(F.col("weight").cast("double"), 5).alias("weight"),
    )


def _definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code definitions with their embeddings, one per part."""
    text = F.concat_ws(
        " ", F.concat(F.lit("P"), F.col("p_partkey").cast("string")), "p_brand", "p_type", "p_name"
    )
    parts = documents.spread(read_table(spark, sf_dir, "part")).select(text.alias("content_chunked"))
    keyed = parts.select(F.md5("content_chunked").alias("chunk_id"), "content_chunked")
    return with_embedding(changes.collapse_keys(keyed), token_hash=md5_number)


@_query
def code_allergies(spark, sf_dir):
    return coding.code_allergies(
        _allergy_table(spark, sf_dir),
        _definitions(spark, sf_dir),
        lambda df, column: with_embedding(df, column, token_hash=md5_number),
        CODES_PER_ALLERGY,
    )


# Conversations


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "conversations")


@_query
def conv_last_message(spark, sf_dir):
    return conversations.last_messages(_turns(spark, sf_dir))


@_query
def conv_transcript(spark, sf_dir):
    return conversations.transcripts(_turns(spark, sf_dir))


@_query
def conv_counts(spark, sf_dir):
    return conversations.message_counts(_turns(spark, sf_dir))


@_query
def response_messages(spark, sf_dir):
    """Each turn as a chat response: assistant turns as a choice, the others as a message list."""
    message = F.struct("role", F.col("text").alias("content"))
    choice = F.to_json(F.struct(F.array(F.struct(message.alias("message"))).alias("choices")))
    listed = F.to_json(F.struct(F.array(message).alias("messages")))
    responses = _turns(spark, sf_dir).select(
        "conv_id", "turn",
        F.when(F.col("role") == "assistant", choice)
        .when(F.col("role") == "user", listed)
        .otherwise("{}").alias("response"),
    )
    return conversations.explode_responses(responses)


@_query
def update_messages(spark, sf_dir):
    """Each turn as two agent updates, an empty one and one with the message twice."""
    message = F.struct("role", F.col("text").alias("content"))
    updates = F.concat(
        F.lit('[{"supervisor":{}},{"worker":'),
        F.to_json(F.struct(F.array(message, message).alias("messages"))),
        F.lit("}]"),
    )
    return conversations.explode_updates(
        _turns(spark, sf_dir).select("conv_id", "turn", updates.alias("updates"))
    )
