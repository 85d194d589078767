"""Snapshot diff, upsert, ordered assembly, chat shapes."""

import pytest

from chartloom.functions.embedding import with_embedding
from chartloom.operators import changes, conversations, grouping


def table(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, content_chunked string, doc_uri string")


OLD = [("a", "A", "u1"), ("b", "B", "u1"), ("c", "C", None)]
NEW = [("a", "A", "u1"), ("b", "B", "u2"), ("c", "C", None), ("d", "D", "u3")]


def test_diff_and_apply(spark):
    old, new = table(spark, OLD + [("z", "Z", "u9")]), table(spark, NEW)
    diff = changes.diff_snapshots(old, new)
    kinds = {r["chunk_id"]: r["change_type"] for r in diff.collect()}
    assert kinds == {"b": "update", "d": "insert", "z": "delete"}
    applied = changes.apply_changes(old, diff)
    assert sorted(map(str, applied.collect())) == sorted(map(str, new.collect()))


def test_diff_sees_null_and_needs_same_columns(spark):
    old, new = table(spark, [("c", "C", None)]), table(spark, [("c", "C", "u")])
    assert changes.diff_snapshots(old, new).first()["change_type"] == "update"
    with pytest.raises(ValueError):
        changes.diff_snapshots(old.drop("doc_uri"), new)


def test_sync_embeds_new_keys_only(spark):
    index = with_embedding(table(spark, OLD).select("chunk_id", "content_chunked"))
    embedded = []

    def embed(rows):
        embedded.extend(r["chunk_id"] for r in rows.collect())
        return with_embedding(rows)

    synced = changes.sync_index(index, table(spark, NEW[1:] + NEW[:2]), embed)
    assert embedded == ["d"]
    assert sorted(r["chunk_id"] for r in synced.collect()) == ["a", "b", "c", "d"]
    dropped = changes.sync_index(index, table(spark, NEW[:1]), with_embedding)
    assert [r["chunk_id"] for r in dropped.collect()] == ["a"]


def test_latest_by_key(spark):
    log = spark.createDataFrame(
        [("a", "insert", 1, 0), ("a", "update", 2, 1), ("b", "insert", 1, 0), ("b", "delete", 1, 2)],
        "key string, change_type string, v int, batch_id int",
    )
    assert [tuple(r) for r in changes.latest_by_key(log, "key").collect()] == [("a", 2)]


def test_assembly_orders_across_blocks(spark):
    lines = [("f", n, f"l{n}") for n in reversed(range(25))] + [("g", 0, "x"), ("g", 1, None)]
    df = spark.createDataFrame(lines, "file_path string, line_no long, value string").repartition(5)
    text = grouping.F.col("value")
    rows = grouping.assemble_text(df, ["file_path"], ["line_no"], text, ",", "value", block_rows=4)
    got = {r["file_path"]: r["value"] for r in rows.collect()}
    assert got == {"f": ",".join(f"l{n}" for n in range(25)), "g": "x,"}


def test_response_shapes(spark):
    df = spark.createDataFrame(
        [
            (1, '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}]}'),
            (2, '{"choices":[{"message":{"role":"assistant","content":"c"}},{"message":{"content":"d"}}]}'),
            (3, '{"other":1}'), (4, "not json"), (5, '{"messages":[]}'),
        ],
        "id int, response string",
    )
    rows = conversations.explode_responses(df).orderBy("id", "position").collect()
    got = [(r["id"], r["position"], r["role"], r["content"], r["fault"] is not None) for r in rows]
    assert got == [
        (1, 0, "user", "a", False), (1, 1, "assistant", "b", False), (2, 0, "assistant", "c", False),
        (3, 0, None, None, True), (4, 0, None, None, True),
    ]


def test_update_lists(spark):
    text = (
        '[{"supervisor":{"next_node":"x"}},{"n1":{"messages":[{"role":"a","content":"1"}]},'
        '"n2":{"messages":[{"role":"b","content":"2"}]}},{"n3":{"messages":[{"role":"c","content":"3"}]}}]'
    )
    rows = conversations.explode_updates(spark.createDataFrame([(1, text)], "id int, updates string"))
    assert [r["content"] for r in rows.orderBy("position").collect()] == ["1", "2", "3"]


def test_conversation_aggregates(spark):
    turns = spark.createDataFrame(
        [(1, 1, "assistant", "x\ny"), (1, 0, "user", "q"), (2, 0, "user", "only")],
        "conv_id long, turn long, role string, text string",
    )
    last = {r["conv_id"]: (r["turn"], r["text"]) for r in conversations.last_messages(turns).collect()}
    assert last == {1: (1, "x\ny"), 2: (0, "only")}
    texts = {r["conv_id"]: r["transcript"] for r in conversations.transcripts(turns).collect()}
    assert texts == {1: "user: q\nassistant: x\ny", 2: "user: only"}
    assert conversations.message_counts(turns).filter("messages = 2").count() == 1
