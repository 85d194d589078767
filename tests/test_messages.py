"""Golden messages, and the two routes to typed tables."""

import pytest
from pyspark.sql import functions as F

from chartloom.operators import messages as msg

HEAD = "MSH|^~\\&|A|B|C|D|20240102||ADT^A01|7|P|2.5"


def parse(spark, *texts):
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "file_path string, value string")
    return msg.flatten_messages(msg.parse_messages(rows), ("file_path",))


def one(spark, text):
    return parse(spark, text).first()


def test_header_values_and_segment_order(spark):
    row = one(spark, f"{HEAD}\rEVN|A01\rPID|1||p9||Doe^J\rZZZ|x||y\rAL1|1|DA|nuts")
    assert row["message_type"] == "ADT^A01"
    assert row["message_datetime"] == "20240102"
    assert (row["patient_id"], row["patient_name"]) == ("p9", "Doe^J")
    assert [s["segment_id"] for s in row["segments"]] == ["MSH", "EVN", "PID", "ZZZ", "AL1"]
    assert row["segments"][3]["fields"] == {"ZZZ_1": "x", "ZZZ_3": "y"}


def test_header_fields_are_shifted_and_kept_verbatim(spark):
    fields = one(spark, HEAD)["segments"][0]["fields"]
    assert fields["MSH_1"] == "|"
    assert fields["MSH_2"] == "^~\\&"
    assert fields["MSH_3"] == "A"
    assert "MSH_8" not in fields
    assert fields["MSH_12"] == "2.5"


@pytest.mark.parametrize("ends", ["\r", "\n", "\r\n", "\r\r", "\n \n"])
def test_line_ends_and_blank_lines(spark, ends):
    row = one(spark, ends.join([HEAD, "PID|1||p1", "AL1|1"]))
    assert [s["segment_id"] for s in row["segments"]] == ["MSH", "PID", "AL1"]
    assert row["patient_id"] == "p1"


def test_last_repetition_wins_in_fields_first_in_header(spark):
    row = one(spark, f"{HEAD}\rPID|1||first~second||N1~N2||x~")
    fields = row["segments"][1]["fields"]
    assert (fields["PID_3"], fields["PID_5"]) == ("second", "N2")
    assert "PID_7" not in fields
    assert (row["patient_id"], row["patient_name"]) == ("first", "N1")


def test_last_patient_line_counts(spark):
    row = one(spark, f"{HEAD}\rPID|1||a||A\rPID|2||b||B")
    assert (row["patient_id"], row["patient_name"]) == ("b", "B")


def test_other_separators(spark):
    row = one(spark, "MSH#^*\\&#A#B#C#D#t##X^Y\rPID#1##p*q")
    assert row["message_type"] == "X^Y"
    assert row["patient_id"] == "p"
    assert row["segments"][1]["fields"] == {"PID_1": "1", "PID_3": "q"}
    assert row["segments"][0]["fields"]["MSH_1"] == "#"


def test_separator_that_is_a_regex_sign(spark):
    row = one(spark, "MSH.^~\\&.A.B.C.D.t..M\rPID.1..p")
    assert (row["message_type"], row["patient_id"]) == ("M", "p")


@pytest.mark.parametrize(
    "text, reason",
    [
        (None, msg.NO_TEXT), ("", msg.TOO_SHORT), ("MSH|^~", msg.TOO_SHORT),
        ("PID|1||p9||Doe", msg.NO_HEADER),
    ],
)
def test_unreadable_messages_become_rows(spark, text, reason):
    row = one(spark, text)
    assert row["message_type"] == "ERROR"
    assert row["message_datetime"] is row["patient_id"] is row["patient_name"] is None
    assert [(s["segment_id"], s["fields"]) for s in row["segments"]] == [("ERROR", {"error": reason})]


def test_errors_and_readable_messages_part_the_rows(spark):
    texts = [HEAD, None, "nothing useful", "MSH|^~\\&|A|B"]
    flat = parse(spark, *texts)
    raw = spark.createDataFrame([(t,) for t in texts], "value string")
    assert msg.message_errors(flat).count() == 2
    assert msg.readable_messages(flat).count() == 2
    assert sorted(msg.text_faults(raw).collect()) == sorted(msg.message_errors(flat).collect())
    report = {r["error_text"]: r["messages"] for r in msg.error_report(msg.text_faults(raw)).collect()}
    assert report == {msg.NO_TEXT: 1, msg.NO_HEADER: 1}


def test_message_without_type_keeps_null(spark):
    assert one(spark, "MSH|^~\\&|A|B")["message_type"] is None


@pytest.mark.parametrize("segment", ["MSH", "PID", "AL1", "PV1"])
def test_both_routes_agree(spark, segment):
    texts = [
        f"{HEAD}\rPID|1||a~b||A|||x\rPV1|{'|'.join(f'v{n}' for n in range(1, 55))}\rAL1|1|DA|n\rAL1|2||m~o",
        "MSH#^~\\&#A\rPID#1\rAL1\rPV1", None, "broken message", f"{HEAD}\rPIDX|1",
    ]
    raw = spark.createDataFrame([(t,) for t in texts], "value string")
    parsed = msg.flatten_messages(msg.parse_messages(raw))
    only = msg.flatten_messages(msg.parse_messages(raw, only=[segment]))
    expected = sorted(map(str, msg.segment_table(parsed, segment).collect()))
    assert sorted(map(str, msg.segment_table_from_text(raw, segment).collect())) == expected
    assert sorted(map(str, msg.segment_table(only, segment).collect())) == expected
    exploded = msg.typed_segments(msg.explode_segments(parsed), segment)
    assert sorted(map(str, exploded.collect())) == expected


def test_visit_table_leaves_out_fields_41_to_50(spark):
    raw = spark.createDataFrame([(HEAD,)], "value string")
    columns = msg.segment_table_from_text(raw, "PV1").columns
    assert "PV1_40" in columns and "PV1_51" in columns
    assert not {f"PV1_{n}" for n in range(41, 51)} & set(columns)


def test_own_field_list_and_unknown_segment(spark):
    raw = spark.createDataFrame([(f"{HEAD}\rZZZ|a|b",)], "value string")
    assert msg.segment_table_from_text(raw, "ZZZ", [2]).first()["ZZZ_2"] == "b"
    with pytest.raises(ValueError):
        msg.segment_table_from_text(raw, "ZZZ")


def test_provenance_is_carried_on_request(spark):
    flat = parse(spark, f"{HEAD}\rAL1|1")
    assert msg.segment_table(flat, "AL1", provenance=("file_path",)).columns[0] == "file_path"
    assert "file_path" not in msg.segment_table(flat, "AL1").columns


def test_no_python_worker_on_the_message_path(spark):
    raw = spark.createDataFrame([(HEAD,)], "value string").withColumn("value", F.upper("value"))
    tables = [msg.explode_segments(msg.flatten_messages(msg.parse_messages(raw)))]
    tables.append(msg.segment_table_from_text(raw, "OBX"))
    for table in tables:
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "ArrowEval" not in plan


def _expected_fields(line, separator, repetition):
    """The map of a line, field by field."""
    parts = line.split(separator)
    fields = [separator, *parts[1:]] if parts[0] == "MSH" else parts[1:]
    last = [f if parts[0] == "MSH" and i == 1 else f.split(repetition)[-1] for i, f in enumerate(fields)]
    return parts[0], {f"{parts[0]}_{i + 1}": f for i, f in enumerate(last) if f}


@pytest.mark.parametrize("head, separator, repetition", [
    (HEAD, "|", "~"), ("MSH|^~\\&|a~b|~|c~", "|", "~"), ("MSH~^~\\&~A~B~C", "~", "~"), ("MSH#^*\\&#x*y", "#", "*"), ("MSHM^~\\&MAMB", "M", "~"),
])
def test_fields_of_all_kinds_and_lengths(spark, head, separator, repetition):
    lines = [head]
    for kind in [*msg.SEGMENT_FIELD_NUMBERS, "ZZZ", "", "MSHX", "OBX~P", "É"]:
        for n in (0, 1, 7, 8, 9, 16, 17, 63, 64, 65, 200):
            for make in (lambda i: f"v{i}", lambda i: "" if i % 3 == 0 else f"a{repetition}b{i}", lambda i: "", lambda i: "é" if i % 7 else repetition):
                lines.append(separator.join([kind, *(make(i) for i in range(n))]))
    lines = [line for line in lines if line.strip(" ")]
    found = [(s["segment_id"], s["fields"]) for s in one(spark, "\r".join(lines))["segments"]]
    assert found == [_expected_fields(line, separator, repetition) for line in lines]


def test_names_of_usual_fields_are_not_made_for_each_line(spark):
    raw = spark.createDataFrame([(HEAD,)], "value string")
    plan = msg.parse_messages(raw)._jdf.queryExecution().optimizedPlan().toString()
    assert "map_from_arrays" in plan and "OBX_16" in plan


def test_the_table_of_all_segments_has_the_values_of_their_fields(spark, tmp_path):
    from chartloom.catalog.queries import all_queries

    tables = {
        "part": ([(2, "bolt", "LARGE")], "p_partkey long, p_name string, p_type string"),
        "customer": ([(7, "Ann", "AUTO")], "c_custkey long, c_name string, c_mktsegment string"),
        "orders": (
            [(3, 7, "O", "1996-01-02", "HIGH"), (89, 7, "F", "1996-01-03", None), (97, 7, "F", "1996-01-03", "LOW")],
            "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate string, o_orderpriority string",
        ),
        "lineitem": ([(3, 2, 1, 5.0, "R")], "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_returnflag string"),
    }
    for name, (data, schema) in tables.items():
        table = spark.createDataFrame(data, schema)
        if name == "lineitem":
            table = table.selectExpr("*", "1L l_suppkey", "1D l_extendedprice", "0D l_discount", "0D l_tax", "'O' l_linestatus", "'1996-02-01' l_shipdate")
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    got = {(r.message_datetime, r.segment_id): r for r in all_queries()["gold_all"](spark, str(tmp_path)).collect()}
    first, second = "19960102000000", "19960103000000"
    assert got[first, "OBX"].fields == "OBX_1=1\nOBX_2=NM\nOBX_3=2\nOBX_5=5" and got[first, "OBX"].filled_fields == 4
    assert got[first, "AL1"].fields == "AL1_1=1\nAL1_2=DA\nAL1_3=bolt"
    assert got[second, "PID"].fields == "PID_11=b\nPID_1=1\nPID_3=7\nPID_5=Ann"
    assert got[None, "ERROR"].fields == "error=message does not start with a header segment"
