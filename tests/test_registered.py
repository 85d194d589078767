"""Every registered query next to its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as registered
from check_oracles import rows

ORACLES = registered.oracle_sql()


@pytest.fixture(scope="module")
def db(sf_dir):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(registered.queries()))
def test_query(spark, sf_dir, db, name):
    df = registered.queries()[name](spark, sf_dir)
    got = rows(df.columns, df.collect())
    assert got
    if name in ORACLES:
        result = db.sql(ORACLES[name])
        assert sorted(df.columns) == sorted(result.columns)
        assert got == rows(result.columns, result.fetchall())


def test_entry(spark, sf_dir):
    assert registered.entry(spark).columns == ["AL1_1", "AL1_2", "AL1_3"]


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(registered.queries())


def test_items_of_an_order_travel_as_rows(spark, tmp_path):
    """Items are collected behind their shuffle: arrays collected before it would be sorted on disk by each task."""
    from chartloom import samples

    tables = {
        "part": ([(1, "nut", "SMALL"), (2, "bolt", "LARGE")], "p_partkey long, p_name string, p_type string"),
        "customer": ([(7, "Ann", "AUTO")], "c_custkey long, c_name string, c_mktsegment string"),
        "orders": (
            [(3, 7, "O", "1996-01-02", "HIGH"), (4, 7, "F", "1996-01-03", "LOW")],
            "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate string, o_orderpriority string",
        ),
        "lineitem": (
            [(3, 2, 2, 5.0, "R"), (3, 1, 1, 4.0, "N"), (3, 1, 1, 4.0, "N"), (3, 9, 9, 1.0, "R"), (None, 1, 1, 1.0, "R")],
            "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_returnflag string",
        ),
    }
    for name, (rows, schema) in tables.items():
        table = spark.createDataFrame(rows, schema)
        if name == "lineitem":
            table = table.selectExpr("*", "1L l_suppkey", "1D l_extendedprice", "0D l_discount", "0D l_tax", "'O' l_linestatus", "'1996-02-01' l_shipdate")
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    made = samples.order_messages(spark, str(tmp_path))
    plan = made._jdf.queryExecution().executedPlan().toString().splitlines()
    lines = {row["o_orderkey"]: row["lines"] for row in made.collect()}
    assert [line for line in lines[3] if line[:3] in ("OBR", "OBX", "AL1")] == [
        "OBR|1|3||SMALL", "OBX|1|NM|1||4", "OBX|2|NM|1||4", "OBX|3|NM|2||5", "AL1|3|DA|bolt"
    ]
    assert not [line for line in lines[4] if line[:3] in ("OBR", "OBX", "AL1")]
    partial = next(i for i, line in enumerate(plan) if "partial_collect_list" in line)
    dealt = next(line for line in plan[partial + 1 :] if "Sort" not in line and "Project" not in line)
    assert "Exchange hashpartitioning(l_orderkey" in dealt
