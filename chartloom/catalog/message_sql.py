"""Expected results of the message queries, in SQL over the base tables."""

from __future__ import annotations

from collections.abc import Callable

from chartloom.samples import LINE_ORDER
from chartloom.schemas import SEGMENT_FIELD_NUMBERS

BASE = f"""
WITH items AS (
  SELECT l.*, p_name, p_type,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE_ORDER)}) AS n
  FROM lineitem l JOIN part ON l_partkey = p_partkey
), every_order AS (
  SELECT o.*, c_name, c_mktsegment,
         o_orderkey::VARCHAR AS okey, o_custkey::VARCHAR AS cust,
         strftime(o_orderdate, '%Y%m%d%H%M%S') AS dt,
         '/landing/part-00' || o_orderkey::VARCHAR AS file_path
  FROM orders o JOIN customer ON o_custkey = c_custkey
), good AS (
  SELECT *, 'ADT^A01' AS message_type, dt AS message_datetime,
         CASE WHEN o_orderkey % 83 = 0 THEN cust || '-2' ELSE cust END AS patient_id
  FROM every_order WHERE o_orderkey % 97 <> 0 AND o_orderkey % 101 <> 0
)
"""

# Values by field number for each segment kind, and the rows that carry them.
_ROWS: dict[str, list[tuple[dict[int, str], str]]] = {
    "MSH": [
        (
            {1: "'|'", 2: "'^~\\&'", 3: "'SRC'", 4: "'FAC'", 5: "'DST'", 6: "'DFAC'", 7: "dt",
             9: "'ADT^A01'", 10: "okey", 11: "'P'", 12: "'2.5'"},
            "good",
        )
    ],
    "EVN": [({1: "'A01'", 2: "dt"}, "good")],
    "PID": [
        (
            {1: "'1'", 3: "cust", 5: "c_name",
             11: "CASE WHEN o_orderkey % 89 = 0 THEN 'b' ELSE c_mktsegment END"},
            "good",
        ),
        ({1: "'2'", 3: "cust || '-2'", 5: "c_name"}, "good WHERE o_orderkey % 83 = 0"),
    ],
    "PV1": [
        (
            {1: "'1'", 2: "o_orderstatus", 3: "o_orderpriority"},
            "good WHERE o_orderkey % 71 <> 0",
        ),
        ({n: f"'v{n}'" for n in range(1, 55)}, "good WHERE o_orderkey % 71 = 0"),
    ],
    "OBR": [
        (
            {1: "'1'", 2: "okey", 4: "p_type"},
            "good JOIN items ON l_orderkey = o_orderkey WHERE n = 1",
        )
    ],
    "OBX": [
        (
            {1: "n::VARCHAR", 2: "'NM'", 3: "l_partkey::VARCHAR", 5: "l_quantity::BIGINT::VARCHAR"},
            "good JOIN items ON l_orderkey = o_orderkey",
        )
    ],
    "CTI": [({1: "okey"}, "good WHERE o_orderkey % 5 = 0")],
    "AL1": [
        (
            {1: "n::VARCHAR", 2: "'DA'", 3: "p_name"},
            "good JOIN items ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'",
        )
    ],
}


def segment_sql(segment: str) -> str:
    """The typed table of one segment kind."""
    branches = []
    for values, source in _ROWS[segment]:
        columns = ", ".join(
            f"{values.get(n, 'CAST(NULL AS VARCHAR)')} AS {segment}_{n}"
            for n in SEGMENT_FIELD_NUMBERS[segment]
        )
        branches.append(
            f"SELECT message_type, message_datetime, patient_id, '{segment}' AS segment_id, "
            f"{columns} FROM {source}"
        )
    return BASE + "\nUNION ALL\n".join(branches)


def all_segments_sql() -> str:
    """Key columns, kind and number of filled fields of every segment, errors included."""
    branches = []
    for segment, variants in _ROWS.items():
        for values, source in variants:
            branches.append(
                f"SELECT message_type, message_datetime, patient_id, '{segment}' AS segment_id, "
                f"{len(values)} AS filled_fields FROM {source}"
            )
    branches.append(
        "SELECT message_type, message_datetime, patient_id, 'ZZZ', 2 FROM good "
        "WHERE o_orderkey % 79 = 0"
    )
    branches.append(
        "SELECT 'ERROR', NULL, NULL, 'ERROR', 1 FROM every_order "
        "WHERE o_orderkey % 97 = 0 OR o_orderkey % 101 = 0"
    )
    return BASE + "\nUNION ALL\n".join(branches)


def _with_fields_sql(shown: Callable[[list[str]], str]) -> str:
    """Key columns, kind and what is shown of the fields (``name=value``) of every segment, errors included."""
    branches = []
    for segment, variants in _ROWS.items():
        for values, source in variants:
            fields = [f"'{segment}_{n}=' || {value}" for n, value in values.items()]
            branches.append(
                f"SELECT message_type, message_datetime, patient_id, '{segment}' AS segment_id, {shown(fields)} FROM {source}"
            )
    custom = shown(["'ZZZ_1=custom'", "'ZZZ_2=' || okey"])
    branches.append(
        f"SELECT message_type, message_datetime, patient_id, 'ZZZ', {custom} FROM good WHERE o_orderkey % 79 = 0"
    )
    fault = shown([f"'error=' || {_ERROR_TEXT}"])
    branches.append(
        f"SELECT 'ERROR', NULL, NULL, 'ERROR', {fault} FROM every_order WHERE o_orderkey % 97 = 0 OR o_orderkey % 101 = 0"
    )
    return BASE + "\nUNION ALL\n".join(branches)


def _sorted_text(fields: list[str]) -> str:
    return f"array_to_string(list_sort([{', '.join(fields)}]), chr(10))"


def all_fields_sql() -> str:
    """Of every segment the md5 sum of its sorted fields."""
    return _with_fields_sql(lambda fields: f"md5({_sorted_text(fields)}) AS fields_md5")


def gold_all_sql() -> str:
    """Of every segment its sorted fields and their number."""
    return _with_fields_sql(lambda fields: f"{len(fields)} AS filled_fields, {_sorted_text(fields)} AS fields")


def segment_counts_sql() -> str:
    return (
        f"SELECT segment_id, count(*) AS n_rows, sum(filled_fields)::BIGINT AS filled_fields "
        f"FROM ({all_segments_sql()}) GROUP BY segment_id"
    )


HEADER_SQL = BASE + """
SELECT file_path, message_type, message_datetime, patient_id, c_name AS patient_name FROM good
UNION ALL
SELECT file_path, 'ERROR', NULL, NULL, NULL FROM every_order
WHERE o_orderkey % 97 = 0 OR o_orderkey % 101 = 0
"""

_ERROR_TEXT = """CASE WHEN o_orderkey % 101 = 0 THEN 'message text is missing'
            ELSE 'message does not start with a header segment' END"""

_ERRORS = f"""
SELECT file_path, {_ERROR_TEXT} AS error_text
FROM every_order WHERE o_orderkey % 97 = 0 OR o_orderkey % 101 = 0
"""

ERRORS_SQL = BASE + _ERRORS
ERROR_REPORT_SQL = (
    BASE + f"SELECT error_text, count(*) AS messages FROM ({_ERRORS}) GROUP BY error_text"
)

LAST_REPETITION_SQL = BASE + """
SELECT file_path, 'b' AS last_repetition FROM good WHERE o_orderkey % 89 = 0
"""

_LINES = """
, all_lines AS (
  SELECT file_path, o_orderkey, 0 AS part, 0 AS n,
         'MSH|^~\\&|SRC|FAC|DST|DFAC|' || dt || '||ADT^A01|' || okey || '|P|2.5' AS value
  FROM every_order WHERE o_orderkey % 97 <> 0
  UNION ALL SELECT file_path, o_orderkey, 1, 0, 'EVN|A01|' || dt FROM every_order
  UNION ALL SELECT file_path, o_orderkey, 2, 0, 'PID|1||' || cust || '||' || c_name || '||||||' ||
         CASE WHEN o_orderkey % 89 = 0 THEN 'a~b' ELSE c_mktsegment END FROM every_order
  UNION ALL SELECT file_path, o_orderkey, 3, 0, 'PID|2||' || cust || '-2||' || c_name
    FROM every_order WHERE o_orderkey % 83 = 0
  UNION ALL SELECT file_path, o_orderkey, 4, 0, 'PV1|1|' || o_orderstatus || '|' || o_orderpriority
    FROM every_order WHERE o_orderkey % 71 <> 0
  UNION ALL SELECT file_path, o_orderkey, 4, 0,
         'PV1|' || array_to_string(list_transform(range(1, 55), lambda i: 'v' || i), '|')
    FROM every_order WHERE o_orderkey % 71 = 0
  UNION ALL SELECT file_path, o_orderkey, 5, 0, 'OBR|1|' || okey || '||' || p_type
    FROM every_order JOIN items ON l_orderkey = o_orderkey WHERE n = 1
  UNION ALL SELECT file_path, o_orderkey, 6, n,
         'OBX|' || n || '|NM|' || l_partkey || '||' || l_quantity::BIGINT
    FROM every_order JOIN items ON l_orderkey = o_orderkey
  UNION ALL SELECT file_path, o_orderkey, 7, 0, 'CTI|' || okey
    FROM every_order WHERE o_orderkey % 5 = 0
  UNION ALL SELECT file_path, o_orderkey, 8, n, 'AL1|' || n || '|DA|' || p_name
    FROM every_order JOIN items ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'
  UNION ALL SELECT file_path, o_orderkey, 9, 0, 'ZZZ|custom|' || okey
    FROM every_order WHERE o_orderkey % 79 = 0
)
"""

ASSEMBLE_SQL = BASE + _LINES + """
SELECT file_path, string_agg(value, chr(13) ORDER BY part, n) AS value
FROM all_lines GROUP BY file_path
"""


def patient_sql(patient_id: str) -> str:
    return f"SELECT AL1_1, AL1_2, AL1_3 FROM ({segment_sql('AL1')}) WHERE patient_id = '{patient_id}'"


ALLERGIES_BY_PATIENT_SQL = f"""
SELECT patient_id, string_agg(AL1_3, '; ' ORDER BY AL1_3) AS allergies, count(*) AS n_allergies
FROM (SELECT DISTINCT patient_id, AL1_3 FROM ({segment_sql('AL1')})) GROUP BY patient_id
"""

DISTINCT_ALLERGIES_SQL = f"SELECT DISTINCT AL1_3 FROM ({segment_sql('AL1')})"
