"""SQL that states the expected result of the registered queries."""

from __future__ import annotations

from chartloom.catalog import message_sql as m
from chartloom.catalog.html_sql import HTML_SQL, ROUND_TRIP_SQL
from chartloom.catalog.queries import (
    CHUNK_OVERLAP, CHUNK_SIZE, CODES_PER_ALLERGY, NEIGHBORS, PATIENT, WINDOW,
)
from chartloom.functions.embedding import DIMENSIONS
from chartloom.schemas import SEGMENT_FIELD_NUMBERS

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"

_FILES = f"""
WITH files AS (
  SELECT doc_id, text,
         list_extract(['.txt', '.md', '.TXT', '.xyz'], (doc_id % 4 + 1)::INT) AS ext,
         doc_id % 31 = 0 AS broken, doc_id % 31 <> 0 AND doc_id % 29 = 0 AS blank
  FROM documents
), parsed AS (
  SELECT 'd' || doc_id || ext AS name,
         CASE WHEN ext IN ('.TXT', '.xyz')
              THEN 'An error occurred: no parser for file:/in/d' || doc_id || ext
              WHEN broken THEN 'An error occurred: the bytes are not UTF-8 text'
              ELSE 'SUCCESS' END AS parser_status,
         CASE WHEN blank THEN '' ELSE trim(text, {_BLANKS}) END AS body
  FROM files
), docs AS (
  SELECT CASE WHEN parser_status = 'SUCCESS' THEN body ELSE '' END AS content, parser_status,
         CASE WHEN parser_status = 'SUCCESS' THEN '/in/' ELSE 'file:/in/' END
           || name AS doc_uri,
         CASE WHEN parser_status = 'SUCCESS' THEN '2024-01-01 00:00:00' END AS last_modified
  FROM parsed
)
"""


def _chunk_ctes(source: str, columns: str) -> str:
    """``chunks`` from the relation ``source`` with ``content``, by windows of words."""
    step = CHUNK_SIZE - CHUNK_OVERLAP
    carried = "".join(f", {c}" for c in columns.split(", "))
    return f"""
{source}_words AS (
  SELECT list_filter(string_split_regex(content, '\\s+'), lambda w: w <> '') AS words{carried} FROM {source}
), {source}_chunks AS (
  SELECT md5(content_chunked) AS chunk_id, content_chunked{carried} FROM (
    SELECT array_to_string(list_slice(words, s + 1, s + {CHUNK_SIZE}), ' ') AS content_chunked{carried}
    FROM (SELECT *, unnest(range(0, greatest(len(words) - {CHUNK_OVERLAP}, 1), {step})) AS s
          FROM {source}_words WHERE len(words) > 0))
)"""


_CHUNKS = (
    "WITH d AS (SELECT doc_id, text AS content FROM documents), " + _chunk_ctes("d", "doc_id")
)

_SNAPSHOTS = f"""
WITH v1 AS (
  SELECT text AS content, '/docs/' || doc_id AS doc_uri, '2024-01-01 00:00:00' AS last_modified
  FROM documents WHERE lang <> 'es'
), v2 AS (
  SELECT CASE WHEN lang = 'fr' THEN 'revised ' || text ELSE text END AS content,
         '/docs/' || d.doc_id AS doc_uri,
         CASE WHEN lang = 'en' AND quality IS NOT NULL THEN '2024-02-01 00:00:00'
              ELSE '2024-01-01 00:00:00' END AS last_modified
  FROM documents d LEFT JOIN labels USING (doc_id) WHERE lang <> 'de'
), {_chunk_ctes("v1", "doc_uri, last_modified")}, {_chunk_ctes("v2", "doc_uri, last_modified")},
old AS (
  SELECT DISTINCT ON (chunk_id) * FROM v1_chunks ORDER BY chunk_id, doc_uri, last_modified
), new AS (
  SELECT DISTINCT ON (chunk_id) * FROM v2_chunks ORDER BY chunk_id, doc_uri, last_modified
)
"""


def _neighbors_sql(condition: str) -> str:
    return f"""
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
scores AS (
  SELECT a.vec_id, b.vec_id AS near_vec_id, round(list_cosine_similarity(a.v, b.v), 6) AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE {condition}
)
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, near_vec_id)::INT AS rank
  FROM scores
) WHERE rank <= {NEIGHBORS}
"""


def _weights_cte(name: str, source: str, key: str, text: str) -> str:
    """``name(key, slot, weight)``: the nonzero slots of the hashed embedding, as 32-bit floats."""
    return f"""
{name}_slots AS (
  SELECT {key}, (n % {2 * DIMENSIONS}) // 2 AS slot, sum(CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END) AS w
  FROM (
    SELECT {key}, ('0x' || substr(md5(token), 1, 8))::BIGINT AS n
    FROM (SELECT {key}, unnest(string_split_regex(lower({text}), '[^\\p{{L}}\\p{{N}}]+')) AS token
          FROM {source})
    WHERE token <> '')
  GROUP BY ALL
), {name} AS (
  SELECT {key}, slot, (w / sqrt(sum(w * w) OVER (PARTITION BY {key})))::FLOAT::DOUBLE AS weight
  FROM {name}_slots WHERE w <> 0
)"""


def _code_allergies_sql() -> str:
    return f"""
WITH al1 AS ({m.segment_sql("AL1")}),
q AS (SELECT DISTINCT AL1_3 FROM al1),
c AS (
  SELECT DISTINCT md5(content) AS chunk_id, content FROM (
    SELECT 'P' || p_partkey || ' ' || p_brand || ' ' || p_type || ' ' || p_name AS content FROM part)
),
{_weights_cte("qw", "q", "AL1_3", "AL1_3")}, {_weights_cte("cw", "c", "chunk_id", "content")},
qn AS (SELECT AL1_3, sqrt(sum(weight * weight)) AS norm FROM qw GROUP BY 1),
cn AS (SELECT chunk_id, sqrt(sum(weight * weight)) AS norm FROM cw GROUP BY 1),
dots AS (
  SELECT AL1_3, chunk_id, sum(qw.weight * cw.weight) AS dot
  FROM qw JOIN cw USING (slot) GROUP BY 1, 2
),
scores AS (
  SELECT q.AL1_3, c.chunk_id,
         round(coalesce(dot / (qn.norm * cn.norm), 0), 6) AS score
  FROM q CROSS JOIN c LEFT JOIN dots ON dots.AL1_3 = q.AL1_3 AND dots.chunk_id = c.chunk_id
  LEFT JOIN qn ON qn.AL1_3 = q.AL1_3 LEFT JOIN cn ON cn.chunk_id = c.chunk_id
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY AL1_3 ORDER BY score DESC, chunk_id)::INT AS rank
  FROM scores
)
SELECT patient_id, AL1_3, rank, chunk_id, score
FROM (SELECT DISTINCT patient_id, AL1_3 FROM al1) JOIN ranked USING (AL1_3)
WHERE rank <= {CODES_PER_ALLERGY}
"""


def _chunk_neighbors_sql() -> str:
    """Nearest other chunks of each chunk whose first document's id is divisible by 100."""
    return _CHUNKS + f"""
, c AS (SELECT chunk_id, content_chunked AS content, min(doc_id) AS doc_id FROM d_chunks GROUP BY 1, 2),
{_weights_cte("cw", "c", "chunk_id", "content")},
n AS (SELECT chunk_id, sqrt(sum(weight * weight)) AS norm FROM cw GROUP BY 1),
q AS (SELECT chunk_id AS query_id FROM c JOIN n USING (chunk_id) WHERE doc_id % 100 = 0),
dots AS (
  SELECT query_id, b.chunk_id, sum(a.weight * b.weight) AS dot
  FROM q JOIN cw a ON a.chunk_id = query_id JOIN cw b USING (slot) WHERE b.chunk_id <> query_id GROUP BY 1, 2
), scores AS (
  SELECT q.query_id, n.chunk_id, round(coalesce(dot / (n.norm * own.norm), 0), 6) AS score
  FROM q JOIN n ON n.chunk_id <> q.query_id JOIN n own ON own.chunk_id = q.query_id
  LEFT JOIN dots ON dots.query_id = q.query_id AND dots.chunk_id = n.chunk_id
)
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM scores
) WHERE rank <= {NEIGHBORS}
"""


_CHUNK_RECALL_SQL = _CHUNKS + f"""
, c AS (SELECT chunk_id, content_chunked AS content, min(doc_id) AS doc_id FROM d_chunks GROUP BY 1, 2),
{_weights_cte("cw", "c", "chunk_id", "content")}
SELECT count(DISTINCT chunk_id) AS queries, true AS recall_reached, true AS scores_exact, true AS share_below_fifth
FROM cw JOIN c USING (chunk_id) WHERE doc_id % 100 = 0
"""


def all_oracles() -> dict[str, str]:
    gold = {f"gold_{s.lower()}": m.segment_sql(s) for s in SEGMENT_FIELD_NUMBERS}
    step_words = "len(string_split(content_chunked, ' '))"
    return {
        "message_assemble": m.ASSEMBLE_SQL,
        "message_parse_header": m.HEADER_SQL,
        "gold_all": m.gold_all_sql(),
        "gold_all_fields": m.all_fields_sql(),
        "gold_all_counts": m.segment_counts_sql(),
        **gold,
        "gold_obx_from_silver": m.segment_sql("OBX"),
        "message_errors": m.ERRORS_SQL,
        "message_error_report": m.ERROR_REPORT_SQL,
        "repeated_field_last_wins": m.LAST_REPETITION_SQL,
        "patient_allergies": m.patient_sql(PATIENT),
        "customer_allergies": (
            f"SELECT patient_id, message_datetime, AL1_1, AL1_3 FROM ({m.segment_sql('AL1')}) "
            "WHERE patient_id IN (SELECT c_custkey::VARCHAR FROM customer)"
        ),
        "allergies_by_patient": m.ALLERGIES_BY_PATIENT_SQL,
        "distinct_allergies": m.DISTINCT_ALLERGIES_SQL,
        "stream_gold_al1": m.segment_sql("AL1"),
        "stream_multi_hop": m.all_segments_sql(),
        "stream_fanout": m.segment_counts_sql(),
        "stream_message_files": """
            SELECT 'ADT^A04' AS message_type, '20240101' AS message_datetime,
                   s_suppkey::VARCHAR AS patient_id, '1' AS PID_1, s_suppkey::VARCHAR AS PID_3,
                   s_name AS PID_5 FROM supplier""",
        "stream_line_files": """
            SELECT 'MSH|^~\\&|SRC|FAC|DST|DFAC|20240101||ADT^A04|' || s_suppkey || chr(13)
                   || 'PID|1||' || s_suppkey || '||' || s_name || chr(13)
                   || 'PV1|1|N|' || s_nationkey AS value FROM supplier""",
        "stream_assemble_upsert": m.ASSEMBLE_SQL,
        "stream_index_sync": _SNAPSHOTS + "," + _weights_cte("w", "new", "chunk_id", "content_chunked") + """
            SELECT chunk_id, slot, round(weight, 5) AS weight FROM w""",
        "stream_index_compacted": _SNAPSHOTS + "SELECT chunk_id, content_chunked FROM new",
        "stream_assemble_complete": """
            SELECT 'part-00' || s_suppkey AS file_path, true AS complete,
                   'MSH|^~\\&|SRC|FAC|DST|DFAC|20240101||ADT^A04|' || s_suppkey || chr(13)
                   || 'PID|1||' || s_suppkey || '||' || s_name || chr(13)
                   || 'PV1|1|N|' || s_nationkey AS value FROM supplier""",
        "doc_parse_text": _FILES + "SELECT * FROM docs",
        "doc_success_filter": _FILES + """
            SELECT doc_uri, length(content) AS n_chars FROM docs WHERE parser_status = 'SUCCESS'""",
        "doc_dispatch": _FILES + """
            SELECT regexp_extract(doc_uri, '\\.[a-zA-Z]+$') AS extension,
                   parser_status = 'SUCCESS' AS parsed, count(*) AS files
            FROM docs GROUP BY ALL
            UNION ALL SELECT '.html', true, count(*) FROM pages
            UNION ALL SELECT '.json', true, count(*) FROM events""",
        "html_markdown": HTML_SQL,
        "html_round_trip": ROUND_TRIP_SQL,
        "json_tags": """
            SELECT event_id, '<k>' || regexp_extract(props, '[0-9]+') || '</k>' AS tags FROM events""",
        "parse_quality": _FILES + """
            , counts AS (
              SELECT count(*) AS documents,
                     count(*) FILTER (parser_status = 'SUCCESS') AS parsed,
                     count(*) FILTER (parser_status <> 'SUCCESS') AS failed,
                     count(*) FILTER (parser_status = 'SUCCESS' AND content = '') AS empty
              FROM docs)
            SELECT *, round_even(failed / documents, 2) * 100 AS failed_percent,
                   round_even(empty / documents, 2) * 100 AS empty_percent,
                   parsed || ' / ' || documents AS summary FROM counts""",
        "chunk_fixed": _CHUNKS + "SELECT chunk_id, content_chunked, doc_id FROM d_chunks",
        "chunk_recursive_words": """
            SELECT doc_id, count(*) AS n_words, count(DISTINCT word) AS n_distinct FROM (
              SELECT doc_id, unnest(string_split_regex(text, '\\s+')) AS word FROM documents)
            WHERE word <> '' GROUP BY doc_id""",
        "chunk_recursive_order": """
            SELECT doc_id, md5(array_to_string(words, ' ')) AS words_md5 FROM (
              SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS words FROM documents)
            WHERE len(words) > 0""",
        "chunk_recursive_sizes": """
            SELECT count(*) AS documents, 0::BIGINT AS oversize FROM documents WHERE text <> ''""",
        "chunk_oversize": _CHUNKS + f"""
            SELECT chunk_id, doc_id, {step_words} AS tokens FROM d_chunks
            WHERE {step_words} > {WINDOW}""",
        "chunk_window_usage": _CHUNKS + f"""
            SELECT round_even(({step_words} + {CHUNK_OVERLAP}) / 512, 2) * 100 AS usage_percent,
                   count(*) AS chunks
            FROM d_chunks GROUP BY 1""",
        "chunk_key_dedup": _CHUNKS + """
            SELECT chunk_id, content_chunked, min(doc_id) AS doc_id FROM d_chunks GROUP BY 1, 2""",
        "chunk_diff": _SNAPSHOTS + """
            SELECT CASE WHEN old.chunk_id IS NULL THEN 'insert'
                        WHEN new.chunk_id IS NULL THEN 'delete' ELSE 'update' END AS change_type,
                   coalesce(new.chunk_id, old.chunk_id) AS chunk_id, new.doc_uri
            FROM old FULL JOIN new ON old.chunk_id = new.chunk_id
            WHERE old.chunk_id IS NULL OR new.chunk_id IS NULL OR old.doc_uri <> new.doc_uri
               OR old.last_modified <> new.last_modified""",
        "index_upsert": _SNAPSHOTS + """
            SELECT chunk_id, content_chunked, doc_uri, last_modified FROM new""",
        "document_index": _FILES + "," + _chunk_ctes("docs", "parser_status, doc_uri, last_modified") + """
            , texts AS (SELECT DISTINCT chunk_id, content_chunked FROM docs_chunks),
            """ + _weights_cte("w", "texts", "chunk_id", "content_chunked") + """
            SELECT chunk_id, parser_status, doc_uri, last_modified, length(content_chunked) AS n_chars, slot,
                   round(weight, 5) AS weight
            FROM docs_chunks JOIN w USING (chunk_id)""",
        "change_feed_replay": _SNAPSHOTS + """
            SELECT chunk_id, content_chunked, doc_uri, last_modified FROM old WHERE doc_uri LIKE '%7'""",
        "change_feed_counts": _SNAPSHOTS + """
            , changed AS (
              SELECT CASE WHEN old.chunk_id IS NULL THEN 'insert' WHEN new.chunk_id IS NULL THEN 'delete'
                          WHEN old.doc_uri <> new.doc_uri OR old.last_modified <> new.last_modified THEN 'update' END AS kind
              FROM old FULL JOIN new ON old.chunk_id = new.chunk_id)
            SELECT 1 AS version, 'insert' AS change_type, count(*) AS n_rows FROM old
            UNION ALL SELECT 2, kind, count(*) FROM changed WHERE kind IN ('insert', 'delete') GROUP BY kind
            UNION ALL SELECT 2, 'update_' || image, count(*)
            FROM changed, (SELECT unnest(['preimage', 'postimage']) AS image) WHERE kind = 'update' GROUP BY image""",
        "embed_only_new": _SNAPSHOTS + """
            SELECT chunk_id, content_chunked FROM new
            WHERE chunk_id NOT IN (SELECT chunk_id FROM old)""",
        "index_kept": _SNAPSHOTS + """
            SELECT chunk_id, content_chunked FROM old
            WHERE chunk_id IN (SELECT chunk_id FROM new)""",
        "vector_topk": _neighbors_sql("true"),
        "vector_topk_filtered": _neighbors_sql("b.label >= 5"),
        "vector_topk_approx_recall": """
            SELECT count(*) AS queries, true AS recall_reached, true AS scores_exact FROM embeddings""",
        "chunk_neighbors_exact": _chunk_neighbors_sql(),
        "chunk_neighbors_recall": _CHUNK_RECALL_SQL,
        "embed_hash": "WITH " + _weights_cte("w", "documents", "doc_id", "text") + """
            SELECT doc_id, slot, round(weight, 5) AS weight FROM w""",
        "code_allergies": _code_allergies_sql(),
        "conv_last_message": """
            SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, arg_max(text, turn) AS text
            FROM conversations GROUP BY conv_id""",
        "conv_transcript": """
            SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript
            FROM conversations GROUP BY conv_id""",
        "conv_counts": """
            SELECT conv_id, count(*) AS messages FROM conversations GROUP BY conv_id""",
        "response_messages": """
            SELECT conv_id, turn, 0 AS position,
                   CASE WHEN role NOT IN ('user', 'assistant')
                        THEN 'the response holds neither messages nor choices' END AS fault,
                   CASE WHEN role IN ('user', 'assistant') THEN role END AS role,
                   CASE WHEN role IN ('user', 'assistant') THEN text END AS content
            FROM conversations""",
        "update_messages": """
            SELECT conv_id, turn, unnest([0, 1]) AS position, role, text AS content
            FROM conversations""",
    }
