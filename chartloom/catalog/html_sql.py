"""Expected markdown of the pages, from the tags and references that the pages table is made of.

Nothing here comes from the code under test: the tags, their markdown and the references are written
out again for the pages at hand.
"""

from __future__ import annotations

BLANK_LINE = "\n\n"
BLOCKS = ("head", "title", "body", "nav", "ul", "div", "article", "p", "footer")
OPENING = {**{tag: BLANK_LINE for tag in BLOCKS}, "h1": BLANK_LINE + "# ", "br": "  \n", "b": "**", "a": "[", "li": "\n* "}
CLOSING = {**{tag: BLANK_LINE for tag in BLOCKS}, "h1": BLANK_LINE, "b": "**"}
REFERENCES = [("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]
REMOVED = ["(?s)<!--.*?-->", "(?s)<script>.*?</script>", "(?s)<style>.*?</style>"]
LINK = '<a href="([^"]*)">([^<]*)</a>'


def _literal(text: str) -> str:
    parts = [f"'{p}'" for p in text.replace("'", "''").split("\n")]
    return " || chr(10) || ".join(parts)


def _case(tags: dict[str, str]) -> str:
    branches = " ".join(f"WHEN '{t}' THEN {_literal(sign)}" for t, sign in tags.items())
    return f"CASE name {branches} ELSE '' END"


def _html_sql() -> str:
    text = "html"
    for pattern in REMOVED:
        text = f"regexp_replace({text}, '{pattern}', '', 'g')"
    link = LINK.replace("'", "''")
    text = f"""regexp_replace({text}, '{link}', '<a>\\2</a "\\1">', 'g')"""
    final = "joined"
    for reference, char in REFERENCES:
        final = f"replace({final}, '{reference}', {_literal(char.replace(chr(39), chr(39)))})"
    final = f"regexp_replace({final}, '\\n +', chr(10), 'g')"
    final = f"regexp_replace({final}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    final = f"regexp_replace({final}, '^[ \\n]+|[ \\n]+$', '', 'g')"
    return f"""
WITH cut AS (
  SELECT page_id, string_split({text}, '<') AS pieces FROM pages
), numbered AS (
  SELECT page_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS place FROM cut
), tagged AS (
  SELECT page_id, place,
         CASE WHEN place = 1 THEN '' ELSE string_split(piece, '>')[1] END AS tag,
         CASE WHEN place = 1 THEN piece
              WHEN position('>' IN piece) > 0 THEN substr(piece, position('>' IN piece) + 1)
              ELSE '' END AS text
  FROM numbered
), named AS (
  SELECT *, starts_with(tag, '/') AS closing,
         lower(regexp_extract(tag, '^/?([A-Za-z][A-Za-z0-9]*)', 1)) AS name FROM tagged
), signed AS (
  SELECT page_id, place,
         CASE WHEN closing AND name = 'a' THEN '](' || regexp_extract(tag, '(?s)^/a "(.*)"$', 1) || ')'
              WHEN closing THEN {_case(CLOSING)}
              ELSE {_case(OPENING)} END AS sign,
         regexp_replace(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g'), '([*_])', '\\\\\\1', 'g') AS shown
  FROM named
), whole AS (
  SELECT page_id, string_agg(sign || shown, '' ORDER BY place) AS joined FROM signed GROUP BY page_id
)
SELECT page_id, {final} AS markdown FROM whole
"""


HTML_SQL = _html_sql()

#: Every word of a text that was wrapped into a page, with a lone ``<`` between them.
ROUND_TRIP_SQL = """
SELECT doc_id, len(words) AS n_words, md5(array_to_string(words, ' ')) AS words_md5 FROM (
  SELECT doc_id, list_filter(string_split_regex(replace(text, ' ', ' < '), '[ \\t\\r\\n]+'), lambda w: w <> '') AS words
  FROM documents)
"""
