"""File types, fault rows, gates, and the schema helper."""

from datetime import date, datetime
from typing import Dict, List, TypedDict

import pytest
from pyspark.sql import functions as F, types as T

from chartloom import schemas
from chartloom.functions.html import html_to_markdown
from chartloom.functions.json_tags import tagged_lines
from chartloom.functions.text import collapse_blank_lines, file_extension, percentage, strip, uri_path
from chartloom.operators import documents, quality
from chartloom.sources import files as file_sources

TIME = datetime(2024, 1, 1)


def files(spark, *rows):
    data = [(path, TIME, len(content), bytearray(content)) for path, content in rows]
    return spark.createDataFrame(
        data, "path string, modificationTime timestamp, length bigint, content binary"
    )


def parsed(spark, path, content, **options):
    return documents.parse_files(files(spark, (path, content)), **options).first()


@pytest.mark.parametrize(
    "name, content, expected",
    [
        ("a.txt", b"\n  hello \xc2\xa0\t", "hello"),
        ("a.md", "# Ü\n".encode(), "# Ü"),
        ("a.json", b'{"a": {"b": 1}, "c": [1, {"d": null}]}', "<b>1</b>\n<c_0>1</c_0>\n<d>None</d>"),
        ("a.jsonl", b'{"k": true}', "<k>True</k>"),
        ("a.html", b"<h1>T</h1><p>x <b>y</b></p>", "# T\n\nx **y**"),
    ],
)
def test_file_types(spark, name, content, expected):
    row = parsed(spark, f"file:/v/some dir/{name}", content)
    assert row["content"] == expected
    assert row["parser_status"] == "SUCCESS"
    assert row["doc_uri"] == f"/v/some dir/{name}"
    assert row["last_modified"] == TIME


@pytest.mark.parametrize(
    "name, content",
    [("a.PDF", b"x"), ("a", b"x"), ("a.txt", b"\xff\xfe"), ("a.jsonl", b"{}\n{}"), ("a.json", b"{")],
)
def test_faults_become_rows(spark, name, content):
    row = parsed(spark, f"file:/v/{name}", content)
    assert row["content"] == ""
    assert row["parser_status"].startswith(documents.FAULT_PREFIX)
    assert row["doc_uri"] == f"file:/v/{name}"
    assert row["last_modified"] is None


def test_hooks_handle_more_types_and_their_errors(spark):
    def hook(content):
        if content == b"bad":
            raise RuntimeError("no pages")
        return f" pdf {len(content)} "

    good = parsed(spark, "/v/a.pdf", b"1234", hooks={".pdf": hook})
    assert (good["content"], good["parser_status"]) == ("pdf 4", "SUCCESS")
    bad = parsed(spark, "/v/a.pdf", b"bad", hooks={".pdf": hook})
    assert bad["content"] == "" and "RuntimeError: no pages" in bad["parser_status"]


def test_apply_parser_guards_the_parser(spark):
    def parser(row):
        doc_path = row["path"]
        if doc_path.endswith("x"):
            raise ValueError("boom")
        if doc_path.endswith("y"):
            return {"content": "c", "parser_status": "half done"}
        return {"content": "ok", "parser_status": "SUCCESS", "doc_uri": doc_path}

    rows = {
        r["doc_uri"]: r
        for r in documents.apply_parser(files(spark, ("a", b"1"), ("x", b"1"), ("y", b"1")), parser).collect()
    }
    assert rows["a"]["content"] == "ok" and rows["a"]["last_modified"] is None
    assert rows["x"]["parser_status"] == "An error occurred: ValueError: boom"
    assert rows["y"]["parser_status"] == "An error occurred: half done"


@pytest.mark.parametrize(
    "text, expected",
    [
        ('{"a": [], "b": 1}', "<b>1</b>"), ("{}", ""), ("5", "<>5</>"), ("null", "<>None</>"),
        ('{"a": {"b": {}}, "c": 2}', "<c>2</c>"), ('{"z": 1, "a": {}, "m": 2}', "<z>1</z>\n\n<m>2</m>"),
        ('[[1, 2], {"k": "v"}, false]', "<_0_0>1</_0_0>\n<_0_1>2</_0_1>\n<k>v</k>\n<_2>False</_2>"),
        ("not json", None), ('{"a": 1}\n{"a": 2}', None),
    ],
)
def test_json_tags(text, expected):
    assert tagged_lines(text) == expected


@pytest.mark.parametrize(
    "html, expected",
    [
        ("<p>a</p><p>b</p>", "a\n\nb"),
        ("<h2>A <i>b</i></h2>text", "## A *b*\n\ntext"),
        ('<p><a class="x" href="/u_1?a=b">the\n link</a></p>', "[the link](/u_1?a=b)"),
        ("<ul><li>a</li><li>b</li></ul>", "* a\n* b"),
        ("<ol><li>a</li><li>b</li></ol><ul><li>c</li></ul>", "1. a\n2. b\n\n* c"),
        ("a<br>b<br/>c", "a  \nb  \nc"),
        ("x<!-- <p>no</p> --><script>if (a<b) {}</script><style>p{}</style>y", "xy"),
        ("<pre>a_b\n  c *d</pre>", "```\na_b\n  c *d\n```"),
        ("<p>snake_case 2*3</p>", "snake\\_case 2\\*3"),
        ("&lt;b&gt; &amp;amp; &#233;&#x41;&copy; &#99999999;", "<b> &amp; éA© &#99999999;"),
        ("<p><strong>s</strong> <em>e</em> <code>c</code></p>", "**s** *e* `c`"),
        ("plain  \n text", "plain text"),
        ("a < b", "a < b"),
        ("<p>if a < b then c</p>", "if a < b then c"),
        ("<p>3 < 4</p>", "3 < 4"),
        ("x <y and more <b>z</b>", "x <y and more **z**"),
        ("<table><tr><td>1</td><td>2</td></tr></table>", "| 1 | 2"),
        ('a <img src="p.png" alt="a picture"> b', "a a picture b"),
        ("<blockquote>said</blockquote><q>so</q>", '> said\n\n"so"'),
        ("&eacute;&NotEqual;&nosuch; &amp;lt;", "é≠&nosuch; &lt;"),
        ("<PRE>a\n b</PRE><OL><LI>x</LI><Li>y</Li></OL>", "```\na\n b\n```\n\n1. x\n2. y"),
        ("", ""),
    ],
)
def test_html_to_markdown(spark, html, expected):
    df = spark.createDataFrame([(html,)], "html string")
    assert df.select(html_to_markdown(F.col("html"))).first()[0] == expected


@pytest.mark.parametrize(
    "path, extension, stripped",
    [
        ("file:/a b/c.tar.gz", ".gz", "/a b/c.tar.gz"), ("/a/.bashrc", "", "/a/.bashrc"),
        ("file:///x/y.PDF", ".PDF", "/x/y.PDF"), ("s3://bucket/k/f.md", ".md", "/k/f.md"),
        ("/a.b/noext", "", "/a.b/noext"), ("file:/q.txt?x=1#f", ".txt?x=1#f", "/q.txt"),
    ],
)
def test_paths(spark, path, extension, stripped):
    df = spark.createDataFrame([(path,)], "path string")
    row = df.select(file_extension(F.col("path")), uri_path(F.col("path"))).first()
    assert tuple(row) == (extension, stripped)


def test_strip_equals_python(spark):
    texts = ["  a b ", " x ", "\x1c\x85y　", "", " \n", "z"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(strip(F.col("t"))).collect()] == [t.strip() for t in texts]


def test_blank_lines_and_percentages(spark):
    df = spark.createDataFrame([("a\n\n\n\nb\n\nc", 1, 8)], "t string, part int, whole int")
    row = df.select(
        collapse_blank_lines(F.col("t")), percentage(F.col("part"), F.col("whole")),
        percentage(F.col("part"), F.lit(0)),
    ).first()
    assert row[0] == "a\n\nb\n\nc"
    assert row[1] == round(1 / 8, 2) * 100
    assert row[2] is None


def test_quality_summary_and_gate(spark):
    docs = documents.parse_files(
        files(spark, ("a.txt", b"x"), ("b.txt", b"  "), ("c.bin", b"x"), ("d.txt", b"y"))
    )
    row = quality.quality_summary(docs).first()
    assert (row["documents"], row["parsed"], row["failed"], row["empty"]) == (4, 3, 1, 1)
    assert (row["failed_percent"], row["empty_percent"], row["summary"]) == (25.0, 25.0, "3 / 4")
    assert documents.parse_failures(docs).count() == documents.empty_successes(docs).count() == 1
    with pytest.raises(quality.QualityError, match="1 of 4 documents failed"):
        quality.quality_gate(docs)
    with pytest.raises(quality.QualityError, match="1 of 4 documents empty"):
        quality.quality_gate(docs, max_failed_percent=30)
    assert quality.quality_gate(docs, 30, 30) is docs


def test_binary_files_and_listing(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "part-001").write_text("one")
    (tmp_path / "sub" / "part-002").write_text("two!")
    (tmp_path / "NOTICE.txt").write_text("skip")
    path = str(tmp_path)
    assert file_sources.binary_files(spark, path).count() == 3
    names = file_sources.file_listing(spark, path, leave_out="NOTICE").orderBy("file_name").collect()
    assert [(r["file_name"], r["length"]) for r in names] == [("part-001", 3), ("part-002", 4)]
    assert file_sources.file_listing(spark, path, "part-00*").count() == 2
    with pytest.raises(FileNotFoundError):
        file_sources.binary_files(spark, path, "*.none", require_any=True)
    messages = file_sources.message_files(spark, path, name_glob="part-00*").collect()
    assert sorted(r["value"] for r in messages) == ["one", "two!"]


class Extra(TypedDict):
    n: int
    x: float
    ok: bool
    tags: List[List[str]]
    plain: list
    day: date


def test_schema_from_annotations():
    schema = schemas.schema_from_annotations(schemas.ParsedDocument, Extra)
    assert schema.simpleString() == (
        "struct<content:string,parser_status:string,doc_uri:string,last_modified:timestamp,n:int,"
        "x:double,ok:boolean,tags:array<array<string>>,plain:array<string>,day:date>"
    )
    assert all(field.nullable for field in schema)


@pytest.mark.parametrize("annotation", [Dict[str, int], dict[str, int], set, bytes])
def test_schema_refuses_other_annotations(annotation):
    with pytest.raises(ValueError):
        schemas.spark_type_of(annotation)
    assert isinstance(schemas.spark_type_of(int), T.IntegerType)
