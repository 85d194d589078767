import math
import re

import pytest
from pyspark.sql import functions as F

from chartloom.llm.html_text import extract_main_text, page_text, style_tree
from chartloom.llm.queries import URL_RULES
from chartloom.llm.url_filter import FEATURES, judge_urls, lexical_features
from chartloom.session import read_table


@pytest.fixture(scope="module")
def make_pages(spark):
    def make(rows):
        return spark.createDataFrame(
            [(*r, "x", "x", 1) for r in rows], "page_id long, url string, html string, key string, text string, suffix int"
        )

    return make


def test_text_of_a_page():
    html = (
        "<html><head><title>t</title></head><body class='has-sidebar'><nav><li>menu</nav><header>top</header>"
        "<div class='ad'><p>buy</div><div id=cookie-notice>ok?</div><article><h1>T&eacute; &lt;b&gt;</h1><ul><li>a<li>b</ul>"
        "<p>x <b>y</b>z\n\t q<script>var a='</p>'</script><!-- k --><p>3 < 4 & 5&nbsp;> 2<div class='comments'><p>nice</div></article>"
        "<aside>side</aside><form>name</form><FOOTER>f</FOOTER>"
    )
    assert page_text(html, set()) == "Té <b>\na\nb\nx yz q\n3 < 4 & 5 > 2"
    assert page_text("", set()) == page_text("<", set())[:0]
    assert page_text("plain text", set()) == "plain text"
    assert page_text("<table><tr><td>1<td>2</table><p class=x", set()) == "1\n2"


def test_style_tree_removes_what_pages_share(make_pages):
    body = "<body><div class=x1><p>{}</div><div class=x2><p>word{} and word{}</div></body>"
    rows = [(i, f"http://a.example/{i}", body.format("same on all pages", i, i * i + 7)) for i in range(8)]
    rows += [(20, "http://b.example/1", body.format("same on all pages", 1, 2)), (21, None, None), (None, "x", ""), (20, "http://b.example/1", "<p>z")]
    got = extract_main_text(make_pages(rows))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    texts = sorted((r.page_id if r.page_id is not None else -1, r.text) for r in got.collect())
    expected = [(i, f"word{i} and word{i * i + 7}") for i in range(8)]
    expected += [(20, "same on all pages\nword1 and word2"), (20, "z"), (21, ""), (-1, "")]
    assert texts == sorted(expected)
    importance = [r.importance for r in style_tree(make_pages(rows).select("url", "html").where("html is not null")).collect()]
    assert min(importance) < 0.3 < max(importance)


def test_copies_of_a_page_are_no_template(make_pages):
    body = "<body><div class=x1><p>{}</div><div class=x2><p>word{}<p>more {}</div></body>"
    same = body.format("head", "same", "text")
    rows = [(i, f"http://a.example/{i}", same + f"<script>{i}</script>") for i in range(6)]
    rows += [(100 + i, f"http://b.example/{i}", same if i < 80 else body.format("head", i, i)) for i in range(100)]
    rows += [(300 + i, None, same) for i in range(6)] + [(310 + i, "x", body.format("head", i, i)) for i in range(6)]
    texts = {r.page_id: r.text for r in extract_main_text(make_pages(rows)).collect()}
    assert all(texts[i] == "head\nwordsame\nmore text" for i in (*range(6), *range(300, 306)))
    assert all(texts[100 + i] == ("wordsame\nmore text" if i < 80 else f"word{i}\nmore {i}") for i in range(100))
    assert all(texts[310 + i] == f"head\nword{i}\nmore {i}" for i in range(6))


def test_articles_of_the_pages_table(spark, sf_dir):
    from html import unescape

    pages = read_table(spark, sf_dir, "pages")
    got = {r.page_id: r for r in extract_main_text(pages).collect()}
    for page in pages.collect():
        article = re.search(r"<article>(.*)</article>", page.html, re.S).group(1)
        blocks = (" ".join(unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert got[page.page_id].text == "\n".join(b for b in blocks if b)
        assert got[page.page_id].n_chars == len(got[page.page_id].text)


def by_hand(url):
    rest = (url or "").partition("://")[2]
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    fitting = [r for r in URL_RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fitting, key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best and best[0] + best[1], best and best[2]


def test_rules_and_verdicts(spark, sf_dir, make_pages):
    urls = [r.url for r in read_table(spark, sf_dir, "pages").collect()] + [
        None, "", "no scheme", "://", "http://", "http://EXAMPLE.org/en/17?x=/es/", "http://example.org", "http://notexample.org/es/",
        "ftp://a.example.ORG/es/x#y", "http://com/fr/", "http://x.com?/de/", "http://ÄB.com/de/a%20b", "a://b://c/de/", "http://example.org/en/17?x=/es/",
    ]
    got = judge_urls(make_pages([(i if i % 9 else None, u, "h") for i, u in enumerate(urls)]), URL_RULES).collect()
    assert len(got) == len(urls)
    expected = sorted(map(str, (by_hand(u)[:3] for u in urls)))
    assert sorted(str((r.host, r.path, r.rule)) for r in got) == expected
    verdicts = {by_hand(u)[2]: by_hand(u)[3] for u in urls}
    assert all(r.verdict == verdicts[r.rule] for r in got if r.rule)
    assert {r.verdict for r in got} <= {"allow", "block"}


def test_trees_learn_the_labelled_urls(spark, sf_dir):
    got = judge_urls(read_table(spark, "/root/testdata/sf0.01", "pages"), URL_RULES).where("rule is not null")
    right = got.where((F.col("block_score") >= 0.5) == (F.col("verdict") == "block")).count()
    assert right / got.count() > 0.8


def test_one_verdict_or_none(spark, make_pages):
    assert judge_urls(make_pages([]), URL_RULES).count() == 0
    got = judge_urls(make_pages([(1, "http://a.de/x", "h"), (2, "http://b.net/y", None)]), URL_RULES).collect()
    assert [(r.rule, r.verdict) for r in got] == [(None, "allow")] * 2
    got = judge_urls(make_pages([(1, "http://a.com/de/x", "h"), (2, "http://b.net/y", "h")]), URL_RULES).collect()
    assert {r.page_id: r.verdict for r in got} == {1: "block", 2: "block"}


def test_features(spark):
    url = "https://a-b1.example.co.uk/x/y2/z%20?a=1&b=2#f"
    frame = spark.createDataFrame([(url, "a-b1.example.co.uk", "/x/y2/z%20")], "url string, host string, path string")
    row = lexical_features(frame).first()
    assert (row.depth, row.host_labels, row.n_parameters, row.n_escapes, row.has_fragment, row.is_https) == (3, 4, 2, 1, 1, 1)
    text = row.host + row.path
    assert row.entropy == pytest.approx(-sum(text.count(c) / len(text) * math.log2(text.count(c) / len(text)) for c in set(text)))
    assert set(FEATURES) - set(row.asDict()) == {"suffix_share", "suffix_allowed"}


def test_names_inside_an_article_are_taken_whole():
    from chartloom.llm.html_text import page_text

    page = (
        "<article><section class='related-work'><p>Prior studies.</p></section><div class='search-results'><p>Result text</p></div>"
        "<p class='share-price'>Shares rose.</p><div class='share-buttons'>Share</div><div id='comments'>Nice</div></article>"
        "<div class='search-results'>Outside</div>"
    )
    assert page_text(page, set()) == "Prior studies.\nResult text\nShares rose."
