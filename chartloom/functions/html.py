"""HTML to markdown with ``#`` headings, as one chain of column expressions.

The text is cut at ``<`` into pieces ``tag>text``; every tag turns into its markdown sign and every
text piece gets its white space collapsed and its markdown signs escaped. Attributes that a closing
tag needs (the link target) and running numbers are moved into the tags first.
"""

from __future__ import annotations

from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column, functions as F

from chartloom.functions.text import bind

# Named character references with their semicolon, from the standard library's table.
REFERENCES = {name: text for name, text in html5.items() if name.endswith(";")}

# Markdown sign of each tag; paragraphs and other blocks take a blank line.
BLOCK = "\n\n"
BLOCK_TAGS = [
    "p", "div", "article", "section", "main", "header", "footer", "nav", "ul", "ol", "table",
    "body", "head", "title", "tr", "aside",
]
OPENING = {
    **{tag: BLOCK for tag in BLOCK_TAGS},
    **{f"h{n}": BLOCK + "#" * n + " " for n in range(1, 7)},
    "br": "  \n", "hr": BLOCK + "---" + BLOCK, "b": "**", "strong": "**", "i": "*", "em": "*",
    "a": "[", "li": "\n* ", "code": "`", "pre": BLOCK + "```\n",
    "td": "| ", "th": "| ", "q": '"', "blockquote": BLOCK + "> ",
}
CLOSING = {
    **{tag: BLOCK for tag in BLOCK_TAGS},
    **{f"h{n}": BLOCK for n in range(1, 7)},
    "b": "**", "strong": "**", "i": "*", "em": "*", "code": "`", "pre": "\n```" + BLOCK,
    "td": " ", "th": " ", "q": '"', "blockquote": BLOCK,
}

# Private characters that keep preformatted text out of the white space rules.
KEPT_NEWLINE, KEPT_BLANK, KEPT_STAR, KEPT_LINE = "\ue000", "\ue001", "\ue002", "\ue003"
PLAIN_LESS = "\ue004"  # a ``<`` that opens no tag
KEPT = KEPT_NEWLINE + KEPT_BLANK + KEPT_STAR + KEPT_LINE

REMOVED = [
    r"(?s)<!--.*?-->",
    r"(?is)<script\b.*?</script\s*>",
    r"(?is)<style\b.*?</style\s*>",
]
LINK = r'(?is)<a\s[^>]*?href\s*=\s*["\']([^"\'>]*)["\'][^>]*>(.*?)</a\s*>'


# Tags whose bodies are looked for by name, in any case.
CASED = ("pre", "ol", "li")
ODD_CASE = r"</?(?!(?:pre|ol|li)\b)(?i:pre|ol|li)\b"
IMAGE = r'(?is)<img\s[^>]*?\balt\s*=\s*(?:"([^">]*)"|\'([^\'>]*)\')[^>]*>'


def _where_present(text: Column, mark: str, change: Callable[[Column], Column]) -> Column:
    return bind(text, lambda t: F.when(F.instr(t, mark) > 0, change(t)).otherwise(t))


def _inside(text: Column, opening: str, closing: str, change: Callable[[Column], Column]) -> Column:
    """Apply ``change`` to what follows each ``opening``, up to its ``closing``."""

    def piece(part: Column, index: Column) -> Column:
        body = F.substring_index(part, closing, 1)
        rest = F.substr(part, F.length(body) + 1)
        return F.when(index == 0, part).otherwise(F.concat(F.lit(opening), change(body), rest))

    return F.array_join(F.transform(F.split(text, opening), piece), "")


def _number_items(body: Column) -> Column:
    def item(part: Column, index: Column) -> Column:
        return F.when(index == 0, part).otherwise(
            F.concat(F.lit("<li#"), index.cast("string"), part)
        )

    return F.array_join(F.transform(F.split(body, "<li\\b"), item), "")


def _looked_up(signs: dict[str, str], name: Column) -> Column:
    pairs = [F.lit(x) for pair in signs.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[name], F.lit(""))


def _tag_sign(tag: Column, name: Column) -> Column:
    link = F.concat(F.lit("]("), F.regexp_extract(tag, r'(?s)^/a "(.*)"$', 1), F.lit(")"))
    item = F.concat(F.lit("\n"), F.substring(name, 4, 9), F.lit(". "))
    return (
        F.when(
            tag.startswith("/"), F.when(name == "a", link).otherwise(_looked_up(CLOSING, name))
        )
        .when(name.startswith("li#"), item)
        .otherwise(_looked_up(OPENING, name))
    )


def _markdown_piece(piece: Column, index: Column) -> Column:
    closed = F.instr(piece, ">") > 0
    tag = F.substring_index(piece, ">", 1)
    # A tag that never closes is text like any other; nothing is lost.
    text = F.when(index == 0, piece).when(
        closed, F.substr(piece, F.length(tag) + 2)
    ).otherwise(F.concat(F.lit(PLAIN_LESS), piece))
    name = F.lower(F.regexp_extract(tag, r"^/?([A-Za-z][A-Za-z0-9]*(#[0-9]+)?)", 1))
    shown = F.regexp_replace(F.regexp_replace(text, r"[ \t\r\n]+", " "), r"([*_])", r"\\$1")
    return F.when((index == 0) | ~closed, shown).otherwise(F.concat(_tag_sign(tag, name), shown))


def _references(text: Column) -> Column:
    """Each numeric and named reference once, in one pass."""
    # Two literals, which Catalyst folds into one map, instead of thousands.
    listed = lambda values: F.split(F.lit(KEPT_NEWLINE.join(values)), KEPT_NEWLINE)
    named = F.map_from_arrays(listed(REFERENCES.keys()), listed(REFERENCES.values()))

    def piece(part: Column, index: Column) -> Column:
        digits = F.regexp_extract(part, r"^#([0-9]{1,7});", 1)
        hexed = F.regexp_extract(part, r"^#[xX]([0-9A-Fa-f]{1,6});", 1)
        code = F.when(digits != "", digits.cast("int")).when(
            hexed != "", F.conv(hexed, 16, 10).cast("int")
        )
        fits = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.when(fits, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        name = F.regexp_extract(part, r"^[A-Za-z][A-Za-z0-9]*;", 0)
        found = F.when(part.startswith("amp;"), F.lit("&")).when(part.startswith("#"), char).when(name != "", named[name])
        rest = F.substr(part, F.instr(part, ";") + 1)
        return F.when(index == 0, part).otherwise(
            bind(found, lambda x: F.when(x.isNull(), F.concat(F.lit("&"), part)).otherwise(F.concat(x, rest)))
        )

    return _where_present(
        text, "&", lambda t: F.array_join(F.transform(F.split(t, "&"), piece), "")
    )


def _lower_cased(text: Column) -> Column:
    for tag in CASED:
        text = F.regexp_replace(text, rf"(?i)<(/?){tag}\b", f"<$1{tag}")
    return text


def html_to_markdown(html: Column) -> Column:
    text = html
    for pattern in REMOVED:
        text = F.regexp_replace(text, pattern, "")
    text = F.regexp_replace(text, r"<(?![A-Za-z/!?])", PLAIN_LESS)
    text = bind(text, lambda t: F.when(t.rlike(ODD_CASE), _lower_cased(t)).otherwise(t))
    text = _where_present(text, "<", lambda t: F.regexp_replace(t, IMAGE, "$1$2"))
    text = _where_present(
        text, "<pre",
        lambda t: _inside(t, "<pre", "</pre", lambda body: F.translate(body, "\n *_", KEPT)),
    )
    text = _where_present(text, "<ol", lambda t: _inside(t, "<ol", "</ol", _number_items))
    text = F.regexp_replace(text, LINK, '<a>$2</a "$1">')
    text = F.array_join(F.transform(F.split(text, "<"), _markdown_piece), "")
    text = F.replace(_references(text), F.lit(PLAIN_LESS), F.lit("<"))
    text = F.regexp_replace(text, r"\n +", "\n")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    text = F.regexp_replace(text, r"^[ \n]+|[ \n]+$", "")
    for kept, char in zip(KEPT, "\n *_"):
        text = F.replace(text, F.lit(kept), F.lit(char))
    return text
