"""Text column functions: strip, line breaks, paths, decoding, ratios."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Every character Python's str.strip removes.
BLANKS = "".join(chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace())


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that it uses several times, without repeating the value's expression.

    Worth it where Catalyst may move the expression, as it does with filters it pushes down: moving
    inlines every column it is made of, once per use, and the copies multiply with each step.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def collapse_blank_lines(text: Column) -> Column:
    return F.regexp_replace(text, "\n{3,}", "\n\n")


def file_extension(path: Column) -> Column:
    """Last suffix of the file name with its dot, case kept; empty for none or for dot files."""
    return F.regexp_extract(path, r"[^./][^/]*?(\.[^./]*)$", 1)


def uri_path(uri: Column) -> Column:
    """Path part of a URI: without scheme, host, query and fragment. Blanks in it are fine."""
    without_scheme = F.regexp_replace(uri, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/?#]*)?", "")
    return F.regexp_replace(without_scheme, r"(?s)[?#].*$", "")


def utf8_text(content: Column) -> Column:
    """Text of a binary value; NULL instead of a failed job when the bytes are not UTF-8."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text)


def percentage(part: Column, whole: Column) -> Column:
    """Share in percent, rounded half-even to whole percents; NULL for an empty whole."""
    return F.bround(part / F.nullif(whole, F.lit(0)), 2) * 100


def labeled_line(label: Column, text: Column) -> Column:
    return F.concat(label, F.lit(": "), text)
