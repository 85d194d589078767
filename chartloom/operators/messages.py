"""Message operators: text to parsed struct, to segments, to one typed table per segment kind.

Everything is a column expression. Each step is its own projection, so Catalyst keeps its result as
one computed column instead of repeating the work in every expression that reads it.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from chartloom.functions.text import bind
from chartloom.schemas import HEADER_COLUMNS, MESSAGE_KEYS, SEGMENT_FIELD_NUMBERS

HEADER = "MSH"
ERROR = "ERROR"

# Texts of the pseudo segment that stands for an unreadable message.
NO_TEXT = "message text is missing"
TOO_SHORT = "message text is too short"
NO_HEADER = "message does not start with a header segment"

SHORTEST_MESSAGE = 8
BLANKS = " \t\r\n"
DEFAULT_REPETITION = "~"

_FAULT, _SEP, _REP, _GOOD = "__fault", "__sep", "__rep", "__good"

# Fields of a line up to which their names are held ready, by steps.
USUAL_FIELDS = (8, 16, 64)

# What every segment name outside the known ones is stored under.
OTHER_KIND = "other"


def _split_fields(line: Column, separator: Column) -> Column:
    """Fields of one line. The usual bar takes the single-character split, without a regex."""
    quoted = F.concat(F.lit("\\Q"), separator, F.lit("\\E"))
    return F.when(separator == "|", F.split(line, "\\|")).otherwise(F.split(line, quoted))


def _last_line(marks: Column, segment: str) -> Column:
    """Fields behind the name in the last line of that segment kind; NULL without one."""
    start = F.concat(F.lit("\r" + segment), marks[_SEP])
    rest = F.call_function("substring_index", marks[_GOOD], start, F.lit(-1))
    line = F.substring_index(rest, "\r", 1)
    return F.when(F.contains(marks[_GOOD], start), _split_fields(line, marks[_SEP]))


def _fault(whole: Column) -> Column:
    """What is wrong with a text that has a carriage return before its first line; NULL if nothing is."""
    return (
        F.when(whole.isNull(), NO_TEXT)
        .when(F.length(whole) <= SHORTEST_MESSAGE, TOO_SHORT)
        .when(~whole.startswith("\r" + HEADER), NO_HEADER)
    )


def _message_head(text: Column) -> Column:
    """Struct of fault, separators, readable text and header values of a message text.

    The readable text has a carriage return before every line. Only the last header and patient
    lines are split, as they hold the header values.
    """
    # replace, not translate: that one looks up every single character.
    body = F.replace(F.ltrim(text, F.lit(BLANKS)), F.lit("\n"), F.lit("\r"))
    normal = F.concat(F.lit("\r"), body)

    def from_text(whole: Column) -> Column:
        separator, repetition = F.substring(whole, 5, 1), F.substring(whole, 7, 1)
        fault = _fault(whole)
        usual = (repetition == separator) | repetition.isin("", "\r")
        marks = F.struct(
            fault.alias(_FAULT),
            separator.alias(_SEP),
            F.when(usual, DEFAULT_REPETITION).otherwise(repetition).alias(_REP),
            F.when(fault.isNull(), whole).alias(_GOOD),
        )
        return bind(marks, from_marks)

    def from_marks(marks: Column) -> Column:
        lines = F.struct(
            _last_line(marks, HEADER).alias("header"), _last_line(marks, "PID").alias("patient")
        )
        return bind(lines, lambda found: from_lines(marks, found))

    def from_lines(marks: Column, found: Column) -> Column:
        def value(line: str, place: int) -> Column:
            field = F.get(found[line], F.lit(place))
            first = F.call_function("substring_index", field, marks[_REP], F.lit(1))
            return F.when(first != "", first)

        # The header line carries its separator as field 1, so its fields sit one place earlier.
        kind = F.when(marks[_FAULT].isNotNull(), ERROR).otherwise(value("header", 7))
        return F.struct(
            *[marks[name].alias(name) for name in (_FAULT, _SEP, _REP, _GOOD)],
            kind.alias("message_type"),
            value("header", 5).alias("message_datetime"),
            value("patient", 2).alias("patient_id"),
            value("patient", 4).alias("patient_name"),
        )

    return bind(normal, from_text)


def with_head(messages: DataFrame, text: str = "value") -> DataFrame:
    """Add the header columns and the helper columns of ``_message_head``."""
    head = messages.withColumn("__head", _message_head(F.col(text)))
    names = [_FAULT, _SEP, _REP, _GOOD, *HEADER_COLUMNS]
    return head.select(*messages.columns, *[F.col("__head")[n].alias(n) for n in names])


def _last_repetition(field: Column) -> Column:
    return F.call_function("substring_index", field, F.col(_REP), F.lit(-1))


def _fields_of(line: Column) -> Column:
    """Name and fields of a line, field n at place n: of each field its last repetition. The header's first field
    is the separator, its second one stays as it is."""

    def named(parts: Column) -> Column:
        return F.transform(parts, lambda field, i: F.when(i == 0, field).otherwise(_last_repetition(field)))

    def header(parts: Column) -> Column:
        rest = F.slice(parts, F.lit(2), F.size(parts))
        numbered = F.transform(
            F.concat(F.array(parts[0], F.col(_SEP)), rest),
            lambda field, i: F.when((i == 0) | (i == 2), field).otherwise(_last_repetition(field)),
        )
        return F.when(parts[0] == HEADER, numbered).otherwise(named(parts))

    parts = _split_fields(line, F.col(_SEP))
    return (
        F.when(line.startswith(HEADER), bind(parts, header))
        .when(F.contains(line, F.col(_REP)), named(parts))
        .otherwise(parts)
    )


def _held_names(size: int) -> Column:
    """Constant map from each known segment kind to the names of its first fields."""
    names = [(F.lit(kind), F.split(F.lit(",".join(f"{kind}_{n}" for n in range(1, size + 1))), ",")) for kind in SEGMENT_FIELD_NUMBERS]
    return F.create_map(*[column for pair in names for column in pair])


def _field_map(parts: Column) -> Column:
    """Map from ``SEG_n`` to the text of field n; empty fields are left out.

    Known kinds up to the usual length take the names from a constant, as making a name and an entry for every
    field costs several times the rest of the parse.
    """
    name, n = parts[0], F.size(parts) - 1
    held = None
    for size in USUAL_FIELDS:
        found = _held_names(size)[name]
        held = F.when(n <= size, found) if held is None else held.when(n <= size, found)
    fields = F.slice(parts, F.lit(2), n)
    usual = F.map_from_arrays(F.filter(held, lambda _, i: F.get(parts, i + 1) != ""), F.array_remove(fields, ""))

    def entry(field: Column, index: Column) -> Column:
        key = F.concat(name, F.lit("_"), (index + 1).cast("string"))
        return F.struct(key.alias("key"), field.alias("value"))

    return F.coalesce(usual, F.map_from_entries(F.filter(F.transform(fields, entry), lambda e: e["value"] != "")))


def _lines_of(segments: Iterable[str] | None) -> Column:
    """Lines of the named segment kinds, or all lines that are not blank."""
    lines = F.split(_GOOD, "\r")
    if segments is None:
        return F.filter(lines, lambda line: F.trim(line) != "")
    names = list(segments)

    def wanted(line: Column) -> Column:
        match = line.isin(names)
        for name in names:
            match = match | line.startswith(F.concat(F.lit(name), F.col(_SEP)))
        return match

    return F.filter(lines, wanted)


def _segment_array(only: Iterable[str] | None) -> Column:
    split = F.transform(_lines_of(only), _fields_of)
    parsed = F.transform(
        split,
        lambda parts: F.struct(parts[0].alias("segment_id"), _field_map(parts).alias("fields")),
    )
    fault = F.array(
        F.struct(
            F.lit(ERROR).alias("segment_id"),
            F.create_map(F.lit("error"), F.col(_FAULT)).alias("fields"),
        )
    )
    return F.when(F.col(_FAULT).isNotNull(), fault).otherwise(parsed)


def parse_messages(
    messages: DataFrame, text: str = "value", only: Iterable[str] | None = None
) -> DataFrame:
    """Add the struct ``parsed``. ``only`` keeps the named segment kinds and skips the others
    before their field maps are built; unreadable messages stay as ERROR rows either way."""
    return with_head(messages, text).select(
        *messages.columns,
        F.struct(*HEADER_COLUMNS, _segment_array(only).alias("segments")).alias("parsed"),
    )


def flatten_messages(parsed: DataFrame, provenance: Iterable[str] = ()) -> DataFrame:
    """One flat row per message. ``provenance`` names extra columns to carry, such as the file."""
    names = [*HEADER_COLUMNS, "segments"]
    return parsed.select(*provenance, *[F.col(f"parsed.{n}").alias(n) for n in names])


def explode_segments(flat: DataFrame, provenance: Iterable[str] = ()) -> DataFrame:
    """One row per segment; messages without segments drop out."""
    return _explode_array(flat, F.filter("segments", lambda s: s.isNotNull()), provenance)


def _explode_array(flat: DataFrame, segments: Column, provenance: Iterable[str]) -> DataFrame:
    # The generator gets an expression on purpose. For a bare column Catalyst infers a size filter
    # and pushes it below the parse, which would then run once more for that filter.
    return flat.select(
        *provenance, *MESSAGE_KEYS, F.explode(segments).alias("segment")
    ).select(
        *provenance,
        *MESSAGE_KEYS,
        F.col("segment.segment_id").alias("segment_id"),
        F.col("segment.fields").alias("fields"),
    )


def with_kind(segments: DataFrame) -> DataFrame:
    """Adds ``segment_kind``, a known segment name or ``other``: a bounded set to lay tables out by,
    whatever stands at the start of a line. ``segment_id`` stays as it is in the message."""
    known = F.col("segment_id").isin(list(SEGMENT_FIELD_NUMBERS))
    return segments.withColumn("segment_kind", F.when(known, F.col("segment_id")).otherwise(OTHER_KIND))


def of_kind(segments: DataFrame, segment: str) -> DataFrame:
    """The stored part of a table laid out by kind that can hold ``segment``."""
    kind = segment if segment in SEGMENT_FIELD_NUMBERS else OTHER_KIND
    return segments.filter(F.col("segment_kind") == kind)


def field_numbers(segment: str, numbers: Iterable[int] | None = None) -> list[int]:
    if numbers is not None:
        return list(numbers)
    if segment not in SEGMENT_FIELD_NUMBERS:
        raise ValueError(f"no field list for segment {segment}; pass the field numbers")
    return SEGMENT_FIELD_NUMBERS[segment]


def typed_segments(
    segments: DataFrame, segment: str, numbers: Iterable[int] | None = None,
    provenance: Iterable[str] = (),
) -> DataFrame:
    """Typed table of one segment kind from exploded segments."""
    keys = [f"{segment}_{n}" for n in field_numbers(segment, numbers)]
    return segments.filter(F.col("segment_id") == segment).select(
        *provenance,
        *MESSAGE_KEYS,
        "segment_id",
        *[F.col("fields").getItem(key).alias(key) for key in keys],
    )


def segment_table(
    flat: DataFrame, segment: str, numbers: Iterable[int] | None = None,
    provenance: Iterable[str] = (),
) -> DataFrame:
    """Typed table of one segment kind from flat messages.

    The kind is filtered inside the array, before the explode: Catalyst leaves such a filter above
    the generator, where every other segment of the message would become a row first.
    """
    wanted = F.filter("segments", lambda s: s["segment_id"] == segment)
    keys = [f"{segment}_{n}" for n in field_numbers(segment, numbers)]
    return _explode_array(flat, wanted, provenance).select(
        *provenance,
        *MESSAGE_KEYS,
        "segment_id",
        *[F.col("fields").getItem(key).alias(key) for key in keys],
    )


def segment_table_from_text(
    messages: DataFrame, segment: str, numbers: Iterable[int] | None = None,
    text: str = "value", provenance: Iterable[str] = (),
) -> DataFrame:
    """The same typed table straight from message text: only lines of this kind are split, and no
    field maps are built."""
    headed = with_head(messages, text).select(
        *provenance, *MESSAGE_KEYS, _SEP, _REP, _GOOD
    )
    lines = headed.select(
        *provenance, *MESSAGE_KEYS, _SEP, _REP, F.explode(_lines_of([segment])).alias("__line")
    )
    rows = lines.withColumn("__parts", _split_fields(F.col("__line"), F.col(_SEP)))

    def column(number: int) -> Column:
        if segment == HEADER and number == 1:
            return F.col(_SEP)
        place = number - 1 if segment == HEADER else number
        field = F.get(F.col("__parts"), F.lit(place))
        if not (segment == HEADER and number == 2):
            field = _last_repetition(field)
        return F.when(field != "", field)

    return rows.select(
        *provenance,
        *MESSAGE_KEYS,
        F.lit(segment).alias("segment_id"),
        *[column(n).alias(f"{segment}_{n}") for n in field_numbers(segment, numbers)],
    )


def message_errors(flat: DataFrame, provenance: Iterable[str] = ()) -> DataFrame:
    """Rows of unreadable messages with the reason."""
    return flat.filter(F.col("message_type") == ERROR).select(
        *provenance, F.get("segments", F.lit(0))["fields"]["error"].alias("error_text")
    )


def text_faults(
    messages: DataFrame, text: str = "value", provenance: Iterable[str] = ()
) -> DataFrame:
    """The same rows straight from message text; looks at the start of each text only."""
    start = F.substring(F.ltrim(F.col(text), F.lit(BLANKS)), 1, SHORTEST_MESSAGE + 1)
    faults = messages.select(*provenance, _fault(F.concat(F.lit("\r"), start)).alias("error_text"))
    return faults.filter(F.col("error_text").isNotNull())


def readable_messages(flat: DataFrame) -> DataFrame:
    """The counterpart of ``message_errors``; a message without a type is readable."""
    return flat.filter(~F.col("message_type").eqNullSafe(ERROR))


def error_report(errors: DataFrame) -> DataFrame:
    return errors.groupBy("error_text").agg(F.count("*").alias("messages"))
