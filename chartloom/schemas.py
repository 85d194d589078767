"""Fixed schemas: segment field lists, the parsed message, parsed documents, annotation mapping."""

from __future__ import annotations

import typing
from datetime import date, datetime

from pyspark.sql import types as T

# How many numbered fields each typed segment table shows.
SEGMENT_FIELD_NUMBERS: dict[str, list[int]] = {
    "MSH": list(range(1, 20)),
    "PID": list(range(1, 31)),
    "EVN": list(range(1, 8)),
    # The visit table has no columns for fields 41 to 50.
    "PV1": list(range(1, 41)) + list(range(51, 55)),
    "OBR": list(range(1, 48)),
    "OBX": list(range(1, 34)),
    "CTI": list(range(1, 5)),
    "AL1": list(range(1, 7)),
}

MESSAGE_KEYS = ["message_type", "message_datetime", "patient_id"]
HEADER_COLUMNS = [*MESSAGE_KEYS, "patient_name"]

SEGMENT_TYPE = T.StructType(
    [
        T.StructField("segment_id", T.StringType()),
        T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
    ]
)

PARSED_MESSAGE_TYPE = T.StructType(
    [
        T.StructField("message_type", T.StringType()),
        T.StructField("message_datetime", T.StringType()),
        T.StructField("patient_id", T.StringType()),
        T.StructField("patient_name", T.StringType()),
        T.StructField("segments", T.ArrayType(SEGMENT_TYPE)),
    ]
)

CHAT_MESSAGE_TYPE = T.StructType(
    [T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]
)


class ParsedDocument(typing.TypedDict):
    content: str
    parser_status: str
    doc_uri: str
    last_modified: datetime


# Spark type of each plain Python annotation.
PYTHON_TO_SPARK = {
    str: T.StringType(),
    int: T.IntegerType(),
    float: T.DoubleType(),
    bool: T.BooleanType(),
    list: T.ArrayType(T.StringType()),
    datetime: T.TimestampType(),
    date: T.DateType(),
}


def spark_type_of(annotation) -> T.DataType:
    """Spark type of a Python annotation; ``list[T]`` nests, ``dict[...]`` is refused."""
    if annotation in PYTHON_TO_SPARK:
        return PYTHON_TO_SPARK[annotation]
    origin = typing.get_origin(annotation)
    if origin is list:
        (item,) = typing.get_args(annotation)
        return T.ArrayType(spark_type_of(item))
    if origin is dict:
        raise ValueError(f"a dict annotation has no Spark type here: {annotation}")
    raise ValueError(f"no Spark type for annotation {annotation}")


def schema_from_annotations(*classes: type) -> T.StructType:
    """One nullable field per annotation, in order, over all the classes given."""
    schema = T.StructType()
    for cls in classes:
        for name, annotation in typing.get_type_hints(cls).items():
            schema = schema.add(name, spark_type_of(annotation), True)
    return schema


PARSED_DOCUMENT_SCHEMA = schema_from_annotations(ParsedDocument)
