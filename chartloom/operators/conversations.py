"""Conversation operators over ``(conv_id, turn, role, text)`` and chat responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from chartloom.functions.text import labeled_line
from chartloom.operators.grouping import assemble_text
from chartloom.schemas import CHAT_MESSAGE_TYPE

UNKNOWN_RESPONSE = "the response holds neither messages nor choices"

RESPONSE_TYPE = T.StructType(
    [
        T.StructField("messages", T.ArrayType(CHAT_MESSAGE_TYPE)),
        T.StructField(
            "choices",
            T.ArrayType(T.StructType([T.StructField("message", CHAT_MESSAGE_TYPE)])),
        ),
    ]
)

UPDATES_TYPE = T.ArrayType(
    T.MapType(
        T.StringType(),
        T.StructType([T.StructField("messages", T.ArrayType(CHAT_MESSAGE_TYPE))]),
    )
)


def last_messages(turns: DataFrame) -> DataFrame:
    latest = F.max_by(F.struct("turn", "role", "text"), "turn").alias("last")
    return turns.groupBy("conv_id").agg(latest).select("conv_id", "last.turn", "last.role", "last.text")


def transcripts(turns: DataFrame) -> DataFrame:
    line = labeled_line(F.col("role"), F.col("text"))
    return assemble_text(turns, ["conv_id"], ["turn"], line, "\n", "transcript")


def message_counts(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(F.count("*").alias("messages"))


def response_messages(response: Column) -> Column:
    """Messages of a chat response: its message list, else the first choice; NULL without either."""
    parsed = F.from_json(response, RESPONSE_TYPE)
    first = F.get(parsed["choices"], F.lit(0))["message"]
    return F.coalesce(parsed["messages"], F.when(first.isNotNull(), F.array(first)))


def explode_responses(responses: DataFrame, response: str = "response") -> DataFrame:
    """One row per message, numbered from 0. A response of unknown shape gives a row with a fault."""
    carried = [c for c in responses.columns if c != response]
    fault = F.struct(F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("content"))
    messages = responses.select(*carried, response_messages(F.col(response)).alias("__messages"))
    unknown = F.col("__messages").isNull()
    return messages.select(
        *carried,
        F.when(unknown, UNKNOWN_RESPONSE).alias("fault"),
        F.posexplode(F.coalesce("__messages", F.array(fault))).alias("position", "message"),
    ).select(*carried, "fault", "position", "message.role", "message.content")


def update_messages(updates: Column) -> Column:
    """Messages of a list of updates, ``[{node: {messages: [...]}}, ...]``, in order."""
    parsed = F.from_json(updates, UPDATES_TYPE)
    per_update = F.transform(
        parsed,
        lambda update: F.flatten(
            F.transform(
                F.map_values(update),
                lambda node: F.coalesce(
                    node["messages"], F.array().cast(T.ArrayType(CHAT_MESSAGE_TYPE))
                ),
            )
        ),
    )
    return F.flatten(per_update)


def explode_updates(updates: DataFrame, column: str = "updates") -> DataFrame:
    carried = [c for c in updates.columns if c != column]
    return updates.select(
        *carried, F.posexplode(update_messages(F.col(column))).alias("position", "message")
    ).select(*carried, "position", "message.role", "message.content")
