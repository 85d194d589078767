"""Table sources, batch and streaming, for catalog names and parquet folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def stream_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.readStream.table(name)


def stream_folder(
    spark: SparkSession, path: str, schema: StructType, per_trigger: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path)
