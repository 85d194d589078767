"""A keyed index as a change log in hash buckets, folded into base versions from time to time.

``log/batch_id=N/bucket=B`` holds what batch ``N`` changed, ``base/version=V/bucket=B`` the rows after all
batches up to some number, and ``manifest/version=V`` says up to which. A reader takes the last manifest, its
base and the log behind it; a batch that knows its keys reads their buckets only. A base is complete before
its manifest is written, so a run that ends in between leaves the old version in force, and the next
run writes that base again.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructType

from chartloom.operators.changes import latest_by_key
from chartloom.sinks.tables import COMPRESSION

BUCKETS = 32
_MANIFEST = "folded int, buckets int, version int"


class IndexStore:
    """Rows of ``key`` and other columns. ``schema`` is that of the log: ``change_type``, the key, others.

    An object knows the manifest from when it was made and what it has folded since; one writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int = BUCKETS):
        self.spark, self.path, self.key = spark, path, key
        self.fields = StructType.fromDDL(schema)
        last = self._last("manifest", _MANIFEST, F.struct("version", "folded", "buckets"))
        self.version, self.folded, self.buckets = last or (0, -1, buckets)
        if not last:
            self._write(spark.createDataFrame([], self._row_fields()), f"{path}/base/version=0")
            self._publish()

    def _row_fields(self) -> StructType:
        return StructType([f for f in self.fields if f.name != "change_type"])

    def _last(self, folder: str, schema: str, value: Column):
        """The greatest value in a folder; None without the folder or rows."""
        try:
            rows = self.spark.read.schema(schema).parquet(f"{self.path}/{folder}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return rows.agg(F.max(value)).first()[0]

    def _publish(self) -> None:
        row = self.spark.createDataFrame([(self.folded, self.buckets)], "folded int, buckets int")
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={self.version}")

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, path: str) -> None:
        placed = rows.withColumn("bucket", self.bucket()).hint("rebalance", F.col("bucket"))
        placed.write.mode("overwrite").partitionBy("bucket").parquet(path, compression=COMPRESSION)

    def write_batch(self, changes: DataFrame, batch_id: int) -> None:
        """Add a batch's changes; a batch that comes again replaces its own."""
        self._write(changes, f"{self.path}/log/batch_id={batch_id}")

    def buckets_of(self, rows: DataFrame) -> list[int]:
        """The buckets of some rows' keys, at most all of them."""
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())

    def current(self, before: int, buckets: list[int] | None = None, columns: list[str] | None = None) -> DataFrame:
        """The rows after all batches with a smaller number; with ``buckets`` only what these hold, with
        ``columns`` the key and these alone: others are neither read nor shuffled.

        Batches are numbered without gaps and each has its folder, so the log is read by the names of
        those behind the base and its older folders are not even listed.
        """
        if self.folded >= before:
            raise ValueError(f"batch {before} is older than the base, which holds batches up to {self.folded}")

        def held(schema: StructType, paths: list[str], **options) -> DataFrame:
            rows = self.spark.read.schema(schema.add("bucket", IntegerType())).options(**options).parquet(*paths)
            return (rows if buckets is None else rows.where(F.col("bucket").isin(buckets))).drop("bucket")

        rows = held(self._row_fields(), [f"{self.path}/base/version={self.version}"])
        rows = rows.withColumns({"change_type": F.lit("insert"), "batch_id": F.lit(-1)})
        behind = [f"{self.path}/log/batch_id={batch}" for batch in range(self.folded + 1, before)]
        if behind:
            schema = StructType([*self.fields]).add("batch_id", IntegerType())
            rows = rows.unionByName(held(schema, behind, basePath=f"{self.path}/log"))
        if columns is not None:
            rows = rows.select(self.key, *[c for c in columns if c != self.key], "change_type", "batch_id")
        return latest_by_key(rows, self.key)

    def batches(self) -> int:
        """One more than the number of the last batch that has changes or is in the base."""
        last = self._last("log", "batch_id int, bucket int", F.col("batch_id"))
        return max(-1 if last is None else last, self.folded) + 1

    def behind(self, before: int) -> int:
        """Batches with a smaller number that no base holds yet."""
        return before - 1 - self.folded

    def compact(self, before: int) -> None:
        """Fold all batches with a smaller number into a new base."""
        if self.behind(before) < 1:
            return
        self._write(self.current(before), f"{self.path}/base/version={self.version + 1}")
        self.version, self.folded = self.version + 1, before - 1
        self._publish()

    def versions(self) -> DataFrame:
        """``version, folded``: every base and the last batch in it."""
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest").select("version", "folded")
