"""A versioned change feed of a keyed table: what each version changed, for batches and for streams.

``changes/version=N`` holds the rows that version ``N`` inserted, deleted and updated, updates as the row before
and the row after; ``rows/version=N`` is the table itself at that version. A version counts once its rows
are complete, which are written last.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from chartloom.operators.changes import DELETE, INSERT, UPDATE
from chartloom.operators.chunks import all_but
from chartloom.sinks.tables import overwrite_folder

BEFORE, AFTER = f"{UPDATE}_preimage", f"{UPDATE}_postimage"


class ChangeFeed:
    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path, key

    def version(self) -> int:
        """The last complete version, 0 for none."""
        try:
            done = self.spark.read.schema("rows long, version int").parquet(f"{self.path}/done")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return 0
        return done.agg(F.max("version")).first()[0] or 0

    def snapshot(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows/version={version or self.version()}")

    def commit(self, table: DataFrame) -> int:
        """Make a table with each key once the next version. A commit that was cut short is done again."""
        version = self.version() + 1
        new = overwrite_folder(table, f"{self.path}/rows/version={version}")
        old = self.snapshot(version - 1) if version > 1 else new.limit(0)
        overwrite_folder(_changed(old, new, self.key), f"{self.path}/changes/version={version}")
        self.spark.range(1).select(F.lit(version).cast("long").alias("rows")).coalesce(1).write.mode("overwrite").parquet(
            f"{self.path}/done/version={version}"
        )
        return version

    def _schema(self) -> str:
        fields = self.snapshot(1).schema.fields
        return ", ".join(["change_type string", *(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "version int"])

    def changes(self, first: int, last: int) -> DataFrame:
        """``change_type``, the row and ``version`` of all changes of these versions; older ones aren't read."""
        rows = self.spark.read.schema(self._schema()).parquet(f"{self.path}/changes")
        return rows.where(F.col("version").between(first, min(last, self.version())))

    def stream(self, first: int = 1, versions_per_trigger: int | None = None) -> DataFrame:
        """The same as a stream that goes on with the versions to come."""
        reader = self.spark.readStream.schema(self._schema())
        if versions_per_trigger:
            reader = reader.option("maxFilesPerTrigger", versions_per_trigger)
        return reader.parquet(f"{self.path}/changes").where(F.col("version") >= first)


def _changed(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Both sides of every changed key, from one join; equal rows are told by comparing all columns."""
    columns = new.columns
    before = old.select(F.col(key).alias("__old_key"), F.struct(*columns).alias("__before"))
    after = new.select(F.col(key).alias("__new_key"), F.struct(*columns).alias("__after"))
    same = [F.col("__before")[c].eqNullSafe(F.col("__after")[c]) for c in all_but(new, key)]
    equal = F.lit(True)
    for condition in same:
        equal = equal & condition
    image = lambda kind, row: F.struct(F.lit(kind).alias("change_type"), F.col(row).alias("row"))
    images = (
        F.when(F.col("__old_key").isNull(), F.array(image(INSERT, "__after")))
        .when(F.col("__new_key").isNull(), F.array(image(DELETE, "__before")))
        .when(~equal, F.array(image(BEFORE, "__before"), image(AFTER, "__after")))
    )
    joined = after.join(before, F.col("__new_key") == F.col("__old_key"), "full_outer")
    return joined.select(F.explode(images).alias("change")).select(
        "change.change_type", *[F.col("change.row")[c].alias(c) for c in columns]
    )


def replayed(changes: DataFrame, key: str) -> DataFrame:
    """The table that a feed's changes from its first version on lead to."""
    others = all_but(changes, key, "version", "change_type")
    written = changes.where(F.col("change_type") != BEFORE)
    # Of a deletion only its kind counts, so its row isn't shuffled.
    row = [F.when(F.col("change_type") != DELETE, F.col(c)).alias(c) for c in others]
    last = F.max_by(F.struct("change_type", *row), "version").alias("last")
    rows = written.groupBy(key).agg(last).where(F.col("last.change_type") != DELETE)
    return rows.select(key, *[F.col("last")[c].alias(c) for c in others])
