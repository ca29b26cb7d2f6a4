"""SNK-08 to SNK-15: tables that are changed in place, bucket by bucket.

A table is a folder of Parquet files partitioned by a bucket of its key.  A change reads the buckets that hold keys of
the change, and no others, and writes them anew by dynamic partition overwrite: new files lie in a staging folder until
the job is done, so a failed task or job leaves the table as it was, and files of other buckets aren't touched.  Each
written bucket has a marker row, so that a bucket that loses all its rows is overwritten too.  Every change states what
the rows of its keys shall be, so doing it again changes nothing.  One writer at a time is assumed; a driver that dies
while the finished job's folders are moved into place may leave some buckets changed and others not, which doing the
change again mends.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gridgauge.operators import truth
from gridgauge.shared import written

BUCKET, MARKER = "gridgauge_bucket", "gridgauge_marker"
#: Rows of a task of a change, about.
ROWS = 250_000


class Table:
    """``key``: the column that says a row's bucket; ``buckets``: their number, which is as many numbers as a change brings to the driver at most."""

    def __init__(self, spark: SparkSession, path: str, key: str = "document_id", buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets

    def create(self, df: DataFrame) -> Table:
        """A new table with the rows of ``df``; an existing one is an error."""
        self._write(df.withColumn(MARKER, F.lit(False)), "errorifexists")
        return self

    def read(self) -> DataFrame:
        return self._all().where(~F.col(MARKER)).drop(BUCKET, MARKER)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("long")

    def _all(self) -> DataFrame:
        rows = self.spark.read.parquet(self.path)
        return rows.select(*[c for c in rows.columns if c != BUCKET], F.col(BUCKET).cast("long").alias(BUCKET))

    def _write(self, rows: DataFrame, mode: str, even: bool = True) -> None:
        # Rebalancing splits a bucket that holds much more than others; it moves all rows once.
        bucket = self._bucket() if BUCKET not in rows.columns else F.coalesce(F.col(BUCKET), self._bucket())
        rows = rows.withColumn(BUCKET, bucket)
        (rows.hint("rebalance", BUCKET) if even else rows).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)

    def change(self, keys: DataFrame, made: Callable[[DataFrame], DataFrame], by: list[str] | None = None, even: bool = True) -> None:
        """Rows of the buckets of ``keys`` become what ``made`` gives for them; it must leave rows of other keys alone.

        With ``by``, ``made`` gets them dealt by the columns that it joins them by, over tasks of about ``ROWS`` rows, however many they are.
        Not ``even``: rows are written by the tasks that have them, for changes that add none.
        """
        touched = sorted(r[0] for r in keys.select(self._bucket().alias("b")).distinct().collect())
        if not touched:
            return
        held = self._all()
        old = held.where(F.col(BUCKET).isin(touched) & ~F.col(MARKER)).drop(BUCKET, MARKER)
        if by:
            old = old.repartition(old.count() // ROWS + self.spark.sparkContext.defaultParallelism, *by)
        new = made(old).select(*old.columns).withColumn(MARKER, F.lit(False)).withColumn(BUCKET, F.lit(None).cast("long"))
        marks = self.spark.createDataFrame([(b,) for b in touched], StructType([StructField(BUCKET, LongType())]))
        marks = marks.select(*[F.lit(None).cast(t).alias(c) for c, t in old.dtypes], F.lit(True).alias(MARKER), BUCKET)
        self._write(new.unionByName(marks), "overwrite", even)

    def append(self, new: DataFrame, keys: list[str]) -> None:
        """SNK-08: rows whose ``keys`` the table lacks are added."""
        self.change(new, lambda old: truth.insert_absent(old, new, keys)[0])

    def replace(self, new: DataFrame, keys: list[str]) -> None:
        """SNK-11: all rows of the new rows' keys are replaced."""
        self.change(new, lambda old: truth.replace(old, new, keys))

    def replace_run(self, new: DataFrame) -> None:
        """SNK-10: a run's tables are replaced; what is known of the run as a whole stays."""
        self.change(new, lambda old: truth.replace_run(old, new), ["document_id", "tool_name"])

    def insert_absent(self, new: DataFrame, keys: list[str]) -> DataFrame:
        """SNK-12: adds the rows whose key is new; returns those that were there before, which are refused (a table beside this one)."""
        path = f"{self.path.rstrip('/')}-refused-{uuid.uuid4().hex}"
        new.join(self.read().select(*keys), keys, "left_semi").select(*new.columns).write.parquet(path)
        self.append(new, keys)
        return self.spark.read.schema(new.schema).parquet(path)

    def update(self, changes: DataFrame, keys: list[str], nullable: tuple[str, ...] = ()) -> None:
        """SNK-13, SNK-15: values that aren't null replace what is there; see ``truth.update``."""
        self.change(changes, lambda old: truth.update(old, changes, keys, nullable))

    def delete(self, gone: DataFrame, keys: list[str]) -> None:
        """SNK-14: rows of the given keys go; other indexes stay."""
        self.change(gone, lambda old: truth.delete(old, gone, keys), even=False)


def delete_documents(documents: Table, tables: Table, runs: Table, scores: Table, gone: DataFrame) -> None:
    """SNK-09: documents with their truth, runs and scores.  Children go first, so a delete that was cut short can be done again."""
    ids = gone.select("document_id")
    # Asked for twice, for its buckets and for its rows: the runs are joined once.
    own = written(runs.read().join(ids, "document_id", "left_semi").select("extraction_result_id"))
    scores.delete(own, ["extraction_result_id"])
    for t in (runs, tables, documents):
        t.delete(ids, ["document_id"])
