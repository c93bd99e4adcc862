"""Attempts that land as files: the row that counts, and summaries, kept up after each batch.

The state is a keyed table with a version per batch: a batch reads and rewrites the
parts that its keys fall into, which are bounded, and splits those that outgrow the
bound. A batch that failed or is run again starts from the version before it, and a
restart finds the newest in the folder, with or without new files, also where the
failed batch was in the middle of a split.

A correction can move a row to another bucket. Summaries are therefore kept as totals
that rows are taken out of as well: per model the rows of each bucket, and a histogram
of each value that has a median. A batch subtracts what its parts counted before and
adds what they count after, so its cost depends on the parts that it touches and on
the number of distinct values, not on the state.

Defined results: without any landed row the state is empty; a key may be null in
any column; repeated rows count once, as they carry the same seq.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lawframe.operators import summary
from lawframe.operators.attempts import latest_graded
from lawframe.session import file_system, names_in
from lawframe.sources.keyed import MOST_ROWS, KeyedTable, Parts

#: What is called after each batch: its number, and the rows of the touched parts before and after.
After = Callable[[int, DataFrame, DataFrame], None]


class State:
    """The row that counts of each key, a version per batch."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], most_rows: int = MOST_ROWS):
        self.keys, self.table = keys, KeyedTable(spark, path, schema, keys, most_rows)

    def rows(self) -> DataFrame:
        return self.table.rows()

    def merge(self, batch: DataFrame, number: int, after: After | None = None) -> tuple[Parts, Parts]:
        """Take a batch in; once more with the same number gives the same state. The parts that it touched, before and after."""
        _, parts = self.table.parts(before=number)
        made, former, now = self.table.merged(batch, parts, lambda old, new: latest_graded(old.unionByName(new), self.keys), str(number))
        if after is not None:
            after(number, self.table.rows(former), self.table.rows(now))
        self.table.commit(number, made, replace=True)
        self.table.forget(number)
        return former, now


class Totals:
    """Summary totals (model, kind, value, n), a version per batch: the former one and what the batch changed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def batches(self) -> list[int]:
        """Numbers of the whole ones."""
        found = [b for b in names_in(self.spark, self.path) if b.isdigit()]
        return sorted(int(b) for b in found if "_SUCCESS" in names_in(self.spark, f"{self.path}/{b}"))

    def rows(self, before: int | None = None) -> DataFrame:
        known = [b for b in self.batches() if before is None or b < before]
        schema = summary.TOTALS
        return self.spark.read.schema(schema).parquet(f"{self.path}/{known[-1]}") if known else self.spark.createDataFrame([], schema)

    def change(self, number: int, former: DataFrame, now: DataFrame) -> None:
        """Take out what was counted, put in what counts; once more with the same number gives the same totals."""
        out = summary.summary_counts(former).withColumn("n", -F.col("n"))
        whole = self.rows(before=number).unionByName(out).unionByName(summary.summary_counts(now))
        summary.added_up(whole).write.mode("overwrite").parquet(f"{self.path}/{number}")
        system, make = file_system(self.spark, self.path)
        for old in [b for b in self.batches() if b < number][:-1]:
            system.delete(make(f"{self.path}/{old}"), True)


def _stream(spark: SparkSession, source: str, schema: T.StructType, checkpoint: str, files_per_batch: int, step: Callable[[DataFrame, int], object]) -> None:
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = stream.writeStream.foreachBatch(lambda batch, number: step(batch, number) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def run_incremental_latest(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    keys: list[str],
    state: str,
    checkpoint: str,
    files_per_batch: int = 1,
    after: After | None = None,
    most_rows: int = MOST_ROWS,
) -> DataFrame:
    """Read all rows that have landed since the last run, a few files a batch, and return the state; `after` is called before a batch is committed."""
    held = State(spark, state, schema, keys, most_rows)
    _stream(spark, source, schema, checkpoint, files_per_batch, lambda batch, number: held.merge(batch, number, after))
    return held.rows()


def run_incremental_summary(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    keys: list[str],
    state: str,
    checkpoint: str,
    models: DataFrame,
    files_per_batch: int = 1,
    most_rows: int = MOST_ROWS,
    response: str = "response",
) -> DataFrame:
    """The summary of the rows that count, per requested model, after all that has landed; `response` is an expression for the text whose length counts."""
    totals = Totals(spark, f"{state}/totals")

    def after(number: int, former: DataFrame, now: DataFrame) -> None:
        told = [rows.withColumn("response", F.expr(response)) for rows in (former, now)]
        totals.change(number, *told)

    run_incremental_latest(spark, source, schema, keys, state, checkpoint, files_per_batch, after, most_rows)
    return summary.summary_from_counts(totals.rows(), models)
