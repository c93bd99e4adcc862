"""Numbers in an order over whole tables, without gathering the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lawframe.session import shared_folder


def after(sizes: DataFrame, order: list[str], n: str) -> DataFrame:
    """`before`: the sum of `n` over the rows that come earlier; for tables of a row per task or file, not per record."""
    earlier = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("before", F.coalesce(F.sum(n).over(earlier), F.lit(0)))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows with their place, from 1, in a total order.

    Sorted by ranges; a row's place is its place in its range after the sizes of
    the ranges before. The sorted rows are checkpointed, so that both steps see the
    same ranges.
    """
    shared_folder(rows.sparkSession)
    ordered = rows.orderBy(*order).checkpoint()
    placed = ordered.withColumn("id", F.monotonically_increasing_id()).withColumns({"range": F.shiftright("id", 33), "at": F.col("id").bitwiseAND(F.lit((1 << 33) - 1))})
    before = after(placed.groupBy("range").agg(F.count(F.lit(1)).alias("n")), ["range"], "n").select("range", "before")
    return placed.join(before, "range").withColumn(name, F.col("before") + F.col("at") + 1).select(*rows.columns, name)
