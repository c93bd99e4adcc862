"""Helpers that several training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lawframe.session import shared_folder

#: Text bytes that one numpy step handles at most; a longer text is a step of its own.
CHUNK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return frame.select(*cols) if cols else frame


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with files in the shared folder, which outlive any executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes of rows that a Python worker gets at a time, where the session has Spark's default of 64 MB.
BATCH_BYTES = "4m"
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_batches(df: DataFrame) -> DataFrame:
    """Before mapInArrow: texts are large rows, so bound a batch by bytes. A longer row is a batch of its own."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_SETTING) in ("67108864b", "67108864", "64m", "64MB"):
        conf.set(_BATCH_SETTING, BATCH_BYTES)
    return df


def text_key(text: Column) -> Column:
    """With doc_id, tells rows of different texts apart; rows that agree in both are repeats of one row."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def chunks(batch: pa.RecordBatch, text: str) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts as UTF-8) in steps of about CHUNK_BYTES; null is an empty text."""
    part: list[bytes] = []
    size = first = 0
    column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
    for row, value in enumerate(column):
        raw = value.as_py() or b""
        if part and size + len(raw) > CHUNK_BYTES:
            yield first, part
            part, size, first = [], 0, row
        part.append(raw)
        size += len(raw)
    if part:
        yield first, part


def crc_of(column: Column) -> Column:
    """crc32 of the decimal digits of an integer id, 0 for a null id."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")), F.lit(0))


#: Rows, and bytes as JSON, of a per-source or per-cell table up to which it is broadcast.
BROADCAST_ROWS = 50_000
BROADCAST_BYTES = 32 << 20


#: A key counts as hot from one in so many of all rows on, and from so many rows: at most HOT_SHARE keys are.
HOT_SHARE = 10_000
HOT_ROWS = 100


def joined_on(rows: DataFrame, table: DataFrame, key: str, n: str = "n") -> DataFrame:
    """`rows` joined with `table`, which has each key once, with the number of its rows in `n` (which is left out).

    Hot keys, of bounded number, are broadcast, so that their rows stay where they
    are; all others meet by shuffle.
    """
    least = max(HOT_ROWS, (table.agg(F.coalesce(F.sum(n), F.lit(0)).alias("n")).first()["n"] or 0) // HOT_SHARE)
    hot = F.broadcast(checkpointed(table.where(F.col(n) > least)))
    others = rows.join(hot.select(key), key, "left_anti").join(table.where(F.col(n) <= least), key)
    return rows.join(hot, key).unionByName(others).drop(n)


def small(df: DataFrame) -> DataFrame:
    """Write a table down; mark it for broadcast if its counted rows and bytes allow that, else leave the join to Spark."""
    kept = checkpointed(df)
    if kept.count() > BROADCAST_ROWS:
        return kept
    measured = kept.agg(F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in kept.columns]))))).first()[0] or 0
    return F.broadcast(kept) if measured <= BROADCAST_BYTES else kept


def marked(docs: DataFrame, marks: DataFrame, keys: list[Column], how: str) -> DataFrame:
    """Rows of `docs` whose `keys` are ("left_semi") or aren't ("left_anti") a row of `marks`, nulls equal to nulls.

    The columns of `marks` are those of `keys`, in order. They go in one struct under a
    generated name, so that no column of `docs` can clash with them.
    """
    name = f"mark {uuid.uuid4().hex}"
    side = small(marks.distinct().select(F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(marks.columns)]).alias(name)))
    same = F.lit(True)
    for i, key in enumerate(keys):
        same = same & key.eqNullSafe(F.col(f"`{name}`.k{i}"))
    return docs.join(side, same, how)
