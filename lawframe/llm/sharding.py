"""Sharding by vector bin packing.

Groups of equal texts stay together. Each has a vector of bytes, tokens and rows
and is placed, largest first, where the dot product of its vector with the
shard's residual capacity is highest. Groups that are large beside a cell are
placed one by one; the many small ones are pooled by hash into a fixed number of
cells per shard, and a cell is placed as one group. Large groups and cells are
bounded by the number of shards alone, so the placement step has a fixed size.

A group that fits into a shard stays whole. One with more than a shard's equal
share in any dimension is dealt by row number into pieces of about `piece_share`
of a shard, each placed by itself. At most 3 * shards groups can be so large.

Rows are numbered as they are first written down, so that rows without an id or of
one id differ. Slots are counted in parts of a cell of about `SLOT_ROWS` rows,
after the sizes of the parts before; texts, where they are kept, meet their shard
by row number.

Defined results: a null text has no bytes and no tokens and groups with other
nulls; a text of any length counts whole; repeated rows get slots of their own;
among vectors of one size and places of one dot product the first is taken; an
empty table gives an empty result. Other columns are ignored; sharded_documents
replaces columns named shard or slot.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lawframe.llm.common import checkpointed
from lawframe.llm.mixing import word_count

ROW_OVERHEAD = 16
CELLS_PER_SHARD = 128
PIECE_SHARE = 1 / 4
#: Rows of a cell that are numbered in one task.
SLOT_ROWS = 50_000
DIMENSIONS = ("bytes", "tokens", "n_rows")


def pack(vectors: np.ndarray, shards: int) -> np.ndarray:
    """A shard for each vector, in the order of their largest relative component.

    Residual capacity is what is left of an equal share, negative once it is
    exceeded. A shard that would exceed its share in a dimension where another
    would not is passed over.
    """
    if not len(vectors):
        return np.zeros(0, dtype=np.int64)
    share = np.maximum(vectors.sum(axis=0) / shards, 1e-9)
    parts = vectors / share
    residual = np.ones((shards, parts.shape[1]))
    place = np.zeros(len(parts), dtype=np.int64)
    for i in np.argsort(-parts.max(axis=1), kind="stable"):
        left = (residual - parts[i]).min(axis=1)
        fits = left >= 0 if (left >= 0).any() else left >= left.max() - 1e-12
        place[i] = np.argmax(np.where(fits, residual @ parts[i], -np.inf))
        residual[place[i]] -= parts[i]
    return place


def measured(docs: DataFrame, *keep: str) -> DataFrame:
    """Rows with the size vector, the digest that names the group, and the hash that deals out hot groups."""
    text = F.col("text")
    return docs.select(
        *[F.col(f"`{c}`") for c in keep],
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_OVERHEAD).cast("long").alias("bytes"),
        word_count(text).alias("tokens"),
        F.lit(1).cast("long").alias("n_rows"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.concat_ws("|", F.coalesce(F.md5(text.cast("binary")), F.lit("null")), F.coalesce(F.octet_length(text), F.lit(0)).cast("string")).alias("group"),
    )


def with_cell(rows: DataFrame, plan: DataFrame, shards: int, cells_per_shard: int) -> DataFrame:
    """Rows with their cell; `plan` has the groups that are not pooled, (alone, first, pieces), and their cells from `first` on."""
    common = F.pmod(F.xxhash64("group"), F.lit(shards * cells_per_shard))
    piece = F.pmod(F.xxhash64(F.lit("piece"), "row"), F.col("pieces"))
    placed = rows.join(plan, F.col("group") == F.col("alone"), "left")
    return placed.withColumn("cell", F.when(F.col("alone").isNull(), common).otherwise(F.col("first") + piece)).drop("alone", "first", "pieces")


def assign(rows: DataFrame, shards: int = 40, cells_per_shard: int = CELLS_PER_SHARD, piece_share: float = PIECE_SHARE) -> DataFrame:
    """Per measured row (row, group, and the size vector): shard and slot beside its columns. `rows` are written down."""
    total = rows.agg(*[F.coalesce(F.sum(d), F.lit(0)).alias(d) for d in DIMENSIONS]).first().asDict()
    shares = [F.col(d) / F.lit(max(total[d], 1) / shards) for d in DIMENSIONS]
    groups = rows.groupBy(F.col("group").alias("alone")).agg(*[F.sum(d).alias(d) for d in DIMENSIONS]).withColumn("share", F.greatest(*shares))
    # at most 3 * shards * cells_per_shard groups have as much of any dimension as a cell
    large = groups.where(F.col("share") >= 1 / cells_per_shard).select("alone", "share")
    named = large.collect()
    named.sort(key=lambda r: (-r["share"], r["alone"]))
    first, plan = shards * cells_per_shard, []
    for r in named:
        pieces = math.ceil(r["share"] / piece_share) if r["share"] > 1 else 1
        plan.append((r["alone"], first, pieces))
        first += pieces
    spark = rows.sparkSession
    found = with_cell(rows, F.broadcast(spark.createDataFrame(plan, "alone string, first long, pieces long")), shards, cells_per_shard)
    # one row per cell, of a number that shards fix, whatever the input
    cells = found.groupBy("cell").agg(*[F.sum(d).alias(d) for d in DIMENSIONS]).orderBy("cell").collect()
    place = pack(np.array([[c[d] for d in DIMENSIONS] for c in cells], dtype=float).reshape(len(cells), len(DIMENSIONS)), shards)
    start, table = [0] * shards, []
    for cell, shard in zip(cells, place.tolist(), strict=True):
        table.append((cell["cell"], shard, start[shard], -(-cell["n_rows"] // SLOT_ROWS)))
        start[shard] += cell["n_rows"]
    where = F.broadcast(spark.createDataFrame(table, "at long, shard int, start long, parts long"))
    dealt = found.join(where, F.col("cell") == F.col("at")).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")))
    sizes = dealt.groupBy("cell", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("cell").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("cell", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    place_in_part = F.row_number().over(Window.partitionBy("cell", "part").orderBy("row")) - 1
    counted = dealt.join(before, ["cell", "part"]).withColumn("slot", (F.col("start") + F.col("before") + place_in_part).cast("long"))
    return counted.select(*rows.columns, "shard", "slot")


def shard_rows(docs: DataFrame, shards: int = 40, **options) -> DataFrame:
    """Per row of (doc_id, text): bytes, tokens, text_crc32, shard, slot."""
    rows = checkpointed(measured(docs).withColumn("row", F.monotonically_increasing_id()))
    return assign(rows, shards, **options).select("doc_id", "bytes", "tokens", "text_crc32", "shard", "slot")


def sharded_documents(docs: DataFrame, shards: int = 40, **options) -> DataFrame:
    """The columns of `docs` with shard and slot."""
    columns = [c for c in docs.columns if c not in ("shard", "slot")]
    kept = checkpointed(docs.select(*[F.col(f"`{c}`").alias(f"keep {c}") for c in columns], F.monotonically_increasing_id().alias("row")))
    rows = checkpointed(measured(kept.select("row", F.col("keep doc_id").alias("doc_id"), F.col("keep text").alias("text")), "row"))
    found = assign(rows, shards, **options).select("row", "shard", "slot")
    return kept.join(found, "row").select(*[F.col(f"`keep {c}`").alias(c) for c in columns], "shard", "slot")
