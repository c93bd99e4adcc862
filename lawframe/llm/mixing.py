"""Mixing sources to target weights.

Every row gets a hash-random key. Rows are sorted by that key within key
ranges of their source, token counts are summed up over the ranges (one
total per range, then running totals over blocks of ranges, over the ranges of
a block, and inside each range), and each source is
cut at its exact budget. Whole epochs come before the cut.

Only (source, key, size) is shuffled, never texts. A hot source has more key
ranges, so no range holds more than about `range_rows` rows.

Defined results: a null text has size 0; a null source is a source of its
own, after all others; a source of size 0 has target 0 and takes nothing; an
empty table gives an empty result; repeated rows at the cut share what is
left equally, rounding down. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lawframe.llm.common import checkpointed, small

#: The weights that sources get in turn, and the highest multiple of a source.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
WORD = r"[^\x20\x09-\x0D]+"
RANGE_ROWS = 2_000
#: Ranges whose totals are summed up in one task.
BLOCK_RANGES = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(doc_id: Column, seed: str) -> Column:
    """Hex digits that depend on seed and id alone, so that reruns agree."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, n_rows, target) of rows (source, size).

    Resharing the excess by weight until no source is above its limit ends at
    target = min(limit, level * weight) for one level. Sources in the order of
    limit / weight are at their limit up to some point; the level follows from
    sums over that order. One row per source takes part.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    limit = F.col("source_size").cast("double") * max_epochs
    found = total.withColumn("weight", weight).withColumn("most", limit).withColumn("ratio", F.col("most") / F.col("weight"))
    order = Window.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    spent = F.coalesce(F.sum("most").over(before), F.lit(0.0))
    everything = F.sum("source_size").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    found = found.withColumn("level", (everything - spent) / rest)
    # the level falls short of a source's ratio from the first source on that is not at its limit
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(
        Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    share = F.coalesce(level["level"] * F.col("weight"), F.col("most"))
    return found.select("source", "source_size", "n_rows", F.least(F.col("most"), share).alias("target"))


def cut_points(sizes: DataFrame, targets: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Per source: whole epochs, and the key at which the last epoch stops.

    Rows before `cut_key` are taken once more whole; rows at it share `cut_rest`
    words (`cut_rows` rows in all). Input: (source, key, size).
    """
    plan = targets.select(
        "source",
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("epochs"),
        F.greatest(F.lit(1), F.ceil(F.col("n_rows") / range_rows)).cast("long").alias("ranges"),
    ).withColumn("budget", F.floor("target").cast("long") - F.col("epochs") * F.col("source_size"))
    slot = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / 4294967296.0 * F.col("ranges")).cast("long")
    same = F.col("s.source").eqNullSafe(F.col("p.source"))
    ranged = (
        sizes.alias("s")
        .join(plan.alias("p"), same)
        .select("s.source", "s.key", "s.size", "p.budget", slot.alias("slot"))
        .groupBy("source", "slot", "key")
        .agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.first("budget").alias("budget"))
    )
    per_range = ranged.groupBy("source", "slot").agg(F.sum("size").alias("range_size")).withColumn("block", F.floor(F.col("slot") / BLOCK_RANGES))
    earlier = (Window.unboundedPreceding, -1)
    # blocks of a source, then the ranges of a block: no task has all ranges of a hot source
    blocks = per_range.groupBy("source", "block").agg(F.sum("range_size").alias("block_size"))
    by_source, by_block = Window.partitionBy("source").orderBy("block").rowsBetween(*earlier), Window.partitionBy("source", "block").orderBy("slot").rowsBetween(*earlier)
    blocks = blocks.select(F.col("source").alias("of"), F.col("block").alias("in"), F.coalesce(F.sum("block_size").over(by_source), F.lit(0)).alias("before_block"))
    placed = per_range.withColumn("in_block", F.coalesce(F.sum("range_size").over(by_block), F.lit(0)))
    offsets = placed.join(blocks, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("in"))).select(
        "source", "slot", (F.col("before_block") + F.col("in_block")).alias("before_range")
    )
    within = Window.partitionBy("source", "slot").orderBy("key")
    running = ranged.withColumn("before", F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    o = offsets.alias("o")
    r = running.alias("r")
    prefix = r.join(o, F.col("r.source").eqNullSafe(F.col("o.source")) & (F.col("r.slot") == F.col("o.slot"))).select(
        "r.source", "r.key", "r.size", "r.n", "r.budget", (F.col("o.before_range") + F.col("r.before")).alias("before")
    )
    crossing = prefix.where((F.col("before") <= F.col("budget")) & (F.col("before") + F.col("size") > F.col("budget")))
    cut = crossing.groupBy("source").agg(
        F.min("key").alias("cut_key"),
        F.min_by(F.col("budget") - F.col("before"), "key").alias("cut_rest"),
        F.min_by("n", "key").alias("cut_rows"),
    )
    p = plan.alias("p")
    c = cut.alias("c")
    return p.join(c, F.col("p.source").eqNullSafe(F.col("c.source")), "left").select(
        "p.source", "p.source_size", "p.target", "p.epochs", "c.cut_key", "c.cut_rest", "c.cut_rows"
    )


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: str = "mix",
    range_rows: int = RANGE_ROWS,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Per row of (doc_id, text, source): size, source_size, target, taken, and the columns in `keep`.

    With `keep`, the texts are read once more and decided where they are read;
    without, everything follows from the small table of sizes.
    """
    key = random_key(F.col("doc_id"), seed)
    sized = checkpointed(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key")))
    targets = small(source_targets(sized, weights, max_epochs))
    cuts = small(cut_points(sized.select("source", "key", "size"), targets, range_rows))
    if keep:
        full = docs.select(
            "doc_id",
            F.col("source").alias("src"),
            word_count(F.col("text")).alias("size"),
            key.alias("key"),
            *[F.col(f"`{c}`").alias(f"keep {c}") for c in keep],
        )
    else:
        full = sized.withColumnRenamed("source", "src")
    more = (
        F.when(F.col("cut_key").isNull() | (F.col("key") > F.col("cut_key")), F.lit(0))
        .when(F.col("key") < F.col("cut_key"), F.col("size"))
        .otherwise(F.least(F.col("size"), F.floor(F.col("cut_rest") / F.col("cut_rows"))))
    )
    return full.join(cuts, F.col("src").eqNullSafe(F.col("source"))).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("epochs") * F.col("size") + more).cast("long").alias("taken"),
        *[F.col(f"`keep {c}`") for c in keep],
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row as often as comes nearest to its taken words, with the columns of `docs`.

    A document without words costs nothing and stays once.
    """
    mixed = mix(docs, keep=tuple(docs.columns), **options)
    copies = F.when(F.col("size") > 0, F.floor((F.col("taken") * 2 + F.col("size")) / (F.col("size") * 2))).otherwise(1)
    return (
        mixed.withColumn("copies", copies.cast("int"))
        .where("copies > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .select(*[F.col(f"`keep {c}`").alias(c) for c in docs.columns])
    )
