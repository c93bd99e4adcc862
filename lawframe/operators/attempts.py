"""Attempt logs: the row that counts, what is still to do, and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawframe.operators.similar import nearest

#: Fixed values, in report order.
BUCKETS = ("exact", "correct-swapped", "correct-dualized", "wrong", "unparseable", "api-error")
CORRECT = BUCKETS[:3]
API_ERROR = "api-error"
#: Tokens of an empty reasoning block.
IDLE_TOKENS = 16


def is_correct(bucket: Column) -> Column:
    return bucket.isin(*CORRECT)


def graded(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("bucket") != API_ERROR)


def latest_graded(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the last graded attempt by seq; the first one where none is graded.

    An aggregate rather than a window, so that each task keeps one row per key
    before anything is shuffled.
    """
    good = F.col("bucket") != API_ERROR
    order = F.struct(good, F.when(good, F.col("seq")).otherwise(-F.col("seq")))
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), order).alias("row"))
    return best.select(*keys, "row.*").select(*rows.columns)


#: Names in a block of a list that all rows meet, and blocks up to which the list is broadcast.
BLOCK = 1000
BROADCAST_BLOCKS = 100


def with_every(rows: DataFrame, names: DataFrame, name: str) -> DataFrame:
    """Rows with each of the names, a list that is asked for: blocks of about `BLOCK` names meet all rows, a block at a time.

    A list of up to `BROADCAST_BLOCKS` blocks, by its count, goes to all tasks, so that rows stay where they are.
    """
    listed = names.select(name).where(F.col(name).isNotNull()).distinct()
    blocks = max(1, -(-listed.count() // BLOCK))
    packed = listed.groupBy(F.pmod(F.xxhash64(name), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list(name).alias("names"))
    packed = F.broadcast(packed) if blocks <= BROADCAST_BLOCKS else packed
    met = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(packed, "block")
    return met.withColumn(name, F.explode("names")).drop("block", "names")


def pending_tasks(samples: DataFrame, models: DataFrame, results: DataFrame) -> DataFrame:
    """Tasks (pair_id, model) of the requested models without a graded result."""
    tasks = with_every(samples.select("pair_id").distinct(), models, "model")
    done = graded(results).select("pair_id", "model").distinct()
    return tasks.join(done, ["pair_id", "model"], "left_anti")


def discover_runs(runs: DataFrame, keys: list[str], regime: str = "regime") -> DataFrame:
    """Runs (keys, run), one for each key; ValueError names keys that have several, and regimes that are neither on nor off."""
    by_key = runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("run").alias("first"), F.max("run").alias("last"))
    wrong = by_key.where((F.col("n") > 1) | ~F.coalesce(F.col(regime).isin("on", "off"), F.lit(False))).limit(20).collect()  # for the message
    if wrong:
        raise ValueError("; ".join(f"{tuple(r[k] for k in keys)}: {r['n']} runs, {r['first']} to {r['last']}" for r in wrong))
    return by_key.select(*keys, F.col("first").alias("run"))


def missing_evaluations(expected: DataFrame, results: DataFrame, group: list[str]) -> DataFrame:
    """(group, missing): expected (group, pair_id, model) without a graded row."""
    done = graded(results).select(*group, "pair_id", "model").distinct()
    return expected.join(done, [*group, "pair_id", "model"], "left_anti").groupBy(*group).agg(F.count(F.lit(1)).alias("missing"))


def with_pairs(results: DataFrame, pairs: DataFrame) -> DataFrame:
    """Results whose pair survived a filter of the samples."""
    return results.join(pairs.select("pair_id").distinct(), "pair_id", "left_semi")


def regime_violations(rows: DataFrame) -> DataFrame:
    """Models with off-regime rows that reasoned; a second stage's tokens count where there are any."""
    tokens = [F.coalesce(F.col(c), F.lit(0)) for c in ("reasoning_tokens", "stage1_reasoning_tokens") if c in rows.columns]
    most = F.greatest(*tokens) if len(tokens) > 1 else tokens[0]
    return rows.where((F.col("regime") == "off") & (most > IDLE_TOKENS)).select("model").distinct()


def metric_bins(rows: DataFrame, metric: str) -> DataFrame:
    """Distinct values of a metric for its curve, in which 0 and null have no place."""
    return rows.select(metric).where(F.col(metric).isNotNull() & (F.col(metric) != 0)).distinct()


def with_curve(rows: DataFrame, group: list[str], metric: str, least: int = 3) -> DataFrame:
    """Rows of groups whose curve has enough bins."""
    bins = rows.where(F.col(metric) != 0).groupBy(*group).agg(F.countDistinct(metric).alias("bins")).where(F.col("bins") >= least)
    return rows.join(bins.drop("bins"), group, "left_semi")


def unknown_keys(requested: DataFrame, catalog: DataFrame, least: float = 0.4, most: int = 3) -> DataFrame:
    """(key, nearest): requested keys that the catalog lacks, with its most similar names, ties by name; see `similar`."""
    lacking = requested.select("key").distinct().join(catalog.select("key"), "key", "left_anti")
    near = nearest(lacking, catalog.select(F.col("key").alias("name")), least, most)
    best = near.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rank", "name"))).alias("found"))
    joined = lacking.join(best, "key", "left")
    return joined.select("key", F.coalesce(F.array_join(F.transform("found", lambda x: x["name"]), ","), F.lit("")).alias("nearest"))
