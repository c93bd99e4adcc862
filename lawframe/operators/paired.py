"""Two arms over the same pairs: observations, contingency, correlations, errors and transitions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lawframe.operators.attempts import graded, is_correct, latest_graded

#: Report order of groups and error types; others come last.
GROUP_ORDER = (("uniform", "off"), ("uniform", "on"), ("stratified", "off"), ("stratified", "on"))
ERROR_ORDER = ("assume_wrong_only", "ask_wrong_only", "both_wrong", "inconsistent_operation_direction", "unparseable", "grader_mismatch")


def paired_observations(story: DataFrame, literal: DataFrame, group: list[str], error_type: Column) -> DataFrame:
    """Graded rows of both arms joined on (group, pair_id, model); the error type counts only where literal is right and story wrong."""
    keys = [*group, "pair_id", "model"]
    s = graded(latest_graded(story, keys)).withColumn("error", error_type)
    s = s.select(*keys, "ops_total", F.col("bucket").alias("story_bucket"), "error")
    x = graded(latest_graded(literal, keys)).select(*keys, F.col("bucket").alias("literal_bucket"))
    story_ok, literal_ok = is_correct(F.col("story_bucket")), is_correct(F.col("literal_bucket"))
    return s.join(x, keys).select(
        *keys,
        "ops_total",
        story_ok.alias("story_correct"),
        literal_ok.alias("literal_correct"),
        "story_bucket",
        "literal_bucket",
        F.when(literal_ok & ~story_ok, F.col("error")).alias("story_error_type"),
    )


def _counts() -> list[Column]:
    s, x = F.col("story_correct"), F.col("literal_correct")
    cells = {"both_correct": s & x, "literal_only": ~s & x, "story_only": s & ~x, "neither": ~s & ~x}
    return [F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(name) for name, c in cells.items()]]


def with_statistics(counts: DataFrame) -> DataFrame:
    """Accuracies, conditional rates, their difference and phi of 2 x 2 counts; null on a zero denominator."""
    both, x, s, neither = (F.col(c) for c in ("both_correct", "literal_only", "story_only", "neither"))
    right, wrong = F.try_divide(both, both + x), F.try_divide(s, s + neither)
    product = (both + x).cast("double") * (s + neither) * (both + s) * (x + neither)
    return counts.withColumns(
        {
            "story_accuracy": F.try_divide(both + s, F.col("n")),
            "literal_accuracy": F.try_divide(both + x, F.col("n")),
            "literal_correct_n": both + x,
            "literal_wrong_n": s + neither,
            "p_story_given_literal_correct": right,
            "p_story_given_literal_wrong": wrong,
            "risk_difference": right - wrong,
            "phi": F.try_divide((both * neither - x * s).cast("double"), F.sqrt(product)),
        }
    )


def contingency(observations: DataFrame, by: list[str]) -> DataFrame:
    return with_statistics(observations.groupBy(*by).agg(*_counts()))


def grouped_contingency(observations: DataFrame, group: list[str], extra: tuple[str, ...] = ("model", "ops_total")) -> DataFrame:
    """The contingency of each group, and of the group by each extra column, in one pass over narrow rows."""
    narrow = observations.select(*group, *extra, "story_correct", "literal_correct")
    sets = [[F.col(c) for c in group], *[[*(F.col(c) for c in group), F.col(e)] for e in extra]]
    wide = narrow.groupingSets(sets, *group, *extra).agg(*_counts(), *[F.grouping(e).alias(f"without {e}") for e in extra])
    level = F.coalesce(*[F.when(F.col(f"without {e}") == 0, F.lit(e)) for e in extra], F.lit("group")).alias("level")
    return with_statistics(wide.select(level, *group, *extra, "n", "both_correct", "literal_only", "story_only", "neither"))


def error_taxonomy(observations: DataFrame, group: list[str]) -> DataFrame:
    """(group, error_type, count, share, pair_n): shares of a group's classified errors; pair_n counts pairs of all its observations."""
    pairs = observations.groupBy(*group).agg(F.countDistinct("pair_id").alias("pair_n"))
    counts = observations.where("story_error_type is not null").groupBy(*group, F.col("story_error_type").alias("error_type")).agg(F.count(F.lit(1)).alias("count"))
    share = F.col("count") / F.sum("count").over(Window.partitionBy(*group))
    return counts.withColumn("share", share).join(pairs, group)


def pearson(a: Column, b: Column) -> Column:
    """An aggregate: null for fewer than two rows or without variance."""
    return F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))


def average_ranks(rows: DataFrame, value: str, group: list[str], name: str) -> DataFrame:
    """Ranks from 1 within a group, ties averaged; rows are counted per value first, and only distinct values of a group meet."""
    columns = [*group, value]
    ties = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("ties of value"))
    upto = F.sum("ties of value").over(Window.partitionBy(*group).orderBy(value))
    ranks = ties.select(*[F.col(c).alias(f"of {c}") for c in columns], (upto - (F.col("ties of value") - 1) / 2.0).cast("double").alias(name))
    same = [F.col(c).eqNullSafe(F.col(f"of {c}")) for c in columns]
    return rows.join(ranks, same).drop(*[f"of {c}" for c in columns])


def model_correlations(by_model: DataFrame, group: list[str]) -> DataFrame:
    """(group, model_n, model_pearson, model_spearman) over the models' two accuracies."""
    ranked = average_ranks(average_ranks(by_model, "story_accuracy", group, "story_rank"), "literal_accuracy", group, "literal_rank")
    return ranked.groupBy(*group).agg(
        F.count(F.lit(1)).alias("model_n"),
        pearson(F.col("story_accuracy"), F.col("literal_accuracy")).alias("model_pearson"),
        pearson(F.col("story_rank"), F.col("literal_rank")).alias("model_spearman"),
    )


#: Complexity bands by total operations.
BANDS = (("low", 1, 3), ("high", 4, 8))


def transitions(a: DataFrame, b: DataFrame, keys: list[str], by: list[str], bands: str | None = None, vacuous: DataFrame | None = None) -> DataFrame:
    """Both, rescued, lost, neither and net from arm a to arm b, with accuracies: overall and for each column in `by`.

    `bands` names a column of operations by which rows are also grouped into complexity bands, those
    outside of any aside. Pairs in `vacuous` (pair_id), those with a law without operations, are left out.
    """
    own = [*by, *([bands] if bands and bands not in by else [])]
    left = graded(latest_graded(a, keys)).select(*keys, *[c for c in own if c not in keys], is_correct(F.col("bucket")).alias("was"))
    if vacuous is not None:
        left = left.join(vacuous.select("pair_id").distinct(), "pair_id", "left_anti")
    right = graded(latest_graded(b, keys)).select(*keys, is_correct(F.col("bucket")).alias("now"))
    was, now = F.col("was"), F.col("now")
    cells = {"both": was & now, "rescued": ~was & now, "lost": was & ~now, "neither": ~was & ~now}
    joined, levels = left.join(right, keys), list(by)
    if bands:
        joined = joined.withColumn("band", F.coalesce(*[F.when(F.col(bands).between(low, high), F.lit(name)) for name, low, high in BANDS]))
        levels.append("band")
    wide = joined.select(*levels, was, now).groupingSets([[], *[[F.col(c)] for c in levels]], *levels).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(n) for n, c in cells.items()], *[F.grouping(c).alias(f"without {c}") for c in levels]
    )
    if bands:  # a group of rows outside of any band is none
        wide = wide.where((F.col("without band") == 1) | F.col("band").isNotNull())
    level = F.coalesce(*[F.when(F.col(f"without {c}") == 0, F.lit(c)) for c in levels], F.lit("overall"))
    value = F.coalesce(*[F.col(c).cast("string") for c in levels], F.lit("all"))
    return wide.select(
        level.alias("level"),
        value.alias("value"),
        "n",
        *cells,
        (F.col("rescued") - F.col("lost")).alias("net"),
        F.try_divide(F.col("both") + F.col("lost"), F.col("n")).alias("accuracy_before"),
        F.try_divide(F.col("both") + F.col("rescued"), F.col("n")).alias("accuracy_after"),
    )


#: Twice the standard deviations below the mean of a binomial at one half beyond which its terms vanish, and terms that are always added up.
TAIL, LEAST_TERMS = 7, 50


def _stirling(x: Column) -> Column:
    """log x! less Stirling's formula for it, x a whole number: exact up to 15, then its series."""
    x = x.cast("double")
    small = F.log(F.factorial(F.least(x, F.lit(15)).cast("int")).cast("double")) - (x + 0.5) * F.log(F.greatest(x, F.lit(1.0))) + x - 0.5 * math.log(2 * math.pi)
    square = x * x
    return F.when(x <= 15, small).otherwise((1 / 12 - (1 / 360 - (1 / 1260 - 1 / (square * 1680)) / square) / square) / x)


def log_binomial(n: Column, k: Column) -> Column:
    """log of the chance of k of n at one half, without the cancellation of large logarithms."""
    n, k = n.cast("double"), k.cast("double")
    d = 1 - k * 2 / n
    body = 0.5 * F.log(n / (k * (n - k) * (2 * math.pi))) + _stirling(n) - _stirling(k) - _stirling(n - k)
    distance = n / 2 * ((1 - d) * F.log1p(-d) + (1 + d) * F.log1p(d))
    return F.when((k <= 0) | (k >= n), -n * math.log(2)).otherwise(body - distance)


def sign_test_p(gained: Column, lost: Column) -> Column:
    """Two-sided sign test: twice the lower binomial tail at one half, one at most.

    The tail is its largest term times a sum of ratios, which vanish within a number of terms that
    grows with the square root of the counts.
    """
    n, k = gained + lost, F.least(gained, lost).cast("long")
    terms = F.least(k, (F.ceil(F.sqrt(n.cast("double")) * TAIL) + LEAST_TERMS).cast("long"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    x, y = k.cast("double"), (n - k).cast("double")

    def step(s: Column, i: Column) -> Column:
        now = s["term"] * (x - i + 1) / (y + i)
        return F.struct(now.alias("term"), (s["total"] + now).alias("total"))

    places = F.when(terms > 0, F.sequence(F.lit(1).cast("long"), terms)).otherwise(F.array().cast("array<bigint>"))
    total = F.aggregate(places, start, step, lambda s: s["total"])
    return F.least(F.lit(1.0), F.exp(log_binomial(n, k)) * total * 2)


def sign_test(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(gained, lost, p) of arm b against arm a."""
    found = transitions(a, b, keys, [keys[-1]]).where("level = 'overall'")
    return found.select(F.col("rescued").alias("gained"), "lost", sign_test_p(F.col("rescued"), F.col("lost")).alias("p"))


def report_order(rows: DataFrame, sampling: str = "sampling", regime: str = "regime") -> Column:
    """The place of a row's group, 99 for others."""
    return F.coalesce(*[F.when((F.col(sampling) == s) & (F.col(regime) == r), i) for i, (s, r) in enumerate(GROUP_ORDER)], F.lit(99))


def error_order(error_type: Column) -> Column:
    return F.coalesce(*[F.when(error_type == e, i) for i, e in enumerate(ERROR_ORDER)], F.lit(99))
