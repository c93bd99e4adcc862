"""Verdict counts, rates and curves per model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawframe.operators.attempts import API_ERROR, BUCKETS, CORRECT, is_correct


def _count(condition: Column) -> Column:
    return F.count_if(condition)


def model_summary(rows: DataFrame, models: DataFrame) -> DataFrame:
    """One row per requested model, with zeros where it has no rows."""
    bucket = F.col("bucket")
    length = F.length("response")
    tokens = F.col("reasoning_tokens")
    sums = rows.groupBy("model").agg(
        *[_count(bucket == b).alias(b) for b in BUCKETS],
        F.median(F.when(length > 0, length)).alias("length"),
        _count(F.coalesce(tokens, F.lit(0)) != 0).alias("rows_with_reasoning"),
        F.median(F.when(tokens != 0, tokens)).alias("tokens"),
    )
    return _told(sums, models)


def _told(sums: DataFrame, models: DataFrame) -> DataFrame:
    """The summary of (model, a count for each bucket, length, rows_with_reasoning, tokens), for every requested model."""
    zero = F.lit(0).cast("long")
    joined = models.select("model").distinct().join(sums, "model", "left").na.fill(0, [*BUCKETS, "rows_with_reasoning"])
    good = sum((F.col(f"`{b}`") for b in CORRECT), zero)
    all_graded = sum((F.col(f"`{b}`") for b in BUCKETS if b != API_ERROR), zero)
    return joined.select(
        "model",
        *[F.col(f"`{b}`").alias(b.replace("-", "_")) for b in BUCKETS],
        all_graded.alias("graded"),
        F.try_divide(good, all_graded).alias("correct_rate"),
        F.try_divide(F.col("exact"), all_graded).alias("exact_rate"),
        F.col("length").cast("long").alias("median_response_len"),
        "rows_with_reasoning",
        F.coalesce(F.col("tokens").cast("long"), zero).alias("median_reasoning_tokens"),
    )


TOTALS = "model string, kind string, value bigint, n bigint"


def added_up(counts: DataFrame) -> DataFrame:
    return counts.groupBy("model", "kind", "value").agg(F.sum("n").alias("n")).where("n <> 0")


def summary_counts(rows: DataFrame) -> DataFrame:
    """(model, kind, value, n): what a summary is made of, in counts that add up, also negative ones.

    By kind: the rows of each bucket (value null), and histograms of the lengths of responses and of reasoning tokens.
    """
    tokens = F.col("reasoning_tokens").cast("long")
    length = F.length("response").cast("long")
    none = F.lit(None).cast("long")
    told = [F.struct(F.col("bucket").alias("kind"), none.alias("value")), F.when(length > 0, F.struct(F.lit("length").alias("kind"), length.alias("value"))), F.when(tokens != 0, F.struct(F.lit("tokens").alias("kind"), tokens.alias("value")))]
    each = rows.select("model", F.explode(F.array_compact(F.array(*told))).alias("t"))
    return each.groupBy("model", F.col("t.kind").alias("kind"), F.col("t.value").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def summary_from_counts(counts: DataFrame, models: DataFrame) -> DataFrame:
    """model_summary from counts; a median is the mean of the values at the two middle places of a histogram."""
    from pyspark.sql import Window

    by = ["model", "kind"]
    # distinct values of a model and kind, not rows
    running = counts.withColumns({"upto": F.sum("n").over(Window.partitionBy(*by).orderBy("value")), "all": F.sum("n").over(Window.partitionBy(*by))})
    low, high = [F.min(F.when(F.col("upto") >= F.floor((F.col("all") + k) / 2), F.col("value"))) for k in (1, 2)]
    each = running.groupBy(*by).agg(F.max("all").alias("n"), ((low + high) / 2).alias("median"))
    kind = F.col("kind")
    sums = each.groupBy("model").agg(
        *[F.coalesce(F.max(F.when(kind == b, F.col("n"))), F.lit(0)).alias(b) for b in BUCKETS],
        F.max(F.when(kind == "length", F.col("median"))).alias("length"),
        F.coalesce(F.max(F.when(kind == "tokens", F.col("n"))), F.lit(0)).alias("rows_with_reasoning"),
        F.max(F.when(kind == "tokens", F.col("median"))).alias("tokens"),
    )
    return _told(sums, models)


def fmt_pct(ratio: Column, digits: int = 1) -> Column:
    """A ratio in percent, `-` for null."""
    return fmt_number(ratio * 100, digits)


def fmt_number(value: Column, digits: int = 3) -> Column:
    """A number with so many digits, `-` for null; ties go to the even digit."""
    return F.when(value.isNull(), "-").otherwise(F.format_string(f"%.{digits}f", F.bround(value, digits)))


def summary_table(summary: DataFrame) -> DataFrame:
    """(model, line): a report line per model, rates with one decimal place, `-` where there is none."""
    cells = ["model", *[b.replace("-", "_") for b in BUCKETS], "graded"]
    rate = fmt_pct(F.col("correct_rate"))
    parts = [*[F.col(c).cast("string") for c in cells], rate, F.col("rows_with_reasoning").cast("string"), F.col("median_reasoning_tokens").cast("string")]
    return summary.select("model", F.concat(F.lit("| "), F.concat_ws(" | ", *parts), F.lit(" |")).alias("line"))


def correct_pct(rows: DataFrame, by: list[str]) -> DataFrame:
    """Correct share of graded rows in percent, null where none is graded."""
    good = _count(is_correct(F.col("bucket")))
    return rows.groupBy(*by).agg(F.try_divide(good * 100.0, _count(F.col("bucket") != API_ERROR)).alias("correct_pct"))


def correct_pct_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """Correct share of all rows, failed calls among them, in percent; 0 where there are none."""
    return rows.groupBy(*by).agg(F.coalesce(F.try_divide(_count(is_correct(F.col("bucket"))) * 100.0, F.count("bucket")), F.lit(0.0)).alias("correct_pct"))


def bucket_counts(rows: DataFrame, models: DataFrame) -> DataFrame:
    """(model, bucket, n) for every requested model and bucket."""
    sums = rows.groupBy("model").agg(*[_count(F.col("bucket") == b).alias(b) for b in BUCKETS])
    joined = models.select("model").distinct().join(sums, "model", "left").na.fill(0)
    return joined.unpivot("model", [F.col(f"`{b}`") for b in BUCKETS], "bucket", "n")


def accuracy_by_metric(rows: DataFrame, metric: str) -> DataFrame:
    """(metric, value, correct_pct) pooled over models, without zero and null bins."""
    found = correct_pct(rows.where(F.col(metric).isNotNull() & (F.col(metric) != 0)), [metric])
    return found.select(F.lit(metric).alias("metric"), F.col(metric).alias("value"), "correct_pct")


def report_tiles(rows: DataFrame, run: list[str]) -> DataFrame:
    good = _count(is_correct(F.col("bucket")))
    all_graded = _count(F.col("bucket") != API_ERROR)
    return rows.agg(
        F.countDistinct(*run).alias("runs"),
        F.countDistinct("model").alias("models"),
        F.countDistinct("pair_id").alias("pairs"),
        all_graded.alias("graded"),
        F.try_divide(good * 100.0, all_graded).alias("correct_pct"),
    )


def run_sketches(rows: DataFrame, run: list[str], precision: int = 12) -> DataFrame:
    """Per run its counts and sketches of its models and pairs, to be kept and united later; sketches of overlapping runs add up."""
    found = rows.groupBy(*run).agg(
        F.hll_sketch_agg("model", precision).alias("models"),
        F.hll_sketch_agg("pair_id", precision).alias("pairs"),
        _count(F.col("bucket") != API_ERROR).alias("graded"),
        _count(is_correct(F.col("bucket"))).alias("good"),
    )
    return found


def tiles_of_sketches(sketches: DataFrame, run: list[str]) -> DataFrame:
    """report_tiles from the runs' sketches: models and pairs are estimates, with a standard error of 1.04 / sqrt(2^precision)."""
    return sketches.agg(
        F.countDistinct(*run).alias("runs"),
        F.hll_sketch_estimate(F.hll_union_agg("models")).alias("models"),
        F.hll_sketch_estimate(F.hll_union_agg("pairs")).alias("pairs"),
        F.sum("graded").alias("graded"),
        F.try_divide(F.sum("good") * 100.0, F.sum("graded")).alias("correct_pct"),
    )


def group_runs_by_pairset(rows: DataFrame, run: list[str], seen: str | None = None) -> DataFrame:
    """Runs with `pairs` and `experiment`, the first run that covers the same set of pairs: by name, or by the least of `seen`.

    A set is told by the number of its pairs and two sums of hashes over it,
    which add up in parallel, so that no set is gathered in one place.
    """
    distinct = rows.groupBy(*run, "pair_id").agg(F.min(seen if seen else F.lit(0)).alias("seen"))
    name = F.concat_ws("/", *run)
    marks = [F.sum(F.xxhash64("pair_id", F.lit(i)).cast("decimal(38,0)")).alias(f"mark{i}") for i in (1, 2)]
    sets = distinct.groupBy(*run).agg(F.count(F.lit(1)).alias("pairs"), F.min("seen").alias("seen"), *marks).withColumn("run", name)
    first = sets.groupBy("pairs", "mark1", "mark2").agg(F.min_by("run", F.struct("seen", "run")).alias("experiment"))
    return sets.join(first, ["pairs", "mark1", "mark2"]).select("run", "pairs", "experiment")


def usage_rollup(rows: DataFrame, by: list[str], cost: str, split: Column | None = None) -> DataFrame:
    """Costs, tokens and failures; with `split`, whether a row's text was split into its sections, also graded rows of which it wasn't."""
    failed = F.col("bucket") == API_ERROR
    more = [] if split is None else [_count(~failed & ~F.coalesce(split, F.lit(False))).alias("split_failures")]
    return rows.groupBy(*by).agg(
        F.sum(F.coalesce(F.col(cost), F.lit(0.0))).alias("cost"),
        F.sum(F.coalesce(F.col("reasoning_tokens"), F.lit(0))).alias("tokens"),
        _count(failed).alias("error_rows"),
        *more,
        F.count(F.lit(1)).alias("n_rows"),
    )


def macro_mean(rows: DataFrame, by: list[str]) -> DataFrame:
    """The unweighted mean of the models' rates beside the pooled rate, in percent."""
    good, n = _count(is_correct(F.col("bucket"))), _count(F.col("bucket") != API_ERROR)
    each = rows.groupBy(*by, "model").agg(good.alias("good"), n.alias("n"))
    return each.groupBy(*by).agg(
        F.avg(F.try_divide(F.col("good") * 100.0, F.col("n"))).alias("macro_pct"), F.try_divide(F.sum("good") * 100.0, F.sum("n")).alias("pooled_pct")
    )


def finish_mix(rows: DataFrame, bin_column: str, reason: str) -> DataFrame:
    """(bin, reason, unparseable, unparseable_rate): unparseable rows by how the answer ended, and their share of the bin's rows."""
    lost = F.col("bucket") == "unparseable"
    each = rows.groupBy(bin_column, reason).agg(_count(lost).alias("unparseable"), F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window

    total = F.sum("n").over(Window.partitionBy(bin_column))
    return each.select(F.col(bin_column).alias("bin"), F.col(reason).alias("reason"), "unparseable", F.try_divide(F.col("unparseable"), total).alias("unparseable_rate"))


def depth_boxplot(rows: DataFrame, metric: str = "depth") -> DataFrame:
    """(model, low, q1, median, q3, high) of a model's accuracies over the metric."""
    each = correct_pct(rows.where(F.col(metric).isNotNull()), ["model", metric]).where("correct_pct is not null")
    q = F.percentile("correct_pct", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    found = each.groupBy("model").agg(F.min("correct_pct").alias("low"), q.alias("q"), F.max("correct_pct").alias("high"))
    return found.select("model", "low", *[F.get("q", i).alias(n) for i, n in enumerate(("q1", "median", "q3"))], "high")


def pivot_conditions(rows: DataFrame, conditions: list[str], by: str = "regime") -> DataFrame:
    """Per model a column of correct percent for each condition, and `delta` of the last against the first."""
    wide = correct_pct(rows, ["model", by]).groupBy("model").pivot(by, conditions).agg(F.first("correct_pct"))
    names = [F.col(f"`{c}`").alias(f"pct_{c}".replace("-", "_")) for c in conditions]
    return wide.select("model", *names, (F.col(f"`{conditions[-1]}`") - F.col(f"`{conditions[0]}`")).alias("delta"))
