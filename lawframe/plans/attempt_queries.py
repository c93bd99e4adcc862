"""Queries over the attempts: summaries, paired statistics and votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lawframe.functions import labels as L
from lawframe.operators import attempts as T
from lawframe.operators import paired, summary, voting
from lawframe.operators.order import numbered
from lawframe.plans.registry import query
from lawframe.plans.views import attempts, attempts_sql, table

RUN = ["form", "regime"]
CELL = [*RUN, "pair_id", "model"]
_OK = "bucket IN ('exact', 'correct-swapped', 'correct-dualized')"
_LATEST = """, latest AS (SELECT * FROM attempts QUALIFY row_number() OVER (PARTITION BY form, regime, pair_id, model
  ORDER BY (bucket <> 'api-error') DESC, CASE WHEN bucket <> 'api-error' THEN -seq ELSE seq END) = 1)"""
_MODELS = ("m0", "m1", "m2", "m3", "m9")


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.latest_graded(attempts(spark, sf_dir), CELL)


def _models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m,) for m in _MODELS], "model string")


_MODEL_ROWS = "(VALUES ('m0'), ('m1'), ('m2'), ('m3'), ('m9')) v(model)"


@query("latest_graded", attempts_sql(_LATEST + "SELECT form, regime, pair_id, model, seq, bucket FROM latest"))
def latest_graded(spark, sf_dir):
    return _latest(spark, sf_dir).select(*CELL, "seq", "bucket")


_SUMMARY = (
    _LATEST
    + f""", sums AS (SELECT v.model, {", ".join(f"count(*) FILTER (bucket = '{b}') AS {b.replace('-', '_')}" for b in T.BUCKETS)},
  count(*) FILTER (bucket <> 'api-error') AS graded, count(*) FILTER ({_OK}) AS good,
  trunc(median(CASE WHEN length(bucket || answer_class) > 0 THEN length(bucket || answer_class) END))::BIGINT AS median_response_len,
  count(*) FILTER (reasoning_tokens <> 0) AS rows_with_reasoning,
  coalesce(trunc(median(CASE WHEN reasoning_tokens <> 0 THEN reasoning_tokens END))::BIGINT, 0) AS median_reasoning_tokens
  FROM {_MODEL_ROWS} LEFT JOIN latest USING (model) GROUP BY v.model)"""
)


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _latest(spark, sf_dir).withColumn("response", F.concat("bucket", "answer_class"))
    return summary.model_summary(rows, _models(spark))


@query(
    "model_summary",
    attempts_sql(
        _SUMMARY
        + """SELECT model, exact, correct_swapped, correct_dualized, wrong, unparseable, api_error, graded, good / nullif(graded, 0) AS correct_rate, exact / nullif(graded, 0) AS exact_rate,
  median_response_len, rows_with_reasoning, median_reasoning_tokens FROM sums"""
    ),
)
def model_summary(spark, sf_dir):
    return _summary(spark, sf_dir)


@query(
    "summary_table",
    attempts_sql(
        _SUMMARY
        + """SELECT model, '| ' || concat_ws(' | ', model, exact, correct_swapped, correct_dualized, wrong, unparseable, api_error, graded,
  coalesce(printf('%.1f', 100 * (good / nullif(graded, 0))), '-'), rows_with_reasoning, median_reasoning_tokens) || ' |' AS line FROM sums"""
    ),
)
def summary_table(spark, sf_dir):
    return summary.summary_table(_summary(spark, sf_dir))


@query("correct_pct", attempts_sql(f"SELECT form, regime, model, count(*) FILTER ({_OK}) * 100.0::DOUBLE / nullif(count(*) FILTER (bucket <> 'api-error'), 0) AS correct_pct FROM attempts GROUP BY ALL"))
def correct_pct(spark, sf_dir):
    return summary.correct_pct(attempts(spark, sf_dir), [*RUN, "model"])


@query("correct_pct_counts", attempts_sql(f"SELECT form, regime, model, coalesce(count(*) FILTER ({_OK}) * 100.0::DOUBLE / nullif(count(*), 0), 0) AS correct_pct FROM attempts GROUP BY ALL"))
def correct_pct_counts(spark, sf_dir):
    return summary.correct_pct_counts(attempts(spark, sf_dir), [*RUN, "model"])


_BUCKET_ROWS = "(VALUES " + ", ".join(f"('{b}')" for b in T.BUCKETS) + ") b(bucket)"


@query("bucket_counts", attempts_sql(f"SELECT v.model, b.bucket, count(a.seq) AS n FROM {_MODEL_ROWS} JOIN {_BUCKET_ROWS} ON true LEFT JOIN attempts a ON a.model = v.model AND a.bucket = b.bucket GROUP BY ALL"))
def bucket_counts(spark, sf_dir):
    return summary.bucket_counts(attempts(spark, sf_dir), _models(spark))


@query(
    "accuracy_by_metric",
    attempts_sql(
        "".join(
            f"{joint}SELECT '{m}' AS metric, {m} AS value, count(*) FILTER ({_OK}) * 100.0::DOUBLE / nullif(count(*) FILTER (bucket <> 'api-error'), 0) AS correct_pct FROM attempts WHERE {m} <> 0 GROUP BY {m}"
            for joint, m in (("", "ops_total"), (" UNION ALL ", "depth"))
        )
    ),
)
def accuracy_by_metric(spark, sf_dir):
    rows = attempts(spark, sf_dir)
    return summary.accuracy_by_metric(rows, "ops_total").unionByName(summary.accuracy_by_metric(rows, "depth"))


@query(
    "report_tiles",
    attempts_sql(
        f"SELECT count(DISTINCT form || regime) AS runs, count(DISTINCT model) AS models, count(DISTINCT pair_id) AS pairs, count(*) FILTER (bucket <> 'api-error') AS graded, count(*) FILTER ({_OK}) * 100.0::DOUBLE / nullif(count(*) FILTER (bucket <> 'api-error'), 0) AS correct_pct FROM attempts"
    ),
)
def report_tiles(spark, sf_dir):
    return summary.report_tiles(attempts(spark, sf_dir), RUN)


@query(
    "group_runs_by_pairset",
    attempts_sql(
        """, s AS (SELECT form || '/' || regime AS run, count(DISTINCT pair_id) AS pairs, string_agg(DISTINCT pair_id, ',' ORDER BY pair_id) AS ids FROM attempts GROUP BY 1)
SELECT run, pairs, min(run) OVER (PARTITION BY ids) AS experiment FROM s"""
    ),
)
def group_runs_by_pairset(spark, sf_dir):
    return summary.group_runs_by_pairset(attempts(spark, sf_dir), RUN)


@query(
    "group_runs_by_pairset_all",
    attempts_sql(
        """, s AS (SELECT form || '/' || regime AS run, count(DISTINCT pair_id) AS pairs, min(seq) AS seen, string_agg(DISTINCT pair_id, ',' ORDER BY pair_id) AS ids FROM attempts GROUP BY 1)
SELECT run, pairs, first_value(run) OVER (PARTITION BY ids ORDER BY seen, run) AS experiment FROM s"""
    ),
)
def group_runs_by_pairset_all(spark, sf_dir):
    """Experiments named by the run that was seen first."""
    return summary.group_runs_by_pairset(attempts(spark, sf_dir), RUN, seen="seq")


@query("usage_rollup", attempts_sql("SELECT form, regime, model, round(sum(coalesce(latency_s, 0)), 4) AS cost, sum(coalesce(reasoning_tokens, 0))::BIGINT AS tokens, count(*) FILTER (bucket = 'api-error') AS error_rows, count(*) FILTER (bucket <> 'api-error' AND answer_class = 'c0') AS split_failures, count(*) AS n_rows FROM attempts GROUP BY ALL"))
def usage_rollup(spark, sf_dir):
    """The text of a class is split into its sections, but for one class."""
    text = F.when(F.col("answer_class") == "c0", "no sections").otherwise(F.concat(F.lit("GRAMMAR\n"), "answer_class", F.lit("\nENCODING\n"), "bucket"))
    sections = L.split_sections(text)
    split = (F.coalesce(sections["grammar"], F.lit("")) != "") & (F.coalesce(sections["encoding"], F.lit("")) != "")
    return summary.usage_rollup(attempts(spark, sf_dir), [*RUN, "model"], "latency_s", split).withColumn("cost", F.round("cost", 4))


@query(
    "macro_mean",
    attempts_sql(
        f", e AS (SELECT form, model, count(*) FILTER ({_OK}) AS good, count(*) FILTER (bucket <> 'api-error') AS n FROM attempts GROUP BY ALL) SELECT form, avg(good * 100.0::DOUBLE / nullif(n, 0)) AS macro_pct, sum(good) * 100.0::DOUBLE / sum(n) AS pooled_pct FROM e GROUP BY form"
    ),
)
def macro_mean(spark, sf_dir):
    return summary.macro_mean(attempts(spark, sf_dir), ["form"])


@query(
    "finish_reason_mix",
    attempts_sql(
        ", e AS (SELECT ops_total AS bin, regime AS reason, count(*) FILTER (bucket = 'unparseable') AS unparseable, count(*) AS n FROM attempts GROUP BY ALL) SELECT bin, reason, unparseable, unparseable / sum(n) OVER (PARTITION BY bin) AS unparseable_rate FROM e"
    ),
)
def finish_reason_mix(spark, sf_dir):
    return summary.finish_mix(attempts(spark, sf_dir), "ops_total", "regime")


@query(
    "depth_boxplot",
    attempts_sql(
        f""", e AS (SELECT model, depth, count(*) FILTER ({_OK}) * 100.0::DOUBLE / nullif(count(*) FILTER (bucket <> 'api-error'), 0) AS p FROM attempts GROUP BY ALL)
SELECT model, min(p) AS low, quantile_cont(p, 0.25) AS q1, quantile_cont(p, 0.5) AS median, quantile_cont(p, 0.75) AS q3, max(p) AS high FROM e GROUP BY model"""
    ),
)
def depth_boxplot(spark, sf_dir):
    return summary.depth_boxplot(attempts(spark, sf_dir))


_PIVOT = f", e AS (SELECT model, regime, count(*) FILTER ({_OK}) * 100.0::DOUBLE / nullif(count(*) FILTER (bucket <> 'api-error'), 0) AS p FROM attempts GROUP BY ALL)"


@query("pivot_conditions", attempts_sql(_PIVOT + "SELECT model, max(p) FILTER (regime = 'off') AS pct_off, max(p) FILTER (regime = 'on') AS pct_on, max(p) FILTER (regime = 'on') - max(p) FILTER (regime = 'off') AS delta FROM e GROUP BY model"))
def pivot_conditions(spark, sf_dir):
    return summary.pivot_conditions(attempts(spark, sf_dir), ["off", "on"])


@query("delta_vs_baseline", attempts_sql(_PIVOT + "SELECT model, regime, p - first_value(p) OVER (PARTITION BY model ORDER BY regime) AS delta FROM e"))
def delta_vs_baseline(spark, sf_dir):
    rates = summary.correct_pct(attempts(spark, sf_dir), ["model", "regime"])
    first = F.first("correct_pct").over(Window.partitionBy("model").orderBy("regime"))
    return rates.select("model", "regime", (F.col("correct_pct") - first).alias("delta"))


@query(
    "leaderboard",
    attempts_sql(
        _PIVOT
        + ", w AS (SELECT model, max(p) FILTER (regime = 'off') AS pct_off, max(p) FILTER (regime = 'on') AS pct_on FROM e GROUP BY model) SELECT model, pct_off, pct_on, row_number() OVER (ORDER BY pct_on DESC, pct_off DESC, model)::INT AS place FROM w"
    ),
)
def leaderboard(spark, sf_dir):
    wide = summary.pivot_conditions(attempts(spark, sf_dir), ["off", "on"]).drop("delta")
    place = F.row_number().over(Window.orderBy(F.desc("pct_on"), F.desc("pct_off"), "model"))  # one row per model
    return wide.withColumn("place", place).orderBy("place")


@query("drop_api_errors", attempts_sql("SELECT seq, bucket FROM attempts WHERE bucket <> 'api-error'"))
def drop_api_errors(spark, sf_dir):
    return T.graded(attempts(spark, sf_dir)).select("seq", "bucket")


@query("is_correct", attempts_sql(f"SELECT seq, {_OK} AS correct FROM attempts"))
def is_correct(spark, sf_dir):
    return attempts(spark, sf_dir).select("seq", T.is_correct(F.col("bucket")).alias("correct"))


@query("regime_violations", attempts_sql("SELECT DISTINCT model FROM attempts WHERE regime = 'off' AND coalesce(reasoning_tokens, 0) > 16"))
def regime_violations(spark, sf_dir):
    return T.regime_violations(attempts(spark, sf_dir)).orderBy("model")


@query("metric_bins", attempts_sql("SELECT DISTINCT reasoning_tokens FROM attempts WHERE reasoning_tokens <> 0"))
def metric_bins(spark, sf_dir):
    return T.metric_bins(attempts(spark, sf_dir), "reasoning_tokens")


@query(
    "min_bins_guard",
    attempts_sql("SELECT form, regime, pair_id, count(*) AS n FROM attempts WHERE (form, regime, pair_id) IN (SELECT (form, regime, pair_id) FROM attempts GROUP BY form, regime, pair_id HAVING count(DISTINCT pass) >= 3) GROUP BY ALL"),
)
def min_bins_guard(spark, sf_dir):
    group = [*RUN, "pair_id"]
    return T.with_curve(attempts(spark, sf_dir), group, "pass").groupBy(*group).agg(F.count(F.lit(1)).alias("n"))


@query(
    "pending_tasks",
    attempts_sql(
        f", tasks AS (SELECT DISTINCT pair_id, v.model FROM attempts JOIN {_MODEL_ROWS} ON true) SELECT pair_id, model FROM tasks WHERE (pair_id, model) NOT IN (SELECT (pair_id, model) FROM attempts WHERE bucket <> 'api-error' AND form = 'story')"
    ),
)
def pending_tasks(spark, sf_dir):
    rows = attempts(spark, sf_dir)
    return T.pending_tasks(rows, _models(spark), rows.where("form = 'story'"))


@query(
    "missing_evaluations",
    attempts_sql(
        f", tasks AS (SELECT DISTINCT a.form, a.regime, a.pair_id, m.model FROM attempts a JOIN (SELECT DISTINCT model FROM attempts) m ON true) SELECT form, regime, count(*) AS missing FROM tasks WHERE (form, regime, pair_id, model) NOT IN (SELECT (form, regime, pair_id, model) FROM attempts WHERE bucket <> 'api-error') GROUP BY ALL"
    ),
)
def missing_evaluations(spark, sf_dir):
    rows = attempts(spark, sf_dir)
    names = F.array(*[F.lit(f"m{i}") for i in range(4)])
    expected = rows.select(*RUN, "pair_id").distinct().withColumn("model", F.explode(names))
    return T.missing_evaluations(expected, rows, RUN)


@query("filter_results_by_pairs", attempts_sql("SELECT seq, pair_id FROM attempts WHERE pair_id IN (SELECT pair_id FROM attempts WHERE ops_total >= 4)"))
def filter_results_by_pairs(spark, sf_dir):
    rows = attempts(spark, sf_dir)
    return T.with_pairs(rows, rows.where("ops_total >= 4")).select("seq", "pair_id")


_OBSERVED = (
    _LATEST
    + f""", s AS (SELECT * FROM latest WHERE form = 'story' AND bucket <> 'api-error'), l AS (SELECT * FROM latest WHERE form = 'literal' AND bucket <> 'api-error'),
obs AS (SELECT 'uniform' AS sampling, s.regime, s.pair_id, s.model, s.ops_total, s.{_OK} AS story_correct, l.{_OK} AS literal_correct, s.bucket AS story_bucket, l.bucket AS literal_bucket,
  CASE WHEN l.{_OK} AND NOT s.{_OK} THEN CASE WHEN s.bucket = 'unparseable' THEN 'unparseable' WHEN s.answer_class < 'c2' THEN 'assume_wrong_only' ELSE 'both_wrong' END END AS story_error_type
  FROM s JOIN l ON s.regime = l.regime AND s.pair_id = l.pair_id AND s.model = l.model)"""
)
_GROUP = ["sampling", "regime"]


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = attempts(spark, sf_dir).withColumn("sampling", F.lit("uniform"))
    error = F.when(F.col("bucket") == "unparseable", "unparseable").when(F.col("answer_class") < "c2", "assume_wrong_only").otherwise("both_wrong")
    return paired.paired_observations(rows.where("form = 'story'"), rows.where("form = 'literal'"), _GROUP, error)


@query("paired_observations", attempts_sql(_OBSERVED + "SELECT * FROM obs"))
def paired_observations(spark, sf_dir):
    return _observations(spark, sf_dir)


_COUNTS = "count(*) AS n, count(*) FILTER (story_correct AND literal_correct) AS both_correct, count(*) FILTER (NOT story_correct AND literal_correct) AS literal_only, count(*) FILTER (story_correct AND NOT literal_correct) AS story_only, count(*) FILTER (NOT story_correct AND NOT literal_correct) AS neither"
_STATS = """(both_correct + story_only) / nullif(n, 0) AS story_accuracy, (both_correct + literal_only) / nullif(n, 0) AS literal_accuracy, both_correct + literal_only AS literal_correct_n, story_only + neither AS literal_wrong_n,
  both_correct / nullif(both_correct + literal_only, 0) AS p_story_given_literal_correct, story_only / nullif(story_only + neither, 0) AS p_story_given_literal_wrong,
  both_correct / nullif(both_correct + literal_only, 0) - story_only / nullif(story_only + neither, 0) AS risk_difference,
  (both_correct * neither - literal_only * story_only)::DOUBLE / nullif(sqrt((both_correct + literal_only)::DOUBLE * (story_only + neither) * (both_correct + story_only) * (literal_only + neither)), 0) AS phi"""


@query("contingency", attempts_sql(_OBSERVED + f", c AS (SELECT sampling, regime, {_COUNTS} FROM obs GROUP BY ALL) SELECT *, {_STATS} FROM c"))
def contingency(spark, sf_dir):
    return paired.contingency(_observations(spark, sf_dir), _GROUP)


@query(
    "grouped_contingency",
    attempts_sql(
        _OBSERVED
        + f""", c AS (SELECT CASE WHEN grouping(model) = 0 THEN 'model' WHEN grouping(ops_total) = 0 THEN 'ops_total' ELSE 'group' END AS level, sampling, regime, model, ops_total, {_COUNTS}
  FROM obs GROUP BY GROUPING SETS ((sampling, regime), (sampling, regime, model), (sampling, regime, ops_total))) SELECT *, {_STATS} FROM c"""
    ),
)
def grouped_contingency(spark, sf_dir):
    return paired.grouped_contingency(_observations(spark, sf_dir), _GROUP)


@query(
    "error_taxonomy",
    attempts_sql(
        _OBSERVED
        + """, p AS (SELECT sampling, regime, count(DISTINCT pair_id) AS pair_n FROM obs GROUP BY ALL), e AS (SELECT sampling, regime, story_error_type AS error_type, count(*) AS "count" FROM obs WHERE story_error_type IS NOT NULL GROUP BY ALL)
SELECT e.*, "count" / sum("count") OVER (PARTITION BY e.sampling, e.regime) AS share, p.pair_n FROM e JOIN p USING (sampling, regime)"""
    ),
)
def error_taxonomy(spark, sf_dir):
    return paired.error_taxonomy(_observations(spark, sf_dir), _GROUP)


@query(
    "taxonomy_order",
    attempts_sql(
        _OBSERVED
        + """SELECT sampling, regime, story_error_type AS error_type, row_number() OVER (ORDER BY CASE regime WHEN 'off' THEN 0 ELSE 1 END,
  CASE story_error_type WHEN 'assume_wrong_only' THEN 0 WHEN 'both_wrong' THEN 2 ELSE 4 END)::INT AS place FROM (SELECT DISTINCT sampling, regime, story_error_type FROM obs WHERE story_error_type IS NOT NULL)"""
    ),
)
def taxonomy_order(spark, sf_dir):
    rows = paired.error_taxonomy(_observations(spark, sf_dir), _GROUP)
    order = Window.orderBy(paired.report_order(rows), paired.error_order(F.col("error_type")))  # a few rows per group
    return rows.select(*_GROUP, "error_type", F.row_number().over(order).alias("place")).orderBy("place")


@query(
    "report_order",
    attempts_sql(
        _OBSERVED
        + """, c AS (SELECT DISTINCT sampling, regime, model, ops_total FROM obs) SELECT *, row_number() OVER (ORDER BY CASE regime WHEN 'off' THEN 0 ELSE 1 END, model, ops_total)::INT AS place FROM c"""
    ),
)
def report_order(spark, sf_dir):
    rows = _observations(spark, sf_dir).select(*_GROUP, "model", "ops_total").distinct()
    order = Window.orderBy(paired.report_order(rows), "model", F.coalesce("ops_total", F.lit(-1)))  # report rows
    return rows.withColumn("place", F.row_number().over(order)).orderBy("place")


_BY_MODEL = _OBSERVED + f", c AS (SELECT sampling, regime, model, {_COUNTS} FROM obs GROUP BY ALL), m AS (SELECT *, {_STATS} FROM c)"


@query(
    "pearson",
    attempts_sql(
        _BY_MODEL
        + "SELECT sampling, regime, round(covar_samp(story_accuracy, literal_accuracy) / nullif(stddev_samp(story_accuracy) * stddev_samp(literal_accuracy), 0), 9) AS r FROM m GROUP BY ALL"
    ),
)
def pearson(spark, sf_dir):
    by_model = paired.contingency(_observations(spark, sf_dir), [*_GROUP, "model"])
    return by_model.groupBy(*_GROUP).agg(F.round(paired.pearson(F.col("story_accuracy"), F.col("literal_accuracy")), 9).alias("r"))


_RANKS = """, r AS (SELECT *, rank() OVER (PARTITION BY sampling, regime ORDER BY story_accuracy) + (count(*) OVER (PARTITION BY sampling, regime, story_accuracy) - 1) / 2.0 AS sr,
  rank() OVER (PARTITION BY sampling, regime ORDER BY literal_accuracy) + (count(*) OVER (PARTITION BY sampling, regime, literal_accuracy) - 1) / 2.0 AS lr FROM m)"""


@query("spearman", attempts_sql(_BY_MODEL + _RANKS + "SELECT sampling, regime, count(*) AS model_n, round(covar_samp(sr, lr) / nullif(stddev_samp(sr) * stddev_samp(lr), 0), 9) AS rho FROM r GROUP BY ALL"))
def spearman(spark, sf_dir):
    by_model = paired.contingency(_observations(spark, sf_dir), [*_GROUP, "model"])
    found = paired.model_correlations(by_model, _GROUP)
    return found.select(*_GROUP, "model_n", F.round("model_spearman", 9).alias("rho"))


@query(
    "average_ranks",
    attempts_sql(f", g AS (SELECT regime, pair_id, count(*) FILTER ({_OK}) AS good FROM attempts GROUP BY ALL) SELECT regime, pair_id, (rank() OVER (PARTITION BY regime ORDER BY good) + (count(*) OVER (PARTITION BY regime, good) - 1) / 2.0)::DOUBLE AS place FROM g"),
)
def average_ranks(spark, sf_dir):
    return _average_ranks(attempts(spark, sf_dir))


@query(
    "average_ranks_all",
    attempts_sql(f", g AS (SELECT regime, pair_id, count(*) FILTER ({_OK}) AS good FROM attempts GROUP BY ALL) SELECT regime, pair_id, (rank() OVER (PARTITION BY regime ORDER BY good) + (count(*) OVER (PARTITION BY regime, good) - 1) / 2.0)::DOUBLE AS place FROM g"),
)
def average_ranks_all(spark, sf_dir):
    return _average_ranks(attempts(spark, sf_dir))


def _average_ranks(rows: DataFrame) -> DataFrame:
    good = rows.groupBy("regime", "pair_id").agg(F.count_if(T.is_correct(F.col("bucket"))).alias("good"))
    return paired.average_ranks(good, "good", ["regime"], "place").drop("good")


@query("share_of_group", attempts_sql("SELECT form, bucket, count(*) / sum(count(*)) OVER (PARTITION BY form) AS share FROM attempts GROUP BY form, bucket"))
def share_of_group(spark, sf_dir):
    counts = attempts(spark, sf_dir).groupBy("form", "bucket").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("form", "bucket", (F.col("n") / F.sum("n").over(Window.partitionBy("form"))).alias("share"))


_ARMS = _LATEST + f""", s AS (SELECT regime, pair_id, model, ops_total, {_OK} AS was FROM latest WHERE form = 'story' AND bucket <> 'api-error'), l AS (SELECT regime, pair_id, model, {_OK} AS now FROM latest WHERE form = 'two-stage' AND bucket <> 'api-error'),
j AS (SELECT * FROM s JOIN l USING (regime, pair_id, model))"""


def _arms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = attempts(spark, sf_dir)
    return rows.where("form = 'story'"), rows.where("form = 'two-stage'")


_LEVELS = """CASE WHEN grouping(model) = 0 THEN 'model' WHEN grouping(ops_total) = 0 THEN 'ops_total' WHEN grouping(band) = 0 THEN 'band' ELSE 'overall' END"""


@query(
    "paired_transitions",
    attempts_sql(
        _ARMS
        + f""", vacuous AS (SELECT DISTINCT pair_id FROM attempts WHERE depth = 1),
kinds AS (SELECT *, 'all' AS pairs, CASE WHEN ops_total BETWEEN 1 AND 3 THEN 'low' WHEN ops_total BETWEEN 4 AND 8 THEN 'high' END AS band FROM j
  UNION ALL SELECT *, 'not vacuous', CASE WHEN ops_total BETWEEN 1 AND 3 THEN 'low' WHEN ops_total BETWEEN 4 AND 8 THEN 'high' END FROM j WHERE pair_id NOT IN (SELECT pair_id FROM vacuous)),
c AS (SELECT pairs, {_LEVELS} AS level, coalesce(model, ops_total::VARCHAR, band, 'all') AS value, count(*) AS n, count(*) FILTER (was AND now) AS "both", count(*) FILTER (NOT was AND now) AS rescued, count(*) FILTER (was AND NOT now) AS lost, count(*) FILTER (NOT was AND NOT now) AS neither
  FROM kinds GROUP BY GROUPING SETS ((pairs), (pairs, model), (pairs, ops_total), (pairs, band)))
SELECT *, rescued - lost AS net, ("both" + lost) / nullif(n, 0) AS accuracy_before, ("both" + rescued) / nullif(n, 0) AS accuracy_after FROM c"""
    ),
)
def paired_transitions(spark, sf_dir):
    """All pairs, and those without a law of no operation, for which pairs of depth one stand."""
    a, b = _arms(spark, sf_dir)
    keys, by = ["regime", "pair_id", "model"], ["model", "ops_total"]
    vacuous = attempts(spark, sf_dir).where("depth = 1").select("pair_id")
    told = [paired.transitions(a, b, keys, by, bands="ops_total", vacuous=v).withColumn("pairs", F.lit(name)) for name, v in (("all", None), ("not vacuous", vacuous))]
    return told[0].unionByName(told[1])


@query(
    "sign_test",
    attempts_sql(
        _ARMS
        + """, c AS (SELECT count(*) FILTER (NOT was AND now) AS gained, count(*) FILTER (was AND NOT now) AS lost FROM j),
t AS (SELECT gained, lost, i, lgamma(gained + lost + 1) - lgamma(i + 1) - lgamma(gained + lost - i + 1) - (gained + lost) * ln(2) AS lp FROM c, range(100000) r(i) WHERE i <= least(gained, lost))
SELECT gained, lost, round(least(1.0, 2 * sum(exp(lp))), 6) AS p FROM t GROUP BY ALL"""
    ),
)
def sign_test(spark, sf_dir):
    found = paired.sign_test(*_arms(spark, sf_dir), ["regime", "pair_id", "model"])
    return found.withColumn("p", F.round("p", 6))


_PASSES = """, passes AS (SELECT * FROM attempts QUALIFY row_number() OVER (PARTITION BY pair_id, model, pass ORDER BY (bucket <> 'api-error') DESC, CASE WHEN bucket <> 'api-error' THEN -seq ELSE seq END) = 1)"""


def _vote_sql(source: str, keys: str) -> str:
    return f""", ballots AS (SELECT *, CASE WHEN bucket NOT IN ('unparseable', 'api-error') THEN answer_class END AS ballot FROM {source}),
tally AS (SELECT {keys}, ballot, count(*) AS votes, min(pass) AS first FROM ballots WHERE ballot IS NOT NULL GROUP BY ALL),
best AS (SELECT * FROM tally QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY votes DESC, first) = 1),
tops AS (SELECT {keys}, count(*) AS distinct_classes, max(votes) AS votes_for_winner, sum(votes) AS valid, count(*) FILTER (votes = m) AS at_top FROM (SELECT *, max(votes) OVER (PARTITION BY {keys}) AS m FROM tally) GROUP BY ALL),
chosen AS (SELECT b.*, t.ballot AS winner_class FROM ballots b LEFT JOIN best t USING ({keys}) WHERE t.ballot IS NULL OR b.ballot = t.ballot
  QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY CASE WHEN t.ballot IS NULL THEN (b.bucket = 'api-error')::INT ELSE 0 END, b.pass) = 1),
sizes AS (SELECT {keys}, count(*) AS k_present FROM ballots GROUP BY ALL),
votes AS (SELECT {keys}, bucket, seq, k_present::INT AS vote_k, coalesce(valid, 0)::INT AS valid_ballots, (k_present - coalesce(valid, 0))::INT AS abstentions, coalesce(votes_for_winner, 0)::INT AS votes_for_winner, coalesce(distinct_classes, 0)::INT AS distinct_classes, coalesce(at_top > 1, false) AS tie, pass AS source_pass, winner_class
  FROM chosen JOIN sizes USING ({keys}) LEFT JOIN tops USING ({keys}))"""


_VOTES = _PASSES + _vote_sql("passes", "pair_id, model")


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voting.majority_vote(voting.passes_of(attempts(spark, sf_dir)))


_VOTED = ["bucket", "seq", "vote_k", "valid_ballots", "abstentions", "votes_for_winner", "distinct_classes", "tie", "source_pass", "winner_class"]


@query("majority_vote", attempts_sql(_VOTES + "SELECT * FROM votes"))
def majority_vote(spark, sf_dir):
    return _votes(spark, sf_dir).select("pair_id", "model", *_VOTED)


@query("vote_tally", attempts_sql(_VOTES + "SELECT pair_id, model, ballot AS answer_class, votes, first AS first_pass FROM tally"))
def vote_tally(spark, sf_dir):
    passes = voting.passes_of(attempts(spark, sf_dir)).where(~F.col("bucket").isin(*voting.ABSTAIN))
    return passes.groupBy("pair_id", "model", "answer_class").agg(F.count(F.lit(1)).alias("votes"), F.min("pass").alias("first_pass"))


@query("vote_at_k", attempts_sql(_PASSES + ", upto AS (SELECT p.*, k FROM passes p JOIN (VALUES (1), (3), (5), (7)) v(k) ON p.pass <= v.k)" + _vote_sql("upto", "k, pair_id, model") + "SELECT * FROM votes"))
def vote_at_k(spark, sf_dir):
    return voting.vote_at_k(voting.passes_of(attempts(spark, sf_dir)), [1, 3, 5, 7]).select("k", "pair_id", "model", *_VOTED)


@query(
    "agreement_curve",
    attempts_sql(
        _VOTES
        + f"SELECT votes_for_winner, count(*) AS n, avg(({_OK})::INT) AS correct_rate, count(*) FILTER (valid_ballots > 0 AND votes_for_winner = vote_k) AS unanimous, count(*) FILTER (tie) AS tie_broken, count(*) FILTER (valid_ballots = 0) AS all_abstain FROM votes GROUP BY ALL"
    ),
)
def agreement_curve(spark, sf_dir):
    return voting.agreement_curve(_votes(spark, sf_dir))


@query(
    "confidence_gate",
    attempts_sql(
        _VOTES
        + f"SELECT threshold::INT AS threshold, count(*) FILTER (votes_for_winner >= threshold) AS answered, count(*) FILTER (votes_for_winner >= threshold) / count(*) AS coverage, count(*) FILTER (votes_for_winner >= threshold AND {_OK}) / nullif(count(*) FILTER (votes_for_winner >= threshold), 0) AS \"precision\" FROM votes, range(1, 8) t(threshold) GROUP BY threshold"
    ),
)
def confidence_gate(spark, sf_dir):
    return voting.confidence_gate(_votes(spark, sf_dir), list(range(1, 8)))


@query(
    "multi_pass_join",
    attempts_sql(_PASSES + "SELECT pair_id, model, string_agg(bucket, ',' ORDER BY pass) AS buckets, count(*)::INT AS present, (5 - count(*))::INT AS missing FROM passes WHERE pass <= 5 GROUP BY pair_id, model"),
)
def multi_pass_join(spark, sf_dir):
    passes = voting.passes_of(attempts(spark, sf_dir))
    return voting.multi_pass_join(passes, 5, expected=passes.where("pass <= 5"))


@query(
    "baseline_subset",
    attempts_sql(
        """, mine AS (SELECT * FROM attempts WHERE form = 'story' QUALIFY row_number() OVER (PARTITION BY pair_id, model ORDER BY (bucket <> 'api-error') DESC, CASE WHEN bucket <> 'api-error' THEN -seq ELSE seq END) = 1)
SELECT seq, pair_id, model, row_number() OVER (ORDER BY substr(pair_id, 2)::BIGINT, model DESC) AS place FROM mine WHERE pair_id IN (SELECT pair_id FROM attempts WHERE form = 'literal') AND model IN ('m0', 'm1')"""
    ),
)
def baseline_subset(spark, sf_dir):
    """The story run as baseline of two models, over the pairs that the literal run has too."""
    rows = attempts(spark, sf_dir)
    common = rows.where("form = 'story'").select("pair_id").intersect(rows.where("form = 'literal'").select("pair_id"))
    samples = common.select(F.substring("pair_id", 2, 20).cast("long").alias("place"), "pair_id", F.sha2("pair_id", 256).alias("prompt_hash"))
    baseline = T.with_pairs(T.latest_graded(rows.where("form = 'story'"), voting.KEYS), common)
    models = spark.createDataFrame([(1, "m1"), (2, "m0")], "place int, model string")
    return voting.baseline_subset(baseline, samples, samples, models).select("seq", "pair_id", "model", F.col("at").alias("place"))


@query("sample_model_order", attempts_sql("SELECT pair_id, model, row_number() OVER (ORDER BY first_seq, model)::INT AS place FROM (SELECT pair_id, model, min(min(seq)) OVER (PARTITION BY pair_id) AS first_seq FROM attempts GROUP BY pair_id, model)"))
def sample_model_order(spark, sf_dir):
    return _model_order(attempts(spark, sf_dir))


@query("sample_model_order_all", attempts_sql("SELECT pair_id, model, row_number() OVER (ORDER BY first_seq, model)::INT AS place FROM (SELECT pair_id, model, min(min(seq)) OVER (PARTITION BY pair_id) AS first_seq FROM attempts GROUP BY pair_id, model)"))
def sample_model_order_all(spark, sf_dir):
    return _model_order(attempts(spark, sf_dir))


def _model_order(rows: DataFrame) -> DataFrame:
    first = rows.groupBy("pair_id").agg(F.min("seq").alias("first_seq"))
    cells = rows.select("pair_id", "model").distinct().join(first, "pair_id")
    return numbered(cells, ["first_seq", "model", "pair_id"], "place").select("pair_id", "model", F.col("place").cast("int").alias("place"))


@query(
    "assert_same_pairs",
    attempts_sql(
        """, cells AS (SELECT DISTINCT form, regime, pair_id, model FROM attempts WHERE form <> 'two-stage'), a AS (SELECT regime, pair_id, model FROM cells WHERE form = 'story'), b AS (SELECT regime, pair_id, model FROM cells WHERE form = 'literal')
SELECT regime, pair_id, model, 'a' AS only_in FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT regime, pair_id, model, 'b' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)"""
    ),
)
def assert_same_pairs(spark, sf_dir):
    """Where the story and the literal runs differ, by regime, pair and model."""
    a, b = (attempts(spark, sf_dir).where(F.col("form") == f) for f in ("story", "literal"))
    return voting.coverage_differences(a, b, ["regime", "pair_id", "model"])


_PASS_SAMPLES = """, sampled AS (SELECT DISTINCT pass, pair_id, substr(pair_id, 2)::BIGINT AS place FROM attempts),
samples AS (SELECT pass, place, pair_id, CASE WHEN pass = 3 AND place % 10 = 0 THEN 'changed' ELSE 'same' END AS prompt_hash FROM sampled),
meta AS (SELECT pass, 'seed' AS key, '7' AS value FROM (SELECT DISTINCT pass FROM attempts) UNION ALL SELECT pass, 'temperature', CASE WHEN pass = 5 THEN '0.7' ELSE '0' END FROM (SELECT DISTINCT pass FROM attempts))"""


@query(
    "pass_consistency",
    attempts_sql(
        _PASS_SAMPLES
        + """, first AS (SELECT place, pair_id, prompt_hash FROM samples WHERE pass = 1),
others AS (SELECT DISTINCT pass FROM attempts WHERE pass > 1),
lists AS (SELECT o.pass, (SELECT count(*) FROM (SELECT place, pair_id, prompt_hash FROM samples s WHERE s.pass = o.pass EXCEPT SELECT * FROM first)) + (SELECT count(*) FROM (SELECT * FROM first EXCEPT SELECT place, pair_id, prompt_hash FROM samples s WHERE s.pass = o.pass)) AS n FROM others o)
SELECT pass, 'samples' AS differs, n FROM lists WHERE n > 0 UNION ALL SELECT pass, 'temperature', 1 FROM others WHERE pass = 5"""
    ),
)
def pass_consistency(spark, sf_dir):
    """Passes against the first: each samples what its attempts have; one has changed prompts, one another temperature."""
    place = F.substring("pair_id", 2, 20).cast("long")
    sampled = attempts(spark, sf_dir).select("pass", "pair_id").distinct().withColumn("place", place)
    changed = F.when((F.col("pass") == 3) & (F.col("place") % 10 == 0), "changed").otherwise("same")
    meta = sampled.select("pass").distinct().select("pass", F.lit("7").alias("seed"), F.when(F.col("pass") == 5, "0.7").otherwise("0").alias("temperature"))
    return voting.pass_differences(sampled.withColumn("prompt_hash", changed), meta, ("seed", "temperature"))


@query("union_runs", attempts_sql("SELECT seq, bucket, CASE WHEN form = 'two-stage' THEN reasoning_tokens END AS stage1_reasoning_tokens FROM attempts WHERE form IN ('story', 'two-stage')"))
def union_runs(spark, sf_dir):
    rows = attempts(spark, sf_dir)
    one = rows.where("form = 'story'").select("seq", "bucket")
    two = rows.where("form = 'two-stage'").select("seq", "bucket", F.col("reasoning_tokens").alias("stage1_reasoning_tokens"))
    return one.unionByName(two, allowMissingColumns=True)


@query("common_keys", attempts_sql("SELECT pair_id, model FROM attempts WHERE form = 'story' AND bucket <> 'api-error' INTERSECT SELECT pair_id, model FROM attempts WHERE form = 'literal' AND bucket <> 'api-error'"))
def common_keys(spark, sf_dir):
    rows = T.graded(attempts(spark, sf_dir))
    return rows.where("form = 'story'").select("pair_id", "model").intersect(rows.where("form = 'literal'").select("pair_id", "model"))


@query(
    "unknown_keys",
    """WITH catalog AS (SELECT n_name AS key FROM nation), requested AS (SELECT DISTINCT replace(n_name, 'A', 'E') AS key FROM nation),
lacking AS (SELECT key FROM requested WHERE key NOT IN (SELECT key FROM catalog)),
near AS (SELECT l.key, c.key AS name, 1 - levenshtein(l.key, c.key) / greatest(length(l.key), length(c.key)) AS near FROM lacking l JOIN catalog c ON true),
best AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY near DESC, name) AS rank FROM near WHERE near >= 0.4)
SELECT l.key, coalesce(string_agg(b.name, ',' ORDER BY b.rank), '') AS nearest FROM lacking l LEFT JOIN best b ON b.key = l.key AND b.rank <= 3 GROUP BY l.key""",
)
def unknown_keys(spark, sf_dir):
    names = table(spark, sf_dir, "nation")
    return T.unknown_keys(names.select(F.replace("n_name", F.lit("A"), F.lit("E")).alias("key")), names.select(F.col("n_name").alias("key")))
