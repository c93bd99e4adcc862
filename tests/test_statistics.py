"""Retries, votes, contingency, ranks and tests on small literal cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lawframe.operators import attempts as T
from lawframe.operators import paired, summary, voting


def _log(spark, rows):
    return spark.createDataFrame([("p", "m", i, b) for i, b in enumerate(rows)], "pair_id string, model string, seq long, bucket string")


@pytest.mark.parametrize("rows, seq", [(["api-error", "exact", "api-error"], 1), (["wrong", "exact"], 1), (["api-error", "api-error"], 0), (["exact", "wrong", "api-error"], 1)])
def test_latest_graded(spark, rows, seq):
    assert T.latest_graded(_log(spark, rows), ["pair_id", "model"]).first()["seq"] == seq


@pytest.mark.parametrize(
    "rows, bucket, votes, source, tie, valid",
    [
        ([("wrong", "a"), ("exact", "b"), ("exact", "b")], "exact", 2, 2, False, 3),
        ([("wrong", "a"), ("exact", "b"), ("unparseable", "c")], "wrong", 1, 1, True, 2),
        ([("api-error", "x"), ("unparseable", "x"), ("api-error", "x")], "unparseable", 0, 2, False, 0),
        ([("api-error", "x"), ("api-error", "x")], "api-error", 0, 1, False, 0),
    ],
)
def test_votes(spark, rows, bucket, votes, source, tie, valid):
    df = spark.createDataFrame([("p", "m", i + 1, b, c) for i, (b, c) in enumerate(rows)], "pair_id string, model string, pass int, bucket string, answer_class string")
    r = voting.majority_vote(df).first()
    assert (r["bucket"], r["votes_for_winner"], r["source_pass"], r["tie"], r["valid_ballots"], r["vote_k"]) == (bucket, votes, source, tie, valid, len(rows))
    assert r["abstentions"] == len(rows) - valid


def test_contingency(spark):
    cells = [(True, True)] * 2 + [(False, True), (True, False)] + [(False, False)] * 2
    df = spark.createDataFrame([("g", *c) for c in cells], "g string, story_correct boolean, literal_correct boolean")
    r = paired.contingency(df, ["g"]).first()
    assert r["p_story_given_literal_correct"] == pytest.approx(2 / 3) and r["p_story_given_literal_wrong"] == pytest.approx(1 / 3)
    assert r["phi"] == pytest.approx(1 / 3)


def test_published_phi(spark):
    counts = spark.createDataFrame([(240, 38, 53, 14, 135), (0, 0, 0, 0, 0)], "n long, both_correct long, literal_only long, story_only long, neither long")
    full, none = paired.with_statistics(counts).collect()
    assert full["phi"] == pytest.approx(0.38112917262964824) and full["p_story_given_literal_correct"] == pytest.approx(0.4175824175824176)
    assert none["phi"] is None and none["risk_difference"] is None


def test_ranks_and_correlation(spark):
    df = spark.createDataFrame([("g", 10), ("g", 20), ("g", 20), ("g", 40)], "g string, v int")
    assert [r["r"] for r in paired.average_ranks(df, "v", ["g"], "r").orderBy("v").collect()] == [1, 2.5, 2.5, 4]
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert flat.agg(paired.pearson(F.col("a"), F.col("b"))).first()[0] is None
    assert flat.limit(1).agg(paired.pearson(F.col("a"), F.col("b"))).first()[0] is None


@pytest.mark.parametrize("gained, lost, p", [(48, 44, 0.755), (47, 78, 0.0070), (0, 0, 1.0), (0, 1, 1.0)])
def test_sign_test(spark, gained, lost, p):
    df = spark.createDataFrame([(gained, lost)], "g long, l long")
    assert df.select(paired.sign_test_p(F.col("g"), F.col("l"))).first()[0] == pytest.approx(p, abs=6e-4)


def test_average_ranks_of_a_large_group(spark):
    """Rows meet by value before they are ordered, nulls first and by themselves."""
    rows = [(None if i % 7 == 0 else "g", None if i % 11 == 0 else float(i % 5)) for i in range(300)]
    got = paired.average_ranks(spark.createDataFrame(rows, "g string, v double"), "v", ["g"], "r").collect()
    assert len(got) == len(rows)
    order = lambda v: (v is not None, v or 0.0)
    for r in got:
        peers = [order(v) for g, v in rows if g == r["g"]]
        below, ties = sum(p < order(r["v"]) for p in peers), peers.count(order(r["v"]))
        assert r["r"] == below + (ties + 1) / 2
    plan = paired.average_ranks(spark.createDataFrame(rows, "g string, v double"), "v", ["g"], "r")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("Aggregate")  # the window is over counts


def test_attempt_queries_cover_all_attempts(spark):
    from helpers import SF

    from lawframe.plans import registry
    from lawframe.plans.views import attempts

    rows = attempts(spark, SF)
    assert registry.QUERIES["average_ranks_all"](spark, SF).count() == rows.select("regime", "pair_id").distinct().count()
    assert registry.QUERIES["sample_model_order_all"](spark, SF).count() == rows.select("pair_id", "model").distinct().count()
    wide = registry.QUERIES["group_runs_by_pairset_all"](spark, SF).agg(F.sum("pairs")).first()[0]
    assert wide == rows.select("form", "regime", "pair_id").distinct().count()


def _tail(gained, lost):
    """Exact, in whole numbers."""
    from fractions import Fraction
    from math import comb

    n, k = gained + lost, min(gained, lost)
    return float(min(Fraction(1), Fraction(2 * sum(comb(n, i) for i in range(k + 1)), 2**n)))


def test_sign_test_is_exact_and_bounded(spark):
    counts = [(0, 0), (0, 1), (1, 0), (3, 3), (0, 40), (15, 16), (14, 40), (47, 78), (48, 44), (100, 160), (300, 301), (700, 1000), (5, 900), (2000, 2100)]
    rows = spark.createDataFrame(counts, "g long, l long").select("g", "l", paired.sign_test_p(F.col("g"), F.col("l")).alias("p")).collect()
    for r in rows:
        assert r["p"] == pytest.approx(_tail(r["g"], r["l"]), rel=1e-10)
    # a normal tail is near enough for very large counts; equal ones are sure
    large = [(10**9, 10**9), (10**9, 10**9 + 10**5), (4 * 10**8, 4 * 10**8 - 30_000), (10**9, 10**6)]
    found = [r["p"] for r in spark.createDataFrame(large, "g long, l long").select(paired.sign_test_p(F.col("g"), F.col("l")).alias("p")).collect()]
    for (g, x), p in zip(large, found, strict=True):
        assert p == pytest.approx(min(1.0, math.erfc((abs(g - x) - 1) / math.sqrt(2 * (g + x)))), rel=1e-4, abs=1e-300)


def _ballots(seed, keys, passes):
    draw = random.Random(seed)
    kinds = ["exact", "wrong", "wrong", "unparseable", "api-error", "correct-swapped"]
    return [(f"p{i}", "m", k, draw.choice(kinds), draw.choice(["a", "b", "c", None]), i * 100 + k) for i in range(keys) for k in range(1, passes + 1) if draw.random() < 0.8]


def test_running_votes_are_those_of_each_prefix(spark):
    rows = spark.createDataFrame(_ballots(5, 120, 9), "pair_id string, model string, pass int, bucket string, answer_class string, seq long").withColumn("map", F.create_map(F.lit("x"), F.col("seq")))
    ks = [1, 2, 3, 5, 9]
    found = voting.vote_at_k(rows, ks).drop("map")
    for k in ks:
        want = voting.majority_vote(rows.drop("map").where(F.col("pass") <= k))
        assert sorted(map(str, found.where(F.col("k") == k).select(*want.columns).collect())) == sorted(map(str, want.collect()))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_passes_that_cover_nothing_are_named(spark):
    rows = spark.createDataFrame([("p1", "m", 1, "exact"), ("p1", "m", 2, "wrong"), ("p2", "m", 3, "exact")], "pair_id string, model string, pass int, bucket string")
    keys = lambda *ks: spark.createDataFrame(list(ks), "pair_id string, model string")
    found = voting.multi_pass_join(rows, 2, keys(("p1", "m"))).collect()
    assert [(r["buckets"], r["present"], r["missing"]) for r in found] == [("exact,wrong", 2, 0)]
    with pytest.raises(ValueError, match="no pass has a row for p2 m, p3 n"):
        voting.multi_pass_join(rows, 2, keys(("p1", "m"), ("p2", "m"), ("p3", "n")))
    assert voting.multi_pass_join(rows, 2).count() == 1


def test_baselines_cover_the_same_prompts_and_models(spark):
    rows = spark.createDataFrame([(f"p{i}", m, f"{i}{m}") for i in (2, 1) for m in ("a", "b", "c")], "pair_id string, model string, row string")
    samples = spark.createDataFrame([(1, "p2", "h2"), (2, "p1", "h1")], "place int, pair_id string, prompt_hash string")
    models = lambda *ms: spark.createDataFrame(list(enumerate(ms)), "place int, model string")
    found = voting.baseline_subset(rows, samples, samples, models("c", "a")).orderBy("at").collect()
    assert [(r["row"], r["at"]) for r in found] == [("2c", 1), ("2a", 2), ("1c", 3), ("1a", 4)]
    with pytest.raises(ValueError, match="lacks models: x, y"):
        voting.baseline_subset(rows, samples, samples, models("a", "y", "x"))
    for change in (F.lit("other"), F.col("prompt_hash")):
        moved = samples.withColumns({"prompt_hash": change, "place": 3 - F.col("place")})
        with pytest.raises(ValueError, match="other pairs or prompts"):
            voting.baseline_subset(rows, samples, moved, models("a"))


def test_transitions_by_band_without_vacuous_pairs(spark):
    """The documented shape: bands 1-3 and 4-8, and pairs with a law without operations left out."""
    cells = [("E1", 1, "exact", "wrong"), ("E2", 2, "wrong", "exact"), ("E3", 3, "exact", "exact"), ("E4", 4, "wrong", "exact"), ("E8", 8, "exact", "wrong"), ("E9", 9, "wrong", "wrong"), ("E0", None, "exact", "exact")]
    arm = lambda i: spark.createDataFrame([(c[0], "m", c[1], c[i], 1) for c in cells], "pair_id string, model string, ops_total int, bucket string, seq long")
    vacuous = spark.createDataFrame([("E1",)], "pair_id string")
    told = lambda v: {(r["level"], r["value"]): (r["n"], r["rescued"], r["lost"], r["net"]) for r in paired.transitions(arm(2), arm(3), ["pair_id", "model"], ["model", "ops_total"], "ops_total", v).collect()}
    every, some = told(None), told(vacuous)
    assert every["overall", "all"] == (7, 2, 2, 0) and every["band", "low"] == (3, 1, 1, 0) and every["band", "high"] == (2, 1, 1, 0)
    assert some["overall", "all"] == (6, 2, 1, 1) and some["band", "low"] == (2, 1, 0, 1) and ("ops_total", "1") not in some
    assert {v for level, v in every if level == "band"} == {"low", "high"}


def test_sketches_of_runs_add_up(spark):
    rows = spark.range(60_000).selectExpr("concat('r', id % 3) as run", "concat('m', id % 7) as model", "concat('E', id % 20000) as pair_id", "if(id % 4 = 0, 'exact', if(id % 4 = 1, 'api-error', 'wrong')) as bucket")
    want = summary.report_tiles(rows, ["run"]).first()
    parts = [summary.run_sketches(rows.where(F.col("run") == r), ["run"]) for r in ("r0", "r1", "r2")]
    kept = parts[0].unionByName(parts[1]).unionByName(parts[2])
    for sketches in (kept, summary.run_sketches(rows, ["run"])):
        found = summary.tiles_of_sketches(sketches, ["run"]).first()
        assert (found["runs"], found["graded"], found["correct_pct"], found["models"]) == (want["runs"], want["graded"], want["correct_pct"], 7)
        assert abs(found["pairs"] - want["pairs"]) <= 3 * 1.04 / 2**6 * want["pairs"]  # three standard errors


def test_experiments_are_named_by_the_run_seen_first(spark):
    rows = spark.createDataFrame([("b", "E1", 1), ("a", "E1", 2), ("c", "E2", 0)], "run string, pair_id string, seq long")
    told = lambda **o: {r["run"]: r["experiment"] for r in summary.group_runs_by_pairset(rows, ["run"], **o).collect()}
    assert told() == {"a": "a", "b": "a", "c": "c"} and told(seen="seq") == {"a": "b", "b": "b", "c": "c"}
