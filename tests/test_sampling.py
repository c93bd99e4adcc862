"""Sampling contracts."""

import pytest
from helpers import SF
from pyspark.sql import Window
from pyspark.sql import functions as F

from lawframe.operators import corpus, sampling
from lawframe.plans.views import parsed, parsed_laws


@pytest.fixture(scope="module")
def laws(spark):
    return parsed_laws(spark, SF).cache()


def test_pairs_repeat_and_differ_by_seed(laws):
    key = lambda df: [(r["e_no"], r["f_no"]) for r in df.collect()]
    one = key(sampling.sample_pairs(laws, 50, "1"))
    assert one == key(sampling.sample_pairs(laws, 50, "1", form="literal")) != key(sampling.sample_pairs(laws, 50, "2"))
    assert len(set(one)) == 50 and all(e != f for e, f in one)


def test_too_few_pairs_is_an_error(spark):
    two = parsed(spark.createDataFrame([(1, "x = y"), (2, "x = x")], "law_no long, equation string"))
    with pytest.raises(ValueError):
        sampling.sample_pairs(two, 10, "1")


def _law_list(spark, n, good):
    """n laws of which every `good`-th is renderable, the others of seven variables or no equations."""
    bad = ["((a ∘ b) ∘ (c ∘ d)) ∘ ((e ∘ f) ∘ g) = a", "x ∘ y ∘ z = x"]
    rows = [(i, "x ∘ y = y" if i % good == 0 else bad[i % 2]) for i in range(1, n + 1)]
    return parsed(spark.createDataFrame(rows, "law_no long, equation string"))


def test_any_sample_that_can_be_filled_is(spark):
    laws = _law_list(spark, 600, 3)
    assert sampling.sample_pairs(laws, 50, "7").count() == 50
    few = _law_list(spark, 60, 5)  # 12 renderable laws: all of their pairs, each once
    rows = sampling.sample_pairs(few, 132, "7").collect()
    assert {(r["e_no"], r["f_no"]) for r in rows} == {(e, f) for e in range(5, 61, 5) for f in range(5, 61, 5) if e != f} and len(rows) == 132
    with pytest.raises(ValueError, match="only 132 of 133"):
        sampling.sample_pairs(few, 133, "7")


@pytest.mark.parametrize("size", [1, 2, 3, 5, 16, 17, 100, 1000])
def test_permutations(spark, size):
    every = [r["at"] for r in sampling.permuted(spark, size, size, "s").collect()]
    assert sorted(every) == list(range(size))
    assert [r["at"] for r in sampling.permuted(spark, size, min(size, 5), "s").collect()] == every[:5]
    if size > 50:
        assert every != sorted(every) and every != [r["at"] for r in sampling.permuted(spark, size, size, "t").collect()]


def test_slots_fill_from_few_laws(spark):
    """One pair alone fits a slot among very many that don't."""
    rows = [(i, "x = y ∘ z") for i in range(1, 300)] + [(300, "x ∘ y = (x ∘ x) ∘ y"), (301, "x = y ∘ (z ∘ (x ∘ (y ∘ (z ∘ x))))"), (302, "x = (y ∘ z) ∘ x"), (303, "x = x")]
    laws = parsed(spark.createDataFrame(rows, "law_no long, equation string"))
    found = sampling.slot_fill(laws, "7").collect()
    assert {(r["slot"], r["place"]) for r in found} == {("low", 1), ("high", 1), ("example", 1), ("example", 2), ("example", 3)}
    assert all(303 not in (r["e_no"], r["f_no"]) for r in found)


def test_stratified_quotas_and_splits(laws):
    rows = sampling.sample_stratified(laws.where("tokens is not null"), 20, "7").collect()
    assert len({(r["e_no"], r["f_no"]) for r in rows}) == len(rows) and all(r["e_no"] != r["f_no"] for r in rows)
    ops = {r["law_no"]: r["o"] for r in laws.where("tokens is not null").selectExpr("law_no", "size(filter(tokens, t -> t = '∘')) as o").collect()}
    for b in range(1, 9):
        own = [r for r in rows if r["bin"] == b]
        assert len(own) == 20 and all(ops[r["e_no"]] + ops[r["f_no"]] == b for r in own)
    per_split = {}
    for r in rows:
        if r["bin"] == 4:
            per_split[ops[r["e_no"]]] = per_split.get(ops[r["e_no"]], 0) + 1
    assert max(per_split.values()) - min(per_split.values()) <= 1


def test_slots(laws):
    rows = sampling.slot_fill(laws, "7").collect()
    assert sorted(r["slot"] for r in rows) == ["example"] * 3 + ["high", "low"]
    band = {"low": (2, 3), "high": (7, 8), "example": (4, 6)}
    assert all(band[r["slot"]][0] <= r["ops_total"] <= band[r["slot"]][1] for r in rows)


def test_one_operation_gives_five_laws(spark):
    draws = spark.range(400).withColumnRenamed("id", "draw")
    found = sampling.synthesize_laws(draws, [1], "9", per_bin=40).collect()
    assert len(found) == 5  # 20 ordered pairs are enough
    with pytest.raises(ValueError, match="bin 1: 5 of 6"):
        sampling.synthesize_laws(draws, [1], "9", per_bin=40, min_pairs=21)


def test_synthetic_laws_keep_the_contract(spark):
    found = sampling.synthesize_laws(spark.range(300).withColumnRenamed("id", "draw"), range(1, 7), "9", per_bin=60)
    lines = parsed(found.select(F.monotonically_increasing_id().alias("law_no"), F.col("line").alias("equation"))).cache()
    broken = {r["rule"]: r["violations"] for r in corpus.corpus_contract(lines, 1, 6).collect()}
    assert broken == dict.fromkeys(broken, 0)


def test_shapes_are_uniform(spark):
    shapes = spark.range(14_000).select(F.array_join(sampling._shape("s", F.col("id"), "l", F.lit(4)), "").alias("s")).groupBy("s").count().collect()
    assert len(shapes) == 14  # the fourth Catalan number
    assert all(800 < r["count"] < 1200 for r in shapes)


def test_quotas_are_errors(spark, laws):
    """A bin, a pool or a slot that can't be filled is an error that names it; so is an absent one."""
    three = parsed(spark.createDataFrame([(1, "x = y"), (2, "x = y ∘ z"), (3, "x = x ∘ y")], "law_no long, equation string"))
    with pytest.raises(ValueError, match="bin 2: 2 of 20"):
        sampling.sample_stratified(three, 20, "7", bins=(2,))
    with pytest.raises(ValueError, match="bin 5: 0 of 1"):
        sampling.sample_stratified(three, 1, "7", bins=(5,))
    with pytest.raises(ValueError, match="ops 1: 2 of 3"):
        sampling.sample_balanced(three, 3, "7", bins=(1,))
    with pytest.raises(ValueError, match="ops 4: 0 of 1"):
        sampling.sample_balanced(three, 1, "7", bins=(1, 4))
    with pytest.raises(ValueError, match="high: 0 of 1"):
        sampling.slot_fill(three, "7")
    assert sampling.sample_balanced(three, 2, "7", bins=(1,)).count() == 2


def test_synthetic_bins_have_their_quota(spark):
    found = sampling.synthesize_laws(spark.range(400).withColumnRenamed("id", "draw"), range(2, 11), "9", per_bin=15)
    assert {r["bin"]: r["count"] for r in found.groupBy("bin").count().collect()} == dict.fromkeys(range(2, 11), 15)


def test_synthetic_laws_of_many_draws_are_those_of_all(spark, monkeypatch):
    """A bin that the lowest draws fill takes no part in later attempts, others take all draws, and each task has a bounded share of attempts."""
    draws = spark.range(900).select((F.col("id") * 7 % 900).alias("draw")).coalesce(1)
    made, calls = sampling._attempts, []
    first = Window.partitionBy("bin").orderBy("draw", "law_key")
    want = made(draws.repartition(4), [1, 2, 3], "9").withColumn("rank", F.row_number().over(first)).where("rank <= 6").drop("rank")
    monkeypatch.setattr(sampling, "_attempts", lambda some, bins, seed: calls.append((bins, some.rdd.getNumPartitions())) or made(some, bins, seed))
    monkeypatch.setattr(sampling, "FIRST_ATTEMPTS", 300)
    monkeypatch.setattr(sampling, "LATER_ATTEMPTS", 200)
    found = sampling.synthesize_laws(draws, [1, 2, 3], "9", per_bin=6)
    assert sorted(map(tuple, found.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert calls == [([1, 2, 3], 3), ([1], 3)]  # 300 draws for three bins, then 600 for the one of five laws
