"""Similar names and themes by their openings, against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lawframe.operators import attempts, corpus, similar
from lawframe.plans import corpus_queries
from lawframe.session import shared_folder


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def _alike(a, b):
    return 1 - _distance(a, b) / max(len(a), len(b)) if max(len(a), len(b)) else 0


@pytest.fixture(scope="module")
def names():
    draw = random.Random(11)
    base = ["".join(draw.choice("abcdefghiklmnoprstuv") for _ in range(draw.randint(1, 14))) for _ in range(60)]
    catalog = base + [w[:-1] + c for w in base[:10] for c in "xy"] + ["abcd", "abce", "abcf", "abcg", "aaaa", "aaaaaaaaaa", "é中x", ""]
    asked = ["".join(c for c in w if draw.random() > 0.2) + draw.choice(["", "q", "zz"]) for w in base] + ["abcx", "aaa", "é中y", "", "zzzzzzzzzzzz", base[0], None]
    return asked, catalog


def test_nearest_names_against_brute_force(spark, names):
    asked, catalog = names
    df = lambda xs: spark.createDataFrame([(x,) for x in xs], "key string")
    found = {r["key"]: r["nearest"] for r in attempts.unknown_keys(df(asked + asked[:5]), df([*catalog, None, catalog[0]])).collect()}
    want = {}
    for key in {*asked} - {*catalog}:
        near = sorted((-_alike(key, c), c) for c in {*catalog} if key is not None and _alike(key, c) >= 0.4)
        want[key] = ",".join(c for _, c in near[:3])
    assert found == want and any(w.count(",") == 2 for w in want.values()) and "" in want.values()


@pytest.mark.parametrize("least", [0.8, 0.6, 0.5, 0.4, 0.95])
def test_no_pair_is_lost_and_not_all_are_tried(spark, names, least):
    asked, catalog = ({w for w in ws if w is not None} for ws in names)
    frames = [spark.createDataFrame([(w,) for w in ws], f"{c} string") for ws, c in ((asked, "key"), (catalog, "name"))]
    tried = {tuple(r) for r in similar.candidates(*frames, least).collect()}
    assert {(a, b) for a, b in itertools.product(asked, catalog) if _alike(a, b) >= least and max(len(a), len(b))} <= tried
    if least >= 0.6:
        assert len(tried) < len(asked) * len(catalog) / 8


def test_no_key_meets_all_names(spark, names):
    frames = [spark.createDataFrame([(w,) for w in ws], "key string") for ws in names]
    plan = attempts.unknown_keys(*frames)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


@pytest.fixture(scope="module")
def openings(spark):
    """Three themes of which one's intro begins another's, and two have the same."""
    themes = corpus_queries.example_themes(spark)
    loom = themes.where("key = 'loom'")
    longer = loom.withColumn("key", F.lit("a-long")).withColumn("intro", F.concat("intro", F.lit(" Once.")))
    return themes.unionByName(longer).unionByName(loom.withColumn("key", F.lit("zz")))


def test_the_first_theme_that_opens_a_story(spark, openings):
    laws = spark.createDataFrame([(1, "x ∘ y = y ∘ x", "x = x ∘ x"), (2, "x = y", "x ∘ (y ∘ z) = y")], "no long, e string, f string")
    from lawframe.functions import algebra as A

    pairs = laws.withColumns({"e": A.parse_infix(F.col("e")), "f": A.parse_infix(F.col("f"))})
    stories = None
    for key in ("bakery", "loom", "a-long", "zz"):
        told = corpus.render_story(pairs.withColumn("theme", F.lit(key)), openings).select("no", "theme", "story", "canonical_e", "canonical_f", F.lit("other").alias("key"))
        stories = told if stories is None else stories.unionByName(told)
    stories = stories.unionByName(stories.limit(1).withColumn("story", F.lit("No theme opens so."))).unionByName(stories.limit(1).withColumn("story", F.lit(None).cast("string")))
    shared_folder(spark)
    stories = stories.checkpoint()
    read = corpus.backparse_story(stories, openings)
    rows = read.collect()
    assert len(rows) == stories.count()
    # by key order, of all whose intro opens the story
    first = {"bakery": "bakery", "loom": "loom", "a-long": "a-long", "zz": "loom"}
    for r in rows:
        if r["story"] is None or r["story"].startswith("No theme"):
            assert r["read_theme"] is None and r["read_e"] is None
        else:
            assert r["read_theme"] == first[r["theme"]] and (r["read_e"], r["read_f"]) == (r["canonical_e"], r["canonical_f"])
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
