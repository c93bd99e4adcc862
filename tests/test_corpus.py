"""Texts: damaged descriptions, leakage and theme rules."""

import pytest
from pyspark.sql import functions as F

from lawframe.functions import algebra as A
from lawframe.operators import corpus
from lawframe.plans.corpus_queries import example_themes


def _pairs(spark, *texts):
    df = spark.createDataFrame([(i, e, f) for i, (e, f) in enumerate(texts)], "i int, e_text string, f_text string")
    return df.select("i", A.parse_infix(F.col("e_text")).alias("e"), A.parse_infix(F.col("f_text")).alias("f"))


def test_literal_wording(spark):
    row = corpus.render_literal(_pairs(spark, ("x = x", "x ∘ y = y"))).first()
    first, second, third = row["description"].split("\n\n")
    assert second == "Suppose the following always holds. For every choice of an object x, x is always equal to x."
    assert third == (
        "Now consider the following question. For every choice of objects x and y, apply the operation to x as its first input and y as its second input, "
        "and call the result Value 1. Does it follow that Value 1 is always equal to y?"
    )


def test_damaged_descriptions_do_not_read(spark):
    good = corpus.render_literal(_pairs(spark, ("x ∘ (y ∘ z) = x", "x ∘ y = y ∘ x"))).first()["description"]
    bad = [good[:-1], good.replace("Value 1", "Value 9", 1), good.replace("first input and", "first"), good.replace("\n\n", "\n", 1), "", None]
    df = spark.createDataFrame([(t,) for t in [good, *bad]], "description string")
    rows = corpus.backparse_literal(df).collect()
    whole = [r["canonical_e"] is not None and r["canonical_f"] is not None for r in rows]
    assert whole == [True] + [False] * len(bad)


def test_story_wording(spark):
    """One bare side and one with two steps, word for word."""
    pairs = _pairs(spark, ("x = (x ∘ y) ∘ z", "x ∘ y = y ∘ x")).withColumn("theme", F.lit("bakery"))
    assert corpus.render_story(pairs, example_themes(spark)).first()["story"].split("\n\n") == [
        "In a small harbour bakery, the baker keeps to one old custom. Take any three doughs at all — call the first rye, the second spelt, and the third millet.",
        "She folds rye into spelt and sets the result aside as Loaf 1; then she folds Loaf 1 into millet and calls the result Loaf 2.",
        "However she chooses her three starting doughs, rye itself and Loaf 2 always bake to the very same bread. Nobody in the bakery has seen it otherwise.",
        "One winter her cousin asks about something. Take any two doughs — again call the first rye and the second spelt. Fold rye into spelt and set the result aside as Loaf 1. "
        "Separately, fold spelt into rye and call the result Loaf 2.",
        "In this bakery, must Loaf 1 and Loaf 2 always bake to the same bread?",
    ]


def test_damaged_stories_do_not_read(spark):
    themes = example_themes(spark)
    good = corpus.render_story(_pairs(spark, ("x = (x ∘ y) ∘ z", "x ∘ y = y ∘ x")).withColumn("theme", F.lit("loom")), themes).first()
    story = good["story"]
    bad = [
        story[:-30], story.replace("In a quiet valley mill", "Somewhere"), story.replace("Cloth 1", "Cloth 7", 1), story.replace("always feel exactly alike", "feel alike"),
        story.replace("runs linen across merino", "lays linen across merino"), story.replace("One summer his niece", "His niece"), "", None,
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([story, *bad])], "i int, story string")
    rows = corpus.backparse_story(df, themes).orderBy("i").collect()
    truth = (good["canonical_e"], good["canonical_f"])
    assert [(r["read_e"], r["read_f"]) == truth and r["read_theme"] == "loom" for r in rows] == [True] + [False] * len(bad)


def test_seven_variables_are_not_rendered(spark):
    row = corpus.render_literal(_pairs(spark, ("((a ∘ b) ∘ (c ∘ d)) ∘ (e ∘ f) = g", "x = x"))).first()
    assert row["description"] is None


def test_leakage(spark):
    df = spark.createDataFrame([("All laws of E387",), ("a plain tale, he said",), ("so b = c",), (None,)], "t string")
    got = [tuple(r) for r in corpus.leakage_filter(df, "t").select("banned_word", "banned_char", "lone_letter", "letter_digit").collect()]
    assert got == [(True, False, False, True), (False, False, False, False), (False, True, True, False), (False, False, False, False)]


def test_theme_rules(spark):
    good = example_themes(spark)
    assert all(not r["violations"] for r in corpus.validate_records(good).collect())
    odd = good.withColumn("extra", F.lit(1)).withColumn("result_noun", F.lit("Rye")).withColumn("op_agent", F.lit("mixes {a} and {a}"))
    found = {r["key"]: set(r["violations"]) for r in corpus.validate_records(odd).collect()}
    assert found["bakery"] == {"op_agent places", "result_noun in palette", "unknown field extra"}
    assert found["loom"] == {"op_agent places", "unknown field extra"}


def _copies(spark, n=40):
    """Copies of two pairs, and of one without a second law."""
    some = _pairs(spark, ("x = (x ∘ y) ∘ z", "x ∘ y = y ∘ x"), ("x = x", "x ∘ y = y"), ("x = y", "x ="))
    return some.withColumn("theme", F.when(F.col("i") == 1, "loom").otherwise("bakery")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(n))))


def _made_once(monkeypatch, run, few):
    """What `run` gives, and how many distinct values texts were made of or read from."""
    seen, once = [], corpus.once_per

    def counted(records, by, make):
        return once(records, by, lambda values, tasks: seen.append(values.count()) or make(values, tasks))

    monkeypatch.setattr(corpus, "once_per", counted)
    monkeypatch.setattr(corpus, "FEW_LETTERS", few)
    return run().collect(), seen


@pytest.mark.parametrize("few", [4 << 20, 0])
def test_stories_are_made_once_per_pair(spark, monkeypatch, few):
    """By either join; a pair without a law keeps its row."""
    rows, seen = _made_once(monkeypatch, lambda: corpus.render_story(_copies(spark), example_themes(spark)), few)
    assert seen == [3] and len(rows) == 120
    assert len({(r["i"], r["story"]) for r in rows}) == 3 and sorted({r["i"] for r in rows if r["canonical_f"] is None}) == [2]


@pytest.mark.parametrize("few", [4 << 20, 0])
def test_stories_are_read_once_per_text(spark, monkeypatch, few):
    """By either join; rows without a story keep their place."""
    told = corpus.render_story(_copies(spark), example_themes(spark)).withColumn("story", F.when(F.col("i") < 2, F.col("story"))).localCheckpoint()
    rows, seen = _made_once(monkeypatch, lambda: corpus.backparse_story(told, example_themes(spark)), few)
    assert seen == [3] and len(rows) == 120
    assert all((r["read_e"], r["read_f"]) == ((r["canonical_e"], r["canonical_f"]) if r["i"] < 2 else (None, None)) for r in rows)


@pytest.mark.parametrize("few", [4 << 20, 0])
def test_literal_texts_are_made_and_read_once(spark, monkeypatch, few):
    told, made = _made_once(monkeypatch, lambda: corpus.render_literal(_copies(spark)), few)
    assert made == [3] and len(told) == 120
    cut = corpus.render_literal(_copies(spark)).withColumn("theme", F.col("i").cast("string")).withColumn("description", F.when(F.col("i") < 2, F.col("description"))).localCheckpoint()
    gate, read = _made_once(monkeypatch, lambda: corpus.roundtrip_gate(cut), few)
    assert max(read) == 3  # two texts and none
    assert sorted(map(tuple, gate)) == [("0", 40, 0), ("1", 40, 0), ("2", 40, 40)]
