"""Answers: extraction, verdicts and error types on small literal cases."""

import pytest
from pyspark.sql import functions as F

from lawframe.functions import grading as G
from lawframe.functions import labels as L
from lawframe.operators import answers

#: Answers, equations and canonical forms in this file are fixed values.
E, TRUE_F = "(v1 ∘ v2) = ((v2 ∘ v2) ∘ v1)", "(v1 ∘ v2) = ((v1 ∘ v1) ∘ v2)"


@pytest.mark.parametrize(
    "text, assume, ask",
    [
        ("ASSUME: a = b\nASK: b = a\nASSUME: op(a, b) = b\nASK: a = a", "op(a, b) = b", "a = a"),
        ("**ASSUME**: `op(a, b) = op(b, a)`\n- ASK: op(a, a) = a.", "op(a, b) = op(b, a)", "op(a, a) = a"),
        ("> assume : x = y\r\n  * ask: y = x \t", "x = y", "y = x"),
        ("ASSUME:\nop(x, y) = x\nASK: x = x", "op(x, y) = x", "x = x"),
        ("ASSUME: x = y", "x = y", None),
        ("nothing", None, None),
        ("", None, None),
        (None, None, None),
    ],
)
def test_extract(spark, text, assume, ask):
    df = spark.createDataFrame([(text,)], "t string")
    a, b = G.extract_answer(F.col("t"))
    assert tuple(df.select(a, b).first()) == (assume, ask)


CASES = {
    "ASSUME: op(a, b) = op(op(b, b), a)\nASK: op(a, b) = op(op(a, a), b)": ("correct", "exact"),
    "ASSUME: op(op(b, b), a) = op(a, b)\nASK: op(a, b) = op(op(a, a), b)": ("correct", "correct-swapped"),
    "ASSUME: op(a, b) = op(op(b, b), a)\nASK: op(op(a, a), b) = op(a, b)": ("correct", "correct-swapped"),
    "ASSUME: op(b, a) = op(a, op(b, b))\nASK: op(b, a) = op(b, op(a, a))": ("correct", "correct-dualized"),
    "ASSUME: op(a, op(b, b)) = op(b, a)\nASK: op(b, a) = op(b, op(a, a))": ("correct", "correct-dualized"),
    "ASSUME: op(a, b) = op(op(a, a), b)\nASK: op(a, b) = op(op(b, b), a)": ("wrong", "both_wrong"),
    "ASSUME: op(b, a) = op(a, op(b, b))\nASK: op(a, b) = op(op(a, a), b)": ("wrong", "inconsistent_operation_direction"),
    "ASSUME: op(a, b) = op(op(b, b), a)\nASK: a = b": ("wrong", "ask_wrong_only"),
    "ASSUME: a = b\nASK: op(a, b) = op(op(a, a), b)": ("wrong", "assume_wrong_only"),
    "ASSUME: a + b = b\nASK: a = b": ("unparseable", "unparseable"),
}


def test_verdicts_and_errors(spark):
    df = spark.createDataFrame([(t, E, TRUE_F) for t in [*CASES, None]], "response string, canonical_e string, canonical_f string")
    kind = G.error_type(F.col("verdict.status"), F.col("e"), F.col("f"), F.col("canonical_e"), F.col("canonical_f"))
    rows = {r["response"]: r for r in answers.graded_responses(df).withColumn("kind", kind).collect()}
    for text, (status, more) in CASES.items():
        assert rows[text]["verdict"]["status"] == status, text
        assert (rows[text]["bucket"] if status == "correct" else rows[text]["kind"]) == more, text
        assert (rows[text]["verdict"]["error"] is None) == (status != "unparseable")
    assert rows[None]["bucket"] == "api-error"


def test_split_sections(spark):
    text = "GRAMMAR\nold\nENCODING\nno\n## GRAMMAR:\nreal g\n\n**ENCODING**\n the rest \n"
    df = spark.createDataFrame([(text,), ("no markers",), ("ENCODING:\nx",), (None,)], "t string")
    got = [tuple(r["s"]) for r in df.select(L.split_sections(F.col("t")).alias("s")).collect()]
    assert got == [("real g", "the rest"), (None, None), (None, "x"), (None, None)]


def test_all_rows_are_formatted_and_split(spark):
    from helpers import SF

    from lawframe.plans import registry

    lines = registry.QUERIES["fmt_pct_all"](spark, SF)
    assert lines.count() == spark.read.parquet(f"{SF}/lineitem.parquet").count()
    found = {r["l_linenumber"]: (r["pct"], r["number"]) for r in lines.select("l_linenumber", "pct", "number").distinct().collect()}
    assert {n: found[n] for n in (2, 5, 6)} == {2: ("50", "0.500"), 5: ("125", "1.250"), 6: ("150", "1.500")}
    assert registry.QUERIES["split_sections_all"](spark, SF).count() == spark.read.parquet(f"{SF}/conversations.parquet").count()


def test_split_sections_of_texts_that_hold_markers_or_are_blank(spark):
    import re

    marker = r"(?m)^[ \t]*(?:#{{1,6}}[ \t]*)?\**[ \t]*{0}\b\**[ \t]*:?\**[ \t]*$"
    inner = ["", "  ", " untrimmed \n", "GRAMMAR\nx", "a\nENCODING\nb", "not a GRAMMAR line", "**ENCODING:**\n"]
    texts = [f"## GRAMMAR:\ng\n**ENCODING**\n{t}" for t in inner] + [f"ENCODING:\n{t}" for t in inner] + inner

    def want(text):
        ends = list(re.finditer(marker.format("ENCODING"), text))
        if not ends:
            return None, None
        before = text[: ends[-1].start()]
        starts = list(re.finditer(marker.format("GRAMMAR"), before))
        return (before[starts[-1].end() :].strip() if starts else None), text[ends[-1].end() :].strip()

    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert [tuple(r["s"]) for r in rows.select("i", L.split_sections(F.col("t")).alias("s")).orderBy("i").collect()] == [want(t) for t in texts]
