"""Parsing, renaming, duals and keys on small literal cases."""

import itertools

import pytest
from pyspark.sql import functions as F

from lawframe.functions import algebra as A

#: Answers, equations and canonical forms in this file are fixed values.
TEXTS = {
    "x ◇ y = y * x": "(v1 ∘ v2) = (v2 ∘ v1)",
    "x = x": "v1 = v1",
    "((x ∘ y)) = (z)": "(v1 ∘ v2) = v3",
    "(x) ∘ ((y ∘ z)) = x": "(v1 ∘ (v2 ∘ v3)) = v1",
    "y = (x ∘ (y ∘ x)) ∘ z9": "v1 = ((v2 ∘ (v1 ∘ v2)) ∘ v3)",
    "x ∘ y ∘ z = x": None,
    "x y = z": None,
    "x = y = z": None,
    "x ∘ y": None,
    "x_1 = y": None,
    "(x = y": None,
    "": None,
    "x ∘ = y": None,
    "é ∘ Ω = é": "(v1 ∘ v2) = v1",
}

PREFIX = {
    "op(x, y) = op(y, x)": "(v1 ∘ v2) = (v2 ∘ v1)",
    "OP(a_1,Op(b, a_1)) = b": "(v1 ∘ (v2 ∘ v1)) = v2",
    "op(x y) = y": None,
    "op(x, y, z) = x": None,
    "op(x, y) = y = x": None,
    "op = x": None,
    "op(x) = x": None,
    "x + y = y": None,
    "op(x, y)": None,
    "op(x, y = z": None,
    "(x) = x": None,
    "op(" * 50 + "x" + ", y)" * 50 + " = x": "ok",
    "op(" * 51 + "x" + ", y)" * 51 + " = x": None,
    "op(" * 200 + "x" + ", y)" * 200 + " = x": None,
}


def test_infix(spark):
    df = spark.createDataFrame([(t,) for t in [*TEXTS, None]], "t string")
    got = {r["t"]: r["c"] for r in df.select("t", A.canonical(A.parse_infix(F.col("t"))).alias("c")).collect()}
    assert got == TEXTS | {None: None}


def test_prefix(spark):
    df = spark.createDataFrame([(t,) for t in [*PREFIX, None]], "t string")
    got = {r["t"]: r["c"] for r in df.select("t", A.canonical(A.parse_prefix(F.col("t"))).alias("c")).collect()}
    for text, want in PREFIX.items():
        assert (got[text] is not None) if want == "ok" else got[text] == want, text
    assert got[None] is None


def test_depth_and_operations(spark):
    tokens = A.parse_infix(F.col("t"))
    df = spark.createDataFrame([("x ∘ (y ∘ (z ∘ w)) = (x ∘ y) ∘ w",)], "t string")
    row = df.select(A.depth(tokens).alias("d"), A.operations(tokens).alias("o"), A.serialized(tokens).alias("s")).first()
    assert (row["d"], row["o"], row["s"]) == (3, 5, "x ◇ (y ◇ (z ◇ w)) = (x ◇ y) ◇ w")


def test_orbit_has_one_class_key(spark):
    e, f = "x ∘ y = (y ∘ y) ∘ x", "x ∘ y = (x ∘ x) ∘ y"
    df = spark.createDataFrame([(e, f)], "e string, f string").select(F.explode(A.orbit(A.parse_infix(F.col("e")), A.parse_infix(F.col("f")))).alias("t"))
    keys = df.select("t", A.answer_class_key(A.parse_canonical(F.col("t.e")), A.parse_canonical(F.col("t.f"))).alias("k")).collect()
    assert len(keys) == 8 and len({r["k"] for r in keys}) == 1
    assert [tuple(r["t"][:3]) for r in keys] == sorted(itertools.product((False, True), repeat=3), key=lambda t: (sum(t), t))


@pytest.mark.parametrize("a, b, same", [("x ∘ y = z", "z = x ∘ y", True), ("x = x ∘ y", "x = y ∘ x", False), ("b ∘ a = b", "x ∘ y = x", True)])
def test_law_key(spark, a, b, same):
    df = spark.createDataFrame([(a,), (b,)], "t string")
    keys = {r[0] for r in df.select(A.law_key(A.parse_infix(F.col("t")))).collect()}
    assert (len(keys) == 1) == same
