"""Grading tables of responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawframe.functions import algebra as A
from lawframe.functions import grading as G


#: Parts over which responses without answer lines are dealt.
SALTS = 64


def graded_responses(responses: DataFrame) -> DataFrame:
    """Rows (response, canonical_e, canonical_f) with `assume`, `ask`, `verdict` and `bucket`.

    Answers repeat heavily, so each distinct (assume, ask, truth) is graded once
    and joined back. The answer lines are extracted where the responses are read.
    Responses without either line can be very many of one key, so they are dealt
    over `SALTS` parts of it.
    """
    assume, ask = G.extract_answer(F.col("response"))
    extracted = responses.withColumns({"assume": assume, "ask": ask})
    keys = ["assume", "ask", "canonical_e", "canonical_f"]
    distinct = extracted.select(*keys).distinct()
    tokens = distinct.groupBy(*keys).agg(F.first(A.parse_prefix(F.col("assume"))).alias("te"), F.first(A.parse_prefix(F.col("ask"))).alias("tf"))
    found = tokens.groupBy(*keys).agg(
        F.first("te").alias("e"), F.first("tf").alias("f"), F.first(G.transform_found(F.col("te"), F.col("tf"), F.col("canonical_e"), F.col("canonical_f"))).alias("transform")
    )
    lost = F.col("assume").isNull() & F.col("ask").isNull()
    parts = F.when(lost, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    once = found.withColumn("of salt", F.explode(parts)).select(
        "of salt", *[F.col(k).alias(f"of {k}") for k in keys], "e", "f", G.verdict(F.col("assume"), F.col("ask"), F.col("e"), F.col("f"), F.col("transform")).alias("verdict")
    )
    extracted = extracted.withColumn("salt", F.when(lost, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(0).cast("int"))
    same = F.col("salt") == F.col("of salt")
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"of {k}"))
        same = same & one
    joined = extracted.join(once, same).drop("salt", "of salt", *[f"of {k}" for k in keys])
    return joined.withColumn("bucket", G.bucket_of(F.col("response"), F.col("verdict")))


def law_reading_rate(graded: DataFrame) -> DataFrame:
    """(law, ops, n, read): laws by their operations, and the share read right up to their own swap or dual."""
    parts = graded.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("law"),
                        A.operations(A.parse_canonical(F.col(truth))).alias("ops"),
                        (F.coalesce(F.size(G.matching_duals(F.col(tokens), F.col(truth))), F.lit(0)) > 0).alias("right"),
                    )
                    for name, tokens, truth in (("e", "e", "canonical_e"), ("f", "f", "canonical_f"))
                ]
            )
        ).alias("x")
    )
    return parts.groupBy("x.law", "x.ops").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("x.right").cast("double")).alias("read"))


def stage_attribution(rows: DataFrame) -> DataFrame:
    """(stage1, correct, n): whether a first stage's description is faithful, drifted or off the grammar, against the final result.

    Rows have `stage1_response`, canonical_e, canonical_f and `correct`. The description
    is what follows the last opening line.
    """
    from lawframe.operators import corpus

    tail = F.concat(F.lit(corpus.OPENING), F.substring_index("stage1_response", corpus.OPENING, -1))
    told = rows.select(F.col("canonical_e").alias("true e"), F.col("canonical_f").alias("true f"), "correct", F.regexp_replace(tail, r"\s+$", "").alias("description"))
    # readings are counted before they are compared, as few differ and each comparison is a long expression
    read = corpus.backparse_literal(told).groupBy("true e", "true f", "correct", "canonical_e", "canonical_f").agg(F.count(F.lit(1)).alias("n"))
    key = lambda e, f: A.answer_class_key(A.parse_canonical(F.col(e)), A.parse_canonical(F.col(f)))
    state = (
        F.when(F.col("canonical_e").isNull() | F.col("canonical_f").isNull(), "off-grammar")
        .when(key("canonical_e", "canonical_f") == key("true e", "true f"), "faithful")
        .otherwise("drifted")
    )
    return read.select(state.alias("stage1"), "correct", "n").groupBy("stage1", "correct").agg(F.sum("n").alias("n"))
