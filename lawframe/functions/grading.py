"""Grading of raw answers against canonical truths, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lawframe.functions import algebra as A

#: Fixed value: an answer line with its decoration. (?d): only a line feed ends a line.
_LINE = r"(?imd)^[ \t>*+-]*(?:\*\*)?\s*(ASSUME|ASK)\b\s*(?:\*\*)?\s*:\s*(.+)$"


#: Messages of missing lines.
NO_ASSUME = "no 'ASSUME:' line found in the response"
NO_ASK = "no 'ASK:' line found in the response"


def _clean(value: Column) -> Column:
    bare = F.regexp_replace(value, r"^\s+|\s+$", "")
    bare = F.regexp_replace(bare, r"^[`*]+|[`*]+$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"\.+$", ""), r"^\s+|\s+$", "")


def extract_answer(response: Column) -> tuple[Column, Column]:
    """(assume, ask): the last line of each label, cleaned; null where the label is missing."""
    found_pairs = F.arrays_zip(F.regexp_extract_all(response, F.lit(_LINE), F.lit(1)).alias("label"), F.regexp_extract_all(response, F.lit(_LINE), F.lit(2)).alias("value"))

    def last(label: str) -> Column:
        found = F.filter(found_pairs, lambda p: F.upper(p["label"]) == label)
        return _clean(F.try_element_at(found, F.lit(-1))["value"])

    return last("ASSUME"), last("ASK")


def transform_found(e: Column, f: Column, true_e: Column, true_f: Column) -> Column:
    """The first transform, in order of preference, under which the answer is the truth; null if none."""
    hits = F.filter(A.orbit(e, f), lambda t: (t["e"] == true_e) & (t["f"] == true_f))
    flags = F.transform(hits, lambda t: F.struct(t["swap_e"].alias("swap_e"), t["swap_f"].alias("swap_f"), t["dual"].alias("dual")))
    return F.get(flags, 0)


def verdict(assume: Column, ask: Column, e: Column, f: Column, transform: Column) -> Column:
    """The verdict of an extracted answer, its parsed tokens and the transform found."""
    parsed = e.isNotNull() & f.isNotNull()
    error = (
        F.when(assume.isNull(), NO_ASSUME)
        .when(ask.isNull(), NO_ASK)
        .when(e.isNull(), "the ASSUME line is no equation")
        .when(f.isNull(), "the ASK line is no equation")
    )
    return F.struct(
        F.when(~parsed, "unparseable").when(transform.isNotNull(), "correct").otherwise("wrong").alias("status"),
        F.when(parsed, transform).alias("transform"),
        F.when(parsed, A.canonical(e)).alias("canonical_answer_e"),
        F.when(parsed, A.canonical(f)).alias("canonical_answer_f"),
        error.alias("error"),
    )


def bucket_of(response: Column, verdict: Column) -> Column:
    transform = verdict["transform"]
    return (
        F.when(response.isNull(), "api-error")
        .when(verdict["status"] != "correct", verdict["status"])
        .when(transform["dual"], "correct-dualized")
        .when(transform["swap_e"] | transform["swap_f"], "correct-swapped")
        .otherwise("exact")
    )


def matching_duals(tokens: Column, truth: Column) -> Column:
    """Under which readings, (false: as it is, true: dual), a law is the truth up to swapped sides."""
    def fits(tokens: Column) -> Column:
        return A.let(tokens, lambda t: (A.canonical(t) == truth) | (A.canonical(A.swapped(t)) == truth))

    return F.array_compact(F.array(F.when(fits(tokens), F.lit(False)), F.when(fits(A.dual(tokens)), F.lit(True))))


def error_type(status: Column, e: Column, f: Column, true_e: Column, true_f: Column) -> Column:
    """Which law a failed answer still has right."""
    def of(x: Column) -> Column:
        return _error_type(status, e, f, x["assume"], x["ask"])

    return A.let(F.struct(matching_duals(e, true_e).alias("assume"), matching_duals(f, true_f).alias("ask")), of)


def _error_type(status: Column, e: Column, f: Column, assume: Column, ask: Column) -> Column:
    return (
        F.when((status == "unparseable") | e.isNull() | f.isNull(), "unparseable")
        .when((F.size(assume) > 0) & (F.size(ask) > 0), F.when(F.arrays_overlap(assume, ask), "grader_mismatch").otherwise("inconsistent_operation_direction"))
        .when(F.size(assume) > 0, "ask_wrong_only")
        .when(F.size(ask) > 0, "assume_wrong_only")
        .otherwise("both_wrong")
    )


def synthesize_answer(canonical_e: Column, canonical_f: Column) -> Column:
    return F.concat(F.lit("ASSUME: "), A.to_prefix(canonical_e), F.lit("\nASK: "), A.to_prefix(canonical_f))
