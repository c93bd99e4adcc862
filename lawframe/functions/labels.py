"""Labels, prompts and hashes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The template that each form uses unless a run says otherwise, and the order of forms.
DEFAULT_TEMPLATES = {"story": "formalize_prompt.md", "literal": "literal_prompt.md", "two-stage": "abstract_prompt.md"}
FORM_ORDER = ("story", "literal", "two-stage")


def prompt_hash(text: Column) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 12)


def condition_label(label: Column, regime: Column) -> Column:
    return F.coalesce(F.when(label != "", label), F.when(regime == "off", "no-think").when(regime == "on", "all-think").otherwise("legacy"))


def arm_label(form: Column, template: Column) -> Column:
    """The form, and what a template of its own adds to it."""
    default = F.coalesce(*[F.when(form == f, F.lit(t)) for f, t in DEFAULT_TEMPLATES.items()], F.lit(""))
    stem = F.regexp_replace(F.substring_index(template, "/", -1), r"\.[^.]*$", "")
    words = F.replace(F.replace(F.replace(stem, F.lit("formalize_"), F.lit("")), F.lit("_prompt"), F.lit("")), F.lit("_"), F.lit(" + "))
    plain = F.coalesce(template == default, F.lit(True)) | (template == "")
    return F.when(plain, form).otherwise(F.concat(form, F.lit(" + "), words))


def arm_order(arm: Column) -> Column:
    base = F.substring_index(arm, " + ", 1)
    return F.coalesce(*[F.when(base == f, i) for i, f in enumerate(FORM_ORDER)], F.lit(9))


def sampling_label(sampling: Column, pair_n: Column, model_n: Column, n: Column) -> Column:
    """Complex or Stratified, and the number of pairs; without one, rows per model, else rows."""
    size = F.coalesce(pair_n, F.when(model_n > 0, F.floor(n / model_n)), n).cast("long")
    return F.concat(F.when(sampling == "uniform", "Complex ").otherwise("Stratified "), size.cast("string"))


def sample_tag(pairs: Column, stratify_ops: Column, stratify_eq_ops: Column) -> Column:
    """How a run samples, and how many pairs; numbers per bin that are null or 0 do not count."""
    kind = F.when(stratify_eq_ops > 0, "balanced ").when(stratify_ops > 0, "stratified ").otherwise("uniform ")
    return F.concat(kind, pairs.cast("string"))


def group_name(label: Column, regime: Column) -> Column:
    """A sampling label and the regime."""
    return F.concat(label, F.when(regime == "off", " / Reasoning off").otherwise(" / Reasoning on"))


#: The phrases of titles are fixed values.
def experiment_title(pairs: Column, stratify_ops: Column, stratify_eq_ops: Column, eq_bins: Column, bins: Column, seed: Column, arms: Column, labels: Column) -> Column:
    """The title of runs over the same pairs: how they were sampled, the seed, and the arms or the conditions compared.

    `bins` are the pairs' operation counts, `arms` and `labels` those of the runs, all with repeats; labels keep their order.
    """
    n = F.concat(pairs.cast("string"), F.lit(" pairs, "))
    low, high = F.array_min(bins), F.array_max(bins)
    balanced = F.concat(
        n, stratify_eq_ops.cast("string"), F.lit(" per per-equation operation bin "), F.replace(F.coalesce(F.when(eq_bins != "", eq_bins), F.lit("1:10")), F.lit(":"), F.lit("–")),
        F.lit(", both laws from the same bin"),
    )
    less = F.when(low > 1, F.concat(F.lit(" minus vacuous-law pairs (bins "), low.cast("string"), F.lit("–"), high.cast("string"), F.lit(" remain)"))).otherwise("")
    stratified = F.concat(n, stratify_ops.cast("string"), F.lit(" per operation-count bin 1–8"), less)
    how = F.when(stratify_eq_ops > 0, balanced).when(stratify_ops > 0, stratified).otherwise(F.concat(pairs.cast("string"), F.lit(" uniformly sampled pairs")))
    ordered = F.transform(F.array_sort(F.transform(F.array_distinct(arms), lambda a: F.struct(arm_order(a).alias("o"), a.alias("a")))), lambda x: x["a"])
    several = F.size(ordered) > 1
    names = F.array_distinct(labels)
    compared = F.when(several, F.concat(F.array_join(ordered, " vs "), F.lit(" · "), F.array_join(names, " and "))).otherwise(F.array_join(names, " vs "))
    return F.concat(how, F.lit(" · seed "), seed.cast("string"), F.lit(" · "), compared)


def short_model(model: Column) -> Column:
    return F.regexp_replace(model, "^[^/]*/", "")


def run_stem(name: Column) -> Column:
    return F.regexp_replace(name, r"-pass\d+$", "")


def build_prompt(template: Column, story: Column) -> Column:
    return F.replace(template, F.lit("{story}"), story)


def build_example_prompt(template: Column, examples: Column, k: Column, story: Column) -> Column:
    """The template with the first k examples, each under a heading, and the target's story."""
    blocks = F.transform(F.slice(examples, F.lit(1), k), lambda x, i: F.concat(F.lit("### Example story "), (i + 1).cast("string"), F.lit("\n\n"), x))
    return F.replace(F.replace(template, F.lit("{examples}"), F.array_join(blocks, "\n\n")), F.lit("{story}"), story)


#: The model family and its switch are fixed values.
def wrap_prompt(prompt: Column, prefix: Column, suffix: Column, regime: Column, model: Column) -> Column:
    """Prefix and suffix of (regime, form), null for none, around a prompt; a switch that one model family has, after it."""
    switch = F.when((regime == "off") & F.startswith(model, F.lit("qwen/qwen3")), "\n/no_think").otherwise("")
    return F.concat(F.coalesce(prefix, F.lit("")), prompt, F.coalesce(suffix, F.lit("")), switch)


#: Fixed value: a section marker line.
_MARKER = r"(?md)^[ \t]*(?:#{1,6}[ \t]*)?\**[ \t]*(GRAMMAR|ENCODING)\b\**[ \t]*:?\**[ \t]*$"


def split_sections(text: Column) -> Column:
    """(grammar, encoding): what follows the last ENCODING marker, and the last GRAMMAR marker before it; null where there is none."""
    marker = lambda word: _MARKER.replace("(GRAMMAR|ENCODING)", word)
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    # greedy: as much as possible before the last marker
    before = F.regexp_extract(text, rf"(?s)\A(.*){marker('ENCODING')}(.*)\z", 1)
    after = F.regexp_extract(text, rf"(?s)\A.*{marker('ENCODING')}(.*)\z", 1)
    has = F.coalesce(F.regexp_like(text, F.lit(marker("ENCODING"))), F.lit(False))
    grammar = F.when(F.regexp_like(before, F.lit(marker("GRAMMAR"))), trim(F.regexp_extract(before, rf"(?s)\A.*{marker('GRAMMAR')}(.*)\z", 1)))
    return F.struct(F.when(has, grammar).alias("grammar"), F.when(has, trim(after)).alias("encoding"))


def two_stage_row(first: Column, second: Column, error1: Column, error2: Column, template: Column) -> Column:
    """(stage2_prompt, response, api_error): the second stage gets the first one's response as it is, or nothing if that failed."""
    prompt = F.when(first.isNotNull(), build_prompt(template, first))
    errors = F.concat_ws("; ", F.concat(F.lit("stage 1: "), error1), F.when(first.isNotNull(), F.concat(F.lit("stage 2: "), error2)))
    return F.struct(prompt.alias("stage2_prompt"), F.when(first.isNotNull(), second).alias("response"), F.nullif(errors, F.lit("")).alias("api_error"))
