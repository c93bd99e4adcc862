"""Majority votes over repeated passes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lawframe.operators.attempts import API_ERROR, is_correct, latest_graded
from lawframe.operators.order import numbered

ABSTAIN = ("unparseable", API_ERROR)
KEYS = ["pair_id", "model"]
#: Models up to which their list is broadcast.
BROADCAST_MODELS = 10_000


def passes_of(rows: DataFrame) -> DataFrame:
    """One row per (pair_id, model, pass): the one that counts."""
    return latest_graded(rows, [*KEYS, "pass"])


def majority_vote(passes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per key the earliest row of the class with most votes, with how the vote went.

    Ties go to the class seen first. Unparseable rows and failed calls abstain;
    if all do, the first row that is no failed call comes out, else the first.
    `vote_k` counts the rows there are. Two aggregates with partial sums; a row is
    carried per class, so no key's rows meet in a list.
    """
    keys = keys or KEYS
    row = F.struct(*[c for c in passes.columns if c not in keys])
    ballot = F.when(~F.col("bucket").isin(*ABSTAIN), F.col("answer_class"))
    failed = F.col("bucket") == API_ERROR
    classes = passes.groupBy(*keys, ballot.alias("class")).agg(
        F.count(F.lit(1)).alias("votes"), F.min("pass").alias("first"), F.min_by(row, F.struct(failed, "pass")).alias("row"), F.min(F.struct(failed, "pass")).alias("order")
    )
    valid = F.col("class").isNotNull()
    votes = classes.groupBy(*keys).agg(
        F.sum("votes").cast("int").alias("vote_k"),
        F.coalesce(F.sum(F.when(valid, F.col("votes"))), F.lit(0)).cast("int").alias("valid_ballots"),
        F.count_if(valid).cast("int").alias("distinct_classes"),
        F.coalesce(F.max(F.when(valid, F.col("votes"))), F.lit(0)).cast("int").alias("votes_for_winner"),
        F.max_by(F.struct("class", "row"), F.when(valid, F.struct("votes", -F.col("first")))).alias("winner"),
        F.min_by("row", F.when(~valid, F.col("order"))).alias("fallback"),
        F.collect_list(F.when(valid, F.col("votes"))).alias("each"),
    )
    top = F.size(F.filter("each", lambda v: v == F.col("votes_for_winner")))
    chosen = F.coalesce(F.col("winner.row"), F.col("fallback"))
    return votes.withColumn("chosen", chosen).select(
        *keys,
        "chosen.*",
        "vote_k",
        "valid_ballots",
        (F.col("vote_k") - F.col("valid_ballots")).alias("abstentions"),
        "votes_for_winner",
        "distinct_classes",
        ((F.col("distinct_classes") > 0) & (top > 1)).alias("tie"),
        F.col("chosen.pass").alias("source_pass"),
        F.col("winner.class").alias("winner_class"),
    )


def vote_at_k(passes: DataFrame, ks: list[int]) -> DataFrame:
    """Votes over the first k passes for each k, with one shuffle for all: as majority_vote of each.

    A key's passes up to the largest k, one row each, are put in order, and tallies of classes run
    along them; what the running vote was after the last pass that each k has comes out.
    """
    most = max(ks)
    carried = [c for c in passes.columns if c not in KEYS]
    ballot = F.when(~F.col("bucket").isin(*ABSTAIN), F.col("answer_class"))
    one = F.struct(F.col("pass").alias("at"), ballot.alias("class"), (F.col("bucket") == API_ERROR).alias("failed"), F.struct(*carried).alias("row"))
    found = passes.where(F.col("pass") <= most).groupBy(*KEYS).agg(F.collect_list(one).alias("rows"))
    in_order = F.array_sort("rows", lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0))
    found = found.withColumn("rows", in_order)
    kind = found.schema["rows"].dataType.elementType
    row = kind["row"].dataType.simpleString()
    tally = "array<struct<class:string,votes:int,row:{0}>>".format(row)
    state = f"struct<n:int,valid:int,tallies:{tally},best:struct<class:string,votes:int,row:{row}>,fallback:struct<failed:boolean,row:{row}>>"

    def count(s: Column, r: Column) -> Column:
        """The state with one pass more: a class that draws level with the leading one stays behind it, as it was seen later or caught up."""
        tallies, mine = s["tallies"], r["class"]
        known = F.exists(tallies, lambda t: t["class"] == mine)
        raised = F.transform(tallies, lambda t: F.struct(t["class"].alias("class"), (t["votes"] + (t["class"] == mine).cast("int")).alias("votes"), t["row"].alias("row")))
        grown = F.when(known, raised).otherwise(F.array_append(tallies, F.struct(mine.alias("class"), F.lit(1).alias("votes"), r["row"].alias("row"))))
        now = F.when(mine.isNull(), tallies).otherwise(grown)
        better = s["fallback"].isNull() | (s["fallback"]["failed"] & ~r["failed"])
        fallback = F.when(mine.isNotNull(), s["fallback"]).when(better, F.struct(r["failed"].alias("failed"), r["row"].alias("row"))).otherwise(s["fallback"])
        # classes stand in the order in which they were first seen, so the first of most votes leads
        lead = F.aggregate(now, F.lit(None).cast(kind_of_best), lambda b, t: F.when(b.isNull() | (t["votes"] > b["votes"]), t).otherwise(b))
        return F.struct((s["n"] + 1).alias("n"), (s["valid"] + mine.isNotNull().cast("int")).alias("valid"), now.alias("tallies"), lead.alias("best"), fallback.alias("fallback")).cast(state)

    kind_of_best = f"struct<class:string,votes:int,row:{row}>"
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("valid"), F.array().cast(tally).alias("tallies"), F.lit(None).cast(kind_of_best).alias("best"), F.lit(None).cast(f"struct<failed:boolean,row:{row}>").alias("fallback")).cast(state)

    def upto(k: int) -> Column:
        return F.struct(F.lit(k).alias("k"), F.aggregate(F.filter("rows", lambda r: r["at"] <= k), start, count).alias("vote"))

    each = found.select(*KEYS, F.explode(F.array(*[upto(k) for k in ks])).alias("v")).select("v.k", *KEYS, "v.vote").where("vote.n > 0")
    vote = F.col("vote")
    leading = F.coalesce(vote["best"]["votes"], F.lit(0))
    chosen = F.coalesce(vote["best"]["row"], vote["fallback"]["row"])
    return each.withColumn("chosen", chosen).select(
        "k",
        *KEYS,
        "chosen.*",
        vote["n"].alias("vote_k"),
        vote["valid"].alias("valid_ballots"),
        (vote["n"] - vote["valid"]).alias("abstentions"),
        leading.alias("votes_for_winner"),
        F.size(vote["tallies"]).alias("distinct_classes"),
        (F.size(F.filter(vote["tallies"], lambda t: t["votes"] == leading)) > 1).alias("tie"),
        F.col("chosen.pass").alias("source_pass"),
        vote["best"]["class"].alias("winner_class"),
    )


def multi_pass_join(passes: DataFrame, k: int, expected: DataFrame | None = None) -> DataFrame:
    """(pair_id, model, buckets, present, missing): the rows of passes 1 to k in order, and how many lack.

    With `expected` (pair_id, model), those alone and each of them; ValueError names some that no pass covers.
    """
    rows = passes.where(F.col("pass").between(1, k))
    if expected is not None:
        rows = rows.join(expected.select(*KEYS).distinct(), KEYS, "right")
    found = rows.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.when(F.col("pass").isNotNull(), F.struct("pass", "bucket")))).alias("rows"))
    if expected is not None and (lacking := found.where(F.size("rows") == 0).orderBy(*KEYS).limit(20).collect()):  # for the message
        raise ValueError("no pass has a row for " + ", ".join(f"{r['pair_id']} {r['model']}" for r in lacking))
    return found.select(*KEYS, F.array_join(F.transform("rows", lambda r: r["bucket"]), ",").alias("buckets"), F.size("rows").alias("present"), (k - F.size("rows")).alias("missing"))


#: What runs of one experiment have in common.
SHARED_META = ("models", "form", "reasoning_regime", "prompt_template_sha256", "equations_sha256", "label_prefix", "seed", "temperature")


def coverage_differences(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, only_in): distinct keys that only one of two runs covers; none if they cover the same."""
    both = a.select(*keys).distinct().withColumn("run", F.lit("a")).unionByName(b.select(*keys).distinct().withColumn("run", F.lit("b")))
    return both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("run").alias("only_in")).where("n = 1").drop("n")


def pass_differences(samples: DataFrame, meta: DataFrame, shared: tuple[str, ...] = SHARED_META) -> DataFrame:
    """(pass, differs, n): where a pass differs from the first one.

    `samples` has the ordered list of each pass (pass, place, pair_id, prompt_hash):
    entries that only one of the two lists has count under "samples". `meta` has a
    row per pass; each shared key with another value, null like any, counts once.
    """
    first = meta.agg(F.min("pass")).first()[0]
    others = meta.where(F.col("pass") != first)
    entries = samples.groupBy("place", "pair_id", "prompt_hash").agg(F.collect_set("pass").alias("passes"))
    each = entries.select(F.explode("passes").alias("pass"), F.array_contains("passes", F.lit(first)).alias("shared"))
    sizes = each.groupBy("pass").agg(F.count(F.lit(1)).alias("own"), F.count_if("shared").alias("common"))
    # a row per pass from here on; a pass without samples lacks all of the first one's
    sizes = meta.select("pass").join(sizes, "pass", "left").na.fill(0, ["own", "common"])
    want = F.max(F.when(F.col("pass") == first, F.col("own"))).over(Window.partitionBy())
    lists = sizes.withColumn("n", want + F.col("own") - 2 * F.col("common")).where((F.col("pass") != first) & (F.col("n") > 0)).select("pass", F.lit("samples").alias("differs"), "n")
    values = lambda df: df.select("pass", F.explode(F.array(*[F.struct(F.lit(k).alias("differs"), F.col(k).cast("string").alias("value")) for k in shared])).alias("m")).select("pass", "m.*")
    want = values(meta.where(F.col("pass") == first)).select("differs", F.col("value").alias("wanted"))
    keys = values(others).join(want, "differs").where(~F.col("value").eqNullSafe(F.col("wanted")))
    return lists.unionByName(keys.select("pass", "differs", F.lit(1).cast("long").alias("n")))


def check_consistency(samples: DataFrame, meta: DataFrame, shared: tuple[str, ...] = SHARED_META) -> None:
    """ValueError naming the passes that sample other prompts than the first, or differ from it in metadata."""
    found = pass_differences(samples, meta, shared).orderBy("pass", "differs").collect()  # passes times shared keys at most
    if found:
        raise ValueError("; ".join(f"pass {r['pass']} differs in {r['differs']}" for r in found))


def baseline_subset(baseline: DataFrame, samples: DataFrame, baseline_samples: DataFrame, models: DataFrame, baseline_models: DataFrame | None = None) -> DataFrame:
    """The baseline's rows of the passes' `models` (place, model), numbered in sample and model order by `at`.

    `samples` and `baseline_samples` (place, pair_id, prompt_hash) are the ordered lists of the passes and of
    the baseline: ValueError unless they are the same, prompts too. ValueError names models that the
    baseline, by its rows or else `baseline_models` (model), lacks.
    """
    known = (baseline if baseline_models is None else baseline_models).select("model").distinct()
    if lacking := [r["model"] for r in models.select("model").distinct().join(known, "model", "left_anti").orderBy("model").collect()]:  # of a short list
        raise ValueError(f"the baseline lacks models: {', '.join(lacking)}")
    entry = ["place", "pair_id", "prompt_hash"]
    other = samples.select(*entry, F.lit(1).alias("side")).unionByName(baseline_samples.select(*entry, F.lit(-1).alias("side"))).groupBy(*entry).agg(F.sum("side").alias("side")).where("side <> 0")
    if differing := other.orderBy("place").limit(5).collect():
        raise ValueError("the baseline samples other pairs or prompts: " + ", ".join(f"{r['pair_id']} at {r['place']}" for r in differing))
    # a model's place in a short list; the samples' places number the rows
    listed = models.groupBy("model").agg(F.min("place").alias("model place"))
    placed = baseline.join(F.broadcast(listed) if listed.count() <= BROADCAST_MODELS else listed, "model").join(samples.select("pair_id", F.col("place").alias("sample place")), "pair_id")
    return numbered(placed, ["sample place", "model place"], "at").drop("sample place", "model place")


def agreement_curve(votes: DataFrame) -> DataFrame:
    """(votes_for_winner, n, correct_rate, unanimous, tie_broken, all_abstain)."""
    return votes.groupBy("votes_for_winner").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(is_correct(F.col("bucket")).cast("double")).alias("correct_rate"),
        F.count_if((F.col("valid_ballots") > 0) & (F.col("votes_for_winner") == F.col("vote_k"))).alias("unanimous"),
        F.count_if("tie").alias("tie_broken"),
        F.count_if(F.col("valid_ballots") == 0).alias("all_abstain"),
    )


def confidence_gate(votes: DataFrame, thresholds: list[int]) -> DataFrame:
    """(threshold, answered, coverage, precision) when only votes of at least the threshold are answered."""
    by = votes.groupBy("votes_for_winner").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_correct(F.col("bucket"))).alias("good"))
    total = F.sum("n").over(Window.partitionBy())
    each = by.withColumn("all", total).withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    met = F.col("votes_for_winner") >= F.col("threshold")
    sums = each.groupBy("threshold").agg(F.sum(F.when(met, F.col("n")).otherwise(0)).alias("answered"), F.sum(F.when(met, F.col("good")).otherwise(0)).alias("good"), F.first("all").alias("all"))
    return sums.select("threshold", "answered", F.try_divide("answered", "all").alias("coverage"), F.try_divide("good", "answered").alias("precision"))
