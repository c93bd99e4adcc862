"""URL filters: host rules, and gradient-boosted trees on lexical features for the rest.

Everything is built-in column expressions; the trees are Spark's own, trained
from URLs that carry a label (here, those that a rule decides) on a bounded
sample: the `train_rows` labelled URLs of least hash. Rule lookup, features,
suffix statistics and scoring cover every row.

Suffix statistics are the smoothed share of blocked URLs for each last host
label among the labelled URLs, one aggregate over all of them. A suffix that
no label has gets the overall share.

In training, a row's suffix has the share that the labels outside its own fold
have, one of `FOLDS` by hash, so that no row tells its own label.

Defined results: a null url, or one without `://`, has an empty host and path
and fits no rule; it is judged by its features: those of the host and the path
are those of empty text, those of the whole url (length, digits, parameters) are
counted as in any other, for a null url as for an empty one. With
fewer than two classes among the labels the trees can't be trained, and the
verdict is the only class, or allow. An empty host has a depth of one, as empty text has one
part, and the overall share as its suffix's. A url of any length is judged whole. Repeated rows each come out. Other
columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawframe.llm.common import checkpointed, small

#: Fixed values: (verdict, host, path); a rule fits its host and all subdomains.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
TRAIN_ROWS = 20_000
#: Parts of the labelled URLs for the suffix shares in training.
FOLDS = 10
FEATURES = ("length", "host_length", "depth", "host_depth", "digit_ratio", "entropy", "params", "hyphens", "longest_label", "suffix_rate")


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest rule that fits, as (length, rule, verdict), else null."""
    fits = [
        F.when(
            ((host == F.lit(h)) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)),
            F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for v, h, p in rules
    ]
    return F.array_max(F.array_compact(F.array(*fits)))


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits: equal ones are counted as runs of the sorted characters."""
    chars = F.array_sort(F.filter(F.split(text, ""), lambda c: c != ""))
    n = F.length(text).cast("double")
    start = F.struct(F.lit("").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("total"))
    weight = lambda x: F.when(x > 1, x * F.log2(x)).otherwise(0.0)

    def step(s: Column, c: Column) -> Column:
        same = s["last"] == c
        return F.struct(
            c.alias("last"), F.when(same, s["run"] + 1).otherwise(1.0).alias("run"), F.when(same, s["total"]).otherwise(s["total"] + weight(s["run"])).alias("total")
        )

    total = F.aggregate(chars, start, step, lambda s: s["total"] + weight(s["run"]))
    return F.when(n > 0, F.log2(n) - total / n).otherwise(0.0)


def lexical(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """(page_id, url) with host, path, the rule that fits, and the lexical features."""
    url = F.coalesce(F.col("url"), F.lit(""))
    parsed = pages.select("page_id", url.alias("u"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labels = F.split("host", r"\.")
    size = F.length("u")
    return parsed.select(
        "page_id",
        "host",
        "path",
        best_rule(F.col("host"), F.col("path"), rules).alias("best"),
        F.substring_index("host", ".", -1).alias("suffix"),
        size.cast("double").alias("length"),
        F.length("host").cast("double").alias("host_length"),
        F.regexp_count("path", F.lit("/[^/]")).cast("double").alias("depth"),
        F.size(labels).cast("double").alias("host_depth"),
        F.when(size > 0, F.regexp_count("u", F.lit("[0-9]")) / size).otherwise(0.0).cast("double").alias("digit_ratio"),
        entropy(F.col("host")).alias("entropy"),
        F.when(F.contains("u", F.lit("?")), F.size(F.split(F.substring_index("u", "?", -1), "&"))).otherwise(0).cast("double").alias("params"),
        F.regexp_count("host", F.lit("-")).cast("double").alias("hyphens"),
        F.array_max(F.transform(labels, lambda x: F.length(x))).cast("double").alias("longest_label"),
        F.xxhash64("u", "page_id").alias("draw"),
    )


def judge(pages: DataFrame, rules: tuple = RULES, train_rows: int = TRAIN_ROWS, trees: int = 12, depth: int = 4) -> DataFrame:
    """(page_id, host, path, rule, verdict, score): score is the trees' probability that the URL is to be blocked."""
    rows = checkpointed(lexical(pages, rules))
    label = (F.col("best.verdict") == "block").cast("double")
    known = F.col("best").isNotNull()
    own = F.pmod("draw", F.lit(FOLDS))
    in_fold = [[F.sum(F.when(own == k, x).otherwise(0)) for k in range(FOLDS)] for x in (label, F.lit(1))]
    by_suffix = rows.where(known).groupBy("suffix").agg(
        F.sum(label).alias("bad"), F.count(F.lit(1)).alias("n"), F.array(*in_fold[0]).alias("fold_bad"), F.array(*in_fold[1]).alias("fold_n")
    )
    overall = by_suffix.agg(F.coalesce(F.sum("bad"), F.lit(0.0)).alias("bad"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    share = overall["bad"] / overall["n"] if overall["n"] else 0.0
    rates = small(by_suffix.withColumnRenamed("suffix", "of"))
    rate = lambda bad, n: (bad + 10 * share) / (n + 10)
    full = rows.join(rates, F.col("suffix") == F.col("of"), "left").withColumn("suffix_rate", F.coalesce(rate(F.col("bad"), F.col("n")), F.lit(share)))
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    vectors = assembler.transform(full)
    if 0 < overall["bad"] < overall["n"]:
        labelled = full.where(known).withColumn("suffix_rate", rate(F.col("bad") - F.get("fold_bad", own), F.col("n") - F.get("fold_n", own)))
        train = assembler.transform(labelled).select("features", label.alias("label"), "draw").orderBy("draw").limit(train_rows)
        model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7, maxMemoryInMB=64).fit(checkpointed(train.select("features", "label")))
        scored = model.transform(vectors).withColumn("score", vector_to_array("probability")[1])
    else:
        scored = vectors.withColumn("score", F.lit(share))
    method = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", method).alias("verdict"), "score")
