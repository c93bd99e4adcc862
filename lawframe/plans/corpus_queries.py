"""Queries over themed texts and leakage."""

from __future__ import annotations

import json
from importlib import resources

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawframe.functions import algebra as A
from lawframe.functions import labels as L
from lawframe.operators import corpus
from lawframe.plans.io_queries import _folder
from lawframe.plans.registry import query
from lawframe.plans.views import law_pairs, table
from lawframe.sources import io


THEME_COLUMNS = (*corpus.THEME_FIELDS, "palette", "notes")


def example_themes(spark: SparkSession) -> DataFrame:
    """Two themes of the package, as rows."""
    rows = json.loads(resources.files("lawframe.plans").joinpath("example_themes.json").read_text())
    return spark.createDataFrame([tuple(r.get(c) for c in THEME_COLUMNS) for r in rows], io.THEME)


def themed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pair with the theme that its laws select, of the two in order of their keys."""
    number = A.theme_number(A.canonical(F.col("e")), A.canonical(F.col("f")), 2)
    theme = F.get(F.array(F.lit("bakery"), F.lit("loom")), number)
    return corpus.once_per(law_pairs(spark, sf_dir), ["e", "f"], lambda values, tasks: values.repartition(tasks).withColumn("theme", theme))


def _stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.render_story(themed_pairs(spark, sf_dir), example_themes(spark))


@query("render_story")
def render_story(spark, sf_dir):
    return _stories(spark, sf_dir).select("e_no", "f_no", "theme", "story")


@query("backparse_story")
def backparse_story(spark, sf_dir):
    stories = _stories(spark, sf_dir).select("e_no", "f_no", "theme", "story", "canonical_e", "canonical_f")
    read = corpus.backparse_story(stories, example_themes(spark))
    agrees = (F.col("read_theme") == F.col("theme")) & (F.col("read_e") == F.col("canonical_e")) & (F.col("read_f") == F.col("canonical_f"))
    return read.select("e_no", "f_no", "read_theme", "read_e", "read_f", agrees.alias("agrees"))


@query(
    "leakage_filter",
    r"""SELECT doc_id, regexp_matches(lower(t), '(^|[^\p{L}\p{N}_])(?:equation|equations|law|laws|magma|magmas|implies|implication|implications|theorem|theorems|lemma|axiom|axioms|formula|formulas|variable|variables|quantifier|commutative|associative|lean)($|[^\p{L}\p{N}_])') AS banned_word,
  regexp_matches(t, '[∘◇*=+^⇒→≠()\[\]{}<>]') AS banned_char, regexp_matches(t, '(^|[^\p{L}\p{N}_])[b-hj-zB-HJ-Z]($|[^\p{L}\p{N}_])') AS lone_letter, regexp_matches(t, '[A-Za-z][0-9]|[0-9][A-Za-z]') AS letter_digit FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
)
def leakage_filter(spark, sf_dir):
    flagged = corpus.leakage_filter(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return flagged.select("doc_id", "banned_word", "banned_char", "lone_letter", "letter_digit")


@query("scan_themes", "SELECT lower(replace(n_name, ' ', '_')) AS key, 6 AS names, CASE WHEN n_nationkey % 3 = 0 THEN 'other' ELSE lower(replace(n_name, ' ', '_')) END AS stem, n_nationkey % 3 = 0 AS misnamed FROM nation")
def scan_themes(spark, sf_dir):
    """Nations make themes, a file each, that are written, read and checked against their file names."""
    names = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    base = example_themes(spark).where("key = 'loom'").drop("key")
    rows = names.withColumn("key", F.lower(F.regexp_replace("n_name", " ", "_"))).withColumn("match", F.lit("loom"))
    themed = rows.join(base.withColumn("match", F.lit("loom")), "match").select("n_nationkey", *THEME_COLUMNS)
    path = _folder(spark)
    file = F.concat(F.when(F.col("n_nationkey") % 3 == 0, "other").otherwise(F.col("key")), F.lit(".json"))
    # every third theme is in a file of another name; one of a name holds one theme, as maxRecordsPerFile says
    themed.withColumn("file", file).drop("n_nationkey").write.option("maxRecordsPerFile", 1).partitionBy("file").json(path)
    return io.scan_themes(spark, path).select("key", F.size("palette").alias("names"), "stem", "misnamed")


@query(
    "validate_records",
    "SELECT n_name AS key, CASE WHEN n_nationkey % 3 = 0 THEN 'subject' WHEN n_nationkey % 3 = 1 THEN 'closing is empty' ELSE '' END AS violations FROM nation",
)
def validate_records(spark, sf_dir):
    names = table(spark, sf_dir, "nation").select("n_nationkey", "n_name").withColumn("match", F.lit("loom"))
    base = example_themes(spark).where("key = 'loom'").drop("key").withColumn("match", F.lit("loom"))
    themed = names.join(base, "match").withColumnRenamed("n_name", "key")
    kind = F.col("n_nationkey") % 3
    broken = themed.withColumn("subject", F.when(kind == 0, "they").otherwise(F.col("subject"))).withColumn("closing", F.when(kind == 1, " ").otherwise(F.col("closing")))
    return corpus.validate_records(broken.drop("n_nationkey", "match")).select("key", F.array_join("violations", ",").alias("violations"))


@query(
    "build_example_prompt",
    """WITH e AS (SELECT conv_id, list(text ORDER BY turn) AS texts FROM conversations GROUP BY conv_id)
SELECT conv_id, 'Given' || chr(10) || array_to_string(list_transform(texts[:2], lambda x, i: '### Example story ' || i || chr(10) || chr(10) || x), chr(10) || chr(10)) || chr(10) || 'read ' || texts[-1] AS prompt FROM e""",
)
def build_example_prompt(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where("turn is not null")
    told = turns.groupBy("conv_id").agg(F.min_by("text", "turn").alias("a"), F.min_by(F.struct("turn", "text"), "turn").alias("first"), F.max_by("text", "turn").alias("last"))
    second = turns.join(told.select("conv_id", F.col("first.turn").alias("t0")), "conv_id").where("turn > t0").groupBy("conv_id").agg(F.min_by("text", "turn").alias("b"))
    both = told.join(second, "conv_id", "left")
    examples = F.array_compact(F.array("a", "b"))
    return both.select("conv_id", L.build_example_prompt(F.lit("Given\n{examples}\nread {story}"), examples, F.lit(2), F.col("last")).alias("prompt"))


