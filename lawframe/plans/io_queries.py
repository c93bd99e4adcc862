"""Queries that write given rows in the reference's formats and read them back, and streams over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lawframe.functions import algebra as A
from lawframe.functions.labels import FORM_ORDER
from lawframe.operators import attempts as T
from lawframe.operators import corpus, summary
from lawframe.operators.attempts import latest_graded
from lawframe.plans.attempt_queries import _LATEST, _SUMMARY, CELL, _models
from lawframe.plans.registry import query
from lawframe.plans.views import attempts, attempts_sql, forms_sql, law_pairs, laws
from lawframe.session import scratch_folder
from lawframe.sources import io
from lawframe.streaming.latest import run_incremental_latest, run_incremental_summary


def _folder(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    return scratch_folder(spark, "io")


@query("scan_equations", forms_sql("SELECT row_number() OVER (ORDER BY law_no) AS law_no, equation FROM laws"))
def scan_equations(spark, sf_dir):
    path = _folder(spark)
    # as many files as the sort has ranges, named in their order
    laws(spark, sf_dir).orderBy("law_no").select("equation").write.text(path)
    return io.scan_equations(spark, path)


#: Law numbers whose lists, a file per hundred, one task writes.
LISTED_A_TASK = 5_000


@query(
    "content_digest",
    forms_sql(
        """, numbered AS (SELECT law_no // 100 AS list, equation, row_number() OVER (PARTITION BY law_no // 100 ORDER BY law_no) - 1 AS place FROM laws),
plain AS (SELECT list, sha256(string_agg(equation, chr(10) ORDER BY place) || chr(10)) AS sha256, count(*) AS n_lines FROM numbered GROUP BY list),
leaves AS (SELECT list, place // 8 AS block, sha256(string_agg(equation || chr(10), '' ORDER BY place)) AS h FROM numbered GROUP BY ALL),
inner_nodes AS (SELECT list, block // 8 AS block, sha256(string_agg(h, '' ORDER BY block)) AS h FROM leaves GROUP BY list, block // 8),
roots AS (SELECT list, sha256(string_agg(h, '' ORDER BY block)) AS tree FROM inner_nodes GROUP BY list)
SELECT list, sha256, n_lines, tree FROM plain JOIN roots USING (list)"""
    ),
)
def content_digest(spark, sf_dir):
    """A list of equations per hundred law numbers, each a file, with the digest of its bytes and the one of its tree of lines."""
    path = _folder(spark)
    lists = laws(spark, sf_dir).withColumn("list", F.floor(F.col("law_no") / 100))
    # a file takes longer than its rows, so that lists are dealt to tasks by number, and each task puts its own files in place
    tasks = max(1, -(-lists.count() // LISTED_A_TASK))
    ordered = lists.repartition(tasks, "list").sortWithinPartitions("list", "law_no").select("list", "equation")
    ordered.write.option("mapreduce.fileoutputcommitter.algorithm.version", 2).partitionBy("list").text(path)
    number = F.regexp_extract("path", r"list=(\d+)/", 1).cast("long").alias("list")
    # the folder rather than a glob, which the driver would follow by itself
    plain = io.content_digest(spark, path).select(number, "sha256")
    return plain.join(io.tree_digest(spark, path, fan=8, levels=2).select(number, "n_lines", "tree"), "list")


def _result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = attempts(spark, sf_dir).select("form", "regime", "pair_id", "model", "ops_total", "depth", F.col("reasoning_tokens").cast("long").alias("reasoning_tokens"), "latency_s", "bucket")
    return have.select(*[F.col(f.name) if f.name in have.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(io.RESULTS)])


def _run_folders(spark: SparkSession, sf_dir: str) -> str:
    """Each (form, regime) as a run directory of the three tables."""
    path, rows = _folder(spark), _result_rows(spark, sf_dir)
    for form in FORM_ORDER:
        for regime in ("off", "on"):
            run = f"{path}/{form}-{regime}"
            own = rows.where((F.col("form") == form) & (F.col("regime") == regime))
            own.write.json(f"{run}/results.jsonl")
            own.groupBy("pair_id").agg(F.first("form").alias("form"), F.max("depth").alias("depth")).write.json(f"{run}/samples.jsonl")
            size = own.agg(F.countDistinct("pair_id").alias("n"), F.array_sort(F.collect_set("model")).alias("models"))
            size.withColumns({"form": F.lit(form), "reasoning_regime": F.lit(regime)}).coalesce(1).write.json(f"{run}/run_meta.json")
    return path


@query(
    "scan_runs",
    attempts_sql(
        """, runs AS (SELECT form, regime, count(DISTINCT pair_id)::INT AS n, array_to_string(list_sort(list(DISTINCT model)), ',') AS models FROM attempts GROUP BY ALL),
samples AS (SELECT form, regime, pair_id, max(depth) AS sample_depth FROM attempts GROUP BY ALL)
SELECT a.form || '-' || a.regime AS run, a.form, a.regime, n, models, a.pair_id, model, ops_total, depth, bucket, reasoning_tokens::BIGINT AS reasoning_tokens, latency_s, sample_depth
FROM attempts a JOIN runs USING (form, regime) JOIN samples s ON a.form = s.form AND a.regime = s.regime AND a.pair_id = s.pair_id"""
    ),
)
def scan_runs(spark, sf_dir):
    """Run directories are written and read again: every result row beside its run's metadata and its sample; the folder's name tells the run."""
    meta, samples, results = io.scan_runs(spark, f"{_run_folders(spark, sf_dir)}/*")
    told = meta.select("run", F.col("reasoning_regime").alias("meta_regime"), "n", F.array_join("models", ",").alias("models"))
    mine = samples.select("run", "pair_id", F.col("depth").alias("sample_depth"))
    rows = results.join(told, "run").where("regime = meta_regime").join(mine, ["run", "pair_id"])
    return rows.select("run", "form", "regime", "n", "models", "pair_id", "model", "ops_total", "depth", "bucket", "reasoning_tokens", "latency_s", "sample_depth")


@query("discover_runs", attempts_sql("SELECT DISTINCT form, regime, form || '-' || regime AS run FROM attempts"))
def discover_runs(spark, sf_dir):
    meta, *_ = io.scan_runs(spark, f"{_run_folders(spark, sf_dir)}/*")
    return T.discover_runs(meta.select("form", F.col("reasoning_regime").alias("regime"), "run"), ["form", "regime"])


@query("write_results", attempts_sql("SELECT regime, bucket, count(*) AS n FROM attempts GROUP BY ALL"))
def write_results(spark, sf_dir):
    """A batch per regime to one log, each written twice, as a job that is run again does; read back."""
    path = _folder(spark)
    rows = _result_rows(spark, sf_dir)
    for regime in ("off", "on", "off", "on"):
        io.write_results(rows.where(F.col("regime") == regime), path, ["regime"], batch=f"regime {regime}")
    return io.read_results(spark, path).groupBy("regime", "bucket").agg(F.count(F.lit(1)).alias("n"))


@query("write_csv_report", attempts_sql("SELECT form, regime, count(*)::VARCHAR AS n FROM attempts GROUP BY ALL"))
def write_csv_report(spark, sf_dir):
    path = _folder(spark)
    counts = attempts(spark, sf_dir).groupBy("form", "regime").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("left_out"))
    io.write_csv_report(counts, ["form", "regime", "n"], path)
    return spark.read.option("header", True).csv(path)


@query("write_run_dir", attempts_sql(_SUMMARY + "SELECT model, graded, good AS correct FROM sums WHERE model <> 'm9'"))
def write_run_dir(spark, sf_dir):
    path = _folder(spark)
    rows = latest_graded(attempts(spark, sf_dir), CELL)
    told = summary.model_summary(rows.withColumn("response", F.col("bucket")), rows.select("model").distinct())
    told = told.select("model", "graded", (F.col("exact") + F.col("correct_swapped") + F.col("correct_dualized")).alias("correct"))
    io.write_run_dir(path, rows.select("form", "regime").distinct(), rows.select("pair_id").distinct(), rows, told)
    return spark.read.schema("model string, graded long, correct long").json(f"{path}/summary")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = corpus.render_literal(law_pairs(spark, sf_dir))
    meta = {
        "theme": F.lit("literal"), "style": F.lit("literal"), "equation_e": F.col("e_text"), "equation_f": F.col("f_text"), "canonical_e": F.col("canonical_e"),
        "canonical_f": F.col("canonical_f"), "label_e": F.concat(F.lit("E"), F.col("e_no").cast("string")), "label_f": F.concat(F.lit("E"), F.col("f_no").cast("string")),
    }
    kinds = {f.name: f.dataType for f in StructType.fromDDL(io.RECORD)["metadata"].dataType}
    return pairs.select(F.col("description").alias("story"), F.struct(*[meta.get(n, F.lit(None)).cast(t).alias(n) for n, t in kinds.items()]).alias("metadata"))


@query("scan_corpus_record", forms_sql("SELECT 'E' || e_no AS label_e, 'E' || f_no AS label_f, canon_e AS canonical_e, canon_f AS canonical_f FROM pairs"))
def scan_corpus_record(spark, sf_dir):
    path = _folder(spark)
    _records(spark, sf_dir).write.json(path)
    found = io.scan_corpus_records(spark, path, lines=True)
    return found.select("metadata.label_e", "metadata.label_f", "metadata.canonical_e", "metadata.canonical_f")


@query("write_corpus", forms_sql("SELECT 'E' || e_no || '-E' || f_no || '-literal' AS record_key FROM pairs"))
def write_corpus(spark, sf_dir):
    """Written twice, the second time in part: no key is there twice."""
    path = _folder(spark)
    records = _records(spark, sf_dir)
    m = {c: F.col(f"metadata.{c}") for c in ("label_e", "label_f", "theme", "canonical_e", "canonical_f")}
    key = A.record_key(m["label_e"], m["label_f"], m["theme"], m["canonical_e"], m["canonical_f"])
    io.write_corpus(records, key, path)
    io.write_corpus(records.where(F.length("metadata.label_e") < 4), key, path)
    return io.corpus_table(spark, path).rows().select("record_key")


def _landed(spark: SparkSession, sf_dir: str) -> tuple[str, str, DataFrame]:
    folder = _folder(spark)
    rows = attempts(spark, sf_dir).select("form", "regime", "pair_id", "model", "seq", "bucket", "answer_class", "reasoning_tokens")
    rows.repartitionByRange(4, "seq").write.parquet(f"{folder}/landed")
    return folder, f"{folder}/landed", rows


@query("incremental_latest", attempts_sql(_LATEST + "SELECT form, regime, pair_id, model, seq, bucket FROM latest"))
def incremental_latest(spark, sf_dir):
    folder, landed, rows = _landed(spark, sf_dir)
    final = run_incremental_latest(spark, landed, rows.schema, CELL, f"{folder}/state", f"{folder}/offsets", files_per_batch=2)
    return final.select(*CELL, "seq", "bucket")


@query(
    "incremental_summary",
    attempts_sql(_SUMMARY + "SELECT model, graded, good / nullif(graded, 0) AS correct_rate, median_response_len, rows_with_reasoning, median_reasoning_tokens FROM sums"),
)
def incremental_summary(spark, sf_dir):
    folder, landed, rows = _landed(spark, sf_dir)
    told = run_incremental_summary(
        spark, landed, rows.schema, CELL, f"{folder}/state", f"{folder}/offsets", _models(spark), files_per_batch=2, response="concat(bucket, answer_class)"
    )
    return told.select("model", "graded", "correct_rate", "median_response_len", "rows_with_reasoning", "median_reasoning_tokens")
