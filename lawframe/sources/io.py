"""Readers and writers of equation lists, run directories, themes, records and reports.

Paths are resolved by Spark alone, so any store that Spark reads will do.
Schemas are explicit; a field that a file lacks is null.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lawframe.functions import algebra
from lawframe.operators.corpus import THEME_FIELDS
from lawframe.operators.order import after
from lawframe.session import file_system, names_in, put_text, read_text, shared_folder
from lawframe.sources.keyed import MOST_ROWS, KeyedTable, tasks_for

TRANSFORM = "struct<swap_e:boolean,swap_f:boolean,dual:boolean>"
USAGE = "struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint,cost:double>"
METADATA = (
    "struct<theme:string,style:string,equation_e:string,equation_f:string,canonical_e:string,canonical_f:string,palette_e:map<string,string>,"
    "palette_f:map<string,string>,letters_e:map<string,string>,letters_f:map<string,string>,label_e:string,label_f:string>"
)
LAWS = "law_no bigint, equation string"
RECORD = (f"story string, metadata {METADATA}")
SAMPLES = (
    f"pair_id string, form string, story string, metadata {METADATA}, prompt string, prompt_hash string, ops_e int, ops_f int, ops_total int, depth int"
)
RESULTS = (
    "pair_id string, form string, label_e string, label_f string, theme string, model string, regime string, ops_e int, ops_f int, ops_total int, depth int, "
    "prompt_hash string, sent_prompt_hash string, response string, "
    f"verdict struct<status:string,transform:{TRANSFORM},canonical_answer_e:string,canonical_answer_f:string,error:string>, "
    f"api_error string, usage {USAGE}, latency_s double, routed_model string, provider string, finish_reason string, reasoning_tokens bigint, "
    f"stage1_sent_prompt_hash string, stage1_response string, stage1_usage {USAGE}, stage1_latency_s double, stage1_routed_model string, "
    "stage1_provider string, stage1_finish_reason string, stage1_reasoning_tokens bigint, bucket string, "
    "vote struct<k:int,valid_ballots:int,abstentions:int,votes_for_winner:int,distinct_classes:int,tie:boolean,source_pass:int,winner_class:array<string>>"
)
RUN_META = (
    "timestamp timestamp, seed int, n int, stratify_ops int, stratify_eq_ops int, eq_bins string, label_prefix string, exclude_vacuous boolean, form string, models array<string>, "
    "dry_run boolean, max_tokens int, temperature double, reasoning_regime string, regime_prefix string, regime_suffix string, "
    "native_reasoning map<string,struct<enabled:boolean,effort:string,exclude:boolean>>, equations_sha256 string, prompt_template string, prompt_template_sha256 string, "
    "stage2_template string, stage2_template_sha256 string, stage2_regime_prefix string, stage2_regime_suffix string, condition_label string, baseline_of string, "
    "vote struct<k:int,pass_dirs:array<string>,temperature:double,ballots_exclude:array<string>,tie_break:string,generated_by:string,timestamp:timestamp>"
)
THEME = (", ".join(f"{f} string" for f in THEME_FIELDS) + ", palette array<string>, notes string")


def _run() -> Column:
    """The run directory of a table in it, which is a file or a folder of files."""
    return F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)/(?:run_meta\.json|samples\.jsonl|results\.jsonl)(?:/[^/]*)?$", 1)


def scan_equations(spark: SparkSession, path: str) -> DataFrame:
    """(law_no, equation) by line, from 1, over files in order of their paths; unparsable lines included.

    ValueError if there is no line, or if the first one is no equation. Lines are
    numbered where they are read, and a table of a row per split of a file says
    how many lines come before.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"), F.rtrim("value").alias("equation")
    )
    splits = lines.groupBy("file", "start").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = after(splits, ["file", "start"], "n").select("file", "start", "first", "before")
    found = lines.join(before, ["file", "start"]).select((F.col("before") + F.col("id") - F.col("first") + 1).alias("law_no"), "equation")
    first = found.where("law_no = 1").select(algebra.parse_infix(F.col("equation")).isNotNull().alias("good")).first()
    if first is None:
        raise ValueError(f"{path} has no equations")
    if not first["good"]:
        raise ValueError(f"the first line of {path} is no equation")
    return found


#: Bytes up to which a file is digested as a whole, in one task.
WHOLE_BYTES = (1 << 31) - 1


def content_digest(spark: SparkSession, path: str, most: int = WHOLE_BYTES) -> DataFrame:
    """(path, file, bytes, sha256) of each file; sha256 of its bytes is null for one of more than `most` bytes, for which there is tree_digest."""
    name = F.regexp_extract("path", r"([^/]*)$", 1).alias("file")
    files = spark.read.format("binaryFile").load(path)
    # the reader doesn't open files that the filter on their length leaves out
    small = files.where(F.col("length") <= most).select("path", name, F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > most).select("path", name, F.col("length").alias("bytes"), F.lit(None).cast("string").alias("sha256"))
    return small.unionByName(large)


def tree_digest(spark: SparkSession, path: str, fan: int = 4096, levels: int = 3) -> DataFrame:
    """(path, n_lines, tree) of each file of any size, whatever the splits in which it is read.

    A leaf is the sha256 of `fan` lines, each with its line end, an inner node that of `fan`
    nodes' hexadecimal digests, and the root that of all nodes below it, `levels` levels up; no
    task holds more than `fan` lines or digests but for the root, of fewer than lines / fan^levels.
    A line end is \\n alone, and the last line has one whether or not the file has it.
    """
    # text that is read isn't decoded, so lines keep their bytes; a line's place is known from its split's, as in scan_equations
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"), F.concat("value", F.lit("\n")).alias("node")
    )
    splits = lines.groupBy("path", "start").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    before = splits.select("path", "start", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    nodes = lines.join(before, ["path", "start"]).select("path", (F.col("before") + F.col("id") - F.col("first")).alias("at"), "node", F.lit(1).cast("long").alias("n_lines"))
    for level in range(levels + 1):
        block = F.lit(0).cast("long") if level == levels else F.floor(F.col("at") / fan)
        in_order = F.array_sort(F.collect_list(F.struct("at", "node")))  # places differ, so what they hold isn't compared
        joined = F.array_join(F.transform(in_order, lambda r: r["node"]), "").cast("binary")
        nodes = nodes.groupBy("path", block.alias("block")).agg(F.sha2(joined, 256).alias("node"), F.sum("n_lines").alias("n_lines")).withColumnRenamed("block", "at")
    return nodes.select("path", "n_lines", F.col("node").alias("tree"))


def scan_runs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(meta, samples, results) of the run directories that a glob names, each row with its `run`; blank lines are skipped."""
    meta = spark.read.schema(RUN_META).option("multiLine", True).json(f"{path}/run_meta.json").withColumn("run", _run())
    lines = [spark.read.schema(s).option("mode", "FAILFAST").json(f"{path}/{name}.jsonl").withColumn("run", _run()) for s, name in ((SAMPLES, "samples"), (RESULTS, "results"))]
    return meta, *lines


def scan_themes(spark: SparkSession, path: str) -> DataFrame:
    """Themes with `stem` of the file, or of the folder that a writer made of it (`x.json/part-0` or `file=x.json/part-0`); a key that differs from it is marked in `misnamed`."""
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/=]*)\.json(?:/[^/]*)?$", 1)
    return spark.read.schema(THEME).option("multiLine", True).json(path).withColumn("stem", stem).withColumn("misnamed", ~F.col("key").eqNullSafe(F.col("stem")))


def scan_corpus_records(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Corpus records: a file each as they are authored, or a line each as Spark writes them."""
    return spark.read.schema(RECORD).option("multiLine", not lines).option("mode", "FAILFAST").json(path)


def write_results(rows: DataFrame, path: str, by: list[str], batch: str) -> bool:
    """Append a batch of rows to a log, once: False if the batch is in it already, whatever rows it has now.

    The rows go to a folder of their own; a commit file, which is put in place for one
    writer alone, then makes them part of the log. What a writer that died, or one that came second,
    has left is in no commit, and readers don't see it.
    """
    spark = rows.sparkSession
    name = hashlib.sha256(batch.encode()).hexdigest()
    if f"{name}.json" in names_in(spark, f"{path}/_commits"):
        return False
    folder = f"data/batch={name}-{uuid.uuid4().hex}"
    rows.write.partitionBy(*by).json(f"{path}/{folder}")
    if put_text(spark, f"{path}/_commits/{name}.json", json.dumps({"batch": batch, "folder": folder})):
        return True
    system, make = file_system(spark, path)
    system.delete(make(f"{path}/{folder}"), True)
    return False


def read_results(spark: SparkSession, path: str, schema: str = RESULTS) -> DataFrame:
    """The rows of all batches that are committed when it is called, each once."""
    names = [n for n in names_in(spark, f"{path}/_commits") if n.endswith(".json") and not n.startswith(".")]
    if not names:
        return spark.createDataFrame([], schema)
    folders = [json.loads(read_text(spark, f"{path}/_commits/{n}"))["folder"] for n in sorted(names)]
    found = spark.read.schema(schema).option("basePath", f"{path}/data").json([f"{path}/{f}" for f in folders])
    return found.select(*StructType.fromDDL(schema).names)


#: A record by key; the record itself is kept as JSON.
CORPUS = "record_key string, row string"


def write_corpus(records: DataFrame, key: Column, path: str, most_rows: int = MOST_ROWS) -> int:
    """Write records by key, once each: the same key replaces what an earlier call wrote, whatever the call's other keys.

    Parts are copied on write and split as they grow. The call makes a new version, which it
    returns; readers see the former one whole until then. Of two writers of one version, one starts again from the other's.
    Tasks are as many as records ask for: records alike take little room where shuffles are measured, and much where they are sorted.
    """
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in records.columns]))
    keyed = records.select(key.alias("record_key"), row.alias("row")).repartition(tasks_for(records.count()), "record_key")
    shared_folder(records.sparkSession)
    fresh = keyed.groupBy("record_key").agg(F.min("row").alias("row")).checkpoint()

    def fold(old: DataFrame, new: DataFrame) -> DataFrame:
        both = old.withColumn("new", F.lit(0)).unionByName(new.withColumn("new", F.lit(1)))
        return both.repartition(tasks_for(both.count()), "record_key").groupBy("record_key").agg(F.max_by("row", "new").alias("row"))

    return corpus_table(records.sparkSession, path, most_rows).upsert(fresh, fold)


def corpus_table(spark: SparkSession, path: str, most_rows: int = MOST_ROWS) -> KeyedTable:
    """The versions of a written corpus; `rows()` is a snapshot of the newest."""
    return KeyedTable(spark, path, StructType.fromDDL(CORPUS), ["record_key"], most_rows)


def write_run_dir(path: str, meta: DataFrame, samples: DataFrame, rows: DataFrame, summary: DataFrame) -> None:
    """A derived run: one folder per table."""
    for name, table in (("run_meta", meta), ("samples", samples), ("results", rows), ("summary", summary)):
        table.write.mode("overwrite").json(f"{path}/{name}")


def write_csv_report(rows: DataFrame, fields: list[str], path: str) -> None:
    """The named fields in order, with a header; others are left out."""
    rows.select(*fields).write.mode("overwrite").option("header", True).csv(path)
