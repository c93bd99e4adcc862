"""Queries over responses: extraction, parsing, grading and error types."""

from __future__ import annotations

from pyspark.sql import functions as F

from lawframe.functions import algebra as A
from lawframe.functions import grading as G
from lawframe.functions import labels as L
from lawframe.operators import answers, corpus, summary
from lawframe.operators.attempts import is_correct
from lawframe.plans.registry import query
from lawframe.plans.views import RESPONSES, forms_sql, law_pairs, responses

#: Per kind of answer: cleaned lines, canonical forms (null: does not parse), status by parity of the pair, transform and bucket.
_KINDS = """kinds(tid, assume, ask, e, f) AS (VALUES
 (0, 'op(x, y) = op(op(y, y), x)', 'op(x, y) = op(y, x)', '(v1 ∘ v2) = ((v2 ∘ v2) ∘ v1)', '(v1 ∘ v2) = (v2 ∘ v1)'),
 (1, 'op(op(y, y), x) = op(x, y)', 'op(x, y) = op(y, x)', '((v1 ∘ v1) ∘ v2) = (v2 ∘ v1)', '(v1 ∘ v2) = (v2 ∘ v1)'),
 (2, 'op(y, x) = op(x, op(y, y))', 'op(y, x) = op(x, y)', '(v1 ∘ v2) = (v2 ∘ (v1 ∘ v1))', '(v1 ∘ v2) = (v2 ∘ v1)'),
 (3, 'op(x, y) = op(y, x)', 'op(x, y) = op(op(y, y), x)', '(v1 ∘ v2) = (v2 ∘ v1)', '(v1 ∘ v2) = ((v2 ∘ v2) ∘ v1)'),
 (4, 'x + y = y', 'x = y', NULL, NULL),
 (5, NULL, NULL, NULL, NULL),
 (6, 'op(crimson, ochre) = op(op(ochre, ochre), crimson)', 'op(crimson, ochre) = op(op(crimson, crimson), ochre)', '(v1 ∘ v2) = ((v2 ∘ v2) ∘ v1)', '(v1 ∘ v2) = ((v1 ∘ v1) ∘ v2)'),
 (7, 'op(y, x) = op(x, op(y, y))', 'op(x, y) = op(op(x, x), y)', '(v1 ∘ v2) = (v2 ∘ (v1 ∘ v1))', '(v1 ∘ v2) = ((v1 ∘ v1) ∘ v2)'),
 (8, 'op(x, y) = op(op(y, y), x)', 'op(op(x, x), y) = op(x, y)', '(v1 ∘ v2) = ((v2 ∘ v2) ∘ v1)', '((v1 ∘ v1) ∘ v2) = (v1 ∘ v2)'))"""

#: Fixed value: an answer line, in DuckDB's words.
_LINE = r"(?im)^[ \t>*+-]*(?:\*\*)?\s*{0}\b\s*(?:\*\*)?\s*:\s*(.+)$"


def _sql_line(label: str) -> str:
    last = f"regexp_extract_all(response, '{_LINE.format(label)}', 1)[-1]"
    return f"trim(rtrim(trim(trim({last}, ' ' || chr(9) || chr(13)), '`*'), '.'), ' ' || chr(9) || chr(13))"


_EXTRACTED = f"""WITH responses AS ({RESPONSES.replace("AS STRING", "AS VARCHAR")}),
x AS (SELECT *, {_sql_line("ASSUME")} AS assume, {_sql_line("ASK")} AS ask FROM responses)"""

#: Verdicts by hand of the nine kinds of answer, for even and odd pairs.
_GRADED = f"""WITH {_KINDS},
responses AS ({RESPONSES.replace("AS STRING", "AS VARCHAR")}),
j AS (SELECT r.*, k.*, r.conv_id % 2 AS odd FROM responses r JOIN kinds k ON (r.conv_id * 8 + r.turn) % 9 = k.tid),
g AS (SELECT *, CASE WHEN e IS NULL THEN 'unparseable' WHEN odd = 0 AND tid IN (0, 1, 2) OR odd = 1 AND tid IN (6, 8) THEN 'correct' ELSE 'wrong' END AS status FROM j),
b AS (SELECT *, CASE WHEN status <> 'correct' THEN status WHEN tid IN (0, 6) THEN 'exact' WHEN tid IN (1, 8) THEN 'correct-swapped' ELSE 'correct-dualized' END AS bucket,
  CASE WHEN status = 'correct' THEN tid = 1 END AS swap_e, CASE WHEN status = 'correct' THEN tid = 8 END AS swap_f, CASE WHEN status = 'correct' THEN tid = 2 END AS dual FROM g)"""

ID = ["conv_id", "turn"]


@query("extract_answer", _EXTRACTED + " SELECT conv_id, turn, assume, ask FROM x")
def extract_answer(spark, sf_dir):
    assume, ask = G.extract_answer(F.col("response"))
    return responses(spark, sf_dir).select(*ID, assume.alias("assume"), ask.alias("ask"))


@query("parse_prefix", _GRADED + " SELECT conv_id, turn, e IS NOT NULL AS valid_e, f IS NOT NULL OR tid = 4 AS valid_f FROM j")
def parse_prefix(spark, sf_dir):
    assume, ask = G.extract_answer(F.col("response"))
    return responses(spark, sf_dir).select(*ID, A.valid_prefix(A.prefix_tokens(assume)).alias("valid_e"), A.valid_prefix(A.prefix_tokens(ask)).alias("valid_f"))


@query("prefix_to_canonical", _GRADED + " SELECT conv_id, turn, e AS canonical FROM j")
def prefix_to_canonical(spark, sf_dir):
    assume, _ = G.extract_answer(F.col("response"))
    return responses(spark, sf_dir).select(*ID, A.canonical(A.parse_prefix(assume)).alias("canonical"))


@query("grade", _GRADED + " SELECT conv_id, turn, status, swap_e, swap_f, dual, e AS canonical_answer_e, f AS canonical_answer_f FROM b")
def grade(spark, sf_dir):
    v = F.col("verdict")
    return answers.graded_responses(responses(spark, sf_dir)).select(
        *ID, v["status"].alias("status"), *[v["transform"][c].alias(c) for c in ("swap_e", "swap_f", "dual")], v["canonical_answer_e"].alias("canonical_answer_e"), v["canonical_answer_f"].alias("canonical_answer_f")
    )


@query("bucket_of", _GRADED + " SELECT conv_id, turn, bucket FROM b")
def bucket_of(spark, sf_dir):
    return answers.graded_responses(responses(spark, sf_dir)).select(*ID, "bucket")


@query(
    "error_type",
    _GRADED
    + """ SELECT conv_id, turn, CASE WHEN e IS NULL THEN 'unparseable'
  WHEN odd = 0 THEN CASE tid WHEN 3 THEN 'both_wrong' ELSE 'ask_wrong_only' END
  ELSE CASE WHEN tid IN (0, 1, 2) THEN 'ask_wrong_only' WHEN tid = 7 THEN 'inconsistent_operation_direction' ELSE 'both_wrong' END END AS error_type FROM b WHERE status <> 'correct'""",
)
def error_type(spark, sf_dir):
    rows = answers.graded_responses(responses(spark, sf_dir)).where(~is_correct(F.col("bucket")))
    kind = G.error_type(F.col("verdict.status"), F.col("e"), F.col("f"), F.col("canonical_e"), F.col("canonical_f"))
    return rows.select(*ID, kind.alias("error_type"))


@query("synthesize_answer", _GRADED + " SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'wrong' ELSE 'unparseable' END AS bucket FROM responses")
def synthesize_answer(spark, sf_dir):
    """Perfect answers; every third is made with the laws exchanged, every other third loses its last line, and these must fail."""
    perfect, turned = G.synthesize_answer(F.col("canonical_e"), F.col("canonical_f")), G.synthesize_answer(F.col("canonical_f"), F.col("canonical_e"))
    kind = F.col("turn") % 3
    told = F.when(kind == 0, perfect).when(kind == 1, turned).otherwise(F.regexp_replace(perfect, r"\nASK:.*$", ""))
    return answers.graded_responses(responses(spark, sf_dir).withColumn("response", told)).select(*ID, "bucket")


@query(
    "law_reading_rate",
    _GRADED
    + """, laws AS (SELECT 'e' AS law, 3 AS ops, coalesce(tid IN (0, 1, 2, 6, 7, 8), false) AS ok FROM b
  UNION ALL SELECT 'f', CASE odd WHEN 0 THEN 2 ELSE 3 END, CASE odd WHEN 0 THEN tid IN (0, 1, 2) ELSE tid IN (6, 7, 8) END FROM b)
SELECT law, ops::INT AS ops, count(*) AS n, avg(ok::INT) AS read FROM laws GROUP BY law, ops""",
)
def law_reading_rate(spark, sf_dir):
    return answers.law_reading_rate(answers.graded_responses(responses(spark, sf_dir)))


@query(
    "stage_attribution",
    forms_sql("SELECT CASE WHEN e_no % 7 = 0 THEN 'off-grammar' WHEN e_no % 5 = 0 THEN 'drifted' ELSE 'faithful' END AS stage1, e_no % 2 = 0 AS correct, count(*) AS n FROM pairs GROUP BY ALL"),
)
def stage_attribution(spark, sf_dir):
    """First stages made from law pairs: every seventh is cut off, of the others every fifth tells the two laws in the wrong order; some have words before the description."""
    pairs = law_pairs(spark, sf_dir)
    turned = pairs.select("e_no", F.col("f").alias("e"), F.col("e").alias("f"))
    wrong = corpus.render_literal(turned).select("e_no", F.col("description").alias("turned"))
    rendered = corpus.render_literal(pairs).join(wrong, "e_no")
    whole = F.when(F.col("e_no") % 5 == 0, F.col("turned")).otherwise(F.col("description"))
    told = F.when(F.col("e_no") % 7 == 0, F.substring("description", 1, 300)).when(F.col("e_no") % 3 == 0, F.concat(F.lit("Here it is.\n"), whole)).otherwise(whole)
    return answers.stage_attribution(rendered.withColumn("stage1_response", told).withColumn("correct", F.col("e_no") % 2 == 0))


@query("prompt_hash", "SELECT conv_id, turn, substr(sha256(text), 1, 12) AS prompt_hash FROM conversations")
def prompt_hash(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select(*ID, L.prompt_hash(F.col("text")).alias("prompt_hash"))


_TEXTS = "FROM conversations"


@query("build_prompt", "SELECT conv_id, turn, 'Read: ' || text || ' End.' AS prompt FROM conversations")
def build_prompt(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return rows.select(*ID, L.build_prompt(F.lit("Read: {story} End."), F.col("text")).alias("prompt"))


@query(
    "wrap_prompt",
    """SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'Think first. ' ELSE '' END || text || CASE WHEN turn % 2 = 1 THEN ' Be brief.' || CASE WHEN conv_id % 3 = 0 THEN chr(10) || '/no_think' ELSE '' END ELSE '' END AS prompt FROM conversations""",
)
def wrap_prompt(spark, sf_dir):
    """Wrappers come as a dimension of (regime, form)."""
    wrappers = spark.createDataFrame([("on", "story", "Think first. ", None), ("off", "story", None, " Be brief.")], "regime string, form string, prefix string, suffix string")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        *ID, "text", F.when(F.col("turn") % 2 == 0, "on").otherwise("off").alias("regime"), F.lit("story").alias("form"), F.when(F.col("conv_id") % 3 == 0, "qwen/qwen3-8b").otherwise("other/m").alias("model")
    )
    joined = rows.join(wrappers, ["regime", "form"], "left")
    return joined.select(*ID, L.wrap_prompt(F.col("text"), F.col("prefix"), F.col("suffix"), F.col("regime"), F.col("model")).alias("prompt"))


_SECTIONS = r"""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'g ' || role END AS grammar, CASE WHEN turn % 3 < 2 THEN regexp_replace(text, '^\s+|\s+$', '', 'g') END AS encoding FROM conversations"""


@query("split_sections", _SECTIONS)
@query("split_sections_all", _SECTIONS)
def split_sections(spark, sf_dir):
    """All texts: after two pairs of markers, after one, and without any."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    body = F.concat(F.lit("ENCODING\nnot this\n## GRAMMAR:\ng "), F.col("role"), F.lit("\n**ENCODING**\n"), F.col("text"))
    text = F.when(F.col("turn") % 3 == 0, body).when(F.col("turn") % 3 == 1, F.concat(F.lit("ENCODING:\n"), F.col("text"))).otherwise(F.col("text"))
    return rows.withColumn("s", L.split_sections(text)).select(*ID, "s.grammar", "s.encoding")


@query(
    "stage2_prompt",
    """SELECT conv_id, turn, CASE WHEN turn % 3 <> 0 THEN 'Now: ' || text END AS stage2_prompt, CASE WHEN turn % 3 = 1 THEN 'ok' END AS response,
  CASE turn % 3 WHEN 0 THEN 'stage 1: timeout' WHEN 2 THEN 'stage 2: refused' END AS api_error FROM conversations""",
)
def stage2_prompt(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    kind = F.col("turn") % 3
    first, second = F.when(kind != 0, F.col("text")), F.when(kind == 1, "ok")
    row = L.two_stage_row(first, second, F.when(kind == 0, "timeout"), F.when(kind == 2, "refused"), F.lit("Now: {story}"))
    return rows.withColumn("row", row).select(*ID, "row.*")


@query(
    "condition_label",
    "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'special' WHEN event_id % 5 < 2 THEN 'no-think' WHEN event_id % 5 < 4 THEN 'all-think' ELSE 'legacy' END AS label FROM events",
)
def condition_label(spark, sf_dir):
    regime = F.when(F.col("event_id") % 5 < 2, "off").when(F.col("event_id") % 5 < 4, "on")
    label = L.condition_label(F.when(F.col("event_id") % 7 == 0, "special"), regime)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", label.alias("label"))


@query(
    "arm_label",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'story' WHEN 1 THEN 'literal + hint + example' ELSE 'two-stage + hint' END AS arm, (event_id % 3)::INT AS place FROM events""",
)
def arm_label(spark, sf_dir):
    kind = F.col("event_id") % 3
    form = F.when(kind == 0, "story").when(kind == 1, "literal").otherwise("two-stage")
    template = F.when(kind == 0, "formalize_prompt.md").when(kind == 1, "prompts/formalize_hint_example_prompt.md").otherwise("hint_prompt.md")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", L.arm_label(form, template).alias("arm"))
    return rows.withColumn("place", L.arm_order(F.col("arm")))


@query("sampling_label", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'Complex ' ELSE 'Stratified ' END || CASE event_id % 3 WHEN 0 THEN user_id WHEN 1 THEN user_id // 4 ELSE user_id END AS label FROM events")
def sampling_label(spark, sf_dir):
    kind = F.col("event_id") % 3
    label = L.sampling_label(F.when(F.col("event_id") % 2 == 0, "uniform").otherwise("stratified"), F.when(kind == 0, F.col("user_id")), F.when(kind == 1, F.lit(4)), F.col("user_id"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", label.alias("label"))


@query(
    "sample_tag",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'uniform ' WHEN 1 THEN 'stratified ' ELSE 'balanced ' END || user_id AS tag,
  CASE WHEN event_id % 3 = 0 THEN 'Complex ' ELSE 'Stratified ' END || user_id || CASE WHEN event_id % 2 = 0 THEN ' / Reasoning off' ELSE ' / Reasoning on' END AS name FROM events""",
)
def sample_tag(spark, sf_dir):
    kind = F.col("event_id") % 3
    tag = L.sample_tag(F.col("user_id"), F.when(kind == 1, 20).otherwise(0), F.when(kind == 2, 20))
    label = L.sampling_label(F.when(kind == 0, "uniform").otherwise("stratified"), F.col("user_id"), F.lit(None), F.lit(None))
    name = L.group_name(label, F.when(F.col("event_id") % 2 == 0, "off").otherwise("on"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", tag.alias("tag"), name.alias("name"))


@query(
    "experiment_title",
    """SELECT user_id, count(*) || CASE user_id % 3
    WHEN 0 THEN ' uniformly sampled pairs'
    WHEN 1 THEN ' pairs, 20 per operation-count bin 1–8' || CASE WHEN min(event_id % 8) > 1 THEN ' minus vacuous-law pairs (bins ' || min(event_id % 8) || '–' || max(event_id % 8) || ' remain)' ELSE '' END
    ELSE ' pairs, 20 per per-equation operation bin ' || CASE WHEN user_id % 2 = 0 THEN '1–10' ELSE '2–7' END || ', both laws from the same bin' END
  || ' · seed ' || user_id % 5 || ' · ' || CASE WHEN count(DISTINCT event_id % 2) > 1 THEN 'story vs literal + hint · no-think' ELSE 'no-think' END AS title
FROM events GROUP BY user_id""",
)
def experiment_title(spark, sf_dir):
    """A title per user: events are the pairs, whose parity is the arm."""
    arm = F.when(F.col("event_id") % 2 == 0, "literal + hint").otherwise("story")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.col("event_id") % 8).alias("bins"), F.collect_set(arm).alias("arms"))
    kind = F.col("user_id") % 3
    title = L.experiment_title(
        F.col("n"), F.when(kind == 1, 20), F.when(kind == 2, 20), F.when(F.col("user_id") % 2 == 1, "2:7"), F.col("bins"), F.col("user_id") % 5, F.col("arms"), F.array(F.lit("no-think"), F.lit("no-think"))
    )
    return rows.select("user_id", title.alias("title"))


@query("short_names", "SELECT event_id, event_type AS model, 'run-' || user_id AS run FROM events")
def short_names(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    name = F.concat(F.lit("run-"), F.col("user_id").cast("string"), F.lit("-pass"), (F.col("event_id") % 7).cast("string"))
    return rows.select("event_id", L.short_model(F.concat(F.lit("vendor/"), F.col("event_type"))).alias("model"), L.run_stem(name).alias("run"))


def _formatted(spark, sf_dir: str, parts: float, digits: int):
    value = F.when(F.col("l_linenumber") != 3, F.col("l_linenumber") / parts).cast("double")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.select("l_orderkey", "l_linenumber", summary.fmt_pct(value, digits).alias("pct"), summary.fmt_number(value).alias("number"))


@query("fmt_pct", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN '-' ELSE printf('%.1f', 100 * l_linenumber / 16.0) END AS pct, CASE WHEN l_linenumber = 3 THEN '-' ELSE printf('%.3f', l_linenumber / 16.0) END AS number FROM lineitem")
def fmt_pct(spark, sf_dir):
    """Sixteenths, which have ties at one and at three digits."""
    return _formatted(spark, sf_dir, 16.0, 1)


@query("fmt_pct_all", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN '-' ELSE (25 * l_linenumber)::VARCHAR END AS pct, CASE WHEN l_linenumber = 3 THEN '-' ELSE printf('%.3f', l_linenumber / 4.0) END AS number FROM lineitem")
def fmt_pct_all(spark, sf_dir):
    """Quarters, without digits."""
    return _formatted(spark, sf_dir, 4.0, 0)
