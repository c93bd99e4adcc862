"""Views over the given tables that stand for attempts, equation lists and responses.

The SQL is portable: Spark runs it over the tables, and queries' SQL uses it as
common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawframe.functions import algebra
from lawframe.operators.corpus import once_per_text

ATTEMPTS = """SELECT event_id AS seq, ts,
  concat('E', CAST(user_id AS STRING)) AS pair_id,
  concat('m', CAST(event_id % 4 AS STRING)) AS model,
  CAST(floor((event_id % 28) / 4.0) AS INT) + 1 AS pass,
  CASE event_id % 3 WHEN 0 THEN 'story' WHEN 1 THEN 'literal' ELSE 'two-stage' END AS form,
  CASE WHEN event_id % 5 < 3 THEN 'off' ELSE 'on' END AS regime,
  CASE WHEN event_type = 'signup' THEN 'exact'
       WHEN event_type = 'purchase' AND value < 10 THEN 'correct-dualized'
       WHEN event_type = 'purchase' THEN 'correct-swapped'
       WHEN event_type = 'click' THEN 'wrong'
       WHEN event_type = 'view' THEN 'unparseable'
       ELSE 'api-error' END AS bucket,
  CAST(user_id % 8 AS INT) + 1 AS ops_total,
  CAST(user_id % 4 AS INT) + 1 AS depth,
  CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS reasoning_tokens,
  concat('c', CAST((event_id * 7 + user_id) % 5 AS STRING)) AS answer_class,
  value AS latency_s
FROM events"""

LAWS = """SELECT p.p_partkey AS law_no,
  CASE CAST(floor(p.p_partkey / 12.0) AS BIGINT) % 3
    WHEN 0 THEN t.eq WHEN 1 THEN replace(t.eq, '∘', '◇') ELSE replace(t.eq, '∘', '*') END AS equation
FROM part p JOIN (VALUES
 (0,'x = x'),(1,'x = y'),(2,'x = x ∘ x'),(3,'x = y ∘ z'),
 (4,'x ∘ y = y ∘ x'),(5,'x ∘ y = (y ∘ y) ∘ x'),(6,'x ∘ y = (x ∘ x) ∘ y'),
 (7,'x ∘ (y ∘ (z ∘ w)) = ((x ∘ y) ∘ z) ∘ w'),(8,'x = y ∘ (z ∘ (w ∘ (u ∘ v)))'),
 (9,'(a ∘ a) ∘ a = a'),(10,'x ∘ y ∘ z = x'),(11,'x = ((y ∘ x) ∘ y) ∘ z')
) AS t(tid, eq) ON p.p_partkey % 12 = t.tid"""

RESPONSES = """SELECT c.conv_id, c.turn, concat('P', CAST(c.conv_id % 2 AS STRING)) AS pair_id,
  concat('m', CAST(c.turn % 4 AS STRING)) AS model,
  concat(c.text, chr(10), t.ans) AS response,
  '(v1 ∘ v2) = ((v2 ∘ v2) ∘ v1)' AS canonical_e,
  CASE WHEN c.conv_id % 2 = 0 THEN '(v1 ∘ v2) = (v2 ∘ v1)'
       ELSE '(v1 ∘ v2) = ((v1 ∘ v1) ∘ v2)' END AS canonical_f
FROM conversations c JOIN (VALUES
 (0, concat('ASSUME: op(x, y) = op(op(y, y), x)', chr(10), 'ASK: op(x, y) = op(y, x)')),
 (1, concat('ASSUME: op(op(y, y), x) = op(x, y)', chr(10), 'ASK: op(x, y) = op(y, x)')),
 (2, concat('**ASSUME**: `op(y, x) = op(x, op(y, y))`', chr(10), '- ASK: op(y, x) = op(x, y).')),
 (3, concat('ASSUME: op(x, y) = op(y, x)', chr(10), 'ASK: op(x, y) = op(op(y, y), x)')),
 (4, concat('ASSUME: x + y = y', chr(10), 'ASK: x = y')),
 (5, 'no answer lines at all'),
 (6, concat('assume: op(crimson, ochre) = op(op(ochre, ochre), crimson)', chr(10), 'Ask: op(crimson, ochre) = op(op(crimson, crimson), ochre)')),
 (7, concat('ASSUME: op(y, x) = op(x, op(y, y))', chr(10), 'ASK: op(x, y) = op(op(x, x), y)')),
 (8, concat('ASSUME: x = y', chr(10), 'ASK: x = y', chr(10), 'ASSUME: op(x, y) = op(op(y, y), x)', chr(10), 'ASK: op(op(x, x), y) = op(x, y)'))
) AS t(tid, ans) ON (c.conv_id * 8 + c.turn) % 9 = t.tid"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ATTEMPTS.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))


def laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LAWS.replace("FROM part p", "FROM {part} p"), part=table(spark, sf_dir, "part"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RESPONSES.replace("FROM conversations c", "FROM {conversations} c"), conversations=table(spark, sf_dir, "conversations"))


def parsed(equations: DataFrame) -> DataFrame:
    """Equations with `tokens`; every distinct text is parsed once, as lists repeat the same laws."""
    once = once_per_text(equations, "equation", algebra.parse_infix(F.col("equation")))
    return once.withColumnRenamed("made", "tokens")


def parsed_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(laws(spark, sf_dir))


def law_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each parsed law with the next one as (e, f)."""
    known = parsed_laws(spark, sf_dir).where(F.col("tokens").isNotNull())
    e = known.select(F.col("law_no").alias("e_no"), F.col("equation").alias("e_text"), F.col("tokens").alias("e"))
    f = known.select(F.col("law_no").alias("f_no"), F.col("equation").alias("f_text"), F.col("tokens").alias("f"))
    return e.join(f, F.col("e_no") + 1 == F.col("f_no"))


def _fold_sql(text: str, times: int = 5) -> str:
    for _ in range(times):
        text = f"regexp_replace(regexp_replace({text}, '\\(([^()∘]*)\\)', '\\1', 'g'), '\\(([^()∘]*)∘([^()∘]*)\\)', '[\\1·\\2]', 'g')"
    return text


def _shape_sql(text: str, times: int = 5) -> str:
    for _ in range(times):
        text = f"regexp_replace({text}, '\\(V\\)|\\(VoV\\)', 'V', 'g')"
    return text


#: Common table expressions from the laws to `forms`: a row for each parsed law and each of swap and dual.
FORMS = rf"""
laws AS ({LAWS.replace("AS STRING", "AS VARCHAR")}),
toks AS (SELECT law_no, equation, list_transform(regexp_extract_all(equation, '[()=∘◇*]|[a-z][a-z0-9]*'), lambda t: CASE WHEN t IN ('◇', '*') THEN '∘' ELSE t END) AS raw FROM laws),
shaped AS (SELECT *, array_to_string(list_transform(raw, lambda t: CASE WHEN t IN ('(', ')', '=') THEN t WHEN t = '∘' THEN 'o' ELSE 'V' END), '') AS shape,
  array_to_string(list_transform(raw, lambda t: CASE WHEN regexp_matches(t, '^[a-z]') THEN '{{' || t || '}}' ELSE t END), '') AS braced FROM toks),
checked AS (SELECT *, regexp_full_match({_shape_sql("shape")}, '(V|VoV)=(V|VoV)') AS valid FROM shaped),
folded AS (SELECT *, regexp_replace(regexp_replace({_fold_sql("braced")}, '^([^∘=]*)∘([^∘=]*)=', '[\1·\2]='), '=([^∘=]*)∘([^∘=]*)$', '=[\1·\2]') AS outer_text FROM checked WHERE valid),
normal AS (SELECT law_no, equation, list_transform(regexp_extract_all(outer_text, '[\[\]·=]|\{{[^{{}}]*\}}'),
  lambda t: CASE t WHEN '[' THEN '(' WHEN ']' THEN ')' WHEN '·' THEN '∘' WHEN '=' THEN '=' ELSE replace(replace(t, '{{', ''), '}}', '') END) AS toks FROM folded),
mirrored AS (
  SELECT law_no, equation, false AS dual, toks FROM normal
  UNION ALL
  SELECT law_no, equation, true, b[list_position(b, '=') + 1:] || ['='] || b[:list_position(b, '=') - 1] FROM (
    SELECT law_no, equation, list_transform(list_reverse(toks), lambda t: CASE t WHEN '(' THEN ')' WHEN ')' THEN '(' ELSE t END) AS b FROM normal)),
turned AS (
  SELECT law_no, equation, dual, false AS swap, toks FROM mirrored
  UNION ALL
  SELECT law_no, equation, dual, true, toks[list_position(toks, '=') + 1:] || ['='] || toks[:list_position(toks, '=') - 1] FROM mirrored),
named AS (SELECT *, list_filter(toks, lambda t: regexp_matches(t, '^[a-z]')) AS nm FROM turned),
distinct_named AS (SELECT *, list_filter(nm, lambda x, i: list_position(nm, x) = i) AS vars FROM named),
forms AS (SELECT *, array_to_string(list_transform(toks, lambda t: CASE WHEN regexp_matches(t, '^[a-z]') THEN 'v' || list_position(vars, t)
    WHEN t = '∘' THEN ' ∘ ' WHEN t = '=' THEN ' = ' ELSE t END), '') AS canon FROM distinct_named),
base AS (SELECT *, canon AS canonical_text FROM forms WHERE NOT swap AND NOT dual),
pairs AS (SELECT e.law_no AS e_no, f.law_no AS f_no, e.equation AS e_text, f.equation AS f_text, e.toks AS e, f.toks AS f, e.canon AS canon_e, f.canon AS canon_f
  FROM base e JOIN base f ON e.law_no + 1 = f.law_no)
"""


def forms_sql(select: str) -> str:
    return f"WITH {FORMS}\n{select}"


def attempts_sql(select: str) -> str:
    text = ATTEMPTS.replace("AS STRING", "AS VARCHAR")
    return f"WITH attempts AS ({text})\n{select}" if not select.lstrip().startswith(",") else f"WITH attempts AS ({text}){select.lstrip()}"
