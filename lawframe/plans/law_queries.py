"""Queries over the equation list: algebra, keys, checks and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawframe.functions import algebra as A
from lawframe.operators import corpus, sampling
from lawframe.plans.registry import query
from lawframe.plans.views import forms_sql, law_pairs, laws, parsed_laws


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed_laws(spark, sf_dir).where(F.col("tokens").isNotNull())


@query("tokenize_infix", forms_sql("SELECT law_no, len(raw)::BIGINT AS n_tokens, array_to_string(raw, ' ') AS tokens FROM toks"))
def tokenize_infix(spark, sf_dir):
    tokens = A.infix_tokens(F.col("equation"))
    return laws(spark, sf_dir).select("law_no", F.size(tokens).cast("long").alias("n_tokens"), F.array_join(tokens, " ").alias("tokens"))


@query("valid_infix", forms_sql("SELECT law_no, valid FROM checked"))
def valid_infix(spark, sf_dir):
    return parsed_laws(spark, sf_dir).select("law_no", F.col("tokens").isNotNull().alias("valid"))


@query("vars_in_order", forms_sql("SELECT law_no, array_to_string(vars, ',') AS vars FROM base"))
def vars_in_order(spark, sf_dir):
    return _known(spark, sf_dir).select("law_no", F.array_join(A.variables(F.col("tokens")), ",").alias("vars"))


@query("canonical", forms_sql("SELECT law_no, canon AS canonical FROM base"))
def canonical(spark, sf_dir):
    return _known(spark, sf_dir).select("law_no", A.canonical(F.col("tokens")).alias("canonical"))


@query(
    "term_ops",
    forms_sql(
        """SELECT law_no, len(list_filter(string_split(split_part(canon, ' = ', 1), ''), lambda c: c = '('))::INT AS lhs_ops,
  len(list_filter(string_split(split_part(canon, ' = ', 2), ''), lambda c: c = '('))::INT AS rhs_ops FROM base"""
    ),
)
def term_ops(spark, sf_dir):
    t = F.col("tokens")
    return _known(spark, sf_dir).select("law_no", A.operations(A.left_side(t)).alias("lhs_ops"), A.operations(A.right_side(t)).alias("rhs_ops"))


_DEPTH = """(SELECT coalesce(max(d), 0)::INT FROM (SELECT sum(CASE c WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER (ORDER BY i) AS d
  FROM (SELECT unnest(string_split({0}, '')) AS c, generate_subscripts(string_split({0}, ''), 1) AS i)))"""
_LEFT, _RIGHT = "split_part(canon, ' = ', 1)", "split_part(canon, ' = ', 2)"


@query(
    "term_depth",
    forms_sql(
        """, chars AS (SELECT canon, side, unnest(string_split(part, '')) AS c, generate_subscripts(string_split(part, ''), 1) AS i FROM (
  SELECT DISTINCT canon, 'l' AS side, split_part(canon, ' = ', 1) AS part FROM base UNION ALL SELECT DISTINCT canon, 'r', split_part(canon, ' = ', 2) FROM base)),
depths AS (SELECT canon, side, max(d) AS depth FROM (SELECT canon, side, sum(CASE c WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER (PARTITION BY canon, side ORDER BY i) AS d FROM chars) GROUP BY ALL)
SELECT law_no, l.depth::INT AS lhs_depth, r.depth::INT AS rhs_depth FROM base b JOIN depths l ON l.canon = b.canon AND l.side = 'l' JOIN depths r ON r.canon = b.canon AND r.side = 'r'"""
    ),
)
def term_depth(spark, sf_dir):
    t = F.col("tokens")
    return _known(spark, sf_dir).select("law_no", A.depth(A.left_side(t)).alias("lhs_depth"), A.depth(A.right_side(t)).alias("rhs_depth"))


_OPS = "len(list_filter({0}, lambda t: t = '∘'))::INT"


@query(
    "complexity",
    forms_sql(
        f""", chars AS (SELECT canon, unnest(string_split(canon, '')) AS c, generate_subscripts(string_split(canon, ''), 1) AS i FROM (SELECT DISTINCT canon FROM base)),
depths AS (SELECT canon, max(d)::INT AS depth FROM (SELECT canon, sum(CASE c WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER (PARTITION BY canon ORDER BY i) AS d FROM chars) GROUP BY canon)
SELECT e_no, f_no, {_OPS.format("e")} AS ops_e, {_OPS.format("f")} AS ops_f, {_OPS.format("e")} + {_OPS.format("f")} AS ops_total, greatest(x.depth, y.depth) AS depth
FROM pairs JOIN depths x ON x.canon = canon_e JOIN depths y ON y.canon = canon_f"""
    ),
)
def complexity(spark, sf_dir):
    return corpus.with_complexity(law_pairs(spark, sf_dir)).select("e_no", "f_no", "ops_e", "ops_f", "ops_total", "depth")


@query("num_vars", forms_sql("SELECT law_no, len(vars)::INT AS n_vars, len(vars) <= 6 AS within_limit FROM base"))
def num_vars(spark, sf_dir):
    n = F.size(A.variables(F.col("tokens")))
    return _known(spark, sf_dir).select("law_no", n.alias("n_vars"), (n <= 6).alias("within_limit"))


@query("is_vacuous", forms_sql("SELECT law_no, NOT regexp_matches(equation, '[∘◇*]') AS vacuous FROM laws"))
def is_vacuous(spark, sf_dir):
    return laws(spark, sf_dir).select("law_no", A.is_vacuous(F.col("equation")).alias("vacuous"))


@query("law_key", forms_sql("SELECT law_no, min(canon) AS law_key FROM forms WHERE NOT dual GROUP BY law_no"))
def law_key(spark, sf_dir):
    return _known(spark, sf_dir).select("law_no", A.law_key(F.col("tokens")).alias("law_key"))


@query(
    "serialize_equation",
    forms_sql(
        r"""SELECT law_no, regexp_replace(split_part(s, ' = ', 1), '^\((.*)\)$', '\1') || ' = ' || regexp_replace(split_part(s, ' = ', 2), '^\((.*)\)$', '\1') AS line
FROM (SELECT law_no, array_to_string(list_transform(toks, lambda t: CASE t WHEN '∘' THEN ' ◇ ' WHEN '=' THEN ' = ' ELSE t END), '') AS s FROM base)"""
    ),
)
def serialize_equation(spark, sf_dir):
    return _known(spark, sf_dir).select("law_no", A.serialized(F.col("tokens")).alias("line"))


@query("to_prefix", forms_sql("SELECT law_no, replace(replace(canon, '(', 'op('), ' ∘ ', ', ') AS prefix FROM base"))
def to_prefix(spark, sf_dir):
    return _known(spark, sf_dir).select("law_no", A.to_prefix(A.canonical(F.col("tokens"))).alias("prefix"))


@query("dual", forms_sql("SELECT law_no, canon AS dual FROM forms WHERE dual AND NOT swap"))
def dual(spark, sf_dir):
    return _known(spark, sf_dir).select("law_no", A.canonical(A.dual(F.col("tokens"))).alias("dual"))


_ORBIT = """, orbit AS (SELECT p.e_no, p.f_no, e.swap AS swap_e, f.swap AS swap_f, e.dual AS dual, e.canon AS e, f.canon AS f
FROM pairs p JOIN forms e ON e.law_no = p.e_no JOIN forms f ON f.law_no = p.f_no AND e.dual = f.dual)"""


@query(
    "transform_orbit",
    forms_sql(
        _ORBIT
        + """SELECT e_no, f_no, swap_e, swap_f, dual, e, f, (row_number() OVER (PARTITION BY e_no ORDER BY swap_e::INT + swap_f::INT + dual::INT, swap_e, swap_f, dual))::INT AS preference FROM orbit"""
    ),
)
def transform_orbit(spark, sf_dir):
    found = law_pairs(spark, sf_dir).select("e_no", "f_no", F.posexplode(A.orbit(F.col("e"), F.col("f"))).alias("at", "form"))
    return found.select("e_no", "f_no", "form.swap_e", "form.swap_f", "form.dual", "form.e", "form.f", (F.col("at") + 1).alias("preference"))


@query("answer_class_key", forms_sql(_ORBIT + "SELECT e_no, f_no, min({'e': e, 'f': f}).e AS class_e, min({'e': e, 'f': f}).f AS class_f FROM orbit GROUP BY e_no, f_no"))
def answer_class_key(spark, sf_dir):
    keyed = law_pairs(spark, sf_dir).withColumn("key", A.answer_class_key(F.col("e"), F.col("f")))
    return keyed.select("e_no", "f_no", F.col("key.e").alias("class_e"), F.col("key.f").alias("class_f"))


@query(
    "record_key",
    forms_sql(
        """SELECT e_no, f_no, CASE WHEN e_no % 5 = 0 THEN 'pair-' || substr(sha256(canon_e || ' => ' || canon_f), 1, 12) ELSE 'E_' || e_no || '-E_' || f_no END || '-paint' AS record_key FROM pairs"""
    ),
)
def record_key(spark, sf_dir):
    label = lambda c: F.when(F.col("e_no") % 5 != 0, F.concat(F.lit("E:"), F.col(c).cast("string")))
    key = A.record_key(label("e_no"), label("f_no"), F.lit("paint"), A.canonical(F.col("e")), A.canonical(F.col("f")))
    return law_pairs(spark, sf_dir).select("e_no", "f_no", key.alias("record_key"))


@query(
    "select_theme",
    forms_sql("SELECT e_no, f_no, (('0x' || substr(sha256(canon_e || ' => ' || canon_f), 1, 16))::UBIGINT % 4)::INT AS theme_no FROM pairs"),
)
def select_theme(spark, sf_dir):
    return law_pairs(spark, sf_dir).select("e_no", "f_no", A.theme_number(A.canonical(F.col("e")), A.canonical(F.col("f")), 4).alias("theme_no"))


@query("drop_vacuous", forms_sql("SELECT e_no, f_no FROM pairs WHERE regexp_matches(e_text, '[∘◇*]') AND regexp_matches(f_text, '[∘◇*]')"))
def drop_vacuous(spark, sf_dir):
    return corpus.drop_vacuous(law_pairs(spark, sf_dir)).select("e_no", "f_no")


@query("renderable", forms_sql("SELECT law_no FROM base WHERE len(vars) <= 6"))
def renderable(spark, sf_dir):
    return corpus.renderable(parsed_laws(spark, sf_dir)).select("law_no")


@query("bin_counts", forms_sql(f"SELECT {_OPS.format('toks')} AS ops, count(*) AS n FROM base GROUP BY 1"))
def bin_counts(spark, sf_dir):
    return _known(spark, sf_dir).groupBy(A.operations(F.col("tokens")).alias("ops")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "dedup_laws",
    forms_sql(
        ", keys AS (SELECT law_no, min(canon) AS law_key FROM forms WHERE NOT dual GROUP BY law_no) SELECT min(law_no) AS law_no, law_key FROM keys GROUP BY law_key"
    ),
)
def dedup_laws(spark, sf_dir):
    return corpus.dedup_laws(parsed_laws(spark, sf_dir)).select("law_no", "law_key")


@query(
    "corpus_contract",
    forms_sql(
        f""", k AS (SELECT b.law_no, b.equation, b.toks, b.vars, (SELECT min(canon) FROM forms f WHERE f.law_no = b.law_no AND NOT dual) AS law_key FROM base b),
s AS (SELECT law_no, {_OPS.format("toks")} AS ops, len(vars) AS n_vars, count(*) OVER (PARTITION BY law_key) AS copies,
  array_to_string(list_transform(toks, lambda t: CASE t WHEN '∘' THEN ' ◇ ' WHEN '=' THEN ' = ' ELSE t END), '') AS s, equation FROM k),
t AS (SELECT *, regexp_replace(split_part(s, ' = ', 1), '^\\((.*)\\)$', '\\1') || ' = ' || regexp_replace(split_part(s, ' = ', 2), '^\\((.*)\\)$', '\\1') AS line FROM s)
SELECT 'unparseable' AS rule, (SELECT count(*) FROM checked WHERE NOT valid) AS violations
UNION ALL SELECT 'format', count(*) FROM t WHERE line <> equation
UNION ALL SELECT 'bin', count(*) FROM t WHERE ops NOT BETWEEN 1 AND 4
UNION ALL SELECT 'variables', count(*) FROM t WHERE n_vars > 6
UNION ALL SELECT 'duplicate', count(*) FROM t WHERE copies > 1"""
    ),
)
def corpus_contract(spark, sf_dir):
    return corpus.corpus_contract(parsed_laws(spark, sf_dir), 1, 4)


_SIDES = f", known AS (SELECT law_no, equation, {_OPS.format('toks')} AS ops, len(vars) AS n_vars, regexp_matches(equation, '[∘◇*]') AS solid FROM base)"


_DRAW = "sha256(concat_ws('|', '7', {0}))"


@query(
    "complexity_pair_join",
    forms_sql(
        _SIDES
        + f""", g AS (SELECT ops, count(*) AS n FROM known WHERE ops <= 4 GROUP BY ops), bins AS (SELECT unnest(range(1, 9))::INT AS bin),
splits AS (SELECT bin, e.ops AS ops_e, f.ops AS ops_f, e.n AS n_e, f.n AS n_f, (e.n * f.n - CASE WHEN e.ops = f.ops THEN e.n ELSE 0 END)::BIGINT AS candidates FROM bins JOIN g e ON true JOIN g f ON f.ops = bin - e.ops),
turns AS (SELECT *, unnest(range(least(3, candidates))) AS j FROM splits WHERE candidates > 0),
spots AS (SELECT law_no, ops, row_number() OVER (PARTITION BY ops ORDER BY {_DRAW.format("law_no")}, law_no) - 1 AS at FROM known)
SELECT bin, ops_e, ops_f, candidates, (j + 1)::INT AS place, e.law_no AS e_no, f.law_no AS f_no FROM turns JOIN spots e ON e.ops = ops_e AND e.at = j % n_e
  JOIN spots f ON f.ops = ops_f AND f.at = (j % n_e + j // n_e + CASE WHEN ops_e = ops_f THEN 1 ELSE 0 END) % n_f"""
    ),
)
def complexity_pair_join(spark, sf_dir):
    """How many pairs each split of a bin has, and its first three."""
    return sampling.split_pairs(_known(spark, sf_dir), per_split=3, seed="7")


def _permuted_sql(name: str, seed: str, size: str, n: int) -> str:
    """Tables up to `name` (draw, at): the first n of the numbers below `size`, an expression, in the order of the seed."""
    rounds = "".join(
        f""", {name}_{i + 1} AS (SELECT draw, w, size, r AS l, xor(l, ('0x' || substr(sha256(concat_ws('|', '{seed}', '{i}', r)), 1, 15))::BIGINT % (1::BIGINT << w)) AS r FROM {name}_{i})"""
        for i in range(4)
    )
    return f""", {name}_size AS (SELECT s AS size, (SELECT min(w) FROM range(1, 31) t(w) WHERE pow(4, w) >= s)::INT AS w FROM (SELECT ({size})::BIGINT AS s)),
{name}_0 AS (SELECT i AS draw, w, size, i >> w AS l, i & ((1::BIGINT << w) - 1) AS r FROM {name}_size, range(100000) t(i) WHERE i < pow(4, w) AND i < {8 * n + 64}){rounds},
{name} AS (SELECT draw, (l << w) + r AS at FROM {name}_4 WHERE (l << w) + r < size ORDER BY draw LIMIT {n})"""


_U = ", u AS (SELECT law_no, ops FROM known WHERE n_vars <= 6), places AS (SELECT law_no, row_number() OVER (ORDER BY law_no) - 1 AS at FROM u), m AS (SELECT count(*) AS m FROM u)"


def _pairs_sql(name: str, seed: str) -> str:
    return _permuted_sql(f"{name}_p", seed, "SELECT m * (m - 1) FROM m", 100) + f""", {name} AS (
  SELECT draw, e.law_no AS e_no, f.law_no AS f_no FROM {name}_p p, m JOIN places e ON e.at = p.at // (m - 1)
    JOIN places f ON f.at = p.at % (m - 1) + CASE WHEN p.at % (m - 1) >= p.at // (m - 1) THEN 1 ELSE 0 END)"""


@query("sample_pairs", forms_sql(_SIDES + _U + _pairs_sql("a", "7") + "SELECT * FROM a"))
def sample_pairs(spark, sf_dir):
    return sampling.sample_pairs(parsed_laws(spark, sf_dir), n=100, seed="7").select("draw", "e_no", "f_no")


@query(
    "sample_stratified",
    forms_sql(
        _SIDES
        + _U
        + f""", g AS (SELECT ops, count(*) AS n FROM u WHERE ops <= 4 GROUP BY ops), bins AS (SELECT unnest(range(1, 9))::INT AS bin),
splits AS (SELECT bin, e.ops AS ops_e, f.ops AS ops_f, e.n AS n_e, f.n AS n_f, e.n * f.n - CASE WHEN e.ops = f.ops THEN e.n ELSE 0 END AS candidates FROM bins JOIN g e ON true JOIN g f ON f.ops = bin - e.ops),
turns AS (SELECT *, unnest(range(least(20, candidates))) AS j FROM splits WHERE candidates > 0),
dealt AS (SELECT * FROM turns QUALIFY row_number() OVER (PARTITION BY bin ORDER BY j, {_DRAW.format("bin, ops_e")}) <= 20),
spots AS (SELECT law_no, ops, row_number() OVER (PARTITION BY ops ORDER BY {_DRAW.format("law_no")}, law_no) - 1 AS at FROM u)
SELECT bin, e.law_no AS e_no, f.law_no AS f_no FROM dealt d JOIN spots e ON e.ops = ops_e AND e.at = j % n_e
  JOIN spots f ON f.ops = ops_f AND f.at = (j % n_e + j // n_e + CASE WHEN ops_e = ops_f THEN 1 ELSE 0 END) % n_f"""
    ),
)
def sample_stratified(spark, sf_dir):
    return sampling.sample_stratified(_known(spark, sf_dir), per_bin=20, seed="7")


@query(
    "sample_balanced",
    forms_sql(
        _SIDES
        + f""", places AS (SELECT law_no, ops, row_number() OVER (PARTITION BY ops ORDER BY {_DRAW.format("law_no")}, law_no) - 1 AS at, count(*) OVER (PARTITION BY ops) AS pool FROM known WHERE n_vars <= 6 AND ops IN (1, 2, 3, 4, 6)),
draws AS (SELECT DISTINCT ops, pool, i FROM places, range(20) t(i) WHERE pool >= 2),
chosen AS (SELECT ops, i, i % pool AS e_at, (i + 1 + (i // pool) % (pool - 1)) % pool AS f_at FROM draws WHERE i < pool * (pool - 1))
SELECT c.ops, e.law_no AS e_no, f.law_no AS f_no FROM chosen c JOIN places e ON e.ops = c.ops AND e.at = c.e_at JOIN places f ON f.ops = c.ops AND f.at = c.f_at"""
    ),
)
def sample_balanced(spark, sf_dir):
    return sampling.sample_balanced(parsed_laws(spark, sf_dir), per_bin=20, seed="7", bins=(1, 2, 3, 4, 6))


def _slot_sql(slot: str, low: int, high: int, n: int) -> str:
    splits = f"""SELECT t AS ops_total, e.ops AS ops_e, f.ops AS ops_f, e.n * (f.n - (e.ops = f.ops)::INT) AS pairs, f.n - (e.ops = f.ops)::INT AS width
  FROM range({low}, {high + 1}) r(t) JOIN sized e ON true JOIN sized f ON e.ops + f.ops = t WHERE e.n * (f.n - (e.ops = f.ops)::INT) > 0"""
    return f""", {slot}_s AS (SELECT *, sum(pairs) OVER (ORDER BY ops_total, ops_e) - pairs AS first FROM ({splits}))""" + _permuted_sql(f"{slot}_p", f"7|{slot}", f"SELECT sum(pairs) FROM {slot}_s", n) + f""", {slot} AS (
  SELECT '{slot}' AS slot, row_number() OVER (ORDER BY draw)::INT AS place, e.law_no AS e_no, f.law_no AS f_no, ops_total::INT AS ops_total
  FROM {slot}_p p JOIN {slot}_s s ON p.at >= s.first AND p.at < s.first + s.pairs
    JOIN spots e ON e.ops = s.ops_e AND e.at = (p.at - s.first) // s.width
    JOIN spots f ON f.ops = s.ops_f AND f.at = (p.at - s.first) % s.width + CASE WHEN s.ops_e = s.ops_f AND (p.at - s.first) % s.width >= (p.at - s.first) // s.width THEN 1 ELSE 0 END)"""


@query(
    "slot_fill",
    forms_sql(
        _SIDES
        + ", spots AS (SELECT law_no, ops, row_number() OVER (PARTITION BY ops ORDER BY law_no) - 1 AS at FROM known WHERE n_vars <= 6 AND ops > 0), sized AS (SELECT ops, count(*) AS n FROM spots GROUP BY ops)"
        + _slot_sql("low", 2, 3, 1)
        + _slot_sql("high", 7, 8, 1)
        + _slot_sql("example", 4, 6, 3)
        + "SELECT * FROM low UNION ALL SELECT * FROM high UNION ALL SELECT * FROM example"
    ),
)
def slot_fill(spark, sf_dir):
    return sampling.slot_fill(parsed_laws(spark, sf_dir), seed="7")


@query("synthesize_laws")
def synthesize_laws(spark, sf_dir):
    draws = laws(spark, sf_dir).select(F.col("law_no").alias("draw"))
    return sampling.synthesize_laws(draws, bins=range(1, 11), seed="7", per_bin=40)


@query(
    "nested_prefix_examples",
    forms_sql(
        _SIDES
        + f""", ranked AS (SELECT law_no, equation, ops, row_number() OVER (PARTITION BY ops ORDER BY {_DRAW.format("law_no")}, law_no) AS rn FROM known)
SELECT ops, k::INT AS k, string_agg(equation, chr(10) ORDER BY rn) AS examples FROM ranked JOIN range(1, 4) t(k) ON rn <= k GROUP BY ops, k"""
    ),
)
def nested_prefix_examples(spark, sf_dir):
    known = _known(spark, sf_dir).withColumn("ops", A.operations(F.col("tokens")))
    return sampling.nested_examples(known, "ops", most=3, seed="7")


@query(
    "same_pairs_across_forms",
    forms_sql(
        _SIDES
        + _U
        + _pairs_sql("a", "7")
        + _pairs_sql("b", "8")
        + """,
d AS (SELECT (SELECT count(*) FROM (SELECT e_no, f_no FROM a EXCEPT SELECT e_no, f_no FROM b)) AS x, (SELECT count(*) FROM (SELECT e_no, f_no FROM b EXCEPT SELECT e_no, f_no FROM a)) AS y)
SELECT l AS form_a, r AS form_b, CASE WHEN r = 'reseeded' THEN x ELSE 0 END::BIGINT AS only_a, CASE WHEN r = 'reseeded' THEN y ELSE 0 END::BIGINT AS only_b
FROM (VALUES ('story', 'literal'), ('story', 'two-stage'), ('story', 'reseeded'), ('literal', 'two-stage'), ('literal', 'reseeded'), ('two-stage', 'reseeded')) t(l, r), d"""
    ),
)
def same_pairs_across_forms(spark, sf_dir):
    """The pairs of three forms, and those of another seed, which do differ."""
    known = parsed_laws(spark, sf_dir)
    arms = {form: sampling.sample_pairs(known, n=100, seed="7", form=form) for form in ("story", "literal", "two-stage")}
    return sampling.pair_set_differences(arms | {"reseeded": sampling.sample_pairs(known, n=100, seed="8")})


#: The text before the step's closing bracket is replaced by its number, one step a turn.
_STEPS = """, steps AS (
  WITH RECURSIVE r(law_no, n, s, a, b) AS (
    SELECT law_no, 0::BIGINT, array_to_string(toks, ' '), NULL::VARCHAR, NULL::VARCHAR FROM base
    UNION ALL
    SELECT law_no, n + 1, regexp_replace(s, '\\( ([^()]+) ∘ ([^()]+) \\)', 'Result~' || (n + 1)), regexp_extract(s, '\\( ([^()]+) ∘ ([^()]+) \\)', 1), regexp_extract(s, '\\( ([^()]+) ∘ ([^()]+) \\)', 2)
    FROM r WHERE s LIKE '%(%')
  SELECT law_no, n, replace(a, '~', ' ') AS a, replace(b, '~', ' ') AS b FROM r WHERE n > 0)"""


@query("linearize_steps", forms_sql(_STEPS + "SELECT law_no, n::INT AS step, a, b FROM steps"))
def linearize_steps(spark, sf_dir):
    """A row per step: the innermost operation whose bracket closes first comes first, the left side before the right one."""
    steps = F.posexplode(corpus.linearized(F.col("tokens"), "Result")["steps"]).alias("at", "s")
    return _known(spark, sf_dir).select("law_no", steps).select("law_no", (F.col("at") + 1).alias("step"), "s.a", "s.b")


@query("render_literal")
def render_literal(spark, sf_dir):
    return corpus.render_literal(law_pairs(spark, sf_dir)).select("e_no", "f_no", "description")


@query("backparse_literal", forms_sql("SELECT e_no, f_no, canon_e AS canonical_e, canon_f AS canonical_f FROM pairs"))
def backparse_literal(spark, sf_dir):
    rendered = corpus.render_literal(law_pairs(spark, sf_dir)).select("e_no", "f_no", "description")
    return corpus.backparse_literal(rendered).select("e_no", "f_no", "canonical_e", "canonical_f")


@query(
    "roundtrip_gate",
    forms_sql(
        """, told AS (SELECT e_no, f_no, regexp_matches(e_text || f_text, '[∘◇*]') AND e_no % 6 = 0 AS damaged FROM pairs),
themed AS (SELECT e_no, f_no, CASE ('0x' || substr(sha256(canon_e || ' => ' || canon_f), 1, 16))::UBIGINT % 2 WHEN 0 THEN 'bakery' ELSE 'loom' END AS theme FROM pairs)
SELECT theme, count(*) AS records, count(*) FILTER (damaged AND kind = 0 OR e_no % 10 = 3 AND kind = 1) AS failures FROM (
  SELECT 'literal' AS theme, 0 AS kind, * FROM told UNION ALL SELECT theme, 1, e_no, f_no, damaged FROM told JOIN themed USING (e_no, f_no)) GROUP BY theme"""
    ),
)
def roundtrip_gate(spark, sf_dir):
    """Literal texts and stories; every sixth literal text and every tenth story are damaged first."""
    from lawframe.plans.corpus_queries import example_themes, themed_pairs

    cut = F.replace("description", F.lit(" as its first input"), F.lit(" as its input"))
    literal = corpus.render_literal(law_pairs(spark, sf_dir)).withColumn("description", F.when(F.col("e_no") % 6 == 0, cut).otherwise(F.col("description")))
    # a story without its last character has no closing question
    stories = corpus.render_story(themed_pairs(spark, sf_dir), example_themes(spark)).withColumn("description", F.when(F.col("e_no") % 10 == 3, F.expr("left(story, length(story) - 40)")).otherwise(F.col("story")))
    columns = ["theme", "description", "canonical_e", "canonical_f"]
    found = corpus.roundtrip_gate(literal.withColumn("theme", F.lit("literal")).select(*columns))
    return found.unionByName(corpus.story_roundtrip_gate(stories.select(*columns), example_themes(spark)))
