"""Jobs over equation pairs and their texts: checks, rendering, and reading texts back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawframe.functions import algebra as A
from lawframe.session import shared_folder

MOST_VARIABLES = 6
#: Fixed values of the literal form.
LETTERS = ("x", "y", "z", "w", "u", "v")
RESULT = "Value"
OPENING = (
    "Consider a collection of objects together with an operation that combines two objects into one. "
    "The operation takes a first input and a second input, and the order of the inputs matters."
)
ASSUME = "Suppose the following always holds."
QUESTION = "Now consider the following question."
FOR_ONE = "for every choice of an object "
FOR_MORE = "for every choice of objects "
APPLY = "apply the operation to "
FIRST_INPUT = " as its first input and "
SECOND_INPUT = " as its second input, and call the result "
NEXT_STEP = "; then "
AFTER_STEPS = ". Then "
EQUAL = " is always equal to "
FOLLOWS = "Does it follow that "
FOLLOWS_BARE = "Does it follow that, "
#: Fixed values of the story form.
SIDE_BY_SIDE = " runs two procedures side by side."
IN_THE_FIRST = "In the first, "
IN_THE_SECOND = "In the second, "
HOWEVER = "However "
CHOOSES = " chooses "
ALWAYS = " always "
SEPARATELY = "Separately, "
MUST = "must "
TAKE = "Take any "
AT_ALL = " at all"
CALL_ONE = "call it "
CALL_MORE = "call "
AGAIN = "again "
STARTING = "starting "
ITSELF = " itself"
NAMING_AGENT = ("sets the result aside as", "calls the result", "calls that")
NAMING_IMPERATIVE = ("set the result aside as", "call the result", "call that")
NUMBERS = ("one", "two", "three", "four", "five", "six")
ORDINALS = ("first", "second", "third", "fourth", "fifth", "sixth")
THEME_FIELDS = (
    "key", "intro", "subject", "possessive", "element_singular", "element_plural", "op_agent", "op_imperative",
    "result_noun", "same_habit", "same_question", "closing", "question_intro", "question_lead",
)


def with_complexity(pairs: DataFrame) -> DataFrame:
    """Pairs (e, f) of tokens with ops_e, ops_f, ops_total and depth."""
    ops_e, ops_f = A.operations(F.col("e")), A.operations(F.col("f"))
    return pairs.withColumns(
        {"ops_e": ops_e, "ops_f": ops_f, "ops_total": ops_e + ops_f, "depth": F.greatest(A.depth(F.col("e")), A.depth(F.col("f")))}
    )


def drop_vacuous(pairs: DataFrame) -> DataFrame:
    return pairs.where(~(A.is_vacuous(F.col("e_text")) | A.is_vacuous(F.col("f_text"))))


def renderable(laws: DataFrame) -> DataFrame:
    return laws.where(F.col("tokens").isNotNull() & (F.size(A.variables(F.col("tokens"))) <= MOST_VARIABLES))


def dedup_laws(laws: DataFrame) -> DataFrame:
    """The first law of each key, by law_no."""
    keyed = laws.where(F.col("tokens").isNotNull()).withColumn("law_key", A.law_key(F.col("tokens")))
    row = F.struct("law_no", "equation", "tokens")
    return keyed.groupBy("law_key").agg(F.min_by(row, "law_no").alias("row")).select("row.*", "law_key")


def corpus_contract(laws: DataFrame, low: int, high: int) -> DataFrame:
    """(rule, violations): laws that do not parse, are not in line form, are outside the bins, have too many variables or repeat."""
    t = F.col("tokens")
    known = t.isNotNull()
    checked = laws.select(
        (~known).alias("unparseable"),
        (known & (A.serialized(t) != F.col("equation"))).alias("format"),
        (known & ~A.operations(t).between(low, high)).alias("bin"),
        (known & (F.size(A.variables(t)) > MOST_VARIABLES)).alias("variables"),
        F.when(known, A.law_key(t)).alias("law_key"),
    )
    rules = ["unparseable", "format", "bin", "variables"]
    # by key first, so that copies of one law are a few rows before they meet
    by_key = checked.groupBy("law_key").agg(*[F.count_if(r).alias(r) for r in rules], F.count(F.lit(1)).alias("n"))
    repeats = F.sum(F.when(F.col("law_key").isNotNull() & (F.col("n") > 1), F.col("n")).otherwise(0))
    totals = by_key.agg(*[F.coalesce(F.sum(r), F.lit(0)).alias(r) for r in rules], F.coalesce(repeats, F.lit(0)).alias("duplicate"))
    return totals.unpivot([], [*rules, "duplicate"], "rule", "violations")


def linearized(tokens: Column, noun: Column | str) -> Column:
    """(stack, steps): the references of both sides, and the numbered steps (a, b) in post-order, numbered over both sides."""
    noun = F.lit(noun) if isinstance(noun, str) else noun
    start = F.struct(
        F.array().cast("array<string>").alias("stack"), F.array().cast("array<struct<a:string,b:string>>").alias("steps")
    )

    def step(s: Column, t: Column) -> Column:
        n = F.size(s["stack"])
        made = F.struct(F.get(s["stack"], n - 2).alias("a"), F.get(s["stack"], n - 1).alias("b"))
        ref = F.concat(noun, F.lit(" "), (F.size(s["steps"]) + 1).cast("string"))
        closed = F.struct(F.array_append(F.slice(s["stack"], F.lit(1), F.greatest(n - 2, F.lit(0))), ref).alias("stack"), F.array_append(s["steps"], made).alias("steps"))
        pushed = F.struct(F.array_append(s["stack"], t).alias("stack"), s["steps"].alias("steps"))
        return F.when(t == ")", closed).when(t.isin("(", "=", A.OP), s).otherwise(pushed)

    return F.aggregate(tokens, start, step)


def _named(tokens: Column, names: Column) -> Column:
    """Tokens with variables replaced by names, in order of first appearance."""
    def named(order: Column) -> Column:
        return F.transform(tokens, lambda t: F.when(F.array_contains(order, t), F.get(names, (F.array_position(order, t) - 1).cast("int"))).otherwise(t))

    return A.let(A.variables(tokens), named)


def _listing(parts: Column) -> Column:
    n = F.size(parts)
    last = F.element_at(parts, -1)
    return (
        F.when(n == 1, last)
        .when(n == 2, F.concat(F.get(parts, 0), F.lit(" and "), last))
        .otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), n - 1), ", "), F.lit(", and "), last))
    )


def _capital(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


def _literal_law(tokens: Column) -> Column:
    """(quantifier, procedure, steps, equality) of a law in literal words; steps is their number."""
    letters = F.array(*[F.lit(x) for x in LETTERS])

    def words(used: Column, law: Column) -> Column:
        quantifier = F.when(F.size(used) == 1, F.concat(F.lit(FOR_ONE), F.get(used, 0))).otherwise(
            F.concat(F.lit(FOR_MORE), _listing(used))
        )
        texts = F.transform(
            law["steps"],
            lambda s, i: F.concat(
                F.lit(APPLY), s["a"], F.lit(FIRST_INPUT), s["b"], F.lit(f"{SECOND_INPUT}{RESULT} "), (i + 1).cast("string")
            ),
        )
        equality = F.concat(F.get(law["stack"], 0), F.lit(EQUAL), F.get(law["stack"], 1))
        return F.struct(quantifier.alias("quantifier"), F.array_join(texts, NEXT_STEP).alias("procedure"), F.size(law["steps"]).alias("steps"), equality.alias("equality"))

    used = F.slice(letters, F.lit(1), F.size(A.variables(tokens)))
    return A.let(linearized(_named(tokens, letters), RESULT), lambda law: A.let(used, lambda u: words(u, law)))


#: Keys over which records without a text are dealt.
SALTS = 64
#: Distinct values that a task works on, and letters of all that is made of them up to which it goes to every task.
VALUES_A_TASK, FEW_LETTERS = 500, 4 << 20


def once_per(records: DataFrame, by: list[str], make: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """Records with the columns that are made from `by` alone, once for each distinct value; they replace columns of their names.

    `make` gets the distinct values, nulls included, and the number of tasks that their work is to be
    dealt to: a value is a few bytes, so that Spark would leave all of them to one task. Records of a value
    that it leaves out are left out. The work is in proportion to the values, and to the records only for the join.
    """
    shared_folder(records.sparkSession)
    values = records.select(*by).distinct().checkpoint()
    made = make(values, max(1, -(-values.count() // VALUES_A_TASK))).checkpoint()
    added = [c for c in made.columns if c not in by]
    letters = made.agg(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0] or 0
    keys = made.select(*[F.col(c).alias(f"of {c}") for c in by], *added)
    kept = records.drop(*added)
    same = [F.col(f"`{c}`").eqNullSafe(F.col(f"`of {c}`")) for c in by]
    if letters <= FEW_LETTERS:
        keys = F.broadcast(keys)
    else:  # rows of null would all meet in one task
        empty = lambda names: F.greatest(*[F.col(f"`{c}`").isNull() for c in names], F.lit(False))
        kept = kept.withColumn("salt", F.when(empty(by), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(0).cast("int"))
        every = F.when(empty([f"of {c}" for c in by]), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        keys = keys.withColumn("of salt", F.explode(every))
        same.append(F.col("salt") == F.col("of salt"))
    columns = [c for c in records.columns if c not in added]
    return kept.join(keys, same).select(*[F.col(f"`{c}`") for c in [*columns, *added]])


def render_literal(pairs: DataFrame) -> DataFrame:
    """Pairs (e, f) of tokens with `description`, canonical_e and canonical_f; null where a law has too many variables."""
    def assume(law: Column) -> Column:
        lead = F.concat(F.lit(f"{ASSUME} "), _capital(law["quantifier"]), F.lit(", "))
        return F.when(law["steps"] > 0, F.concat(lead, law["procedure"], F.lit(AFTER_STEPS), law["equality"], F.lit("."))).otherwise(F.concat(lead, law["equality"], F.lit(".")))

    def ask(law: Column) -> Column:
        stepped = F.concat(F.lit(f"{QUESTION} "), _capital(law["quantifier"]), F.lit(", "), law["procedure"], F.lit(f". {FOLLOWS}"), law["equality"], F.lit("?"))
        return F.when(law["steps"] > 0, stepped).otherwise(
            F.concat(F.lit(f"{QUESTION} {FOLLOWS_BARE}"), law["quantifier"], F.lit(", "), law["equality"], F.lit("?"))
        )

    fits = (F.size(A.variables(F.col("e"))) <= MOST_VARIABLES) & (F.size(A.variables(F.col("f"))) <= MOST_VARIABLES)
    made = {
        "description": F.when(fits, F.concat_ws("\n\n", F.lit(OPENING), A.let(_literal_law(F.col("e")), assume), A.let(_literal_law(F.col("f")), ask))),
        "canonical_e": A.canonical(F.col("e")),
        "canonical_f": A.canonical(F.col("f")),
    }
    return once_per(pairs, ["e", "f"], lambda values, tasks: values.repartition(tasks).withColumns(made))


_LETTER = "[xyzwuv]"
_REF = rf"(?:{_LETTER}|{RESULT} \d+)"
_STEP = rf"^{APPLY}({_REF}){FIRST_INPUT}({_REF}){SECOND_INPUT}{RESULT} (\d+)$"
#: The words begin a sentence or stand within one.
_QUANTIFIER = rf"^[Ff](?:{FOR_ONE[1:]}{_LETTER}|{FOR_MORE[1:]}{_LETTER}(?:, {_LETTER})*,? and {_LETTER}), "


def _resolved(ref: Column, values: Column) -> Column:
    """A letter, or the term of an earlier step; null if there is none."""
    number = F.try_to_number(F.regexp_extract(ref, r"(\d+)$", 1), F.lit("999999999"))
    return F.when(ref.rlike(rf"^{_LETTER}$"), ref).otherwise(F.get(values, F.coalesce(number.cast("int"), F.lit(0)) - 1))


def _read_law(procedure: Column, equality: Column) -> Column:
    """The law of a procedure (null: none) and an equality, as tokens; null where either is malformed."""
    parts = F.when(procedure.isNull(), F.array().cast("array<string>")).otherwise(F.split(procedure, NEXT_STEP))

    def step(values: Column, part: Column) -> Column:
        number = F.regexp_extract(part, _STEP, 3)
        a, b = (_resolved(F.regexp_extract(part, _STEP, i), values) for i in (1, 2))
        good = number == (F.size(values) + 1).cast("string")
        return F.when(good, F.array_append(values, F.concat(F.lit("("), a, F.lit(f" {A.OP} "), b, F.lit(")"))))

    pattern = rf"^({_REF}){EQUAL}({_REF})$"

    def law(values: Column) -> Column:
        sides = [_resolved(F.regexp_extract(equality, pattern, i), values) for i in (1, 2)]
        return F.concat(sides[0], F.lit(" = "), sides[1])

    text = A.let(F.aggregate(parts, F.array().cast("array<string>"), step), law)
    return F.when(equality.rlike(pattern), A.parse_infix(text))


def _after(text: Column, start: str) -> Column:
    return F.when(F.startswith(text, F.lit(start)), F.substr(text, F.lit(len(start) + 1)))


def once_per_text(records: DataFrame, text: str, made: Column) -> DataFrame:
    """Records with `made`, a struct made from a text alone, once for each distinct text; records without a text have none.

    The second aggregate shuffles nothing; without it Spark would repeat the
    expression in each filter that it pushes down. Records without a text match nothing, so they are
    dealt over `SALTS` keys.
    """
    texts = records.select(text).where(F.col(text).isNotNull()).distinct()
    once = texts.groupBy(text).agg(F.first(made).alias("made")).withColumn("salt of text", F.lit(0))
    salt = F.when(F.col(text).isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(0).cast("int")
    return records.withColumn("salt of text", salt).join(once, [text, "salt of text"], "left").select(*[F.col(f"`{c}`") for c in records.columns], "made")


def backparse_literal(records: DataFrame) -> DataFrame:
    """Records (description) with canonical_e and canonical_f, read from the text alone; null where it is malformed."""
    nothing = F.lit(None).cast("string")

    def first(text: Column) -> Column:
        body = F.when(text.endswith("."), F.regexp_extract(_after(text, f"{ASSUME} "), r"(?s)^(.*)\.$", 1))
        rest = F.when(body.rlike(_QUANTIFIER), F.regexp_replace(body, _QUANTIFIER, ""))
        return A.let(F.split(rest, rf"\{AFTER_STEPS}", 2), lambda two: A.let(F.struct(F.when(F.size(two) == 2, F.get(two, 0)).alias("p"), F.element_at(two, -1).alias("q")), lambda x: _read_law(x["p"], x["q"])))

    def second(text: Column) -> Column:
        def parts(ask: Column) -> Column:
            plain = _after(ask, FOLLOWS_BARE)
            bare = F.when(plain.rlike(_QUANTIFIER), F.regexp_replace(plain, _QUANTIFIER, ""))
            two = F.split(F.when(ask.rlike(_QUANTIFIER), F.regexp_replace(ask, _QUANTIFIER, "")), rf"\. {FOLLOWS}", 2)
            stepped = F.struct(F.get(two, 0).alias("p"), F.get(two, 1).alias("q"))
            return F.when(plain.isNotNull(), F.struct(nothing.alias("p"), bare.alias("q"))).otherwise(stepped)

        ask = F.when(text.endswith("?"), F.regexp_extract(_after(text, f"{QUESTION} "), r"(?s)^(.*)\?$", 1))
        return A.let(A.let(ask, parts), lambda x: _read_law(x["p"], x["q"]))

    whole = lambda parts: F.when((F.size(parts) == 3) & (F.get(parts, 0) == OPENING), parts)
    parts = A.let(F.split("description", "\n\n"), whole)
    e, f = A.let(F.get(parts, 1), first), A.let(F.get(parts, 2), second)
    made = {"canonical_e": A.canonical(e), "canonical_f": A.canonical(f)}
    return once_per(records, ["description"], lambda values, tasks: values.repartition(tasks).withColumns(made))


def _gate(read: DataFrame, e: str, f: str) -> DataFrame:
    same = F.col(e).eqNullSafe(F.col("true e")) & F.col(f).eqNullSafe(F.col("true f"))
    return read.groupBy("theme").agg(F.count(F.lit(1)).alias("records"), F.count_if(~same).alias("failures"))


def roundtrip_gate(records: DataFrame) -> DataFrame:
    """(theme, records, failures): records (theme, description, canonical_e, canonical_f) whose text does not read back as they say."""
    told = records.select("theme", "description", F.col("canonical_e").alias("true e"), F.col("canonical_f").alias("true f"))
    return _gate(backparse_literal(told), "canonical_e", "canonical_f")


def story_roundtrip_gate(records: DataFrame, themes: DataFrame) -> DataFrame:
    """The same of records whose description is a story; one that opens like another theme's fails as well."""
    told = records.select("theme", F.col("description").alias("story"), F.col("canonical_e").alias("true e"), F.col("canonical_f").alias("true f"))
    read = backparse_story(told, themes)
    return _gate(read.withColumn("read_e", F.when(F.col("read_theme") == F.col("theme"), F.col("read_e"))), "read_e", "read_f")


def _story_law(tokens: Column, question: bool) -> dict[str, Column]:
    t = {name: F.col(f"theme.{name}") for name in THEME_FIELDS}
    names = F.slice(F.col("theme.palette"), F.lit(1), F.size(A.variables(tokens)))
    n = F.size(names)
    law = linearized(_named(tokens, F.col("theme.palette")), t["result_noun"])
    left = A.operations(A.left_side(tokens))
    clause, naming = (t["op_imperative"], NAMING_IMPERATIVE) if question else (t["op_agent"], NAMING_AGENT)
    texts = F.transform(
        law["steps"],
        lambda s, i: F.concat(
            F.replace(F.replace(clause, F.lit("{a}"), s["a"]), F.lit("{b}"), s["b"]),
            F.lit(" and "),
            F.get(F.array(*[F.lit(x) for x in naming]), i % 3),
            F.lit(" "),
            t["result_noun"],
            F.lit(" "),
            (i + 1).cast("string"),
        ),
    )
    glue = F.lit(NEXT_STEP) if question else F.concat(F.lit(NEXT_STEP), t["subject"], F.lit(" "))
    joined = lambda steps: F.aggregate(F.slice(steps, F.lit(2), F.greatest(F.size(steps) - 1, F.lit(0))), F.get(steps, 0), lambda a, s: F.concat(a, glue, s))
    again = AGAIN if question else ""
    at_all = "" if question else AT_ALL
    ordinal = F.array(*[F.lit(x) for x in ORDINALS])
    number = F.array(*[F.lit(x) for x in NUMBERS])
    parts = F.transform(names, lambda x, i: F.concat(F.lit("the "), F.get(ordinal, i), F.lit(" "), x))
    take = F.when(n == 1, F.concat(F.lit(TAKE), t["element_singular"], F.lit(f"{at_all} — {again}{CALL_ONE}"), F.get(names, 0), F.lit("."))).otherwise(
        F.concat(F.lit(TAKE), F.get(number, n - 1), F.lit(" "), t["element_plural"], F.lit(f"{at_all} — {again}{CALL_MORE}"), _listing(parts), F.lit("."))
    )
    ref = lambda i: F.when(F.array_contains(names, F.get(law["stack"], i)), F.concat(F.get(law["stack"], i), F.lit(ITSELF))).otherwise(F.get(law["stack"], i))
    chosen = F.when(n == 1, F.concat(F.lit(STARTING), t["element_singular"])).otherwise(F.concat(F.get(number, n - 1), F.lit(f" {STARTING}"), t["element_plural"]))
    return t | {
        "take": take,
        "n_left": left,
        "n_right": F.size(law["steps"]) - left,
        "left": joined(F.slice(texts, F.lit(1), left)),
        "right": joined(F.slice(texts, left + 1, F.size(texts) - left)),
        "x": ref(0),
        "y": ref(1),
        "chosen": chosen,
    }


def render_story(pairs: DataFrame, themes: DataFrame) -> DataFrame:
    """Pairs (e, f, theme key) as themed question-stories: `story`, canonical_e and canonical_f.

    `themes` has one row per theme, with THEME_FIELDS and a palette; a row per
    authored file, it is left to Spark whether to broadcast it.
    """
    dim = themes.select(F.col("key").alias("theme key"), F.struct(*THEME_FIELDS, "palette").alias("theme"))
    h = _story_law(F.col("e"), question=False)
    two = (h["n_left"] > 0) & (h["n_right"] > 0)
    some = (h["n_left"] > 0) | (h["n_right"] > 0)
    opening = F.concat(h["intro"], F.lit(" "), h["take"], F.when(two, F.concat(F.lit(" "), _capital(h["subject"]), F.lit(SIDE_BY_SIDE))).otherwise(""))
    first = F.when(two, F.concat(F.lit(IN_THE_FIRST), h["subject"], F.lit(" "), h["left"], F.lit("."))).when(
        some, F.concat(_capital(h["subject"]), F.lit(" "), F.coalesce(F.when(h["n_left"] > 0, h["left"]), h["right"]), F.lit("."))
    )
    second = F.when(two, F.concat(F.lit(IN_THE_SECOND), h["subject"], F.lit(" "), h["right"], F.lit(".")))
    habit = F.concat(
        F.lit(HOWEVER), h["subject"], F.lit(CHOOSES), h["possessive"], F.lit(" "), h["chosen"], F.lit(", "), h["x"], F.lit(" and "), h["y"], F.lit(ALWAYS), h["same_habit"], F.lit(". "), h["closing"]
    )
    q = _story_law(F.col("f"), question=True)
    then = F.when((q["n_left"] > 0) & (q["n_right"] > 0), F.concat(F.lit(SEPARATELY), q["right"], F.lit("."))).when(q["n_right"] > 0, F.concat(_capital(q["right"]), F.lit(".")))
    start = F.when(q["n_left"] > 0, F.concat(_capital(q["left"]), F.lit(".")))
    asked = F.concat_ws(" ", q["question_intro"], q["take"], start, then)
    closing = F.concat(q["question_lead"], F.lit(f", {MUST}"), q["x"], F.lit(" and "), q["y"], F.lit(ALWAYS), q["same_question"], F.lit("?"))
    made = {
        "story": F.concat_ws("\n\n", opening, first, second, habit, asked, closing),
        "canonical_e": A.canonical(F.col("e")),
        "canonical_f": A.canonical(F.col("f")),
    }

    def told(values: DataFrame, tasks: int) -> DataFrame:
        joined = values.withColumnRenamed("theme", "wanted").join(dim, F.col("wanted") == F.col("theme key"))
        return joined.repartition(tasks).withColumns(made).select("e", "f", F.col("wanted").alias("theme"), *made)

    return once_per(pairs, ["e", "f", "theme"], told)


def _with_theme(stories: DataFrame, dim: DataFrame) -> DataFrame:
    """Distinct stories (story) beside the first theme (theme key, intro, ..) whose intro opens them, or nulls.

    Each story makes a row for each distinct length of an intro, and these meet intros by
    equality; a story's rows are then brought back to one, before it meets the theme itself.
    """
    first = dim.where("`theme key` is not null").groupBy("intro").agg(F.min("theme key").alias("theme key"))
    lengths = sorted(r["n"] for r in first.select(F.length("intro").alias("n")).distinct().collect() if r["n"] is not None)  # fewer than an intro has letters
    tried = stories.select(F.col("story").alias("told story"), F.explode(F.array(*[F.lit(n) for n in lengths]).cast("array<int>")).alias("n"))
    tried = tried.where(F.col("n") <= F.length("told story")).withColumn("intro", F.substring(F.col("told story"), F.lit(1), F.col("n")))
    best = tried.join(first, "intro").groupBy("told story").agg(F.min("theme key").alias("found key"))
    met = stories.join(best, F.col("story") == F.col("told story"), "left")
    return met.join(dim, F.col("found key") == F.col("theme key"), "left").drop("told story", "found key")


def backparse_story(stories: DataFrame, themes: DataFrame) -> DataFrame:
    """Stories with read_theme, read_e and read_f (canonical), from the text alone; null laws where it is malformed.

    The theme is the first, in the order of keys, whose intro opens the story; it is looked up
    by the story's beginnings of the lengths that intros have. Steps are found by a pattern
    from the theme's own words and folded into terms in order.
    """
    quoted = lambda c: F.regexp_replace(c, r"([\\\[\](){}.*+?^$|])", r"\\$1")
    names = F.array_join(F.transform("palette", quoted), "|")
    noun = quoted(F.col("result_noun"))
    ref = F.concat(F.lit("("), noun, F.lit(r" \d+|"), names, F.lit(")"))
    op = lambda c: F.replace(F.replace(quoted(c), F.lit(r"\{a\}"), ref), F.lit(r"\{b\}"), ref)
    compare = F.concat(F.lit("("), noun, F.lit(r" \d+|(?:"), names, F.lit(f")(?:{ITSELF})?)"))
    dim = themes.select(
        F.col("key").alias("theme key"),
        "intro",
        "question_intro",
        "result_noun",
        F.locate("{a}", F.col("op_agent")).alias("a agent"),
        F.locate("{b}", F.col("op_agent")).alias("b agent"),
        F.concat(F.lit(r"\b(?:[Ss]he|[Hh]e) "), op(F.col("op_agent")), F.lit(" and (?:" + "|".join(NAMING_AGENT) + ") "), noun, F.lit(r" (\d+)")).alias("agent"),
        F.concat(F.lit("(?i)"), op(F.col("op_imperative")), F.lit(" and (?:" + "|".join(NAMING_IMPERATIVE) + ") "), noun, F.lit(r" (\d+)")).alias("imperative"),
        F.concat(F.lit(f"{HOWEVER}(?:she|he){CHOOSES}[^,]*, "), compare, F.lit(" and "), compare, F.lit(ALWAYS), quoted(F.col("same_habit")), F.lit(r"\.")).alias("habit"),
        F.concat(F.lit(MUST), compare, F.lit(" and "), compare, F.lit(ALWAYS), quoted(F.col("same_question")), F.lit(r"\?")).alias("asked"),
    )
    at = F.expr("locate(question_intro, story)")
    habit_text = F.expr("substring(story, 1, locate(question_intro, story) - 1)")
    question_text = F.when(at > 0, F.expr("substring(story, locate(question_intro, story))"))

    def resolve(word: Column, values: Column) -> Column:
        number = F.try_to_number(F.regexp_extract(word, r"(\d+)$", 1), F.lit("999999999")).cast("int")
        name = F.lower(F.regexp_replace(word, "(?i) itself$", ""))
        return F.when(number.isNotNull(), F.get(values, number - 1)).otherwise(name)

    def law(text: str, steps: str, closing: str) -> Column:
        found = [F.regexp_extract_all(F.col(text), F.col(steps), F.lit(i)) for i in (1, 2, 3)]
        rows = F.arrays_zip(found[0].alias("a"), found[1].alias("b"), found[2].alias("n"))
        in_order = F.col("b agent") > F.col("a agent")
        first = lambda r: F.when(in_order, r["a"]).otherwise(r["b"])
        second = lambda r: F.when(in_order, r["b"]).otherwise(r["a"])

        def step(values: Column, r: Column) -> Column:
            made = F.concat(F.lit("("), resolve(first(r), values), F.lit(f" {A.OP} "), resolve(second(r), values), F.lit(")"))
            return F.when(r["n"] == (F.size(values) + 1).cast("string"), F.array_append(values, made))

        values = F.aggregate(rows, F.array().cast("array<string>"), step)
        sides = [resolve(F.expr(f"regexp_extract(`{text}`, `{closing}`, {i})"), values) for i in (1, 2)]
        good = F.regexp_like(F.col(text), F.col(closing))
        return F.when(good, A.canonical(A.parse_infix(F.concat(sides[0], F.lit(" = "), sides[1]))))

    def read(values: DataFrame, tasks: int) -> DataFrame:
        texts = _with_theme(values, dim).repartition(tasks).withColumns({"habit text": habit_text, "question text": question_text})
        return texts.select("story", F.col("theme key").alias("read_theme"), law("habit text", "agent", "habit").alias("read_e"), law("question text", "imperative", "asked").alias("read_f"))

    return once_per(stories, ["story"], read)


#: Words and characters that must not leak into texts.
BANNED_WORDS = (
    "equation", "equations", "law", "laws", "magma", "magmas", "implies", "implication", "implications", "theorem", "theorems", "lemma",
    "axiom", "axioms", "formula", "formulas", "variable", "variables", "quantifier", "commutative", "associative", "lean",
)
BANNED_CHARS = "∘◇*=+^⇒→≠()[]{}<>"


def leakage_filter(texts: DataFrame, column: str) -> DataFrame:
    """Texts with flags for formal words, notation, lone letters and letters next to digits; null texts leak nothing."""
    text = F.coalesce(F.col(column), F.lit(""))
    chars = "".join("\\" + c for c in BANNED_CHARS)
    # word ends by letters of any script, as a bare \\b differs between regex engines
    before, after = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
    return texts.withColumns(
        {
            "banned_word": F.lower(text).rlike(rf"{before}(?:{'|'.join(BANNED_WORDS)}){after}"),
            "banned_char": text.rlike(f"[{chars}]"),
            "lone_letter": text.rlike(f"{before}[b-hj-zB-HJ-Z]{after}"),
            "letter_digit": text.rlike(r"[A-Za-z][0-9]|[0-9][A-Za-z]"),
        }
    )


def validate_records(themes: DataFrame) -> DataFrame:
    """(key, violations): the rules that each theme record breaks, in a fixed order; records may lack columns or have more."""
    have = set(themes.columns)
    field = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    palette = F.col("palette") if "palette" in have else F.lit(None).cast("array<string>")
    once = lambda c, mark: F.size(F.split(field(c), "\\{" + mark + "\\}")) == 2
    rules = {f"{c} is empty": F.coalesce(F.regexp_replace(field(c), r"(?U)\s", ""), F.lit("")) == "" for c in THEME_FIELDS}
    rules |= {
        "palette is short": F.coalesce(F.size(palette) < 6, F.lit(True)),
        "palette has odd names": F.coalesce(F.exists(palette, lambda x: ~F.coalesce(x.rlike("^[a-z]+$"), F.lit(False))), F.lit(False)),
        "palette repeats": F.coalesce(F.size(F.array_distinct(palette)) < F.size(palette), F.lit(False)),
        "op_agent places": ~F.coalesce(once("op_agent", "a") & once("op_agent", "b"), F.lit(False)),
        "op_imperative places": ~F.coalesce(once("op_imperative", "a") & once("op_imperative", "b"), F.lit(False)),
        "subject": ~F.coalesce(field("subject").isin("she", "he"), F.lit(False)),
        "result_noun": ~F.coalesce(field("result_noun").rlike("^[A-Z][a-z]+$"), F.lit(False)),
        "result_noun in palette": F.coalesce(F.array_contains(palette, F.lower(field("result_noun"))), F.lit(False)),
    }
    odd = sorted(have - {*THEME_FIELDS, "palette", "notes"})
    rules |= {f"unknown field {c}": F.col(f"`{c}`").isNotNull() for c in odd}
    broken = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))
    return themes.select(field("key").alias("key"), broken.alias("violations"))
