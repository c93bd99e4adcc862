"""Equation algebra as column expressions.

An equation is an array of tokens: `(`, `)`, `=`, `∘` and names, in which every
operation but no lone term has parentheses, so that the array holds the term
trees without a recursive type. A null array is an equation that does not
parse; every function of it is null.

No Python runs here. Spark evaluates the lambdas element by element, so a long
plan should write down `parse_infix` or `parse_prefix` once and go on from there.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OP = "∘"
#: Nested operations that an answer may have.
MOST_DEPTH = 50
#: (swap_e, swap_f, dual) with the fewest flags first, equal counts in tuple order (fixed values).
TRANSFORMS = (
    (False, False, False),
    (False, False, True),
    (False, True, False),
    (True, False, False),
    (False, True, True),
    (True, False, True),
    (True, True, False),
    (True, True, True),
)

_INFIX = r"[()=∘◇*]|\p{L}[\p{L}\p{N}]*"
_PREFIX = r"[(),=]|\p{L}[\p{L}\p{N}_]*"


def let(value: Column, body) -> Column:
    """body(value) with the value evaluated once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def infix_tokens(text: Column) -> Column:
    """Tokens of infix text with `∘` for every operation symbol; null if there is any other character."""
    found = F.regexp_extract_all(text, F.lit(_INFIX), F.lit(0))
    left = F.regexp_replace(F.regexp_replace(text, _INFIX, ""), r"(?U)\s+", "")
    return F.when(left == "", F.transform(found, lambda t: F.when(t.isin("◇", "*"), OP).otherwise(t)))


def prefix_tokens(text: Column) -> Column:
    """Tokens of `op(a, b)` text with `op` in lower case; null if there is any other character."""
    found = F.regexp_extract_all(text, F.lit(_PREFIX), F.lit(0))
    left = F.regexp_replace(F.regexp_replace(text, _PREFIX, ""), r"(?U)\s+", "")
    return F.when(left == "", F.transform(found, lambda t: F.when(F.lower(t) == "op", "op").otherwise(t)))


def _is_name(t: Column) -> Column:
    return t.rlike(r"^\p{L}") & (t != "op")


def _fold(start: Column, steps: Column, step) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), start, lambda s, _: step(s))


def _parens(tokens: Column) -> Column:
    return F.size(F.filter(tokens, lambda t: t == "("))


def valid_infix(tokens: Column) -> Column:
    """Whether tokens make two fully parenthesised terms around one `=`; the outermost operation may be bare."""
    code = lambda t: F.when(t.isin("(", ")", "="), t).when(t == OP, "o").otherwise("V")
    shape = F.array_join(F.transform(tokens, code), "")
    reduced = _fold(shape, _parens(tokens), lambda s: F.regexp_replace(s, r"\(V\)|\(VoV\)", "V"))
    return F.coalesce(reduced.rlike(r"^(V|VoV)=(V|VoV)$"), F.lit(False))


def valid_prefix(tokens: Column) -> Column:
    """Whether tokens are an equation of prefix terms with at most MOST_DEPTH nested operations."""
    code = lambda t: F.when(t.isin("(", ")", "=", ","), t).when(t == "op", "O").otherwise("V")
    shape = F.array_join(F.transform(tokens, code), "")
    steps = F.least(_parens(tokens), F.lit(MOST_DEPTH))
    reduced = _fold(shape, steps, lambda s: F.regexp_replace(s, r"O\(V,V\)", "V"))
    return F.coalesce(reduced == "V=V", F.lit(False))


def _normalised(tokens: Column) -> Column:
    """Valid infix tokens with parentheses around exactly the operations.

    Innermost pairs first, an operation's become brackets with its symbol
    changed, and a lone term's vanish; names are in braces meanwhile.
    """
    text = F.array_join(F.transform(tokens, lambda t: F.when(_is_name(t), F.concat(F.lit("{"), t, F.lit("}"))).otherwise(t)), "")
    once = lambda s: F.regexp_replace(F.regexp_replace(s, r"\(([^()∘]*)\)", "$1"), r"\(([^()∘]*)∘([^()∘]*)\)", "[$1·$2]")
    folded = _fold(text, _parens(tokens), once)
    outer = F.regexp_replace(folded, r"^([^∘=]*)∘([^∘=]*)=", "[$1·$2]=")
    outer = F.regexp_replace(outer, r"=([^∘=]*)∘([^∘=]*)$", "=[$1·$2]")
    parts = F.regexp_extract_all(outer, F.lit(r"[\[\]·=]|\{[^{}]*\}"), F.lit(0))
    return F.transform(
        parts, lambda t: F.when(t == "[", "(").when(t == "]", ")").when(t == "·", OP).when(t == "=", "=").otherwise(F.regexp_replace(t, r"[{}]", ""))
    )


def parse_infix(text: Column) -> Column:
    return let(infix_tokens(text), lambda t: F.when(valid_infix(t), _normalised(t)))


def parse_prefix(text: Column) -> Column:
    infix = lambda tokens: F.transform(F.filter(tokens, lambda t: t != "op"), lambda t: F.when(t == ",", OP).otherwise(t))
    return let(prefix_tokens(text), lambda t: F.when(valid_prefix(t), infix(t)))


def parse_canonical(text: Column) -> Column:
    """Tokens of a canonical string, which needs no check."""
    return F.regexp_extract_all(text, F.lit(_INFIX), F.lit(0))


def variables(tokens: Column) -> Column:
    """Distinct names by first appearance."""
    return F.array_distinct(F.filter(tokens, _is_name))


def renamed(tokens: Column) -> Column:
    """Names become v1, v2, ... by first appearance."""
    def number(all_tokens: Column, names: Column) -> Column:
        return F.transform(all_tokens, lambda t: F.when(_is_name(t), F.concat(F.lit("v"), F.array_position(names, t).cast("string"))).otherwise(t))

    return let(tokens, lambda all_tokens: let(variables(all_tokens), lambda names: number(all_tokens, names)))


def rendered(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda t: F.when(t == OP, f" {OP} ").when(t == "=", " = ").otherwise(t)), "")


def canonical(tokens: Column) -> Column:
    return rendered(renamed(tokens))


def left_side(tokens: Column) -> Column:
    return F.slice(tokens, F.lit(1), (F.array_position(tokens, "=") - 1).cast("int"))


def right_side(tokens: Column) -> Column:
    at = F.array_position(tokens, "=").cast("int")
    return F.slice(tokens, at + 1, F.size(tokens) - at)


def swapped(tokens: Column) -> Column:
    return let(tokens, lambda t: F.concat(right_side(t), F.array(F.lit("=")), left_side(t)))


def _backwards(tokens: Column) -> Column:
    """The dual with its sides swapped."""
    return F.transform(F.reverse(tokens), lambda t: F.when(t == "(", ")").when(t == ")", "(").otherwise(t))


def dual(tokens: Column) -> Column:
    """Every operation with its arguments exchanged: each side read backwards."""
    return swapped(_backwards(tokens))


def operations(tokens: Column) -> Column:
    return F.size(F.filter(tokens, lambda t: t == OP))


def depth(tokens: Column) -> Column:
    """Deepest nesting of operations; both sides end at no nesting, so that they need not be parted."""
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(s: Column, t: Column) -> Column:
        now = s["now"] + F.when(t == "(", 1).when(t == ")", -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(s["most"], now).alias("most"))

    return F.when(tokens.isNotNull(), F.aggregate(tokens, start, step, lambda s: s["most"]))


def law_key(tokens: Column) -> Column:
    return let(tokens, lambda t: F.least(canonical(t), canonical(swapped(t))))


def serialized(tokens: Column) -> Column:
    """Line form of an equation list: the outermost operation bare, `◇` for the operation."""
    def side(t: Column) -> Column:
        return F.regexp_replace(F.translate(rendered(t), OP, "◇"), r"^\((.*)\)$", "$1")

    return let(tokens, lambda t: F.concat(side(left_side(t)), F.lit(" = "), side(right_side(t))))


def to_prefix(canonical_text: Column) -> Column:
    return F.replace(F.replace(canonical_text, F.lit("("), F.lit("op(")), F.lit(f" {OP} "), F.lit(", "))


def is_vacuous(text: Column) -> Column:
    return ~text.rlike("[∘◇*]")


def orbit(e: Column, f: Column) -> Column:
    """The eight accepted forms of a pair of equations, as (swap_e, swap_f, dual, e, f) with canonical strings."""
    def forms(tokens: Column) -> Column:
        """Canonical strings as they are, swapped, dual, dual and swapped."""
        return let(
            tokens,
            lambda t: let(
                _backwards(t), lambda back: F.array(canonical(t), canonical(swapped(t)), canonical(swapped(back)), canonical(back))
            ),
        )

    def eight(both: Column) -> Column:
        place = lambda swap, mirror: swap + 2 * mirror
        return F.array(
            *[
                F.struct(
                    F.lit(a).alias("swap_e"), F.lit(b).alias("swap_f"), F.lit(d).alias("dual"), F.get(both["e"], place(a, d)).alias("e"), F.get(both["f"], place(b, d)).alias("f")
                )
                for a, b, d in TRANSFORMS
            ]
        )

    return let(F.struct(forms(e).alias("e"), forms(f).alias("f")), eight)


def answer_class_key(e: Column, f: Column) -> Column:
    """The least (e, f) of the orbit: equal for two answers if and only if they are graded alike everywhere."""
    return F.array_min(F.transform(orbit(e, f), lambda t: F.struct(t["e"].alias("e"), t["f"].alias("f"))))


def theme_number(e_text: Column, f_text: Column, themes: int) -> Column:
    """Zero-based place of the theme, from the first eight bytes of the pair's digest."""
    digest = F.sha2(F.concat(e_text, F.lit(" => "), f_text).cast("binary"), 256)
    return (F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)") % themes).cast("int")


def record_key(label_e: Column, label_f: Column, theme: Column, canonical_e: Column, canonical_f: Column) -> Column:
    """`E1-E2-theme` with odd characters replaced, or `pair-` and a digest where a label is missing."""
    clean = lambda c: F.regexp_replace(c, r"[^A-Za-z0-9_-]", "_")
    digest = F.substring(F.sha2(F.concat(canonical_e, F.lit(" => "), canonical_f).cast("binary"), 256), 1, 12)
    labelled = F.concat_ws("-", clean(label_e), clean(label_f), theme)
    has = F.coalesce(label_e, F.lit("")) != ""
    has &= F.coalesce(label_f, F.lit("")) != ""
    return F.when(has, labelled).otherwise(F.concat_ws("-", F.concat(F.lit("pair-"), digest), theme))
