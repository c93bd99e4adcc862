"""Seeded samples and synthetic laws in hash order.

A draw's hash decides it, so that samples repeat, do not depend on the form in
which pairs are rendered, and can be made on any number of executors. Pairs are
found by position: laws get a place within their group, and draw number i names two
places, by a keyed permutation of the numbers of all pairs or by turns. No law is
paired with every other, and a sample that can be filled is.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lawframe.functions import algebra as A
from lawframe.operators import corpus
from lawframe.operators.order import numbered
from lawframe.session import shared_folder

#: Rounds of the keyed permutation.
ROUNDS = 4
#: (slot, least and most operations of both laws, how many), filled in this order (fixed values).
SLOTS = (("low", 2, 3, 1), ("high", 7, 8, 1), ("example", 4, 6, 3))


def _hash(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]).cast("binary"), 256)


def _number(digest: Column) -> Column:
    """The first 60 bits."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def permuted(spark: SparkSession, size: int, n: int, seed: str) -> DataFrame:
    """(draw, at): the first n of the numbers 0 .. size - 1 in an order that the seed decides, each number once.

    A Feistel network permutes the numbers below a power of four, of which those below `size`, one in
    four at least, count in their order. So each draw is a new number, and all are drawn in the end.
    """
    half = next(w for w in range(1, 32) if 4**w >= size)
    mask = (1 << half) - 1
    tried = min(4**half, 8 * n + 64)
    while True:
        draws = spark.range(tried).select(F.col("id").alias("draw"), F.shiftright("id", half).alias("l"), F.col("id").bitwiseAND(F.lit(mask)).alias("r"))
        for turn in range(ROUNDS):
            mixed = _number(_hash(seed, str(turn), F.col("r"))) % (1 << half)
            draws = draws.select("draw", F.col("r").alias("l"), F.col("l").bitwiseXOR(mixed).alias("r"))
        found = draws.select("draw", (F.shiftleft("l", half) + F.col("r")).alias("at")).where(F.col("at") < size)
        if tried == 4**half or found.count() >= n:
            return found.orderBy("draw").limit(n)
        tried = min(4**half, 2 * tried)


def _with_laws(pairs: DataFrame, laws: DataFrame) -> DataFrame:
    """Pairs (e_no, f_no) of renderable laws with their texts and tokens."""
    usable = corpus.renderable(laws)
    e = usable.select(F.col("law_no").alias("e_no"), F.col("equation").alias("e_text"), F.col("tokens").alias("e"))
    f = usable.select(F.col("law_no").alias("f_no"), F.col("equation").alias("f_text"), F.col("tokens").alias("f"))
    return pairs.join(e, "e_no").join(f, "f_no")


def _by_place(pairs: DataFrame, placed: DataFrame) -> DataFrame:
    """Pairs (e_at, f_at) with e_no and f_no of the laws in these places."""
    for side in "ef":
        pairs = pairs.join(placed.select(F.col("place").alias(f"{side}_at"), F.col("law_no").alias(f"{side}_no")), f"{side}_at")
    return pairs


def sample_pairs(laws: DataFrame, n: int, seed: str, form: str = "story") -> DataFrame:
    """n ordered pairs of different renderable laws in draw order; ValueError if there are not as many.

    A pair's number tells the places of its laws among the renderable ones; numbers are
    drawn without replacement, so that any sample that can be filled is.
    """
    placed = numbered(corpus.renderable(laws).select("law_no"), ["law_no"], "place").checkpoint()
    m = placed.count()
    size = m * (m - 1)
    if size < n:
        raise ValueError(f"only {size} of {n} pairs can be drawn")
    e_at = F.expr(f"at div {max(m - 1, 1)}")
    f_at = F.col("at") % max(m - 1, 1)
    drawn = permuted(laws.sparkSession, size, n, seed).select("draw", (e_at + 1).alias("e_at"), (f_at + 1 + (f_at >= e_at).cast("long")).alias("f_at"))
    found = _by_place(drawn, placed).select("draw", "e_no", "f_no")
    return _with_laws(found, laws).withColumn("form", F.lit(form)).orderBy("draw")


def pair_set_differences(arms: dict[str, DataFrame]) -> DataFrame:
    """(form_a, form_b, only_a, only_b): how far the pair sets of two arms differ."""
    names, found = list(arms), None
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            left, right = (arms[x].select("e_no", "f_no") for x in (a, b))
            parts = left.exceptAll(right).select(F.lit(1).alias("a")).unionByName(right.exceptAll(left).select(F.lit(0).alias("a")))
            row = parts.agg(F.count_if(F.col("a") == 1).alias("only_a"), F.count_if(F.col("a") == 0).alias("only_b"))
            row = row.select(F.lit(a).alias("form_a"), F.lit(b).alias("form_b"), "only_a", "only_b")
            found = row if found is None else found.unionByName(row)
    return found


def split_sizes(laws: DataFrame, bins: Iterable[int] = range(1, 9), most: int = 4) -> DataFrame:
    """(bin, ops_e, ops_f, candidates): how many pairs of different laws each split of a bin has, found by equal keys."""
    sizes = laws.withColumn("ops", A.operations(F.col("tokens"))).where(F.col("ops") <= most).groupBy("ops").agg(F.count(F.lit(1)).alias("n"))
    e = sizes.select(F.col("ops").alias("ops_e"), F.col("n").alias("n_e"))
    f = sizes.select(F.col("ops").alias("ops_f"), F.col("n").alias("n_f"))
    wanted = e.withColumn("bin", F.explode(F.array(*[F.lit(b) for b in bins])))
    own = F.when(F.col("ops_e") == F.col("ops_f"), F.col("n_e")).otherwise(0)
    split = wanted.join(f, F.col("bin") - F.col("ops_e") == F.col("ops_f"))
    return split.select("bin", "ops_e", "ops_f", (F.col("n_e") * F.col("n_f") - own).alias("candidates")).where("candidates > 0")


def _placed(laws: DataFrame, seed: str, most: int) -> DataFrame:
    """(law_no, ops, at): the first `most` places by hash among laws of as many operations."""
    order = Window.partitionBy("ops").orderBy(_hash(seed, F.col("law_no")), "law_no")
    ranked = laws.withColumn("ops", A.operations(F.col("tokens"))).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= most).select("law_no", "ops", (F.col("rank") - 1).cast("long").alias("at"))


def _full(sample: DataFrame, group: str, quota: dict) -> DataFrame:
    """The sample, if each group has its quota; ValueError with the groups that fall short, an absent one included."""
    got = {r[group]: r["n"] for r in sample.groupBy(group).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per group of a short list
    if short := [f"{g}: {got.get(g, 0)} of {n}" for g, n in quota.items() if got.get(g, 0) < n]:
        raise ValueError(f"too few for {group} {', '.join(short)}")
    return sample


def _turns(laws: DataFrame, per_split: int, bins: Iterable[int], most: int) -> DataFrame:
    """(bin, ops_e, ops_f, candidates, j, e_at, f_at): the places of the laws of each split's first pairs, all different."""
    counts = laws.groupBy(A.operations(F.col("tokens")).alias("ops")).agg(F.count(F.lit(1)).alias("n"))
    e, f = (counts.select(F.col("ops").alias(f"ops_{x}"), F.col("n").alias(f"n_{x}")) for x in "ef")
    turns = split_sizes(laws, bins, most).join(e, "ops_e").join(f, "ops_f")
    turns = turns.withColumn("j", F.explode(F.sequence(F.lit(0), F.least(F.lit(per_split), F.col("candidates")).cast("int") - 1)))
    block, same = F.floor(F.col("j") / F.col("n_e")), (F.col("ops_e") == F.col("ops_f")).cast("int")
    e_at = F.col("j") % F.col("n_e")
    return turns.select("bin", "ops_e", "ops_f", "candidates", "j", e_at.alias("e_at"), ((e_at + block + same) % F.col("n_f")).alias("f_at"))


def _at_places(turns: DataFrame, laws: DataFrame, seed: str, per_split: int) -> DataFrame:
    """Turns with e_no and f_no; only places that they can reach are kept: e_at + block + 1 is at most 2 * per_split."""
    placed = _placed(laws, seed, 2 * per_split + 1)
    e, f = (placed.select(F.col("law_no").alias(f"{x}_no"), F.col("ops").alias(f"ops_{x}"), F.col("at").alias(f"{x}_at")) for x in "ef")
    return turns.join(e, ["ops_e", "e_at"]).join(f, ["ops_f", "f_at"])


def split_pairs(laws: DataFrame, per_split: int, seed: str, bins: Iterable[int] = range(1, 9), most: int = 4) -> DataFrame:
    """(bin, ops_e, ops_f, candidates, place, e_no, f_no): of each split of a bin how many pairs there are, and the first `per_split` of them."""
    found = _at_places(_turns(laws, per_split, bins, most), laws, seed, per_split)
    return found.select("bin", "ops_e", "ops_f", "candidates", (F.col("j") + 1).alias("place"), "e_no", "f_no")


def sample_stratified(laws: DataFrame, per_bin: int, seed: str, bins: Iterable[int] = range(1, 9), most: int = 4) -> DataFrame:
    """(bin, e_no, f_no): per bin of total operations, pairs dealt in turn to its splits, then by place within a split.

    A split that runs out leaves its turns to the others; ValueError if a bin
    has fewer pairs than asked for.
    """
    bins = list(bins)
    usable = corpus.renderable(laws)
    order = Window.partitionBy("bin").orderBy("j", _hash(seed, F.col("bin"), F.col("ops_e")))
    turns = _turns(usable, per_bin, bins, most).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_bin)
    return _full(_at_places(turns, usable, seed, per_bin).select("bin", "e_no", "f_no"), "bin", dict.fromkeys(bins, per_bin))


def sample_balanced(laws: DataFrame, per_bin: int, seed: str, bins: Iterable[int] = range(1, 11)) -> DataFrame:
    """(ops, e_no, f_no): `per_bin` pairs of different laws of as many operations, for each number in `bins`; ValueError if one has too few."""
    bins = list(bins)
    usable = corpus.renderable(laws).where(A.operations(F.col("tokens")).isin(bins))
    pools = usable.groupBy(A.operations(F.col("tokens")).alias("ops")).agg(F.count(F.lit(1)).alias("pool")).where("pool >= 2")
    draws = pools.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(per_bin - 1)))).where("i < pool * (pool - 1)")
    e_at = F.col("i") % F.col("pool")
    shift = F.floor(F.col("i") / F.col("pool")) % (F.col("pool") - 1)
    draws = draws.select("ops", e_at.alias("e_at"), ((F.col("i") + 1 + shift) % F.col("pool")).alias("f_at"))
    placed = _placed(usable, seed, per_bin + 1)
    e, f = (placed.select(F.col("law_no").alias(f"{x}_no"), "ops", F.col("at").alias(f"{x}_at")) for x in "ef")
    return _full(draws.join(e, ["ops", "e_at"]).join(f, ["ops", "f_at"]).select("ops", "e_no", "f_no"), "ops", dict.fromkeys(bins, per_bin))


def slot_fill(laws: DataFrame, seed: str) -> DataFrame:
    """(slot, place, e_no, f_no, ops_total): for each slot as many distinct, non-vacuous pairs as it wants, in draw order; ValueError if there are not as many.

    The pairs of a slot are numbered by the operations of their laws and by the laws' places
    among those of as many, and drawn without replacement.
    """
    usable = corpus.renderable(laws).select("law_no", A.operations(F.col("tokens")).alias("ops")).where("ops > 0")
    placed = numbered(usable, ["ops", "law_no"], "place").checkpoint()
    have = {r["ops"]: (r["first"], r["n"]) for r in placed.groupBy("ops").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).collect()}  # a row per number of operations
    found = None
    for slot, low, high, n in SLOTS:
        splits, size = [], 0
        for total in range(low, high + 1):
            for e in sorted(have):
                f = total - e
                if f in have and (pairs := have[e][1] * (have[f][1] - (e == f))):
                    splits.append((size, pairs, total, e, f))
                    size += pairs
        if size < n:
            raise ValueError(f"too few for slot {slot}: {size} of {n}")
        told = F.lit(None)
        for first, pairs, total, e, f in splits:
            (e_first, _), (f_first, f_n) = have[e], have[f]
            width = f_n - (e == f)
            e_at = F.expr(f"(at - {first}) div {width}")
            f_at = (F.col("at") - first) % width
            f_at = f_at + (f_at >= e_at).cast("long") if e == f else f_at
            own = F.struct(F.lit(total).alias("ops_total"), (e_at + e_first).alias("e_at"), (f_at + f_first).alias("f_at"))
            told = F.when((F.col("at") >= first) & (F.col("at") < first + pairs), own).otherwise(told)
        drawn = permuted(laws.sparkSession, size, n, f"{seed}|{slot}").withColumn("t", told)
        place = F.row_number().over(Window.orderBy("draw"))  # of the few rows of a slot
        drawn = drawn.select(F.lit(slot).alias("slot"), place.alias("place"), "t.ops_total", "t.e_at", "t.f_at")
        found = drawn if found is None else found.unionByName(drawn)
    return _by_place(found, placed).select("slot", "place", "e_no", "f_no", "ops_total")


def nested_examples(laws: DataFrame, group: str, most: int, seed: str) -> DataFrame:
    """(group, k, examples): per group the first k laws in hash order, k = 1 .. most, so that each set holds the one before."""
    order = Window.partitionBy(group).orderBy(_hash(seed, F.col("law_no")), "law_no")
    ranked = laws.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    sets = ranked.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("rank", "equation"))).alias("found"))
    each = sets.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("found"))))
    return each.select(group, "k", F.array_join(F.transform(F.slice("found", F.lit(1), F.col("k")), lambda x: x["equation"]), "\n").alias("examples"))


def _shape(seed: str, draw: Column, side: str, ops: Column) -> Column:
    """A binary tree of `ops` operations in Polish order, O and L, uniform over all shapes.

    Any order of the ops O and ops + 1 L has exactly one rotation that is a tree
    (the one after its first lowest partial sum), and each tree has as many.
    """
    places = F.transform(F.sequence(F.lit(0), ops * 2), lambda p: F.struct(_hash(seed, side, draw, p).alias("h"), F.when(p < ops, "O").otherwise("L").alias("t")))
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("low"), F.lit(0).alias("at"), F.lit(0).alias("i"))

    def step(s: Column, t: Column) -> Column:
        total = s["sum"] + F.when(t == "O", 1).otherwise(-1)
        lower = total < s["low"]
        return F.struct(
            total.alias("sum"), F.when(lower, total).otherwise(s["low"]).alias("low"), F.when(lower, s["i"] + 1).otherwise(s["at"]).alias("at"), (s["i"] + 1).alias("i")
        )

    def rotated(mixed: Column) -> Column:
        cut = F.aggregate(mixed, start, step, lambda s: s["at"])
        return A.let(cut, lambda c: F.concat(F.slice(mixed, c + 1, F.size(mixed) - c), F.slice(mixed, F.lit(1), c)))

    return A.let(F.transform(F.array_sort(places), lambda x: x["t"]), rotated)


def _term(polish: Column) -> Column:
    """Polish tokens as infix text."""
    def step(stack: Column, t: Column) -> Column:
        n = F.size(stack)
        # read from the right: the top of the stack is the left argument
        made = F.concat(F.lit("("), F.get(stack, n - 1), F.lit(f" {A.OP} "), F.get(stack, n - 2), F.lit(")"))
        return F.when(t == "O", F.array_append(F.slice(stack, F.lit(1), F.greatest(n - 2, F.lit(0))), made)).otherwise(F.array_append(stack, t))

    return F.get(F.aggregate(F.reverse(polish), F.array().cast("array<string>"), step), 0)


def _attempts(draws: DataFrame, bins: list[int], seed: str) -> DataFrame:
    """(bin, law_key, line, draw): the laws that the draws make with as many operations, one per law key, the first drawn."""
    each = draws.withColumn("bin", F.explode(F.array(*[F.lit(b) for b in bins])))
    cut = (_number(_hash(seed, "cut", F.col("bin"), F.col("draw"))) % (F.col("bin") + 1)).cast("int")
    split = each.withColumn("cut", cut).withColumn("few", F.least("cut", F.col("bin") - F.col("cut")))
    key = F.concat_ws("|", F.col("bin").cast("string"), F.col("draw").cast("string"))
    shapes = F.struct(_shape(seed, key, "l", F.col("few")).alias("lhs"), _shape(seed, key, "r", F.col("bin") - F.col("few")).alias("rhs"))
    names = F.array(*[F.lit(x) for x in "xyzwuv"])
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("used"))

    def leaf(s: Column, t: Column) -> Column:
        choice = (_number(_hash(seed, "leaf", F.col("bin"), F.col("draw"), F.size(s["out"]))) % F.least(s["used"] + 1, F.lit(corpus.MOST_VARIABLES))).cast("int")
        named = lambda at: F.struct(F.array_append(s["out"], F.get(names, at)).alias("out"), F.greatest(s["used"], at + 1).alias("used"))
        return F.when(t == "L", A.let(choice, named)).otherwise(F.struct(F.array_append(s["out"], t).alias("out"), s["used"].alias("used")))

    def filled(s: Column) -> Column:
        leaves = F.aggregate(F.concat(s["lhs"], s["rhs"]), start, leaf, lambda x: x["out"])
        return F.struct(leaves.alias("polish"), F.size(s["lhs"]).alias("n"))

    # small bins have few laws, so that draws meet in Polish form before terms are made of them;
    # exploding an array of one keeps Spark from repeating the expression wherever its result is used
    drawn = split.select("bin", "draw", F.explode(F.array(A.let(shapes, filled))).alias("s"))
    drawn = drawn.groupBy("bin", F.col("s.n").alias("n"), F.array_join("s.polish", "").alias("polish")).agg(F.min("draw").alias("draw"))
    polish = F.split("polish", "")
    left, right = F.slice(polish, F.lit(1), F.col("n")), F.slice(polish, F.col("n") + 1, F.length("polish") - F.col("n"))
    made = drawn.select("bin", "draw", F.explode(F.array(F.struct(_term(left).alias("left"), _term(right).alias("right")))).alias("s")).where("s.left <> s.right")
    tokens = A.parse_canonical(F.concat("s.left", F.lit(" = "), "s.right"))
    keyed = made.select("bin", "draw", F.explode(F.array(tokens)).alias("t")).select("bin", "draw", A.law_key(F.col("t")).alias("law_key"), A.serialized(F.col("t")).alias("line"))
    return keyed.groupBy("bin", "law_key").agg(F.min_by("line", "draw").alias("line"), F.min("draw").alias("draw"))


#: Draws for each law of a quota that are tried first, and attempts of one task then and later.
FIRST_DRAWS = 50
FIRST_ATTEMPTS, LATER_ATTEMPTS = 2_000, 20_000


def synthesize_laws(draws: DataFrame, bins: Iterable[int], seed: str, per_bin: int, min_pairs: int = 20) -> DataFrame:
    """(bin, law_key, line, draw): per bin the first `per_bin` laws with as many operations, one per law key, the first drawn.

    Each row of `draws` (draw) makes one attempt per bin: the operations are split
    uniformly, the smaller side first, each side's shape is uniform, and each leaf
    takes a used variable or a fresh one, six at most. A bin may stay short of its
    quota if its laws still make `min_pairs` ordered pairs; ValueError if not.

    A bin whose quota the lowest draws fill can't change by any later one; all other bins
    take every draw. Attempts are dealt to tasks by their number, as a row is small and its work isn't.
    """
    bins, draws = list(bins), draws.select("draw")
    shared_folder(draws.sparkSession)
    order = Window.partitionBy("bin").orderBy("draw", "law_key")

    def kept(found: DataFrame) -> DataFrame:
        # the plan drops all but the first of each bin before it shuffles
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_bin).drop("rank").checkpoint()

    def dealt(some: DataFrame, n: int, n_bins: int, attempts: int) -> DataFrame:
        return some.repartition(max(1, -(-n * n_bins // attempts)))

    lowest = draws.orderBy("draw").limit(FIRST_DRAWS * per_bin).checkpoint()
    n, last = lowest.agg(F.count(F.lit(1)), F.max("draw")).first()
    laws = kept(_attempts(dealt(lowest, n, len(bins), FIRST_ATTEMPTS), bins, seed))
    have = {r["bin"]: r["n"] for r in laws.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per bin
    lacking = [b for b in bins if have.get(b, 0) < per_bin]
    later = draws.where("draw is not null" if last is None else F.col("draw") > last)
    if lacking and (n := later.count()):
        more = laws.unionByName(_attempts(dealt(later, n, len(lacking), LATER_ATTEMPTS), lacking, seed))
        laws = kept(more.groupBy("bin", "law_key").agg(F.min_by("line", "draw").alias("line"), F.min("draw").alias("draw")))
    enough = next(n for n in range(per_bin + 1) if n == per_bin or n * (n - 1) >= min_pairs)
    return _full(laws, "bin", dict.fromkeys(bins, enough))
