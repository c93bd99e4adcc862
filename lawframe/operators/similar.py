"""Similar names by edit distance, through an index of q-grams.

The similarity of two names is 1 - edit distance / longer length. Names that are at
least s alike have a number of q-grams in common that follows from s and their
lengths, so of each name's q-grams, the rarest first, a few must have one in common
with any name that is alike: only those are in the index. Lengths bound the pairs
further, and the edit distance of what is left is computed up to the bound alone.

The nearest few are looked for at high similarities first, where the index is
sharp. A name goes on to a lower one only while it has found too few.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lawframe.session import shared_folder

#: Similarities that are tried before the least one.
LEVELS = (0.8, 0.6, 0.5)
#: What counts as equal where similarities are compared as floating-point numbers.
SLACK = 1e-9


def gram_size(least: float) -> int:
    """The longest grams, of three letters at most, of which names that are so alike must share one."""
    return max(1, min(3, math.floor(1 / max(1 - least, SLACK) + SLACK)))


def _grams(names: DataFrame, name: str, q: int) -> DataFrame:
    """(name, length, gram, nth): the q-grams of each name, with its ends marked; equal ones are numbered."""
    length = F.length(name)
    marked = F.concat(F.repeat(F.lit("\x01"), q - 1), F.col(name), F.repeat(F.lit("\x02"), q - 1))
    places = F.when(length + q - 1 > 0, F.sequence(F.lit(1), length + q - 1)).otherwise(F.array().cast("array<int>"))
    each = names.select(name, length.alias("length"), marked.alias("marked"), F.explode(places).alias("at"))
    each = each.select(name, "length", F.substring(F.col("marked"), F.col("at"), F.lit(q)).alias("gram"), "at")
    return each.select(name, "length", "gram", F.row_number().over(Window.partitionBy(name, "gram").orderBy("at")).alias("nth"))


def _indexed(grams: DataFrame, counts: DataFrame, name: str, q: int, least: float) -> DataFrame:
    """The rarest grams of each name, as many as have to be tried."""
    shared = F.greatest(F.lit(1), F.ceil(F.col("length") * F.lit(1 - q * (1 - least)) + F.lit(q - 1 - SLACK)))
    rank = F.row_number().over(Window.partitionBy(name).orderBy(F.coalesce("n", F.lit(0)), "gram", "nth"))
    ranked = grams.join(counts, ["gram", "nth"], "left").withColumn("rank", rank)
    return ranked.where(F.col("rank") <= F.col("length") + q - shared).select(name, "length", "gram", "nth")


def candidates(keys: DataFrame, names: DataFrame, least: float) -> DataFrame:
    """(key, name): the pairs of distinct (key) and (name) that can be so alike, each once; no pair that is so alike is missing."""
    q = gram_size(least)
    grams = _grams(names, "name", q)
    counts = grams.groupBy("gram", "nth").agg(F.count(F.lit(1)).alias("n"))
    left = _indexed(_grams(keys, "key", q), counts, "key", q, least)
    right = _indexed(grams, counts, "name", q, least).withColumnRenamed("length", "size")
    near = (F.col("size") + SLACK >= F.col("length") * least) & (F.col("length") + SLACK >= F.col("size") * least)
    return left.join(right, ["gram", "nth"]).where(near).select("key", "name").distinct()


def similarity(key: Column | str, name: Column | str, least: float) -> Column:
    """The similarity of two names if it is `least` or more, else null."""
    longer = F.greatest(F.length(key), F.length(name))
    most = F.floor(longer * F.lit(1 - least) + F.lit(SLACK)).cast("int")
    distance = F.call_function("levenshtein", F.col(key) if isinstance(key, str) else key, F.col(name) if isinstance(name, str) else name, most)
    near = 1 - distance / longer
    return F.when((distance >= 0) & (near >= least), near)


def nearest(keys: DataFrame, names: DataFrame, least: float = 0.4, most: int = 3) -> DataFrame:
    """(key, rank, name): for each (key) its up to `most` most similar names (name), ties by name."""
    shared_folder(keys.sparkSession)
    keys = keys.where("key is not null").select("key").distinct().checkpoint()
    names = names.where("name is not null").select("name").distinct().checkpoint()
    found = None
    for level in [*[x for x in LEVELS if x > least], least]:
        alike = candidates(keys, names, level).withColumn("near", similarity("key", "name", level)).where("near is not null")
        ranked = alike.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("near"), "name"))).where(F.col("rank") <= most)
        best = ranked.select("key", "rank", "name").checkpoint()
        done = best.where(F.col("rank") == most).select("key") if level > least else keys
        part = best.join(done, "key", "left_semi")
        found = part if found is None else found.unionByName(part)
        keys = keys.join(done, "key", "left_anti").checkpoint()
    return found
