"""The trie of conversation prefixes, by ROLLUP over positional columns.

A turn's id is a digest of its role and text. Turns get places by one sort over
ranges; `WIDTH` consecutive turns of a conversation are the columns t1, t2, .. of a
block, and a block's key tells the node that the turns before it lead to: the
exclusive or of a hash of each turn and its depth, two numbers of 64 bits. So

    GROUP BY block, key, ROLLUP (t1, .., t8)

with grouping_id() aggregates all prefixes of all conversations together, a long
conversation's in further blocks. A prefix that is longer than its conversation
ends in a null column and is left out.

Sums over subtrees need no walk either. A node's owner is its smallest member. Going
down a conversation owners never get smaller, so what a conversation owns is the end
of its path; of its nodes in the subtree of a node that it doesn't own, it owns the
same ones. Hence distinct nodes, leaves and bytes of a subtree are sums over its
members of what each owns, with one correction for the node's owner, and a second
ROLLUP adds them up.

Every step is an aggregate with partial sums or a join on unique keys; the members
that end in one node are hashed in order, by id ranges of bounded size that are
packed on any number of executors, then streamed.

Defined results: turns of equal number come in order of role, then text, repeated
rows each count; a null role or text is empty; rows without conv_id belong to no
conversation; a conversation without turns is a member of the root alone; a
conversation may be of any length; without conversations there is no node, not even
the root. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lawframe.llm.common import checkpointed, in_batches, joined_on

WIDTH = 8
#: Blocks of a conversation whose prefixes one task sums up at a time.
RUN = 4096
#: Ids in a range that is hashed as one piece.
RANGE = 4096


def turn_id(role: Column, text: Column) -> Column:
    """A digest of 128 bits of both, told apart by the role's length."""
    parts = F.concat_ws(":", F.octet_length(role).cast("string"), role, text)
    return F.unhex(F.md5(parts.cast("binary")))


def placed_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, id, bytes): each turn's place in its conversation, from 1, by a sort over ranges and not a task per conversation."""
    empty = F.lit("")
    role, text = F.coalesce(F.col("role").cast("string"), empty), F.coalesce(F.col("text"), empty)
    turns = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    ordered = turns.orderBy("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    # numbered by range, then by place in it; the texts stay behind
    kept = checkpointed(ordered.select("conv_id", turn_id(F.col("role"), F.col("text")).alias("id"), F.octet_length("text").cast("long").alias("bytes"), F.monotonically_increasing_id().alias("at")))
    ranges = kept.groupBy("conv_id", F.shiftright("at", 33).alias("range")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    per = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # a row per conversation and range that it is in
    starts = checkpointed(ranges.select(F.struct("conv_id", "range").alias("key"), "first", F.coalesce(F.sum("n").over(per), F.lit(0)).alias("before"), "n"))
    met = joined_on(kept.withColumn("key", F.struct("conv_id", F.shiftright("at", 33).alias("range"))), starts, "key")
    return met.select("conv_id", (F.col("before") + F.col("at") - F.col("first") + 1).alias("place"), "id", "bytes")


def branched(turns: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """(conversations (c, total), turns (c, place, id, bytes)) with the start of each conversation replaced.

    Conversation c takes the first h turns of conversation c - c % group, h = crc32(c) % most,
    then its own after the first h.
    """
    h = F.crc32(F.col("c").cast("string").cast("binary")) % most
    lengths = checkpointed(turns.groupBy(F.col("conv_id").alias("c")).agg(F.count(F.lit(1)).alias("n")))
    base = lengths.select(F.col("c").alias("base"), F.col("n").alias("base_n"))
    told = lengths.withColumns({"h": h, "base": F.col("c") - F.col("c") % group}).join(base, "base", "left")
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    told = checkpointed(told.select("c", "base", "h", "n", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total")))
    own = joined_on(turns.withColumnRenamed("conv_id", "c"), told.select("c", "h", "taken", "n"), "c").where("place > h")
    own = own.select("c", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "id", "bytes")
    # at most `most` turns of a conversation, for at most `group` others
    heads = turns.where((F.col("place") < most) & (F.col("conv_id") % group == 0))
    lent = told.where("taken > 0").join(heads, F.col("base") == F.col("conv_id")).where("place <= taken").select("c", "place", "id", "bytes")
    return told.select("c", "total"), own.unionByName(lent)


def _mixed(depth: Column, turn: Column) -> list[Column]:
    return [F.xxhash64(F.lit(salt), depth, turn) for salt in (1, 2)]


def _turn(j: int) -> str:
    return f"t{j + 1}"


def blocks(conversations: DataFrame, turns: DataFrame, width: int = WIDTH, run: int = RUN) -> DataFrame:
    """(c, total, block, x1, x2, t1 .. , rest, y1, y2, last): blocks of turns; each conversation has a first one, even without turns.

    A column t is (id, bytes). (x1, x2) is the key of the node before the block, (y1, y2) of the one
    at its end, `rest` the bytes from the block on, `last` marks a conversation's last block.
    """
    depth = F.col("place")
    at = turns.select("c", F.floor((depth - 1) / width).alias("block"), ((depth - 1) % width).alias("slot"), F.struct("id", "bytes").alias("t"), *[m.alias(n) for m, n in zip(_mixed(depth, F.col("id")), ("x1", "x2"), strict=True)], "bytes")
    none = conversations.where("total = 0").select("c", F.lit(0).cast("long").alias("block"))
    own = at.unionByName(none, allowMissingColumns=True).groupBy("c", "block").agg(
        *[F.max(F.when(F.col("slot") == j, F.col("t"))).alias(_turn(j)) for j in range(width)],
        F.coalesce(F.bit_xor("x1"), F.lit(0)).alias("z1"),
        F.coalesce(F.bit_xor("x2"), F.lit(0)).alias("z2"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("here"),
    )
    own = checkpointed(own.join(conversations, "c"))
    columns = ["c", "total", "block", "x1", "x2", *[_turn(j) for j in range(width)], "rest", "y1", "y2", "last"]
    zero = F.lit(0).cast("long")
    single = own.where(F.col("total") <= width).withColumns({"x1": zero, "x2": zero, "rest": F.col("here"), "y1": F.col("z1"), "y2": F.col("z2"), "last": F.lit(True)}).select(*columns)
    # prefixes over the blocks of longer ones: within runs of blocks, after those of the runs before
    long = own.where(F.col("total") > width).withColumn("run", F.floor(F.col("block") / run))
    runs = long.groupBy("c", F.col("run").alias("of run")).agg(F.bit_xor("z1").alias("r1"), F.bit_xor("z2").alias("r2"), F.sum("here").alias("r")).withColumnRenamed("c", "of c")
    earlier = Window.partitionBy("of c").orderBy("of run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("of c", "of run", *[F.coalesce(F.bit_xor(f"r{i}").over(earlier), F.lit(0)).alias(f"b{i}") for i in (1, 2)], F.coalesce(F.sum("r").over(earlier), F.lit(0)).alias("b"), F.sum("r").over(Window.partitionBy("of c")).alias("all"))
    within = Window.partitionBy("c", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = {f"w{i}": F.coalesce(F.bit_xor(f"z{i}").over(within), F.lit(0)) for i in (1, 2)} | {"w": F.coalesce(F.sum("here").over(within), F.lit(0))}
    met = long.withColumns(sums).join(runs, (F.col("c") == F.col("of c")) & (F.col("run") == F.col("of run")))
    x = {f"x{i}": F.col(f"w{i}").bitwiseXOR(F.col(f"b{i}")) for i in (1, 2)}
    met = met.withColumns(x).withColumns({f"y{i}": F.col(f"x{i}").bitwiseXOR(F.col(f"z{i}")) for i in (1, 2)})
    met = met.withColumns({"rest": F.col("all") - F.col("b") - F.col("w"), "last": (F.col("block") + 1) * width >= F.col("total")})
    return checkpointed(single.unionByName(met.select(*columns)))


def rolled_up(rows: DataFrame, aggregates: dict[str, str], width: int = WIDTH) -> DataFrame:
    """(depth, x1, x2, p1, p2, bytes, before, ..): aggregates of each node's members, with its key, its parent's, the bytes of its last text and those before it in its block."""
    names = [_turn(j) for j in range(width)]
    told = ", ".join(f"{sql} AS {name}" for name, sql in aggregates.items())
    # the bits of the columns before the ROLLUP are 0 in grouping_id(), as these are always grouped
    wide = rows.sparkSession.sql(
        f"SELECT block, x1, x2, {', '.join(names)}, grouping_id() AS gid, {told} FROM {{rows}} GROUP BY block, x1, x2, ROLLUP ({', '.join(names)})", rows=rows
    )
    inside = (width - F.length(F.regexp_replace(F.bin("gid"), "0", ""))).cast("int")
    wide = wide.withColumn("inside", inside)
    turns = F.array(*names)
    # the root is a node of no turn; the others end in a turn, or else the conversation has ended
    wide = wide.where(F.when(F.col("inside") == 0, F.col("block") == 0).otherwise(F.get(turns, F.col("inside") - 1).isNotNull()))
    keys = {f"{k}{i}": F.col(f"x{i}") for k in "xp" for i in (1, 2)}
    before, last, zero = F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long")
    for j, name in enumerate(names):
        for i, mixed in zip((1, 2), _mixed(F.col("block") * width + j + 1, F.col(f"{name}.id")), strict=True):
            keys[f"x{i}"] = keys[f"x{i}"].bitwiseXOR(F.when(F.col("inside") > j, mixed).otherwise(zero))
            keys[f"p{i}"] = keys[f"p{i}"].bitwiseXOR(F.when(F.col("inside") > j + 1, mixed).otherwise(zero))
        before = before + F.when(F.col("inside") > j + 1, F.col(f"{name}.bytes")).otherwise(zero)
        last = last + F.when(F.col("inside") == j + 1, F.col(f"{name}.bytes")).otherwise(zero)
    depth = (F.col("block") * width + F.col("inside")).cast("long")
    return wide.select(depth.alias("depth"), *[c.alias(n) for n, c in keys.items()], last.alias("bytes"), before.alias("before"), *aggregates)


def _end(ids: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(ids), lambda c: c.cast("string")), ",")


def ends(rows: DataFrame, key: str, member: str, span: int = RANGE) -> DataFrame:
    """(key, sha256) of the members of each key, ascending, comma-joined.

    Members in an id range of `span`, a power of two, are one piece; only keys with several pieces are
    hashed piece by piece, in order, as a hash of a sequence has to be: one piece is held at a time.
    """
    pieces = checkpointed(rows.groupBy(key, F.shiftright(member, span.bit_length() - 1).alias("range")).agg(_end(F.collect_list(member)).alias("text")))
    per = checkpointed(pieces.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("text").alias("text")))
    single = per.where("n = 1").select(key, F.sha2("text", 256).alias("sha256"))
    several = pieces.join(per.where("n > 1").select(key), key).repartition(key).sortWithinPartitions(key, "range").select(F.to_json(key).alias("told"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done: list[tuple[str, str]] = []
            for told, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if told != now:
                    if now is not None:
                        done.append((now, state.hexdigest()))
                    now, state = told, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], type=pa.string()) for i in (0, 1)], names=["told", "sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], names=["told", "sha256"])

    kind = rows.schema[key].dataType
    streamed = in_batches(several).mapInArrow(run, "told string, sha256 string").select(F.from_json("told", kind).alias(key), "sha256")
    return single.unionByName(streamed)


def trie(conversations: DataFrame, turns: DataFrame, width: int = WIDTH) -> DataFrame:
    """A row per node of the conversations (c, total) and their turns (c, place, id, bytes).

    (key, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)
    """
    rows = blocks(conversations, turns, width)
    first = rolled_up(rows, {"owner": "min(c)", "longest": "max(total)"}, width)
    owned = first.groupBy("owner").agg(F.sum("bytes").alias("owned"), F.count_if(F.col("longest") == F.col("depth")).alias("leaves"))
    owned = checkpointed(owned.withColumnRenamed("owner", "of"))
    # what a conversation owns is below all nodes on its path that it doesn't own, so each of its blocks tells it
    weighed = rows.join(owned, F.col("c") == F.col("of"), "left").withColumns({"weight": F.col("rest") - F.coalesce("owned", F.lit(0)), "leaf": F.coalesce("leaves", F.lit(0))})
    sums = {"conv_id": "min(c)", "n_convs": "count(*)", "weight": "sum(weight)", "own": "min_by(weight, c)", "n_leaves": "sum(leaf)"}
    nodes = rolled_up(weighed.select("c", "block", "x1", "x2", *[_turn(j) for j in range(width)], "weight", "leaf"), sums, width)
    nodes = checkpointed(
        nodes.select(
            F.struct("depth", "x1", "x2").alias("key"),
            F.struct((F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")).alias("parent"),
            "depth",
            "conv_id",
            "n_convs",
            "n_leaves",
            (F.col("weight") - F.col("own") - (F.col("n_convs") - 1) * F.col("before")).alias("saved_tokens"),
        )
    )
    parents = nodes.where("depth > 0").groupBy("parent").agg(F.count(F.lit(1)).alias("n"))
    parents = checkpointed(parents.join(nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent"))
    below = joined_on(nodes.where("depth > 0"), parents, "parent").select(*nodes.columns, "parent_conv_id")
    root = nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    last = rows.where("last").select(F.struct(F.col("total").alias("depth"), F.col("y1").alias("x1"), F.col("y2").alias("x2")).alias("key"), "c")
    told = below.unionByName(root).join(parents.select(F.col("parent").alias("key"), F.col("n").alias("n_children")), "key", "left").join(ends(last, "key", "c"), "key", "left")
    return told.select(
        "key", "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")
    )


def prefix_trie(conversations: DataFrame, group: int = 5, most: int = 9, width: int = WIDTH) -> DataFrame:
    """The trie of (conv_id, turn, role, text) with replaced starts, as `branched` says."""
    told, turns = branched(placed_turns(conversations), group, most)
    return trie(told, turns, width).drop("key")
