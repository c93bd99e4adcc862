"""SimHash near-duplicates by pigeonring filtering.

Fingerprints are 64-bit. Equal fingerprints are merged before anything else,
so exact copies cost one shuffled row per task. The bits form a ring of five
segments. With at most two differing bits in all, some segment starts a chain
whose first l segments differ in at most l * 2 / 5 bits for every l: none in
the first two, at most one in the first three and in the first four. Hence
the first two and the third or fourth segment agree exactly: ten keys of 38
or 39 bits per distinct fingerprint, which keep candidates few up to tens of
billions of fingerprints. Fingerprints that share a key are checked against
the chain's quotas, then by their full Hamming distance.

Within a key, links are searched breadth first, and only the links that first
reach a fingerprint come out: fewer than the fingerprints, and as connected as
all pairs. A key with more than `limit` fingerprints is divided on the executors
into three finer keys by its other bits (two differing bits leave one of three
parts equal), again and again; each key is thus bounded without losing a pair.
Components of the links are found by alternating minimum stars.

Defined results: a text without words has fingerprint zero and links to other
texts near zero; null is a text without words; repeated rows are in one
component and each come out; a component whose ids are all null has id null;
an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawframe.llm.common import checkpointed, chunks, in_batches, joined_on, marked, text_key

SEED = 42
SHINGLE = 3
SEGMENTS = 5
DISTANCE = 2
KEY_LIMIT = 2048

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def fingerprint(raw: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of a text's word shingles, repeats included, as a signed 64-bit number."""
    words = raw.translate(_LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(text[a:b], seed) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 1 << 16):
        counts += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, key, fp) per row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, shingle, seed) for _, texts in chunks(batch, "text") for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, type=pa.int64())], names=["doc_id", "key", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), F.col("text").cast("binary").alias("text"))
    return in_batches(rows).mapInArrow(run, "doc_id long, key long, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _bits(places: list[int]) -> int:
    return sum(1 << p for p in places)


def key_masks() -> tuple[list[int], list[int], list[list[int]]]:
    """By kind: the bits that agree, the bits of the chain's first four segments, and the kinds of its three finer keys.

    Kinds 0 to 9 are the chain keys; finer kinds follow, until 12 bits or fewer are free.
    """
    edges = [i * 64 // SEGMENTS for i in range(SEGMENTS + 1)]
    segment = [list(range(edges[i], edges[i + 1])) for i in range(SEGMENTS)]
    masks, chains = [], []
    for i in range(SEGMENTS):
        ring = [segment[(i + j) % SEGMENTS] for j in range(4)]
        for third in (ring[2], ring[3]):
            masks.append(_bits(ring[0] + ring[1] + third))
            chains.append(_bits([p for part in ring for p in part]))
    finer: list[list[int]] = []
    kind = 0
    while kind < len(masks):
        free = [p for p in range(64) if not masks[kind] >> p & 1]
        finer.append([])
        if len(free) > 12:
            for j in range(3):
                finer[kind].append(len(masks))
                masks.append(masks[kind] | _bits(free[j::3]))
                chains.append(chains[kind])
        kind += 1
    return masks, chains, finer


MASKS, CHAINS, FINER = key_masks()


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows (kind, fp) with the bits of their key, without those that share their key with no other."""
    masks = F.array(*[F.lit(_signed(m)) for m in MASKS])
    keyed = rows.withColumn("bits", F.col("fp").bitwiseAND(F.element_at(masks, F.col("kind") + 1)))
    # counted before they meet, as a key can have very many fingerprints
    counts = keyed.groupBy("kind", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return keyed.join(counts, ["kind", "bits"]).select("fp", "kind", "bits", "n")


def _forest(values: np.ndarray, chain: int) -> Iterator[tuple[int, int]]:
    """Links that reach every value from the first of its component; each link keeps to the chain's quota and the distance."""
    rest = values
    quota, most = np.uint64(chain), DISTANCE
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            differs = rest ^ at
            near = np.bitwise_count(differs & quota) <= 1
            near[near] = np.bitwise_count(differs[near]) <= most
            if near.any():
                for other in rest[near]:
                    yield int(at), int(other)
                queue += list(rest[near])
                rest = rest[~near]


def _links(rows: DataFrame) -> DataFrame:
    """(a, b) as above within each key; rows come sorted, so that one key at a time is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            both = np.array(pairs, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        held: list[np.ndarray] = []
        key = None
        for batch in batches:
            kind, bits = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            fps = batch.column(2).to_numpy().view(np.uint64)
            if not len(fps):
                continue
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(kind) != 0) | (np.diff(bits) != 0)) + 1, [len(fps)]]).tolist()
            pairs: list[tuple[int, int]] = []
            for low, high in zip(cuts, cuts[1:], strict=False):
                now = (int(kind[low]), int(bits[low]))
                if now != key:
                    if held:
                        pairs += _forest(np.concatenate(held), CHAINS[key[0]])
                    held, key = [], now
                held.append(fps[low:high])
            if pairs:
                yield out(pairs)
        if held:
            yield out(list(_forest(np.concatenate(held), CHAINS[key[0]])))

    dealt = rows.select("kind", "bits", "fp").repartition("kind", "bits").sortWithinPartitions("kind", "bits", "fp")
    return in_batches(dealt).mapInArrow(run, "a long, b long").distinct()


def links(distinct: DataFrame, limit: int = KEY_LIMIT) -> DataFrame:
    """(a, b): links between distinct fingerprints (fp) that connect all within the distance."""
    rows = distinct.select("fp", F.explode(F.array(*[F.lit(k) for k in range(2 * SEGMENTS)])).alias("kind"))
    found = None
    while rows is not None:
        shared = checkpointed(_keyed(rows))
        finer = F.array(*[F.array(*[F.lit(k) for k in ks]).cast("array<int>") for ks in FINER])
        deeper = F.element_at(finer, F.col("kind") + 1)
        large = (F.col("n") > limit) & (F.size(deeper) > 0)
        part = _links(shared.where(~large))
        found = part if found is None else found.union(part)
        hot = shared.where(large)
        rows = None if hot.isEmpty() else hot.select("fp", F.explode(deeper).alias("kind"))
    return found


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): alternating stars around each node's least neighbour.

    Minima are aggregated before they are joined back, so a node with very many
    links is one aggregate and a join that Spark can split.
    """
    now = checkpointed(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).where("v <> m").distinct())
    seen = None
    while True:
        both = now.union(now.select("m", "v")).toDF("v", "u")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select("v", "m").where("v <> m").distinct()
        low = large.groupBy("v").agg(F.min("m").alias("least"))
        pairs = large.join(low, "v")
        star = pairs.select(F.greatest("m", "least").alias("v"), F.least("m", "least").alias("m")).union(pairs.select("v", F.col("least").alias("m")))
        now = checkpointed(star.where("v <> m").distinct())
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return now.select(F.col("v").alias("node"), F.col("m").alias("root")).union(now.select("m", "m").distinct())


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, limit: int = KEY_LIMIT) -> DataFrame:
    """(doc_id, key, fp, component_id) per row of (doc_id, text)."""
    printed = checkpointed(fingerprints(docs, shingle, seed))
    distinct = checkpointed(printed.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("n")))
    linked = checkpointed(components(links(distinct, limit)))
    of_root = linked.join(distinct, F.col("node") == F.col("fp")).groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_node = linked.join(of_root, "root").select("node", "component_id")
    of_print = distinct.join(of_node, F.col("fp") == F.col("node"), "left").select(
        "fp", F.when(F.col("node").isNull(), F.col("least_id")).otherwise(F.col("component_id")).alias("component_id"), "n"
    )
    return joined_on(printed, checkpointed(of_print), "fp").select("doc_id", "key", "fp", "component_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """The rows of `docs` without near-duplicates: of each component the row of least id (nulls last) stays, once."""
    found = checkpointed(near_duplicates(docs, shingle, seed))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    # a component of null ids only is told by the texts' fingerprints
    group = F.coalesce(F.concat(F.lit("id "), F.col("component_id").cast("string")), F.concat(F.lit("fp "), F.col("fp").cast("string")))
    rows = found.groupBy(group.alias("g"), "doc_id", "key").agg(F.count(F.lit(1)).alias("copies"))
    best = checkpointed(rows.groupBy("g").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("n")))
    marks = checkpointed(
        joined_on(rows, best, "g").select("doc_id", "key", rank.eqNullSafe(F.col("best")).alias("stays"), "copies").where("not stays or copies > 1")
    )
    keys = [F.col("doc_id"), text_key(F.col("text"))]
    kept = marked(docs, marks.where("not stays").select("doc_id", "key"), keys, "left_anti")
    repeated = marks.where("stays").select("doc_id", "key")
    if repeated.isEmpty():
        return kept
    # rows that agree in doc_id and text may differ in others, of any type: the least as JSON stays
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    once = marked(kept, repeated, keys, "left_semi").select(row.alias("row")).groupBy(F.col("row.doc_id").alias("id"), text_key(F.col("row.text")).alias("key"))
    return marked(kept, repeated, keys, "left_anti").union(once.agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*"))
