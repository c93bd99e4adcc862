"""Benchmark decontamination by a prefix-filtered set join.

Benchmark items become windows of `window` words; a document must hold all
shingles of a window to hold the window, so the prefix of each window, in the
order of rarity over all documents, is its one rarest shingle. Documents are
scanned for prefix shingles only; what is found joins the windows by shingle
hash, is bounded by position and length, and is compared word for word.

Two scans of the documents read whole texts: one counts benchmark shingles,
one finds candidates. Each filters by a bit table that is built from hashes on
the executors, with 256 bits or more for each shingle looked for, up to 16 MB in
all; a benchmark of more than half a million windows only lets more false
candidates through to the join, which drops them. No step pairs documents with each other
or holds a group: a passage that is in a third of all documents makes one
candidate per occurrence, which carries the window's number and not its items.

Defined results: null, empty and wordless texts have no words and no hits;
items without words have no windows; repeated items count once by item_id; an
item without an id marks words as hit and is not among the items; among equally
rare shingles the one of least hash is the prefix; a long text is scanned whole;
repeated document rows each get the same result; an empty benchmark leaves
every document clean. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawframe.llm.common import BROADCAST_ROWS, checkpointed, chunks, in_batches, marked, small, text_key

WINDOW = 10
SHINGLE = 3
#: Least and most bits of a bit table, as powers of two; it is made in blocks of 2 ** 16 bits.
LEAST_BITS, MOST_BITS = 16, 27

#: Bytes of words stay, A-Z in lower case; all others part words.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_WORD_BYTES).split()


def shingle_hashes(crcs: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash for each run of `size` words, given the words' crc32."""
    n = max(0, len(crcs) - size + 1)
    found = np.full(n, size * 0x2545F4914F6CDD1D & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            found = (found ^ crcs[j : j + n]) * np.uint64(_MIX[j % len(_MIX)])
            found ^= found >> np.uint64(29)
    return found


def word_crcs(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), dtype=np.uint64, count=len(words))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(item_id, window, len, off, k, h): every shingle of every window."""
    schema = "item_id string, window string, len int, off int, k int, h long"
    names = ["item_id", "window", "len", "off", "k", "h"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                words = words_of(text or b"")
                if not words:
                    continue
                size = min(window, len(words))
                k = min(shingle, size)
                hashes = shingle_hashes(word_crcs(words), k).view(np.int64).tolist()
                for at in range(len(words) - size + 1):
                    name = b" ".join(words[at : at + size]).decode("utf-8", "replace")
                    out += [(item, name, size, off, k, hashes[at + off]) for off in range(size - k + 1)]
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays(_columns(out), names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays(_columns(out), names=names)

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text"))
    return in_batches(items).mapInArrow(run, schema)


def _columns(rows: list[tuple]) -> list[pa.Array]:
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
    return [pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]


class BitTable:
    """Bits over shingles' hashes, and the shingles' sizes."""

    def __init__(self, bits: int, table: np.ndarray, sizes: list[int]):
        self.bits, self.table, self.sizes = bits, table, sizes

    def find(self, crcs: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of shingles that the table may hold and that stay within one text."""
        hashes = shingle_hashes(crcs, k)
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        at = np.flatnonzero(self.table[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
        text = np.searchsorted(ends, at, side="right")
        at = at[at + k <= ends[text]] if len(at) else at
        return at, hashes[at]


def bit_table(hashes: DataFrame) -> BitTable:
    """The table of (k, h) rows, sized by their number; its blocks are made on the executors."""
    sizes, n = hashes.agg(F.collect_set("k"), F.count_distinct("h")).first()
    bits = min(MOST_BITS, max(LEAST_BITS, (256 * n).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            slot = np.sort((batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64))
            for part in np.split(slot, np.flatnonzero(np.diff(slot >> 16)) + 1):
                if len(part):
                    held.setdefault(int(part[0] >> 16), np.zeros(1 << 16, dtype=bool))[part & 0xFFFF] = True
        for block, found in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([np.packbits(found, bitorder="little").tobytes()])], names=["block", "bits"])

    table = np.zeros(1 << (bits - 3), dtype=np.uint8)
    once = hashes.select("h").distinct()  # so that no shingle's copies meet in one task
    dealt = once.repartition(F.shiftrightunsigned("h", 64 - bits + 16)) if bits > 16 else once.coalesce(1)
    for row in dealt.mapInArrow(run, "block long, bits binary").toLocalIterator():  # 2 ** (MOST_BITS - 16) rows at most
        table[row["block"] << 13 : row["block"] + 1 << 13] |= np.frombuffer(row["bits"], dtype=np.uint8)
    return BitTable(bits, table, sorted(sizes))


def shingle_counts(docs: DataFrame, table: BitTable) -> DataFrame:
    """(h, n): occurrences over all documents of the shingles in the table, summed per step before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in chunks(batch, "text"):
                split = [words_of(t) for t in texts]
                ends = np.cumsum([len(w) for w in split])
                crcs = word_crcs([w for s in split for w in s])
                for k in table.sizes:
                    hashes, n = np.unique(table.find(crcs, ends, k)[1], return_counts=True)
                    if len(hashes):
                        yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    return in_batches(docs.select("text")).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def candidates(docs: DataFrame, table: BitTable, window: int) -> DataFrame:
    """Per document row, a row with is_row = 1, and one per occurrence of a prefix shingle, with the words around it."""
    schema = "doc_id long, key long, is_row int, n_words long, h long, pos long, before int, around string"
    names = ["doc_id", "key", "is_row", "n_words", "h", "pos", "before", "around"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, texts in chunks(batch, "text"):
                split = [words_of(t) for t in texts]
                sums = np.cumsum([len(w) for w in split])
                crcs = word_crcs([w for s in split for w in s])
                # the hash of a document's own row is spread and meets no window, as it joins by is_row too
                out = [(ids[first + i], keys[first + i], 1, len(w), keys[first + i], None, None, None) for i, w in enumerate(split)]
                starts = np.concatenate([[0], sums[:-1]])
                for k in table.sizes:
                    at, hashes = table.find(crcs, sums, k)
                    for p, i, h in zip(at.tolist(), np.searchsorted(sums, at, side="right").tolist(), hashes.view(np.int64).tolist(), strict=True):
                        p -= int(starts[i])
                        low = max(0, p - window + 1)
                        around = b" ".join(split[i][low : p + window]).decode("utf-8", "replace")
                        out.append((ids[first + i], keys[first + i], 0, len(split[i]), h, p, p - low, around))
                        if len(out) >= 20_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                            out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), F.col("text").cast("binary").alias("text"))
    return in_batches(rows).mapInArrow(run, schema)


def prefixes(docs: DataFrame, shingles: DataFrame) -> DataFrame:
    """(no, window, len, h, off, k): each window, numbered, with its rarest shingle."""
    counts = shingle_counts(docs, bit_table(shingles))
    ranked = shingles.join(counts, "h", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    found = ranked.groupBy("window", "len").agg(F.min(F.struct("n", "h", "off", "k")).alias("rarest"))
    return found.select(F.monotonically_increasing_id().alias("no"), "window", "len", "rarest.h", "rarest.off", "rarest.k")


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Per document row: doc_id, key (of its text), n_words, spans (distinct (start, len) of windows found), items."""
    shingles = checkpointed(benchmark_windows(benchmark, window, shingle))
    prefix = checkpointed(prefixes(docs, shingles))
    found = candidates(docs, bit_table(prefix), window)
    p = prefix.select(F.col("h").alias("ph"), "off", "len", "window", "no")
    p = F.broadcast(p) if prefix.count() <= BROADCAST_ROWS else p
    start = F.col("pos") - F.col("off")
    place = F.col("before") - F.col("off")
    bounds = (F.col("is_row") == 0) & (place >= 0) & (start + F.col("len") <= F.col("n_words"))
    same = F.array_join(F.slice(F.split("around", " "), F.greatest(place + 1, F.lit(1)), F.col("len")), " ") == F.col("window")
    joined = found.join(p, (F.col("h") == F.col("ph")) & (F.col("is_row") == 0), "left").withColumn("hit", F.when(bounds & same, True))
    by_row = joined.groupBy("doc_id", "key").agg(
        F.sum("is_row").cast("int").alias("copies"),
        F.max("n_words").alias("n_words"),
        F.collect_set(F.when(F.col("hit"), F.struct(start.alias("start"), F.col("len")))).alias("spans"),
        F.collect_set(F.when(F.col("hit"), F.col("no"))).alias("windows"),
    )
    by_row = checkpointed(by_row)
    items = shingles.where("off = 0 and item_id is not null").select("item_id", "window", "len").distinct().join(prefix.select("window", "len", "no"), ["window", "len"])
    held = by_row.where(F.size("windows") > 0).withColumn("set", F.array_sort("windows"))
    # copies of a passage bring the same set of windows, whose items are listed once
    sets = held.select("set").distinct().select("set", F.explode("set").alias("no"))
    named = sets.join(small(items.select("no", "item_id")), "no").groupBy("set").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    none = F.array().cast("array<string>")
    found = held.join(small(named), "set", "left").select(*by_row.columns, F.coalesce("items", none).alias("items"))
    found = found.unionByName(by_row.where(F.size("windows") == 0).withColumn("items", none))
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc_id", "key", "n_words", "spans", "items")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of what matches() returns."""
    hit = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["len"] - 1))))
    return found.withColumn("n_hit", F.size(hit).cast("long")).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """The rows of `docs` that hold no window of the benchmark."""
    hit = matches(docs, benchmark, window, shingle).where(F.size("spans") > 0)
    return marked(docs, hit.select("doc_id", "key"), [F.col("doc_id"), text_key(F.col("text"))], "left_anti")
