"""Spelling variants by search schemes on bidirectional FM-indexes.

Words are the runs of letters of all documents, counted. Two words are near at one
inserted, deleted or replaced code point. One error leaves one half of a word as it
is, so two searches find all near words: match the left half exactly and let the
error be in the right one, and the other way round.

The vocabulary is dealt to shards by direction and half: a word meets the words that
share the half which a search matches exactly. A shard is a text of delimited words
with an FM-index of it and one of its mirror image. The exact half goes leftwards
from its end to the delimiter on the first, while the interval of suffix ranks on the
second is kept in step; from there the search goes rightwards on the second, with one
error at any place, to the delimiter that ends the word. In shards of right halves
words are mirrored, so that both searches are the same code. All words of a shard are
searched at once, a step of all intervals being array arithmetic.

A half that very many words share is divided into blocks of bounded size by hash, and
is searched in each; a shard is thus bounded whatever the words. Chains of forms
are followed by pointer jumping.

Defined results: a null or empty text has no words; a null doc_id is the empty text in
the hash that damages words; repeated rows count each; a run is read whole, whatever
its length; a word whose near words are all rare has form null and is its own root;
without words the result is empty. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawframe.llm.common import checkpointed, chunks, in_batches, joined_on

LEAST_LETTERS = 5
LEAST_COUNT = 3
#: Letters and delimiters of a shard, and of a block of a half that more words share.
SHARD_SYMBOLS = 1 << 18
#: A form has at least so many times the occurrences of the word.
RATIO = 2
#: Words that a task counts before it hands them on.
HELD_WORDS = 1 << 18
#: Every so many-th run of a document is damaged by its hash, to have variants to find.
DAMAGED = 97
#: Searches that take one step together.
BEAM = 1 << 14

#: By code point up to U+00FF: letters, A-Z in lower case, and blanks for all others.
_LETTERS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0xC0 else 0x20 for c in range(256))


def runs_of(raw: bytes) -> list[bytes]:
    """Runs of letters of a text in UTF-8, lower-cased, a byte for each code point."""
    return raw.decode("utf-8", "replace").encode("latin-1", "replace").translate(_LETTERS).split()


def damaged(run: bytes, start: int, every: int = DAMAGED) -> bytes:
    """The run, or the run without one code point where its checksum after `start` says so, once in `every` times."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, every: int = DAMAGED) -> DataFrame:
    """(word, n) of (doc_id, text): counted by task first."""

    def out(counts: Counter[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in counts], type=pa.string()), pa.array(list(counts.values()), type=pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, texts in chunks(batch, "text"):
                for i, raw in enumerate(texts):
                    doc = ids[first + i] or ""
                    start = zlib.crc32(f"{doc}:".encode())
                    for word, n in Counter(runs_of(raw)).items():
                        made = damaged(word, start, every)
                        if len(made) >= least_letters:
                            held[made] += n
                    if len(held) >= HELD_WORDS:
                        yield out(held)
                        held = Counter()
        yield out(held)

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    counted = in_batches(rows).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class Ranks:
    """Counts of each letter before each place of a Burrows-Wheeler text: a sum per 32 places, and a bit for each place in between."""

    def __init__(self, text: np.ndarray, letters: int):
        n = len(text)
        size = n // 32 + 1
        self.bits = np.zeros((size, letters), dtype=np.uint32)
        place = np.arange(n)
        np.bitwise_or.at(self.bits, (place >> 5, text), np.uint32(1) << (place & 31).astype(np.uint32))
        self.sums = np.zeros((size, letters), dtype=np.int32)
        np.cumsum(np.bitwise_count(self.bits[:-1]), axis=0, out=self.sums[1:])
        totals = np.bincount(text, minlength=letters)
        self.first = np.concatenate([[0], np.cumsum(totals)[:-1]])

    def of(self, letter: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The suffix rank to which a letter before suffix rank `at` leads."""
        block = at >> 5
        below = (np.uint32(1) << (at & 31).astype(np.uint32)) - np.uint32(1)
        return self.first[letter] + self.sums[block, letter] + np.bitwise_count(self.bits[block, letter] & below)

    def all(self, at: np.ndarray) -> np.ndarray:
        """The same for every letter: a row for each place."""
        block = at >> 5
        below = (np.uint32(1) << (at & 31).astype(np.uint32)) - np.uint32(1)
        return self.first + self.sums[block] + np.bitwise_count(self.bits[block] & below[:, None])


def burrows_wheeler(words: list[np.ndarray]) -> np.ndarray:
    """The text's last column for sorted, distinct words of letters from 1, each ended by a delimiter 0 of its own that comes before its first letter.

    Suffixes are sorted by doubling; one that has reached its delimiter is like no other.
    """
    sizes = np.array([len(w) for w in words], dtype=np.int64) + 1
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    text = np.zeros(int(sizes.sum()), dtype=np.int64)
    ends = starts + sizes - 1
    inside = np.ones(len(text), dtype=bool)
    inside[ends] = False
    text[inside] = np.concatenate(words)
    rank = text + len(words)
    rank[ends] = np.arange(len(words))
    step = 1
    while True:
        ahead = np.zeros_like(rank)
        ahead[:-step or None] = rank[step:] if step < len(rank) else 0
        keys = rank * (int(rank.max()) + 1) + ahead
        order = np.argsort(keys, kind="stable")
        new = np.concatenate([[True], np.diff(keys[order]) != 0])
        rank[order] = np.cumsum(new) - 1
        if new.all():
            break
        step *= 2
    before = np.where(inside, text, 0)
    last = np.empty(len(text), dtype=np.int64)
    previous = np.empty(len(text), dtype=np.int64)
    previous[1:] = before[:-1]
    previous[starts] = 0
    last[rank] = previous
    return last


class BidirectionalIndex:
    """Ranks of a delimited vocabulary and of its mirror image; intervals of suffix ranks of both are kept in step."""

    def __init__(self, words: list[bytes], letters: bytes = b""):
        """`letters` are further ones that are asked for."""
        self.alphabet = np.unique(np.frombuffer(b"".join(words) + letters, dtype=np.uint8))
        self.code = np.zeros(256, dtype=np.int64)
        self.code[self.alphabet] = np.arange(1, len(self.alphabet) + 1)
        self.letters = len(self.alphabet) + 1
        forward = sorted(words)
        self.mirrored = sorted(w[::-1] for w in words)
        self.size = sum(map(len, words)) + len(words)
        self.left, self.right = (Ranks(burrows_wheeler([self.coded(w) for w in ws]), self.letters) for ws in (forward, self.mirrored))

    def coded(self, word: bytes) -> np.ndarray:
        """Letters by number, from 1."""
        return self.code[np.frombuffer(word, dtype=np.uint8)]

    def to_left(self, low: np.ndarray, mirror: np.ndarray, size: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Intervals (low, mirror, size) with one letter more on the left: the mirror interval moves past all smaller letters."""
        a, b = self.left.all(low), self.left.all(low + size)
        counts = np.concatenate([np.zeros((len(low), 1), dtype=b.dtype), np.cumsum(b - a, axis=1)], axis=1)
        row = np.arange(len(low))
        return a[row, letter], mirror + counts[row, letter], b[row, letter] - a[row, letter]

    def to_right(self, low: np.ndarray, high: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mirror intervals with one letter more on the right."""
        return self.right.of(letter, low), self.right.of(letter, high)

    def each_to_right(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place, letter, low, high) for every letter, delimiters aside, that goes on from an interval."""
        a, b = self.right.all(low), self.right.all(high)
        place, letter = np.nonzero(b[:, 1:] > a[:, 1:])
        return place, letter + 1, a[place, letter + 1], b[place, letter + 1]

    def near(self, queries: list[bytes], halves: list[int]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
        """(place in `queries`, word): the words at one error to the right of the first `halves` letters of a query."""
        order = sorted(range(len(queries)), key=lambda i: len(queries[i]))
        at = 0
        while at < len(order):
            # so many that their letters fit, at least one
            upto = at + 1
            while upto < len(order) and upto - at < BEAM and (upto - at) * len(queries[order[upto]]) <= 32 * BEAM:
                upto += 1
            part = order[at:upto]
            at = upto
            found, rows = self._near([queries[i] for i in part], np.array([halves[i] for i in part]))
            yield np.array(part)[found], [self.mirrored[r][::-1] for r in rows.tolist()]

    def _near(self, queries: list[bytes], half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(q) for q in queries])
        coded = np.zeros((len(queries), int(size.max()) + 1), dtype=np.int16)
        for i, q in enumerate(queries):
            coded[i, : len(q)] = self.coded(q)
        n = np.arange(len(queries))
        # the exact half, from its end to the delimiter before the word
        low, mirror, width = np.zeros(len(n), dtype=np.int64), np.zeros(len(n), dtype=np.int64), np.full(len(n), self.size, dtype=np.int64)
        for back in range(int(half.max()) + 1):
            moves = np.flatnonzero((half >= back) & (width > 0))
            place = half[moves] - 1 - back
            letter = np.where(place >= 0, coded[moves, np.maximum(place, 0)], 0)
            low[moves], mirror[moves], width[moves] = self.to_left(low[moves], mirror[moves], width[moves], letter.astype(np.int64))
        keep = np.flatnonzero(width > 0)
        # without an error so far: one interval for each query; with one: any number
        q0, lo0, hi0 = keep, mirror[keep], mirror[keep] + width[keep]
        q1 = lo1 = hi1 = np.zeros(0, dtype=np.int64)
        found, rows = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for step in range(int((size - half).max()) + 1):
            place = half + step
            ends0 = place[q0] == size[q0]
            place0 = np.minimum(place[q0], coded.shape[1] - 1)
            own = coded[q0, place0].astype(np.int64)
            which, letter, lo, hi = self.each_to_right(lo0, hi0)
            # one letter more in the word; of equal letters in a row, the last one counts
            more = ends0[which] | (letter != own[which])
            q1, lo1, hi1 = np.concatenate([q1, q0[which[more]]]), np.concatenate([lo1, lo[more]]), np.concatenate([hi1, hi[more]])
            done = place[q1] == size[q1]
            if done.any():
                a, b = self.to_right(lo1[done], hi1[done], np.zeros(int(done.sum()), dtype=np.int64))
                hit = b > a  # words are distinct, so one rank
                found.append(q1[done][hit])
                rows.append(a[hit])
            q1, lo1, hi1 = q1[~done], lo1[~done], hi1[~done]
            a, b = self.to_right(lo1, hi1, coded[q1, place[q1]].astype(np.int64))
            on = b > a
            q1, lo1, hi1 = q1[on], a[on], b[on]
            # one letter replaced, or one letter fewer
            other = ~ends0[which] & (letter != own[which])
            q1 = np.concatenate([q1, q0[which[other]], q0[~ends0]])
            lo1, hi1 = np.concatenate([lo1, lo[other], lo0[~ends0]]), np.concatenate([hi1, hi[other], hi0[~ends0]])
            q0, lo0, hi0, own = q0[~ends0], lo0[~ends0], hi0[~ends0], own[~ends0]
            a, b = self.to_right(lo0, hi0, own)
            on = b > a
            q0, lo0, hi0 = q0[on], a[on], b[on]
        return np.concatenate(found), np.concatenate(rows)


def _left_half(m: Column) -> Column:
    return F.floor(m / 2).cast("int")


def _right_half(m: Column) -> Column:
    return F.ceil(m / 2).cast("int")


def entries(words: DataFrame, least_letters: int = LEAST_LETTERS) -> DataFrame:
    """(word, n, key, mirrored, half, asks): for each direction the halves that a word shares with near ones; it asks with its own."""
    size = F.length("word")
    made = []
    for mirrored in (False, True):
        # of words of m letters, the left half has m div 2, the right one the rest
        half = _right_half if mirrored else _left_half
        lengths = F.array_distinct(F.filter(F.array(size - 1, size, size + 1), lambda m: m >= least_letters))
        halves = F.array_distinct(F.transform(lengths, half))
        text = F.reverse("word") if mirrored else F.col("word")
        each = words.select("word", "n", text.alias("text"), half(size).alias("own"), F.explode(halves).alias("half")).where(F.col("half") <= size)
        key = F.xxhash64(F.lit(mirrored), "half", F.substring(F.col("text"), F.lit(1), F.col("half")))
        made.append(each.select("word", "n", key.alias("key"), F.lit(mirrored).alias("mirrored"), "half", (F.col("half") == F.col("own")).alias("asks")))
    return made[0].unionByName(made[1])


def dealt(found: DataFrame, symbols: int = SHARD_SYMBOLS) -> DataFrame:
    """(shard, mirrored, half, word, n, held, asks): rows of a shard's words and of those that ask it; halves of one word, or that none asks for, are left out."""
    space = F.length("word") + 1
    keys = found.groupBy("key").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(space).cast("long").alias("space"), F.count_if("asks").alias("asking")).where("n_rows > 1 and asking > 0")
    keys = checkpointed(keys.select("key", "space", "n_rows"))
    total = keys.agg(F.coalesce(F.sum("space"), F.lit(0)).alias("t")).first()["t"]
    shards = max(1, -(-total // symbols))
    met = joined_on(found, keys.withColumnRenamed("n_rows", "n of key"), "key", "n of key")
    parts = F.ceil(F.col("space") / symbols).cast("long")
    light = F.col("space") <= symbols
    shard = F.when(light, F.pmod("key", F.lit(shards)) * 2 + F.col("mirrored").cast("int")).otherwise(F.col("key"))
    base = met.withColumns({"parts": F.when(light, 1).otherwise(parts), "group": F.struct(light.alias("light"), shard.alias("id"))})
    own = F.pmod(F.xxhash64("word"), F.col("parts"))
    columns = ["group", "mirrored", "half", "word", "n"]
    held = base.select(*columns, own.alias("part"), F.lit(True).alias("held"), F.col("asks") & (F.col("parts") == 1))
    held = held.toDF(*columns, "part", "held", "asks")
    asking = base.where("asks and parts > 1").select(*columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(False).alias("held"), F.lit(True).alias("asks"))
    return held.unionByName(asking).withColumn("shard", F.xxhash64("group", "part")).drop("group", "part")


def near_words(words: DataFrame, least_letters: int = LEAST_LETTERS, symbols: int = SHARD_SYMBOLS) -> DataFrame:
    """(word, near, near_n): near pairs in both orders; a pair may come out by both searches."""

    def search(rows: list[tuple]) -> pa.RecordBatch:
        mirrored = rows[0][1]
        turn = (lambda w: w[::-1]) if mirrored else (lambda w: w)
        known = {turn(w.encode("latin-1")): n for _, _, _, w, n, held, _ in rows if held}
        asked = [(turn(w.encode("latin-1")), half) for _, _, half, w, _, _, asks in rows if asks]
        word, near, near_n = [], [], []
        if known and asked:
            index = BidirectionalIndex(list(known), b"".join(q for q, _ in asked))
            for places, hits in index.near([q for q, _ in asked], [h for _, h in asked]):
                for place, hit in zip(places.tolist(), hits, strict=True):
                    word.append(turn(asked[place][0]).decode("latin-1"))
                    near.append(turn(hit).decode("latin-1"))
                    near_n.append(known[hit])
        return pa.RecordBatch.from_arrays([pa.array(word, type=pa.string()), pa.array(near, type=pa.string()), pa.array(near_n, type=pa.int64())], names=["word", "near", "near_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if rows and row[:2] != rows[0][:2]:
                    yield search(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield search(rows)

    rows = dealt(entries(words, least_letters), symbols).select("shard", "mirrored", "half", "word", "n", "held", "asks")
    return in_batches(rows.repartition("shard").sortWithinPartitions("shard", "mirrored")).mapInArrow(run, "word string, near string, near_n long")


def with_roots(forms: DataFrame) -> DataFrame:
    """`root` for (word, form): forms are followed by pointer jumping, as a form has more occurrences than its word."""
    now = checkpointed(forms.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("at"), F.col("root").alias("next"))
        moved = checkpointed(now.join(ahead, F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if moved.where("moved").isEmpty():
            break
        now = moved.select("word", "root")
    return forms.join(now, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, symbols: int = SHARD_SYMBOLS, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of (doc_id, text)."""
    words = checkpointed(vocabulary(docs, least_letters, least_count))
    pairs = near_words(words, least_letters, symbols).groupBy("word", "near").agg(F.first("near_n").alias("near_n"))
    best = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    joined = words.join(best, "word", "left")
    common = -F.col("best.less") >= ratio * F.col("n")
    forms = checkpointed(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(common, F.col("best.near")).alias("form"), F.when(common, -F.col("best.less")).alias("form_n")))
    return with_roots(forms).select("word", "form", "root", "n", "n_near", "form_n")
