"""LM scoring with a weighted backoff automaton.

States are word histories: the empty one, one word, two words. A state's arcs
carry smoothed log-probabilities of the words seen after it; a word without an
arc takes the failure arc, which costs the state's failure weight and leads to
the history without its first word.

Every word of the training texts has an arc from the empty state, and every pair
and triple of words that occurs at least `least_count` times has one from its
history, whatever the size of the corpus. With absolute discounting and
interpolation, for a history h of count c(h) whose arcs have counts c(hw),

    failure weight of h = (c(h) - sum of (c(hw) - D)) / c(h),
    p(w | h) = (c(hw) - D) / c(h) + failure weight * p(w | h without its first word),

without the first summand where there is no arc. From the empty state, a word of
count c has (c - D) / N, and the mass D * V / N left over is the probability of
an unknown word, one more type.

How the automaton meets the texts. Texts are read once, as chunks of word
numbers in a bucketed table, so that later steps meet a chunk without shuffling it.
Counts are gathered in two exchanges of packed blocks, a block per chunk and
bucket of keys:

1. Slots of words, pairs and triples (a hash of a few bits more than there are
   tokens) are counted; a chunk learns which of its own may occur often enough
   for an arc. An n-gram that does is never left out; most others are.
2. Those n-grams are counted exactly, each with its history, and a chunk learns
   the counts of its own histories and arcs: its part of the automaton.

The chunk's texts are then traversed from left to right (`Automaton.walk`): a state is carried from
token to token, along an arc or down failure arcs, and the logarithms of what is passed add up.
A history that a large share of all
tokens has is divided over several buckets by the words after it, and its sums
come together again in the chunk. Nothing is broadcast or sent to the driver but
three totals and the code book of blocks, of bounded size.

N-grams are told apart by hashes, of 24 bits more than the number of tokens has.

Defined results: a null or empty text is one end token; end counts as a token in
training and scoring; without training rows every probability is that of one
unknown type, 1, and the base score is 0 by the given formula; repeated rows each
get the same result, those without an id train like any other (crc32 taken as 0).
A text longer than a chunk is divided, with two words of context before each
further part, and gets one sum. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
import struct
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawframe.llm.common import crc_of, in_batches
from lawframe.session import scratch_folder

#: Not a word, as it holds a space.
END = b" "
#: The discount is a whole number of quarters, so that what a history's arcs take is a whole number too.
QUARTERS = 3
DISCOUNT = QUARTERS / 4
#: Pairs and triples seen this often have arcs.
LEAST_COUNT = 2
HELD_OUT = (7, 2)
#: Tokens in a chunk, and about those in a bucket of keys; there are half as many buckets as shuffle partitions at least.
CHUNK_TOKENS = 1_000_000
BUCKET_TOKENS = 4_000_000
#: Tokens of a text that one lane of the traversal goes over.
LANE = 512
#: Bytes of a long text that are cut into words at a time.
PART_BYTES = 8 << 20
#: Common words that blocks name by number, and the chunks that they are taken from.
BOOK_WORDS = 65_535
BOOK_CHUNKS = 16
#: A history is divided from this many tokens on, and from a quarter of a bucket.
LEAST_HOT = 1_000

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_BLANK = re.compile(rb"[\x20\x09-\x0d]")


def token_parts(raw: bytes) -> Iterator[list[bytes]]:
    """The tokens of a text, in parts of bounded size; the last closes with the end token."""
    raw = raw.translate(_LOWER)
    start = 0
    while len(raw) - start > PART_BYTES and (cut := _BLANK.search(raw, start + PART_BYTES)):
        yield raw[start : cut.start()].split()
        start = cut.end()
    yield [*raw[start:].split(), END]


_SQUEEZE, _SWELL = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress


def pack(*columns: np.ndarray) -> bytes:
    """Whole numbers as one block: per column the bytes of all values by place, each place compressed by itself, without leading zeros."""
    parts = []
    for column in columns:
        values = np.ascontiguousarray(column, dtype=np.uint64)
        width = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
        parts.append(struct.pack("<QB", len(values), width))
        for place in range(width):
            raw = values.view(np.uint8).reshape(-1, 8)[:, place].tobytes()
            squeezed = _SQUEEZE(raw) if len(raw) > 32 else raw
            # a place that does not shrink stays as it is
            stored = squeezed if len(squeezed) < len(raw) else raw
            parts += [struct.pack("<I", len(stored)), stored]
    return b"".join(parts)


def unpack(block: bytes) -> list[np.ndarray]:
    found, at = [], 0
    while at < len(block):
        n, width = struct.unpack_from("<QB", block, at)
        values = np.zeros((n, 8), dtype=np.uint8)
        at += 9
        for place in range(width):
            size = struct.unpack_from("<I", block, at)[0]
            stored = block[at + 4 : at + 4 + size]
            values[:, place] = np.frombuffer(stored if size == n else _SWELL(stored), dtype=np.uint8)
            at += 4 + size
        found.append(values.view(np.uint64).reshape(n))
    return found


def steps(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A sorted column as its first value and the steps after it."""
    return ordered[:1], np.diff(ordered)


def whole(first: np.ndarray, rest: np.ndarray) -> np.ndarray:
    return np.cumsum(np.concatenate([first, rest]), dtype=np.uint64)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The key of a history's key and a word's."""
    h = a * np.uint64(0x9E3779B97F4A7C15) + b
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def bucket_of(keys: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Equal ranges of keys of so many bits."""
    top = keys >> np.uint64(bits - 32) if bits >= 32 else keys << np.uint64(32 - bits)
    return (top * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


class _Numbers(dict):
    """Words numbered as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


_CHUNK = "chunk long, refs array<long>, ids array<long>, held array<boolean>, sizes array<long>, before array<long>, n_train long, n_all long, block binary"


def chunked(docs: DataFrame, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """Rows of (ref, doc_id, held_out, text) as chunks of pieces: ref, id, held out, tokens, words of context before them; words' hashes and the words by number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        numbers, tokens, pieces = _Numbers(), array("I"), []

        def done() -> pa.RecordBatch:
            hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed=42) for w in numbers), dtype=np.uint64, count=len(numbers))
            by = np.argsort(hashes)
            place = np.empty(len(by), dtype=np.uint32)
            place[by] = np.arange(len(by))
            block = pack(*steps(hashes[by]), place[np.frombuffer(tokens, dtype=np.uint32)])
            columns = [list(c) for c in zip(*pieces, strict=True)]
            row = [number, *columns, sum(p[3] for p in pieces if not p[2]), sum(columns[3]), block]
            return pa.RecordBatch.from_pylist([dict(zip(_SCHEMA.names, row, strict=True))], schema=_SCHEMA)

        for batch in batches:
            for ref, doc_id, held, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                before: list[bytes] = []
                for words in token_parts(text or b""):
                    for at in range(0, len(words), chunk_tokens):
                        part = words[at : at + chunk_tokens]
                        if tokens and len(tokens) + len(part) > chunk_tokens:
                            yield done()
                            number, numbers, tokens, pieces = number + 1, _Numbers(), array("I"), []
                        tokens.extend(map(numbers.__getitem__, before))
                        tokens.extend(map(numbers.__getitem__, part))
                        pieces.append((ref, doc_id, held, len(part), len(before)))
                        before = [*before, *part][-2:]
        if pieces:
            yield done()

    return in_batches(docs).mapInArrow(run, _CHUNK)


_SCHEMA = pa.schema(
    [("chunk", pa.int64()), *[(name, pa.list_(kind)) for name, kind in (("refs", pa.int64()), ("ids", pa.int64()), ("held", pa.bool_()), ("sizes", pa.int64()), ("before", pa.int64()))]]
    + [("n_train", pa.int64()), ("n_all", pa.int64()), ("block", pa.binary())]
)
_END_KEY = np.uint64(xxhash.xxh64_intdigest(END, seed=42))


def distinct(keys: np.ndarray, kind: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, a place of each, and each key's number; kind "stable" for keys that are a few sorted runs."""
    by = np.argsort(keys, kind=kind)
    ordered = keys[by]
    new = np.ones(len(keys), dtype=bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    number = np.empty(len(keys), dtype=np.int32)
    number[by] = np.cumsum(new, dtype=np.int32) - 1
    return ordered[new], by[new], number


class Grams:
    """A chunk's distinct words, pairs and triples with their counts, and which of them end at each token (-1: none)."""

    def __init__(self, row: dict):
        first, rest, place = unpack(row["block"])
        self.words, self.word = whole(first, rest), place.astype(np.int32)
        del place
        before, self.held = np.array(row["before"], dtype=np.int32), np.array(row["held"], dtype=bool)
        sizes = np.array(row["sizes"], dtype=np.int32) + before
        at = np.arange(len(self.word), dtype=np.int32) - np.repeat(np.cumsum(sizes, dtype=np.int32) - sizes, sizes)
        self.piece = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.scored = at >= before[self.piece]
        key = self.words[self.word]
        at2, at3 = np.flatnonzero(at >= 1), np.flatnonzero((at >= 2) & self.scored)
        pair_key = np.zeros(len(key), dtype=np.uint64)
        pair_key[at2] = mixed(key[at2 - 1], key[at2])
        self.pairs, where, self.pair = self._distinct(pair_key[at2], at2)
        self.pair_first, self.pair_last = self.word[where - 1], self.word[where]
        self.triples, where, self.triple = self._distinct(mixed(pair_key[at3 - 1], key[at3]), at3)
        self.triple_pair, self.triple_last, self.triple_then = self.pair[where - 1], self.word[where], self.pair[where]

    def _distinct(self, keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        kinds, first, number = distinct(keys)
        of = np.full(len(self.word), -1, dtype=np.int32)
        of[at] = number
        return kinds, at[first], of

    def counts(self, train: bool) -> list[np.ndarray]:
        """Of words, pairs and triples, in training texts or in all."""
        counted = self.scored & ~self.held[self.piece] if train else self.scored
        columns = ((self.word, self.words), (self.pair, self.pairs), (self.triple, self.triples))
        return [np.bincount(of[counted & (of >= 0)], minlength=len(kinds)) for of, kinds in columns]

    def slots(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct slots, and each n-gram's slot."""
        slot, _, of = distinct(np.concatenate([self.words, self.pairs, self.triples]) >> np.uint64(64 - bits), "stable")
        return slot, of


_ASK = "bucket long, chunk long, alone long, block binary"
_ASK_SCHEMA = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("alone", pa.int64()), ("block", pa.binary())])
_REPLY = "chunk long, bucket long, kind int, types long, block binary"
_REPLY_SCHEMA = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("kind", pa.int32()), ("types", pa.int64()), ("block", pa.binary())])


def _columns(rows: list[tuple], schema: pa.Schema) -> list[pa.Array]:
    return [pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema.types, strict=True)]


def slot_asks(chunks: DataFrame, bits: int, buckets: int) -> DataFrame:
    """Each chunk's slots with their counts in all texts, a block per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                grams = Grams(row)
                slot, of = grams.slots(bits)
                n = np.bincount(of, weights=np.concatenate(grams.counts(train=False)), minlength=len(slot)).astype(np.int64)
                edges = np.searchsorted(bucket_of(slot, bits, buckets), np.arange(buckets + 1))
                blocks = [(b, row["chunk"], 0, pack(*steps(slot[i:j]), n[i:j])) for b, (i, j) in enumerate(zip(edges, edges[1:])) if j > i]
                yield pa.RecordBatch.from_arrays(_columns(blocks, _ASK_SCHEMA), schema=_ASK_SCHEMA)

    return chunks.mapInArrow(run, _ASK)


def slot_replies(least: int, hot: int):
    """To each chunk: which slots are as common as an arc has to be, and how common the hot ones are."""

    def run(asks: pa.Table) -> pa.Table:
        chunk, [bucket, *_] = asks["chunk"].to_pylist(), asks["bucket"].to_pylist()
        found = [unpack(block) for block in asks["block"].to_pylist()]
        sizes = [len(f[2]) for f in found]
        kinds, _, of = distinct(np.concatenate([whole(f[0], f[1]) for f in found]))
        n = np.bincount(of, weights=np.concatenate([f[2] for f in found]), minlength=len(kinds)).astype(np.int64)
        out = []
        for to, own in zip(chunk, np.split(of, np.cumsum(sizes)[:-1]), strict=True):
            total = n[own]
            common = np.flatnonzero(total >= hot)
            out.append((to, bucket, 0, 0, pack([len(own)], np.packbits(total >= least), common, total[common])))
        return pa.table(_columns(out, _REPLY_SCHEMA), schema=_REPLY_SCHEMA)

    return run


def code_book(chunks: DataFrame) -> np.ndarray:
    """Keys of common words, at most `BOOK_WORDS`, the most common of the sampled chunks first. Blocks name these by number; what is counted does not depend on them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                first, rest, word = unpack(row["block"])
                keys = whole(first, rest)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.bincount(word.astype(np.int64), minlength=len(keys)))], names=["key", "n"])

    some = [r["chunk"] for r in chunks.select("chunk").orderBy(F.xxhash64("chunk"), "chunk").limit(BOOK_CHUNKS).collect()]
    counts = chunks.where(F.col("chunk").isin(some)).select("block").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return counts.orderBy(F.desc("n"), "key").limit(BOOK_WORDS).select("key").toArrow()["key"].to_numpy().view(np.uint64)


def codes(keys: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Each key's number in the book, else the number of keys in it."""
    if not len(book):
        return np.zeros(len(keys), dtype=np.int64)
    by = np.argsort(book)
    at = np.minimum(np.searchsorted(book[by], keys), len(book) - 1)
    return np.where(book[by][at] == keys, by[at], len(book))


class Asks:
    """What a chunk asks in the second exchange: lines of words, lines of pairs under their first word, triples under their first pair.

    All that may occur often enough are asked, in the bucket of the first word. A
    word that can't is nowhere else, so that its count is known in the chunk. A hot
    word's pairs are dealt over several buckets by their second word, a hot pair's
    triples by their third; the counts of words and pairs go to the first one.
    """

    def __init__(self, grams: Grams, replies: list[dict], bits: int, buckets: int, hot: int):
        _, of = grams.slots(bits)
        flags, loads = [], []
        for row in replies:
            n, bit, at, load = unpack(row["block"])
            flags.append(np.unpackbits(bit.astype(np.uint8))[: int(n[0])].astype(bool))
            own = np.zeros(int(n[0]), dtype=np.int64)
            own[at.astype(np.int64)] = load
            loads.append(own)
        flag, load = np.concatenate(flags)[of], np.concatenate(loads)[of]
        del of, flags, loads
        self.keys, (self.n1, self.n2, self.n3) = grams.words, grams.counts(train=True)
        n1, n2 = len(grams.words), len(grams.pairs)
        self.asked = flag[:n1]
        has2 = flag[n1 : n1 + n2] & self.asked[grams.pair_first] & self.asked[grams.pair_last]
        self.words, self.pairs = np.flatnonzero(self.asked), np.flatnonzero(has2)
        self.triples = np.flatnonzero(flag[n1 + n2 :] & has2[grams.triple_pair])
        shares1 = np.minimum(1 + load[:n1] // hot, buckets)
        shares2 = np.minimum(1 + load[n1 : n1 + n2] // hot, buckets)[self.pairs]
        del flag, load
        base = bucket_of(grams.words, 64, buckets)
        share_of = lambda word, shares: (grams.words[word] % shares.astype(np.uint64)).astype(np.int64)
        # lines of pairs: a pair's shares, in turn
        first2 = np.cumsum(shares2) - shares2
        pair = np.repeat(np.arange(len(self.pairs)), shares2)
        turn = np.arange(len(pair)) - first2[pair]
        w1, w2 = (x[self.pairs][pair].astype(np.int64) for x in (grams.pair_first, grams.pair_last))
        bucket2 = (base[w1] + share_of(w2, shares1[w1]) + turn) % buckets
        # lines of words: a word's shares, and where its pairs are
        word = np.repeat(self.words, shares1[self.words])
        turns = np.arange(len(word)) - np.repeat(np.cumsum(shares1[self.words]) - shares1[self.words], shares1[self.words])
        lines, _, line = distinct(np.concatenate([(base[word] + turns) % buckets * n1 + word, bucket2 * n1 + w1]))
        self.line_word, self.line_bucket = lines % n1, lines // n1
        under = line[len(word) :].astype(np.int64)
        by2 = np.argsort(under * n1 + w2)
        self.line_pair = pair[by2]
        rank2 = np.empty(len(by2), dtype=np.int64)
        rank2[by2] = np.arange(len(by2))
        place = np.full(n2, -1, dtype=np.int64)
        place[self.pairs] = np.arange(len(self.pairs))
        of2, w3 = place[grams.triple_pair[self.triples]], grams.triple_last[self.triples].astype(np.int64)
        under3 = rank2[first2[of2] + share_of(w3, shares2[of2])]
        self.by3 = np.argsort(under3 * n1 + w3)
        self.level1 = np.where(self.line_bucket == base[self.line_word], self.n1[self.line_word], 0), np.bincount(under, minlength=len(lines))
        self.level2 = w2[by2], np.where(turn == 0, self.n2[self.pairs][pair], 0)[by2], np.bincount(under3, minlength=len(by2))
        self.level3 = w3[self.by3], self.n3[self.triples][self.by3]
        self.buckets = self.line_bucket, bucket2[by2], bucket2[by2][under3[self.by3]]

    def blocks(self, book: np.ndarray, key_bits: int, buckets: int) -> Iterator[tuple[int, bytes]]:
        """Per bucket the words' keys, counts and numbers of pairs; per pair its word's code, its count and number of triples; per triple its word's code and count; the keys of words without a code."""
        edges = [np.searchsorted(b, np.arange(buckets + 1)) for b in self.buckets]
        shift, code = np.uint64(64 - key_bits), codes(self.keys, book)
        for b in range(buckets):
            one, two, three = (slice(e[b], e[b + 1]) for e in edges)
            if one.stop > one.start:
                w2, w3 = self.level2[0][two], self.level3[0][three]
                rare = np.concatenate([w2, w3])
                rare = self.keys[rare[code[rare] == len(book)]] >> shift
                columns = [*(c[one] for c in self.level1), code[w2], *(c[two] for c in self.level2[1:]), code[w3], self.level3[1][three]]
                yield b, pack(*steps(self.keys[self.line_word[one]] >> shift), *columns, rare)

    def alone(self) -> int:
        """Training words that no bucket counts."""
        return int((self.n1[~self.asked] > 0).sum())

    def read(self, replies: list[dict]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Per word of the chunk its count and what its arcs take; the same per pair asked; per triple asked its count, 0 without an arc."""
        found = [np.concatenate(c).astype(np.int64) for c in zip(*(unpack(row["block"]) for row in replies), strict=True)] or [np.zeros(0, dtype=np.int64)] * 5
        words = [np.bincount(self.line_word, weights=c, minlength=len(self.n1)).astype(np.int64) for c in found[:2]]
        words[0] = np.where(self.asked, words[0], self.n1)
        pairs = [np.bincount(self.line_pair, weights=c, minlength=len(self.pairs)).astype(np.int64) for c in found[2:4]]
        triples = np.empty(len(self.triples), dtype=np.int64)
        triples[self.by3] = found[4]
        return words, pairs, triples


def gram_asks(book, bits: int, key_bits: int, buckets: int, hot: int):
    def run(chunk: pa.Table, replies: pa.Table) -> pa.Table:
        [row] = chunk.to_pylist()
        asks = Asks(Grams(row), sorted(replies.to_pylist(), key=lambda r: r["bucket"]), bits, buckets, hot)
        blocks = [(b, row["chunk"], 0, block) for b, block in asks.blocks(book.value, key_bits, buckets)]
        # a line of its own, so that it is there without any block
        return pa.table(_columns([*blocks, (row["chunk"] % buckets, row["chunk"], asks.alone(), None)], _ASK_SCHEMA), schema=_ASK_SCHEMA)

    return run


def _kept(of: np.ndarray, n: np.ndarray, first: np.ndarray, parent: np.ndarray, parents: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of arcs, 0 below the least; per parent, what its arcs take of its count, in quarters."""
    count = np.bincount(of, weights=n, minlength=len(first)).astype(np.int64)
    count[count < least] = 0
    has = np.flatnonzero(count)
    return count, np.bincount(parent[first[has]], weights=4 * count[has] - QUARTERS, minlength=parents).astype(np.int64)


def gram_replies(book, key_bits: int, least: int):
    """To each chunk: per word its count and what its arcs take; the same per pair; per triple its count. A bucket's first row has the number of its words."""

    def run(asks: pa.Table) -> pa.Table:
        bucket, alone = asks["bucket"].to_pylist()[0], sum(asks["alone"].to_pylist())
        asks = asks.filter(asks["block"].is_valid())
        if not asks.num_rows:
            return pa.table(_columns([(None, bucket, 1, alone, None)], _REPLY_SCHEMA), schema=_REPLY_SCHEMA)
        found = [unpack(block) for block in asks["block"].to_pylist()]
        n1, pairs_of, n2, triples_of, n3 = (np.concatenate([f[i] for f in found]).astype(np.int64) for i in (2, 3, 5, 6, 8))
        keys = np.append(book.value >> np.uint64(64 - key_bits), np.uint64(0))
        after = []
        for f in found:
            code = np.concatenate([f[4], f[7]]).astype(np.int64)
            word = keys[code]
            word[code == len(keys) - 1] = f[9]
            after.append(np.split(word, [len(f[4])]))
        w2, w3 = (np.concatenate([w[i] for w in after]) for i in (0, 1))
        ends = [np.cumsum([len(f[i]) for f in found])[:-1] for i in (2, 4, 7)]
        words, _, of1 = distinct(np.concatenate([whole(f[0], f[1]) for f in found]))
        del found, after
        parent2 = np.repeat(of1, pairs_of)
        pairs, first2, of2 = distinct(mixed(words[parent2], w2))
        parent3 = np.repeat(of2, triples_of)
        _, first3, of3 = distinct(mixed(pairs[parent3], w3))
        c1 = np.bincount(of1, weights=n1, minlength=len(words)).astype(np.int64)
        c2, taken2 = _kept(of2, n2, first2, parent2, len(words), least)
        c3, taken3 = _kept(of3, n3, first3, parent3, len(pairs), least)
        types, out = alone + int((c1 > 0).sum()), []
        parts = [np.split(of, end) for of, end in zip((of1, of2, of3), ends, strict=True)]
        for i, (to, one, two, three) in enumerate(zip(asks["chunk"].to_pylist(), *parts, strict=True)):
            out.append((to, bucket, 1, 0 if i else types, pack(c1[one], taken2[one], c2[two], taken3[two], c3[three])))
        return pa.table(_columns(out, _REPLY_SCHEMA), schema=_REPLY_SCHEMA)

    return run


class Automaton:
    """A chunk's part: states 0 (empty), a word, a pair; arcs by n-gram, to the longest history that is a state; a failure arc from each state but the empty one."""

    def __init__(self, grams: Grams, asks: Asks, replies: list[dict], total: int, types: int):
        words, pairs, triple = asks.read(replies)
        fail = lambda c, taken: np.where(c > 0, (c - taken / 4) / np.maximum(c, 1), 1.0)
        self.count, word_fail = words[0], fail(*words)
        pair_fail = np.ones(len(grams.pairs))
        pair_fail[asks.pairs] = fail(*pairs)
        unknown = DISCOUNT * types / total if total else 1.0
        start = np.where(self.count > 0, (self.count - DISCOUNT) / max(total, 1), unknown)
        pair = np.zeros(len(grams.pairs), dtype=np.int64)
        pair[asks.pairs] = pairs[0]
        n1, n2 = len(grams.words), len(grams.pairs)
        self.words = n1
        # what a word has after a word, by the pair's own share and by failing
        after = word_fail[grams.pair_first] * start[grams.pair_last]
        has = np.flatnonzero(pair)
        after[has] += (pair[has] - DISCOUNT) / self.count[grams.pair_first[has]]
        has = asks.triples[triple > 0]
        third = (triple[triple > 0] - DISCOUNT) / pair[grams.triple_pair[has]] + pair_fail[grams.triple_pair[has]] * after[grams.triple_then[has]]
        self.fail_to = np.concatenate([[0], np.zeros(n1, dtype=np.int32), 1 + grams.pair_last]).astype(np.int32)
        self.fail_log = np.concatenate([[0.0], np.log10(word_fail), np.log10(pair_fail)])
        # arcs of words from the empty state, of pairs from words, of triples from pairs; -1: from nowhere, as there is none
        self.arc_from = np.full(n1 + n2 + len(grams.triples), -1, dtype=np.int32)
        self.arc_to, self.arc_log = np.zeros(len(self.arc_from), dtype=np.int32), np.zeros(len(self.arc_from))
        self.arc_from[:n1], self.arc_to[:n1], self.arc_log[:n1] = 0, 1 + np.arange(n1), np.log10(start)
        kept = np.flatnonzero(pair)
        self.arc_from[n1 + kept], self.arc_to[n1 + kept], self.arc_log[n1 + kept] = 1 + grams.pair_first[kept], 1 + n1 + kept, np.log10(after[kept])
        at = n1 + n2 + has
        self.arc_from[at], self.arc_to[at], self.arc_log[at] = 1 + n1 + grams.triple_pair[has], 1 + n1 + grams.triple_then[has], np.log10(third)

    def walk(self, grams: Grams, lane: int = LANE) -> np.ndarray:
        """Each token's log10 probability: one traversal from left to right, which carries a state for each lane.

        A lane is a run of up to `lane` tokens of a text; all lanes of the chunk go a token at a time, in step.
        A lane within a text reads the two tokens before it first, after which its state is the text's. At a token a
        lane takes the arc of its state, or failure arcs until there is one, and adds up their logarithms.
        """
        n1, n2 = len(grams.words), len(grams.pairs)
        arcs = [np.where(of >= 0, of + first, -1) for of, first in ((grams.triple, n1 + n2), (grams.pair, n1), (grams.word, 0))]
        size = np.bincount(grams.piece)
        first = np.cumsum(size) - size
        runs = -(-size // lane)
        begin = np.repeat(first, runs) + (np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)) * lane
        low, high = np.repeat(first, runs), np.repeat(first + size, runs)
        at, end = np.maximum(begin - 2, low), np.minimum(begin + lane, high)
        by = np.argsort(at - end, kind="stable")  # the longest first, so that lanes that have ended are at the end
        at, end, begin = at[by], end[by], begin[by]
        length, out = end - at, np.zeros(len(grams.word))
        state = np.zeros(len(at), dtype=np.int32)
        for step in range(int(length.max(initial=0))):
            m = int(np.searchsorted(-length, -step, side="left"))
            place, s, log = at[:m] + step, state[:m], np.zeros(m)
            todo = np.arange(m)
            for order in arcs:
                arc = order[place[todo]]
                go = (arc >= 0) & (self.arc_from[arc] == s[todo])
                lanes, taken = todo[go], arc[go]
                log[lanes] += self.arc_log[taken]
                reached = self.arc_to[taken]
                todo = todo[~go]
                if order is not arcs[2]:
                    # the state has no arc for the word: down to the history of one word less, if it is as long as these arcs' histories
                    longest = todo[s[todo] > (self.words if order is arcs[0] else 0)]
                    log[longest] += self.fail_log[s[longest]]
                    s[longest] = self.fail_to[s[longest]]
                s[lanes] = reached
            scored = place >= begin[:m]
            out[place[scored]] = log[scored]
        return out


_HEAD = [("ref", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("logs", pa.float64()), ("score", pa.float64())]


def piece_scores(bits: int, buckets: int, hot: int, total: int, types: int):
    """Per piece of a text: tokens, known ones, the sum of log10(c + 1), and the automaton's log10 probability."""

    def run(chunk: pa.Table, replies: pa.Table) -> pa.Table:
        [row] = chunk.to_pylist()
        by_bucket = sorted(replies.to_pylist(), key=lambda r: r["bucket"])
        grams = Grams(row)
        asks = Asks(grams, [r for r in by_bucket if r["kind"] == 0], bits, buckets, hot)
        automaton = Automaton(grams, asks, [r for r in by_bucket if r["kind"] == 1], total, types)
        count, piece = automaton.count[grams.word], np.where(grams.scored, grams.piece, len(row["refs"]))
        known, logs, score = (np.bincount(piece, weights=x, minlength=len(row["refs"]) + 1)[: len(row["refs"])] for x in (count > 0, np.log10(count + 1.0), automaton.walk(grams)))
        columns = [row["refs"], row["ids"], row["held"], row["sizes"], known.astype(np.int64), logs, score]
        return pa.table([pa.array(c, type=t) for c, (_, t) in zip(columns, _HEAD, strict=True)], names=[name for name, _ in _HEAD])

    return run


def _stored(df: DataFrame) -> DataFrame:
    """Like a checkpoint, as Parquet: blocks are compressed already."""
    path = scratch_folder(df.sparkSession, "lm")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def score(docs: DataFrame, chunk_tokens: int = CHUNK_TOKENS, least_hot: int = LEAST_HOT, least_count: int = LEAST_COUNT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of (doc_id, text).

    Pairs and triples seen `least_count` times have arcs; 1 gives the model of all n-grams.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    modulus, held = HELD_OUT
    rows = docs.select(
        F.monotonically_increasing_id().alias("ref"), F.col("doc_id").cast("long").alias("doc_id"), (crc_of(F.col("doc_id")) % modulus == held).alias("held_out"), F.col("text").cast("binary").alias("text")
    )
    name, path = f"lm_chunks_{uuid.uuid4().hex}", scratch_folder(spark, "lm")
    chunked(rows, chunk_tokens).write.format("parquet").option("path", path).bucketBy(partitions, "chunk").saveAsTable(name)
    try:
        chunks = spark.table(name)
        size = chunks.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_train", "n_all")]).first()
        total, tokens = size["n_train"], size["n_all"]
        buckets = max(1, partitions // 2, tokens // BUCKET_TOKENS)
        hot = max(least_hot, tokens // (4 * buckets))
        # some sixteen slots a token
        size_bits = round(math.log2(max(tokens, 1)))
        bits = max(16, size_bits + 4)
        # a key's chance to be taken for another is 2 ** -24 at most
        key_bits = min(64, max(40, size_bits + 24))
        book = spark.sparkContext.broadcast(code_book(chunks))
        first = _stored(slot_asks(chunks, bits, 4 * buckets).groupBy("bucket").applyInArrow(slot_replies(least_count, hot), _REPLY))
        asks = chunks.groupBy("chunk").cogroup(first.groupBy("chunk")).applyInArrow(gram_asks(book, bits, key_bits, buckets, hot), _ASK)
        second = _stored(asks.groupBy("bucket").applyInArrow(gram_replies(book, key_bits, least_count), _REPLY))
        types = second.agg(F.coalesce(F.sum("types"), F.lit(0)).alias("types")).first()["types"]
        schema = "ref long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double"
        pieces = chunks.groupBy("chunk").cogroup(first.unionByName(second.where("chunk is not null")).groupBy("chunk")).applyInArrow(piece_scores(bits, buckets, hot, total, types), schema)
        by_row = _stored(pieces.groupBy("ref").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "logs", "score")]))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return by_row.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.lit(float(np.log10(total + types + 1)))).alias("base_score"),
        "score",
    )
