"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of `PASSAGE_WORDS` words, from end to end of the
whole text. Each passage is encoded as a vector: shares of kinds of bytes, figures
of its words, how much of it the document has said before, and hashed pairs of
kinds of neighbouring bytes. A gated attention gives each passage a weight,

    a ~ exp(w . (tanh(V x) * sigmoid(U x))),   z = sum of a * h(x),   h(x) = tanh(H x)

and the document's score is a logistic function of z. Only documents carry labels;
the attention is learned from them together with the rest, by Adam steps.

Training uses at most `train_good` + `train_bad` labelled documents, those of least
hash outside the held-out part, with at most `train_bytes` bytes of text each; the
driver gets their encoded passages and no other row's. Scoring covers every row and
every passage: the sums over passages are kept up part by part of a text, with the
running maximum of the attention's exponents, in the task that reads it; nothing
is shuffled.

Defined results: a null or empty text, or one of blanks alone, is one passage without
words; repeated rows get equal scores; a document with several labels counts once,
with the largest; labels other than 0 and 1, and rows of labels without id are
ignored; without labels of both kinds every score is the share of good labels (0.5
without any); a long text is scored from end to end; an empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawframe.llm.common import checkpointed, chunks, crc_of, in_batches

PASSAGE_WORDS = 64
TRAIN_GOOD = 2_000
TRAIN_BAD = 2_000
#: Longest text in training, so that what the driver gathers is bounded: some 80 passages, 200 MB if all texts had as many.
TRAIN_BYTES = 32 << 10
HELD_OUT = (3, 1)
HIDDEN = 16
STEPS = 200
#: Words of a phrase that counts as said before.
PHRASE = 4
#: Slots for pairs of neighbouring kinds of bytes: lower, upper, high, digit, blank, stop, and each other byte by hash.
KINDS = 12
#: Bytes of a text that are encoded at a time: passages begin anew there, and what was said before is known within a part.
PART_BYTES = 2 << 20

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def _kinds() -> np.ndarray:
    table = 7 + (np.arange(256, dtype=np.uint8) * np.uint8(151) >> 4) % 5
    table[0x61:0x7B], table[0x41:0x5B], table[0x80:], table[0x30:0x3A] = 0, 1, 2, 3
    table[_BLANK] = 4
    table[[0x2E, 0x2C, 0x3B, 0x3A]] = 5
    table[[0x0A, 0x0D]] = 6
    return table.astype(np.int64)


_KIND = _kinds()
_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[0x41:0x5B] += 32
FEATURES = 10 + KINDS + KINDS * KINDS


def encode(raw: bytes, words: int = PASSAGE_WORDS) -> np.ndarray:
    """A row of FEATURES numbers per passage; at least one."""
    codes = np.frombuffer(raw, dtype=np.uint8)
    blank = _BLANK[codes]
    inside = np.concatenate([[False], ~blank, [False]])
    starts, ends = np.flatnonzero(~inside[:-1] & inside[1:]), np.flatnonzero(inside[:-1] & ~inside[1:])
    if not len(starts):
        return np.zeros((1, FEATURES), dtype=np.float32)
    n = len(starts)
    n_passages = -(-n // words)
    first = np.arange(0, n, words)
    edges = np.append(starts[first], len(codes))
    edges[0] = 0
    size = np.diff(edges).astype(float)
    passage = np.repeat(np.arange(n_passages), np.diff(edges))
    kind = _KIND[codes]
    single = np.bincount(passage * KINDS + kind, minlength=n_passages * KINDS).reshape(n_passages, KINDS)
    pair = np.bincount((passage[1:] * KINDS + kind[:-1]) * KINDS + kind[1:], minlength=n_passages * KINDS * KINDS).reshape(n_passages, -1)
    # a word's number: its bytes in lower case, by place
    length = ends - starts
    place = np.arange(len(codes), dtype=np.uint64)
    mixed = (_FOLD[codes] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    at = np.repeat(starts, length)
    letters = np.flatnonzero(~blank)
    turned = mixed[letters] * ((place[letters] - at.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F) | np.uint64(1))
    number = np.add.reduceat(turned ^ (turned >> np.uint64(29)), np.concatenate([[0], np.cumsum(length)[:-1]]))
    of = np.arange(n) // words
    per = np.bincount(of, minlength=n_passages).astype(float)

    def fresh(values: np.ndarray, groups: np.ndarray | None = None) -> np.ndarray:
        """Whether a value is the first of its kind, of its group."""
        keys = values if groups is None else values + groups.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        new = np.zeros(len(keys), dtype=bool)
        new[np.unique(keys, return_index=True)[1]] = True
        return new

    phrase = number.copy()
    for j in range(1, min(PHRASE, n)):
        phrase[: n - j] = phrase[: n - j] * np.uint64(0x100000001B3) + number[j:]
    counts = lambda mask: np.bincount(of[mask], minlength=n_passages) / per
    same = np.zeros(n, dtype=bool)
    same[1:] = number[1:] == number[:-1]
    figures = [
        counts(fresh(number, of)),
        counts(~fresh(number)),
        counts(~fresh(phrase)),
        counts(same),
        np.bincount(of, weights=length, minlength=n_passages) / per / 10,
        counts(length == 1),
        counts(length > 20),
        size / per / 10,
        np.minimum(per, words) / words,
        np.full(n_passages, np.log1p(n_passages) / 8),
    ]
    return np.column_stack([*figures, single / size[:, None], pair / size[:, None] * 4]).astype(np.float32)


def parts_of(raw: bytes, size: int) -> Iterator[bytes]:
    """The whole text in parts that end at a blank, or in the middle of a word that is longer than a part."""
    at = 0
    while at < len(raw):
        end = min(len(raw), at + size)
        if end < len(raw):
            cut = max(raw.rfind(b" ", at + size // 2, end), raw.rfind(b"\n", at + size // 2, end))
            end = cut + 1 if cut > 0 else end
        yield raw[at:end]
        at = end
    if not raw:
        yield raw


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def parts(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(exponent of the attention, representation) of each passage."""
        w = self.weights
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        gate = np.tanh(x @ w["V"] + w["v"]) * _sigmoid(x @ w["U"] + w["u"])
        return gate @ w["w"], np.tanh(x @ w["H"] + w["h"])

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """A probability for each text, whatever its length: passages are weighed part by part."""
        out = np.zeros(len(texts))
        for i, raw in enumerate(texts):
            top, mass, total = -np.inf, 0.0, 0.0
            for part in parts_of(raw, PART_BYTES):
                e, h = self.parts(encode(part))
                now = max(top, float(e.max()))
                a = np.exp(e - now)
                kept = np.exp(top - now)
                mass, total, top = mass * kept + a.sum(), total * kept + a @ h, now
            out[i] = _sigmoid(total / mass @ self.weights["c"] + self.weights["b"][0])
        return out


def loss_and_slopes(w: dict[str, np.ndarray], x: np.ndarray, bags: np.ndarray, y: np.ndarray, ridge: float) -> tuple[float, dict[str, np.ndarray]]:
    """Mean log loss of bags of passages, and its slopes; `bags` has the first row of each bag."""
    size = np.diff(np.append(bags, len(x)))
    t, s, h = np.tanh(x @ w["V"] + w["v"]), _sigmoid(x @ w["U"] + w["u"]), np.tanh(x @ w["H"] + w["h"])
    e = (t * s) @ w["w"]
    a = np.exp(e - np.repeat(np.maximum.reduceat(e, bags), size))
    a /= np.repeat(np.add.reduceat(a, bags), size)
    z = np.add.reduceat(a[:, None] * h, bags)
    p = _sigmoid(z @ w["c"] + w["b"][0])
    loss = -np.mean(y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12)) + ridge * sum(float((w[k] ** 2).sum()) for k in "VUHwc")
    d = ((p - y) / len(y)).astype(x.dtype)
    dz = d[:, None] * w["c"]
    each = np.repeat(dz, size, axis=0)
    da = (each * h).sum(axis=1)
    de = a * (da - np.repeat(np.add.reduceat(a * da, bags), size))
    dh = a[:, None] * each * (1 - h * h)
    dg = de[:, None] * w["w"]
    dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
    slopes = {"V": x.T @ dt, "v": dt.sum(axis=0), "U": x.T @ ds, "u": ds.sum(axis=0), "w": (t * s).T @ de, "H": x.T @ dh, "h": dh.sum(axis=0), "c": z.T @ d, "b": np.array([d.sum()])}
    for k in "VUHwc":
        slopes[k] = slopes[k] + 2 * ridge * w[k]
    return float(loss), slopes


def fit(bags: list[np.ndarray], y: np.ndarray, hidden: int = HIDDEN, steps: int = STEPS, ridge: float = 1e-5, seed: int = 42) -> Model:
    """The model by Adam steps over all bags at once."""
    x = np.concatenate(bags)
    mean, scale = x.mean(axis=0, dtype=np.float64).astype(np.float32), x.std(axis=0, dtype=np.float64).astype(np.float32) + np.float32(1e-3)
    x = np.clip((x - mean) / scale, -6, 6)
    first = np.concatenate([[0], np.cumsum([len(b) for b in bags])[:-1]])
    y = y.astype(np.float32)
    draw = np.random.default_rng(seed)
    shapes = {"V": (x.shape[1], hidden), "U": (x.shape[1], hidden), "H": (x.shape[1], hidden), "w": (hidden,), "c": (hidden,)}
    w = {k: draw.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32) for k, s in shapes.items()}
    share = min(max(float(np.mean(y)), 1e-3), 1 - 1e-3)
    w |= {k: np.zeros(hidden, dtype=np.float32) for k in "vuh"} | {"b": np.array([np.log(share / (1 - share))], dtype=np.float32)}
    m, v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        _, slopes = loss_and_slopes(w, x, first, y, ridge)
        for k, g in slopes.items():
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            w[k] = (w[k] - 0.02 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Model(mean, scale, w)


def training_rows(docs: DataFrame, labels: DataFrame, train_good: int = TRAIN_GOOD, train_bad: int = TRAIN_BAD, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """(doc_id, text, quality): the labelled documents of least hash of each kind, outside the held-out part and not over `train_bytes`."""
    modulus, held = HELD_OUT
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_of(F.col("doc_id")) % modulus != held))
    usable = usable.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    # several rows of one id have one text in training, the least
    known = docs.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= train_bytes).select("doc_id").distinct().join(usable, "doc_id")
    draw = F.xxhash64("doc_id", F.lit("quality"))
    parts = [known.where(F.col("quality") == k).orderBy(draw, "doc_id").limit(n) for k, n in ((1, train_good), (0, train_bad))]
    # at most train_good + train_bad rows of two numbers
    chosen = F.broadcast(checkpointed(parts[0].union(parts[1])))
    short = docs.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= train_bytes)
    return short.join(chosen, "doc_id").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.first("quality").alias("quality"))


def train(docs: DataFrame, labels: DataFrame, hidden: int = HIDDEN, steps: int = STEPS, **bounds: int) -> Model | float:
    """A model, or the score for all rows if labels of one kind are lacking; `bounds` are those of training_rows."""
    sample = training_rows(docs, labels, **bounds).select("doc_id", "quality", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [encode(t) for _, part in chunks(batch, "text") for t in part]
            sizes = pa.array([len(f) for f in found], type=pa.int32())
            flat = pa.array([f.tobytes() for f in found], type=pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sizes, flat], names=["doc_id", "quality", "n", "x"])

    rows = in_batches(sample.repartition(12)).mapInArrow(run, "doc_id long, quality int, n int, x binary").collect()
    rows.sort(key=lambda r: r["doc_id"])
    y = np.array([float(r["quality"]) for r in rows])
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.5
    bags = [np.frombuffer(r["x"], dtype=np.float32).reshape(r["n"], FEATURES) for r in rows]
    return fit(bags, y, hidden, steps)


def score(docs: DataFrame, model: Model | float) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of (doc_id, text)."""
    modulus, held = HELD_OUT
    rows = docs.select("doc_id", (crc_of(F.col("doc_id")) % modulus == held).alias("held_out"), "text")
    if isinstance(model, float):
        scored = rows.select("doc_id", "held_out", F.lit(model).alias("score"))
    else:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [model.scores(part) for _, part in chunks(batch, "text")]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(found) if found else np.zeros(0))], names=["doc_id", "held_out", "score"])

        scored = in_batches(rows.withColumn("doc_id", F.col("doc_id").cast("long"))).mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
