"""Toxicity by compression distance.

Two zstandard dictionaries are trained from labelled text. Both hold the most
common words of ordinary text; the toxic one also holds the pieces of words
that toxic documents have significantly more often than ordinary ones. Each
text is cut into windows at word ends; a window that compresses to fewer bytes
with the toxic dictionary than with the ordinary one speaks for toxicity. What
the differences of a document's windows come to is calibrated to a probability
by logistic regression on the same labelled rows.

Training uses at most `train_toxic` + `train_ordinary` labelled rows, those of
least hash, of which the driver gathers the texts of at most `train_bytes` bytes, and their
figures; it gets no other row's. All telling pieces of those rows are in the dictionary. Scoring covers every row, every window of the whole text,
in the task that reads it; nothing is shuffled.

Defined results: a null or empty text has one empty window; repeated rows get
equal scores; labels other than 0 and 1 are ignored; without labels of both
kinds every score is the share of toxic labels (0 without any); a long text is cut
into windows from end to end; an empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawframe.llm.common import checkpointed, chunks, crc_of, in_batches

WINDOW = 40
GRAM = 5
TRAIN_TOXIC = 2_500
TRAIN_ORDINARY = 5_000
LEAST_Z = 6.0
LEAST_LOG_ODDS = 2.5
LEAST_DOCUMENTS = 4
#: Bytes of common words in both dictionaries, a parameter of the model: more do not rank better (figures in the README).
COMMON_BYTES = 4096
#: Longest text in training, so that what the driver gathers is bounded: 2 GB at most, some 20 MB of usual texts.
TRAIN_BYTES = 256 << 10
HELD_OUT = (5, 0)

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def windows(raw: bytes, size: int = WINDOW) -> list[bytes]:
    """The whole text in parts that end before the first space from `size` bytes on, or at four times that."""
    text, out, at = raw.translate(_LOWER), [], 0
    while at < len(text):
        end = text.find(b" ", at + size, at + 4 * size)
        end = min(at + 4 * size, len(text)) if end < 0 else end
        out.append(text[at:end])
        at = end
    return out or [b""]


def _grams(raw: bytes) -> tuple[bytes, np.ndarray]:
    """Words parted by spaces, and the run of GRAM bytes at each place as a number: 0 if a space is inside it."""
    text = b" " + b" ".join(raw.translate(_LETTERS).split()) + b" "
    codes = np.frombuffer(text, dtype=np.uint8).astype(np.uint64)
    n = max(0, len(codes) - GRAM + 1)
    found, inside = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=bool)
    for j in range(GRAM):
        found = found * np.uint64(256) + codes[j : j + n]
        if 0 < j < GRAM - 1:
            inside |= codes[j : j + n] == 0x20
    found[inside] = 0
    return text, found


def _document_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    each = [np.unique(_grams(t)[1]) for t in texts]
    return np.unique(np.concatenate(each), return_counts=True) if each else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def telling_pieces(toxic: list[bytes], ordinary: list[bytes], least_z: float = LEAST_Z, least_log_odds: float = LEAST_LOG_ODDS, least_documents: int = LEAST_DOCUMENTS) -> list[bytes]:
    """Pieces of words that toxic documents have more often, the most common first.

    A gram is telling from a difference of shares of `least_z` standard errors and log odds of `least_log_odds` on, in `least_documents` toxic ones.
    """
    grams, in_toxic = _document_counts(toxic)
    other, counts = _document_counts(ordinary)
    place = np.minimum(np.searchsorted(other, grams), max(len(other) - 1, 0))
    in_ordinary = np.where(other[place] == grams, counts[place], 0) if len(other) else np.zeros(len(grams))
    nt, no = len(toxic), len(ordinary)
    pooled = (in_toxic + in_ordinary) / (nt + no)
    error = np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / nt + 1 / no))
    z = (in_toxic / nt - in_ordinary / no) / error
    odds = np.log((in_toxic + 0.5) / (nt + 1) / ((in_ordinary + 0.5) / (no + 1)))
    telling = set(grams[(z >= least_z) & (odds >= least_log_odds) & (in_toxic >= least_documents) & (grams > 0)].tolist())
    pieces: Counter[bytes] = Counter()
    for raw in toxic:
        text, found = _grams(raw)
        places = [i for i, g in enumerate(found.tolist()) if g in telling]
        spans, i = set(), 0
        while i < len(places):
            j = i
            while j + 1 < len(places) and places[j + 1] == places[j] + 1:
                j += 1
            spans.add(text[places[i] : places[j] + GRAM])
            i = j + 1
        pieces.update(spans)
    return [p for p, n in sorted(pieces.items(), key=lambda x: (-x[1], x[0])) if n >= least_documents]


@dataclass
class Model:
    common: bytes
    toxic: bytes
    mean: list[float]
    scale: list[float]
    weights: list[float]

    def compressors(self) -> list:
        made = []
        for content in (self.common, self.common + self.toxic):
            # content of under 8 bytes is no dictionary
            words = zstandard.ZstdCompressionDict(content.rjust(64), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            settings = zstandard.ZstdCompressionParameters.from_level(
                5, dict_size=len(content), strategy=zstandard.STRATEGY_GREEDY, min_match=5, write_content_size=0, write_checksum=0, write_dict_id=0
            )
            made.append(zstandard.ZstdCompressor(dict_data=words, compression_params=settings).compress)
        return made

    def probability(self, figures: np.ndarray) -> np.ndarray:
        z = np.clip((figures - self.mean) / self.scale @ np.array(self.weights[1:]) + self.weights[0], -35, 35)
        return 1 / (1 + np.exp(-z))


def train_dictionaries(toxic: list[bytes], ordinary: list[bytes], common_bytes: int = COMMON_BYTES, **telling: float) -> tuple[bytes, bytes]:
    """(common, toxic): raw dictionary content, the most useful last, where references are shortest.

    All telling pieces, by the thresholds of telling_pieces in `telling`, are in the toxic part; the common part has as many whole words as `common_bytes` hold.
    """
    counts: Counter[bytes] = Counter()
    for raw in ordinary:
        counts.update(set(raw.translate(_LETTERS).split()))
    words, size = [], 0
    for word, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        size += len(word) + 1
        if size > common_bytes:
            break
        words.append(word)
    return b" ".join(words[::-1]), b"".join(telling_pieces(toxic, ordinary, **telling)[::-1])


def figures(raw: bytes, ordinary, toxic) -> list[float]:
    """What the windows' differences in compressed length come to."""
    gains = np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(raw)])
    counts = [np.count_nonzero(gains >= t) for t in (2, 3, 4, 6)]
    n = len(gains)
    return [gains.mean(), gains.max(), np.sort(gains)[-3:].mean(), *np.log1p(counts), counts[0] / n, counts[2] / n, np.count_nonzero(gains >= 5) / n, math.log(n)]


def fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[list[float], list[float], list[float]]:
    """(mean, scale, weights with the constant first), by Newton steps with a ridge."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.zeros(a.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + np.eye(len(w)), a.T @ (p - y) + w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return mean.tolist(), scale.tolist(), w.tolist()


def training_rows(docs: DataFrame, labels: DataFrame, train_toxic: int = TRAIN_TOXIC, train_ordinary: int = TRAIN_ORDINARY, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """(doc_id, text, toxic): the labelled rows of least hash of each kind, outside the held-out part and of texts of at most `train_bytes` bytes."""
    modulus, held = HELD_OUT
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_of(F.col("doc_id")) % modulus != held)).select("doc_id", "toxic")
    draw = F.xxhash64("doc_id", F.lit("toxicity"))
    parts = [usable.where(F.col("toxic") == k).orderBy(draw, "doc_id").limit(n) for k, n in ((1, train_toxic), (0, train_ordinary))]
    chosen = parts[0].union(parts[1]).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # at most train_toxic + train_ordinary rows of two numbers
    short = docs.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= train_bytes)
    return short.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.first("toxic").alias("toxic"))


def train(docs: DataFrame, labels: DataFrame, common_bytes: int = COMMON_BYTES, telling: dict[str, float] | None = None, **bounds: int) -> Model | float:
    """A model, or the score for all rows if labels of one kind are lacking; `telling` has thresholds of telling_pieces, `bounds` are those of training_rows."""
    sample = checkpointed(training_rows(docs, labels, **bounds))
    rows = sample.select("text", "toxic").collect()
    texts = {(r["text"].encode(), r["toxic"]) for r in rows}
    toxic, ordinary = [sorted(t for t, k in texts if k == kind) for kind in (1, 0)]
    if not toxic or not ordinary:
        return float(bool(toxic))
    common, extra = train_dictionaries(toxic, ordinary, common_bytes, **(telling or {}))
    model = Model(common, extra, [], [], [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = model.compressors()
        for batch in batches:
            found = [figures(t, *pair) for _, part in chunks(batch, "text") for t in part]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, type=pa.list_(pa.float64()))], names=["toxic", "x"])

    measured = in_batches(sample.select(F.col("toxic").cast("double").alias("toxic"), "text").repartition(12)).mapInArrow(run, "toxic double, x array<double>").collect()
    measured.sort(key=lambda r: (r["toxic"], r["x"]))
    model.mean, model.scale, model.weights = fit_logistic(np.array([r["x"] for r in measured]), np.array([r["toxic"] for r in measured]))
    return model


def score(docs: DataFrame, model: Model | float) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of (doc_id, text)."""
    modulus, held = HELD_OUT
    rows = docs.select("doc_id", (crc_of(F.col("doc_id")) % modulus == held).alias("held_out"), "text")
    if isinstance(model, float):
        scored = rows.select("doc_id", "held_out", F.lit(model).alias("score"))
    else:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pair = model.compressors()
            for batch in batches:
                found = [figures(t, *pair) for _, part in chunks(batch, "text") for t in part]
                p = model.probability(np.array(found)) if found else np.zeros(0)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p)], names=["doc_id", "held_out", "score"])

        scored = in_batches(rows.withColumn("doc_id", F.col("doc_id").cast("long"))).mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
