"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are sums of signed deltas. A
change inserts a document (its tokens count once more), deletes it (the same
counts, negative) or revises its count (the difference). The changes of a batch
are summed per key before they are written, into the batch's own partition of
the delta table; committing a batch again replaces that partition, so a retried
or replayed batch changes nothing. Totals are the sum over all batches, one
small shuffle of rows that were summed already: a source with a third of all
rows is a few rows per task. Batches can be sealed into a base (`Rollup.compact`), so that
reading totals doesn't take longer with every commit.

Tokenizers run in the tasks that read the texts; their vocabulary files are
read by the driver and sent along (a few MB, whatever the input).

Defined results: a null text has no tokens; a null source or language is a key of
its own; repeated rows count as often as they come; an empty batch leaves the
totals as they are; keys whose documents are all deleted stay with zero
totals; without any commit there are no totals. Other columns are ignored.
"""

from __future__ import annotations

import base64
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lawframe.llm.common import CHUNK_BYTES, in_batches
from lawframe.session import file_system, names_in, put_text, read_text

KEYS = ("source", "lang", "version")
#: Split pattern that the public byte-level vocabularies were made with (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@dataclass(frozen=True)
class Tokenizer:
    """A version name, and the bytes of a vocabulary of ranks; without one, words between white space are tokens."""

    version: str
    ranks: bytes | None = None

    @classmethod
    def from_file(cls, version: str, path: str) -> Tokenizer:
        with open(path, "rb") as file:
            return cls(version, file.read())

    def counter(self):
        if self.ranks is None:
            return lambda text: sum(1 for _ in WORDS.finditer(text))
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.ranks.splitlines()) if a}
        encoding = tiktoken.Encoding(self.version, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda text: sum(len(encoding.encode_ordinary(part)) for part in whole_pieces(text))


def whole_pieces(text: str, most: int = CHUNK_BYTES) -> Iterator[str]:
    """A very long text in parts that tokenize like the whole: cut before a space that lies between two letters."""
    at = 0
    while len(text) - at > most:
        cut = at + most
        while cut < len(text) - 1 and not (text[cut] == " " and text[cut - 1].isalpha() and text[cut + 1].isalpha()):
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


def counted(docs: DataFrame, tokenizers: list[Tokenizer]) -> DataFrame:
    """(doc_id, source, lang, version, n_tokens) per row and tokenizer."""
    sent = docs.sparkSession.sparkContext.broadcast(tokenizers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = [(t.version, t.counter()) for t in sent.value]
        for batch in batches:
            texts = batch.column(3)
            for version, count in counters:
                n = [count(t.as_py() or "") for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:3], pa.array([version] * len(n), type=pa.string()), pa.array(n, type=pa.int64())], names=["doc_id", "source", "lang", "version", "n_tokens"]
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), "text")
    return in_batches(rows).mapInArrow(run, "doc_id long, source string, lang string, version string, n_tokens long")


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(1).cast("long").alias("docs"), F.col("n_tokens").alias("tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("docs"), (-F.col("n_tokens")).alias("tokens"))


def revisions(counts: DataFrame) -> DataFrame:
    """Of rows that have `old_tokens` besides n_tokens."""
    return counts.select(*KEYS, F.lit(0).cast("long").alias("docs"), (F.col("n_tokens") - F.col("old_tokens")).alias("tokens"))


class Rollup:
    """A delta table in a folder that all executors share: `deltas/batch=<id>`, and sums of sealed batches in `base/<version>`.

    compact() adds the deltas up into a new base and seals their batches. A manifest per version, put in
    place whole and by one writer alone, says which base counts and which batches are in it; their deltas
    count no more, also before they are removed.
    """

    SCHEMA = T.StructType(
        [T.StructField(k, T.StringType()) for k in KEYS] + [T.StructField("docs", T.LongType()), T.StructField("tokens", T.LongType()), T.StructField("batch", T.StringType())]
    )

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def sealed(self) -> tuple[int, str | None, list[str]]:
        """(version, folder of the base, ids of the batches in it)."""
        known = sorted(int(n) for n in names_in(self.spark, f"{self.path}/manifests") if n.isdigit())
        if not known:
            return -1, None, []
        told = json.loads(read_text(self.spark, f"{self.path}/manifests/{known[-1]}"))
        return known[-1], told["base"], told["batches"]

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Write a batch's summed changes; the same batch id replaces what it wrote before, but for a sealed one, of which nothing is written (False)."""
        if batch in self.sealed()[2]:
            return False
        summed = changes.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        # written by partition even if no row is left, so that an emptied batch replaces its former rows
        marker = self.spark.createDataFrame([(None, None, None, 0, 0)], self.SCHEMA[:5])
        rows = summed.union(marker).withColumn("batch", F.lit(batch))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.path}/deltas")
        return True

    def _live(self, batches: list[str]) -> dict[str, str]:
        """Folders of the batches that are not sealed, by id."""
        names = [n for n in names_in(self.spark, f"{self.path}/deltas") if n.startswith("batch=")]
        return {i: n for n in sorted(names) if (i := unquote(n.removeprefix("batch="))) not in set(batches)}

    def _sums(self) -> tuple[DataFrame, list[str]]:
        """Rows of the base and of the batches that are not in it, and these batches' ids."""
        _, base, batches = self.sealed()
        plain, live = T.StructType(self.SCHEMA[:5]), self._live(batches)
        rows = self.spark.createDataFrame([], plain)
        if live:
            folders = [f"{self.path}/deltas/{name}" for name in live.values()]
            rows = rows.unionByName(self.spark.read.schema(self.SCHEMA).option("basePath", f"{self.path}/deltas").parquet(*folders).drop("batch"))
        if base is not None:
            rows = rows.unionByName(self.spark.read.schema(plain).parquet(f"{self.path}/base/{base}"))
        return rows.where(F.col("version").isNotNull()), list(live)

    def compact(self) -> bool:
        """Seal all batches that are committed; False if there are none, or another writer has sealed some meanwhile."""
        version, _, batches = self.sealed()
        live = self._live(batches)
        rows, ids = self._sums()
        if not ids or set(ids) != set(live):  # a batch came in just now
            return False
        base = f"{version + 1}-{uuid.uuid4().hex}"
        summed = rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        summed.write.parquet(f"{self.path}/base/{base}")
        system, make = file_system(self.spark, self.path)
        if not put_text(self.spark, f"{self.path}/manifests/{version + 1}", json.dumps({"base": base, "batches": [*batches, *ids]})):
            system.delete(make(f"{self.path}/base/{base}"), True)
            return False
        for name in live.values():
            system.delete(make(f"{self.path}/deltas/{name}"), True)
        return True

    def totals(self) -> DataFrame:
        """(source, lang, version, n_docs, n_tokens) over all committed batches."""
        return self._sums()[0].groupBy(*KEYS).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
