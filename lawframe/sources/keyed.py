"""A table with a row per key in a folder, changed by batches, of which readers see whole versions.

Keys are dealt to parts by the leading bits of their hash: a part is named by a bit
prefix and holds the keys whose hash begins with it. A part that would have more than
`most_rows` rows splits in two, again and again, and no other part is touched, so the
number of parts grows with the table and a part's size doesn't. A batch reads and
rewrites the parts that its keys fall into, under a name of its own; nothing is
written in place. A manifest per version, put in place whole and last, says which
files each part has. Until then the former version stands, whatever was written.

The manifest is what a driver holds: a line for each part, that is for each
`most_rows` / 2 rows of the table.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_left
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lawframe.session import file_system, names_in, put_text, read_text, shared_folder

MOST_ROWS = 1_000_000
#: Parts are told by so many bits of the hash at most.
BITS = 64
#: Rows that one task sorts, whatever the parts they belong to.
ROWS_A_TASK = 100_000


def tasks_for(rows: int) -> int:
    return max(1, -(-rows // ROWS_A_TASK))


#: Of each part, by prefix: the name of its files, and its rows.
Parts = dict[str, tuple[str, int]]
Fold = Callable[[DataFrame, DataFrame], DataFrame]


def _splits(prefix: str, counts: dict[str, int], most: int) -> dict[str, int]:
    """The prefix, or the halves of it that hold `most` rows at most, with their rows; `counts` are by longer prefixes of equal length."""
    own = {p: n for p, n in counts.items() if p.startswith(prefix)}
    total = sum(own.values())
    if total <= most or all(len(p) == len(prefix) for p in own):
        return {prefix: total}
    return _splits(prefix + "0", own, most) | _splits(prefix + "1", own, most)


class KeyedTable:
    """`rows/part=p<bits>/by=<name>` and `manifests/<version>`."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], most_rows: int = MOST_ROWS):
        self.spark, self.path, self.schema, self.keys, self.most_rows = spark, path, schema, keys, most_rows

    def versions(self) -> list[int]:
        return sorted(int(name) for name in names_in(self.spark, f"{self.path}/manifests") if name.isdigit())

    def parts(self, before: int | None = None) -> tuple[int, Parts]:
        """The newest version, of those below `before`, and its parts."""
        known = [v for v in self.versions() if before is None or v < before]
        if not known:
            return -1, {}
        told = json.loads(read_text(self.spark, f"{self.path}/manifests/{known[-1]}"))
        return known[-1], {p: (by, n) for p, (by, n) in told.items()}

    def _folders(self, parts: Parts) -> list[str]:
        return [f"{self.path}/rows/part=p{p}/by={by}" for p, (by, n) in sorted(parts.items()) if n]

    def rows(self, parts: Parts | None = None) -> DataFrame:
        """A snapshot: of the newest version, or of the parts that `parts()` gave."""
        folders = self._folders(self.parts()[1] if parts is None else parts)
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def bits(self) -> Column:
        return F.lpad(F.bin(F.xxhash64(*[F.col(k) for k in self.keys])), BITS, "0")

    def _placed(self, rows: DataFrame, prefixes: list[str]) -> DataFrame:
        """Rows with the prefix, one of `prefixes`, that their key has."""
        sizes = sorted({len(p) for p in prefixes})
        if sizes == [0]:
            return rows.withColumn("part", F.lit(""))
        # no prefix begins another one, so exactly one of the lengths fits
        listed = self.spark.createDataFrame([(p,) for p in prefixes], "part string")
        tried = rows.withColumn("part", F.explode(F.transform(F.array(*[F.lit(n) for n in sizes]), lambda n: F.substring(self.bits(), F.lit(1), n))))
        return tried.join(listed, "part")

    def merged(self, batch: DataFrame, parts: Parts, fold: Fold, name: str) -> tuple[Parts, Parts, Parts]:
        """Write the parts that a batch touches, under `name`: (all parts from now on, touched ones before, the same ones after).

        `fold` makes of the rows of these parts and the batch's the rows that stay, one for each key.
        """
        known = list(parts) or [""]
        if known == [""]:
            touched = [] if batch.isEmpty() else known
        else:
            touched = sorted(r["part"] for r in self._placed(batch.select(*self.keys), known).select("part").distinct().collect())
        if not touched:
            return parts, {}, {}
        former = {p: parts[p] for p in touched if p in parts}
        shared_folder(self.spark)
        folded = fold(self.rows(former), batch.select(*self.schema.names)).checkpoint()
        # rows by longer prefixes, so long that none has too many: a few numbers for each part that is touched or made
        deeper = max(len(p) for p in touched) + 2
        while True:
            deeper = min(deeper, BITS)
            counts = {r["p"]: r["n"] for r in folded.groupBy(F.substring(self.bits(), 1, deeper).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
            most = max(counts.values(), default=0)
            if deeper == BITS or most <= self.most_rows:
                break
            deeper += (most // self.most_rows).bit_length() + 1
        made: dict[str, int] = {}
        ordered = sorted(counts)
        for p in touched:
            inside = ordered[bisect_left(ordered, p) : bisect_left(ordered, p + "2")]  # all that begin with p
            made |= _splits(p, {q: counts[q] for q in inside}, self.most_rows)
        placed = self._placed(folded, list(made)).withColumns({"part": F.concat(F.lit("p"), "part"), "by": F.lit(name)})
        # ranges of the hash are parts or pieces of them, so a task's rows are bounded and a part is in few files
        ranges = placed.repartitionByRange(tasks_for(sum(made.values())), self.bits())
        ranges.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "by").parquet(f"{self.path}/rows")
        after = {p: (name, n) for p, n in made.items()}
        return {p: v for p, v in parts.items() if p not in touched} | after, former, after

    def commit(self, version: int, parts: Parts, replace: bool = False) -> bool:
        """Make a version of the parts; False if another writer has made it."""
        return put_text(self.spark, f"{self.path}/manifests/{version}", json.dumps(parts), replace)

    def forget(self, version: int, keep: int = 2) -> None:
        """Remove versions before the last `keep` up to `version`, and files that only they have."""
        system, make = file_system(self.spark, self.path)
        known = [v for v in self.versions() if v <= version]
        kept: set[str] = set()
        for v in known[-keep:]:
            kept |= set(self._folders(self.parts(before=v + 1)[1]))
        for v in known[:-keep]:
            for folder in set(self._folders(self.parts(before=v + 1)[1])) - kept:
                system.delete(make(folder), True)
            system.delete(make(f"{self.path}/manifests/{v}"), False)

    def upsert(self, batch: DataFrame, fold: Fold, tries: int = 20, keep: int = 10) -> int:
        """Take a batch in as the next version; a writer that another one overtakes starts again from its version."""
        for _ in range(tries):
            version, parts = self.parts()
            made, _, after = self.merged(batch, parts, fold, uuid.uuid4().hex)
            if self.commit(version + 1, made):
                self.forget(version + 1, keep)
                return version + 1
            system, make = file_system(self.spark, self.path)
            for folder in self._folders(after):
                system.delete(make(folder), True)
        raise RuntimeError(f"{self.path}: overtaken {tries} times")
