"""Language ID by Bayesian evidence fusion.

The log-posterior of each language is the sum of four kinds of evidence:

* text: multinomial likelihoods of byte trigrams, learned from labelled rows
  and tempered by `temper`, as trigrams of one text are not independent;
* declared markup language: how often rows whose text says language l declare
  each language, one grouped aggregation over all rows, smoothed;
* address suffix: the distribution of text languages over each suffix,
  smoothed towards the overall distribution, one grouped aggregation;
* host: the distribution over each host, smoothed towards its suffix.

The aggregations are counts by (host, suffix, declared, text language): partly
summed before the shuffle, so a host with a third of all rows is a few rows per
task, and the same counts rolled up serve all three priors.

Every label that has a text is a language. The text model is fitted on at most
`train_rows` distinct texts per language, those of least hash among twice as many
drawn by hash. All counts cover all rows. The model is a dense array, half a megabyte
per language.

Defined results: a null or empty text has no text evidence; a row without a
declared language, suffix or host has no such evidence; a null label is not
learned from; without any labels there are no languages, and every row has
lang null and is rejected; a tie goes to the first language by name; an empty
table gives an empty result; repeated rows each get the same result and count
each in the aggregations; a long text is read whole, and its evidence grows with
its letters. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lawframe.llm.common import BROADCAST_ROWS, checkpointed, chunks, in_batches, joined_on, marked, small, text_key

TRAIN_ROWS = 1_000
SLOTS = 1 << 16
TEMPER = 0.2
#: Prior counts with which a host leans on its suffix, a suffix on all rows, and declarations on uniform ones.
HOST_WEIGHT, SUFFIX_WEIGHT, DECLARED_WEIGHT = 20.0, 50.0, 5.0
LEAST_POSTERIOR = 0.5
#: Languages up to which their model is sent to all executors: 256 MB.
MOST_LANGUAGES = 512
LEAST_LETTERS = 1
#: Log-likelihood per trigram in no language, where all slots are as likely; a text that fits no language better is in none.
OTHER = -float(np.log(SLOTS)) - 1e-6

_FOLDED = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def slots(raw: bytes) -> tuple[np.ndarray, int]:
    """Hashed trigrams of letters and word ends, and the number of letter bytes."""
    words = raw.translate(_FOLDED).split()
    text = b" " + b" ".join(words) + b" "
    codes = np.frombuffer(text, dtype=np.uint8).astype(np.uint32)
    if not words:
        return np.zeros(0, dtype=np.int64), 0
    code = (codes[:-2] * 0x10001 + codes[1:-1] * 0x101 + codes[2:]) * np.uint32(0x9E3779B1)
    return (code >> np.uint32(16)).astype(np.int64), len(text) - len(words) - 1


@dataclass
class TextModel:
    languages: list[str]
    logs: np.ndarray  # slots by languages

    def evidence(self, raw: bytes) -> tuple[np.ndarray, int]:
        """Mean log-likelihood per trigram for each language, and the number of letters."""
        at, letters = slots(raw)
        if not letters:
            return np.zeros(len(self.languages)), 0
        counts = np.bincount(at, minlength=SLOTS) if len(at) > SLOTS else None
        total = counts @ self.logs if counts is not None else self.logs[at].sum(axis=0)
        return total / len(at), letters


def training_texts(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[list[str], DataFrame]:
    """Every label of a text, and at most `train_rows` distinct texts (lang, key, text) of each."""
    found = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", text_key(F.col("text")).alias("key"), "text")
    # near enough, as twice the share is drawn
    sizes = {r["lang"]: r["n"] for r in found.groupBy("lang").agg(F.approx_count_distinct("key").alias("n")).collect()}
    names = sorted(sizes)
    draw = F.xxhash64("key", F.lit("lang"))
    # twice the share that is needed goes on, so that a language with most rows is few before it meets in one task
    share = F.coalesce(*[F.when(F.col("lang") == n, F.lit(min(1.0, 2 * train_rows / max(sizes[n], 1)))) for n in names], F.lit(0.0))
    few = found.where(F.pmod(draw, F.lit(1 << 40)).cast("double") / float(1 << 40) < share).select("lang", "key").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(draw, "key"))
    chosen = few.withColumn("rank", rank).where(F.col("rank") <= train_rows).drop("rank")
    # train_rows rows per language of a name and a number
    return names, found.join(small(chosen), ["lang", "key"]).groupBy("lang", "key").agg(F.min("text").alias("text"))


def train_text(labelled: DataFrame, train_rows: int = TRAIN_ROWS, most_languages: int = MOST_LANGUAGES) -> TextModel:
    """A model of (text, lang) rows, every label of which is a language; trigrams are counted on the executors.

    The model goes to all executors, half a megabyte for each language: ValueError for more labels than `most_languages`.
    """
    names, texts = training_texts(labelled, train_rows)
    if len(names) > most_languages:
        raise ValueError(f"{len(names)} labels are more than {most_languages} languages, for which the model has {SLOTS * most_languages * 8 >> 20} MB")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            sums: dict[str, np.ndarray] = {}
            for first, part in chunks(batch, "text"):
                for lang, raw in zip(langs[first : first + len(part)], part, strict=True):
                    sums[lang] = sums.get(lang, 0) + np.bincount(slots(raw)[0], minlength=SLOTS)
            for lang, n in sums.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), type=pa.string()), pa.array(at), pa.array(n[at])], names=["lang", "slot", "n"])

    rows = texts.select("lang", F.col("text").cast("binary").alias("text"))
    found = in_batches(rows).mapInArrow(run, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    counts = np.full((SLOTS, len(names)), 0.05)
    place = {name: i for i, name in enumerate(names)}
    table = found.toArrow()  # SLOTS rows per language at most
    if len(table):
        at = np.array([place[lang] for lang in table["lang"].to_pylist()])
        counts[table["slot"].to_numpy(), at] += table["n"].to_numpy()
    return TextModel(names, np.log(counts / counts.sum(axis=0)))


def visible_text(html: Column) -> Column:
    """Markup without scripts, styles, comments, tags and entities."""
    cut = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(F.regexp_replace(cut, r"(?s)<[^>]*>", " "), r"&#?\w+;", " ")


def declared_lang(html: Column) -> Column:
    """The primary subtag of the html element's lang attribute, else null."""
    found = F.regexp_extract(html, r"""(?is)<html\b[^>]*?\slang\s*=\s*["']?([a-z]{2,3})""", 1)
    return F.when(found != "", F.lower(found))


def text_evidence(rows: DataFrame, model: TextModel, text: str = "text") -> DataFrame:
    """Rows without `text`, with `likelihood` (per language), `letters` and `said` (the language the text alone says)."""
    keep = [c for c in rows.columns if c != text]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*[F.col(f"`{c}`") for c in keep]).schema)
    broadcast = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = broadcast.value
        for batch in batches:
            likelihood, letters, said = [], [], []
            for _, texts in chunks(batch, text):
                for raw in texts:
                    mean, n = own.evidence(raw)
                    likelihood.append(mean)
                    letters.append(n)
                    said.append(own.languages[int(np.argmax(mean))] if n and own.languages else None)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            made = [pa.array(likelihood, type=pa.list_(pa.float64())), pa.array(letters, type=pa.int64()), pa.array(said, type=pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, *made], names=[*keep, "likelihood", "letters", "said"])

    prepared = rows.withColumn(text, F.col(text).cast("binary"))
    return in_batches(prepared).mapInArrow(run, f"{kinds}, likelihood array<double>, letters long, said string")


def _shares(counts: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """Per value of `by`, the counts per language as an array, for values that are not null."""
    sums = [F.coalesce(F.sum(F.when(F.col("said") == n, F.col("n"))), F.lit(0)).cast("double") for n in names]
    known = counts.where(F.col("said").isNotNull())
    for c in by:
        known = known.where(F.col(c).isNotNull())
    return known.groupBy(*by).agg(F.array(*sums).alias("counts"))


def _smoothed(counts: Column, prior: Column, weight: float) -> Column:
    """Dirichlet smoothing of counts towards prior shares."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(counts, prior, lambda c, p: (c + F.lit(weight) * p) / (total + F.lit(weight)))


def _with_hosts(rows: DataFrame, hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows with `by host`: a table of few hosts is broadcast; of many, hosts with very many rows are, and rows without a known host stay where they are."""
    kept = small(hosts)
    key = F.when(F.col("host").isNotNull() & F.col("suffix").isNotNull(), F.struct("host", "suffix"))
    keyed = rows.withColumn("place key", key)
    if kept.count() <= BROADCAST_ROWS:
        return keyed.join(kept, "place key", "left").drop("place key")
    # every host of a row with a said language is in the table; others have no host's evidence
    sizes = counts.where("host is not null and suffix is not null").groupBy(F.struct("host", "suffix").alias("place key")).agg(F.sum("n").alias("rows of host"))
    every = checkpointed(sizes.join(kept, "place key", "left"))
    none = keyed.where(F.col("place key").isNull()).withColumn("by host", F.lit(None).cast("array<double>"))
    met = joined_on(keyed.where(F.col("place key").isNotNull()), every, "place key", "rows of host")
    return met.drop("place key").unionByName(none.drop("place key"))


def fuse(rows: DataFrame, model: TextModel, temper: float = TEMPER, least_posterior: float = LEAST_POSTERIOR) -> DataFrame:
    """`rows` with (likelihood, letters, said, declared, suffix, host) get lang, posterior and accepted."""
    names = model.languages
    if not names:
        return rows.withColumns({"lang": F.lit(None).cast("string"), "posterior": F.lit(None).cast("double"), "accepted": F.lit(False)})
    counts = checkpointed(rows.groupBy("host", "suffix", "declared", "said").agg(F.count(F.lit(1)).alias("n")))
    uniform = F.array(*[F.lit(1.0 / len(names))] * len(names))
    overall = counts.where(F.col("said").isNotNull()).groupBy("said").agg(F.sum("n").alias("n")).collect()  # one row per language
    found = {r["said"]: r["n"] for r in overall}
    total = sum(found.values())
    base = [(found.get(n, 0) + 1.0) / (total + len(names)) for n in names]
    prior = F.array(*[F.lit(p) for p in base])
    suffixes = _shares(counts, ["suffix"], names).select(F.col("suffix").alias("of suffix"), _smoothed(F.col("counts"), prior, SUFFIX_WEIGHT).alias("by suffix"))
    suffixes = small(suffixes)
    hosts = _shares(counts, ["host", "suffix"], names).join(suffixes, F.col("suffix") == F.col("of suffix"))
    hosts = hosts.select(F.struct("host", "suffix").alias("place key"), _smoothed(F.col("counts"), F.col("by suffix"), HOST_WEIGHT).alias("by host"))
    # per declared value, the chance of declaring it given each language
    said = F.array(*[F.lit(float(found.get(n, 0))) for n in names])
    declared = _shares(counts, ["declared"], names).select(
        F.col("declared").alias("of declared"),
        F.zip_with("counts", said, lambda c, s: (c + F.lit(DECLARED_WEIGHT / len(names))) / (s + F.lit(DECLARED_WEIGHT))).alias("by declared"),
    )
    known = rows.join(suffixes, F.col("suffix") == F.col("of suffix"), "left").join(small(declared), F.col("declared") == F.col("of declared"), "left")
    joined = _with_hosts(known, hosts, counts)
    place = F.coalesce("by host", "by suffix", prior)
    told = F.coalesce("by declared", uniform)
    # the whole text's tempered evidence: a mean per trigram, and as many trigrams as letters
    weight = F.col("letters") * temper
    logs = F.zip_with(
        F.zip_with(F.transform("likelihood", lambda x: x * weight), place, lambda a, p: a + F.log(p)), told, lambda a, p: a + F.log(p)
    )
    scored = joined.withColumn("logs", logs).withColumn("best", F.array_max("logs"))
    mass = F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("best")))
    scored = scored.withColumn("posterior", 1.0 / mass).withColumn(
        "lang_found", F.element_at(F.array(*[F.lit(n) for n in names]), F.array_position("logs", F.col("best")).cast("int"))
    )
    kept = [F.col(f"`{c}`") for c in rows.columns]
    fits = F.array_max("likelihood") >= OTHER
    accepted = (F.col("letters") >= LEAST_LETTERS) & (F.col("posterior") >= least_posterior) & fits
    return scored.select(*kept, F.col("lang_found").alias("lang"), "posterior", accepted.alias("accepted"))


def identify_pages(pages: DataFrame, labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(page_id, host, suffix, declared, text_lang, letters, lang, posterior, accepted) per row of (page_id, url, html)."""
    from lawframe.llm.urls import host_of

    model = train_text(labelled, train_rows)
    rows = pages.select("page_id", F.nullif(host_of(F.col("url")), F.lit("")).alias("host"), declared_lang(F.col("html")).alias("declared"), visible_text(F.col("html")).alias("text"))
    rows = rows.withColumn("suffix", F.substring_index("host", ".", -1))
    measured = checkpointed(text_evidence(rows, model))
    return fuse(measured, model).select("page_id", "host", "suffix", "declared", F.col("said").alias("text_lang"), "letters", "lang", "posterior", "accepted")


def accepted_documents(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of `docs` whose language can be told; their source serves as host, and their lang as declared.

    Rows go that have no letter, whose posterior stays under one half, or whose text
    alone is less likely in every language than evenly drawn trigrams.
    """
    model = train_text(docs.select("text", "lang"), train_rows)
    rows = docs.select(
        "doc_id", text_key(F.col("text")).alias("key"), F.col("source").alias("host"), F.lit("source").alias("suffix"), F.col("lang").alias("declared"), "text"
    )
    measured = checkpointed(text_evidence(rows, model))
    rejected = fuse(measured, model).where("not accepted").select("doc_id", "key", "host", "declared")
    return marked(docs, rejected, [F.col("doc_id"), text_key(F.col("text")), F.col("source"), F.col("lang")], "left_anti")
