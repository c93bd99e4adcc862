"""Queries of the training-data operators, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawframe.llm import decontamination, langid, lm_score, media, mixing, prefix_trie, quality, sharding, simhash, spelling, token_counts, toxicity, urls
from lawframe.llm.common import checkpointed, table
from lawframe.session import scratch_folder


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return decontamination.digest(decontamination.matches(docs, table(spark, sf_dir, "benchmark", "item_id", "text")))


OP1_SQL = r"""
WITH lowered AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM lowered, sizes WHERE len(w) >= n)),
hits AS (SELECT p.doc_id, p.i, p.n, x.item_id FROM places p JOIN windows x ON p.win = x.win AND p.n = x.n),
covered AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY doc_id)
SELECT l.doc_id, len(l.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(f.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(f.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM lowered l LEFT JOIN covered c ON l.doc_id = c.doc_id LEFT JOIN found f ON l.doc_id = f.doc_id
"""


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = sharding.shard_rows(docs, shards=40)
    return found.select(
        "doc_id",
        F.col("bytes").alias("size"),
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "tokens",
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return mixing.mix(docs)


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix|' || coalesce(doc_id::VARCHAR, 'null')) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rn, source_size::DOUBLE * 3 AS most FROM s),
w AS (SELECT *, CASE rn % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM r),
q AS (SELECT *, most / weight AS ratio FROM w),
l AS (
  SELECT *, ((SELECT sum(source_size) FROM s)::DOUBLE
      - coalesce(sum(most) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM q),
t AS (
  SELECT source, source_size,
    least(most, coalesce((SELECT min_by(x.level, x.ratio) FROM l x WHERE x.level <= x.ratio) * weight, most)) AS target
  FROM l),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
c AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.epochs, floor(p.target)::BIGINT - p.epochs * p.source_size AS budget,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
      - sum(d.size) OVER (PARTITION BY d.source, d.k) AS before,
    sum(d.size) OVER (PARTITION BY d.source, d.k) AS here,
    count(*) OVER (PARTITION BY d.source, d.k) AS same
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
  (epochs * size + CASE WHEN before + here <= budget THEN size
     WHEN before >= budget THEN 0 ELSE least(size, (budget - before) // same) END)::BIGINT AS taken
FROM c
"""

def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages", "page_id", "url"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.from_media(media.to_media(table(spark, sf_dir, "documents", "doc_id", "text")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic")))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_pages(table(spark, sf_dir, "pages", "page_id", "url", "html"), table(spark, sf_dir, "documents", "text", "lang"))


TOKENIZERS = "/opt/tokenizers"


def op4_token_counts(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """All documents come in with estimated counts, then are revised to counted ones; those without tokens are withdrawn, twice."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source", "lang")
    versions = [
        token_counts.Tokenizer("words-1"),
        token_counts.Tokenizer.from_file("byte_bpe_50k-1", f"{tokenizers}/byte_bpe_50k.tiktoken"),
    ]
    estimate = F.ceil(F.coalesce(F.octet_length("text"), F.lit(0)) / 4).cast("long")
    counts = checkpointed(token_counts.counted(docs, versions))
    rollup = token_counts.Rollup(spark, scratch_folder(spark, "token-counts"))
    for tokenizer in versions:
        first = docs.select("source", "lang", F.lit(tokenizer.version).alias("version"), estimate.alias("n_tokens"))
        rollup.commit(f"ingest-{tokenizer.version}", token_counts.inserts(first))
        own = counts.where(F.col("version") == tokenizer.version)
        # the sum of the differences is the difference of the sums, so that no row has to meet its former count
        rollup.commit(
            f"count-{tokenizer.version}",
            token_counts.revisions(own.withColumn("old_tokens", F.lit(0).cast("long")).unionByName(first.select(F.lit(None).cast("long").alias("doc_id"), "source", "lang", "version", F.lit(0).cast("long").alias("n_tokens"), F.col("n_tokens").alias("old_tokens")))),
        )
    for _ in range(2):
        rollup.commit("withdraw", token_counts.deletes(counts.where("n_tokens = 0")))
    return rollup.totals()


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents", "doc_id", "text"))


#: The checksum of a run is crc32, bit by bit, of its bytes; near words share what is left when one code point goes, or are it.
OP11_SQL = r"""
WITH RECURSIVE runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS d, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS c
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents) GROUP BY ALL),
coded AS (SELECT w, c, hex(d || ':' || w) AS x, strlen(d || ':' || w) AS size FROM runs),
summed AS (
  SELECT w, c, xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(range(0, size),
      lambda i: (instr('123456789ABCDEF', x[2 * i + 1]) * 16 + instr('123456789ABCDEF', x[2 * i + 2]))::BIGINT),
    lambda a, b: list_reduce([xor(a, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda s, z: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END))) AS h
  FROM coded),
made AS (SELECT CASE WHEN h % 97 = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, c FROM summed),
words AS (SELECT word, sum(c)::BIGINT AS n FROM made WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
less AS (SELECT word, i, left(word, i) || substr(word, i + 2) AS v FROM (SELECT word, unnest(range(0, length(word)))::INT AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS near FROM less a JOIN less b ON a.v = b.v AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word FROM less a JOIN words b ON a.v = b.word
  UNION SELECT b.word, a.word FROM less a JOIN words b ON a.v = b.word),
best AS (
  SELECT p.word, count(*) AS n_near, arg_min(p.near, (-w.n, p.near)) AS near, max(w.n) AS near_n FROM pairs p JOIN words w ON p.near = w.word GROUP BY p.word),
forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near, CASE WHEN b.near_n >= 2 * w.n THEN b.near END AS form, CASE WHEN b.near_n >= 2 * w.n THEN b.near_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word),
walk(word, found, step) AS (
  SELECT word, word, 0 FROM forms UNION ALL SELECT k.word, f.form, step + 1 FROM walk k JOIN forms f ON k.found = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM forms f JOIN (SELECT word, arg_max(found, step) AS root FROM walk GROUP BY word) r ON f.word = r.word
"""


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


#: h of a conversation: crc32, bit by bit, of the digits of its id.
OP12_SQL = """
WITH RECURSIVE turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place,
    {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(t ORDER BY place) AS ts FROM turns GROUP BY conv_id),
hashed AS (
  SELECT conv_id, ts, xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
    lambda a, b: list_reduce([xor(a, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda s, z: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END))) % 9 AS h
  FROM own),
built AS (
  SELECT a.conv_id, list_concat(coalesce(b.ts[1:a.h], []), a.ts[a.h + 1:]) AS ts
  FROM hashed a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 5),
prefixes AS (SELECT conv_id, len(ts) AS total, d, ts[1:d] AS path FROM (SELECT conv_id, ts, unnest(range(0, len(ts) + 1)) AS d FROM built)),
nodes AS (
  SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(total) = d AS leaf,
    CASE WHEN d > 0 THEN strlen(path[d].text) ELSE 0 END AS bytes,
    sha256(coalesce(string_agg(CASE WHEN total = d THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM prefixes GROUP BY path, d),
kids AS (SELECT path[1:d - 1] AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
below AS (
  SELECT path[1:a] AS path, sum((n_convs - 1) * bytes) AS saved, count_if(leaf) AS leaves
  FROM (SELECT path, n_convs, bytes, leaf, unnest(range(0, d + 1)) AS a FROM nodes) GROUP BY 1)
SELECT v.conv_id, v.d::BIGINT AS depth, p.conv_id AS parent_conv_id, v.n_convs, coalesce(k.n, 0)::BIGINT AS n_children, b.leaves::BIGINT AS n_leaves,
  b.saved::BIGINT AS saved_tokens, v.ends_sha256
FROM nodes v JOIN below b ON v.path = b.path LEFT JOIN kids k ON v.path = k.path LEFT JOIN nodes p ON v.d > 0 AND p.d = v.d - 1 AND p.path = v.path[1:v.d - 1]
"""


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels", "doc_id", "quality")))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_media": op2_media,
    "op3_lm_score": op3_lm_score,
    "op4_token_counts": op4_token_counts,
    "op5_langid": op5_langid,
    "op6_sharding": op6_sharding,
    "op7_mixing": op7_mixing,
    "op8_toxicity": op8_toxicity,
    "op9_simhash": op9_simhash,
    "op10_urls": op10_urls,
    "op11_spelling": op11_spelling,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_quality": op13_quality,
}
ORACLES = {"op1_decontamination": OP1_SQL, "op7_mixing": OP7_SQL, "op11_spelling": OP11_SQL, "op12_prefix_trie": OP12_SQL}
