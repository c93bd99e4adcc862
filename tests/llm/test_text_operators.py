"""Decontamination, near-duplicates, language models and language ID against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from helpers import SF, same_rows
from pyspark.sql import functions as F

from lawframe.llm import decontamination, langid, lm_score, registry, simhash

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(spark, duck, name):
    same_rows(registry.QUERIES[name](spark, SF), duck, registry.ORACLES[name])


def _brute_hits(text, items):
    words, hit, found = _words(text), set(), set()
    for item, bench in items:
        b = _words(bench)
        size = min(10, len(b))
        windows = {tuple(b[i : i + size]) for i in range(len(b) - size + 1)} if b else set()
        for i in range(len(words) - size + 1):
            if size and tuple(words[i : i + size]) in windows:
                hit |= set(range(i, i + size))
                found.add(item)
    return len(words), len(hit), found


def test_decontamination_of_odd_rows(spark, docs, no_docs):
    items = [
        (1, "Fox jumps OVER"), (1, "lazy dog"), (2, None), (3, "..."), (4, "one two three four five six seven eight nine ten eleven"), (4, "one two three four five six seven eight nine ten eleven"),
        (10, "x"), (None, "no id"), (5, "für die Straße, größer als je, ein Tag"), (6, "the the the"), (7, "straße größer"),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("window", F.lit(1))
    got = collections.Counter(tuple(r) for r in decontamination.digest(decontamination.matches(docs, bench)).collect())
    want = collections.Counter()
    for r in docs.collect():
        n, hit, found = _brute_hits(r["text"], items)
        ids = sorted(str(i) for i in found if i is not None)
        want[(r["doc_id"], n, hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0)] += 1
    assert got == want
    assert decontamination.digest(decontamination.matches(no_docs, bench)).count() == 0
    assert decontamination.matches(docs, bench.limit(0)).where(F.size("spans") > 0).count() == 0
    kept = {r["doc_id"] for r in decontamination.clean_documents(docs, bench).collect()}
    assert kept == {r["doc_id"] for r in docs.collect() if not _brute_hits(r["text"], items)[1]}


def _print(text):
    w = (text or "").encode().translate(LOWER).split()
    parts = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(p, seed=42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def _components(prints):
    """Least id reachable, by id, over (id, print) rows."""
    label = list(range(len(prints)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
                label[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(prints))]


def test_simhash_of_given_documents(spark, duck):
    rows = duck.execute("SELECT doc_id, text FROM documents").fetchall()
    prints = [(d, _print(t)) for d, t in rows]
    want = {(d, f"{p:016x}", c) for (d, p), c in zip(prints, _components(prints), strict=True)}
    assert {tuple(r) for r in registry.op9_simhash(spark, SF).collect()} == want


def test_simhash_of_odd_rows(spark, docs, no_docs):
    rows = docs.select("doc_id", "text").collect()
    prints = [(r["doc_id"], _print(r["text"])) for r in rows]
    want = collections.Counter((d, p if p < 1 << 63 else p - (1 << 64), c) for (d, p), c in zip(prints, _components(prints), strict=True))
    got = collections.Counter(tuple(r) for r in simhash.near_duplicates(docs).select("doc_id", "fp", "component_id").collect())
    assert got == want
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = [r["doc_id"] for r in simhash.one_of_each(docs).collect()]
    comps = {c for *_, c in want}
    assert sorted(k for k in kept if k is not None) == sorted(c for c in comps if c is not None)
    assert simhash.one_of_each(docs).columns == docs.columns


@pytest.mark.parametrize("limit", [4, 2048])
def test_links_between_close_fingerprints(spark, limit):
    """Dense clusters, also with keys that have to be divided."""
    rng = random.Random(5)
    prints = set()
    for _ in range(6):
        center = rng.getrandbits(64)
        for _ in range(40):
            value = center
            for b in rng.sample(range(64), rng.choice([0, 1, 1, 2, 3, 5])):
                value ^= 1 << b
            prints.add(value)
    prints = sorted(prints)
    df = spark.createDataFrame([(p if p < 1 << 63 else p - (1 << 64),) for p in prints], "fp long")
    found = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, limit)).collect()}
    comps = _components(list(enumerate(prints)))
    for i, p in enumerate(prints):
        for j in range(i):
            a, b = (q if q < 1 << 63 else q - (1 << 64) for q in (p, prints[j]))
            assert (comps[i] == comps[j]) == (found.get(a, a) == found.get(b, b))


def _automaton(texts, least=2):
    """The same model with dictionaries, walked state by state."""
    toks = [(t or "").encode().translate(LOWER).split() + [b" "] for t in texts]
    uni = collections.Counter(w for t in toks for w in t)
    total, types = sum(uni.values()), len(uni)
    core = {w for w, c in uni.items() if c >= least}
    grams = {n: collections.Counter(tuple(t[i : i + n]) for t in toks for i in range(len(t) - n + 1) if all(w in core for w in t[i : i + n])) for n in (2, 3)}
    grams = {n: {g: c for g, c in v.items() if c >= least} for n, v in grams.items()}
    grams[3] = {g: c for g, c in grams[3].items() if g[:2] in grams[2]}
    d, arcs, fail = lm_score.DISCOUNT, {}, {}
    for w, c in uni.items():
        arcs[(w,)] = math.log10((c - d) / total)
    for n in (2, 3):
        by = collections.defaultdict(dict)
        for g, c in grams[n].items():
            by[g[:-1]][g[-1]] = c
        for h, next_words in by.items():
            n_h = uni[h[0]] if n == 2 else grams[2][h]
            left = 1 - (sum(next_words.values()) - d * len(next_words)) / n_h
            lower = {w: 10 ** _walk(arcs, fail, h[1:], w) for w in next_words}
            for w, c in next_words.items():
                arcs[(*h, w)] = math.log10((c - d) / n_h + left * lower[w])
            fail[h] = math.log10(max(1 - sum(10 ** arcs[(*h, w)] for w in next_words), 1e-9) / max(1 - sum(lower.values()), 1e-9))
    return arcs, fail, math.log10(d * types / total), core, uni, total, types


def _walk(arcs, fail, state, word, unknown=0.0):
    cost = 0.0
    while True:
        if (*state, word) in arcs:
            return cost + arcs[(*state, word)]
        if not state:
            return cost + unknown
        cost += fail.get(state, 0.0)
        state = state[1:]


def _same_as_automaton(rows, scored, least=2):
    """Held-out tokens' gain over the base, after comparing every row with the walk through dictionaries."""
    train = [t for d, t in rows if zlib.crc32(str(d).encode()) % 7 != 2]
    arcs, fail, unknown, core, uni, total, types = _automaton(train, least)
    got = {r["doc_id"]: r for r in scored.collect()}
    assert len(got) == len(rows)
    gain = 0.0
    for d, t in rows:
        words = (t or "").encode().translate(LOWER).split() + [b" "]
        score, state = 0.0, ()
        for w in words:
            score += _walk(arcs, fail, state, w, unknown)
            state = (*state, w)[-2:] if w in core else ()
            while state and state not in fail:
                state = state[1:]
        base = sum(math.log10((uni[w] + 1) / (total + types + 1)) for w in words)
        r = got[d]
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(score, rel=1e-9)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(uni[w] > 0 for w in words), total)
        gain += (r["score"] - r["base_score"]) * r["held_out"]
    return gain


@pytest.mark.parametrize("sf_dir", [SF, SF.replace("sf0.001", "sf0.01")])
def test_lm_score_is_the_automaton(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert _same_as_automaton(rows, registry.op3_lm_score(spark, sf_dir)) > 0  # closer to held-out text than the base


def test_lm_score_with_small_chunks_and_divided_histories(spark):
    """Texts over several chunks, and histories over several buckets, change nothing."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    _same_as_automaton(rows, lm_score.score(docs, chunk_tokens=700, least_hot=20))


def test_code_book():
    book, keys = np.array([7, 3, 9], dtype=np.uint64), np.array([1, 3, 7, 9, 10], dtype=np.uint64)
    assert lm_score.codes(keys, book).tolist() == [3, 1, 0, 2, 3] and lm_score.codes(keys, book[:0]).tolist() == [0] * 5


def test_packed_blocks():
    rng = random.Random(3)
    for n in (0, 1, 2, 1000):
        columns = [sorted(rng.getrandbits(64) for _ in range(n)), [rng.getrandbits(48) for _ in range(n)], [0] * n]
        first, rest, *others = lm_score.unpack(lm_score.pack(*lm_score.steps(np.array(columns[0], dtype=np.uint64)), *(np.array(c, dtype=np.uint64) for c in columns[1:])))
        assert [lm_score.whole(first, rest).tolist(), *(c.tolist() for c in others)] == columns


def test_long_texts_are_cut_at_blanks(monkeypatch):
    monkeypatch.setattr(lm_score, "PART_BYTES", 10)
    for text in (b"", b" ", b"one", b"A bc\t def  ghij\nklmnopqrstuvwxyz0123456789 a b c d e f g h i j k l ", b"x" * 50):
        assert [w for part in lm_score.token_parts(text) for w in part] == [*text.translate(LOWER).split(), b" "]


def test_lm_probabilities_sum_to_one(spark):
    """From any state, all words and the unknown one have probability one together."""
    texts = ["a b a b a c", "a b d", "b a b a e f"] * 3
    arcs, fail, unknown, _, uni, *_ = _automaton(texts)
    for state in [(), *fail]:
        cost, rest = 0.0, state
        while rest:
            cost += fail.get(rest, 0.0)
            rest = rest[1:]
        assert sum(10 ** _walk(arcs, fail, state, w) for w in uni) + 10 ** (cost + unknown) == pytest.approx(1)


def test_lm_score_of_odd_rows(docs, no_docs):
    rows = lm_score.score(docs).collect()
    assert len(rows) == docs.count()
    assert all(r["n_tokens"] >= 1 and math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in rows)
    assert len({(r["n_tokens"], r["score"]) for r in rows if r["doc_id"] == 7}) == 1
    assert lm_score.score(no_docs).count() == 0
    held = docs.where("doc_id = 1 and false")
    assert held.count() == 0


def test_language_id(spark, duck):
    rows = registry.op5_langid(spark, SF).collect()
    truth = dict(duck.execute(r"SELECT page_id, regexp_extract(url, '://[^/]*/(en|fr|de|es)/', 1) FROM pages").fetchall())
    assert len(rows) == len(truth)
    known = [r for r in rows if truth[r["page_id"]]]
    assert sum(r["lang"] == truth[r["page_id"]] for r in known) >= 0.98 * len(known)
    assert sum(r["accepted"] for r in rows) >= 0.98 * len(rows)


def _brute_languages(pages, labelled):
    """Posteriors in plain Python: trigram counts, then counts by declared language, suffix and host."""
    counts = {}
    for text, lang in {(t, l) for t, l in labelled if t is not None and l is not None}:
        counts.setdefault(lang, collections.Counter()).update(langid.slots(text.encode())[0].tolist())
    names = sorted(counts)
    total = {n: sum(counts[n].values()) + 0.05 * langid.SLOTS for n in names}
    rows = []
    for page, url, html in pages:
        html = html or ""
        text = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ", html)
        text = re.sub(r"&#?\w+;", " ", re.sub(r"(?s)<[^>]*>", " ", text), flags=re.A)
        found = re.search(r"""(?is)<html\b[^>]*?\slang\s*=\s*["']?([a-z]{2,3})""", html)
        host = re.split(r"[/?#]", url.split("://", 1)[1])[0].lower() if url and "://" in url else ""
        at, letters = langid.slots(text.encode())
        mean = {n: sum(math.log((counts[n][s] + 0.05) / total[n]) for s in at.tolist()) / len(at) if letters else 0.0 for n in names}
        said = max(names, key=lambda n: (mean[n], -names.index(n))) if letters else None
        rows.append((page, host or None, host.rsplit(".", 1)[-1] if host else None, found and found.group(1).lower(), letters, mean, said))
    said = collections.Counter(r[6] for r in rows if r[6])
    base = {n: (said[n] + 1) / (sum(said.values()) + len(names)) for n in names}
    by = collections.Counter()
    for _, host, suffix, declared, _, _, lang in rows:
        if lang:
            for key in (("s", suffix) if suffix else None, ("h", host, suffix) if host else None, ("d", declared) if declared else None):
                by[key, lang] += 1

    def smoothed(key, prior, weight):
        n = sum(by[key, x] for x in names)
        return {x: (by[key, x] + weight * prior[x]) / (n + weight) for x in names} if n else None

    out = {}
    for page, host, suffix, declared, letters, mean, _ in rows:
        suffixes = smoothed(("s", suffix), base, langid.SUFFIX_WEIGHT) if suffix else None
        hosts = smoothed(("h", host, suffix), suffixes, langid.HOST_WEIGHT) if host and suffixes else None
        prior = hosts or suffixes or base
        told = {x: 1.0 for x in names}
        if declared and any(by[("d", declared), x] for x in names):
            told = {x: (by[("d", declared), x] + langid.DECLARED_WEIGHT / len(names)) / (said[x] + langid.DECLARED_WEIGHT) for x in names}
        logs = {x: langid.TEMPER * letters * mean[x] + math.log(prior[x]) + math.log(told[x]) for x in names}
        best = max(logs.values())
        lang = next(x for x in names if logs[x] == best)
        out[page] = (lang, 1 / sum(math.exp(v - best) for v in logs.values()))
    return out


def test_language_posteriors_are_the_brute_force_ones(spark):
    read = lambda name, *c: [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(*c).collect()]
    want = _brute_languages(read("pages", "page_id", "url", "html"), read("documents", "text", "lang"))
    rows = registry.op5_langid(spark, SF).collect()
    assert len(rows) == len(want)
    for r in rows:
        assert (r["lang"], r["posterior"]) == (want[r["page_id"]][0], pytest.approx(want[r["page_id"]][1], rel=1e-6))


def test_language_id_of_odd_rows(spark, docs, no_docs):
    kept = langid.accepted_documents(docs).collect()
    gone = docs.count() - len(kept)
    assert gone == sum(not any(c.isalpha() for c in r["text"] or "") for r in docs.collect())
    assert langid.accepted_documents(no_docs).count() == 0
    pages = spark.createDataFrame([(1, None, None), (2, "no scheme", ""), (3, "http://h.example/x", '<html LANG="fr-CA"><body><script>x</script>Bonjour &amp; le monde'), (3, "http://h.example/x", None)], "page_id long, url string, html string")
    labelled = docs.select("text", "lang")
    found = sorted(tuple(r)[:4] for r in langid.identify_pages(pages, labelled).select("page_id", F.coalesce("host", F.lit("")), F.coalesce("declared", F.lit("")), "accepted").collect())
    assert found == [(1, "", "", False), (2, "", "", False), (3, "h.example", "", False), (3, "h.example", "fr", True)]
    assert langid.identify_pages(pages, labelled.limit(0)).where("accepted or lang is not null").count() == 0


def test_very_long_pages(spark):
    """Over a megabyte of markup is read from end to end."""
    labelled = spark.createDataFrame([("le chat est sur la table et le chien mange", "fr"), ("the cat sat on the mat and the dog ate", "en")], "text string, lang string")
    html = "<html lang=en><body>" + "<p>the dog</p>" * 20 + "<script>var x = 1;</script><p>le chien mange sur la table</p>" * 20_000
    found = langid.identify_pages(spark.createDataFrame([(1, "http://h.example/x", html)], "page_id long, url string, html string"), labelled).first()
    assert (found["text_lang"], found["lang"], found["declared"]) == ("fr", "fr", "en") and found["letters"] > 400_000


def test_priors_decide_where_texts_do_not(spark):
    """A host that is French otherwise makes a doubtful page French."""
    model = langid.TextModel(["en", "fr"], None)
    rows = [("h1", "com", None, [0.0, 0.0], 1, None)] + [("h1", "com", None, [-9.0, -1.0], 100, "fr")] * 30 + [("h2", "com", None, [-1.0, -9.0], 100, "en")] * 30
    df = spark.createDataFrame(rows, "host string, suffix string, declared string, likelihood array<double>, letters long, said string")
    found = langid.fuse(df, model).where("said is null").first()
    assert found["lang"] == "fr" and found["posterior"] > 0.75


def test_lm_score_of_all_ngrams(spark):
    """With arcs for what is seen once, and lanes so short that most begin within a text."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    _same_as_automaton(rows, lm_score.score(docs, chunk_tokens=20_000, least_count=1), least=1)


@pytest.mark.parametrize("lane", [1, 2, 3, 7, 1000])
def test_lanes_of_the_traversal(lane):
    """States by hand: two texts of a chunk, one of them going on from a former chunk with two words of context."""
    words = np.array([3, 5, 9], dtype=np.uint64) << np.uint64(40)
    word = np.array([0, 1, 2, 0, 1, 0, 1, 2], dtype=np.uint64)
    row = {"block": lm_score.pack(*lm_score.steps(words), word), "before": [0, 2], "held": [False, False], "sizes": [4, 2]}
    grams = lm_score.Grams(row)
    machine = object.__new__(lm_score.Automaton)
    n1, n2, n3 = len(grams.words), len(grams.pairs), len(grams.triples)
    machine.words = n1
    machine.fail_to = np.concatenate([[0], np.zeros(n1), 1 + grams.pair_last]).astype(np.int32)
    machine.fail_log = np.concatenate([[0], -10.0 * np.arange(1, n1 + 1), -100.0 * np.arange(1, n2 + 1)])
    machine.arc_from, machine.arc_to, machine.arc_log = np.full(n1 + n2 + n3, -1, dtype=np.int32), np.zeros(n1 + n2 + n3, dtype=np.int32), np.zeros(n1 + n2 + n3)
    machine.arc_from[:n1], machine.arc_to[:n1], machine.arc_log[:n1] = 0, 1 + np.arange(n1), [-1, -2, -3]
    kept = [p for p in range(n2) if (grams.pair_first[p], grams.pair_last[p]) == (0, 1)]
    machine.arc_from[n1 + kept[0]], machine.arc_to[n1 + kept[0]], machine.arc_log[n1 + kept[0]] = 1, 1 + n1 + kept[0], -0.5
    down = machine.fail_log[1 + n1 + kept[0]]
    # a; a b by its arc; then down to b and to nothing for c; down from c for a. The other: a b of the context, then a and b
    want = [-1, -0.5, down - 20 - 3, -30 - 1, down - 20 - 1, -0.5]
    found = machine.walk(grams, lane)[grams.scored]
    assert found.tolist() == pytest.approx([*want[:4], -0.5 if word[6] == 1 else want[4], down - 20 - 3])


def test_lm_keeps_rare_pairs_of_a_large_corpus(spark):
    """A pair and a triple seen three times have arcs, though they are a tiny share of all tokens."""
    rows = [(i, " ".join(f"w{(i * 31 + j * 17) % 500}" for j in range(4000))) for i in range(500)]
    rare = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 7 != 2][:3]
    held = next(i for i in range(2000, 2100) if zlib.crc32(str(i).encode()) % 7 == 2)
    rows += [(i, "zeta omega kappa") for i in rare] + [(held, "zeta omega kappa")]
    got = {r["doc_id"]: r for r in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}[held]
    # alone, each of three words of three occurrences has some 1.3e-6, and the end 2.5e-4
    assert got["train_tokens"] * 2e-6 > 3
    assert got["score"] > -9


def test_rare_languages_and_copies_train(spark):
    """A label of a tiny share is a language; copies leave no language short of texts."""
    english = [(f"the cat number {i} sat on the mat and looked at the dog", "en") for i in range(1500)]
    rare = [(f"ulkona sataa vettä ja tuuli puhaltaa kovaa, sanoi mies {'xyz'[i]}", "fi") for i in range(3)]
    copies = [("le chat est sur la table", "fr")] * 3000 + [(f"le chien de la rue {chr(97 + i // 26)}{chr(97 + i % 26)} mange une pomme", "fr") for i in range(60)]
    labelled = spark.createDataFrame(english + rare + copies, "text string, lang string")
    names, texts = langid.training_texts(labelled, 20)
    assert names == ["en", "fi", "fr"]
    assert {r["lang"]: r["count"] for r in texts.groupBy("lang").count().collect()} == {"en": 20, "fi": 3, "fr": 20}
    pages = spark.createDataFrame([(1, None, "<p>tuuli puhaltaa ja sataa vettä</p>"), (2, None, "<p>the dog sat on the mat</p>")], "page_id long, url string, html string")
    assert {r["page_id"]: r["text_lang"] for r in langid.identify_pages(pages, labelled, 20).collect()} == {1: "fi", 2: "en"}


def test_texts_in_no_language_go(spark):
    """Another script and gibberish are rejected, whatever they declare; other texts stay."""
    rng = random.Random(3)
    words = "the cat dog house river stone under over walked looked small green morning evening water bread".split()
    rows = [(i, " ".join(rng.choices(words, k=30)), "en", "a") for i in range(400)]
    planted = [(1000, "сегодня утром мы пошли на рынок и купили хлеб", "en", "a"), (1001, " ".join("".join(rng.choices("bcdfghjklmnpqrstvwxz", k=7)) for _ in range(30)), "en", "a")]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = langid.train_text(labelled)
    docs = [(d, t, "en", "com", "h") for d, t, *_ in rows + planted]
    measured = langid.text_evidence(spark.createDataFrame(docs, "doc_id long, text string, declared string, suffix string, host string"), model)
    gone = {r["doc_id"] for r in langid.fuse(measured, model).where("not accepted").collect()}
    assert gone == {1000, 1001}


def test_many_hosts_give_the_same_languages(spark, monkeypatch):
    """Beyond the bound of a broadcast, hosts of very many rows are split and rows without one stay where they are."""
    from lawframe.llm import common

    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    odd = spark.createDataFrame([(-1, None, None), (-2, "no host", "<p>the and of</p>"), (-3, "http://new.example.zz/", None)], "page_id long, url string, html string")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang")
    read = lambda: sorted(map(str, langid.identify_pages(pages.unionByName(odd), docs).collect()))
    want = read()
    for module in (langid, common):
        monkeypatch.setattr(module, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    monkeypatch.setattr(common, "HOT_SHARE", 50)
    assert read() == want


def test_more_labels_than_a_model_holds_are_an_error(spark):
    labelled = spark.createDataFrame([(f"some text {i}", f"l{i}") for i in range(5)], "text string, lang string")
    with pytest.raises(ValueError, match="5 labels are more than 4"):
        langid.train_text(labelled, most_languages=4)
