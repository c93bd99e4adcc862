"""Spelling variants, the trie of conversations and document quality."""

import collections
import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest
from helpers import SF
from pyspark.sql import functions as F

from lawframe.llm import prefix_trie, quality, registry, spelling


def _near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def test_last_column_is_that_of_sorted_suffixes():
    for words in (["a"], ["ab", "b"], ["aab", "ab", "abab", "b", "ba"]):
        words = sorted(words)
        text = "".join(w + "$" for w in words)
        ends = [i for i, c in enumerate(text) if c == "$"]
        # a delimiter sorts before all letters, and delimiters by their word
        key = lambda i: [(0, ends.index(j)) if text[j] == "$" else (1, ord(text[j])) for j in range(i, next(e for e in ends if e >= i) + 1)]  # noqa: E731, B023
        order = sorted(range(len(text)), key=key)
        want = [0 if i == 0 or text[i - 1] == "$" else ord(text[i - 1]) for i in order]
        assert spelling.burrows_wheeler([np.frombuffer(w.encode(), dtype=np.uint8).astype(np.int64) for w in words]).tolist() == want


@pytest.mark.parametrize("letters", [b"ab", b"ab\xe9", b"abcde"])
@pytest.mark.parametrize("half", [lambda m: m // 2, lambda m: (m + 1) // 2])
def test_search_finds_what_differs_after_the_exact_half(letters, half):
    draw = random.Random(7)
    words = sorted({bytes(draw.choice(letters) for _ in range(draw.randint(5, 9))) for _ in range(150)})
    held = words[::2]
    index = spelling.BidirectionalIndex(held, b"".join(words) + b"z")
    asked = [*words, b"zzzzzz", b"a" * 300]
    found = set()
    for places, hits in index.near(asked, [half(len(w)) for w in asked]):
        found |= {(asked[p], w) for p, w in zip(places.tolist(), hits, strict=True)}
    assert found == {(a, b) for a in asked for b in held if _near(a, b) and a[: half(len(a))] == b[: half(len(a))]}


def _brute_variants(rows):
    counts = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in words if _near(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return out


@pytest.fixture(scope="module")
def spelled(spark):
    draw = random.Random(3)
    base = ["colour", "flavour", "étoilée", "aaaaaaaa", "banana", "ÀÉÎÕÚ", "straße", "x" * 3000]
    words = []
    for w in base:
        for _ in range(40):
            v = w
            for _ in range(draw.choice([0, 0, 1, 1, 2])):
                at = draw.randrange(len(v))
                v = draw.choice([v[:at] + v[at + 1 :], v[:at] + draw.choice("aboé") + v[at:], v[:at] + draw.choice("aboü") + v[at + 1 :]])
            words += [v] * draw.choice([1, 3, 4, 8, 20])
    draw.shuffle(words)
    rows = [(i, " ".join(words[i::60]) + ", ā中 Colour_colour×") for i in range(60)]
    rows += [(1, None), (2, ""), (None, "colour colour colour"), (3, " \n"), (5, rows[5][1]), (5, rows[5][1])]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("n", "word", "near", "key", "part", "shard", "root")})


@pytest.mark.parametrize("symbols", [64, 1 << 18])
def test_variants_against_brute_force(spelled, symbols):
    rows, frame = spelled
    found = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(frame, symbols=symbols).collect()}
    want = _brute_variants(rows)
    assert found == want and any(f and f != r for f, r, *_ in want.values())


def test_variants_of_odd_rows(docs, no_docs):
    found = {r["word"] for r in spelling.variants(docs, least_count=1).collect()}
    assert "straße" in found and spelling.variants(no_docs).count() == 0


def _brute_trie(rows):
    empty = lambda s: s or ""
    own = collections.defaultdict(list)
    for c, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, empty(r[2]), empty(r[3]))):
        if c is not None:
            own[c].append((empty(role), empty(text)))
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - int(np.fmod(c, 5)), [])[:h] + turns[h:]
    nodes = collections.defaultdict(list)
    for c, turns in sorted(built.items()):
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    kids = collections.Counter(p[:-1] for p in nodes if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(members) - 1) * len(p[-1][1].encode()) if p else 0
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return sorted(
        (m[0], len(p), nodes[p[:-1]][0] if p else -1, len(m), kids[p], leaves[p], saved[p], sha([c for c in m if len(built[c]) == len(p)])) for p, m in nodes.items()
    )


@pytest.fixture(scope="module")
def talks(spark):
    draw = random.Random(5)
    rows = []
    for c in range(-12, 160):
        for t in range(draw.randint(1, 11)):
            rows.append((c, draw.choice([t, t, 3]), draw.choice(["user", "assistant", None]), draw.choice(["hi", "hi", "hé", "", None, "yes :1"])))
    rows += [(500, t, "user", f"turn {t // 2}") for t in range(120)] + [(505, t, "user", f"turn {t // 2}") for t in range(120)] + [(501, t, "user", f"turn {t}") for t in range(90)]
    # one conversation many times over, whose members fill several id ranges
    rows += [(c, t, "user", f"same {t}") for c in range(10_000, 10_400) for t in range(3)]
    rows += [(None, 1, "user", "nobody"), (7, None, "user", "first"), (7, None, "user", "first"), (900, 1, None, None), (901, 1, "user", "x" * 100_000)]
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


@pytest.mark.parametrize(("width", "run", "span"), [(3, 2, 16), (8, 4096, 4096)])
def test_trie_against_brute_force(talks, monkeypatch, width, run, span):
    rows, frame = talks
    monkeypatch.setattr(prefix_trie, "RUN", run)
    for name, value in (("blocks", (width, run)), ("ends", (span,))):
        monkeypatch.setattr(getattr(prefix_trie, name), "__defaults__", value)
    odd = frame.withColumns({c: F.lit(1) for c in ("c", "place", "key", "block", "t1", "x1", "gid", "weight", "range")})
    found = prefix_trie.prefix_trie(odd, width=width).collect()
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    assert sorted(tuple(-1 if r[n] is None else r[n] for n in names) for r in found) == _brute_trie(rows)


def test_trie_of_nothing(talks):
    _, frame = talks
    assert prefix_trie.prefix_trie(frame.limit(0)).count() == 0
    assert prefix_trie.prefix_trie(frame.where("conv_id is null")).count() == 0


def test_passages_are_of_the_whole_text():
    raw = " ".join(f"word{i}" for i in range(1000)).encode()
    assert quality.encode(raw).shape == (16, quality.FEATURES)
    for odd in (b"", b"  \n", b"x", "中文 \u0000".encode(), b"a" * 100_000):
        found = quality.encode(odd)
        assert found.shape == (1, quality.FEATURES) and np.isfinite(found).all()
    assert b"".join(quality.parts_of(raw, 100)) == raw and list(quality.parts_of(b"", 9)) == [b""]


def _toy(n, seed):
    """Bags of which one passage tells the label."""
    draw = np.random.default_rng(seed)
    y = draw.integers(0, 2, n)
    bags = [draw.normal(0, 1, (draw.integers(1, 9), 12)).astype(np.float32) for _ in range(n)]
    for bag, label in zip(bags, y, strict=True):
        bag[draw.integers(len(bag)), :3] = [6, 6 if label else -6, 6]
    return bags, y.astype(float)


def test_slopes_are_those_of_the_loss():
    bags, y = _toy(20, 1)
    x = np.concatenate(bags).astype(float)
    first = np.concatenate([[0], np.cumsum([len(b) for b in bags])[:-1]])
    draw = np.random.default_rng(2)
    w = {k: draw.normal(0, 0.5, s) for k, s in {"V": (12, 4), "U": (12, 4), "H": (12, 4), "w": 4, "c": 4, "v": 4, "u": 4, "h": 4, "b": 1}.items()}
    _, slopes = quality.loss_and_slopes(w, x, first, y, 1e-3)
    for k, a in w.items():
        for at in list(np.ndindex(a.shape))[:6]:
            sides = []
            for move in (1e-5, -1e-5):
                moved = {**w, k: a.copy()}
                moved[k][at] += move
                sides.append(quality.loss_and_slopes(moved, x, first, y, 1e-3)[0])
            assert slopes[k][at] == pytest.approx((sides[0] - sides[1]) / 2e-5, abs=1e-6)


def test_attention_finds_the_passage_that_tells():
    bags, y = _toy(400, 3)
    model = quality.fit(bags, y)
    others, labels = _toy(200, 4)
    right = told = 0
    for bag, label in zip(others, labels, strict=True):
        e, h = model.parts(bag)
        a = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
        p = 1 / (1 + np.exp(-(a @ h @ model.weights["c"] + model.weights["b"][0])))
        right += (p >= 0.5) == label
        told += int(np.argmax(a)) == int(np.argmax(bag[:, 0] + bag[:, 2]))
    assert right >= 190 and told >= 120


def test_scores_don_t_depend_on_batches(monkeypatch):
    texts = [" ".join(f"w{i % k} AND" for i in range(n)).encode() for k, n in ((3, 10), (50, 4000), (7, 900))] + [b""]
    model = quality.fit([quality.encode(t) for t in texts], np.array([0.0, 1, 0, 1]), steps=20)
    for raw, found in zip(texts, model.scores(texts), strict=True):
        e, h = model.parts(quality.encode(raw))
        a = np.exp(e - e.max())
        assert found == pytest.approx(1 / (1 + np.exp(-(a @ h / a.sum() @ model.weights["c"] + model.weights["b"][0]))), rel=1e-5)
    monkeypatch.setattr(quality, "PART_BYTES", 2000)
    assert np.isfinite(model.scores(texts)).all()


def test_quality_of_odd_rows(spark, docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (4, 0), (5, 1), (9, 1), (7, None), (None, 1), (6, 5)], "doc_id long, quality int")
    model = quality.train(docs, labels, steps=5)
    rows = quality.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows if r["doc_id"] is not None)
    assert len({r["score"] for r in rows if r["doc_id"] == 7}) == 1
    assert quality.score(no_docs, model).count() == 0
    assert quality.train(docs, labels.limit(0)) == 0.5 and quality.train(no_docs, labels) == 0.5
    assert quality.train(docs, labels.where("quality = 1")) == 1.0
    assert {r["score"] for r in quality.score(docs, 0.5).collect()} == {0.5}


def test_quality_of_held_out_documents(spark):
    sf = SF.replace("0.001", "0.01")
    found = registry.op13_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").select("quality", "score", "predicted").collect()
    good, bad = ([r for r in found if r["quality"] == k] for k in (1, 0))
    area = np.mean([(g["score"] > b["score"]) + 0.5 * (g["score"] == b["score"]) for g in good for b in bad])
    assert area >= 0.97 and np.mean([r["predicted"] for r in good]) >= 0.97 and np.mean([r["predicted"] for r in bad]) <= 0.2, json.dumps([area, len(good), len(bad)])
