"""SimHash groups, centroid clusters and spelling variants against brute force."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
import xxhash

from quern.llm import centroids, queries, simhash, spelling

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def fingerprint(text):
    w = WORD.findall(lowered(text))
    said = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in said]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(keys, linked):
    up = list(range(len(keys)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            if linked(keys[i], keys[j]):
                up[root(i)] = root(j)
    return [root(i) for i in range(len(keys))]


def texts():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghé") for _ in range(rng.randrange(2, 7)))
    made = [" ".join(word() for _ in range(rng.choice([1, 2, 3, 40, 200]))) for _ in range(60)]
    base = [word() for _ in range(400)]
    for _ in range(60):
        t = list(base)
        for _ in range(rng.randrange(12)):
            t[rng.randrange(len(t))] = word()
        made.append(" ".join(t))
    rows = list(enumerate(made)) + [(500, None), (501, ""), (502, " \n\t"), (503, "A b"), (504, "a  B"), (505, "x " * 30_000), (3, made[3]), (None, made[70]), (None, "only here " + word()), (700, made[4].upper())]
    return [(i, t, "k", 1) for i, t in rows]


@pytest.mark.parametrize("block", [4, 1024])
def test_simhash_groups(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component int").repartition(5)
    prints = [fingerprint(t) for _, t, _, _ in rows]
    group = grouped(prints, lambda x, y: (x ^ y).bit_count() <= 3)
    least = {}
    for (d, *_), g in zip(rows, group, strict=True):
        if d is not None:
            least[g] = min(least.get(g, d), d)
    want = Counter((d, p, least.get(g)) for (d, *_), p, g in zip(rows, prints, group, strict=True))
    got = Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    assert not simhash.near_duplicates(docs.limit(0)).collect()


@pytest.mark.parametrize("block", [8, 64])
def test_sweeps_lose_no_link(spark, monkeypatch, block):
    """Random fingerprints with chains and dense heaps of near ones, in buckets small and large."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(5)
    flipped = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(64), n))
    made = [rng.getrandbits(64) for _ in range(100)]
    made += [flipped(made[0], rng.randrange(7)) for _ in range(300)]
    for n in (1, 2, 3, 3, 4, 3, 2, 5) * 12:
        made.append(flipped(made[-1], n))
    monkeypatch.setattr(simhash, "fingerprints", None)  # fingerprints are given here
    rows = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(made)], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "_described", lambda n: (lambda batches: (b for b in batches)))
    docs = rows.selectExpr("doc_id", "cast(fp as string) as text")
    real = simhash.written
    monkeypatch.setattr(simhash, "written", lambda df, name, **o: real(rows, name) if name == "fingerprints" else real(df, name, **o))
    group = grouped(made, lambda x, y: (x ^ y).bit_count() <= 3)
    least = {}
    for i, g in enumerate(group):
        least[g] = min(least.get(g, i), i)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: least[g] for i, g in enumerate(group)}


def test_five_spans_meet_every_pair():
    rng = random.Random(6)
    masks = simhash._masks()
    assert len(masks) == 10
    for _ in range(2000):
        x = rng.getrandbits(64)
        y = x ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4)))
        assert any(x & m == y & m for m in masks)


def lloyd(vectors, k, rounds, salt="3"):
    order = sorted(range(len(vectors)), key=lambda i: (vectors[i][0] is None, hashlib.sha256(f"{salt}:{vectors[i][0]}".encode()).hexdigest(), vectors[i][1]))
    at = [list(vectors[i][1]) for i in order[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), n) for n, c in enumerate(at))
    for _ in range(rounds):
        own = [near(x)[1] for _, x in vectors]
        at = [[sum(col) // len(mine) for col in zip(*mine, strict=True)] if (mine := [x for (_, x), o in zip(vectors, own, strict=True) if o == n]) else c for n, c in enumerate(at)]
    return [near(x) for _, x in vectors], at


def vector_rows(n=400, dim=64):
    rng = np.random.default_rng(12)
    x = 3 * rng.normal(size=(9, dim))[rng.integers(0, 9, n)] + rng.normal(size=(n, dim)) * rng.uniform(0.1, 2, (n, 1))
    made = [(i, [float(v) for v in np.float32(row)]) for i, row in enumerate(x)]
    made += [made[3], made[3], (900, [0.0] * dim), (901, [0.0] * dim), (None, made[5][1]), (902, made[7][1])]
    odd = [(910, None), (911, []), (912, [1.0] * (dim - 1)), (913, [float("nan")] + [0.0] * (dim - 1)), (914, [None] + [0.0] * (dim - 1)), (915, [float("inf")] * dim)]
    return made, odd


@pytest.mark.parametrize(("n", "parts"), [(400, 1), (400, 7), (3, 2)])
def test_clusters(spark, n, parts):
    made, odd = vector_rows()
    made = made[:n]
    rows = spark.createDataFrame([(*r, "c") for r in made + odd], "vec_id long, embedding array<float>, cluster string").repartition(parts)
    vectors = [(i, [math.floor(1024 * v) for v in e]) for i, e in made]
    found, at = lloyd(vectors, 8, 10)
    within = Counter()
    for d, c in found:
        within[c] += d
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    want = Counter((i, c, d, within[c], sum(within.values()), name[c]) for (i, _), (d, c) in zip(vectors, found, strict=True))
    assert Counter(tuple(r) for r in centroids.clustered(rows).collect()) == want


def test_clusters_of_nothing_and_of_too_much(spark):
    made, odd = vector_rows()
    rows = spark.createDataFrame(odd, "vec_id long, embedding array<float>")
    none = centroids.clustered(rows)
    assert none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and not none.collect()
    with pytest.raises(Exception, match="beyond"):
        centroids.clustered(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<float>")).collect()


def test_annuli_are_exact_and_pass_few():
    rng = np.random.default_rng(2)
    at = rng.integers(-50, 50, (40, 6)) * np.linspace(1, 60, 40, dtype=np.int64)[:, None]
    at[7] = at[3]
    x = np.concatenate([at[rng.integers(0, 40, 3000)] + rng.integers(-9, 9, (3000, 6)), at, np.zeros((1, 6), np.int64)])
    who, best, done = centroids.Annuli(at).nearest(x)
    d = ((x[:, None] - at[None]) ** 2).sum(axis=2)
    assert (best == d.min(axis=1)).all() and (who == d.argmin(axis=1)).all()
    assert done < 0.4 * d.size


def near_words(words):
    def near(x, y):
        if abs(len(x) - len(y)) > 1 or x == y:
            return False
        if len(x) == len(y):
            return sum(a != b for a, b in zip(x, y, strict=True)) == 1
        x, y = sorted((x, y), key=len)
        return any(y[:i] + y[i + 1 :] == x for i in range(len(y)))

    out = {}
    for w, n in words.items():
        mine = sorted((-m, v) for v, m in words.items() if near(w, v))
        form = mine[0][1] if mine and -mine[0][0] >= 2 * n else None
        out[w] = (form, n, len(mine), words[form] if form else None)
    return out


def want_variants(rows):
    counts = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lowered(run)
            h = crc32(f"{'' if d is None else d}:{run}".encode())
            counts[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = near_words({w: n for w, n in counts.items() if len(w) >= 5 and n >= 3})
    want = {}
    for w, (form, n, number, form_n) in words.items():
        root = w
        while words[root][0]:
            root = words[root][0]
        want[w] = (form, root, n, number, form_n)
    return want


def spelt():
    rng = random.Random(13)
    stem = lambda: "".join(rng.choice("abÀéÿz") for _ in range(rng.randrange(4, 8)))
    words = [stem() for _ in range(250)]
    for w in list(words):
        i = rng.randrange(len(w))
        words += [w[:i] + w[i + 1 :], w[:i] + rng.choice("abé") + w[i:]]
    weight = [1 / (1 + i % 40) for i in range(len(words))]
    rows = [(d, rng.choice([" ", "-", "1", "漢", "\n"]).join(w.upper() if rng.random() < 0.1 and w.isascii() else w for w in rng.choices(words, weight, k=400))) for d in range(40)]
    return rows + [(100, None), (101, ""), (None, rows[0][1]), (3, rows[3][1]), (102, "aaaaa aaaaaa aaaaaaa aaaaa " * 5), (103, "z" * 3_000_000 + " zzzzz" * 4)]


@pytest.mark.parametrize(("shard", "wave"), [(1 << 15, 16 << 20), (40, 16 << 20), (7, 900)])
def test_variants(spark, monkeypatch, shard, wave):
    monkeypatch.setattr(spelling, "SHARD", shard)
    monkeypatch.setattr(spelling, "WAVE_BYTES", wave)
    monkeypatch.setattr(spelling, "HELD", 100)
    rows = spelt()
    docs = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(4)
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(docs).collect()}
    assert got == want_variants(rows)
    assert any(x[0] and x[1] != x[0] for x in got.values())  # some chain is longer than one


def test_variants_of_nothing(spark):
    docs = spark.createDataFrame([(1, None), (2, "so few")], "doc_id long, text string")
    assert not spelling.variants(docs).collect()
    lone = spark.createDataFrame([(1, "lonely lonely lonely")], "doc_id long, text string")
    assert [tuple(r) for r in spelling.variants(lone).select("word", "form", "root", "n", "n_near", "form_n").collect()] == [("lonely", None, "lonely", 3, 0, None)]


def test_tries_emit_each_near_word_once():
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))) for _ in range(200)})
    trie = spelling.Trie(spelling.packed([w.encode() for w in words], list(range(1, len(words) + 1))))
    everything = near_words({w: i for i, w in enumerate(words, 1)})
    for w in words:
        got = [x for x, _ in trie.near(w.encode(), 0)]
        assert len(got) == len(set(got)) == everything[w][2]


@pytest.mark.parametrize("name", ["op11_simhash_near_dedup", "op13_spelling_variants"])
def test_registered_queries(spark, name):
    """The queries over the smallest tables against plain loops."""
    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES[name](spark, folder).collect()
    if name.startswith("op13"):
        assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == want_variants(rows)
        return
    prints = [fingerprint(t) for _, t in rows]
    group = grouped(prints, lambda x, y: (x ^ y).bit_count() <= 3)
    least = {g: min(d for (d, _), h in zip(rows, group, strict=True) if h == g) for g in set(group)}
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == Counter((d, f"{p:016x}", least[g]) for (d, _), p, g in zip(rows, prints, group, strict=True))
