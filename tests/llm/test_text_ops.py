"""Near-duplicates, passages, the classifier and the language model against brute force."""

import hashlib
import math
import pickle
import random
import re
from collections import Counter, defaultdict
from math import log10
from uuid import uuid4
from zlib import crc32

import numpy as np
import pytest

from quern.llm import lm, minhash, mixing, passages, quality
from quern.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=1, n=60):
    """Random texts with copies, near copies, shared passages and odd rows."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "and", "Über"]) if rng.random() < 0.2 else "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 6)))
    texts = [[word() for _ in range(rng.choice([1, 3, 5, 40, 120]))] for _ in range(n)]
    passage = [word() for _ in range(60)]
    for i in range(0, n, 6):
        texts[i] = texts[i][:50] + passage[rng.randrange(10) : rng.randrange(45, 60)] + texts[i][50:]
    base = [word() for _ in range(150)]
    for _ in range(25):
        t = list(base)
        for _ in range(rng.randrange(8)):
            t[rng.randrange(len(t))] = word()
        texts.append(t)
    texts += [["x"] * 100, ["x"] * 30, base, base[:40] + base[:40]]
    rows = [(i, rng.choice([" ", "\n", "  "]).join(t)) for i, t in enumerate(texts)]
    rows += [(1000, None), (1001, ""), (1002, " \n"), (5, rows[5][1]), (None, rows[7][1]), (None, "lone words here only once"), (1003, rows[8][1])]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "a" if i and i % 3 else None, len(t or "")) for i, t in corpus()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)


def shingle_set(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_near_duplicates(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    want = Counter((d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows))
    got = minhash.near_duplicates(docs).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    kept = minhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(map(str, ids)) == sorted(str(d) for d in {(d, c) for d, _, c in want if d == c} for d in [d[0]])
    assert not minhash.near_duplicates(docs.limit(0)).collect()


def test_one_of_each_group_stays_whatever_its_ids(spark):
    words = lambda a: " ".join(f"{a}{i}" for i in range(60))
    near = lambda a: [words(a) + f" tail{i}" for i in range(3)]
    rows = [(None, t) for t in near("null")] + [(7, t) for t in near("same")] + [(7, words("other")), (None, words("lone")), (None, words("lone"))]
    rows += [(9, near("mixed")[0]), (None, near("mixed")[1]), (3, ""), (4, None), (4, None)]
    kept = minhash.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = Counter((r["doc_id"], (r["text"] or "").split("0")[0]) for r in kept)
    assert got == Counter([(None, "null"), (7, "same"), (7, "other"), (None, "lone"), (9, "mixed"), (3, ""), (4, "")])


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = defaultdict(set)
    for a, b in edges:
        if a is not None and a != b:
            near[a].add(b)
            near[b].add(a)
    for a in near:
        seen, todo = {a}, [a]
        while todo:
            for b in near[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        assert got[a] == min(seen)
    assert set(got) == set(near)
    assert not components(spark.createDataFrame([], "a long, b long")).collect()


def brute_repeats(rows, k):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i : i + k])] > 1:
                gone.update(range(i, i + k))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("window", [35, 7])
def test_repeated_passages(docs, window):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = passages.without_repeats(docs, window)
    assert got.columns == [*docs.columns, "n_words", "n_removed", "kept_words"]
    found = Counter((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept_words"].encode()).hexdigest()) for r in got.collect())
    assert found == brute_repeats(rows, window)
    assert sum(n for _, _, n, _ in found) > 0
    assert not passages.without_repeats(docs.limit(0), window).collect()


def test_bundles_do_not_matter(docs, monkeypatch):
    monkeypatch.setattr(passages, "BUNDLE_BYTES", 2000)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = Counter((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept_words"].encode()).hexdigest()) for r in passages.without_repeats(docs).collect())
    assert found == brute_repeats(rows, 35)


def test_network_gradients():
    net = quality.Network(filters=3, width=4)
    rng = np.random.default_rng(0)
    text = rng.integers(0, 256, 1700).astype(np.uint8)
    net.p = {k: x.astype(np.float64) for k, x in net.p.items()}
    net.p["bias"] += 0.3
    loss = lambda: -np.log(1 - net.score(text, np.array([0, len(text)]))[0])
    g = net.gradients(text, 0.0)
    for name, at in (("table", (1, int(text[900]), 2)), ("bias", 0), ("mean", 1), ("max", 2), ("out", 0)):
        net.p[name][at] += 1e-3
        up = loss()
        net.p[name][at] -= 2e-3
        down = loss()
        net.p[name][at] += 1e-3
        assert abs((up - down) / 2e-3 - g[name][at]) < 2e-3


def loop_score(net, text):
    """The network byte by byte: filters at every place, strides, chunks of two, mean and maximum."""
    table, wide = net.p["table"].astype(np.float64), net.width
    n = max(1, -(-(len(text) + wide - 1) // quality.STRIDE))
    code = list(text) + [quality.PAD] * (n * quality.STRIDE + wide)
    strides = []
    for k in range(n):
        best = [-math.inf] * net.filters
        for i in range(k * quality.STRIDE, (k + 1) * quality.STRIDE):
            here = sum(table[j, code[i + j]] for j in range(wide))
            best = [max(b, h) for b, h in zip(best, here.tolist(), strict=True)]
        strides.append([b + float(x) for b, x in zip(best, net.p["bias"], strict=True)])
    chunks = [[max(0.0, a, b) for a, b in zip(x, y, strict=True)] for x, y in (zip(strides, strides[1:], strict=False) if n > 1 else [(strides[0], strides[0])])]
    z = float(net.p["out"][0])
    for f in range(net.filters):
        values = [c[f] for c in chunks]
        z += sum(values) / len(values) * float(net.p["mean"][f]) + max(values) * float(net.p["max"][f])
    return 1 / (1 + math.exp(-z))


def test_quality_scores_are_those_of_a_plain_loop(spark):
    from quern.llm.queries import op5_quality_classifier

    folder = "/root/testdata/sf0.001"
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    net = quality.fitted(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    got = {r["doc_id"]: r for r in op5_quality_classifier(spark, folder).collect()}
    assert set(got) == set(rows)
    sizes = sorted(rows, key=lambda d: len((rows[d] or "").encode()))
    for d in sizes[:6] + sizes[:: len(sizes) // 8] + sizes[-2:]:
        assert abs(got[d]["score"] - loop_score(net, (rows[d] or "").encode())) < 1e-4
        assert got[d]["held_out"] == (crc32(str(d).encode()) % 3 == 1) and got[d]["predicted"] == int(got[d]["score"] >= 0.5)
    for size in (0, 1, 4, 507, 508, 509, 512, 1020, 1021, 1500):
        text = bytes(i * 7 % 251 for i in range(size))
        one = net.score(np.frombuffer(text, np.uint8), np.array([0, size]))[0]
        assert abs(one - loop_score(net, text)) < 1e-5


def test_quality_holds_out_and_scores_all(spark):
    rng = random.Random(2)
    good = lambda: " ".join("".join(rng.choice("aeinst") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(300)))
    rows = [(i, good() + (" buy!! $$$ NOW" * rng.randrange(3, 60) if i % 4 == 0 else "")) for i in range(240)] + [(900, None), (901, ""), (None, "some text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(240)] + [(3, None), (None, 1), (8, 7)], "doc_id long, quality int")
    net = quality.fitted(docs, labels)
    got = quality.scored(docs, net).collect()
    assert len(got) == len(rows) and all(0 <= r["_score"] <= 1 for r in got)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 240 and crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert sum((r["_score"] >= 0.5) == (r["doc_id"] % 4 != 0) for r in held) / len(held) > 0.93
    none = quality.fitted(docs, labels.where("quality = 1"))
    assert {r["_score"] for r in quality.scored(docs, none).collect()} == {1.0}


def test_quality_learns_from_long_texts(spark):
    rows = [(i, "fine words " * (5 + i % 7) if i % 3 else "buy!! $$$ NOW " * 2400) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    net = quality.fitted(docs, spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(30)], "doc_id long, quality int"))
    assert net.constant is None
    assert all((r["_score"] >= 0.5) == (r["doc_id"] % 3 != 0) for r in quality.scored(docs, net).collect())


def test_mixture(docs):
    tokens = [1000, 50, 9, 9]
    a = mixing.exponent_for(tokens, target_entropy=1.2)
    assert abs(mixing.entropy(mixing.weights(tokens, a)) - 1.2) < 1e-5
    a = mixing.exponent_for(tokens, repeats=3, budget=2000)
    w = mixing.weights(tokens, a)
    assert abs(max(x * 2000 / t for x, t in zip(w, tokens, strict=True)) - 3) < 1e-4
    with pytest.raises(ValueError):
        mixing.exponent_for(tokens, repeats=1.5, budget=2000)
    rows = mixing.mixture(docs, repeats=1.3, block_tokens=500).collect()
    count = Counter()
    for r in rows:
        count[r["source"]] += r["n_tokens"]
    own = Counter()
    for r in docs.collect():
        own[r["source"]] += len(WORD.findall(r["text"] or ""))
    assert set(count) == set(own)
    small, large = sorted(own, key=own.get)
    assert count[large] == own[large] and abs(count[small] - 1.3 * own[small]) <= 161
    blocks = defaultdict(list)
    for r in rows:
        blocks[r["block"]].append(r)
    for b in blocks.values():
        assert sorted(r["position"] for r in b) == list(range(1, len(b) + 1))
        assert sum(r["n_tokens"] for r in b) <= 500 + 2 * 161
    out = mixing.mixed(docs, repeats=1.3)
    assert out.columns == docs.columns and out.count() == len(rows)
    assert not mixing.mixture(docs.limit(0), repeats=1.3).collect()


def random_model(rng):
    m = lm.CLASSES * lm.MEMBERS
    classes = lm.Classes(rng.integers(0, 50, 4000), rng.random((lm.CLASSES * (lm.MEMBERS - 1), 6)))
    counts = lambda *s: (rng.random(s) < 0.01) * rng.integers(1, 9, s).astype(np.float32)
    return classes, lm.Attention(lm.Values(classes.share, counts(m, m), counts(lm.GROUPS, m, m // lm.FINE), counts(lm.REACH - 1, m // lm.FINE, m)))


def test_attention_gradients():
    rng = np.random.default_rng(1)
    classes, net = random_model(rng)
    assert np.bincount(classes.of // lm.MEMBERS, minlength=lm.CLASSES).max() < 80
    own = np.bincount(classes.of, np.exp(classes.within), lm.CLASSES * lm.MEMBERS)
    assert np.allclose(own[own > 0], 1)
    net.p = {k: x.astype(np.float64) for k, x in net.p.items()}
    seen, next_ = rng.integers(0, lm.CLASSES * lm.MEMBERS, (2, lm.WINDOW, 3))
    scored = rng.random((lm.WINDOW, 3)) < 0.7
    loss = lambda: -np.log(net.probability(seen, next_))[scored].sum() / scored.sum()
    g = net.gradients(seen, next_, scored)
    for k, x in net.p.items():
        at = (int(seen[3, 0]) // lm.MEMBERS, 2)[: x.ndim] if k != "distance" else (2,)
        x[at] += 1e-4
        up = loss()
        x[at] -= 2e-4
        down = loss()
        x[at] += 1e-4
        assert abs((up - down) / 2e-4 - g[k][at]) < 1e-5


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(2)
    classes, net = random_model(rng)
    m = lm.CLASSES * lm.MEMBERS
    seen = np.repeat(np.append(m, rng.integers(0, m, lm.WINDOW - 1))[:, None], m, axis=1)
    p = net.probability(seen, np.broadcast_to(np.arange(m), (lm.WINDOW, m)))
    assert np.allclose(p.sum(axis=1), 1, atol=1e-3)
    assert np.isclose(np.bincount(classes.of, np.exp(classes.within)).sum(), len(np.unique(classes.of)))


@pytest.mark.parametrize("most", [3, 1000])
def test_each_subword_is_scored_once_with_context(most):
    off = np.array([0, 1, 9, 200, 232, 300])
    found = []
    for _, _, index, scored in lm.windows(np.arange(300) % 7, off, most):
        place = np.broadcast_to(np.arange(lm.WINDOW)[:, None], index.shape)[scored]
        found += zip(place.tolist(), index[scored].tolist(), strict=True)
    assert sorted(i for _, i in found) == list(range(300))
    assert all(p >= min(lm.OVERLAP, i - off[np.searchsorted(off, i, "right") - 1]) for p, i in found)


def plain_score(members, classes, values, weights, ids):
    """The log10 probability of one text, subword by subword."""
    net = lm.Attention(values)
    net.load(weights)
    near, more, far = values.tables()
    mark, step, total = lm.CLASSES * lm.MEMBERS, lm.WINDOW - lm.OVERLAP, 0.0
    for i, m in enumerate(members):
        start = max(0, -(-(i - lm.WINDOW + 1) // step)) * step
        seen = [members[j - 1] if j else mark for j in range(i, start - 1, -1)]  # newest first
        weight = [np.exp(net.p["rest"][seen[0] // lm.MEMBERS])]
        value = [values.share[m]]
        for d, x in enumerate(seen):
            weight.append(np.exp(net.p["query"][seen[0] // lm.MEMBERS] @ net.p["key"][x // lm.MEMBERS] + net.p["distance"][d]))
            if x == mark:
                value.append(values.share[m])
            elif d:
                value.append(far[min(d, lm.REACH - 1) - 1][x // lm.FINE][m])
            else:
                group = seen[1] * lm.GROUPS // mark if len(seen) > 1 and seen[1] != mark else None
                value.append(near[x][m] * (1 if group is None else more[group][x][m // lm.FINE]))
        total += np.log10(np.dot(weight, value) / np.sum(weight)) + classes.within[ids[i]] / np.log(10)
    return total


def test_lm_score_is_that_of_a_plain_loop(docs, monkeypatch):
    given, make = {}, lm._scored_rows

    def kept(size, classes, shared, weights, *rest):
        given.update(classes=classes, values=pickle.loads(shared.sent.value), weights=weights)
        return make(size, classes, shared, weights, *rest)

    monkeypatch.setattr(lm, "_scored_rows", kept)
    got = {r["doc_id"]: r["score"] for r in lm.lm_scores(docs.where("doc_id < 12 or doc_id = 1001")).collect()}
    encoder = lm._encoder(lm.MODEL)
    for r in docs.where("doc_id < 12 or doc_id = 1001").collect():
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(r["text"])]
        ids = [i for w in words for i in encoder.sp.encode(w)] + [encoder.sp.eos_id()]
        want = plain_score(given["classes"].of[ids].tolist(), ids=ids, **given)
        assert r["doc_id"] == 5 or abs(got[r["doc_id"]] - want) < 1e-3 * max(1, -want)  # id 5 stands twice


def test_lm_scores(docs, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 20)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    held = lambda d: crc32(("" if d is None else str(d)).encode()) % 10 == 0
    tokens = lambda t: [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    c = Counter(x for d, t in rows if not held(d) for x in tokens(t))
    n, v = sum(c.values()), len(c)
    got = lm.lm_scores(docs).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for d, t in rows:
        x = tokens(t)
        by[d].append((held(d), len(x), sum(c[y] > 0 for y in x), n, round(sum(log10((c[y] + 0.1) / (n + 0.1 * (v + 1))) for y in x), 6)))
    for r in got:
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) in by[r["doc_id"]]
        assert r["score"] < 0
    assert len({round(r["score"], 3) for r in got if r["doc_id"] in (1000, 1001, 1002)}) == 1
    assert not lm.lm_scores(docs.limit(0)).collect()
    assert all(r["base_score"] == 0 for r in lm.lm_scores(docs.where("doc_id = 0")).collect() if held(0))


def test_lm_learns_from_every_text(spark, monkeypatch, tmp_path):
    docs = spark.range(9000).selectExpr("id as doc_id", "concat('a text of number ', id) as text")

    def counting(name):
        make = getattr(lm, name)

        def made(*given):
            run = make(*given)

            def counted(batches):
                for batch in batches:
                    (tmp_path / f"{name}-{uuid4().hex}").write_text(str(batch.num_rows))
                    yield batch

            return lambda batches: run(counted(batches))

        monkeypatch.setattr(lm, name, made)

    steps = ("_id_counts", "_company_counts", "_value_counts", "_slopes")
    for name in steps:
        counting(name)
    lm.lm_scores(docs)
    texts = sum(crc32(str(i).encode()) % 10 != 0 for i in range(9000))
    read = lambda name: sum(int(p.read_text()) for p in tmp_path.glob(name + "-*"))
    assert texts > 8000 and [read(name) for name in steps] == [texts, texts, texts, texts]


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_lm_scores_follow_from_the_texts(spark, parts):
    """However the table is dealt out, the scores are the same and better than the base on held-out texts."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(parts, "doc_id")
    got = lm.lm_scores(rows).select("doc_id", "held_out", "score", "base_score").toPandas().set_index("doc_id").sort_index()
    held = got[got["held_out"]]
    assert held["score"].sum() > held["base_score"].sum()
    before = SCORES.setdefault("first", got["score"])
    assert np.allclose(got["score"], before, rtol=1e-6, atol=0)


SCORES: dict = {}

