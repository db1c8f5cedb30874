"""The pipeline's stages one by one against brute force on what the stage before kept."""

import random
import re
from collections import Counter

import corpus_pipeline
from quern.llm import quality
from quern.llm._scratch import written

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7)))
    passage = [word() for _ in range(55)]
    out = []
    for i in range(120):
        t = [word() for _ in range(rng.randrange(40, 90))]
        if i % 10 == 1:
            t = t[:20] + passage + t[20:]
        if i % 12 == 5:
            t = [w.upper() + "!! $$$" for w in t]
        out.append([i, " ".join(t)])
    out[7][1] = out[3][1] + " tail"
    out[8][1] = out[3][1]
    return [(i, t, "en", "big" if i % 3 else "small", len(t)) for i, t in out] + [(500, None, None, None, None), (501, "", "en", "big", 0)]


def shingles(text):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_stages(spark, tmp_path):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 12 != 5), 0) for i in range(120)], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, str(tmp_path)), "stage")
        kept.append(docs.collect())
        if len(kept) < 5:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    first, near, cut, mixed, last = kept
    start = spark.read.parquet(f"{tmp_path}/documents.parquet")
    net = quality.fitted(start, labels)
    assert {r["doc_id"] for r in first} == {r["doc_id"] for r in quality.scored(start, net).collect() if r["_score"] >= 0.5}
    assert sum(r["doc_id"] % 12 == 5 for r in first) <= 2 and sum(r["doc_id"] < 120 and r["doc_id"] % 12 != 5 for r in first) >= 100

    sets = sorted((r["doc_id"], shingles(r["text"])) for r in first)
    up = {i: i for i, _ in sets}
    for i, a in sets:
        for j, b in sets:
            if j < i and a and b and 100 * len(a & b) >= 75 * len(a | b):
                p, q = sorted((up[i], up[j]))
                up = {k: p if v == q else v for k, v in up.items()}
    assert {r["doc_id"] for r in near} == {i for i in up if up[i] == i}

    words = {r["doc_id"]: WORD.findall(r["text"] or "") for r in near}
    seen = Counter(tuple(w[i : i + 35]) for w in words.values() for i in range(len(w) - 34))
    text = {r["doc_id"]: r["text"] for r in near}
    want = {}
    for d, w in words.items():
        gone = {k for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for k in range(i, i + 35)}
        if not gone:
            want[d] = text[d]
        elif len(gone) < len(w):
            want[d] = " ".join(x for i, x in enumerate(w) if i not in gone)
    assert {r["doc_id"]: r["text"] for r in cut} == want and want != text
    assert all(r["n_chars"] in (len(r["text"] or ""), None) for r in cut)

    times = Counter(r["doc_id"] for r in mixed)
    assert set(times) == {d for d, t in want.items() if WORD.findall(t or "")} and max(times.values()) == 2
    size = Counter()
    for r in mixed:
        size[r["source"]] += len(WORD.findall(r["text"]))
    once = Counter()
    for r in cut:
        once[r["source"]] += len(WORD.findall(r["text"] or ""))
    assert size["big"] == once["big"] and abs(size["small"] - 1.5 * once["small"]) < 200
    assert sorted(r["doc_id"] for r in last) == sorted(times.elements()) and all(r["round_trip"] for r in last)
