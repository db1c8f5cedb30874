import gc
import math
import random
from array import array
from hashlib import sha256

import pytest

from quern.llm.nbest import Segmenter, far_search, search
from quern.llm.piece_model import MODEL, UNIT, piece_model, uncollected
from quern.llm.token_counts import Trie


def ways(model, text):
    """Every segmentation, by brute force."""
    if not text:
        return [(0.0, ())]
    out = []
    for k in range(1, len(text) + 1):
        e = model.edge(text[:k])
        if e:
            out += [(e[0] + s, e[1] + ids) for s, ids in ways(model, text[k:])]
    return out


TEXTS = ["", " ", "the thing", "Über straße\n\n  x", "a  b   c ", "▁x ▁", "emoji \U0001f600!", "thtion, onble.", "...", "\t\x00 q"]


def test_nbest_is_every_way_sorted():
    model = piece_model(MODEL)
    for text in [t[:12] for t in TEXTS]:
        text = " " + text
        want = sorted((s for s, _ in ways(model, text)), reverse=True)[:4]
        assert [s for s, _ in search(model, text, 4)] == pytest.approx(want)
        assert far_search(model, text, 4) == search(model, text, 4)
        seg = Segmenter(model, 4)
        got = seg.nbest(text[1:])
        assert [s for s, _ in got] == pytest.approx(want)
        assert len({tuple(ids) for _, ids in got}) == len(got)
        assert all(model.decode(ids) == text[1:] for _, ids in got)


def test_units_cover_the_text():
    rng = random.Random(1)
    for _ in range(100):
        t = " " + "".join(rng.choice(" ab\n") for _ in range(20))
        assert "".join(UNIT.findall(t)) == t
    model = piece_model(MODEL)
    for _ in range(300):
        t = " " + "".join(rng.choice(" ab\n.,$%-'é") for _ in range(20))
        units = model.unit.findall(t)
        assert "".join(units) == t
        # a cut is only made where segments are cut too
        assert [x for u in units for x in model.segments(u)] == model.segments(t)


def test_trie_agrees_with_the_lattice(monkeypatch):
    model = piece_model(MODEL)
    trie, seg = Trie(model), Segmenter(model, 1)
    for text in TEXTS:
        for unit in UNIT.findall(" " + text):
            node, code = trie[unit], seg[unit]
            assert trie.score[node] == pytest.approx(seg.best[code])
            assert trie.count[node] <= seg.size[code]
            two = search(model, unit, 2)
            assert seg.best[code] == pytest.approx(two[0][0]) and seg.gap[code] == pytest.approx(two[0][0] - two[1][0] if len(two) > 1 else math.inf)
            every = ways(model, unit[:14])
            assert trie.count[trie[unit[:14]]] in {len(i) for s, i in every if s == pytest.approx(max(s for s, _ in every))}


def test_operators(spark):
    from quern.llm.nbest import encoded
    from quern.llm.token_counts import token_counts

    rows = [(i, t, "x") for i, t in enumerate([*TEXTS, None, "word " * 5000])] + [(None, "tail", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars string")
    got = encoded(docs).collect()
    assert len(got) == len(rows) and all(r["round_trip"] and r["n_pieces"] == len(r["ids"]) and r["score"] == r["nbest"][0] for r in got)
    counts = {r["doc_id"]: r for r in token_counts(docs).collect()}
    assert len(counts) == len(rows)
    assert all(counts[r["doc_id"]]["score"] == pytest.approx(r["score"]) for r in got)
    assert not token_counts(docs.limit(0)).collect() and not encoded(docs.limit(0)).collect()
    with pytest.raises(ValueError):
        encoded(docs.withColumnRenamed("n_chars", "ids"))


def test_every_segmentation_is_returned(spark):
    from quern.llm.nbest import encoded

    model, seg = piece_model(MODEL), Segmenter(piece_model(MODEL), 4)
    texts = [*TEXTS, "", None, "word " * 50, "x" * 40 + " \u00e9\u2603"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    thin = {r["doc_id"]: r for r in encoded(docs, ids=False).collect()}
    for r in encoded(docs).collect():
        text = r["text"] or ""
        assert r["nbest_ids"] == [ids for _, ids in seg.nbest(text)] and len(r["nbest_ids"]) == len(r["nbest"]) and r["nbest_ids"][0] == r["ids"]
        assert r["round_trip"] and all(model.decode(ids) == text for ids in r["nbest_ids"])
        assert thin[r["doc_id"]]["nbest_sha256"] == [sha256(array("i", ids).tobytes()).hexdigest() for ids in r["nbest_ids"]]
        assert thin[r["doc_id"]]["ids_sha256"] == thin[r["doc_id"]]["nbest_sha256"][0] and thin[r["doc_id"]]["round_trip"]


def test_scores_are_log_probabilities():
    model = piece_model(MODEL)
    assert sum(math.exp(s) for s in model.score.values() if s > -1e8) == pytest.approx(1)


def test_long_units_are_bounded(spark, monkeypatch):
    from quern.llm import nbest, token_counts

    rng = random.Random(4)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000))
    model = piece_model(MODEL)
    short = " " + text[:1500]
    whole, alone = Trie(model), Trie(model)
    monkeypatch.setattr(token_counts, "LONG", 5000)
    a = whole[short]
    monkeypatch.setattr(token_counts, "LONG", 100)
    b = alone[short]
    assert (whole.score[a], whole.count[a]) == (alone.score[b], alone.count[b]) and not alone.child and not alone
    assert far_search(model, short, 4) == search(model, short, 4)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (r,), (c,) = nbest.encoded(docs, n=3).collect(), token_counts.token_counts(docs).collect()
    assert r["round_trip"] and len(r["nbest_ids"]) == 3 and c["score"] == pytest.approx(r["score"]) and c["n_tokens"] <= r["n_pieces"]


def test_the_collector_is_as_before():
    with uncollected():
        assert not gc.isenabled()
    assert gc.isenabled()
