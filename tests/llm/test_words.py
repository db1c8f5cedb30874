import random
import re

import numpy as np
import pyarrow as pa

from quern.llm import _words
from quern.llm._words import Words, pieces, shingles

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def cases():
    rng = random.Random(4)
    texts = [None, "", " ", "\n\n", "a", " a ", "x\ty\x0bz", "Über ßtraße   ok ok", "end "]
    texts += ["".join(rng.choice("abcÄé \n\t") for _ in range(rng.randrange(60))) for _ in range(200)]
    return texts


def test_words_match_a_regex_whatever_the_slice():
    texts = cases()
    for column in (pa.array(texts), pa.array(["zz", *texts, None]).slice(1, len(texts))):
        for lower in (False, True):
            w = Words(column, lower)
            want = [WORD.findall((t or "").encode()) for t in texts]
            if lower:
                want = [[x.lower() for x in row] for row in want]
            got = [[w.span(i, i + 1) for i in range(w.first[k], w.first[k + 1])] for k in range(len(texts))]
            assert got == want
            assert [x.as_py() for x in w.strings()] == [x for row in want for x in row]
            assert [w.span(w.first[k], w.first[k + 1]) for k in range(len(texts))] == [b" ".join(r) for r in want]
            by = {}
            for h, x in zip(w.hashes().tolist(), (x for row in want for x in row), strict=True):
                assert by.setdefault(x, h) == h
            assert len(set(by.values())) == len(by)


def test_words_longer_than_a_block(monkeypatch):
    monkeypatch.setattr(_words, "_BLOCK", 16)
    monkeypatch.setattr(_words, "_POWER", [])
    text = "short " + "q" * 100 + " short " + "q" * 100 + " " + "r" * 99
    h = Words(pa.array([text])).hashes()
    assert h[0] == h[2] and h[1] == h[3] and h[4] not in h[:4]


def test_shingles_and_pieces():
    h = Words(pa.array(["a b c d e f a b c d e"])).hashes()
    s = shingles(h, 5)
    assert len(s) == 7 and s[0] == s[6] and len(set(s.tolist())) == 6
    assert len(shingles(h[:3], 5)) == 0
    batch = pa.record_batch({"text": ["a" * 10, None, "", "b" * 30, "c"]})
    got = [x.column(0).to_pylist() for x in pieces(batch, "text", 12)]
    assert [t for x in got for t in x] == ["a" * 10, None, "", "b" * 30, "c"]
    assert len(got) >= 2
    assert np.all([len(x) for x in got])
