"""Vector searches against brute force; archives as an exact round trip."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from quern.llm import kdtree, multi_index, warc


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    made = [(i, [float(x) for x in np.float32(rng.normal(i % 3, 0.7, 8))], "t") for i in range(900)]
    made += [(i, [0.25] * 8, "same") for i in range(2000, 2030)]
    made += [(3000, None, "x"), (3050, [], "x"), (3100, [1.0] * 7 + [float("nan")], "x"), (3150, [1.0] * 7 + [None], "x"), (3200, [0.0] * 8, "zero"), (3300, [1.0] * 7 + [float("inf")], "x")]
    made += [made[0], made[100], (None, [1.0] * 8, "x"), (3400, [1.0, 2.0, 3.0], "short"), (3500, [1.0, 2.0, 4.0], "short")]
    return spark.createDataFrame(made, "vec_id long, embedding array<float>, score string").repartition(5)


def sound(rows):
    good = {(r["vec_id"], tuple(r["embedding"])) for r in rows.collect() if r["vec_id"] is not None and r["embedding"] and all(x is not None and math.isfinite(x) for x in r["embedding"])}
    return sorted(good)


@pytest.mark.parametrize("shard", [100, 16384])
def test_kdtree_is_exact(rows, monkeypatch, shard):
    monkeypatch.setattr(kdtree, "SHARD", shard)
    v = [(i, [math.floor(256 * x) for x in e]) for i, e in sound(rows)]
    want = {}
    for q, x in v:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in v if i != q and len(x) == len(y))[:5]
            want |= {(q, n): (i, -s) for n, (s, i) in enumerate(best, 1)}
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in kdtree.top_k(rows, rows.where("vec_id % 50 = 0")).collect()}
    assert got == want


def test_kdtree_beyond_exact_floats():
    x = np.array([[1 << 40, 3], [1 << 40, 5], [7, 1]], object)
    assert kdtree.numbers(x, x) is object
    t = kdtree.Tree(np.array([1, 2, 3]), x)
    q = np.array([1 << 30, 1], object)
    assert t.best(q, -1, 2, t.bounds(q[None])[0]) == [((1 << 70) + 5, 2), ((1 << 70) + 3, 1)]


def test_empty_tables(spark, rows):
    none = rows.limit(0)
    assert not kdtree.top_k(none, none).collect()
    assert not multi_index.nearest(none, none).collect()


def test_walk_passes_cells_in_order():
    rng = np.random.default_rng(0)
    a, b = rng.random(6), rng.random(5)
    counts = rng.integers(0, 3, 30)
    got = multi_index.walk(a, b, counts, 1e9)
    sums = [a[c // 5] + b[c % 5] for c in got]
    assert sums == sorted(sums) and sorted(got) == np.flatnonzero(counts).tolist()
    some = multi_index.walk(a, b, counts, 7)
    assert some == got[: len(some)] and counts[some].sum() >= 7 > counts[some[:-1]].sum()


@pytest.mark.parametrize("sub", [7, 8192])
def test_multi_index_recall_and_scores(rows, monkeypatch, sub):
    monkeypatch.setattr(multi_index, "PART", sub)
    v = [(i, np.array(e)) for i, e in sound(rows) if any(e)]
    got = defaultdict(list)
    for r in multi_index.nearest(rows, rows.where("vec_id % 100 = 0")).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    for q, x in v:
        if q % 100 == 0:
            best = sorted((math.sqrt(((x - y) ** 2).sum()), i) for i, y in v if i != q and len(x) == len(y))[:10]
            mine = sorted(got.pop(q))
            assert [r for r, _, _ in mine] == list(range(1, len(best) + 1))
            assert all(abs(s - math.sqrt(((x - dict(v)[i]) ** 2).sum())) < 1e-9 for _, i, s in mine)
            assert [(s, i) for _, i, s in mine] == sorted((s, i) for _, i, s in mine)
            hits += len({i for _, i in best} & {i for _, i, _ in mine})
            total += len(best)
    assert not got and hits / total >= 0.9


def pages(spark):
    rng = random.Random(1)
    body = lambda n: "".join(rng.choice("ab<>é\r\n ") for _ in range(n))
    same, small = body(300), "x" * 99
    made = [(i, f"http://h/{i} a\n?q=ü", body(rng.randrange(2000))) for i in range(200)]
    made += [(i, "http://same", same) for i in (77777, 500, 501, 502)] + [(i, None, small) for i in (600, 601)]
    made += [(700, "u", None), (701, "u", ""), (None, "n", same), (None, "n", body(150)), (500, "again", same), (-5, "minus", "y" * 100), (800, "minus", "y" * 100)]
    return spark.createDataFrame([(*r, "x") for r in made], "page_id long, url string, html string, record_type string").repartition(6)


def test_archives_round_trip(spark, tmp_path):
    rows = pages(spark)
    for name in ("a", "b"):
        warc.write(rows.repartition(3 if name == "a" else 7), f"file://{tmp_path}/{name}", shard_bytes=50_000, roll_bytes=5_000)
    files = sorted(p.name for p in (tmp_path / "a").glob("*.warc.gz"))
    assert len(files) > 8 and not list((tmp_path / "a").glob("*.tmp"))
    for f in files:
        assert (tmp_path / "a" / f).read_bytes() == (tmp_path / "b" / f).read_bytes()
    data = [(r["page_id"], r["html"] or "") for r in rows.collect()]
    least = {}
    for i, h in data:
        if len(h.encode()) >= 100 and i is not None:
            least[h] = min(i, least.get(h, i))
    want = Counter((i, len(h.encode()), hashlib.sha256(h.encode()).hexdigest(), "response" if least.get(h, i) == i else "revisit", None if least.get(h, i) == i else least[h]) for i, h in data)
    got = warc.read(spark, f"file://{tmp_path}/a", payload=True).collect()
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    text = Counter(h for _, h in data)
    assert all(r["payload"] in text for r in got if r["record_type"] == "response")


def test_shards_are_sorted_and_damage_is_seen(spark, tmp_path):
    import gzip

    warc.write(pages(spark), f"file://{tmp_path}/a", shard_bytes=60_000, roll_bytes=9_000)
    last = None
    for f in sorted((tmp_path / "a").glob("*.warc.gz")):
        for head, _ in warc.records(gzip.open(f)):
            if "x-page-id" in head:
                now = int(head["x-page-id"])
                assert last is None or now >= last
                last = now
    f = sorted((tmp_path / "a").glob("*.warc.gz"))[0]
    f.write_bytes(f.read_bytes()[:-9])
    with pytest.raises(Exception, match="not the file of the manifest"):
        warc.read(spark, f"file://{tmp_path}/a").collect()


def test_empty_archive(spark, tmp_path):
    assert warc.write(pages(spark).limit(0), f"file://{tmp_path}/e").count() == 0
    assert not warc.read(spark, f"file://{tmp_path}/e").collect()


@pytest.mark.parametrize(("n", "clustered"), [(2_000, False), (20_000, True), (20_000, False), (50_000, True)])
def test_recall_at_the_registered_settings(n, clustered):
    """The walks of the operator in one process, at its own settings: recall, and the share of entries passed."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 64))
    if clustered:
        x = 3 * rng.normal(size=(200, 64))[rng.integers(0, 200, n)] + x
    books = multi_index.Books(x[:20_000], int(np.clip(np.sqrt(n) / 1.6, 4, 256)))
    a, b = books.distances(x)
    cell = a.argmin(axis=1) * b.shape[1] + b.argmin(axis=1)
    counts, k, hits, passed, asked = np.bincount(cell, minlength=a.shape[1] * b.shape[1]), 10, 0, 0, range(0, n, n // 50)
    for q in asked:
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        cells = multi_index.walk(a[q], b[q], counts, multi_index.FIRST * k)
        for most in (multi_index.MIDWAY * k, multi_index.MISSED * k):
            kth = np.sort(d[np.isin(cell, cells)])[k - 1]
            more = multi_index.walk(a[q], b[q], counts, np.inf, multi_index.reach(a[q], b[q], counts, books, kth, most))
            cells = max(cells, more, key=len)
        seen = np.isin(cell, cells)
        hits += seen[np.argsort(d)[:k]].sum()
        passed += seen.mean()
    assert hits / len(asked) / k >= 0.9
    assert not clustered or passed / len(asked) < 0.2
