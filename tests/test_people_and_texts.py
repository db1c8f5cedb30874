"""Contacts, merges, segments, scorers, front matter, guards and postings, by hand and by loops."""

import hashlib
import json
import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quern.functions import front
from quern.operators import chains, guard, people, postings, scoring, segments

# contacts


def one_by_one(contacts, aliases, taken):
    """The registry after reading contacts in their order."""
    owner, who, ids = dict(aliases), {}, set(taken)
    for contact, name, phones, emails in contacts:
        if not phones and not emails:
            continue
        carried = [("phone", p) for p in phones or []] + [("email", e) for e in emails or []] + [("name", name)]
        person = next((owner[a] for a in carried if a in owner), None)
        added = person is None
        if added:
            person = hashlib.sha256(name.encode()).hexdigest()[:12]
            if person in ids:
                person = hashlib.sha256(f"{name}#{contact}".encode()).hexdigest()[:12]
            ids.add(person)
        who[contact] = (person, added)
        for a in carried:
            owner.setdefault(a, person)
    return who, {a: p for a, p in owner.items() if a not in aliases}


def test_contacts_in_their_order(spark):
    rng = random.Random(8)
    contacts = []
    for i in range(1000):
        phones = [f"p{rng.randrange(900)}" for _ in range(rng.choice([0, 0, 1, 2]))]
        emails = [f"e{rng.randrange(900)}" for _ in range(rng.choice([0, 1, 1, 3]))]
        contacts.append((i, f"n{rng.randrange(700)}", phones or rng.choice([None, []]), emails or None))
    contacts += [(1000, "chain", ["c0"], None)] + [(1000 + i, f"chain{i}", [f"c{i}", f"c{i - 1}"], None) for i in range(1, 40)]
    aliases = {("phone", "p1"): "x", ("email", "e2"): "y", ("name", "n3"): "x"}
    taken = [hashlib.sha256(b"n9").hexdigest()[:12], "x"]
    want, gained = one_by_one(contacts, aliases, taken)
    df = spark.createDataFrame(contacts, "contact long, name string, phones array<string>, emails array<string>").repartition(4)
    known = spark.createDataFrame([(*a, p) for a, p in aliases.items()], "type string, value string, person string")
    who, fresh = people.synced(df, known, spark.createDataFrame([(t,) for t in taken], "person string"))
    assert {r["contact"]: (r["person"], r["added"]) for r in who.collect()} == want
    assert {(r["type"], r["value"]): r["person"] for r in fresh.collect()} == gained
    assert len({want[1000 + i][0] for i in range(40)}) == 1


def test_circles_are_refused(spark):
    rows = spark.createDataFrame([(1, 2, 0), (2, 3, 0), (3, 1, 0), (9, 8, 0)], "node long, parent long, step int")
    with pytest.raises(ValueError, match="circle"):
        chains.ends(rows)


# merges

NODES = [("A", "a", None), ("B", "b", None), ("C", "", None), ("D", None, None), ("X", "x", None), ("Y", "y", None)]
EDGES = [("1", "A", "X", "k"), ("2", "Y", "A", "k"), ("3", "B", "X", "k"), ("4", "A", "B", "k"), ("5", "D", "D", "k"), ("6", "X", "Y", "k"), ("7", "A", "C", "k"), ("8", "D", "A", "k")]
EDGE = "edge string, src string, dst string, type string, invalid_at timestamp_ntz, reason string, copied_from string"


def graph(spark):
    nodes = spark.createDataFrame(NODES, "node string, summary string, merged_into string")
    edges = spark.createDataFrame([(*e, None, None, None) for e in EDGES], EDGE)
    stamped = edges.withColumn("invalid_at", F.when(F.col("edge") == "8", F.lit("2020-01-01").cast("timestamp_ntz")))
    return nodes, stamped


def merged(spark, nodes, edges, *merges):
    rows = spark.createDataFrame([(*m, i) for i, m in enumerate(merges)], "dupe string, survivor string, nth long")
    return people.merged(nodes, edges, rows, F.lit("2024-01-01").cast("timestamp_ntz"))


def live(edges):
    return sorted((r["src"], r["dst"], r["type"]) for r in edges.collect() if r["invalid_at"] is None)


def test_one_run_of_merges_is_two(spark):
    nodes, edges = graph(spark)
    one_nodes, one_edges = merged(spark, nodes, edges, ("A", "B"), ("B", "C"))
    step = merged(spark, nodes, edges, ("A", "B"))
    two_nodes, two_edges = merged(spark, *step, ("B", "C"))
    between = lambda rows: [r for r in live(rows) if not {r[0], r[1]} <= {"A", "B", "C"}]
    assert between(one_edges) == between(two_edges) == sorted([("C", "X", "k"), ("C", "X", "k"), ("Y", "C", "k"), ("D", "D", "k"), ("X", "Y", "k")])
    assert [r for r in live(one_edges) if r not in between(one_edges)] == [("A", "B", "k"), ("A", "C", "k")]  # within the group they stay as they are
    told = lambda rows: {r["node"]: (r["summary"], r["merged_into"]) for r in rows.collect()}
    assert told(one_nodes)["C"] == told(two_nodes)["C"] == ("b\na", None)
    assert told(one_nodes)["A"] == ("a", "B") and told(one_nodes)["B"][1] == "C" and told(one_nodes)["D"] == (None, None)
    rows = {r["edge"]: r for r in one_edges.collect()}
    assert rows["1"]["invalid_at"] is not None and rows["1"]["reason"] == "merged into C" and rows["1+"]["copied_from"] == "1"
    assert "8+" not in rows and rows["8"]["reason"] is None and "4+" not in rows  # stamped before; within the group


# segments


def test_pauses():
    a, b = "**Ann** (11:50 PM): hi", "**Bo** (1:10 AM): late"
    assert segments.cut("plain\ntext") == ["plain\ntext"] and segments.cut(f"{a}\nmore") == [f"{a}\nmore"]
    assert segments.cut(f"{a}\n{b}", 120) == [f"{a}\n{b}"]  # 80 minutes over midnight
    assert segments.cut(f"{a}\n\n<!-- id: 3 -->\n\n{b}", 80) == [a, f"<!-- id: 3 -->\n\n{b}"]  # the pause counts from its length on; lines in front go along
    assert segments.cut("**A** (3/9/26 7:44 am): x\n**B** (7:44pm): y", 120) == ["**A** (3/9/26 7:44 am): x", "**B** (7:44pm): y"]
    assert segments.cut("**A** (13:00 PM): no time\n**B** (9:00 AM): x\n**C** (9:30 AM): y", 30) == ["**A** (13:00 PM): no time\n**B** (9:00 AM): x", "**C** (9:30 AM): y"]
    assert segments.cut("date: 2026-03-30T10:00\nx\ndate: 2026-03-31T09:00\ny", 120) == ["date: 2026-03-30T10:00\nx", "date: 2026-03-31T09:00\ny"]
    assert segments.cut("date: 2026-13-30T10:00\n**A** (9:00 AM): x") == ["date: 2026-13-30T10:00\n**A** (9:00 AM): x"]
    assert segments.cut("\n\n<!-- c -->\n**A** (1:00 AM): x\n**B** (2:00 AM): y\n**C** (9:00 AM): z", 60) == ["<!-- c -->\n**A** (1:00 AM): x", "**B** (2:00 AM): y", "**C** (9:00 AM): z"]


def test_segments_of_a_table(spark):
    rows = spark.createDataFrame([(1, "**A** (1:00 AM): x\n**B** (9:00 AM): y"), (2, None), (3, "")], "doc long, text string")
    got = {(r["doc"], r["segment"]): r["segment_text"] for r in segments.segments(rows, "doc", "text", 60).collect()}
    assert got == {(1, 0): "**A** (1:00 AM): x", (1, 1): "**B** (9:00 AM): y", (3, 0): ""}


def best(chunk, parts):
    """The first segment that holds the head, else by words."""
    for i, p in enumerate(parts):
        if chunk[:200] in p:
            return i
    words = set(chunk.split()[:50])
    scores = [len(words & set(p.split()[:200])) for p in parts]
    return scores.index(max(scores))


def test_chunks_find_their_segment(spark):
    rng = random.Random(2)
    chunks, parts, want = [], [], {}
    for doc in range(25):
        alphabet = "ab é" if doc % 3 else "ab"
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.choice([0, 3, 30, 90, 260, 700]))) for _ in range(6)]
        whole = "".join(texts)
        parts += [(doc, i, t) for i, t in enumerate(texts)]
        for c in range(14):
            size, at = rng.choice([0, 1, 5, 23, 24, 40, 64, 150, 199, 200, 201, 300]), rng.randrange(max(1, len(whole)))
            chunk = whole[at : at + size] if rng.random() < 0.8 else "".join(rng.choice("abc ") for _ in range(size))
            chunks.append((doc, c, chunk))
            want[doc, c] = best(chunk, texts)
    a = spark.createDataFrame(chunks, "doc long, chunk int, chunk_text string").repartition(3)
    b = spark.createDataFrame(parts, "doc long, segment int, segment_text string")
    got = {(r["doc"], r["chunk"]): r["segment"] for r in segments.best_segment(a, b).collect()}
    assert got == want


# scorers


class Slow:
    def scores(self, query, texts):
        import time

        time.sleep(5)
        return [1.0] * len(texts)


class Short:
    def scores(self, query, texts):
        return [1.0]


class Odd:
    def scores(self, query, texts):
        return [float("nan")] * len(texts)


def results(spark):
    rows = [(q, "green tea", i, "" if i % 2 else "tea", f"{'green ' * (i == 3)}leaf {i}", 1 / i, 0.0, None, q == 1, 0.4) for q in (1, 2) for i in range(1, 6)]
    return spark.createDataFrame(rows, "query_id long, query string, rank int, context string, text string, base double, recency double, importance double, hybrid boolean, dense double")


def test_a_scorer_by_name(spark):
    rows = scoring.reranked(results(spark), "quern.operators.scoring:TokenOverlap", most=4)
    one = {r["rank"]: (r["place"], r["rerank"]) for r in rows.where("query_id = 1").collect()}
    assert one == {2: (1, 0.0), 3: (2, 0.0), 4: (3, 0.0), 1: (4, -4.0), 5: (5, None)}
    assert {(r["query_id"], r["mode"]) for r in rows.collect()} == {(1, "hybrid-rerank"), (2, "dense-rerank")}
    told = {r["query_id"]: (r["no_strong_match"], r["why"]) for r in scoring.no_strong_match(rows, 0.5).collect()}
    assert told[1] == (True, "top rerank score 0.00 < 0.5")


@pytest.mark.parametrize("spec", ["nowhere.at_all:Scorer", "quern.operators.scoring:Nothing", "no colon", f"{__name__}:Short", f"{__name__}:Odd", f"{__name__}:Slow"])
def test_failures_keep_the_order(spark, spec, monkeypatch):
    rows = scoring.reranked(results(spark), spec, seconds=0.5)
    got = rows.orderBy("query_id", "place").collect()
    assert [r["rank"] for r in got] == [1, 2, 3, 4, 5] * 2 and all(r["rerank"] is None for r in got)
    assert {(r["query_id"], r["mode"]) for r in got} == {(1, "hybrid-rrf"), (2, "dense-fallback")}
    assert {r["why"] for r in scoring.no_strong_match(rows).collect()} == {"best cosine 0.400 < 0.65"}


# front matter

BLOCKS = [
    ("a: 1\nb: two words", {"a": 1, "b": "two words"}), ("a: 1\na: 2", {"a": 2}), ("tags: [x, 'y, z', \"q\"]", {"tags": ["x", "y, z", "q"]}), ("tags:\n  - x\n  - y z\n", {"tags": ["x", "y z"]}), ("tags:\n- x\n- 2", {"tags": ["x", 2]}),
    ("a:\n  b:\n    c: true\n  d: ~", {"a": {"b": {"c": True}, "d": None}}), ("day: 2024-01-05\nat: 2024-01-05T10:00:00+02:00", {"day": "2024-01-05", "at": "2024-01-05T08:00:00Z"}),
    ("x: 'it''s'\ny: \"a\\nb\"", {"x": "it's", "y": "a\nb"}), ("n: 1.5\nm: -3\nk: 1_000\no: 0x1F", {"n": 1.5, "m": -3, "k": 1000, "o": 31}), ("e:\nf: ''", {"e": None, "f": ""}), ("a: yes\nb: No\nc: yEs", {"a": True, "b": False, "c": "yEs"}),
    ("# note\na: 1 # one\nb: x#y", {"a": 1, "b": "x#y"}), ("a: |\n  one\n   two\nb: 1", {"a": "one\n two\n", "b": 1}), ("a: >-\n  one\n  two\n\n  three", {"a": "one two\nthree"}), ("l:\n  - a: 1\n    b: 2\n  - a: 3", {"l": [{"a": 1, "b": 2}, {"a": 3}]}),
    ("m: {a: 1, b: [2, 3]}", {"m": {"a": 1, "b": [2, 3]}}), ("type: [System] Incident\nat: x", {"type": "[System] Incident", "at": "x"}), ("a: b: c\nd: 'x", {"a": "b: c", "d": "'x"}), ("url: http://x.org/a?b#c\nt: 10:30", {"url": "http://x.org/a?b#c", "t": 630}),
    ("just words", {}), ("- a\n- b", {}), ("", {}), ("a: one\n  two\nb: 3", {"a": "one two", "b": 3}), ("\tindented: no\nok: 1", {"ok": "1"}), ("a: 2024-02-30", {"a": "2024-02-30"}),
]


@pytest.mark.parametrize(("block", "want"), BLOCKS)
def test_front_matter_blocks(block, want):
    assert front.parsed("\n" + block) == want


def test_front_matter_columns(spark):
    rows = spark.createDataFrame([(1, "---\na: [1, 2]\n---\ntext"), (2, "no mark"), (3, None), (4, "---\nopen: 1")], "id long, text string")
    got = {r["id"]: json.loads(r["v"]) for r in rows.select("id", F.to_json(front.front_matter(F.col("text"))).alias("v")).collect()}
    assert got == {1: {"a": [1, 2]}, 2: {}, 3: {}, 4: {}}


# guard


@pytest.mark.parametrize("text", [
    "SELECT delete, `update` FROM t WHERE x = 'drop table y'", "WITH a AS (SELECT 1 AS merge) SELECT * FROM a JOIN b USING (merge)", "SELECT * FROM t WHERE id IN (SELECT id FROM s) ORDER BY 1 LIMIT 3",
    "SELECT count(*) FROM VALUES (1), (2) AS v(x) GROUP BY x HAVING count(*) > 1", "SELECT * FROM t UNION SELECT * FROM s", "SELECT set FROM t LATERAL VIEW explode(a) x AS y",
])
def test_reading_passes(spark, text):
    assert guard.refusal(spark, text) is None


@pytest.mark.parametrize("text", [
    "DROP TABLE t", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", "INSERT OVERWRITE t SELECT 1", "DELETE FROM t", "UPDATE t SET a = 1", "MERGE INTO t USING s ON t.a = s.a WHEN MATCHED THEN DELETE", "CREATE TABLE x AS SELECT 1",
    "SET spark.x = 1", "CACHE TABLE t", "SELECT 1; DROP TABLE t", "not sql at all", "", "   ", "SELECT reflect('java.lang.System', 'exit', 0)", "SELECT * FROM (SELECT java_method('a', 'b') AS z)", "TRUNCATE TABLE t", "USE x", "EXPLAIN SELECT 1",
])
def test_all_else_is_refused(spark, text):
    assert guard.refusal(spark, text)


def test_answers(spark):
    assert [r["n"] for r in guard.answered(spark, "SELECT count(*) AS n FROM {rows}", rows=spark.range(3)).collect()] == [3]
    with pytest.raises(PermissionError):
        guard.answered(spark, "DROP TABLE {rows}", rows=spark.range(3))


# postings


def test_postings_over_two_fields(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: rng.choice(["the", "tea", "Über", "grün", "x1", "leaf"])
    rows = [(i, " ".join(word() for _ in range(rng.randrange(4))), None if i % 9 == 0 else " ".join(word() for _ in range(rng.randrange(30)))) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, name string, fact string").repartition(4)
    index = postings.opened(spark, postings.written(df, ["name", "fact"], f"{tmp_path}/index"))
    split = lambda s: [w for w in re.split(r"[^\w]+|_", (s or "").lower()) if w]
    score = defaultdict(float)
    for field in (1, 2):
        texts = [split(r[field]) for r in rows]
        mean = sum(map(len, texts)) / len(texts)
        for term in ("tea", "über", "nowhere"):
            df_ = sum(term in t for t in texts)
            for r, t in zip(rows, texts, strict=True):
                if term in t:
                    tf = t.count(term)
                    score[r[0]] += math.log(1 + (len(texts) - df_ + 0.5) / (df_ + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean))
    want = sorted(((round(s, 9), -i) for i, s in score.items()), reverse=True)
    got = [(r["score"], -r["id"]) for r in postings.search(index, ["Tea", "über", "nowhere", "tea", ""], None).collect()]
    got.sort(reverse=True)
    assert [s for s, _ in got] == pytest.approx([s for s, _ in want], abs=2e-9) and {i for _, i in got} == {i for _, i in want}
    assert [r["id"] for r in postings.search(index, ["tea", "über", "nowhere"], 5).collect()] == [-i for _, i in want[:5]]
    each = postings.search_each(index, spark.createDataFrame([(7, "Tea über nowhere"), (8, "")], "query_id long, query string"), 5).collect()
    assert [(r["query_id"], r["id"]) for r in sorted(each, key=lambda r: r["rank"])] == [(7, -i) for _, i in want[:5]]
    assert not postings.search(index, [], 5).collect()
    plan = index.entries.where(F.col("term").isin("tea"))._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "EqualTo(term,tea)" in plan.partition("PushedFilters")[2].partition("ReadSchema")[0]
