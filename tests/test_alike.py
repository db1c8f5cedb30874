"""Joins on the sequence ratio lose no pair: brute force over all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from quern.operators import alike, resolve
from quern.plans import QUERIES


def made_names(n, seed):
    rng = random.Random(seed)
    first, last = ["ann", "bo", "maría", "Jo", "Kim", "li", "Zoë", "Ann-Marie"], ["Lee", "Li", "Osei", "van der Berg", "Smith", "Smythe", "García", "O'Neil"]
    out = []
    for _ in range(n):
        words = [rng.choice(first)] + rng.sample(last, rng.randrange(3))
        if rng.random() < 0.4:
            words.append(f"{rng.randrange(60)}")
        name = (" " * rng.randrange(1, 3)).join(words)
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            i = rng.randrange(len(name) + 1)
            name = name[:i] + rng.choice(["x", "", "e", "ann"]) + name[i + rng.randrange(2) :]
        out.append(name)
    return [*out, "", " ", "a", "ab", "ann" * 20, "ann " * 30]


def test_every_pair_of_two_thousand_names(spark):
    names, known = made_names(200, 1), made_names(1800, 2)
    a = spark.createDataFrame(list(enumerate(names)), "id long, name string").union(spark.createDataFrame([(9999, None)], "id long, name string"))
    b = spark.createDataFrame(list(enumerate(known)), "known long, known_name string").repartition(3)
    got = {r["id"]: (r["known"], r["score"]) for r in resolve.near_names(a, b).collect()}
    want = {}
    for i, x in enumerate(names):
        if not x.split():
            continue
        score, j = min((-resolve.names_alike(x, y), j) for j, y in enumerate(known) if y.split())
        if -score >= resolve.REVIEW:
            want[i] = (j, round(-score, 6))
    assert got == want and len(want) > 100
    placed = {r["id"]: r["tier"] for r in resolve.placed(a, b).collect()}
    assert len(placed) == len(names) + 1 and placed[9999] == "create"


def test_common_words_block_nothing(spark):
    known = [(i, f"ann {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{i}") for i in range(3000)]
    a = spark.createDataFrame([(1, "Ann"), (2, "lee ann"), (3, "ann zz9")], "id long, name string")
    got = {r["id"]: (r["known"], r["score"]) for r in resolve.near_names(a, spark.createDataFrame(known, "known long, known_name string")).collect()}
    assert got[1] == (0, 0.85)
    assert got[3] == min(((-resolve.names_alike("ann zz9", n), i) for i, n in known), key=lambda x: x)[::-1][:1] + (round(max(resolve.names_alike("ann zz9", n) for _, n in known), 6),)


@pytest.mark.parametrize("least", [0.5, 0.72, 0.75, 0.96])
def test_keys_meet(least):
    from difflib import SequenceMatcher

    rng = random.Random(3)
    texts = ["".join(rng.choice("aabcé ") for _ in range(rng.choice([1, 2, 3, 5, 8, 14, 17, 30, 45]))) for _ in range(120)]
    texts += [t[: rng.randrange(len(t) + 1)] + "b" + t[rng.randrange(len(t)) :] for t in texts]
    rank = {c: i for i, c in enumerate("éabc")}
    held = [alike.keys(t, rank, least) for t in texts]
    for i, x in enumerate(texts):
        for j, y in enumerate(texts):
            if SequenceMatcher(None, x, y).ratio() >= least:
                assert held[i] & held[j], (x, y)


def tasks(n=160):
    rng = random.Random(4)
    words = ["send", "report", "ann", "call", "bank", "renew", "policy", "draft", "q3", "budget", "to", "the", "review"]
    out = []
    for i in range(n):
        text = " ".join(rng.choices(words, k=rng.randrange(1, 12)))
        if rng.random() < 0.3:
            text = text.replace(" ", "").replace("a", "aa", 1)  # alike by letters, with no word in common
        out.append((i, rng.choice(["me", "you"]), rng.choice(["Ann ", "ann", "", None]), text, text.split() if i % 7 else []))
    return [*out, (900, "me", "ann", "", []), (901, "me", "ann", None, None)]


@pytest.mark.parametrize("block", [7, 512])
def test_tasks_alike(spark, monkeypatch, block):
    rows = tasks()
    monkeypatch.setattr(alike.scanned, "__defaults__", (block,))
    df = spark.createDataFrame(rows, "id long, owner string, counterparty string, text string, tokens array<string>").repartition(4)
    got = {(r["id"], r["match"]): r["score"] for r in resolve.candidates(df.where("id % 5 = 0"), df, top=10**6).collect()}
    want = {}
    for i, _, p, x, v in rows:
        for j, _, q, y, w in rows:
            if i % 5 or i == j or not x or not y:
                continue
            s = resolve.texts_alike(x, y, set(v), set(w))
            if (q or "").strip() and (p or "").strip().lower() == q.strip().lower():
                s = min(1.0, s + resolve.PARTNER)
            if round(s, 3) >= resolve.SAME_TASK:
                want[i, j] = round(s, 3)
    assert got == want and any(not set(rows[i][4]) & set(rows[j][4]) for i, j in want if i < 160 and j < 160)
    three = resolve.candidates(df.where("id % 5 = 0"), df).groupBy("id").agg(F.count("*").alias("n")).collect()
    assert max(r["n"] for r in three) == 3


def test_the_registry_comes_first(spark):
    names = spark.createDataFrame([(1, " Mia Old ", "person"), (2, "Kim Lee", "Person"), (3, "Kim Lee", "Project"), (4, "Sam", "Person"), (5, "Twin", "Person"), (6, "New Q", "Person"), (7, "Brand new thing", None)], "id long, name string, kind string")
    known = spark.createDataFrame([(10, "Mia Married"), (11, "kim lee"), (12, "Sam Rivera"), (13, "Kim  Lee")], "known long, known_name string")
    aliases = spark.createDataFrame([("MIA OLD", "p1"), ("mia old", "p1"), ("kim lee", "p2"), ("twin", "p3"), ("twin", "p4"), ("new q", "p5")], "alias string, person string")
    nodes = spark.createDataFrame([("p1", 99, 0), ("p1", 10, 1), ("p2", 98, 0)], "person string, known long, at int")
    got = {r["id"]: (r["action"], r["known"], r["score"], r["person"], r["links"]) for r in resolve.entity_actions(names, known, aliases, nodes).collect()}
    assert got == {
        1: ("resolved_via_registry", 10, None, "p1", False), 2: ("updated_existing", 11, 1.0, "p2", True), 3: ("updated_existing", 11, 1.0, None, False), 4: ("queued_for_review", 12, 0.85, None, False),
        5: ("created", None, None, None, False), 6: ("created", None, None, "p5", True), 7: ("created", None, None, None, False),
    }


@pytest.mark.parametrize("name", ["entity_tiers", "entity_actions", "duplicate_candidates"])
def test_queries_against_loops(spark, name):
    folder = "/root/testdata/sf0.001"
    got = QUERIES[name](spark, folder).collect()
    from quern.plans import memory
    from quern.plans.registry import Tables

    if name == "duplicate_candidates":
        rows = [(r["id"], r["counterparty"], r["text"], set(r["tokens"])) for r in memory._tasks(Tables(spark, folder)).collect()]
        want = set()
        for i, p, x, v in rows:
            if i % 20 == 0:
                scores = [(-round(min(1.0, resolve.texts_alike(x, y, v, w) + 0.03 * (p == q)), 3), j) for j, q, y, w in rows if j != i]
                want |= {(i, j, -s) for s, j in sorted(scores)[:3] if -s >= 0.72}
        assert {tuple(r) for r in got} == want
        return
    fresh, known, *_ = memory._names(Tables(spark, folder))
    names, old = [(r["id"], r["name"]) for r in fresh.collect()], [(r["known"], r["known_name"]) for r in known.collect()]
    best = {i: min((-round(resolve.names_alike(n, o), 6), k) for k, o in old) for i, n in names}
    for r in got:
        s, k = best[r["id"]]
        if name == "entity_tiers":
            assert (r["known"], r["score"]) == ((k, -s) if -s >= 0.75 else (None, None))
        elif r["action"] != "resolved_via_registry":
            assert (r["known"], r["score"]) == ((k, -s) if -s >= 0.75 else (None, None))
    assert len(got) == len(names)
