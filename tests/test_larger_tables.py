"""What showed on larger tables: queries against their SQL, or loops, on rows made for it."""

import datetime

import duckdb

from quern.operators import chains, people, resolve
from quern.plans import ORACLE_SQL, QUERIES


def against_sql(spark, folder, name, **tables):
    """The query and its SQL over tables (rows, schema) give the same rows, which are returned."""
    c = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        c.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    df = QUERIES[name](spark, str(folder))
    got, rel = [tuple(r) for r in df.collect()], c.sql(ORACLE_SQL[name])
    at = [rel.columns.index(x) for x in df.columns]
    assert sorted(got, key=repr) == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)
    return got


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(*at, value=1.0):
    return [(i, datetime.datetime.fromisoformat(x), 1, "view", value, "") for i, x in enumerate(at)], EVENTS


def test_hours_of_the_nearest_second(spark, tmp_path):
    at = ["2024-01-02T07:59:59.400000", "2024-01-02T07:59:59.500000", "2024-01-02T07:59:59.700000", "2024-01-02T17:59:59.600000", "2024-01-05T23:59:59.900000", "2024-01-06T17:59:59.900000"]
    got = against_sql(spark, tmp_path, "boundary_violations", events=events(*at))
    assert sorted(got) == [(0, "early"), (3, "late"), (4, "early"), (5, "late")]


def test_days_of_the_nearest_second(spark, tmp_path):
    at = ["2024-01-02T23:59:59.700000", "2024-01-03T00:00:00.100000", "2024-01-03T10:00:00.000000", "2024-01-02T09:00:00.000000"]
    got = against_sql(spark, tmp_path, "calendar_findings", events=events(*at, value=50.0))
    assert sorted(got) == [(0, "large forum"), (1, "large forum"), (2, "large forum"), (3, "keep")]


def test_slices_of_the_nearest_second(spark, tmp_path):
    rows = [(0, "2024-01-02T23:59:59.700000", "view", 1.0), (1, "2024-01-03T12:00:00", "view", 2.0), (2, "2024-01-03T01:00:00", "error", 1.0), (3, "2024-01-03T02:00:00", "error", 2.0)]
    table = [(i, datetime.datetime.fromisoformat(x), 1, kind, v, "") for i, x, kind, v in rows], EVENTS
    assert len(against_sql(spark, tmp_path, "subset_slices", events=table)) == 1


def test_office_texts_that_begin_with_digits(spark, tmp_path):
    texts = ["4754 then words", "44.1 x", "-3 degrees", "plain {braces} and \\slashes", "", "a (b) & <c>"]
    rows = [(6 * i + k, x, "en", "src0", len(x)) for i, x in enumerate(texts) for k in range(6)]
    got = against_sql(spark, tmp_path, "office_texts", documents=(rows, "doc_id long, text string, lang string, source string, n_chars int"))
    assert len(got) == 36


def test_long_chains_stay_narrow(spark):
    """Ways along a chain would be its square; the order of the summaries is that of the ways all the same."""
    n = 400
    merges = [(i, i - 1 if i < n else i % 7, i) for i in range(1, n)] + [(n + i, (i * 7919) % n, (i * 31) % 97) for i in range(300)]
    nodes = spark.createDataFrame([(i, f"s{i}" if i % 3 else "", None) for i in range(n + 300)], "node long, summary string, merged_into long")
    table = spark.createDataFrame(merges, "dupe long, survivor long, nth long")
    pointers = people.pointed(nodes, table)
    ended = chains.ends(pointers)
    assert ended.columns == ["node", "end"]
    got = {r["node"]: r["summary"] for r in people.folded(nodes, table, pointers, ended).collect()}
    parent, step = {d: s for d, s, _ in merges}, {d: (k, d) for d, _, k in merges}
    way = lambda d: way(parent[d]) + [step[d]] if d in parent else []
    assert got[0].split("\n") == [f"s{d}" for d in sorted(parent, key=way) if d % 3]


def test_tasks_of_one_text_are_compared_once(spark, monkeypatch):
    """However many tasks repeat a text, pairs of texts are compared; the best are those of all tasks."""
    rows = [(i, "me", str(i % 3), ["send report now", "send the report now", "call ann"][i % 7 % 3], ["send", "report", "now"] if i % 7 % 3 < 2 else ["call", "ann"]) for i in range(140)]
    df = spark.createDataFrame(rows, "id long, owner string, counterparty string, text string, tokens array<string>")
    seen, scanned = [], resolve.alike.scanned
    monkeypatch.setattr(resolve.alike, "scanned", lambda q, k, *more: seen.append((q.count(), k.count())) or scanned(q, k, *more))
    got = {(r["id"], r["match"], r["score"]) for r in resolve.candidates(df.where("id % 20 = 0"), df).collect()}
    want = set()
    for i, _, p, x, v in rows[::20]:
        scores = [(-round(min(1.0, resolve.texts_alike(x, y, set(v), set(w)) + resolve.PARTNER * (p == q)), 3), j) for j, _, q, y, w in rows if j != i]
        want |= {(i, j, -s) for s, j in sorted(scores)[:3] if -s >= resolve.SAME_TASK}
    assert got == want and seen == [(3, 3)]


def test_names_that_are_found_are_not_scored_with_all(spark, monkeypatch):
    """A name that is known is not compared with all that are a little like it."""
    names = spark.createDataFrame([(i, f"ann building {i}") for i in range(40)], "id long, name string")
    known = spark.createDataFrame([(i, f"Ann  building {i}") for i in range(500)], "known long, known_name string")
    asked, near = [], resolve.alike.near_texts
    monkeypatch.setattr(resolve.alike, "near_texts", lambda a, *more: asked.append(a.count()) or near(a, *more))
    got = {r["id"]: (r["known"], r["score"]) for r in resolve.near_names(names, known).collect()}
    assert got == {i: (i, 1.0) for i in range(40)} and set(asked) == {0}


def test_blocks_of_few_token_sets(spark, tmp_path, monkeypatch):
    """Each pair of token sets is scored once."""
    from quern.plans import texts

    names = [("LARGE", "hot ring"), ("SMALL", "ring of hot"), ("SMALL", "Hot ring"), ("MED", "a"), ("LARGE", "bolt")]
    rows = [(i, names[i % 5][1], f"B{i % 2}", names[i % 5][0], i % 3, 1.0) for i in range(120)]
    scored, put = [], texts.kept
    monkeypatch.setattr(texts, "kept", lambda df, name: scored.append((name, df.count())) or put(df, name))
    got = against_sql(spark, tmp_path, "blocked_jaccard", part=(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"))
    assert len(got) == 6 * 20 * 19 // 2 and dict(scored)["scores"] == 10


def test_an_index_is_shuffled_once(spark, tmp_path):
    """Words are counted row by row, so only counts move; rows of one id and size are still one in a search."""
    from quern.operators import postings

    docs = spark.createDataFrame([(1, "the end the end the"), (2, "a the b"), (2, "the the c"), (3, None), (4, "")], "id long, text string")
    index = postings.opened(spark, postings.written(docs, ["text"], str(tmp_path / "i")))
    assert index.fields.first()["n"] == 5
    assert sorted((r["id"], r["tf"]) for r in postings.whole(index.entries.where("term = 'the'")).collect()) == [(1, 3), (2, 3)]
    found = postings.search_each(index, spark.createDataFrame([(7, "the end"), (8, "c")], "query_id long, query string"), 3)
    assert [(r["query_id"], r["id"]) for r in found.orderBy("query_id", "rank").collect()] == [(7, 1), (7, 2), (8, 2)]


def test_small_files_share_tasks(spark, tmp_path):
    """Splits of small files are read many to a task; a file's name is as it was written."""
    rows = [(i, f"text {i}\r\n\u00e4" * (i % 9 + 1), "en", ["src0", "src1", "a b%41", "c#d?"][i % 4], 1) for i in range(1200)]
    got = against_sql(spark, tmp_path, "two_roots", documents=(rows, "doc_id long, text string, lang string, source string, n_chars int"))
    assert len(got) == 1100 and ("a b%41/2.md", len("text 2\r\n\u00e4" * 3)) in got
    assert QUERIES["two_roots"](spark, str(tmp_path)).rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism  # of 35 splits


def test_documents_that_are_no_file_have_their_row(spark, tmp_path):
    """Empty and missing texts, names and numbers; repeated and hidden names; numbers below zero."""
    rows = [(1, ""), (3, ""), (2, None), (6, None), (-1, "minus"), (-3, "three"), (None, "x"), (4, "a"), (4, "bcd"), (9, "q"), (9, "q"), (10, "\u00e4\r\n")]
    sources = ["src0", "src1", "src12", ".h", "_u", "a/b", "src1/x", "", "..", None]
    table = [(i, x, "en", s, 1) for i, x in rows for s in sources], "doc_id long, text string, lang string, source string, n_chars int"
    got = against_sql(spark, tmp_path, "two_roots", documents=table)
    assert {("src0/1.md", 0), ("@memory/src0/3.md", 0), ("src0/2.md", None), ("src0/-1.md", 5), ("_u/10.md", 3)} <= set(got) and got.count(("@memory/src0/9.md", 1)) == 2


def test_notes_without_a_text(spark, tmp_path):
    rows = [(i, x, "en", "src2", 1) for i, x in enumerate(["", None, "", "a\n---\n", "\n---", "b\n"])]
    got = against_sql(spark, tmp_path, "markdown_scan", documents=(rows, "doc_id long, text string, lang string, source string, n_chars int"))
    assert sorted(r[3] for r in got if r[3] is not None) == [0, 1, 3, 5] and len(got) == 5


def test_empty_files_are_read(spark, tmp_path):
    from quern.sources import files

    for name in ("top.md", "a/empty.md", "a/b/_under.md", "_c/x y%41.md"):
        (tmp_path / "notes" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "notes" / name).write_text("" if "empty" in name else name)
    got = {r["file_path"]: r["text"] for r in files.markdown(spark, str(tmp_path / "notes")).collect()}
    assert got == {"top.md": "top.md", "a/empty.md": "", "a/b/_under.md": "a/b/_under.md", "_c/x y%41.md": "_c/x y%41.md"}


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars int"


def test_chunks_are_matched_in_the_row_of_their_document(spark, tmp_path):
    """Nothing is shuffled for it; words are those of the SQL, and documents of one id are one."""
    import random

    rng, texts = random.Random(5), ["", None, "one line", "\n\n\n\n\n\n", "a\0b\n\0\nc"]
    for n in (3, 9, 40):
        for words in (["a", "b", "", " ", "c\vd", " e", "ä f "], ["the", "end", "of", "x" * 90, "\t", "g\r"]):
            texts += ["\n".join(" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 60]))) for _ in range(n)) for _ in range(6)]
    once = [(i, x, "en", "src0", 1) for i, x in enumerate(texts)]
    got = against_sql(spark, tmp_path / "once", "chunk_segments", documents=(once, DOCUMENTS))
    assert len(got) == sum(-(-len(x.split("\n")) // 3) for x in texts if x is not None)
    plan = QUERIES["chunk_segments"](spark, str(tmp_path / "once"))._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Join" not in plan
    again = [(i // 2, *r) for i, *r in once] + [(None, "x", "en", "src0", 1)]
    against_sql(spark, tmp_path / "again", "chunk_segments", documents=(again, DOCUMENTS))


def test_heads_of_a_long_text(monkeypatch):
    """Places by hashes are those of a plain search; words by lists as well."""
    import random

    from quern.operators import segments

    rng = random.Random(3)
    whole = "".join(rng.choice("abä\n") for _ in range(3000)) + "\U0001f600" + "a" * 500
    heads = {whole[at : at + n] for n in (1, 5, 40, 200) for at in range(0, 3300, 97)} | {"", "b" * 60, "zz"}
    want = {h: whole.find(h) for h in heads if h in whole}
    lines = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(12)) for _ in range(400)]
    chunks, parts = ["\n".join(lines[i : i + 3]) for i in range(0, 400, 3)], ["\n".join(lines[i : i + 4]) for i in range(0, 400, 4)]
    few = [segments.which([c], parts)[0] for c in chunks]
    assert segments.which(chunks, parts) == few  # 134 times 100
    monkeypatch.setattr(segments, "SCANNED", 0)
    monkeypatch.setattr(segments, "BLOCK", 64)
    assert segments.places(whole, heads) == want and segments.which(chunks, parts) == few


def test_office_texts_are_whole(spark, tmp_path):
    """All of a text, in each kind of body; a document without one keeps its row."""
    import random

    rng = random.Random(1)
    texts = ["".join(rng.choice("ab \n\u00e4(){}[]\\<>&;'\"%") for _ in range(n)) for n in (299, 301, 5_000, 200_000)] + ["<si></si> &amp; stream " * 40 + "TJ] Tj) endstream", "x" * 40_000 + " last", None]
    rows = [(6 * i + k, x, "en", "src0", 1) for i, x in enumerate(texts) for k in range(6)]
    got = against_sql(spark, tmp_path, "office_texts", documents=(rows, DOCUMENTS))
    assert sorted(len(x) for _, x in got if x is not None)[-6] > 100_000 and sum(x is None for _, x in got) == 6
