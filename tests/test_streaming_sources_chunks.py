import datetime as dt
import json
import random

from pyspark.sql import functions as F

from quern.operators import chunks
from quern.sources import files
from quern.streaming import events

START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def queue(folder, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{len(list(folder.iterdir()))}.jsonl").write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")


def event(seq, minutes, content="x", **meta):
    return {"seq": seq, "ts": (START + dt.timedelta(minutes=minutes)).isoformat(), "content": content, "meta": meta}


def test_stream_keeps_its_place_and_counts_fates(spark, tmp_path):
    q, out, mark = tmp_path / "q", str(tmp_path / "out"), str(tmp_path / "mark")
    noise = {"sync": "^no changes"}

    def go():
        events.run_all(events.fates(events.parsed(events.lines(spark, str(q))), noise), out, mark)
        return {(r["seq"], r["fate"]) for r in spark.read.parquet(out).collect()}

    queue(q, [event(0, 0, "no changes here", job="sync", event_type="job_complete", status="ok"), event(1, 1, "3 new", job="sync", event_type="job_complete", status="ok"), "{broken"])
    assert go() == {(0, "dropped"), (1, "delivered"), (None, "delivered")}
    queue(q, [event(2, 2, "no changes", job="sync", event_type="job_complete", status="error"), event(3, 3, "alert")])
    assert go() == {(0, "dropped"), (1, "delivered"), (None, "delivered"), (2, "delivered"), (3, "delivered")}


def test_sessions_end_at_the_gap_and_slices_need_three(spark, tmp_path):
    q = tmp_path / "q"
    queue(q, [event(i, m, who="a") for i, m in enumerate([0, 1, 2, 122, 123, 600])])
    rows = events.parsed(events.lines(spark, str(q))).withColumn("who", F.col("meta")["who"])
    events.run_all(events.sessions(rows, "who"), str(tmp_path / "s"), str(tmp_path / "sm"))
    got = {(r["start"].minute + 60 * r["start"].hour, r["n"]) for r in spark.read.parquet(str(tmp_path / "s")).collect()}
    assert got == {(0, 3), (122, 2)}
    events.run_all(events.slices(rows, "who"), str(tmp_path / "w"), str(tmp_path / "wm"))
    assert {r["n"] for r in spark.read.parquet(str(tmp_path / "w")).collect()} == {3}


def test_repeats_are_dropped_for_a_while(spark, tmp_path):
    q = tmp_path / "q"
    queue(q, [event(1, 0, id="g"), event(2, 0.2, id="g"), event(3, 0.4, id="h")])
    rows = events.parsed(events.lines(spark, str(q))).withColumn("id", F.col("meta")["id"])
    events.run_all(events.once(rows, "id"), str(tmp_path / "o"), str(tmp_path / "om"))
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "o")).collect()) == ["g", "h"]


def test_replay_prune_and_bodies(spark):
    now = START + dt.timedelta(hours=5)
    rows = spark.createDataFrame([(i, START + dt.timedelta(hours=i)) for i in range(5)], "seq long, ts timestamp")
    assert [r["seq"] for r in events.replayed(rows, 2, now).collect()] == [3, 4]
    assert [r["seq"] for r in events.replayed(rows, 0, now).collect()] == [3, 4]
    assert events.replayed(rows, None, now).count() == 0
    lines = spark.createDataFrame([(json.dumps({"ts": "2023-12-01T00:00:00Z"}),), (json.dumps({"ts": "2024-01-01T00:00:00Z"}),), ("{bad",)], "value string")
    assert events.pruned(lines, now).count() == 2
    posted = spark.createDataFrame([(START, "/ci", '{"message": "", "text": "hi", "type": "note"}'), (START, "/", "plain")], "ts timestamp, path string, body string")
    assert [tuple(r)[1:] for r in events.received(posted).collect()] == [("hi", "note", "ci"), ("plain", "webhook", "unknown")]


def test_line_packing_by_hand():
    assert chunks.by_lines("aaa\nbbb\nccc\ndd", 10, 4) == [(0, 1, "aaa\nbbb"), (1, 2, "bbb\nccc"), (2, 3, "ccc\ndd")]
    assert chunks.by_lines(" \n ", 10, 4) == []
    assert [c for _, _, c in chunks.by_lines("x" * 30 + "\nab", 10, 0)] == ["x" * 30, "ab"]


def test_without_overlap_nothing_is_lost(spark):
    rng = random.Random(1)
    texts = ["\n".join("".join(rng.choice("abc ") for _ in range(rng.randrange(30))) for _ in range(rng.randrange(1, 40))) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(99, None), (98, "---\na: b\n---\nbody")], "doc_id long, text string")
    rows = chunks.chunked(docs, "doc_id", "text", tokens=20, overlap=0).collect()
    for i, t in enumerate(texts):
        mine = sorted((r["n"], r["chunk"]) for r in rows if r["doc_id"] == i)
        assert "\n".join(c for _, c in mine) == (t if t.strip() else "")
        assert all(len(c) < 80 or "\n" not in c for _, c in mine)
    assert [r["chunk"] for r in rows if r["doc_id"] == 98] == ["body"]
    assert not [r for r in rows if r["doc_id"] == 99]


def test_heads_and_messages():
    text = "intro\n## Turn 1\nhello\n## Turn 2\nworld"
    assert [c for _, _, c in chunks.by_heads(text, chunks.HEADS["turns"], 20, 0)] == ["intro", "## Turn 1\nhello", "## Turn 2\nworld"]
    assert [c for _, _, c in chunks.by_heads("**A** (1): x **B** (2): y", chunks.HEADS["speaker"], 10, 0)] == ["**A** (1): x", "**B** (2): y"]
    parts = chunks.messages("word " * 50, 100)
    assert all(len(p) <= 100 for p in parts) and parts[0].endswith(f"(1/{len(parts)})")
    assert chunks.messages("short", 100) == ["short"]
    assert chunks.messages("a" * 55 + "\n" + "b" * 60, 100) == ["a" * 55 + " (1/2)", "b" * 60 + " (2/2)"]
    assert chunks.messages("a" * 44 + " " + "b" * 60, 100) == ["a" * 44 + " " + "b" * 45 + " (1/2)", "b" * 15 + " (2/2)"]  # a space before the middle is no place to cut
    assert chunks.messages("a" * 95 + "    ", 100) == ["a" * 95 + "    "]
    sections = "## A\none\n## B\n" + "\n".join(["x" * 8] * 4)
    assert [c for _, _, c in chunks.by_sections(sections, 20, 0)] == ["## A\none", "## B\nxxxxxxxx", "xxxxxxxx\nxxxxxxxx", "xxxxxxxx"]


def test_markdown_tree(spark, tmp_path):
    for name, text in {"mail/a.md": "---\nsubject: 'Hi: you'\nfrom: ann\n---\nBody\nline", "mail/.hidden.md": "x", "photos/p.md": "no", "notes/b.md": "plain", "notes/c.txt": "no"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    rows = {r["file_path"]: r for r in files.documents(files.markdown(spark, str(tmp_path), ("photos/",), "@x/")).collect()}
    assert set(rows) == {"@x/mail/a.md", "@x/notes/b.md"}
    a = rows["@x/mail/a.md"]
    assert (a["subject"], a["from"], a["title"], a["body"]) == ("Hi: you", "ann", None, "Body\nline")
    assert rows["@x/notes/b.md"]["body"] == "plain" and rows["@x/notes/b.md"]["frontmatter"] == {}


def test_json_lines_binaries_and_days(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n{"a": \n{"a": 2}\n')
    assert sorted(r["a"] for r in files.json_lines(spark, str(tmp_path / "l.jsonl"), "a long").collect()) == [1, 2]
    data = [(0, b"plain text\n"), (1, b"a\x00b"), (2, b""), (3, bytes([1, 2, 3, 65])), (4, "é".encode() * 50), (5, b"tab\tback\x08" * 9)]
    rows = spark.createDataFrame([(i, bytearray(b)) for i, b in data], "i int, content binary")
    assert {r["i"]: r["b"] for r in rows.select("i", files.is_binary(F.col("content")).alias("b")).collect()} == {0: False, 1: True, 2: False, 3: True, 4: True, 5: False}
    days = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2024, 1, 2))], "x int, at timestamp")
    files.by_day(days, str(tmp_path / "d"), "at")
    files.by_day(days.where("x = 2").withColumn("x", F.lit(9)), str(tmp_path / "d"), "at")
    assert sorted(r["x"] for r in spark.read.parquet(str(tmp_path / "d")).collect()) == [1, 9]
