"""Memory: payload filters, result shapes, context, transcripts, graph writes and registry links."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as x
from . import retrieval

#: fixed values: markup that a retrieved text may not bring along
INJECTED = (
    r"(?i)</?system[^>]*>", r"(?i)\[INST\]|\[/INST\]", r"(?i)<\|im_start\|>|<\|im_end\|>", r"(?i)<\|endoftext\|>", r"(?i)</?assistant[^>]*>", r"(?i)</?user[^>]*>",
    r"(?i)</?relevant-memories[^>]*>", r"<\|.*?\|>",
)
PROPER_NOUN = r"\b([A-Z][a-zA-Z]{2,}(?:\s+[A-Z][a-zA-Z]+)?)\b"
#: fixed values: words that begin sentences
NO_NOUNS = (
    "The", "This", "That", "There", "These", "Those", "They", "It", "Its", "How", "What", "When", "Where", "Why", "Who", "Which", "Can", "Could",
    "Should", "Would", "Will", "Did", "Does", "Do", "Is", "Are", "Was", "Were", "Have", "Has", "Had",
)
#: fixed values: texts that come from the tools themselves
TOOL_MARKS = ("<relevant-memories>", "<system-reminder>", "hookSpecificOutput", "<function_calls>", "<command-name>")
#: fixed values: how commitments are worded; the group is what is promised
COMMITMENTS = (
    r"(?i)\bI['’]ll\s+(\w[\w\s,'’-]{5,120})", r"(?i)\bWe['’]ll\s+(\w[\w\s,'’-]{5,120})", r"(?i)\bremind me to\s+(\w[\w\s,'’-]{3,120})",
    r"(?i)\blet['’]s\s+(\w[\w\s,'’-]{5,120})", r"(?i)\bI['’]m going to\s+(\w[\w\s,'’-]{5,120})", r"(?i)\bpromised to\s+(\w[\w\s,'’-]{5,120})",
    r"(?i)\bwill send\s+(\w[\w\s,'’-]{3,120})", r"(?i)\bdeadline (?:is|of)\s+(\w[\w\s,'’-]{3,120})",
)
NOTE = r"(?im)^\s*(?:-\s*)?NOTE:\s*(.+)$"
#: fixed values: capitalised words that name nobody in a sentence with a date
NOBODY = ("The", "This", "That", "When", "Where", "With")
DEADLINE = (
    r"(?i)\b(?:by|on|before|after|due)\s+(?:Mon|Tues|Wednes|Thurs|Fri|Satur|Sun)day|\b\d{4}-\d{2}-\d{2}\b|"
    r"\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2}\b"
)


def either(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def payload_filter(sources: list[str] | None = None, since: str | None = None, until: str | None = None, people: tuple = (), text: str = "text") -> Column:
    """All of: one of the sources, the day not before and not after, each person named in the text."""
    out = F.lit(True)
    if sources:
        out = out & F.col("source").isin(*sources)
    if since:
        out = out & (F.col("date") >= since)
    if until:
        out = out & (F.col("date") <= until)
    for person in people:
        out = out & F.lower(text).contains(person.lower())
    return out


def contains_literal(column: Column, needle: str) -> Column:
    """As SQL's LIKE between two per cent signs: ASCII case folds, per cent and underscore in the needle are not escaped."""
    pattern = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in needle)
    return column.rlike(f"(?is){pattern}")


def path_matches(path: Column, patterns: list[str]) -> Column:
    """Case-folded: patterns with * ? or [ are globs of the whole path, others stand anywhere in it."""
    low = F.lower(path)

    def one(p: str) -> Column:
        if not any(c in p for c in "*?["):
            return low.contains(p)
        body = re.sub(r"\\\[(.+?)\\\]", lambda m: "[" + m[1].replace("\\", "").replace("!", "^", 1) + "]", re.escape(p)).replace(r"\*", ".*").replace(r"\?", ".")
        return low.rlike(f"(?s)^{body}$")

    return either([one(p.lower()) for p in patterns])


def read_only(query: Column) -> Column:
    """Whether a graph query only reads, by its clauses."""
    return ~query.rlike(r"(?i)\b(?:create|merge|delete|detach|set|remove|drop|call|load|foreach|insert|update|truncate|alter)\b")


def skipped(text: Column) -> Column:
    """Not worth capturing: under 10 or over 4,000 characters, written by a tool, or markup."""
    marked = either([text.contains(m) for m in TOOL_MARKS])
    return F.coalesce((F.length(text) < 10) | (F.length(text) > 4000) | marked | (F.ltrim(text).startswith("<") & text.contains("</")), F.lit(True))


def sanitised(text: Column, most: int = 2000) -> Column:
    """Markup off, spaces folded, long ones cut with three dots."""
    out = reduce(lambda c, p: F.regexp_replace(c, p, ""), INJECTED, F.coalesce(text, F.lit("")))
    out = F.trim(F.regexp_replace(F.regexp_replace(out, "[ \t]+", " "), "\n{3,}", "\n\n"))
    return F.when(F.length(out) > most, F.concat(F.substring(out, 1, most - 3), F.lit("..."))).otherwise(out)


def proper_nouns(text: Column) -> Column:
    return F.array_sort(F.array_except(F.regexp_extract_all(text, F.lit(PROPER_NOUN), F.lit(1)), F.array(*[F.lit(w) for w in NO_NOUNS])))


def captures(blocks: DataFrame, most: int = 40) -> DataFrame:
    """(conv, nth, turn, kind, text, key) of the text blocks (conv, turn, role, text) of conversations: what is worth remembering.

    Notes of anyone, phrases of the user that promise something (the whole phrase up to a full stop or line end, 8 to 200
    characters), and sentences of 15 to 300 characters with a date and a capitalised word that may be a name. Texts that
    aren't worth it are skipped and markup comes off first. Of equal texts of a conversation (case folded) the first stays,
    and the first ``most`` in order.
    """
    clean = blocks.where(~skipped(F.col("text"))).withColumn("s", F.trim(reduce(lambda c, p: F.regexp_replace(c, p, ""), INJECTED, F.col("text"))))
    every = lambda pattern, group: F.regexp_extract_all("s", F.lit(pattern), F.lit(group))
    kind = lambda name, place, found: F.transform(found, lambda v, i: F.struct(F.lit(place).alias("place"), i.alias("i"), F.lit(name).alias("kind"), v.alias("text")))
    notes = F.filter(F.transform(every(NOTE, 1), lambda v: F.regexp_replace(F.trim(v), r"\.+$", "")), lambda v: F.length(v) >= 5)
    said = F.transform(F.concat(*[every(c.replace("(?i)", "(?iU)"), 0) for c in COMMITMENTS]), lambda v: F.substring(F.trim(F.get(F.split(v, r"[.\n]"), F.lit(0))), 1, 200))
    said = F.when(F.col("role") == "user", F.filter(said, lambda v: F.length(v) >= 8)).otherwise(F.array().cast("array<string>"))
    named = lambda v: F.size(F.array_except(F.regexp_extract_all(v, F.lit(r"\b[A-Z][a-zA-Z]{2,}\b"), F.lit(0)), F.array(*[F.lit(w) for w in NOBODY]))) > 0
    dated = F.filter(F.split("s", r"(?<=[.!?])\s+"), lambda v: (F.length(v) >= 15) & (F.length(v) <= 300) & v.rlike(DEADLINE) & named(v))
    found = clean.select("conv", "turn", F.explode(F.concat(kind("note", 0, notes), kind("commitment", 1, said), kind("deadline", 2, F.transform(dated, F.trim)))).alias("x"))
    rows = found.select("conv", "turn", "x.*", F.substring(F.sha2(F.lower("x.text"), 256), 1, 16).alias("key"))
    first = rows.groupBy("conv", "key").agg(F.min(F.struct("turn", "place", "i", "kind", "text")).alias("f")).select("conv", "key", "f.*")
    nth = F.row_number().over(Window.partitionBy("conv").orderBy("turn", "place", "i"))
    return first.withColumn("nth", nth).where(F.col("nth") <= most).select("conv", "nth", "turn", "kind", "text", "key")


def unremembered(found: DataFrame, index: DataFrame, head: int = 40, least: int = 20) -> DataFrame:
    """captures whose first ``head`` characters (case folded, ``least`` at least) stand in no text of the index (id, text)."""
    from . import segments

    needle = F.substring(F.lower("text"), 1, head)
    asked = found.select(needle.alias("chunk")).where(F.char_length("chunk") >= least).distinct()
    held = segments.holding(asked.withColumn("chunk_text", F.col("chunk")), index.select(F.col("id").alias("segment"), F.lower("text").alias("segment_text")), None)
    return found.join(held.select(F.col("chunk").alias("_c")), needle == F.col("_c"), "left_anti")


def effective(final: Column, rerank: Column, dense: Column, fused: Column) -> Column:
    return F.coalesce(final, rerank, dense, fused)


def concise(rows: DataFrame, most: int = 2000) -> DataFrame:
    """What a search shows: path, lines, one score, and the fields that are not empty as a map."""
    given = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))
    fields = F.map_filter(F.create_map(*[v for c in ("source", "date", "title") for v in (F.lit(c), given(c))]), lambda _, v: v.isNotNull())
    score = F.round(effective(F.col("final"), F.col("rerank"), F.col("dense"), F.col("fused")), 3)
    return rows.select("path", F.concat_ws("-", "start_line", "end_line").alias("lines"), score.alias("score"), F.array_join(F.transform(F.array_sort(F.map_entries(fields)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("fields"), x.snippet(F.col("snippet"), most).alias("snippet"))


def mode_label(hybrid: Column, reranked: Column) -> Column:
    """How a search was answered."""
    return F.when(hybrid & reranked, "hybrid-rerank").when(hybrid, "hybrid-rrf").when(reranked, "dense-rerank").otherwise("dense-fallback")


SCORERS = {"overlap": lambda query, text: F.size(F.array_intersect(x.token_set(query), x.token_set(text))) / F.greatest(F.lit(1), F.size(x.token_set(query)))}


def reranked_by(rows: DataFrame, query: str, scorer: str = "overlap", most: int = 24, cut: int = 1500) -> DataFrame:
    """The first ``most`` of ranked rows (id, rank, context, text, recency, importance) scored anew; a scorer is any Column function registered in SCORERS.

    The others keep their order behind them; scorers see context and text, cut.
    """
    seen = F.substring(F.concat_ws("\n", F.nullif("context", F.lit("")), "text"), 1, cut)
    score = F.when(F.col("rank") <= most, SCORERS[scorer](F.lit(query), seen))
    rows = rows.withColumn("rerank", score).withColumn("final", retrieval.reranked(F.col("rerank"), F.col("recency"), F.col("importance")))
    order = Window.orderBy(F.when(F.col("rank") <= most, 0).otherwise(1), F.desc_nulls_last("final"), "rank")
    return rows.withColumn("place", F.row_number().over(order))  # a search's result: bounded by its limit


def context_block(rows: DataFrame, most: int = 200) -> DataFrame:
    """One text: numbered results with their scores."""
    line = F.format_string("%d. [%.2f] %s", "rank", "score", sanitised(F.col("text"), most))
    listed = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))  # a search's result: bounded by its limit
    return rows.agg(F.array_join(F.transform(listed, lambda e: e["line"]), "\n").alias("block"))


def tool_summary(name: Column, args: Column) -> Column:
    """A tool call in a word: file names, commands and patterns cut, else the first text argument. ``args``: JSON."""
    get = lambda k: F.nullif(F.get_json_object(args, f"$.{k}"), F.lit(""))
    low = F.lower(name)
    titled = F.initcap(low)
    call = lambda label, inner: F.when(inner.isNull(), label).otherwise(F.concat(label, F.lit("("), inner, F.lit(")")))
    texts = F.filter(F.map_values(F.from_json(args, "map<string,variant>")), lambda v: F.schema_of_variant(v) == "STRING")
    first = F.filter(F.transform(texts, lambda v: F.variant_get(v, "$", "string")), lambda v: v != "")
    return (
        F.when(low.isin("read", "write", "edit"), call(titled, F.substring_index(get("file_path"), "/", -1)))
        .when(low == "bash", call(titled, F.substring(get("command"), 1, 60)))
        .when(low.isin("grep", "glob"), F.concat(titled, F.lit("("), F.substring(F.coalesce(get("pattern"), F.lit("")), 1, 40), F.lit(")")))
        .when(name == "Agent", F.concat(F.lit("Agent("), F.substring(F.coalesce(get("description"), F.lit("")), 1, 50), F.lit(")")))
        .otherwise(call(name, F.substring(F.get(first, 0), 1, 40)))
    )


BLOCKS = "array<struct<type:string,text:string,name:string,input:string>>"


def content_text(content: Column) -> Column:
    """Text of a message whose content is a string or a JSON list of blocks: texts and tool calls, a line each; results and thoughts are left out."""
    blocks = F.filter(F.from_json(content, BLOCKS), lambda b: b["type"].isin("text", "tool_use"))
    lines = F.transform(blocks, lambda b: F.when(b["type"] == "text", F.nullif(F.trim(b["text"]), F.lit(""))).otherwise(F.concat(F.lit("[Tool: "), tool_summary(b["name"], b["input"]), F.lit("]"))))
    return F.when(F.ltrim(content).startswith("["), F.nullif(F.array_join(F.filter(lines, lambda v: v.isNotNull()), "\n"), F.lit(""))).otherwise(F.nullif(F.trim(content), F.lit("")))


#: fixed values: (pattern of a session's first words, its label, where $1 is what the pattern holds), the first that fits
SESSION_LABELS = (
    (r"^<channel", "orchestrator-session"), (r'<scheduled-task name="([^"]+)"', "scheduled:$1"), (r"skills/([A-Za-z0-9_-]+)/SKILL\.md", "skill:$1"),
    (r"(?i)^execute this nightwatch task", "nightwatch-task"), (r"(?is)^.{0,65}nightwatch task", "nightwatch-task"),
)


def session_label(text: Column, slug: Column) -> Column:
    """What a session is about, from its first words: the first of SESSION_LABELS, else six words, 60 characters at most; without words its slug."""
    t = F.trim(F.coalesce(text, F.lit("")))
    held = lambda p: F.regexp_extract(t, p, 1) if "(" in p.replace("(?", "") else F.lit("")
    ruled = [F.when(t.rlike(p), F.replace(F.lit(label), F.lit("$1"), held(p))) for p, label in SESSION_LABELS]
    words = F.substring(F.array_join(F.slice(F.split(t, r"\s+"), 1, 6), " "), 1, 60)
    return F.when(t == "", F.coalesce(slug, F.lit("unknown"))).otherwise(F.coalesce(*ruled, words))


def merged_fragments(rows: DataFrame, key: str, order: str, at: str, text: str) -> DataFrame:
    """(key, at, text): streamed fragments of one message, joined in order, at the first one's time. A message is bounded by its own size."""
    parts = F.array_sort(F.collect_list(F.struct(order, text)))
    return rows.groupBy(key).agg(F.min(at).alias("first_at"), F.array_join(F.transform(parts, lambda p: p[text]), "").alias("text"))


def subset_slices(slices: DataFrame) -> DataFrame:
    """Names of slices (session, name, s, e, messages) whose messages all stand in a sibling that covers their time; of equal times the first name stays."""
    a = slices.select("session", "name", "s", "e", "messages")
    b = slices.select("session", F.col("name").alias("other"), F.col("s").alias("os"), F.col("e").alias("oe"), F.col("messages").alias("held"))
    inside = (F.col("os") <= F.col("s")) & (F.col("e") <= F.col("oe")) & (F.col("name") != F.col("other"))
    tie = (F.col("os") == F.col("s")) & (F.col("oe") == F.col("e")) & (F.col("other") > F.col("name"))
    pairs = a.join(b, "session").where(inside & ~tie).where(F.size(F.array_except("messages", "held")) == 0)
    return pairs.select("session", "name").distinct()


def context_gate(bulk: Column, chars: Column, least_tokens: Column, segments: Column, most: int = 540_000) -> Column:
    """Why a document gets no context, in order, or that it does."""
    return F.when(bulk, "bulk mail").when((least_tokens > 0) & (chars < least_tokens * 4), "below threshold").when((chars > most) & (segments <= 1), "oversized").otherwise("eligible")


def invalidated(edges: DataFrame, uuids: list[int], pairs: DataFrame, at: str, reason: str) -> DataFrame:
    """edges (id, src, dst, type, invalid_at) with those named by id or by (src, dst, type) stamped; stamped ones stay as they are."""
    named = edges.join(F.broadcast(pairs.withColumn("hit", F.lit(True))), ["src", "dst", "type"], "left")  # the request: a few rows
    hit = (F.col("id").isin(*uuids) | F.coalesce("hit", F.lit(False))) & F.col("invalid_at").isNull()
    return named.select("id", "src", "dst", "type", F.when(hit, F.lit(at).cast("timestamp_ntz")).otherwise(F.col("invalid_at")).alias("invalid_at"), F.when(hit, reason).alias("reason"))


def linked(nodes: DataFrame, names: DataFrame, owners: DataFrame) -> DataFrame:
    """(uuid, state) of graph nodes (uuid, name) against registry names (name, person) and owners (uuid, owner).

    no match, ambiguous, conflict, already, linked; of several nodes for one person the first by uuid is linked, the rest conflict.
    """
    found = names.select(F.lower(F.trim("name")).alias("n"), "person").distinct().groupBy("n").agg(F.count("*").alias("k"), F.min("person").alias("person"))
    rows = nodes.select("uuid", F.lower(F.trim("name")).alias("n")).join(found, "n", "left").join(owners, "uuid", "left")
    taken = owners.select(F.col("owner").alias("person")).distinct().withColumn("taken", F.lit(True))
    state = F.when(F.col("k").isNull(), "no match").when(F.col("k") > 1, "ambiguous").when(F.col("owner").isNotNull() & (F.col("owner") != F.col("person")), "conflict").when(F.col("owner").isNotNull(), "already").when(F.col("taken"), "conflict")
    rows = rows.join(taken, "person", "left").withColumn("state", state)
    first = rows.where("state is null").groupBy("person").agg(F.min("uuid").alias("first"))
    return rows.join(first, "person", "left").select("uuid", F.coalesce("state", F.when(F.col("uuid") == F.col("first"), "linked").otherwise("conflict")).alias("state"))
