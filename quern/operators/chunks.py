"""Chunking: texts cut into pieces of bounded size with overlap.

Packing depends on what was packed before it (the overlap is carried), so each
text is packed in one Arrow-batched function; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PER_TOKEN = 4  # characters
#: fixed values: what begins a piece, by kind of source
HEADS = {
    "speaker": re.compile(r"(?=\*\*[^*]+\*\*\s*\()"),
    "sections": re.compile(r"(?m)^(?=#{2,3}\s)"),
    "turns": re.compile(r"(?m)^(?=## Turn \d+)"),
    "header": re.compile(r"(?m)^(?=#{1,4}\s)"),
}
FRONT = re.compile(r"\A---\n.*?\n---\n", re.S)


def packed(pieces: list[str], most: int, overlap: int, cost: int) -> Iterator[tuple[int, int]]:
    """(first, last) piece of each chunk: full at ``most`` characters, beginning with what fits the overlap.

    Each piece costs its length and ``cost`` for what joins it; one too long stands alone.
    """
    begin, size = 0, 0
    for i, piece in enumerate(pieces):
        own = len(piece) + cost
        if size + own > most and i > begin:
            yield begin, i - 1
            back, kept = i, 0
            while back > begin and kept + len(pieces[back - 1]) + cost <= overlap:
                back -= 1
                kept += len(pieces[back]) + cost
            begin, size = back, kept
        size += own
    if pieces:
        yield begin, len(pieces) - 1


def by_lines(text: str, most: int, overlap: int) -> list[tuple[int, int, str]]:
    """(first line, last line, chunk), lines counted from 0; blank texts have none."""
    if not text.strip():
        return []
    lines = text.split("\n")
    return [(a, b, "\n".join(lines[a : b + 1])) for a, b in packed(lines, most, overlap, 1)]


def by_heads(text: str, head: re.Pattern, most: int, overlap: int) -> list[tuple[int, int, str]]:
    """Pieces begin where ``head`` matches and are packed whole."""
    if not text.strip():
        return []
    pieces = [p.strip() for p in head.split(text) if p.strip()]
    return [(0, 0, "\n\n".join(pieces[a : b + 1])) for a, b in packed(pieces, most, overlap, 2)]


def messages(text: str, most: int) -> list[str]:
    """Parts to deliver, cut at a blank line, a line or a space from the middle on, numbered if there are several; ten characters are kept for the number."""
    if len(text) <= most:
        return [text]
    out, room = [], most - 10
    while len(text) > room:
        cut = next((at for mark in ("\n\n", "\n", " ") if (at := text.rfind(mark, 0, room + len(mark))) >= room // 2), room)
        out.append(text[:cut].rstrip())
        text = text[cut:].lstrip()
    out += [text] if text else []
    return out if len(out) == 1 else [f"{p} ({i}/{len(out)})" for i, p in enumerate(out, 1)]


def by_sections(text: str, most: int, overlap: int) -> list[tuple[int, int, str]]:
    """Sections that fit are a chunk each; others are packed by lines."""
    out = []
    for piece in (p.strip() for p in HEADS["sections"].split(text) if p.strip()):
        out += [(0, 0, piece)] if len(piece) <= most else [(0, 0, c) for _, _, c in by_lines(piece, most, overlap)]
    return out


def _cutter(strategy: str, most: int, overlap: int) -> Callable[[str], list[tuple[int, int, str]]]:
    if strategy == "lines":
        return lambda t: by_lines(t, most, overlap)
    if strategy == "sections":
        return lambda t: by_sections(t, most, overlap)
    return lambda t: by_heads(t, HEADS[strategy], most, overlap)


#: fixed values: (tokens, overlap, strategy) by source
STRATEGIES = {
    "imessage": (300, 30, "speaker"), "o365-mail": (400, 40, "lines"), "google-mail": (400, 40, "lines"), "o365-teams": (400, 40, "speaker"), "o365-sharepoint": (512, 50, "header"),
    "fireflies": (600, 60, "sections"), "limitless": (600, 60, "speaker"), "jira": (512, 50, "header"), "linear": (512, 50, "header"), "confluence": (512, 50, "header"),
    "bitbucket": (512, 50, "header"), "sessions": (600, 60, "turns"), "documents": (512, 50, "header"), "notes": (512, 50, "header"), "memory": (512, 50, "header"),
    "default": (512, 50, "lines"),
}


def dispatched(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(key, source, n, start_line, end_line, chunk): each text by its source's strategy and size."""
    cutters = {s: _cutter(how, tokens * PER_TOKEN, overlap * PER_TOKEN) for s, (tokens, overlap, how) in STRATEGIES.items()}

    def run(batches):
        for pdf in batches:
            rows = [(k, s, n, *c) for k, t, s in zip(pdf[key], pdf[text], pdf[source], strict=True) for n, c in enumerate(cutters.get(s, cutters["default"])(FRONT.sub("", t or "")))]
            yield pd.DataFrame(rows, columns=[key, "source", "n", "start_line", "end_line", "chunk"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text, source).mapInPandas(run, f"`{key}` {kind}, source string, n int, start_line int, end_line int, chunk string")


def delivered(docs: DataFrame, key: str, text: str, most: int) -> DataFrame:
    """(key, n, part): texts as messages of at most ``most`` characters (numbers from 100 on may exceed it)."""

    def run(batches):
        for pdf in batches:
            rows = [(k, n, p) for k, t in zip(pdf[key], pdf[text], strict=True) for n, p in enumerate(messages(t or "", most))]
            yield pd.DataFrame(rows, columns=[key, "n", "part"])

    return docs.select(key, text).mapInPandas(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n int, part string")


def chunked(docs: DataFrame, key: str, text: str, strategy: str = "lines", tokens: int = 512, overlap: int = 50) -> DataFrame:
    """(key, n, start_line, end_line, chunk) of each text; front matter is left out."""
    cut = _cutter(strategy, tokens * PER_TOKEN, overlap * PER_TOKEN)

    def run(batches):
        for pdf in batches:
            rows = [(k, n, *c) for k, t in zip(pdf[key], pdf[text], strict=True) for n, c in enumerate(cut(FRONT.sub("", t or "")))]
            yield pd.DataFrame(rows, columns=[key, "n", "start_line", "end_line", "chunk"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInPandas(run, f"`{key}` {kind}, n int, start_line int, end_line int, chunk string")


def with_context(chunks: DataFrame, context: str, chunk: str) -> DataFrame:
    """The text to embed: context, a blank line, the chunk; no context, no line."""
    return chunks.withColumn("embed_text", F.concat_ws("\n\n", F.nullif(F.trim(context), F.lit("")), chunk))
