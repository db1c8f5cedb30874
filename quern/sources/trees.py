"""Rich trees as Markdown: document nodes in JSON, storage-format pages, and lifelog trees. Recursion runs inside a batch."""

from __future__ import annotations

import json
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARKS = {"strong": "**{}**", "em": "*{}*", "code": "`{}`", "strike": "~~{}~~"}


def node_text(node: dict) -> str:
    """One node of a document tree as Markdown, its children first."""
    kind, attrs = node.get("type", ""), node.get("attrs") or {}
    if kind == "text":
        out = node.get("text", "")
        for mark in node.get("marks") or []:
            if mark.get("type") == "link":
                out = f"[{out}]({(mark.get('attrs') or {}).get('href', '')})"
            else:
                out = MARKS.get(mark.get("type"), "{}").format(out)
        return out
    inner = [node_text(c) for c in node.get("content") or []]
    joined = "".join(inner)
    if kind == "heading":
        return f"{'#' * int(attrs.get('level', 1))} {joined}\n\n"
    if kind == "paragraph":
        return joined + "\n\n"
    if kind == "hardBreak":
        return "\n"
    if kind in ("bulletList", "orderedList"):
        marks = ("- " if kind == "bulletList" else f"{i}. " for i in range(1, len(inner) + 1))
        return "".join(m + item.strip().replace("\n", "\n  ") + "\n" for m, item in zip(marks, inner, strict=True)) + "\n"
    if kind == "codeBlock":
        return f"```{attrs.get('language') or ''}\n{joined}\n```\n\n"
    if kind == "blockquote":
        return "".join(f"> {line}\n" for line in joined.strip().split("\n")) + "\n"
    if kind == "rule":
        return "---\n\n"
    if kind == "mention":
        return attrs.get("text") or "@" + str(attrs.get("id", ""))
    if kind in ("inlineCard", "blockCard"):
        return attrs.get("url", "")
    if kind == "emoji":
        return attrs.get("shortName", "")
    if kind == "tableRow":
        return "| " + " | ".join(c.strip().replace("\n", " ") for c in inner) + " |\n"
    if kind == "table":
        head, *rest = inner or [""]
        return head + "|" + " --- |" * head.count(" | ") + " --- |\n" + "".join(rest) + "\n" if inner else ""
    return joined


class Storage(HTMLParser):
    """A storage-format page as Markdown."""

    LEAD = {"h1": "# ", "h2": "## ", "h3": "### ", "h4": "#### ", "li": "- "}
    WRAP = {"strong": "**", "b": "**", "em": "*", "i": "*", "code": "`"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.links: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "ac:parameter"):
            self.hidden += 1
        elif tag in self.LEAD:
            self.out.append("\n" + self.LEAD[tag])
        elif tag in self.WRAP:
            self.out.append(self.WRAP[tag])
        elif tag == "a":
            self.links.append(dict(attrs).get("href") or "")
            self.out.append("[")
        elif tag in ("br", "tr"):
            self.out.append("\n")
        elif tag in ("td", "th"):
            self.out.append("| ")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "ac:parameter"):
            self.hidden = max(0, self.hidden - 1)
        elif tag in self.WRAP:
            self.out.append(self.WRAP[tag])
        elif tag == "a":
            self.out.append(f"]({self.links.pop() if self.links else ''})")
        elif tag in ("p", "h1", "h2", "h3", "h4", "ul", "ol", "table"):
            self.out.append("\n\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def storage_text(page: str) -> str:
    parser = Storage()
    parser.feed(page)
    parser.close()
    lines = [line.rstrip() for line in "".join(parser.out).split("\n")]
    return "\n".join(line for i, line in enumerate(lines) if line or (i and lines[i - 1])).strip()


def lifelog(nodes: list[dict], me: str = "You") -> list[tuple[int, str, str | None, str]]:
    """(depth, type, speaker, content) of a tree of typed nodes, depth first; the wearer is called You."""
    out, todo = [], [(0, n) for n in reversed(nodes)]
    while todo:
        depth, n = todo.pop()
        speaker = me if n.get("speakerIdentifier") == "user" else n.get("speakerName")
        if n.get("content"):
            out.append((depth, n.get("type", ""), speaker, n["content"]))
        todo += [(depth + 1, c) for c in reversed(n.get("children") or [])]
    return out


def _load(raw: str | None):
    try:
        return json.loads(raw) if raw else None
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def markdown_of_tree(tree: pd.Series) -> pd.Series:
    loaded = (_load(x) for x in tree)
    return pd.Series([node_text(x).strip() if isinstance(x, dict) else None for x in loaded], dtype="object")


@F.pandas_udf(T.StringType())
def markdown_of_storage(page: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else storage_text(x) for x in page], dtype="object")


_ROW = T.StructType([T.StructField("depth", T.IntegerType()), *(T.StructField(c, T.StringType()) for c in ("type", "speaker", "content"))])


@F.pandas_udf(T.ArrayType(_ROW))
def flattened(tree: pd.Series) -> pd.Series:
    keys = ("depth", "type", "speaker", "content")
    return pd.Series([[dict(zip(keys, r, strict=True)) for r in lifelog(_load(x) or [])] for x in tree], dtype="object")
