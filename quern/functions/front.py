"""Front matter as typed values: the usual subset of YAML, read block by block."""

from __future__ import annotations

import datetime as dt
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = re.compile(r"""(?:"((?:[^"\\]|\\.)*)"|'((?:[^']|'')*)'|([^\s#&*!|>'"%@`\-\[\]{},:?][^:#]*?|[\-?:](?=\S)[^:#]*?))\s*:(?:\s+|$)""")
PLAIN = re.compile(r"^([A-Za-z_][\w-]*):\s*(.*)$")  # of the fallback
WORDS = {"true": True, "yes": True, "on": True, "false": False, "no": False, "off": False, "null": None, "~": None, "": None}
INTEGER, FLOAT = re.compile(r"[-+]?(?:0|[1-9][0-9_]*)$"), re.compile(r"[-+]?(?:[0-9][0-9_]*)?\.[0-9_]*(?:[eE][-+][0-9]+)?$|[-+]?\.inf$|\.nan$", re.I)
BASED = re.compile(r"[-+]?0x[0-9a-fA-F_]+$|[-+]?0[0-7_]+$")
SIXTIES = re.compile(r"[-+]?[1-9][0-9_]*(?::[0-5]?[0-9])+$")
DATE = re.compile(r"\d{4}-\d{2}-\d{2}$")
TIME = re.compile(r"(\d{4})-(\d{1,2})-(\d{1,2})(?:[Tt]|[ \t]+)(\d{1,2}):(\d{2}):(\d{2})(?:\.(\d*))?(?:[ \t]*(Z|[-+]\d{1,2}(?::?\d{2})?))?$")
ESCAPES = {"n": "\n", "t": "\t", '"': '"', "\\": "\\", "/": "/", "0": "\0", "r": "\r"}


class Unreadable(ValueError):
    """Not in the subset: the caller falls back to plain lines."""


def scalar(text: str):
    """A plain or quoted value."""
    text = text.strip()
    if text[:1] == '"':
        m = re.fullmatch(r'"((?:[^"\\]|\\.)*)"', text, re.S)
        if not m:
            raise Unreadable(text)
        return re.sub(r"\\(.)", lambda e: ESCAPES.get(e[1], "\\" + e[1]), m[1])
    if text[:1] == "'":
        m = re.fullmatch(r"'((?:[^']|'')*)'", text, re.S)
        if not m:
            raise Unreadable(text)
        return m[1].replace("''", "'")
    if text[:1] in "[{":
        return flow(text)
    if text[:1] in "&*!|>%@`" and text or re.search(r":(\s|$)", text):
        raise Unreadable(text)
    if text.lower() in WORDS and text in (text.lower(), text.upper(), text.capitalize()):
        return WORDS[text.lower()]
    if INTEGER.match(text):
        return int(text.replace("_", ""))
    if BASED.match(text):  # hexadecimal, and octal by a zero in front
        digits = text.replace("_", "")
        return int(digits, 16) if "x" in digits else int(digits, 8)
    if SIXTIES.match(text):  # 1:30 is ninety
        sign, total = (-1 if text[0] == "-" else 1), 0
        for part in text.lstrip("+-").replace("_", "").split(":"):
            total = 60 * total + int(part)
        return sign * total
    if FLOAT.match(text) and re.search(r"\d", text):
        return float(text.replace("_", ""))
    if DATE.match(text):
        try:
            return dt.date.fromisoformat(text).isoformat()
        except ValueError as e:
            raise Unreadable(text) from e
    if m := TIME.match(text):
        at = dt.datetime(*map(int, m.groups()[:6]))
        if m[8] and m[8] != "Z":
            sign, rest = (-1 if m[8][0] == "-" else 1), m[8][1:].replace(":", "")
            hours, minutes = (int(rest), 0) if len(rest) <= 2 else (int(rest[:-2]), int(rest[-2:]))
            at -= sign * dt.timedelta(hours=hours, minutes=minutes)
        return at.isoformat() + ("Z" if m[8] else "")
    return text


def flow(text: str):
    """[a, b] and {a: b}, nested."""
    at = 0

    def blank() -> None:
        nonlocal at
        while at < len(text) and text[at] in " \t\n":
            at += 1

    def value(stop: str):
        nonlocal at
        blank()
        if at < len(text) and text[at] == "[":
            at += 1
            out = []
            while True:
                blank()
                if at >= len(text):
                    raise Unreadable(text)
                if text[at] == "]":
                    at += 1
                    return out
                out.append(value(",]"))
                blank()
                if at < len(text) and text[at] == ",":
                    at += 1
        if at < len(text) and text[at] == "{":
            at += 1
            made = {}
            while True:
                blank()
                if at >= len(text):
                    raise Unreadable(text)
                if text[at] == "}":
                    at += 1
                    return made
                name = value(":,}")
                blank()
                made[str(name)] = None
                if at < len(text) and text[at] == ":":
                    at += 1
                    made[str(name)] = value(",}")
                    blank()
                if at < len(text) and text[at] == ",":
                    at += 1
        if at < len(text) and text[at] in "\"'":
            m = re.compile(r'"(?:[^"\\]|\\.)*"' if text[at] == '"' else r"'(?:[^']|'')*'", re.S).match(text, at)
            if not m:
                raise Unreadable(text)
            at = m.end()
            return scalar(m[0])
        begin = at
        while at < len(text) and text[at] not in stop:
            at += 1
        return scalar(text[begin:at])

    out = value("")
    blank()
    if at != len(text):
        raise Unreadable(text)
    return out


def bare(line: str) -> str:
    """Without a comment: # at the beginning or behind a space, outside quotes."""
    quote = ""
    for i, c in enumerate(line):
        if quote:
            if c == quote and not (quote == '"' and line[i - 1] == "\\"):
                quote = ""
        elif c in "\"'" and (i == 0 or line[i - 1] in " [{,:-"):
            quote = c
        elif c == "#" and (i == 0 or line[i - 1] in " \t"):
            return line[:i].rstrip()
    return line.rstrip()


class _Block:
    def __init__(self, text: str) -> None:
        self.lines, self.at = text.split("\n"), 0
        if any(line.lstrip(" ").startswith("\t") for line in self.lines if line.strip()):
            raise Unreadable("tabs as indents")

    def peek(self) -> tuple[int, str] | None:
        """(indent, text) of the next line that says something."""
        while self.at < len(self.lines):
            text = bare(self.lines[self.at])
            if text.strip():
                return len(text) - len(text.lstrip(" ")), text.strip()
            self.at += 1
        return None

    def node(self, indent: int):
        text = self.peek()[1]
        if text == "-" or text.startswith("- "):
            return self.items(indent)
        if KEY.match(text):
            return self.fields(indent)
        return self.folded_plain(indent - 1, "")

    def items(self, indent: int) -> list:
        out = []
        while (now := self.peek()) and now[0] == indent and (now[1] == "-" or now[1].startswith("- ")):
            rest = now[1][1:].strip()
            if rest and KEY.match(rest) or rest.startswith("- "):
                inner = indent + len(now[1]) - len(rest)
                self.lines[self.at] = " " * inner + rest
                out.append(self.node(inner))
            else:
                self.at += 1
                out.append(self.value(rest, indent))
        if now and now[0] > indent:
            raise Unreadable(now[1])
        return out

    def fields(self, indent: int) -> dict:
        out = {}
        while (now := self.peek()) and now[0] == indent:
            m = KEY.match(now[1])
            if not m:
                raise Unreadable(now[1])
            self.at += 1
            name = next(g for g in m.groups() if g is not None)
            out[str(name)] = self.value(now[1][m.end() :].strip(), indent, True)  # the last of equal keys stays
        if now and now[0] > indent:
            raise Unreadable(now[1])
        return out

    def value(self, rest: str, indent: int, field: bool = False):
        if rest[:1] in ("|", ">") and re.fullmatch(r"[|>][+-]?", rest):
            return self.literal(rest, indent)
        if rest:
            if rest[0] in "[{":
                while rest.count(rest[0]) > rest.count({"[": "]", "{": "}"}[rest[0]]) and self.at < len(self.lines):
                    rest += " " + bare(self.lines[self.at]).strip()
                    self.at += 1
                return flow(rest)
            return self.folded_plain(indent, rest)
        now = self.peek()
        if now and (now[0] > indent or field and now[0] == indent and (now[1] == "-" or now[1].startswith("- "))):
            return self.node(now[0])
        return None

    def folded_plain(self, indent: int, text: str):
        """A plain or quoted scalar that may go on in deeper lines."""
        while (now := self.peek()) and now[0] > indent:
            if text and text[0] not in "\"'" and KEY.match(now[1]):
                raise Unreadable(now[1])
            text = f"{text} {now[1]}".strip()
            self.at += 1
        return scalar(text)

    def literal(self, mark: str, indent: int) -> str:
        held, deep = [], None
        while self.at < len(self.lines):
            line = self.lines[self.at]
            own = len(line) - len(line.lstrip(" "))
            if line.strip() and own <= indent:
                break
            if line.strip() and deep is None:
                deep = own
            held.append(line[deep or 0 :] if line.strip() else "")
            self.at += 1
        while held and not held[-1]:
            held.pop()
        text = "\n".join(held) if mark[0] == "|" else re.sub(r"(?<!\n)\n(?!\n)", " ", "\n".join(held)).replace("\n\n", "\n")
        return text if mark.endswith("-") or not held else text + "\n"


def parsed(block: str) -> dict:
    """The fields of a block; one that is not in the subset, or not a map, is read as plain lines with raw values."""
    try:
        reader = _Block(block)
        now = reader.peek()
        out = reader.node(now[0]) if now else {}
        if isinstance(out, dict) and reader.peek() is None:
            return out
    except (Unreadable, IndexError, ValueError, RecursionError):
        pass
    return {m[1]: m[2].strip() for line in block.splitlines() if (m := PLAIN.match(line))}


def block_of(text: str | None) -> str | None:
    """What stands between the marks at the very beginning."""
    if not text or not text.startswith("---"):
        return None
    end = text.find("\n---", 3)
    return text[3:end] if end >= 0 else None


@F.pandas_udf(T.StringType())
def _json(texts: pd.Series) -> pd.Series:
    return pd.Series([json.dumps(parsed(b), ensure_ascii=False) if (b := block_of(t)) is not None else "{}" for t in texts], dtype="object")


def front_matter(text: Column) -> Column:
    """The front matter of a text as a VARIANT; an empty object where there is none. Dates and times are ISO texts."""
    return F.parse_json(_json(text))
