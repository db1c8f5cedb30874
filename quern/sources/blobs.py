"""Texts out of binary bodies: office files, compressed notes, attributed strings. By batches, never by rows on the driver."""

from __future__ import annotations

import gzip
import html
import io
import re
import zipfile
import zlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

PLAIN = re.compile(r"[ -~\n\t\u00a0-\ufffc]{10,}")
_TAG = re.compile(r"<[^>]+>")


def _xml_text(raw: bytes, breaks: str) -> str:
    text = re.sub(rf"</(?:{breaks})>", "\n", raw.decode("utf-8", "replace"))
    return html.unescape(_TAG.sub("", text)).strip()


def _zip_parts(content: bytes, pattern: str) -> list[bytes]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = [n for n in z.namelist() if re.fullmatch(pattern, n)]
        return [z.read(n) for n in sorted(names, key=lambda n: (len(n), n))]


def _sheets(content: bytes) -> str:
    """Rows of all sheets, cells by tabs; shared strings resolved."""
    shared = [html.unescape(_TAG.sub("", s)) for part in _zip_parts(content, r"xl/sharedStrings\.xml") for s in re.findall(r"<si>(.*?)</si>", part.decode("utf-8", "replace"), re.S)]
    out = []
    for sheet in _zip_parts(content, r"xl/worksheets/sheet\d+\.xml"):
        for row in re.findall(r"<row[^>]*>(.*?)</row>", sheet.decode("utf-8", "replace"), re.S):
            cells = re.findall(r"<c\b([^>]*)>(.*?)</c>", row, re.S)
            values = [(a, html.unescape(_TAG.sub("", v))) for a, v in cells]
            out.append("\t".join(shared[int(v)] if 't="s"' in a else v for a, v in values))
    return "\n".join(out)


def _rtf(content: bytes) -> str:
    text = re.sub(r"\{\\\*?\\?(?:fonttbl|colortbl|stylesheet|info)[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", "{}", content.decode("latin-1"))
    text = re.sub(r"[{}]|\\[a-z]+-?\d* ?", "", re.sub(r"\\(?:par|line)\b ?", "\n", text)).strip()
    return re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes([int(m[1], 16)]).decode("cp1252", "replace"), text)


def _pdf(content: bytes) -> str:
    """What text operators show in the streams of a PDF, plain or deflated."""
    out = []
    for raw in re.findall(rb"stream\r?\n(.*?)\r?\nendstream", content, re.S):
        try:
            raw = zlib.decompressobj().decompress(raw)  # a stream may lose its last byte to the line break before its end
        except zlib.error:
            pass
        for shown in re.findall(rb"\[(.*?)\]\s*TJ|(\((?:\\.|[^\\)])*\))\s*Tj", raw, re.S):
            strings = re.findall(rb"\(((?:\\.|[^\\)])*)\)", shown[0] or shown[1], re.S)
            out.append(re.sub(rb"\\([()\\])", rb"\1", b"".join(strings)).decode("latin-1"))
    return "\n".join(out)


#: by extension; anything else is taken as UTF-8
READERS = {
    "docx": lambda c: "\n".join(_xml_text(p, "w:p") for p in _zip_parts(c, r"word/document\.xml")),
    "pptx": lambda c: "\n".join(_xml_text(p, "a:p") for p in _zip_parts(c, r"ppt/slides/slide\d+\.xml")),
    "xlsx": _sheets,
    "rtf": _rtf,
    "pdf": _pdf,
}


def extracted(content: bytes | None, extension: str | None) -> str | None:
    """The text of one file; null where it cannot be read."""
    if content is None:
        return None
    try:
        return READERS.get((extension or "").lower(), lambda c: c.decode("utf-8", "replace"))(content)
    except (zipfile.BadZipFile, KeyError, ValueError, IndexError):
        return None


def note(content: bytes | None) -> str | None:
    """The first printable run of ten characters or more in a compressed note."""
    if content is None:
        return None
    try:
        found = PLAIN.search(gzip.decompress(content).decode("utf-8", "replace"))
    except (OSError, EOFError, zlib.error):
        return None
    return found and found[0]


def attributed(content: bytes | None, least: int = 2) -> str | None:
    """The longest run of an attributed string's body that is no class name, else the first printable run."""
    if content is None:
        return None
    text = content.decode("utf-8", "replace")
    runs = [r for r in re.findall(r"[ -~\n\u00a0-\ufffc]{%d,}" % least, text) if not re.match(r"(?:NS|__kIM|streamtyped|\$)", r.strip())]
    if runs:
        return max(runs, key=len).strip("+\n ")
    found = re.search(r"[ -~]+", text)
    return found and found[0]


@F.pandas_udf(T.StringType())
def office_text(content: pd.Series, extension: pd.Series) -> pd.Series:
    return pd.Series([extracted(c, e) for c, e in zip(content, extension, strict=True)], dtype="object")


@F.pandas_udf(T.StringType())
def note_text(content: pd.Series) -> pd.Series:
    return pd.Series([note(c) for c in content], dtype="object")


@F.pandas_udf(T.StringType())
def attributed_text(content: pd.Series) -> pd.Series:
    return pd.Series([attributed(c) for c in content], dtype="object")


def _zipped(**parts: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def body(text: str, kind: str) -> bytes:
    """The smallest file of a kind that holds a text: what tests and demonstrations read back."""
    safe = html.escape(text, quote=False)
    if kind == "docx":
        return _zipped(**{"word/document.xml": f"<w:document><w:p><w:r><w:t>{safe}</w:t></w:r></w:p></w:document>"})
    if kind == "pptx":
        return _zipped(**{"ppt/slides/slide1.xml": f"<p:sld><a:p><a:r><a:t>{safe}</a:t></a:r></a:p></p:sld>"})
    if kind == "xlsx":
        return _zipped(**{"xl/sharedStrings.xml": f"<sst><si><t>{safe}</t></si></sst>", "xl/worksheets/sheet1.xml": '<sheetData><row r="1"><c r="A1" t="s"><v>0</v></c></row></sheetData>'})
    if kind == "rtf":
        return (r"{\rtf1{\fonttbl{\f0 A;}}" + re.sub(r"([{}\\])", lambda m: f"\\'{ord(m[1]):02x}", text) + "}").encode("latin-1")
    if kind == "pdf":
        shown = re.sub(r"([()\\])", r"\\\1", text).encode("latin-1")
        return b"%PDF-1.4\nstream\n" + zlib.compress(b"BT (" + shown + b") Tj ET") + b"\nendstream\n"
    if kind == "note":
        return gzip.compress(b"\x08\x01" + text.encode() + b"\x12\x00")
    if kind == "attributed":
        return b"\x04\x0bstreamtyped\x81\xe8\x03\x84\x01NSString\x00\x84\x01+\x05" + text.encode() + b"\x86\x84NSDictionary\x00"
    return text.encode()


@F.pandas_udf(T.BinaryType())
def packed(text: pd.Series, kind: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else body(x, k) for x, k in zip(text, kind, strict=True)], dtype="object")
