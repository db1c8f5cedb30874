"""Words of whole Arrow batches, without a Python object per word.

Words are maximal runs of bytes other than space and 0x09-0x0D of the UTF-8
text; null texts have none.  ``Words`` keeps them as one compact buffer in
which a single space follows each word.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_CODE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLOCK = 1 << 20  # positions for which powers are kept


def _powers(base: int) -> np.ndarray:
    out = np.full(_BLOCK, np.uint64(base), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (in place)."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def texts_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n+1 offsets into them) of a string or binary array; nulls are empty."""
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    off = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:  # a null may cover bytes
        keep = np.asarray(column.is_valid())
        lens = np.where(keep, np.diff(off), 0)
        if lens.sum() != off[-1] - off[0]:
            pieces = [buf[off[i] : off[i + 1]] for i in np.flatnonzero(keep)]
            buf = np.concatenate(pieces) if pieces else buf[:0]
            return buf, np.concatenate([[0], np.cumsum(lens)])
    return buf[off[0] : off[-1]], off - off[0]


class Words:
    """Words of one batch of texts.

    buf     compact bytes, one space after every word
    start   first byte of each word in buf; length: its bytes
    first   n+1: the words of text i are first[i]:first[i+1]
    """

    def __init__(self, column: pa.Array, lower: bool = False) -> None:
        raw, off = texts_buffer(column)
        if lower and len(raw):
            raw = LOWER[raw]
        ink = ~SEPARATOR[raw]
        begins = ink.copy()
        if len(raw):
            begins[1:] &= ~ink[:-1]
            cuts = off[1:-1]
            cuts = cuts[cuts < len(raw)]
            begins[cuts] = ink[cuts]
        at = np.flatnonzero(begins)
        self.first = np.searchsorted(at, off).astype(np.int64)
        inked = np.cumsum(ink, dtype=np.int64)
        total = int(inked[-1]) if len(raw) else 0
        before = inked[at] - 1 if len(at) else np.zeros(0, np.int64)
        self.length = np.diff(np.append(before, total))
        self.start = before + np.arange(len(at))
        self.buf = np.full(total + len(at), 0x20, np.uint8)
        if len(at):
            fill = np.ones(total + len(at), bool)
            fill[self.start + self.length] = False
            self.buf[fill] = raw[ink]
        self.n = len(at)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not _POWER:
            _POWER.extend([_powers(_STEP), _powers(_BACK)])
        out = np.empty(self.n, np.uint64)
        w = 0
        while w < self.n:
            # words wholly inside the block that begins at word w
            end = int(np.searchsorted(self.start + self.length, self.start[w] + _BLOCK, "right"))
            if end == w:
                out[w] = self._long(w)
                w += 1
                continue
            a, b = int(self.start[w]), int(self.start[end - 1] + self.length[end - 1])
            sums = np.empty(b - a + 1, np.uint64)
            sums[0] = 0
            np.cumsum(_CODE[self.buf[a:b]] * _POWER[0][: b - a], out=sums[1:])
            s = self.start[w:end] - a
            out[w:end] = (sums[s + self.length[w:end]] - sums[s]) * _POWER[1][s]
            w = end
        return mix(out ^ self.length.astype(np.uint64))

    def _long(self, w: int) -> np.uint64:
        """The same polynomial for a word longer than a block."""
        total, scale = 0, 1
        for a in range(int(self.start[w]), int(self.start[w] + self.length[w]), _BLOCK):
            part = self.buf[a : min(a + _BLOCK, int(self.start[w] + self.length[w]))]
            total += scale * int((_CODE[part] * _POWER[0][: len(part)]).sum(dtype=np.uint64))
            scale = scale * pow(_STEP, len(part), 1 << 64) % (1 << 64)
        return np.uint64(total % (1 << 64))

    def strings(self) -> pa.Array:
        """The words as an Arrow binary array."""
        ink = np.ones(len(self.buf), bool)
        ink[self.start + self.length] = False
        offsets = np.concatenate([[0], np.cumsum(self.length)])
        kind, width = (pa.binary(), np.int32) if offsets[-1] < 2**31 else (pa.large_binary(), np.int64)
        return pa.Array.from_buffers(kind, self.n, [None, pa.py_buffer(offsets.astype(width)), pa.py_buffer(self.buf[ink])])

    def span(self, a: int, b: int) -> bytes:
        """Words a to b (not included), joined by one space."""
        return self.buf[self.start[a] : self.start[b - 1] + self.length[b - 1]].tobytes() if b > a else b""


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n neighbouring words, from their hashes."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = h[:m].copy()
    for j in range(1, n):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += h[j : j + m]
    return mix(out)


def released() -> None:
    """Hands memory that is free back to the machine: workers live on from operator to operator."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def pieces(batch: pa.RecordBatch, column: str, most: int = 1 << 22):
    """Slices of a batch with about ``most`` bytes of text each (one text at least)."""
    col = batch.column(batch.schema.get_field_index(column))
    _, off = texts_buffer(col)
    i, n = 0, len(col)
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j
    released()
