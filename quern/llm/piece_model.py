"""The pieces of a SentencePiece model, read once per worker process.

Texts are taken as they are, with one space put in front; a piece's "▁" is a
space.  A character without a piece of its own costs ``unknown`` and is encoded
as its UTF-8 bytes, so decoding gives every text back exactly, a literal "▁"
included.

A model of merges has no probabilities but the ranks of its merges.  Its pieces
then get those of Zipf's law over these ranks, in proportion to 1 / (rank +
``SHIFT``) and summing to one, so that sums of their logarithms are unigram
scores.  (Nothing is fitted: tokenizers are never trained here.)
"""

from __future__ import annotations

import gc
import math
import os
import re
from contextlib import contextmanager
from functools import lru_cache

import sentencepiece

MODEL = os.environ.get("QUERN_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
SHIFT = 10

#: Pre-tokens: a word with the spaces before it, or the spaces at the end. A model's own ``unit`` cuts finer where its pieces allow.
UNIT = re.compile(" *[^ ]+| +")


class PieceModel:
    def __init__(self, path: str) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.bytes: list[bytes] = []  # by id
        self.byte_id = [sp.unk_id()] * 256
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes.append(b"")
            else:
                text = piece.replace("▁", " ")
                self.score[text], self.id[text] = sp.get_score(i), i
                self.bytes.append(text.encode())
        if all(s == int(s) for s in self.score.values()):  # ranks of merges: the model has no probabilities of its own
            ranks = {p: -s for p, s in self.score.items() if s > -1e8}
            scale = math.log(sum(1 / (r + SHIFT) for r in ranks.values()))
            self.score = {p: -math.log(ranks[p] + SHIFT) - scale if p in ranks else s for p, s in self.score.items()}
        self.unknown = min(s for s in self.score.values() if s > -1e8) - 10  # some runs of spaces have -1e9
        self.longest = max(map(len, self.score))
        #: every beginning of a piece: its (score, ids), or () where it is no piece itself
        self.prefix: dict[str, tuple] = {p[:j]: () for p in self.score for j in range(1, len(p))}
        self.prefix |= {p: (s, (self.id[p],)) for p, s in self.score.items()}
        #: the pieces as a trie of (edge, or () within a piece; what follows by character)
        self.root: dict[str, tuple] = {}
        for p in sorted(self.score):
            below = self.root
            for j, c in enumerate(p, 1):
                if c not in below:
                    below[c] = (self.prefix[p[:j]], {})
                below = below[c][1]
        self.joined = {p[j : j + 2] for p in self.score for j in range(len(p) - 1)}

        # marks that no piece holds behind another character, so a unit ends before them
        marks = set("".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()))
        while bad := {b[1] for b in self.joined if b[1] in marks and b[0] != " " and b[0] not in marks}:
            marks -= bad
        inner = "".join(map(re.escape, sorted(marks)))
        self.unit = re.compile(f" *(?:[^ {inner}]+|[{inner}]+[^ {inner}]*)| +" if marks else " *[^ ]+| +")

    def edge(self, text: str) -> tuple[float, tuple[int, ...]] | None:
        """(score, ids) of a lattice edge that spells ``text``, if there is one."""
        return self.prefix.get(text) or ((self.unknown, tuple(self.byte_id[b] for b in text.encode())) if len(text) == 1 else None)

    def segments(self, unit: str) -> list[str]:
        """The unit cut wherever no piece holds both neighbouring characters."""
        out, at = [], 0
        for j in range(1, len(unit)):
            if unit[j - 1 : j + 1] not in self.joined:
                out.append(unit[at:j])
                at = j
        out.append(unit[at:])
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode()[1:]


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


@contextmanager
def uncollected():
    """Without the cyclic garbage collector, which would walk large tables again and again; it is as before afterwards."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()
