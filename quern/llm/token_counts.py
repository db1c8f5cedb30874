"""Token counts by dynamic programming over a shared trie.

The distinct pre-tokens of a text batch go into one trie.  Each of its nodes
holds the unigram forward score of its prefix (the best sum of piece scores
that spells it), with the number of pieces on that way, computed once however
many pre-tokens share the prefix; a node also carries the pieces still open
there.  Terminal nodes thus hold the counts of whole pre-tokens, and a text's
count is the sum over its pre-tokens.  A worker's trie is bounded by ``NODES``
and begins anew beyond that, which changes no count; pre-tokens of more than
``LONG`` characters pass the same recursion without being inserted.

Scores are those of ``piece_model``: log probabilities of the pieces.  The
counts are those of the likeliest segmentation; a model of merges encodes by its
merges, so its own encoder may count a little otherwise.

Cases: a null text counts as the empty one, which is the single space in
front; equal scores go to the way with fewer pieces; rows may repeat, doc_id may
be of any type, other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._words import pieces
from .piece_model import MODEL, PieceModel, piece_model, uncollected

NODES = 1_000_000
LONG = 1024


class Trie(dict):
    """pre-token -> its terminal node."""

    def __init__(self, model: PieceModel) -> None:
        super().__init__()
        self.unknown = model.unknown
        self.root = model.root
        self.alone = {c for c in model.score if len(c) == 1}
        self.start()

    def start(self) -> None:
        self.clear()
        self.child: dict[tuple[int, str], int] = {}
        self.score, self.count = array("d", [0.0]), array("q", [0])
        self.open: list[tuple] = [((self.root, 0.0, 0),)]  # (what follows in the pieces' trie, score and count before the piece)

    def __missing__(self, token: str) -> int:
        if len(token) > LONG:
            return self._alone(token)
        child, at = self.child, 0
        for c in token:
            to = child.get((at, c))
            if to is None:
                to = self._grow(at, c)
            at = to
        self[token] = at
        return at

    def _alone(self, token: str) -> int:
        """The terminal node of a long pre-token that nothing else shares: the way to it is given up as it is gone."""
        first, at = len(self.score), 0
        for c in token:
            to = self._grow(at, c)
            del self.child[at, c]
            if at >= first:
                self.open[at] = ()
            at = to
        return at

    def _grow(self, at: int, c: str) -> int:
        best, count, going = -np.inf, 0, []
        for below, score, n in self.open[at]:
            to = below.get(c)
            if to is not None:
                edge, after = to
                if after:
                    going.append((after, score, n))
                if edge:
                    s = score + edge[0]
                    if s > best or s == best and n + 1 < count:
                        best, count = s, n + 1
        if c not in self.alone:
            score, n = self.score[at] + self.unknown, self.count[at] + len(c.encode())
            if score > best:
                best, count = score, n
        going.append((self.root, best, count))
        self.child[at, c] = to = len(self.score)
        self.score.append(best)
        self.count.append(count)
        self.open.append(tuple(going))
        return to


_TRIES: dict[str, Trie] = {}  # of a worker process, over all its tasks


def _counted(path: str):
    def run(batches):
        with uncollected():  # the trie holds no cycles
            yield from count(batches)

    def count(batches):
        if path not in _TRIES:
            _TRIES[path] = Trie(piece_model(path))
        trie, unit = _TRIES[path], piece_model(path).unit
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                units, tokens, scores = [], [], []
                for text in part.column("text").to_pylist():
                    n, sum_, score = 0, 0, 0.0
                    found = unit.findall(" " + (text or ""))
                    for a in range(0, len(found), 1 << 16):  # so that one long text, too, meets the bound
                        if len(trie.score) > NODES:
                            trie.start()
                        nodes = np.fromiter(map(trie.__getitem__, found[a : a + (1 << 16)]), np.int64)
                        n += len(nodes)
                        sum_ += int(np.frombuffer(trie.count, np.int64)[nodes].sum())
                        score += float(np.frombuffer(trie.score)[nodes].sum())
                    units.append(n)
                    tokens.append(sum_)
                    scores.append(score)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(units, pa.int64()), pa.array(tokens, pa.int64()), pa.array(scores, pa.float64())], ["doc_id", "n_pretokens", "n_tokens", "score"])

    return run


def token_counts(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens, score) of each row of docs (doc_id, text, ...)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_counted(model), f"doc_id {kind}, n_pretokens long, n_tokens long, score double")
