"""N-best SentencePiece segmentation.

A forward Viterbi pass gives the best score of every prefix; these scores are
the exact heuristic of a backward A* search over the piece lattice, which
therefore yields segmentations best first.  Scores are those of
``piece_model``: log probabilities of the pieces.  Pieces never cross certain
character pairs, so a text falls into independent segments: each distinct
segment is searched once per worker (up to ``MEMO`` units are remembered), and
the n best of a text are the n best sums over its segments.

Cases: a null text is the empty one; the empty text is one space's piece in
front, decoded to nothing; texts of any length are segmented whole.
"""

from __future__ import annotations

import hashlib
import heapq
from array import array
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._words import pieces
from .piece_model import MODEL, PieceModel, piece_model, uncollected

MEMO = 1_000_000
SHORT, LONG = 9, 2048  # characters of a unit that is not worth cutting, and of a lattice that is kept whole

_first = itemgetter(0)


def search(model: PieceModel, text: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n best (score, ids) of one lattice, best first."""
    if len(text) > LONG:
        return far_search(model, text, n)
    size, prefix = len(text), model.prefix
    best = [0.0] + [-np.inf] * size
    into: list[list] = [[] for _ in range(size + 1)]  # (score up to here, start, edge)
    for i in range(size):
        b, alone = best[i], False
        for j in range(i + 1, size + 1):
            edge = prefix.get(text[i:j])
            if edge is None:
                break
            if edge:
                alone = alone or j == i + 1
                s = b + edge[0]
                into[j].append((s, i, edge))
                if s > best[j]:
                    best[j] = s
        if not alone:
            edge = model.edge(text[i])
            s = b + edge[0]
            into[i + 1].append((s, i, edge))
            if s > best[i + 1]:
                best[i + 1] = s
    found, made, sorted_ = [], 0, [False] * (size + 1)
    # (-whole score, order, node, which of its edges, score behind it, path): an edge's next sibling enters only when the edge is taken
    heap = [(-best[size], 0, size, 0, 0.0, None)]
    while heap and len(found) < n:
        _, _, j, k, behind, path = heapq.heappop(heap)
        while True:
            edges = into[j]
            if not sorted_[j]:
                edges.sort(key=_first, reverse=True)
                sorted_[j] = True
            if k + 1 < len(edges):
                made += 1
                heapq.heappush(heap, (-(edges[k + 1][0] + behind), made, j, k + 1, behind, path))
            _, i, edge = edges[k]
            behind, path = behind + edge[0], (edge[1], path)
            if not i:
                break
            j, k = i, 0  # the best way on costs nothing more
        ids: list[int] = []
        while path is not None:
            ids.extend(path[0])
            path = path[1]
        found.append((behind, tuple(ids)))
    return found


def best_and_gap(model: PieceModel, text: str) -> tuple[float, float, array]:
    """(best score, how much the second best costs more, ids of the best): the first expansion of ``search``.

    What it would put on its heap along the best way are the exact scores of all others, so the greatest is the second best.
    """
    size, root = len(text), model.root
    least = -1e300
    best, other = [0.0] + [least] * size, [least] * (size + 1)
    start, ways = [0] * (size + 1), [()] * (size + 1)  # of the best way into a node: where its last edge starts, and its ids
    for i, c in enumerate(text):
        b = best[i]
        at = root.get(c)
        if at is None or not at[0]:
            s, ids = model.edge(c)
            s += b
            j = i + 1
            if s > best[j]:
                other[j], best[j], start[j], ways[j] = best[j], s, i, ids
            elif s > other[j]:
                other[j] = s
        j = i
        while at is not None:
            edge, below = at
            j += 1
            if edge:
                s = b + edge[0]
                if s > best[j]:
                    other[j], best[j], start[j], ways[j] = best[j], s, i, edge[1]
                elif s > other[j]:
                    other[j] = s
            if j == size or not below:
                break
            at = below.get(text[j])
    second, path, j, whole = least, [], size, best[size]
    while j:
        if other[j] > least:
            second = max(second, other[j] + whole - best[j])
        path.append(ways[j])
        j = start[j]
    ids = array("i")
    for part in reversed(path):
        ids.extend(part)
    return whole, whole - second if second > least else np.inf, ids


def far_search(model: PieceModel, text: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
    """``search`` for long lattices: only the best scores of prefixes are kept; the edges into a node are found anew when it is visited."""
    size, prefix, most = len(text), model.prefix, model.longest
    best = array("d", [0.0]) + array("d", [-np.inf]) * size

    def edges_from(i: int):
        alone = False
        for j in range(i + 1, size + 1):
            edge = prefix.get(text[i:j])
            if edge is None:
                break
            if edge:
                alone = alone or j == i + 1
                yield j, edge
        if not alone:
            yield i + 1, model.edge(text[i])

    def edges_into(j: int) -> list:
        found = []
        for i in range(max(0, j - most), j):
            edge = prefix.get(text[i:j])
            if not edge and j == i + 1:
                edge = model.edge(text[i])
            if edge:
                found.append((best[i] + edge[0], i, edge))
        found.sort(key=_first, reverse=True)
        return found

    for i in range(size):
        for j, edge in edges_from(i):
            best[j] = max(best[j], best[i] + edge[0])
    found, made, heap = [], 0, [(-best[size], 0, size, 0, 0.0, None)]
    while heap and len(found) < n:
        _, _, j, k, behind, path = heapq.heappop(heap)
        while j:
            edges = edges_into(j)
            if k + 1 < len(edges):
                made += 1
                heapq.heappush(heap, (-(edges[k + 1][0] + behind), made, j, k + 1, behind, path))
                if len(heap) > 4 * n:  # only the n best can come out
                    heap = heapq.nsmallest(n, heap)
                    heapq.heapify(heap)
            _, i, edge = edges[k]
            behind, path, j, k = behind + edge[0], (edge[1], path), i, 0
        ids = array("i")
        while path is not None:
            ids.extend(path[0])
            path = path[1]
        found.append((behind, tuple(ids)))
    return found


def combined(parts: list[list[tuple]], n: int) -> list[tuple]:
    """The n best sums of one choice from each list (each best first)."""
    top = parts[0][:n]
    for part in parts[1:]:
        if len(part) == 1:
            s, ids = part[0]
            top = [(a[0] + s, a[1] + ids) for a in top]
            continue
        top = sorted(((a[0] + b[0], a[1] + b[1]) for a in top for b in part), key=lambda x: -x[0])[:n]
    return top


class Segmenter(dict):
    """unit -> its number; arrays hold its best way and how much the second best costs more."""

    def __init__(self, model: PieceModel, n: int) -> None:
        super().__init__()
        self.model, self.n = model, n
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.best, self.size, self.gap, self.fits = array("d"), array("q"), array("d"), array("b")
        self.ids: list[bytes] = []

    def __missing__(self, unit: str) -> int:
        parts = [unit] if len(unit) <= SHORT else self.model.segments(unit)
        if len(parts) == 1:
            if len(unit) > LONG:
                found = far_search(self.model, unit, 2)
                score, ids = found[0][0], array("i", found[0][1]).tobytes()
                gap = score - found[1][0] if len(found) > 1 else np.inf
            else:
                score, gap, ids = best_and_gap(self.model, unit)
                ids = ids.tobytes()
        else:
            known = [self[p] for p in parts]
            score, gap, ids = sum(self.best[k] for k in known), min(self.gap[k] for k in known), b"".join(self.ids[k] for k in known)
        spelt = b"".join(map(self.model.bytes.__getitem__, np.frombuffer(ids, "<i4").tolist()))  # decoded once for all texts that hold the unit
        self.fits.append(spelt == unit.encode())
        self[unit] = at = len(self.best)
        self.best.append(score)
        self.gap.append(gap)
        self.size.append(len(ids) // 4)
        self.ids.append(ids)
        return at

    def coded(self, text: str) -> tuple[list[str], np.ndarray]:
        """The units of a text and their numbers."""
        if len(self.best) > MEMO:
            self.forget()
        units = self.model.unit.findall(" " + text)
        return units, np.fromiter(map(self.__getitem__, units), np.int64, len(units))

    def ways(self, unit: str) -> list[tuple]:
        """The n best of one unit."""
        return combined([search(self.model, segment, self.n) for segment in self.model.segments(unit)], self.n)

    def nbest(self, text: str) -> list[tuple[float, list[int]]]:
        """The n best (score, ids) of a whole text."""
        units, codes = self.coded(text)
        out = []
        for s, change in zip(*self.scores(units, codes), strict=True):
            change, ids = dict(change), []
            for at, unit in enumerate(units):
                ids += change[at] if at in change else np.frombuffer(self.ids[codes[at]], "<i4").tolist()
            out.append((s, ids))
        return out

    def scores(self, units: list[str], codes: np.ndarray) -> tuple[list[float], list]:
        """The n best scores of a text, and for each the units whose way isn't their best, with that way."""
        total = float(np.frombuffer(self.best)[codes].sum())
        gaps = np.frombuffer(self.gap)[codes]
        # no other unit than those of the n - 1 least gaps differs from its best in the n best
        few = np.argsort(gaps, kind="stable")[: self.n - 1] if len(gaps) <= 4 * self.n else np.argpartition(gaps, self.n - 1)[: self.n - 1]
        top: list[tuple[float, tuple]] = [(0.0, ())]
        for at in sorted(few.tolist()):
            ways = self.ways(units[at])
            top = sorted(((loss + ways[0][0] - w[0], change + (((at, w[1]),) if k else ())) for loss, change in top for k, w in enumerate(ways)), key=_first)[: self.n]
        return [total - loss for loss, _ in top], [change for _, change in top]


_SEGMENTERS: dict[tuple[str, int], Segmenter] = {}  # of a worker process, over all its tasks


def _made(whole: bool) -> list[str]:
    return ["n_pieces", "score", "nbest", "round_trip", *(("ids", "nbest_ids") if whole else ("ids_sha256", "nbest_sha256"))]


def _lists(raws: list[bytes]) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.cumsum([0, *(len(raw) // 4 for raw in raws)]).astype(np.int32), pa.array(np.frombuffer(b"".join(raws), "<i4")))


def _encoded(path: str, n: int, fields: list[str], whole: bool):
    def run(batches):
        with uncollected():  # what is remembered holds no cycles
            yield from encode(batches)

    def encode(batches):
        model = piece_model(path)
        if (path, n) not in _SEGMENTERS:
            _SEGMENTERS[path, n] = Segmenter(model, n)
        seg = _SEGMENTERS[path, n]
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                size, scores, same, ways = [], [], [], []
                for text in part.column(part.schema.get_field_index("text")).to_pylist():
                    text = text or ""
                    units, codes = seg.coded(text)
                    best = list(map(seg.ids.__getitem__, codes.tolist()))
                    top, changes = seg.scores(units, codes)
                    raws, fits = [], "".join(units) == " " + text and bool(np.frombuffer(seg.fits, np.int8)[codes].all())
                    for change in changes:
                        way = best.copy() if change else best
                        for at, ids in change:  # the other units are those of the best way
                            way[at] = np.array(ids, "<i4").tobytes()
                            fits = fits and b"".join(map(model.bytes.__getitem__, ids)) == units[at].encode()
                        raws.append(b"".join(way))
                    size.append(len(raws[0]) // 4)
                    scores.append(top)
                    same.append(fits)
                    ways.append(raws if whole else [hashlib.sha256(raw).hexdigest() for raw in raws])
                columns = [*(part.column(part.schema.get_field_index(f)) for f in fields), pa.array(size, pa.int64()), pa.array([s[0] for s in scores], pa.float64()), pa.array(scores, pa.list_(pa.float64())), pa.array(same)]
                if whole:
                    columns += [_lists([raws[0] for raws in ways]), pa.ListArray.from_arrays(np.cumsum([0, *map(len, ways)]).astype(np.int32), _lists([raw for raws in ways for raw in raws]))]
                else:
                    columns += [pa.array([digests[0] for digests in ways], pa.string()), pa.array(ways, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, [*fields, *_made(whole)])

    return run


def encoded(docs: DataFrame, n: int = 4, model: str = MODEL, keep: list[str] | None = None, ids: bool = True) -> DataFrame:
    """docs with n_pieces, score, nbest (the n best scores), round_trip, ids and nbest_ids (or, without ``ids``, ids_sha256 and nbest_sha256 of their little-endian int32s).

    ``nbest_ids``: the n best segmentations, best first. ``round_trip``: decoding each of them gave the text back. ``keep``: the columns of docs that stay (all).
    """
    docs = docs.withColumn("text", F.col("text").cast("string"))
    keep = docs.columns if keep is None else keep
    if clash := set(_made(ids)) & set(keep):
        raise ValueError(f"docs already has columns {sorted(clash)}")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    schema += ", n_pieces long, score double, nbest array<double>, round_trip boolean, " + ("ids array<int>, nbest_ids array<array<int>>" if ids else "ids_sha256 string, nbest_sha256 array<string>")
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(_encoded(model, n, keep, ids), schema)
