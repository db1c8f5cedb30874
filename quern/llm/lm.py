"""LM scoring: a causal self-attention model in numpy on subword ids.

Learning covers every training text.  Each is encoded once; words and subwords
are counted over all of them.  The commonest subwords fall into classes of
equal size by the company that they keep in the training texts (halved again
and again along the direction in which their neighbours differ most); the
rarer ones share the last place of a class, within which their counts decide.

The model is one masked attention head.  Its values are distributions over the
next subword, counted over all neighbours in all training texts: what stands
right behind a subword, and what stands further behind one of its class.  Its
queries, keys and distance biases are trained by synchronised descent: the
training texts fall into ``LOTS`` lots by the hash of their subwords, and each
lot makes one step with the gradient summed over all its windows, whatever
tasks these were in.  So the weights follow from the texts alone, not from how
the table is dealt out.  While
training, a subword is left out of the counts that it is predicted from.  The
output is a distribution, so the product over a text is the probability of its
subwords up to the end.

Scoring cuts a text into windows of ``WINDOW`` subwords that overlap by
``OVERLAP``; each subword is scored once, in the first window that holds it
with context in front.  Windows of many texts pass the masked attention as one
batch.

The base score of the same words comes from their counts: the commonest
``HEAD`` words are sent to all tasks, the others are joined.

Cases: a null or blank text is its end alone; without any training text all
counts are zero and the base score is zero (one outcome only), while the model
is uniform over its members; texts of any length are scored whole, in blocks
of windows.  doc_id may be of any type; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import new_path, written
from ._words import Words, pieces
from .piece_model import MODEL
from .quality import remainder

WINDOW, OVERLAP, WIDTH, CLASSES, MEMBERS, FINE, COMPANY = 16, 4, 16, 64, 32, 8, 128
REACH, FARTHEST = 3, 6  # distances with a table of their own, the last for all further ones, counted as far as FARTHEST
HEAD = 1 << 18
MEMO = 200_000
BATCH = 512  # windows at a time
LOTS, RATE = 16, 0.2  # steps of the descent, the size of the first
GROUPS = 16  # of classes


class Classes:
    """The member (class * MEMBERS + place) of every subword id, and its log share of a last place.

    ``FINE`` neighbouring members make a fine class, ``MEMBERS`` a class; the rarer subwords of a class share its last place.
    """

    def __init__(self, counts: np.ndarray, company: np.ndarray | None = None) -> None:
        c = counts.astype(np.float64) + 0.1
        order = np.argsort(-c, kind="stable")
        top, rest = order[: CLASSES * (MEMBERS - 1)], order[CLASSES * (MEMBERS - 1) :]
        x = np.zeros((len(top), 1)) if company is None else np.sqrt(company / np.maximum(company.sum(axis=1, keepdims=True), 1))
        self.of = np.empty(len(c), np.int64)
        for k, part in enumerate(self._cut(x, np.arange(len(top)), CLASSES)):
            part = np.concatenate(self._cut(x, part, MEMBERS // FINE))
            self.of[top[part]] = k * MEMBERS + np.arange(len(part))
        self.of[rest] = np.arange(len(rest)) % CLASSES * MEMBERS + MEMBERS - 1
        mass = np.bincount(self.of, c, CLASSES * MEMBERS)
        self.within = np.log(c / mass[self.of])
        mass = np.maximum(mass, 1e-3)
        self.share = mass / mass.sum()

    @staticmethod
    def _cut(x: np.ndarray, part: np.ndarray, n: int) -> list[np.ndarray]:
        parts = [part]
        while len(parts) < n:
            parts = [half for part in parts for half in Classes._halves(x, part)]
        return parts

    @staticmethod
    def _halves(x: np.ndarray, part: np.ndarray) -> list[np.ndarray]:
        y = x[part] - x[part].mean(axis=0)
        v = np.ones(y.shape[1])
        for _ in range(20):
            v = y.T @ (y @ v)
            v /= np.linalg.norm(v) or 1
        order = part[np.argsort(y @ v, kind="stable")]
        return [order[: (len(order) + 1) // 2], order[(len(order) + 1) // 2 :]]


class Values:
    """What a subword at some distance says of the next: a distribution over all members, from counts.

    near[p, m]    member m right behind member p
    pair[g, p, f] fine class f behind p, a member of group g before that (a group is a run of classes)
    far[d, f, m]  member m at distance d + 2 behind fine class f (the last d: all further ones up to ``FARTHEST``)

    Pairs are smoothed towards near, near towards what the fine class of p says, and that, as far, towards the share of
    the members.
    ``left_out`` gives the same tables as a training subword sees them that isn't counted itself.
    """

    def __init__(self, share: np.ndarray, near: np.ndarray, pair: np.ndarray, far: np.ndarray) -> None:
        self.share, self.near, self.pair, self.far = share, near, pair, far

    def __reduce__(self):
        """Most cells are empty: only the others travel to the tasks."""
        some = [(x.shape, np.flatnonzero(x).astype(np.int32), x[x != 0]) for x in (self.near, self.pair, self.far)]
        return _unpacked, (self.share, some)

    def tables(self, left_out: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(near, how much more a pair expects a fine class than near does, far)."""
        less = np.float32(left_out)

        def smooth(count: np.ndarray, prior: np.ndarray, weight: float) -> np.ndarray:
            total = count.sum(axis=-1, keepdims=True)
            return ((np.maximum(count - less, 0) + weight * prior) / (np.maximum(total - less, 0) + weight)).astype(np.float32)

        fine = smooth(self.near.reshape(-1, FINE, len(self.share)).sum(axis=1), self.share, 32.0)
        near = smooth(self.near, np.repeat(fine, FINE, axis=0), 8.0)
        by_fine = near.reshape(len(near), -1, FINE).sum(axis=2)
        return near, smooth(self.pair, by_fine, 8.0) / by_fine, smooth(self.far, self.share, 32.0)


def _unpacked(share: np.ndarray, some: list) -> Values:
    tables = []
    for shape, at, count in some:
        tables.append(np.zeros(math.prod(shape), np.float32))
        tables[-1][at] = count
    return Values(share, *(x.reshape(shape) for x, (shape, _, _) in zip(tables, some, strict=True)))


class Attention:
    """One masked attention head over the subwords before each place.

    Queries and keys are learned embeddings of classes, with a learned bias for each distance; the query belongs to the
    newest subword seen.  The values are distributions over the next subword (``Values``), and one more key, always
    visible, stands for the share of the members.  So the output is a distribution.
    """

    def __init__(self, values: Values, seed: int = 2) -> None:
        rng = np.random.default_rng(seed)
        make = lambda *s: rng.normal(0, 0.15, s).astype(np.float32)
        # the newest subword first, the others and the share of the members some twentieth of it
        distance = np.where(np.arange(WINDOW) > 0, -2.9 - 0.1 * np.arange(WINDOW), 0).astype(np.float32)
        self.p = {"query": make(CLASSES + 1, WIDTH), "key": make(CLASSES + 1, WIDTH), "distance": distance, "rest": np.full(CLASSES + 1, -3, np.float32)}
        self.use(values)

    def use(self, values: Values, left_out: bool = False) -> None:
        """Takes the tables of ``values``; the mark before a text's first subword says what the share says."""
        near, pair, far = values.tables(left_out)
        self.share = values.share.astype(np.float32)
        self.near = np.concatenate([near, self.share[None]]).ravel()
        more = np.ones((GROUPS + 1, len(near) + 1, pair.shape[2]), np.float32)  # the mark says nothing more
        more[:-1, :-1] = pair
        self.pair = more.ravel()
        self.far = np.concatenate([far, np.broadcast_to(self.share, (len(far), 1, len(self.share)))], axis=1).reshape(len(far), -1)

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.p.values()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k, x in self.p.items():
            self.p[k] = flat[at : at + x.size].reshape(x.shape).astype(np.float32)
            at += x.size

    def pairs(self, seen: np.ndarray, next_: np.ndarray):
        """(distance, index of the attention weight, weight, value) along each diagonal of the masked matrix.

        seen, next_: (WINDOW, windows), a column a window; a distance covers the places from it on.
        """
        t, m = len(seen), CLASSES * MEMBERS
        match = np.exp(np.clip(self.p["query"] @ self.p["key"].T, -30, 30)).ravel()
        bias = np.exp(np.clip(self.p["distance"], -30, 30))
        klass = seen // MEMBERS
        query, key = klass * (CLASSES + 1), seen // FINE * m
        for d in range(t):
            at = query[d:] + klass[: t - d]
            weight = match.take(at)
            weight *= bias[d]
            if d == 0:
                value = self.near.take(seen * m + next_)
                group = np.full_like(seen, GROUPS)
                group[1:] = seen[:-1] * GROUPS // m
                value *= self.pair.take((group * (m + 1) + seen) * (m // FINE) + next_ // FINE)
            else:
                value = self.far[min(d, len(self.far)) - 1].take(key[: t - d] + next_[d:])
            yield d, at, weight, value

    def probability(self, seen: np.ndarray, next_: np.ndarray) -> np.ndarray:
        """Of each member that comes, given those seen in its window; both (WINDOW, windows)."""
        total = np.exp(np.clip(self.p["rest"], -30, 30)).take(seen // MEMBERS)
        hit = total * self.share.take(next_)
        for d, _, weight, value in self.pairs(seen, next_):
            total[d:] += weight
            weight *= value
            hit[d:] += weight
        return hit / total

    def slopes(self, seen: np.ndarray, next_: np.ndarray, scored: np.ndarray) -> np.ndarray:
        """Of the sum of -log probabilities of the scored places: by match of query and key, by distance, by rest, one behind the other.

        Every place counts on its own, so sums over batches don't depend on how windows are batched.
        """
        kept = list(self.pairs(seen, next_))
        klass = seen // MEMBERS
        rest = np.exp(np.clip(self.p["rest"], -30, 30)).take(klass)
        total, hit = rest.copy(), rest * self.share.take(next_)
        for d, _, weight, value in kept:
            total[d:] += weight
            hit[d:] += weight * value
        by_hit, by_total = scored / hit, scored / total
        g, far = np.zeros((CLASSES + 1) ** 2), np.zeros(WINDOW)
        for d, at, weight, value in kept:
            value = value * by_hit[d:]
            value -= by_total[d:]
            value *= weight  # how much more it should have had
            far[d] = -value.sum(dtype=np.float64)
            g -= np.bincount(at.ravel(), value.ravel(), len(g))
        more = rest * (self.share.take(next_) * by_hit - by_total)
        return np.concatenate([g, far, -np.bincount(klass.ravel(), more.ravel(), CLASSES + 1)])

    def of_slopes(self, slopes: np.ndarray, n: int) -> dict:
        """Gradients of the mean over n places, from summed slopes."""
        g, far, rest = np.split(slopes / max(n, 1), [(CLASSES + 1) ** 2, (CLASSES + 1) ** 2 + WINDOW])
        g = g.reshape(CLASSES + 1, -1)
        return {"query": g @ self.p["key"], "key": g.T @ self.p["query"], "distance": far, "rest": rest}

    def gradients(self, seen: np.ndarray, next_: np.ndarray, scored: np.ndarray) -> dict:
        """Of the mean -log probability of the scored places."""
        return self.of_slopes(self.slopes(seen, next_, scored), int(scored.sum()))


class Descent:
    """Adam over a few steps, which shrink as they go on."""

    def __init__(self, model: Attention, rate: float, steps: int) -> None:
        self.model, self.rate, self.steps, self.t = model, rate, steps, 0
        self.m, self.v = ({k: np.zeros(x.shape) for k, x in model.p.items()} for _ in range(2))

    def step(self, gradients: dict) -> None:
        self.t += 1
        now = self.rate / (1 + self.t / self.steps)
        for k, g in gradients.items():
            self.m[k] = 0.8 * self.m[k] + 0.2 * g
            self.v[k] = 0.9 * self.v[k] + 0.1 * g * g
            self.model.p[k] = self.model.p[k] - (now * (self.m[k] / (1 - 0.8**self.t)) / (np.sqrt(self.v[k] / (1 - 0.9**self.t)) + 1e-8)).astype(np.float32)


class Encoder(dict):
    """word -> its number; flat holds the subword ids of each."""

    def __init__(self, path: str) -> None:
        super().__init__()
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.flat, self.first = array("i"), array("q", [0])

    def codes(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of each word, all ids, first id of each number)."""
        if len(self) > MEMO:
            self.reset()
        new = [w for w in words if w not in self]
        if new:
            for w, ids in zip(new, self.sp.encode([w.decode() for w in new], num_threads=1), strict=True):
                self[w] = len(self.first) - 1
                self.flat.extend(ids)
                self.first.append(len(self.flat))
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words)), np.frombuffer(self.flat, np.int32) if self.flat else np.zeros(0, np.int32), np.frombuffer(self.first, np.int64)


_ENCODERS: dict[str, Encoder] = {}  # of a worker process, over all its tasks


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def sequences(encoder: Encoder, w: Words, named: pa.DictionaryArray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Subword ids of each text, its end behind them, and the offsets of texts."""
    code, flat, first = encoder.codes(named.dictionary.to_pylist())
    word = code[np.asarray(named.indices)] if w.n else np.zeros(0, np.int64)
    size = first[word + 1] - first[word]
    upto = np.concatenate([[0], np.cumsum(size)])
    off = upto[w.first] + np.arange(len(w.first))
    out = np.empty(off[-1], np.int64)
    ends = off[1:] - 1
    keep = np.ones(len(out), bool)
    keep[ends] = False
    out[ends] = end
    if w.n:
        out[keep] = flat[np.arange(upto[-1]) + np.repeat(first[word] - upto[:-1], size)]
    return out, off  # copies: the encoder's arrays grow on


def windows(members: np.ndarray, off: np.ndarray, most: int = 1 << 62):
    """(members before, members that come, index of each place, whether it is scored there), a column a window, by blocks of at most ``most`` windows."""
    n = np.diff(off)
    step = WINDOW - OVERLAP
    count = np.maximum(1, -(-(n - OVERLAP) // step))
    ends = np.cumsum(count)
    before = np.empty(len(members), np.int64)
    before[1:] = members[:-1]
    before[off[:-1]] = CLASSES * MEMBERS
    place = np.arange(WINDOW)[:, None]
    for a in range(0, int(ends[-1]), most):
        nth = np.arange(a, min(a + most, int(ends[-1])))
        text = np.searchsorted(ends, nth, "right")
        nth = nth - (ends[text] - count[text])
        index = off[text] + nth * step + place
        scored = (index < off[text + 1]) & ((place >= OVERLAP) | (nth == 0))
        index = np.minimum(index, len(members) - 1)
        yield before[index], members[index], index, scored


CODED = ("doc_id", "text", "held_out", "ids", "word", "c")


def _narrow(size: int) -> np.dtype:
    return np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")


def _encoded_rows(path: str, end: int):
    """Each row with its subword ids, the end behind them; and rows (word, c) of the texts to learn from."""

    def run(batches):
        encoder = _encoder(path)
        kind = _narrow(encoder.sp.get_piece_size())
        words, held = [], 0

        def summed(types):
            total = pa.concat_tables(words).group_by("word").aggregate([("c", "sum")]).combine_chunks()
            for rows in total.to_batches():
                yield pa.RecordBatch.from_arrays([*(pa.nulls(len(rows), t) for t in types), pa.nulls(len(rows), pa.binary()), rows.column("word"), rows.column("c_sum")], [*CODED])

        for batch in batches:
            for part in pieces(batch, "text"):
                w = Words(part.column("text"), lower=True)
                named = w.strings().dictionary_encode()
                ids, off = sequences(encoder, w, named, end)
                learned = np.repeat(~np.asarray(part.column("held_out").to_numpy(zero_copy_only=False), bool), w.counts())
                counts = np.bincount(np.asarray(named.indices)[learned], minlength=len(named.dictionary)) if w.n else np.zeros(0, np.int64)
                some = np.flatnonzero(counts)
                ids, ends = ids.astype(kind), (off * kind.itemsize).astype(np.int32)
                raw = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(ends), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in CODED[:3]), raw, pa.nulls(len(part), pa.binary()), pa.nulls(len(part), pa.int64())], [*CODED])
                types = [part.schema.field(c).type for c in CODED[:3]]
                words.append(pa.table({"word": named.dictionary.take(pa.array(some)).cast(pa.binary()), "c": pa.array(counts[some])}))
                held += len(some)
                if held > 500_000:
                    yield from summed(types)
                    words, held = [], 0
        if words:
            yield from summed(types)

    return run


def _ids(batches, size: int, most: int = 1 << 20):
    """(ids, offsets of texts, their rows) of about ``most`` ids at a time, one text at least."""
    kind = _narrow(size)
    for batch in batches:
        col = batch.column(batch.schema.get_field_index("ids"))
        off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
        data = np.frombuffer(col.buffers()[2], np.uint8)
        i = 0
        while i < len(col):
            j = max(i + 1, int(np.searchsorted(off, off[i] + most * kind.itemsize, "right")) - 1)
            yield data[off[i] : off[j]].view(kind).astype(np.int64), (off[i : j + 1] - off[i]) // kind.itemsize, batch.slice(i, j - i)
            i = j


def _sparse(total: np.ndarray, at: int = 0) -> pa.RecordBatch:
    some = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(some + at), pa.array(total[some].astype(np.int64))], ["i", "c"])


def _id_counts(size: int):
    def run(batches):
        total = np.zeros(size, np.int64)
        for ids, _, _ in _ids(batches, size):
            total += np.bincount(ids, minlength=size)
        yield _sparse(total)

    return run


def _company_counts(size: int, top: np.ndarray):
    """How often the j-th commonest stands before the i-th, or, from COMPANY on, behind it."""

    def run(batches):
        rank = np.full(size, -1)
        rank[top] = np.arange(len(top))
        total = np.zeros(len(top) * 2 * COMPANY, np.int64)
        for ids, _, _ in _ids(batches, size):
            of = rank[ids]
            a, b = of[:-1], of[1:]
            s = (a >= 0) & (a < COMPANY) & (b >= 0)
            total += np.bincount(b[s] * (2 * COMPANY) + a[s], minlength=len(total))
            s = (b >= 0) & (b < COMPANY) & (a >= 0)
            total += np.bincount(a[s] * (2 * COMPANY) + COMPANY + b[s], minlength=len(total))
        yield _sparse(total)

    return run


def _value_counts(size: int, of: np.ndarray):
    """The cells of ``Values``' tables, one behind the other."""
    m = CLASSES * MEMBERS

    def run(batches):
        near, pair, far = np.zeros(m * m, np.int32), np.zeros(GROUPS * m * m // FINE, np.int32), np.zeros((REACH - 1, m // FINE * m), np.int32)
        for ids, off, _ in _ids(batches, size):
            of_ids = of[ids]
            text = np.repeat(np.arange(len(off) - 1), np.diff(off))
            for d in range(1, FARTHEST + 1):
                same = text[d:] == text[:-d]
                before, next_ = of_ids[:-d][same], of_ids[d:][same]
                if d == 1:
                    near += np.bincount(before * m + next_, minlength=len(near)).astype(np.int32)
                    continue
                if d == 2:
                    pair += np.bincount((before * GROUPS // m * m + of_ids[1:-1][same]) * (m // FINE) + next_ // FINE, minlength=len(pair)).astype(np.int32)
                far[min(d, REACH) - 2] += np.bincount(before // FINE * m + next_, minlength=far.shape[1]).astype(np.int32)
        at = 0
        for table in (near, pair, far.ravel()):
            yield _sparse(table, at)
            at += len(table)

    return run


_MODELS: dict[tuple, Attention] = {}  # of a worker process, over the tasks of one stage


class Shared:
    """Packed values, sent to each worker once for all jobs (bounded by the model's shape), and their digest."""

    def __init__(self, spark, values: Values) -> None:
        packed = pickle.dumps(values)
        self.digest, self.sent = hashlib.sha256(packed).digest(), spark.sparkContext.broadcast(packed)


def _model(shared: Shared, weights: np.ndarray, left_out: bool) -> Attention:
    key = (shared.digest, left_out)
    if key not in _MODELS:
        _MODELS.clear()
        values = pickle.loads(shared.sent.value)
        _MODELS[key] = Attention(values)
        _MODELS[key].use(values, left_out)
    _MODELS[key].load(weights)
    return _MODELS[key]


def _slopes(size: int, classes: Classes, shared: Shared, weights: np.ndarray):
    """The sums of slopes over the windows of a task, and at -1 the number of their places."""

    def run(batches):
        model, total, n = _model(shared, weights, True), None, 0
        for ids, off, _ in _ids(batches, size):
            for seen, next_, _, scored in windows(classes.of[ids], off, BATCH):
                one = model.slopes(seen, next_, scored)
                total = one if total is None else total + one
                n += int(scored.sum())
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(total))), pa.array(np.append(float(n), total))], ["i", "x"])

    return run


def _trained(net: Attention, train: DataFrame, size: int, classes: Classes, shared: Shared, lots: int) -> None:
    """A step for each lot of the training texts, in their order; a lot without texts makes none."""
    spark, path = train.sparkSession, new_path(train.sparkSession, "lots")
    train.withColumn("lot", F.pmod(F.xxhash64("ids"), F.lit(lots)).cast("int")).write.option("compression", "zstd").partitionBy("lot").parquet(path)
    dealt = spark.read.schema("ids binary, lot int").parquet(path)
    descent = Descent(net, RATE, lots)
    for lot in range(lots):
        rows = dealt.where(F.col("lot") == lot).select("ids").mapInArrow(_slopes(size, classes, shared, net.flat()), "i long, x double")
        found = {r["i"]: r["x"] for r in rows.groupBy("i").agg(F.sum("x").alias("x")).collect()}  # a row a slope
        if found:
            descent.step(net.of_slopes(np.array([found[i] for i in range(len(found) - 1)]), int(found[-1])))


def _scored_rows(size: int, classes: Classes, shared: Shared, weights: np.ndarray, head: pa.Array, count: np.ndarray, n: int, v: int):
    divisor = n + 0.1 * (v + 1)

    def run(batches):
        model = _model(shared, weights, False)
        for batch in batches:
            for ids, off, part in _ids([batch], size):
                logs = classes.within[ids]
                for seen, next_, index, scored in windows(classes.of[ids], off, BATCH):
                    logs[index[scored]] += np.log(model.probability(seen, next_)[scored])
                score = np.add.reduceat(logs, off[:-1]) / math.log(10)
                w = Words(part.column("text"), lower=True)
                named = w.strings().dictionary_encode()
                # the base: words of the head here, the others as a list for each text
                at = pc.index_in(named.dictionary, value_set=head)
                there = np.asarray(at.is_valid())
                c = np.where(there, count[np.asarray(at.fill_null(0))], 0) if len(count) else np.zeros(len(there), np.int64)
                word = np.asarray(named.indices)
                known = there[word] if w.n else np.zeros(0, bool)
                value = np.where(known, np.log10((c[word] + 0.1) / divisor), 0.0) if w.n else np.zeros(0)
                upto, some = np.concatenate([[0], np.cumsum(value)]), np.concatenate([[0], np.cumsum(known)])
                tail = np.flatnonzero(~known)
                doc = np.searchsorted(w.first, tail, "right") - 1
                code, times = np.unique(doc * max(1, len(there)) + word[tail], return_counts=True)
                ends = np.searchsorted(code // max(1, len(there)), np.arange(len(part) + 1)).astype(np.int32)
                words = named.dictionary.take(pa.array(code % max(1, len(there))))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), part.column("held_out"), pa.array(w.counts() + 1), pa.array(np.diff(some[w.first])), pa.array(np.diff(upto[w.first])), pa.array(score),
                        pa.ListArray.from_arrays(ends, words), pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int64))),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_head", "head_score", "score", "words", "times"],
                )

    return run


def _collected(rows: DataFrame, size: int) -> np.ndarray:
    """The sums of (i, c) rows as an array of ``size`` cells: bounded by the model's shape, whatever the corpus."""
    out = np.zeros(size, np.int64)
    for r in rows.groupBy("i").agg(F.sum("c").alias("c")).toArrow().to_batches():
        out[np.asarray(r.column("i"))] = np.asarray(r.column("c"))
    return out


def lm_scores(docs: DataFrame, model: str = MODEL, lots: int = LOTS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of docs (doc_id, text, ...).

    Rows whose crc32(doc_id) mod 10 is 0 are held out; all others are learned from.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), (remainder("doc_id", 10) == 0).alias("held_out"))
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    size, end, pair = sp.get_piece_size(), sp.eos_id(), "i long, c long"
    coded = written(docs.mapInArrow(_encoded_rows(model, end), f"doc_id {kind}, text string, held_out boolean, ids binary, word binary, c long"), "encoded")
    train = coded.where("not held_out").select("ids")
    words = written(coded.where("word is not null").groupBy("word").agg(F.sum("c").alias("c")), "words")
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    counts = _collected(train.mapInArrow(_id_counts(size), pair), size)
    texts = int(counts[end])
    n, v = total + texts, distinct + (texts > 0)

    top = np.argsort(-counts, kind="stable")[: CLASSES * (MEMBERS - 1)]
    company = _collected(train.mapInArrow(_company_counts(size, top), pair), len(top) * 2 * COMPANY)
    classes = Classes(counts, company.reshape(len(top), -1))
    m = CLASSES * MEMBERS
    shapes = [(m, m), (GROUPS, m, m // FINE), (REACH - 1, m // FINE, m)]
    ends = np.cumsum([math.prod(x) for x in shapes])
    cells = _collected(train.mapInArrow(_value_counts(size, classes.of), pair), int(ends[-1])).astype(np.float32)
    values = Values(classes.share, *(x.reshape(shape) for x, shape in zip(np.split(cells, ends[:-1]), shapes, strict=True)))
    net, shared = Attention(values), Shared(docs.sparkSession, values)
    if texts:
        _trained(net, train, size, classes, shared, lots)

    # the head: all words as common as some grade or more, HEAD at most
    grade = F.floor(F.log2("c") * 16).cast("int")
    least, held = None, 0
    for g, k in sorted(words.groupBy(grade.alias("g")).agg(F.count("*")).collect(), reverse=True):  # a row a grade: under 1024
        held += k
        if held > HEAD:
            break
        least = g
    top = words.where(grade >= least if least is not None else F.lit(False)).toArrow()
    head, count = pa.array(top["word"].to_pylist(), pa.binary()), np.asarray(top["c"])
    shape = f"doc_id {kind}, held_out boolean, n_tokens long, n_head long, head_score double, score double, words array<binary>, times array<long>"
    rows = coded.where("held_out is not null").select("doc_id", "text", "held_out", "ids").mapInArrow(_scored_rows(size, classes, shared, net.flat(), head, count, n, v), shape)
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "scored")
    log = lambda c: F.log10((c + F.lit(0.1)) / F.lit(n + 0.1 * (v + 1)))
    tails = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    rest = tails.join(words, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    rest = rest.groupBy("row").agg(F.sum(F.col("times") * log(F.col("c"))).alias("tail_score"), F.sum(F.when(F.col("c") > 0, F.col("times"))).alias("n_tail"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.drop("words", "times").join(rest, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_head") + zero("n_tail") + F.lit(int(texts > 0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("head_score") + zero("tail_score") + log(F.lit(texts))).alias("base_score"), "score",
    )
