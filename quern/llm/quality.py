"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters slide over the bytes of the whole text.  Overlapping chunks
(``2 * STRIDE`` bytes, one every ``STRIDE``) cover it; each filter is
max-pooled within each chunk, and the mean and the maximum over all chunks
pass a logistic unit, which gives the probability of label 1.

The network is fitted on the driver, with random cuts of good texts among them, to at most ``per_class`` labelled
documents of each class (those of least id hash), each of them whole.  Every text is scored whole.

Cases: a null text is the empty one, which is scored too; without labelled
rows of both classes the score is the share of label 1 for every text (0.5
without any); labels other than 0 and 1 are passed over, and of contradicting
labels of one document the smaller counts; a null id hashes as empty text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._words import pieces, texts_buffer

STRIDE = 512
PAD = 256  # stands beyond a text's end, with weights of its own


def remainder(column: str, by: int):
    """crc32 of an id as text, modulo ``by``."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % by


@dataclass
class Network:
    filters: int = 16
    width: int = 5
    seed: int = 5
    constant: float | None = None
    p: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        rng = np.random.default_rng(self.seed)
        self.p = {
            "table": rng.normal(0, 0.3, (self.width, 257, self.filters)).astype(np.float32),
            "bias": np.zeros(self.filters, np.float32),
            "mean": rng.normal(0, 0.3, self.filters).astype(np.float32),
            "max": rng.normal(0, 0.3, self.filters).astype(np.float32),
            "out": np.zeros(1, np.float32),
        }

    def padded(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts padded to whole strides, and the first stride of each."""
        lens = np.diff(off)
        blocks = np.maximum(1, -(-(lens + self.width - 1) // STRIDE))
        first = np.concatenate([[0], np.cumsum(blocks)])
        out = np.full(first[-1] * STRIDE + self.width - 1, PAD, np.int64)
        for i in range(len(lens)):
            at = first[i] * STRIDE
            out[at : at + lens[i]] = buf[off[i] : off[i + 1]]
        return out, first

    def strides(self, codes: np.ndarray, where: bool = False, ends: np.ndarray | None = None):
        """Per stride and filter the greatest response (and its place). ``ends``: where texts end, so that no filter reads on into the next one."""
        n = len(codes) - self.width + 1
        table = self.p["table"]
        best, place = np.empty((n // STRIDE, self.filters), np.float32), None
        if where:
            place = np.empty(best.shape, np.int64)
        step = 32 * STRIDE  # stays in cache
        for a in range(0, n, step):
            b = min(n, a + step)
            r = table[0].take(codes[a:b], axis=0)
            cut = ends[(ends > a) & (ends <= b)] - a if ends is not None else []
            for j in range(1, self.width):
                now = codes[a + j : b + j]
                if len(cut):
                    now = now.copy()
                    now[(cut[:, None] - 1 - np.arange(j)).ravel()] = PAD
                r += table[j].take(now, axis=0)
            r = r.reshape(-1, STRIDE, self.filters)
            s = slice(a // STRIDE, b // STRIDE)
            if where:
                place[s] = r.argmax(axis=1)
                best[s] = np.take_along_axis(r, place[s][:, None], axis=1)[:, 0]
            else:
                best[s] = r.max(axis=1)
        if where:
            place += np.arange(len(place))[:, None] * STRIDE
        return best + self.p["bias"], place

    @staticmethod
    def chunks(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(left stride, right stride, first chunk of each text): a chunk is two neighbouring strides, or a lone one."""
        n = np.diff(first)
        many = np.maximum(n - 1, 1)
        at = np.concatenate([[0], np.cumsum(many)])
        left = np.arange(at[-1]) + np.repeat(first[:-1] - at[:-1], many)
        return left, left + np.repeat(n > 1, many), at

    def pooled(self, best: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, right, at = self.chunks(first)
        c = np.maximum(np.maximum(best[left], best[right]), 0)
        return np.add.reduceat(c, at[:-1]) / np.diff(at)[:, None], np.maximum.reduceat(c, at[:-1])

    def score(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(off) - 1, self.constant)
        codes, first = self.padded(buf, off)
        mean, most = self.pooled(self.strides(codes, ends=first[1:] * STRIDE)[0], first)
        z = (mean @ self.p["mean"] + most @ self.p["max"]).astype(np.float64) + float(self.p["out"][0])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def gradients(self, text: np.ndarray, label: float) -> dict:
        """Of the log loss of one text."""
        codes, first = self.padded(text, np.array([0, len(text)]))
        best, place = self.strides(codes, True)
        left, right, _ = self.chunks(first)
        use = np.where(best[left] >= best[right], left[:, None], right[:, None])
        value = np.take_along_axis(best, use, axis=0)
        c = np.maximum(value, 0)
        mean, most, top = c.mean(axis=0), c.max(axis=0), c.argmax(axis=0)
        z = float(mean @ self.p["mean"] + most @ self.p["max"] + self.p["out"][0])
        d = np.float32(1 / (1 + np.exp(-np.clip(z, -30, 30))) - label)
        back = np.repeat(d * self.p["mean"][None] / len(c), len(c), axis=0)
        back[top, np.arange(self.filters)] += d * self.p["max"]
        back *= value > 0
        at = np.take_along_axis(place, use, axis=0)
        table = np.zeros_like(self.p["table"])
        f = np.broadcast_to(np.arange(self.filters), at.shape)
        for j in range(self.width):
            np.add.at(table[j], (codes[at + j], f), back)
        return {"table": table, "bias": back.sum(axis=0), "mean": d * mean, "max": d * most, "out": np.array([d], np.float32)}

    def fit(self, texts: list[bytes], labels: list[int], rounds: int = 6, least_steps: int = 900, batch: int = 32, rate: float = 0.015) -> Network:
        """Adam on shuffled batches, for ``rounds`` rounds and ``least_steps`` steps at least; the two classes weigh the same."""
        y = np.array(labels)
        if not (0 < y.sum() < len(y)):
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
        rng = np.random.default_rng(self.seed)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        arrays = [np.frombuffer(t, np.uint8) for t in texts]
        rounds = max(rounds, -(-least_steps // -(-len(y) // batch)))
        t, steps = 0, rounds * -(-len(y) // batch)
        for _ in range(rounds):
            order = rng.permutation(len(y))
            for a in range(0, len(y), batch):
                part = order[a : a + batch]
                total = {k: np.zeros_like(x) for k, x in self.p.items()}
                for i in part:
                    text = arrays[i]
                    if y[i] == 1 and len(text) > 4 and rng.random() < 0.3:  # short texts are rare among the labelled
                        size = int(np.exp(rng.uniform(np.log(4), np.log(len(text)))))
                        at = int(rng.integers(0, len(text) - size + 1))
                        text = text[at : at + size]
                    for k, g in self.gradients(text, float(y[i])).items():
                        total[k] += np.float32(weight[i] / len(part)) * g
                t += 1
                now = rate * (1 - (t - 1) / steps)
                for k, g in total.items():
                    g += np.float32(1e-4) * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] -= (now * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
        return self


def fitted(docs: DataFrame, labels: DataFrame, per_class: int = 1000, **how) -> Network:
    """A network fitted to docs (doc_id, text) whose crc32(doc_id) mod 3 is not 1, as labels (doc_id, quality) mark them."""
    known = labels.where(F.col("quality").isin(0, 1)).where(remainder("doc_id", 3) != 1).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    least = lambda q: known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    sample = least(0).union(least(1))  # 2 * per_class rows at most: fit to broadcast
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    got = rows.join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").limit(2 * per_class).collect()
    return Network(**how).fit([r["text"].encode() for r in got], [r["quality"] for r in got])


def _scored(network: Network, fields: list[str]):
    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                score = network.score(*texts_buffer(part.column(part.schema.get_field_index("text"))))
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(f)) for f in fields), pa.array(score)], [*fields, "_score"])

    return run


def scored(docs: DataFrame, network: Network, keep: list[str] | None = None) -> DataFrame:
    """docs with _score, the probability of label 1; ``keep``: the columns that stay (all)."""
    if "_score" in docs.columns:
        raise ValueError("docs already has a column _score")
    docs = docs.withColumn("text", F.col("text").cast("string"))
    keep = docs.columns if keep is None else keep
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema) + ", _score double"
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(_scored(network, keep), schema)
