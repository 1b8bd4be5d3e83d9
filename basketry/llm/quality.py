"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every word of every document adds the fixed sparse +-1 vectors of its neighbours to the
context vector of its bucket (words are hashed into `words` buckets, a fixed bound), so
the word vectors cover the whole corpus and one task sends one partial sum a bucket. A
document is the mean and the spread of its words' vectors. A two-layer numpy network is
fitted on a bounded sample of labelled rows, its temperature on another part of them,
and scores every document in a map stage.

Defined cases: null and empty texts pool to zeros and get the network's score for those;
labels that are null, or that disagree for one doc_id, are left out; without labels of
both kinds every score is the share of label 1 (0.5 with none); repeated rows give
repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import U, as_bytes, mix, slabs, slices, words_of

WORDS = 1 << 14
WIDTH = 32
NEIGHBOURS = 2
NONZERO = 4
#: Labelled rows the network is fitted on, at most about.
TRAIN_ROWS = 20_000
HIDDEN = 32
EPOCHS = 40
CUT = 0.7


def buckets_of(h: np.ndarray, words: int = WORDS) -> np.ndarray:
    return (h >> U(64 - int(words).bit_length() + 1)).astype(np.int64)


def index_vectors(words: int = WORDS, width: int = WIDTH) -> np.ndarray:
    """The sparse random vector of each bucket: NONZERO places of +1 or -1 by hashing."""
    out = np.zeros((words, width), dtype=np.float32)
    for k in range(NONZERO):
        r = mix(np.arange(words, dtype=np.uint64) * U(NONZERO) + U(k + 1))
        np.add.at(out, (np.arange(words), (r % U(width)).astype(np.int64)), np.where(r >> U(40) & U(1), 1, -1))
    return out


def word_vectors(docs: DataFrame, words: int = WORDS, width: int = WIDTH) -> np.ndarray:
    """Unit context vectors of all word buckets, counted over all documents; `words` rows, whatever the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, total, seen = index_vectors(words, width), np.zeros((words, width)), np.zeros(words)
        for batch in slices(batches):
            blobs = as_bytes(batch.column(0))
            for lo, hi in slabs(blobs):
                h, _, _, at = words_of(blobs[lo:hi])
                b = buckets_of(h, words)
                owner = np.repeat(np.arange(hi - lo), np.diff(at))
                seen += np.bincount(b, minlength=words)
                for d in range(1, NEIGHBOURS + 1):
                    same = owner[:-d] == owner[d:] if len(owner) > d else np.zeros(0, bool)
                    x, y = b[:-d][same] if len(owner) > d else b[:0], b[d:][same] if len(owner) > d else b[:0]
                    # neighbours meet as (word, neighbour) counts, so each distinct pair adds its vector once
                    pairs, times = np.unique(np.concatenate((x * words + y, y * words + x)), return_counts=True)
                    row, other = pairs // words, pairs % words
                    start = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else np.zeros(0, np.int64)
                    if len(start):
                        total[row[start]] += np.add.reduceat(index[other] * times[:, None], start, axis=0)
        rows = np.flatnonzero(seen)
        for lo in range(0, len(rows), 4096):
            part = rows[lo : lo + 4096]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), pa.array(seen[part].astype(np.int64)), pa.FixedSizeListArray.from_arrays(pa.array(total[part].astype(np.int64).ravel()), width).cast(pa.list_(pa.int64()))],
                names=["word", "times", "context"],
            )

    partial = docs.select("text").mapInArrow(count, "word bigint, times bigint, context array<bigint>")
    summed = partial.groupBy("word").agg(F.array(*(F.sum(F.col("context")[k]) for k in range(width))).alias("context"))
    out = np.zeros((words, width), dtype=np.float32)
    for r in summed.toLocalIterator():  # `words` rows at most
        out[r.word] = r.context
    norm = np.sqrt((out.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    return (out / np.maximum(norm, 1e-9)).astype(np.float32)


def pooled(blobs: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """Mean and standard deviation of each text's word vectors, likeness of neighbours at two distances, log length."""
    words, width = vectors.shape
    out = np.zeros((len(blobs), features(width)))
    for lo, hi in slabs(blobs):
        h, _, _, at = words_of(blobs[lo:hi])
        v = vectors[buckets_of(h, words)]
        n = np.diff(at)
        full = np.flatnonzero(n)
        if len(full):
            mean = np.add.reduceat(v.astype(np.float64), at[full], axis=0) / n[full, None]
            square = np.add.reduceat(v.astype(np.float64) ** 2, at[full], axis=0) / n[full, None]
            out[lo + full, : 2 * width] = np.hstack((mean, np.sqrt(np.maximum(square - mean**2, 0))))
            for d in (1, 2):
                alike = np.zeros(len(v))
                alike[d:] = (v[d:] * v[:-d]).sum(axis=1)
                for first in range(d):  # nothing stands before a text's first words
                    alike[np.minimum(at[full] + first, at[full + 1] - 1)] = 0
                out[lo + full, 2 * width + d - 1] = np.add.reduceat(alike, at[full]) / np.maximum(n[full] - d, 1)
            out[lo + full, 2 * width + 2] = np.log1p(n[full])
    return out


def features(width: int) -> int:
    return 2 * width + 3


class Network:
    """Two layers, fitted by full passes of Adam over shuffled batches with a fixed seed, then calibrated by one temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = 7):
        self.share = float(y.mean()) if len(y) else 0.5
        self.fitted = len(y) >= 10 and 0 < y.sum() < len(y)
        if not self.fitted:
            return
        rng = np.random.default_rng(seed)
        self.shift, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        x = (x - self.shift) / self.scale
        order = rng.permutation(len(x))
        fit, hold = order[len(x) // 5 :], order[: len(x) // 5]
        self.p = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(2 / hidden), (hidden, 1)), np.zeros(1)]
        m, v, step = [np.zeros_like(q) for q in self.p], [np.zeros_like(q) for q in self.p], 0
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(fit), max(1, len(fit) // 128)):
                step += 1
                for q, g, a, b in zip(self.p, self._gradient(x[at], y[at]), m, v, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    q -= 0.003 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        self.temperature = 1.0
        if len(hold) >= 10:
            z = self._logit(x[hold])
            grid = np.exp(np.linspace(-1.5, 3, 91))
            loss = [np.mean(np.logaddexp(0, z / t) - y[hold] * z / t) for t in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def _logit(self, x: np.ndarray) -> np.ndarray:
        return (np.maximum(x @ self.p[0] + self.p[1], 0) @ self.p[2] + self.p[3])[:, 0]

    def _gradient(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        pre = x @ self.p[0] + self.p[1]
        act = np.maximum(pre, 0)
        z = (act @ self.p[2] + self.p[3])[:, 0]
        d = ((1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) / len(y))[:, None]
        back = d @ self.p[2].T * (pre > 0)
        return [x.T @ back + 1e-4 * self.p[0], back.sum(axis=0), act.T @ d + 1e-4 * self.p[2], d.sum(axis=0)]

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), self.share)
        z = self._logit((x - self.shift) / self.scale) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _pool(df: DataFrame, vectors: np.ndarray, width: int) -> DataFrame:
    held = df.sparkSession.sparkContext.broadcast(vectors)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = pooled(as_bytes(batch.column(1)), held.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), features(width)).cast(pa.list_(pa.float64()))], names=["label", "x"])

    return df.select("label", "text").mapInArrow(pool, "label int, x array<double>")


def train(docs: DataFrame, labelled: DataFrame, train_rows: int = TRAIN_ROWS, words: int = WORDS, width: int = WIDTH) -> tuple[np.ndarray, Network]:
    """Word vectors over all docs and the network fitted on rows (doc_id, label, text), about train_rows at most, chosen by a hash of doc_id."""
    vectors = word_vectors(docs, words, width)
    labelled = labelled.where(F.col("label").isin(0, 1))
    total = labelled.count()
    drawn = F.pmod(F.xxhash64(F.lit("train"), "doc_id"), F.lit(1 << 30)) < int(min(1.0, train_rows / max(total, 1)) * (1 << 30))
    rows = _pool(labelled.where(drawn), vectors, width).collect()  # about train_rows rows of features(width) numbers
    rows = sorted((r.label, tuple(r.x)) for r in rows)
    x, y = np.array([r[1] for r in rows]).reshape(-1, features(width)), np.array([r[0] for r in rows], dtype=float)
    return vectors, Network(x, y)


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """(doc_id, label, text) of the documents whose labels agree."""
    one = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("most")).where("label = most")
    return docs.select("doc_id", "text").join(one.select("doc_id", F.col("label").cast("int").alias("label")), "doc_id")


def score(docs: DataFrame, vectors: np.ndarray, network: Network) -> DataFrame:
    """(doc_id, score) of each row: the calibrated probability of label 1."""
    held = docs.sparkSession.sparkContext.broadcast((vectors, network))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            vectors, network = held.value
            p = network.probability(pooled(as_bytes(batch.column(1)), vectors))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(judge, "doc_id bigint, score double")
