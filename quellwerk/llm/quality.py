"""Quality classifier: random Fourier features of document statistics, ridge regression by normal
equations that partitions sum, and isotonic calibration.

Statistics describe the whole text: its length, the shares of kinds of characters, words and lines,
and how much repeats. Standardised, they pass through cosines of random projections, whose inner
products approximate a Gaussian kernel. All labelled rows count; what reaches the driver are sums
of fixed size: moments, normal equations, and a histogram of scores for the calibration.

Defined cases: a null text counts as empty, and an empty text has all-zero statistics and a score
as any other; labels of a repeated id are averaged, null labels and null ids are left out; without
labels every score is 0.5; repeated rows score alike; of documents only id and text are read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quellwerk.llm.common import array_batch, binary, materialise, remainder, small_batches, summed

FEATURES = 384
RIDGE = 0.3
BINS = 2048
_KINDS = [
    [*range(97, 123)], [*range(65, 91)], [*range(48, 58)], [32], [9, 10, 13], [46], [44], [33, 63], [45, 95],
    [34, 39, 40, 41], [58, 59], [35, 36, 37, 38, 42, 43, 61, 64, 94, 96, 126], [60, 62, 91, 92, 93, 123, 124, 125, 47], [*range(128, 256)],
]
_KIND = np.full(256, len(_KINDS))
for _k, _bytes in enumerate(_KINDS):
    _KIND[_bytes] = _k
_SENTENCE = re.compile(rb"[.!?\n]+")
N_STATS = len(_KINDS) + 1 + 15


def statistics(text: bytes) -> np.ndarray:
    """N_STATS numbers that describe the text."""
    out = np.zeros(N_STATS)
    n = len(text)
    if not n:
        return out
    raw = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    kinds = np.bincount(_KIND, raw, len(_KINDS) + 1)
    out[: len(kinds)] = np.sqrt(kinds / n)
    words = text.split()
    lines = text.split(b"\n")
    parts = [p for p in _SENTENCE.split(text) if p.strip()]
    share = raw[raw > 0] / n
    many = max(len(words), 1)
    lengths = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    folded: dict[bytes, int] = {}
    for w in words:
        folded[w] = folded.get(w, 0) + 1
    marked = sum(c for w, c in folded.items() if not (w[-1:].isalnum() or w[-1] > 127))
    upper = sum(c for w, c in folded.items() if w.isupper())
    packed = len(zlib.compress(text, 1)) / n
    out[len(kinds) :] = (
        np.log1p(n), np.log1p(len(words)), np.log1p(lengths.mean()), np.log1p(lengths.std()), np.log1p(lengths.max()),
        len(folded) / many, max(folded.values(), default=0) / many, marked / many, upper / many,
        len(set(lines)) / len(lines), np.log1p(n / len(lines)), len(set(parts)) / max(len(parts), 1), np.log1p(many / max(len(parts), 1)),
        -(share * np.log(share)).sum(), packed,
    )
    return out


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) per row, the statistics as float32 bytes."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t.as_py()).astype(np.float32).tobytes() for t in binary(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], ["doc_id", "stats"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(read, "doc_id long, stats binary")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("stats").to_pylist()), np.float32).reshape(-1, N_STATS).astype(np.float64)


class Model:
    """Standardisation, random projections, ridge weights and the calibration curve."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.project = rng.normal(0, 1 / np.sqrt(N_STATS), (N_STATS, FEATURES))
        self.shift = rng.uniform(0, 2 * np.pi, FEATURES)
        self.mean, self.std = np.zeros(N_STATS), np.ones(N_STATS)
        self.weights = np.zeros(FEATURES + N_STATS + 1)
        self.knots, self.levels = np.array([0.0, 1.0]), np.array([0.5, 0.5])

    def features(self, stats: np.ndarray) -> np.ndarray:
        """Cosines that approximate the kernel, beside the statistics themselves and a constant."""
        x = np.clip((stats - self.mean) / self.std, -6, 6)
        return np.hstack((np.cos(x @ self.project + self.shift) * np.sqrt(2 / FEATURES), 0.05 * x, np.ones((len(x), 1))))

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.knots, self.levels), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pools adjacent violators of points sorted by x: the pools' weighted centres and means."""
    pools: list[list[float]] = []
    for xi, yi, wi in zip(x, y, weight, strict=True):
        pools.append([xi * wi, yi * wi, wi])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    centres = np.array([p[0] / p[2] for p in pools])
    return centres, np.array([p[1] / p[2] for p in pools])


def _total(rows: DataFrame, length: int, of) -> np.ndarray:
    """The sum over all batches of the arrays that of(stats, y) gives; one array a partition."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length)
        for batch in batches:
            if batch.num_rows:
                total += of(_matrix(batch), batch.column("y").to_numpy(zero_copy_only=False))
        yield array_batch(total)

    return summed(rows.select("stats", "y").mapInArrow(add, "chunk int, cells binary"), length)


def train(stats: DataFrame, labels: DataFrame, label: str = "quality") -> Model | None:
    """Fits the model to the labelled rows of stats (doc_id, stats). Every fourth labelled document,
    by a hash, is kept from the regression and calibrates it."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg(F.col(label).cast("double")).alias("y"))
    rows = materialise(stats.join(known, "doc_id").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(4))), "labelled")
    fitted, held = rows.filter("part <> 0"), rows.filter("part = 0")
    model = Model()
    moments = _total(rows, 2 * N_STATS + 1, lambda x, y: np.concatenate(([len(x)], x.sum(0), (x * x).sum(0))))
    n = moments[0]
    if not n:
        return None
    model.mean = moments[1 : N_STATS + 1] / n
    model.std = np.sqrt(np.maximum(moments[N_STATS + 1 :] / n - model.mean**2, 0)) + 1e-3
    size = len(model.weights)

    def equations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = model.features(x)
        return np.concatenate(((z.T @ z).ravel(), z.T @ y, [len(y)]))

    sums = _total(fitted, size * size + size + 1, equations)
    if not sums[-1]:
        sums, held = _total(rows, size * size + size + 1, equations), rows
    model.weights = np.linalg.solve(sums[: size * size].reshape(size, size) + RIDGE * np.eye(size), sums[size * size : -1])

    # Scores lie around 0 and 1; bins of a fixed range keep the histogram's size fixed.
    low, high = -0.5, 1.5

    def histogram(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        at = np.clip((model.raw(x) - low) / (high - low) * BINS, 0, BINS - 1).astype(int)
        return np.concatenate((np.bincount(at, minlength=BINS), np.bincount(at, y, BINS)))

    bins = _total(held if not held.isEmpty() else rows, 2 * BINS, histogram)
    count, good = bins[:BINS], bins[BINS:]
    used = count > 0
    centres = low + (np.arange(BINS) + 0.5) * (high - low) / BINS
    model.knots, model.levels = isotonic(centres[used], good[used] / count[used], count[used])
    # Between pools the curve is drawn straight, and beyond them it rises a little, so that scores
    # of one pool keep their order.
    model.knots = np.concatenate(([low], model.knots, [high]))
    model.levels = np.concatenate(([max(0, model.levels[0] - 0.02)], model.levels, [min(1, model.levels[-1] + 0.02)]))
    return model


def score(stats: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score) per row of stats."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = np.full(batch.num_rows, 0.5) if shared.value is None else shared.value.score(_matrix(batch))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"])

    return stats.select("doc_id", "stats").mapInArrow(apply, "doc_id long, score double")


HELD_OUT = (5, 0)
LEAST_SCORE = 0.3


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    modulus, out = HELD_OUT
    stats = materialise(document_statistics(docs), "statistics")
    model = train(stats, labels.filter(remainder(F.col("doc_id"), modulus) != out))
    return score(stats, model).select("doc_id", (remainder(F.col("doc_id"), modulus) == out).alias("held_out"), "score", (F.col("score") >= LEAST_SCORE).cast("int").alias("predicted"))
