"""Toxicity by a factorization machine over hashed terms.

A text is the set of its terms, hashed to a fixed number of cells. The machine scores single terms
by weights and pairs of terms by the products of their factors, so that a pair may count where its
members alone do not. How often a term goes with the label is counted over all labelled rows; the
machine is then fitted by adaptive gradient steps on a bounded sample of them, in which the weight of
a term moves the more, the stronger and the surer that association is.

Defined cases: terms are runs of digits, letters and non-ASCII, lower-cased over A-Z; a null or
empty text has no terms and gets the bias alone; labels of a repeated id are averaged, null labels
are left out; without any label the score is 0.5; a document without id has no label; repeated rows
are scored alike, counted each, and one row of the sample; a term of a single labelled row counts
little; texts are read whole however long; only the id and text are read of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quellwerk.llm.common import array_rows, binary, bounded_sample, broadcast_if_small, materialise, remainder, small_batches, summed
from quellwerk.llm.decontaminate import _FOLD
from quellwerk.llm.jaccard import word_hashes

CELLS = 1 << 18
FACTORS = 8
#: Labelled rows in the sample that fits the machine, on average at most, and the bytes of their terms.
SAMPLE, SAMPLE_BYTES = 12_000, 64 << 20
#: The likelihood ratio statistic at which half of a term's association with the label counts.
EVIDENCE = 12.0
#: Factors start with this spread, and with half of it for a term of FEW labelled rows: no term is left
#: out, but those of few rows are mostly chance.
SPREAD, FEW = 0.02, 8
#: With fewer sampled rows none are held back.
LEAST_HELD = 140


def terms(text: bytes) -> np.ndarray:
    """The distinct cells of a text's terms."""
    return np.unique((word_hashes(text.translate(_FOLD)) >> np.uint64(46)).astype(np.int64))


class Counts:
    """Rows that hold each cell and the sum of their labels, and both for all rows."""

    def __init__(self, found: np.ndarray, marked: np.ndarray, total: float, positive: float):
        self.found, self.marked, self.total, self.positive = found, marked, total, positive

    @classmethod
    def of(cls, rows: list[np.ndarray], labels: np.ndarray, cells: int) -> Counts:
        held = np.concatenate([*rows, np.empty(0, np.int64)])
        return cls(np.bincount(held, minlength=cells), np.bincount(held, np.repeat(labels, [len(r) for r in rows]), cells), len(rows), float(labels.sum()))

    def association(self) -> np.ndarray:
        """The size of each cell's log odds ratio, shrunk by how likely chance gives as much."""
        n, k, total, positive = self.found.astype(float), self.marked, self.total, self.positive
        if not 0 < positive < total:
            return np.zeros(len(n))
        p = positive / total

        def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
            seen = np.maximum(seen, 0)
            return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-300) / np.maximum(expected, 1e-300)), 0)

        g2 = np.maximum(2 * (part(k, n * p) + part(n - k, n * (1 - p)) + part(positive - k, (total - n) * p) + part(total - n - positive + k, (total - n) * (1 - p))), 0)
        ratio = np.log((k + p) / (np.maximum(n - k, 0) + 1 - p)) - np.log(p / (1 - p))
        return np.abs(ratio) * g2 / (g2 + EVIDENCE)


class FactorizationMachine:
    def __init__(self, cells: int = CELLS, factors: int = FACTORS, seed: int = 11):
        self.bias, self.w = 0.0, np.zeros(cells, np.float32)
        self.v = np.zeros((cells, factors), np.float32)
        self.seed = seed

    def logit(self, cells: np.ndarray) -> float:
        v = self.v[cells]
        sums = v.sum(0, dtype=np.float64)
        return float(self.bias + self.w[cells].sum(dtype=np.float64) + 0.5 * (sums @ sums - (v * v).sum(dtype=np.float64)))

    def fit(self, rows: list[np.ndarray], labels: np.ndarray, epochs: int = 14, batch: int = 64, rate: float = 0.12, l2: float = 0.05, held: np.ndarray | None = None, counts: Counts | None = None) -> None:
        """Mini-batch AdaGrad on the logistic loss, over the terms of the counted rows; counts are of
        the rows themselves if none are given. The held rows (every seventh by default, none if
        there are few) choose the best epoch and must not be counted; where none are held, the last
        epoch stands."""
        rng = np.random.default_rng(self.seed)
        if held is None:
            held = np.arange(len(rows)) % 7 == 6 if len(rows) >= LEAST_HELD else np.zeros(len(rows), bool)
        learned, judged = np.flatnonzero(~held), np.flatnonzero(held)
        counts = counts or Counts.of([rows[i] for i in learned], labels[learned], len(self.w))
        seen = np.flatnonzero(counts.found)
        rows = [r[counts.found[r] > 0] for r in rows]
        self.v[seen] = rng.normal(0, SPREAD, (len(seen), self.v.shape[1])) * (counts.found[seen] / (counts.found[seen] + FEW))[:, None]
        mean = float(np.clip(labels.mean(), 0.01, 0.99))
        self.bias = float(np.log(mean / (1 - mean)))
        # A term's weight is free times scale; the penalty is on free.
        scale, free = counts.association().astype(np.float32), np.zeros_like(self.w)
        sum_w, sum_v = np.full(len(self.w), 5.0, np.float32), np.full(self.v.shape, 5.0, np.float32)
        best = (np.inf, self.bias, self.w, self.v)
        for _ in range(epochs):
            order = rng.permutation(learned)
            for at in range(0, len(order), batch):
                self._step([rows[i] for i in order[at : at + batch]], labels[order[at : at + batch]], rate, l2, scale, free, sum_w, sum_v)
            self.w = free * scale
            if len(judged):
                p = np.array([self.score(rows[i]) for i in judged])
                loss = -float(np.where(labels[judged] > 0.5, np.log(p + 1e-9), np.log(1 - p + 1e-9)).mean())
                if loss < best[0]:
                    best = (loss, self.bias, self.w, self.v.copy())
        if len(judged):
            _, self.bias, self.w, self.v = best

    def gradient(self, rows: list[np.ndarray], labels: np.ndarray, l2: float, scale: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float] | None:
        """(cells, by free weight, by factors, by bias) of the summed logistic loss of the rows, with
        l2 / 2 times the squares of what the cells they use hold; the bias has the mean. None if the
        rows are empty."""
        sizes = np.array([len(r) for r in rows])
        cells, row = np.concatenate(rows), np.repeat(np.arange(len(rows)), sizes)
        if not len(cells):
            return None
        v, x = self.v[cells], scale[cells]
        full = np.flatnonzero(sizes)
        sums = np.zeros((len(rows), v.shape[1]), v.dtype)
        sums[full] = np.add.reduceat(v, (np.cumsum(sizes) - sizes)[full])
        squares = np.bincount(row, (v * v).sum(1), len(rows))
        z = self.bias + np.bincount(row, free[cells] * x, len(rows)) + 0.5 * ((sums**2).sum(1) - squares)
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels).astype(v.dtype)
        by_cell = np.argsort(cells, kind="stable")
        used, first = np.unique(cells[by_cell], return_index=True)
        each = g[row]
        gw = np.add.reduceat((each * x)[by_cell], first) + l2 * free[used]
        gv = np.add.reduceat((each[:, None] * (sums[row] - v))[by_cell], first) + l2 * self.v[used]
        return used, gw, gv, float(g.mean())

    def _step(self, rows: list[np.ndarray], labels: np.ndarray, rate: float, l2: float, scale: np.ndarray, free: np.ndarray, sum_w: np.ndarray, sum_v: np.ndarray) -> None:
        found = self.gradient(rows, labels, l2, scale, free)
        if found is None:
            return
        used, gw, gv, by_bias = found
        sum_w[used] += gw**2
        sum_v[used] += gv**2
        free[used] -= rate * gw / np.sqrt(sum_w[used])
        self.v[used] -= 0.1 * rate * gv / np.sqrt(sum_v[used])
        self.bias -= 0.02 * rate * by_bias

    def score(self, cells: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(cells), -30, 30))))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, seed: int = 11) -> FactorizationMachine | None:
    """Fits the machine to labels (doc_id and label). One pass over the labelled texts counts their
    terms and gathers those of the sample; without labels there is no machine."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg(F.col(label).cast("double")).alias("y"))
    total = known.count()
    if not total:
        return None
    chosen = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) < int(min(1.0, sample / total) * (1 << 30))
    held = chosen & (F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(7)) == 6) & F.lit(min(total, sample) >= LEAST_HELD)
    known = known.select("doc_id", "y", chosen.alias("chosen"), held.alias("held"))
    plain = docs.select("doc_id", "text").join(broadcast_if_small(known, 80), "doc_id").select("doc_id", "text", "y", "chosen", "held")
    names = ["doc_id", "y", "held", "terms", "chunk", "cells"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows with each cell, sums of their labels, and at the end both for all rows.
        counts = np.zeros(2 * CELLS + 2)
        for batch in batches:
            kept = []
            for doc_id, text, y, use, out in zip(batch.column("doc_id").to_pylist(), binary(batch.column("text")), batch.column("y").to_pylist(), batch.column("chosen").to_pylist(), batch.column("held").to_pylist(), strict=True):
                found = terms(text.as_py())
                if not out:
                    counts[found] += 1
                    counts[CELLS + found] += y
                    counts[-2:] += 1, y
                if use:
                    kept.append((doc_id, y, out, found.astype(np.int32).tobytes()))
            if kept:
                n, columns = len(kept), list(zip(*kept, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.bool_()), pa.array(columns[3], pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
        if counts[-2]:
            chunk, cells = array_rows(counts, np.float32)
            n = len(chunk)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.binary()), pa.array(chunk, pa.int32()), pa.array(cells, pa.binary())], names)

    both = materialise(plain.mapInArrow(read, "doc_id long, y double, held boolean, terms binary, chunk int, cells binary"), "toxicity")
    counts = summed(both.filter("chunk is not null"), 2 * CELLS + 2, np.float32)
    # Rows that repeat an id are one row of the sample; long texts make it smaller.
    rows = bounded_sample(both.filter("chunk is null").groupBy("doc_id").agg(F.min("y").alias("y"), F.bool_or("held").alias("held"), F.min("terms").alias("terms")), "doc_id", F.octet_length("terms"), SAMPLE_BYTES)
    rows = sorted(rows.toArrow().to_pylist(), key=lambda r: r["doc_id"])
    if not rows:
        return None
    machine = FactorizationMachine(seed=seed)
    found = [np.frombuffer(r["terms"], np.int32).astype(np.int64) for r in rows]
    machine.fit(found, np.array([r["y"] for r in rows]), held=np.array([r["held"] for r in rows]), counts=Counts(counts[:CELLS], counts[CELLS:-2], counts[-2], counts[-1]))
    return machine


def score(docs: DataFrame, machine: FactorizationMachine | None, carry: list[str], text_col: str = "text") -> DataFrame:
    """The carried columns with the score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)], F.col(f"`{text_col}`").alias("_text"))
    schema = T.StructType([*plain.drop("_text").schema.fields, T.StructField("score", T.DoubleType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.score(terms(t.as_py())) if shared.value else 0.5 for t in binary(batch.column("_text"))]
            yield pa.RecordBatch.from_arrays([*[batch.column(f"c{i}") for i in range(len(carry))], pa.array(found, pa.float64())], schema.names)

    small_batches(docs.sparkSession)
    return plain.mapInArrow(apply, schema).toDF(*carry, "score")


HELD_OUT = (4, 2)
LEAST_SCORE = 0.3


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    modulus, out = HELD_OUT
    machine = train(docs, labels.filter(remainder(F.col("doc_id"), modulus) != out))
    marked = docs.select("doc_id", (remainder(F.col("doc_id"), modulus) == out).alias("held_out"), "text")
    scored = score(marked, machine, ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= LEAST_SCORE).cast("int"))
