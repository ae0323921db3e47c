"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams,
trained by follow-the-regularised-leader with elastic-net penalties, calibrated by a temperature.

A text's features are its n-grams of 1 to 3 characters of the lower-cased text, everything but
letters counting as a space, hashed to a fixed number of cells; a cell's value is its share of the
text's n-grams times its inverse document frequency. Document frequencies come from all learning
documents, the weights from a bounded sample of them.

The best language's probability compares languages only, and is high for a text in none of them. That
a text is in its language at all is told by its n-grams: they must not be much rarer in the learning
documents than those of the language's sampled documents are.

Defined cases: a null text or one without letters is "und" with score 0; without learning documents
everything is; languages tie-break by code point; documents without id belong to the remainder of
the empty text; repeated rows are predicted alike, each in its own row, and are one row of the sample;
texts are read whole however long; other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quellwerk.llm.common import array_rows, binary, bounded_sample, materialise, remainder, small_batches, summed

CELLS = 1 << 15
#: Learning documents in the sample that fits the weights, on average at most, and the bytes of their
#: features.
SAMPLE, SAMPLE_BYTES = 6000, 128 << 20
_MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
#: Values of a text's features sum to about this.
SCALE = 30.0
#: A text is in none of the languages if its n-grams are on average rarer than usual by this much in
#: logarithms, and by so many standard errors. A letter is in about three n-grams, so their number
#: counts for a third.
RARER, ERRORS, OVERLAP = 1.0, 4.0, 3


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def grams(text: bytes) -> np.ndarray:
    """The cells of all n-grams of the text, with repetitions; none if it has no letter."""
    codes = np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return np.empty(0, np.int64)
    # One space stands for every stretch without letters, the ends included.
    held = np.concatenate(([False], letter, [False]))
    marked = np.concatenate(([32], codes, [32])) * held + np.uint32(32) * ~held
    marked = marked[held | np.concatenate(([True], held[:-1]))].astype(np.uint64)
    out, sums = [], np.zeros(len(marked), np.uint64)
    for n in range(1, min(3, len(marked)) + 1):
        sums = sums[: len(marked) - n + 1] + marked[n - 1 :] * _MUL[n - 1]
        out.append(((sums + np.uint64(n)) * _MUL[0]) >> np.uint64(49))
    return np.concatenate(out).astype(np.int64)


class FtrlSoftmax:
    """Per-coordinate FTRL-proximal for a softmax over sparse rows."""

    def __init__(self, cells: int, classes: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.z, self.n = np.zeros((cells + 1, classes)), np.zeros((cells + 1, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)

    def learn(self, cells: np.ndarray, values: np.ndarray, label: int) -> None:
        """One step; the last cell is the bias."""
        at = np.append(cells, len(self.z) - 1)
        x = np.append(values, 1.0)[:, None]
        w = self.weights(at)
        logits = (w * x).sum(0)
        p = np.exp(logits - logits.max())
        p /= p.sum()
        p[label] -= 1
        g = x * p
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature that fits held-back labels best, by a search over a grid."""
    best = (np.inf, 1.0)
    for t in np.geomspace(0.05, 20, 121):
        z = logits / t
        z -= z.max(1, keepdims=True)
        loss = np.log(np.exp(z).sum(1)).sum() - z[np.arange(len(z)), labels].sum()
        best = min(best, (float(loss), float(t)))
    return best[1]


class Model:
    """Languages, a table of idf times weight per cell, the bias, the temperature, the idf per cell,
    per language its documents' usual mean idf, and the spread of n-grams around it."""

    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray, heat: float, idf: np.ndarray | None = None, usual: np.ndarray | None = None, spread: float = 0.0):
        self.langs, self.table, self.bias, self.heat = langs, table, bias, heat
        self.idf, self.usual, self.spread = idf, usual, spread

    def foreign(self, found: np.ndarray, k: int) -> bool:
        """Whether the n-grams are too rare for a text in language k. A language without sampled
        documents takes all."""
        least = self.usual[k] + RARER + ERRORS * self.spread / np.sqrt(len(found) / OVERLAP)
        return bool(self.idf.take(found).mean(dtype=np.float64) > least)

    def predict(self, text: bytes, known: bool = False) -> tuple[str, float]:
        """The language and its probability; with known, texts in none of the languages are "und"."""
        found = grams(text)
        if not len(found) or not self.langs:
            return "und", 0.0
        logits = (self.table.take(found, 0).mean(0, dtype=np.float64) * SCALE + self.bias) / self.heat
        p = np.exp(logits - logits.max())
        k = int(p.argmax())
        if known and self.foreign(found, k):
            return "und", 0.0
        return self.langs[k], float(p[k] / p.sum())


def train(docs: DataFrame, sample: int = SAMPLE, epochs: int = 3, seed: int = 7) -> Model:
    """Learns from docs (doc_id, text, lang) whose lang is not null. One pass over their texts
    counts document frequencies and gathers the features of the sampled documents."""
    known = docs.filter("lang is not null").select("doc_id", "text", "lang")
    per_lang = known.groupBy("lang").count().collect()  # a row per language
    langs, total = sorted(r.lang for r in per_lang), sum(r["count"] for r in per_lang)
    if not langs:
        return Model([], np.zeros((1, 0), np.float32), np.zeros(0), 1.0)
    share = min(1.0, sample / total)
    chosen = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30))
    plain = known.select("text", "lang", chosen.alias("chosen"), F.xxhash64("doc_id", "text").alias("key"))
    names = ["key", "lang", "cell", "share", "chunk", "cells"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = np.zeros(CELLS, np.int64)
        for batch in batches:
            kept = []
            for text, lang, use, key in zip(binary(batch.column("text")), batch.column("lang").to_pylist(), batch.column("chosen").to_pylist(), batch.column("key").to_pylist(), strict=True):
                found = grams(text.as_py())
                if not len(found):
                    continue
                times = np.bincount(found, minlength=CELLS)
                cells = np.flatnonzero(times)
                frequency[cells] += 1
                if use:
                    kept.append((key, lang, cells.astype(np.uint16).tobytes(), (times[cells] / len(found)).astype(np.float32).tobytes()))
            if kept:
                n, columns = len(kept), list(zip(*kept, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
        chunk, cells = array_rows(frequency, np.uint32)
        n = len(chunk)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.array(chunk, pa.int32()), pa.array(cells, pa.binary())], names)

    both = materialise(plain.mapInArrow(read, "key long, lang string, cell binary, share binary, chunk int, cells binary"), "langid")
    frequency = summed(both.filter("chunk is not null"), CELLS, np.uint32)
    idf = np.log((1 + total) / (1 + frequency)) + 1
    # Repeated rows are one row of the sample; long texts make it smaller.
    sampled = both.filter("chunk is null").groupBy("key", "lang").agg(F.min("cell").alias("cell"), F.min("share").alias("share"))
    sampled = bounded_sample(sampled, "key", F.octet_length("cell") + F.octet_length("share"), SAMPLE_BYTES)
    rows = sorted(sampled.toArrow().to_pylist(), key=lambda r: (r["key"], r["lang"]))
    number = {lang: k for k, lang in enumerate(langs)}
    data, means, squares = [], [[] for _ in langs], [[] for _ in langs]
    for r in rows:
        cells = np.frombuffer(r["cell"], np.uint16).astype(np.int64)
        share, k = np.frombuffer(r["share"], np.float32), number[r["lang"]]
        data.append((cells, share * idf[cells] * SCALE, k))
        means[k].append(float(share @ idf[cells]))
        squares[k].append(float(share @ (idf[cells] - means[k][-1]) ** 2))
    # Medians, so that some documents with a wrong language do not count.
    usual = np.array([np.median(m) if m else np.inf for m in means])
    # The widest spread holds for all, as a key or a name in a short text is rare in any language.
    spread = max([float(np.sqrt(np.median(s))) for s in squares if s], default=0.0)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(data))
    held, learned = order[: len(order) // 5], order[len(order) // 5 :]
    ftrl = FtrlSoftmax(CELLS, len(langs))
    for _ in range(epochs):
        for i in rng.permutation(learned):
            ftrl.learn(*data[i])
    w = ftrl.weights()
    logits = np.array([(w[c] * v[:, None]).sum(0) + w[-1] for c, v, _ in (data[i] for i in held)]).reshape(-1, len(langs))
    heat = temperature(logits, np.array([data[i][2] for i in held], int)) if len(held) >= 20 else 1.0
    return Model(langs, (w[:-1] * idf[:, None]).astype(np.float32), w[-1], heat, idf.astype(np.float32), usual, spread)


def predict(docs: DataFrame, model: Model, text_col: str = "text", carry: list[str] | None = None, known: bool = False) -> DataFrame:
    """The carried columns (all by default) with lang_pred and score; with known, texts in none of
    the model's languages are "und"."""
    keep = [c for c in (docs.columns if carry is None else carry) if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(f"`{text_col}`").alias("_text"))
    kept = [f"c{i}" for i in range(len(keep))]
    schema = T.StructType([*plain.drop("_text").schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t.as_py(), known) for t in binary(batch.column("_text"))]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [*kept, "lang_pred", "score"])

    small_batches(docs.sparkSession)
    return plain.mapInArrow(apply, schema).toDF(*keep, "lang_pred", "score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents in an identifiable language, with their own columns. Texts without letters
    go, and texts in none of the learned languages, whatever their number."""
    small_batches(docs.sparkSession)
    model = train(docs)
    probe = docs.select(F.struct("*").alias("row"), F.col("text").alias("_probe"))
    return predict(probe, model, "_probe", carry=["row"], known=True).filter(F.col("lang_pred") != "und").select("row.*")


HELD_OUT = (3, 1)


def query(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    modulus, out = HELD_OUT
    model = train(docs.filter(remainder(F.col("doc_id"), modulus) != out))
    marked = docs.select("doc_id", (remainder(F.col("doc_id"), modulus) == out).alias("held_out"), "text")
    return predict(marked, model, carry=["doc_id", "held_out"])
