"""Benchmark decontamination by Wu-Manber search over words.

The patterns are the windows of the benchmark items, one search table per window length. A table's
shift entry for a block of words says how far the search may move past a position that no pattern
can end at; a block with shift 0 selects, from the bucket of that suffix, the patterns to compare
word by word.

The tables of a benchmark up to a counted size are broadcast. Those of a larger one would not fit the
workers; there a filter of bounded size, over hashes of whole windows, skips the positions that
cannot match, and the windows to compare are selected by a shuffle join on the hash.

Defined cases: texts are lower-cased over A-Z only and words are runs of digits, a-z and non-ASCII;
a null text has no words; texts are read whole however long; without items nothing is hit; an item without words has no window; an item without id counts, and its id
is written as the empty string; repeated items count once per id; repeated documents are judged
alike. Other columns pass through; where they clash with the new ones, the new ones win.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quellwerk.llm.common import binary, materialise, mix64, small_batches
from quellwerk.llm.jaccard import _PLACE, word_hashes

#: Lower-cases A-Z and turns every byte that is not part of a word into a space. In UTF-8 all bytes
#: of characters beyond ASCII are 0x80 or more, so this treats characters and bytes alike.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class WuManber:
    """Finds every occurrence of word patterns of one length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], tuple[str, ...]], length: int):
        self.length, self.block = length, min(2, length)
        self.far = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], list[tuple[bytes, ...]]] = {}
        self.items = patterns
        for p in patterns:
            for end in range(self.block, length + 1):
                key = p[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.far), length - end)
            self.bucket.setdefault(p[length - self.block :], []).append(p)

    def occurrences(self, words: list[bytes]) -> Iterator[tuple[int, tuple[str, ...]]]:
        """(start, items) of each window found, by rising start."""
        at, n, block, length = self.length, len(words), self.block, self.length
        shift, far = self.shift.get, self.far
        while at <= n:
            key = tuple(words[at - block : at])
            step = shift(key, far)
            if step:
                at += step
                continue
            for p in self.bucket[key]:
                if words[at - length] == p[0] and tuple(words[at - length : at]) == p:
                    yield at - length, self.items[p]
                    break  # patterns are distinct, so one at most is equal
            at += 1


def windows(items: list[tuple[str, bytes]], size: int) -> dict[int, dict[tuple[bytes, ...], tuple[str, ...]]]:
    """Patterns by length: each window's words and the ids of the items that have it."""
    found: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
    for item_id, text in items:
        words = words_of(text)
        for at in range(max(1, len(words) - size + 1) if words else 0):
            w = tuple(words[at : at + size])
            found.setdefault(len(w), {}).setdefault(w, set()).add(item_id)
    return {n: {w: tuple(sorted(ids)) for w, ids in of.items()} for n, of in found.items()}


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


_ADDED = ["n_words", "hit_spans", "hit_items"]


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_SPANS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _plain(df: DataFrame, text_col: str, carry: list[str]) -> tuple[DataFrame, list[str], list[T.StructField]]:
    """df as c0, c1, ... and _text, with the names and fields of the former."""
    names = [f"c{i}" for i in range(len(carry))]
    plain = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(carry, names, strict=True)], F.col(f"`{text_col}`").alias("_text"))
    return plain, names, [T.StructField(n, df.schema[c].dataType) for c, n in zip(carry, names, strict=True)]


def _scan(df: DataFrame, text_col: str, items: list[tuple[str, bytes]], size: int, carry: list[str]) -> DataFrame:
    """The carried columns with _ADDED, by one search per window length over broadcast tables."""
    shared = df.sparkSession.sparkContext.broadcast(windows(items, size))
    plain, names, fields = _plain(df, text_col, carry)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [WuManber(patterns, n) for n, patterns in sorted(shared.value.items())]
        for batch in batches:
            counts, spans, ids = [], [], []
            for text in binary(batch.column("_text")):
                words, hits, found = words_of(text.as_py()), [], set()
                for search in searches:
                    for start, of in search.occurrences(words):
                        hits.append((start, start + search.length))
                        found.update(of)
                counts.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in merged(hits)])
                ids.append(sorted(found))
            new = [pa.array(counts, pa.int64()), pa.array(spans, _SPANS_ARROW), pa.array(ids, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *new], [*names, *_ADDED])

    schema = T.StructType([*fields, T.StructField("n_words", T.LongType()), T.StructField("hit_spans", _SPANS), T.StructField("hit_items", T.ArrayType(T.StringType()))])
    return plain.mapInArrow(scan, schema).toDF(*carry, *_ADDED)


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words, from the hashes of the words."""
    count = max(0, len(words) - n + 1)
    out = np.full(count, n, np.uint64)
    for k in range(n):
        out += words[k : k + count] * _PLACE[k % 64]
    return mix64(out)


def _scan_large(df: DataFrame, text_col: str, items: DataFrame, size: int, carry: list[str]) -> DataFrame:
    """As _scan, for items (i, t) of any size."""
    spark = df.sparkSession

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("i").to_pylist(), binary(batch.column("t")), strict=True):
                words = words_of(text.as_py())
                n = min(size, len(words))
                keys = [b" ".join(words[at : at + n]) for at in range(len(words) - n + 1)] if n else []
                hashes = window_hashes(word_hashes(b" ".join(words)), n).view(np.int64) if n else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), n, np.int32)), pa.array(hashes), pa.array(keys, pa.binary()), pa.array([item] * len(keys), pa.string())], ["n", "h", "key", "item"])

    each = items.mapInArrow(cut, "n int, h long, key binary, item string").distinct()
    patterns = materialise(each.groupBy("n", "h", "key").agg(F.collect_list("item").alias("items")), "windows")
    lengths = sorted(r.n for r in patterns.select("n").distinct().collect())  # at most size
    bits = min(MOST_BITS, max(1 << 20, 1 << (BITS_A_WINDOW * patterns.count()).bit_length()))
    word = patterns.select(F.pmod("h", F.lit(bits)).alias("bit")).groupBy(F.shiftright("bit", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("v")).toArrow()
    marks = np.zeros(bits >> 6, np.int64)
    marks[word.column("w").to_numpy()] = word.column("v").to_numpy()
    marked = spark.sparkContext.broadcast(marks)
    plain, names, fields = _plain(df, text_col, carry)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = marked.value
        for batch in batches:
            counts, found = [], []
            for text in binary(batch.column("_text")):
                words = words_of(text.as_py())
                hashes, rows = word_hashes(b" ".join(words)), []
                for n in lengths:
                    h = window_hashes(hashes, n).view(np.int64)
                    bit = h % bits
                    for at in np.flatnonzero((flags[bit >> 6] >> (bit & 63)) & 1):
                        rows.append({"at": int(at), "n": n, "h": int(h[at]), "key": b" ".join(words[at : at + n])})
                counts.append(len(words))
                found.append(rows)
            kind = pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int32()), ("h", pa.int64()), ("key", pa.binary())]))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(counts, pa.int64()), pa.array(found, kind)], [*names, "n_words", "found"])

    schema = T.StructType([*fields, T.StructField("n_words", T.LongType()), T.StructField("found", T.DataType.fromDDL("array<struct<at long, n int, h long, key binary>>"))])
    # Row numbers join the results back; the written table fixes them.
    rows = materialise(plain.mapInArrow(scan, schema).withColumn("_row", F.monotonically_increasing_id()), "candidates")
    asked = rows.select("_row", F.explode("found").alias("f")).select("_row", "f.*")
    hits = asked.join(patterns.hint("merge"), ["n", "h", "key"])
    spans = hits.groupBy("_row").agg(F.collect_set(F.struct(F.col("at").alias("start"), (F.col("at") + F.col("n")).alias("end"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("hit_items"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            joined = [[{"start": a, "end": b} for a, b in merged([(s["start"], s["end"]) for s in row])] for row in batch.column("spans").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(joined, _SPANS_ARROW), batch.column("hit_items")], ["_row", "hit_spans", "hit_items"])

    by_row = spans.mapInArrow(merge, T.StructType([T.StructField("_row", T.LongType()), T.StructField("hit_spans", _SPANS), T.StructField("hit_items", T.ArrayType(T.StringType()))]))
    out = rows.drop("found").join(by_row, "_row", "left")
    return out.select(*names, "n_words", F.coalesce("hit_spans", F.array().cast(_SPANS)).alias("hit_spans"), F.coalesce("hit_items", F.array().cast("array<string>")).alias("hit_items")).toDF(*carry, *_ADDED)


#: Bytes of item text whose tables are broadcast, and the filter's bits per window of a larger benchmark.
BROADCAST_TEXT, BITS_A_WINDOW, MOST_BITS = 2 << 20, 16, 1 << 30


def annotate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = 10, carry: list[str] | None = None, broadcast_text: int = BROADCAST_TEXT) -> DataFrame:
    """docs with n_words, hit_spans (word offsets, half open), hit_items (sorted ids), n_hit,
    n_items and contaminated.

    One scan over docs, without a shuffle, while the benchmark's counted text is at most
    broadcast_text bytes. carry names the columns of docs to return (all by default)."""
    small_batches(docs.sparkSession)
    new = [*_ADDED, "n_hit", "n_items", "contaminated"]
    keep = [c for c in (docs.columns if carry is None else carry) if c not in new]
    items = benchmark.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(f"`{item_text}`"), F.lit("")).alias("t"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("t") + 64), F.lit(0)).alias("b")).first().b
    if total <= broadcast_text:
        out = _scan(docs, text_col, [(r.i, r.t.encode()) for r in items.collect()], size, keep)
    else:
        out = _scan_large(docs, text_col, items, size, keep)
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select(*[F.col(f"`{c}`") for c in keep], *_ADDED, hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), (F.size("hit_spans") > 0).alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no window of the benchmark, with their own columns."""
    renamed = docs.select(F.struct("*").alias("row"), F.col("text").alias("_probe"))
    found = annotate(renamed, benchmark, text_col="_probe", carry=["row"], **options)
    return found.filter(~F.col("contaminated")).select("row.*")


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    digest = F.sha2(F.array_join("hit_items", ","), 256)
    return annotate(docs, benchmark, carry=["doc_id"]).select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS k
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS r(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM win),
docwin AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM d, lens, unnest(range(1, len(w) - n + 2)) AS r(i)),
found AS (SELECT DISTINCT doc_id, i, docwin.n AS n, item_id FROM docwin JOIN win USING (n, k)),
hits AS (SELECT doc_id, count(DISTINCT p) AS h FROM found, unnest(range(i, i + n)) AS r(p) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS c, string_agg(s, ',' ORDER BY s) AS ids
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h, 0)::BIGINT AS n_hit, coalesce(c, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(h, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
"""
