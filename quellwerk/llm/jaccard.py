"""N-gram Jaccard join by vertical partitioning.

A document is the set of its distinct word shingles as 64-bit hashes. The shingles have one global
order, from rare to frequent. The order is cut into fragments; the overlap of two documents is
counted in each fragment separately and summed per pair.

Pairs to count come from prefixes: two sets of the wanted similarity share one of their rarest
shingles. Documents of equal sets are one class and are compared once. In a first round every
class of a shingle's list is compared with one of the list only, the one with fewest shingles that
no other class has, which lies in the midst of a group of copies; what that links is contracted. A second round compares what is left: classes of one list that are not connected yet.
As 1 - Jaccard is a metric, the two similarities to the common class rule out most of those pairs
without counting; the others are all counted, so no link between components is lost, and lists of
thousands of copies never become all their pairs. A pair is counted only if its prefixes, a little
longer than they need be, share several shingles: sharing one is often chance. The places of shared
shingles bound the overlap too, and so do the shingles before them that no other prefix holds: a
linked set would hold such a shingle in its prefix, if at all. Last, the second round compares parity
sketches of the whole sets, of fixed size: every shingle flips one bit, so two sketches differ in no
more bits than the sets do in shingles. That rules out copies that differ a little too much.

What belongs to a list is found per part of it: a shingle whose counter is far above the mean has its
list dealt to several parts, by the class, and the parts' results are put together. So no task
meets a whole long list; in the second round one side of it meets all parts of the other, each in
a task of its own.

Defined cases: words are runs of anything but ASCII white space, lower-cased over A-Z only; fewer
words than a shingle are one shingle; without words, or with a null text, a document has an empty
set and links with nothing; rows of one id are one document; a document without id gets its links,
and its component is the smallest id in it, or null; ties cannot occur (the measure is an exact
fraction); texts are read whole however long; an empty table gives no rows. Sets are told apart by
128-bit fingerprints, of which 64 name the class. Other columns pass through removal untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quellwerk.llm.common import array_rows, binary, broadcast_if_small, materialise, mix64, small_batches, summed, temporary
from quellwerk.llm.components import components

#: Counters of the frequency sketch. Their number bounds memory and the broadcast; collisions only
#: make the order less apt, never wrong.
CELLS = 1 << 18
#: A list has a part for every so many occurrences of its counter, or every so many times the mean of
#: all counters; in the second round it has at most MOST_PARTS.
PART, PART_MEANS, MOST_PARTS = 1000, 4, 64
#: Bits of the map of wanted classes per class, and its largest size.
BITS_A_CLASS, MOST_BITS = 16, 1 << 30
FRAGMENTS = 8
#: A prefix is this much longer than it need be to share one shingle; in return pairs to be counted
#: must share that many more. Both follow from the similarity, so no link is lost.
SHARED = 6
#: Bits of a parity sketch. More tell longer sets apart; fewer only rule out less.
SKETCH = 512
_ODD = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
#: Of each byte: whether it is part of a word, and its value in a hash (A-Z as a-z, spaces 0).
_INSIDE = np.ones(256, bool)
_INSIDE[[32, *range(9, 14)]] = False
_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_VALUE[65:91] = _VALUE[97:123]
_VALUE[~_INSIDE] = 0
#: Multipliers of the words of a shingle by their places.
_PLACE = mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.concatenate((np.ones(1, np.uint64), np.multiply.accumulate(np.full(n - 1, base, np.uint64))))


_PIECE = 1 << 17
_MASK = (1 << 64) - 1
_UP, _DOWN = _powers(_ODD, _PIECE + 1), _powers(_INVERSE, _PIECE + 1)


def _hashes(raw: np.ndarray) -> np.ndarray:
    """A polynomial hash of each word: differences of one running sum, moved to the word's start."""
    inside = np.empty(len(raw) + 2, bool)
    inside[0] = inside[-1] = False
    _INSIDE.take(raw, out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    running = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUE[raw] * _UP[: len(raw)], out=running[1:])
    return (running[ends] - running[starts]) * _DOWN[starts] + (ends - starts).astype(np.uint64)


def _long_word(raw: np.ndarray, at: int) -> tuple[int, int]:
    """The hash that _hashes would give of the word at this place, from its parts, and its end."""
    total, power, end = 0, 1, at
    while end < len(raw):
        part = raw[end : end + _PIECE]
        gaps = np.flatnonzero(~_INSIDE[part])
        n = int(gaps[0]) if len(gaps) else len(part)
        if n:
            total += (int(_hashes(part[:n])[0]) - n) * power
            power = power * int(_UP[_PIECE]) & _MASK
            end += n
        if len(gaps):
            break
    return (total + end - at) & _MASK, end


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word. Long texts go in pieces that end between words; a word that
    fills a piece is hashed from its parts, to the same value as elsewhere."""
    raw = np.frombuffer(text, np.uint8)
    if len(raw) <= _PIECE:
        return mix64(_hashes(raw))
    out, at = [], 0
    while at < len(raw):
        end = min(at + _PIECE, len(raw))
        if end < len(raw):
            gaps = np.flatnonzero(~_INSIDE[raw[at:end]])
            end = at + int(gaps[-1]) + 1 if len(gaps) else at
        if end == at:  # one word fills the piece
            found, end = _long_word(raw, at)
            out.append(np.array([found], np.uint64))
        else:
            out.append(_hashes(raw[at:end]))
        at = end
    return mix64(np.concatenate(out))


def shingles(text: bytes, size: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = word_hashes(text)
    if not len(words):
        return words
    width = min(size, len(words))
    n = len(words) - width + 1
    out = words[:n] * _PLACE[0]
    for k in range(1, width):
        out += words[k : k + n] * _PLACE[k % 64]
    out = mix64(out + np.uint64(width))
    out.sort()
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(out[1:], out[:-1], out=new[1:])
    return out[new]


def fingerprints(own: np.ndarray) -> tuple[int, int]:
    """Two that tell sets apart: sums of mixed members, mixed with their number."""
    n = np.uint64(len(own))
    sums = np.array([np.add.reduce(mix64(own ^ _ODD)) + n, np.add.reduce(mix64(own * _ODD + np.uint64(1))) ^ n], np.uint64)
    return tuple(mix64(sums).view(np.int64).tolist())


class Order:
    """The global order of shingles by the counters of their cells, the parts of their lists, and the
    names of classes."""

    def __init__(self, counts: np.ndarray, clashes: frozenset[int] = frozenset()):
        self.counts, self.clashes = counts, clashes
        # Ranks instead of counts, so that no count is too large for the order.
        self.rank = np.unique(counts, return_inverse=True)[1].astype(np.uint64)
        self.parts = np.maximum(1, np.ceil(counts / max(PART, PART_MEANS * counts.mean()))).astype(np.int64)

    def keys(self, own: np.ndarray) -> np.ndarray:
        """Places in the order, rare shingles first; equal ranks keep the order of the hash."""
        return (self.rank[cells_of(own)] << np.uint64(40)) | (own >> np.uint64(24))

    def pivots(self) -> np.ndarray:
        """Cuts the order into FRAGMENTS parts that hold about as many shingle occurrences."""
        ranked = np.sort(self.rank)
        mass = np.cumsum(np.sort(self.counts.astype(np.float64)))
        wanted = mass[-1] * np.arange(1, FRAGMENTS) / FRAGMENTS
        value = ranked[np.minimum(np.searchsorted(mass, wanted), len(ranked) - 1)]
        low, high = np.searchsorted(ranked, value, "left"), np.searchsorted(ranked, value, "right")
        before = np.where(low > 0, mass[np.maximum(low, 1) - 1], 0)
        share = np.clip((wanted - before) / np.maximum(mass[np.minimum(high, len(mass)) - 1] - before, 1), 0, 1)
        return (value << np.uint64(40)) + (share * ((1 << 40) - 1)).astype(np.uint64)

    def name(self, own: np.ndarray) -> int:
        """The class of a set: its first fingerprint, or the second where different sets share that."""
        first, second = fingerprints(own)
        return second if first in self.clashes else first


def cells_of(own: np.ndarray) -> np.ndarray:
    return (own & np.uint64(CELLS - 1)).astype(np.int64)


def sketch(own: np.ndarray) -> np.ndarray:
    """The parity, for each of SKETCH cells, of the number of members that fall into it."""
    cell = ((own >> np.uint64(18)) & np.uint64(SKETCH - 1)).astype(np.int64)
    return np.packbits(np.bincount(cell, minlength=SKETCH).astype(np.uint8) & 1).view(np.int64)


def _as_long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def survey(docs: DataFrame, size: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, Order]:
    """One pass over the texts. The documents as (doc_id, cid, n), cid being null if the set is empty;
    the classes as (cid, least, sketch), the smallest id and the parity sketch; and the order."""
    plain = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = pa.int64() if dict(plain.dtypes)["doc_id"] == "bigint" else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int64)
        for batch in batches:
            sets = [shingles(text.as_py(), size) for text in binary(batch.column("text"))]
            cells += np.bincount(cells_of(np.concatenate(sets)), minlength=CELLS) if sets else 0
            n = batch.num_rows
            words = SKETCH // 64
            sketches = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * words, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *map(sketch, sets)])))
            prints = [fingerprints(s) if len(s) else (None, None) for s in sets]
            first, second = (pa.array([p[i] for p in prints], pa.int64()) for i in range(2))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), first, second, pa.array([len(s) for s in sets], pa.int64()), sketches, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
        chunk, values = array_rows(cells, np.uint32)
        n = len(chunk)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, kind), *[pa.nulls(n, pa.int64()) for _ in range(3)], pa.nulls(n, pa.list_(pa.int64())), pa.array(chunk, pa.int32()), pa.array(values, pa.binary())], names)

    names = ["doc_id", "cid", "other", "n", "sketch", "chunk", "cells"]
    both = materialise(plain.mapInArrow(read, "doc_id long, cid long, other long, n long, sketch array<long>, chunk int, cells binary"), "sets")
    counts = summed(both.filter("chunk is not null"), CELLS, np.uint32)
    rows = both.filter("chunk is null")
    classes = rows.filter("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("least"), F.first("sketch").alias("sketch"), F.min("other").alias("other"), F.max("other").alias("_last"))
    classes = materialise(classes, "classes")
    # Of n sets about n * n / 2 ** 65 share a fingerprint: none or a handful, at any size there is.
    clashes = frozenset(r.cid for r in classes.filter("other <> _last").select("cid").collect())
    if clashes:
        rows = rows.withColumn("cid", F.when(F.col("cid").isin(*clashes), F.col("other")).otherwise(F.col("cid")))
        classes = rows.filter("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("least"), F.first("sketch").alias("sketch"))
    return rows.select("doc_id", "cid", "n"), classes.select("cid", "least", "sketch"), Order(counts, clashes)


def postings(docs: DataFrame, size: int, num: int, den: int, text_col: str, shared) -> DataFrame:
    """(h, s, k, cid, size_at): the prefix of every class: the shingle, the part of its list and their
    number, and in size_at the size of the set in the upper and the shingle's place in the order of
    the set in the lower half. A task emits a class once, so copies add little."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = shared.value, set()
        for batch in batches:
            heads, ids, sizes = [], [], []
            for text in binary(batch.column(0)):
                own = shingles(text.as_py(), size)
                if not len(own) or (cid := order.name(own)) in seen:
                    continue
                seen.add(cid)
                least = -(-num * len(own) // den)
                length = len(own) - least + min(SHARED, least)
                heads.append(own[np.argsort(order.keys(own), kind="stable")[:length]])
                ids.append(cid)
                sizes.append(len(own))
            if heads:
                each = [len(x) for x in heads]
                place = np.concatenate([np.arange(k) for k in each])
                h = np.concatenate(heads)
                k = order.parts[cells_of(h)]
                cids = np.repeat(np.array(ids, np.int64), each)
                yield pa.RecordBatch.from_arrays([_as_long(h), pa.array((cids % k).astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(cids), pa.array((np.repeat(np.array(sizes, np.int64), each) << 32) | place)], ["h", "s", "k", "cid", "size_at"])

    return docs.select(F.col(f"`{text_col}`")).mapInArrow(emit, "h long, s int, k int, cid long, size_at long")


def put_together(parts: DataFrame, low: list[str], high: list[str] | None = None) -> DataFrame:
    """parts, whose columns low and high hold a minimum and a maximum of each part of a list, with those
    of the whole list. Lists of one part stay as they are."""
    several = parts.filter("k > 1")
    whole = several.groupBy("h", "k").agg(*[F.min(c).alias(c) for c in low], *[F.max(c).alias(c) for c in high or []])
    whole = whole.select("h", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("s"), *low, *(high or []))
    joined = several.drop(*low, *(high or [])).join(whole, ["h", "s"])
    return parts.filter("k = 1").unionByName(joined.select(*parts.columns))


def segments(docs: DataFrame, pairs: DataFrame, size: int, text_col: str, shared) -> DataFrame:
    """(cid, f, hs): the sets of the classes in pairs, cut into fragments of the global order.

    Which classes are wanted reaches the tasks as a bit map, of a size that follows from their number
    and is bounded. Its false hits are rows too many, which the join with the pairs leaves out."""
    bits = min(MOST_BITS, max(1 << 20, 1 << (2 * pairs.count() * BITS_A_CLASS).bit_length()))
    word = pairs.select(F.explode(F.array("a", "b")).alias("cid")).select(F.pmod("cid", F.lit(bits)).alias("bit")).groupBy(F.shiftright("bit", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("v")).toArrow()
    marks = np.zeros(bits >> 6, np.int64)
    marks[word.column("w").to_numpy()] = word.column("v").to_numpy()
    marked = docs.sparkSession.sparkContext.broadcast(marks)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen, flags = shared.value, set(), marked.value
        cuts = order.pivots()
        for batch in batches:
            cids, parts, members = [], [], []
            for text in binary(batch.column(0)):
                own = shingles(text.as_py(), size)
                if not len(own) or (cid := order.name(own)) in seen:
                    continue
                bit = cid % bits
                if not (int(flags[bit >> 6]) >> (bit & 63)) & 1:
                    continue
                seen.add(cid)
                part = np.searchsorted(cuts, order.keys(own), "right")
                for f in np.unique(part):
                    cids.append(cid)
                    parts.append(int(f))
                    members.append(own[part == f].view(np.int64))
            if cids:
                ends = np.cumsum([0, *map(len, members)])
                hs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(members)))
                yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(parts, pa.int32()), hs], ["cid", "f", "hs"])

    rows = docs.select(F.col(f"`{text_col}`")).mapInArrow(emit, "cid long, f int, hs array<long>")
    return materialise(rows.groupBy("cid", "f").agg(F.first("hs").alias("hs")), "segments")


def overlaps(pairs: DataFrame, cut: DataFrame) -> DataFrame:
    """pairs (a, b, na, nb) with inter: the overlaps counted fragment by fragment, and summed."""
    left = pairs.join(cut.select(F.col("cid").alias("a"), "f", F.col("hs").alias("ha")).hint("merge"), "a")
    both = left.join(cut.select(F.col("cid").alias("b"), "f", F.col("hs").alias("hb")).hint("merge"), ["b", "f"])
    partial = both.select("a", "b", "na", "nb", F.size(F.array_intersect("ha", "hb")).alias("c"))
    return partial.groupBy("a", "b", "na", "nb").agg(F.sum("c").alias("inter"))


def _size_at(packed: str, size: str, at: str) -> list:
    return [F.shiftright(packed, 32).alias(size), F.col(packed).bitwiseAND((1 << 32) - 1).alias(at)]


def _paired(x, nx, y, ny):
    """Columns a < b of a pair, with their sizes."""
    first = x < y
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), F.when(first, nx).otherwise(ny).alias("na"), F.when(first, ny).otherwise(nx).alias("nb")]


def jaccard_components(docs: DataFrame, size: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of docs; sets link when Jaccard >= num / den."""
    spark = docs.sparkSession
    small_batches(spark)
    rows, classes, order = survey(docs, size, id_col, text_col)
    shared, of_part = spark.sparkContext.broadcast(order), Window.partitionBy("h", "s")
    lists = postings(docs, size, num, den, text_col, shared).withColumn("_low", F.min("cid").over(of_part)).withColumn("_high", F.max("cid").over(of_part))
    every = materialise(lists.filter("k > 1 or _low <> _high"), "lists")
    lists = put_together(every, ["_low"], ["_high"])
    lists = lists.filter("_low <> _high").select("h", "s", "k", "cid", *_size_at("size_at", "n", "at")).dropDuplicates(["h", "s", "cid"])
    # Places of a prefix that are in no list hold shingles of that class alone.
    of_class = Window.partitionBy("cid")
    lists = lists.withColumn("lone", F.col("at") - F.row_number().over(of_class.orderBy("at")) + 1).withColumn("_odd", F.max("lone").over(of_class))
    lists = lists.filter(F.col("lone") <= F.col("n") - F.ceil(num * F.col("n") / den - 1e-9))
    lists = lists.withColumn("_lead", F.min(F.struct("_odd", "cid", "n", "at", "lone")).over(of_part)).drop("_odd")
    with temporary(spark, every):
        lists = materialise(lists, "postings", outlive=1)
    lists = put_together(lists, ["_lead"])
    lists = lists.select("h", "s", "k", "cid", "n", "at", "lone", F.col("_lead.cid").alias("lead"), *[F.col(f"_lead.{c}").alias(f"lead_{c}") for c in ("n", "at", "lone")])

    def alike(n, at, lone, m, at_m, lone_m):
        """Whether a shingle can be one of the first SHARED that two sets of these sizes share, at
        these places, if the sets link: the places, or the lone shingles before them, leave too
        little overlap otherwise."""
        overlap = F.ceil(num * (n + m) / (num + den) - 1e-9)
        placed = (at <= n - overlap + SHARED - 1) & (at_m <= m - overlap + SHARED - 1)
        return (den * F.least(n, m) >= num * F.greatest(n, m)) & placed & (lone <= n - overlap) & (lone_m <= m - overlap)

    common = lambda n, m: F.least(F.lit(SHARED), F.ceil(num * F.least(n, m) / den))
    stars = lists.filter("cid <> lead").filter(alike(*map(F.col, ("n", "at", "lone", "lead_n", "lead_at", "lead_lone"))))
    stars = stars.groupBy(*_paired(F.col("cid"), F.col("n"), F.col("lead"), F.col("lead_n"))).count()
    stars = materialise(stars.filter(F.col("count") >= common(F.col("na"), F.col("nb"))).drop("count"), "pairs")
    linked = lambda t: t.filter(den * F.col("inter") >= num * (F.col("na") + F.col("nb") - F.col("inter")))
    edge = lambda t: linked(t).select(F.col("a").alias("u"), F.col("b").alias("v"))

    def count(pairs: DataFrame) -> DataFrame:
        with temporary(spark):
            return materialise(overlaps(pairs, segments(docs, pairs, size, text_col, shared)), "overlaps", outlive=1)

    first = count(stars)
    groups = materialise(components(edge(first)), "components")

    rest = _open_pairs(lists, first, groups, classes.select("cid", "sketch"), num, den, alike)
    rest = materialise(rest.filter(F.col("count") >= common(F.col("na"), F.col("nb"))).drop("count"), "pairs")
    if not rest.isEmpty():
        second = edge(count(rest))
        if not second.isEmpty():
            groups = components(edge(first).unionByName(second))
    named = classes.select("cid", "least").join(groups.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_class = named.join(smallest, "component").select("cid", "component_id")
    out = rows.join(by_class, "cid", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _open_pairs(lists: DataFrame, first: DataFrame, groups: DataFrame, sketches: DataFrame, num: int, den: int, alike) -> DataFrame:
    """Pairs that are not connected yet, with the count of the lists they share, as far as their
    distances to the list's leading class or their sketches do not rule them out there. A distance
    that was not counted lies between the bound that the sizes give and 1."""
    near = first.select("a", "b", (1 - F.col("inter") / (F.col("na") + F.col("nb") - F.col("inter"))).alias("d"))
    of_part = Window.partitionBy("h", "s")
    open_ = lists.join(groups.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    open_ = open_.withColumn("_lo", F.min("component").over(of_part)).withColumn("_hi", F.max("component").over(of_part)).filter("k > 1 or _lo <> _hi")
    open_ = open_.withColumn("a", F.least("cid", "lead")).withColumn("b", F.greatest("cid", "lead")).join(near, ["a", "b"], "left").drop("a", "b")
    bound = 1 - F.least("n", "lead_n") / F.greatest("n", "lead_n")
    open_ = open_.join(sketches, "cid")
    open_ = materialise(open_.select("h", "s", "k", "cid", "n", "at", "lone", "sketch", "component", "_lo", "_hi", F.coalesce("d", bound).alias("lo"), F.when(F.col("cid") == F.col("lead"), 0.0).otherwise(F.coalesce("d", F.lit(1.0))).alias("hi")), "open")
    long = put_together(open_.filter("k > 1"), ["_lo"], ["_hi"]).filter("_lo <> _hi").withColumn("k", F.least("k", F.lit(MOST_PARTS)))
    long = materialise(long.drop("s", "_lo", "_hi"), "open-long")
    c = F.col
    slack = 1 - num / den + 1e-9
    total = c("x.n") + c("y.n")
    apart = sum((F.bit_count(c("x.sketch")[i].bitwiseXOR(c("y.sketch")[i])) for i in range(SKETCH // 64)), F.lit(0))
    near_enough = apart <= total - 2 * F.ceil(num * total / (num + den) - 1e-9)
    keep = (c("x.cid") < c("y.cid")) & (c("x.component") != c("y.component")) & alike(*[c(f"{t}.{k}") for t in "xy" for k in ("n", "at", "lone")]) & (c("x.lo") - c("y.hi") <= slack) & (c("y.lo") - c("x.hi") <= slack) & near_enough
    of = lambda joined: joined.select(c("x.cid").alias("a"), c("y.cid").alias("b"), c("x.n").alias("na"), c("y.n").alias("nb"))
    short = open_.filter("k = 1")
    pairs = of(short.alias("x").join(short.alias("y"), (c("x.h") == c("y.h")) & keep))
    # One side of a long list is dealt to parts, the other meets every part.
    x = long.withColumn("part", F.pmod(F.xxhash64("cid"), F.col("k")).cast("int")).alias("x")
    y = long.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).alias("y")
    pairs = pairs.unionByName(of(x.join(y, (c("x.h") == c("y.h")) & (c("x.part") == c("y.part")) & keep))).groupBy("a", "b", "na", "nb").count()
    return pairs.join(first.select("a", "b"), ["a", "b"], "left_anti")


def remove_near_duplicates(docs: DataFrame, size: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """docs with one document of each group, the one of the smallest id; rows without id stay, and of
    rows that repeat an id one stays, chosen by a hash of the row. The columns are those of docs,
    whatever their names. The ids that go are broadcast if their counted size allows, else joined
    by shuffle."""
    with temporary(docs.sparkSession):
        found = materialise(jaccard_components(docs, size, num, den), "duplicates", outlive=1)
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"))
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("id")).distinct()
    kept = whole.join(broadcast_if_small(gone, 16), "id", "left_anti")
    again = found.filter("doc_id is not null").groupBy(F.col("doc_id").alias("id")).count().filter("count > 1").select("id")
    if again.isEmpty():
        return kept.select("row.*")
    again = broadcast_if_small(again, 16)
    once = kept.join(again, "id", "left_anti").select("row")
    one = kept.join(again, "id", "left_semi").groupBy("id").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return once.unionByName(one.select("row")).select("row.*")


def query(docs: DataFrame) -> DataFrame:
    return jaccard_components(docs, size=3, num=90, den=100)
