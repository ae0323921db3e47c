"""Mixing sources to target weights.

The words of each source are packed into blocks of one fixed length. Targets share a budget by weight
and stop at a multiple of their source's size. An output shard has a fixed number of slots, and how
many of them each source gets is one multinomial draw per shard. The draws are settled against the
targets in this way: the chances of a shard are those of the slots that the sources have left, no
source gets more than it has left, and the last shard takes what remains. The slots of a source are
mapped to block numbers through its own pseudorandom permutation, and joined with the blocks by
number; its last slot is cut to the words that its target still lacks.

Defined cases: words are runs of anything but ASCII white space; a null or empty text has size 0
and is taken 0 times; texts are packed whole however long; a null source is a source of its own,
last in order; repeated rows are separate documents, packed one after the other; an empty table
gives an empty mix. Other columns pass through, whatever their names, as only the id, the text and
the source are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quellwerk.llm.common import BROADCAST_BYTES, binary, broadcast_if_small, materialise, mix64, small_batches

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)


def count_words(text):
    """Words of a text column, 0 for null. A word ends where white space or the end follows."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) to which source_rank and target are added.

    Sharing the excess of capped sources by weight until none is above its cap ends at one level
    per unit of weight: sources whose cap lies below level times weight get their cap, the others
    level times weight. Over the sources sorted by cap per weight, that level is the first which
    the next source can hold. The tables here have a row per source."""
    by_code = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("source_rank", F.row_number().over(by_code) - 1)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("_w", F.get(cycle, F.pmod("source_rank", F.lit(len(weights))))).withColumn("_cap", cap * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), "source_rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    ranked = ranked.withColumn("_capped", F.coalesce(F.sum("_cap").over(before), F.lit(0.0))).withColumn("_open", F.sum("_w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    ranked = ranked.withColumn("_level", (share * F.sum("source_size").over(whole) - F.col("_capped")) / F.col("_open"))
    holds = F.col("_level") * F.col("_w") <= F.col("_cap")
    ranked = ranked.withColumn("_final", F.min(F.when(holds, F.struct((F.col("_cap") / F.col("_w")).alias("r"), F.col("source_rank").alias("k"), F.col("_level").alias("level")))).over(whole)["level"])
    target = F.when(F.col("_final").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_final") * F.col("_w")))
    return ranked.select("source", "source_size", "source_rank", target.alias("target"))


def permuted(index: np.ndarray, n: int, seed: int, back: bool = False) -> np.ndarray:
    """A pseudorandom permutation of range(n), or its inverse, at the given places: a Feistel network
    over the next power of four, walked until the value falls below n."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    mixed = lambda x, k: mix64(x + np.uint64((seed * 4 + k) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & mask

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for k in range(4):
            if back:
                left, right = right ^ mixed(left, 3 - k), left
            else:
                left, right = right, left ^ mixed(right, k)
        return (left << half) | right

    out = once(index.astype(np.uint64))
    while (over := out >= np.uint64(n)).any():
        out[over] = once(out[over])
    return out.astype(np.int64)


def _seed(rank: int, seed: int, what: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{seed}/{rank}/{what}".encode()).digest()[:6], "big")


def slots_of(rank: int, size: int, target: float, block_words: int, seed: int) -> tuple[int, int, int]:
    """(blocks, slots, words of the last slot) with which a source meets its target, rounded to words.
    Only a source's last block is short, and where its last pass meets that one is known."""
    blocks = -(-size // block_words)
    passes, rest = divmod(round(target), size) if size else (0, 0)
    if not rest:
        return blocks, passes * blocks, block_words
    lacks = blocks * block_words - size
    place = int(permuted(np.array([blocks - 1]), blocks, _seed(rank, seed, f"pass {passes}"), back=True)[0])
    more = -(-rest // block_words)
    if place < more and more * block_words - lacks < rest:
        more = -(-(rest + lacks) // block_words)
    words = more * block_words - (lacks if place < more else 0)
    own = block_words - (lacks if place == more - 1 else 0)
    return blocks, passes * blocks + more, own - (words - rest)


def shard_counts(slots: np.ndarray, shard_slots: int, seed: int) -> Iterator[np.ndarray]:
    """How many slots each source has in each shard: a multinomial draw per shard, with chances as the
    sources have slots left. What is drawn beyond that is drawn again among the others."""
    left = slots.astype(np.int64).copy()
    rng = np.random.default_rng(_seed(0, seed, "shards"))
    while (total := int(left.sum())) > shard_slots:
        counts = np.zeros(len(left), np.int64)
        while (wanted := shard_slots - int(counts.sum())) > 0:
            open_ = left - counts
            counts = np.minimum(counts + rng.multinomial(wanted, open_ / open_.sum()), left)
        left -= counts
        yield counts
    if total:
        yield left


def draw_slots(sources: DataFrame, shard_slots: int, seed: int, tasks: int) -> DataFrame:
    """(source_rank, shard, slot, block, words): which block fills which place of which shard, and how
    many of its words.

    Slot t of a source takes block perm(t mod blocks) of pass t div blocks; a pass uses each block
    once. The draws need a row per source in one task; it emits the sources that a shard has."""
    ranges = "source_rank int, shard long, first long, slots long, blocks long, all_slots long, last_words long, block_words long"
    kinds = [pa.int32()] + [pa.int64()] * 7
    names = [f.split(" ")[0] for f in ranges.split(", ")]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for batch in batches for r in batch.to_pylist()), key=lambda r: r["source_rank"])
        if not rows:
            return
        used, held = np.zeros(len(rows), np.int64), []
        for shard, counts in enumerate(shard_counts(np.array([r["slots"] for r in rows]), shard_slots, seed)):
            for i in np.flatnonzero(counts):
                r = rows[i]
                held.append((r["source_rank"], shard, int(used[i]), int(counts[i]), r["blocks"], r["slots"], r["last_words"], r["block_words"]))
            used += counts
            if len(held) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names)

    def permute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                slot = np.arange(r["first"], r["first"] + r["slots"], dtype=np.int64)
                turn, place = np.divmod(slot, r["blocks"])
                block = np.empty_like(slot)
                for p in np.unique(turn):
                    own = turn == p
                    block[own] = permuted(place[own], r["blocks"], _seed(r["source_rank"], seed, f"pass {p}"))
                n = len(slot)
                words = np.where(slot == r["all_slots"] - 1, r["last_words"], r["block_words"])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, r["source_rank"], np.int32)), pa.array(np.full(n, r["shard"], np.int64)), pa.array(slot), pa.array(block), pa.array(words)], ["source_rank", "shard", "slot", "block", "words"])

    dealt = sources.select("source_rank", "slots", "blocks", "last_words", "block_words").filter("slots > 0").coalesce(1).mapInArrow(deal, ranges)
    return dealt.repartition(tasks, "source_rank", "first").mapInArrow(permute, "source_rank int, shard long, slot long, block long, words long")


KEY = ("doc_id", "_tie", "_copy")


def with_offsets(sized: DataFrame, buckets: int) -> DataFrame:
    """Adds begin, the words of the source before this document, in order of a hash of the id and the
    text; equal rows stand in any order, as they are alike.

    A source may hold a third of all rows, so the running sum is taken in buckets of the hash: the
    totals of source and bucket are summed first, and each bucket adds up only its own rows."""
    bits = (buckets - 1).bit_length()
    hashed = sized.withColumn("_h", F.xxhash64("doc_id", "_tie")).withColumn("_b", F.shiftrightunsigned("_h", 64 - bits))
    totals = hashed.groupBy("source_rank", "_b").agg(F.sum("size").alias("_t"))
    earlier = Window.partitionBy("source_rank").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("source_rank", "_b", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_s"))
    inner = Window.partitionBy("source_rank", "_b").orderBy("_h", *KEY).rowsBetween(Window.unboundedPreceding, -1)
    begin = F.col("_s") + F.coalesce(F.sum("size").over(inner), F.lit(0))
    return hashed.join(starts, ["source_rank", "_b"]).withColumn("begin", begin).drop("_h", "_b", "_s")


class Mix:
    """A mix of documents: the sources with their targets, and the pieces that the mix takes."""

    def __init__(self, docs: DataFrame, block_words: int = 64, shard_slots: int = 1 << 14, seed: int = 1, share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = WEIGHTS, bucket_rows: int = 50_000):
        """Blocks hold block_words words and shards shard_slots blocks, whatever the source."""
        self.shard_slots, self.seed = shard_slots, seed
        # Row numbers tell repeated rows apart; the written table fixes them.
        rows = docs.select("doc_id", "source", count_words(F.col("text")).alias("size"), F.xxhash64("text").alias("_tie"), F.monotonically_increasing_id().alias("_copy"))
        self.sizes = materialise(rows, "mix-sizes")
        per_source = self.sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        targets = source_targets(per_source, share, cap, weights).withColumn("block_words", F.lit(block_words).cast("long"))

        def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [slots_of(r, n, t, block_words, seed) for r, n, t in zip(*[batch.column(c).to_pylist() for c in ("source_rank", "source_size", "target")], strict=True)]
                columns = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * 3
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "blocks", "slots", "last_words"])

        schema = T.StructType([*targets.schema.fields, *[T.StructField(n, T.LongType()) for n in ("blocks", "slots", "last_words")]])
        self.sources = materialise(targets.mapInArrow(plan, schema), "mix-sources")
        total = self.sources.agg(F.coalesce(F.sum("slots"), F.lit(0)).alias("slots")).first().slots
        self.tasks = max(32, total >> 20)
        self.buckets = 1 << max(6, (self.sizes.count() // bucket_rows).bit_length())

    def documents(self) -> DataFrame:
        """doc_id, _tie and _copy (which tell repeated rows apart), size, and the source's row."""
        sources = broadcast_if_small(self.sources, 200).withColumnRenamed("source", "_source")
        return self.sizes.join(sources, F.col("source").eqNullSafe(F.col("_source"))).drop("source", "_source")

    def pieces(self) -> DataFrame:
        """(doc_id, _tie, _copy, source_rank, block, in_block, from_word, n_words): blocks cut at
        documents."""
        placed = with_offsets(self.documents().filter("size > 0"), self.buckets)
        cut = placed.withColumn("block", F.explode(F.sequence(F.expr("begin div block_words"), F.expr("(begin + size - 1) div block_words"))))
        low = F.greatest(F.col("block") * F.col("block_words"), F.col("begin"))
        high = F.least((F.col("block") + 1) * F.col("block_words"), F.col("begin") + F.col("size"))
        return cut.select(*KEY, "source_rank", "block", (low - F.col("block") * F.col("block_words")).alias("in_block"), (low - F.col("begin")).alias("from_word"), (high - low).alias("n_words"))

    def slots(self) -> DataFrame:
        return draw_slots(self.sources, self.shard_slots, self.seed, self.tasks)

    def placements(self) -> DataFrame:
        """The mix itself: (shard, slot, source_rank, block, doc_id, from_word, n_words)."""
        placed = self.slots().hint("merge").join(self.pieces(), ["source_rank", "block"])
        placed = placed.withColumn("n_words", F.least("n_words", F.col("words") - F.col("in_block"))).filter("n_words > 0")
        return placed.drop("_tie", "_copy", "words", "in_block")

    def taken_pieces(self) -> DataFrame:
        """pieces() that the mix takes, with times, the number of its passes that take them whole, and
        part, the words that one more pass takes of them."""
        whole = F.col("words") == F.col("block_words")
        slots = self.slots().join(F.broadcast(self.sources.select("source_rank", "block_words")) if self.few_sources() else self.sources.select("source_rank", "block_words"), "source_rank")
        uses = slots.groupBy("source_rank", "block").agg(F.count_if(whole).alias("times"), F.coalesce(F.max(F.when(~whole, F.col("words"))), F.lit(0)).alias("_upto"))
        # The planner guesses the slots' size from the few sources; they must not be broadcast.
        joined = self.pieces().join(uses.hint("merge"), ["source_rank", "block"])
        part = F.greatest(F.lit(0), F.least(F.col("n_words"), F.col("_upto") - F.col("in_block")))
        return joined.withColumn("part", part).drop("_upto", "in_block").filter("times > 0 or part > 0")

    def few_sources(self) -> bool:
        return self.sources.count() * 200 <= BROADCAST_BYTES


def mixed_texts(docs: DataFrame, block_words: int = 1024, **options) -> DataFrame:
    """The mix as documents: for each pass that takes of a document, a row with docs' columns whose
    text is the document's runs of taken words, as they stand in it, joined by line ends; a pass
    that takes the whole document leaves its text as it is. n_chars, where present, follows."""
    mix = Mix(docs, block_words=block_words, **options)
    runs = mix.taken_pieces().groupBy(*KEY).agg(F.collect_list(F.struct("from_word", "n_words", "times", "part")).alias("_pieces")).select(F.col("doc_id").alias("_id"), F.col("_tie").alias("_t"), "_pieces")
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_key"), F.xxhash64("text").alias("_tie"), F.col("text").alias("_text"))
    repeated = mix.sizes.groupBy("doc_id", "_tie").count().filter("count > 1")
    if not repeated.isEmpty():  # one row stands for its repetitions, of which each has its own pieces
        rows = rows.groupBy("_key", "_tie").agg(F.min_by(F.struct("_row", "_text"), F.xxhash64("_row")).alias("_r")).select("_r._row", "_key", "_tie", "_r._text")
    joined = rows.join(runs, F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_tie") == F.col("_t")))
    plain = joined.select(*[F.col(f"_row.`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)], "_text", "_pieces")
    names, schema = plain.columns[:-2], plain.drop("_text", "_pieces").schema
    text_at, chars_at = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source_rows, texts = [], []
            pieces = batch.column("_pieces")
            for i, text in enumerate(binary(batch.column("_text"))):
                for out in _runs(text.as_py(), pieces[i].as_py()):
                    source_rows.append(i)
                    texts.append(out.decode())
            taken = batch.take(pa.array(source_rows, pa.int64()))
            columns = [taken.column(n) for n in names]
            columns[text_at] = pa.array(texts, columns[text_at].type)
            if chars_at is not None:
                columns[chars_at] = pa.array([len(t) for t in texts], pa.int64()).cast(columns[chars_at].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    small_batches(docs.sparkSession)
    return plain.mapInArrow(cut, schema).toDF(*docs.columns)


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _runs(text: bytes, pieces: list[dict]) -> Iterator[bytes]:
    """The text of every pass that takes some of it."""
    gap = np.concatenate(([True], _SPACE[np.frombuffer(text, np.uint8)], [True]))
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edges[::2], edges[1::2]
    own = sorted((p["from_word"], p["n_words"], p["times"], p["part"]) for p in pieces)
    for turn in range(1, max(p[2] + (p[3] > 0) for p in own) + 1):
        spans: list[list[int]] = []
        for at, n, times, part in own:
            n = n if turn <= times else part if turn == times + 1 else 0
            if n and spans and spans[-1][1] == at:
                spans[-1][1] = at + n
            elif n:
                spans.append([at, at + n])
        if spans == [[0, len(starts)]]:
            yield text
        elif spans:
            yield b"\n".join(text[starts[a] : ends[b - 1]] for a, b in spans)


def query(docs: DataFrame) -> DataFrame:
    """Per document: its size, its source's size and target, and the words the mix takes of it."""
    mix = Mix(docs)
    taken = mix.taken_pieces().groupBy(*KEY).agg(F.sum(F.col("times") * F.col("n_words") + F.col("part")).alias("_taken"))
    documents = mix.documents()
    out = documents.join(taken.select(F.col("doc_id").alias("_id"), F.col("_tie").alias("_t"), F.col("_copy").alias("_c"), "_taken"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_tie") == F.col("_t")) & (F.col("_copy") == F.col("_c")), "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"))
