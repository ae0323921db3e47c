"""Approximate nearest neighbours: NN-descent and greedy graph search.

Equal vectors are one node, known by its smallest ids. A graph that joins every node with its
nearest in random-projection blocks, and in blocks dealt by chance, is refined in rounds: each round
joins neighbours of neighbours and keeps the closer ones. The graph is built on vectors of one byte a
component, which are what the rounds move; they decide which edges there are, not what is returned.
A query walks the graph from its own node on the full vectors: in each round the nodes of its beam
that were not looked at yet bring in their neighbours, until nothing closer comes.

Defined cases: vectors that are null, empty, all zero or hold a null or a component that is not
finite take no part, nor do rows without id, nor vectors of another length than most have (the
longer of two as frequent); vectors may be of any length; equal vectors tie and are ordered by id; a repeated id with the same vector is one candidate; with fewer candidates than
wanted, all are returned; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quellwerk.llm.common import ARRAY_SCHEMA, array_batch, broadcast_if_small, materialise, small_batches, summed, temporary

#: Neighbours a node keeps, and the most neighbours that one local join takes at a time.
DEGREE, GATHER = 24, 80
ROUNDS, BLOCK, TREES, BEAM = 8, 160, 4, 192
#: Further bits by which a sign pattern that too many nodes share is cut.
MORE_BITS = 24
#: The most rows of the broadcast table of nodes whose links are dealt to several local joins.
MOST_HUBS = 1 << 20
#: Nodes whose rounded score comes so near to the last one wanted are ranked by the exact one.
CLOSE = 1e-5


def usable(vector: Column) -> Column:
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1. Scaling first by the largest component keeps squares finite."""
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def _bytes(vectors: list) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), np.float32)


def _codes(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors as bytes."""
    return np.rint(vectors * (127 / np.abs(vectors).max(1, keepdims=True))).astype(np.int8)


def _decoded(codes: list, n: int) -> np.ndarray:
    x = np.frombuffer(b"".join(codes), np.int8).reshape(n, -1).astype(np.float32)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def nodes_of(rows: DataFrame, id_col: str, vector_col: str, copies: int) -> tuple[DataFrame, DataFrame]:
    """(node, vec, code): the distinct vectors, named by their smallest id, as unit float32 bytes and with
    one byte a component; and (node, member, original): the copies smallest ids of each, with the vector as it was.

    The smallest ids are found per salt first, so that a third of all rows may be one vector."""
    sound = rows.select(F.col(f"`{id_col}`").cast("long").alias("member"), F.col(f"`{vector_col}`").cast("array<double>").alias("original")).filter(F.col("member").isNotNull() & usable(F.col("original")))
    lengths = sound.groupBy(F.size("original").alias("n")).count().orderBy(F.col("count").desc(), F.col("n").desc()).first()
    if lengths:
        sound = sound.filter(F.size("original") == lengths.n)
    key = sound.withColumn("_k", F.xxhash64("original")).withColumn("_k2", F.xxhash64(F.lit(1), "original"))
    salted = Window.partitionBy("_k", "_k2", F.pmod(F.xxhash64("member"), F.lit(64))).orderBy("member")
    whole = Window.partitionBy("_k", "_k2").orderBy("member")
    few = key.dropDuplicates(["member", "_k", "_k2"]).withColumn("_r", F.row_number().over(salted)).filter(F.col("_r") <= copies)
    few = few.withColumn("_r", F.row_number().over(whole)).filter(F.col("_r") <= copies).withColumn("node", F.min("member").over(Window.partitionBy("_k", "_k2")))
    members = materialise(few.select("node", "member", "original", "_r"), "members")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = _unit(np.array(batch.column("original").to_pylist(), np.float64)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([v.tobytes() for v in vectors], pa.binary()), pa.array([c.tobytes() for c in _codes(vectors)], pa.binary())], ["node", "vec", "code"])

    return materialise(members.filter("_r = 1").select("node", "original").mapInArrow(pack, "node long, vec binary, code binary"), "nodes"), members.drop("_r")


def _mean(nodes: DataFrame) -> np.ndarray:
    """The mean of the coded vectors: a sum of fixed size per partition."""
    first = nodes.select("code").first()
    width = len(first.code) if first else 1

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width + 1)
        for batch in batches:
            if batch.num_rows:
                total[:-1] += _decoded(batch.column("code").to_pylist(), batch.num_rows).sum(0)
                total[-1] += batch.num_rows
        yield array_batch(total)

    total = summed(nodes.select("code").mapInArrow(add, ARRAY_SCHEMA), width + 1)
    return (total[:-1] / max(total[-1], 1)).astype(np.float32)


def _blocks(nodes: DataFrame, tree: int, count: int, mean: np.ndarray) -> DataFrame:
    """(node, near, score): the nearest within blocks of about BLOCK nodes. A block is a sign pattern of
    random projections of the vectors around their mean; one that many nodes share is cut on further
    bits, and what is still too large into even pieces along one more projection.

    The last tree deals its blocks by chance, so that nodes that are alone in their sign patterns,
    as outliers may be in all trees, start with neighbours too."""
    bits = max(0, (max(count // BLOCK, 1) - 1).bit_length())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _decoded(batch.column("code").to_pylist(), batch.num_rows) - mean
                p = x @ np.random.default_rng(1000 + tree).normal(size=(x.shape[1], bits + MORE_BITS + 1)).astype(np.float32)
                signs = p[:, :-1] > 0
                pattern = (signs[:, :bits] << np.arange(bits)).sum(1).astype(np.int64) if bits else np.zeros(len(x), np.int64)
                more = (signs[:, bits:] << np.arange(MORE_BITS)).sum(1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("code"), pa.array(pattern), pa.array(more), pa.array(p[:, -1].astype(np.float64))], ["node", "code", "pattern", "more", "along"])

    if tree == TREES:
        coded = nodes.select("node", "code", F.pmod(F.xxhash64(F.lit(1000 + tree), "node"), F.lit(1 << bits)).alias("pattern"), F.pmod(F.xxhash64(F.lit(2000 + tree), "node"), F.lit(1 << MORE_BITS)).alias("more"), F.lit(0.0).alias("along"))
    else:
        coded = nodes.select("node", "code").mapInArrow(project, "node long, code binary, pattern long, more long, along double")
    full = coded.groupBy("pattern").count().filter(F.col("count") > 2 * BLOCK)
    spread = F.least(F.lit(MORE_BITS), F.ceil(F.log2(F.col("count") / BLOCK))).cast("int")
    # Patterns that are too full number at most count / (2 * BLOCK).
    coded = coded.join(broadcast_if_small(full.select("pattern", F.expr("cast(1 as long)").alias("_one"), spread.alias("_bits")), 24), "pattern", "left")
    coded = coded.withColumn("more", F.when(F.col("_bits").isNotNull(), F.col("more") % F.call_function("shiftleft", F.col("_one"), F.col("_bits"))).otherwise(0))
    at = Window.partitionBy("pattern", "more").orderBy("along", "node")
    size = F.count(F.lit(1)).over(Window.partitionBy("pattern", "more"))
    pieces = coded.withColumn("piece", F.floor((F.row_number().over(at) - 1) * F.ceil(size / (2 * BLOCK)) / size))
    groups = pieces.groupBy("pattern", "more", "piece").agg(F.collect_list(F.struct("node", "code")).alias("rows"))
    return groups.select("rows").mapInArrow(_join_all, "node long, near long, score float")


def _join_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node's DEGREE nearest among the nodes of its row."""
    for batch in batches:
        out = []
        for rows in batch.column("rows"):
            values = rows.values
            ids = values.field("node").to_numpy(zero_copy_only=False)
            x = _decoded(values.field("code").to_pylist(), len(ids))
            s = x @ x.T
            np.fill_diagonal(s, -2)
            k = min(DEGREE, len(ids) - 1)
            if k:
                top = np.argpartition(-s, k - 1, 1)[:, :k]
                out.append((np.repeat(ids, k), ids[top].ravel(), np.take_along_axis(s, top, 1).ravel()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["node", "near", "score"])


def _keep(edges: DataFrame) -> DataFrame:
    """The DEGREE best distinct neighbours of each node. A node's candidates are bounded by what
    the local joins emit for it."""
    distinct = edges.repartition("node").groupBy("node", "near").agg(F.max("score").alias("score"), F.min("fresh").alias("fresh"))
    best = Window.partitionBy("node").orderBy(F.col("score").desc(), "near")
    return distinct.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= DEGREE).drop("_r")


def _local_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the neighbours of a node, the pairs with a new member that are closer than the worst
    neighbour that their first member has."""
    for batch in batches:
        out = []
        for rows in batch.column("rows"):
            values = rows.values
            ids = values.field("near").to_numpy(zero_copy_only=False)
            if len(ids) < 2:
                continue
            fresh = values.field("fresh").to_numpy(zero_copy_only=False).astype(bool)
            worst = values.field("worst").to_numpy(zero_copy_only=False)
            x = _decoded(values.field("code").to_pylist(), len(ids))
            s = x @ x.T
            use = (fresh[:, None] | fresh[None, :]) & (ids[:, None] != ids[None, :]) & (s > worst[:, None])
            a, b = np.nonzero(use)
            if len(a):
                out.append((ids[a], ids[b], s[a, b]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["node", "near", "score"])


def _dealt(links: DataFrame) -> DataFrame:
    """links (node, near, fresh) with part: the links of a node are dealt to local joins of about GATHER
    rows, and none is dropped. Nodes of more links than that are known from a broadcast table of how
    many they have, so that a hub's links never meet in one task. It has a row per node, so joining it
    gives each link once. If there are too many such nodes for it, those of fewer links, a bounded
    number, are dealt by a window."""
    sizes = links.groupBy("node").agg(F.count(F.lit(1)).alias("_n"))
    least = max(GATHER, links.count() // MOST_HUBS)
    marked = links.join(F.broadcast(sizes.filter(F.col("_n") > least)), "node", "left")
    parts = F.pmod(F.xxhash64("near"), F.ceil(F.col("_n") / GATHER))
    if least == GATHER:
        return marked.withColumn("part", F.coalesce(parts, F.lit(0))).drop("_n")
    hub = marked.filter("_n is not null").withColumn("part", parts)
    dealt = Window.partitionBy("node").orderBy(F.xxhash64("near"))
    rest = marked.filter("_n is null").withColumn("part", F.floor((F.row_number().over(dealt) - 1) / GATHER))
    return rest.unionByName(hub).drop("_n")


def neighbour_graph(nodes: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(node, near, score): the graph after NN-descent; it ends when under 1 in 1000 edges change."""
    count = nodes.count()
    mean, start = _mean(nodes), None
    for tree in range(TREES + 1):
        block = _blocks(nodes, tree, count, mean)
        start = block if start is None else start.unionByName(block)
    graph = materialise(_keep(start.withColumn("fresh", F.lit(1))), "graph")
    for _ in range(rounds):
        with temporary(nodes.sparkSession, graph):
            worst = graph.groupBy("node").agg(F.when(F.count(F.lit(1)) < DEGREE, F.lit(-2.0)).otherwise(F.min("score")).cast("float").alias("worst"))
            side = nodes.join(worst, "node", "left").select(F.col("node").alias("near"), "code", F.coalesce("worst", F.lit(-2.0).cast("float")).alias("worst"))
            both = graph.select("node", "near", "fresh").unionByName(graph.select(F.col("near").alias("node"), F.col("node").alias("near"), "fresh"))
            both = _dealt(materialise(both.groupBy("node", "near").agg(F.max("fresh").alias("fresh")), "links"))
            gathered = both.join(side, "near").groupBy("node", "part").agg(F.collect_list(F.struct("near", "fresh", "worst", "code")).alias("rows"), F.max("fresh").alias("_any")).filter("_any = 1")
            found = gathered.select("rows").mapInArrow(_local_join, "node long, near long, score float").withColumn("fresh", F.lit(1))
            graph = materialise(_keep(graph.withColumn("fresh", F.lit(0)).unionByName(found)), "graph", outlive=True)
        if graph.filter("fresh = 1").count() < count * DEGREE / 1000:
            break
    return graph.select("node", "near", "score")


def _cosines(left: str, right: str, names: list[str]):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _bytes(batch.column(left).to_pylist()).reshape(batch.num_rows, -1)
                y = _bytes(batch.column(right).to_pylist()).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(np.einsum("ij,ij->i", x, y))], [*names, "score"])

    return score


def search(queries: DataFrame, nodes: DataFrame, graph: DataFrame, beam: int = BEAM, rounds: int = 12) -> DataFrame:
    """(query, node, score): the beam nearest nodes that greedy search from each query's own node
    finds. queries has (query), the query's node. Edges are walked both ways."""
    links = materialise(graph.select("node", "near").unionByName(graph.select(F.col("near").alias("node"), F.col("node").alias("near"))).distinct(), "links")
    vectors = nodes.select("node", "vec")
    ask = materialise(queries.join(vectors, queries.query == vectors.node).select("query", F.col("vec").alias("asked")), "asked")
    state = materialise(ask.select("query", F.col("query").alias("node"), F.lit(1.0).cast("float").alias("score"), F.lit(0).alias("seen")), "beam")
    width = Window.partitionBy("query").orderBy(F.col("score").desc(), "node")
    for _ in range(rounds):
        with temporary(nodes.sparkSession, state):
            reached = state.filter("seen = 0").select("query", "node").join(links, "node").select("query", F.col("near").alias("node")).distinct()
            fresh = reached.join(state.select("query", "node"), ["query", "node"], "left_anti")
            scored = fresh.join(ask, "query").join(vectors, "node").mapInArrow(_cosines("asked", "vec", ["query", "node"]), "query long, node long, score float").withColumn("seen", F.lit(0))
            merged = state.withColumn("seen", F.lit(1)).unionByName(scored)
            state = materialise(merged.withColumn("_r", F.row_number().over(width)).filter(F.col("_r") <= beam).drop("_r"), "beam", outlive=True)
        if state.filter("seen = 0").isEmpty():
            break
    return state.select("query", "node", "score")


def exact_cosine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cosine of the original vectors in double precision."""
    for batch in batches:
        if batch.num_rows:
            x, y = (np.array(batch.column(n).to_pylist(), np.float64) for n in ("asked", "original"))
            a, b = np.abs(x).max(1, keepdims=True), np.abs(y).max(1, keepdims=True)
            x, y = x / a, y / b
            score = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("vec_id"), pa.array(score)], ["query_id", "vec_id", "score"])


def nearest(rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for the rows that is_query holds for,
    over the id column. Every row is a candidate but for the query's own."""
    spark = rows.sparkSession
    small_batches(spark)
    nodes, members = nodes_of(rows, id_col, vector_col, k + 1)
    graph = neighbour_graph(nodes)
    # Queries may be copies that are not among a node's smallest ids, so their vectors are looked up.
    sound = rows.select(F.col(f"`{id_col}`").cast("long").alias("query_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("asked")).filter(F.col("query_id").isNotNull() & usable(F.col("asked")))
    named = members.filter("member = node").select("node", F.xxhash64("original").alias("_k"), F.xxhash64(F.lit(1), "original").alias("_k2"))
    wanted = sound.withColumn("vec_id", F.col("query_id")).filter(is_query).drop("vec_id").dropDuplicates(["query_id", "asked"])
    asked = wanted.withColumn("_k", F.xxhash64("asked")).withColumn("_k2", F.xxhash64(F.lit(1), "asked")).join(named.hint("merge"), ["_k", "_k2"]).select("query_id", "asked", F.col("node").alias("query"))
    asked = materialise(asked, "queries")
    found = search(asked.select("query").distinct(), nodes, graph)
    near = Window.partitionBy("query").orderBy(F.col("score").desc(), "node")
    # All nodes as near as those wanted, the query's own among them, up to what float32 may swap; copies
    # come with their node.
    ranked = found.withColumn("_r", F.row_number().over(near))
    last = F.min(F.when(F.col("_r") <= k + 1, F.col("score"))).over(Window.partitionBy("query"))
    close = ranked.withColumn("_last", last).filter(F.col("score") >= F.col("_last") - CLOSE).select("query", "node")
    pairs = asked.join(close, "query").join(members, "node").filter("query_id <> member")
    scored = pairs.select("query_id", F.col("member").alias("vec_id"), "asked", "original").mapInArrow(exact_cosine, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return scored.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(rows: DataFrame) -> DataFrame:
    return nearest(rows, F.col("vec_id") % 50 == 0)
