"""Sharding by extendible hashing.

A directory is indexed by the leading bits of a hash of the document id. Starting from one bucket,
only buckets over the byte limit split, on one more bit, until every bucket fits. A bucket whose
rows all share one hash cannot split; beyond the limit it is cut into pages by running byte sums.

The sizes are summed into cells of a depth near that of the buckets; a cell over the limit is summed
anew, deeper, by itself. The buckets are the largest nodes that fit, found by adding cells upwards
pair by pair, which touches ever fewer rows.

Defined cases: a text's bytes are its UTF-8 length, 0 for null; a null id hashes as the empty text;
a single document beyond the limit is a shard of its own; repeated rows hash alike and are paged if
need be, each partition of the table by itself; an empty table gives no shards. Other columns pass through; on a clash the new ones win.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quellwerk.llm.common import BROADCAST_BYTES, broadcast_if_small, kept_columns, materialise, temporary

#: The hash keeps this many bits, the leading ones of an MD5.
BITS = 60
_NEW = ["n_bytes", "shard_id", "shard_bytes", "shard_docs"]


def hash_bits(doc_id: Column) -> Column:
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long")


def _shifted(way: str, value: Column | str, bits: Column) -> Column:
    return F.call_function(f"shift{way}", F.col(value) if isinstance(value, str) else value, bits)


def _fits(limit: int) -> Column:
    return (F.col("bytes") <= limit) | (F.col("low") == F.col("high"))


def _cells(sizes: DataFrame, depth: int, limit: int) -> DataFrame:
    """The nodes of a depth: (node, bytes, docs, low, high, fits), low and high being hashes."""
    cells = sizes.groupBy(F.shiftright("h", BITS - depth).alias("node")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("docs"), F.min("h").alias("low"), F.max("h").alias("high"))
    return materialise(cells.withColumn("fits", _fits(limit)), "shard-cells")


def _climb(nodes: DataFrame, depth: int, top: int, limit: int) -> list[DataFrame]:
    """The largest nodes that fit, of depths over top up to depth: those that fit while their parent
    does not. A node that does not fit keeps its ancestors from fitting."""
    found = []
    while depth > top:
        child = F.struct("node", "bytes", "docs", "low", "high", "fits")
        parents = nodes.groupBy(F.shiftright("node", 1).alias("up")).agg(F.collect_list(child).alias("parts"))  # two at most
        total = lambda name: F.aggregate("parts", F.lit(0).cast("long"), lambda n, x: n + x[name])
        parents = parents.select(F.col("up").alias("node"), total("bytes").alias("bytes"), total("docs").alias("docs"), F.array_min(F.transform("parts", lambda x: x["low"])).alias("low"), F.array_max(F.transform("parts", lambda x: x["high"])).alias("high"), "parts")
        parents = materialise(parents.withColumn("fits", _fits(limit) & F.forall("parts", lambda x: x["fits"])), "shard-level")
        found.append(parents.filter("not fits").select(F.explode("parts").alias("x")).select("x.*").filter("fits").withColumn("depth", F.lit(depth)))
        nodes, depth = parents.drop("parts"), depth - 1
        if nodes.filter("fits").isEmpty():
            return found
    return [*found, nodes.filter("fits").withColumn("depth", F.lit(depth))] if depth == 0 else found


def split_buckets(sizes: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """The directory, a row per bucket and cell of the directory's depth, as (cell, node, depth, bytes,
    docs), and that depth. A bucket deeper than it shares its cell with others.

    sizes has (h, bytes) per document."""
    with temporary(sizes.sparkSession):
        total = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first().b
        fine = min(BITS, max(1, -(-total // limit)).bit_length() + 2)
        cells = _cells(sizes, fine, limit)
        found = _climb(cells, fine, 0, limit)
        depth, over = fine, cells.filter("not fits").select("node")
        while depth < BITS and not over.isEmpty():
            deeper = min(BITS, depth + 4)
            # Cells over the limit number at most total / limit.
            inside = sizes.join(broadcast_if_small(over, 16), F.shiftright("h", BITS - depth) == F.col("node"), "left_semi")
            cells = _cells(inside, deeper, limit)
            found += _climb(cells, deeper, depth, limit)
            depth, over = deeper, cells.filter("not fits").select("node")
        buckets = found[0]
        for part in found[1:]:
            buckets = buckets.unionByName(part)
        first = F.when(F.col("depth") <= fine, _shifted("left", "node", fine - F.col("depth"))).otherwise(_shifted("right", "node", F.col("depth") - fine))
        last = F.when(F.col("depth") <= fine, _shifted("left", F.col("node") + 1, fine - F.col("depth")) - 1).otherwise(first)
        return materialise(buckets.select(F.explode(F.sequence(first, last)).alias("cell"), "node", "depth", "bytes", "docs"), "shard-directory", outlive=2), fine


def assign(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """docs with n_bytes, shard_id (the leading bits, with a page number where paged), shard_bytes
    and shard_docs. The directory is broadcast if its counted size allows, else joined by shuffle."""
    size = F.coalesce(F.octet_length(f"`{text_col}`"), F.lit(0)).cast("long")
    with temporary(docs.sparkSession):
        sizes = materialise(docs.select(hash_bits(F.col(f"`{id_col}`")).alias("h"), size.alias("bytes")), "shard-sizes")
        directory, fine = split_buckets(sizes, limit)
    first = directory.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.when(F.col("bytes") > limit, 1)).alias("over")).first()
    names = kept_columns(docs, _NEW) if carry is None else carry
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), hash_bits(F.col(f"`{id_col}`")).alias("_hash"), size.alias("n_bytes"), F.spark_partition_id().alias("_part"))
    directory = directory.withColumnRenamed("node", "_node")
    small = first.rows * 64 <= BROADCAST_BYTES
    held = (F.shiftright("_hash", BITS - fine) == F.col("cell")) & (_shifted("right", "_hash", BITS - F.col("depth")) == F.col("_node"))
    bits = F.lpad(F.bin("_hash"), BITS, "0")
    joined = rows.join(F.broadcast(directory) if small else directory, held).withColumn("shard_id", F.concat(F.lit("b"), bits.substr(F.lit(1), F.col("depth"))))
    fitting = joined.filter(F.col("bytes") <= limit).select("_row.*", "n_bytes", "shard_id", F.col("bytes").alias("shard_bytes"), F.col("docs").alias("shard_docs"))
    if not first.over:
        return fitting
    return fitting.unionByName(_paged(joined.filter(F.col("bytes") > limit), limit))


def _paged(rows: DataFrame, limit: int) -> DataFrame:
    """Cuts buckets of one hash into pages, for each partition of the table by itself, so that all rows
    of a hash never meet in one task. A page covers a stretch of the running sum that leaves room
    for the largest row, so no page passes the limit; rows that take more than half of it, where
    such a stretch would be short, have pages of their own."""
    large = F.col("n_bytes") * 2 > limit
    order = Window.partitionBy("_hash", "_part", large).orderBy("n_bytes", F.xxhash64("_row"))
    before = F.coalesce(F.sum("n_bytes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    page = F.when(large, F.concat(F.lit("/x"), F.row_number().over(order))).otherwise(F.concat(F.lit("/p"), F.floor(before / F.lit(limit - limit // 2))))
    paged = rows.withColumn("shard_id", F.concat("shard_id", F.lit("/"), F.col("_part").cast("string"), page))
    own = Window.partitionBy("shard_id")
    return paged.select("_row.*", "n_bytes", "shard_id", F.sum("n_bytes").over(own).alias("shard_bytes"), F.count(F.lit(1)).over(own).alias("shard_docs"))


#: Byte limit of the registered query and of the pipeline's last stage.
LIMIT = 4 << 20


def query(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    return assign(docs, limit, carry=["doc_id"])


ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
levels AS (SELECT doc_id, n_bytes, depth, h >> ({BITS} - depth) AS p
           FROM d, unnest(range(0, 31)) AS r(depth)),
buckets AS (SELECT depth, p, sum(n_bytes)::BIGINT AS shard_bytes, count(*)::BIGINT AS shard_docs,
                   count(DISTINCT doc_id) AS ids FROM levels GROUP BY depth, p),
first AS (SELECT l.doc_id, l.n_bytes, l.p, b.*, row_number() OVER (PARTITION BY l.doc_id ORDER BY depth) AS k
          FROM levels l JOIN buckets b USING (depth, p) WHERE b.shard_bytes <= {LIMIT} OR b.ids = 1)
SELECT doc_id, n_bytes, 'b' || CASE depth WHEN 0 THEN '' ELSE right(lpad(bin(p), 60, '0'), depth::INT) END AS shard_id,
       shard_bytes, shard_docs
FROM first WHERE k = 1
"""
