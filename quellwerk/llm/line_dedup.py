"""Line deduplication with DataFrame functions alone.

Lines are exploded, normalised and hashed to 128 bits, once; per hash the documents that hold it are
counted; a line whose hash reaches the threshold stays only in the document with the smallest id.
Lines of the most frequent hashes find theirs in a broadcast table of bounded size, so no task meets
all lines of one of them; the others are joined by shuffle.

Defined cases: a null or empty text is one empty line; keys shorter than min_chars never drop; a
row without id keeps all its lines and counts for no other; repeated rows are treated alike (they
are one document when they share an id); repeated lines within the keeping document all stay; other
columns pass through, and where they clash with n_lines, n_dropped or the text, the new ones win.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quellwerk.llm.common import ASCII_SPACE, LOWER, UPPER, kept_columns, materialise


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased and nothing else."""
    core = F.btrim(line, F.lit(ASCII_SPACE))
    return F.when(F.octet_length(core) == F.char_length(core), F.lower(core)).otherwise(F.translate(core, UPPER, LOWER))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


#: Keys beyond this many lines are frequent, and at most this many keys can be.
LEAST_FREQUENT, MOST_FREQUENT = 1000, 1 << 20


def repeated_keys(lines: DataFrame, min_docs: int) -> DataFrame:
    """(h1, h2, keeper, lines) of the keys that at least min_docs distinct ids hold. Both forms combine
    on the map side, so a line that a third of all documents share is a row per task."""
    keys = lines.groupBy("h1", "h2")
    if min_docs == 2:
        return keys.agg(F.min("_id").alias("keeper"), F.max("_id").alias("_last"), F.count(F.lit(1)).alias("lines")).filter("keeper <> _last").drop("_last")
    each = lines.filter("_id is not null").groupBy("h1", "h2", "_id").agg(F.count(F.lit(1)).alias("_n"))
    found = each.groupBy("h1", "h2").agg(F.min("_id").alias("keeper"), F.count("_id").alias("_docs"), F.sum("_n").alias("lines"))
    return found.filter(F.col("_docs") >= min_docs).drop("_docs")


def with_keeper(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """lines whose key is among keys, with its keeper. Of the keys, those with more than a millionth of
    all lines are a broadcast table: there are at most MOST_FREQUENT of them."""
    often = F.col("lines") > max(LEAST_FREQUENT, lines.count() // MOST_FREQUENT)
    frequent = F.broadcast(keys.filter(often).select("h1", "h2", F.col("keeper").alias("_often")))
    marked = lines.join(frequent, ["h1", "h2"], "left")
    rest = marked.filter("_often is null").drop("_often").join(keys.filter(~often).select("h1", "h2", "keeper").hint("merge"), ["h1", "h2"])
    return marked.filter("_often is not null").withColumnRenamed("_often", "keeper").unionByName(rest)


def dedupe_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2, carry: list[str] | None = None) -> DataFrame:
    """docs with the text rebuilt from the lines that stay, and n_lines, n_dropped (long).

    The text is shuffled once, for the join with the dropped positions of its document; lines
    travel as 128-bit hashes. carry names the other columns to return (all by default)."""
    others = kept_columns(docs, [text_col, "n_lines", "n_dropped"]) if carry is None else carry
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("_row"), F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    keyed = source.select("_id", F.xxhash64("_text").alias("_version"), F.posexplode(_lines(F.col("_text"))).alias("_pos", "_line"))
    keyed = keyed.select("_id", "_version", "_pos", line_key(F.col("_line")).alias("_key")).filter(F.char_length("_key") >= min_chars)
    lines = keyed.select("_id", "_version", "_pos", F.xxhash64("_key").alias("h1"), F.xxhash64(F.lit(1), "_key").alias("h2"))
    lines = materialise(lines, "lines")
    keys = materialise(repeated_keys(lines, min_docs), "line-keys")
    drops = with_keeper(lines, keys).filter("_id <> keeper")
    drops = drops.groupBy("_id", "_version").agg(F.sort_array(F.collect_set("_pos")).alias("_drop"))
    joined = source.withColumn("_version", F.xxhash64("_text")).join(drops, ["_id", "_version"], "left")
    # The gaps between dropped positions are slices, so a document costs linear time. The lambda
    # binds the split lines once instead of splitting again for every slice.
    kept = F.transform(F.array(_lines(F.col("_text"))), lambda lines: F.array_join(F.flatten(F.transform(
        F.sequence(F.lit(0), F.size("_drop")),
        lambda i: F.slice(
            lines,
            F.when(i == 0, F.lit(1)).otherwise(F.get("_drop", i - 1) + 2),
            F.when(i == F.size("_drop"), F.size(lines)).otherwise(F.get("_drop", i)) - F.when(i == 0, F.lit(0)).otherwise(F.get("_drop", i - 1) + 1),
        ),
    )), "\n"))[0]
    return joined.select(
        "_row.*",
        F.when(F.col("_drop").isNull(), F.coalesce("_text", F.lit(""))).otherwise(kept).alias(text_col),
        F.size(_lines(F.col("_text"))).cast("long").alias("n_lines"),
        F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
repeated AS (
  SELECT k, min(doc_id) AS keeper FROM keyed WHERE length(k) >= 10
  GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT keyed.*, repeated.keeper IS NOT NULL AND keyed.doc_id <> repeated.keeper AS gone
  FROM keyed LEFT JOIN repeated USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def query(docs: DataFrame) -> DataFrame:
    return dedupe_lines(docs, carry=["doc_id"]).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
