"""Plumbing shared by the corpus operators: scratch tables, table access, Arrow helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
ASCII_SPACE = " \t\n\x0b\f\r"

#: A table is broadcast only if its counted rows times their width stay below this.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir, or a temporary one on a local master."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="quellwerk-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{folder}")
    return f"file://{folder}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/quellwerk/{label}-{uuid.uuid4().hex}"


#: Per open scope of temporary(), the paths that end with it.
_SCOPES: list[list[str]] = []


#: Whether Spark deletes an execution's shuffle files when it ends; without it, they stay until the
#: driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, label: str, outlive: int = 0) -> DataFrame:
    """Writes df as Parquet into the shared folder and rereads it: lineage ends here, and lost
    executors lose nothing of it. The table stays beyond the outlive innermost temporary(); the shuffle
    files of the writing, which nothing else reads, go at once."""
    path = scratch_path(df.sparkSession, label)
    scopes = _SCOPES[: max(0, len(_SCOPES) - outlive)]
    if scopes:
        scopes[-1].append(path)
    conf, before = df.sparkSession.conf, df.sparkSession.conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            conf.unset(_CLEANUP)
        else:
            conf.set(_CLEANUP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def temporary(spark: SparkSession, *spent: DataFrame) -> Iterator[None]:
    """Deletes the tables that were written inside, and the spent ones, which materialise() gave, when
    its body ends without an error. What is needed later has to outlive it, written out."""
    scope: list[str] = []
    _SCOPES.append(scope)
    try:
        yield
    finally:
        _SCOPES.pop()
    _delete(spark, [*scope, *[path for table in spent if (path := getattr(table, "_scratch", None))]])


def small_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch holds, since single texts and archives may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its counted size is below limit, else df, to be shuffled."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def binary(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """A string column as bytes, without copying; nulls become empty."""
    return column.cast(pa.binary()).fill_null(b"")


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod modulus; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(modulus))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: spreads every input bit over the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bounded_sample(rows: DataFrame, key: str, cost: Column, most: int) -> DataFrame:
    """rows, or if their summed cost is over most, those of a share by the key's hash that costs about
    half of it, and never more than most. For classifiers' samples only."""
    total = rows.agg(F.coalesce(F.sum(cost), F.lit(0)).alias("c")).first().c
    if total <= most:
        return rows
    place = F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 30))
    thin = rows.filter(place < int(most / 2 / total * (1 << 30)))
    running = F.sum(cost).over(Window.orderBy(place, key))
    return thin.withColumn("_c", running).filter(F.col("_c") <= most).drop("_c")


CELLS_A_ROW = 2048
ARRAY_SCHEMA = "chunk int, cells binary"


def array_rows(values: np.ndarray, dtype: type = np.float64) -> tuple[list[int], list[bytes]]:
    """A long numeric array as columns (chunk, cells), for summed() to add up."""
    values = np.ascontiguousarray(values, dtype=dtype)
    cells = [values[i : i + CELLS_A_ROW].tobytes() for i in range(0, len(values), CELLS_A_ROW)]
    return list(range(len(cells))), cells


def array_batch(values: np.ndarray, dtype: type = np.float64) -> pa.RecordBatch:
    chunk, cells = array_rows(values, dtype)
    return pa.RecordBatch.from_arrays([pa.array(chunk, pa.int32()), pa.array(cells, pa.binary())], ["chunk", "cells"])


def summed(partials: DataFrame, length: int, dtype: type = np.float64, tasks: int = 16) -> np.ndarray:
    """The sum of the arrays whose array_rows() partials holds. Each task adds a slice of the
    array as a stream, so memory and what reaches the driver depend on length alone."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, cells in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = np.frombuffer(cells.as_buffer(), dtype=dtype)
                if chunk in totals:
                    totals[chunk] += values
                else:
                    totals[chunk] = values.astype(np.float64)
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([v.tobytes() for v in totals.values()], pa.binary())], ["chunk", "cells"])

    total = np.zeros(-(-length // CELLS_A_ROW) * CELLS_A_ROW)
    for row in partials.select("chunk", "cells").repartition(tasks, "chunk").mapInArrow(add, ARRAY_SCHEMA).collect():
        values = np.frombuffer(row.cells, dtype=np.float64)
        total[row.chunk * CELLS_A_ROW : row.chunk * CELLS_A_ROW + len(values)] += values
    return total[:length]


def kept_columns(df: DataFrame, new: list[str]) -> list[str]:
    """df's columns but for those an operator is about to add; its own win on a clash."""
    return [c for c in df.columns if c not in new]
