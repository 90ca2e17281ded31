"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import json
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a folder of this machine only where that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="tide-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `written` made, once nothing that is still to run reads them."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_kept: dict[str, dict] = {}


def kept(name: str) -> dict:
    """What this process keeps from task to task under a name; it is emptied by tasks that do not name it."""
    return _kept.setdefault(name, {})


def forget(*but: str) -> None:
    """Empties what is kept under other names."""
    gone = [held for name, held in _kept.items() if held and name not in but]
    for held in gone:
        held.clear()
    if gone:
        trim()


def release() -> None:
    """Gives freed memory of Arrow's own pool back to the system."""
    pa.default_memory_pool().release_unused()


def trim() -> None:
    """Gives freed memory back to the system, where the C library can: workers live on, and keep it otherwise."""
    release()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *keeps: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, with freed memory given back after each batch (Arrow's) and when a task ends (all).

    keeps: names of what the worker may go on keeping, from this operator's tasks before and for those to come.
    """

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b
            del b
            release()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(*keeps)
        yield from run(released(batches))
        trim()

    return task


def row_key() -> Column:
    """With doc_id, tells rows apart; rows that agree in both have the same text and may share all results."""
    return F.xxhash64("doc_id", "text")


def range_splits(df: DataFrame, key: str, rows_per_bucket: int, most: int = 10_000) -> list:
    """Ascending values that cut df by key into buckets of about rows_per_bucket rows; at most `most`."""
    n = df.select(key).where(F.col(key).isNotNull()).count()
    k = min(most, n // rows_per_bucket)
    if k < 1:
        return []
    at = ",".join(f"{(i + 1) / (k + 1):.9f}" for i in range(k))
    got = df.select(F.expr(f"approx_percentile({key}, array({at}), {max(10_000, 10 * k)})")).first()[0]
    return sorted(set(got))


def bucket_of(key: Column, splits: list) -> Column:
    """How many of the splits are at most key, by binary search (nulls: 0)."""
    if not splits:
        return F.lit(0)
    steps = len(splits).bit_length()
    table = F.lit([int(s) for s in splits]) if len(splits) > 1 else F.array(F.lit(int(splits[0])))
    powers = F.array(*[F.lit(1 << i) for i in reversed(range(steps))])
    found = F.aggregate(powers, F.lit(0), lambda lo, p: F.when((lo + p <= len(splits)) & (F.element_at(table, F.least(lo + p, F.lit(len(splits)))) <= key), lo + p).otherwise(lo))
    return F.when(key.isNull(), 0).otherwise(found)


def as_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column back to back, and len + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:
        lens = np.where(np.asarray(column.is_valid()), np.diff(off), 0)
        buf = np.concatenate([buf[a : a + n] for a, n in zip(off[:-1], lens, strict=True)] or [buf[:0]])
        return buf, np.concatenate([[0], np.cumsum(lens)])
    return buf[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most `most` bytes together, or of one longer text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Polynomial hashes (mod 2^64) of any slice of a byte buffer, from one prefix sum."""

    def __init__(self, base: int = 0x9E3779B97F4A7C15 | 1, seed: int = 7):
        self.base = base
        self.table = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            up, down = np.full(size, self.base, np.uint64), np.full(size, pow(self.base, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)

    def prefix(self, buf: np.ndarray) -> np.ndarray:
        self._powers(len(buf) + 1)
        out = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(self.table[buf] * self.up[: len(buf)], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((prefix[end] - prefix[start]) * self.down[start])


def with_start(df: DataFrame, value: str, order: list[str], name: str = "start", rows_per_bucket: int = 20_000) -> DataFrame:
    """Adds the sum of value over all rows before, in ascending order of the columns `order` (the first one numeric).

    Sums of at most 10,000 ranges meet in the driver; the rest is a window inside each range. df is read more
    than once, so it should be a written table.
    """
    splits = range_splits(df, order[0], rows_per_bucket)
    keyed = df.withColumn("_b", bucket_of(F.col(order[0]), splits))
    sums = {r["_b"]: r["s"] for r in keyed.groupBy("_b").agg(F.sum(value).alias("s")).collect()}
    before, total = [], 0
    for b in range(len(splits) + 1):
        before.append(total)
        total += int(sums.get(b) or 0)
    inside = Window.partitionBy("_b").orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    base = F.element_at(F.from_json(F.lit(json.dumps(before)), "array<bigint>"), F.col("_b") + 1)
    return keyed.withColumn(name, (base + F.coalesce(F.sum(value).over(inside), F.lit(0))).cast("long")).drop("_b")
