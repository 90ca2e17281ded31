"""Sharding by a hypergeometric communication matrix: a uniform shuffle with exact shard sizes.

Rows lie in cells (the source partitions; beyond MOST_CELLS, runs of them). How many rows of each cell go to each
target block is drawn exactly, as a uniform shuffle would deal them: row by row of a matrix with given margins. Cells
permute their rows where they lie and cut them by their row of the matrix, one exchange takes them to their blocks, and
blocks permute what they receive. A shard is a run of blocks, so no task holds a whole shard. Only keys of fixed width
travel, and the matrix has at most MOST_CELLS^2 entries whatever the input.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.llm.common import written

#: Source cells and target blocks, at most: the matrix is the one thing that is broadcast, at 8 bytes an entry.
MOST_CELLS = 1024


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Good ones among draws without replacement; numpy's where its range allows, else ratio of uniforms."""
    total = good + bad
    if draws <= 0 or good <= 0:
        return 0
    if bad <= 0:
        return draws
    if draws >= total:
        return good
    if total < 10**9:
        return int(rng.hypergeometric(good, bad, draws))
    low, high = max(0, draws - bad), min(good, draws)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))

    def log_p(k: int) -> float:
        return -sum(math.lgamma(x + 1) for x in (k, good - k, draws - k, bad - draws + k))

    top = log_p(mode)
    mean, var = draws * good / total, draws * (good / total) * (bad / total) * (total - draws) / (total - 1)
    width = math.sqrt(2 * (var + 0.5)) * 1.72 + 1.03
    while True:
        u, v = rng.random(), rng.random()
        if u == 0:
            continue
        k = math.floor(mean + 0.5 + width * (v - 0.5) / u)
        if low <= k <= high and 2 * math.log(u) <= log_p(k) - top:
            return k


def communication_matrix(cells: list[int], blocks: list[int], seed: int) -> np.ndarray:
    """Counts with row sums `cells` and column sums `blocks`, distributed as for a uniform shuffle.

    Both sides are halved in turn, so that each entry costs one draw whatever its size. Empty cells and blocks have
    zeros; no cells give no rows. Sums that differ are an error.
    """
    rng, out = np.random.default_rng(seed), np.zeros((len(cells), len(blocks)), np.int64)
    if sum(cells) != sum(blocks):
        raise ValueError("margins differ")
    left = np.array(blocks, dtype=np.int64)
    for i, rows in enumerate(cells):
        todo = [(0, len(blocks), rows)]
        ahead = np.concatenate([[0], np.cumsum(left)])
        while todo:
            a, b, k = todo.pop()
            if k == 0:
                continue
            if b - a == 1:
                out[i, a] = k
                continue
            m = (a + b) // 2
            x = hypergeometric(rng, int(ahead[m] - ahead[a]), int(ahead[b] - ahead[m]), k)
            todo += [(a, m, x), (m, b, k - x)]
        left -= out[i]
    return out


def even(total: int, parts: int) -> list[int]:
    return [total // parts + (i < total % parts) for i in range(parts)]


def shard(docs: DataFrame, n_shards: int = 8, rows_per_block: int = 4096, seed: int = 20240) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: a uniform shuffle of all rows into shards whose counts differ by one at most.

    Null texts have size 1 and crc 0; null doc_ids, repeated rows and ties are rows like any other; an empty
    table gives no rows. Other columns are not read. The draw is fixed by seed and by the input's partitions.
    """
    spark = docs.sparkSession
    narrow = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    ).coalesce(MOST_CELLS)
    # a cell's rows in a random order: the number that Spark gives them is the cell and the place in it
    narrow = narrow.withColumns({f"_r{i}": F.rand(seed + i) for i in (1, 2)}).sortWithinPartitions("_r1", "_r2", "doc_id", "text_crc32")
    place = F.monotonically_increasing_id()
    base = written(narrow.withColumn("_at", place).select("doc_id", "size", "text_crc32", "_r1", "_r2", F.shiftright("_at", 33).cast("int").alias("_cell"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_i")), "shard-rows")
    found = {r["_cell"]: r["count"] for r in base.groupBy("_cell").count().collect()}
    n, cells = sum(found.values()), [found.get(i, 0) for i in range(max(found, default=0) + 1)]
    per_shard = max(1, min(MOST_CELLS // n_shards, -(-n // (n_shards * rows_per_block))))
    blocks = [x for size in even(n, n_shards) for x in even(size, per_shard)]
    matrix = communication_matrix(cells, blocks, seed)
    ends = json.dumps(np.cumsum(matrix, axis=1).tolist())
    starts = np.concatenate([np.concatenate([[0], np.cumsum(blocks[s * per_shard : (s + 1) * per_shard])[:-1]]) for s in range(n_shards)])
    dealt = spark.range(1).select(F.posexplode(F.from_json(F.lit(ends), "array<array<bigint>>")).alias("_cell", "_ends"))

    placed = base.join(F.broadcast(dealt), "_cell")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(blocks).bit_length()))])
    # how many of the ascending ends are at most _i, by binary search
    block = F.aggregate(steps, F.lit(0), lambda lo, p: F.when((lo + p <= len(blocks)) & (F.element_at("_ends", F.least(lo + p, F.lit(len(blocks)))) <= F.col("_i")), lo + p).otherwise(lo))
    again = Window.partitionBy("_block").orderBy("_r2", "_r1", "doc_id", "text_crc32")
    return placed.withColumn("_block", block).select(
        "doc_id",
        "size",
        "text_crc32",
        F.floor(F.col("_block") / per_shard).cast("int").alias("shard"),
        (F.element_at(F.from_json(F.lit(json.dumps(starts.tolist())), "array<bigint>"), F.col("_block") + 1) + F.row_number().over(again) - 1).cast("long").alias("slot"),
    )


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 7 under the law `rows`."""
    from tidegraph.llm.common import documents

    out = shard(documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
