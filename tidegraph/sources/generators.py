"""Made graphs: chain, grids, random graphs, random weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def chain(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))


def _lattice(spark: SparkSession, n: int, steps: list[tuple[int, ...]]) -> DataFrame:
    """Points of an n^k lattice joined with their neighbours at the given steps; inside only."""
    dims = len(steps[0])
    points = spark.range(n**dims).withColumnRenamed("id", "src")
    at = [F.floor(F.col("src") / n**k) % n for k in range(dims)]
    moves = F.array(*[F.struct(F.lit(sum(s * n**k for k, s in enumerate(step))).alias("by"), F.lit(True if not step else True).alias("ok"), *[F.lit(s).alias(f"s{k}") for k, s in enumerate(step)]) for step in steps])
    out = points.select("src", *[a.alias(f"a{k}") for k, a in enumerate(at)], F.explode(moves).alias("m"))
    for k in range(dims):
        out = out.where((F.col(f"a{k}") + F.col(f"m.s{k}")).between(0, n - 1))
    return out.select("src", (F.col("src") + F.col("m.by")).alias("dst"))


def grid(spark: SparkSession, n: int) -> DataFrame:
    return _lattice(spark, n, [(1, 0), (0, 1)])


def crossgrid(spark: SparkSession, n: int) -> DataFrame:
    return _lattice(spark, n, [(1, 0), (0, 1), (1, 1), (-1, 1)])


def cubegrid(spark: SparkSession, n: int) -> DataFrame:
    return _lattice(spark, n, [(1, 0, 0), (0, 1, 0), (0, 0, 1)])


def quadgrid(spark: SparkSession, n: int) -> DataFrame:
    return _lattice(spark, n, [(1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 0), (0, 0, 0, 1)])


def erdos_renyi(spark: SparkSession, n: int, p: float, seed: int = 1) -> DataFrame:
    """Each pair with probability p, in a random direction; a pair's draw depends on the pair and the seed alone."""
    pairs = spark.range(n).select(F.col("id").alias("a"), F.explode(F.sequence(F.col("id") + 1, F.lit(n - 1) + F.when(F.col("id") == n - 1, 1).otherwise(0))).alias("b")).where("b < " + str(n))
    draw = F.pmod(F.xxhash64("a", "b", F.lit(seed)), F.lit(1_000_000))
    turn = F.pmod(F.xxhash64("b", "a", F.lit(seed)), F.lit(2)) == 0
    return pairs.where(draw < int(p * 1_000_000)).select(F.when(turn, F.col("a")).otherwise(F.col("b")).alias("src"), F.when(turn, F.col("b")).otherwise(F.col("a")).alias("dst"))


def random_weights(edges: DataFrame, most: int = 100_000_000, seed: int = 1) -> DataFrame:
    return edges.withColumn("weight", F.pmod(F.xxhash64("src", "dst", F.lit(seed)), F.lit(most)))
