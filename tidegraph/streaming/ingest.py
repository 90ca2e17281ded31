"""Streaming edges: appended to an edge table micro-batch by micro-batch, with ranks kept up to date.

Back-pressure is the source's (maxFilesPerTrigger); deletions are tombstones that an anti-join applies.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegraph.operators.graph import degrees, iterate, vertices_of
from tidegraph.operators.programs import pagerank_program, run
from tidegraph.plans.tables import written


class EdgeTable:
    """Edges as they came, in a Parquet folder; a batch is written under its number, so that one run twice counts once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, edges: DataFrame, batch: int) -> None:
        edges.where("src <> dst").select("src", "dst").write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def delete(self, edges: DataFrame, batch: int) -> None:
        edges.select("src", "dst").write.mode("overwrite").parquet(f"{self.path}-gone/batch={batch}")

    def edges(self) -> DataFrame:
        found = self.spark.read.schema("src long, dst long, batch int").parquet(self.path).select("src", "dst").distinct()
        try:
            gone = self.spark.read.schema("src long, dst long, batch int").parquet(f"{self.path}-gone").select("src", "dst")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return found
        return found.join(gone, ["src", "dst"], "left_anti")

    def compact(self, path: str) -> EdgeTable:
        """The edges of now as one batch in a new folder."""
        self.edges().write.parquet(f"{path}/batch=0")
        return EdgeTable(self.spark, path)

    def crowded(self, batches: int = 100, gone: float = 0.1) -> bool:
        """Whether a compaction is due: more than so many batches, or so large a share of the edges deleted."""
        found = self.spark.read.schema("src long, dst long, batch int").parquet(self.path)
        if found.select("batch").distinct().count() > batches:
            return True
        return self.edges().count() < (1 - gone) * found.select("src", "dst").distinct().count()


def refresh_ranks(edges: DataFrame, old: DataFrame | None, updates: int) -> DataFrame:
    """id, rank: `updates` rounds of PageRank from the old ranks (1 for new vertices)."""
    deg = degrees(edges).select("id", "out_degree")
    if old is not None:
        deg = deg.join(old, "id", "left").select("id", F.coalesce("rank", F.lit(1.0)).alias("rank"), "out_degree")
    else:
        deg = deg.withColumn("rank", F.lit(1.0))
    out = iterate(edges, deg.select("id", "rank", "out_degree"), F.col("rank") / F.col("out_degree"), F.sum, lambda m: {"rank": 0.15 + 0.85 * F.coalesce(m, F.lit(0.0))}, updates)
    return out.select("id", "rank")


def reschedule_ranks(edges: DataFrame, old: DataFrame, new_edges: DataFrame, rounds: int, least: float = 0.1) -> DataFrame:
    """id, rank after new edges, incrementally: only scheduled vertices gather, at most `rounds` times.

    First the out-neighbours of the new edges' sources are scheduled, whose shares changed, and then those of vertices
    whose rank moved by `least` or more. Vertices without an old rank start at 1.
    """
    p = pagerank_program(least)
    known = old.withColumnRenamed("id", "_id")
    start = written(vertices_of(edges).join(known, F.col("id") == F.col("_id"), "left").select("id", F.coalesce("rank", F.lit(1.0)).alias("rank")), "ranks")
    touched = edges.join(new_edges.select("src").distinct(), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
    return run(edges, p, rounds, active=written(touched, "scheduled"), start=start)


class Leaderboard:
    """The k best vertices after each batch, kept as a table; called with the batch's number and its ranks."""

    def __init__(self, spark: SparkSession, path: str, k: int = 20):
        self.spark, self.path, self.k = spark, path, k

    def __call__(self, batch: int, ranks: DataFrame) -> None:
        best = ranks.orderBy(F.round("rank", 9).desc(), "id").limit(self.k)
        place = F.row_number().over(Window.orderBy(F.round("rank", 9).desc(), "id"))  # k rows
        best.select("id", "rank", place.alias("place")).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def table(self) -> DataFrame:
        """batch, id, rank, place."""
        return self.spark.read.schema("id long, rank double, place int, batch long").parquet(self.path).select("batch", "id", "rank", "place")


def follow(source: DataFrame, table: EdgeTable, updates_per_batch: int = 1, updates_at_end: int = 5, on_ranks: Callable[[int, DataFrame], None] | None = None) -> DataFrame:
    """Runs a stream of edges (src, dst) to its end; returns the ranks after `updates_at_end` more rounds.

    Checkpoint and ranks lie beside the edge table, the ranks under their batch's number, so that a stream that was
    stopped goes on where it was: a batch that is run again starts from the ranks of the one before it.
    """

    def ranks_of(n: int) -> DataFrame | None:
        try:
            return table.spark.read.schema("id long, rank double").parquet(f"{table.path}-ranks/{n}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None

    last = {"batch": -1}

    def batch(df: DataFrame, n: int) -> None:
        table.append(df, n)
        edges = table.edges()
        if edges.limit(1).count():
            refresh_ranks(edges, ranks_of(n - 1), updates_per_batch).write.mode("overwrite").parquet(f"{table.path}-ranks/{n}")
            if on_ranks:
                on_ranks(n, ranks_of(n))
        last["batch"] = n

    where = f"{table.path}-checkpoint"
    source.writeStream.foreachBatch(batch).option("checkpointLocation", where).trigger(availableNow=True).start().awaitTermination()
    n = last["batch"] if last["batch"] >= 0 else _last_batch(table)
    return written(refresh_ranks(table.edges(), ranks_of(n), updates_at_end), "ranks")


def _last_batch(table: EdgeTable) -> int:
    """The number of the last batch in the table, for a stream that had nothing new; -1 if there is none."""
    got = table.spark.read.schema("src long, dst long, batch int").parquet(table.path).agg(F.max("batch")).first()[0]
    return -1 if got is None else got
