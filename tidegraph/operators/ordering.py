"""Ranks and running sums over a whole table in a total order, range by range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.plans.tables import written


def in_ranges(df: DataFrame, order: list[Column]) -> DataFrame:
    """df, written, with _p: the number of its range in the order; ties must not be many, so order should tell rows apart."""
    return written(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranges")


def running_sum(df: DataFrame, value: Column, order: list[Column], name: str) -> DataFrame:
    """Adds the sum of value over all rows before, in the order; 0 for the first.

    The table is cut into ranges of the order. One sum per range, as many as there are shuffle partitions, meets in the
    driver; the rest is a window inside each range.
    """
    ranged = in_ranges(df.withColumn("_v", value), order)
    sums = sorted((r["_p"], r["s"]) for r in ranged.groupBy("_p").agg(F.sum("_v").alias("s")).collect())
    before, total = [], 0
    for p, s in sums:
        before.append((p, total))
        total += s or 0
    kind = dict(ranged.groupBy().agg(F.sum("_v").alias("s")).dtypes)["s"]
    base = F.broadcast(df.sparkSession.createDataFrame(before, f"_p int, _base {kind}"))
    inside = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(base, "_p").withColumn(name, F.col("_base") + F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    return out.drop("_p", "_v", "_base")


def row_numbers(df: DataFrame, order: list[Column], name: str, base: int = 1) -> DataFrame:
    """Adds the place of each row in the order, from base."""
    return running_sum(df, F.lit(1), order, name).withColumn(name, F.col(name) + base)


def equal_intervals(degrees: DataFrame, parts: int) -> DataFrame:
    """interval, first, last, edges: ranges of ids that hold about equally many in-edges each; no vertex is split.

    degrees: id, in_degree. A range ends where the running count passes the next multiple of the mean, so a vertex of
    very many edges makes a range larger and others empty; empty ranges are left out.
    """
    placed = written(running_sum(degrees.select("id", "in_degree"), F.col("in_degree"), [F.col("id")], "before"), "placed")
    total = placed.agg(F.sum("in_degree")).first()[0] or 0
    interval = F.least(F.floor(F.col("before") * parts / max(1, total)), F.lit(parts - 1)).cast("int")
    return placed.withColumn("interval", interval).groupBy("interval").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.sum("in_degree").alias("edges"))


def running_last(df: DataFrame, value: Column, order: list[Column], name: str) -> DataFrame:
    """Adds the last value that is not null up to each row, in the order; one value per range meets in the driver."""
    ranged = in_ranges(df.withColumn("_v", value), order)
    kind = dict(ranged.dtypes)["_v"]
    known = ranged.where("_v is not null").groupBy("_p").agg(F.max_by("_v", F.struct(*order)).alias("v"))
    found = {r["_p"]: r["v"] for r in known.collect()}
    parts = [r["_p"] for r in ranged.select("_p").distinct().collect()]
    before, last = [], None
    for p in sorted(parts):
        before.append((p, last))
        last = found.get(p, last)
    base = F.broadcast(df.sparkSession.createDataFrame(before, f"_p int, _base {kind}"))
    inside = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(base, "_p").withColumn(name, F.coalesce(F.last("_v", ignorenulls=True).over(inside), F.col("_base")))
    return out.drop("_p", "_v", "_base")
