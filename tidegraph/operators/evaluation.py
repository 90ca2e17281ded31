"""Errors and ranking measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.operators.ordering import row_numbers


def errors(df: DataFrame, weight: str | None = None, cutoff: float | None = None) -> DataFrame:
    """rmse, mae (and share on the wrong side of cutoff) of columns r and prediction."""
    e = F.col("r") - F.col("prediction")
    w = F.col(weight) if weight else F.lit(1.0)
    out = [F.sqrt(F.sum(w * e * e) / F.sum(w)).alias("rmse"), (F.sum(w * F.abs(e)) / F.sum(w)).alias("mae")]
    if cutoff is not None:
        out.append(F.avg(((F.col("r") > cutoff) != (F.col("prediction") > cutoff)).cast("int")).alias("wrong"))
    return df.agg(*out)


def auc(df: DataFrame, cutoff: float) -> DataFrame:
    """Area under the curve by ranks; equal predictions are ordered by id, not averaged."""
    ranked = row_numbers(df.select("r", "prediction", "id"), [F.col("prediction"), F.col("id")], "rank")
    pos = (F.col("r") > cutoff).cast("int")
    s = ranked.agg(F.sum(pos * F.col("rank")).alias("s"), F.sum(pos).alias("p"), F.sum(1 - pos).alias("n"))
    return s.select(((F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("n"))).alias("auc"))


def average_precision(ranked: DataFrame, actual: DataFrame, k: int) -> DataFrame:
    """id, ap: ranked (id, item, rank from 1), actual (id, item, rank); the actual list is cut to its first k as well."""
    truth = actual.where(F.col("rank") <= k)
    n = truth.groupBy("id").agg(F.least(F.count("*"), F.lit(k)).alias("n"))
    hit = ranked.where(F.col("rank") <= k).join(truth.select("id", "item", F.lit(1).alias("hit")), ["id", "item"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    run = hit.withColumn("hits", F.sum("hit").over(Window.partitionBy("id").orderBy("rank")))
    return run.groupBy("id").agg(F.sum(F.col("hit") * F.col("hits") / F.col("rank")).alias("s")).join(n, "id").select("id", (F.col("s") / F.col("n")).alias("ap"))


def reciprocal_rank(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """id, rr: one over the place of the first relevant item; 0 where there is none."""
    first = ranked.join(relevant.select("id", "item"), ["id", "item"], "left_semi").groupBy("id").agg(F.min("rank").alias("first"))
    return ranked.select("id").distinct().join(first, "id", "left").select("id", F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"))


def validation_precision(df: DataFrame, cutoff: float, k: int) -> DataFrame:
    """id, ap: each user's validation items (u, i, r, prediction) by falling prediction, relevant at r >= cutoff.

    The sum of hits / place over the first k is divided by the number of relevant items, k at most; users without any
    are left out.
    """
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.round("prediction", 9).desc(), "i"))
    rows = df.select(F.col("u").alias("id"), F.col("i").alias("item"), (F.col("r") >= cutoff).cast("int").alias("hit"), rank.alias("rank"))
    hits = rows.withColumn("hits", F.sum("hit").over(Window.partitionBy("id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
    term = F.when(F.col("rank") <= k, F.col("hit") * F.col("hits") / F.col("rank"))
    return hits.groupBy("id").agg(F.sum(term).alias("s"), F.sum("hit").alias("n")).where("n > 0").select("id", (F.col("s") / F.least("n", F.lit(k))).alias("ap"))
