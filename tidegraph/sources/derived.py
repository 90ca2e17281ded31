"""Graphs and ratings derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def user_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: a user, and the next user who touched the same item; events without an item are left out."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_id", "user_id", F.get_json_object("props", "$.k").cast("long").alias("k")).where("k is not null")
    after = F.lead("user_id").over(Window.partitionBy("k").orderBy("ts", "event_id"))
    return e.select(F.col("user_id").alias("src"), after.alias("dst")).where("src <> dst").distinct()


def user_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """u, i, r: mean value of a user's events on an item."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy(F.col("user_id").alias("u"), F.get_json_object("props", "$.k").cast("long").alias("i")).agg(F.avg("value").alias("r"))


def co_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src < dst: parts that share an order."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey").distinct()
    a, b = li.toDF("o", "src"), li.toDF("o", "dst")
    return a.join(b, "o").where("src < dst").select("src", "dst").distinct()


def weighted(edges: DataFrame) -> DataFrame:
    """edges with an integer weight fixed by their ends."""
    return edges.withColumn("weight", (F.col("src") * 7919 + F.col("dst") * 104729) % 1000)


ITEM = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
SQL = {
    "un": f"un AS (SELECT DISTINCT src, dst FROM (SELECT user_id src, lead(user_id) OVER (PARTITION BY {ITEM} ORDER BY ts, event_id) dst FROM events WHERE {ITEM} IS NOT NULL) WHERE src <> dst)",
    "ui": f"ui AS (SELECT user_id u, {ITEM} i, avg(value) r FROM events GROUP BY 1, 2)",
    "co": "co AS (SELECT DISTINCT a.l_partkey src, b.l_partkey dst FROM lineitem a JOIN lineitem b USING (l_orderkey) WHERE a.l_partkey < b.l_partkey)",
}
