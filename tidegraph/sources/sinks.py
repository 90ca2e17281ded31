"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def delimited(df: DataFrame, path: str, sep: str = "\t") -> None:
    df.write.option("sep", sep).csv(path)


def adjacency(edges: DataFrame, path: str, cassovary: bool = False) -> None:
    rows = edges.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("d"))
    sep = "\n" if cassovary else " "
    rows.select(F.concat_ws(sep, F.concat_ws(" ", F.col("src"), F.size("d")), F.concat_ws(sep, F.transform("d", lambda x: x.cast("string"))))).write.text(path)


def metis(edges: DataFrame, path: str) -> None:
    """A header `vertices edges` and a line of neighbours per vertex 0, 1, ..; edges both ways. Read folder/*."""
    spark = edges.sparkSession
    both = edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst").distinct()
    size = both.agg(F.max("src").alias("top"), F.count("*").alias("m")).first()
    n = 0 if size["top"] is None else size["top"] + 1
    spark.range(1).select(F.lit(f"{n} {size['m'] // 2}")).coalesce(1).write.text(f"{path}/0-head")
    lists = both.groupBy("src").agg(F.concat_ws(" ", F.transform(F.sort_array(F.collect_list("dst")), lambda x: x.cast("string"))).alias("d"))
    rows = spark.range(n).join(lists, F.col("id") == F.col("src"), "left").select("id", F.coalesce("d", F.lit("")).alias("d"))
    rows.orderBy("id").select("d").write.text(f"{path}/1-rows")


def _head(spark, path: str, kind: str, size: str) -> None:
    spark.range(1).select(F.lit(f"%%MatrixMarket matrix {kind} real general\n{size}")).coalesce(1).write.text(f"{path}/0-head")


def matrix_market(df: DataFrame, path: str, rows: int, cols: int, shift: int = 1) -> None:
    """Banner and size row as a file, entries row, col[, time], val as text files beside it. Read folder/*."""
    _head(df.sparkSession, path, "coordinate", f"{rows} {cols} {df.count()}")
    time = ["time"] if "time" in df.columns else []
    df.select(F.concat_ws(" ", F.col("row") + shift, F.col("col") + shift, *time, "val")).write.text(f"{path}/1-entries")


def dense_matrix(df: DataFrame, path: str, rows: int, cols: int) -> None:
    """A Matrix Market array, column by column; places without an entry (row, col, val) are 0. Read folder/*."""
    spark = df.sparkSession
    _head(spark, path, "array", f"{rows} {cols}")
    cells = spark.range(rows * cols).select(F.col("id"), (F.col("id") % rows).alias("row"), F.floor(F.col("id") / rows).alias("col"))
    full = cells.join(df.select(F.col("row").cast("long"), F.col("col").cast("long"), "val"), ["row", "col"], "left")
    full.orderBy("id").select(F.coalesce("val", F.lit(0.0)).cast("string")).write.text(f"{path}/1-entries")


def vector(df: DataFrame, path: str, n: int) -> None:
    """(id, val) as a Matrix Market array of one column. Read folder/*."""
    dense_matrix(df.select(F.col("id").alias("row"), F.lit(0).alias("col"), "val"), path, n, 1)


def scalar(spark, path: str, value: float) -> None:
    """One number as a Matrix Market array. Read folder/*."""
    _head(spark, path, "array", "1 1")
    spark.range(1).select(F.lit(repr(float(value)))).write.text(f"{path}/1-entries")


def predictions(df: DataFrame, path: str, rows: int, cols: int, shift: int = 1) -> None:
    """Test pairs (u, i[, t], prediction) as Matrix Market entries."""
    time = [F.col("t").alias("time")] if "t" in df.columns else []
    matrix_market(df.select(F.col("u").alias("row"), F.col("i").alias("col"), *time, F.col("prediction").alias("val")), path, rows, cols, shift)


def id_map(df: DataFrame, path: str) -> None:
    """(key, id) as lines `key id`."""
    df.select(F.concat_ws(" ", "key", "id")).write.text(path)


def vertex_values(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def component_sizes(labels: DataFrame, path: str) -> None:
    labels.groupBy("label").count().write.csv(path)


def top_lists(df: DataFrame, path: str, key: str, item: str, score: str, k: int) -> None:
    """Ids and values of the k best of each key, a line per key, under ids/ and values/."""
    first = df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.col(score).desc(), item))).where(F.col("_n") <= k)
    best = first.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col("_n"), F.col(score).alias("s"), F.col(item).alias("i")))), lambda x: F.struct(x["s"].alias("s"), x["i"].alias("i"))).alias("b"))
    for name, field in (("ids", "i"), ("values", "s")):
        best.select(F.concat_ws(" ", key, F.concat_ws(" ", F.col("b")[field].cast("array<string>")))).write.text(f"{path}/{name}")
