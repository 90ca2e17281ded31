"""Readers of graph, matrix and log formats; load_graph dispatches on the format."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.operators.ordering import row_numbers, running_last

_NO_COMMENT = r"^\s*([#%]|$)"
#: Where a line stands: its file, the block of the file that a task reads, and its place there.
_PLACE = ("_file", "_block", "_row")


def _placed(spark: SparkSession, path: str) -> DataFrame:
    at = [F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()]
    return spark.read.text(path).select("value", *[c.alias(n) for c, n in zip(at, _PLACE, strict=True)])


def numbered_lines(spark: SparkSession, path: str, keep: Column | None = None) -> DataFrame:
    """value, n: lines (those that `keep` lets pass) with their place from 0; files in the order of their paths."""
    lines = _placed(spark, path)
    if keep is not None:
        lines = lines.where(keep)
    return row_numbers(lines, [F.col(c) for c in _PLACE], "n", 0).select("value", "n")


def first_line(spark: SparkSession, path: str) -> list[str] | None:
    """The tokens of the first line that is no comment."""
    got = _placed(spark, path).where(~F.col("value").rlike(_NO_COMMENT)).orderBy(*_PLACE).limit(1).select(F.split(F.trim("value"), r"[\t, ]+").alias("t")).first()
    return None if got is None else list(got["t"])


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(~F.col("value").rlike(_NO_COMMENT))


def _tokens() -> Column:
    return F.split(F.trim("value"), r"[\t, ]+")


def edge_list(spark: SparkSession, path: str, keep_loops: bool = False, max_vertex: int | None = None) -> DataFrame:
    """src, dst, value (0 where absent); comment lines start with # or %; self loops are dropped.

    max_vertex: edges with an id beyond it are dropped.
    """
    t = _tokens()
    out = _lines(spark, path).select(t[0].cast("long").alias("src"), t[1].cast("long").alias("dst"), F.coalesce(F.get(t, 2).cast("double"), F.lit(0.0)).alias("value"))
    if max_vertex is not None:
        out = out.where((F.col("src") <= max_vertex) & (F.col("dst") <= max_vertex))
    return out if keep_loops else out.where("src <> dst")


def multi_value_edge_list(spark: SparkSession, path: str) -> DataFrame:
    """src, dst, values: array from v1:v2:..."""
    t = _tokens()
    return _lines(spark, path).select(t[0].cast("long").alias("src"), t[1].cast("long").alias("dst"), F.transform(F.split(t[2], ":"), lambda x: x.cast("double")).alias("values")).where("src <> dst")


def adjacency_list(spark: SparkSession, path: str) -> DataFrame:
    """src, dst from lines `src n d1 .. dn`; a wrong n is ignored."""
    t = _tokens()
    return _lines(spark, path).select(t[0].cast("long").alias("src"), F.explode(F.transform(F.slice(t, 3, 1 << 30), lambda x: x.cast("long"))).alias("dst")).where("src <> dst")


def metis(spark: SparkSession, path: str, shift: int = 0) -> DataFrame:
    """src <= dst from METIS text: the k-th line after the header lists vertex k's neighbours, ids as read minus shift."""
    lines = numbered_lines(spark, path, ~F.col("value").startswith("%")).where("n > 0")
    pairs = lines.select((F.col("n") - 1).cast("long").alias("src"), F.explode(F.filter(F.split("value", r"\s+"), lambda x: x != "")).alias("d"))
    return pairs.select("src", (F.col("d").cast("long") - shift).alias("dst")).where("src <= dst")


def cassovary(spark: SparkSession, path: str) -> DataFrame:
    """src, dst from `id n` lines, each followed by n lines with a neighbour."""
    t = F.split(F.trim("value"), r"\s+")
    lines = numbered_lines(spark, path, F.trim("value") != "").select("n", F.when(F.size(t) > 1, t[0].cast("long")).alias("head"), t[0].cast("long").alias("dst"))
    return running_last(lines, F.col("head"), [F.col("n")], "src").where("head is null").select("src", "dst")


def binary_edge_list(spark: SparkSession, path: str, value: str | None = None) -> DataFrame:
    """src, dst[, value] from native-endian unsigned 32-bit pairs, with a value of the numpy type if given."""
    dtype = np.dtype([("src", "<u4"), ("dst", "<u4"), *([("value", value)] if value else [])])

    def run(frames):
        import pandas as pd

        for frame in frames:
            for content in frame["content"]:
                a = np.frombuffer(content, dtype)
                cols = {"src": a["src"].astype("int64"), "dst": a["dst"].astype("int64")}
                if value:
                    cols["value"] = a["value"].astype("float64")
                yield pd.DataFrame(cols)

    schema = "src long, dst long" + (", value double" if value else "")
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def matrix_market(spark: SparkSession, path: str, shift: int = 1, allow_zeros: bool = False) -> DataFrame:
    """row, col[, time], val from Matrix Market coordinates (three or four columns); the size row is the first after the comments.

    Entries outside the size row's bounds are dropped, zeros too unless allowed.
    """
    t = _tokens()
    rows = _lines(spark, path).select(t.alias("t"))
    size = first_line(spark, path)
    if size is None:
        raise ValueError("no size row")
    alike = rows.where(F.array_join("t", " ") == " ".join(size))
    body = rows.where(F.array_join("t", " ") != " ".join(size)).union(alike.limit(max(0, alike.count() - 1)))  # entries may read like the size row
    four = body.where(F.size("t") >= 4).limit(1).count() > 0
    cols = [(F.col("t")[0].cast("long") - shift).alias("row"), (F.col("t")[1].cast("long") - shift).alias("col")]
    if four:
        cols += [F.col("t")[2].cast("double").alias("time"), F.col("t")[3].cast("double").alias("val")]
    else:
        cols += [F.coalesce(F.get("t", 2).cast("double"), F.lit(1.0)).alias("val")]
    out = body.select(*cols).where((F.col("row") < int(size[0])) & (F.col("col") < int(size[1])))
    return out if allow_zeros else out.where("val <> 0")


def bipartite(spark: SparkSession, path: str, undirected: bool = False) -> DataFrame:
    """src, dst, value of ratings under a first row `users items edges`; items follow the users; ids from 1."""
    size, t = first_line(spark, path), _tokens()
    if size is None:
        raise ValueError("no size row")
    e = _lines(spark, path).where(F.array_join(_tokens(), " ") != " ".join(size)).select((t[0].cast("long") - 1).alias("src"), (t[1].cast("long") - 1 + int(size[0])).alias("dst"), t[2].cast("double").alias("value"))
    return e.union(e.select("dst", "src", "value")) if undirected else e


def dense_matrix(spark: SparkSession, path: str) -> DataFrame:
    """row, col, val of a Matrix Market array: a size row, then values column by column (one column: a vector)."""
    lines = numbered_lines(spark, path, ~F.col("value").rlike(_NO_COMMENT))
    head = lines.where("n = 0").first()
    if head is None:
        raise ValueError("no size row")
    rows = int(head["value"].split()[0])
    k = F.col("n") - 1
    return lines.where("n > 0").select((k % rows).alias("row"), F.floor(k / rows).alias("col"), F.trim("value").cast("double").alias("val"))


def ratings_with_similarity(spark: SparkSession, ratings: str, similarities: str, first_item: int | None = None) -> DataFrame:
    """src, dst, value, kind: ratings (0) from users to items that follow them, and item pairs (1); self pairs are dropped.

    first_item: the vertex of item 0; without it the number of users in the size row of ratings.
    """
    size = first_line(spark, ratings)
    if size is None:
        raise ValueError("no size row")
    users = int(size[0]) if first_item is None else first_item
    r = matrix_market(spark, ratings).select(F.col("row").alias("src"), (F.col("col") + users).alias("dst"), F.col("val").alias("value"), F.lit(0).alias("kind"))
    s = matrix_market(spark, similarities).where("row <> col").select((F.col("row") + users).alias("src"), (F.col("col") + users).alias("dst"), F.col("val").alias("value"), F.lit(1).alias("kind"))
    return r.union(s)


def feature_rows(spark: SparkSession, path: str, sep: str = r"\s+") -> DataFrame:
    """from, to, features, rating from lines `from to f1 .. fn rating`."""
    t = F.split(F.trim("value"), sep)
    return _lines(spark, path).select(t[0].alias("from"), t[1].alias("to"), F.slice(t, 3, F.size(t) - 3).alias("features"), F.element_at(t, -1).cast("double").alias("rating"))


def feature_table(spark: SparkSession, path: str, names: list[str] | None = None, sep: str = ",", json: bool = False, source: str = "from", target: str = "to", value: str = "rating", features: list[str] | None = None) -> DataFrame:
    """from, to, features (a map of names to raw values), rating.

    names: of the columns; None: the first line has them. json: each line is an object instead. features: the names to
    keep; None: all but source, target and value. Missing values are left out of the map.
    """
    if json:
        cells = F.from_json("value", "map<string,string>")
        rows = spark.read.text(path).where("trim(value) <> ''").select(cells.alias("c"))
    else:
        head = None
        lines = numbered_lines(spark, path, F.trim("value") != "") if names is None else spark.read.text(path).where("trim(value) <> ''")
        if names is None:
            head = lines.where("n = 0").first()
            if head is None:
                raise ValueError("no header")
            names, lines = [x.strip() for x in head["value"].split(sep)], lines.where("n > 0")
        t = F.transform(F.split("value", F.lit("\\Q" + sep + "\\E")), lambda x: F.trim(x))
        rows = lines.select(F.map_from_arrays(F.array(*[F.lit(x) for x in names]), F.slice(t, 1, len(names))).alias("c"))
    wanted = (lambda k: k.isin(features)) if features is not None else (lambda k: ~k.isin([source, target, value]))
    cell = lambda k: F.element_at("c", F.lit(k))
    return rows.select(cell(source).alias("from"), cell(target).alias("to"), F.map_filter("c", lambda k, v: wanted(k) & v.isNotNull() & (v != "")).alias("features"), cell(value).cast("double").alias("rating"))


def feature_nodes(rows: DataFrame) -> DataFrame:
    """feature, value, node: each feature's distinct values as nodes from 0, in the order of (feature, value)."""
    pairs = rows.select(F.explode("features").alias("feature", "value")).distinct()
    return row_numbers(pairs, [F.col("feature"), F.col("value")], "node", 0)


def node_features(spark: SparkSession, path: str) -> DataFrame:
    """id, features (array of numbers) from lines `id f1 f2 ..`."""
    t = _tokens()
    return _lines(spark, path).select(t[0].cast("long").alias("id"), F.transform(F.slice(t, 2, 1 << 30), lambda x: x.cast("double")).alias("features"))


def node_links(spark: SparkSession, path: str) -> DataFrame:
    """src, dst, value both ways from lines `a b [weight]`; a missing weight is 1; self links are dropped."""
    t = _tokens()
    e = _lines(spark, path).select(t[0].cast("long").alias("src"), t[1].cast("long").alias("dst"), F.coalesce(F.get(t, 2).cast("double"), F.lit(1.0)).alias("value")).where("src <> dst")
    return e.union(e.select("dst", "src", "value"))


def config(spark: SparkSession, path: str, **over) -> dict[str, str]:
    """Settings of a file of `key = value` lines (comments start with #), keyword arguments before them."""
    lines = spark.read.text(path).where("trim(value) <> '' and not startswith(trim(value), '#')")
    pairs = (r["value"].split("=", 1) for r in lines.collect())
    return {**{k.strip(): v.strip() for k, v in pairs}, **{k: str(v) for k, v in over.items()}}


def id_map(spark: SparkSession, path: str) -> DataFrame:
    t = F.split(F.trim("value"), r"\s+", 2)
    return spark.read.text(path).where("trim(value) <> ''").select(t[0].alias("key"), F.get(t, 1).cast("long").alias("id"))


def call_records(spark: SparkSession, path: str) -> DataFrame:
    """from, to, epoch, duration from tab-separated call records (times in UTC)."""
    t = F.split("value", "\t")
    return spark.read.text(path).select(t[1].cast("long").alias("from"), t[2].cast("long").alias("to"), F.unix_timestamp(t[0], "yyyy-MM-dd HH:mm:ss").alias("epoch"), t[4].cast("long").alias("duration"))


def ip_pairs(spark: SparkSession, path: str) -> DataFrame:
    """src, dst, attr; rows whose addresses are no dotted quads are skipped."""
    quad = r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?!$)|$)){4}$"
    t = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).select(F.get(t, 0).alias("src"), F.get(t, 1).alias("dst"), F.get(t, 2).alias("attr")).where(F.col("src").rlike(quad) & F.col("dst").rlike(quad))


def tweets(spark: SparkSession, path: str) -> DataFrame:
    """ts, user, text from T/U/W triples."""
    records = spark.read.option("lineSep", "\n\n").text(path)
    pick = lambda tag: F.trim(F.regexp_extract("value", rf"(?m)^{tag}\s+(.*)$", 1))
    return records.select(F.to_timestamp(pick("T"), "yyyy-MM-dd HH:mm:ss").alias("ts"), F.lower(F.regexp_extract(pick("U"), r"([^/]+)/?$", 1)).alias("user"), pick("W").alias("text")).where("user <> ''")


FORMATS = {
    "edgelist": edge_list, "multivalue": multi_value_edge_list, "adjlist": adjacency_list, "metis": metis, "cassovary": cassovary, "binedgelist": binary_edge_list,
    "matrixmarket": matrix_market, "array": dense_matrix, "bipartite": bipartite, "features": feature_rows, "featuretable": feature_table, "nodefeatures": node_features,
    "nodelinks": node_links, "cdr": call_records, "ips": ip_pairs, "tweets": tweets,
}


def load_graph(spark: SparkSession, path: str, fmt: str, cache: str | None = None, **options) -> DataFrame:
    """Reads a format by its name. cache: a folder; what was read is kept there as Parquet and used until path is newer."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}; known: {', '.join(FORMATS)}")
    if cache is None:
        return FORMATS[fmt](spark, path, **options)
    made = _modified(spark, f"{cache}/_SUCCESS")
    if made is None or made < (_modified(spark, path) or 0):
        FORMATS[fmt](spark, path, **options).write.mode("overwrite").parquet(cache)
    return spark.read.parquet(cache)


def _modified(spark: SparkSession, path: str) -> int | None:
    """The latest time of change of a file, or of the files in a folder; None if there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    files, latest = fs.listFiles(at, True), None
    while files.hasNext():
        t = files.next().getModificationTime()
        latest = t if latest is None else max(latest, t)
    return latest
