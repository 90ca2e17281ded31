"""Small text and log operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.functions.scalar import tokens
from tidegraph.operators.ordering import row_numbers


def sum_by_pair(df: DataFrame, a: str, b: str, value: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.sum(value).alias("total"))


def frequencies(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"))


def contingency(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """mi, entropy (of a) in bits, and their ratio (null at 0.001 or less)."""
    n = df.count()
    ab = df.groupBy(a, b).agg(F.count("*").alias("c"))
    x, y = df.groupBy(a).agg(F.count("*").alias("ca")), df.groupBy(b).agg(F.count("*").alias("cb"))
    mi = ab.join(x, a).join(y, b).agg(F.sum(F.col("c") / n * F.log2(F.col("c") * n / (F.col("ca") * F.col("cb")))).alias("mi"))
    h = x.agg((-F.sum(F.col("ca") / n * F.log2(F.col("ca") / n))).alias("entropy"))
    return mi.join(h).select("mi", "entropy", F.when(F.col("mi") / F.col("entropy") > 1e-3, F.col("mi") / F.col("entropy")).alias("ratio"))  # a row each


def consecutive_ids(df: DataFrame, column: str, base: int = 1) -> DataFrame:
    """value, id: distinct values numbered from base in ascending order."""
    values = df.select(F.col(column).alias("value")).where(F.col(column).isNotNull()).distinct()
    return row_numbers(values, [F.col("value")], "id", base)


def first_seen_ids(df: DataFrame, columns: list[str], order: str, base: int = 1) -> DataFrame:
    """value, id: distinct values of the columns, as one domain, numbered from base as they are first met (by order, then column)."""
    each = [df.select(F.col(c).cast("string").alias("value"), F.struct(F.col(order).alias("o"), F.lit(k).alias("k")).alias("at")) for k, c in enumerate(columns)]
    met = each[0]
    for more in each[1:]:
        met = met.union(more)
    first = met.where("value is not null").groupBy("value").agg(F.min("at").alias("at"))
    return row_numbers(first, [F.col("at.o"), F.col("at.k"), F.col("value")], "id", base).select("value", "id")


def token_counts(df: DataFrame, line: str, text: str, low: int = 1, high: int | None = None) -> DataFrame:
    """line, token, n: tokens cut at punctuation and white space; after a line's first, tokens of one character go."""
    rows = df.select(F.col(line).alias("line"), F.explode(tokens(F.col(text))).alias("token"))
    out = rows.groupBy("line", "token").agg(F.count("*").alias("n")).where(F.col("n") >= low)
    return out if high is None else out.where(F.col("n") <= high)


def first_per_key(df: DataFrame, key: str, order: str, k: int) -> DataFrame:
    """The first k rows of each key by order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("_n") <= k).drop("_n")


def last_per_key(df: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    return df.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def fold(df: DataFrame, key: str, k: int, which: int) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows: validation where key modulo k is `which`."""
    held = F.pmod(F.col(key), F.lit(k)) == which
    return df.where(~held), df.where(held)


def mentions(tweets: DataFrame) -> DataFrame:
    """src, dst, kind from (user, text): 1 for a mention, 2 for a retweet; names of up to 15 characters without / and :"""
    rows = tweets.select(F.col("user").alias("src"), F.explode(F.regexp_extract_all("text", F.lit(r"(RT )?@([A-Za-z0-9_]{1,15})(?![\w/])"), F.lit(0))).alias("m"))
    return rows.select("src", F.lower(F.regexp_extract("m", r"@(\w+)", 1)).alias("dst"), F.when(F.col("m").startswith("RT "), 2).otherwise(1).alias("kind"))


def train_given(edges: DataFrame, least: int, given: int, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Users (src) with at least `least` edges: `given` drawn ones to train, the others to test."""
    n = F.count("*").over(Window.partitionBy("src"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.md5(F.concat_ws("|", "src", "dst", F.lit(seed))), "dst"))
    rows = edges.withColumns({"_n": n, "_k": rank}).where(F.col("_n") >= least)
    return rows.where(F.col("_k") <= given).drop("_n", "_k"), rows.where(F.col("_k") > given).drop("_n", "_k")


def string_edges(lines: DataFrame, two_domains: bool = False) -> tuple[DataFrame, DataFrame]:
    """Edges (src, dst) and ids (side, value, id) of lines (n, value) `name name1 name2 ..`.

    Names get ids from 1 as they are first met, line by line and from left to right; two_domains: first names and the
    others apart (side 0 and 1).
    """
    each = lines.select("n", F.posexplode(F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "")).alias("k", "name"))
    each = each.withColumn("side", F.when(F.lit(two_domains) & (F.col("k") > 0), 1).otherwise(0))
    first = each.groupBy("side", "name").agg(F.min(F.struct("n", "k")).alias("at"))
    one = lambda s: row_numbers(first.where(F.col("side") == s), [F.col("at.n"), F.col("at.k")], "id").select("side", F.col("name").alias("value"), "id")
    ids = one(0).union(one(1)) if two_domains else one(0)
    heads = each.where("k = 0").select("n", F.col("name").alias("head")).join(ids.where("side = 0").select(F.col("value").alias("head"), F.col("id").alias("src")), "head")
    tails = each.where("k > 0").select("n", F.col("name").alias("tail"), "side").join(ids.select("side", F.col("value").alias("tail"), F.col("id").alias("dst")), ["side", "tail"])
    return tails.join(heads, "n").select("src", "dst"), ids


def ips_to_ids(rows: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """Edges (src, dst, attr) and ids (value, id) of address pairs (src, dst, attr): one domain of ids from 1, as first met."""
    ids = first_seen_ids(rows, ["src", "dst"], order)
    of = lambda c: ids.select(F.col("value").alias(c), F.col("id").alias(f"{c}_id"))
    return rows.join(of("src"), "src").join(of("dst"), "dst").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "attr"), ids


def token_ids(df: DataFrame, line: str, text: str, low: int = 1, high: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Counts (line, id, n) within the thresholds, and terms (token, id): ids from 1 as tokens are first met."""
    each = df.select(F.col(line).alias("line"), F.posexplode(tokens(F.col(text))).alias("k", "token"))
    first = each.groupBy("token").agg(F.min(F.struct("line", "k")).alias("at"))
    ids = row_numbers(first, [F.col("at.line"), F.col("at.k")], "id").select("token", "id")
    counts = each.groupBy("line", "token").agg(F.count("*").alias("n")).where(F.col("n") >= low)
    counts = counts if high is None else counts.where(F.col("n") <= high)
    return counts.join(ids, "token").select("line", "id", "n"), ids


def tweet_counts(tweets: DataFrame) -> DataFrame:
    """user, tweets, mentions, retweets."""
    said = tweets.groupBy("user").agg(F.count("*").alias("tweets"))
    m = mentions(tweets).groupBy(F.col("src").alias("user")).agg(F.count(F.when(F.col("kind") == 1, 1)).alias("mentions"), F.count(F.when(F.col("kind") == 2, 1)).alias("retweets"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return said.join(m, "user", "left").select("user", "tweets", zero("mentions"), zero("retweets"))
