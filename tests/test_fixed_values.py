"""Small inputs with published results."""

import math

from pyspark.sql import functions as F

from tidegraph.operators import etl, evaluation, factorisation, similarity
from tidegraph.sources import text

# Inputs and results.
RATINGS = "%%MatrixMarket matrix coordinate real general\n5 6 15\n1 1 1\n1 3 .1\n1 4 1\n2 3 1\n2 4 .1\n2 5 1\n3 1 1\n3 2 1\n3 4 1\n4 1 .1\n4 3 1\n4 5 1\n5 4 .1\n5 5 1\n5 6 1\n"
JACCARD = [(3, 1, 0.5), (4, 1, 0.4), (4, 3, 0.4), (5, 3, 0.5), (5, 4, 0.4)]
ITEM_GRAPH = [(2, 1, 2.0), (3, 1, 1.0), (4, 5, 1.0), (6, 7, 1.0)]
WEIGHTED_JACCARD = [(2, 1, 0.666667), (3, 1, 0.333333), (4, 5, 1.0), (6, 7, 1.0)]
RATED = "%%MatrixMarket matrix coordinate real general\n5 4 9\n1 1 1\n1 2 1\n2 3 1\n3 4 1\n4 4 1\n4 1 1\n1 4 1\n2 2 1\n5 3 1\n"
SIMILAR = "%%MatrixMarket matrix coordinate real general\n4 4 5\n1 2 1\n2 3 1\n3 4 1\n1 4 1\n2 2 1\n"
RECOMMENDED = [(1, 3, 2.0), (2, 1, 1.0), (2, 4, 1.0), (3, 1, 1.0), (3, 3, 1.0), (4, 2, 1.0), (4, 3, 1.0), (5, 2, 1.0), (5, 4, 1.0)]
LISTS = "1 1 3\n1 2 4\n1 4 1\n1 3 5\n2 1 3\n2 2 4\n2 6 3\n3 1 1\n4 2 1\n5 6 1\n5 5 1\n5 4 1\n5 3 1 \n"
FIRST_THREE = [(1, [1, 2, 4]), (2, [1, 2, 6]), (3, [1]), (4, [2]), (5, [6, 5, 4])]
RANKED = {2: "1 1 2 3 4\n2 1 2 3 4\n3 1 2 3\n4 1 2 3 4 5", 3: "1 1 3 4\n2 1 2 4\n3 1 3", 4: "1 1 2 3 4 5\n2 1 2 3 4 5\n3 1 2 3 4 5"}
# mean average precision of the first against the second at 1, 3 and 10 over rows 1 to 3
PRECISION = {(2, 3): (1.0, 0.685185, 0.851852), (2, 4): (1.0, 1.0, 0.733333), (3, 2): (1.0, 0.666667, 0.722222), (3, 4): (1.0, 0.666667, 0.533333), (4, 2): (1.0, 1.0, 1.0), (4, 3): (1.0, 0.685185, 0.851852)}
WEIGHTED = [(3, 1, 1, 0.9527821496566151), (4, 1, 2, 0.7040621667749977), (1, 2, 1, 0.9538774735922314), (2, 2, 3, 0.5981585241721892), (3, 2, 1, 0.8407431981130701), (4, 2, 1, 0.4428188422351334), (1, 4, 2, 0.8368196006763403), (2, 4, 2, 0.5187030597249157), (4, 4, 1, 0.02220977857260138)]
WEIGHTED_ERROR = 0.03


def put(tmp_path, name, content):
    p = tmp_path / name
    p.write_text(content)
    return str(p)


def ratings(spark, path):
    return text.matrix_market(spark, path, shift=0).select(F.col("row").alias("u"), F.col("col").alias("i"), F.col("val").alias("r"))


def test_item_similarity(spark, tmp_path):
    path = put(tmp_path, "ratings", RATINGS)
    r = text.matrix_market(spark, path).select((F.col("row") + 1).alias("u"), (F.col("col") + 1).alias("i"), F.col("val").alias("r"))
    got = similarity.similarities(r, min_common=2).select("a", "b", F.round("jaccard", 6)).collect()
    assert sorted(map(tuple, got)) == JACCARD


def test_weighted_item_similarity(spark):
    e = spark.createDataFrame(ITEM_GRAPH, "src long, dst long, weight double")
    assert sorted((a, b, round(s, 6)) for a, b, s in similarity.weighted_jaccard(e).collect()) == WEIGHTED_JACCARD


def test_ratings_from_similarities(spark, tmp_path):
    one = lambda df: df.select(F.col("row") + 1, F.col("col") + 1, "val")
    r = one(text.matrix_market(spark, put(tmp_path, "rated", RATED))).toDF("u", "i", "r")
    s = one(text.matrix_market(spark, put(tmp_path, "similar", SIMILAR))).toDF("a", "b", "sim").where("a <> b")
    got = similarity.ratings_from_similarity(r, s, 10).select("u", "i", F.round("score", 6)).collect()
    assert sorted(map(tuple, got)) == RECOMMENDED


def test_first_of_each_key(spark, tmp_path):
    t = F.split(F.trim("value"), " ")
    lines = text.numbered_lines(spark, put(tmp_path, "lists", LISTS)).select("n", t[0].cast("long").alias("k"), t[1].cast("long").alias("v"))
    got = etl.first_per_key(lines, "k", "n", 3).groupBy("k").agg(F.sort_array(F.collect_list(F.struct("n", "v"))).alias("l")).select("k", "l.v").collect()
    assert sorted(map(tuple, got)) == FIRST_THREE


def test_average_precision(spark):
    def lists(name):
        rows = [(int(x.split()[0]), int(v), k) for x in RANKED[name].split("\n") for k, v in enumerate(x.split()[1:], 1)]
        return spark.createDataFrame(rows, "id long, item long, rank long").where("id <= 3")

    for (a, b), want in PRECISION.items():
        for k, x in zip((1, 3, 10), want, strict=True):
            got = evaluation.average_precision(lists(a), lists(b), k).agg(F.avg("ap")).first()[0]
            assert math.isclose(got, x, abs_tol=2e-6), (a, b, k)


def test_weighted_least_squares(spark):
    r = spark.createDataFrame(WEIGHTED, "u long, i long, w long, r double")
    u, v = factorisation.als(r, 4, 15, reg=0.001, weighted=True)
    p = factorisation.predictions(r, u, v, 4)
    assert evaluation.errors(p).first()["rmse"] <= WEIGHTED_ERROR
