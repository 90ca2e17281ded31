"""Models on small inputs: they fit what they should, equal plain versions, and are stable."""

import math

import numpy as np
from pyspark.sql import functions as F

from tidegraph.operators import factorisation, models, similarity


def ratings(spark):
    rng = np.random.default_rng(0)
    p, q = rng.normal(0, 1, (12, 2)), rng.normal(0, 1, (9, 2))
    return spark.createDataFrame([(u, i, float(3 + p[u] @ q[i]), int((u + 2 * i) % 4)) for u in range(12) for i in range(9) if (u * i) % 5 != 3], "u long, i long, r double, t long")


def rmse(df):
    return df.agg(F.sqrt(F.avg((F.col("r") - F.col("prediction")) ** 2))).first()[0]


def spread(df):
    return df.agg(F.stddev_pop("r")).first()[0]


def test_coordinates_and_split_ids(spark, monkeypatch):
    r = ratings(spark)
    assert rmse(factorisation.predictions(r, *factorisation.als(r, 3, 6, reg=0.01, coordinate=True), 3)) < spread(r) * 0.5
    whole = factorisation.als(r, 2, 2)
    monkeypatch.setattr(factorisation, "ROWS_A_TASK", 3)
    for a, b in zip(whole, factorisation.als(r, 2, 2), strict=True):
        b = {x["id"]: x["f"] for x in b.collect()}
        assert all(np.allclose(x["f"], b[x["id"]]) for x in a.collect())


def test_gradient_variants(spark):
    r = ratings(spark)
    base = spread(r)
    u, v, m = factorisation.sgd(r, 2, 6, rate=0.05, decay=1.0, bias=True, implicit=True, blocks=2)
    assert rmse(factorisation.predictions(r, u, v, 2, m, implicit_from=r)) < base * 0.9
    low, high = -4.0, 10.0
    for loss in ("square", "abs", "logistic"):
        u, v, m = factorisation.sgd(r, 2, 6, rate=0.02, decay=0.7, bias=True, low=low, high=high, logistic=True, loss=loss)
        got = factorisation.predictions(r, u, v, 2, m, low, high, logistic=True)
        assert rmse(got) < base and got.where((F.col("prediction") < low) | (F.col("prediction") > high)).count() == 0


def test_factorisation_machine(spark):
    r = models.with_last_item(ratings(spark)).withColumn("row", F.col("u") * 100 + F.col("i"))
    r = r.withColumn("age", F.col("u") / 12).withColumn("tags", F.concat(F.lit("a:"), F.col("u") % 2, F.lit(" b:"), F.col("i") % 3))
    x = models.design(r, "row", ["u", "i", "t", "last"], ["age"], "tags")
    assert x.where("feature = 'a:1'").count() == r.where("u % 2 = 1").count()
    w, m = models.fm(x, r, 3, 12, rate=0.5, decay=1.0)
    assert rmse(models.fm_predict(x, r, w, m, 3)) < spread(r) * 0.9
    w, m = models.fm(x, r, 3, 6, rate=0.5, decay=1.0, low=-4.0, high=10.0, logistic=True, loss="logistic")
    assert rmse(models.fm_predict(x, r, w, m, 3, -4.0, 10.0, True)) < spread(r)
    unseen = r.limit(1).withColumn("row", F.lit(-1).cast("long"))
    assert math.isclose(models.fm_predict(x, unseen, w, m, 3, -4.0, 10.0, True).first()["prediction"], -4 + 14 / (1 + math.exp(-m)))


def test_machine_gradient_equals_plain(spark):
    """One round against the sums worked out row by row."""
    r = spark.createDataFrame([(0, 5.0), (1, 1.0)], "row long, r double")
    x = spark.createDataFrame([(0, "a", 1.0), (0, "b", 2.0), (1, "a", 1.0)], "row long, feature string, x double")
    w0, _ = models.fm(x, r, 2, 0)
    w1, mean = models.fm(x, r, 2, 1, rate=0.1, reg_bias=0.01, reg_factor=0.02)
    old = {t["feature"]: (t["b"], np.array(t["v"])) for t in w0.collect()}
    grad = {k: [0.0, np.zeros(2), 0.0, np.zeros(2), 0] for k in old}
    for row, target in ((("a", 1.0), ("b", 2.0)), 5.0), ((("a", 1.0),), 1.0):
        s = sum(old[k][1] * v for k, v in row)
        e = target - (mean + sum(old[k][0] * v for k, v in row) + 0.5 * (s @ s - sum((old[k][1] * v) @ (old[k][1] * v) for k, v in row)))
        for k, v in row:
            rest, g, m = s - old[k][1] * v, grad[k], 3 * len(row)
            grad[k] = [g[0] + e * v, g[1] + e * v * rest, g[2] + v * v * m, g[3] + v * v * rest * rest * m, g[4] + 1]
    for t in w1.collect():
        b, v = old[t["feature"]]
        g = grad[t["feature"]]
        assert math.isclose(t["b"], b + 0.1 / (1 + 0.1 * (g[2] + 0.01 * g[4])) * (g[0] - 0.01 * g[4] * b), abs_tol=1e-12)
        assert np.allclose(t["v"], v + 0.1 / (1 + 0.1 * (g[3] + 0.02 * g[4])) * (g[1] - 0.02 * g[4] * v))


def test_time_model(spark):
    r = ratings(spark)
    side, mean = models.time_svd(r, 2, 10, rate=0.5)
    got = models.time_svd_predict(r, r, side, mean, 2)
    assert got.count() == r.count() and rmse(got) < spread(r) * 0.97
    new = spark.createDataFrame([(99, 99, 99, 1.0)], "u long, i long, t long, r double")
    assert math.isclose(models.time_svd_predict(new, r, side, mean, 2).first()["prediction"], mean)


def test_ranking_objective_rises(spark):
    _, _, values = models.climf(ratings(spark), 3, 4, rate=0.05, cutoff=3.0)
    assert values[-1] > values[0]


def test_boltzmann_broadcasts_no_row_per_rating(spark, monkeypatch):
    """Files of samples are far smaller than their rows; their join must not go by the files' size."""
    plans, write = [], models.written
    monkeypatch.setattr(models, "written", lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or write(df, name))
    r = spark.createDataFrame([(u, i, float((u + i) % 5)) for u in range(40) for i in range(10)], "u long, i long, r double")
    models.boltzmann(r, 5, 1.0, 2, 1)
    moved = [p for name, p in plans if name == "items"][-1]
    assert "SortMergeJoin [u#" in moved and "BroadcastHashJoin [u#" not in moved


def test_boltzmann(spark):
    r = spark.createDataFrame([(u, i, 4.0 if (u + i) % 2 else 1.0) for u in range(40) for i in range(8) if (u * 3 + i) % 7], "u long, i long, r double")
    items = models.boltzmann(r, 5, 1.0, 4, 15, rate=0.5, reg=0.001, decay=1.0)
    got = models.boltzmann_predict(r, r, items, 5, 4)
    assert rmse(got) < spread(r) * 0.9
    assert models.boltzmann_predict(spark.createDataFrame([(1, 999)], "u long, i long"), r, items, 5, 4).first()["prediction"] is None


def test_sampled_factors(spark):
    r = ratings(spark)
    _, _, got = models.sampled_factors(r, r, 3, 14, 8)
    assert got.count() == r.count() and rmse(got) < spread(r) * 0.5


def test_topics(spark):
    d = spark.createDataFrame([(d, f"{'xy'[d % 2]}{k % 4}") for d in range(16) for k in range(24)], "d long, w string")
    start, end = models.topics(d, 2, 0), models.topics(d, 2, 10, alpha=0.1)
    assert end.count() == d.count()
    assert models.topic_likelihood(end, 2) > models.topic_likelihood(start, 2)
    best = {t["z"]: set() for t in models.topic_words(end, 4).collect()}
    for t in models.topic_words(end, 4).collect():
        best[t["z"]].add(t["w"][0])
    assert all(len(x) == 1 for x in best.values())
    got = {(t["z"], t["w"]): t["n"] for t in end.groupBy("z", "w").agg(F.count("*").alias("n")).collect()}
    want = 0.0
    for z in {z for z, _ in got}:
        ns = [n for (y, _), n in got.items() if y == z]
        want += math.lgamma(0.8) - math.lgamma(sum(ns) + 0.8) + sum(math.lgamma(n + 0.1) - math.lgamma(0.1) for n in ns)
    assert math.isclose(models.topic_likelihood(end, 2), want)


def test_recommend_equals_plain(spark):
    rng = np.random.default_rng(3)
    p, q = rng.normal(0, 1, (20, 3)).round(1), rng.normal(0, 1, (15, 3)).round(1)
    known = {(u, i) for u in range(20) for i in range(15) if (u * 7 + i) % 3 == 0}
    df = lambda m, c: spark.createDataFrame([(k, f.tolist()) for k, f in enumerate(m)], f"{c} long, f array<double>")
    got = similarity.recommend(df(p, "u"), df(q, "i"), spark.createDataFrame(sorted(known), "u long, i long"), 4, block=6)
    want = set()
    for u in range(20):
        free = sorted((round(-float(p[u] @ q[i]), 9), i) for i in range(15) if (u, i) not in known)[:4]
        want |= {(u, i, k + 1) for k, (_, i) in enumerate(free)}
    assert {(t["u"], t["i"], t["rank"]) for t in got.collect()} == want


def test_empty(spark):
    none = spark.createDataFrame([], "u long, i long, r double, t long")
    assert all(x.count() == 0 for x in factorisation.als(none, 2, 1))
    assert models.fm(models.design(none.withColumn("row", F.col("u")), "row", ["u"]), none.withColumn("row", F.col("u")), 2, 1)[0].count() == 0
    assert models.boltzmann(none, 5, 1.0, 2, 1).count() == 0
    assert models.topics(spark.createDataFrame([], "d long, w string"), 2, 1).count() == 0
    assert similarity.recommend(spark.createDataFrame([], "u long, f array<double>"), spark.createDataFrame([], "i long, f array<double>"), none, 3).count() == 0
