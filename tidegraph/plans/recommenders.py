"""Queries of factor models' steps from given factors, recommendations and measures, with SQL written out for two dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.operators import etl, evaluation, factorisation, similarity
from tidegraph.plans.registry import _PAIRS, query, rounded
from tidegraph.sources.derived import user_item

#: Given factors: fixed fractions of the ids.
_FU = "fu AS (SELECT DISTINCT u, (1 + u % 7) / 7.0::DOUBLE p0, (1 + u % 5) / 10.0::DOUBLE p1, (u % 11 - 5) / 10.0::DOUBLE bu FROM ui)"
_FI = "fi AS (SELECT DISTINCT i, (1 + i % 6) / 6.0::DOUBLE q0, (1 + i % 4) / 8.0::DOUBLE q1, (i % 9 - 4) / 10.0::DOUBLE bi FROM ui)"


def _fractions(ids: DataFrame, c: str, *mods: tuple[int, int, float]) -> DataFrame:
    return ids.select(F.col(c).alias("id")).distinct().select("id", F.array(*[(add + F.col("id") % m) / F.lit(over) for m, add, over in mods]).alias("f"))


def _users(r: DataFrame, bias: bool = False) -> DataFrame:
    return _fractions(r, "u", (7, 1, 7.0), (5, 1, 10.0), *([(11, -5, 10.0)] if bias else []))


def _items(r: DataFrame, bias: bool = False) -> DataFrame:
    return _fractions(r, "i", (6, 1, 6.0), (4, 1, 8.0), *([(9, -4, 10.0)] if bias else []))


def _two(df: DataFrame, places: int = 6) -> DataFrame:
    return rounded(df.select("id", F.col("f")[0].alias("f0"), F.col("f")[1].alias("f1")), "f0", "f1", places=places)


def _sums(weight: str = "1.0", r: str = "r", q0: str = "q0", q1: str = "q1", of: str = "ui JOIN fi USING (i)") -> str:
    return f"g AS (SELECT u id, count(*) n, sum({weight} * {q0} * {q0}) a, sum({weight} * {q0} * {q1}) b, sum({weight} * {q1} * {q1}) c, sum({weight} * {r} * {q0}) y0, sum({weight} * {r} * {q1}) y1 FROM {of} GROUP BY 1)"


def _solved(reg: str) -> str:
    det = f"((a + {reg}) * (c + {reg}) - b * b)"
    return f" SELECT id, round((y0 * (c + {reg}) - y1 * b) / {det}, 6) AS f0, round((y1 * (a + {reg}) - y0 * b) / {det}, 6) AS f1 FROM g"


@query("als_step", f", {_FI}, {_sums()}" + _solved("0.065"), ("ui",))
def _(spark, d):
    """Users' factors that are the least squares for given items'."""
    r = user_item(spark, d)
    return _two(factorisation.half_step(r, _items(r), "u", "i"))


@query("als_step_by_degree", f", {_FI}, {_sums()}" + _solved("0.065 * n"), ("ui",))
def _(spark, d):
    r = user_item(spark, d)
    return _two(factorisation.half_step(r, _items(r), "u", "i", by_degree=True))


@query("weighted_als_step", f", {_FI}, {_sums('(1.0 + (u + i) % 3)')}" + _solved("0.065"), ("ui",))
def _(spark, d):
    r = user_item(spark, d).withColumn("w", (F.col("u") + F.col("i")) % 3 + 1.0)
    return _two(factorisation.half_step(r, _items(r), "u", "i", weighted=True))


@query("coordinate_als_step", f", {_FI}, {_FU}, {_sums()}, h AS (SELECT g.*, p1, (y0 - b * p1) / (0.065 + a) x0 FROM g JOIN fu ON fu.u = g.id) SELECT id, round(x0, 6) AS f0, round((y1 - b * x0) / (0.065 + c), 6) AS f1 FROM h", ("ui",))
def _(spark, d):
    """One sweep from given factors of the users."""
    r = user_item(spark, d)
    return _two(factorisation.half_step(r, _items(r), "u", "i", coordinate=True, own=_users(r)))


@query("sparse_als_step", f", {_FI}, {_sums()}, s AS ({_solved('0.065')[1:]}) SELECT id, CASE WHEN abs(f0) >= abs(f1) THEN f0 ELSE 0.0 END AS f0, CASE WHEN abs(f0) >= abs(f1) THEN 0.0 ELSE f1 END AS f1 FROM s", ("ui",))
def _(spark, d):
    """One entry of two: matching pursuit takes both places at first and keeps the larger entry."""
    r = user_item(spark, d)
    return _two(factorisation.half_step(r, _items(r), "u", "i", keep=1))


_DESIGN = "(SELECT ui.u, ui.i, r, q0 * (1 + (ui.u + 3 * ui.i) % 7) / 7.0 z0, q1 * (1 + (ui.u + 3 * ui.i) % 7) / 7.0 z1 FROM ui JOIN fi USING (i))"


@query("tensor_als_step", f", {_FI}, {_sums(q0='z0', q1='z1', of=_DESIGN)}" + _solved("0.065"), ("ui",))
def _(spark, d):
    """Users' factors against the products of items' and times' factors."""
    r = user_item(spark, d).withColumn("t", (F.col("u") + 3 * F.col("i")) % 7)
    times = r.select(F.col("t").alias("id")).distinct().select("id", F.array(*[(1 + F.col("id")) / 7.0] * 2).alias("f"))
    rows = r.join(_items(r).toDF("i", "fx"), "i").join(times.toDF("t", "fy"), "t")
    rows = rows.select("u", "r", (F.col("u") * 1000 + F.col("i")).alias("z"), F.zip_with("fx", "fy", lambda x, y: x * y).alias("f"))
    return _two(factorisation.half_step(rows.select("u", "z", "r"), rows.select(F.col("z").alias("id"), "f"), "u", "z"))


@query("nmf_step", f", {_FU}, {_FI}, t AS (SELECT sum(q0) t0, sum(q1) t1 FROM fi), g AS (SELECT u, any_value(p0) p0, any_value(p1) p1, sum(abs(r) / greatest(p0 * q0 + p1 * q1, 1e-8) * q0) s0, sum(abs(r) / greatest(p0 * q0 + p1 * q1, 1e-8) * q1) s1 FROM ui JOIN fu USING (u) JOIN fi USING (i) GROUP BY 1) SELECT u AS id, round(greatest(p0 * s0 / t0, 1e-8), 6) AS f0, round(greatest(p1 * s1 / t1, 1e-8), 6) AS f1 FROM g, t", ("ui",))
def _(spark, d):
    r = user_item(spark, d).withColumn("r", F.abs("r"))
    return _two(factorisation.nmf_half(r, _users(r), _items(r), "u", "i", 2))


@query("factor_sums", f", {_FI} SELECT round(sum(q0), 6) AS f0, round(sum(q1), 6) AS f1 FROM fi", ("ui",))
def _(spark, d):
    return rounded(factorisation.factor_sums(_items(user_item(spark, d)), 2).toDF("f0", "f1"), "f0", "f1")


@query("normal_equations", f", {_FI}, {_sums()} SELECT id, n, round(a, 8) AS a, round(b, 8) AS b, round(c, 8) AS c, round(y0, 7) AS y0, round(y1, 7) AS y1 FROM g", ("ui",))
def _(spark, d):
    """Sums of products of factors and of factors with ratings, per user."""
    r = user_item(spark, d)
    g = factorisation.normal_equations(r, _items(r), "u", "i", 2)
    return rounded(rounded(g.toDF("id", "n", "a", "b", "c", "y0", "y1"), "a", "b", "c", places=8), "y0", "y1", places=7)


_DOT = "p0 * q0 + p1 * q1"
_ALL = f", {_FU}, {_FI}, m AS (SELECT avg(r) m FROM ui)"


@query("predictions_of_factors", _ALL + f" SELECT u, i, round({_DOT}, 6) AS prediction FROM ui JOIN fu USING (u) JOIN fi USING (i)", ("ui",))
def _(spark, d):
    r = user_item(spark, d)
    return rounded(factorisation.predictions(r, _users(r), _items(r), 2).select("u", "i", "prediction"), "prediction")


@query("predictions_with_biases", _ALL + f" SELECT u, i, round(least(greatest({_DOT} + m + bu + bi, 49.0), 51.0), 6) AS prediction FROM ui JOIN fu USING (u) JOIN fi USING (i), m", ("ui",))
def _(spark, d):
    """Bounded to 49..51."""
    r = user_item(spark, d)
    mean = r.agg(F.avg("r")).first()[0]
    return rounded(factorisation.predictions(r, _users(r, True), _items(r, True), 2, mean, 49.0, 51.0).select("u", "i", "prediction"), "prediction")


@query("predictions_by_logistic_link", _ALL + f" SELECT u, i, round(1 + 98 / (1 + exp(-({_DOT} + 0.25 + bu + bi))), 6) AS prediction FROM ui JOIN fu USING (u) JOIN fi USING (i)", ("ui",))
def _(spark, d):
    r = user_item(spark, d)
    return rounded(factorisation.predictions(r, _users(r, True), _items(r, True), 2, 0.25, 1.0, 99.0, logistic=True).select("u", "i", "prediction"), "prediction")


@query("predictions_with_implicit_factors", _ALL + ", z AS (SELECT u, sum((i % 3) / 10.0) / sqrt(count(*)) z0, sum((i % 2) / 10.0) / sqrt(count(*)) z1 FROM ui GROUP BY 1) SELECT ui.u, ui.i, round((p0 + z0) * q0 + (p1 + z1) * q1 + m + bu + bi, 6) AS prediction FROM ui JOIN fu USING (u) JOIN fi USING (i) JOIN z USING (u), m", ("ui",))
def _(spark, d):
    r = user_item(spark, d)
    items = _fractions(r, "i", (6, 1, 6.0), (4, 1, 8.0), (9, -4, 10.0), (3, 0, 10.0), (2, 0, 10.0))
    mean = r.agg(F.avg("r")).first()[0]
    return rounded(factorisation.predictions(r, _users(r, True), items, 2, mean, implicit_from=r).select("u", "i", "prediction"), "prediction")


@query("predictions_of_unseen", _ALL + ", x AS (SELECT u, i FROM ui UNION SELECT u + 100000, i FROM ui UNION SELECT u, i + 100000 FROM ui) SELECT x.u, x.i, round(coalesce(p0, 1) * coalesce(q0, 1) + coalesce(p1, 1) * coalesce(q1, 1) + 1.5 + coalesce(bu, 0) + coalesce(bi, 0), 6) AS prediction FROM x LEFT JOIN fu ON fu.u = x.u LEFT JOIN fi ON fi.i = x.i", ("ui",))
def _(spark, d):
    """Ids without factors count as ones without bias."""
    r = user_item(spark, d)
    x = r.select("u", "i")
    x = x.union(x.select(F.col("u") + 100000, "i")).union(x.select("u", F.col("i") + 100000))
    return rounded(factorisation.predictions(x, _users(r, True), _items(r, True), 2, 1.5), "prediction")


def _top_sql(score: str) -> str:
    return f", s AS (SELECT fu.u, fi.i, {score} score FROM fu CROSS JOIN fi, m WHERE NOT EXISTS (SELECT 1 FROM ui WHERE ui.u = fu.u AND ui.i = fi.i)), t AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY round(score, 9) DESC, i) n FROM s)"


@query("recommendations", _ALL + _top_sql(_DOT) + " SELECT u, i, round(score, 6) AS score, n::INT AS rank FROM t WHERE n <= 10", ("ui",))
def _(spark, d):
    r = user_item(spark, d)
    return rounded(similarity.recommend(_users(r).toDF("u", "f"), _items(r).toDF("i", "f"), r, 10), "score")


@query("recommendations_with_biases", _ALL + _top_sql(f"{_DOT} + m + bu + bi") + " SELECT u, i, round(score, 6) AS score, n::INT AS rank FROM t WHERE n <= 10", ("ui",))
def _(spark, d):
    r = user_item(spark, d)
    mean = r.agg(F.avg("r")).first()[0]
    u, v = similarity.with_biases(_users(r, True), _items(r, True), 2, mean)
    return rounded(similarity.recommend(u.toDF("u", "f"), v.toDF("i", "f"), r, 10), "score")


@query("recommendation_range", _ALL + _top_sql(_DOT) + " SELECT round(min(score), 6) AS least, round(avg(score), 6) AS mean, round(max(score), 6) AS most FROM t WHERE n <= 10", ("ui",))
def _(spark, d):
    r = user_item(spark, d)
    return rounded(similarity.score_range(similarity.recommend(_users(r).toDF("u", "f"), _items(r).toDF("i", "f"), r, 10)), "least", "mean", "most")


@query("merged_similarities", _PAIRS + ", s AS (SELECT a, b, n_ab / (na + nb - n_ab) AS score FROM p UNION ALL SELECT a, b, n_ab / (sqrt(na) * sqrt(nb)) + 2 FROM p) SELECT a, b, round(score, 6) AS score, row_number() OVER (ORDER BY a, b, score DESC) - 1 AS place FROM s", ("ui",))
def _(spark, d):
    s = similarity.similarities(user_item(spark, d))
    return rounded(similarity.merged([s.select("a", "b", F.col("jaccard").alias("score")), s.select("a", "b", (F.col("asym_cosine") + 2).alias("score"))]), "score")


@query("similarity_asymmetric", _PAIRS + " SELECT a, b, round(n_ab / (pow(na, 0.25) * pow(nb, 0.75)), 6) AS score FROM p UNION ALL SELECT b, a, round(n_ab / (pow(nb, 0.25) * pow(na, 0.75)), 6) FROM p", ("ui",))
def _(spark, d):
    return rounded(similarity.asymmetric_cosine(user_item(spark, d), 0.25), "score")


@query("similarity_thresholds", _PAIRS + " SELECT a, b, n_ab, round(n_ab / (na + nb - n_ab), 6) AS score FROM p WHERE n_ab >= 20 AND n_ab <= 60", ("ui",))
def _(spark, d):
    s = similarity.similarities(user_item(spark, d), min_common=20, max_common=60)
    return rounded(s.select("a", "b", "n_ab", F.col("jaccard").alias("score")), "score")


# -- measures --------------------------------------------------------------------------------------------------


@query("weighted_errors", _ALL + f" SELECT round(sqrt(sum(w * e * e) / sum(w)), 5) AS rmse, round(sum(w * abs(e)) / sum(w), 5) AS mae FROM (SELECT r - ({_DOT}) e, 1.0 + (u + i) % 3 w FROM ui JOIN fu USING (u) JOIN fi USING (i))", ("ui",))
def _(spark, d):
    r = user_item(spark, d).withColumn("w", (F.col("u") + F.col("i")) % 3 + 1.0)
    return rounded(evaluation.errors(factorisation.predictions(r, _users(r), _items(r), 2), weight="w"), "rmse", "mae", places=5)


@query("validation_precision", _ALL + f", v AS (SELECT u, i, CASE WHEN r >= 50 THEN 1 ELSE 0 END hit, {_DOT} s FROM ui JOIN fu USING (u) JOIN fi USING (i) WHERE (u + i) % 3 = 0), k AS (SELECT u, hit, row_number() OVER (PARTITION BY u ORDER BY round(s, 9) DESC, i) n FROM v), h AS (SELECT u, hit, n, sum(hit) OVER (PARTITION BY u ORDER BY n) hits FROM k) SELECT u AS id, round(sum(CASE WHEN n <= 10 THEN hit * hits / n::DOUBLE ELSE 0 END) / least(sum(hit), 10), 6) AS ap FROM h GROUP BY u HAVING sum(hit) > 0", ("ui",))
def _(spark, d):
    """Average precision over each user's held-out ratings, relevant at 50 or more."""
    r = user_item(spark, d)
    v = r.where("(u + i) % 3 = 0")
    return rounded(evaluation.validation_precision(factorisation.predictions(v, _users(r), _items(r), 2), 50, 10), "ap")


@query("fold_training", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 5 <> 2")
def _(spark, d):
    return etl.fold(spark.read.parquet(f"{d}/orders.parquet"), "o_orderkey", 5, 2)[0].select("o_orderkey", "o_totalprice")


# -- without SQL -----------------------------------------------------------------------------------------------


@query("tensor_als_fit")
def _(spark, d):
    r = user_item(spark, d).withColumn("t", (F.col("u") + 3 * F.col("i")) % 7)
    u, v, t = factorisation.tensor_als(r, 4, 2)
    rows = r.join(u.toDF("u", "fu"), "u").join(v.toDF("i", "fi"), "i").join(t.toDF("t", "ft"), "t")
    guess = F.aggregate(F.zip_with(F.zip_with("fu", "fi", lambda x, y: x * y), "ft", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return rounded(evaluation.errors(rows.withColumn("prediction", guess)), "rmse", "mae", places=4)


def _values(spark, s) -> DataFrame:
    return rounded(spark.createDataFrame([(k, float(x)) for k, x in enumerate(s)], "k int, value double"), "value", places=4)


def _matrix(spark, d) -> DataFrame:
    return user_item(spark, d).select(F.col("u").alias("row"), F.col("i").alias("col"), F.col("r").alias("val"))


_FIRST = "mv AS (SELECT u, i, r FROM ui), v0 AS (SELECT DISTINCT i, 1.0::DOUBLE x FROM ui)"


def _power_sql(rounds: int) -> str:
    s = f", {_FIRST}"
    for k in range(rounds):
        s += f", a{k} AS (SELECT u, sum(r * x) y FROM mv JOIN v{k} USING (i) GROUP BY 1), b{k} AS (SELECT i, sum(r * y) z FROM mv JOIN a{k} USING (u) GROUP BY 1), v{k + 1} AS MATERIALIZED (SELECT i, z / sqrt(sum(z * z) OVER ()) x FROM b{k})"
    return s + f" SELECT round(sqrt(sum(y * y)), 4) AS value FROM (SELECT u, sum(r * x) y FROM mv JOIN v{rounds} USING (i) GROUP BY 1)"


@query("largest_singular_value", _power_sql(12), ("ui",))
def _(spark, d):
    s, _u, _v = factorisation.svd(_matrix(spark, d), 3, 8)
    return _values(spark, s[:1]).select("value")


@query("largest_singular_value_one_sided", _power_sql(12), ("ui",))
def _(spark, d):
    s, _v = factorisation.svd_one_sided(_matrix(spark, d), 2, 8)
    return _values(spark, s[:1]).select("value")


@query("singular_values")
def _(spark, d):
    return _values(spark, factorisation.svd(_matrix(spark, d), 4, 8)[0])


@query("implicit_negatives", "SELECT floor(0.2 * (1 + max(u)) * (1 + max(i)))::BIGINT AS n, -1.0::DOUBLE AS value, 0::BIGINT AS outside FROM ui", ("ui",))
def _(spark, d):
    """How many drawn pairs, and whether all lie inside."""
    r = user_item(spark, d)
    n = factorisation.implicit_negatives(r, 0.2, -1.0)
    top = r.agg(F.max("u").alias("mu"), F.max("i").alias("mi"))
    return n.join(F.broadcast(top)).agg(F.count("*").alias("n"), F.min("r").alias("value"), F.sum(((F.col("u") > F.col("mu")) | (F.col("i") > F.col("mi"))).cast("int")).alias("outside"))
