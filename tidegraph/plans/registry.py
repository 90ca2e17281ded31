"""All queries over the driver tables, with their DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegraph.operators import etl, evaluation, factorisation, graph, models, programs, similarity
from tidegraph.sources import generators
from tidegraph.sources.derived import SQL, co_purchase, user_item, user_next, weighted

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Registers a query; views: names in SQL of the WITH clause."""

    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = (f"WITH RECURSIVE {', '.join(SQL[v] for v in views)} " if views and not sql.startswith(",") else "") + (f"WITH RECURSIVE {', '.join(SQL[v] for v in views)}{sql}" if sql.startswith(",") else sql)
        return f

    return put


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- ranking ---------------------------------------------------------------------------------------------------


def _pagerank_sql(updates: int, base: str = "0.15") -> str:
    steps = ", dg AS (SELECT src id, count(*) d FROM un GROUP BY 1), vs AS (SELECT src id FROM un UNION SELECT dst FROM un), r0 AS (SELECT id, 1.0::DOUBLE r FROM vs)"
    for k in range(updates):
        steps += f", r{k + 1} AS (SELECT vs.id, {base} + 0.85 * coalesce(m.s, 0) r FROM vs LEFT JOIN (SELECT un.dst id, sum(r{k}.r / dg.d) s FROM un JOIN r{k} ON r{k}.id = un.src JOIN dg ON dg.id = un.src GROUP BY 1) m USING (id))"
    return steps + f" SELECT id, round(r, 6) rank FROM r{updates}"


@query("pagerank", _pagerank_sql(5), ("un",))
def _(spark, d):
    return rounded(graph.pagerank(user_next(spark, d), 5), "rank")


@query("pagerank_normalised", _pagerank_sql(4, "0.15 / (SELECT count(*) FROM vs)"), ("un",))
def _(spark, d):
    return rounded(graph.pagerank(user_next(spark, d), 4, normalised=True), "rank")


@query("pagerank_scatter_first", _pagerank_sql(3), ("un",))
def _(spark, d):
    """The engine whose first round only scatters: four iterations make three updates."""
    return rounded(graph.pagerank(user_next(spark, d), 4 - 1), "rank")


@query("top_vertices", _pagerank_sql(5) + " ORDER BY r DESC, id LIMIT 20", ("un",))
def _(spark, d):
    return rounded(graph.top(graph.pagerank(user_next(spark, d), 5), "rank", 20), "rank")


# -- primitives ------------------------------------------------------------------------------------------------


@query("degrees", "SELECT id, sum(i)::BIGINT in_degree, sum(o)::BIGINT out_degree FROM (SELECT src id, 0 i, 1 o FROM un UNION ALL SELECT dst, 1, 0 FROM un UNION ALL SELECT range, 0, 0 FROM range((SELECT max(greatest(src, dst)) + 1 FROM un))) GROUP BY 1", ("un",))
def _(spark, d):
    return graph.degrees(user_next(spark, d), implicit=True)


@query("gather_sum", "SELECT dst id, sum(src)::BIGINT m FROM un GROUP BY 1", ("un",))
def _(spark, d):
    e = user_next(spark, d)
    return graph.aggregate_messages(e, graph.vertices_of(e), F.col("src"), F.sum)


@query("gather_out_max", "SELECT src id, max(dst) m FROM un GROUP BY 1", ("un",))
def _(spark, d):
    e = user_next(spark, d)
    return graph.aggregate_messages(e, graph.vertices_of(e), F.col("dst"), F.max, back=True)


@query("edge_relation", "SELECT src, dst, round(1.0 / o.d + 2.0 / i.d, 6) AS value FROM un JOIN (SELECT src, count(*) d FROM un GROUP BY 1) o USING (src) JOIN (SELECT dst, count(*) d FROM un GROUP BY 1) i USING (dst)", ("un",))
def _(spark, d):
    e = programs.related(user_next(spark, d), 1.0 / F.col("src_out") + 2.0 / F.col("dst_in"))
    return rounded(e.select("src", "dst", F.col("edge").alias("value")), "value")


@query("range_sum", "SELECT count(*) n, sum(c)::BIGINT total FROM (SELECT src id, count(*) c FROM un GROUP BY 1) WHERE id >= 10 AND id < 100", ("un",))
def _(spark, d):
    return graph.degrees(user_next(spark, d)).where("out_degree > 0 and id >= 10 and id < 100").agg(F.count("*").alias("n"), F.sum("out_degree").alias("total"))


@query("delete_edges", "SELECT src, dst FROM un WHERE NOT (src % 7 = 0 AND dst % 3 = 0)", ("un",))
def _(spark, d):
    e = user_next(spark, d)
    return graph.remove_edges(e, e.where("src % 7 = 0 and dst % 3 = 0"))


@query("reverse_union", "SELECT src, dst FROM un UNION SELECT dst, src FROM un", ("un",))
def _(spark, d):
    return graph.undirected(user_next(spark, d))


@query("prefix_sum", "SELECT id, (sum(c) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING) - c)::BIGINT AS start FROM (SELECT dst id, count(*) c FROM un GROUP BY 1)", ("un",))
def _(spark, d):
    return graph.prefix_sums(user_next(spark, d))


@query("relabel_by_degree", "SELECT id, row_number() OVER (ORDER BY c, id) - 1 AS new_id FROM (SELECT id, count(*) c FROM (SELECT src id FROM un UNION ALL SELECT dst FROM un) GROUP BY 1)", ("un",))
def _(spark, d):
    return graph.relabel_by_degree(user_next(spark, d))


# -- components and communities --------------------------------------------------------------------------------

_REACH = ", b AS (SELECT src, dst FROM co UNION SELECT dst, src FROM co), cc(id, label) USING KEY (id) AS (SELECT DISTINCT src, src FROM b UNION SELECT b.src, min(cc.label) FROM cc JOIN b ON b.dst = cc.id JOIN recurring.cc r ON r.id = b.src WHERE cc.label < r.label GROUP BY b.src)"


@query("connected_components", _REACH + " SELECT id, label FROM cc", ("co",))
def _(spark, d):
    return graph.connected_components(co_purchase(spark, d))


@query("component_sizes", _REACH + " SELECT label, count(*) AS size FROM cc GROUP BY 1", ("co",))
def _(spark, d):
    return graph.component_sizes(graph.connected_components(co_purchase(spark, d)))


@query("component_edges", _REACH + " SELECT label, count(*) AS edges FROM co JOIN cc ON cc.id = co.src GROUP BY 1", ("co",))
def _(spark, d):
    e = co_purchase(spark, d)
    return graph.component_edges(e, graph.connected_components(e))


@query("percolation_sites", _REACH + " SELECT size, count(*) AS components FROM (SELECT label, count(*) AS size FROM cc GROUP BY 1) GROUP BY 1", ("co",))
def _(spark, d):
    return graph.percolation(co_purchase(spark, d))[0]


@query("percolation_bonds", _REACH + " SELECT edges, count(*) AS components FROM (SELECT label, count(*) AS edges FROM co JOIN cc ON cc.id = co.src GROUP BY 1) GROUP BY 1", ("co",))
def _(spark, d):
    return graph.percolation(co_purchase(spark, d))[1]


def _lpa_sql(rounds: int) -> str:
    s = ", b AS (SELECT src, dst FROM un UNION ALL SELECT dst, src FROM un), l0 AS (SELECT DISTINCT src id, src AS label FROM b)"
    for k in range(rounds):
        s += f", l{k + 1} AS (SELECT id, label FROM (SELECT src id, label, row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, label DESC) n FROM b JOIN l{k} ON l{k}.id = b.dst GROUP BY src, label) WHERE n = 1)"
    return s + f" SELECT id, label FROM l{rounds}"


@query("communities", _lpa_sql(4), ("un",))
def _(spark, d):
    return graph.communities(user_next(spark, d), 4)


@query("strong_components", ", vs AS (SELECT src id FROM un UNION SELECT dst FROM un), reach AS (SELECT src a, dst b FROM un UNION SELECT reach.a, un.dst FROM reach JOIN un ON un.src = reach.b) SELECT vs.id, least(vs.id, coalesce(min(x.b), vs.id)) AS label FROM vs LEFT JOIN (SELECT r.a, r.b FROM reach r JOIN reach s ON s.a = r.b AND s.b = r.a) x ON x.a = vs.id GROUP BY vs.id", ("un",))
def _(spark, d):
    return graph.strong_components(user_next(spark, d))


def _forest_sql(squarings: int) -> str:
    """An edge is in the forest if no path of lesser edges joins its ends: least largest edge of all paths, by squaring."""
    s = ", e AS (SELECT src, dst, min(w) w FROM (SELECT least(src, dst) src, greatest(src, dst) dst, (src * 7919 + dst * 104729) % 1000 w FROM un) GROUP BY 1, 2), o AS (SELECT *, w * 1000000000000 + src * 1000000 + dst k FROM e), p0 AS (SELECT src a, dst b, k FROM o UNION ALL SELECT dst, src, k FROM o UNION ALL SELECT DISTINCT src, src, -1 FROM (SELECT src FROM o UNION SELECT dst FROM o))"
    for i in range(squarings):
        s += f", p{i + 1} AS MATERIALIZED (SELECT x.a, y.b, min(greatest(x.k, y.k)) k FROM p{i} x JOIN p{i} y ON y.a = x.b GROUP BY 1, 2)"
    return s + f" SELECT o.src, o.dst, o.w AS weight FROM o JOIN p{squarings} p ON p.a = o.src AND p.b = o.dst WHERE p.k = o.k"


@query("spanning_forest", _forest_sql(8), ("un",))
def _(spark, d):
    return graph.spanning_forest(weighted(user_next(spark, d)))


@query("spanning_forest_of_purchases")
def _(spark, d):
    return graph.spanning_forest(weighted(co_purchase(spark, d)))


@query("triangles", ", s AS (SELECT DISTINCT least(src, dst) a, greatest(src, dst) b FROM un), t AS (SELECT x.a, x.b, y.b c FROM s x JOIN s y ON x.b = y.a JOIN s z ON z.a = x.a AND z.b = y.b) SELECT id, count(*) AS triangles FROM (SELECT a id FROM t UNION ALL SELECT b FROM t UNION ALL SELECT c FROM t) GROUP BY 1", ("un",))
def _(spark, d):
    return graph.triangles(user_next(spark, d))


def _core_sql(rounds: int) -> str:
    """Coreness as the fixed point of h-indices of the neighbours' values, from the degrees."""
    s = ", b AS (SELECT src, dst FROM un UNION ALL SELECT dst, src FROM un), h0 AS (SELECT src id, count(*)::BIGINT h FROM b GROUP BY 1)"
    for k in range(rounds):
        s += f", h{k + 1} AS MATERIALIZED (SELECT src id, max(least(h, n)) h FROM (SELECT src, h, row_number() OVER (PARTITION BY src ORDER BY h DESC) n FROM b JOIN h{k} ON h{k}.id = b.dst) GROUP BY 1)"
    return s


@query("k_core", _core_sql(40) + " SELECT id, h::INT AS core FROM h40", ("un",))
def _(spark, d):
    return graph.k_core(user_next(spark, d))


@query("k_core_levels", _core_sql(40) + ", l AS (SELECT least(x.h, y.h) k, count(*) links FROM un JOIN h40 x ON x.id = src JOIN h40 y ON y.id = dst GROUP BY 1) SELECT h::INT AS k, n::BIGINT AS removed, (sum(n) OVER (ORDER BY h))::BIGINT AS removed_to_here, (sum(coalesce(links, 0)) OVER () - sum(coalesce(links, 0)) OVER (ORDER BY h))::BIGINT AS links_left FROM (SELECT h, count(*) n FROM h40 GROUP BY 1) LEFT JOIN l ON l.k = h", ("un",))
def _(spark, d):
    e = user_next(spark, d)
    return graph.k_core_levels(graph.k_core(e), e)


@query("k_core_of_purchases")
def _(spark, d):
    return graph.k_core(co_purchase(spark, d))


def _spread_sql(rounds: int, renormalise: bool) -> str:
    s = ", e AS (SELECT src, dst, ((src * 7919 + dst * 104729) % 1000) + 1 AS weight FROM un), seeds AS (SELECT DISTINCT src id, src % 3 AS topic, 1.0::DOUBLE p FROM un WHERE src % 10 = 0), s0 AS (SELECT * FROM seeds)"
    for k in range(rounds):
        total = "sum(s) OVER (PARTITION BY id)" if renormalise else "(SELECT sum(weight) FROM e WHERE e.src = g.id)"
        final = "p / sum(p) OVER (PARTITION BY id)" if renormalise else "p"
        s += f", s{k + 1} AS (SELECT id, topic, {final} p FROM (SELECT id, topic, sum(p) p FROM (SELECT id, topic, 0.85 * s / {total} p FROM (SELECT e.src id, topic, sum(weight * p) s FROM e JOIN s{k} ON s{k}.id = e.dst GROUP BY 1, 2) g WHERE id NOT IN (SELECT id FROM seeds) UNION ALL SELECT id, topic, 0.15 * p FROM s{k} WHERE id NOT IN (SELECT id FROM seeds)) GROUP BY 1, 2) UNION ALL SELECT * FROM seeds)"
    return s + f" SELECT id, topic, round(p, 6) p FROM s{rounds}"


def _spread(spark, d, renormalise):
    e = user_next(spark, d).withColumn("weight", (F.col("src") * 7919 + F.col("dst") * 104729) % 1000 + 1)
    seeds = e.where("src % 10 = 0").select(F.col("src").alias("id"), (F.col("src") % 3).alias("topic"), F.lit(1.0).alias("p")).distinct()
    return rounded(graph.label_spreading(e, seeds, 3, renormalise=renormalise), "p")


@query("label_propagation", _spread_sql(3, True), ("un",))
def _(spark, d):
    return _spread(spark, d, True)


@query("co_training", _spread_sql(3, False), ("un",))
def _(spark, d):
    return _spread(spark, d, False)


@query("k_hop", ", b AS (SELECT src, dst FROM co UNION SELECT dst, src FROM co), lv AS (SELECT DISTINCT src id, 0 AS h FROM co WHERE src % 100 = 0 UNION SELECT b.dst, lv.h + 1 FROM lv JOIN b ON b.src = lv.id WHERE lv.h < 3), m AS (SELECT id, min(h) AS h FROM lv GROUP BY 1) SELECT b.src, b.dst, (m.h + 1)::INT AS hop FROM b JOIN m ON m.id = b.src WHERE m.h < 3", ("co",))
def _(spark, d):
    e = co_purchase(spark, d)
    return graph.k_hop(e, e.where("src % 100 = 0").select(F.col("src").alias("id")), 3)


# -- item similarity and recommendation ------------------------------------------------------------------------

_PAIRS = ", dg AS (SELECT u, count(*) deg FROM ui GROUP BY 1), it AS (SELECT i, count(*) n, sum(r * r) sq, sum(abs(r)) ab, sum(r) sm FROM ui GROUP BY 1), pr AS (SELECT x.i a, y.i b, count(*) n_ab, sum(x.r * y.r) dt, sum(1 / ln(deg)) aa, sum(1.0 / deg) ra, sum(abs(x.r - y.r) - abs(x.r) - abs(y.r)) l1 FROM ui x JOIN ui y USING (u) JOIN dg USING (u) WHERE x.i > y.i GROUP BY 1, 2), p AS (SELECT pr.*, ia.n na, ib.n nb, ia.sq sa, ib.sq sb, ia.ab aba, ib.ab abb, ia.sm sma, ib.sm smb FROM pr JOIN it ia ON ia.i = a JOIN it ib ON ib.i = b)"
_METRICS = {
    "jaccard": "n_ab / (na + nb - n_ab)",
    "adamic_adar": "aa",
    "resource": "ra",
    "asym_cosine": "n_ab / (sqrt(na) * sqrt(nb))",
    "cosine": "1 - dt / sqrt(sa * sb)",
    "manhattan": "aba + abb + l1",
    "tanimoto": "1 - dt / (sa + sb - dt)",
    "slope_one": "(sma - smb) / n_ab",
    "euclidean": "sqrt(abs(sa + sb - 2 * dt))",
}
for _metric, _formula in _METRICS.items():

    _places = 9 if _metric == "slope_one" else 5  # its values often lie halfway between shorter ones

    @query(f"similarity_{_metric}", _PAIRS + f" SELECT a, b, round({_formula}, {_places}) AS score FROM p", ("ui",))
    def _(spark, d, metric=_metric, places=_places):
        return rounded(similarity.similarities(user_item(spark, d)).select("a", "b", F.col(metric).alias("score")), "score", places=places)


@query("similarity_top", _PAIRS + " SELECT a, b, round(score, 5) AS score, n::INT AS rank FROM (SELECT a, b, n_ab / (na + nb - n_ab) AS score, row_number() OVER (PARTITION BY a ORDER BY round(n_ab / (na + nb - n_ab), 9) DESC, b) n FROM p) WHERE n <= 5", ("ui",))
def _(spark, d):
    return rounded(similarity.top_k(similarity.similarities(user_item(spark, d)).select("a", "b", F.col("jaccard").alias("score")), "a", "b", "score", 5), "score", places=5)


@query("similarity_chebyshev", ", p AS (SELECT DISTINCT x.i a, y.i b FROM ui x JOIN ui y USING (u) WHERE x.i > y.i), v AS (SELECT a, b, u FROM p JOIN ui ON ui.i = p.a UNION SELECT a, b, u FROM p JOIN ui ON ui.i = p.b) SELECT v.a, v.b, round(max(abs(coalesce(x.r, 0) - coalesce(y.r, 0))), 5) AS chebyshev FROM v LEFT JOIN ui x ON x.i = v.a AND x.u = v.u LEFT JOIN ui y ON y.i = v.b AND y.u = v.u GROUP BY 1, 2", ("ui",))
def _(spark, d):
    return rounded(similarity.chebyshev(user_item(spark, d)), "chebyshev", places=5)


@query("similarity_pearson", "SELECT a, b, CASE WHEN NOT isnan(c) THEN round(c, 6) END AS pearson FROM (SELECT x.i a, y.i b, corr(x.r, y.r) c FROM ui x JOIN ui y USING (u) WHERE x.i > y.i GROUP BY 1, 2)", ("ui",))
def _(spark, d):
    return rounded(similarity.pearson(user_item(spark, d)), "pearson")


@query("similarity_pearson_of_all", ", n AS (SELECT count(DISTINCT u) m, count(DISTINCT i) n FROM ui), us AS (SELECT DISTINCT u FROM ui), it AS (SELECT DISTINCT i FROM ui), mu AS (SELECT u, sum(r) / any_value(n.n) mu FROM ui, n GROUP BY u), x AS (SELECT us.u, it.i, coalesce(ui.r, 0) - mu.mu e FROM us CROSS JOIN it JOIN mu USING (u) LEFT JOIN ui ON ui.u = us.u AND ui.i = it.i), v AS (SELECT i, sum(e * e) / (any_value(n.m) - 1) v FROM x, n GROUP BY i), p AS (SELECT DISTINCT a.i a, b.i b FROM ui a JOIN ui b USING (u) WHERE a.i > b.i) SELECT p.a, p.b, round(sum(xa.e * xb.e) / (any_value(va.v) * any_value(vb.v)), 8) AS pearson FROM p JOIN x xa ON xa.i = p.a JOIN x xb ON xb.i = p.b AND xb.u = xa.u JOIN v va ON va.i = p.a JOIN v vb ON vb.i = p.b GROUP BY p.a, p.b", ("ui",))
def _(spark, d):
    return rounded(similarity.pearson_of_all(user_item(spark, d)), "pearson", places=8)


_LL = "(CASE WHEN {k} = 0 THEN 0 ELSE {k} * ln({q}) END + CASE WHEN {n} - {k} = 0 THEN 0 ELSE ({n} - {k}) * ln(1 - {q}) END)"


@query("similarity_llr", ", m AS (SELECT count(DISTINCT u)::DOUBLE m FROM ui), it AS (SELECT i, count(*)::DOUBLE n FROM ui GROUP BY 1), p AS (SELECT x.i a, y.i b, count(*)::DOUBLE k1 FROM ui x JOIN ui y USING (u) WHERE x.i > y.i GROUP BY 1, 2), t AS (SELECT a, b, k1, ib.n n1, ia.n - k1 k2, m.m - ib.n n2, m.m FROM p JOIN it ia ON ia.i = a JOIN it ib ON ib.i = b, m) SELECT a, b, round(1 - 1 / (1 + abs(2 * (" + _LL.format(k="k1", n="n1", q="(k1 / n1)") + " + " + _LL.format(k="k2", n="n2", q="(k2 / nullif(n2, 0))") + " - " + _LL.format(k="k1", n="n1", q="((k1 + k2) / m)") + " - " + _LL.format(k="k2", n="n2", q="((k1 + k2) / m)") + "))), 6) AS llr FROM t", ("ui",))
def _(spark, d):
    return rounded(similarity.log_likelihood(user_item(spark, d)), "llr")


_CHANCE = ", k AS (SELECT (count(*) / (count(DISTINCT u) * count(DISTINCT i) - count(*))::DOUBLE) c, count(DISTINCT u) m, count(DISTINCT i) n FROM ui), du AS (SELECT u, count(*) d FROM ui GROUP BY 1), di AS (SELECT i, count(*) d FROM ui GROUP BY 1)"


@query("similarity_probabilistic", _CHANCE + ", p AS (SELECT x.i a, y.i b, count(*) n_ab FROM ui x JOIN ui y USING (u) WHERE x.i > y.i GROUP BY 1, 2), ex AS (SELECT p.a, p.b, sum(1 / (1 + k.c * ((k.n - du.d) / du.d) * ((k.m - di.d) / di.d))) e FROM p JOIN ui ON ui.i = p.b JOIN du ON du.u = ui.u JOIN di ON di.i = p.a, k GROUP BY 1, 2) SELECT a, b, round(n_ab / e, 6) AS probability FROM p JOIN ex USING (a, b)", ("ui",))
def _(spark, d):
    return rounded(similarity.probabilistic(user_item(spark, d)), "probability")


@query("ratings_from_probability", _CHANCE + ", s AS (SELECT DISTINCT x.i a, y.i b, 1 + ((x.i * 31 + y.i * 17) % 100) / 100.0::DOUBLE sim FROM ui x JOIN ui y USING (u) WHERE x.i <> y.i), q AS (SELECT ui.u, s.b i, sum((ui.r - 0.5) / 0.5 * (s.sim - 1)) q FROM ui JOIN s ON s.a = ui.i WHERE s.sim > 1 GROUP BY 1, 2), sc AS (SELECT q.u, q.i, 1 / (1 + k.c * ((k.n - du.d) / du.d) * ((k.m - di.d) / di.d)) * (1 + q) score FROM q JOIN du ON du.u = q.u JOIN di ON di.i = q.i, k WHERE NOT EXISTS (SELECT 1 FROM ui WHERE ui.u = q.u AND ui.i = q.i)) SELECT u, i, round(score, 4) AS score, rn::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY round(score, 9) DESC, i) rn FROM sc) WHERE rn <= 5", ("ui",))
def _(spark, d):
    r = user_item(spark, d)
    s = similarity.pairs(r).select("a", "b")
    s = s.union(s.select("b", "a")).withColumn("sim", 1 + ((F.col("a") * 31 + F.col("b") * 17) % 100) / 100.0)
    return rounded(similarity.ratings_from_probability(r, s, 5), "score", places=4)


@query("similarity_weighted_jaccard", ", e AS (SELECT src, dst, ((src * 7919 + dst * 104729) % 1000) + 1 AS weight FROM co), t AS (SELECT v, sum(weight) t FROM (SELECT src v, weight FROM e UNION ALL SELECT dst, weight FROM e) GROUP BY 1) SELECT src, dst, round(weight / (x.t + y.t - weight), 6) AS score FROM e JOIN t x ON x.v = src JOIN t y ON y.v = dst", ("co",))
def _(spark, d):
    e = co_purchase(spark, d).withColumn("weight", (F.col("src") * 7919 + F.col("dst") * 104729) % 1000 + 1)
    return rounded(similarity.weighted_jaccard(e), "score")


@query("ratings_from_similarity", _PAIRS + ", s AS (SELECT a, b, n_ab / (na + nb - n_ab) AS sim FROM p), bs AS (SELECT a, b, sim FROM s UNION SELECT b, a, sim FROM s), sc AS (SELECT u, b AS i, sum(r * sim * sim * sim) AS score FROM ui JOIN bs ON bs.a = ui.i GROUP BY 1, 2) SELECT u, i, round(score, 4) AS score, n::INT AS rank FROM (SELECT sc.*, row_number() OVER (PARTITION BY sc.u ORDER BY round(score, 9) DESC, sc.i) n FROM sc WHERE score <> 0 AND NOT EXISTS (SELECT 1 FROM ui WHERE ui.u = sc.u AND ui.i = sc.i)) WHERE n <= 5", ("ui",))
def _(spark, d):
    r = user_item(spark, d)
    s = similarity.similarities(r).select("a", "b", F.col("jaccard").alias("sim"))
    return rounded(similarity.ratings_from_similarity(r, s, 5), "score", places=4)


# -- models ----------------------------------------------------------------------------------------------------


def _fit(pairs, u, v, dims, mean=None):
    return rounded(evaluation.errors(factorisation.predictions(pairs, u, v, dims, mean)), "rmse", "mae", places=4)


@query("als_fit")
def _(spark, d):
    r = user_item(spark, d)
    u, v = factorisation.als(r, 4, 2)
    return _fit(r, u, v, 4)


@query("als_by_degree_fit")
def _(spark, d):
    r = user_item(spark, d)
    u, v = factorisation.als(r, 4, 2, by_degree=True)
    return _fit(r, u, v, 4)


@query("weighted_als_fit")
def _(spark, d):
    r = user_item(spark, d).withColumn("w", (F.col("u") + F.col("i")) % 3 + 1.0)
    u, v = factorisation.als(r, 4, 2, weighted=True)
    return _fit(r, u, v, 4)


@query("sparse_als_fit")
def _(spark, d):
    r = user_item(spark, d)
    u, v = factorisation.als(r, 4, 2, keep=2)
    return _fit(r, u, v, 4)


@query("nmf_fit")
def _(spark, d):
    r = user_item(spark, d).withColumn("r", F.abs("r"))
    u, v = factorisation.nmf(r, 2, 2)
    return _fit(r, u, v, 2)


@query("sgd_fit")
def _(spark, d):
    r = user_item(spark, d)
    u, v, _m = factorisation.sgd(r, 4, 1, rate=0.002, blocks=2)
    return _fit(r, u, v, 4)


@query("bias_sgd_fit")
def _(spark, d):
    r = user_item(spark, d)
    u, v, m = factorisation.sgd(r, 4, 1, rate=0.002, bias=True, blocks=2)
    return _fit(r, u, v, 4, m)


@query("coordinate_als_fit")
def _(spark, d):
    r = user_item(spark, d)
    u, v = factorisation.als(r, 4, 2, coordinate=True)
    return _fit(r, u, v, 4)


@query("implicit_sgd_fit")
def _(spark, d):
    r = user_item(spark, d)
    u, v, m = factorisation.sgd(r, 4, 1, rate=0.002, bias=True, implicit=True)
    return rounded(evaluation.errors(factorisation.predictions(r, u, v, 4, m, implicit_from=r)), "rmse", "mae", places=4)


@query("logistic_sgd_fit")
def _(spark, d):
    r = user_item(spark, d)
    low, high = (float(x) for x in r.agg(F.min("r"), F.max("r")).first())
    u, v, m = factorisation.sgd(r, 4, 1, rate=0.002, bias=True, low=low, high=high, logistic=True)
    return rounded(evaluation.errors(factorisation.predictions(r, u, v, 4, m, low, high, logistic=True)), "rmse", "mae", places=4)


def _timed(spark, d):
    return user_item(spark, d).withColumn("t", (F.col("u") + 3 * F.col("i")) % 7)


@query("machine_fit")
def _(spark, d):
    r = models.with_last_item(_timed(spark, d)).withColumn("row", F.struct("u", "i"))
    x = models.design(r, "row", ["u", "i", "t", "last"])
    w, m = models.fm(x, r, 4, 2, rate=0.1)
    return rounded(evaluation.errors(models.fm_predict(x, r, w, m, 4)), "rmse", "mae", places=4)


@query("time_fit")
def _(spark, d):
    r = _timed(spark, d)
    side, m = models.time_svd(r, 4, 2, rate=0.1)
    return rounded(evaluation.errors(models.time_svd_predict(r, r, side, m, 4)), "rmse", "mae", places=4)


@query("ranking_factors")
def _(spark, d):
    return rounded(models.climf(user_item(spark, d), 4, 2, cutoff=50.0)[0].select("id", F.posexplode("f").alias("k", "f")), "f")


@query("boltzmann_fit")
def _(spark, d):
    r = user_item(spark, d)
    top = float(r.agg(F.max("r")).first()[0])
    items = models.boltzmann(r, 6, top / 5, 4, 2)
    return rounded(evaluation.errors(models.boltzmann_predict(r, r, items, 6, 4, top / 5)), "rmse", "mae", places=4)


@query("sampled_factors_fit")
def _(spark, d):
    r = user_item(spark, d)
    return rounded(evaluation.errors(models.sampled_factors(r, r, 4, 3, 1)[2]), "rmse", "mae", places=4)


@query("topic_words")
def _(spark, d):
    words = F.explode(F.split(F.lower("p_name"), r"[^a-z]+"))
    return models.topic_words(models.topics(table(spark, d, "part").select(F.col("p_partkey").alias("d"), words.alias("w")).where("w <> ''"), 5, 2), 10)


@query("top_n_recommendations")
def _(spark, d):
    r = user_item(spark, d)
    u, v = factorisation.als(r, 4, 2)
    return similarity.recommend(u.toDF("u", "f"), v.toDF("i", "f"), r, 10)


for _kind in ("global", "user", "item"):

    @query(f"baseline_{_kind}", f"SELECT u, i, round(r, 9) r, round(avg(r) OVER ({dict(user='PARTITION BY u', item='PARTITION BY i').get(_kind, '')}), 9) AS prediction FROM ui", ("ui",))
    def _(spark, d, kind=_kind):
        return rounded(factorisation.baseline(user_item(spark, d), kind), "r", "prediction", places=9).select("u", "i", "r", "prediction")


# -- evaluation ------------------------------------------------------------------------------------------------


@query("errors", "SELECT round(sqrt(avg((r - p) * (r - p))), 5) AS rmse, round(avg(abs(r - p)), 5) AS mae, round(avg(CASE WHEN (r > 50) <> (p > 50) THEN 1.0 ELSE 0 END), 5) AS wrong FROM (SELECT r, avg(r) OVER (PARTITION BY i) p FROM ui)", ("ui",))
def _(spark, d):
    return rounded(evaluation.errors(factorisation.baseline(user_item(spark, d), "item"), cutoff=50), "rmse", "mae", "wrong", places=5)


@query("auc", "SELECT round((sum(CASE WHEN r > 50 THEN k ELSE 0 END) - p * (p + 1) / 2.0) / (p * (n - p)), 6) AS auc FROM (SELECT value r, row_number() OVER (ORDER BY user_id, event_id) k, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) OVER () p, count(*) OVER () n FROM events) GROUP BY p, n")
def _(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("value").alias("r"), F.col("user_id").cast("double").alias("prediction"))
    return rounded(evaluation.auc(e, 50), "auc")


_RANKED = ", rk AS (SELECT u id, i item, row_number() OVER (PARTITION BY u ORDER BY r DESC, i) AS rank FROM ui), ac AS (SELECT u id, i item, row_number() OVER (PARTITION BY u ORDER BY r * ((i % 3) + 1) DESC, i) AS rank FROM ui)"


def _ranked(spark, d, score):
    r = user_item(spark, d).withColumn("s", score)
    return r.select(F.col("u").alias("id"), F.col("i").alias("item"), F.row_number().over(Window.partitionBy("u").orderBy(F.col("s").desc(), "i")).alias("rank"))


@query("average_precision", _RANKED + ", h AS (SELECT rk.id, rk.rank, CASE WHEN ac.item IS NULL THEN 0 ELSE 1 END hit FROM rk LEFT JOIN ac ON ac.id = rk.id AND ac.item = rk.item AND ac.rank <= 10 WHERE rk.rank <= 10), c AS (SELECT id, rank, hit, sum(hit) OVER (PARTITION BY id ORDER BY rank) hits FROM h) SELECT c.id, round(sum(hit * hits / rank) / least(any_value(n.n), 10), 6) AS ap FROM c JOIN (SELECT id, count(*) n FROM ac WHERE rank <= 10 GROUP BY 1) n USING (id) GROUP BY c.id", ("ui",))
def _(spark, d):
    return rounded(evaluation.average_precision(_ranked(spark, d, F.col("r")), _ranked(spark, d, F.col("r") * (F.col("i") % 3 + 1)), 10), "ap")


@query("reciprocal_rank", _RANKED + " SELECT rk.id, round(coalesce(1.0 / min(CASE WHEN rk.item % 7 = 0 THEN rk.rank END), 0), 6) AS rr FROM rk GROUP BY 1", ("ui",))
def _(spark, d):
    r = _ranked(spark, d, F.col("r"))
    return rounded(evaluation.reciprocal_rank(r, r.where("item % 7 = 0")), "rr")


# -- ETL -------------------------------------------------------------------------------------------------------


@query("sum_by_pair", "SELECT l_partkey, l_suppkey, sum(l_quantity) AS total FROM lineitem GROUP BY 1, 2")
def _(spark, d):
    return etl.sum_by_pair(table(spark, d, "lineitem"), "l_partkey", "l_suppkey", "l_quantity")


@query("frequencies", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    return etl.frequencies(table(spark, d, "events"), "event_type")


@query("contingency", "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2, 3")
def _(spark, d):
    return etl.contingency(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", "l_linenumber")


@query("mutual_information", "WITH ab AS (SELECT l_returnflag a, l_linestatus b, count(*) c FROM lineitem GROUP BY 1, 2), n AS (SELECT sum(c) n FROM ab), x AS (SELECT a, sum(c) ca FROM ab GROUP BY 1), y AS (SELECT b, sum(c) cb FROM ab GROUP BY 1), m AS (SELECT sum(c / n * log2(c * n / (ca * cb))) mi FROM ab JOIN x USING (a) JOIN y USING (b), n), h AS (SELECT -sum(ca / n * log2(ca / n)) entropy FROM x, n) SELECT round(mi, 6) mi, round(entropy, 6) entropy, round(CASE WHEN mi / entropy > 0.001 THEN mi / entropy END, 6) ratio FROM m, h")
def _(spark, d):
    return rounded(etl.mutual_information(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus"), "mi", "entropy", "ratio")


@query("consecutive_ids", "SELECT value, row_number() OVER (ORDER BY value) AS id FROM (SELECT DISTINCT c_name AS value FROM customer)")
def _(spark, d):
    return etl.consecutive_ids(table(spark, d, "customer"), "c_name")


@query("first_per_key", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) n FROM orders) WHERE n <= 3")
def _(spark, d):
    return etl.first_per_key(table(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 3)


@query("last_per_key", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def _(spark, d):
    return etl.last_per_key(table(spark, d, "events").select("user_id", "event_id", "ts", F.col("event_id").alias("e")), "user_id", "event_id", "ts", "e")


@query("fold", "SELECT count(*) AS n, sum(o_totalprice)::BIGINT AS total FROM orders WHERE o_orderkey % 5 = 2")
def _(spark, d):
    return etl.fold(table(spark, d, "orders"), "o_orderkey", 5, 2)[1].agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice")).cast("long").alias("total"))


@query("token_counts", "WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\\s,.;:!?()\\[\\]\"'']+'), lambda x: x <> '') t FROM documents WHERE text IS NOT NULL), e AS (SELECT doc_id, unnest(t) token, generate_subscripts(t, 1) k FROM t) SELECT doc_id AS line, token, count(*) AS n FROM e WHERE k = 1 OR length(token) > 1 GROUP BY 1, 2 HAVING count(*) >= 2")
def _(spark, d):
    return etl.token_counts(table(spark, d, "documents"), "doc_id", "text", 2)


@query("train_given", "SELECT src, dst FROM (SELECT src, dst, count(*) OVER (PARTITION BY src) n, row_number() OVER (PARTITION BY src ORDER BY md5(src || '|' || dst || '|1'), dst) k FROM un) WHERE n >= 5 AND k <= 3", ("un",))
def _(spark, d):
    return etl.train_given(user_next(spark, d), 5, 3)[0]


# -- generators and streams ------------------------------------------------------------------------------------


@query("grid_components", "SELECT 1::BIGINT AS components, 760::BIGINT AS edges, 400::BIGINT AS vertices")
def _(spark, d):
    e = generators.grid(spark, 20)
    labels = graph.connected_components(e)
    return labels.agg(F.countDistinct("label").alias("components"), F.count("*").alias("vertices")).join(e.agg(F.count("*").alias("edges"))).select("components", "edges", "vertices")


@query("crossgrid_edges", "SELECT 1482::BIGINT AS edges")
def _(spark, d):
    return generators.crossgrid(spark, 20).agg(F.count("*").alias("edges"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


# further queries register themselves here
import tidegraph.plans.formats  # noqa: E402
import tidegraph.plans.programs  # noqa: E402
import tidegraph.plans.recommenders  # noqa: E402, F401
