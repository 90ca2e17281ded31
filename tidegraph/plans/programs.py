"""Queries of user-defined programs, schedules, subgraphs and functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidegraph.functions import scalar
from tidegraph.operators import graph, ordering, programs
from tidegraph.plans import observe
from tidegraph.plans.registry import _pagerank_sql, query, rounded, table
from tidegraph.plans.tables import shared_dir
from tidegraph.sources.derived import co_purchase, user_next, weighted
from tidegraph.streaming import ingest

_ENDS = "vs AS (SELECT src id FROM un UNION SELECT dst FROM un)"


@query("program_pagerank", _pagerank_sql(5), ("un",))
def _(spark, d):
    return rounded(programs.run(user_next(spark, d), programs.pagerank_program(), 5), "rank")


@query("in_edge_program", _pagerank_sql(4), ("un",))
def _(spark, d):
    """Relation and update of ranks as columns."""
    out = programs.in_edge_program(user_next(spark, d), 1 / F.col("src_out"), F.lit(1.0), lambda m: 0.15 + 0.85 * F.coalesce(m, F.lit(0.0)), 4)
    return rounded(out.select("id", F.col("value").alias("rank")), "rank")


@query("program_labels", f", b AS (SELECT src, dst FROM un UNION SELECT dst, src FROM un), cc(id, label) USING KEY (id) AS (SELECT DISTINCT src, src FROM b UNION SELECT b.src, min(cc.label) FROM cc JOIN b ON b.dst = cc.id JOIN recurring.cc r ON r.id = b.src WHERE cc.label < r.label GROUP BY b.src) SELECT id, label FROM cc", ("un",))
def _(spark, d):
    """Components with an active set: only vertices whose neighbours changed gather."""
    return programs.run(user_next(spark, d), programs.least_label_program(), 1000)


@query("program_hops", f", {_ENDS}, h(id, hops) USING KEY (id) AS (SELECT id, 0::BIGINT FROM vs WHERE id % 40 = 0 UNION SELECT un.dst, min(h.hops + 1) FROM h JOIN un ON un.src = h.id LEFT JOIN recurring.h r ON r.id = un.dst WHERE r.hops IS NULL OR h.hops + 1 < r.hops GROUP BY un.dst) SELECT vs.id, h.hops FROM vs LEFT JOIN h ON h.id = vs.id", ("un",))
def _(spark, d):
    e = user_next(spark, d)
    start = graph.vertices_of(e).where("id % 40 = 0")
    p = programs.reach_program(F.col("id") % 40 == 0)
    first = e.join(start.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
    return programs.run(e, p, 1000, active=first)


def _log_sql(updates: int) -> str:
    s = _pagerank_sql(updates)
    s = s[: s.rindex(" SELECT id, round")]
    return s + " " + " UNION ALL ".join(f"SELECT {k}::INT AS iter, count(*) AS updates, count(*) AS work, round(sum(abs(a.r - b.r)), 6) AS delta FROM r{k + 1} a JOIN r{k} b USING (id)" for k in range(updates))


@query("delta_log", _log_sql(4), ("un",))
def _(spark, d):
    e, p = user_next(spark, d), programs.pagerank_program()
    programs.run(e, p, 4)
    return rounded(programs.delta_log(e, p), "delta")


@query("round_hooks", "SELECT * FROM (VALUES (0::INT, 'before'), (0, 'after'), (1, 'before'), (1, 'after'), (2, 'before'), (2, 'after')) t(round, hook)")
def _(spark, d):
    seen, p = [], programs.pagerank_program()
    p.before_round, p.after_round = lambda k, s: seen.append((k, "before")), lambda k, s: seen.append((k, "after"))
    programs.run(user_next(spark, d), p, 3)
    return spark.createDataFrame(seen, "round int, hook string")


@query("run_metrics", "SELECT * FROM (VALUES ('edges', 'counter', 1::BIGINT, (SELECT count(*)::DOUBLE FROM un)), ('ranks.round', 'timer', 3, NULL), ('ranks.rounds', 'counter', 3, 3.0)) t(name, kind, n, total)", ("un",))
def _(spark, d):
    """Counters and timers of a run; the timers' seconds are left out."""
    m, e, p = observe.Metrics(), user_next(spark, d), programs.pagerank_program()
    m.count("edges", e.count())
    p.before_round, p.after_round = m.hooks("ranks")
    programs.run(e, p, 3)
    return m.table(spark).select("name", "kind", "n", F.when(F.col("kind") == "counter", F.col("total")).alias("total"))


@query("contracted_edges", ", e AS (SELECT src, dst, (src * 7919 + dst * 104729) % 1000 w FROM un) SELECT src % 10 AS src, dst % 10 AS dst, min(w) AS weight FROM e WHERE src % 10 <> dst % 10 GROUP BY 1, 2", ("un",))
def _(spark, d):
    e = weighted(user_next(spark, d))
    return graph.contracted(e, graph.vertices_of(e).select("id", (F.col("id") % 10).alias("label")))


@query("least_neighbour_edge", ", e AS (SELECT src, dst, (src * 7919 + dst * 104729) % 1000 w FROM un) SELECT src AS id, min(w)::DOUBLE AS weight, arg_min(dst, (w, dst)) AS dst FROM e GROUP BY 1", ("un",))
def _(spark, d):
    """The out-edge of least weight of each vertex."""
    e = weighted(user_next(spark, d))
    best = F.min(F.struct("weight", "dst"))
    return e.groupBy(F.col("src").alias("id")).agg(best.alias("b")).select("id", F.col("b.weight").cast("double").alias("weight"), "b.dst")


@query("one_of_duplicates", "SELECT user_id AS src, (event_id % 40) AS dst, min(value)::DOUBLE AS value, arg_min(event_id, (value, event_id)) AS event FROM events GROUP BY 1, 2")
def _(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("src"), (F.col("event_id") % 40).alias("dst"), "value", F.col("event_id").alias("event"))
    return programs.one_of_duplicates(e, [F.col("value"), F.col("event")])


@query("reset_edges", "SELECT src, dst, 2.5::DOUBLE AS value FROM un", ("un",))
def _(spark, d):
    return programs.reset_edges(user_next(spark, d), 2.5)


@query("aggregate_vertices", ", dg AS (SELECT src id, count(*) c FROM un GROUP BY 1) SELECT round(sqrt(sum(c * c)), 6) AS result FROM dg WHERE id >= 20 AND id < 120", ("un",))
def _(spark, d):
    deg = graph.degrees(user_next(spark, d)).where("out_degree > 0")
    return rounded(programs.aggregate_vertices(deg, F.col("out_degree") * F.col("out_degree"), F.sum, F.sqrt, 20, 120), "result")


@query("components_while_loading", ", b AS (SELECT src, dst FROM co UNION SELECT dst, src FROM co), cc(id, label) USING KEY (id) AS (SELECT DISTINCT src, src FROM b UNION SELECT b.src, min(cc.label) FROM cc JOIN b ON b.dst = cc.id JOIN recurring.cc r ON r.id = b.src WHERE cc.label < r.label GROUP BY b.src) SELECT id, label FROM cc", ("co",))
def _(spark, d):
    return programs.components_while_loading(co_purchase(spark, d))


def _seeds(e):
    return graph.vertices_of(e).where("id % 10 = 0")


@query("seed_edges", "SELECT src, dst FROM un WHERE src % 10 = 0 AND dst % 10 = 0", ("un",))
def _(spark, d):
    e = user_next(spark, d)
    return programs.seed_edges(e, _seeds(e))


@query("seed_degrees", "SELECT id, sum(i)::BIGINT in_degree, sum(o)::BIGINT out_degree FROM (SELECT src id, 0 i, 1 o FROM un UNION ALL SELECT dst, 1, 0 FROM un) WHERE id % 10 = 0 GROUP BY 1", ("un",))
def _(spark, d):
    e = user_next(spark, d)
    return programs.seed_degrees(e, _seeds(e))


@query("component_report", ", vs AS (SELECT src id FROM un UNION SELECT dst FROM un) SELECT id % 3 AS label, count(*) AS nodes, any_value(m.n) AS edges, count(CASE WHEN id % 10 = 0 THEN 1 END) AS seeds FROM vs JOIN (SELECT src % 3 l, count(*) n FROM un GROUP BY 1) m ON m.l = id % 3 GROUP BY 1", ("un",))
def _(spark, d):
    """Nodes, edges by their sources, and seeds of three given groups."""
    e = user_next(spark, d)
    return programs.component_report(e, graph.vertices_of(e).select("id", (F.col("id") % 3).alias("label")), _seeds(e))


@query("k_hop_capped", ", b AS (SELECT src, dst FROM un UNION SELECT dst, src FROM un), lv AS (SELECT 0::BIGINT id, 0 AS h UNION SELECT b.dst, lv.h + 1 FROM lv JOIN b ON b.src = lv.id WHERE lv.h < 3), m AS (SELECT id, min(h) AS h FROM lv GROUP BY 1) SELECT b.src, b.dst, (m.h + 1)::INT AS hop FROM b JOIN m ON m.id = b.src WHERE m.h < 3 ORDER BY hop, src, dst LIMIT 500", ("un",))
def _(spark, d):
    e = user_next(spark, d)
    return graph.k_hop(e, spark.range(1), 3, most_edges=500)


_HASH = "('0x' || substr(md5(src || '|' || dst || '|1'), 1, 8))::BIGINT"


@query("base_of_stream", f"SELECT src, dst FROM un WHERE {_HASH} % 4 = 0", ("un",))
def _(spark, d):
    return programs.base_and_stream(user_next(spark, d), 4)[0]


@query("rest_of_stream", f"SELECT src, dst, substr(md5(src || '|' || dst || '|1'), 9, 16) AS \"order\" FROM un WHERE {_HASH} % 4 <> 0", ("un",))
def _(spark, d):
    return programs.base_and_stream(user_next(spark, d), 4)[1]


def _walk_sql(walks: int, steps: int) -> str:
    s = f", e AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 k FROM un), dg AS (SELECT src, count(*) d FROM un GROUP BY 1), w0 AS (SELECT src id, src origin, walk FROM (SELECT DISTINCT src FROM un WHERE src % 50 = 0), range(1, {walks + 1}) t(walk))"
    for i in range(steps):
        s += f", w{i + 1} AS (SELECT e.dst id, origin, walk FROM w{i} w JOIN dg ON dg.src = w.id JOIN e ON e.src = w.id AND e.k = ('0x' || substr(md5(origin || '|' || walk || '|{i}|1'), 1, 8))::BIGINT % dg.d)"
    return s + " SELECT id, count(*) AS arrivals FROM (" + " UNION ALL ".join(f"SELECT id FROM w{i + 1}" for i in range(steps)) + ") GROUP BY 1"


@query("random_walks", _walk_sql(100, 4), ("un",))
def _(spark, d):
    e = user_next(spark, d)
    return graph.random_walks(e, e.where("src % 50 = 0").select(F.col("src").alias("id")).distinct(), 100, 4)


# -- order -----------------------------------------------------------------------------------------------------


@query("edges_by_destination", "SELECT src, dst, row_number() OVER (ORDER BY dst, src) - 1 AS place FROM un", ("un",))
def _(spark, d):
    return graph.by_destination(user_next(spark, d))


@query("equal_intervals", ", g AS (SELECT dst id, count(*) c FROM un GROUP BY 1), p AS (SELECT id, c, sum(c) OVER (ORDER BY id) - c b, sum(c) OVER () t FROM g) SELECT least(floor(b * 7 / t), 6)::INT AS \"interval\", min(id) AS first, max(id) AS last, sum(c)::BIGINT AS edges FROM p GROUP BY 1", ("un",))
def _(spark, d):
    return ordering.equal_intervals(graph.degrees(user_next(spark, d)).where("in_degree > 0"), 7)


# -- streams ---------------------------------------------------------------------------------------------------


def _base(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("crowded_table", "SELECT * FROM (VALUES (1::INT, FALSE), (2, FALSE), (3, TRUE), (4, FALSE)) t(step, crowded)")
def _(spark, d):
    """Whether a compaction is due: after two appends, a few deletions, very many, and the compaction."""
    e, t = user_next(spark, d), ingest.EdgeTable(spark, _base(spark, "edges"))
    t.append(e.where("src % 2 = 0"), 0)
    t.append(e.where("src % 2 = 1"), 1)
    steps = [t.crowded()]
    t.delete(e.where("src = 1"), 0)
    steps.append(t.crowded())
    t.delete(e.where("src % 2 = 1"), 1)
    steps.append(t.crowded())
    steps.append(t.compact(_base(spark, "edges")).crowded())
    return spark.createDataFrame(list(enumerate(steps, 1)), "step int, crowded boolean")


@query("streamed_edges", "SELECT DISTINCT src, dst FROM un WHERE NOT (src % 5 = 0 AND dst % 3 = 0)", ("un",))
def _(spark, d):
    """Edges that a stream appended and tombstones took away, after a compaction in between."""
    e, t = user_next(spark, d), ingest.EdgeTable(spark, _base(spark, "edges"))
    t.append(e.where("src % 2 = 0"), 0)
    t.delete(e.where("src % 10 = 0 and dst % 3 = 0"), 0)
    t = t.compact(_base(spark, "edges"))
    t.append(e.where("src % 2 = 1").union(spark.createDataFrame([(3, 3)], "src long, dst long")), 1)
    t.delete(e.where("src % 5 = 0 and src % 2 = 1 and dst % 3 = 0"), 1)
    return t.edges()


_STEP = "SELECT vs.id, 0.15 + 0.85 * coalesce(m.s, 0) r FROM vs LEFT JOIN (SELECT un.dst id, sum({r}.r / dg.d) s FROM un JOIN {r} ON {r}.id = un.src JOIN dg ON dg.id = un.src GROUP BY 1) m USING (id)"


def _refresh_sql(rounds: int) -> str:
    s = ", a AS (SELECT * FROM un WHERE src % 4 <> 1), va AS (SELECT src id FROM a UNION SELECT dst FROM a), da AS (SELECT src id, count(*) d FROM a GROUP BY 1), q0 AS (SELECT id, 1.0::DOUBLE r FROM va)"
    for k in range(3):
        s += f", q{k + 1} AS (SELECT va.id, 0.15 + 0.85 * coalesce(m.s, 0) r FROM va LEFT JOIN (SELECT a.dst id, sum(q{k}.r / da.d) s FROM a JOIN q{k} ON q{k}.id = a.src JOIN da ON da.id = a.src GROUP BY 1) m USING (id))"
    s += f", {_ENDS}, dg AS (SELECT src id, count(*) d FROM un GROUP BY 1), r0 AS (SELECT vs.id, coalesce(q3.r, 1.0) r FROM vs LEFT JOIN q3 USING (id)), s0 AS (SELECT DISTINCT un.dst id FROM un WHERE un.src IN (SELECT src FROM un WHERE src % 4 = 1))"
    for k in range(rounds):
        s += f", f{k + 1} AS ({_STEP.format(r=f'r{k}')}), r{k + 1} AS (SELECT r{k}.id, CASE WHEN s{k}.id IS NULL THEN r{k}.r ELSE f{k + 1}.r END r FROM r{k} JOIN f{k + 1} USING (id) LEFT JOIN s{k} ON s{k}.id = r{k}.id), s{k + 1} AS (SELECT DISTINCT un.dst id FROM un JOIN r{k + 1} x ON x.id = un.src JOIN r{k} y ON y.id = un.src JOIN s{k} ON s{k}.id = un.src WHERE abs(x.r - y.r) >= 0.1)"
    return s + f" SELECT id, round(r, 6) AS rank FROM r{rounds}"


@query("rescheduled_ranks", _refresh_sql(3), ("un",))
def _(spark, d):
    """Ranks after new edges: their sources' neighbours gather, then those of vertices that moved by 0.1 or more."""
    e = user_next(spark, d)
    old = graph.pagerank(e.where("src % 4 <> 1"), 3)
    return rounded(ingest.reschedule_ranks(e, old, e.where("src % 4 = 1"), 3), "rank")


def _followed_sql(at_end: int) -> str:
    s = f", a AS (SELECT * FROM un WHERE src % 2 = 0), va AS (SELECT src id FROM a UNION SELECT dst FROM a), da AS (SELECT src id, count(*) d FROM a GROUP BY 1), q AS (SELECT va.id, 0.15 + 0.85 * coalesce(m.s, 0) r FROM va LEFT JOIN (SELECT a.dst id, sum(1.0 / da.d) s FROM a JOIN da ON da.id = a.src GROUP BY 1) m USING (id)), {_ENDS}, dg AS (SELECT src id, count(*) d FROM un GROUP BY 1), r0 AS (SELECT vs.id, coalesce(q.r, 1.0) r FROM vs LEFT JOIN q USING (id))"
    for k in range(at_end + 1):
        s += f", r{k + 1} AS ({_STEP.format(r=f'r{k}')})"
    return s + f" SELECT id, round(r, 6) AS rank FROM r{at_end + 1}"


@query("streamed_ranks", _followed_sql(5), ("un",))
def _(spark, d):
    """Two files of edges, one after the other: a round of ranks for each, five at the end."""
    import time

    base, e = _base(spark, "stream"), user_next(spark, d)
    e.where("src % 2 = 0").coalesce(1).write.parquet(f"{base}/in")
    time.sleep(1.1)  # files are taken in the order of their times
    e.where("src % 2 = 1").coalesce(1).write.mode("append").parquet(f"{base}/in")
    source = spark.readStream.schema("src long, dst long").option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    return rounded(ingest.follow(source, ingest.EdgeTable(spark, f"{base}/table")), "rank")


_TOP = " SELECT batch, id, rank, place FROM (SELECT 0::BIGINT AS batch, q.id, round(q.r, 6) AS rank, row_number() OVER (ORDER BY round(q.r, 9) DESC, q.id)::INT AS place FROM q UNION ALL SELECT 1, r1.id, round(r1.r, 6), row_number() OVER (ORDER BY round(r1.r, 9) DESC, r1.id)::INT FROM r1) WHERE place <= 20"


@query("live_top", _followed_sql(0)[: _followed_sql(0).rindex(" SELECT id, round")] + _TOP, ("un",))
def _(spark, d):
    """The 20 best after each batch of a stream."""
    import time

    base, e = _base(spark, "stream"), user_next(spark, d)
    e.where("src % 2 = 0").coalesce(1).write.parquet(f"{base}/in")
    time.sleep(1.1)
    e.where("src % 2 = 1").coalesce(1).write.mode("append").parquet(f"{base}/in")
    source = spark.readStream.schema("src long, dst long").option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    board = ingest.Leaderboard(spark, f"{base}/top", 20)
    ingest.follow(source, ingest.EdgeTable(spark, f"{base}/table"), updates_at_end=0, on_ranks=board)
    return rounded(board.table(), "rank")


# -- functions -------------------------------------------------------------------------------------------------


@query("scalar_functions", "SELECT event_id, round(ln(1 + event_id % 10) * ln(10000.0 / (1 + user_id)), 6) AS tf_idf, ((7919 * event_id + 13) % 7907) % 2 = 1 AS heads, round(1 / (1 + exp(-value / 100)), 6) AS logistic, least(greatest(value, 10.0), 60.0) AS clamped, epoch(date_trunc('second', ts))::BIGINT AS epoch FROM events")
def _(spark, d):
    e = table(spark, d, "events")
    out = e.select(
        "event_id", scalar.tf_idf(F.col("event_id") % 10, F.lit(10000.0), 1 + F.col("user_id")).alias("tf_idf"), scalar.heads(F.col("event_id"), 7919, 13).alias("heads"),
        scalar.logistic(F.col("value") / 100).alias("logistic"), scalar.clamp(F.col("value"), 10.0, 60.0).alias("clamped"), scalar.epoch(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("epoch"),
    )
    return rounded(out, "tf_idf", "logistic")


@query("string_functions", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'user' || user_id WHEN event_id % 3 = 1 THEN NULL ELSE 'x' || event_id END AS name, CASE WHEN event_id % 400 <= 255 THEN 10 * 16777216 + (event_id % 400) * 256 + user_id % 256 END::BIGINT AS ip, event_type || '|' || user_id AS tokens FROM events")
def _(spark, d):
    """Names: with @, with a slash, plain. Addresses: some beyond 255. JSON objects: values by name."""
    e = table(spark, d, "events")
    name = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("@User"), F.col("user_id"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("a/b"), F.col("event_id"))).otherwise(F.concat(F.lit("X"), F.col("event_id")))
    ip = F.concat_ws(".", F.lit("10"), F.lit("0"), (F.col("event_id") % 400).cast("string"), (F.col("user_id") % 256).cast("string"))
    cells = F.to_json(F.struct(F.col("event_type").alias("a"), F.col("user_id").alias("b")))
    return e.select("event_id", scalar.user_name(name).alias("name"), scalar.ip_number(ip).alias("ip"), F.concat_ws("|", scalar.json_tokens(cells)).alias("tokens"))


@query("array_functions", "SELECT user_id, event_id, round(a * b + 2.0 * a, 6) AS dot, round(a * b * 0.5 + 2.0 * a * 3.0, 6) AS dot3, round(a * a + 4.0, 6) AS squares, round((b * 2.0 - a) / (4.0 * a - 1), 6) AS x FROM (SELECT user_id, event_id, 1 + event_id % 7 a, value b FROM events)")
def _(spark, d):
    e = table(spark, d, "events").withColumns({"a": (1 + F.col("event_id") % 7).cast("double"), "b": F.col("value")})
    one, two, three = F.array("a", F.lit(2.0)), F.array("b", F.col("a")), F.array(F.lit(0.5), F.lit(3.0))
    x = scalar.solve2(2 * F.col("a"), F.lit(1.0), F.lit(2.0), F.col("b"), F.col("a"))[0]
    return rounded(e.select("user_id", "event_id", scalar.dot(one, two).alias("dot"), scalar.dot3(one, two, three).alias("dot3"), scalar.sum_of_squares(one).alias("squares"), x.alias("x")), "dot", "dot3", "squares", "x")
