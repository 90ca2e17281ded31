"""Operators without SQL, readers and streams on small inputs."""

import math
import struct

from pyspark.sql import functions as F

from tidegraph.operators import etl, factorisation, graph, similarity
from tidegraph.sources import generators, sinks, text
from tidegraph.streaming import ingest


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src long, dst long")


def test_spanning_forest(spark):
    e = spark.createDataFrame([(1, 2, 5), (2, 3, 1), (1, 3, 1), (4, 5, 7), (5, 4, 3), (3, 3, 0)], "src long, dst long, weight long")
    assert rows(graph.spanning_forest(e)) == [(1, 3, 1), (2, 3, 1), (4, 5, 3)]


def test_k_core_at_once_and_by_rounds(spark, monkeypatch):
    """A long chain, a clique, loops, reciprocal and repeated edges: one task's levels are those of the rounds."""
    import random

    rng = random.Random(2)
    e = [(k, k + 1) for k in range(100, 120)] + [(a, b) for a in range(8) for b in range(a)] + [(9, 9), (9, 8), (8, 9), (30, 30)]
    e += [(rng.randrange(40, 70), rng.randrange(40, 70)) for _ in range(90)] + [(7, 40), (7, 40)]
    e = spark.createDataFrame(e, "src long, dst long")
    once = rows(graph.k_core(e))
    monkeypatch.setattr(graph, "PEELED_AT_ONCE", 40)
    later = rows(graph.k_core(e))
    monkeypatch.setattr(graph, "PEELED_AT_ONCE", 0)
    assert once == later == rows(graph.k_core(e))
    monkeypatch.undo()
    writes, write = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: writes.append(name) or write(df, name))
    chain = spark.range(60).selectExpr("id as src", "id + 1 as dst")
    assert {c for _, c in rows(graph.k_core(chain))} == {1} and len(writes) < 6


def test_k_core_of_large_graphs_writes_edges_once(spark, monkeypatch):
    """Blocks of vertices, parts of blocks and sparse ids: the levels of one task, without a table of edges per round."""
    import random

    from tidegraph.operators import cores

    rng = random.Random(3)
    pairs = [(rng.randrange(90), rng.randrange(90)) for _ in range(500)] + [(k, k + 1) for k in range(90, 130)] + [(3, 3), (3, 3)]
    for step in (1, 10**12):
        e = spark.createDataFrame([((a - 40) * step, (b - 40) * step) for a, b in pairs], "src long, dst long")
        once = rows(graph.k_core(e))
        assert len(once) == len({x for p in pairs for x in p}) and once[-1] == (90 * step, 1)
        writes, dropped, write, drop = [], [], graph.written, graph.discard
        with monkeypatch.context() as m:
            m.setattr(graph, "PEELED_AT_ONCE", 10)
            for at in (graph, cores):
                m.setattr(at, "written", lambda df, name, **o: writes.append(name) or write(df, name, **o))
                m.setattr(at, "discard", lambda *t: dropped.extend(t) or drop(*t))
            m.setattr(cores, "BLOCK_ENDS", 200)
            m.setattr(cores, "PART_ENDS", 60)
            assert rows(graph.k_core(e)) == once
            assert writes == ["edges", "degrees", "blocks", "core"] and len(dropped) == 3
            m.setattr(graph, "MOST_SETTLED", 0)
            assert step > 1 or rows(graph.k_core(e)) == once


def test_k_core_and_triangles(spark):
    e = edges(spark, (0, 1), (1, 2), (0, 2), (2, 3))
    assert rows(graph.k_core(e)) == [(0, 2), (1, 2), (2, 2), (3, 1)]
    assert rows(graph.triangles(e)) == [(0, 1), (1, 1), (2, 1)]


def test_strong_components(spark):
    e = edges(spark, (1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 1))
    assert rows(graph.strong_components(e)) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6)]


def test_long_chain_is_one_component(spark):
    labels = graph.connected_components(generators.chain(spark, 60))
    assert labels.count() == 60 and labels.where("label <> 0").count() == 0


def test_generators(spark):
    n = 5
    assert generators.grid(spark, n).count() == 2 * n * (n - 1)
    assert generators.crossgrid(spark, n).count() == 2 * n * (n - 1) + 2 * (n - 1) ** 2
    assert generators.cubegrid(spark, n).count() == 3 * n * n * (n - 1)
    assert generators.quadgrid(spark, 3).count() == 4 * 27 * 2
    assert graph.triangles(generators.grid(spark, n)).count() == 0
    drawn = generators.erdos_renyi(spark, 60, 0.1).count()
    assert 100 < drawn < 260


def test_readers(spark, tmp_path):
    def put(name, content):
        p = tmp_path / name
        p.write_bytes(content if isinstance(content, bytes) else content.encode())
        return str(p)

    assert rows(text.load_graph(spark, put("e", "# c\n1\t2\t0.5\n2,3\n4 4\n% x\n"), "edgelist")) == [(1, 2, 0.5), (2, 3, 0.0)]
    assert rows(text.load_graph(spark, put("m", "1 2 3:4:5\n"), "multivalue")) == [(1, 2, [3.0, 4.0, 5.0])]
    assert rows(text.load_graph(spark, put("a", "1 3 2 5 9\n2 1 2\n"), "adjlist")) == [(1, 2), (1, 5), (1, 9)]
    assert rows(text.load_graph(spark, put("metis", "3 2\n1 2\n2\n0\n"), "metis")) == [(0, 1), (0, 2), (1, 2)]
    assert rows(text.load_graph(spark, put("cas", "1 2\n5\n6\n2 1\n7\n"), "cassovary")) == [(1, 5), (1, 6), (2, 7)]
    assert rows(text.load_graph(spark, put("bin", struct.pack("<IIfIIf", 1, 2, 0.5, 3, 4, 1.5)), "binedgelist", value="<f4")) == [(1, 2, 0.5), (3, 4, 1.5)]
    mm = "%%MatrixMarket matrix coordinate real general\n% c\n4 4 3\n1 2 3.5\n4 4 3\n2 2 0\n"
    assert rows(text.load_graph(spark, put("mm", mm), "matrixmarket")) == [(0, 1, 3.5), (3, 3, 3.0)]
    assert rows(text.load_graph(spark, put("bi", "2 2 2\n1 1 5\n2 1 3\n"), "bipartite")) == [(0, 2, 5.0), (1, 2, 3.0)]
    assert rows(text.load_graph(spark, put("ips", "1.2.3.4 5.6.7.8 a\n1.2.3 5.6.7.8 b\n1.2.3.400 1.1.1.1 c\n"), "ips")) == [("1.2.3.4", "5.6.7.8", "a")]
    assert rows(text.load_graph(spark, put("cdr", "2011-12-05 00:00:00\t15\t22\t1\t39\n"), "cdr")) == [(15, 22, 1323043200, 39)]
    t = text.load_graph(spark, put("tw", "T\t2011-12-05 00:00:00\nU\thttp://x.com/Ann\nW\tRT @Bob hi @cy\n\n"), "tweets")
    assert rows(etl.mentions(t)) == [("ann", "bob", 2), ("ann", "cy", 1)]


def test_sinks(spark, tmp_path):
    e = edges(spark, (1, 2), (1, 3), (2, 1))
    sinks.adjacency(e, str(tmp_path / "adj"))
    assert rows(text.adjacency_list(spark, str(tmp_path / "adj"))) == [(1, 2), (1, 3), (2, 1)]
    sinks.delimited(e, str(tmp_path / "tsv"))
    assert text.edge_list(spark, str(tmp_path / "tsv")).count() == 3


def test_similarity_golden(spark):
    """Weighted Jaccard and rating fixtures worked by hand."""
    e = spark.createDataFrame([(2, 1, 2.0), (3, 1, 1.0)], "src long, dst long, weight double")
    assert [(a, b, round(s, 6)) for a, b, s in rows(similarity.weighted_jaccard(e))] == [(2, 1, 0.666667), (3, 1, 0.333333)]
    r = spark.createDataFrame([(1, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0)], "u long, i long, r double")
    s = spark.createDataFrame([(1, 3, 0.5), (2, 3, 1.0)], "a long, b long, sim double")
    got = [(u, i, round(x, 6)) for u, i, x, _ in rows(similarity.ratings_from_similarity(r, s, 5).select("u", "i", "score", "rank"))]
    assert got == [(1, 3, 1.125), (2, 1, 0.125), (2, 2, 1.0)]


def test_first_per_key_in_order(spark):
    df = spark.createDataFrame([(1, 9, 0), (1, 8, 1), (1, 7, 2), (2, 1, 3)], "k long, v long, line long")
    assert rows(etl.first_per_key(df, "k", "line", 2)) == [(1, 8, 1), (1, 9, 0), (2, 1, 3)]


def test_factorisation(spark):
    data = [(u, i, (u + 1.0) * (i + 1.0)) for u in range(5) for i in range(4)]
    r = spark.createDataFrame(data, "u long, i long, r double")
    for fitted in (factorisation.als(r, 2, 5, reg=0.001), factorisation.nmf(r, 2, 8)):
        p = factorisation.predictions(r, *fitted, 2)
        assert p.agg(F.sqrt(F.avg((F.col("r") - F.col("prediction")) ** 2))).first()[0] < 0.3
    s, _, _ = factorisation.svd(r.select(F.col("u").alias("row"), F.col("i").alias("col"), F.col("r").alias("val")), 2, 6)
    assert math.isclose(s[0], math.sqrt(55 * 30), rel_tol=1e-6) and s[1] < 1e-3
    u, v, mean = factorisation.sgd(r, 2, 3, rate=0.01, bias=True, blocks=2)
    assert u.count() == 5 and v.count() == 4 and mean == 7.5
    t = spark.createDataFrame([(u, i, k, (u + 1.0) * (i + 1.0) * (k + 1.0)) for u in range(3) for i in range(3) for k in range(2)], "u long, i long, t long, r double")
    assert all(x.count() for x in factorisation.tensor_als(t, 2, 2))


def test_stream_equals_batch(spark, tmp_path):
    e = edges(spark, (0, 1), (1, 2), (2, 0), (2, 3), (3, 0), (0, 2))
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("src long, dst long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    table = ingest.EdgeTable(spark, str(tmp_path / "table"))
    ranks = ingest.follow(source, table, updates_at_end=60)
    want = {r["id"]: r["rank"] for r in graph.pagerank(e, 90).collect()}
    assert all(math.isclose(r["rank"], want[r["id"]], rel_tol=1e-3) for r in ranks.collect())
    table.delete(edges(spark, (0, 1)), 0)
    assert (0, 1) not in rows(table.edges()) and rows(table.compact(str(tmp_path / "c")).edges()) == rows(table.edges())


def test_cosamp():
    """A fixture of the toolkit: the published result of one entry of three."""
    import numpy as np

    a = np.array([[0.9528, 0.5982, 0.8368], [0.7041, 0.8407, 0.5187], [0.9539, 0.4428, 0.0222]])
    b = np.array([0.3759, 0.8986, 0.4290])
    got = factorisation.cosamp(a, b, 1)
    assert np.count_nonzero(got) == 1 and np.linalg.norm(got - [0, 1.2032, 0]) < 1e-4
    x = np.zeros(40)
    x[[3, 17, 30]] = [2.0, -1.5, 3.0]
    m = np.random.default_rng(2).normal(size=(30, 40))
    assert np.allclose(factorisation.cosamp(m, m @ x, 3), x)


def test_singular_values(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    m = rng.normal(size=(30, 12)) * (rng.random((30, 12)) < 0.5)
    df = spark.createDataFrame([(i, j, float(m[i, j])) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(m)), strict=True)], "row long, col long, val double")
    want = np.linalg.svd(m)[1]
    s, u, v = factorisation.svd(df, 3, 25)
    assert np.allclose(s, want[:3], rtol=1e-4)
    uu, vv = (np.array([r["f"] for r in sorted(x.collect())]) for x in (u, v))
    assert np.allclose(uu.T @ m[[r["id"] for r in sorted(u.collect())]][:, [r["id"] for r in sorted(v.collect())]] @ vv, np.diag(want[:3]), atol=2e-2)
    s, v = factorisation.svd_one_sided(df, 3, 9)
    assert np.allclose(s, want[:3], rtol=1e-8)
    vv = np.array([r["f"] for r in sorted(v.collect())])
    assert np.allclose(vv.T @ vv, np.eye(3), atol=1e-8) and np.allclose(np.linalg.norm(m[:, [r["id"] for r in sorted(v.collect())]] @ vv, axis=0), want[:3])


def test_least_squares_in_parts(spark, monkeypatch):
    """An id with many ratings is summed in parts, with the same result."""
    import numpy as np

    rng = np.random.default_rng(1)
    f = rng.normal(size=(50, 3))
    rows = [(0, i, float(rng.normal())) for i in range(50)] + [(u, int(i), float(rng.normal())) for u in range(1, 6) for i in rng.choice(50, 7, False)]
    r = spark.createDataFrame(rows, "u long, i long, r double")
    fixed = spark.createDataFrame([(i, f[i].tolist()) for i in range(50)], factorisation.FACTORS)
    old = spark.createDataFrame([(u, [0.1, 0.2, 0.3]) for u in range(6)], factorisation.FACTORS)

    def got(**kw):
        return {x["id"]: x["f"] for x in factorisation.half_step(r, fixed, "u", "i", reg=0.1, **kw).collect()}

    whole, swept = got(), got(coordinate=True, own=old)
    for u in range(6):
        q, y = f[[i for v, i, _ in rows if v == u]], np.array([x for v, _, x in rows if v == u])
        assert np.allclose(whole[u], np.linalg.solve(q.T @ q + 0.1 * np.eye(3), q.T @ y))
    monkeypatch.setattr(factorisation, "ROWS_A_TASK", 8)
    for a, b in ((whole, got()), (swept, got(coordinate=True, own=old))):
        assert all(np.allclose(a[u], b[u]) for u in range(6))


def test_item_pairs_of_a_hot_user(spark, monkeypatch):
    r = spark.createDataFrame([(u, i, float(i)) for u in (1, 2) for i in range(20 if u == 1 else 4)], "u long, i long, r double")
    want = rows(similarity.item_pairs(r))
    monkeypatch.setattr(similarity, "ROWS_A_BLOCK", 3)
    assert rows(similarity.item_pairs(r)) == want and len(want) == 190 + 6


def test_orders(spark):
    from tidegraph.operators import ordering

    df = spark.createDataFrame([(k * 7 % 100, k % 5, None if k % 3 else k) for k in range(100)], "id long, v long, w long").repartition(5)
    got = {r["id"]: r for r in ordering.running_sum(df, F.col("v"), [F.col("id")], "before").collect()}
    total, last = 0, None
    carried = {r["id"]: r["last"] for r in ordering.running_last(df, F.col("w"), [F.col("id")], "last").collect()}
    for i in range(100):
        assert got[i]["before"] == total
        total += got[i]["v"]
        last = got[i]["w"] if got[i]["w"] is not None else last
        assert carried[i] == last
    empty = df.where("id < 0")
    assert ordering.row_numbers(empty, [F.col("id")], "n").count() == 0


def test_numbered_lines_of_many_blocks(spark, tmp_path):
    from tidegraph.sources import text as t

    p = tmp_path / "long"
    p.write_text("".join(f"line {k}\n" for k in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = {r["n"]: r["value"] for r in t.numbered_lines(spark, str(p)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {k: f"line {k}" for k in range(5000)}


def test_components_of_odd_graphs(spark):
    import random

    rng = random.Random(6)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(5, 5)]
    up = {v: v for p in pairs for v in p}

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in pairs:
        up[max(root(a), root(b))] = min(root(a), root(b))
    from tidegraph.operators import programs

    want = sorted((v, root(v)) for v in up)
    assert rows(graph.connected_components(edges(spark, *pairs))) == want
    assert rows(programs.components_while_loading(edges(spark, *pairs).repartition(3))) == want
    assert graph.connected_components(edges(spark, (1, 1)).where("false")).count() == 0


def test_stream_goes_on_after_a_stop(spark, tmp_path):
    """A second run takes only what is new, from the ranks of the run before."""
    e = edges(spark, (0, 1), (1, 2), (2, 0))
    e.write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema("src long, dst long").parquet(str(tmp_path / "in"))
    table = ingest.EdgeTable(spark, str(tmp_path / "table"))
    ingest.follow(source(), table, updates_at_end=0)
    edges(spark, (2, 3), (3, 0)).write.mode("append").parquet(str(tmp_path / "in"))
    got = {r["id"]: r["rank"] for r in ingest.follow(source(), table, updates_at_end=80).collect()}
    want = {r["id"]: r["rank"] for r in graph.pagerank(table.edges(), 90).collect()}
    assert len(rows(table.edges())) == 5 and all(math.isclose(got[k], want[k], rel_tol=1e-3) for k in want)
