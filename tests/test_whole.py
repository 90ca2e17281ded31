"""Queries run on the whole of their tables, against brute force."""

from test_queries import SF, db  # noqa: F401
from tidegraph.plans import registry
from tidegraph.sources import derived

def test_co_purchase(spark, db):  # noqa: F811
    want = db.execute("SELECT DISTINCT a.l_partkey, b.l_partkey FROM lineitem a JOIN lineitem b USING (l_orderkey) WHERE a.l_partkey < b.l_partkey").fetchall()
    assert sorted(map(tuple, derived.co_purchase(spark, SF).collect())) == sorted(want)


def test_spanning_forest_and_k_core(spark):
    edges = [tuple(r) for r in derived.co_purchase(spark, SF).collect()]
    label = {v: v for e in edges for v in e}

    def root(v):
        while label[v] != v:
            v = label[v]
        return v

    total = 0
    for w, a, b in sorted(((a * 7919 + b * 104729) % 1000, a, b) for a, b in edges):
        if root(a) != root(b):
            label[root(a)] = root(b)
            total += w
    forest = registry.queries()["spanning_forest_of_purchases"](spark, SF).collect()
    roots = {root(v) for v in label}
    assert len(forest) == len(label) - len(roots) and sum(r["weight"] for r in forest) == total
    near = {v: set() for v in label}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    core, k = {}, 1
    while near:
        low = [v for v, x in near.items() if len(x) <= k]
        if not low:
            k += 1
        for v in low:
            core[v] = k
            for x in near.pop(v):
                near.get(x, set()).discard(v)
    assert {r["id"]: r["core"] for r in registry.queries()["k_core_of_purchases"](spark, SF).collect()} == core


def strong(edges):
    """The least vertex that each vertex reaches and is reached from."""
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set())

    def reach(v):
        seen, todo = {v}, [v]
        while todo:
            new = out[todo.pop()] - seen
            seen |= new
            todo += new
        return seen

    r = {v: reach(v) for v in out}
    return {v: min(x for x in r[v] if v in r[x]) for v in out}


def test_strong_components(spark):
    edges = [tuple(r) for r in derived.user_next(spark, SF).collect()]
    assert {r["id"]: r["label"] for r in registry.queries()["strong_components"](spark, SF).collect()} == strong(edges)


def test_many_strong_components(spark):
    from tidegraph.operators import graph

    edges = [(7, 3), (3, 5), (5, 7), (5, 9), (9, 8), (8, 9), (8, 20), (20, 21), (21, 22), (22, 20), (30, 30), (31, 30), (40, 41), (41, 40), (41, 7)]
    got = graph.strong_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert {r["id"]: r["label"] for r in got} == strong(edges)


def test_ratings_of_many_users(spark, tmp_path):
    """Users and items beyond 1,000 stay."""
    duckdb = __import__("duckdb")
    c = duckdb.connect()
    c.execute(f"copy (select event_id, ts, user_id * 331 as user_id, event_type, value, '{{\"k\": ' || event_id * 7 % 1301 || '}}' as props from '{SF}/events.parquet') to '{tmp_path}/events.parquet' (format parquet)")
    c.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    got = registry.queries()["ratings_and_similarities"](spark, str(tmp_path)).select("src", "dst", "value", "kind").collect()
    assert sorted(map(tuple, got)) == sorted(c.execute(f"SELECT src, dst, value, kind FROM ({registry.oracle_sql()['ratings_and_similarities']})").fetchall())
    assert max(r["src"] for r in got if r["kind"] == 0) >= 1000 and max(r["dst"] for r in got) >= 2000
