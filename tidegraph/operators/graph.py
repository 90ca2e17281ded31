"""Vertex programs over edge tables: gather along edges, combine, apply; and the algorithms built on them.

All loops are bulk-synchronous: the state of a round is a table written to the shared folder, a round is one join
of the edges with it and one aggregation, whose partial sums are made before the exchange.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.operators.cores import counted, settled_by_blocks
from tidegraph.operators.ordering import row_numbers, running_sum
from tidegraph.plans.tables import discard, written


#: As many edges are peeled in one task (some 60 bytes each).
PEELED_AT_ONCE = 8_000_000
#: Of as many vertices the driver holds a value each (12 bytes, and some while they arrive).
MOST_SETTLED = 30_000_000


def vertices_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def all_vertices(edges: DataFrame) -> DataFrame:
    """Ids from 0 to the largest, those without edges included."""
    top = edges.agg(F.max(F.greatest("src", "dst"))).first()[0]
    return edges.sparkSession.range(0 if top is None else top + 1)


def undirected(edges: DataFrame, distinct: bool = True) -> DataFrame:
    both = edges.select("src", "dst").union(edges.select("dst", "src"))
    return both.distinct() if distinct else both


def degrees(edges: DataFrame, implicit: bool = False) -> DataFrame:
    """id, in_degree, out_degree; zero where a side has none."""
    ends = edges.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(edges.select("dst", F.lit(1), F.lit(0)))
    if implicit:
        ends = ends.union(all_vertices(edges).select("id", F.lit(0), F.lit(0)))
    return ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def aggregate_messages(edges: DataFrame, state: DataFrame, message: Column, combine: Callable[[Column], Column], back: bool = False) -> DataFrame:
    """id and m: combine over the messages along the edges (or against them); message may use src, dst, edge columns and the sender's state."""
    sender, receiver = ("dst", "src") if back else ("src", "dst")
    sent = edges.join(state, F.col(sender) == F.col("id")).select(F.col(receiver).alias("to"), message.alias("msg"))
    return sent.groupBy(F.col("to").alias("id")).agg(combine(F.col("msg")).alias("m"))


def iterate(edges: DataFrame, state: DataFrame, message: Column, combine, apply: Callable[[Column], dict[str, Column]], rounds: int, until_still: str | None = None, both: bool = False, hook=None) -> DataFrame:
    """`rounds` times: gather, combine, apply (new columns from the message m, null where none came).

    until_still: a column; ends early when no vertex changes it. hook(round, state) is called after each round.
    """
    edges = written(undirected(edges, distinct=False) if both else edges, "edges")
    state = written(state, "state")
    for k in range(rounds):
        got = aggregate_messages(edges, state, message, combine).withColumnRenamed("id", "_to")
        state_now = state.drop("_changed")
        following = state_now.join(got, F.col("id") == F.col("_to"), "left").withColumns({f"_{c}": e for c, e in apply(F.col("m")).items()})
        names = [c[1:] for c in following.columns if c.startswith("_") and c not in ("_to", "_changed")]
        changed = (F.col(f"_{until_still}") != F.col(until_still)) if until_still else F.lit(False)
        old, state = state, written(following.select(*[F.col(f"_{c}").alias(c) if c in names else F.col(c) for c in state_now.columns], changed.alias("_changed")), "state")
        if hook:
            hook(k, state)
        moved = state.where("_changed").limit(1).count() if until_still else 1
        discard(old)
        if not moved:
            break
    discard(edges)
    return state.drop("_changed")


def pagerank(edges: DataFrame, updates: int, normalised: bool = False) -> DataFrame:
    """id, rank: rank = 0.15 + 0.85 * sum of rank / out-degree over in-edges, from 1 for all; 0.15 / n if normalised."""
    deg = degrees(edges).select("id", "out_degree")
    base = 0.15 / max(1, deg.count()) if normalised else 0.15
    state = deg.select("id", F.lit(1.0).alias("rank"), "out_degree")
    out = iterate(edges, state, F.col("rank") / F.col("out_degree"), F.sum, lambda m: {"rank": F.lit(base) + 0.85 * F.coalesce(m, F.lit(0.0))}, updates)
    return out.select("id", "rank")


def top(df: DataFrame, value: str, k: int) -> DataFrame:
    return df.orderBy(F.col(value).desc(), "id").limit(k)


def connected_components(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """id, label: the least id of the weak component.

    Each round every vertex joins its least neighbour, the trees are folded into their roots, and edges between roots
    are all that is left, once each. A vertex with an edge is no root or has a neighbour that is none, so vertices
    halve and a round costs less than the one before. Raises after `rounds` rounds (of halvings).
    """
    live = written(edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct(), "live")
    labels = written(vertices_of(edges).select("id", F.col("id").alias("label")), "labels")
    for _ in range(rounds):
        if live.limit(1).count() == 0:
            return labels
        # of two ends only the larger has the other as a smaller neighbour
        up = written(live.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("up")), "up")
        while True:
            further = up.select(F.col("id").alias("up"), F.col("up").alias("over"))
            before, up = up, written(up.join(further, "up", "left").select("id", F.coalesce("over", "up").alias("up"), F.col("over").isNotNull().alias("moved")), "up")
            discard(before)
            if up.where("moved").limit(1).count() == 0:
                break
        to = lambda c: up.select(F.col("id").alias(c), F.col("up").alias(f"{c}_up"))
        old, labels = labels, written(labels.join(to("label"), "label", "left").select("id", F.coalesce("label_up", "label").alias("label")), "labels")
        discard(old)
        moved = live.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("a_up", "a").alias("a"), F.coalesce("b_up", "b").alias("b")).where("a <> b")
        old, live = live, written(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "live")
        discard(old, up)
    raise RuntimeError(f"components are not settled after {rounds} rounds")


def component_sizes(labels: DataFrame, include_singletons: bool = True) -> DataFrame:
    out = labels.groupBy("label").agg(F.count("*").alias("size"))
    return out if include_singletons else out.where("size > 1")


def component_edges(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """label, edges: how many edges lie in each component."""
    return edges.join(labels, F.col("src") == F.col("id")).groupBy("label").agg(F.count("*").alias("edges"))


def percolation(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Histograms: sites (component size -> components) and bonds (edges of a component -> components)."""
    labels = connected_components(edges)
    sites = component_sizes(labels).groupBy("size").agg(F.count("*").alias("components"))
    bonds = component_edges(edges, labels).groupBy("edges").agg(F.count("*").alias("components"))
    return sites, bonds


def communities(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """id, label: each round the commonest label of the neighbours (in and out), the larger of equally common ones."""
    e = written(undirected(edges, distinct=False), "edges")
    state = written(vertices_of(e).select("id", F.col("id").alias("label")), "state")
    for _ in range(rounds):
        votes = e.join(state, F.col("dst") == F.col("id")).groupBy("src", "label").agg(F.count("*").alias("n"))
        state = written(votes.groupBy("src").agg(F.max_by("label", F.struct("n", "label")).alias("label")).select(F.col("src").alias("id"), "label"), "state")
    return state


def strong_components(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """id, label: the least id of the strong component, by trimming and forward and backward colouring."""
    left = written(edges.select("src", "dst").where("src <> dst").distinct(), "edges")
    nodes = written(vertices_of(edges), "nodes")
    done = written(nodes.where("false").select("id", F.col("id").alias("label")), "done")
    for _ in range(rounds):
        if left.limit(1).count() == 0:
            break
        inner = left.select(F.col("src").alias("id")).intersect(left.select("dst"))  # trimming: no in- or no out-edge
        kept = left.join(inner.select(F.col("id").alias("src")), "src", "left_semi").join(inner.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")
        kept = written(kept, "edges")
        if kept.count() < left.count():
            left = kept
            continue
        state = vertices_of(left).select("id", F.col("id").alias("colour"))
        state = iterate(left, state, F.col("colour"), F.min, lambda m: {"colour": F.least("colour", F.coalesce(m, F.col("colour")))}, rounds, "colour")
        # backward from the roots, inside a colour
        near = written(state.where("id = colour"), "reached")
        frontier, colours = near, written(state, "colours")
        coloured = written(left.join(colours.select(F.col("id").alias("src"), F.col("colour").alias("cs")), "src").join(colours.select(F.col("id").alias("dst"), F.col("colour").alias("cd")), "dst").where("cs = cd").select("src", "dst", F.col("cs").alias("c")), "inside")
        while frontier.limit(1).count():
            back = coloured.join(frontier.select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("id"), F.col("c").alias("colour")).distinct()
            frontier = written(back.join(near.select("id"), "id", "left_anti"), "frontier")
            near = written(near.union(frontier), "reached")
        done = written(done.union(near.select("id", F.col("colour").alias("label"))), "done")
        gone = near.select("id")
        left = written(left.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"), "edges")
    return nodes.join(done, "id", "left").select("id", F.coalesce("label", "id").alias("label"))


def spanning_forest(edges: DataFrame) -> DataFrame:
    """src, dst, weight of a minimum spanning forest; ties by (weight, src, dst), so that rounds make no cycles (Boruvka)."""
    all_edges = written(edges.where("src <> dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.min("weight").alias("weight")), "edges")
    live = written(all_edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.struct("weight", "src", "dst").alias("e")), "live")
    forest = written(all_edges.where("false"), "forest")
    while live.limit(1).count():
        both = live.union(live.select("b", "a", "e"))
        best = written(both.groupBy("a").agg(F.min("e").alias("e")).select("e").distinct(), "best")
        forest = written(forest.unionByName(best.select("e.src", "e.dst", "e.weight")), "forest")
        chosen = live.join(best, "e", "left_semi").select(F.col("a").alias("src"), F.col("b").alias("dst"))
        labels = written(connected_components(chosen), "labels")
        to = lambda c: labels.select(F.col("id").alias(c), F.col("label").alias(f"n{c}"))
        moved = live.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("na", "a").alias("a"), F.coalesce("nb", "b").alias("b"), "e").where("a <> b")
        live = written(moved.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("e").alias("e")), "live")
    return forest


def contracted(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """src, dst, weight: the graph of components; edges between their labels, the least weight of parallel ones."""
    to = lambda c: labels.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label"))
    moved = edges.join(to("src"), "src").join(to("dst"), "dst").where("src_label <> dst_label")
    return moved.groupBy(F.col("src_label").alias("src"), F.col("dst_label").alias("dst")).agg(F.min("weight").alias("weight"))


def triangles(edges: DataFrame) -> DataFrame:
    """id, triangles: triangles at each vertex of the simple undirected graph; edges point from lower (degree, id)."""
    simple = written(edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct(), "edges")
    deg = simple.select(F.col("a").alias("v")).union(simple.select("b")).groupBy("v").agg(F.count("*").alias("d"))
    up = simple.join(deg.toDF("a", "da"), "a").join(deg.toDF("b", "db"), "b")
    low = F.struct("da", "a") < F.struct("db", "b")
    up = written(up.select(F.when(low, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("v")), "oriented")
    wedge = up.toDF("u", "v").join(up.toDF("u", "w"), "u").where("v <> w")
    closed = wedge.join(up.toDF("v", "w"), ["v", "w"])
    each = closed.select(F.explode(F.array("u", "v", "w")).alias("id"))
    return each.groupBy("id").agg(F.count("*").alias("triangles"))


def peeled(src: np.ndarray, dst: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and their levels, from level k on, by peeling; an edge stands once, but one from a vertex to itself twice."""
    ids = np.unique(np.concatenate([np.unique(src), np.unique(dst)]))
    src, dst = (np.searchsorted(ids, x).astype(np.int32) for x in (src, dst))
    other = src != dst
    src, dst = np.concatenate([src, dst[other]]), np.concatenate([dst, src[other]])
    near = dst[np.argsort(src, kind="stable")]
    degree = np.bincount(src, minlength=len(ids))
    start, n = np.cumsum(degree) - degree, degree.copy()
    level, left = np.zeros(len(ids), np.int32), np.ones(len(ids), bool)
    while len(over := np.flatnonzero(left)):
        k = max(k, int(degree[over].min()))
        low = over[degree[over] <= k]
        while len(low):
            level[low], left[low] = k, False
            at = np.repeat(start[low] - (np.cumsum(n[low]) - n[low]), n[low]) + np.arange(int(n[low].sum()))
            met, times = np.unique(near[at], return_counts=True)
            degree[met] -= times
            low = met[left[met] & (degree[met] <= k)]
    return ids, level


def k_core(edges: DataFrame) -> DataFrame:
    """id, core: peeling; at level k vertices with k or fewer live incident edges go (a reciprocal pair is two edges).

    A vertex whose edges all went with others has the level of that round. Levels at which no vertex goes are skipped.
    Up to PEELED_AT_ONCE edges are peeled in one task. More are settled block by block, which holds a value per vertex
    in the driver; beyond MOST_SETTLED vertices it goes round by round over the edges.
    """
    live = written(edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).where("src is not null and dst is not null"), "edges")
    n = live.count()
    if n <= PEELED_AT_ONCE:
        return written(_peeled_at_once(live.union(live.where("src = dst")), 1), "core")
    # a task passes on a count for most vertices, however many edges it reads: few tasks
    ends = live.coalesce(6 + n // 8_000_000).mapInArrow(counted, "id long, n long")
    deg = written(ends.groupBy("id").agg(F.sum("n").alias("d")), "degrees")
    out = settled_by_blocks(live, deg) if deg.count() <= MOST_SETTLED else _peeled_by_rounds(live)
    discard(live, deg)
    return out


def _peeled_by_rounds(edges: DataFrame) -> DataFrame:
    live = written(undirected(edges, distinct=False), "edges")
    none = live.where("false").select(F.col("src").alias("id"), F.lit(0).alias("core"))
    done, parts, k = written(none, "core"), [], 1
    while True:
        deg = written(live.groupBy("src").agg(F.count("*").alias("d")), "degrees")
        least, ends = deg.agg(F.min("d"), F.sum("d")).first()
        if least is None:
            break
        if ends <= 2 * PEELED_AT_ONCE:
            parts.append(written(_peeled_at_once(live.where("src <= dst"), k), "core"))
            break
        k = max(k, least)
        low = deg.where(F.col("d") <= k).select(F.col("src").alias("id"))
        rest = written(live.join(low.withColumnRenamed("id", "src"), "src", "left_anti").join(low.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"), "edges")
        # with them go the neighbours whose edges are all gone
        parts.append(written(deg.join(rest.select("src"), "src", "left_anti").select(F.col("src").alias("id"), F.lit(k).alias("core")), "core"))
        if len(parts) == 20:
            done, parts = written(_union([done, *parts]), "core"), []
        discard(live, deg)
        live = rest
    return _union([done, *parts])


def _peeled_at_once(half: DataFrame, k: int) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        found = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if found:
            ids, level = peeled(*(np.concatenate(x) for x in zip(*found, strict=True)), k)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(level)], names=["id", "core"])

    return half.repartition(1).mapInArrow(run, "id long, core int")


def k_core_levels(cores: DataFrame, edges: DataFrame) -> DataFrame:
    """k, removed, removed_to_here, links_left: what each level takes; links_left are the edges between vertices beyond it."""
    per = cores.groupBy(F.col("core").alias("k")).agg(F.count("*").alias("removed"))
    of = lambda c: cores.select(F.col("id").alias(c), F.col("core").alias(f"{c}_core"))
    gone = edges.join(of("src"), "src").join(of("dst"), "dst").groupBy(F.least("src_core", "dst_core").alias("k")).agg(F.count("*").alias("links"))
    # a row per level: their number is the largest coreness, not the graph's size
    order = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    both = per.join(gone, "k", "left").withColumn("links", F.coalesce("links", F.lit(0)))
    total = F.sum("links").over(Window.partitionBy())
    return both.select("k", "removed", F.sum("removed").over(order).alias("removed_to_here"), (total - F.sum("links").over(order)).alias("links_left"))


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def label_spreading(edges: DataFrame, seeds: DataFrame, rounds: int, alpha: float = 0.15, renormalise: bool = True) -> DataFrame:
    """id, topic, p: p <- alpha p + (1 - alpha) weighted mean of the out-neighbours; seeds (id, topic, p) stay.

    renormalise: each vertex' p sum to one after a round (without it: co-training of two kinds of vertices).
    """
    e = written(edges.select("src", "dst", "weight"), "edges")
    fixed = written(seeds, "seeds")
    free = fixed.select("id").distinct()
    state = fixed
    for _ in range(rounds):
        got = e.join(state, F.col("dst") == F.col("id")).groupBy("src", "topic").agg(F.sum(F.col("weight") * F.col("p")).alias("s"))
        if renormalise:
            got = got.withColumn("t", F.sum("s").over(Window.partitionBy("src")))
        else:
            got = got.join(e.groupBy("src").agg(F.sum("weight").alias("t")), "src")
        new = got.where("t > 0").select(F.col("src").alias("id"), "topic", ((1 - alpha) * F.col("s") / F.col("t")).alias("p")).join(free, "id", "left_anti")
        old = state.join(free, "id", "left_anti").select("id", "topic", (alpha * F.col("p")).alias("p"))
        mixed = new.union(old).groupBy("id", "topic").agg(F.sum("p").alias("p"))
        if renormalise:
            mixed = mixed.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy("id")))
        state = written(mixed.union(fixed.select("id", "topic", "p")), "state")
    return state


def k_hop(edges: DataFrame, seeds: DataFrame, hops: int, most_edges: int | None = None) -> DataFrame:
    """src, dst, hop: edges first met when going out from the seeds (id), level by level, over the undirected graph.

    most_edges: so many in the order of (hop, src, dst) are the result; levels beyond are not searched.
    """
    e = written(undirected(edges), "edges")
    seen = written(seeds.select("id").distinct(), "seen")
    front, out = seen, None
    for k in range(1, hops + 1):
        step = written(e.join(front.withColumnRenamed("id", "src"), "src").select("src", "dst", F.lit(k).alias("hop")), "hop")
        out = step if out is None else out.union(step)
        front = written(step.select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti"), "front")
        seen = written(seen.union(front), "seen")
        if most_edges is not None and out.count() >= most_edges:
            break
    return out if most_edges is None else out.orderBy("hop", "src", "dst").limit(most_edges)


def random_walks(edges: DataFrame, sources: DataFrame, walks: int, steps: int, seed: int = 1) -> DataFrame:
    """id, arrivals: walks per source (id), each hop to an out-neighbour drawn by a hash; dead ends stop.

    The hash is MD5 of origin, walk, step and seed, so that a walk can be repeated anywhere.
    """
    e = written(edges.select("src", "dst", (F.row_number().over(Window.partitionBy("src").orderBy("dst")) - 1).alias("k")), "edges")
    deg = written(e.groupBy("src").agg(F.count("*").alias("d")), "degrees")
    at = sources.select("id", F.explode(F.sequence(F.lit(1), F.lit(walks))).alias("walk")).withColumn("origin", F.col("id"))
    total = None
    for step in range(steps):
        pick = at.join(deg, F.col("id") == F.col("src")).select("walk", "origin", "src", (F.conv(F.substring(F.md5(F.concat_ws("|", "origin", "walk", F.lit(step), F.lit(seed))), 1, 8), 16, 10).cast("long") % F.col("d")).alias("k"))
        at = written(pick.join(e, ["src", "k"]).select(F.col("dst").alias("id"), "walk", "origin"), "walks")
        came = at.groupBy("id").agg(F.count("*").alias("n"))
        total = came if total is None else total.union(came)
    return total.groupBy("id").agg(F.sum("n").alias("arrivals"))


def relabel_by_degree(edges: DataFrame) -> DataFrame:
    """id, new_id: ids in order of (degree, id), from 0."""
    d = degrees(edges).select("id", (F.col("in_degree") + F.col("out_degree")).alias("d"))
    return row_numbers(d, [F.col("d"), F.col("id")], "new_id", 0).select("id", "new_id")


def prefix_sums(edges: DataFrame) -> DataFrame:
    """id, start: in-edges of all vertices before, for vertices with in-edges (offsets of a column of sources)."""
    deg = degrees(edges).where("in_degree > 0").select("id", "in_degree")
    return running_sum(deg, F.col("in_degree"), [F.col("id")], "start").select("id", "start")


def by_destination(edges: DataFrame) -> DataFrame:
    """src, dst, place: edges in the order of (dst, src), with their place from 0."""
    return row_numbers(edges.select("src", "dst"), [F.col("dst"), F.col("src")], "place", 0)


def remove_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone, ["src", "dst"], "left_anti")
