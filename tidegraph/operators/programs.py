"""User-defined programs on graphs: gather, combine, apply, scatter, with an active set, hooks and a log of changes.

A program is a set of Column expressions; a round is a join of the edges with the state and one aggregation. Only
vertices that a round schedules gather again, and only edges into them are joined. State and frontier of each round
are tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.operators.graph import connected_components, degrees, vertices_of
from tidegraph.plans.tables import discard, written


@dataclass
class Program:
    """What a vertex program does.

    init: columns of the state from id, in_degree and out_degree. relation: a column `edge` of each edge, from src, dst,
    value and the degrees src_out, src_in, dst_out, dst_in, made once. message: what an edge brings, from `edge` and
    the sender's state. combine: an aggregate of messages. apply: new columns from the state and m (null where nothing
    came). gather: "in", "out" or "both" edges. changed: from the new state and the old one (columns old_<name>),
    whether the vertex wakes its neighbours. delta: what a round's log sums up.
    """

    init: dict[str, Column]
    message: Column
    combine: Callable[[Column], Column]
    apply: Callable[[Column], dict[str, Column]]
    relation: Column | None = None
    gather: str = "in"
    scatter: str = "out"
    changed: Column | None = None
    delta: Column | None = None
    before_round: Callable[[int, DataFrame], None] | None = None
    after_round: Callable[[int, DataFrame], None] | None = None
    log: list[tuple[int, int, int, float]] = field(default_factory=list)


def _directed(edges: DataFrame, way: str) -> DataFrame:
    """sender, receiver and edge of the edges that bring messages (way in: along the edge)."""
    along = edges.select(F.col("src").alias("sender"), F.col("dst").alias("receiver"), "edge")
    against = edges.select(F.col("dst").alias("sender"), F.col("src").alias("receiver"), "edge")
    return {"in": along, "out": against, "both": along.union(against)}[way]


def related(edges: DataFrame, relation: Column | None) -> DataFrame:
    """src, dst, edge: the relation of each edge (its value, or 1, if there is none)."""
    e = edges if "value" in edges.columns else edges.withColumn("value", F.lit(1.0))
    if relation is None:
        return e.select("src", "dst", F.col("value").alias("edge"))
    deg = degrees(edges)
    of = lambda c: deg.select(F.col("id").alias(c), F.col("out_degree").alias(f"{c}_out"), F.col("in_degree").alias(f"{c}_in"))
    return e.join(of("src"), "src").join(of("dst"), "dst").select("src", "dst", relation.alias("edge"))


def run(edges: DataFrame, program: Program, rounds: int, active: DataFrame | None = None, start: DataFrame | None = None) -> DataFrame:
    """id and the state's columns after `rounds` rounds, or before, when no vertex is scheduled any more.

    active: the vertices (id) of the first round; None: all. start: a state (id and its columns) instead of init. Without `changed` all vertices gather in every round.
    program.log gets (round, vertices that gathered, vertices that woke others, delta) for each round.
    """
    e = written(related(edges, program.relation), "edges")
    come, go = _directed(e, program.gather), _directed(e, {"out": "in", "in": "out", "both": "both"}[program.scatter])
    names = list(program.init)
    deg = degrees(edges)
    state = deg.select("id", *[c.alias(k) for k, c in program.init.items()], "in_degree", "out_degree") if start is None else deg.join(start.select("id", *names), "id").select("id", *names, "in_degree", "out_degree")
    state = written(state, "state")
    program.log.clear()
    for k in range(rounds):
        if program.before_round:
            program.before_round(k, state)
        wanted = come if active is None else come.join(active.select(F.col("id").alias("receiver")), "receiver", "left_semi")
        got = wanted.join(state, F.col("sender") == F.col("id")).select("receiver", program.message.alias("msg")).groupBy("receiver").agg(program.combine(F.col("msg")).alias("m"))
        turn = state if active is None else state.join(active.select("id"), "id", "left_semi")
        new = turn.join(got, F.col("id") == F.col("receiver"), "left")
        values = program.apply(F.col("m"))
        new = new.select("id", "in_degree", "out_degree", *[values.get(c, F.col(c)).alias(c) for c in names], *[F.col(c).alias(f"old_{c}") for c in names])
        moved = F.lit(True) if program.changed is None else F.coalesce(program.changed, F.lit(False))
        new = written(new.withColumns({"_moved": moved, "_delta": F.coalesce(program.delta, F.lit(0.0)) if program.delta is not None else F.lit(0.0)}), "turn")
        fields = ["id", *names, "in_degree", "out_degree"]
        rest = state.join(new.select("id"), "id", "left_anti").select(*fields) if active is not None else None
        old, state = state, written(new.select(*fields) if rest is None else rest.union(new.select(*fields)), "state")
        discard(old)
        n, woke, delta = new.agg(F.count("*"), F.count(F.when(F.col("_moved"), 1)), F.sum("_delta")).first()
        program.log.append((k, n, woke, float(delta or 0.0)))
        if program.after_round:
            program.after_round(k, state)
        if program.changed is not None:
            if not woke:
                break
            awake = new.where("_moved").select(F.col("id").alias("sender"))
            active = written(go.join(awake, "sender", "left_semi").select(F.col("receiver").alias("id")).distinct(), "active")
    return state.select("id", *names)


def delta_log(edges: DataFrame, program: Program) -> DataFrame:
    """iter, updates, work, delta of the last run: vertices that gathered, those that woke others, the sum of changes."""
    return edges.sparkSession.createDataFrame(program.log, "iter int, updates long, work long, delta double")


def pagerank_program(tolerance: float | None = None) -> Program:
    """PageRank; with a tolerance, a vertex wakes its out-neighbours only when its rank moves by so much or more."""
    step = F.abs(F.col("rank") - F.col("old_rank"))
    return Program(
        init={"rank": F.lit(1.0)}, message=F.col("rank") * F.col("edge"), combine=F.sum, relation=1 / F.col("src_out"),
        apply=lambda m: {"rank": 0.15 + 0.85 * F.coalesce(m, F.lit(0.0))}, changed=None if tolerance is None else step >= tolerance, delta=step,
    )


def least_label_program() -> Program:
    """Weak components: the least label of all neighbours until none changes."""
    return Program(
        init={"label": F.col("id")}, message=F.col("label"), combine=F.min, gather="both", scatter="both",
        apply=lambda m: {"label": F.least("label", F.coalesce(m, F.col("label")))}, changed=F.col("label") < F.col("old_label"), delta=(F.col("old_label") - F.col("label")).cast("double"),
    )


def reach_program(sources: Column) -> Program:
    """Least number of edges from the vertices for which `sources` (a condition on id) holds; null where none leads."""
    return Program(
        init={"hops": F.when(sources, F.lit(0).cast("long"))}, message=F.col("hops") + 1, combine=F.min,
        apply=lambda m: {"hops": F.least("hops", m)}, changed=F.col("hops").isNotNull() & (F.col("old_hops").isNull() | (F.col("hops") < F.col("old_hops"))),
    )


def in_edge_program(edges: DataFrame, relation: Column, init: Column, update: Callable[[Column], Column], rounds: int, combine=F.sum) -> DataFrame:
    """id, value: each round combines relation * sender's value over in-edges and updates; see Program for the relation's columns."""
    p = Program(init={"value": init}, message=F.col("value") * F.col("edge"), combine=combine, relation=relation, apply=lambda m: {"value": update(m)})
    return run(edges, p, rounds)


def aggregate_vertices(state: DataFrame, mapped: Column, combine: Callable[[Column], Column], final: Callable[[Column], Column] | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """result: one value over the vertices (with first <= id < last): map, combine, finish."""
    rows = state if first is None else state.where(F.col("id") >= first)
    rows = rows if last is None else rows.where(F.col("id") < last)
    out = rows.agg(combine(mapped).alias("result"))
    return out if final is None else out.select(final(F.col("result")).alias("result"))


def reset_edges(edges: DataFrame, value: float) -> DataFrame:
    return edges.withColumn("value", F.lit(float(value)))


def one_of_duplicates(edges: DataFrame, order: list[Column]) -> DataFrame:
    """Of edges with equal ends the first in the order stays, with its other columns."""
    others = [c for c in edges.columns if c not in ("src", "dst")]
    best = F.min_by(F.struct(*others), F.struct(*order)) if others else F.count("*")
    out = edges.groupBy("src", "dst").agg(best.alias("_e"))
    return out.select("src", "dst", *[F.col(f"_e.{c}") for c in others])


def components_while_loading(edges: DataFrame) -> DataFrame:
    """id, label: weak components, the edges joined by the task that reads them.

    Each task keeps a forest over the vertices of its own rows and hands on its links only, at most one per vertex, as
    soon as there are 2,000,000; the least id of a component is its label.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        def links() -> pa.RecordBatch:
            a = np.fromiter(up, np.int64, len(up))
            b = np.fromiter((root(x) for x in up), np.int64, len(up))
            up.clear()
            return pa.RecordBatch.from_arrays([pa.array(b), pa.array(a)], names=["src", "dst"])

        for batch in batches:
            for s, d in zip(batch.column("src").to_pylist(), batch.column("dst").to_pylist(), strict=True):
                a, b = root(s), root(d)
                up.setdefault(s, a)
                up.setdefault(d, b)
                if a != b:
                    up[max(a, b)] = min(a, b)
            if len(up) > 2_000_000:
                yield links()
        if up:
            yield links()

    return connected_components(edges.select("src", "dst").mapInArrow(join, "src long, dst long"))


def seed_edges(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """src, dst of edges whose ends are both seeds (id)."""
    s = seeds.select("id").distinct()
    return edges.select("src", "dst").join(s.withColumnRenamed("id", "src"), "src", "left_semi").join(s.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


def seed_degrees(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """id, in_degree, out_degree of the seeds (id); 0 for those without edges."""
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return seeds.select("id").distinct().join(degrees(edges), "id", "left").select("id", zero("in_degree"), zero("out_degree"))


def component_report(edges: DataFrame, labels: DataFrame, seeds: DataFrame) -> DataFrame:
    """label, nodes, edges, seeds of each component."""
    known = labels.join(seeds.select("id").distinct().withColumn("_seed", F.lit(1)), "id", "left")
    nodes = known.groupBy("label").agg(F.count("*").alias("nodes"), F.count("_seed").alias("seeds"))
    inside = edges.join(labels, F.col("src") == F.col("id")).groupBy("label").agg(F.count("*").alias("edges"))
    return nodes.join(inside, "label", "left").select("label", "nodes", F.coalesce("edges", F.lit(0).cast("long")).alias("edges"), "seeds")


def base_and_stream(edges: DataFrame, parts: int, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """One in `parts` edges, drawn by a hash, as the base; the rest, with a place in a shuffled order, as the stream."""
    h = F.md5(F.concat_ws("|", "src", "dst", F.lit(seed)))
    base = F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % parts == 0
    return edges.where(base), edges.where(~base).withColumn("order", F.substring(h, 9, 16))
