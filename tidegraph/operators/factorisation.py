"""Matrix factorisation and related models over ratings (u, i, r[, weight or time]).

Half-steps of alternating models gather a row's neighbours' factors with a join, sum its normal equations by parts
of bounded size and solve them; gradient models run in blocks whose rows and columns don't meet (strata), so that each block
is one task and steps inside it are sequential.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.plans.tables import written

FACTORS = "id long, f array<double>"


def initial(ids: DataFrame, dims: int, seed: int) -> DataFrame:
    """id, f: factors in [0, 1) / sqrt(dims), fixed by id and seed."""
    f = F.transform(F.sequence(F.lit(1), F.lit(dims)), lambda k: F.pmod(F.xxhash64("id", k, F.lit(seed)), F.lit(1_000_003)) / (1_000_003.0 * dims**0.5))
    return ids.select("id", f.alias("f"))


#: Ratings of one id that one task sums; ids with more are split over several.
ROWS_A_TASK = 200_000


def _spread(ratings: DataFrame, *keys: str) -> DataFrame:
    """ratings with a part number and the number of parts per key, so that an id with very many ratings is summed by
    several tasks.

    Rows with a null key go. Write the result before use: part numbers are random.
    """
    for k in keys:
        n = ratings.groupBy(k).agg(F.ceil(F.count("*") / ROWS_A_TASK).cast("int").alias(f"_parts_{k}"))
        ratings = ratings.join(n, k).withColumn(f"_part_{k}", F.floor(F.rand(1) * F.col(f"_parts_{k}")).cast("int"))
    return ratings


def _solver(reg: float, by_degree: bool = False, keep: int | None = None):
    """Least squares; keep: only so many entries of a solution stay (see `cosamp`)."""

    def solve(ids, a, b, n, old):
        d = b.shape[1]
        a = a + reg * (n if by_degree else np.ones(len(b)))[:, None, None] * np.eye(d)
        if keep is not None and keep < d:
            return np.array([cosamp(x, y, keep) for x, y in zip(a, b, strict=True)]).reshape(-1, d)
        return np.linalg.solve(a, b[:, :, None])[:, :, 0]

    return solve


def cosamp(a: np.ndarray, b: np.ndarray, keep: int, rounds: int = 10, close: float = 1e-3) -> np.ndarray:
    """A solution of a x = b with `keep` entries by compressive sampling matching pursuit.

    Each round the 2 * keep entries on which the residual weighs most join those of the last solution, least squares
    over them gives the new one, and its largest entries stay; it ends when the residual is small or does not fall.
    """
    best, left, least = np.zeros(a.shape[1]), b.astype(float), np.inf
    for _ in range(rounds):
        near = np.abs(a.T @ left)
        some = np.union1d(np.argsort(-near, kind="stable")[: 2 * keep], np.flatnonzero(best))
        got = np.zeros(len(best))
        got[some] = np.linalg.lstsq(a[:, some], b, rcond=None)[0]
        top = np.argsort(-np.abs(got), kind="stable")[:keep]
        x = np.zeros(len(best))
        x[top] = got[top]
        rest = b - a @ x
        size = float(np.linalg.norm(rest))
        if size >= least - 1e-12:
            break
        best, left, least = x, rest, size
        if size < close:
            break
    return best


def _coordinates(reg: float, by_degree: bool = False):
    """One sweep over the coordinates of the old solution, each solved with the others fixed."""

    def solve(ids, a, b, n, old):
        x, lam = np.array(old, float), reg * (n if by_degree else np.ones(len(b)))
        for t in range(b.shape[1]):
            under = lam + a[:, t, t]
            top = b[:, t] - np.einsum("ij,ij->i", a[:, t], x) + a[:, t, t] * x[:, t]
            x[:, t] = np.where(under > 0, top / np.where(under > 0, under, 1), 0.0)
        return x

    return solve


def _matrix(column, rows: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(rows, -1) if rows else np.zeros((0, 1))


def _runs(keys: list[np.ndarray], values: list[np.ndarray], carry):
    """Sums of values (2-D arrays) over runs of equal keys, and the open last run; carry: the open run before."""
    change = np.zeros(len(keys[0]), bool)
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    at = np.concatenate([[0], np.flatnonzero(change)])
    heads, sums = [k[at] for k in keys], [np.add.reduceat(v, at, axis=0) for v in values]
    if carry is not None:
        if all(h[0] == c for h, c in zip(heads, carry[0], strict=True)):
            for s, c in zip(sums, carry[1], strict=True):
                s[0] += c
        else:
            heads = [np.concatenate([[c], h]) for h, c in zip(heads, carry[0], strict=True)]
            sums = [np.concatenate([c[None], s]) for s, c in zip(sums, carry[1], strict=True)]
    last = ([h[-1] for h in heads], [s[-1] for s in sums])
    return [h[:-1] for h in heads], [s[:-1] for s in sums], last


def _half(ratings: DataFrame, fixed: DataFrame, key: str, other: str, solve, weighted: bool = False, own: DataFrame | None = None) -> DataFrame:
    """id, f of the ids of `key` from the other side's factors: normal equations are summed by parts, then solved.

    Rows come sorted by id, so sums and solutions are taken for many ids at once. solve: (ids, sums of qq', sums of rq,
    numbers of ratings, old solutions if own is given), an entry per id, to the new solutions.
    """
    import pyarrow as pa

    cols = [F.col(key).alias("id"), F.col(f"_part_{key}").alias("part"), F.col(f"_parts_{key}").alias("parts"), "f", F.col("r").cast("double").alias("r")]
    rows = ratings.join(fixed, F.col(other) == F.col("id")).select(*cols, *([F.col("w").cast("double").alias("w")] if weighted else []))
    follows = own is not None
    lists = lambda x: pa.array(list(x), pa.list_(pa.float64()))

    def solved(ids, n, g, old=None):
        d = int((np.sqrt(1 + 4 * g.shape[1]) - 1) / 2)
        return np.asarray(solve(ids, g[:, : d * d].reshape(-1, d, d), g[:, d * d :], n, old))

    def sums(batches):
        carry = None

        def out(heads, totals):
            ids, parts, (n, g) = heads[0], heads[2], totals
            done = (parts == 1) & (not follows)
            f = [None] * len(ids)
            if done.any():
                for k, x in zip(np.flatnonzero(done).tolist(), solved(ids[done], n[done, 0], g[done]), strict=True):
                    f[k] = x
            rest = [None if x else y for x, y in zip(done.tolist(), g, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n[:, 0].astype(np.int64)), lists(f), lists(rest)], names=["id", "n", "f", "g"])

        for whole in batches:
            for b in (whole.slice(i, 2000) for i in range(0, whole.num_rows, 2000)):
                q, r = _matrix(b.column("f"), b.num_rows), b.column("r").to_numpy()
                wq = q * b.column("w").to_numpy()[:, None] if weighted else q
                g = np.concatenate([(wq[:, :, None] * q[:, None, :]).reshape(len(q), -1), wq * r[:, None]], axis=1)
                heads, totals, carry = _runs([b.column(c).to_numpy() for c in ("id", "part", "parts")], [np.ones((len(q), 1)), g], carry)
                if len(heads[0]):
                    yield out(heads, totals)
        if carry is not None:
            yield out([np.array([h]) for h in carry[0]], [t[None] for t in carry[1]])

    parts = int(ratings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    summed = rows.repartition(parts, "id", "part").sortWithinPartitions("id", "part").mapInArrow(sums, "id long, n long, f array<double>, g array<double>")
    summed = written(summed, "half")
    open_ = summed.where("g is not null").select("id", "n", "g")
    if follows:
        open_ = open_.join(own.toDF("id", "old"), "id", "left").withColumn("old", F.coalesce("old", F.transform(F.sequence(F.lit(1), F.floor(F.sqrt(F.size("g").cast("double"))).cast("int")), lambda k: F.lit(0.0))))

    def merge(batches):
        carry = None

        def out(heads, totals):
            old = totals[2] / totals[3] if follows else None
            f = solved(heads[0], totals[0][:, 0], totals[1], old)
            return pa.RecordBatch.from_arrays([pa.array(heads[0], pa.int64()), lists(f)], names=["id", "f"])

        for b in batches:
            if not b.num_rows:
                continue
            values = [b.column("n").to_numpy()[:, None].astype(float), _matrix(b.column("g"), b.num_rows)]
            if follows:  # the old solution stands in each part
                values += [_matrix(b.column("old"), b.num_rows), np.ones((b.num_rows, 1))]
            heads, totals, carry = _runs([b.column("id").to_numpy()], values, carry)
            if len(heads[0]):
                yield out(heads, totals)
        if carry is not None:
            yield out([np.array([h]) for h in carry[0]], [t[None] for t in carry[1]])

    merged = open_.repartition(parts, "id").sortWithinPartitions("id").mapInArrow(merge, FACTORS)
    return summed.where("f is not null").select("id", "f").union(merged)


def half_step(ratings: DataFrame, fixed: DataFrame, key: str, other: str, reg: float = 0.065, by_degree: bool = False, weighted: bool = False, keep: int | None = None, coordinate: bool = False, own: DataFrame | None = None) -> DataFrame:
    """id, f: one side's factors (of the ids in column key) from the other side's (id, f); see `als` for the rest.

    coordinate: one sweep from the factors `own`.
    """
    solve = _coordinates(reg, by_degree) if coordinate else _solver(reg, by_degree, keep)
    return _half(written(_spread(ratings, key), "ratings"), fixed, key, other, solve, weighted, own if coordinate else None)


def als(ratings: DataFrame, dims: int = 20, rounds: int = 6, reg: float = 0.065, by_degree: bool = False, weighted: bool = False, keep: int | None = None, coordinate: bool = False, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Factors of users and items (id, f) by alternating least squares.

    weighted: by column w; keep: sparse solutions; coordinate: one sweep over coordinates instead of a solution.
    """
    ratings = written(_spread(ratings, "u", "i"), "ratings")
    solve = _coordinates(reg, by_degree) if coordinate else _solver(reg, by_degree, keep)
    v = written(initial(ratings.select(F.col("i").alias("id")).distinct(), dims, seed), "items")
    u = written(initial(ratings.select(F.col("u").alias("id")).distinct(), dims, seed + 1), "users") if coordinate else None
    for _ in range(rounds):
        u = written(_half(ratings, v, "u", "i", solve, weighted, u if coordinate else None), "users")
        v = written(_half(ratings, u, "i", "u", solve, weighted, v if coordinate else None), "items")
    return u, v


def tensor_als(ratings: DataFrame, dims: int = 20, rounds: int = 6, reg: float = 0.065, seed: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Factors of users, items and times (u, i, t): each side is solved against the products of the other two."""
    ratings = written(_spread(ratings, "u", "i", "t"), "ratings")
    side = {c: written(initial(ratings.select(F.col(c).alias("id")).distinct(), dims, seed + k), c) for k, c in enumerate("uit")}
    for _ in range(rounds):
        for c in "uit":
            x, y = (o for o in "uit" if o != c)
            rows = ratings.join(side[x].toDF(x, "fx"), x).join(side[y].toDF(y, "fy"), y).select(c, f"_part_{c}", f"_parts_{c}", "r", F.zip_with("fx", "fy", lambda p, q: p * q).alias("f"), F.monotonically_increasing_id().alias("k"))
            fixed = written(rows, "design")
            side[c] = written(_half(fixed.select(F.col(c), f"_part_{c}", f"_parts_{c}", F.col("k").alias("z"), "r"), fixed.select(F.col("k").alias("id"), "f"), c, "z", _solver(reg)), c)
    return side["u"], side["i"], side["t"]


def nmf(ratings: DataFrame, dims: int = 2, rounds: int = 2, seed: int = 1, floor: float = 1e-8) -> tuple[DataFrame, DataFrame]:
    """Multiplicative updates: p <- p * sum(r / (p.q) q) / sum of q over all; users and items in turn. Built-in functions only."""
    ratings = written(ratings, "ratings")
    plus = lambda x: F.transform(x, lambda v: v + 0.01)
    u = written(initial(ratings.select(F.col("u").alias("id")).distinct(), dims, seed).select("id", plus("f").alias("f")), "users")
    v = written(initial(ratings.select(F.col("i").alias("id")).distinct(), dims, seed + 1).select("id", plus("f").alias("f")), "items")

    for _ in range(rounds):
        u = written(nmf_half(ratings, u, v, "u", "i", dims, floor), "users")
        v = written(nmf_half(ratings, v, u, "i", "u", dims, floor), "items")
    return u, v


def factor_sums(factors: DataFrame, dims: int) -> DataFrame:
    """t0, t1, ..: the sum of each factor over all ids, one row."""
    return factors.agg(*[F.sum(F.col("f")[k]).alias(f"t{k}") for k in range(dims)])


def nmf_half(ratings: DataFrame, own: DataFrame, fixed: DataFrame, key: str, other: str, dims: int, floor: float = 1e-8) -> DataFrame:
    """id, f: one side's factors after a multiplicative update against the other side's."""
    rows = ratings.join(own.toDF(key, "p"), key).join(fixed.toDF(other, "q"), other)
    dot = sum((F.col("p")[k] * F.col("q")[k] for k in range(dims)), F.lit(0.0))
    got = rows.groupBy(key).agg(F.first("p").alias("p"), *[F.sum(F.col("r") / F.greatest(dot, F.lit(floor)) * F.col("q")[k]).alias(f"s{k}") for k in range(dims)])
    new = F.array(*[F.greatest(F.col("p")[k] * F.col(f"s{k}") / F.greatest(F.col(f"t{k}"), F.lit(floor)), F.lit(floor)) for k in range(dims)])
    return got.join(F.broadcast(factor_sums(fixed, dims))).select(F.col(key).alias("id"), new.alias("f"))  # the sums are one row


def normal_equations(ratings: DataFrame, fixed: DataFrame, key: str, other: str, dims: int) -> DataFrame:
    """id, n, the upper triangle of the sum of qq' row by row, and the sum of rq; built-in aggregates, summed before the exchange."""
    q = [F.col("f")[k] for k in range(dims)]
    rows = ratings.join(fixed, F.col(other) == F.col("id")).select(F.col(key).alias("_k"), "r", "f")
    sums = [F.sum(q[a] * q[b]).alias(f"a{a}_{b}") for a in range(dims) for b in range(a, dims)] + [F.sum(F.col("r") * q[k]).alias(f"y{k}") for k in range(dims)]
    return rows.groupBy(F.col("_k").alias("id")).agg(F.count("*").alias("n"), *sums)


#: Ratings that one block pair of gradient descent holds on average.
ROWS_A_BLOCK = 1_000_000


def implied(ratings: DataFrame, v: DataFrame, dims: int) -> DataFrame:
    """u, n, z: number of a user's items, and the sum of their implicit factors over the root of n."""
    rows = ratings.join(v.toDF("i", "fv"), "i")
    got = rows.groupBy("u").agg(F.count("*").alias("n"), *[F.sum(F.col("fv")[dims + 1 + k]).alias(f"z{k}") for k in range(dims)])
    return got.select("u", "n", F.array(*[F.col(f"z{k}") / F.sqrt("n") for k in range(dims)]).alias("z"))


def sgd(ratings: DataFrame, dims: int = 20, rounds: int = 6, rate: float = 1e-3, reg: float = 1e-3, decay: float = 0.9, bias: bool = False, implicit: bool = False, low: float | None = None, high: float | None = None, logistic: bool = False, loss: str = "square", blocks: int | None = None, seed: int = 1) -> tuple[DataFrame, DataFrame, float]:
    """Stochastic gradient descent by strata: factors (id, f) of users and items, and the mean.

    Each round has `blocks` sub-rounds; in each, block b of users meets block (b + s) % blocks of items, one task a
    pair, and goes through its ratings in order. blocks: None sets them by the number of ratings (ROWS_A_BLOCK).
    f holds the factors, then the bias. implicit: an item's f has its implicit factors as well; their sum over all
    items of a user (see `implied`) is taken at the start of a round and follows the block's own changes. logistic:
    predictions are squeezed into low..high, the mean is that of the logits, loss is square, abs or logistic.
    """
    if blocks is None:
        blocks = max(1, int(np.ceil(np.sqrt(ratings.count() / ROWS_A_BLOCK))))
    ratings = written(ratings.select("u", "i", F.col("r").cast("double").alias("r"), F.pmod(F.xxhash64("u"), F.lit(blocks)).alias("bu"), F.pmod(F.xxhash64("i"), F.lit(blocks)).alias("bi")), "ratings")
    mean = float(ratings.agg(F.avg("r")).first()[0] or 0.0)
    if logistic:
        share = min(max((mean - low) / (high - low), 1e-6), 1 - 1e-6)
        mean = float(np.log(share / (1 - share)))
    width = dims + 1
    start = lambda c, w, n: written(initial(ratings.select(F.col(c).alias("id")).distinct(), w, n).select("id", F.transform("f", lambda x, k: F.when(k == dims, 0.0).otherwise(x)).alias("f")), c)  # noqa: E731, biases start at 0
    u, v = start("u", width, seed), start("i", width + (dims if implicit else 0), seed + 1)

    for k in range(rounds):
        step = rate * decay**k
        around = written(implied(ratings, v, dims), "implied") if implicit else None
        for s in range(blocks):
            rows = ratings.where(F.col("bi") == (F.col("bu") + s) % blocks).join(u.toDF("u", "fu"), "u").join(v.toDF("i", "fv"), "i")
            if implicit:
                rows = rows.join(around, "u")

            def descend(table):  # sent before step changes: each stratum is written at once
                import pyarrow as pa

                t = table.take(pa.array(np.lexsort((table["i"].to_numpy(), table["u"].to_numpy()))))
                us, vs, rs = t["u"].to_numpy(), t["i"].to_numpy(), t["r"].to_numpy()
                side = lambda ids, c: dict(zip(ids.tolist(), np.array(t[c].combine_chunks().flatten()).reshape(len(ids), -1), strict=True))
                p, q = side(us, "fu"), side(vs, "fv")
                cuts = np.flatnonzero(np.diff(us, prepend=us[0] - 1, append=us[-1] + 1))
                for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    x, own = p[int(us[lo])], [q[j] for j in vs[lo:hi].tolist()]
                    if implicit:
                        norm, around_user, pulled = float(t["n"][lo].as_py()) ** -0.5, np.array(t["z"][lo].as_py()), np.zeros(dims)
                    for y, r in zip(own, rs[lo:hi].tolist(), strict=True):
                        user = x[:dims] + around_user if implicit else x[:dims]
                        guess = user @ y[:dims] + ((mean + x[dims] + y[dims]) if bias else 0.0)
                        if logistic:
                            g = 1 / (1 + np.exp(-guess))
                            e, slope = r - (low + g * (high - low)), g * (1 - g) * (high - low)
                            e = {"square": e * slope, "abs": np.sign(e) * slope, "logistic": e}[loss]
                        else:
                            e = r - (guess if low is None else min(max(guess, low), high))
                            e = np.sign(e) if loss == "abs" else e
                        if implicit:
                            pulled += e * y[:dims]
                        y[:dims] += step * (e * user - reg * y[:dims])
                        x[:dims] += step * (e * y[:dims] - reg * x[:dims])
                        if bias:
                            x[dims] += step * (e - reg * x[dims])
                            y[dims] += step * (e - reg * y[dims])
                    if implicit:
                        for y in own:
                            y[dims + 1 :] += step * (norm * pulled - reg * y[dims + 1 :])
                out = [(0, i, f.tolist()) for i, f in p.items()] + [(1, i, f.tolist()) for i, f in q.items()]
                return pa.table({"side": [x[0] for x in out], "id": [x[1] for x in out], "f": [x[2] for x in out]}, schema=pa.schema([("side", pa.int32()), ("id", pa.int64()), ("f", pa.list_(pa.float64()))]))

            new = written(rows.groupBy("bu").applyInArrow(descend, "side int, " + FACTORS), "stratum")
            moved = lambda old, side, new=new: old.join(new.where(F.col("side") == side).select("id", F.col("f").alias("g")), "id", "left").select("id", F.coalesce("g", "f").alias("f"))
            u, v = written(moved(u, 0), "users"), written(moved(v, 1), "items")
    return u, v, mean


def predictions(pairs: DataFrame, u: DataFrame, v: DataFrame, dims: int, mean: float | None = None, low: float | None = None, high: float | None = None, logistic: bool = False, implicit_from: DataFrame | None = None) -> DataFrame:
    """pairs (u, i, ..) with prediction; unseen ids get bias 0 and factors 1; mean: add it and the biases (after the factors).

    low, high: bounds, or with logistic the link's ends; implicit_from: ratings whose items add implicit factors to users.
    """
    ones = F.array(*[F.lit(1.0)] * dims, F.lit(0.0))
    if implicit_from is not None:
        near = implied(implicit_from, v, dims).select(F.col("u").alias("id"), "z")
        u = u.join(near, "id", "left").select("id", F.array(*[F.col("f")[k] + F.coalesce(F.col("z")[k], F.lit(0.0)) for k in range(dims)], F.col("f")[dims]).alias("f"))
    rows = pairs.join(u.toDF("u", "fu"), "u", "left").join(v.toDF("i", "fv"), "i", "left").withColumns({"fu": F.coalesce("fu", ones), "fv": F.coalesce("fv", ones)})
    dot = F.aggregate(F.zip_with(F.slice("fu", 1, dims), F.slice("fv", 1, dims), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    if mean is not None:
        dot = dot + mean + F.element_at("fu", dims + 1) + F.element_at("fv", dims + 1)
    if logistic:
        dot = low + (high - low) / (1 + F.exp(-dot))
    elif low is not None:
        dot = F.least(F.greatest(dot, F.lit(float(low))), F.lit(float(high)))
    return rows.withColumn("prediction", dot).drop("fu", "fv")


def baseline(ratings: DataFrame, kind: str = "global") -> DataFrame:
    """ratings with prediction: the global mean, or that of the user or of the item."""
    if kind == "global":
        return ratings.join(F.broadcast(ratings.agg(F.avg("r").alias("prediction"))))  # one row
    key = {"user": "u", "item": "i"}[kind]
    return ratings.join(ratings.groupBy(key).agg(F.avg("r").alias("prediction")), key)


def implicit_negatives(ratings: DataFrame, share: float, value: float, seed: int = 1) -> DataFrame:
    """Random (u, i, value) triples, `share` of all possible ones; duplicates may occur."""
    m = ratings.agg(F.max("u").alias("u"), F.max("i").alias("i")).first()
    n = int(share * (m["u"] + 1) * (m["i"] + 1))
    return ratings.sparkSession.range(n).select(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(m["u"] + 1)).alias("u"), F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(m["i"] + 1)).alias("i"), F.lit(float(value)).alias("r"))


def _times(m: DataFrame, x: DataFrame, inner: str, outer: str, k: int) -> DataFrame:
    """The product of the sparse matrix m with k vectors (id, f): a join and a sum."""
    rows = m.join(x, F.col(inner) == F.col("id"))
    sums = rows.groupBy(F.col(outer).alias("_id")).agg(*[F.sum(F.col("val") * F.col("f")[j]).alias(f"s{j}") for j in range(k)])
    return written(sums.select(F.col("_id").alias("id"), F.array(*[f"s{j}" for j in range(k)]).alias("f")), "vectors")


def _gram(x: DataFrame, y: DataFrame | None, k: int) -> np.ndarray:
    """The k by k products of the vectors (id, f) of x and y."""
    rows = x.select("f", F.col("f").alias("h")) if y is None else x.join(y.toDF("id", "h"), "id")
    got = rows.agg(*[F.sum(F.col("f")[a] * F.col("h")[b]).alias(f"g{a}_{b}") for a in range(k) for b in range(k)]).first()
    return np.array([[got[f"g{a}_{b}"] or 0.0 for b in range(k)] for a in range(k)], float)


def _mixed(x: DataFrame, t: np.ndarray) -> DataFrame:
    """Vectors that are sums of those of x, by the columns of t."""
    f = F.array(*[sum((F.col("f")[a] * float(t[a, b]) for a in range(t.shape[0])), F.lit(0.0)) for b in range(t.shape[1])])
    return written(x.select("id", f.alias("f")), "vectors")


def _orthonormal(x: DataFrame, k: int) -> tuple[DataFrame, np.ndarray]:
    """An orthonormal basis of x and the lengths along it, falling."""
    w, q = np.linalg.eigh(_gram(x, None, k))
    order = np.argsort(-w)
    w, q = np.maximum(w[order], 1e-300), q[:, order]
    return _mixed(x, q / np.sqrt(w)), np.sqrt(w)


def svd(matrix: DataFrame, k: int, rounds: int = 12, seed: int = 1) -> tuple[np.ndarray, DataFrame, DataFrame]:
    """Largest k singular values, left and right vectors (id, f) of a sparse matrix (row, col, val), by block iteration.

    Both sides are turned in each round. Only k by k matrices meet in the driver.
    """
    m = written(matrix.select("row", "col", "val"), "matrix")
    v = initial(m.select(F.col("col").alias("id")).distinct(), k, seed)
    u, s = None, np.zeros(k)
    for _ in range(rounds):
        u, s = _orthonormal(_times(m, v, "col", "row", k), k)
        v, s = _orthonormal(_times(m, u, "row", "col", k), k)
    # u is turned to fit v
    u, s = _orthonormal(_times(m, v, "col", "row", k), k)
    return s, u, _mixed(_times(m, u, "row", "col", k), np.diag(1 / np.maximum(s, 1e-300)))


def svd_one_sided(matrix: DataFrame, k: int, rounds: int = 20, seed: int = 1) -> tuple[np.ndarray, DataFrame]:
    """Largest k singular values and right vectors (id, f), by Lanczos steps on the columns' products alone.

    A basis of k + rounds vectors grows one by one, each made orthogonal to all before (twice); the small matrix of
    their products is solved in the driver. Vectors on the rows' side are never kept.
    """
    m = written(matrix.select("row", "col", "val"), "matrix")
    ids = m.select(F.col("col").alias("id")).distinct()
    steps = min(k + rounds, ids.count())
    x = initial(ids, 1, seed)
    basis, products = None, np.zeros((steps, steps))
    n = 0
    while n < steps:
        if basis is not None:
            for _ in range(2):  # rounding leaves a rest after the first
                share = _shares(x, basis, n)
                f = F.array(F.col("f")[0] - sum((F.col("h")[j] * float(share[j]) for j in range(n)), F.lit(0.0)))
                x = written(x.join(basis.toDF("id", "h"), "id").select("id", f.alias("f")), "vectors")
        size = float(np.sqrt(_gram(x, None, 1)[0, 0]))
        if size < 1e-9:
            break
        x = _mixed(x, np.array([[1 / size]]))
        basis = x if basis is None else written(basis.join(x.toDF("id", "h"), "id").select("id", F.concat("f", "h").alias("f")), "vectors")
        n += 1
        x = _times(m, _times(m, x, "col", "row", 1), "row", "col", 1)
        products[:n, n - 1] = products[n - 1, :n] = _shares(x, basis, n)
    if basis is None:
        return np.zeros(0), x
    w, q = np.linalg.eigh(products[:n, :n])
    order = np.argsort(-w)[:k]
    return np.sqrt(np.maximum(w[order], 0)), _mixed(basis, q[:, order])


def _shares(x: DataFrame, basis: DataFrame, n: int) -> np.ndarray:
    """The products of one vector with each of n."""
    got = x.join(basis.toDF("id", "h"), "id").agg(*[F.sum(F.col("f")[0] * F.col("h")[j]).alias(f"s{j}") for j in range(n)]).first()
    return np.array([got[f"s{j}"] or 0.0 for j in range(n)])
