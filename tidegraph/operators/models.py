"""Models over ratings and texts beyond plain factors: factorisation machines, time, ranking, sampling, topics.

All are bulk-synchronous: a round joins rows with parameters, sums gradients or counts per parameter (partial sums
before each shuffle, so that a hot id is no hot task) and writes new parameters. Where sequential steps would be
added up, a parameter's step is damped by its summed curvature c and the number m of parameters that move together,
rate / (1 + rate * c * m): for few ratings that is the plain step, for very many it stays stable. Rows with a null
id or rating are left out; empty inputs give empty parameters.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.operators.factorisation import _half, _spread, initial
from tidegraph.plans.tables import written


def _array(columns) -> Column:
    return F.array(*columns)


def _dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _sums(column: str, width: int, prefix: str) -> list[Column]:
    return [F.sum(F.col(column)[k]).alias(f"{prefix}{k}") for k in range(width)]


def _uniform(*parts) -> Column:
    """A number in (0, 1) fixed by the parts."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1_000_003)) + 0.5) / 1_000_003.0


# -- factorisation machines ------------------------------------------------------------------------------------


def design(df: DataFrame, row: str, categories: list[str], numbers: list[str] = (), sparse: str | None = None) -> DataFrame:
    """row, feature, x: a feature per category value, per number column and per entry of a sparse column 'name:value ..'.

    With a sparse column each (name, value) pair is a feature of its own. Null values give no feature.
    """
    parts = [F.struct(F.concat(F.lit(c + "="), F.col(c).cast("string")).alias("feature"), F.lit(1.0).alias("x")) for c in categories]
    parts += [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in numbers]
    all_ = F.array(*parts)
    if sparse:
        pairs = F.filter(F.split(F.coalesce(F.col(sparse), F.lit("")), r"\s+"), lambda t: t.contains(":"))
        all_ = F.concat(all_, F.transform(pairs, lambda t: F.struct(t.alias("feature"), F.lit(1.0).alias("x"))))
    return df.select(F.col(row).alias("row"), F.explode(all_).alias("e")).select("row", "e.feature", "e.x").where("feature is not null and x is not null")


def with_last_item(ratings: DataFrame, time: str = "t") -> DataFrame:
    """ratings with last: the item that the user rated last (ties: the largest id)."""
    last = ratings.groupBy("u").agg(F.max(F.struct(time, "i"))["i"].alias("last"))
    return ratings.join(last, "u")


def _gathered(features: DataFrame, weights: DataFrame, dims: int) -> DataFrame:
    """row, line (sum of b x), s0.. (sums of v x), sq (sum of (v x)^2), width; features not in weights count as 0."""
    rows = features.join(weights, "feature")
    return rows.groupBy("row").agg(
        F.sum(F.col("b") * F.col("x")).alias("line"), F.sum(F.aggregate("v", F.lit(0.0), lambda s, v: s + v * v) * F.col("x") * F.col("x")).alias("sq"),
        F.count("*").alias("width"), *[F.sum(F.col("v")[k] * F.col("x")).alias(f"s{k}") for k in range(dims)],
    )


def _score(mean: float, dims: int) -> Column:
    pairs = sum((F.col(f"s{k}") * F.col(f"s{k}") for k in range(dims)), F.lit(0.0)) - F.col("sq")
    return F.lit(mean) + F.coalesce(F.col("line") + 0.5 * pairs, F.lit(0.0))


def _link(score: Column, low, high, logistic: bool) -> Column:
    if logistic:
        return low + (high - low) / (1 + F.exp(-score))
    return score if low is None else F.least(F.greatest(score, F.lit(float(low))), F.lit(float(high)))


def fm(features: DataFrame, targets: DataFrame, dims: int = 20, rounds: int = 6, rate: float = 1e-3, reg_bias: float = 1e-3, reg_factor: float = 1e-3, decay: float = 0.9, low: float | None = None, high: float | None = None, logistic: bool = False, loss: str = "square", seed: int = 1) -> tuple[DataFrame, float]:
    """Factorisation machine of order 2: weights (feature, b, v) and the mean.

    features: (row, feature, x), see `design`; targets: (row, r). low, high: bounds, or with logistic the link's ends.
    """
    targets = written(targets.select("row", F.col("r").cast("double").alias("r")).dropna(), "targets")
    features = written(features.join(targets.select("row"), "row", "left_semi"), "features")
    mean = float(targets.agg(F.avg("r")).first()[0] or 0.0)
    if logistic:
        share = min(max((mean - low) / (high - low), 1e-6), 1 - 1e-6)
        mean = float(np.log(share / (1 - share)))
    centred = F.transform(F.sequence(F.lit(1), F.lit(dims)), lambda k: (_uniform("feature", k, F.lit(seed)) - 0.5) * (0.2 / dims**0.5))
    weights = written(features.select("feature").distinct().select("feature", F.lit(0.0).alias("b"), centred.alias("v")), "weights")
    for n in range(rounds):
        step = rate * decay**n
        score = _score(mean, dims)
        guess = _link(score, low, high, logistic)
        e = F.col("r") - F.col("guess")
        slope = (F.col("guess") - low) * (high - F.col("guess")) / (high - low) if logistic else F.lit(1.0)
        e = {"square": e * slope, "abs": F.signum(e) * slope, "logistic": e}[loss]
        rows = targets.join(_gathered(features, weights, dims), "row").withColumn("guess", guess).select("row", "width", e.alias("e"), _array([F.col(f"s{k}") for k in range(dims)]).alias("s"))
        x, m = F.col("x"), F.col("width") * (dims + 1)
        rest = [F.col("s")[k] - F.col("v")[k] * x for k in range(dims)]
        got = features.join(rows, "row").join(weights, "feature").groupBy("feature").agg(
            F.first("b").alias("b"), F.first("v").alias("v"), F.sum(F.col("e") * x).alias("gb"), F.sum(x * x * m).alias("cb"), F.count("*").alias("n"),
            *[F.sum(F.col("e") * x * rest[k]).alias(f"g{k}") for k in range(dims)], *[F.sum(x * x * rest[k] * rest[k] * m).alias(f"c{k}") for k in range(dims)],
        )
        size = lambda c, reg, step=step: step / (1 + step * (F.col(c) + reg * F.col("n")))
        weights = written(got.select(
            "feature", (F.col("b") + size("cb", reg_bias) * (F.col("gb") - reg_bias * F.col("n") * F.col("b"))).alias("b"),
            _array([F.col("v")[k] + size(f"c{k}", reg_factor) * (F.col(f"g{k}") - reg_factor * F.col("n") * F.col("v")[k]) for k in range(dims)]).alias("v"),
        ), "weights")
    return weights, mean


def fm_predict(features: DataFrame, rows: DataFrame, weights: DataFrame, mean: float, dims: int, low: float | None = None, high: float | None = None, logistic: bool = False) -> DataFrame:
    """rows (row, ..) with prediction; unseen features are skipped, a row without any known feature gets the mean."""
    got = _gathered(features, weights, dims)
    return rows.join(got, "row", "left").withColumn("prediction", _link(_score(mean, dims), low, high, logistic)).drop("line", "sq", "width", *[f"s{k}" for k in range(dims)])


# -- time ------------------------------------------------------------------------------------------------------


def time_svd(ratings: DataFrame, dims: int = 10, rounds: int = 6, rate: float = 5e-3, reg_bias: float = 1e-2, reg_factor: float = 1e-2, low: float | None = None, high: float | None = None, seed: int = 1) -> tuple[dict[str, DataFrame], float]:
    """Time-aware model over (u, i, r, t): parameters by side ('u', 'i', 't') and the mean.

    r ~ mean + b_u + b_i + (pu + z_u) . q + x . zt + sum(pu pt q), where z_u is the sum over all dims of the implicit
    factors y of the user's items, over the root of their number plus 10. u: f = p, pu, x; i: f = q, y; t: f = zt, pt.
    """
    d = dims
    ratings = written(ratings.select("u", "i", "t", F.col("r").cast("double").alias("r")).dropna(), "ratings")
    mean = float(ratings.agg(F.avg("r")).first()[0] or 0.0)
    side = {c: written(initial(ratings.select(F.col(c).alias("id")).distinct(), w * d, seed + n).select("id", F.lit(0.0).alias("b"), "f"), c) for n, (c, w) in enumerate({"u": 3, "i": 2, "t": 2}.items())}
    for _ in range(rounds):
        rows = _time_rows(ratings, side, d).withColumn("e", F.col("r") - _link(_time_score(mean, d), low, high, False))
        pu, x, q, zt, pt = (F.slice(a, 1 + o * d, d) for a, o in (("fu", 1), ("fu", 2), ("fi", 0), ("ft", 0), ("ft", 1)))
        slopes = {"p": q, "pu": F.zip_with(q, pt, lambda a, b: a * b), "x": zt, "q": F.transform(F.zip_with(pu, pt, lambda a, b: a + a * b), lambda a: a + F.col("z")), "zt": x, "pt": F.zip_with(q, pu, lambda a, b: a * b)}
        rows = written(rows.select("u", "i", "t", "e", "n_u", *[s.alias(k) for k, s in slopes.items()]), "slopes")
        pulled = rows.groupBy("u").agg(F.first("n_u").alias("n_u"), *[F.sum(F.col("e") * F.col("p")[k]).alias(f"y{k}") for k in range(d)])
        y = ratings.select("u", "i").join(pulled, "u").groupBy(F.col("i").alias("id")).agg(*[F.sum(F.col(f"y{k}") / F.sqrt(F.col("n_u") + 10)).alias(f"y{k}") for k in range(d)])
        m = float(7 * d + 2)
        for c, names in {"u": ("p", "pu", "x"), "i": ("q",), "t": ("zt", "pt")}.items():
            flat = [F.col(a)[k] for a in names for k in range(d)]
            got = rows.groupBy(F.col(c).alias("id")).agg(F.count("*").alias("n"), F.sum("e").alias("gb"), *[F.sum(F.col("e") * s).alias(f"g{k}") for k, s in enumerate(flat)], *[F.sum(s * s * m).alias(f"c{k}") for k, s in enumerate(flat)])
            got = got.join(side[c], "id")
            f = [F.col("f")[k] + rate / (1 + rate * (F.col(f"c{k}") + reg_factor * F.col("n"))) * (F.col(f"g{k}") - reg_factor * F.col("n") * F.col("f")[k]) for k in range(len(flat))]
            if c == "i":
                got = got.join(y, "id")
                f += [F.col("f")[d + k] + rate / (1 + rate * F.col("n") * (m + reg_factor)) * (F.col(f"y{k}") - reg_factor * F.col("n") * F.col("f")[d + k]) for k in range(d)]
            b = F.lit(0.0) if c == "t" else F.col("b") + rate / (1 + rate * F.col("n") * (m + reg_bias)) * (F.col("gb") - reg_bias * F.col("n") * F.col("b"))
            side[c] = written(got.select("id", b.alias("b"), _array(f).alias("f")), c)
    return side, mean


def _time_rows(ratings: DataFrame, side: dict[str, DataFrame], d: int, known: DataFrame | None = None) -> DataFrame:
    items = side["i"].select(F.col("id").alias("i"), F.aggregate(F.slice("f", d + 1, d), F.lit(0.0), lambda s, y: s + y).alias("y"))
    near = (ratings if known is None else known).select("u", "i").join(items, "i").groupBy("u").agg(F.count("*").alias("n_u"), (F.sum("y") / F.sqrt(F.count("*") + 10)).alias("z"))
    rows = ratings
    for c in "uit":
        rows = rows.join(side[c].select(F.col("id").alias(c), F.col("b").alias(f"b{c}"), F.col("f").alias(f"f{c}")), c, "inner" if known is None else "left")
    return rows.join(near, "u", "inner" if known is None else "left")


def _time_score(mean: float, d: int) -> Column:
    some = lambda a, o: F.slice(a, 1 + o * d, d)
    mixed = F.aggregate(F.zip_with(F.zip_with(some("fu", 1), some("ft", 1), lambda a, b: a * b), some("fi", 0), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    shifted = F.transform(some("fu", 1), lambda a: a + F.col("z"))
    parts = [F.col("bu"), F.col("bi"), _dot(shifted, some("fi", 0)), _dot(some("fu", 2), some("ft", 0)), mixed]
    return F.lit(mean) + sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))


def time_svd_predict(pairs: DataFrame, known: DataFrame, side: dict[str, DataFrame], mean: float, dims: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """pairs (u, i, t, ..) with prediction; known: the ratings of training; terms of unseen ids are left out."""
    return _time_rows(pairs, side, dims, known).withColumn("prediction", _link(_time_score(mean, dims), low, high, False)).drop("bu", "bi", "bt", "fu", "fi", "ft", "n_u", "z")


# -- ranking ---------------------------------------------------------------------------------------------------


def climf(ratings: DataFrame, dims: int = 10, rounds: int = 10, rate: float = 1e-2, reg: float = 1e-3, cutoff: float = 0.0, seed: int = 1) -> tuple[DataFrame, DataFrame, list[float]]:
    """Factors (id, f) of users and items by gradient ascent on the smoothed reciprocal rank, and its value per round.

    Ratings of at least `cutoff` are relevant; users with fewer than two are left out. The gradient is the published
    one (its first item term points along the user). A user's relevant items are one task, in blocks of 512 against all
    of them: memory grows with their number, work with its square, as the objective has a term per pair of them.
    """
    r = ratings.where(F.col("r") >= cutoff).select("u", "i").distinct()
    r = written(r.join(r.groupBy("u").agg(F.count("*").alias("n")).where("n >= 2").select("u"), "u"), "relevant")
    u = written(initial(r.select(F.col("u").alias("id")).distinct(), dims, seed), "users")
    v = written(initial(r.select(F.col("i").alias("id")).distinct(), dims, seed + 1), "items")
    values = []
    for _ in range(rounds):
        rows = r.join(u.toDF("u", "fu"), "u").join(v.toDF("i", "fv"), "i")

        def ascend(table):
            import pyarrow as pa

            x = np.array(table["fu"][0].as_py())
            y = np.asarray(table["fv"].combine_chunks().flatten()).reshape(table.num_rows, -1)
            s = lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            f = y @ x
            total, n = float(-0.5 * reg * x @ x + np.log(s(f)).sum()), len(f)
            dx, by_item = -reg * x + s(-f) @ y, s(-f)
            for a in range(0, n, 512):
                g = s(f[a : a + 512, None] - f)  # chance that the block's item is before each other
                total += float(np.log(g).sum())
                by_item[a : a + 512] += (1 - 2 * g).sum(1)  # an item against itself: 1/2, so nothing
                dx += (1 - g).sum(1) @ y[a : a + 512] - (1 - g).sum(0) @ y
            dv = by_item[:, None] * x - reg * y
            out = [(0, table["u"][0].as_py(), dx.tolist(), float(n * n), total)] + [(1, i, g.tolist(), float(n), 0.0) for i, g in zip(table["i"].to_pylist(), dv, strict=True)]
            names = ("side", "id", "g", "c", "value")
            return pa.table(dict(zip(names, map(list, zip(*out, strict=True)), strict=True)), schema=pa.schema([("side", pa.int32()), ("id", pa.int64()), ("g", pa.list_(pa.float64())), ("c", pa.float64()), ("value", pa.float64())]))

        got = written(rows.groupBy("u").applyInArrow(ascend, "side int, id long, g array<double>, c double, value double"), "gradients")
        values.append(float(got.agg(F.sum("value")).first()[0] or 0.0))
        moved = got.groupBy("side", "id").agg(F.sum("c").alias("c"), *_sums("g", dims, "g"))
        new = lambda old, k: written(old.join(moved.where(F.col("side") == k), "id").select("id", _array([F.col("f")[j] + rate / (1 + rate * F.col("c")) * F.col(f"g{j}") for j in range(dims)]).alias("f")), "factors")  # noqa: E731, B023
        u, v = new(u, 0), new(v, 1)
    return u, v, values


# -- sampling --------------------------------------------------------------------------------------------------


def boltzmann(ratings: DataFrame, bins: int, scale: float = 1.0, dims: int = 20, rounds: int = 6, rate: float = 0.1, reg: float = 0.06, decay: float = 0.9, seed: int = 1) -> DataFrame:
    """Restricted Boltzmann machine, one step of contrastive divergence a round: i, bias array, w array of arrays per bin.

    A rating falls into bin floor(r / scale), at most bins - 1. All users move the weights at once, so that an item's
    step is the mean over its ratings. Built-in functions only; samples are fixed by seed, round and ids.
    """
    r = ratings.select("u", "i", F.least(F.greatest(F.floor(F.col("r") / scale), F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin")).dropna()
    r = written(r, "ratings")
    share = [F.log(F.lit(1e-9) + F.avg((F.col("bin") == k).cast("double"))) for k in range(bins)]
    small = _array([_array([(_uniform("i", F.lit(k * dims + j), F.lit(seed)) - 0.5) * 0.001 for j in range(dims)]) for k in range(bins)])
    items = written(r.groupBy("i").agg(F.count("*").alias("n"), _array(share).alias("bias")).select("i", "n", "bias", small.alias("w")), "items")
    sigmoid = lambda x: 1 / (1 + F.exp(-x))

    def hidden(rows: DataFrame, at: str, n: int, salt: int, sampled: bool = True) -> DataFrame:
        sums = rows.select("u", F.col("w")[F.col(at)].alias("wb")).groupBy("u").agg(*_sums("wb", dims, "h"))
        on = [sigmoid(F.col(f"h{k}")) for k in range(dims)]
        return sums.select("u", _array([(_uniform("u", F.lit(k), F.lit(n), F.lit(salt + seed)) < on[k]).cast("double") if sampled else on[k] for k in range(dims)]).alias(f"h{at}"))

    for n in range(rounds):
        step = rate * decay**n
        rows = r.join(items, "i")
        first = rows.join(hidden(rows, "bin", n, 0), "u")
        level = F.zip_with("bias", F.transform("w", lambda w: _dot(w, F.col("hbin"))), lambda b, d: b + d)
        first = first.withColumn("level", level).withColumn("odds", F.transform("level", lambda x: F.exp(x - F.array_max("level"))))
        mark = _uniform("u", "i", F.lit(n), F.lit(7 + seed)) * F.aggregate("odds", F.lit(0.0), lambda s, x: s + x)
        upto = [F.aggregate(F.slice("odds", 1, k + 1), F.lit(0.0), lambda s, x: s + x) for k in range(bins - 1)]
        first = first.withColumn("mark", mark).withColumn("again", sum(((F.col("mark") >= c).cast("int") for c in upto), F.lit(0)))
        first = written(first.select("u", "i", "bin", "again", "hbin"), "sampled")
        # files of samples are a small part of the rows' size in memory, so that Spark would broadcast a row per rating
        second = first.hint("merge").join(hidden(first.join(items, "i"), "again", n, 1), "u")
        both = second.select("i", F.explode(_array([F.struct(F.col("bin").alias("b"), F.col("hbin").alias("g"), F.lit(1.0).alias("way")), F.struct(F.col("again").alias("b"), F.col("hagain").alias("g"), F.lit(-1.0).alias("way"))])).alias("e"))
        moved = both.groupBy("i", "e.b").agg(F.count("*").alias("hits"), *[F.sum(F.col("e.way") * F.col("e.g")[k]).alias(f"g{k}") for k in range(dims)])
        moved = moved.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("b", F.struct("hits", _array([f"g{k}" for k in range(dims)]).alias("g"))))).alias("by"))  # at most `bins` entries an item
        grown = F.transform("w", lambda w, k: F.when(F.col("by")[k.cast("int")].isNull(), w).otherwise(F.zip_with(w, F.col("by")[k.cast("int")]["g"], lambda a, g: a + step / F.col("n") * (g - reg * F.col("by")[k.cast("int")]["hits"] * a))))  # noqa: B023
        items = written(items.join(moved, "i").select("i", "n", "bias", grown.alias("w")), "items")
    return items.select("i", "bias", "w")


def boltzmann_predict(pairs: DataFrame, known: DataFrame, items: DataFrame, bins: int, dims: int, scale: float = 1.0) -> DataFrame:
    """pairs (u, i, ..) with prediction: the expected bin given the hidden chances of the user's known ratings, times scale.

    A user without known ratings has hidden chances of 1/2; an unknown item gets null.
    """
    r = known.select("u", "i", F.least(F.greatest(F.floor(F.col("r") / scale), F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin")).dropna().join(items, "i")
    h = r.select("u", F.col("w")[F.col("bin")].alias("wb")).groupBy("u").agg(*_sums("wb", dims, "h")).select("u", _array([1 / (1 + F.exp(-F.col(f"h{k}"))) for k in range(dims)]).alias("h"))
    rows = pairs.join(items, "i", "left").join(h, "u", "left").withColumn("h", F.coalesce("h", _array([F.lit(0.5)] * dims)))
    level = F.zip_with("bias", F.transform("w", lambda w: _dot(w, F.col("h"))), lambda b, d: b + d)
    rows = rows.withColumn("level", level).withColumn("odds", F.transform("level", lambda x: F.exp(x - F.array_max("level"))))
    mass = F.aggregate("odds", F.lit(0.0), lambda s, x: s + x)
    return rows.withColumn("prediction", _dot("odds", _array([F.lit(float(k)) for k in range(bins)])) / mass * scale).drop("bias", "w", "h", "level", "odds")


def _wishart(rng, scale: np.ndarray, freedom: float) -> np.ndarray:
    d = len(scale)
    t = np.tril(rng.standard_normal((d, d)), -1)
    t[np.diag_indices(d)] = np.sqrt([rng.chisquare(freedom - k) for k in range(d)])
    a = np.linalg.cholesky((scale + scale.T) / 2) @ t
    return a @ a.T


def sampled_factors(ratings: DataFrame, pairs: DataFrame, dims: int = 10, rounds: int = 10, burn_in: int = 5, seed: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bayesian factors by Gibbs sampling: the last sample of users and items (id, f), and pairs with prediction.

    prediction is the mean over the rounds after burn_in (null for unseen ids). Hyper-priors are normal-Wishart, drawn
    in the driver from sums of dims^2 numbers; the factor of an id is drawn from a generator seeded by round and id.
    """
    if rounds <= burn_in:
        raise ValueError("rounds must be more than burn_in")
    ratings = written(_spread(ratings.select("u", "i", F.col("r").cast("double").alias("r")).dropna(), "u", "i"), "ratings")
    side = {c: written(initial(ratings.select(F.col(c).alias("id")).distinct(), dims, seed + n), c) for n, c in enumerate("ui")}
    pairs = written(pairs.withColumn("_row", F.monotonically_increasing_id()), "pairs")
    rng, kept = np.random.default_rng(seed), None

    def hyper(x: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        got = x.agg(F.count("*").alias("n"), *_sums("f", dims, "m"), *[F.sum(F.col("f")[a] * F.col("f")[b]).alias(f"s{a}_{b}") for a in range(dims) for b in range(a, dims)]).first()
        n = got["n"]
        mean = np.array([got[f"m{k}"] or 0.0 for k in range(dims)]) / max(n, 1)
        gram = np.array([[got[f"s{min(a, b)}_{max(a, b)}"] or 0.0 for b in range(dims)] for a in range(dims)])
        inverse = np.eye(dims) + gram - n * np.outer(mean, mean) + n / (1 + n) * np.outer(mean, mean)
        precision = _wishart(rng, np.linalg.inv(inverse), dims + n)
        return precision, rng.multivariate_normal(n * mean / (1 + n), np.linalg.inv((1 + n) * precision))

    def draw(precision, mean, noise, at):
        def solve(ids, a, b, n, old):
            p = precision + noise * a
            centre = np.linalg.solve(p, (precision @ mean + noise * b)[:, :, None])[:, :, 0]
            drawn = np.array([np.random.default_rng([seed, at, x & 0xFFFFFFFFFFFFFFFF]).standard_normal(b.shape[1]) for x in ids.tolist()])
            upper = np.linalg.cholesky((p + p.transpose(0, 2, 1)) / 2).transpose(0, 2, 1)
            return centre + np.linalg.solve(upper, drawn[:, :, None])[:, :, 0]

        return solve

    dot = _dot("fu", "fi")
    for n in range(rounds):
        error, count = ratings.join(side["u"].toDF("u", "fu"), "u").join(side["i"].toDF("i", "fi"), "i").agg(F.sum((F.col("r") - dot) ** 2), F.count("*")).first()
        noise = rng.gamma((1 + count) / 2, 2 / (1 + (error or 0.0)))
        for c, o in ("ui", "iu"):
            precision, mean = hyper(side[c])
            side[c] = written(_half(ratings, side[o], c, o, draw(precision, mean, noise, 2 * n + (c == "i"))), c)
        if n >= burn_in:
            now = pairs.join(side["u"].toDF("u", "fu"), "u", "left").join(side["i"].toDF("i", "fi"), "i", "left").select("_row", dot.alias("now"))
            kept = written(now.select("_row", F.col("now").alias("total")) if kept is None else kept.join(now, "_row").select("_row", (F.col("total") + F.col("now")).alias("total")), "kept")
    return side["u"], side["i"], pairs.join(kept, "_row").withColumn("prediction", F.col("total") / (rounds - burn_in)).drop("_row", "total")


# -- topics ----------------------------------------------------------------------------------------------------


def topics(tokens: DataFrame, n_topics: int = 10, rounds: int = 10, alpha: float = 1.0, beta: float = 0.1, seed: int = 1) -> DataFrame:
    """d, w, z: a topic per token (d, w) by collapsed Gibbs sampling, documents in parallel.

    Within a round a document samples its tokens in order against the counts of the round's start and its own changes;
    counts of all documents meet between rounds. A document is one task's group.
    """
    at = tokens.select("d", "w").dropna().withColumn("row", F.monotonically_increasing_id())
    at = written(written(at, "tokens").select("d", "w", "row", F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(n_topics)).cast("long").alias("z")), "topics")
    words = at.select("w").distinct().count()
    for n in range(rounds):
        totals = [0] * n_topics
        for r in at.groupBy("z").count().collect():  # n_topics rows
            totals[r["z"]] = r["count"]
        per_word = at.groupBy("w").agg(_array([F.sum((F.col("z") == k).cast("long")) for k in range(n_topics)]).alias("counts"))

        def resample(table):  # sent before totals and n change: each round is written at once
            import pyarrow as pa

            t = table.sort_by("row")
            ws, z = t["w"].to_pylist(), t["z"].to_numpy().copy()
            own = {w: np.array(c, float) for w, c in zip(ws, t["counts"].to_pylist(), strict=True)}
            all_, doc = np.array(totals, float), np.bincount(z, minlength=n_topics).astype(float)
            rng = np.random.default_rng([seed, n, t["row"][0].as_py()])
            marks = rng.random(len(z))
            for k, w in enumerate(ws):
                c, old = own[w], z[k]
                c[old] -= 1
                all_[old] -= 1
                doc[old] -= 1
                p = np.cumsum((alpha + doc) * (beta + c) / (beta * words + all_))
                z[k] = new = min(int(np.searchsorted(p, marks[k] * p[-1], side="right")), n_topics - 1)
                c[new] += 1
                all_[new] += 1
                doc[new] += 1
            return pa.table([t["d"], t["w"], t["row"], pa.array(z, pa.int64())], names=["d", "w", "row", "z"])

        schema = ", ".join(f"{c} {at.schema[c].dataType.simpleString()}" for c in ("d", "w", "row", "z"))
        at = written(at.join(per_word, "w").select("d", "w", "row", "z", "counts").groupBy("d").applyInArrow(resample, schema), "topics")
    return at.select("d", "w", "z")


def topic_words(at: DataFrame, k: int = 10) -> DataFrame:
    """z, w, n, rank: the k most frequent words of each topic, ties by word."""
    from tidegraph.operators.similarity import top_k

    return top_k(at.groupBy("z", "w").agg(F.count("*").alias("n")), "z", "w", "n", k)


def topic_likelihood(at: DataFrame, n_topics: int, beta: float = 0.1) -> float:
    """Log-likelihood of the words given their topics, topic-word distributions integrated out."""
    from math import lgamma

    words = at.select("w").distinct().count()
    counts = at.groupBy("z", "w").agg(F.count("*").alias("n")).groupBy("z", "n").agg(F.count("*").alias("many"))

    def part(batches):
        import pyarrow as pa

        for b in batches:
            z, n, many = (b[c].to_pylist() for c in ("z", "n", "many"))
            yield pa.RecordBatch.from_pydict({"z": z, "n": [x * m for x, m in zip(n, many, strict=True)], "v": [(lgamma(x + beta) - lgamma(beta)) * m for x, m in zip(n, many, strict=True)]})

    got = counts.mapInArrow(part, "z long, n long, v double").groupBy("z").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()  # n_topics rows
    return sum(lgamma(words * beta) - lgamma(r["n"] + words * beta) + r["v"] for r in got)
