"""Item similarity from ratings (u, i, r), and recommendations from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.functions.scalar import log_likelihood_ratio
from tidegraph.operators.ordering import row_numbers


#: Ratings of one user that meet in one task; a user with more is split into pairs of blocks.
ROWS_A_BLOCK = 2000


def item_pairs(ratings: DataFrame) -> DataFrame:
    """u, deg (the user's ratings), a > b, ra, rb: a row per user and pair of the user's items.

    A user of more than ROWS_A_BLOCK ratings is split: each of the user's items goes to every block of the others.
    """
    deg = ratings.groupBy("u").agg(F.count("*").alias("deg"))
    rows = ratings.join(deg, "u").withColumn("blocks", F.ceil(F.col("deg") / ROWS_A_BLOCK).cast("int"))
    x = rows.select("u", F.col("i").alias("a"), F.col("r").alias("ra"), "deg", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    y = rows.select("u", F.col("i").alias("b"), F.col("r").alias("rb"), F.pmod(F.xxhash64("i"), F.col("blocks")).cast("int").alias("block"))
    return x.join(y, ["u", "block"]).where("a > b").drop("block")


def pairs(ratings: DataFrame, min_common: int = 1, max_common: int | None = None) -> DataFrame:
    """a > b, n_ab and the sums over common users that the metrics need; pairs of fewer or more common users are left out."""
    both = item_pairs(ratings)
    return both.groupBy("a", "b").agg(
        F.count("*").alias("n_ab"), F.sum(F.col("ra") * F.col("rb")).alias("dot"), F.sum(1 / F.log("deg")).alias("adamic_adar"), F.sum(1 / F.col("deg")).alias("resource"),
        F.sum(F.abs(F.col("ra") - F.col("rb")) - F.abs("ra") - F.abs("rb")).alias("l1"), F.sum(F.col("ra") - F.col("rb")).alias("diff"),
    ).where((F.col("n_ab") >= min_common) & (F.col("n_ab") <= (max_common if max_common is not None else (1 << 62))))


def similarities(ratings: DataFrame, min_common: int = 1, alpha: float = 0.5, max_common: int | None = None) -> DataFrame:
    """a, b and every metric. A missing rating counts as 0 in manhattan, slope_one and the distances."""
    items = ratings.groupBy("i").agg(F.count("*").alias("n"), F.sum(F.col("r") * F.col("r")).alias("sq"), F.sum(F.abs("r")).alias("abs"), F.sum("r").alias("sum")).where(F.col("n") >= min_common)
    of = lambda k: items.select(F.col("i").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("n", "sq", "abs", "sum")])
    p = pairs(ratings, min_common, max_common).join(of("a"), "a").join(of("b"), "b")
    return p.select(
        "a", "b", "n_ab",
        (F.col("n_ab") / (F.col("n_a") + F.col("n_b") - F.col("n_ab"))).alias("jaccard"),
        "adamic_adar", "resource",
        (F.col("n_ab") / (F.pow("n_a", F.lit(alpha)) * F.pow("n_b", F.lit(1 - alpha)))).alias("asym_cosine"),
        (1 - F.col("dot") / F.sqrt(F.col("sq_a") * F.col("sq_b"))).alias("cosine"),
        (F.col("abs_a") + F.col("abs_b") + F.col("l1")).alias("manhattan"),
        (1 - F.col("dot") / (F.col("sq_a") + F.col("sq_b") - F.col("dot"))).alias("tanimoto"),
        ((F.col("sum_a") - F.col("sum_b")) / F.col("n_ab")).alias("slope_one"),
        F.sqrt(F.abs(F.col("sq_a") + F.col("sq_b") - 2 * F.col("dot"))).alias("euclidean"),
    )


def chebyshev(ratings: DataFrame) -> DataFrame:
    """a > b, chebyshev: largest absolute difference over the users of either item."""
    some = pairs(ratings).select("a", "b")
    x = some.join(ratings.select(F.col("i").alias("a"), "u", F.col("r").alias("ra")), "a")
    y = some.join(ratings.select(F.col("i").alias("b"), "u", F.col("r").alias("rb")), "b")
    return x.join(y, ["a", "b", "u"], "full").groupBy("a", "b").agg(F.max(F.abs(F.coalesce("ra", F.lit(0.0)) - F.coalesce("rb", F.lit(0.0)))).alias("chebyshev"))


def pearson(ratings: DataFrame, min_common: int = 1) -> DataFrame:
    """a > b, pearson over common users; null where one of the items has no variance over them."""
    same = item_pairs(ratings).groupBy("a", "b").agg(F.count("*").alias("n_ab"), F.corr("ra", "rb").alias("pearson"))
    return same.where(F.col("n_ab") >= min_common).select("a", "b", F.when(~F.isnan("pearson"), F.col("pearson")).alias("pearson"))


def pearson_of_all(ratings: DataFrame, min_common: int = 1) -> DataFrame:
    """a > b, pearson as the recommenders' toolkit defines it: sum of (a - m)(b - m) over ALL users, by variances.

    A user's mean m is the sum of the user's ratings over the number of ALL items; a missing rating counts as 0, so every
    user who rated neither item still adds m * m. The divisor is the product of the two items' variances (about their own
    means m, divided by the number of users less one), without a root. Null where a variance is 0.
    """
    n = ratings.agg(F.countDistinct("u").alias("m"), F.countDistinct("i").alias("n")).first()
    per_user = ratings.groupBy("u").agg((F.sum("r") / F.lit(n["n"])).alias("mu"))
    squares = per_user.agg(F.sum(F.col("mu") * F.col("mu"))).first()[0] or 0.0
    rows = ratings.join(per_user, "u")
    # sum over all users of (x - m)^2 = sum of m^2 + sum over raters of (x^2 - 2 x m)
    of_item = rows.groupBy("i").agg(F.sum(F.col("r") * F.col("r") - 2 * F.col("r") * F.col("mu")).alias("v"), F.sum(F.col("r") * F.col("mu")).alias("rm"))
    of_item = of_item.select("i", ((F.col("v") + squares) / F.greatest(F.lit(n["m"] - 1), F.lit(1))).alias("v"), "rm")
    of = lambda k: of_item.toDF(k, f"v_{k}", f"rm_{k}")
    p = pairs(ratings, min_common).select("a", "b", "dot").join(of("a"), "a").join(of("b"), "b")
    top, under = F.col("dot") - F.col("rm_a") - F.col("rm_b") + squares, F.col("v_a") * F.col("v_b")
    return p.select("a", "b", F.when(under != 0, top / under).alias("pearson"))


def log_likelihood(ratings: DataFrame) -> DataFrame:
    """a > b, llr: 1 - 1 / (1 + ratio) of the binomial likelihoods of the users of a with and without b."""
    users = ratings.select("u").distinct().count()
    n = ratings.groupBy("i").agg(F.count("*").alias("n"))
    p = pairs(ratings).select("a", "b", "n_ab").join(n.toDF("a", "n_a"), "a").join(n.toDF("b", "n_b"), "b")
    k1, n1 = F.col("n_ab").cast("double"), F.col("n_b").cast("double")
    k2, n2 = (F.col("n_a") - F.col("n_ab")).cast("double"), (users - F.col("n_b")).cast("double")
    ratio = log_likelihood_ratio(k1, k2, n1, n2)
    return p.select("a", "b", (1 - 1 / (1 + F.abs(ratio))).alias("llr"))


def weighted_jaccard(edges: DataFrame) -> DataFrame:
    """src, dst, score of a directed weighted item graph: w / (out-weight of src + out-weight of dst - w), nodes as pairs both ways."""
    total = edges.select(F.col("src").alias("v"), "weight").union(edges.select("dst", "weight")).groupBy("v").agg(F.sum("weight").alias("t"))
    return edges.join(total.toDF("src", "ts"), "src").join(total.toDF("dst", "td"), "dst").select("src", "dst", (F.col("weight") / (F.col("ts") + F.col("td") - F.col("weight"))).alias("score"))


def top_k(df: DataFrame, key: str, other: str, score: str, k: int) -> DataFrame:
    """The k best of each key; scores that agree in nine places are ties and go by the other column."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.round(score, 9).desc(), other))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def ratings_from_similarity(ratings: DataFrame, sims: DataFrame, k: int, power: float = 3.0) -> DataFrame:
    """u, i, score, rank: sum of r * sim^power over the user's items, over items not rated yet; sims (a, b, sim) both ways."""
    both = sims.select("a", "b", "sim").union(sims.select("b", "a", "sim")).distinct()
    score = ratings.join(both, F.col("i") == F.col("a")).groupBy("u", F.col("b").alias("i")).agg(F.sum(F.col("r") * F.pow("sim", F.lit(power))).alias("score"))
    return top_k(score.where("score <> 0").join(ratings.select("u", "i"), ["u", "i"], "left_anti"), "u", "i", "score", k)


def chances(ratings: DataFrame) -> tuple[float, int, int]:
    """The constant c = L / (M N - L) of the probabilistic similarity, the number of users M and of items N; L counts ratings."""
    got = ratings.agg(F.count("*").alias("l"), F.countDistinct("u").alias("m"), F.countDistinct("i").alias("n")).first()
    free = got["m"] * got["n"] - got["l"]
    return (got["l"] / free if free else float("inf")), got["m"], got["n"]


def _chance(c: float, users: int, items: int, user_degree, item_degree):
    """Probability that a user with so many ratings rated an item with so many."""
    return 1 / (1 + c * ((items - user_degree) / user_degree) * ((users - item_degree) / item_degree))


def probabilistic(ratings: DataFrame, min_common: int = 1) -> DataFrame:
    """a > b, probability: common users over the number to be expected, from the users of b, if choices were random.

    The expectation depends on a's degree alone, so it is summed once per (b, degree of a) over b's users by degree.
    """
    c, users, items = chances(ratings)
    per_item = ratings.groupBy("i").agg(F.count("*").alias("n"))
    degree = ratings.groupBy("u").agg(F.count("*").alias("deg"))
    p = pairs(ratings, min_common).select("a", "b", "n_ab").join(per_item.toDF("a", "n_a"), "a")
    users_of = ratings.join(degree, "u").groupBy(F.col("i").alias("b"), "deg").agg(F.count("*").alias("many"))
    expected = p.select("b", "n_a").distinct().join(users_of, "b").groupBy("b", "n_a").agg(F.sum(F.col("many") * _chance(c, users, items, F.col("deg"), F.col("n_a"))).alias("expected"))
    return p.join(expected, ["b", "n_a"]).select("a", "b", (F.col("n_ab") / F.col("expected")).alias("probability"))


def ratings_from_probability(ratings: DataFrame, sims: DataFrame, k: int) -> DataFrame:
    """u, i, score, rank: chance * (1 + sum of (2 r - 1) (sim - 1)) over directed sims (a to b) above 1, for items not rated yet."""
    c, users, items = chances(ratings)
    pulled = ratings.join(sims.where("sim > 1"), F.col("i") == F.col("a")).groupBy("u", F.col("b").alias("i")).agg(F.sum((F.col("r") - 0.5) / 0.5 * (F.col("sim") - 1)).alias("pull"))
    new = pulled.join(ratings.select("u", "i"), ["u", "i"], "left_anti")
    new = new.join(ratings.groupBy("u").agg(F.count("*").alias("du")), "u").join(ratings.groupBy("i").agg(F.count("*").alias("di")), "i")
    return top_k(new.select("u", "i", (_chance(c, users, items, F.col("du"), F.col("di")) * (1 + F.col("pull"))).alias("score")), "u", "i", "score", k)


def recommend(users: DataFrame, items: DataFrame, known: DataFrame, k: int, share: float = 1.0, block: int = 4096, seed: int = 1) -> DataFrame:
    """u, i, score, rank: best dot products of factors (u, f), (i, f) over unknown pairs, ties by item.

    Blocks of users meet blocks of items as matrix products; only a block's k best of each user leave it.
    share: only so large a part of the items, drawn by hash, is scored.
    """
    import numpy as np

    if share < 1:
        items = items.where(F.pmod(F.xxhash64("i", F.lit(seed)), F.lit(1_000_003)) < share * 1_000_003)
    nu, ni = (max(1, -(-df.count() // block)) for df in (users, items))
    bu, bi = F.pmod(F.xxhash64("u"), F.lit(nu)).cast("int"), F.pmod(F.xxhash64("i"), F.lit(ni)).cast("int")
    left = users.select(F.lit(0).alias("side"), F.col("u").alias("x"), F.lit(None).cast("long").alias("y"), "f", bu.alias("bu"), F.explode(F.sequence(F.lit(0), F.lit(ni - 1))).alias("bi"))
    right = items.select(F.lit(1).alias("side"), F.lit(None).cast("long").alias("x"), F.col("i").alias("y"), "f", F.explode(F.sequence(F.lit(0), F.lit(nu - 1))).alias("bu"), bi.alias("bi"))
    seen = known.select("u", "i").distinct().select(F.lit(2).alias("side"), F.col("u").alias("x"), F.col("i").alias("y"), F.array().cast("array<double>").alias("f"), bu.alias("bu"), bi.alias("bi"))

    def best(table):
        import pyarrow as pa
        import pyarrow.compute as pc

        part = lambda s: table.filter(pc.equal(table["side"], s))
        a, b, old = part(0), part(1).sort_by("y"), part(2)
        out = {"u": [], "i": [], "score": []}
        if a.num_rows and b.num_rows:
            mat = lambda t: np.asarray(t["f"].combine_chunks().flatten()).reshape(t.num_rows, -1)
            us, vs = a["x"].to_numpy(), b["y"].to_numpy()
            score = mat(a) @ mat(b).T
            order = np.argsort(us)
            ou, ov = old["x"].to_numpy(), old["y"].to_numpy()
            at, bt = np.minimum(np.searchsorted(us[order], ou), len(us) - 1), np.minimum(np.searchsorted(vs, ov), len(vs) - 1)
            hit = (us[order][at] == ou) & (vs[bt] == ov)
            score[order[at[hit]], bt[hit]] = -np.inf
            for row, u in zip(score, us.tolist(), strict=True):
                take = np.lexsort((vs, -row))[:k]
                take = take[row[take] > -np.inf]
                out["u"] += [u] * len(take)
                out["i"] += vs[take].tolist()
                out["score"] += row[take].tolist()
        return pa.table(out, schema=pa.schema([("u", pa.int64()), ("i", pa.int64()), ("score", pa.float64())]))

    return top_k(left.unionByName(right).unionByName(seen).groupBy("bu", "bi").applyInArrow(best, "u long, i long, score double"), "u", "i", "score", k)


def with_biases(users: DataFrame, items: DataFrame, dims: int, mean: float) -> tuple[DataFrame, DataFrame]:
    """Factors (id, f) whose dot product is mean + both biases + that of the first `dims`; the bias is the place after them."""
    first, bias = F.slice("f", 1, dims), F.element_at("f", dims + 1)
    return users.select("id", F.concat(first, F.array(bias + mean, F.lit(1.0))).alias("f")), items.select("id", F.concat(first, F.array(F.lit(1.0), bias)).alias("f"))


def score_range(scores: DataFrame) -> DataFrame:
    """least, mean, most of the scores."""
    return scores.agg(F.min("score").alias("least"), F.avg("score").alias("mean"), F.max("score").alias("most"))


def merged(parts: list[DataFrame]) -> DataFrame:
    """a, b, score, place: similarity lists made apart, as one list in the order of (a, b, score falling)."""
    out = parts[0].select("a", "b", "score")
    for p in parts[1:]:
        out = out.union(p.select("a", "b", "score"))
    return row_numbers(out, [F.col("a"), F.col("b"), F.col("score").desc()], "place", 0)


def asymmetric_cosine(ratings: DataFrame, alpha: float = 0.5, min_common: int = 1) -> DataFrame:
    """a, b, score for both directions of each pair: n_ab / (n_a^alpha * n_b^(1 - alpha))."""
    n = ratings.groupBy("i").agg(F.count("*").alias("n"))
    p = pairs(ratings, min_common).select("a", "b", "n_ab")
    p = p.union(p.select("b", "a", "n_ab")).join(n.toDF("a", "n_a"), "a").join(n.toDF("b", "n_b"), "b")
    return p.select("a", "b", (F.col("n_ab") / (F.pow("n_a", F.lit(alpha)) * F.pow("n_b", F.lit(1 - alpha)))).alias("score"))
