"""Column functions that the operators share, and that queries may use on their own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _log(x: Column) -> Column:
    return F.when(x > 0, F.log(x)).otherwise(F.lit(0.0))


def log_likelihood_ratio(k1: Column, k2: Column, n1: Column, n2: Column) -> Column:
    """Twice the gain in log-likelihood of two shares k1 / n1 and k2 / n2 over one common share; logs of 0 count as 0."""
    fit = lambda k, m, q: k * _log(q) + (m - k) * _log(1 - q)
    share = lambda k, m: F.when(m > 0, k / m).otherwise(0.0)
    both = share(k1 + k2, n1 + n2)
    return 2 * (fit(k1, n1, share(k1, n1)) + fit(k2, n2, share(k2, n2)) - fit(k1, n1, both) - fit(k2, n2, both))


def tf_idf(tf: Column, docs: Column, df: Column) -> Column:
    """ln(1 + tf) * ln(docs / df)."""
    return F.log1p(tf) * F.log(docs / df)


def heads(id_: Column, a: int, b: int) -> Column:
    """A coin fixed by the id: ((a * id + b) mod 7907) mod 2 is 1."""
    return F.pmod(F.pmod(id_ * a + b, F.lit(7907)), F.lit(2)) == 1


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logistic_slope(x: Column) -> Column:
    return logistic(x) * (1 - logistic(x))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def tokens(text: Column, signs: str = r"\s,.;:!?()\[\]\"'") -> Column:
    """Tokens between white space and signs; after the first, those of one character go."""
    t = F.filter(F.split(text, f"[{signs}]+"), lambda x: x != "")
    return F.filter(t, lambda x, k: (k == 0) | (F.length(x) > 1))


def user_name(x: Column, most: int = 15) -> Column:
    """Lower case without a leading @; null if longer than `most` or with / or : in it, or empty."""
    name = F.lower(F.regexp_replace(F.trim(x), "^@", ""))
    return F.when((F.length(name) > 0) & (F.length(name) <= most) & ~name.rlike("[/:]"), name)


def ip_number(x: Column) -> Column:
    """A dotted quad as a number; null if a part is missing or beyond 255."""
    parts = F.transform(F.split(F.trim(x), r"\."), lambda p: F.when(p.rlike(r"^\d{1,3}$"), p.cast("int")))
    fine = (F.size(parts) == 4) & F.forall(parts, lambda p: p.isNotNull() & (p <= 255))
    return F.when(fine, F.aggregate(parts, F.lit(0).cast("long"), lambda s, p: s * 256 + F.coalesce(p, F.lit(0))))


def epoch(x: Column) -> Column:
    """Seconds since 1970 of `YYYY-MM-DD HH:MM:SS` in the session's time zone; null if it is none."""
    return F.try_to_timestamp(x, F.lit("yyyy-MM-dd HH:mm:ss")).cast("long")


def json_tokens(x: Column) -> Column:
    """The values of a flat JSON object as strings, in the order of their names."""
    cells = F.from_json(x, "map<string,string>")
    return F.transform(F.array_sort(F.map_entries(cells)), lambda e: e["value"])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def dot3(a: Column, b: Column, c: Column) -> Column:
    return dot(F.zip_with(a, b, lambda x, y: x * y), c)


def sum_of_squares(a: Column) -> Column:
    return dot(a, a)


def solve2(a11: Column, a12: Column, a22: Column, b1: Column, b2: Column) -> Column:
    """x of the symmetric system of two equations, as an array; null if it has none."""
    det = a11 * a22 - a12 * a12
    return F.when(det != 0, F.array((b1 * a22 - b2 * a12) / det, (b2 * a11 - b1 * a12) / det))
