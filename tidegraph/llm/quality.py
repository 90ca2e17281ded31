"""Quality by a generalised additive model with pairwise interactions.

Shallow trees, boosted in cycles over the features, are folded as they grow into one lookup table a feature
(main effects), then trees over the most useful pairs into tables over two features. A score is the sum of one
entry of each table, so scoring is binning and adding, whole batches at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import as_bytes, documents, slices, trimmed
from tidegraph.llm.repetition import Texts, repeated

#: Labelled rows that the fit uses at most: a bounded sample, by hash of doc_id.
MOST_LABELLED = 4000
THRESHOLD = 0.7
BINS, ROUNDS, RATE, PAIRS, PAIR_BINS, PAIR_ROUNDS = 24, 60, 0.15, 4, 6, 20

FEATURES = ("log_words", "word_length", "length_spread", "signs", "exclaims", "pipes", "capitals", "digits", "line_ends", "line_words", "dup_lines", "repeat_3", "repeat_5", "distinct", "short_words", "sign_ends", "shouted", "accents")

_CLASS = np.zeros(256, np.uint8)
_CLASS[list(b"#*$%&<>")] = 1
_CLASS[ord("!")] = 2
_CLASS[ord("|")] = 3
_CLASS[list(range(0x41, 0x5B))] = 4
_CLASS[list(range(0x30, 0x3A))] = 5
_CLASS[list(range(0x80, 0x100))] = 6


def features(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text (as by as_bytes); empty texts give zeros and full diversity."""
    t = Texts(buf, off)
    n, words = t.n, np.maximum(t.n_words, 1)
    size = np.maximum(np.diff(off), 1)
    kind = _CLASS[buf]
    rate = [t.per_doc(kind == k) / size for k in range(1, 7)]
    add = lambda values: np.bincount(t.doc, values, minlength=n)
    length = add(t.chars) / words
    spread = np.sqrt(np.maximum(add(t.chars.astype(float) ** 2) / words - length**2, 0))
    start, end, doc = t.lines()
    n_lines = np.maximum(np.bincount(doc, minlength=n), 1)
    from tidegraph.llm.repetition import _DOC, _roll

    later = repeated(_roll.of(t.prefix, start, end) + doc.astype(np.uint64) * _DOC)[1]
    stops = t.per_doc((buf == ord(".")) | (buf == ord("?"))) / words
    known = repeated(t.hash + t.doc.astype(np.uint64) * _DOC)[1]
    last = kind[t.end - 1] if len(t.end) else np.zeros(0, np.uint8)
    capitals = np.concatenate([[0], np.cumsum(kind == 4)])
    shouted = (capitals[t.end] - capitals[t.start] >= 2) & (2 * (capitals[t.end] - capitals[t.start]) >= t.chars)
    return np.column_stack([
        np.log1p(t.n_words), length, spread, rate[0], rate[1], rate[2], rate[3], rate[4], stops, t.n_words / n_lines, np.bincount(doc[later], minlength=n) / n_lines,
        add(t.covered(3)) / words, add(t.covered(5)) / words, 1 - add(known) / words, add(t.chars <= 3) / words, add((last >= 1) & (last <= 3)) / words, add(shouted) / words, rate[5],
    ])


@dataclass
class AdditiveModel:
    """Cut points and lookup tables of single features and of pairs."""

    cuts: list[np.ndarray]
    bias: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for k, (cut, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            out += table[np.searchsorted(cut, x[:, k], "right")]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            out += table[np.searchsorted(self.pair_cuts[a], x[:, a], "right"), np.searchsorted(self.pair_cuts[b], x[:, b], "right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def _stump(sums: np.ndarray, weights: np.ndarray, penalty: float = 1.0) -> tuple[float, np.ndarray]:
    """The best tree of up to three leaves over ordered bins, as a table; sums of gradients and of second derivatives by bin."""

    def split(a: int, b: int) -> tuple[float, int]:
        g, h = np.cumsum(sums[a:b]), np.cumsum(weights[a:b])
        if b - a < 2:
            return 0.0, a
        gain = g[:-1] ** 2 / (h[:-1] + penalty) + (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + penalty) - g[-1] ** 2 / (h[-1] + penalty)
        k = int(np.argmax(gain))
        return float(gain[k]), a + k + 1

    n = len(sums)
    total, at = split(0, n)
    if total <= 1e-9:
        return 0.0, np.zeros(n)
    more = max((split(a, b) for a, b in ((0, at), (at, n))), key=lambda x: x[0])
    edges = sorted({0, at, n, *([more[1]] if more[0] > 1e-9 else [])})
    table = np.zeros(n)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        table[a:b] = sums[a:b].sum() / (weights[a:b].sum() + penalty)
    return total + more[0], table


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Logistic loss. With no rows, or one label only, the score is that label's smoothed share."""
    quantiles = lambda k, n: np.unique(np.quantile(x[:, k], np.arange(1, n) / n)) if len(x) else np.zeros(0)
    model = AdditiveModel([quantiles(k, BINS) for k in range(x.shape[1])])
    share = (y.sum() + 1) / (len(y) + 2)
    model.bias = float(np.log(share / (1 - share)))
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    model.pair_cuts = [quantiles(k, PAIR_BINS) for k in range(x.shape[1])]
    if len(np.unique(y)) < 2:
        return model
    bins = [np.searchsorted(c, x[:, k], "right") for k, c in enumerate(model.cuts)]
    raw = np.full(len(y), model.bias)
    gradients = lambda: (y - (p := 1 / (1 + np.exp(-raw))), np.maximum(p * (1 - p), 1e-6))
    for _ in range(ROUNDS):
        for k, b in enumerate(bins):
            g, h = gradients()
            m = len(model.tables[k])
            step = RATE * _stump(np.bincount(b, g, m), np.bincount(b, h, m))[1]
            model.tables[k] += step
            raw += step[b]
    coarse = [np.searchsorted(c, x[:, k], "right") for k, c in enumerate(model.pair_cuts)]

    def grid(a: int, b: int) -> tuple[float, np.ndarray, np.ndarray]:
        g, h = gradients()
        nb = len(model.pair_cuts[b]) + 1
        cell = coarse[a] * nb + coarse[b]
        size = (len(model.pair_cuts[a]) + 1) * nb
        sums, weights = np.bincount(cell, g, size), np.bincount(cell, h, size)
        # a tree of depth two: the best cut of a, then the best cut of b on either side
        best = (0.0, np.zeros((size // nb, nb)))
        s, w = sums.reshape(-1, nb), weights.reshape(-1, nb)
        for cut in range(1, size // nb):
            (ga, ta), (gb, tb) = _stump(s[:cut].sum(0), w[:cut].sum(0)), _stump(s[cut:].sum(0), w[cut:].sum(0))
            if ga + gb > best[0]:
                best = (ga + gb, np.vstack([np.tile(ta, (cut, 1)), np.tile(tb, (size // nb - cut, 1))]))
        return best[0], best[1], cell

    found = sorted(((grid(a, b)[0], a, b) for a in range(x.shape[1]) for b in range(a + 1, x.shape[1])), reverse=True)[:PAIRS]
    model.pairs = [(a, b) for _, a, b in found]
    model.pair_tables = [np.zeros((len(model.pair_cuts[a]) + 1, len(model.pair_cuts[b]) + 1)) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for i, (a, b) in enumerate(model.pairs):
            _, table, cell = grid(a, b)
            model.pair_tables[i] += RATE * table
            raw += RATE * table.ravel()[cell]
    return model


def features_of(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` and an array x of features; null texts count as empty, a row for each row."""
    schema = docs.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = as_bytes(b.column("text"))
            for i, j in slices(off):
                x = features(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                yield pa.RecordBatch.from_arrays([*[b.column(c).slice(i, j - i) for c in keep], pa.array(list(x), pa.list_(pa.float64()))], names=[*keep, "x"])

    from pyspark.sql.types import ArrayType, DoubleType

    return docs.select("text", *keep).mapInArrow(trimmed(run), schema.add("x", ArrayType(DoubleType())))


def in_fold(doc_id) -> F.Column:
    """Held out: crc32 of doc_id as text, modulo 4, is 2."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> AdditiveModel:
    """Fits on labelled documents that are not held out, at most `most` of them (the least by hash of doc_id).

    Of clashing labels of a doc_id the commoner one counts, 0 if there are as many of either; of rows that share a
    doc_id the one with the least hash of its text. Labels without a document, or null, teach nothing, and without any
    label every score is 0.5. Other columns are not read.
    """
    marked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id")))
    known = marked.groupBy("doc_id").agg((F.avg("quality") > 0.5).cast("int").alias("quality"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    one = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = features_of(one, ["doc_id", "quality"])
    got = rows.select("doc_id", "quality", "x").orderBy("doc_id").toPandas()
    x = np.array(got["x"].tolist(), float).reshape(-1, len(FEATURES))
    return fit(x, got["quality"].to_numpy(float))


def score(docs: DataFrame, model: AdditiveModel, keep: list[str], name: str = "score", verdict: str = "predicted") -> DataFrame:
    """The columns `keep`, and the score and verdict (1 if score >= THRESHOLD) under the names given, which must be new.

    Null texts count as empty; empty texts get a score like any other; repeated rows give a row each; an empty
    table gives none. Only text enters a score.
    """
    from pyspark.sql.types import DoubleType, IntegerType

    read = list(keep) if "text" in keep else [*keep, "text"]
    at = read.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = as_bytes(b.column(at))
            for i, j in slices(off):
                s = model.score(features(buf[off[i] : off[j]], off[i : j + 1] - off[i]))
                yield pa.RecordBatch.from_arrays([*[b.column(c).slice(i, j - i) for c in range(len(keep))], pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=[*keep, name, verdict])

    return docs.select(*read).mapInArrow(trimmed(run), docs.select(*keep).schema.add(name, DoubleType()).add(verdict, IntegerType()))


def op10_quality_additive(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model, ["doc_id"]).select("doc_id", in_fold(F.col("doc_id")).alias("held_out"), "score", "predicted")
