"""Lexical retrieval packing: windows of one length filled with a seed document and its nearest unused neighbours.

Nearness is BM25 with all terms (token ids) of the seed and the statistics of the whole table. The index is sharded by
content: a document's key is its terms in the order of an exponential race weighted by idf, so that two documents have
the same first term with the probability of their weighted Jaccard similarity. Documents are sorted by the first three
terms and cut into shards, ties by a hash of the row, so that neighbours meet and no group of equal texts outgrows a
shard. Each shard has the postings of its documents. A seed scores all that are unused there and takes the best, as
many as its window needs; a document that reaches over the end of a window is cut there and is the seed of the next.
Tables of up to DOCS_PER_SHARD documents are one shard, so there the search is of the whole table.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm import tokens
from tidegraph.llm.common import as_bytes, documents, mixed, slices, trimmed, written

LENGTH, DOCS_PER_SHARD = 2048, 4000
#: A shard ends before its token ids outgrow a task's memory, too (one document may be longer).
TOKENS_PER_SHARD = 16_000_000
#: BM25's constants.
K1, B = 1.2, 0.75
#: Borders between shards at most; beyond, what lies between two is cut into several shards.
MOST_BORDERS = 10_000
#: Rows a shard from which the borders are drawn, on average; all rows are dealt by them.
SAMPLED = 200


def idf(df: np.ndarray, n: int) -> np.ndarray:
    return np.log1p((n - df + 0.5) / (df + 0.5))


def sorted_keys(each: list[np.ndarray], to: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    """document << bits | term (or to[term]) of all places, sorted; and the bits. Short numbers sort fastest."""
    whole = np.concatenate(each) if each else np.zeros(0, np.uint16)
    whole = whole if to is None else to[whole]
    kind, bits = (np.uint32, 16) if len(each) < 1 << 16 and (not len(whole) or whole.max() < 1 << 16) else (np.int64, 32)
    key = np.repeat(np.arange(len(each), dtype=kind) << kind(bits), [len(x) for x in each]) | whole.astype(kind)
    key.sort()
    return key, bits


def firsts(key: np.ndarray) -> np.ndarray:
    """Places where sorted keys change."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))


def term_counts(each: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """document, term, frequency, by document and then term."""
    key, bits = sorted_keys(each)
    at = firsts(key)
    own = key[at].astype(np.int64)
    return own >> bits, own & ((1 << bits) - 1), np.diff(np.append(at, len(key)))


def race(each: list[np.ndarray], weight: np.ndarray, places: int = 3) -> np.ndarray:
    """The first terms of each document in an exponential race with weights by term; a row each, -1 where none is left."""
    n = len(each)
    u = ((mixed(np.arange(1, len(weight) + 1, dtype=np.uint64)) >> np.uint64(12)).astype(float) + 0.5) / 2**52
    by_rank = np.lexsort((np.arange(len(weight)), -np.log(u) / weight))
    rank = np.empty(len(weight), np.uint32)
    rank[by_rank] = np.arange(len(weight), dtype=np.uint32)
    key, bits = sorted_keys(each, rank)
    own = key[firsts(key)].astype(np.int64)
    first = np.searchsorted(own, np.arange(n + 1) << bits)
    at = first[:-1, None] + np.arange(places)
    inside = at < first[1:, None]
    return np.where(inside, by_rank[own[np.where(inside, at, 0)] & ((1 << bits) - 1)] if len(own) else -1, -1)


class Shard:
    """An inverted index over documents (their ids without the end id) with the table's statistics.

    Terms that an eighth of the documents or more have are rows of a full matrix, the others lists.
    """

    def __init__(self, each: list[np.ndarray], size: np.ndarray, df: np.ndarray, n: int, mean: float):
        doc, self.term, tf = term_counts(each)
        self.first = np.searchsorted(doc, np.arange(len(each) + 1))
        weight = idf(df, n)[self.term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[doc] / max(mean, 1.0)))
        order = np.argsort(self.term.astype(np.uint32), kind="stable")
        self.live = np.arange(len(each))
        self._post(self.term[order], doc[order], weight[order])

    def _post(self, term: np.ndarray, doc: np.ndarray, weight: np.ndarray) -> None:
        """doc: places in live."""
        self.t, self.d, self.w = term, doc, weight
        at = firsts(term)
        self.names, self.at = term[at], np.append(at, len(term))
        common = np.flatnonzero(np.diff(self.at) * 8 > len(self.live))
        self.row = np.full(len(self.names), -1)
        self.row[common] = np.arange(len(common))
        self.full = np.zeros((len(common), len(self.live)), np.float32)
        for r, k in enumerate(common.tolist()):
            x = slice(self.at[k], self.at[k + 1])
            self.full[r, doc[x]] = weight[x]

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of the live documents for all terms of the seed."""
        out = np.zeros(len(self.live), np.float32)
        own = self.term[self.first[seed] : self.first[seed + 1]]
        if not len(own) or not len(self.names):
            return out
        k = np.minimum(np.searchsorted(self.names, own), len(self.names) - 1)
        k = k[self.names[k] == own]
        rows = self.row[k]
        rare = k[rows < 0]
        lists = [slice(a, b) for a, b in zip(self.at[rare].tolist(), self.at[rare + 1].tolist(), strict=True)]
        for r in rows[rows >= 0].tolist():
            out += self.full[r]
        if lists:
            return out + np.bincount(np.concatenate([self.d[x] for x in lists]), np.concatenate([self.w[x] for x in lists]), len(out))
        return out

    def forget(self, used: np.ndarray) -> None:
        """Drops used documents once they are half of the live ones."""
        keep = ~used[self.live]
        if 2 * int(keep.sum()) < len(keep):
            place, stays = np.cumsum(keep) - 1, keep[self.d]
            self.live = self.live[keep]
            self._post(self.t[stays], place[self.d[stays]], self.w[stays])


def nearest(score: np.ndarray, size: np.ndarray, need: int) -> np.ndarray:
    """Places by falling score (ties: the first) until their sizes sum to need, or all."""
    k = 8
    while True:
        some = np.arange(len(score)) if k >= len(score) else np.flatnonzero(score >= np.partition(score, -k)[-k])
        some = some[np.argsort(-score[some], kind="stable")]
        total = np.cumsum(size[some])
        if k >= len(score) or total[-1] >= need:
            return some[: int(np.searchsorted(total, need)) + 1]
        k *= 8


def windows(each: list[np.ndarray], size: np.ndarray, df: np.ndarray, n: int, mean: float, length: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, window, offset) of all pieces of a shard's documents; one window is padded at most.

    each: the terms; size: the tokens to pack, end ids included. Whole windows of a long document come first, its rest
    is what is packed with others.
    """
    out: list[tuple[int, int, int, int, int]] = []
    w = 0
    start, left = size // length * length, size % length
    for d in np.flatnonzero(start).tolist():
        for s in range(0, int(start[d]), length):
            out.append((d, s, length, w, 0))
            w += 1
    used = left == 0
    shard = Shard(each, size, df, n, mean)
    at = 0
    for seed in range(len(each)):
        if used[seed]:
            continue
        used[seed] = True
        out.append((seed, int(start[seed]), int(left[seed]), w, 0))
        at, now = int(left[seed]), seed
        while 0 < at < length:
            shard.forget(used)
            free = np.flatnonzero(~used[shard.live])
            if not len(free):
                return out
            docs = shard.live[free]
            for d in docs[nearest(shard.scores(now)[free], left[docs], length - at)].tolist():
                used[d] = True
                m = min(int(left[d]), length - at)
                out.append((d, int(start[d]), m, w, at))
                at += m
                if at == length:
                    w, at = w + 1, int(left[d]) - m
                    if at:  # the rest is the next window's beginning, and its document the seed
                        out.append((d, int(start[d]) + m, at, w, 0))
                        now = d
    return out


def lane_of(spark: SparkSession, n: int) -> list[int]:
    """A number for each of n shards, such that n partitions by the numbers' hash have one shard each."""
    found = spark.range(30 * n).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("id")).collect()
    by = {r["p"]: r["id"] for r in found}
    return [by.get(k, k) for k in range(n)]


def pack(docs: DataFrame, length: int = LENGTH, vocabulary: str | None = None, end_id: int = 1, docs_per_shard: int = DOCS_PER_SHARD) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are their end id alone; repeated rows and null doc_ids are packed like any other; an
    empty table gives no rows; other columns are not read. sequence_id is the partition (upper bits) and a window in it.
    The driver holds the terms' document frequencies, as many as the vocabulary has tokens, and the shards' borders.
    """
    spark, schema = docs.sparkSession, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file, row = vocabulary or tokens.vocabulary(), TaskContext.get().partitionId() << 33
        counts, n_docs, n_tokens = np.zeros(0, np.int64), 0, 0
        names = ["row", "doc_id", "width", "ids"]
        for b in batches:
            buf, off = as_bytes(b.column("text"))
            for i, j in slices(off, 1 << 19):
                ids, at = tokens.encode(file, buf[off[i] : off[j]], off[i : j + 1] - off[i], end_id)
                n_docs, n_tokens = n_docs + j - i, n_tokens + len(ids)
                small = ids.astype("<u2") if ids.max() < 1 << 16 else ids.astype("<u4")
                key, bits = sorted_keys([small[x : y - 1] for x, y in zip(at[:-1], at[1:], strict=True)])
                df = np.bincount(key[firsts(key)].astype(np.int64) & ((1 << bits) - 1), minlength=len(counts))
                df[: len(counts)] += counts
                counts = df
                payload = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer((at * small.itemsize).astype(np.int64)), pa.py_buffer(small)])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + j - i)), b.column("doc_id").slice(i, j - i).cast(pa.int64()), pa.array(np.full(j - i, small.itemsize, np.int8)), payload.cast(pa.binary())], names=names)
                row += j - i
        if n_docs:
            term = np.flatnonzero(counts)
            stats = np.stack([np.concatenate([[-2, -1], term]), np.concatenate([[n_tokens, n_docs], counts[term]])]).astype("<i8")
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([0], pa.int8()), pa.array([stats.tobytes()], pa.binary())], names=names)

    def unfolded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column("ids"):
                term, n = np.frombuffer(x.as_buffer(), "<i8").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(n)], names=["term", "n"])

    table = written(docs.select("doc_id", "text").mapInArrow(trimmed(encode, "words"), "row long, doc_id long, width byte, ids binary"), "packing")
    stats = {r["term"]: r["n"] for r in table.where("width = 0").select("ids").mapInArrow(trimmed(unfolded, "words"), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    if not stats:
        return spark.createDataFrame([], schema)
    n, mean = stats[-1], stats[-2] / stats[-1]
    df = np.zeros(max(stats) + 1 if max(stats) >= 0 else 1)
    for term, count in stats.items():
        if term >= 0:
            df[term] = count

    def ids_of(b: pa.RecordBatch) -> list[np.ndarray]:
        return [np.frombuffer(x.as_buffer(), f"<u{w}") for x, w in zip(b.column("ids"), b.column("width").to_pylist(), strict=True)]

    def key(splits: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weight = idf(df, n)
            for whole in batches:
                for b in (whole.slice(i, 1000) for i in range(0, whole.num_rows, 1000)):
                    t = race([x[:-1] for x in ids_of(b)], weight).astype(np.uint64) & np.uint64(0x1FFFF)
                    tie = mixed(b.column("row").to_numpy().astype(np.uint64)) >> np.uint64(52)
                    k = (t[:, 0] << np.uint64(46) | t[:, 1] << np.uint64(29) | t[:, 2] << np.uint64(12) | tie).astype(np.int64)
                    shard = np.searchsorted(splits, k, "right").astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(k), pa.array(shard)], names=[*b.schema.names, "key", "shard"])

        return run

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        w = TaskContext.get().partitionId() << 32

        def done(doc_ids: list, each: list[np.ndarray]) -> pa.RecordBatch:
            nonlocal w
            size = np.array([len(x) for x in each], np.int64)
            got = windows([x[:-1] for x in each], size, df, n, mean, length)
            crc = [zlib.crc32(each[d][s : s + m].astype("<u4").tobytes()) for d, s, m, _, _ in got]
            doc, start, long, window, offset = (np.array(x, np.int64) for x in zip(*got, strict=True))
            out = pa.RecordBatch.from_arrays([pa.array([doc_ids[d] for d in doc.tolist()], pa.int64()), pa.array(start), pa.array(long), pa.array(crc, pa.int64()), pa.array(size[doc]), pa.array(window + w), pa.array(offset)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            w += int(window.max()) + 1
            return out

        doc_ids, each, held, now = [], [], 0, None
        for b in batches:
            for i, x, shard in zip(b.column("doc_id").to_pylist(), ids_of(b), b.column("shard").to_pylist(), strict=True):
                if each and (shard != now or len(each) >= 1.5 * docs_per_shard or held + len(x) > TOKENS_PER_SHARD):
                    yield done(doc_ids, each)
                    doc_ids, each, held = [], [], 0
                now = shard
                doc_ids.append(i)
                each.append(x)
                held += len(x)
        if each:
            yield done(doc_ids, each)

    rows, kind = table.where("width > 0"), "row long, doc_id long, width byte, ids binary, key long, shard int"
    splits, shards = np.zeros(0, np.int64), min(MOST_BORDERS, -(-n // docs_per_shard))
    if shards > 1:
        some = rows.sample(min(1.0, SAMPLED * shards / n), 1).mapInArrow(trimmed(key(splits), "words"), kind)
        at = ",".join(f"{(i + 1) / shards:.9f}" for i in range(shards - 1))
        splits = np.unique(np.array(some.select(F.expr(f"approx_percentile(key, array({at}), {max(10_000, 10 * shards)})")).first()[0] or [], np.int64))
    lanes = lane_of(spark, shards)
    lane = F.element_at(F.from_json(F.lit(json.dumps(lanes)), "array<bigint>"), F.col("shard") + 1)
    dealt = rows.mapInArrow(trimmed(key(splits), "words"), kind).repartition(shards, lane).sortWithinPartitions("shard", "key", "row")
    return dealt.select("doc_id", "width", "ids", "shard").mapInArrow(trimmed(fill, "words"), schema)


def op8_retrieval_packing(spark, sf_dir: str) -> DataFrame:
    """All documents into sequences of 2048."""
    return pack(documents(spark, sf_dir))
