"""N-gram Jaccard join with signature trees.

A text is the set of its distinct word shingles. Texts with equal sets are one node. Candidates come from the
least hashes of a set (its sketch): sets as alike as 0.75 share each of the KEYS least hashes of their union with
probability 0.75 or more, so that they share none happens with 0.25^24 < 4e-15, as rarely as hashes collide.

1. Nodes that share a key meet, with their sketches. A signature tree over them finds which are roughly alike;
   only a spanning forest of these links leaves the task. Its components are families.
2. The texts of a family meet once. A signature tree over the whole sets, with exact intersections at the leaves,
   finds a spanning forest of the exact links.

A tree's nodes hold the OR of their members' token bitmaps and the range of their sizes; two nodes are opened
only if some pair below could reach the overlap that a link needs and is not connected yet.

Hot keys (of more than CAP nodes) bring no nodes together: two nodes share a key that is not hot as well, unless more
than FEW keys of both are hot. Such nodes meet again by all hashes of their sketches. Only those whose sketch is hot
nearly throughout even there (among such nodes) become one family unseen, which costs time but no link.

A family of more than CAP nodes is cut into blocks. Links inside the blocks come first; then one node of each
component found meets those of the other blocks. Only if the family is not one component by then do pairs of blocks
meet, and in them only nodes of different components are compared. A large group of near copies is connected by the
first two steps.

Nodes are named by hashes of 128 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import as_bytes, documents, mixed, row_key, slices, trim, trimmed, written
from tidegraph.llm.components import components
from tidegraph.llm.repetition import _BASE, Texts

WORDS = 5
SKETCH, KEYS, FEW, CAP = 64, 24, 3, 2000
#: A set of SKETCH shingles or more meets another by the hashes that are not hot if at most MANY are: as rarely not as with KEYS.
MANY = SKETCH - KEYS
#: Sketches this alike make a family: sets as alike as 0.75 have 48 of 64 in common, 22 or fewer with less than 1e-12.
ROUGH = 0.34
LEAF = 8

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def shingle_sets(buf: np.ndarray, off: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Ascending hashes of each text's distinct shingles back to back, and the texts' offsets in them.

    A text of fewer words has the whole sequence as its one shingle; one without words has none.
    """
    t = Texts(_LOWER[buf], off)
    w = len(t.start)
    n = max(0, w - words + 1)
    gram = t.hash[:n].copy()
    for k in range(1, words):
        gram = gram * _BASE + t.hash[k : n + k]
    inside = t.doc[:n] == t.doc[words - 1 :]
    doc, gram = t.doc[:n][inside], mixed(gram[inside])
    first = np.searchsorted(t.doc, np.arange(t.n))
    few = np.flatnonzero((t.n_words > 0) & (t.n_words < words))
    whole = []
    for d in few.tolist():
        h = np.array([t.n_words[d]], np.uint64)
        for x in t.hash[first[d] : first[d] + t.n_words[d]]:
            h = mixed(h * _BASE + x)
        whole.append(h[0])
    doc, gram = np.concatenate([doc, few]), np.concatenate([gram, np.array(whole, np.uint64)])
    order = np.lexsort((gram, doc))
    doc, gram = doc[order], gram[order]
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])
    doc, gram = doc[keep], gram[keep]
    return gram, np.searchsorted(doc, np.arange(t.n + 1))


class Forest:
    """Which members are connected, and the links that connected them."""

    def __init__(self, n: int):
        self.up, self.links = np.arange(n), []

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def roots(self) -> np.ndarray:
        while (self.up != (two := self.up[self.up])).any():
            self.up = two
        return self.up

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.links.append((i, j))


def link(sets: list[np.ndarray], sizes: np.ndarray, need: Callable[[np.ndarray, np.ndarray], np.ndarray], ratio: float, side: np.ndarray | None = None, known: list | None = None) -> Forest:
    """A spanning forest (its links are new ones) of the pairs whose sets share at least need(length, length) tokens.

    sizes: what must be as alike as ratio; side: if given, only pairs of different sides count; known: components that
    members belong to already, whose links are not looked for.
    """
    g = len(sets)
    forest = Forest(g)
    if known is not None:
        met: dict = {}
        for i, x in enumerate(known):
            forest.up[i] = met.setdefault(x, i)
    length = np.array([len(s) for s in sets])

    def same(i: int, j: int) -> bool:
        return len(np.intersect1d(sets[i], sets[j], assume_unique=True)) >= need(length[i], length[j])

    if g <= LEAF:  # a tree of one leaf
        for i in range(g):
            for j in range(i):
                if (side is None or side[i] != side[j]) and min(sizes[i], sizes[j]) >= ratio * max(sizes[i], sizes[j]) and forest.root(i) != forest.root(j) and same(i, j):
                    forest.join(i, j)
        return forest

    # leaves hold members that begin alike; the tree above them is binary
    order = np.lexsort((sizes, [int(s[0]) if len(s) else 0 for s in sets]))
    bits = 1 << int(np.clip(np.ceil(np.log2(8 * max(1, np.median(length)))), 9, 14))
    maps = np.zeros((g, bits // 64), np.uint64)
    for a in range(0, g, 512):
        some = order[a : a + 512]
        flags = np.zeros((len(some), bits), bool)
        flat = np.concatenate([sets[i] for i in some]).astype(np.uint64)
        flags[np.repeat(np.arange(len(some)), length[some]), (flat * _BASE >> np.uint64(64 - (bits - 1).bit_length())).astype(np.int64)] = True
        maps[a : a + len(some)] = np.packbits(flags, axis=1).view(np.uint64)
    size, tokens = sizes[order], length[order]
    # tokens that share a bit: how many more than its bits a set may have in common with another
    extra = tokens - np.bitwise_count(maps).sum(1)
    edges = np.append(np.arange(0, g, LEAF), g)
    levels = [(np.bitwise_or.reduceat(maps, edges[:-1]), np.minimum.reduceat(size, edges[:-1]), np.maximum.reduceat(size, edges[:-1]), np.minimum.reduceat(tokens, edges[:-1]), np.maximum.reduceat(extra, edges[:-1]))]
    while len(levels[-1][0]) > 1:
        at = np.arange(0, len(levels[-1][0]), 2)
        levels.append(tuple(f.reduceat(x, at) for f, x in zip((np.bitwise_or, np.minimum, np.maximum, np.minimum, np.maximum), levels[-1], strict=True)))
    span = [edges]
    for _ in levels[1:]:
        span.append(np.append(span[-1][:-1][::2], g))
    todo = [(len(levels) - 1, 0, 0)]
    while todo:
        k, p, q = todo.pop()
        low, high, fewest, spare = (x for x in levels[k][1:])
        if p != q:
            if min(high[p], high[q]) < ratio * max(low[p], low[q]):
                continue
            if np.bitwise_count(levels[k][0][p] & levels[k][0][q]).sum() + min(spare[p], spare[q]) < need(fewest[p], fewest[q]):
                continue
        if k:
            a, b = (2 * p, 2 * p + 1), (2 * q, 2 * q + 1)
            m = len(levels[k - 1][0])
            pairs = [(x, y) for x in a for y in b if x < m and y < m and (p != q or x <= y)]
            todo += [(k - 1, x, y) for x, y in pairs[::-1]]
            continue
        i, j = np.arange(span[0][p], span[0][p + 1]), np.arange(span[0][q], span[0][q + 1])
        r = forest.roots()
        open_ = r[order[i]][:, None] != r[order[j]][None, :]
        if side is not None:
            open_ &= side[order[i]][:, None] != side[order[j]][None, :]
        if p == q:
            open_ &= i[:, None] < j[None, :]
        if not open_.any():
            continue
        open_ &= np.minimum(size[i][:, None], size[j][None, :]) >= ratio * np.maximum(size[i][:, None], size[j][None, :])
        x, y = np.nonzero(open_)
        common = np.bitwise_count(maps[i[x]] & maps[j[y]]).sum(1)
        bound = common + np.minimum(extra[i[x]], extra[j[y]])
        maybe = bound >= need(tokens[i[x]], tokens[j[y]])
        x, y, common = x[maybe], y[maybe], common[maybe]
        for z in np.argsort(-common, kind="stable").tolist():  # the likeliest first: they connect the others
            a, b = int(order[i[x[z]]]), int(order[j[y[z]]])
            if forest.root(a) != forest.root(b) and same(a, b):
                forest.join(a, b)
    return forest


def _rough(a, b):
    return np.maximum(1, np.ceil(ROUGH * np.minimum(a, b)))


def _exact(percent: int) -> Callable:
    """The least overlap i of sets of a and b with 100 i >= percent (a + b - i)."""
    return lambda a, b: -(-percent * (a + b) // (100 + percent))


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows of each key (the first n_keys columns), from sorted batches."""
    open_key, parts = None, []
    for b in batches:
        if not b.num_rows:
            continue
        keys = [b.column(k).to_numpy(zero_copy_only=False) for k in range(n_keys)]
        change = np.zeros(b.num_rows, bool)
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for a, e in zip(starts[:-1], starts[1:], strict=True):
            key = tuple(k[a].item() if k.dtype != object else k[a] for k in keys)
            if parts and key != open_key:
                yield open_key, pa.Table.from_batches(parts)
                parts = []
            open_key = key
            parts.append(b.slice(a, e - a))
    if parts:
        yield open_key, pa.Table.from_batches(parts)


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, rk, n, node (a hash of the whole set) and sketch (its least hashes) per document.

    Null, empty and blank texts have n = 0 and an empty sketch; repeated rows and null doc_ids give a row each, an empty
    table none; other columns are not read. Sketches hold SKETCH hashes at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = as_bytes(b.column("text"))
            for i, j in slices(off):
                gram, at = shingle_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i], words)
                n = np.diff(at)
                sums = []
                for salt in (1, 2):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(gram + np.uint64(salt)))])
                    sums.append(total[at[1:]] - total[at[:-1]])
                node = np.stack([mixed(sums[0] + mixed(sums[1] ^ n.astype(np.uint64)) * _BASE), mixed(sums[1] ^ mixed(sums[0]))], axis=1)
                node = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), j - i, [None, pa.py_buffer(np.ascontiguousarray(node))]).cast(pa.binary())
                kept = np.minimum(n, SKETCH)
                flat = gram[np.arange(int(kept.sum())) + np.repeat(at[:-1] - (np.cumsum(kept) - kept), kept)]
                ends = np.concatenate([[0], np.cumsum(kept)])
                sketch = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i).cast(pa.int64()), b.column("rk").slice(i, j - i), pa.array(n), node, sketch], names=["doc_id", "rk", "n", "node", "sketch"])

    return docs.select("doc_id", "text", row_key().alias("rk")).mapInArrow(trimmed(run), "doc_id long, rk long, n long, node binary, sketch array<long>")


def _families(nodes: DataFrame) -> DataFrame:
    """node and root of each family of two nodes or more."""
    # unsigned order: the least hashes come first in a sketch
    keys = nodes.select("node", "n", F.explode(F.slice("sketch", 1, KEYS)).alias("key"))
    often = keys.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    met = written(keys.join(often, "key"), "keys")
    hot = met.groupBy("node", "n").agg(F.sum(F.when(F.col("df") > CAP, 1).otherwise(0)).alias("n_hot"))
    ruled = hot.where(F.when(F.col("n") >= KEYS, F.col("n_hot") > FEW).otherwise(2 * F.col("n_hot") >= F.col("n")) & (F.col("n_hot") > 0)).select("node")
    ruled = written(ruled, "ruled")
    sketches = nodes.select("node", F.transform("sketch", lambda x: F.shiftright(x, 32).cast("int")).alias("sketch"))
    meeting = met.where(F.col("df") <= CAP).select("key", "node", "n")
    star_edges = None
    if not ruled.isEmpty():
        wide = nodes.join(ruled, "node", "left_semi").select("node", "n", F.explode("sketch").alias("key"))
        wide = written(wide.join(wide.groupBy("key").agg(F.count("*").alias("df")).where("df > 1"), "key"), "wide-keys")
        meeting = meeting.union(wide.where(F.col("df") <= CAP).select(F.xxhash64("key"), "node", "n"))
        # up to 48 shingles a partner's sketch is its whole set (and three quarters are shared), up to 64 it lacks 21 at most
        n_hot = F.sum(F.when(F.col("df") > CAP, 1).otherwise(0))
        few = F.when(F.col("n") <= 48, 4 * n_hot >= 3 * F.col("n")).when(F.col("n") < SKETCH, 4 * n_hot >= F.col("n")).otherwise(n_hot > MANY)
        stars = wide.where(F.col("df") > CAP).join(wide.groupBy("node", "n").agg(few.alias("few")).where("few").select("node"), "node", "left_semi")
        centres = stars.groupBy("key").agg(F.min("node").alias("v"))
        star_edges = stars.join(centres, "key").select(F.col("node").alias("u"), "v")
    rows = meeting.join(sketches, "node").select("key", "node", "n", "sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[bytes, bytes] = {}  # what this task has connected; equal groups meet again and again

        def root(x: bytes) -> bytes:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        u, v = [], []
        for _, t in _groups(batches, 1):
            ids = t["node"].to_pylist()
            roots = [root(x) for x in ids]
            if len(set(roots)) > 1:
                flat = t["sketch"].combine_chunks()
                ends = flat.offsets.to_numpy()
                values = flat.values.to_numpy().view(np.uint32).astype(np.uint64)
                sets = [np.unique(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                for i, j in link(sets, t["n"].to_numpy(), _rough, 0.75).links:
                    a, b = root(ids[i]), root(ids[j])
                    if a != b:
                        up[max(a, b)] = min(a, b)
                        u.append(ids[i])
                        v.append(ids[j])
            if len(u) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], names=["u", "v"])
                u, v = [], []
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], names=["u", "v"])

    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = rows.repartition(parts, "key").sortWithinPartitions("key", "node").mapInArrow(trimmed(run), "u binary, v binary")
    return components(edges if star_edges is None else edges.union(star_edges))


def jaccard_groups(docs: DataFrame, percent: int = 75, words: int = WORDS) -> DataFrame:
    """doc_id, rk (tells rows with equal doc_id apart), n_shingles, component_id and root per document.

    root names the component (null without shingles); component_id is its least doc_id; null doc_ids count in a component's links but not for
    that, and a component of null doc_ids only has a null one. Null and empty texts have no shingles and are
    linked with nothing. Repeated rows give a row each. An empty table gives no rows. Other columns are not read.
    percent: the least similarity; 75 or more.
    """
    if percent < 75:
        raise ValueError("sketches are made for a similarity of 0.75 or more")
    signed = written(signatures(docs, words), "signatures")
    some = signed.where("n > 0")
    nodes = written(some.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "rk")).alias("first"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "nodes")
    family = written(_families(nodes), "families")
    sizes = family.groupBy("root").agg(F.count("*").alias("members"))
    blocks = F.ceil(F.col("members") / CAP).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = written(family.join(sizes, "root").withColumn("blocks", blocks).select("node", "root", "blocks", own.alias("block")), "placed")
    firsts = placed.select("node").join(nodes.select("node", F.col("first.doc_id").alias("f_id"), F.col("first.rk").alias("f_rk")), "node")
    text = docs.select("doc_id", "text", row_key().alias("rk"))
    found = text.join(firsts, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("rk") == F.col("f_rk"))).select("node", "text")
    texts = written(found.dropDuplicates(["node"]), "texts")  # a text for each node of a family
    need = _exact(percent)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), t in _groups(batches, 3):
            ids, known = t["node"].to_pylist(), t["known"].to_pylist()
            large = t["blocks"][0].as_py() > 1
            forest = Forest(len(ids))
            if len(set(known)) > 1:
                buf, off = as_bytes(t["text"])
                sets = []
                for a, b in slices(off):
                    gram, at = shingle_sets(buf[off[a] : off[b]], off[a : b + 1] - off[a], words)
                    sets += [gram[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]
                side = None if i == j else t["block"].to_numpy()
                forest = link(sets, np.array([len(s) for s in sets]), need, percent / 100, side, known)
                if len(ids) > CAP // 4:
                    trim()
            out = [(ids[a], ids[b], True) for a, b in forest.links]
            if large and i == j:
                out += [(x, ids[r], False) for x, r in zip(ids, forest.roots().tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.bool_())], names=["u", "v", "link"])

    def met(groups: DataFrame, name: str) -> DataFrame:
        """u, v, link: links between the nodes of each (root, i, j), and where i = j in a family of several blocks each
        node u with the one v that stands for its component there. groups: node, root, i, j, blocks, block, known."""
        # Spark takes the pairs for as small as the file they are exploded from, and would broadcast them
        rows = groups.join(texts.hint("merge"), "node").repartition(parts, "root", "i", "j").sortWithinPartitions("root", "i", "j", "node")
        return written(rows.select("root", "i", "j", "node", "block", "blocks", "known", "text").mapInArrow(trimmed(run), "u binary, v binary, link boolean"), name)

    inside = met(placed.select("node", "root", F.col("block").alias("i"), F.col("block").alias("j"), "blocks", "block", F.col("node").alias("known")), "links-inside")
    links = inside.where("link").select("u", "v")
    large = placed.where("blocks > 1")
    if not large.isEmpty():
        inner = large.join(inside.where("not link").select(F.col("u").alias("node"), F.col("v").alias("head")), "node")
        # one node of each component, all of a family together as far as CAP lets
        heads = inner.where("node = head").select("node", "root", "blocks")
        many = heads.groupBy("root").agg(F.ceil(F.count("*") / CAP).cast("int").alias("tables"))
        seat = F.pmod(F.xxhash64("node"), F.col("tables")).cast("int")
        between = met(heads.join(many, "root").select("node", "root", seat.alias("i"), seat.alias("j"), "blocks", seat.alias("block"), F.col("node").alias("known")), "links-heads")
        outer = written(inner.join(between.where("not link").select(F.col("u").alias("head"), F.col("v").alias("known")), "head").select("node", "root", "blocks", "block", "known"), "outer")
        apart = outer.groupBy("root").agg(F.min("known").alias("a"), F.max("known").alias("b")).where("a <> b").select("root")
        pairs = outer.join(apart, "root", "left_semi").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).where("other <> block")
        pairs = pairs.select("node", "root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "blocks", "block", "known")
        across = met(pairs, "links-across")
        links = links.union(between.where("link").select("u", "v")).union(across.where("link").select("u", "v"))
    roots = written(components(links), "components")
    known = nodes.select("node", F.col("first.doc_id").alias("least")).join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least")
    known = written(known, "component-nodes")
    names = known.groupBy("root").agg(F.min("least").alias("component_id"))
    of_node = known.join(names, "root").select("node", "component_id", "root")
    linked = some.select("doc_id", "rk", "n", "node").join(of_node, "node").select("doc_id", "rk", F.col("n").alias("n_shingles"), "component_id", "root")
    return linked.unionByName(signed.where("n = 0").select("doc_id", "rk", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("binary").alias("root")))


def one_of_each(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One document of each group of near duplicates; all columns stay, whatever their names.

    It is the one of least doc_id; documents without doc_id come after all others, and ties are settled by a hash of
    the text. Of rows that agree in doc_id and text one stays. Documents without words are linked with nothing and stay.
    An empty table gives no rows.
    """
    groups = written(jaccard_groups(docs, percent), "groups")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "rk")).alias("least")
    keep = groups.where(F.col("root").isNotNull()).groupBy("root").agg(least).select("least.doc_id", "least.rk")
    keep = written(keep.union(groups.where(F.col("root").isNull()).select("doc_id", "rk").distinct()), "kept")
    names = [c if c in ("doc_id", "text") else f"_c{k}" for k, c in enumerate(docs.columns)]
    keyed = docs.toDF(*names).withColumns({"_rk": row_key(), "_id": F.coalesce("doc_id", F.lit(0)), "_null": F.col("doc_id").isNull()})
    rows = keep.select(F.col("rk").alias("_rk"), F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_null"))
    return keyed.join(rows, ["_rk", "_id", "_null"]).dropDuplicates(["_rk", "_id", "_null"]).select(*names).toDF(*docs.columns)


def op6_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Components of all documents at a similarity of 0.75."""
    return jaccard_groups(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")
