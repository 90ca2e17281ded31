"""Exact repeated passages by a distributed merge sort of suffixes.

A byte goes if a string of `length` bytes that covers it starts anywhere else. Each such string (window) is known by
its anchor, the place in it where the hash of the next bytes (the seed) is least: equal windows have their anchors
at equal places, so only suffixes that start at anchors need sorting, one in some 170 bytes for windows of 400.

1. Neighbouring windows with one anchor make a span. One pass over the texts writes the spans of all lengths that
   are asked for. Seeds are counted alone first, and only spans whose seed is met twice or more are kept. Spans of
   equal bytes (and equal places of the anchor) are counted by hash: in spans met twice or more all windows repeat.
2. Of what is left, the spans' suffixes (from the anchor on) are sorted into runs by the tasks that read the
   texts, front-coded (the length of the prefix shared with the suffix before, then the rest) and exchanged by
   seed. A loser tree merges the runs: the lengths of prefixes shared with the last winner decide most matches,
   and where they are equal bytes are compared only beyond them, so no known prefix is compared again. The merge
   gives the lengths of the prefixes that neighbours share, and these, with the bytes left of the anchor, say
   which windows are equal.

Seeds with more than MOST_SPANS different spans are settled by counting hashes of their windows instead, so that no
task holds them all.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import as_bytes, discard, documents, mixed, Rolling, slices, trimmed, written

LENGTH = 400
#: A passage is a run of repeated strings of so many bytes with so many words at least. 50 words have some 300 bytes.
PASSAGE_LENGTH, PASSAGE_WORDS = 200, 50
MOST_SPANS = 50_000
#: Bytes that are hashed at once: arrays of so many words stay in a core's cache.
_BLOCK = 1 << 16
_PLACE = np.uint64(_BLOCK - 1)
_AT = np.arange(_BLOCK, dtype=np.uint64)
_roll, _other = Rolling(seed=17), Rolling(base=0xC2B2AE3D27D4EB4F, seed=23)
_HEAD = struct.Struct("<HHHqqqB")


def seed_bytes(length: int) -> int:
    """Bytes of the seeds of windows of `length` bytes (100 to 1,000)."""
    return min(50, length // 4)


def pieces(off: np.ndarray, length: int = LENGTH) -> Iterator[tuple[int, int, int, int, int]]:
    """(first text, last text, first byte, last byte, own): several texts, or part of a long one.

    Windows of at most `length` bytes that begin in the first `own` bytes are the piece's; each is one piece's.
    """
    for i, j in slices(off, _BLOCK - 1):
        a, b = int(off[i]), int(off[j])
        if b - a < _BLOCK:
            yield i, j, a, b, b - a
        else:
            step = _BLOCK - length
            for s in range(a, b, step):
                e = min(b, s + step + length - 1)
                yield i, j, s, e, e - s if e == b else step
                if e == b:
                    break


def spans(buf: np.ndarray, off: np.ndarray, lengths: tuple[int, ...] = (LENGTH,), own: int | None = None) -> Iterator[tuple]:
    """length, and text, first and last window, anchor (places in buf), seed hash and hash of the bytes of its spans.

    off: where the texts begin in buf, and the end; at most _BLOCK bytes. own: windows that begin there are left out.
    """
    n, seed = len(buf), 0
    prefix, other = _roll.prefix(buf), _other.prefix(buf)
    for length in sorted(lengths):
        windows = min(n - length + 1, n if own is None else own)
        if windows < 1:
            return
        if seed != seed_bytes(length):
            seed = seed_bytes(length)
            m = n - seed + 1
            least, size = (((prefix[seed:] - prefix[:m]) * _roll.down[:m]) & ~_PLACE) | _AT[:m], 1
        # least key of each window: of `size` grams by doubling, which longer windows go on with, then of two that overlap
        grams_each = length - seed + 1
        while 2 * size <= grams_each:
            least, size = np.minimum(least[size:], least[:-size]), 2 * size
        low = np.minimum(least[:windows], least[grams_each - size : grams_each - size + windows])
        p0 = np.union1d(np.flatnonzero(low[1:] != low[:-1]) + 1, off[:-1][np.diff(off) >= length])
        p0 = p0[p0 < windows]
        text = np.searchsorted(off, p0, "right") - 1
        p1 = np.minimum(np.append(p0[1:], windows) - 1, off[text + 1] - length)
        inside = p0 <= p1
        text, p0, p1 = text[inside], p0[inside], p1[inside]
        a = (low[p0] & _PLACE).astype(np.int64)
        whole = mixed(_other.of(other, p0, p1 + length) + (a - p0).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (p1 - p0).astype(np.uint64))
        yield length, text, p0, p1, a, _roll.of(prefix, a, a + seed), whole


def _keyed(docs: DataFrame, also: list | None = None) -> DataFrame:
    """doc_id, text and the columns `also` with a key of 128 bits: rows that agree in it agree in doc_id and text."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *(also or [])).withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64("text", "doc_id")})


def span_table(keyed: DataFrame, *lengths: int) -> DataFrame:
    """length, k1, k2, place, seed, whole per span; place holds p0, p1 - p0 and a - p0 (see unpacked)."""
    names = ["length", "k1", "k2", "place", "seed", "whole"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = as_bytes(b.column("text"))
            k1, k2 = b.column("k1").to_numpy(), b.column("k2").to_numpy()
            rows, held = [], 0

            def flush() -> pa.RecordBatch:
                cols = [np.concatenate(c) for c in zip(*rows, strict=True)]
                return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

            for i, j, s, e, own in pieces(off, max(lengths)):
                for length, text, p0, p1, a, seed, whole in spans(buf[s:e], np.clip(off[i : j + 1] - s, 0, e - s), lengths, own):
                    shift = s - off[i + text]
                    rows.append([np.full(len(text), length, np.int32), k1[i + text], k2[i + text], ((p0 + shift) << 20) | ((p1 - p0) << 10) | (a - p0), seed.view(np.int64), whole.view(np.int64)])
                    held += len(text)
                if held > 50_000:
                    yield flush()
                    rows, held = [], 0
            if rows:
                yield flush()

    return keyed.select("k1", "k2", "text").mapInArrow(trimmed(run), "length int, k1 long, k2 long, place long, seed long, whole long")


def unpacked(rows: DataFrame) -> DataFrame:
    """rows with p0, p1 and a, the places of the first and the last window and of the anchor, for place."""
    p0 = F.shiftright("place", 20)
    return rows.withColumns({"p0": p0, "p1": p0 + F.shiftright("place", 10).bitwiseAND(F.lit(1023)), "a": p0 + F.col("place").bitwiseAND(F.lit(1023))}).drop("place")


def front_coded(rows: list[tuple]) -> bytes:
    """A run: rows (suffix, left, k1, k2, place, single), sorted by suffix."""
    out, before = [], b""
    for suffix, left, k1, k2, place, single in rows:
        n = shared(before, suffix, 0)
        out += [_HEAD.pack(n, len(suffix), len(left), k1, k2, place, single), suffix[n:], left]
        before = suffix
    return zstandard.ZstdCompressor(level=3).compress(b"".join(out))


def run_rows(blob: bytes) -> Iterator[tuple]:
    """(suffix, prefix shared with the one before, left, k1, k2, place, single) of a run, in order."""
    data, at, before = zstandard.ZstdDecompressor().decompress(blob), 0, b""
    while at < len(data):
        n, size, n_left, k1, k2, place, single = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        suffix = before[:n] + data[at : at + size - n]
        at += size - n
        yield suffix, n, data[at : at + n_left], k1, k2, place, single
        at += n_left
        before = suffix


def shared(a: bytes, b: bytes, known: int) -> int:
    """The length of the longest common prefix, of which `known` bytes are known."""
    most = min(len(a), len(b))
    while known < most:
        x, y = a[known : known + 32], b[known : known + 32]
        if x != y:
            n = min(len(x), len(y))
            differ = int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")
            return known + (n - (differ.bit_length() + 7) // 8 if differ else n)
        known += len(x)
    return most


def merged(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """Rows of all runs in order, each with the prefix it shares with the row before, by a loser tree."""
    k = 1
    while k < len(runs):
        k *= 2
    heads: list[tuple | None] = [next(r, None) for r in runs] + [None] * (k - len(runs))
    common = [0] * k  # with the last winner
    loser = [0] * k

    def wins(x: int, y: int) -> bool:
        """Does x come before y? What the loser shares with the winner is set."""
        if heads[y] is None:
            return True
        if heads[x] is None:
            return False
        if common[x] != common[y]:
            return common[x] > common[y]
        a, b = heads[x][0], heads[y][0]
        n = shared(a, b, common[x])
        first = (n == len(a)) if n == len(a) or n == len(b) else a[n] < b[n]
        common[y if first else x] = n
        return first

    def play(node: int) -> int:
        if node >= k:
            return node - k
        x, y = play(2 * node), play(2 * node + 1)
        if wins(x, y):
            loser[node] = y
            return x
        loser[node] = x
        return y

    best = play(1) if k > 1 else 0
    while heads[best] is not None:
        row = heads[best]
        yield (row[0], common[best], *row[2:])
        heads[best] = following = next(runs[best], None)
        common[best] = following[1] if following else 0
        node = (best + k) // 2
        while node:
            if wins(loser[node], best):
                loser[node], best = best, loser[node]
            node //= 2


def repeated_windows(lcp: np.ndarray, lefts: list[bytes], nearest: np.ndarray, length: int = LENGTH) -> Iterator[tuple[int, int, int]]:
    """(row, d, e): windows that begin d to e bytes left of the row's anchor repeat in another row.

    Rows are sorted by what follows the anchor; lcp: the prefix shared with the row before; lefts: the bytes before
    it, as far as the row's windows go; nearest: how far before it the nearest of the row's windows begins.
    """
    g = len(lefts)
    far = np.array([len(x) for x in lefts])
    first, most = int(nearest.min()), int(far.max())
    table = np.zeros((g, most), np.uint8)
    for i, x in enumerate(lefts):
        table[i, : len(x)] = np.frombuffer(x[::-1], np.uint8)
    step = max(1, 700_000 // g)
    running = np.zeros(g, np.uint64)
    hit = np.zeros((g, most - first + 1), bool)
    _roll._powers(most + 1)
    done = 0
    for d0 in range(first, most + 1, step):
        d = np.arange(d0, min(most + 1, d0 + step))
        # hashes of the d bytes left of the anchor
        if done < d0:
            part = table[:, done:d0]
            running = running + (_roll.table[part] * _roll.up[done:d0]).sum(axis=1, dtype=np.uint64)
            done = d0
        more = _roll.table[table[:, d0 : d[-1]]] * _roll.up[d0 : d[-1]]
        left = np.concatenate([running[:, None], running[:, None] + np.cumsum(more, axis=1, dtype=np.uint64)], axis=1)
        running, done = left[:, -1], int(d[-1])
        right = np.cumsum(lcp[:, None] < length - d[None, :], axis=0).astype(np.uint64)
        valid = (d[None, :] >= nearest[:, None]) & (d[None, :] <= far[:, None])
        key = mixed(mixed(left) + right * np.uint64(0x9E3779B97F4A7C15) + d[None, :].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        row, col = np.nonzero(valid)
        keys = key[row, col]
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        twice = np.zeros(len(keys), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hit[row[twice], col[twice] + d0 - first] = True
    step_up = np.diff(np.pad(hit.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    rows, begin = np.nonzero(step_up == 1)
    _, end = np.nonzero(step_up == -1)
    for r, b, e in zip(rows.tolist(), begin.tolist(), end.tolist(), strict=True):
        yield r, b + first, e - 1 + first


def _blocks(rows: Iterator[tuple], seed: int) -> Iterator[list[tuple]]:
    """Rows in blocks of some 2,000 that don't part suffixes with a seed in common."""
    block: list[tuple] = []
    for row in rows:
        if len(block) >= 2000 and row[1] < seed:
            yield block
            block = []
        block.append(row)
    if block:
        yield block


def repeats(keyed: DataFrame, *lengths: int) -> list[DataFrame]:
    """For each length k1, k2, s, e: bytes s to e of the texts lie in repeated windows; written tables. keyed: see _keyed."""
    every = written(span_table(keyed, *lengths), "spans-all")
    out = [_repeats(keyed, every.where(F.col("length") == length).drop("length"), length) for length in lengths]
    discard(every)
    return out


def _repeats(keyed: DataFrame, every: DataFrame, length: int) -> DataFrame:
    """k1, k2, s, e by the spans of one length."""
    spark = keyed.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    often = written(every.groupBy("seed").count().where("count > 1").select("seed"), "seeds")
    table = written(every.join(often, "seed", "left_semi"), "spans")
    counted = table.groupBy("seed", "whole").agg(F.count("*").alias("c"), F.min(F.struct("k1", "k2", "place")).alias("span"))
    counted = written(counted, "spans-counted")
    # every span gets its count; where it is one, no bytes go
    each = unpacked(table.join(counted.select("seed", "whole", "c"), ["seed", "whole"], "left"))
    plain = each.select("k1", "k2", F.col("p0").alias("s"), F.when(F.col("c") > 1, F.col("p1") + length).alias("e")).where("e > s")
    open_ = counted.groupBy("seed").agg(F.count("*").alias("kinds"), F.min("c").alias("least")).where("kinds > 1 and least = 1").select("seed", "kinds")
    wanted = written(counted.join(open_, "seed").select("seed", "kinds", (F.col("c") == 1).alias("single"), "span.*"), "spans-open")

    def with_text(rows: DataFrame) -> DataFrame:
        of_doc = unpacked(rows).groupBy("k1", "k2").agg(F.collect_list(F.struct("seed", "single", "p0", "p1", "a")).alias("spans"))
        return keyed.select("k1", "k2", "text").join(of_doc, ["k1", "k2"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[int, list[tuple]] = {}
        held, met = 0, set()

        def flush() -> pa.RecordBatch:
            names = sorted(runs)
            blobs = [front_coded(sorted(runs[k])) for k in names]
            runs.clear()
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "run"])

        for b in batches:
            texts, lists = b.column("text"), b.column("spans")
            for k1, k2, text, own in zip(b.column("k1").to_pylist(), b.column("k2").to_pylist(), texts, lists.to_pylist(), strict=True):
                if (k1, k2) in met:
                    continue  # a repeated row: its spans are the same
                if len(met) < 100_000:
                    met.add((k1, k2))
                data = text.as_buffer().to_pybytes()
                for x in own:
                    a = x["a"]
                    row = (data[a : x["p1"] + length], data[x["p0"] : a], k1, k2, a, int(x["single"]))
                    runs.setdefault((x["seed"] & 0x7FFFFFFFFFFFFFFF) % parts, []).append(row)
                    held += len(row[0]) + len(row[1]) + 200
            if held > 32 << 20:
                yield flush()
                held = 0
        if runs:
            yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[int, list[bytes]] = {}
        for b in batches:
            for k, blob in zip(b.column("part").to_pylist(), b.column("run").to_pylist(), strict=True):
                runs.setdefault(k, []).append(blob)
        for blobs in runs.values():
            for block in _blocks(merged([run_rows(x) for x in blobs]), seed_bytes(length)):
                if len(block) < 2:
                    continue
                lcp = np.array([row[1] for row in block])
                lcp[0] = 0
                nearest = np.array([length - len(row[0]) for row in block])
                out = [(block[r][3], block[r][4], block[r][5] - far, block[r][5] - near + length) for r, near, far in repeated_windows(lcp, [row[2] for row in block], nearest, length) if block[r][6]]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(4)], names=["k1", "k2", "s", "e"])

    found = with_text(wanted.where(F.col("kinds") <= MOST_SPANS)).mapInArrow(trimmed(encode), "part int, run binary")
    found = found.repartition(parts, "part").mapInArrow(trimmed(merge), "k1 long, k2 long, s long, e long")
    out = plain.union(found)

    windowed = []
    hot = wanted.where(F.col("kinds") > MOST_SPANS)
    if not hot.isEmpty():

        def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k1, k2, text, own in zip(b.column("k1").to_pylist(), b.column("k2").to_pylist(), b.column("text"), b.column("spans").to_pylist(), strict=True):
                    buf = np.frombuffer(text.as_buffer(), np.uint8)
                    for x in own:
                        part = buf[x["p0"] : x["p1"] + length]
                        at = np.arange(x["p1"] - x["p0"] + 1)
                        one, two = (r.of(r.prefix(part), at, at + length) for r in (_roll, _other))
                        n = len(at)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k1)), pa.array(np.full(n, k2)), pa.array(at + x["p0"]), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(np.full(n, x["single"]))], names=["k1", "k2", "s", "one", "two", "single"])

        each = written(with_text(hot).mapInArrow(trimmed(windows), "k1 long, k2 long, s long, one long, two long, single boolean"), "windows")
        windowed.append(each)
        twice = each.select("k1", "k2", "s", "one", "two").distinct().groupBy("one", "two").count().where("count > 1")
        out = out.union(each.where("single").join(twice, ["one", "two"], "left_semi").select("k1", "k2", "s", (F.col("s") + length).alias("e")))
    out = written(out, "repeats")
    discard(often, table, counted, wanted, *windowed)
    return out


def _union(parts: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted((p["s"], p["e"]) for p in parts):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def _parts(found: DataFrame, name: str) -> DataFrame:
    """k1, k2 and the list `name` of a document's repeated windows (s, e), in no order; they may overlap."""
    return found.groupBy("k1", "k2").agg(F.collect_set(F.struct("s", "e")).alias(name))


def strip(docs: DataFrame, length: int = PASSAGE_LENGTH, least_words: int = PASSAGE_WORDS) -> DataFrame:
    """docs with repeated passages cut out of the texts; all columns and rows stay.

    A passage is a run of bytes that strings of `length` bytes which start elsewhere as well cover, with least_words
    words or more (parts of words at its ends count as words). Null texts become empty. Half characters that a cut
    leaves go as well. Equal rows are cut alike, an empty table gives no rows, columns may have any names.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    keyed = _keyed(docs, [docs[c].alias(f"_c{i}") for i, c in enumerate(others)])
    rows = keyed.join(_parts(repeats(keyed, length)[0], "parts"), ["k1", "k2"], "left").drop("k1", "k2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, 500) for whole in batches for i in range(0, whole.num_rows, 500)):
            texts = []
            for text, parts in zip(b.column("text"), b.column("parts").to_pylist(), strict=True):
                whole, at, left = text.as_buffer().to_pybytes(), 0, []
                for s, e in passages(whole, parts, least_words):
                    left.append(whole[at:s])
                    at = e
                texts.append(b"".join([*left, whole[at:]]).decode(errors="ignore"))
            yield pa.RecordBatch.from_arrays([pa.array(texts, b.schema.field("text").type) if c == "text" else b.column(c) for c in b.schema.names if c != "parts"], names=[c for c in b.schema.names if c != "parts"])

    out = rows.mapInArrow(trimmed(run), rows.drop("parts").schema)
    named = {"doc_id": "doc_id", "text": "text", **{c: f"_c{i}" for i, c in enumerate(others)}}
    return out.select(*[F.col(named[c]).alias(c) for c in docs.columns])


def passages(text: bytes, parts: list[dict] | None, least_words: int) -> list[tuple[int, int]]:
    """The runs of repeated windows with least_words words or more."""
    return [(s, e) for s, e in _union(parts or []) if len(text[s:e].split()) >= least_words]


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, n_passage_bytes per document.

    n_removed, n_spans and kept_sha256 are of windows of LENGTH bytes. n_passages and n_passage_bytes are the runs that
    strip would cut: of PASSAGE_WORDS words or more, which may be shorter than LENGTH. Null texts count as empty; equal
    rows have equal results; null doc_ids stay; an empty table gives no rows; other columns are not read. Matches are
    of bytes and may begin inside a character.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, 500) for whole in batches for i in range(0, whole.num_rows, 500)):
            counts, sha = [], []
            for text, parts, short in zip(b.column("text"), b.column("parts").to_pylist(), b.column("short").to_pylist(), strict=True):
                data, cuts, h, at = text.as_buffer(), _union(parts or []), hashlib.sha256(), 0
                whole = memoryview(data)
                for s, e in cuts:
                    h.update(whole[at:s])
                    at = e
                h.update(whole[at:])
                found = passages(data.to_pybytes(), short, PASSAGE_WORDS) if short else []
                counts.append((len(whole), sum(e - s for s, e in cuts), len(cuts), len(found), sum(e - s for s, e in found)))
                sha.append(h.hexdigest())
            n_bytes, n_removed, n_spans, n_found, found_bytes = (pa.array(x, pa.int64()) for x in zip(*counts, strict=True))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), n_bytes, n_removed, n_spans, pa.array(sha, pa.string()), n_found, found_bytes], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "n_passage_bytes"])

    keyed = _keyed(docs)
    parts, short = (_parts(found, name) for found, name in zip(repeats(keyed, LENGTH, PASSAGE_LENGTH), ("parts", "short"), strict=True))
    both = written(parts.join(short, ["k1", "k2"], "full"), "repeats-both")
    rows = keyed.join(both, ["k1", "k2"], "left").drop("k1", "k2")
    return rows.mapInArrow(trimmed(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, n_passage_bytes long")


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Repeated passages of 400 bytes in all documents, and those of 50 words."""
    return dedup(documents(spark, sf_dir))
