"""A content-addressed store of token ids.

A rolling hash over the ids cuts each document's stream into chunks, so equal passages give equal chunks wherever
they stand. A chunk's address is the BLAKE2b digest of its bytes. The files, all Parquet:

    chunks/   chunk_id (16 bytes), n_ids, payload (ids, little-endian, 2 bytes each; 4 for larger vocabularies)
    recipes/  doc_id, row, n_tokens, chunks (addresses in order), sizes, root; files and rows by ascending doc_id

root is the Merkle root over a document's chunk addresses: reading verifies each payload against its address and
each list of addresses against its root.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm import tokens
from tidegraph.llm.common import as_bytes, discard, documents, mixed, shared_dir, slices, trimmed, with_start, written

#: Ids that the rolling hash sees, bits of it that must be zero to cut, and the least and most ids of a chunk.
WINDOW, CUT_BITS, LEAST, MOST = 4, 9, 64, 4096
#: Addresses that a task remembers so as not to send a chunk twice; more are forgotten, which costs only traffic.
REMEMBERED = 200_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Pairs are hashed level by level; an odd last one moves up."""
    level = [digest(b"\0" + x) for x in leaves] or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"\1" + b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def chunk_ends(ids: np.ndarray, off: np.ndarray) -> list[list[int]]:
    """Where the chunks of each document (off: offsets in ids) end."""
    h = ids.astype(np.uint64)
    for k in range(1, WINDOW):
        h[k:] = h[k:] + ids[:-k].astype(np.uint64) * (_BASE ** np.uint64(k))
    places = np.flatnonzero((mixed(h) >> np.uint64(64 - CUT_BITS)) == 0) + 1
    out = []
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        ends, last = [], a
        for p in places[np.searchsorted(places, a + LEAST) : np.searchsorted(places, b)].tolist():
            if p - a < WINDOW or p - last < LEAST:
                continue  # the hash would see ids of the document before, or the chunk be small
            while p - last > MOST:
                ends.append(last := last + MOST)
            if p - last >= LEAST:
                ends.append(last := p)
        while b - last > MOST:
            ends.append(last := last + MOST)
        out.append([*ends, b] if b > last else ends)
    return out


_STAGED = "doc_id long, row long, n_tokens long, chunks array<binary>, sizes array<int>, root binary, fresh array<struct<chunk_id: binary, n_ids: int, payload: binary>>"


def write_store(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 0, width: int = 2) -> None:
    """Encodes every text (null: empty), appends end_id to each, and writes the store under path.

    Repeated rows get a recipe each and share their chunks; null doc_ids come first; other columns are not read;
    an empty table writes empty files. width: bytes of an id, 2 up to 65,536 ids.
    """
    dtype = {2: np.dtype("<u2"), 4: np.dtype("<u4")}[width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, seen = vocabulary or tokens.vocabulary(), set()
        schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_tokens", pa.int64()), ("chunks", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int32())), ("root", pa.binary()), ("fresh", pa.list_(pa.struct([("chunk_id", pa.binary()), ("n_ids", pa.int32()), ("payload", pa.binary())])))])
        for b in batches:
            buf, off = as_bytes(b.column("text"))
            for i, j in slices(off, 1 << 19):
                ids, at = tokens.encode(file, buf[off[i] : off[j]], off[i : j + 1] - off[i], end_id)
                if len(ids) and int(ids.max()) > np.iinfo(dtype).max:
                    raise ValueError(f"ids need more than {width} bytes")
                data = ids.astype(dtype).tobytes()
                cols: dict[str, list] = {k: [] for k in ("chunks", "sizes", "root")}
                new: tuple[list[bytes], list[int], list[bytes]] = ([], [], [])
                new_at = [0]
                for start, ends in zip(at[:-1].tolist(), chunk_ends(ids, at), strict=True):
                    names, sizes = [], []
                    for end in ends:
                        part = data[start * width : end * width]
                        name = digest(part)
                        names.append(name)
                        sizes.append(end - start)
                        if name not in seen:
                            if len(seen) >= REMEMBERED:
                                seen.clear()
                            seen.add(name)
                            for column, value in zip(new, (name, end - start, part), strict=True):
                                column.append(value)
                        start = end
                    for k, v in (("chunks", names), ("sizes", sizes), ("root", merkle_root(names))):
                        cols[k].append(v)
                    new_at.append(len(new[0]))
                kind = schema.field("fresh").type
                fresh = pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(new, kind.value_type, strict=True)], fields=list(kind.value_type))
                rest = [pa.array(cols[k], schema.field(k).type) for k in cols] + [pa.ListArray.from_arrays(pa.array(new_at, pa.int32()), fresh, type=kind)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i).cast(pa.int64()), b.column("row").slice(i, j - i), pa.array(np.diff(at)), *rest], schema=schema)

    spark = docs.sparkSession
    staged = written(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")).mapInArrow(trimmed(run, "words"), _STAGED), "ids-staged")
    each = staged.select(F.explode("fresh").alias("c")).select("c.*")
    each.groupBy("chunk_id").agg(F.first("n_ids").alias("n_ids"), F.first("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{path}/chunks")
    recipes = staged.drop("fresh")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    recipes.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "row").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "row").write.parquet(f"{path}/recipes")
    discard(staged)


def _times(a: int, b: int) -> int:
    """Product of polynomials modulo CRC-32's, bits reversed as in zlib."""
    m, p = 1 << 31, 0
    while True:
        if a & m:
            p ^= b
            if not a & (m - 1):
                return p
        m >>= 1
        b = (b >> 1) ^ 0xEDB88320 if b & 1 else b >> 1


_zeros: dict[int, int] = {}


def crc_join(first: int, second: int, n_second: int) -> int:
    """CRC-32 of two byte strings joined, from theirs and the length of the second."""
    if n_second not in _zeros:
        if len(_zeros) > 100_000:
            _zeros.clear()
        p, square, n = 1 << 31, 1 << 23, n_second  # 1, x^8
        while n:
            if n & 1:
                p = _times(square, p)
            square, n = _times(square, square), n >> 1
        _zeros[n_second] = p
    return _times(_zeros[n_second], first) ^ second


def read_store(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """doc_id, row, n_tokens, ids_crc32 (of the ids as 4 bytes each) and verified, per document, from the files alone."""
    dtype = {2: "<u2", 4: "<u4"}[width]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [x.as_py() for x in b.column("payload")]
            names = b.column("chunk_id")
            ok = [digest(x) == n.as_py() for x, n in zip(data, names, strict=True)]
            crc = [zlib.crc32(np.frombuffer(x, dtype).astype("<u4").tobytes()) for x in data]
            yield pa.RecordBatch.from_arrays([names, pa.array(ok), pa.array(crc, pa.int64()), pa.array([len(x) // width for x in data], pa.int32())], names=["chunk_id", "ok", "crc", "held"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pydict()
            crcs, good = [], []
            for parts, root, names in zip(rows["parts"], rows["root"], rows["chunks"], strict=True):
                crc = 0
                for p in parts:
                    crc = crc_join(crc, p["crc"] or 0, 4 * (p["held"] or 0))
                crcs.append(crc)
                good.append(all(p["ok"] for p in parts) and merkle_root(names) == root)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), pa.array([sum(p["held"] or 0 for p in x) for x in rows["parts"]], pa.int64()), pa.array(crcs, pa.int64()), pa.array(good, pa.bool_())], names=["doc_id", "row", "n_tokens", "ids_crc32", "verified"])

    chunks = spark.read.parquet(f"{path}/chunks").select("chunk_id", "payload").mapInArrow(trimmed(check, "words"), "chunk_id binary, ok boolean, crc long, held int")
    recipes = spark.read.parquet(f"{path}/recipes")
    uses = recipes.select("row", F.posexplode("chunks").alias("pos", "chunk_id"))
    found = uses.join(chunks, "chunk_id", "left").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "ok", "crc", "held"))).alias("parts"))
    return recipes.select("doc_id", "row", "root", "chunks").join(found, "row").mapInArrow(trimmed(join, "words"), "doc_id long, row long, n_tokens long, ids_crc32 long, verified boolean")


def op5_content_store(spark, sf_dir: str) -> DataFrame:
    """All documents into a store in the shared folder, and back; raises if a document is not what was written."""
    path = f"{shared_dir(spark)}/id-store-{uuid.uuid4().hex}"
    write_store(documents(spark, sf_dir), path)
    back = written(read_store(spark, path), "ids-read")
    if broken := back.where("not verified").count():
        raise RuntimeError(f"{broken} documents of the store at {path} do not fit their Merkle roots")
    return with_start(back, "n_tokens", ["doc_id", "row"]).select("doc_id", "start", "n_tokens", "ids_crc32", "verified")
