"""Byte-level BPE encoding and decoding with a vectorised pre-tokenizer.

Texts become code points and these become classes (letter, number, white space, other). A code point's transition
function on the automaton's state, the start of the open token, either sets it to its own place or keeps it;
such functions compose associatively, so one prefix scan evaluates the automaton at all places at once and the
tokens' slices are where the state changes. Slices go through pair merging, whose results are kept for slices
that recur. Offsets of tokens and slices are kept, and decoding gathers bytes by id.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidegraph.llm.common import as_bytes, documents, kept, slices, trimmed
from tidegraph.llm.tokens import Words, _gather

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: White space of the pre-tokenizer's pattern (fixed values: Unicode's White_Space property).
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Endings that stand alone after an apostrophe (fixed values).
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]

_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of each code point."""
    if not _classes:
        import regex

        table = np.full(0x110000, OTHER, np.uint8)
        points = np.concatenate([np.arange(0xD800, dtype=np.uint32), np.arange(0xE000, 0x110000, dtype=np.uint32)])
        every = points.tobytes().decode("utf-32-le")
        for name, value in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
            for m in regex.finditer(name, every):
                table[points[m.start() : m.end()]] = value
        table[WHITE_SPACE] = SPACE
        _classes.append(table)
    return _classes[0]


def token_starts(points: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where tokens of the pre-tokenizer begin; off: where the texts begin in points, and the end."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    space = kind == SPACE
    before = np.empty(n, np.uint8)
    before[0], before[1:] = 255, kind[:-1]
    before[edge[:n]] = 255
    blank_before = np.zeros(n, bool)
    blank_before[1:] = points[:-1] == 0x20
    blank_before[edge[:n]] = False
    last_of_run = np.zeros(n, bool)  # white space with something after it in its text
    last_of_run[:-1] = space[:-1] & ~space[1:]
    last_of_run &= ~edge[1:]
    sets = np.where(space, (before != SPACE) | last_of_run, (before != kind) & ~blank_before)
    # apostrophes that open a token may have an ending with them; what follows opens a token again
    marks = np.flatnonzero((points == 0x27) & sets)
    if len(marks):
        stop = off[np.searchsorted(off, marks, "right")]
        pad = np.append(points, [0, 0, 0])
        for e in ENDINGS:
            hit = marks[(marks + len(e) < stop) & np.logical_and.reduce([pad[marks + 1 + k] == ord(c) for k, c in enumerate(e)])]
            sets[hit + 1] = False
            after = hit + 1 + len(e)
            inside = after[after < n]
            inside = inside[~edge[inside]]
            # after the ending: a letter goes on as a token of its own; anything else opens one by its class already
            sets[inside[kind[inside] == LETTER]] = True
    state = np.maximum.accumulate(np.where(sets, np.arange(n), 0))
    return np.flatnonzero(state == np.arange(n)) if sets[0] else np.flatnonzero(sets)


class Bpe:
    """Encoder and decoder by merge ranks (token bytes -> id)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        tokens = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            tokens[i] = t
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.words = Words(self._encode)

    @classmethod
    def load(cls, path: str) -> Bpe:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})

    def merge(self, word: bytes) -> list[int]:
        """Joins the pair of lowest rank, the first of equal ones, until none has a rank."""
        ranks = self.ranks
        if (whole := ranks.get(word)) is not None:
            return [whole]
        parts = [word[i : i + 1] for i in range(len(word))]
        none = len(self.size)
        pair = [ranks.get(parts[i] + parts[i + 1], none) for i in range(len(parts) - 1)]
        while pair:
            low = min(pair)
            if low == none:
                break
            i = pair.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pair[i]
            if i < len(pair):
                pair[i] = ranks.get(parts[i] + parts[i + 1], none)
            if i:
                pair[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        return [ranks[p] for p in parts]

    def merge_long(self, word: bytes) -> list[int]:
        """As merge, with a heap: for slices so long that merge's scans would cost the square of their length."""
        import heapq

        ranks, n = self.ranks, len(word)
        after, back, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            r, i, e = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or end[j] != e:
                continue
            alive[j] = False
            end[i], after[i] = e, after[j]
            if after[i] < n:
                back[after[i]] = i
                if (x := ranks.get(word[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (x, i, end[after[i]]))
            if (p := back[i]) >= 0 and (x := ranks.get(word[p:e])) is not None:
                heapq.heappush(heap, (x, p, e))
        return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        each = [self.merge(w) if len(w) < 200 else [self.ranks[w]] if w in self.ranks else self.merge_long(w) for w in words]
        return np.array([i for x in each for i in x], np.uint32), np.array([len(x) for x in each], np.int64)

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts (UTF-8, as by as_bytes), and the offsets of the texts in them."""
        data = buf.tobytes()
        lead = np.flatnonzero((buf & 0xC0) != 0x80)
        points = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
        starts = lead[token_starts(points, np.searchsorted(lead, off))] if len(points) else lead
        ends = np.append(starts[1:], len(buf))
        ids, size = self.words.look_up(buf, starts, ends)
        return ids, np.concatenate([[0], np.cumsum(size)])[np.searchsorted(starts, off)]

    def decode(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids, and the offsets of the texts (off: in ids) in them."""
        size = self.size[ids]
        return _gather(self.bytes, self.start[ids], size), np.concatenate([[0], np.cumsum(size)])[off]

    def token_offsets(self, ids: np.ndarray) -> np.ndarray:
        """Where each id's bytes begin in the decoded bytes, and their end."""
        return np.concatenate([[0], np.cumsum(self.size[ids])])


_loaded: dict[str, Bpe] = kept("ranks")


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 per document.

    Null texts count as empty, which have no ids; repeated rows give a row each; null doc_ids stay; an empty table
    gives no rows; other columns are not read; texts of any length are read whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.tiktoken")
        bpe = _loaded.get(path) or _loaded.setdefault(path, Bpe.load(path))
        sha = lambda x, o: [hashlib.sha256(x[a:b]).hexdigest() for a, b in zip(o[:-1].tolist(), o[1:].tolist(), strict=True)]
        for b in batches:
            buf, off = as_bytes(b.column("text"))
            for i, j in slices(off):
                ids, at = bpe.encode(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                back, back_at = bpe.decode(ids, at)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i).cast(pa.int64()), pa.array(np.diff(at)), pa.array(sha(ids.astype("<u4").tobytes(), 4 * at)), pa.array(sha(back.tobytes(), back_at))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(trimmed(run, "ranks"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_bpe_round_trip(spark, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded."""
    return round_trip(documents(spark, sf_dir))
