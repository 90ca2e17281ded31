"""Quality rules by repetition coverage: the share of a text's characters inside repeated n-grams and lines.

Texts are handled many at a time as one byte buffer: words and lines are slices, a prefix sum gives the hash
of each, rolling over the words' hashes gives those of n-grams, and a sort finds what repeats in a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidegraph.llm.common import as_bytes, documents, mixed, Rolling, slices, trimmed

#: The largest share of word characters that repeated n-grams of so many words may cover, and repeated lines.
NGRAM_LIMITS = {5: 0.25, 6: 0.24, 7: 0.23, 8: 0.22, 9: 0.21, 10: 0.20}
LINE_LIMIT = 0.30

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LEAD = (np.arange(256) & 0xC0) != 0x80
_BASE = np.uint64(0xD6E8FEB86659FD93)
_DOC = np.uint64(0x9E3779B97F4A7C15)
_roll = Rolling()


class Texts:
    """Words and lines of some texts; buf and off as by as_bytes."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.buf, self.off, self.n = buf, off, len(off) - 1
        size = len(buf)
        edge = np.zeros(size + 1, bool)
        edge[off] = True
        word = np.zeros(size + 1, bool)
        word[:size] = ~_SPACE[buf]
        before = np.zeros(size + 1, bool)
        before[1:] = word[:size]
        before[edge] = False
        self.start = np.flatnonzero(word & ~before)
        after = np.zeros(size, bool)
        after[:] = word[1:]
        after[edge[1:]] = False
        self.end = np.flatnonzero(word[:size] & ~after) + 1
        self.doc = np.searchsorted(off, self.start, "right") - 1
        self.n_words = np.bincount(self.doc, minlength=self.n)
        self.lead = np.concatenate([[0], np.cumsum(_LEAD[buf])])
        self.chars = self.lead[self.end] - self.lead[self.start]
        self.prefix = _roll.prefix(buf)
        self.hash = _roll.of(self.prefix, self.start, self.end)

    def per_doc(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each text the mask marks."""
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[self.off[1:]] - total[self.off[:-1]]

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text of the lines that have a word."""
        breaks = np.flatnonzero(self.buf == 10)
        start = np.unique(np.concatenate([self.off[:-1][np.diff(self.off) > 0], breaks + 1]))
        start = start[start < len(self.buf)]
        end = np.minimum(np.append(breaks, len(self.buf))[np.searchsorted(breaks, start)], self.off[np.searchsorted(self.off, start, "right")])
        has = np.searchsorted(self.start, end) > np.searchsorted(self.start, start)
        start, end = start[has], end[has]
        return start, end, np.searchsorted(self.off, start, "right") - 1

    def covered(self, n: int) -> np.ndarray:
        """Marks the words inside windows of n words that are found twice or more in their text, the first included."""
        w = len(self.start)
        out = np.zeros(w, bool)
        if w < n:
            return out
        gram = self.hash[: w - n + 1].copy()
        for k in range(1, n):
            gram = gram * _BASE + self.hash[k : w - n + 1 + k]
        inside = np.flatnonzero(self.doc[: w - n + 1] == self.doc[n - 1 :])
        again, _ = repeated(mixed(gram[inside]) + self.doc[inside].astype(np.uint64) * _DOC)
        step = np.zeros(w + 1, np.int32)
        at = inside[again]
        np.add.at(step, at, 1)
        np.add.at(step, at + n, -1)
        return np.cumsum(step[:w]) > 0


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks keys found twice or more; marks those that equal an earlier one."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    any_, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:][same]] = True
    any_[order[1:][same]] = True
    any_[order[:-1][same]] = True
    return any_, later


def measures(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """Base counts, and the characters covered by repeated n-grams (cover_n) and lines (cover_lines)."""
    t = Texts(buf, off)
    sums = lambda mask, of: np.bincount(t.doc[mask], of[mask], minlength=t.n).astype(np.int64)
    out = {"n_words": t.n_words, "word_chars": np.bincount(t.doc, t.chars, minlength=t.n).astype(np.int64), "n_symbols": t.per_doc(_SYMBOL[buf])}
    start, end, doc = t.lines()
    both, later = repeated(_roll.of(t.prefix, start, end) + doc.astype(np.uint64) * _DOC)
    out["n_dup_lines"] = np.bincount(doc[later], minlength=t.n)
    in_line = np.concatenate([[0], np.cumsum(t.chars)])
    chars = in_line[np.searchsorted(t.start, end)] - in_line[np.searchsorted(t.start, start)]
    out["cover_lines"] = np.bincount(doc[both], chars[both], minlength=t.n).astype(np.int64)
    three = t.covered(3)
    out["n_repeat_words"] = sums(three, np.ones(len(t.doc)))
    for n in NGRAM_LIMITS:
        out[f"cover_{n}"] = sums(t.covered(n), t.chars)
    out["base_failed"] = (out["n_words"] < 50) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
    whole = np.maximum(out["word_chars"], 1)
    bad = out["cover_lines"] > LINE_LIMIT * whole
    for n, most in NGRAM_LIMITS.items():
        bad |= out[f"cover_{n}"] > most * whole
    out["kept"] = ~(out["base_failed"] | bad)
    return out


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", base_failed boolean, kept boolean, cover_lines long, " + ", ".join(f"cover_{n} long" for n in NGRAM_LIMITS)


def repetition(docs: DataFrame) -> DataFrame:
    """One row per document: base counts, verdicts, and covered characters.

    Null and empty texts have zero counts and fail the base rule; null doc_ids stay null; repeated rows give
    a row each; an empty table gives none; other columns are not read. Texts of any length are read whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = as_bytes(b.column("text"))
            for i, j in slices(off):
                m = measures(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                cols = {"doc_id": b.column("doc_id").slice(i, j - i).cast(pa.int64())}
                cols |= {c: pa.array(m[c].astype(np.int64)) for c in _COUNTS}
                cols |= {c: pa.array(m[c]) for c in ("base_failed", "kept")}
                cols |= {c: pa.array(m[c].astype(np.int64)) for c in ("cover_lines", *(f"cover_{n}" for n in NGRAM_LIMITS))}
                yield pa.RecordBatch.from_pydict(cols)

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), _SCHEMA)


def op2_repetition_coverage(spark, sf_dir: str) -> DataFrame:
    """Repetition coverage of all documents."""
    return repetition(documents(spark, sf_dir))
