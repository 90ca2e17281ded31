"""Personal data by candidate gradient boosting.

Generators with high recall propose spans, which may overlap; boosted trees judge each by its format and its
context; thresholds calibrated for each kind on rows that the trees have not seen select what counts. Spans of
the base patterns always stay. The trees learn from texts made here by a seeded generator, in which the true
spans are known; nothing is learnt from the corpus.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidegraph.llm.common import as_bytes, documents, slices, trimmed

#: In the order in which spans are listed; the first four have base patterns.
KINDS = ("email", "ip", "card", "phone", "secret", "national_id", "iban")
#: What the calibrated thresholds reach on held-out candidates, at least.
PRECISION = 0.98

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a match that fails at a run's first digit fails at its others
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _octet(digits: str) -> bool:
    return len(digits) < 4 and int(digits or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """Spans of the four base patterns: by kind, leftmost and without overlap; a match that fails its test is dropped."""
    out: list[Span] = []
    pos, at = 0, text.find("@")
    while at >= 0:
        before = text[pos:at]
        start = pos + len(before.rstrip(_LOCAL))
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            pos = m.end()
        else:
            pos = at + 1
        at = text.find("@", pos)
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(_octet(p.lstrip("0")) for p in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


_SAID = r"(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key|auth)"
_GENERATORS: tuple[tuple[str, str, re.Pattern], ...] = (
    ("email", "email", re.compile(r"[A-Za-z0-9._%+-]{1,64}(?: ?(?:\[at\]|\(at\)|\{at\}) ?|@)[A-Za-z0-9-]{1,63}(?:(?:\.| ?(?:\[dot\]|\(dot\)) ?)[A-Za-z0-9-]{1,63}){1,5}")),
    ("phone", "digits", re.compile(r"(?<![\w.+-])\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![\w])")),
    ("card", "digits", re.compile(r"(?<![\w])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![\w])")),
    ("national_id", "digits", re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")),
    ("iban", "digits", re.compile(r"(?<![\w])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\w])")),
    ("secret", "said", re.compile(rf"(?i:{_SAID})[\"']?\s{{0,3}}[:=]\s{{0,3}}[\"']?([^\s\"',;]{{4,}}+)")),
    ("secret", "digits", re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{12,}+")),
)
_CONTEXT = (
    re.compile(r"(?i)mail|contact|write"), re.compile(r"(?i)phone|tel\b|call|mobile|fax"), re.compile(r"(?i)card|visa|credit|pay"), re.compile(rf"(?i){_SAID}|credential|login"),
    re.compile(r"(?i)ssn|social|national|passport"), re.compile(r"(?i)iban|bank|account"), re.compile(r"(?i)order|isbn|invoice|version|part|item|commit|build|ref|no\.|number|page|date|year"), re.compile(r"[#$€£]\s?$"),
)


def candidates(text: str) -> list[tuple[Span, int]]:
    """Spans that the generators propose, with the generator's number."""
    out = []
    has_digit = re.search("[0-9]", text) is not None
    for g, (kind, needs, pattern) in enumerate(_GENERATORS):
        if (needs == "digits" and not has_digit) or (needs == "email" and "@" not in text and "at" not in text):
            continue
        for m in pattern.finditer(text):
            a, b = m.span(1) if m.re.groups else m.span()
            if needs != "digits" or re.search("[0-9]", m[0]):
                out.append(((kind, a, b), g))
    return out


def describe(text: str, span: Span, generator: int) -> list[float]:
    """Format and context of a candidate as numbers."""
    kind, a, b = span
    s, left, right = text[a:b], text[max(0, a - 32) : a], text[b : b + 8]
    d = _digits(s)
    n = len(s)
    count = Counter(s)
    groups = re.findall("[0-9]+", s)
    return [
        float(generator), KINDS.index(kind), n, len(d), len(d) / n, sum(c.isupper() for c in s) / n, sum(c.islower() for c in s) / n,
        -sum(v / n * np.log2(v / n) for v in count.values()), len(groups), max(map(len, groups), default=0), len(groups[-1]) if groups else 0,
        float(13 <= len(d) <= 19 and luhn(d)), s.count("-"), s.count("."), s.count(" "), float("(" in s), s.count("/"), sum(x.isdigit() != y.isdigit() for x, y in zip(s, s[1:], strict=False)) / n,
        float(d.startswith("555") or "555" in groups), float(s.startswith("AKIA")), float(re.fullmatch(r"[0-9a-f]+", s) is not None), float(re.fullmatch(r"(?:19|20)[0-9]{2}[-.]?[01][0-9].*", s) is not None),
        float(left[-1:].isalnum()), float(right[:1].isalnum()), float(left[-1:] in "\"'="), *[float(p.search(left) is not None) for p in _CONTEXT],
    ]


_WORDS = "the of and river under stone morning letter garden window paper bridge quiet later found small people house water number report table market winter".split()


def _example(rng: random.Random) -> tuple[str, set[Span]]:
    """A made text and its true spans."""
    dig = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    alnum = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    name = lambda: "".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(3, 9)))

    def card() -> str:
        x = rng.choice("345") + dig(14)
        return x + next(c for c in "0123456789" if luhn(x + c))

    four = lambda x, sep: sep.join(x[i : i + 4] for i in range(0, len(x), 4))
    sep = rng.choice([" ", "-"])
    true = [
        ("email", lambda: f"{name()}.{dig(2)}@{name()}.example.com"), ("email", lambda: f"{name()} [at] {name()} [dot] com"), ("email", lambda: f"{name()}(at){name()}.org"), ("email", lambda: f"{name()}@{name()}.net"),
        ("phone", lambda: f"({dig(3)}) 555-{dig(4)}"), ("phone", lambda: f"{dig(3)}-555-{dig(4)}"), ("phone", lambda: f"0{dig(2)} {dig(4)} {dig(4)}"), ("phone", lambda: f"{dig(3)}.{dig(3)}.{dig(4)}"),
        ("card", lambda: four(card(), sep)), ("card", card), ("national_id", lambda: f"{dig(3)}-{dig(2)}-{dig(4)}"), ("iban", lambda: rng.choice(["DE", "FR", "GB", "ES"]) + four(dig(2) + dig(18), rng.choice(["", " "]))),
        ("secret", lambda: "AKIA" + alnum(16).upper()), ("secret", lambda: hexa(rng.choice([18, 24, 32, 40]))), ("secret", lambda: alnum(rng.randint(10, 40))),
        ("secret", lambda: alnum(rng.randint(200, 900))),
    ]
    lead = {"email": ["mail", "contact", "", ""], "phone": ["phone", "call", "tel", "", ""], "card": ["card", "visa", "", ""], "national_id": ["ssn", "", ""], "iban": ["iban", "account", ""], "secret": ["password=", "token = ", "secret: ", "api_key="]}
    false = [
        lambda: f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", lambda: f"{rng.randint(1, 31)}.{rng.randint(1, 12)}.{rng.randint(1900, 2030)}", lambda: f"version {rng.randint(0, 9)}.{rng.randint(0, 30)}.{rng.randint(0, 99)}",
        lambda: f"${dig(3)},{dig(3)}.{dig(2)}", lambda: f"order {dig(rng.randint(6, 16))}", lambda: f"isbn 978-{dig(1)}-{dig(4)}-{dig(4)}-{dig(1)}", lambda: f"commit {hexa(40)}", lambda: f"pages {dig(3)}-{dig(3)}", lambda: f"{rng.randint(1990, 2029)}-{rng.randint(1990, 2029)}",
        lambda: f"part {alnum(4).upper()}-{dig(4)}-{dig(2)}", lambda: dig(rng.randint(4, 12)), lambda: f"{name()}-{name()}-{dig(2)}", lambda: f"{dig(2)}/{dig(2)}/{name()}", lambda: f"item{dig(8)}_{name()}", lambda: "#" + hexa(6), lambda: f"{dig(4)} {dig(4)}",
        lambda: f"ref {dig(3)} {dig(3)} {dig(2)}", lambda: "-".join(name() for _ in range(4)) + dig(1), lambda: f"{rng.randint(1990, 2029)}{rng.randint(1, 12):02}{rng.randint(1, 28):02}{dig(6)}", lambda: f"{dig(2)}:{dig(2)}:{dig(2)}.{dig(3)}", lambda: f"build {dig(14)}", lambda: f"{name()}/{name()}/{dig(4)}/{name()}",
    ]
    text, spans = "", set()
    for _ in range(rng.randint(2, 6)):
        text += " ".join(rng.choice(_WORDS) for _ in range(rng.randint(3, 9))) + " "
        if rng.random() < 0.5:
            kind, make = rng.choice(true)
            value = make()
            before = rng.choice(lead[kind])
            if kind == "secret" and value.startswith("AKIA"):
                before = rng.choice(["", "", "key "])
            quote = rng.choice(["", '"']) if kind == "secret" and before else ""
            text += before + ("" if before[-1:] in "= " or not before else " ") + quote
            spans.add((kind, len(text), len(text) + len(value)))
            text += value + quote + rng.choice([" ", ". ", ", "])
        else:
            text += rng.choice(false)() + rng.choice([" ", ". "])
    return text, spans


class Trees:
    """Gradient boosting for the logistic loss, with regression trees over binned features."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32):
        self.rounds, self.depth, self.rate, self.bins = rounds, depth, rate, bins

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.cuts = [np.unique(np.quantile(c, np.arange(1, self.bins) / self.bins, method="lower")) for c in x.T]
        b = self._binned(x)
        self.bias = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        raw, self.trees = np.full(len(y), self.bias), []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            tree: list[tuple[int, int, int, int, float]] = []
            self._grow(b, y - p, np.maximum(p * (1 - p), 1e-6), np.arange(len(y)), self.depth, tree)
            self.trees.append(tree)
            raw += self._walk(b, tree)
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, k], "right") for k, c in enumerate(self.cuts)])

    def _grow(self, b, g, h, rows, depth, tree) -> int:
        me = len(tree)
        tree.append((-1, 0, 0, 0, float(self.rate * g[rows].sum() / (h[rows].sum() + 1.0))))
        if depth == 0 or len(rows) < 10:
            return me
        best = (1e-6, -1, 0)
        whole = g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
        for k in range(b.shape[1]):
            n = len(self.cuts[k]) + 1
            sg, sh = np.cumsum(np.bincount(b[rows, k], g[rows], n)), np.cumsum(np.bincount(b[rows, k], h[rows], n))
            gain = sg[:-1] ** 2 / (sh[:-1] + 1) + (sg[-1] - sg[:-1]) ** 2 / (sh[-1] - sh[:-1] + 1) - whole
            if len(gain) and gain.max() > best[0]:
                best = (float(gain.max()), k, int(gain.argmax()))
        if best[1] >= 0:
            left = b[rows, best[1]] <= best[2]
            if 0 < left.sum() < len(rows):
                lo = self._grow(b, g, h, rows[left], depth - 1, tree)
                hi = self._grow(b, g, h, rows[~left], depth - 1, tree)
                tree[me] = (best[1], best[2], lo, hi, 0.0)
        return me

    @staticmethod
    def _walk(b: np.ndarray, tree) -> np.ndarray:
        k, cut, lo, hi, value = (np.array(c) for c in zip(*tree, strict=True))
        at = np.zeros(len(b), np.int64)
        while (inner := k[at] >= 0).any():
            r = np.flatnonzero(inner)
            n = at[r]
            at[r] = np.where(b[r, k[n]] <= cut[n], lo[n], hi[n])
        return value[at]

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        raw = self.bias + sum(self._walk(b, t) for t in self.trees)
        return 1 / (1 + np.exp(-raw))


def _rows(examples: list[tuple[str, set[Span]]]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    x, y, kinds = [], [], []
    for text, spans in examples:
        for span, g in candidates(text):
            x.append(describe(text, span, g))
            y.append(float(span in spans))
            kinds.append(span[0])
    return np.array(x), np.array(y), kinds


@cache
def trained(n: int = 4000, seed: int = 11) -> tuple[Trees, dict[str, float]]:
    """Trees, and for each kind the least threshold that reaches PRECISION on made texts that they have not seen."""
    rng = random.Random(seed)
    made = [_example(rng) for _ in range(n)]
    x, y, _ = _rows(made[: n // 2])
    trees = Trees().fit(x, y)
    x, y, kinds = _rows(made[n // 2 :])
    p, of = trees.predict(x), np.array(kinds)
    limits = {}
    for kind in KINDS:
        own = of == kind
        order = np.argsort(-p[own], kind="stable")
        right = np.cumsum(y[own][order]) / np.arange(1, own.sum() + 1)
        good = np.flatnonzero(right >= PRECISION)
        limits[kind] = max(0.5, float(p[own][order][good[-1]])) if len(good) else 1.1
    return trees, limits


class Taken:
    """Spans that don't overlap, in order; asks and additions take the logarithm of their number."""

    def __init__(self, spans: list[Span] = ()):
        self.start: list[int] = []
        self.end: list[int] = []
        for _, s, e in sorted(spans, key=lambda x: x[1:]):
            if self.end and s <= self.end[-1]:
                self.end[-1] = max(self.end[-1], e)
            else:
                self.start.append(s)
                self.end.append(e)

    def meets(self, a: int, b: int) -> bool:
        k = bisect_left(self.start, b)  # spans before k start before b
        return k > 0 and self.end[k - 1] > a

    def add(self, a: int, b: int) -> None:
        k = bisect_left(self.start, a)
        self.start.insert(k, a)
        self.end.insert(k, b)


def added_spans(texts: list[str], base: list[list[Span]], trees: Trees, limits: dict[str, float]) -> list[list[Span]]:
    """Selected candidates, the likeliest first, that overlap no base span and no other selected one."""
    found = []
    for t, b in zip(texts, base, strict=True):
        taken = Taken(b)
        found.append([c for c in candidates(t) if not taken.meets(c[0][1], c[0][2])])
    flat = [describe(t, span, g) for t, cs in zip(texts, found, strict=True) for span, g in cs]
    p = trees.predict(np.array(flat)).tolist() if flat else []
    out, at = [], 0
    for cs in found:
        own, at = p[at : at + len(cs)], at + len(cs)
        kept, taken = [], Taken()
        for q, (kind, a, b) in sorted(zip(own, (c[0] for c in cs), strict=True), key=lambda x: (-x[0], x[1][1], x[1][2], KINDS.index(x[1][0]))):
            if q >= limits[kind] and not taken.meets(a, b):
                kept.append((kind, a, b))
                taken.add(a, b)
        out.append(kept)
    return out


def _written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def _find(buf: np.ndarray, off: np.ndarray, trees: Trees, limits: dict[str, float]) -> list[tuple[list[Span], list[Span]]]:
    """Base and added spans of each text; a text without digit, @ and = has none, nor can a generator match in it but for (at) and a colon after a key word."""
    hint = np.zeros(256, bool)
    hint[list(b"0123456789@=:([{")] = True
    total = np.concatenate([[0], np.cumsum(hint[buf])])
    some = np.flatnonzero(total[off[1:]] > total[off[:-1]])
    data = buf.tobytes()
    texts = [data[off[i] : off[i + 1]].decode() for i in some]
    base = [base_spans(t) for t in texts]
    out: list[tuple[list[Span], list[Span]]] = [([], [])] * (len(off) - 1)
    for i, b, a in zip(some.tolist(), base, added_spans(texts, base, trees, limits), strict=True):
        out[i] = (b, a)
    return out


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base spans, all spans, and n_added and n_spans, per document.

    n_added counts the spans that the trees added to the base, n_spans all.

    Null and empty texts have no spans; repeated rows give a row each; null doc_ids stay; an empty table gives no
    rows; other columns are not read; texts of any length are read whole.
    """
    trees, limits = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = as_bytes(b.column("text"))
            for i, j in slices(off):
                found = _find(buf[off[i] : off[j]], off[i : j + 1] - off[i], trees, limits)
                cols = {"doc_id": b.column("doc_id").slice(i, j - i).cast(pa.int64())}
                cols |= {f"n_{k}": pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS[:4]}
                cols["base_sha256"] = pa.array([hashlib.sha256(_written(base).encode()).hexdigest() for base, _ in found])
                cols["spans"] = pa.array([_written(base + more) for base, more in found])
                cols["n_added"] = pa.array([len(more) for _, more in found], pa.int64())
                cols["n_spans"] = pa.array([len(base) + len(more) for base, more in found], pa.int64())
                yield pa.RecordBatch.from_pydict(cols)

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long")


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span (overlapping ones as one) replaced by its kind in angle brackets.

    Null texts stay null, empty ones empty; all rows (repeated ones too) and columns stay; an empty table gives no rows.
    """
    trees, limits = trained()
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = as_bytes(b.column(at))
            texts: list[str | None] = []
            for i, j in slices(off):
                found = _find(buf[off[i] : off[j]], off[i : j + 1] - off[i], trees, limits)
                for k, (base, more) in enumerate(found):
                    text = buf[off[i + k] : off[i + k + 1]].tobytes().decode()
                    spans = sorted(base + more, key=lambda s: (s[1], -s[2]))
                    parts, done = [], 0
                    for kind, a, e in spans:
                        if a >= done:
                            parts += [text[done:a], f"<{kind}>"]
                        done = max(done, e)
                    texts.append("".join(parts) + text[done:])
            column = b.column(at)
            texts = [t if ok else None for t, ok in zip(texts, column.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, b.schema.field(at).type) if k == at else b.column(k) for k in range(b.num_columns)], schema=b.schema)

    return docs.mapInArrow(trimmed(run), docs.schema)


def op7_pii_boosting(spark, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return find_spans(documents(spark, sf_dir))
