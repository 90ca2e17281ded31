"""Token ids of many texts by the tokenizers library, with the ids of words that recur kept.

Texts are cut before a space, and around a line break, that stands between two characters that are not white
space, and between an ASCII letter and an ASCII sign other than the apostrophe. No token of the byte-level
pre-tokenizer reaches over such a place, so the ids of the parts, joined, are those of the text.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np

from tidegraph.llm.common import kept

#: Words kept by one worker; at more, those that were met only once go.
MOST_WORDS = 500_000

_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_SIGN = np.zeros(256, bool)
_SIGN[[i for i in range(0x21, 0x7F) if not chr(i).isalnum() and i != 0x27]] = True
# first bytes of the white space beyond ASCII; last but one bytes of it
_FIRST = np.zeros(256, bool)
_FIRST[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_LAST_BUT_ONE = np.zeros(256, bool)
_LAST_BUT_ONE[[0xC2, 0x9A, 0xA0, 0x80, 0x81]] = True


def safe_cuts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Places where some texts (as by as_bytes) may be cut, the beginnings of texts included."""
    n = len(buf)
    cut = np.zeros(n + 2, bool)
    edge = np.zeros(n + 2, bool)
    edge[off] = True
    cut[1:n] = _SIGN[buf[1:]] & _LETTER[buf[:-1]]
    at = np.flatnonzero((buf == 0x20) | (buf == 0x0A))
    at = at[(at >= 1) & (at + 1 < n)]
    prev, after = buf[at - 1], buf[at + 1]
    ok = ~_ASCII_SPACE[prev] & ~_ASCII_SPACE[after] & ~_FIRST[after]
    ok &= ~((prev >= 0x80) & _LAST_BUT_ONE[buf[np.maximum(at - 2, 0)]])
    ok &= ~edge[at + 1] & ~edge[at]  # white space at either end of its text
    at = at[ok]
    cut[at] = True
    cut[at[buf[at] == 0x0A] + 1] = True
    cut[off] = True
    return np.flatnonzero(cut[: n + 1])


class _Grown:
    """An array that takes values at its end."""

    def __init__(self, dtype):
        self.all, self.n = np.zeros(1024, dtype), 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.all):
            self.all = np.concatenate([self.all[: self.n], np.zeros(self.n + len(values), self.all.dtype)])
        self.all[self.n : self.n + len(values)] = values
        self.n += len(values)


_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_SLOT_BITS = 20
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)


class Words:
    """Ids of words, by a function from a list of new words to all their ids in order and how many each has.

    Words of up to 16 bytes are first sought, all at once, in a table of slots that holds their bytes as two
    numbers; what is not there goes through a dictionary.
    """

    def __init__(self, encode):
        self.encode = encode
        self._empty()

    def _empty(self) -> None:
        self.index: dict[bytes, int] = {}
        self.start, self.size, self.ids, self.again = _Grown(np.int64), _Grown(np.int64), _Grown(np.uint32), _Grown(bool)
        self._clear_slots()

    def _clear_slots(self) -> None:
        self.low, self.high, self.at = np.zeros(1 << _SLOT_BITS, np.uint64), np.zeros(1 << _SLOT_BITS, np.uint64), np.zeros(1 << _SLOT_BITS, np.int32)

    def _add(self, words: list[bytes]) -> None:
        ids, size = self.encode(words)
        k = len(self.index)
        self.index.update(zip(words, range(k, k + len(words)), strict=True))
        self.start.add(self.ids.n + np.cumsum(size) - size)
        self.size.add(size)
        self.ids.add(ids)
        self.again.add(np.zeros(len(words), bool))

    def _shrink(self) -> None:
        keep = np.flatnonzero(self.again.all[: self.again.n])
        if len(keep) > MOST_WORDS * 3 // 4:
            keep = keep[len(keep) // 2 :]  # the later half
        names = list(self.index)  # in the order of their numbers
        size, ids = self.size.all[keep], _gather(self.ids.all, self.start.all[keep], self.size.all[keep])
        self._empty()
        self.index = {names[i]: n for n, i in enumerate(keep.tolist())}
        self.start.add(np.cumsum(size) - size)
        self.size.add(size)
        self.ids.add(ids)
        self.again.add(np.zeros(len(keep), bool))

    def _numbers(self, parts: list[bytes]) -> np.ndarray:
        k = np.fromiter(map(self.index.get, parts, repeat(-1)), np.int64, len(parts))
        new = k < 0
        self.again.all[k[~new]] = True
        if new.any():
            missing = [parts[i] for i in np.flatnonzero(new)]
            self._add(list(dict.fromkeys(missing)))
            k[new] = np.fromiter(map(self.index.__getitem__, missing), np.int64, len(missing))
        return k

    def look_up(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the slices of buf, in order, and how many each slice has."""
        if len(self.index) > MOST_WORDS:
            self._shrink()
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        n = end - start
        padded = np.concatenate([buf, np.zeros(24, np.uint8)])
        eight = np.ndarray((len(buf) + 16,), "<u8", padded.data, strides=(1,))
        low, high = eight[start] & _MASK[np.minimum(n, 8)], eight[start + np.minimum(n, 8)] & _MASK[np.clip(n - 8, 0, 8)]
        slot = (((low * _ODD[0]) ^ (high * _ODD[1])) * _ODD[2] >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        short = n <= 16
        if (buf == 0).any():  # then the numbers don't tell a word's length
            short[:] = False
        hit = short & (self.low[slot] == low) & (self.high[slot] == high)
        k = self.at[slot].astype(np.int64)
        self.again.all[k[hit]] = True
        rest = np.flatnonzero(~hit)
        if len(rest):
            data = buf.tobytes()
            k[rest] = self._numbers([data[a:b] for a, b in zip(start[rest].tolist(), end[rest].tolist(), strict=True)])
            rest = rest[short[rest]]
            where = slot[rest]
            self.at[where] = k[rest]
            # of words that share a slot, the same one in all three arrays
            last = self.at[where] == k[rest]
            self.low[where[last]], self.high[where[last]] = low[rest][last], high[rest][last]
        size = self.size.all[k]
        return _gather(self.ids.all, self.start.all[k], size), size


def _gather(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices of values back to back."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.arange(total) + np.repeat(start - (ends - size), size)]


_encoders: dict[str, Words] = kept("words")


def encoder(path: str) -> Words:
    """One for each worker process and file."""
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        spaced = np.zeros(tokenizer.get_vocab_size(), bool)  # ids whose token begins with a space
        spaced[[i for t, i in tokenizer.get_vocab().items() if t[0] == "\u0120"]] = True
        _encoders[path] = Words(lambda words: _ids_of(tokenizer, spaced, words))
    return _encoders[path]


def _spaced(words: list[bytes]) -> np.ndarray:
    """Which words are one space and then characters, without white space at either end or another space among them."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    buf = np.frombuffer(b"".join(words), np.uint8)
    start = np.cumsum(size) - size
    second, last = buf[np.minimum(start + 1, len(buf) - 1)], buf[start + size - 1]
    plain = (size > 1) & (buf[start] == 0x20) & (np.add.reduceat((buf == 0x20).astype(np.int32), start) == 1) & ~_ASCII_SPACE[second] & ~_ASCII_SPACE[last]
    for i in np.flatnonzero(plain & ((second >= 0x80) | (last >= 0x80))).tolist():  # white space beyond ASCII
        w = words[i].decode()
        plain[i] = not w[1].isspace() and not w[-1].isspace()
    return plain


def _ids_of(tokenizer, spaced: np.ndarray, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All ids in order, and how many each word has.

    Words with one space, their first character, go through many as one text: a token that begins with a space
    begins a word there.
    """
    text = [w.decode() for w in words]
    plain = _spaced(words)
    size = np.zeros(len(text), np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    together = np.flatnonzero(plain)
    groups = [together[a : a + 200] for a in range(0, len(together), 200)]
    for some, got in zip(groups, tokenizer.encode_batch_fast(["".join([text[i] for i in some]) for some in groups], add_special_tokens=False), strict=True):
        ids = np.array(got.ids, np.uint32)
        first = np.flatnonzero(spaced[ids])
        if len(first) != len(some) or first[0] != 0:
            plain[some] = False
            continue
        size[some] = np.diff(np.append(first, len(ids)))
        found.append((some, ids))
    alone = np.flatnonzero(~plain)
    if len(alone):
        each = [x.ids for x in tokenizer.encode_batch_fast([text[i] for i in alone], add_special_tokens=False)]
        size[alone] = [len(x) for x in each]
        found.append((alone, np.array([i for x in each for i in x], np.uint32)))
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint32)
    for which, ids in found:
        n = size[which]
        out[np.arange(len(ids)) + np.repeat(start[which] - (np.cumsum(n) - n), n)] = ids
    return out, size


def encode(path: str, buf: np.ndarray, off: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of some texts (as by as_bytes), each with end_id after it, and the offsets of the texts in them."""
    cuts = safe_cuts(buf, off)
    ids, size = encoder(path).look_up(buf, cuts[:-1], cuts[1:])
    before = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(cuts, off)]
    out = np.full(len(ids) + len(off) - 1, end_id, np.uint32)
    keep = np.ones(len(out), bool)
    keep[before[1:] + np.arange(len(off) - 1)] = False
    out[keep] = ids
    return out, before + np.arange(len(off))


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
