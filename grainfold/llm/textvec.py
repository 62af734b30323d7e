"""Texts as arrays: words, word runs and canonical hashes for a whole batch at once.

All functions work on the code points of many texts laid end to end. One lookup table
folds each code point to its lower-case letter or digit, or to 0 (skipped), so canonical
strings are never built.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np

_U = np.uint64
_GOLD, _M1, _M2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
#: Odd bases of the rolling polynomial hashes, modulo 2^64.
BASES = (_U(0x9E3779B97F4A7C15 | 1), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9))
#: Texts are worked on in slices of about so many characters; a longer text is a slice of its own.
SLICE = 200_000

_fold_table: np.ndarray | None = None


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _M1
        x = (x ^ (x >> _U(27))) * _M2
        return x ^ (x >> _U(31))


def fold_table() -> np.ndarray:
    """Code point -> lower-case code point if it is a letter or digit, else 0."""
    global _fold_table
    if _fold_table is None:
        t = np.zeros(0x110000, dtype=np.uint32)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalnum():
                low = c.lower()
                t[cp] = ord(low[0])
        _fold_table = t
    return _fold_table


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    out = np.empty(max(n, 1), dtype=np.uint64)
    out[0] = 1
    size = 1
    with np.errstate(over="ignore"):
        step = base
        while size < n:
            take = min(size, n - size)
            out[size : size + take] = out[:take] * step
            size += take
            step = step * step
    return out


def slices(texts: Sequence[str]) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about SLICE characters."""
    a, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > SLICE:
            yield a, i
            a, size = i, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)


class Batch:
    """The folded code points of some texts, and the text each belongs to."""

    def __init__(self, texts: Sequence[str]):
        self.n = len(texts)
        self.lengths = np.fromiter(map(len, texts), dtype=np.int64, count=self.n)
        self.starts = np.zeros(self.n + 1, dtype=np.int64)
        np.cumsum(self.lengths, out=self.starts[1:])
        raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.codes = fold_table()[raw]

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each word, number of words of each text). A word is a run of letters and digits."""
        kept = self.codes != 0
        first = kept.copy()
        first[1:] &= ~kept[:-1]
        heads = self.starts[:-1][self.lengths > 0]
        first[heads] = kept[heads]
        at = np.flatnonzero(first)
        counts = np.diff(np.searchsorted(at, self.starts))
        if not len(at):
            return np.zeros(0, dtype=np.uint64), counts
        idx = np.flatnonzero(kept)
        begin = np.repeat(at, np.diff(np.searchsorted(idx, np.append(at, len(self.codes)))))
        place = idx - begin
        with np.errstate(over="ignore"):
            value = mix(self.codes[idx].astype(np.uint64) * _GOLD) * powers(BASES[0], int(place.max()) + 1)[place]
            return mix(np.add.reduceat(value, np.searchsorted(idx, at))), counts

    def canonical(self, parts: dict[int, list[int]] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, second hash, kept characters) of each text without blanks, case and punctuation.

        Two independent rolling polynomials over the kept characters. parts: for labelled
        texts the offsets at which parts begin; the hashes of the parts are added, so
        their order does not count. The first part reaches back to the text's begin.
        """
        cuts = self.starts[:-1]
        if parts:
            extra = [self.starts[i] + p for i, ps in parts.items() for p in ps[1:]]
            cuts = np.unique(np.concatenate([cuts, np.array(extra, dtype=np.int64)]))
        owner = np.searchsorted(self.starts[1:], cuts, side="right")
        idx = np.flatnonzero(self.codes)
        bounds = np.searchsorted(idx, cuts)
        sizes = np.diff(np.append(bounds, len(idx)))
        full = sizes > 0
        h1, h2 = np.zeros(self.n, dtype=np.uint64), np.zeros(self.n, dtype=np.uint64)
        kept = np.zeros(self.n, dtype=np.int64)
        if len(idx):
            place = np.arange(len(idx)) - np.repeat(bounds[full], sizes[full])
            with np.errstate(over="ignore"):
                v = mix(self.codes[idx].astype(np.uint64) * _GOLD)
                top = int(place.max()) + 1
                for h, base in ((h1, BASES[1]), (h2, BASES[2])):
                    part = mix(np.add.reduceat(v * powers(base, top)[place], bounds[full]) + sizes[full].astype(np.uint64))
                    np.add.at(h, owner[full], part)
            np.add.at(kept, owner[full], sizes[full])
        return mix(h1), mix(h2 + _GOLD), kept


_LABEL = re.compile(r"(?:^|[;|\n])(?:(?![;|\n])[\W_])*([^\W_]+)(?:(?![;|\n])[\W_])*:")
_WORDCHAR = re.compile(r"[^\W_]")


def label_starts(text: str) -> list[int] | None:
    """Where the parts of a labelled text (`Label: words`, two parts or more) begin, else None.

    A label is one word followed by a colon, at the begin of the text or after ; | or a
    line end. A text whose first word is no label is not labelled.
    """
    if text.count(":") < 2:
        return None
    at = [m.start(1) for m in _LABEL.finditer(text)]
    if len(at) < 2 or _WORDCHAR.search(text, 0, at[0]):
        return None
    return at


def word_runs(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of k successive words, number of runs of each text)."""
    runs = np.maximum(counts - k + 1, 0)
    if len(words) < k:
        return np.zeros(0, dtype=np.uint64), runs
    n = len(words) - k + 1
    h = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = h * BASES[1] + words[j : j + n]
    ends = np.cumsum(counts)
    begins = ends - counts
    keep = np.arange(n) + k <= np.repeat(ends, counts)[:n]
    del begins
    return mix(h[keep]), runs


def sequence_hash(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One hash of each text's whole sequence of words; 0 for a text without words."""
    out = np.zeros(len(counts), dtype=np.uint64)
    full = counts > 0
    if len(words):
        begins = (np.cumsum(counts) - counts)[full]
        place = np.arange(len(words)) - np.repeat(begins, counts[full])
        with np.errstate(over="ignore"):
            out[full] = mix(np.add.reduceat(words * powers(BASES[2], int(place.max()) + 1)[place], begins) + counts[full].astype(np.uint64))
    return out
