"""Several values packed in one field: one row per value, in field order.

A multi-pattern automaton marks every place where a whole known value stands; dynamic
programming then picks the cover of the field that explains most of it, so that a
delimiter inside a known or quoted value does not separate.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import islice

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that separate, open and close.
DELIMITERS = ",;|/&\n\t\r·•，；、"
QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’", "«": "»", "„": "“", "`": "`"}
BRACKETS = {"[": "]", "(": ")", "{": "}"}
_OPEN = set(QUOTES) | set(BRACKETS)
_CLOSE = set(QUOTES.values()) | set(BRACKETS.values())
_DELIM = set(DELIMITERS)

# Gain per character and cost per value: a known name outweighs a quoted span, which
# outweighs free text; fewer values win among equals.
_KNOWN, _QUOTED, _FREE, _PER_VALUE = 8.0, 4.0, 1.0, 1.5


class Segmenter:
    """Splits one field. `names` are the known whole values, compared in any case; `more` are
    spans of further known values, found with other parts of the dictionary."""

    def __init__(self, names: Iterable[str]):
        self.names = tuple(sorted({n.strip().lower() for n in names if n and n.strip()}))
        self._known, self._auto = frozenset(self.names), None
        if self.names:
            self._auto = ahocorasick.Automaton()
            for n in self.names:
                self._auto.add_word(n, len(n))
            self._auto.make_automaton()
        self.split = lru_cache(maxsize=50_000)(self._split)

    def __reduce__(self):
        return Segmenter, (self.names,)

    @staticmethod
    def _fold(s: str) -> str:
        low = s.lower()
        return low if len(low) == len(s) else "".join(c.lower() if len(c.lower()) == 1 else c for c in s)

    def spans(self, field: str) -> list[tuple[int, int]]:
        """[begin, end) of every place where a known value stands."""
        return [(end + 1 - size, end + 1) for end, size in self._auto.iter(self._fold(field))] if self._auto else []

    def _split(self, field: str, more: tuple[tuple[int, int], ...] = ()) -> tuple[str, ...]:
        n = len(field)
        known: dict[int, list[int]] = {}
        whole = set(more)
        for i, j in (*self.spans(field), *more):
            known.setdefault(i, []).append(j)

        # next_delim[i]: the first delimiter at or after i. after[i]: where a value that ends
        # at i leaves off, past blanks and closing marks; -1 if other text follows first.
        next_delim, after = [n] * (n + 1), [n] * (n + 1)
        for i in range(n - 1, -1, -1):
            c = field[i]
            next_delim[i] = i if c in _DELIM else next_delim[i + 1]
            after[i] = i if c in _DELIM else after[i + 1] if c.isspace() or c in _CLOSE else -1
        # best[i]: (score, next position, value span or None) where a value may start at i.
        best: list[tuple[float, int, tuple[int, int] | None]] = [(0.0, n, None)] * (n + 1)
        # closing: each closing quote's nearest place behind i where a value can end.
        closing: dict[str, int] = {}
        for i in range(n - 1, -1, -1):
            c = field[i]
            skip = c in _DELIM or c.isspace() or c in BRACKETS or c in _CLOSE and c not in QUOTES
            options = [(best[i + 1][0] - (_FREE if c in QUOTES else 0.0), i + 1, None)] if skip or c in QUOTES else []
            for j in known.get(i, ()):
                if after[j] >= 0:
                    options.append((_KNOWN * (j - i) - _PER_VALUE + best[after[j]][0], after[j], (i, j)))
            if c in QUOTES:
                j = closing.get(QUOTES[c], -1)
                if j != -1:
                    options.append((_QUOTED * (j - i - 1) - _PER_VALUE + best[after[j + 1]][0], after[j + 1], (i + 1, j)))
            elif not skip:
                j = next_delim[i]
                options.append((_FREE * (j - i) - _PER_VALUE + best[j][0], j, (i, j)))
            best[i] = max(options, key=lambda o: o[0])
            if c in _CLOSE and after[i + 1] >= 0:
                closing[c] = i
        out, i = [], 0
        while i < n:
            _, j, span = best[i]
            if span:
                v = field[span[0] : span[1]] if span in whole else self._bare(field[span[0] : span[1]])
                if v:
                    out.append(v)
            i = j
        return tuple(out)

    def _bare(self, v: str) -> str:
        """Without surrounding blanks, quotes and brackets; brackets that belong to a known name stay."""
        while True:
            v = v.strip()
            if v.lower() in self._known:
                return v
            if v and (v[0] in _OPEN or v[0] in _CLOSE):
                v = v[1:]
            elif v and (v[-1] in _CLOSE or v[-1] in _OPEN):
                v = v[:-1]
            else:
                return v


#: Names of the dictionary that one automaton holds.
BLOCK = 50_000


def explode_packed(df: DataFrame, field: Column, names: Iterable[str], keep: Sequence[Column], value: str = "value", pos: str = "pos", block: int = BLOCK) -> DataFrame:
    """One row per value: the columns of `keep`, then `pos` (int, from 1) and `value`.

    Null, blank and delimiter-only fields give no rows; repeated values each keep their
    place; a field without any delimiter is one value. Case is kept as written. The names
    are shipped with the function, `block` of them at a time: a larger dictionary is
    searched block after block, with the same result.
    """
    parts, every = [], iter(names)
    while own := list(islice(every, block)):
        parts.append(Segmenter(own))
    cut, others = (parts or [Segmenter(())])[0], parts[1:]

    def finder(s: Segmenter):
        @F.pandas_udf(T.ArrayType(T.IntegerType()))
        def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for b in batches:
                yield b.map(lambda x: [i for span in s.spans(x) for i in span])

        return find

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda x: list(cut.split(x)))

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split_with(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([list(cut.split(x, tuple(zip(y[::2], y[1::2])))) for x, y in zip(a, b)])

    rows = df.where(field.isNotNull()).select(*keep, field.alias("__field"))
    names_kept = rows.columns[:-1]
    values = split_with("__field", F.concat(*[finder(s)("__field") for s in others])) if others else split("__field")
    out = rows.select(*names_kept, values.alias("__values")).select(*names_kept, F.posexplode("__values").alias("__pos", "__value"))
    return out.select(*names_kept, (F.col("__pos") + 1).cast("int").alias(pos), F.col("__value").alias(value))
