"""Quantities recorded in different units, brought to common units.

`UnitGrammar` reads a unit string by dynamic programming over tries of prefixes, roots
and exponents. An ambiguous string ("pt": point or pint, "min": minute or milli-inch) is
decided by the weights of its parts plus a prior for the dimension the field measures.
`QuantityReader` reads whole fields (number, unit, link, scale; grades and star signs) with it
and `to_common_scale` applies it to a table, taking a missing scale from a running text
or from a lookup table.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from fractions import Fraction
from functools import lru_cache
from heapq import heappop, heappush
from math import isfinite, log

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Root:
    dimension: str
    factor: Fraction = Fraction(1)
    weight: float = 1.0


@dataclass(frozen=True)
class Unit:
    """A read unit: powers by dimension, factor to base units, log score."""

    powers: tuple[tuple[str, int], ...]
    factor: Fraction
    score: float

    @property
    def dimension(self) -> str:
        return "*".join(d if p == 1 else f"{d}^{p}" for d, p in self.powers) or "none"


class _Trie:
    def __init__(self, words: Mapping[str, object]):
        self.top: dict = {}
        for w, v in words.items():
            node = self.top
            for c in w:
                node = node.setdefault(c, {})
            node.setdefault("", []).extend(v if isinstance(v, (list, tuple)) else [v])

    def walk(self, s: str, i: int) -> Iterator[tuple[int, object]]:
        """(end, value) of every word of the trie that begins at i."""
        node = self.top
        while True:
            for v in node.get("", ()):
                yield i, v
            if i == len(s) or s[i] not in node:
                return
            node = node[s[i]]
            i += 1


class UnitGrammar:
    """unit := factor ((' ' | '*' | '/' | ' per ') factor)*, factor := [prefix] root [exponent]."""

    #: log weight of using a prefix: a plain root is likelier than prefix and root.
    PREFIX = log(0.3)
    SEPARATORS = {" per ": -1, "/": -1, " ": 1, "*": 1, "·": 1, "-": 1}

    def __init__(self, prefixes: Mapping[str, Fraction], roots: Mapping[str, Root | list[Root]], exponents: Mapping[str, int], priors: Mapping[str, float]):
        self.priors = dict(priors)
        self._prefix, self._root, self._exp = _Trie(prefixes), _Trie(roots), _Trie(exponents)
        self._sep = _Trie(self.SEPARATORS)

    def readings(self, text: str) -> list[Unit]:
        """All readings of the whole string, best first; empty if there is none."""
        s = " ".join(text.lower().split())
        return sorted((u for end, u in self.spans(s, 0) if end == len(s)), key=lambda u: (-u.score, u.dimension))

    def spans(self, s: str, begin: int) -> list[tuple[int, Unit]]:
        """(end, reading) of every unit that begins at `begin`.

        table[i] holds, for each (dimension powers, sign of the next factor), the best way
        to read s[begin:i]; the dimension prior is added at the end.
        """
        table: dict[int, dict] = {begin: {((), 1): (0.0, Fraction(1))}}
        todo = [begin]
        out = []

        def put(i: int, key, score: float, factor: Fraction) -> None:
            at = table.setdefault(i, {})
            if not at:
                heappush(todo, i)
            if key not in at or at[key][0] < score:
                at[key] = (score, factor)

        while todo:
            i = heappop(todo)
            for (powers, sign), (score, factor) in list(table[i].items()):
                if sign == 0:  # after a factor: the unit may end, or a separator follows
                    out.append((i, Unit(powers, factor, score + self._prior(powers))))
                    for j, s2 in self._sep.walk(s, i):
                        put(j, (powers, s2), score, factor)
                    continue
                starts = [(i, Fraction(1), 0.0)] + [(j, f, self.PREFIX) for j, f in self._prefix.walk(s, i) if j > i]
                for a, pre, cost in starts:
                    for b, root in self._root.walk(s, a):
                        if b == a:
                            continue
                        for e_end, e in [(b, 1)] + [(j, x) for j, x in self._exp.walk(s, b) if j > b]:
                            p = dict(powers)
                            p[root.dimension] = p.get(root.dimension, 0) + sign * e
                            key = (tuple(sorted((d, x) for d, x in p.items() if x)), 0)
                            put(e_end, key, score + cost + log(root.weight), factor * (pre * root.factor) ** (sign * e))
        return out

    def read(self, text: str) -> Unit | None:
        return next(iter(self.readings(text)), None)

    def _prior(self, powers: tuple[tuple[str, int], ...]) -> float:
        name = Unit(powers, Fraction(1), 0.0).dimension
        return log(self.priors.get(name, self.priors.get("*", 1e-3)))


# SI and everyday prefixes, roots and exponents.
PREFIXES = {"k": Fraction(1000), "kilo": Fraction(1000), "h": Fraction(100), "d": Fraction(1, 10), "c": Fraction(1, 100), "centi": Fraction(1, 100), "m": Fraction(1, 1000), "milli": Fraction(1, 1000), "per ": Fraction(1), "per": Fraction(1), "pro": Fraction(1)}
EXPONENTS = {"s": 1, "2": 2, "²": 2, "^2": 2, "3": 3, "³": 3, "^3": 3, "^-1": -1}
ROOTS: dict[str, list[Root]] = {
    "m": [Root("length")],
    "metre": [Root("length")],
    "meter": [Root("length")],
    "in": [Root("length", Fraction(254, 10000))],
    "inch": [Root("length", Fraction(254, 10000))],
    "ft": [Root("length", Fraction(3048, 10000))],
    "g": [Root("mass", Fraction(1, 1000))],
    "gram": [Root("mass", Fraction(1, 1000))],
    "lb": [Root("mass", Fraction(45359237, 100000000))],
    "h": [Root("time", Fraction(3600))],
    "hour": [Root("time", Fraction(3600))],
    "min": [Root("time", Fraction(60))],
    "minute": [Root("time", Fraction(60))],
    "sec": [Root("time")],
    "l": [Root("volume", Fraction(1, 1000))],
    "pt": [Root("volume", Fraction(473176473, 10**12)), Root("count")],
    "point": [Root("count")],
    "star": [Root("count")],
    "mark": [Root("count")],
    "cent": [Root("share", Fraction(1, 100)), Root("money", Fraction(1, 100))],
    "ct": [Root("share", Fraction(1, 100), 0.2)],
    "pct": [Root("share", Fraction(1, 100))],
    "percent": [Root("share", Fraction(1, 100))],
    "%": [Root("share", Fraction(1, 100))],
    "‰": [Root("share", Fraction(1, 1000))],
}
#: How likely a field holding ratings measures each dimension.
RATING_PRIORS = {"count": 0.6, "share": 0.35, "money": 0.001, "volume": 0.001, "time": 0.001, "length": 0.001, "*": 1e-6}

# Number words, the words between a value and its scale, labels.
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
POWERS = {"hundred": 100, "thousand": 1000, "million": 1_000_000}
HALF = "and a half"
FIELD_LINKS = ("/", "out of", "of a possible", "on a scale of", "of", "sur", "von")
TEXT_LINKS = ("/", "out of", "of a possible", "on a scale of", "sur", "von")
LABELS = ("rating", "grade", "score", "mark", "verdict", "note")
STAR_FULL, STAR_HALF, STAR_EMPTY = "★", "½", "☆"
_MARKS = str.maketrans(dict.fromkeys("()[]{}\"'“”‘’«»„`", " "))

_NUMERAL = _Trie({**{w: [("one", i)] for i, w in enumerate(ONES)}, **{w: [("ten", 10 * (i + 2))] for i, w in enumerate(TENS)}, **{w: [("power", p)] for w, p in POWERS.items()}, "a": [("a", 1)]})


def _digits(s: str, i: int) -> int:
    while i < len(s) and "0" <= s[i] <= "9":
        i += 1
    return i


def numbers(s: str, i: int) -> Iterator[tuple[int, Fraction]]:
    """(end, value) of every number that begins at i: digits with a point or comma, or words
    ("thirty-five", "a hundred and twelve", "three and a half"). Digits are never parted."""
    j = _digits(s, i)
    if j > i:
        if s[j : j + 1] in (".", ",") and _digits(s, j + 1) > j + 1:
            k = _digits(s, j + 1)
            yield k, Fraction(int(s[i:j] + s[j + 1 : k]), 10 ** (k - j - 1))
        else:
            yield j, Fraction(int(s[i:j]))
        return
    # (at, settled, open, kind of the last word): the value is settled + open.
    todo = [(i, 0, 0, "")]
    while todo:
        at, total, part, last = todo.pop()
        for j, (kind, n) in _NUMERAL.walk(s, at):
            if j < len(s) and s[j].isalnum():
                continue
            if kind == "one" and (last in ("", "power") or last == "ten" and 0 < n < 10):
                state = (total, part + n, kind)
            elif kind == "ten" and last in ("", "power") or kind == "a" and last == "":
                state = (total, part + n, kind)
            elif kind == "power" and last and part and (n > 100 or part < 100):
                state = (total, part * n, kind) if n == 100 else (total + part * n, 0, kind)
            else:
                continue
            if kind != "a":
                value = Fraction(state[0] + state[1])
                yield j, value
                if s.startswith(" " + HALF, j) and not s[j + len(HALF) + 1 : j + len(HALF) + 2].isalnum():
                    yield j + len(HALF) + 1, value + Fraction(1, 2)
            todo += [(j + len(x), *state) for x in (" and ", "-", " ") if s.startswith(x, j)][:1]


def _fold(text: str) -> str:
    """Lower case, one blank for each run of blanks, without emphasis marks and unseen characters."""
    t = unicodedata.normalize("NFKC", text.replace(STAR_HALF, "\0")).replace("\0", STAR_HALF).lower()
    t = "".join(c for c in t if c not in "*_" and unicodedata.category(c) != "Cf")
    return " ".join(t.split())


@dataclass(frozen=True)
class Reading:
    """kind: ratio (value of scale), grade (name in `grade`), bare (value, scale unknown), none."""

    kind: str
    value: Fraction | None = None
    scale: Fraction | None = None
    grade: str | None = None


_NONE = Reading("none")


@dataclass
class QuantityReader:
    """Reads one field as number [unit] [link number [unit]]: of all ways that the tries of
    numbers, units and links allow, the one with the best score. Answers are remembered:
    notations repeat a great deal."""

    grammar: UnitGrammar = field(default_factory=lambda: UnitGrammar(PREFIXES, ROOTS, EXPONENTS, RATING_PRIORS))

    def __post_init__(self):
        self.read = lru_cache(maxsize=100_000)(self._read)
        self._field_links, self._text_links = (_Trie({w: w for w in links}) for links in (FIELD_LINKS, TEXT_LINKS))
        self._labels, self._grades = _Trie({w: w for w in LABELS}), _Trie({"+": "+", "-": "-", "plus": "+", "minus": "-", "": ""})
        # Where a number may begin in a running text; the grammar reads on from there.
        self._begins = re.compile(rf"(?<![\w.,])(?=\d|(?:{'|'.join(ONES + TENS)}|a (?:{'|'.join(POWERS)}))\b)")

    def __reduce__(self):
        return QuantityReader, (self.grammar,)

    def _unit_after(self, s: str, i: int) -> list[tuple[int, Unit | None]]:
        """Whether and how a unit follows the number that ends at i."""
        j = i + 1 if s[i : i + 1] == " " else i
        own = [(e + 1 if s[e : e + 1] == "." else e, u) for e, u in self.grammar.spans(s, j) if e == len(s) or not s[e].isalnum()]
        return [(i, None), *own]

    def _phrases(self, s: str, i: int, links: _Trie) -> Iterator[tuple[int, float, Fraction, Unit | None, Fraction | None, Unit | None]]:
        """(end, score, value, its unit, scale or None, its unit) of every quantity that begins at i."""
        for j, value in numbers(s, i):
            for k, unit in self._unit_after(s, j):
                score = unit.score if unit else 0.0
                yield k, score, value, unit, None, None
                at = k + 1 if s[k : k + 1] == " " else k
                for m, _ in links.walk(s, at):
                    m = m + 1 if s[m : m + 1] == " " else m
                    for n, scale in numbers(s, m):
                        for end, other in self._unit_after(s, n):
                            yield end, score + (other.score if other else 0.0), value, unit, scale, other

    def _read(self, text: str) -> Reading:
        t = _fold(text)
        for end, _ in self._labels.walk(t, 0):
            rest = t[end:].lstrip()
            if rest[:1] in (":", "="):
                t = rest[1:].lstrip()
                break
        while len(t) > 1 and (t[0], t[-1]) in (("(", ")"), ("[", "]"), ('"', '"')):
            t = t[1:-1].strip()
        if t and set(t) <= {STAR_FULL, STAR_HALF, STAR_EMPTY}:
            return Reading("ratio", t.count(STAR_FULL) + Fraction(t.count(STAR_HALF), 2), Fraction(len(t)))
        signs = [sign for e, sign in self._grades.walk(t, 2 if t[1:2] == " " else 1) if e == len(t)] if t else []
        if signs and "a" <= t[0] <= "z":
            return Reading("grade", grade=t[0].upper() + signs[0])
        whole = [p for p in self._phrases(t, 0, self._field_links) if p[0] == len(t)]
        if not whole:
            return _NONE
        _, _, value, unit, scale, other = max(whole, key=lambda p: p[1])
        kinds = [u.dimension if u else "count" for u in (unit, other)]
        if scale is not None:
            return Reading("ratio", value, scale) if kinds == ["count", "count"] else _NONE
        if kinds[0] == "share":
            return Reading("ratio", value, 1 / unit.factor)
        return Reading("bare", value) if kinds[0] == "count" else _NONE

    def scale_in_text(self, value: Fraction, text: str) -> Fraction | None:
        """The scale that a running text gives for this same number; the first if several.
        Quotes and brackets around words do not count."""
        t = " ".join(_fold(text).translate(_MARKS).split())
        for m in self._begins.finditer(t):
            found = [
                (end, scale)
                for end, _, own, unit, scale, other in self._phrases(t, m.start(), self._text_links)
                if own == value and scale is not None and other is None and (unit is None or unit.dimension == "count") and not t[end : end + 1].isalnum()
            ]
            if found:
                return max(found)[1]
        return None


def _score(value: Fraction, scale: Fraction, target: int) -> int | None:
    """target * value / scale, rounded half up; null if the value lies outside the scale."""
    if scale <= 0 or not 0 <= value <= scale:
        return None
    return int((2 * target * value + scale) // (2 * scale))


def to_common_scale(
    df: DataFrame,
    *,
    keep: list[Column],
    quantity: Column,
    text: Column,
    fallback: Column,
    grades: DataFrame,
    grade_name: str = "grade",
    grade_share: str = "pct",
    target: int = 1000,
    reader: QuantityReader | None = None,
) -> DataFrame:
    """The columns of `keep`, then `kind` and `score`: round half up(target * value / scale).

    The scale is the one in the quantity itself (a ratio, a percentage, a row of star
    signs; a grade is worth grade_share percent), else the one that `text` gives for the
    same number, else `fallback`. score is null where the quantity is null, blank or no
    number, the grade or the scale is unknown or not positive, or the value lies above
    the scale. Values and scales are exact whatever their size and number of digits. Rows
    are kept one for one, repeated ones too; empty tables give no rows; only the given
    columns are read.

    The text is sent to Python only for rows whose quantity states no scale; repeated
    notations are read once per worker.
    """
    r = reader or QuantityReader()

    @F.pandas_udf("kind string, score int, v string, g string")
    def read(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for col in parts:
            codes, uniq = pd.factorize(col, use_na_sentinel=True)
            got = [r.read(u) for u in uniq] + [_NONE]
            scores = [_score(x.value, x.scale, target) if x.kind == "ratio" else None for x in got]
            values = [str(x.value) if x.kind == "bare" else None for x in got]
            table = pd.DataFrame({"kind": [x.kind for x in got], "score": pd.array(scores, "Int32"), "v": values, "g": [x.grade for x in got]})
            yield table.iloc[codes].reset_index(drop=True)  # code -1 is null: the last row

    @F.pandas_udf("int")
    def score_bare(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for v, t, f in parts:
            out: list[int | None] = []
            for a, b, c in zip(v, t, f):
                score = None
                if a is not None:
                    value = Fraction(a)
                    scale = r.scale_in_text(value, b) if b is not None else None
                    if scale is None and c is not None and isfinite(c):
                        scale = Fraction(repr(float(c)))
                    score = _score(value, scale, target) if scale is not None else None
                out.append(score)
            yield pd.Series(pd.array(out, "Int32"))

    first = df.select(*keep, quantity.alias("__q"), text.alias("__text"), fallback.cast("double").alias("__fallback"))
    names = first.columns[: len(keep)]
    first = first.withColumn("__r", read("__q"))
    bare = F.col("__r.kind") == "bare"
    second = first.select(*names, F.col("__r.kind").alias("kind"), F.col("__r.score").alias("__score"), F.col("__r.v").alias("__v"), F.col("__r.g").alias("__g"), F.when(bare, F.col("__text")).alias("__text"), "__fallback")
    third = second.withColumn("__bare", score_bare("__v", "__text", "__fallback"))
    share = F.col(grade_share).cast("decimal(20,6)")
    g = grades.select(F.upper(F.trim(F.col(grade_name))).alias("__grade"), F.when(share.between(0, 100), share).alias("__pct"))
    g = g.where(F.col("__grade").isNotNull()).groupBy("__grade").agg(F.max("__pct").alias("__pct"))
    graded = F.floor((F.col("__pct") * (2 * target) + 100) / 200).cast("int")
    joined = third.join(g, F.col("__g") == F.col("__grade"), "left")
    return joined.select(*names, "kind", F.coalesce("__score", "__bare", F.when(F.col("kind") == "grade", graded)).alias("score"))
