"""Near-duplicate records: pairs that share most of their runs of successive words.

Every distinct text gets a signature of positional bytes: byte i is the low byte of the
smallest value of hash function i over the text's word runs, so two texts agree at a
position with a chance that equals their similarity. An inverted index lists texts by the
bytes at groups of `rows` positions. Two texts meeting in a list are tallied over sixteen
further positional bytes, and only pairs with the minimum number of matches are kept and
verified on the texts themselves. The groups grow with the number of texts, so that lists
stay short, and the number of groups with them, so that no more pairs are missed.

A signature reaches its minimum with a known chance only. Where every link is wanted,
`exact` indexes the word runs themselves: of a text's runs, rarest first, so many are
listed that any two texts similar enough are guaranteed to meet in at least one list.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from fractions import Fraction
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainfold.llm import textvec as tv
from grainfold.llm.copies import canonical_hash, classed, record_classes
from grainfold.session import written


@dataclass(frozen=True)
class Similarity:
    """run: words in a run; at_least: similarity of the sets of runs; min_words: shorter texts
    take no part; rows x bands positional bytes; matches: least tally out of 16."""

    run: int = 5
    at_least: Fraction = Fraction(8, 10)
    min_words: int = 5
    rows: int = 3
    bands: int = 28
    matches: int = 7
    #: Index the word runs themselves: no link is missed, at the price of longer lists.
    exact: bool = False
    #: Texts in a list by chance, at most: rows grow until there are so many lists.
    crowd: int = 16
    #: Posting lists longer than this are tallied block against block in separate tasks.
    block: int = 8192


def miss_chance(s: Similarity) -> float:
    """The chance that a pair right at the threshold is missed."""
    p = float(s.at_least)
    enough = sum(comb(_TALLY, k) * p**k * (1 - p) ** (_TALLY - k) for k in range(s.matches, _TALLY + 1))
    return (1 - p**s.rows * enough) ** s.bands


def fitted(s: Similarity, texts: int) -> Similarity:
    """The same with more rows where `texts` would crowd the lists, and as many more bands as
    keep the chance of a miss. A key has eight bytes, two of them for the band."""
    own = s
    while own.rows < 6 and texts > own.crowd * 256**own.rows:
        own = replace(own, rows=own.rows + 1)
        while miss_chance(own) > miss_chance(s):
            own = replace(own, bands=own.bands + 1)
    return own


def _signatures(words: np.ndarray, counts: np.ndarray, s: Similarity) -> np.ndarray:
    """Positional bytes (texts x positions); texts have at least one run each."""
    runs, n = tv.word_runs(words, counts, s.run)
    h = (runs >> np.uint64(32)).astype(np.uint32)
    begins = np.cumsum(n) - n
    out = np.empty((len(counts), s.rows * s.bands), dtype=np.uint8)
    rng = np.random.default_rng(20_240_229)
    odd = rng.integers(0, 2**32, size=(out.shape[1], 2), dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    with np.errstate(over="ignore"):
        for i, (a, b) in enumerate(odd):
            x = h * a + b
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            low = np.minimum.reduceat(x, begins)
            low = (low ^ (low >> np.uint32(11))) * np.uint32(0x9E3779B1)
            out[:, i] = low >> np.uint32(24)
    return out


_TALLY = 16  # positional bytes that go with each posting, as two whole numbers
_POSTING = pa.schema([(c, pa.int64()) for c in ("key", "doc", "t1", "t2")])
_EVENT = pa.schema([("kind", pa.int32()), *((c, pa.int64()) for c in ("a", "b", "t1", "t2")), ("block", pa.int32())])


def postings(texts: DataFrame, s: Similarity) -> DataFrame:
    """(key, doc, t1, t2): the lists each distinct text stands in. doc is the hash of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            own = batch.column(0).to_pylist()
            for a, b in tv.slices(own):
                words, counts = tv.Batch(own[a:b]).words()
                doc = tv.sequence_hash(words, counts).view(np.int64)
                _, first = np.unique(doc, return_index=True)
                new = np.zeros(len(doc), dtype=bool)
                new[first] = True
                new &= counts >= max(s.min_words, s.run)
                new &= np.fromiter((d not in seen for d in doc.tolist()), dtype=bool, count=len(doc))
                if len(seen) > 500_000:
                    seen.clear()  # saves work only; the lists are made unique later
                seen.update(doc[new].tolist())
                if not new.any():
                    continue
                words, counts, doc = words[np.repeat(new, counts)], counts[new], doc[new]
                sig = _signatures(words, counts, s)
                wide = np.concatenate([sig, sig[:, : s.rows + _TALLY]], axis=1)
                n = len(doc)
                key, tally = np.empty((s.bands, n), np.int64), np.empty((s.bands, n, 2), np.int64)
                for g in range(s.bands):
                    k = np.full(n, g, dtype=np.int64)
                    for j in range(s.rows):
                        k = (k << 8) | sig[:, g * s.rows + j]
                    key[g] = k
                    at = (g + 1) * s.rows
                    tally[g] = np.ascontiguousarray(wide[:, at : at + _TALLY]).view(np.int64)
                yield pa.record_batch([pa.array(key.ravel()), pa.array(np.tile(doc, s.bands)), pa.array(tally[:, :, 0].ravel()), pa.array(tally[:, :, 1].ravel())], schema=_POSTING)

    return texts.mapInArrow(run, "key bigint, doc bigint, t1 bigint, t2 bigint")


def exact_postings(texts: DataFrame, s: Similarity) -> DataFrame:
    """(key, doc, t1, t2): the rarest runs of each distinct text, one more than the texts of a
    pair can differ in: of n runs, n - ceil(n * at_least) + 1. Two texts that share enough
    runs share one of these, whichever of them the other lacks (ties: the smaller hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pylist()
            for a, b in tv.slices(own):
                words, counts = tv.Batch(own[a:b]).words()
                doc = tv.sequence_hash(words, counts).view(np.int64)
                runs, n = tv.word_runs(words, counts, s.run)
                keep = np.repeat(counts >= max(s.min_words, s.run), n)
                if keep.any():
                    yield pa.record_batch([pa.array(np.repeat(doc, n)[keep]), pa.array(runs.view(np.int64)[keep])], names=["doc", "key"])

    every = written(texts.mapInArrow(run, "doc bigint, key bigint").distinct(), "runs")
    counted = every.join(every.groupBy("key").agg(F.count(F.lit(1)).alias("df")), "key").where("df > 1")
    sizes = every.groupBy("doc").agg(F.count(F.lit(1)).alias("n"))
    # Runs that no other text has come first of all: they take up the first places.
    alone = counted.groupBy("doc").agg(F.count(F.lit(1)).alias("common")).join(sizes, "doc").select("doc", "n", (F.col("n") - F.col("common")).alias("alone"))
    num, den = s.at_least.numerator, s.at_least.denominator
    place = F.row_number().over(Window.partitionBy("doc").orderBy("df", "key"))
    listed = counted.withColumn("place", place).join(alone, "doc").where(F.col("place") + F.col("alone") <= F.col("n") - F.ceil(F.col("n") * num / den) + 1)
    return listed.select("key", "doc", F.lit(0).cast("bigint").alias("t1"), F.lit(0).cast("bigint").alias("t2"))


def _matches(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of equal bytes of two arrays of eight positional bytes."""
    x = (a ^ b).view(np.uint64)
    low = np.uint64(0x7F7F7F7F7F7F7F7F)
    zero = ~(((x & low) + low) | x | low)  # the top bit of each byte that is zero
    ones = zero >> np.uint64(7)
    with np.errstate(over="ignore"):
        return ((ones * np.uint64(0x0101010101010101)) >> np.uint64(56)).astype(np.int64)


def _tally_lists(key: np.ndarray, doc: np.ndarray, t1: np.ndarray, t2: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of each list with at least `least` matches. Input sorted by (key, doc)."""
    keep = np.ones(len(key), dtype=bool)
    keep[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    key, doc, t1, t2 = key[keep], doc[keep], t1[keep], t2[keep]
    left, right = [], []
    at = np.arange(len(key) - 1) if len(key) > 1 else np.zeros(0, dtype=np.int64)
    step = 1
    while len(at):
        at = at[at + step < len(key)]
        at = at[key[at + step] == key[at]]
        hit = at[_matches(t1[at], t1[at + step]) + _matches(t2[at], t2[at + step]) >= least]
        left.append(doc[hit])
        right.append(doc[hit + step])
        step += 1
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _events(kind: int, a: np.ndarray, b: np.ndarray, t1: np.ndarray | None = None, t2: np.ndarray | None = None, block: int = 0) -> pa.RecordBatch:
    n = len(a)
    tallies = [pa.array(np.zeros(n, np.int64) if t is None else t) for t in (t1, t2)]
    return pa.record_batch([pa.array(np.full(n, kind, np.int32)), pa.array(a), pa.array(b), *tallies, pa.array(np.full(n, block, np.int32))], schema=_EVENT)


def candidates(lists: DataFrame, s: Similarity) -> DataFrame:
    """(a, b), a < b, distinct: pairs retained by the tally, from all lists whatever their length."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64) for _ in range(4)]  # key, doc, t1, t2 not yet dealt with
        hot, block = None, 0

        def take(n: int) -> list[np.ndarray]:
            nonlocal held
            out, held = [x[:n] for x in held], [x[n:] for x in held]
            return out

        for batch in batches:
            held = [np.concatenate([x, c.to_numpy(zero_copy_only=False)]) for x, c in zip(held, batch.columns)]
            while len(held[0]):
                key = held[0]
                if hot is not None:  # the rest of a long list goes out block by block
                    end = int(np.searchsorted(key, hot, side="right"))
                    if end == len(key) and end < s.block:
                        break
                    if end:
                        yield _events(1, *take(min(end, s.block)), block=block)
                        block += 1
                    elif len(key):
                        hot, block = None, 0
                    continue
                last = int(np.searchsorted(key, key[-1]))
                starts = np.append(np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key))
                long_ = np.flatnonzero(np.diff(starts) > s.block)
                stop = min(last, int(starts[long_[0]])) if len(long_) else last
                if stop:
                    a, b = _tally_lists(*take(stop), s.matches)
                    if len(a):
                        yield _events(0, a, b)
                if not len(long_):
                    break
                hot = held[0][0]
        if len(held[0]):
            if hot is not None and held[0][0] == hot:
                yield _events(1, *held, block=block)
            else:
                a, b = _tally_lists(*held, s.matches)
                if len(a):
                    yield _events(0, a, b)

    events = written(lists.repartition("key").sortWithinPartitions("key", "doc").mapInArrow(scan, "kind int, a bigint, b bigint, t1 bigint, t2 bigint, block int"), "tally")
    long_lists = events.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("doc"), "t1", "t2", "block")
    blocks = long_lists.groupBy("key").agg((F.max("block") + 1).alias("blocks"))
    spread = long_lists.join(blocks, "key").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc", "t1", "t2")

    def cross(_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        x = pdf[pdf["block"] == i]
        y = x if i == j else pdf[pdf["block"] == j]
        (xd, x1, x2), (yd, y1, y2) = ([f[c].to_numpy() for c in ("doc", "t1", "t2")] for f in (x, y))
        left, right = [], []
        for d, t, u in zip(xd, x1, x2):
            enough = _matches(np.full(len(y1), t), y1) + _matches(np.full(len(y2), u), y2) >= s.matches
            hit = np.flatnonzero(enough & ((yd > d) if i == j else (yd != d)))
            left.append(np.minimum(yd[hit], d))
            right.append(np.maximum(yd[hit], d))
        none = np.zeros(0, np.int64)
        return pd.DataFrame({"a": np.concatenate(left or [none]), "b": np.concatenate(right or [none])})

    crossed = spread.groupBy("key", "i", "j").applyInPandas(cross, "a bigint, b bigint")
    return events.where("kind = 0").select("a", "b").unionByName(crossed).distinct()


def _overlap(s: Similarity):
    @F.pandas_udf("shared bigint, total bigint")
    def overlap(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for left, right in parts:
            a, b = left.tolist(), right.tolist()
            out = []
            for x, y in tv.slices(a):
                sets = []
                for own in (a[x:y], b[x:y]):
                    runs, n = tv.word_runs(*tv.Batch(own).words(), s.run)
                    at = np.repeat(np.arange(len(own)), n)
                    with np.errstate(over="ignore"):
                        keyed, first = np.unique(tv.mix(runs + tv.mix((at + 1).astype(np.uint64))), return_index=True)
                    sets.append((keyed, at[first]))
                size = y - x
                (ka, ia), (kb, ib) = sets
                both = ia[np.isin(ka, kb, assume_unique=True)]
                shared = np.bincount(both, minlength=size)
                total = np.bincount(ia, minlength=size) + np.bincount(ib, minlength=size) - shared
                out.append(pd.DataFrame({"shared": shared, "total": total}))
            yield pd.concat(out, ignore_index=True)

    return overlap


@dataclass(frozen=True)
class NearDuplicates:
    """rows: (key, grp, doc, h1, h2) of all texts long enough, the last two hashes of the letters;
    links: (a, b) of distinct texts; keys: (key) of all rows; classes: see record_classes."""

    rows: DataFrame
    links: DataFrame
    keys: DataFrame
    classes: DataFrame


def near_duplicates(df: DataFrame, key: Column, group: Column, text: Column, s: Similarity) -> NearDuplicates:
    """Links between distinct texts whose sets of word runs are similar enough, and membership.

    A text stands once in the index however many rows hold it; the rows come back through
    `rows` (doc: the text's hash). Null texts and texts
    with fewer than min_words words take no part. Repeated rows and ties change nothing;
    empty tables give no links; only the three given columns are read. Signatures can miss
    a pair: at the threshold itself the chance is (1 - p^rows * q)^bands, with p the
    similarity and q the chance of enough tally matches (miss_chance); it falls fast above
    it. With s.exact no pair is missed.
    """

    @F.pandas_udf("doc bigint, words bigint")
    def words_of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for col in parts:
            own, out = col.tolist(), []
            for a, b in tv.slices(own):
                words, counts = tv.Batch(own[a:b]).words()
                out.append(pd.DataFrame({"doc": tv.sequence_hash(words, counts).view(np.int64), "words": counts}))
            yield pd.concat(out, ignore_index=True) if out else pd.DataFrame({"doc": [], "words": []}, dtype="int64")

    source = df.select(key.alias("key"), group.alias("grp"), text.alias("text")).where("text IS NOT NULL")
    hashed = source.select("key", "grp", words_of("text").alias("w"), canonical_hash()("text").alias("c"))
    rows = written(hashed.where(F.col("w.words") >= max(s.min_words, s.run)).select("key", "grp", "w.doc", "c.*"), "texts")
    s = replace(s, matches=0) if s.exact else fitted(s, rows.count())
    pairs = written(candidates((exact_postings if s.exact else postings)(source.select("text"), s), s), "pairs")
    docs = pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    holders = rows.join(docs, "doc").groupBy("doc").agg(F.min("key").alias("key"))
    texts = written(holders.join(source.select("key", "text"), "key").select("doc", "text"), "held")
    both = pairs.join(texts.select(F.col("doc").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("doc").alias("b"), F.col("text").alias("text_b")), "b")
    shared = both.select("a", "b", _overlap(s)("text_a", "text_b").alias("o"))
    num, den = s.at_least.numerator, s.at_least.denominator
    links = shared.where((F.col("o.shared") * den >= F.col("o.total") * num) & (F.col("o.total") > 0)).select("a", "b")
    classes = record_classes(rows.where("grp IS NOT NULL"))
    return NearDuplicates(rows.select("key", "grp", "doc", "h1", "h2"), written(links, "links"), df.select(key.alias("key")), classes)


def expand_pairs(n: NearDuplicates) -> DataFrame:
    """(key_a, key_b), key_a < key_b: linked rows, without copies (same group, same record).

    Rows with the very same words pair up only if their groups differ or are null.
    """
    m = n.rows
    linked = n.links.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    of = classed(m.join(linked, "doc"), n.classes).select("doc", "key", "grp", F.struct("c1", "c2").alias("record"))
    a = of.select(F.col("doc").alias("a"), F.col("key").alias("ka"), F.col("grp").alias("ga"), F.col("record").alias("ca"))
    b = of.select(F.col("doc").alias("b"), F.col("key").alias("kb"), F.col("grp").alias("gb"), F.col("record").alias("cb"))
    copy = F.coalesce((F.col("ga") == F.col("gb")) & (F.col("ca") == F.col("cb")), F.lit(False))
    apart = n.links.join(a, "a").join(b, "b").where(~copy)
    # The same words under several groups: only such texts are paired with themselves.
    per_group = m.groupBy("doc", "grp").agg(F.count(F.lit(1)).alias("n"))
    mixed = per_group.groupBy("doc").agg(F.count(F.lit(1)).alias("groups"), F.max(F.when(F.col("grp").isNull(), F.col("n"))).alias("loose")).where("groups > 1 OR loose > 1").select("doc")
    own = m.join(mixed, "doc")
    x = own.select("doc", F.col("key").alias("ka"), F.col("grp").alias("ga"))
    y = own.select("doc", F.col("key").alias("kb"), F.col("grp").alias("gb"))
    same = x.join(y, "doc").where((F.col("ka") < F.col("kb")) & (F.col("ga").isNull() | F.col("gb").isNull() | (F.col("ga") != F.col("gb"))))
    both = apart.select("ka", "kb").unionByName(same.select("ka", "kb"))
    return both.select(F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b"))


def components(links: DataFrame) -> DataFrame:
    """(doc, class): the smallest doc each linked doc is connected with.

    Large-star and small-star steps in turn, each stored in the shared folder; the number of
    rounds grows with the logarithm of the longest chain.
    """
    edges = links.select("a", "b")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("low"))
        small = down.join(least, "a").select(F.col("b").alias("v"), "low").unionByName(least.select(F.col("a").alias("v"), "low"))
        edges = written(small.where("v <> low").select(F.col("v").alias("a"), F.col("low").alias("b")).distinct(), "stars")
        now = edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
        if mark == tuple(now):
            break
        mark = tuple(now)
    return edges.select(F.col("a").alias("doc"), F.col("b").alias("class")).unionByName(edges.select(F.col("b").alias("doc"), F.col("b").alias("class")).distinct())


def duplicate_classes(n: NearDuplicates) -> DataFrame:
    """(key, class, links): one row per row; links of its text. A text without links is a class
    of its own; null texts and those too short take part in no class and have no links."""
    classes = components(n.links)
    degree = n.links.select(F.explode(F.array("a", "b")).alias("doc")).groupBy("doc").agg(F.count(F.lit(1)).alias("links"))
    known = n.rows.join(classes, "doc", "left").join(degree, "doc", "left").select("key", F.coalesce("class", "doc").alias("class"), F.coalesce("links", F.lit(0)).alias("links"))
    rest = n.keys.join(n.rows, "key", "left_anti").select("key", F.lit(None).cast("bigint").alias("class"), F.lit(0).cast("bigint").alias("links"))
    return known.unionByName(rest)
