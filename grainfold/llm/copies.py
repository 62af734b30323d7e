"""Duplicates hidden by formatting: rows equal but for blanks, case, punctuation, part order.

Each text is streamed through a skip-and-fold table into rolling polynomial hashes
(textvec), so no canonical string is ever stored: two hashes of its letters in the order
they stand and, for a text of labelled parts, two more whose value does not depend on the
order of the parts. Texts with equal letters are copies, so are texts with equal parts,
and a record is everything that hangs together by either. Rows whose hashes agree are
compared again with two pointers, each skipping what does not count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainfold.llm import textvec as tv
from grainfold.operators.skew import salted_pair
from grainfold.session import written

#: Copies of one record that are compared in one task; larger groups are dealt over several.
GROUP_BLOCK = 20_000

# Types as objects: workers import this module without a session.
_HASHES = T.StructType([T.StructField(n, T.LongType()) for n in ("h1", "h2", "s1", "s2")])
_DIGEST = T.StructType([T.StructField(n, T.LongType()) for n in ("d1", "d2")])
_LETTERS = ["grp", "h1", "h2"]
_PARTS = ["grp", "s1", "s2"]


def canonical_hash(bits: int = 64):
    """A UDF: hashes of a text's letters (h1, h2) and of its labelled parts (s1, s2; null
    without such parts). bits: width of each hash, for tests of collisions."""
    mask = np.uint64((1 << bits) - 1)

    @F.pandas_udf(_HASHES)
    def hashes(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for col in batches:
            texts = col.fillna("").tolist()
            out = {n: np.zeros(len(texts), dtype=np.uint64) for n in ("h1", "h2", "s1", "s2")}
            parted = np.zeros(len(texts), dtype=bool)
            for a, b in tv.slices(texts):
                own = texts[a:b]
                out["h1"][a:b], out["h2"][a:b], _ = tv.Batch(own).canonical()
                starts = {i: p for i, t in enumerate(own) if (p := tv.label_starts(t))}
                if starts:
                    at = np.array(list(starts))
                    s1, s2, _ = tv.Batch([own[i] for i in at]).canonical(dict(enumerate(starts.values())))
                    out["s1"][a + at], out["s2"][a + at], parted[a + at] = s1, s2, True
            frame = pd.DataFrame({n: (x & mask).view(np.int64) for n, x in out.items()}).astype("Int64")
            frame.loc[~parted, ["s1", "s2"]] = pd.NA
            yield frame

    return hashes


def same_when_folded(a: str, b: str) -> bool:
    """Two pointers over both texts, each skipping what does not count."""
    return _equal(a, 0, len(a), b, 0, len(b))


def same_parts(a: str, b: str) -> bool:
    """Whether two texts of labelled parts have the same parts, in any order."""
    pa, pb = tv.label_starts(a), tv.label_starts(b)
    if not pa or not pb or len(pa) != len(pb):
        return False
    rest = list(zip(pb, [*pb[1:], len(b)]))
    for i, m in zip(pa, [*pa[1:], len(a)]):
        k = next((k for k, (j, n) in enumerate(rest) if _equal(a, i, m, b, j, n)), None)
        if k is None:
            return False
        del rest[k]
    return True


def _equal(a: str, i: int, m: int, b: str, j: int, n: int) -> bool:
    fold = tv.fold_table()
    while True:
        # Stretches that agree as written are passed over without folding.
        step = 64
        while i + step <= m and j + step <= n and a[i : i + step] == b[j : j + step]:
            i, j, step = i + step, j + step, 2 * step
        while i < m and not fold[ord(a[i])]:
            i += 1
        while j < n and not fold[ord(b[j])]:
            j += 1
        if i == m or j == n:
            return i == m and j == n
        if fold[ord(a[i])] != fold[ord(b[j])]:
            return False
        i, j = i + 1, j + 1


def _digest(text: str, parts: bool) -> tuple[int, int]:
    """128 bits of a cryptographic hash of what counts in a text: its name once its hashes collided."""
    fold, starts = tv.fold_table(), (tv.label_starts(text) if parts else None) or [0]
    spans = [text[i:m] for i, m in zip(starts, [*starts[1:], len(text)])]
    own = sorted("".join(chr(fold[ord(c)]) for c in x if fold[ord(c)]) for x in spans)
    d = hashlib.sha256("\0".join(own).encode("utf-8", "surrogatepass")).digest()
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:16], "big", signed=True)


@F.pandas_udf(_DIGEST)
def unlike(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Null where two texts agree (in their parts, if so asked), else the second one's digest."""
    for left, right, parts in batches:
        out = [None if (same_parts if p else same_when_folded)(a, b) else _digest(b, p) for a, b, p in zip(left, right, parts)]
        yield pd.DataFrame({n: pd.array([x and x[k] for x in out], "Int64") for k, n in enumerate(("d1", "d2"))})


def record_classes(rows: DataFrame) -> DataFrame:
    """(grp, h1, h2, c1, c2): the class of all letters that share their parts with others.

    Letters without a row here are a class of their own (c = h). Each round every set of
    parts takes the smallest class of its letters, and all letters the smallest of their
    parts; one round settles it unless the same letters fall into different parts.
    """
    edges = written(rows.where("s1 IS NOT NULL").groupBy("grp", "h1", "h2", "s1", "s2").agg(F.min("key").alias("key")), "parts")
    at, before = edges.withColumn("c", F.struct("h1", "h2")), None
    while True:
        low = at.groupBy(*_PARTS).agg(F.min("c").alias("low"))
        now = at.join(low, _PARTS).groupBy(*_LETTERS).agg(F.min("low").alias("c"), F.count(F.lit(1)).alias("sets"))
        now = written(now, "classes")
        mark = tuple(now.agg(F.count_if(F.col("sets") > 1), F.bit_xor(F.xxhash64(*_LETTERS, "c"))).first())
        if not mark[0] or mark == before:
            return now.select(*_LETTERS, F.col("c.h1").alias("c1"), F.col("c.h2").alias("c2")).where("c1 <> h1 OR c2 <> h2")
        before, at = mark, edges.join(now.drop("sets"), _LETTERS)


def classed(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Adds the class (c1, c2) of each row."""
    out = rows.join(classes, _LETTERS, "left")
    return out.withColumns({"c1": F.coalesce("c1", "h1"), "c2": F.coalesce("c2", "h2")})


def _records(rows: DataFrame) -> DataFrame:
    """(grp, h1, h2, own, own_copies, first, copies): letters with their smallest key and
    number of rows, and those of their record."""
    letters = written(classed(rows.groupBy(*_LETTERS).agg(F.min("key").alias("own"), F.count(F.lit(1)).alias("own_copies")), record_classes(rows)), "letters")
    whole = letters.groupBy("grp", "c1", "c2").agg(F.min("own").alias("first"), F.sum("own_copies").alias("copies"))
    # The letters of one record come in a few orders of its parts; a record's rows do not meet here.
    return written(letters.join(whole, ["grp", "c1", "c2"]).drop("c1", "c2"), "records")


def _members(rows: DataFrame, records: DataFrame) -> DataFrame:
    """(key, grp, own, own_copies, first, copies) of the rows of records with several rows."""
    several = records.where("copies > 1").withColumn("__k", F.xxhash64(*_LETTERS))
    counts = several.select("__k", F.col("own_copies").alias("rows"))
    left, right = salted_pair(rows.select("key", *_LETTERS, F.xxhash64(*_LETTERS).alias("__k")), several, "__k", "key", counts=counts)
    return left.join(right, ["__k", "__salt", *_LETTERS]).select("key", "grp", "own", "own_copies", "first", "copies")


def _compared(df: DataFrame, key: Column, text: Column, rows: DataFrame, members: DataFrame) -> DataFrame:
    """(key, parts, d1, d2): rows that differ from the first of their letters, or of their parts."""
    by_letters = members.where("key <> own").select(F.col("own").alias("left"), "key", F.col("own_copies").alias("n"), F.lit(False).alias("parts"))
    edges = rows.where("s1 IS NOT NULL").groupBy("grp", "h1", "h2", "s1", "s2").agg(F.min("key").alias("key"))
    sets = edges.groupBy(*_PARTS).agg(F.min("key").alias("left"), F.count(F.lit(1)).alias("n")).where("n > 1")
    by_parts = edges.join(sets, _PARTS).where("key <> left").select("left", "key", "n", F.lit(True).alias("parts"))
    pairs = written(by_letters.unionByName(by_parts), "to_compare")
    wanted = pairs.select(F.explode(F.array("left", "key")).alias("key")).distinct()
    texts = written(df.select(key.alias("key"), text.alias("text")).join(wanted, "key"), "compared")
    blocks = F.ceil(F.col("n") / GROUP_BLOCK).cast("int")
    firsts = pairs.groupBy("left").agg(F.max("n").alias("n")).join(texts.withColumnRenamed("key", "left"), "left")
    firsts = firsts.select("left", F.col("text").alias("left_text"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    dealt = pairs.join(texts, "key").withColumn("block", F.pmod(F.xxhash64("key"), blocks).cast("int"))
    both = dealt.join(firsts, ["left", "block"]).select("key", "parts", unlike("left_text", "text", "parts").alias("d"))
    return both.where("d.d1 IS NOT NULL").select("key", "parts", "d.d1", "d.d2")


def verified_rows(df: DataFrame, key: Column, group: Column, text: Column, bits: int = 64) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, records, members) once every agreement of hashes has been compared.

    A row that only collided is named by a digest instead of its hash and counted anew.
    """
    own = df.select(key.alias("key"), group.alias("grp"), text.alias("__text")).where("grp IS NOT NULL AND __text IS NOT NULL")
    rows = written(own.select("key", "grp", canonical_hash(bits)("__text").alias("h")).select("key", "grp", "h.*"), "copies")
    while True:
        records = _records(rows)
        members = written(_members(rows, records), "members")
        bad = written(_compared(df, key, text, rows, members), "collided")
        if bad.isEmpty():
            return rows, records, members
        wrong = bad.groupBy("key").agg(*[F.max(F.when(F.col("parts") == p, F.struct("d1", "d2"))).alias(n) for n, p in (("s", True), ("h", False))])
        fixed = rows.join(wrong, "key", "left").withColumns({f"{x}{i}": F.coalesce(f"{x}.d{i}", f"{x}{i}") for x in "hs" for i in (1, 2)})
        rows = written(fixed.select("key", "grp", "h1", "h2", "s1", "s2"), "copies")


def formatting_copies(df: DataFrame, key: Column, group: Column, text: Column, bits: int = 64) -> DataFrame:
    """(first, copy): every row that repeats an earlier one of its group but for formatting.

    Rows with a null group or text take part in nothing; texts without any letter or digit
    are alike. `key` must be unique; the first of a record is its smallest key. Exact
    repeats count as copies, and so do texts that share neither letters nor parts but are
    both copies of a third. Further columns are not read; empty tables give no rows. A
    record with very many copies is counted by partial sums, and its copies are dealt
    over several tasks for the comparison.
    """
    _, _, members = verified_rows(df, key, group, text, bits)
    return members.where("key <> first").select("first", F.col("key").alias("copy"))


def collapse(df: DataFrame, key: Column, group: Column, text: Column, bits: int = 64) -> DataFrame:
    """(key, grp, copies): one row per distinct record of a group with its number of copies."""
    _, records, _ = verified_rows(df, key, group, text, bits)
    return records.where("own = first").select(F.col("first").alias("key"), "grp", "copies")
