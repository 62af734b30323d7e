"""Keys that hold a large share of the rows, and aggregation through joins.

Two tools for the same trouble. `heavy_keys` names the keys above a share: there can be
at most 1/share of them, whatever the data, so that list may be broadcast. `salted_pair`
spreads both sides of a key-wise merge over several tasks per heavy key.
`eager_join_aggregate` avoids the trouble altogether: the rows are folded to one compact
state per key before any join, and totals over the join follow by multiplication.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_text(c: Column | str) -> Column:
    """A key without surrounding blanks and in lower case; null where nothing is left."""
    c = F.col(c) if isinstance(c, str) else c
    t = F.lower(F.trim(c))
    return F.when(t != "", t)


def heavy_keys(df: DataFrame, key: str, share: float, tasks: int = 32, counts: DataFrame | None = None) -> DataFrame:
    """(key, rows, salts) of the non-null keys holding at least `share` of all rows of df.

    At most 1/share rows come out. `counts` gives (key, rows) if they are known already. `salts` is in proportion to the key's weight, so that
    one salt of a heavy key is about as large as `share` of the rows, and at most `tasks`.
    """
    counts = counts or df.groupBy(F.col(key)).agg(F.count(F.lit(1)).alias("rows"))
    total = counts.agg(F.sum("rows").alias("total"))
    weight = F.col("rows") / F.col("total")
    return (
        counts.join(F.broadcast(total), F.col("rows") >= F.lit(float(share)) * F.col("total"))  # one row
        .where(F.col(key).isNotNull())
        .select(key, "rows", F.least(F.lit(tasks), F.ceil(weight / F.lit(float(share))) + 1).cast("int").alias("salts"))
    )


def salted_pair(many: DataFrame, few: DataFrame, key: str, spread: str, share: float = 0.005, counts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Give both frames a column `__salt` such that equal keys still meet.

    Rows of `many` with a heavy key are dealt over the key's salts by a hash of `spread`;
    rows of `few` with such a key are copied to each of them. Other keys keep salt 0.
    """
    hot = F.broadcast(heavy_keys(many.select(key), key, share, counts=counts).select(F.col(key).alias("__hot"), "salts"))
    left = (
        many.join(hot, many[key] == F.col("__hot"), "left")
        .withColumn("__salt", F.when(F.col("salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(spread), F.col("salts"))).cast("int"))
        .drop("__hot", "salts")
    )
    right = (
        few.join(hot, few[key] == F.col("__hot"), "left")
        .withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1)))
        .drop("__hot", "salts")
    )
    return left, right


@dataclass(frozen=True)
class Measure:
    """A column summed over the join: `value` is null in rows that do not count."""

    name: str
    value: Column


def eager_join_aggregate(
    left: DataFrame,
    right: DataFrame,
    left_key: Column,
    right_key: Column,
    left_measures: Sequence[Measure] = (),
    right_measures: Sequence[Measure] = (),
    key: str = "id",
) -> DataFrame:
    """Per-key results over `left LEFT JOIN right` without joining a single raw row.

    Both inputs are folded by key first (partial sums before the shuffle, so a key with a
    third of all rows is one row per task when it moves), the two compact states are
    joined, and the totals of the join are products of counts and sums:

        left_rows, right_rows, join_rows = left_rows * right_rows,
        <m>_n, <m>_sum            over the rows of its own side,
        <m>_join_n, <m>_join_sum  over the rows of the inner join.

    Sums are decimals with eight decimals (exact, so independent of order), products too. A null key forms one row of its
    own on the left and joins nothing. Measures that are null, or NaN, do not count.
    Empty inputs give no rows; keys only in `right` do not appear. Other columns of the
    inputs are never read, whatever their names.
    """

    def state(df: DataFrame, k: Column, measures: Sequence[Measure], rows: str, as_key: str) -> DataFrame:
        cols = [k.alias(as_key)]
        for m in measures:
            v = m.value.cast("double")
            cols.append(F.when(~F.isnan(v), v).cast("decimal(20,8)").alias(f"__{m.name}"))
        aggs = [F.count(F.lit(1)).alias(rows)]
        for m in measures:
            aggs += [F.count(f"__{m.name}").alias(f"{m.name}_n"), F.sum(f"__{m.name}").alias(f"{m.name}_sum")]
        return df.select(*cols).groupBy(as_key).agg(*aggs)

    a = state(left, left_key, left_measures, "left_rows", key)
    b = state(right, right_key, right_measures, "right_rows", "__key").where(F.col("__key").isNotNull())
    j = a.join(b, a[key] == F.col("__key"), "left").drop("__key")
    times = F.coalesce(F.col("right_rows"), F.lit(0))
    out = [F.col(key), F.col("left_rows"), times.alias("right_rows"), (F.col("left_rows") * times).alias("join_rows")]
    for measures, other in ((left_measures, times), (right_measures, F.col("left_rows"))):
        for m in measures:
            n, total = F.coalesce(F.col(f"{m.name}_n"), F.lit(0)), F.col(f"{m.name}_sum")
            out += [n.alias(f"{m.name}_n"), total, (n * other).alias(f"{m.name}_join_n"), _exact_product(total, other).alias(f"{m.name}_join_sum")]
    return j.select(*out)


def _exact_product(total: Column, times: Column) -> Column:
    """decimal(30,8) x bigint as decimal(38,8): whole part and decimals apart, as the plain
    product would be rounded to six decimals."""
    whole = F.when(total < 0, F.ceil(total)).otherwise(F.floor(total)).cast("decimal(22,0)")
    rest = (total - whole).cast("decimal(9,8)")
    return ((whole * times).cast("decimal(37,8)") + rest * times).cast("decimal(38,8)")


def rollup_states(states: DataFrame, by: Sequence[Column], sums: Sequence[str]) -> DataFrame:
    """Roll compact states up to coarser groups; every state column is a sum, so it adds."""
    return states.groupBy(*by).agg(*[F.sum(s).alias(s) for s in sums])


def heavy_from_states(states: DataFrame, key: str, rows: str, share_percent: int) -> DataFrame:
    """Keys holding at least share_percent % of all rows, in integers (no rounding at the edge)."""
    total = states.agg(F.sum(rows).alias("__total"))
    return (
        states.join(F.broadcast(total), F.col(rows) * 100 >= F.col("__total") * share_percent)  # one row
        .where(F.col(key).isNotNull())
        .drop("__total")
    )
