"""References to records that do not exist (yet, or any more).

References and parent records are laid out as one stream of events, hash-partitioned by
key and sorted by (key, time); one linear pass over that order keeps, per key, how many
validity intervals are open and whether any has opened before. So every reference learns
its parent's state at its own time without a range join, and with parents that come and
go several times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainfold.operators.skew import salted_pair


def classify_references(
    refs: DataFrame,
    parents: DataFrame,
    *,
    row_key: Column,
    ref_key: Column,
    at: Column,
    parent_key: Column,
    valid_from: Column,
    valid_to: Column,
    hot_share: float = 0.005,
) -> DataFrame:
    """(row_key, key, at, state) for every reference with a non-null key.

    state is `present` if some parent interval [valid_from, valid_to) holds `at`, else
    `missing` (no parent row at all), `late` (the parent's first interval opens later),
    `deleted` (all opened intervals were closed before), or `undated` (`at` is null
    though the parent exists).

    A null valid_to never closes; a null valid_from, or valid_to <= valid_from, never
    opens, yet its row counts as an existing parent. Null parent keys are ignored,
    repeated references keep one row each, empty inputs give no rows or only `missing`.
    Keys compare by all characters. Only the six given expressions are read, so further
    columns may have any name. Keys with more than `hot_share` of the references are
    dealt over several tasks, with the parent's few events copied to each.
    """
    r = refs.select(row_key.alias("row_key"), ref_key.alias("__key"), at.alias("__at")).where(F.col("__key").isNotNull())
    p = parents.select(parent_key.alias("__key"), valid_from.alias("__from"), valid_to.alias("__to")).where(F.col("__key").isNotNull())
    r, p = salted_pair(r, p, "__key", "row_key", hot_share)
    opens = F.col("__from").isNotNull() & (F.col("__to").isNull() | (F.col("__to") > F.col("__from")))

    def event(at_: Column, delta: int, rank: int) -> Column:
        return F.struct(at_.alias("t"), F.lit(delta).alias("delta"), F.lit(rank).alias("rank"))

    moves = F.filter(
        F.array(
            event(F.lit(None).cast("timestamp"), 0, 0),
            F.when(opens, event(F.col("__from"), 1, 1)),
            F.when(opens & F.col("__to").isNotNull(), event(F.col("__to"), -1, 1)),
        ),
        lambda e: e.isNotNull(),
    )
    kind = r.schema["row_key"].dataType
    events = p.select("__key", "__salt", F.explode(moves).alias("e")).select("__key", "__salt", "e.t", "e.delta", "e.rank", F.lit(None).cast(kind).alias("row_key"))
    stream = r.select("__key", "__salt", F.col("__at").alias("t"), F.lit(0).alias("delta"), F.lit(2).alias("rank"), "row_key").unionByName(events)
    # Null times sort first: the parent's marker (rank 0) before undated references (rank 2).
    w = Window.partitionBy("__key", "__salt").orderBy(F.col("t").asc_nulls_first(), "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = stream.select(
        "row_key",
        F.col("__key").alias("key"),
        F.col("t").alias("at"),
        "rank",
        F.sum("delta").over(w).alias("open"),
        F.max(F.when(F.col("rank") < 2, F.col("rank"))).over(w).alias("seen"),
    )
    state = (
        F.when(F.col("seen").isNull(), "missing")
        .when(F.col("at").isNull(), "undated")
        .when(F.col("open") > 0, "present")
        .when(F.col("seen") == 0, "late")
        .otherwise("deleted")
    )
    return merged.where("rank = 2").select("row_key", "key", "at", state.alias("state"))


def orphan_report(classified: DataFrame, table_name: str) -> DataFrame:
    """Orphans by table, month of arrival (UTC whatever the session's zone, first day; null
    where undated) and state."""
    day = F.date_from_unix_date(F.floor(F.unix_micros("at") / F.lit(86_400_000_000)).cast("int"))
    return (
        classified.where("state <> 'present'")
        .groupBy(F.lit(table_name).alias("table_name"), F.trunc(day, "month").alias("month"), "state")
        .agg(F.count(F.lit(1)).alias("orphans"), F.count_distinct("key").alias("keys"))
    )
