"""The N best items of every group, with a fixed order among ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, group: Column, score: Column, item: Column, n: int) -> DataFrame:
    """(grp, rnk, item): the n rows with the highest score of each group, ties by smaller item.

    Rows with a null group, or a null or NaN score, take no part. Repeated (score, item)
    rows each count. Groups with fewer rows come out whole; empty tables give no rows. Only
    the three expressions are read. The rank filter on row_number lets the optimiser put a
    group limit before and after the shuffle: a group with millions of rows sends at most n
    rows from each task.
    """
    rows = df.select(group.alias("grp"), score.cast("double").alias("score"), item.alias("item"))
    rows = rows.where(F.col("grp").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))
    w = Window.partitionBy("grp").orderBy(F.col("score").desc(), F.col("item").asc_nulls_last())
    return rows.withColumn("rnk", F.row_number().over(w)).where(F.col("rnk") <= n).select("grp", "rnk", "item")
