"""Relational operators of the engine: order, pairs, counts, classes, deduplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainfold.session import written


def global_rank(df: DataFrame, order: Sequence[str], name: str = "rn") -> DataFrame:
    """Adds the 0-based place of each row in a total order, without sorting in one task.

    Rows are parted by range, ranked within each part, and moved up by the sizes of the
    parts before; only one count per part is gathered. The parts are stored first, as a
    second pass over a sampled range partitioning could differ.
    """
    parts = written(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    before = sizes.withColumn("__before", F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))).select("__part", F.coalesce("__before", F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    ranked = parts.withColumn("__within", within)
    return ranked.join(before, "__part").withColumn(name, F.col("__before") + F.col("__within") - 1).drop("__part", "__within", "__before")


def running_total(df: DataFrame, order: Sequence[str], value: str, name: str) -> DataFrame:
    """Adds the sum of `value` over this row and all before it in a total order, parted by
    range as in global_rank: each part adds the sums of the parts before."""
    parts = written(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    sums = parts.groupBy("__part").agg(F.sum(value).alias("__sum"))
    before = sums.select("__part", F.coalesce(F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    within = F.sum(value).over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return parts.withColumn("__within", within).join(before, "__part").withColumn(name, F.col("__before") + F.col("__within")).drop("__part", "__within", "__before")


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Adds `mark`, whose order is the same shuffle of the keys everywhere."""
    return df.withColumn("mark", F.md5(F.concat(F.col(key), F.lit(f"-{seed}"))))


def chunks(df: DataFrame, key: str, seed: int, size: int) -> DataFrame:
    """(key, chunk): chunks of equal size of the seeded shuffle."""
    ranked = global_rank(shuffled(df.select(key), key, seed), ["mark", key])
    return ranked.select(key, F.floor(F.col("rn") / size).cast("bigint").alias("chunk"))


def sample_fraction(df: DataFrame, key: str, seed: int, fraction: float) -> DataFrame:
    """The first max(1, round(fraction * n)) keys of the seeded shuffle."""
    ranked = global_rank(shuffled(df.select(key), key, seed), ["mark", key])
    n = ranked.count()
    return ranked.where(F.col("rn") < min(n, max(1, round(fraction * n)))).select(key)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def pair_rows(rows: DataFrame, group: str, key: str, tag: str, conf: str, same: bool) -> DataFrame:
    """(group, rid1, rid2, pair_conf, rn): pairs of a group whose tags agree (or differ).

    The judgement of a pair follows from one judgement per row, so a semantic join is a
    plain join. rn counts a row's partners: ordering by it spreads the pairs over rows.
    Meant for groups of bounded size; for counts over any group use pair_counts.
    """
    a = rows.select(group, F.col(key).alias("rid1"), F.col(tag).alias("t1"), F.col(conf).alias("c1")).where("t1 IS NOT NULL")
    b = rows.select(F.col(group).alias("__g"), F.col(key).alias("rid2"), F.col(tag).alias("t2"), F.col(conf).alias("c2")).where("t2 IS NOT NULL")
    hit = F.col("t1") == F.col("t2") if same else F.col("t1") != F.col("t2")
    j = a.join(b, (F.col(group) == F.col("__g")) & (F.col("rid1") < F.col("rid2")) & hit)
    out = j.select(group, "rid1", "rid2", F.least(F.coalesce("c1", F.lit(0.0)), F.coalesce("c2", F.lit(0.0))).alias("pair_conf")).distinct()
    return out.withColumn("rn", F.row_number().over(Window.partitionBy(group, "rid1").orderBy("rid2")))


def first_pairs(rows: DataFrame, group: str, key: str, tag: str, conf: str | None, same: bool, most: int = 10) -> DataFrame:
    """(group, rid1, rid2, pair_conf, rn, place): the first `most` rows of pair_rows in every
    group, by pair_conf (if conf is given; descending), rn, rid1 and rid2, for groups of any size.

    Pairs are not listed. `edge` is the highest confidence at which a group has `most` pairs:
    fewer lie above it, and of those at it a row's partners stand at successive places of
    their class (tag, confidence), so each row's next ones are looked up by place. Only the
    `most` rows with the nearest partners can give one of the first pairs. Keys are unique.
    """
    c = F.coalesce(F.col(conf), F.lit(0.0)) if conf else F.lit(0.0)
    r = written(rows.select(F.col(group).alias("g"), F.col(key).alias("rid"), F.col(tag).alias("tag"), c.alias("c")).where("g IS NOT NULL AND rid IS NOT NULL AND tag IS NOT NULL"), "pair_rows")
    by_c = r.groupBy("g", "c").agg(F.count_if("tag").alias("t"), F.count_if(~F.col("tag")).alias("f"))
    down = Window.partitionBy("g").orderBy(F.col("c").desc())
    by_c = by_c.withColumn("t", F.sum("t").over(down)).withColumn("f", F.sum("f").over(down))
    pairs = F.expr("t * (t - 1) div 2 + f * (f - 1) div 2" if same else "t * f")
    edges = by_c.groupBy("g").agg(F.coalesce(F.max(F.when(pairs >= most, F.col("c"))), F.min("c")).alias("edge"))
    up = Window.partitionBy("g").orderBy("rid").rowsBetween(Window.unboundedPreceding, 0)
    r = r.join(edges, "g")
    for kind, hit in (("all", F.lit(True)), ("ge", F.col("c") >= F.col("edge")), ("eq", F.col("c") == F.col("edge"))):
        for name, side in (("t", F.col("tag")), ("f", ~F.col("tag"))):
            r = r.withColumn(f"{kind}_{name}", F.sum((hit & side).cast("bigint")).over(up))
    own = lambda kind: F.when(F.col("tag"), F.col(f"{kind}_t")).otherwise(F.col(f"{kind}_f"))
    met = own if same else lambda kind: F.when(F.col("tag"), F.col(f"{kind}_f")).otherwise(F.col(f"{kind}_t"))
    at = F.col("c") == F.col("edge")
    placed = written(r.where("c >= edge").select(
        "g", "rid", "c", "edge", "tag", (F.col("tag") if same else ~F.col("tag")).alias("met"), own("all").alias("of_all"), met("all").alias("met_all"),
        F.when(at, "ge").otherwise("eq").alias("kind"), F.when(at, met("ge")).otherwise(met("eq")).alias("after"), own("ge").alias("ge"), own("eq").alias("eq")), "pair_places")
    places = F.array(F.struct(F.lit("ge").alias("kind"), F.col("ge").alias("after")), F.when(at, F.struct(F.lit("eq").alias("kind"), F.col("eq").alias("after"))))
    y = placed.select("g", F.col("tag").alias("met"), F.col("rid").alias("rid2"), F.col("of_all").alias("of2"), F.explode(F.filter(places, lambda x: x.isNotNull())).alias("x"))
    y = y.select("g", "met", "rid2", "of2", "x.kind", F.col("x.after").alias("place"))
    x = placed.select("g", "met", "kind", "after", "met_all", "edge", F.col("rid").alias("rid1"))
    rn = (F.col("of2") - F.col("met_all")).alias("rn")
    near = x.withColumn("place", F.col("after") + 1).join(y, ["g", "met", "kind", "place"]).select(*x.columns, rn)
    near = near.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("rn", "rid1"))).where(F.col("n") <= most).drop("n", "rn")
    steps = near.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(most)))).withColumn("place", F.col("after") + F.col("step"))
    out = steps.join(y, ["g", "met", "kind", "place"]).select("g", "rid1", "rid2", F.col("edge").alias("pair_conf"), rn)
    above = placed.where("c > edge")
    a = above.select("g", "met", "met_all", F.col("rid").alias("rid1"), F.col("c").alias("c1"))
    b = above.select("g", F.col("tag").alias("met"), F.col("rid").alias("rid2"), F.col("of_all").alias("of2"), F.col("c").alias("c2"))
    few = a.join(b, ["g", "met"]).where("rid1 < rid2").select("g", "rid1", "rid2", F.least("c1", "c2").alias("pair_conf"), rn)
    order = Window.partitionBy("g").orderBy(F.col("pair_conf").desc(), "rn", "rid1", "rid2")
    out = out.unionByName(few).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    return out.select(F.col("g").alias(group), "rid1", "rid2", "pair_conf", "rn", "place")


def pair_partners(rows: DataFrame, group: str, key: str, tag: str) -> DataFrame:
    """(group, key, tag, n_same, n_opposite): every row with its class and the numbers of its
    partners. All pairs of a group follow from it: those of one class, those of two classes."""
    r = rows.select(group, key, tag).where(F.col(group).isNotNull() & F.col(tag).isNotNull())
    n = r.groupBy(group).agg(F.count_if(F.col(tag)).alias("__t"), F.count_if(~F.col(tag)).alias("__f"))
    t, f = F.col("__t"), F.col("__f")
    return r.join(n, group).select(group, key, tag, (F.when(F.col(tag), t).otherwise(f) - 1).alias("n_same"), F.when(F.col(tag), f).otherwise(t).alias("n_opposite"))


def pair_counts(rows: DataFrame, group: str, tag: str) -> DataFrame:
    """(group, n_same, n_opposite): numbers of pairs, from one count per group and answer."""
    g = rows.groupBy(group).agg(F.count_if(F.col(tag)).alias("t"), F.count_if(~F.col(tag)).alias("f"))
    t, f = F.col("t"), F.col("f")
    two = lambda n: F.expr(f"({n} * ({n} - 1)) div 2")
    return g.select(group, (two("t") + two("f")).alias("n_same"), (t * f).alias("n_opposite"))


def tri_state_counts(df: DataFrame, tag: str, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count_if(F.col(tag)).alias("n_true"),
        F.count_if(~F.col(tag)).alias("n_false"),
        F.count_if(F.col(tag).isNull()).alias("n_open"),
        F.count(F.lit(1)).alias("n"),
    )


def ratio(n: Column, of: Column, digits: int = 6) -> Column:
    """n / of, rounded; 0 where of is 0."""
    return F.when(of == 0, F.lit(0.0)).otherwise(F.round(n.cast("double") / of, digits))


def nearest_rank(df: DataFrame, by: Sequence[str], value: str, q: float, name: str) -> DataFrame:
    """Per group the value at place floor(q * (n - 1)) of the sorted values; nulls do not count."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*by).orderBy(value)
    placed = counts.withColumn("__upto", F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__all", F.sum("__n").over(Window.partitionBy(*by)))
    at = F.floor(F.lit(float(q)) * (F.col("__all") - 1))
    hit = placed.where((F.col("__upto") > at) & (F.col("__upto") - F.col("__n") <= at))
    return hit.select(*by, F.col(value).alias(name))
