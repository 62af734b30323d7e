"""Quality of a result against a reference result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainfold.operators.relational import global_rank, running_total


def retrieval(system: DataFrame, truth: DataFrame, key: str, k: int | None, order: Sequence[Column] = ()) -> DataFrame:
    """One row: precision, recall and f1 of the first k of system (all, if k is None).

    Recall counts against min(k, size of truth). An empty answer has precision 1 if nothing
    was to be found; f1 is 0 where either is empty.
    """
    first = system.orderBy(*(order or [F.col(key)])).limit(k) if k is not None else system
    s, t = first.select(key).distinct(), truth.select(key).distinct()
    both = s.withColumn("s", F.lit(1)).join(t.withColumn("t", F.lit(1)), key, "full_outer")
    n = both.agg(F.count("s").alias("ns"), F.count("t").alias("nt"), F.count_if(F.col("s").isNotNull() & F.col("t").isNotNull()).alias("hit"))
    most = F.least(F.lit(k), F.col("nt")) if k is not None else F.col("nt")
    hits = F.least(F.lit(k), F.col("hit")) if k is not None else F.col("hit")
    p = F.when(F.col("ns") == 0, F.when(F.col("nt") == 0, 1.0).otherwise(0.0)).otherwise(F.col("hit").cast("double") / F.col("ns"))
    r = F.when(F.col("nt") == 0, F.lit(0.0)).otherwise(hits.cast("double") / most)
    out = n.select(p.alias("precision"), r.alias("recall"), "ns", "nt")
    f1 = F.when((F.col("ns") == 0) | (F.col("nt") == 0) | (F.col("precision") + F.col("recall") == 0), F.lit(0.0)).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    return out.withColumn("f1", f1).select("precision", "recall", "f1")


def relative_error(s: Column, g: Column) -> Column:
    return F.when(g == 0, F.when(s == 0, F.lit(0.0)).otherwise(F.lit(1.0))).otherwise(F.abs(s - g).cast("double") / F.abs(g))


def quality(error: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + error)


def count_error(system: DataFrame, truth: DataFrame, key: str, n: str) -> DataFrame:
    """One row: mean relative error over the union of keys; keys with 0 on both sides do not count."""
    j = system.select(key, F.col(n).alias("s")).join(truth.select(key, F.col(n).alias("g")), key, "full_outer")
    s, g = F.coalesce("s", F.lit(0)), F.coalesce("g", F.lit(0))
    e = j.select(F.when((s != 0) | (g != 0), relative_error(s, g)).alias("e")).agg(F.coalesce(F.avg("e"), F.lit(0.0)).alias("error"))
    return e.select("error", quality(F.col("error")).alias("quality"))


def _cells(df: DataFrame, x: str, y: str) -> DataFrame:
    """Distinct (x, y) with their numbers: further steps do not grow with the rows."""
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("n"))


def _average_rank(cells: DataFrame, v: str) -> DataFrame:
    per = cells.groupBy(v).agg(F.sum("n").alias("m"))
    return running_total(per, [v], "m", "upto").select(v, (F.col("upto") - (F.col("m") - 1) / 2).alias(f"r{v}"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: rank correlation with average ranks for ties; 0 for fewer than two rows or no spread.

    Works on distinct value pairs; values of unbounded variety should be rounded first.
    """
    c = _cells(df, x, y)
    r = c.join(_average_rank(c, "x"), "x").join(_average_rank(c, "y"), "y")
    n, sx, sy = F.sum("n"), F.sum(F.col("n") * F.col("rx")), F.sum(F.col("n") * F.col("ry"))
    sxx, syy, sxy = (F.sum(F.col("n") * F.col(a) * F.col(b)) for a, b in (("rx", "rx"), ("ry", "ry"), ("rx", "ry")))
    m = r.agg(n.alias("n"), (n * sxy - sx * sy).alias("cov"), (n * sxx - sx * sx).alias("vx"), (n * syy - sy * sy).alias("vy"))
    ok = (F.col("n") > 1) & (F.col("vx") > 0) & (F.col("vy") > 0)
    return m.select(F.when(ok, F.round(F.col("cov") / F.sqrt(F.col("vx")) / F.sqrt(F.col("vy")), 6)).otherwise(F.lit(0.0)).alias("rho"))


def kendall(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: Kendall's tau-b, exact, in n log m steps for m distinct values of y.

    Two values of y first differ at one bit of their ranks. So at each bit, rows are grouped by
    the bits above; those with a one count the rows with a zero before and behind them in x.
    """
    c = _cells(df, x, y)
    ranks = global_rank(c.select("y").distinct(), ["y"], "r")
    levels = max(1, (ranks.count() - 1).bit_length())
    bits = c.join(ranks, "y").withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    one = F.col("r").bitwiseAND(F.lit(1)) == 1
    g = bits.select("bit", F.expr("shiftright(r, bit)").alias("r"), "x", "n").select("bit", F.shiftright("r", 1).alias("high"), "x", F.when(one, F.col("n")).otherwise(0).alias("n1"), F.when(one, 0).otherwise(F.col("n")).alias("n0"))
    g = g.groupBy("bit", "high", "x").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    g = running_total(g, ["bit", "high", "x"], "n0", "upto")
    ends = g.groupBy("bit", "high").agg(F.max("upto").alias("last"), F.sum("n0").alias("all0"))
    g = g.join(ends, ["bit", "high"]).withColumn("before", F.col("upto") - F.col("n0") - (F.col("last") - F.col("all0")))
    main = g.agg(F.sum(F.col("n1") * F.col("before")).alias("con"), F.sum(F.col("n1") * (F.col("last") - F.col("upto"))).alias("dis"))
    main = main.join(F.broadcast(c.agg(F.sum("n").alias("n"))), F.lit(True))  # one row each
    tie = lambda v: c.groupBy(v).agg(F.sum("n").alias("m")).agg(F.sum(F.col("m") * (F.col("m") - 1)).alias(f"t{v}"))
    one = main.join(F.broadcast(tie("x")), F.lit(True)).join(F.broadcast(tie("y")), F.lit(True))  # one row each
    pairs = F.col("n") * (F.col("n") - 1)
    d = (pairs - F.col("tx")).cast("double") * (pairs - F.col("ty"))
    num = 2 * (F.col("con") - F.col("dis"))
    return one.select(F.when((F.col("n") > 1) & (d > 0), F.round(num / F.sqrt(d.cast("double")), 6)).otherwise(F.lit(0.0)).alias("tau"))


def mean_error_and_correlation(df: DataFrame, score: Column, truth: Column, *by: str) -> DataFrame:
    """(by, mae, pearson), rounded to six decimals; pearson is 0 without spread on either side."""
    d = df.select(*by, score.cast("double").alias("s"), truth.cast("double").alias("t")).where("s IS NOT NULL AND t IS NOT NULL")
    n, ss, st = F.count(F.lit(1)), F.sum("s"), F.sum("t")
    m = d.groupBy(*by).agg(F.avg(F.abs(F.col("s") - F.col("t"))).alias("mae"), (n * F.sum(F.col("s") * F.col("t")) - ss * st).alias("cov"), (n * F.sum(F.col("s") * F.col("s")) - ss * ss).alias("vs"), (n * F.sum(F.col("t") * F.col("t")) - st * st).alias("vt"))
    r = F.when((F.col("vs") > 1e-9) & (F.col("vt") > 1e-9), F.round(F.col("cov") / F.sqrt("vs") / F.sqrt("vt"), 6)).otherwise(F.lit(0.0))
    return m.select(*by, F.round("mae", 6).alias("mae"), r.alias("pearson"))


def best(grid: DataFrame, by: str, value: str, largest: bool = False) -> DataFrame:
    """The grid's best row by `value`; ties: the smallest `by`."""
    v = F.col(value)
    return grid.orderBy(v.desc() if largest else v.asc(), by).limit(1)
