"""Where results and logs go."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_log(rows: DataFrame, folder: str) -> None:
    """Adds rows to a log of CSV files, each with a header (call, answer and trace logs)."""
    flat = rows.select(*[F.to_json(c).alias(c) if k.startswith(("array", "struct", "map")) else F.col(c) for c, k in rows.dtypes])
    flat.write.mode("append").csv(folder, header=True, escape='"')


def read_log(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.csv(folder, schema=schema, header=True, escape='"', multiLine=True)


def write_result(rows: DataFrame, folder: str, columns: Sequence[str]) -> None:
    """A query's result as CSV with exactly these columns; a missing one raises."""
    rows.select(*columns).write.mode("overwrite").csv(folder, header=True, escape='"')


def as_json(metrics: Mapping[str, Mapping[str, object]]) -> str:
    return json.dumps(metrics, indent=2, sort_keys=True, default=float)


def as_markdown(metrics: Mapping[str, Mapping[str, object]]) -> str:
    """One line per query, one column per measure; - where a query lacks it."""
    names = sorted({m for row in metrics.values() for m in row})
    show = lambda v: "-" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = ["| query | " + " | ".join(names) + " |", "|---" * (len(names) + 1) + "|"]
    return "\n".join(lines + [f"| {q} | " + " | ".join(show(row.get(m)) for m in names) + " |" for q, row in metrics.items()])


def as_text(metrics: Mapping[str, Mapping[str, object]]) -> str:
    width = max((len(q) for q in metrics), default=0)
    return "\n".join(f"{q:<{width}}  " + "  ".join(f"{m}={v:.4f}" if isinstance(v, float) else f"{m}={v}" for m, v in row.items()) for q, row in metrics.items())


def class_list(cells: DataFrame, by: str = "class") -> DataFrame:
    """(class, n, place): classes by falling number, ties by name."""
    from pyspark.sql import Window

    n = cells.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.col("n").desc(), by)))  # one row per class
