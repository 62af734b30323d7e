"""Joins whose condition is a judgement, with an embedding as its cheap proxy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Query vectors compared with all rows in one pass.
BLOCK = 2048


def proxy_scores(rows: DataFrame, queries: DataFrame, key: str, vector: str, low: float, block: int = BLOCK) -> DataFrame:
    """(query, key, score): pairs of a query and another row whose cosine is `low` or more.

    Queries come to the workers in blocks of bounded size, each compared with all rows; no
    pairs are formed but those that score. Null vectors and vectors of length 0 take no part.
    """
    out = None
    own: list[tuple[int, np.ndarray]] = []

    def flush() -> DataFrame | None:
        if not own:
            return None
        ids, q = np.array([i for i, _ in own]), np.stack([v for _, v in own]).astype(np.float64)
        q /= np.linalg.norm(q, axis=1, keepdims=True)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = np.array(b.column(1).to_pylist(), dtype=np.float64).reshape(b.num_rows, -1)
                k = b.column(0).to_numpy(zero_copy_only=False)
                if not len(x):
                    continue
                with np.errstate(invalid="ignore", divide="ignore"):
                    s = q @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
                i, j = np.nonzero((s >= low) & (ids[:, None] != k[None, :]))
                yield pa.record_batch([pa.array(ids[i]), pa.array(k[j]), pa.array(s[i, j])], names=["query", key, "score"])

        return rows.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint"), vector).mapInArrow(scan, f"query bigint, {key} bigint, score double")

    for r in queries.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint"), vector).toLocalIterator():
        v = np.array(r[1], dtype=np.float64)
        if np.linalg.norm(v) > 0:
            own.append((r[0], v))
        if len(own) == block:
            part = flush()
            out, own = part if out is None else out.unionByName(part), []
    part = flush()
    out = part if out is None else out if part is None else out.unionByName(part)
    return out if out is not None else rows.sparkSession.createDataFrame([], f"query bigint, {key} bigint, score double")


def approximate_join(scored: DataFrame, left: DataFrame, right: DataFrame, key: str, high: float, judge: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """(query, key, score, judged): pairs that hold. A score of `high` or more is taken as it is;
    below, the pair is judged on the contents of both rows (columns l_*, r_*)."""
    sure = scored.where(F.col("score") >= high).select("query", key, "score", F.lit(False).alias("judged"))
    names = [c for c in left.columns if c != key]
    x = left.select(F.col(key).alias("query"), *[F.col(c).alias(f"l_{c}") for c in names])
    y = right.select(key, *[F.col(c).alias(f"r_{c}") for c in right.columns if c != key])
    band = scored.where(F.col("score") < high).join(x, "query").join(y, key)

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf[judge(pdf).to_numpy(dtype=bool)][["query", key, "score"]].assign(judged=True)

    return sure.unionByName(band.mapInPandas(ask, f"query bigint, {key} bigint, score double, judged boolean"))


def accuracy_thresholds(labelled: DataFrame, score: str, holds: str, recall: float = 0.8, precision: float = 0.8) -> tuple[float, float]:
    """(low, high) of the band to judge, from scored pairs with known answers: low keeps the
    wanted recall, high is the least score above which the wanted precision is reached."""
    from pyspark.sql import Window

    c = labelled.groupBy(F.col(score).alias("s")).agg(F.count_if(holds).alias("t"), F.count(F.lit(1)).alias("n"))
    down = Window.orderBy(F.col("s").desc()).rowsBetween(Window.unboundedPreceding, 0)  # over distinct scores of a labelled sample
    r = c.withColumn("hit", F.sum("t").over(down)).withColumn("all", F.sum("n").over(down)).withColumn("total", F.sum("t").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    top = r.agg(F.max(F.when(F.col("hit") >= recall * F.col("total"), F.col("s"))).alias("low"), F.min(F.when(F.col("hit") >= precision * F.col("all"), F.col("s"))).alias("high")).first()
    low = top["low"] if top["low"] is not None else -1.0
    return low, max(low, top["high"] if top["high"] is not None else 1.0)
