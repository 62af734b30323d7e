"""Mixing sources to target shares of all tokens, with capped repetition.

Every document has a soft membership in the sources: its label where it has one, else the
posteriors of a classifier counted from all labelled documents. A rate per document (its
expected number of copies) is fitted by projected-gradient least squares: of all rates
within the caps whose expected tokens per source meet the targets, those nearest to 1. The
gradients are summed first and projected last, so a rate follows from the sum alone, which
has one number per source; steps are scaled by the curvature. Labelled documents of one
source keep equal rates and move as one state; only unlabelled ones are passed over.
Whole copies are then chosen such that each source's tokens meet those of its rates.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainfold.llm import textvec as tv
from grainfold.llm import tokens
from grainfold.session import written


@dataclass(frozen=True)
class Mix:
    """buckets: hashed words of the classifier, fewer if sources x buckets would exceed `cells`,
    the fixed size of the model that goes to the workers; damping: see posteriors; close: the
    descent ends when the sources are within this share of the total, or when no step brings
    them one percent nearer; total: wanted tokens (None: the most at which every share can be met); block:
    documents of one source that are rounded together; path: the tokenizer's file."""

    buckets: int = 4096
    cells: int = 4_194_304
    damping: float = 0.75
    close: float = 1e-7
    total: float | None = None
    block: int = 20_000
    path: str | None = None


@dataclass(frozen=True)
class Mixture:
    rates: DataFrame
    shares: DataFrame


def _features(texts: list[str], buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(begin, end, hashed words, words per text) by slices of the texts."""
    for a, b in tv.slices(texts):
        words, counts = tv.Batch(texts[a:b]).words()
        yield a, b, (words % np.uint64(buckets)).astype(np.int64), counts


def class_counts(docs: DataFrame, m: Mix) -> DataFrame:
    """(cls, bucket, n): hashed words by source over all labelled documents; bucket -1 counts documents."""
    schema = pa.schema([("cls", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            cls, texts = np.array(batch.column(0).to_pylist(), dtype=np.int64), batch.column(1).to_pylist()
            for a, b, f, counts in _features(texts, m.buckets):
                owner = np.repeat(cls[a:b], counts)
                for c in np.unique(cls[a:b]):
                    own = total.setdefault(int(c), np.zeros(m.buckets + 1, dtype=np.int64))
                    own[:-1] += np.bincount(f[owner == c], minlength=m.buckets)
                    own[-1] += int((cls[a:b] == c).sum())
        for c, n in total.items():
            hit = np.flatnonzero(n)
            yield pa.record_batch([pa.array(np.full(len(hit), c, np.int32)), pa.array(np.where(hit == m.buckets, -1, hit).astype(np.int32)), pa.array(n[hit])], schema=schema)

    return docs.mapInArrow(count, "cls int, bucket int, n bigint").groupBy("cls", "bucket").agg(F.sum("n").alias("n"))


def fit_classifier(docs: DataFrame, sources: int, m: Mix) -> np.ndarray:
    """Log weights (sources x (buckets + 1)), naive Bayes with add-one smoothing; the last column is the prior.

    What comes to the driver has a fixed size: sources x buckets counts.
    """
    n = np.zeros((sources, m.buckets + 1))
    for r in class_counts(docs, m).toLocalIterator():
        n[r["cls"], r["bucket"]] = r["n"]
    words = n[:, :-1] + 0.5
    prior = n[:, -1]
    with np.errstate(divide="ignore"):
        return np.column_stack([np.log(words / words.sum(1, keepdims=True)), np.log(prior / max(prior.sum(), 1.0))])


def posteriors(texts: list[str], weights: np.ndarray, m: Mix) -> np.ndarray:
    """Source posteriors (texts x sources). The words' evidence is divided by a power of their
    number, as the words of a text do not come independently: undamped, it is overconfident."""
    out = np.zeros((len(texts), len(weights)))
    for a, b, f, counts in _features(texts, m.buckets):
        score = np.tile(weights[:, -1], (b - a, 1))
        full = counts > 0
        if len(f):
            begins = (np.cumsum(counts) - counts)[full]
            for c in range(len(weights)):
                score[full, c] += np.add.reduceat(weights[c, f], begins) / counts[full] ** m.damping
        score -= score.max(1, keepdims=True)
        p = np.exp(score)
        out[a:b] = p / p.sum(1, keepdims=True)
    return out


def _rates(pull: np.ndarray, cap: np.ndarray) -> np.ndarray:
    """Rates after the summed gradients `pull`, projected to [0, cap]."""
    return np.clip(1.0 - pull, 0.0, cap)


def round_rates(rate: np.ndarray, size: np.ndarray, cap: int) -> np.ndarray:
    """Whole copies between 0 and cap whose tokens come as near to those of the rates as single
    changes and exchanges of two documents bring them. Input in a fixed order.

    The lag of the copies behind the rates is carried from document to document first, the
    largest ones leading.
    """
    k = np.minimum(np.floor(rate), cap).astype(np.int64)
    lag = 0.0
    for i in np.argsort(-size, kind="stable"):
        lag += (rate[i] - k[i]) * size[i]
        if 2 * lag >= size[i] > 0 and k[i] < cap:
            k[i] += 1
            lag -= size[i]
    lag = float((rate * size).sum() - (k * size).sum())
    while True:
        add, drop = np.flatnonzero((k < cap) & (size > 0)), np.flatnonzero((k > 0) & (size > 0))
        moves = [(abs(lag - size[i]), i, -1) for i in add[np.abs(lag - size[add]).argsort(kind="stable")[:1]]]
        moves += [(abs(lag + size[i]), -1, i) for i in drop[np.abs(lag + size[drop]).argsort(kind="stable")[:1]]]
        if len(add) and len(drop):
            order = drop[np.argsort(size[drop], kind="stable")]
            wanted = size[add] - lag  # what should go for each that may come
            at = np.searchsorted(size[order], wanted)
            for near in (np.clip(at, 0, len(order) - 1), np.clip(at - 1, 0, len(order) - 1)):
                off = np.abs(wanted - size[order[near]])
                i = int(off.argmin())
                moves.append((off[i], add[i], order[near[i]]))
        best = min(moves, key=lambda m: m[0], default=None)
        if best is None or best[0] >= abs(lag) - 1e-6:
            return k
        for i, step in ((best[1], 1), (best[2], -1)):
            if i >= 0:
                k[i] += step
                lag -= step * size[i]


def mix(docs: DataFrame, doc_id: Column, source: Column, text: Column, targets: DataFrame, m: Mix = Mix()) -> Mixture:
    """Rates and shares of the mixture.

    targets: (source, target_share, max_repeats). Shares of null or negative size count as
    0; shares of sources without any document are left out and the rest scaled to 1; a
    source in several rows counts with their summed share and smallest cap. Documents
    whose source is null, blank or not among the targets get the classifier's posteriors
    (the label's sources if there is nothing to learn from: equal shares of all).

    rates: (doc_id, source, tokens, rate, repeats): source is the label, or the likeliest
    source; repeats are whole copies, never above its cap, the same however the rows are
    partitioned. Null and empty texts have no tokens and do not appear.
    shares: one row per target: the wanted share, the shares of the rates and of the whole
    copies (an unlabelled document counts by its posteriors), the tokens wanted, reached and
    at hand, and its documents. Empty tables give no rates and shares of 0.
    """
    spark = docs.sparkSession
    path = m.path or tokens.default_path()
    t = targets.groupBy("source").agg(F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("share"), F.min(F.coalesce("max_repeats", F.lit(1))).alias("cap"))
    table = sorted(t.where("source IS NOT NULL").collect(), key=lambda r: r["source"])  # the answer has a row for each
    names = [r["source"] for r in table]
    want, cap = np.array([float(r["share"]) for r in table]), np.array([max(0, int(r["cap"])) for r in table], dtype=float)
    S = len(names)
    empty = spark.createDataFrame([], "doc_id bigint, source string, tokens bigint, rate double, repeats int")
    if not S:
        return Mixture(empty, spark.createDataFrame([], "source string, target_share double, expected_share double, actual_share double, wanted_tokens double, reached_tokens double, tokens double, docs bigint"))
    m = replace(m, buckets=max(16, min(m.buckets, m.cells // S)))

    # One short row per target, all of which the driver holds already: small enough to broadcast.
    index = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "__name string, cls int")
    d = docs.select(doc_id.cast("bigint").alias("doc_id"), source.alias("__source"), text.alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL AND text <> ''")
    d = d.join(F.broadcast(index), F.col("__source") == F.col("__name"), "left").select("doc_id", F.coalesce("cls", F.lit(-1)).alias("cls"), "text")
    weights = fit_classifier(d.where("cls >= 0").select("cls", "text"), S, m)
    if not np.isfinite(weights[:, -1]).any():
        weights[:, -1] = 0.0
    model = spark.sparkContext.broadcast(weights)  # at most `cells` numbers
    schema = pa.schema([("doc_id", pa.int64()), ("cls", pa.int32()), ("tokens", pa.int64()), ("p", pa.list_(pa.float64()))])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = tokens.encoding(path)
        for batch in batches:
            cls, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            n = [len(e.encode_ordinary(x)) for x in texts]
            soft = [i for i, c in enumerate(cls) if c < 0]
            p: list = [None] * len(cls)
            for i, row in zip(soft, posteriors([texts[i] for i in soft], model.value, m) if soft else ()):
                p[i] = row.tolist()
            yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(cls, pa.int32()), pa.array(n, pa.int64()), pa.array(p, pa.list_(pa.float64()))], schema=schema)

    state = written(d.mapInArrow(measure, "doc_id bigint, cls int, tokens bigint, p array<double>"), "mix")
    hard = np.zeros(S)
    for r in state.where("cls >= 0").groupBy("cls").agg(F.sum("tokens").alias("n")).collect():
        hard[r["cls"]] = r["n"]
    soft = state.where("cls < 0").select("tokens", "p")
    any_soft, whole = not soft.isEmpty(), S <= 200

    def soft_sums(pull: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Expected tokens by source of the unlabelled documents, and how they change with the
        pull (for many sources its diagonal only); without a pull: the tokens at hand."""

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, slope = np.zeros(S), np.zeros((S, S) if whole else S)
            for batch in batches:
                if batch.num_rows:
                    p = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, S)
                    n = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
                    raw, most = (np.ones(len(n)), np.ones(len(n))) if pull is None else (1.0 - p @ pull, p @ cap)
                    total += (np.clip(raw, 0.0, most) * n) @ p
                    q = p * (n * ((raw >= 0) & (raw <= most)))[:, None]
                    slope += q.T @ p if whole else (q * p).sum(0)
            i, j = np.nonzero(slope) if whole else (np.arange(S), np.arange(S))
            yield pa.record_batch([pa.array(np.append(np.arange(S), i), pa.int32()), pa.array(np.append(np.full(S, -1), j), pa.int32()), pa.array(np.append(total, slope[i, j] if whole else slope))], names=["i", "j", "v"])

        total, slope = np.zeros(S), np.zeros((S, S))
        if any_soft:
            for r in soft.mapInArrow(part, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
                if r["j"] < 0:
                    total[r["i"]] = r["v"]
                else:
                    slope[r["i"], r["j"]] = r["v"]
        return total, slope

    at_hand = hard + soft_sums(None)[0]
    usable = (at_hand > 0) & (cap > 0)
    share = np.where(usable, want, 0.0)
    share = share / share.sum() if share.sum() > 0 else share
    # Labelled tokens alone bound the total: posteriors only add to them.
    base = np.where(hard > 0, hard, at_hand)
    bound = [cap[i] * base[i] / share[i] for i in range(S) if share[i] > 0]
    total = m.total if m.total is not None else (min(bound) if bound else 0.0)

    def look(pull: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        got, slope = soft_sums(pull)
        error = hard * _rates(pull, cap) + got - share * total
        moves = ((1.0 - pull < cap) | (error > 0)) & ((1.0 - pull > 0) | (error < 0))
        slope = slope + np.diag(hard * moves)
        slope[np.diag_indices(S)] = np.maximum(slope.diagonal(), 0.05 * at_hand + 1e-9)
        return float(np.linalg.norm(error)), error, slope

    pull, damp = np.where(at_hand > 0, 1.0 - np.minimum(cap, share * total / np.maximum(base, 1.0)), 1.0), 1.0
    off, error, slope = look(pull)
    while off > m.close * max(total, 1.0) and damp > 0.02:
        trial = pull + damp * np.linalg.solve(slope, error)
        found = look(trial)
        if found[0] < 0.99 * off:
            pull, damp, (off, error, slope) = trial, min(1.0, 2 * damp), found
        else:
            damp /= 2
    pull = np.round(pull, 9)  # sums of fractions differ by the order of partitions

    final = pa.schema([("doc_id", pa.int64()), ("cls", pa.int32()), ("soft", pa.bool_()), ("tokens", pa.int64()), ("rate", pa.float64()), ("p", pa.list_(pa.float64()))])

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _rates(pull, cap)
        for batch in batches:
            cls = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            loose = cls < 0
            r = own[np.maximum(cls, 0)]
            if loose.any():
                p = batch.column(3).filter(pa.array(loose)).flatten().to_numpy(zero_copy_only=False).reshape(-1, S)
                r[loose], cls[loose] = _rates(p @ pull, p @ cap), p.argmax(1)
            yield pa.record_batch([batch.column(0), pa.array(cls.astype(np.int32)), pa.array(loose), batch.column(2), pa.array(np.round(r, 9)), batch.column(3)], schema=final)

    rated = state.mapInArrow(rate, "doc_id bigint, cls int, soft boolean, tokens bigint, rate double, p array<double>")
    sizes = rated.groupBy("cls", "soft").agg(F.ceil(F.count(F.lit(1)) / m.block).cast("int").alias("blocks"))
    dealt = rated.join(F.broadcast(sizes), ["cls", "soft"]).withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks"))  # two rows a source at most

    def whole_copies(_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        k = round_rates(pdf["rate"].to_numpy(), pdf["tokens"].to_numpy(), int(cap[pdf["cls"].iloc[0]]))
        return pdf[["doc_id", "cls", "tokens", "rate"]].assign(repeats=k.astype(np.int32), p=pdf["p"])

    copies = written(dealt.groupBy("cls", "soft", "block").applyInPandas(whole_copies, "doc_id bigint, cls int, tokens bigint, rate double, repeats int, p array<double>"), "rates")
    label = spark.createDataFrame([(i, n, float(share[i]), float(share[i] * total)) for i, n in enumerate(names)], "cls int, source string, target_share double, wanted_tokens double")
    rates = copies.join(F.broadcast(label), "cls").select("doc_id", "source", "tokens", "rate", "repeats")
    members = F.when(F.col("p").isNull(), F.array(F.struct(F.col("cls").alias("cls"), F.lit(1.0).alias("w")))).otherwise(F.transform("p", lambda w, i: F.struct(i.alias("cls"), w.alias("w"))))
    each = copies.withColumn("m", F.explode(members)).select("m.cls", (F.col("tokens") * F.col("m.w")).alias("t"), "rate", "repeats", F.col("p").isNull().alias("own"))
    by = each.groupBy("cls").agg(F.sum(F.col("t") * F.col("rate")).alias("e"), F.sum(F.col("t") * F.col("repeats")).alias("reached_tokens"), F.sum("t").alias("tokens"), F.count_if("own").alias("docs"))
    sums = by.agg(F.sum("e").alias("all_e"), F.sum("reached_tokens").alias("all_a"))
    ratio = lambda x, y: F.when(F.col(y) > 0, F.coalesce(F.col(x), F.lit(0)) / F.col(y)).otherwise(F.lit(0.0))
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    shares = label.join(by, "cls", "left").join(F.broadcast(sums)).select(  # sums: one row
        "source", "target_share", ratio("e", "all_e").alias("expected_share"), ratio("reached_tokens", "all_a").alias("actual_share"), "wanted_tokens", zero("reached_tokens"), zero("tokens"), zero("docs")
    )
    return Mixture(rates, shares)
