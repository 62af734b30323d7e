"""From sub-question answers to a direction and a confidence, all as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What an answer counts for; anything else counts as undecided.
ANSWER_VALUE = {"T": 1.0, "F": 0.0, "cannot_determine": 0.5, "MISSING": 0.5}


def answer_value(answer: Column) -> Column:
    out = F.lit(0.5)
    for a, v in ANSWER_VALUE.items():
        if v != 0.5:
            out = F.when(answer == a, F.lit(v)).otherwise(out)
    return out


def related(n_true: Column, n_open: Column, n: Column, force: bool = False) -> Column:
    """struct(direction, confidence) of n related answers, compared in whole halves.

    Mean above one half is TRUE, below is FALSE; a tie, or no answer at all, is undecided
    with confidence 0.5, and FALSE where a decision is forced (no answer stays undecided).
    """
    return related_twice(n_true * 2 + n_open, n, force)


def related_twice(twice: Column, n: Column, force: bool = False) -> Column:
    """The same from 2 * true + open answers."""
    r = twice.cast("double") / (n * 2)
    tie = F.lit(False) if force else F.lit(None).cast("boolean")
    direction = F.when(n == 0, F.lit(None).cast("boolean")).when(twice > n, True).when(twice < n, False).otherwise(tie)
    return F.struct(direction.alias("direction"), F.when(n == 0, F.lit(0.5)).otherwise(F.greatest(r, 1 - r)).alias("confidence"))


def content_meta(cs: Column, ms: Column, theta: float | Column = 0.5) -> Column:
    """struct(direction, confidence): content mean against theta; confidence anchored at one half."""
    c, m = F.coalesce(cs, F.lit(0.5)), F.coalesce(ms, F.lit(0.5))
    return F.struct((c > theta).alias("direction"), (F.lit(0.7) * (F.lit(2.0) * F.abs(c - 0.5)) + F.lit(0.3) * m).alias("confidence"))


def alpha_confidence(cs: Column, ms: Column, alpha: float | Column) -> Column:
    a = F.lit(alpha) if isinstance(alpha, float) else alpha
    return F.lit(0.5) + (a + (F.lit(1.0) - a) * ms) * (cs - F.lit(0.5))


def gate(direction: Column, confidence: Column, tau: float | Column, force: bool = False) -> Column:
    """The direction if forced or confident enough, else undecided."""
    return direction if force else F.when(confidence >= tau, direction)


def score(tag: Column, confidence: Column, known: Column) -> Column:
    """1 to 5 from a stored answer: 1 + 4 r, r the chance of TRUE; null where never evaluated."""
    c = F.coalesce(confidence, F.lit(1.0))
    r = F.when(tag, c).when(~tag, F.lit(1.0) - c).otherwise(F.lit(0.5))
    return F.when(known, F.round(F.lit(1.0) + F.lit(4.0) * r, 4))


def reconcile(text: Column, image: Column) -> Column:
    """Both answers must agree to TRUE; with one of them missing the other one counts."""
    return F.coalesce(text & image, text, image)
