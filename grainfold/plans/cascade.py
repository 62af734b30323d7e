"""The tiered cascade: cheap steps first, a row leaves once its tree is settled."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainfold.functions.logic import KillRates, Tree, fold, needed
from grainfold.functions.verdicts import gate
from grainfold.plans.judges import AnswerSource, WordQuestions
from grainfold.plans.specs import CascadeConfig
from grainfold.session import written


@dataclass(frozen=True)
class CascadePlan:
    tree: Tree
    kinds: Mapping[str, str]
    config: CascadeConfig
    order: Sequence[str] | None = None
    #: Leaves answered by the negation of another predicate: leaf -> the predicate to judge.
    negates: Mapping[str, str] = field(default_factory=dict)

    @property
    def leaves(self) -> list[str]:
        return list(self.order or dict.fromkeys(self.tree.leaves()))

    def steps(self) -> int:
        return max(len(self.config.route(self.kinds[n])) for n in self.leaves)

    def judged(self, leaf: str) -> str:
        return self.negates.get(leaf, leaf)

    def direction(self, leaf: str, direction: Column, force: bool) -> Column:
        """A negated leaf's answer is the other one; it is judged unforced, and what stays
        undecided is forced to FALSE only then."""
        if leaf not in self.negates:
            return direction
        return F.coalesce(~direction, F.lit(False)) if force else ~direction

    def known(self) -> dict[str, Column]:
        return {n: F.col(f"known_{n}") for n in self.leaves}


def _prepared(df: DataFrame, plan: CascadePlan) -> DataFrame:
    for n in plan.leaves:
        for col, null in ((f"known_{n}", F.lit(None).cast("boolean")), (f"start_{n}", F.lit(0)), (f"conf_{n}", F.lit(None).cast("double")), (f"tier_{n}", F.lit(None).cast("int"))):
            if col not in df.columns:
                df = df.withColumn(col, null)
    return df


def one_plan(df: DataFrame, plan: CascadePlan, source: WordQuestions) -> DataFrame:
    """The whole cascade as one lazy plan, for judges that are column expressions.

    Adds known_, conf_, tier_ per leaf, calls_t<tier> (judgements made at each tier) and
    `answer`, the root. A judgement is only counted, and only used, where it is needed.
    To filter on an answer, store the result first (session.written) or order by it: a
    filter pushed below the steps would repeat the whole cascade inside itself.
    """
    # The text in lower case and each count of answers are columns of their own, so that
    # they are computed once however often the verdict refers to them.
    df = _prepared(df, plan).withColumn("__low", F.lower(F.col(source.text)))
    tiers = sorted({s.tier for n in plan.leaves for s in plan.config.route(plan.kinds[n])})
    for t in tiers:
        df = df.withColumn(f"calls_t{t}", F.lit(0))
    for s in range(plan.steps()):
        for n in plan.leaves:
            route = plan.config.route(plan.kinds[n])
            if s >= len(route):
                continue
            step, force = route[s], s == len(route) - 1
            todo = needed(plan.tree, plan.known())[n] & (F.lit(s) >= F.col(f"start_{n}"))
            df = df.withColumn("__todo", todo).withColumn("__twice", F.when(F.col("__todo"), source.twice(plan.judged(n), step.tier, F.col("__low"))))
            df = df.withColumn("__v", F.when(F.col("__todo"), source.verdict(plan.judged(n), step, force and n not in plan.negates, F.col("__twice"))))
            settled = gate(plan.direction(n, F.col("__v.direction"), force), F.col("__v.confidence"), F.lit(plan.config.tau(n, plan.kinds[n], step.tier)), force)
            df = df.withColumns({
                f"known_{n}": F.when(F.col("__todo"), settled).otherwise(F.col(f"known_{n}")),
                f"conf_{n}": F.when(F.col("__todo"), F.col("__v.confidence")).otherwise(F.col(f"conf_{n}")),
                f"tier_{n}": F.when(F.col("__todo"), F.lit(step.tier)).otherwise(F.col(f"tier_{n}")),
                f"calls_t{step.tier}": F.col(f"calls_t{step.tier}") + F.col("__todo").cast("int"),
            })
    return df.withColumn("answer", fold(plan.tree, plan.known())).drop("__todo", "__twice", "__v", "__low")


@dataclass(frozen=True)
class StagedResult:
    state: DataFrame
    trace: DataFrame | None
    calls: int


def staged(df: DataFrame, key: str, content: DataFrame, plan: CascadePlan, source: AnswerSource) -> StagedResult:
    """The same cascade step by step, for judges that must not be asked twice.

    Every step's answers are stored before they are used, so neither a later action nor a
    lost executor asks again. Content is read only for the keys about to be judged. Stops
    as soon as every row is settled. trace: (seq, key, predicate, tier, modality, direction,
    confidence, tau, value, cost).
    """
    state = written(_prepared(df, plan), "state")
    seq, trace, calls = 0, None, 0
    for s in range(plan.steps()):
        for n in plan.leaves:
            route = plan.config.route(plan.kinds[n])
            if s >= len(route):
                continue
            step, force = route[s], s == len(route) - 1
            todo = state.where(needed(plan.tree, plan.known())[n] & (F.col(f"start_{n}") <= s)).select(key)
            text = content.join(todo, key, "left_semi")
            got = written(source.answer(text, key, plan.judged(n), step, force and n not in plan.negates), "answers")
            got = got.withColumn("direction", plan.direction(n, F.col("direction"), force))
            tau = plan.config.tau(n, plan.kinds[n], step.tier)
            value = gate(F.col("direction"), F.col("confidence"), F.lit(tau), force)
            event = got.select(F.lit(seq).alias("seq"), key, F.lit(n).alias("predicate"), F.lit(step.tier).alias("tier"), F.lit(step.modality).alias("modality"), "direction", "confidence", F.lit(tau).alias("tau"), value.alias("value"), "cost")
            trace = event if trace is None else trace.unionByName(event)
            made = got.count()
            calls += made
            seq += 1
            if not made:
                continue
            new = got.select(key, value.alias("__value"), F.col("confidence").alias("__conf"), F.lit(True).alias("__hit"))
            state = state.join(new, key, "left").withColumns({
                f"known_{n}": F.when(F.col("__hit"), F.col("__value")).otherwise(F.col(f"known_{n}")),
                f"conf_{n}": F.when(F.col("__hit"), F.col("__conf")).otherwise(F.col(f"conf_{n}")),
                f"tier_{n}": F.when(F.col("__hit"), F.lit(step.tier)).otherwise(F.col(f"tier_{n}")),
            }).drop("__value", "__conf", "__hit")
        state = written(state, "state")
        if state.where(fold(plan.tree, plan.known()).isNull()).isEmpty():
            break
    return StagedResult(state.withColumn("answer", fold(plan.tree, plan.known())), trace, calls)


def kill_rates(sample: DataFrame, plan: CascadePlan, source: WordQuestions) -> DataFrame:
    """(predicate, k_true, k_false, n): shares that each leaf's first step settles, all leaves judged."""
    cols = []
    for n in plan.leaves:
        route = plan.config.route(plan.kinds[n])
        v = source.verdict(n, route[0], len(route) == 1)
        settled = gate(v["direction"], v["confidence"], F.lit(plan.config.tau(n, plan.kinds[n], route[0].tier)), len(route) == 1)
        cols.append(F.struct(F.lit(n).alias("predicate"), settled.alias("value")))
    long = sample.select(F.explode(F.array(*cols)).alias("x")).select("x.*")
    total = F.count(F.lit(1))
    return long.groupBy("predicate").agg(
        (F.count_if(F.col("value")).cast("double") / total).alias("k_true"),
        (F.count_if(~F.col("value")).cast("double") / total).alias("k_false"),
        total.alias("n"),
    )


def read_rates(rows: DataFrame) -> KillRates:
    """One row per predicate comes to the driver; a query with one predicate learns nothing."""
    got = rows.collect()
    if len(got) < 2:
        return KillRates({}, {})
    return KillRates({r["predicate"]: r["k_true"] for r in got}, {r["predicate"]: r["k_false"] for r in got})
