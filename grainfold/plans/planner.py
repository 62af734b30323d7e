"""Runs a query: structural filter, stored answers, order of predicates, cascade, stored results."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainfold.functions import logic
from grainfold.functions.text import COMPARISONS, canonicalize
from grainfold.operators.relational import sample_fraction
from grainfold.plans import tags as tagging
from grainfold.plans.cascade import CascadePlan, kill_rates, one_plan, read_rates, staged
from grainfold.plans.judges import AnswerSource, WordQuestions
from grainfold.plans.specs import CascadeConfig, PredicateSpec, QueryPlan, Structural, TableSpec
from grainfold.session import written


def plan_from_json(spec: Mapping, table: TableSpec) -> QueryPlan:
    """A query plan of {"structural": [{column, op, value}], "predicates": [{phrase, kind}],
    "logic": tree over predicate numbers, "limit": n}. Unknown columns and bad trees raise."""
    structural = tuple(Structural(s["column"], s["op"], s["value"]) for s in spec.get("structural", ()))
    for s in structural:
        if s.column not in table.structural:
            raise ValueError(f"{s.column} is no column to filter by")
        if s.op.upper() not in COMPARISONS:
            raise ValueError(f"unknown operator {s.op}")
    predicates = tuple(PredicateSpec(p["phrase"], p.get("kind", "objective")) for p in spec.get("predicates", ()))
    names = [p.phrase for p in predicates]
    tree = logic.from_json(spec["logic"], names) if spec.get("logic") is not None else logic.Node("AND", tuple(map(logic.Leaf, names))) if names else None
    if names and tree is None:
        raise ValueError("malformed logic")
    return QueryPlan(table, structural, predicates, tree, spec.get("limit"))


def verify_structural(sample: DataFrame, conditions: Sequence[Structural]) -> tuple[bool, int, int, str | None]:
    """(verified, total, matches, error) of the conditions on a sample: an unknown column or
    operator, or an empty sample, fails; a null comparison is no match."""
    for c in conditions:
        if c.column not in sample.columns:
            return False, 0, 0, f"unknown column {c.column}"
        if c.op.upper() not in COMPARISONS:
            return False, 0, 0, f"unknown operator {c.op}"
    hit = F.lit(True)
    for c in conditions:
        hit = hit & F.coalesce(c.condition(), F.lit(False))
    n = sample.agg(F.count(F.lit(1)).alias("total"), F.count_if(hit).alias("matches")).first()
    return (n["total"] > 0, n["total"], n["matches"], None if n["total"] else "empty sample")


@dataclass(frozen=True)
class Engine:
    """tags: stored answers (one row per key and predicate); history: (predicate, query_label,
    first_seen_at); seed, fraction: the sample that the predicates' order is learned on (0:
    tree order); chunk: rows judged in one go by a model source (None: all)."""

    source: AnswerSource
    config: CascadeConfig
    relations: tagging.Relations = tagging.Relations({})
    tags: DataFrame | None = None
    history: DataFrame | None = None
    seed: int = 7
    fraction: float = 0.1
    chunk: int | None = None


@dataclass(frozen=True)
class Answered:
    """answers: (key) of the rows for which the tree is TRUE; state: every row left after the
    structural filter and the stored answers, with known_, conf_, tier_ of each predicate;
    tags, history: with this query's results put in; calls: judgements made."""

    answers: DataFrame
    state: DataFrame | None
    tags: DataFrame | None
    history: DataFrame | None
    calls: int
    order: Sequence[str] = ()


def _reused(rows: DataFrame, plan: QueryPlan, e: Engine) -> tuple[DataFrame, dict[str, str], dict[str, str]]:
    """Rows with known_ and start_ columns of all predicates that a stored one serves; the
    predicate to judge for negated leaves; the name under which each leaf is stored."""
    stored = {canonicalize(r[0]): r[0] for r in e.tags.select("predicate_canon").where("predicate_canon IS NOT NULL").distinct().collect()} if e.tags is not None else {}
    negates, name_of = {}, {}
    for p in plan.predicates:
        tag, relation = e.relations.match(p.phrase, list(stored))
        own = tagging.Reuse(relation)
        name_of[p.phrase] = own.write_column(p.phrase, stored.get(tag))
        if tag is None:
            continue
        rows = tagging.with_cached(rows, e.tags, p.phrase, stored[tag], relation, e.config, p.kind, plan.table.key)
        if own.negated:
            negates[p.phrase] = stored[tag]
    return rows, negates, name_of


def _fresh(state: DataFrame, key: str, names: Mapping[str, str], at) -> DataFrame:
    """Tags of the leaves that reached a tier in this run."""
    cells = [F.struct(F.lit(name).alias("predicate_canon"), F.col(f"known_{n}").alias("tag_value"), F.col(f"conf_{n}").alias("confidence"), F.col(f"tier_{n}").cast("smallint").alias("settled_tier"), F.lit("text").alias("settled_modality")) for n, name in names.items()]
    long = state.select(F.col(key), F.explode(F.array(*cells)).alias("x")).select(key, "x.*").where("settled_tier IS NOT NULL")
    return long.withColumn("source_updated_at", at)


def run(plan: QueryPlan, rows: DataFrame, e: Engine, label: str | None = None) -> Answered:
    """Answers a plan. Pure structural queries end after the filter. Stored answers come first:
    rows they settle are judged no more, and a limited query whose first rows they settle
    judges nothing. A limit takes the rows with the smallest keys."""
    key = plan.table.key
    for s in plan.structural:
        rows = rows.where(s.condition())
    first = (lambda df: df.orderBy(key).limit(plan.limit)) if plan.limit is not None else (lambda df: df)
    if not plan.predicates:
        return Answered(first(rows.select(key)), None, e.tags, e.history, 0)
    rows, negates, name_of = _reused(rows, plan, e)
    kinds = {p.phrase: p.kind for p in plan.predicates}
    cascade = CascadePlan(plan.logic, kinds, e.config, negates=negates)
    known = {n: F.col(f"known_{n}") if f"known_{n}" in rows.columns else F.lit(None).cast("boolean") for n in cascade.leaves}
    rows = rows.where(F.coalesce(logic.fold(plan.logic, known), F.lit(True)))  # the tree's own prefilter
    if len(cascade.leaves) > 1 and e.fraction and isinstance(e.source, WordQuestions):
        sample = rows.join(sample_fraction(rows.select(key), key, e.seed, e.fraction), key, "left_semi")
        scores = {r["predicate"]: r["score"] for r in tagging.reuse_scores(e.history, label or "").collect()} if e.history is not None else {}
        order = logic.subtree_order(plan.logic, read_rates(kill_rates(sample, cascade, e.source)), reuse=scores, weight=e.config.reuse_weight)
        cascade = replace(cascade, order=order)

    def judge(part: DataFrame) -> tuple[DataFrame, int]:
        if isinstance(e.source, WordQuestions):
            done = written(one_plan(part, cascade, e.source).drop(*plan.table.content), "answered")
            tiers = [c for c in done.columns if c.startswith("calls_t")]
            return done, int(done.agg(F.sum(sum((F.col(c) for c in tiers[1:]), F.col(tiers[0])))).first()[0] or 0)
        got = staged(part.drop(*plan.table.content), key, part.select(key, *plan.table.content), cascade, e.source)
        return got.state, got.calls

    state, calls = judge_until(rows, key, judge, plan.limit, e.chunk)
    answers = first(state.where("answer").select(key))
    tags, history = e.tags, e.history
    if tags is not None:
        tags = tagging.flush(tags, _fresh(state, key, {n: name_of[n] for n in cascade.leaves if n not in negates or name_of[n] == n}, F.current_timestamp()), key)
    if history is not None and label is not None:
        history = tagging.record_use(history, [p.phrase for p in plan.predicates], label)
    return Answered(answers, state, tags, history, calls, cascade.leaves)


#: A limited query judges this many rows first, and eight times as many as before each time.
FIRST_BLOCK = 4096


def judge_until(rows: DataFrame, key: str, judge: Callable[[DataFrame], tuple[DataFrame, int]], limit: int | None, chunk: int | None = None) -> tuple[DataFrame, int]:
    """Judges rows in the order of their keys, block by block, until `limit` answers are TRUE;
    without a limit, all at once or in blocks of `chunk`. A block is a range of keys, so only
    its own contents are read. Once a block would hold a million rows, the rest goes as one."""
    if limit is None and chunk is None:
        return judge(rows)
    done, calls, found, size, low = None, 0, 0, chunk or FIRST_BLOCK, None
    while True:
        rest = rows.where(F.col(key) > low) if low is not None else rows
        last = size > 1_000_000 and chunk is None
        bound = None if last else rest.select(key).orderBy(key).limit(size).agg(F.max(key), F.count(F.lit(1))).first()
        part = rest if bound is None else rest.where(F.col(key) <= bound[0])
        if bound is not None and not bound[1]:
            return (done, calls) if done is not None else judge(rows)
        state, made = judge(part)
        calls += made
        done = state if done is None else done.unionByName(state)
        found += state.where("answer").count() if limit is not None else 0
        if bound is None or bound[1] < size or (limit is not None and found >= limit):
            return done, calls
        low, size = bound[0], size if chunk else 8 * size
