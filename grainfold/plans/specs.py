"""What a semantic query is made of: tables, predicates, steps, routes, configuration."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from grainfold.functions.text import canonicalize, compare


@dataclass(frozen=True)
class TableSpec:
    """key: unique row key; content: columns a judge reads; structural: columns to filter by."""

    name: str
    key: str
    content: tuple[str, ...]
    structural: tuple[str, ...] = ()
    note: str = ""


@dataclass(frozen=True)
class Question:
    id: str
    kind: str  # related, content or meta
    text: str


@dataclass(frozen=True)
class PredicateSpec:
    phrase: str
    kind: str = "objective"  # or subjective
    questions: tuple[Question, ...] = ()

    @property
    def tag(self) -> str:
        return canonicalize(self.phrase)

    @property
    def is_related(self) -> bool:
        return bool(self.questions) and all(q.kind == "related" for q in self.questions)


#: Words that say nothing about a predicate.
STOP_WORDS = frozenset({"is", "a", "an", "the", "are", "was", "were", "be"})


def id_prefix(slug: str) -> str:
    """Three letters of the first telling word of a slug, else of its first word."""
    words = slug.lower().split("_")
    return (next((w for w in words if w and w not in STOP_WORDS), "") or next(filter(None, words), "prd"))[:3]


def question_ids(slug: str, content: int = 0, meta: int = 0, related: int = 0) -> list[tuple[str, str]]:
    """(id, kind) in order: content, meta, then related."""
    p = id_prefix(slug)
    out = [(f"{p}_C{i + 1}", "content") for i in range(content)] + [(f"{p}_M{i + 1}", "meta") for i in range(meta)]
    return out + [(f"{p}_R{i + 1}", "related") for i in range(related)]


@dataclass(frozen=True)
class Step:
    tier: int
    modality: str = "text"


T, TI = "text", "text_image"
# The order of steps, and confidence needed by tier.
ROUTES = {
    "objective": (Step(1, T), Step(2, T), Step(1, TI), Step(2, TI), Step(3, T), Step(3, TI)),
    "subjective": (Step(1, T), Step(1, TI), Step(2, T), Step(2, TI), Step(3, T), Step(3, TI)),
}
THRESHOLDS = {"objective": {1: 0.70, 2: 0.60, 3: 0.50}, "subjective": {1: 0.55, 2: 0.45, 3: 0.35}}
RECHECK = {1: 0.9, 2: 0.8, 3: 0.0}


@dataclass(frozen=True)
class CascadeConfig:
    routes: Mapping[str, Sequence[Step]] = field(default_factory=lambda: ROUTES)
    thresholds: Mapping[str, Mapping[int, float]] = field(default_factory=lambda: THRESHOLDS)
    tau_override: Mapping[str, Mapping[int, float]] = field(default_factory=dict)
    recheck: Mapping[int, float] = field(default_factory=lambda: RECHECK)
    terminal: tuple[int, str] = (3, TI)
    reuse_weight: float = 0.0

    def tau(self, predicate: str, kind: str, tier: int) -> float:
        """The predicate's own threshold of a tier, else that of its kind."""
        return {**self.thresholds[kind], **self.tau_override.get(predicate, {})}[tier]

    def route(self, kind: str) -> Sequence[Step]:
        return self.routes[kind]

    def resume_offset(self, kind: str, tier: int | None, modality: str | None) -> int:
        """The step after a settled one; 0 after the last or an unknown one."""
        r = list(self.route(kind))
        s = Step(tier, modality) if tier is not None else None
        return r.index(s) + 1 if s in r and r.index(s) + 1 < len(r) else 0

    def trusted(self, tier: int, modality: str, confidence: float) -> bool:
        return (tier, modality) == self.terminal or confidence >= self.recheck.get(tier, 0.0)


def text_only(config: CascadeConfig = CascadeConfig()) -> CascadeConfig:
    """The routes with their text steps alone, for tables without images."""
    return replace(config, routes={k: tuple(s for s in r if s.modality == T) for k, r in config.routes.items()}, terminal=(3, T))


def single_stage(config: CascadeConfig = CascadeConfig()) -> CascadeConfig:
    """One forced text step at tier 2 for every predicate."""
    one = (Step(2, T),)
    return replace(config, routes={k: one for k in config.routes}, recheck={2: 0.0}, terminal=(2, T))


def trim_routes(config: CascadeConfig, recorded: Mapping[str, set[Step]], kinds: Mapping[str, str]) -> CascadeConfig:
    """Keep the steps recorded for all predicates of a kind in the query."""
    routes = {}
    for kind, route in config.routes.items():
        own = [recorded.get(p, set()) for p, k in kinds.items() if k == kind]
        routes[kind] = tuple(s for s in route if own and all(s in r for r in own)) if own else tuple(route)
    return replace(config, routes=routes)


def effective_batch(n: int, batch: int, workers: int, image: bool = False) -> int:
    """The smallest batch that still keeps all workers busy; images go one by one."""
    return 1 if image else max(1, min(batch, -(-n // max(1, workers))))


@dataclass(frozen=True)
class Structural:
    column: str
    op: str
    value: object

    def condition(self):
        return compare(self.column, self.op, self.value)


@dataclass(frozen=True)
class QueryPlan:
    """Structural conditions (ANDed), predicates, a logic tree over their slugs, a limit."""

    table: TableSpec
    structural: tuple[Structural, ...] = ()
    predicates: tuple[PredicateSpec, ...] = ()
    logic: object | None = None
    limit: int | None = None
