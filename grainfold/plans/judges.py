"""Where answers come from: column expressions, recorded tables, or a model called in batches."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from operator import or_
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainfold.functions.verdicts import answer_value, content_meta, related, related_twice
from grainfold.plans.specs import PredicateSpec, Step, effective_batch

ANSWER = "direction boolean, confidence double, cost double"


class AnswerSource(Protocol):
    def answer(self, todo: DataFrame, key: str, slug: str, step: Step, force: bool) -> DataFrame:
        """(key, direction, confidence, cost), one row per key of todo at most."""


@dataclass(frozen=True)
class WordQuestions:
    """Each question is TRUE if the text holds one of its words; undecided for a null text.

    A higher tier asks more questions: `by_tier[tier]` of them, in order.
    """

    groups: Mapping[str, Sequence[Sequence[str]]]
    by_tier: Mapping[int, int]
    text: str = "review_text"
    cost: Mapping[int, float] = None

    def answers(self, slug: str, tier: int, low: Column | None = None) -> list[Column]:
        """Nullable booleans; `low` is the text in lower case, if it is at hand."""
        low = F.lower(F.col(self.text)) if low is None else low
        return [reduce(or_, [F.contains(low, F.lit(w)) for w in g]) for g in self.groups[slug][: self.by_tier[tier]]]

    def twice(self, slug: str, tier: int, low: Column | None = None) -> Column:
        """2 * TRUE + undecided answers, one pass over the questions."""
        return reduce(lambda a, b: a + b, [F.when(q.isNull(), 1).when(q, 2).otherwise(0) for q in self.answers(slug, tier, low)])

    def verdict(self, slug: str, step: Step, force: bool, twice: Column | None = None) -> Column:
        twice = self.twice(slug, step.tier) if twice is None else twice
        return related_twice(twice, F.lit(self.by_tier[step.tier]), force)

    def price(self, step: Step) -> float:
        return (self.cost or {}).get(step.tier, float(self.by_tier[step.tier]))

    def answer(self, todo: DataFrame, key: str, slug: str, step: Step, force: bool) -> DataFrame:
        v = self.verdict(slug, step, force, F.col("twice"))
        return todo.select(key, self.twice(slug, step.tier).alias("twice")).select(key, v.alias("v")).select(key, "v.direction", "v.confidence", F.lit(self.price(step)).alias("cost"))


@dataclass(frozen=True)
class RecordedSource:
    """Answers from a table (key, slug, tier, modality, direction, confidence, cost); a missing cell raises."""

    table: DataFrame

    def answer(self, todo: DataFrame, key: str, slug: str, step: Step, force: bool) -> DataFrame:
        rows = self.table.where((F.col("slug") == slug) & (F.col("tier") == step.tier) & (F.col("modality") == step.modality))
        hit = todo.select(key).join(rows.select(key, "direction", "confidence", "cost", F.lit(True).alias("__there")), key, "left")
        checked = F.when(F.col("__there"), F.col("confidence")).otherwise(F.raise_error(F.concat(F.lit(f"no recorded answer for {slug}, "), F.col(key).cast("string"))).cast("double"))
        return hit.select(key, "direction", checked.alias("confidence"), "cost")


Client = Callable[[str, Sequence[str]], Sequence[str]]

#: Seconds that one call may take, by tier.
TIMEOUTS = {1: 10.0, 2: 25.0, 3: 40.0}


def limited(call: Callable[[], object], timeout: float, attempts: int = 2, pause: float = 1.0) -> object | None:
    """What the call returns, or None once it failed or overran `timeout` seconds `attempts`
    times. An overrunning call is left behind; pauses double from attempt to attempt."""
    for k in range(attempts):
        pool = ThreadPoolExecutor(1)
        try:
            return pool.submit(call).result(timeout)
        except Exception:
            if k + 1 < attempts:
                time.sleep(pause * 2**k)
        finally:
            pool.shutdown(wait=False, cancel_futures=True)
    return None


def _as_many(answers: Sequence[str], n: int) -> Sequence[str]:
    if len(answers) != n:
        raise ValueError(f"{len(answers)} answers to {n} rows")
    return answers


@dataclass(frozen=True)
class Prices:
    """Per million tokens; thinking is billed as output."""

    prompt: float
    output: float

    def cost(self, prompt: Column, output: Column, thinking: Column) -> Column:
        return (prompt * self.prompt + (output + thinking) * self.output) / 1e6


def localized(prompt: str, noun: str) -> str:
    """A prompt that speaks of `noun` instead of products, its plural and capital too."""
    for old, new in (("products", noun + "s"), ("product", noun), ("Products", (noun + "s").capitalize()), ("Product", noun.capitalize())):
        prompt = re.sub(rf"\b{old}\b", new, prompt)
    return prompt


@dataclass(frozen=True)
class VectorSource:
    """A model called with batches of texts. client(slug, texts) gives one raw answer each; a call
    that fails twice gives up its rows: undecided with confidence 0.15.

    Calls run inside tasks, at most `batch` texts each; the caller stores what comes back, so
    that no later step asks again.
    """

    client: Client
    text: str
    batch: int = 6
    attempts: int = 2
    price: float = 1.0
    pause: float = 1.0

    def answer(self, todo: DataFrame, key: str, slug: str, step: Step, force: bool) -> DataFrame:
        client, batch, attempts, price, text = self.client, self.batch, self.attempts, self.price, self.text
        timeout, pause = TIMEOUTS.get(step.tier, 40.0), self.pause

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                out = []
                for a in range(0, len(pdf), batch):
                    own = pdf.iloc[a : a + batch]
                    texts = ["" if t is None else t for t in own[text]]
                    raw = limited(lambda texts=texts: _as_many(client(slug, texts), len(texts)), timeout, attempts, pause)
                    raw = raw if raw is not None and len(raw) == len(own) else [None] * len(own)
                    out += [(k, *read_match(r), price) for k, r in zip(own[key], raw)]
                yield pd.DataFrame(out, columns=[key, "direction", "confidence", "cost"]).astype({"direction": "boolean"})

        kind = todo.schema[key].dataType.simpleString()
        got = todo.select(key, text).mapInPandas(run, f"{key} {kind}, {ANSWER}")
        return got.withColumn("direction", F.coalesce("direction", F.lit(False))) if force else got


GIVEN_UP = (None, 0.15)


def read_match(raw: str | None) -> tuple[bool | None, float]:
    """(direction, confidence) of a raw single answer: a first word true/false, else JSON."""
    if not raw or not raw.strip():
        return GIVEN_UP
    word = re.split(r"[\s,.:;|]+", raw.strip().lower(), maxsplit=1)[0]
    if word in ("true", "yes", "false", "no"):
        return word in ("true", "yes"), 1.0
    got = json_object(raw)
    v = next((got[k] for k in ("matches", "match", "answer") if k in got), None) if got else None
    if isinstance(v, str):
        v = v.strip().lower() in ("true", "1", "yes")
    return (bool(v), float(got.get("confidence", 1.0))) if isinstance(v, (bool, int)) else GIVEN_UP


#: Longest evidence that is kept, the mark of a cut included.
EVIDENCE = 100


def read_evidence(raw: str | None) -> str:
    """The reason that goes with a raw single answer: of a JSON answer its `evidence`, else what
    follows the first word; on one line, at most EVIDENCE characters."""
    got = json_object(raw or "")
    text = str((got.get("evidence") or got.get("justification") or "") if got else " ".join((raw or "").split(None, 1)[1:]))
    text = " ".join(text.split())
    return text if len(text) < EVIDENCE else text[: EVIDENCE - 2] + "…"


def json_object(raw: str) -> dict | None:
    """The outermost {...} of a model's answer, fences and chatter around it ignored."""
    a, b = raw.find("{"), raw.rfind("}")
    if a < 0 or b < a:
        return None
    try:
        out = json.loads(raw[a : b + 1])
    except ValueError:
        return None
    return out if isinstance(out, dict) else None


#: One-letter answers.
CODES = {"T": "T", "F": "F", "U": "cannot_determine"}


def read_positions(raw: object, ids: Sequence[str]) -> dict[str, str] | None:
    """Positional answers, an array or one string of letters: exactly one known answer per id or nothing."""
    items = list(raw) if isinstance(raw, (list, str)) else None
    if items is None or len(items) != len(ids) or any(x not in CODES and x not in CODES.values() for x in items):
        return None
    return {i: CODES.get(x, x) for i, x in zip(ids, items)}


def read_verbose(raw: object, ids: Sequence[str]) -> dict[str, str]:
    """[{sub_id, answer}]: unknown and repeated ids are ignored, absent ones are MISSING."""
    out = dict.fromkeys(ids, "MISSING")
    seen = set()
    for x in raw if isinstance(raw, list) else ():
        if isinstance(x, dict) and x.get("sub_id") in out and x["sub_id"] not in seen and x.get("answer") in CODES.values():
            seen.add(x["sub_id"])
            out[x["sub_id"]] = x["answer"]
    return out


def read_batch(raw: object, n: int, ids: Sequence[str]) -> list[dict[str, str]] | None:
    """[{index, answers}] for rows 1..n, each exactly once, in any order."""
    if not isinstance(raw, list) or sorted(x.get("index", 0) if isinstance(x, dict) else 0 for x in raw) != list(range(1, n + 1)):
        return None
    out = [read_positions(x.get("answers"), ids) for x in sorted(raw, key=lambda x: x["index"])]
    return None if None in out else out


def read_predicates(raw: str, wanted: Sequence[int]) -> tuple[dict[int, bool], list[str]]:
    """{"results": [{predicate_idx, answer}]}: answers and what was wrong; partial results count."""
    got, errors = {}, []
    for x in (json_object(raw) or {}).get("results", []):
        i, v = (x.get("predicate_idx"), x.get("answer")) if isinstance(x, dict) else (None, None)
        if i not in wanted:
            errors.append(f"unexpected {i}")
        elif i in got:
            errors.append(f"repeated {i}")
        elif not isinstance(v, bool):
            errors.append(f"not a boolean {i}")
        else:
            got[i] = v
    return got, errors + [f"missing {i}" for i in wanted if i not in got]


#: client(phrase, questions [(id, kind, text)], texts): one raw answer for the whole batch.
BatchClient = Callable[[str, Sequence[tuple[str, str, str]], Sequence[str]], str]
#: Raw answers of one call: whole batch, or one row in any of the three forms.
CALLS = "slug string, sub_id string, kind string, answer string, batch_id string, batch_size int"


def read_sub_answers(raw: str | None, n: int, ids: Sequence[str]) -> list[dict[str, str]]:
    """Sub-answers of n rows; where a raw answer cannot be read, MISSING for all of them."""
    try:
        got = json.loads(raw) if raw else None
    except ValueError:
        got = raw.strip() if raw else None
    if n == 1:
        one = read_positions(got, ids)
        if one is None and isinstance(got, list) and all(isinstance(x, dict) for x in got):
            one = (read_batch(got, 1, ids) or [None])[0] or read_verbose(got, ids)
        return [one or dict.fromkeys(ids, "MISSING")]
    return read_batch(got, n, ids) or [dict.fromkeys(ids, "MISSING") for _ in range(n)]


@dataclass(frozen=True)
class SubQuestionSource:
    """A model asked the sub-questions of a predicate, several rows a call.

    A call that fails, overruns or cannot be read makes its rows' answers MISSING, which
    count one half: content/meta predicates then come out undecided with confidence 0.15.
    Predicates whose questions are all `related` are decided by their number of TRUE ones.
    """

    predicates: Mapping[str, PredicateSpec]
    client: BatchClient
    text: str
    batch: int = 6
    workers: int = 20
    attempts: int = 2
    pause: float = 1.0
    price: float = 1.0
    theta: float = 0.5

    def calls(self, todo: DataFrame, key: str, slug: str, step: Step) -> DataFrame:
        """(key, CALLS): one row per row and sub-question, as answered."""
        spec, client, text, attempts, pause = self.predicates[slug], self.client, self.text, self.attempts, self.pause
        asked = [(q.id, q.kind, q.text) for q in spec.questions]
        ids, timeout = [q[0] for q in asked], TIMEOUTS.get(step.tier, 40.0)
        most, workers, image = self.batch, self.workers, step.modality != "text"

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                size, out = effective_batch(len(pdf), most, workers, image), []
                for a in range(0, len(pdf), size):
                    own = pdf.iloc[a : a + size]
                    texts = ["" if t is None else t for t in own[text]]
                    raw = limited(lambda texts=texts: client(spec.phrase, asked, texts), timeout * (2 if len(own) > 1 else 1), attempts, pause)
                    for k, got in zip(own[key], read_sub_answers(raw, len(own), ids)):
                        out += [(k, slug, i, kind, got[i], f"{slug}|{step.tier}|{own[key].iloc[0]}", len(own)) for i, kind, _ in asked]
                yield pd.DataFrame(out, columns=[key, "slug", "sub_id", "kind", "answer", "batch_id", "batch_size"])

        kind = todo.schema[key].dataType.simpleString()
        return todo.select(key, text).mapInPandas(run, f"{key} {kind}, {CALLS}")

    def answer(self, todo: DataFrame, key: str, slug: str, step: Step, force: bool) -> DataFrame:
        v = verdict_of(sub_scores(self.calls(todo, key, slug, step), key), self.predicates[slug].is_related, force, self.theta)
        return v.select(key, "v.direction", "v.confidence", (F.lit(self.price) / F.col("batch_size")).alias("cost"))


def sub_scores(calls: DataFrame, *by: str) -> DataFrame:
    """(by, content, meta, n_true, n_open, n, batch_size): means of the answers by kind; null without any."""
    value, kind = answer_value(F.col("answer")), F.col("kind")
    return calls.groupBy(*by).agg(
        F.avg(F.when(kind == "content", value)).alias("content"), F.avg(F.when(kind == "meta", value)).alias("meta"),
        F.count_if((kind == "related") & (value == 1.0)).alias("n_true"), F.count_if((kind == "related") & (value == 0.5)).alias("n_open"), F.count_if(kind == "related").alias("n"), F.max("batch_size").alias("batch_size"),
    )


def verdict_of(scores: DataFrame, is_related: bool, force: bool = False, theta: float = 0.5) -> DataFrame:
    """Adds `v`, the verdict of sub_scores."""
    if is_related:
        return scores.withColumn("v", related(F.col("n_true"), F.col("n_open"), F.col("n"), force))
    v = content_meta(F.col("content"), F.col("meta"), theta)
    tie = (F.coalesce("content", F.lit(0.5)) == 0.5) & (F.coalesce("meta", F.lit(0.5)) == 0.5)
    undecided = F.struct(F.lit(False if force else None).cast("boolean").alias("direction"), v["confidence"].alias("confidence"))
    return scores.withColumn("v", F.when(tie, undecided).otherwise(v))


def ask_predicates(rows: DataFrame, key: str, text: str, predicates: Sequence[str], client: Callable[[Sequence[str], str], str], timeout: float = 40.0, attempts: int = 2, pause: float = 1.0) -> DataFrame:
    """(key, predicate_idx, answer, error): one call per row asks all predicates; answers that
    came well count even if others did not, and each fault is a row of its own."""
    wanted = list(range(len(predicates)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out: list[tuple] = []
            for k, t in zip(pdf[key], pdf[text]):
                raw = limited(lambda t=t: client(list(predicates), "" if t is None else t), timeout, attempts, pause)
                got, errors = read_predicates(str(raw or ""), wanted)
                out += [(k, i, v, None) for i, v in got.items()] + [(k, None, None, e) for e in errors]
            yield pd.DataFrame(out, columns=[key, "predicate_idx", "answer", "error"]).astype({"predicate_idx": "Int32", "answer": "boolean"})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, text).mapInPandas(run, f"{key} {kind}, predicate_idx int, answer boolean, error string")


def sem_map(rows: DataFrame, text: str, name: str, answer: Callable[[Sequence[str]], Sequence[str]], low: float = 1.0, high: float = 5.0, default: float = 3.0, batch: int = 64) -> DataFrame:
    """Adds `name`: a number per row from a model's raw answers; what is no number, or lies
    outside [low, high], counts as `default`."""

    @F.pandas_udf("string")
    def ask(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for col in parts:
            own = col.fillna("").tolist()
            yield pd.Series([x for a in range(0, len(own), batch) for x in answer(own[a : a + batch])], dtype="object")

    v = F.trim(F.col("__raw")).try_cast("double")
    return rows.withColumn("__raw", ask(text)).withColumn(name, F.when(v.between(low, high), v).otherwise(F.lit(default))).drop("__raw")
