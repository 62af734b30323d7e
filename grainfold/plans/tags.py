"""Stored answers (tags) and their reuse by later queries."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainfold.functions.text import canonicalize, decanonicalize
from grainfold.plans.specs import CascadeConfig

EXACT, EQUIVALENT, NEGATION, BROADER, NARROWER, NONE = "EXACT", "EQUIVALENT", "NEGATION", "BROADER", "NARROWER", "NONE"

#: Latest first; among equal times the more confident, then the decided, then the later step.
LATEST = ("source_updated_at DESC NULLS LAST", "confidence DESC NULLS LAST", "tag_value DESC NULLS LAST", "settled_tier DESC NULLS LAST", "settled_modality DESC NULLS LAST")


def snapshot(tag_meta: DataFrame, key: str = "parent_asin") -> DataFrame:
    """One row per (key, predicate_canon): the latest; ties by LATEST, so never arbitrary."""
    w = Window.partitionBy(key, "predicate_canon").orderBy(*[F.expr(x.split()[0]).desc_nulls_last() for x in LATEST])
    return tag_meta.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


@dataclass(frozen=True)
class Relations:
    """Declared phrase pairs (new, cached) -> relation. Nothing declared means NONE."""

    rules: Mapping[tuple[str, str], str]

    def match(self, phrase: str, cached: Sequence[str]) -> tuple[str | None, str]:
        """(cached tag, relation): the very same name first, then a declared relation."""
        name = canonicalize(phrase)
        if name in cached:
            return name, EXACT
        for tag in sorted(cached):
            rel = self.rules.get((decanonicalize(name), decanonicalize(tag)), NONE)
            if rel in (EQUIVALENT, NEGATION, BROADER, NARROWER):
                return tag, rel
        return None, NONE


@dataclass(frozen=True)
class Reuse:
    """What a relation lets a query take from a cached tag."""

    relation: str

    @property
    def negated(self) -> bool:
        return self.relation == NEGATION

    @property
    def resumes(self) -> bool:
        return self.relation in (EXACT, EQUIVALENT, NEGATION)

    def known(self, value: Column, trusted: Column) -> Column:
        v = ~value if self.negated else value
        if self.relation == BROADER:  # the new predicate is broader: a cached TRUE implies TRUE
            v = F.when(v, v)
        elif self.relation == NARROWER:
            v = F.when(~v, v)
        elif self.relation == NONE:
            v = F.lit(None).cast("boolean")
        return F.when(trusted, v)

    def write_column(self, own: str, cached: str | None) -> str:
        return cached if cached and self.relation in (EXACT, EQUIVALENT) else own


def trusted(config: CascadeConfig) -> Column:
    """Whether a stored answer holds: decided with provenance, and confident enough or terminal."""
    need = F.lit(0.0)
    for tier, tau in config.recheck.items():
        need = F.when(F.col("settled_tier") == tier, F.lit(float(tau))).otherwise(need)
    last = (F.col("settled_tier") == config.terminal[0]) & (F.col("settled_modality") == config.terminal[1])
    return F.coalesce(F.col("tag_value").isNotNull() & F.col("settled_tier").isNotNull() & (F.col("confidence").isNull() | (F.col("confidence") >= need) | F.coalesce(last, F.lit(False))), F.lit(False))


def with_cached(rows: DataFrame, tags: DataFrame, name: str, tag: str, relation: str, config: CascadeConfig, kind: str = "objective", key: str = "parent_asin") -> DataFrame:
    """Adds known_<name> and start_<name>: the reusable answer, and the step to resume at."""
    r = Reuse(relation)
    offset = F.lit(0)
    route = list(config.route(kind))
    for s in route:
        offset = F.when((F.col("settled_tier") == s.tier) & (F.col("settled_modality") == s.modality), F.lit(config.resume_offset(kind, s.tier, s.modality))).otherwise(offset)
    own = tags.where(F.col("predicate_canon") == tag).select(
        F.col(key).alias("__key"),
        r.known(F.col("tag_value"), trusted(config)).alias(f"known_{name}"),
        (F.when(trusted(config), F.lit(0)).otherwise(offset) if r.resumes else F.lit(0)).cast("int").alias(f"start_{name}"),
    )
    return rows.join(own, rows[key] == F.col("__key"), "left").drop("__key").withColumn(f"start_{name}", F.coalesce(f"start_{name}", F.lit(0)))


def nonempty_tags(df: DataFrame) -> list[str]:
    """Boolean tag_ columns that hold at least one answer, in one pass."""
    cols = [f.name for f in df.schema if f.name.startswith("tag_") and isinstance(f.dataType, T.BooleanType)]
    n = df.agg(*[F.count(c).alias(c) for c in cols]).first() if cols else ()
    return [c for c in cols if n[c]]


def flush(old: DataFrame, results: DataFrame, key: str = "parent_asin") -> DataFrame:
    """Old tags with a query's results put in: settled rows, and undecided ones that reached a
    tier (value null). Undecided rows without a tier write nothing."""
    new = results.where(F.col("tag_value").isNotNull() | F.col("settled_tier").isNotNull())
    return upsert(old, new, [key, "predicate_canon"])


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new, and those of old whose keys new does not hold."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of old, and those of new whose keys old does not hold."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def reuse_scores(history: DataFrame, label: str) -> DataFrame:
    """(predicate, score): share of the other past queries that needed a predicate."""
    other = history.where(F.col("query_label") != label).select("predicate", "query_label").distinct()
    total = other.agg(F.count_distinct("query_label").alias("total"))
    needs = other.groupBy("predicate").agg(F.count(F.lit(1)).alias("n"))
    return needs.join(F.broadcast(total), F.col("total") > 0).select("predicate", (F.col("n").cast("double") / F.col("total")).alias("score"))  # total: one row


def wide(tags: DataFrame, names: Sequence[str], key: str = "parent_asin") -> DataFrame:
    """One boolean column per tag name."""
    return tags.groupBy(key).pivot("predicate_canon", list(names)).agg(F.first("tag_value"))


class TagStore:
    """Versions of the tag table under one folder, each with a numbered pointer.

    A writer adds a version, then a pointer with the next number; nothing is deleted, so
    readers of any version go on undisturbed. The highest complete pointer counts. Only a
    folder without pointers is an empty store; a failure to read is raised. One writer at
    a time.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema

    def _pointers(self) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/pointers")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        own = [s.getPath() for s in fs.listStatus(path)]
        return sorted(p.getName() for p in own if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def read(self) -> DataFrame:
        pointers = self._pointers()
        if not pointers:
            return self.spark.createDataFrame([], self.schema)
        version = self.spark.read.text(f"{self.folder}/pointers/{pointers[-1]}").first()[0]
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/{version}")

    def write(self, df: DataFrame) -> None:
        pointers, version = self._pointers(), f"v-{uuid.uuid4().hex}"
        df.select(*self.schema.names).write.parquet(f"{self.folder}/{version}")
        number = int(pointers[-1]) + 1 if pointers else 1
        self.spark.createDataFrame([(version,)], "value string").coalesce(1).write.text(f"{self.folder}/pointers/{number:012d}")

    def upsert(self, new: DataFrame, keys: list[str]) -> None:
        self.write(upsert(self.read(), new, keys))


def clear(tags: DataFrame, predicates: Sequence[str] | None = None, keys: DataFrame | None = None, key: str = "parent_asin") -> DataFrame:
    """Tags without those of the given predicates (None: all) and rows (None: all); values,
    confidence and provenance go, the rest of the table stays."""
    hit = F.col("predicate_canon").isin(list(predicates)) if predicates is not None else F.lit(True)
    if keys is None:
        return tags.where(~hit | F.col("predicate_canon").isNull())
    return tags.join(keys.select(key).distinct().withColumn("__hit", F.lit(True)), key, "left").where(~F.coalesce(hit & F.col("__hit"), F.lit(False))).drop("__hit")


def record_use(history: DataFrame, predicates: Sequence[str], label: str, at: Column | None = None) -> DataFrame:
    """The history with a query's predicates; a pair that is there stays as it was."""
    spark = history.sparkSession
    new = spark.createDataFrame([(p, label) for p in dict.fromkeys(predicates)], "predicate string, query_label string")
    return insert_missing(history, new.withColumn("first_seen_at", at if at is not None else F.current_timestamp()), ["predicate", "query_label"])


class StepSchedule:
    """Where each (row, predicate) stands: scheduled, done at a tier and modality, or open.

    State: (key, predicate, tier, modality, value): value -1 is scheduled, 0 undecided,
    1 decided. Scheduling leaves what is there alone; completing puts the new state.
    """

    KEYS = ["key", "predicate", "tier", "modality"]

    def __init__(self, state: DataFrame):
        self.state = state

    @staticmethod
    def empty(spark: SparkSession) -> StepSchedule:
        return StepSchedule(spark.createDataFrame([], "key string, predicate string, tier int, modality string, value int"))

    def schedule(self, cells: DataFrame) -> StepSchedule:
        return StepSchedule(insert_missing(self.state, cells.select(*self.KEYS).distinct().withColumn("value", F.lit(-1)), self.KEYS))

    def complete(self, cells: DataFrame) -> StepSchedule:
        """cells: KEYS and `settled` (boolean)."""
        return StepSchedule(upsert(self.state, cells.select(*self.KEYS, F.col("settled").cast("int").alias("value")), self.KEYS))

    def pending(self, tier: int | None = None, modality: str | None = None) -> DataFrame:
        rows = self.state.where("value = -1")
        rows = rows.where(F.col("tier") == tier) if tier is not None else rows
        return rows.where(F.col("modality") == modality) if modality is not None else rows
