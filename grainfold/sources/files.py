"""Files that feed the engine: JSON lines, CSV tables, registries of predicates and queries."""

from __future__ import annotations

import json
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainfold.plans.specs import PredicateSpec, Question


def spanning_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON objects that may span lines, each beginning with { at the begin of a line.

    Files are split at those places, so a large file is read by many tasks. Adds `bad`: the
    text of what is no such object, null for good rows.
    """
    raw = spark.read.option("lineSep", "\n{").text(path)
    body = F.btrim("value", F.lit(" \t\r\n"))
    text = F.when(F.startswith(body, F.lit("{")), body).otherwise(F.concat(F.lit("{"), body))
    kept = T._parse_datatype_string(schema).add("bad", T.StringType())
    parsed = raw.where(body != "").select(F.from_json(text, kept, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"}).alias("x"))
    return parsed.select("x.*")


def strict_json(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """One object a line, blank lines skipped, the last line of each key; a bad line raises."""
    kept = T._parse_datatype_string(schema)
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__line"))
    rows = raw.where(F.trim("value") != "").select(F.from_json("value", kept, {"mode": "FAILFAST"}).alias("x"), "__file", "__start", "__line").select("x.*", "__file", "__start", "__line")
    w = Window.partitionBy(key).orderBy(F.col("__file").desc(), F.col("__start").desc(), F.col("__line").desc())
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__file", "__start", "__line", "__n")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table with a header; quotes are doubled inside quoted fields, which may hold line ends."""
    return spark.read.csv(path, schema=schema, header=True, escape='"', multiLine=True)


def soft_labels(spark: SparkSession, path: str) -> DataFrame:
    """(parent_asin, predicate_slug, T_rate)."""
    return read_csv(spark, path, "parent_asin string, predicate_slug string, T_rate double").where("parent_asin IS NOT NULL AND predicate_slug IS NOT NULL")


ANSWERS = "parent_asin string, predicate_slug string, tier int, modality string, direction boolean, confidence double"
CALLS = "parent_asin string, predicate_slug string, tier int, modality string, cost_usd double, latency_s double"


def recorded_answers(spark: SparkSession, answers: str, calls: str) -> DataFrame:
    """Recorded cells for RecordedSource: answers with the cost and latency of their calls,
    (row, predicate, step) by (row, predicate, step); several calls of a cell add up."""
    by = ["parent_asin", "predicate_slug", "tier", "modality"]
    cost = read_csv(spark, calls, CALLS).groupBy(*by).agg(F.sum("cost_usd").alias("cost"), F.sum("latency_s").alias("latency"))
    got = read_csv(spark, answers, ANSWERS).join(cost, by, "left")
    return got.select("parent_asin", F.col("predicate_slug").alias("slug"), "tier", "modality", "direction", "confidence", F.coalesce("cost", F.lit(0.0)).alias("cost"), F.coalesce("latency", F.lit(0.0)).alias("latency"))


def csv_views(spark: SparkSession, paths: Mapping[str, str]) -> None:
    """CSV files as SQL views, types read from the data."""
    for name, path in paths.items():
        spark.read.csv(path, header=True, inferSchema=True, escape='"', multiLine=True).createOrReplaceTempView(name)


def query_catalogue(path: str, values: Mapping[str, str]) -> dict[str, dict]:
    """Benchmark queries by id; {name} in their SQL is filled in, and an unknown name raises."""
    out = {}
    for q in json.loads(Path(path).read_text(encoding="utf-8"))["queries"]:
        if q["id"] in out:
            raise ValueError(f"query {q['id']} twice")
        out[q["id"]] = {**q, "gold_sql": q["gold_sql"].format_map(values)} if q.get("gold_sql") else dict(q)
    return out


def predicate_registry(folder: str) -> dict[str, PredicateSpec]:
    """Predicates by slug from a folder of JSON files; an alias is a slug of its own that shares
    the questions. Only predicates of an even number of related questions are taken."""
    out: dict[str, PredicateSpec] = {}
    for f in sorted(Path(folder).glob("*.json")):
        spec = json.loads(f.read_text(encoding="utf-8"))
        questions = tuple(Question(i, kind, text) for i, kind, text in spec["subquestions"])
        if spec.get("scheme") != "related" or spec["n"] != len(questions) or spec["n"] % 2 or any(q.kind != "related" for q in questions):
            raise ValueError(f"{f.name}: needs an even number of related questions, and as many as it says")
        for slug in (spec["slug"], *spec.get("aliases", ())):
            if slug in out:
                raise ValueError(f"{f.name}: {slug} is taken")
            out[slug] = PredicateSpec(slug.replace("_", " "), spec.get("kind", "objective"), questions)
    return out


def bundle(text: str) -> tuple[dict, list[dict]]:
    """(meta, reviews) of {"meta": {...}, "reviews": [{...}]}; anything else raises."""
    got = json.loads(text)
    if not isinstance(got, dict) or not isinstance(got.get("meta"), dict):
        raise ValueError("meta must be an object")
    reviews = got.get("reviews", [])
    if not isinstance(reviews, list) or not all(isinstance(r, dict) for r in reviews):
        raise ValueError("reviews must be a list of objects")
    return got["meta"], reviews

