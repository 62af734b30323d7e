"""Queries of the planner, the model-facing judges, sources and sinks, and their SQL.

The models are stand-ins: functions that answer as a model would, in raw text, by the words
of a review, so that everything behind the call can be checked in plain SQL.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainfold.catalog_reference import _CSMS, _MID, _MOVIE_A, _SNAP, _TRUST, ACT, CONFIG, JUDGE, KIND, NEG, ONE, POS, QUESTIONS, TAU, Query, _conf, _cs_ms, _dir, _leaf, _movie, _q, _tags_sql, reviews, snap
from grainfold.functions import logic
from grainfold.functions.text import canonicalize
from grainfold.operators import metrics, relational, semantic
from grainfold.operators.skew import key_text
from grainfold.plans import tags
from grainfold.plans.cascade import CascadePlan, one_plan, staged
from grainfold.plans.judges import RecordedSource, SubQuestionSource, ask_predicates, sem_map, sub_scores, verdict_of
from grainfold.plans.planner import Engine, plan_from_json, run, verify_structural
from grainfold.plans.specs import PredicateSpec, Question, Step, Structural, TableSpec, question_ids
from grainfold.session import shared_dir, table, written
from grainfold.sources import content, files, sinks

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


def _folder(s, name: str) -> str:
    return f"{shared_dir(s).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- sources


@query("source_json_spanning", "SELECT id, title, genre FROM movies")
def source_json_spanning(s, d):
    """Movies laid down as indented objects over several lines, and read back."""
    path = _folder(s, "json")
    table(s, d, "movies").select(F.to_json(F.struct("id", "title", "genre"), {"pretty": "true"})).write.text(path)
    return files.spanning_json(s, path, "id string, title string, genre string").where("bad IS NULL").drop("bad")


@query("source_json_strict", "SELECT id, title, director FROM movies")
def source_json_strict(s, d):
    path = _folder(s, "json")
    m = table(s, d, "movies").select("id", "title", "director")
    m.write.json(path)
    return files.strict_json(s, path, "id string, title string, director string", "id")


@query("source_soft_labels", f"WITH {_SNAP} SELECT parent_asin, predicate_canon AS predicate_slug, CAST(tag_value AS INTEGER)::DOUBLE AS T_rate FROM snap WHERE tag_value IS NOT NULL")
def source_soft_labels(s, d):
    path = _folder(s, "labels")
    snap(s, d).where("tag_value IS NOT NULL").select("parent_asin", F.col("predicate_canon").alias("predicate_slug"), F.col("tag_value").cast("int").cast("double").alias("T_rate")).write.csv(path, header=True)
    return files.soft_labels(s, path)


@query("source_recorded", f"SELECT parent_asin, {_leaf(POS)} AS answer FROM movie_reviews")
def source_recorded(s, d):
    """Answers and calls recorded in two CSV tables, joined, then replayed."""
    cells = [F.struct(F.lit(st.tier).alias("tier"), JUDGE.verdict(POS, st, st.tier == 3).alias("v")) for st in CONFIG.route("objective")]
    rec = reviews(s, d, "review_text").select("parent_asin", F.explode(F.array(*cells)).alias("x")).select("parent_asin", F.lit(POS).alias("predicate_slug"), "x.tier", F.lit("text").alias("modality"), "x.v.direction", "x.v.confidence")
    answers, calls = _folder(s, "answers"), _folder(s, "calls")
    rec.write.csv(answers, header=True)
    rec.select("parent_asin", "predicate_slug", "tier", "modality", (F.col("tier") * 0.001).alias("cost_usd"), F.lit(0.5).alias("latency_s")).write.csv(calls, header=True)
    keys = reviews(s, d)
    out = staged(keys, "parent_asin", keys, CascadePlan(logic.parse(POS), KIND, CONFIG), RecordedSource(files.recorded_answers(s, answers, calls)))
    return out.state.select("parent_asin", "answer")


@query("source_csv_view", "SELECT original_language, count(*) AS n FROM movies GROUP BY 1")
def source_csv_view(s, d):
    path = _folder(s, "movies")
    table(s, d, "movies").select("id", "original_language").write.csv(path, header=True, escape='"', emptyValue='""', nullValue="")
    files.csv_views(s, {"movies_csv": path})
    return s.sql("SELECT original_language, count(*) AS n FROM movies_csv GROUP BY 1")


SOURCES = (content.SourceTable("movies", ("title", "director"), "id"), content.SourceTable("movie_reviews", ("critic_name", "features"), "parent_asin", join_on="mid", filters={"outlet": "!= 'Open Reel'"}), content.SourceTable("movie_reviews", ("image_url",), "parent_asin", "image", "mid"))


def _tables(s, d) -> dict[str, DataFrame]:
    return {"movies": table(s, d, "movies"), "movie_reviews": table(s, d, "movie_reviews").withColumn("mid", key_text("id"))}


_LINE = "CASE WHEN trim({0}) <> '' THEN '{0}: ' || trim({0}) END"
_FEATURES = "list_filter(features, lambda x: x <> '')"
_FLINE = f"CASE WHEN len({_FEATURES}) = 1 THEN 'features: - ' || {_FEATURES}[1] WHEN len({_FEATURES}) > 1 THEN 'features:' || chr(10) || array_to_string(list_transform({_FEATURES}, lambda x: '- ' || x), chr(10)) END"


@query("multi_source_text", f"""WITH r AS (SELECT {_MID} AS mid, *, row_number() OVER (PARTITION BY {_MID} ORDER BY parent_asin) AS i, count(*) OVER (PARTITION BY {_MID}) AS n FROM movie_reviews WHERE {_MID} IS NOT NULL AND outlet <> 'Open Reel'),
p AS (SELECT mid, CAST((i - 1) // 1000 AS INTEGER) AS part, string_agg(concat_ws(chr(10), CASE WHEN n > 1 THEN '### row ' || i END, {_LINE.format("critic_name")}, {_FLINE}), chr(10) ORDER BY i) AS text FROM r GROUP BY 1, 2)
SELECT id, 0 AS section, 0 AS part, concat_ws(chr(10), '## SOURCE: movies', nullif(concat_ws(chr(10), {_LINE.format("title")}, {_LINE.format("director")}), '')) AS text FROM movies
UNION ALL SELECT id, 1, coalesce(part, 0), CASE WHEN part IS NULL THEN '## SOURCE: movie_reviews' || chr(10) || '(no rows matched)' WHEN part = 0 THEN concat_ws(chr(10), '## SOURCE: movie_reviews', nullif(text, '')) ELSE text END FROM movies LEFT JOIN p ON p.mid = movies.id""")
def multi_source_text(s, d):
    """Each movie's own columns and its reviews as text sections, in parts of a thousand rows."""
    return content.text_sections(table(s, d, "movies").select("id"), "id", SOURCES, _tables(s, d))


@query("image_addresses", f"SELECT m.id, 'image_url' AS \"column\", trim(r.image_url) AS url FROM movies m JOIN movie_reviews r ON {_MID.replace('(id)', '(r.id)')} = m.id WHERE trim(r.image_url) <> ''")
def image_addresses(s, d):
    return content.image_addresses(table(s, d, "movies").select("id"), "id", SOURCES, _tables(s, d))


@query("listing_reviews", f"""SELECT {_MID} AS mid, row_number() OVER (PARTITION BY {_MID} ORDER BY parent_asin) AS place, CASE WHEN length(review_text) > 1200 THEN substr(review_text, 1, 1197) || '...' ELSE review_text END AS text
FROM movie_reviews WHERE review_text IS NOT NULL AND {_MID} IS NOT NULL""")
def listing_reviews(s, d):
    return content.review_lines(_tables(s, d)["movie_reviews"].select("mid", "parent_asin", "review_text"), "mid", "review_text", "parent_asin")


@query("structural_verify_operator", "SELECT count(*) > 0 AS verified, count(*) AS total, count(*) FILTER (WHERE audience_score > 60 AND title LIKE '%a%') AS matches, CAST(NULL AS VARCHAR) AS error FROM movies")
def structural_verify_operator(s, d):
    got = verify_structural(table(s, d, "movies"), [Structural("audience_score", ">", 60.0), Structural("title", "LIKE", "%a%")])
    return s.createDataFrame([got], "verified boolean, total bigint, matches bigint, error string")


# ---------------------------------------------------------------- sinks


@query("log_append", "SELECT settled_tier AS tier, 2 * count(*) AS n FROM tag_meta GROUP BY 1")
def log_append(s, d):
    """A call log written in two turns and read back."""
    folder = _folder(s, "log")
    rows = table(s, d, "tag_meta").select("parent_asin", "predicate_canon", F.col("settled_tier").cast("int").alias("tier"))
    for _ in range(2):
        sinks.append_log(rows, folder)
    return sinks.read_log(s, folder, "parent_asin string, predicate_canon string, tier int").groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


@query("result_file", f"SELECT {_MID} AS id, count(*) AS n FROM movie_reviews WHERE {_MID} IS NOT NULL GROUP BY 1")
def result_file(s, d):
    folder = _folder(s, "result")
    n = table(s, d, "movie_reviews").select(key_text("id").alias("id")).where("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    sinks.write_result(n, folder, ["id", "n"])
    return files.read_csv(s, folder, "id string, n bigint")


@query("tag_clear", f"WITH {_SNAP} SELECT predicate_canon, count(*) AS n FROM snap t WHERE NOT (predicate_canon = '{POS}' AND parent_asin IN (SELECT parent_asin FROM movie_reviews WHERE {_MID} = ({_MOVIE_A}))) GROUP BY 1")
def tag_clear(s, d):
    """Tags of one predicate taken back for one movie's reviews."""
    r = reviews(s, d, key_text("id").alias("mid"))
    own = r.join(F.broadcast(_movie(s, d)), F.col("mid") == F.col("__mid"), "left_semi")  # one row
    return tags.clear(snap(s, d), [POS], own).groupBy("predicate_canon").agg(F.count(F.lit(1)).alias("n"))


@query("history_record", f"SELECT count(*) AS n, count(*) FILTER (WHERE query_label = 'query_new') AS fresh FROM (SELECT DISTINCT predicate, query_label FROM predicate_query_history UNION SELECT unnest(['{POS}', '{NEG}']), 'query_new')")
def history_record(s, d):
    h = table(s, d, "predicate_query_history").groupBy("predicate", "query_label").agg(F.min("first_seen_at").alias("first_seen_at"))
    twice = tags.record_use(tags.record_use(h, [POS, NEG, POS], "query_new"), [POS], "query_new")
    return twice.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("query_label") == "query_new").alias("fresh"))


@query("step_schedule", f"""SELECT 1 AS tier, count(*) FILTER (WHERE NOT coalesce({_conf(POS, 2)} >= 0.7 AND {_dir(POS, 2)} IS NOT NULL, false)) AS pending FROM movie_reviews
UNION ALL SELECT 2, count(*) FROM movie_reviews""")
def step_schedule(s, d):
    """Two steps scheduled for all reviews (twice), those that the first settles completed."""
    v = JUDGE.verdict(POS, Step(1), False)
    r = reviews(s, d, "review_text").select("parent_asin", (F.coalesce(v["confidence"] >= TAU_1, F.lit(False)) & v["direction"].isNotNull()).alias("settled"))
    cells = r.select(F.col("parent_asin").alias("key"), F.lit(POS).alias("predicate"), F.lit("text").alias("modality"), "settled")
    first = cells.withColumn("tier", F.lit(1))
    plan = tags.StepSchedule.empty(s).schedule(first).schedule(cells.withColumn("tier", F.lit(2))).schedule(first).complete(first.where("settled"))
    return plan.pending().groupBy("tier").agg(F.count(F.lit(1)).alias("pending"))


TAU_1 = float(TAU[1])


# ---------------------------------------------------------------- order of events, classes


@query("trace_sequence", f"""WITH c AS (SELECT parent_asin, (row_number() OVER (ORDER BY md5(parent_asin || '-7'), parent_asin) - 1) // 1000 AS chunk FROM movie_reviews)
SELECT parent_asin, leaf, row_number() OVER (ORDER BY chunk, leaf, parent_asin) - 1 AS seq FROM c, (SELECT unnest(range(2)) AS leaf)""")
def trace_sequence(s, d):
    """Numbers of the first step's events of two predicates, chunk by chunk, leaf by leaf."""
    c = relational.chunks(reviews(s, d), "parent_asin", 7, 1000).withColumn("leaf", F.explode(F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))))
    return relational.global_rank(c, ["chunk", "leaf", "parent_asin"], "seq").select("parent_asin", "leaf", "seq")


def _trace_sql() -> str:
    a, b = f"{_conf(POS, 2)} >= 0.7 AND {_dir(POS, 2)} IS NOT NULL", f"{_conf(POS, 4)} >= 0.6 AND {_dir(POS, 4)} IS NOT NULL"
    return f"SELECT parent_asin, CASE WHEN coalesce({a}, false) THEN 1 WHEN coalesce({b}, false) THEN 2 ELSE 3 END AS tier, CASE WHEN {_leaf(POS)} THEN 'matched' ELSE 'not_matched' END AS status FROM movie_reviews"


@query("trace_last_event", _trace_sql())
def trace_last_event(s, d):
    """The last event of each cell in the trace of a staged run is its status."""
    r = reviews(s, d, "review_text")
    out = staged(r.select("parent_asin"), "parent_asin", r, CascadePlan(logic.parse(POS), KIND, CONFIG), JUDGE)
    last = relational.keep_first(out.trace, ["parent_asin", "predicate"], [F.col("seq").desc()])
    status = F.when(F.col("value"), "matched").when(~F.col("value"), "not_matched").otherwise("inconclusive")
    return last.select("parent_asin", "tier", status.alias("status"))


@query("class_list", f"WITH {_SNAP}, c AS (SELECT coalesce(settled_modality, 'none') AS class, count(*) AS n FROM snap GROUP BY 1) SELECT class, n, CAST(row_number() OVER (ORDER BY n DESC, class) AS INTEGER) AS place FROM c")
def class_list(s, d):
    return sinks.class_list(snap(s, d).select(F.coalesce("settled_modality", F.lit("none")).alias("class")))


@query("alpha_best", f"""WITH u AS (SELECT cs, ms, CAST(tag_is_a_positive_review AS INTEGER) AS gt FROM ({_CSMS}) JOIN movie_reviews USING (parent_asin) WHERE tag_is_a_positive_review IS NOT NULL),
c AS (SELECT i / 100.0::DOUBLE AS alpha, 0.5::DOUBLE + (i / 100.0::DOUBLE + (1.0::DOUBLE - i / 100.0::DOUBLE) * ms) * (cs - 0.5::DOUBLE) AS s, gt FROM u, range(101) t(i))
SELECT alpha, round(avg(abs(s - gt)), 6) AS mae, round(coalesce(corr(s, gt), 0), 6) AS pearson FROM c GROUP BY 1 ORDER BY mae, alpha LIMIT 1""")
def alpha_best(s, d):
    """The alpha with the least error (ties: the smallest), with its error and correlation."""
    from grainfold.functions.verdicts import alpha_confidence

    cs, ms = _cs_ms()
    u = reviews(s, d, "review_text", "tag_is_a_positive_review").where("tag_is_a_positive_review IS NOT NULL").select(cs.alias("cs"), ms.alias("ms"), F.col("tag_is_a_positive_review").cast("int").alias("gt"))
    grid = u.withColumn("alpha", F.explode(F.transform(F.sequence(F.lit(0), F.lit(100)), lambda i: i / F.lit(100.0))))
    return metrics.best(metrics.mean_error_and_correlation(grid, alpha_confidence(F.col("cs"), F.col("ms"), F.col("alpha")), F.col("gt"), "alpha"), "alpha", "mae")


# ---------------------------------------------------------------- judges that call a model

_CLEAN = PredicateSpec("is clearly positive", "objective", tuple(Question(i, k, t) for (i, k), t in zip(question_ids("is_clearly_positive", 3, 2), ("Is it graceful?", "Is it tender?", "Does it earn applause?", "Is it long enough?", "Are there sentences?"))))
_RELATED = PredicateSpec(POS, "objective", tuple(Question(i, k, "|".join(w)) for (i, k), w in zip(question_ids(canonicalize(POS), related=6), QUESTIONS[POS])))


def _answers(kind: str, n: int, text: str) -> str:
    low = text.lower()
    if kind == "related":
        return "".join("T" if any(w in low for w in g) else "F" for g in QUESTIONS[POS])
    content_ = "".join("T" if any(w in low for w in g) else "F" for g in QUESTIONS[POS][:3])
    return content_ + ("T" if len(text) >= 200 else "F") + ("T" if "." in text else "U")


def _stand_in(phrase: str, questions: Sequence[tuple[str, str, str]], texts: Sequence[str]) -> str:
    """Compact positional answers, as JSON; rows of a batch by their number, last one first."""
    own = [_answers(questions[0][1], len(questions), t) for t in texts]
    return json.dumps(own[0] if len(own) == 1 else [{"index": i + 1, "answers": a} for i, a in reversed(list(enumerate(own)))])


_SUB = f"""SELECT parent_asin, ({" + ".join(f"CASE WHEN coalesce({_q(w)}, false) THEN 1 ELSE 0 END" for w in QUESTIONS[POS][:3])}) / 3.0::DOUBLE AS content,
 (CASE WHEN length(review_text) >= 200 THEN 1 ELSE 0 END + CASE WHEN contains(review_text, '.') THEN 1 ELSE 0.5 END) / 2.0::DOUBLE AS meta FROM movie_reviews"""


def _sub_source(spec: PredicateSpec) -> SubQuestionSource:
    return SubQuestionSource({spec.phrase: spec}, _stand_in, "review_text")


@query("sub_question_scores", f"SELECT parent_asin, round(content, 9) AS content, round(meta, 9) AS meta FROM ({_SUB})")
def sub_question_scores(s, d):
    """Means of the sub-answers by kind, from the answers to batched calls."""
    calls = written(_sub_source(_CLEAN).calls(reviews(s, d, "review_text"), "parent_asin", _CLEAN.phrase, Step(1)), "calls")
    return sub_scores(calls, "parent_asin").select("parent_asin", F.round("content", 9).alias("content"), F.round("meta", 9).alias("meta"))


@query("sub_question_cascade", f"SELECT parent_asin, (CASE WHEN review_text IS NULL THEN false ELSE {_dir(POS, 6, True)} END) AS answer FROM movie_reviews")
def sub_question_cascade(s, d):
    """One forced step by six related questions, several rows a call; a null text holds no word."""
    r = reviews(s, d, "review_text")
    return staged(r.select("parent_asin"), "parent_asin", r, CascadePlan(logic.parse(POS), KIND, ONE), _sub_source(_RELATED)).state.select("parent_asin", "answer")


@query("sub_question_missing", "SELECT count(*) AS n, count(*) AS undecided, 0.15::DOUBLE AS confidence FROM movie_reviews")
def sub_question_missing(s, d):
    """A model that cannot be reached: all answers are MISSING, all rows undecided."""
    calls = reviews(s, d).select("parent_asin", F.explode(F.array(*[F.struct(F.lit(q.id).alias("sub_id"), F.lit(q.kind).alias("kind")) for q in _CLEAN.questions])).alias("q"))
    calls = calls.select("parent_asin", F.lit(_CLEAN.phrase).alias("slug"), "q.sub_id", "q.kind", F.lit("MISSING").alias("answer"), F.lit("").alias("batch_id"), F.lit(1).alias("batch_size"))
    v = verdict_of(sub_scores(calls, "parent_asin"), False)
    return v.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("v.direction").isNull()).alias("undecided"), F.round(F.max("v.confidence"), 9).alias("confidence"))


_THREE = (POS, NEG, ACT)


def _three(predicates: Sequence[str], text: str) -> str:
    low = text.lower()
    rows = [{"predicate_idx": i, "answer": any(w in low for g in QUESTIONS[p] for w in g)} for i, p in enumerate(predicates)]
    return "```json\n" + json.dumps({"results": rows if len(text) % 2 else rows[:-1]}) + "\n```"


@query("multi_predicate_judge", f"""WITH r AS (SELECT coalesce(review_text, '') AS review_text FROM movie_reviews)
SELECT * FROM ({" UNION ALL ".join(f"SELECT {i} AS predicate_idx, coalesce({' OR '.join(_q(w) for w in QUESTIONS[p])}, false) AS answer, CAST(NULL AS VARCHAR) AS error, count(*) AS n FROM r {'WHERE length(review_text) % 2 = 1' if i == 2 else ''} GROUP BY 2" for i, p in enumerate(_THREE))}
UNION ALL SELECT NULL, NULL, 'missing 2', count(*) FROM r WHERE length(review_text) % 2 = 0)""")
def multi_predicate_judge(s, d):
    """Three predicates in one call a row; the last answer is left out for every other row."""
    got = ask_predicates(reviews(s, d, "review_text"), "parent_asin", "review_text", _THREE, _three)
    return got.groupBy("predicate_idx", "answer", "error").agg(F.count(F.lit(1)).alias("n"))


@query("sem_map", "SELECT parent_asin, CASE WHEN TRY_CAST(trim(original_score) AS DOUBLE) BETWEEN 1 AND 5 THEN TRY_CAST(trim(original_score) AS DOUBLE) ELSE 3.0::DOUBLE END AS score FROM movie_reviews")
def sem_map_q(s, d):
    """A model that repeats the score field: numbers from 1 to 5 count, all else is 3."""
    return sem_map(reviews(s, d, "original_score"), "original_score", "score", lambda texts: list(texts)).select("parent_asin", "score")


_PROXY = """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL),
p AS (SELECT q.vec_id AS query, e.vec_id, list_cosine_similarity(q.v, e.v) AS score, q.label = e.label AS same FROM e q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0)"""


@query("sem_join_proxy", _PROXY + " SELECT query, vec_id, score < 0.5 AS judged FROM p WHERE score >= 0.5 OR (score >= 0.1 AND same)")
def sem_join_proxy(s, d):
    """Semantic join with embeddings as proxy: sure above 0.5, judged down to 0.1, no below."""
    e = table(s, d, "embeddings").select("vec_id", "embedding", "label")
    scored = semantic.proxy_scores(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", 0.1)
    labels = e.select("vec_id", "label")
    return semantic.approximate_join(scored, labels, labels, "vec_id", 0.5, lambda pdf: pd.Series(pdf["l_label"] == pdf["r_label"])).select("query", "vec_id", "judged")


# ---------------------------------------------------------------- the planner

REVIEWS = TableSpec("movie_reviews", "parent_asin", ("review_text",), ("outlet", "sentiment_conf", "critic_name"))
_PLAN = {"structural": [{"column": "sentiment_conf", "op": ">=", "value": 0.5}], "predicates": [{"phrase": POS}, {"phrase": ACT}], "logic": {"op": "AND", "children": [0, 1]}}
_WHERE = "sentiment_conf >= 0.5"  # NaN counts as largest in both


def _rows(s, d) -> DataFrame:
    return reviews(s, d, "review_text", "outlet", "sentiment_conf", "critic_name")


def _plan(**over):
    return plan_from_json({**_PLAN, **over}, REVIEWS)


@query("plan_structural", f"SELECT parent_asin FROM movie_reviews WHERE {_WHERE} AND outlet = 'Open Reel'")
def plan_structural(s, d):
    """A query without predicates ends after the filter."""
    more = [*_PLAN["structural"], {"column": "outlet", "op": "=", "value": "Open Reel"}]
    return run(_plan(structural=more, predicates=[], logic=None), _rows(s, d), Engine(JUDGE, CONFIG)).answers


@query("plan_cascade", f"SELECT parent_asin FROM movie_reviews WHERE {_WHERE} AND {_leaf(POS)} AND {_leaf(ACT)}")
def plan_cascade(s, d):
    """Filter, kill rates on a sample, leaves in the order they give, cascade."""
    return run(_plan(), _rows(s, d), Engine(JUDGE, CONFIG)).answers


@query("plan_limit", f"SELECT parent_asin FROM movie_reviews WHERE {_WHERE} AND {_leaf(POS)} AND {_leaf(ACT)} ORDER BY 1 LIMIT 20")
def plan_limit(s, d):
    return run(_plan(limit=20), _rows(s, d), Engine(JUDGE, CONFIG)).answers


@query("plan_chunks", f"SELECT parent_asin FROM movie_reviews WHERE {_WHERE} AND outlet = 'Open Reel' AND {_leaf(POS)}")
def plan_chunks(s, d):
    """A model source asked chunk by chunk."""
    more = [*_PLAN["structural"], {"column": "outlet", "op": "=", "value": "Open Reel"}]
    r = _rows(s, d)
    return run(_plan(structural=more, predicates=[{"phrase": POS}], logic=0), r, Engine(JUDGE, CONFIG, chunk=max(200, r.count() // 40))).answers


_T = f"t AS (SELECT parent_asin, tag_value AS k FROM snap WHERE predicate_canon = '{POS}' AND {_TRUST.replace(chr(39) + 'text_image' + chr(39), chr(39) + 'text' + chr(39))})"


def _trusted_tags(s, d) -> DataFrame:
    return written(snap(s, d).where(tags.trusted(CONFIG)), "tags")


@query("plan_warm", f"WITH {_SNAP}, {_T} SELECT r.parent_asin FROM movie_reviews r LEFT JOIN t USING (parent_asin) WHERE coalesce(k, {_leaf(POS)})")
def plan_warm(s, d):
    """Stored answers first, the rest judged."""
    return run(_plan(structural=[], predicates=[{"phrase": POS}], logic=0), _rows(s, d), Engine(JUDGE, CONFIG, tags=_trusted_tags(s, d))).answers


_NOT = "is not a positive review"
_NEGATED = f"coalesce(CASE WHEN {_conf(POS, 2)} >= 0.7 THEN NOT {_dir(POS, 2)} END, CASE WHEN {_conf(POS, 4)} >= 0.6 THEN NOT {_dir(POS, 4)} END, NOT {_dir(POS, 6)}, false)"


@query("plan_negation", f"WITH {_SNAP}, {_T} SELECT r.parent_asin FROM movie_reviews r LEFT JOIN t USING (parent_asin) WHERE coalesce(NOT k, {_NEGATED})")
def plan_negation(s, d):
    """The negation of a stored predicate: its tags are inverted, and so are fresh answers."""
    relations = tags.Relations({(_NOT.replace("-", " "), POS): tags.NEGATION})
    return run(_plan(structural=[], predicates=[{"phrase": _NOT}], logic=0), _rows(s, d), Engine(JUDGE, CONFIG, relations, _trusted_tags(s, d))).answers


@query("plan_calls_warm", f"SELECT true AS judged_first, CAST(0 AS BIGINT) AS calls_again, count(*) FILTER (WHERE {_leaf(POS)} AND {_leaf(ACT)}) AS answers, true AS same FROM movie_reviews")
def plan_calls_warm(s, d):
    """The same query twice over one tag table: the second time nothing is judged."""
    plan = _plan(structural=[])
    empty = snap(s, d).where("false")
    config = CONFIG_TRUSTING
    first = run(plan, _rows(s, d), Engine(JUDGE, config, tags=empty))
    again = run(plan, _rows(s, d), Engine(JUDGE, config, tags=written(first.tags, "tags")))
    a, b = written(first.answers, "first"), written(again.answers, "again")
    n = a.count()
    return s.createDataFrame([(first.calls > 0, int(again.calls), n, n == b.count() and a.join(b, "parent_asin", "left_anti").isEmpty())], "judged_first boolean, calls_again bigint, answers bigint, same boolean")


#: Stored answers count whatever their confidence: a settled answer was settled by its own gate.
CONFIG_TRUSTING = replace(CONFIG, recheck={1: 0.0, 2: 0.0, 3: 0.0})


class DryRun:
    """A judge that says FALSE with confidence 0: nothing settles before the last step."""

    text = "parent_asin"

    def twice(self, slug, tier, low=None):
        return F.lit(0)

    def verdict(self, slug, step, force, twice=None):
        return F.struct(F.lit(False).alias("direction"), F.lit(0.0).alias("confidence"))


@query("dry_run_upper_bound", "SELECT CAST(5 * count(*) AS BIGINT) AS calls FROM movie_reviews")
def dry_run_upper_bound(s, d):
    """Calls of an AND of two predicates if nothing settles early: two steps each, then the
    first one's last step, which rules the other's out."""
    c = one_plan(reviews(s, d), CascadePlan(logic.parse(f"{POS} AND {ACT}"), KIND, CONFIG), DryRun())
    return c.agg(F.sum(F.col("calls_t1") + F.col("calls_t2") + F.col("calls_t3")).cast("bigint").alias("calls"))


@query("attributed_share", f"""WITH {_SNAP}, b AS (SELECT *, coalesce(CAST(date_trunc('hour', source_updated_at AT TIME ZONE 'UTC') AS VARCHAR), parent_asin) AS batch, CASE settled_tier WHEN 1 THEN 13 WHEN 2 THEN 200 WHEN 3 THEN 1330 ELSE 0 END AS cost FROM snap)
SELECT parent_asin, predicate_canon, CAST(sum(cost) OVER (PARTITION BY predicate_canon, batch) AS DOUBLE) / count(*) OVER (PARTITION BY predicate_canon, batch) AS share FROM b""")
def attributed_share(s, d):
    """A batch's total cost over its rows; a row without a time is a batch of its own."""
    tier = F.col("settled_tier")
    b = snap(s, d).select("parent_asin", "predicate_canon", F.coalesce(F.date_trunc("hour", "source_updated_at").cast("string"), F.col("parent_asin")).alias("batch"), F.when(tier == 1, 13).when(tier == 2, 200).when(tier == 3, 1330).otherwise(0).alias("cost"))
    total = b.groupBy("predicate_canon", "batch").agg((F.sum("cost").cast("double") / F.count(F.lit(1))).alias("share"))
    return b.join(total, ["predicate_canon", "batch"]).select("parent_asin", "predicate_canon", "share")
