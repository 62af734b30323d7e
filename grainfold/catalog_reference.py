"""Queries of the semantic engine and its relational layer, and their SQL.

Judges are column expressions (word questions on the whole review text), so the same
verdicts can be computed in plain SQL and every answer can be checked.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grainfold.functions import logic, verdicts
from grainfold.functions.text import canonical_column, compare, listing_block, mini_filter, text_block, token_estimate
from grainfold.operators import metrics, relational
from grainfold.operators.skew import key_text
from grainfold.plans import tags
from grainfold.plans.cascade import CascadePlan, kill_rates, one_plan, read_rates, staged
from grainfold.plans.planner import judge_until
from grainfold.plans.judges import RecordedSource, VectorSource, WordQuestions
from grainfold.plans.specs import CascadeConfig, Step, single_stage, text_only, trim_routes
from grainfold.session import table, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# ---------------------------------------------------------------- judges
# Each question holds if the text has one of its words.
POS, NEG, ACT = "is a positive review", "is a negative review", "praises an actor"
QUESTIONS = {
    POS: (("graceful", "luminous", "moving"), ("tender", "deft", "precise"), ("earns the applause", "makes it sing", "holds the centre"), ("inventive", "witty"), ("spirited", "radiant", "warm"), ("gives it weight", "rises to the moment")),
    NEG: (("dreary", "murky", "hollow"), ("tepid", "sluggish", "laboured"), ("misses the mark", "feels borrowed", "overstays the welcome"), ("bloated", "forced"), ("chaotic", "garbled", "drab"), ("winks too often", "loses the thread")),
    ACT: (("cast", "ensemble"), ("lead", "star"), ("actor", "comic"), ("plays", "channels"), ("inhabits", "becomes"), ("performance", "sketches")),
}
BY_TIER = {1: 2, 2: 4, 3: 6}
JUDGE = WordQuestions(QUESTIONS, BY_TIER)
KIND = dict.fromkeys(QUESTIONS, "objective")
CONFIG, ONE = text_only(), single_stage()
TAU = {1: "0.7", 2: "0.6"}


def reviews(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return table(spark, d, "movie_reviews").select("parent_asin", *cols)


def snap(spark: SparkSession, d: str) -> DataFrame:
    return tags.snapshot(table(spark, d, "tag_meta"))


def plan(text: str, config: CascadeConfig = CONFIG) -> CascadePlan:
    return CascadePlan(logic.parse(text, list(QUESTIONS)), KIND, config)


def _q(words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower(review_text), '{w}')" for w in words) + ")"


def _nt(slug: str, n: int) -> str:
    return "(" + " + ".join(f"CASE WHEN {_q(w)} THEN 1 ELSE 0 END" for w in QUESTIONS[slug][:n]) + ")"


def _twice(slug: str, n: int) -> str:
    return f"(CASE WHEN review_text IS NULL THEN {n} ELSE 2 * {_nt(slug, n)} END)"


def _dir(slug: str, n: int, force: bool = False) -> str:
    t = _twice(slug, n)
    return f"(CASE WHEN {t} > {n} THEN true WHEN {t} < {n} THEN false ELSE {'false' if force else 'NULL'} END)"


def _conf(slug: str, n: int) -> str:
    r = f"(CAST({_twice(slug, n)} AS DOUBLE) / {2 * n})"
    return f"greatest({r}, 1 - {r})"


def _leaf(slug: str) -> str:
    """The value of a leaf judged on its own: the first tier that settles it."""
    return f"coalesce(CASE WHEN {_conf(slug, 2)} >= 0.7 THEN {_dir(slug, 2)} END, CASE WHEN {_conf(slug, 4)} >= 0.6 THEN {_dir(slug, 4)} END, {_dir(slug, 6, True)})"


_SNAP = """snap AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY parent_asin, predicate_canon ORDER BY source_updated_at DESC NULLS LAST,
  confidence DESC NULLS LAST, tag_value DESC NULLS LAST, settled_tier DESC NULLS LAST, settled_modality DESC NULLS LAST) AS n FROM tag_meta) WHERE n = 1)"""
_MID = "nullif(lower(trim(id)), '')"

# ---------------------------------------------------------------- scans, filters, projections


@query("scan_structural", "SELECT id, audience_score FROM movies WHERE audience_score >= 70 AND original_language = 'English'")
def scan_structural(s, d):
    return table(s, d, "movies").where(compare("audience_score", ">=", 70.0) & compare("original_language", "=", "English")).select("id", "audience_score")


@query("filter_ops", """SELECT count(*) FILTER (WHERE tomato_meter < 50) AS lt, count(*) FILTER (WHERE tomato_meter <= 50) AS le, count(*) FILTER (WHERE tomato_meter > 50) AS gt,
  count(*) FILTER (WHERE tomato_meter >= 50) AS ge, count(*) FILTER (WHERE tomato_meter = 50) AS eq, count(*) FILTER (WHERE tomato_meter != 50) AS ne FROM movies WHERE tomato_meter IS NULL OR NOT isnan(tomato_meter)""")
def filter_ops(s, d):
    m = table(s, d, "movies").where("tomato_meter IS NULL OR NOT isnan(tomato_meter)")
    return m.agg(*[F.count_if(compare("tomato_meter", op, 50.0)).alias(n) for n, op in (("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">="), ("eq", "="), ("ne", "!="))])


@query("filter_like", "SELECT id, title FROM movies WHERE title LIKE 'The %'")
def filter_like(s, d):
    return table(s, d, "movies").where(compare("title", "LIKE", "The %")).select("id", "title")


@query("filter_mini_language", "SELECT id FROM movies WHERE tomato_meter >= 60 AND original_language = 'English' AND audience_score != 75.5")
def filter_mini_language(s, d):
    m = table(s, d, "movies")
    return m.where(mini_filter("tomato_meter", ">= 60") & mini_filter("original_language", "= 'English'") & mini_filter("audience_score", "!= 75.5")).select("id")


@query("structural_verify", "SELECT count(*) > 0 AS verified, count(*) AS total, count(*) FILTER (WHERE audience_score > 60 AND title LIKE '%a%') AS matches FROM movies")
def structural_verify(s, d):
    cond = compare("audience_score", ">", 60.0) & compare("title", "LIKE", "%a%")
    return table(s, d, "movies").agg((F.count(F.lit(1)) > 0).alias("verified"), F.count(F.lit(1)).alias("total"), F.count_if(cond).alias("matches"))


@query("text_block", """SELECT parent_asin, concat_ws(chr(10) || chr(10), CASE WHEN title <> '' THEN 'Title: ' || title END,
  CASE WHEN len(list_filter(features, lambda x: x IS NOT NULL AND x <> '')) > 0 THEN 'Features:' || chr(10) || array_to_string(list_transform(list_filter(features, lambda x: x IS NOT NULL AND x <> ''), lambda x: '- ' || x), chr(10)) END,
  CASE WHEN len(list_filter(description, lambda x: x IS NOT NULL AND x <> '')) > 0 THEN 'Description:' || chr(10) || array_to_string(list_transform(list_filter(description, lambda x: x IS NOT NULL AND x <> ''), lambda x: '- ' || x), chr(10)) END) AS block FROM movie_reviews""")
def text_block_q(s, d):
    return reviews(s, d, "title", "features", "description").select("parent_asin", text_block(F.col("title"), F.col("features"), F.col("description")).alias("block"))


@query("listing_block", """SELECT parent_asin, concat_ws(chr(10), title, CASE WHEN len(list_filter(features[1:12], lambda x: x IS NOT NULL AND x <> '')) > 0 THEN array_to_string(list_transform(list_filter(features[1:12], lambda x: x IS NOT NULL AND x <> ''), lambda x: '- ' || x), chr(10)) END,
  CASE WHEN len(features) > 12 THEN '(' || CAST(len(features) - 12 AS VARCHAR) || ' more omitted)' END, 'Image: ' || image_url) AS block FROM movie_reviews""")
def listing_block_q(s, d):
    return reviews(s, d, "title", "features", "image_url").select("parent_asin", listing_block(F.col("title"), F.col("features"), F.col("image_url")).alias("block"))


@query("token_estimate", "SELECT parent_asin, CAST(length(review_text) // 4 AS INTEGER) AS tokens FROM movie_reviews WHERE review_text IS NOT NULL")
def token_estimate_q(s, d):
    return reviews(s, d, "review_text").where("review_text IS NOT NULL").select("parent_asin", token_estimate(F.col("review_text")).alias("tokens"))


@query("canonicalize", "SELECT DISTINCT title, substr('tag_' || trim(regexp_replace(lower(trim(title)), '[^a-z0-9]+', '_', 'g'), '_'), 1, 63) AS name FROM movie_reviews WHERE title IS NOT NULL")
def canonicalize_q(s, d):
    return table(s, d, "movie_reviews").where("title IS NOT NULL").select("title").distinct().select("title", canonical_column(F.col("title")).alias("name"))


@query("score_parse_fraction", """SELECT parent_asin, TRY_CAST(split_part(original_score, '/', 1) AS DOUBLE) / TRY_CAST(split_part(original_score, '/', 2) AS DOUBLE) AS fraction
FROM movie_reviews WHERE original_score LIKE '%/%' AND TRY_CAST(split_part(original_score, '/', 2) AS DOUBLE) > 0""")
def score_parse_fraction(s, d):
    part = lambda i: F.split_part("original_score", F.lit("/"), F.lit(i)).try_cast("double")
    return reviews(s, d, "original_score").where(F.col("original_score").like("%/%") & (part(2) > 0)).select("parent_asin", (part(1) / part(2)).alias("fraction"))


# ---------------------------------------------------------------- state and joins


@query("modality_init", """SELECT parent_asin, CASE WHEN title <> '' THEN 0 ELSE -1 END AS modality_text, CASE WHEN has_image THEN 0 ELSE -1 END AS modality_image FROM movie_reviews""")
def modality_init(s, d):
    return reviews(s, d, "title", "has_image").select("parent_asin", F.when(F.col("title") != "", 0).otherwise(-1).alias("modality_text"), F.when(F.col("has_image"), 0).otherwise(-1).alias("modality_image"))


def _state(s, d) -> DataFrame:
    """Reviews x predicates; the predicates (a handful, of fixed number) ride along as one array."""
    preds = table(s, d, "predicate_store").agg(F.collect_list(F.struct("predicate_idx", "predicate_nl")).alias("ps"))
    rows = modality_init(s, d).join(F.broadcast(preds), F.size("ps") > 0)  # one row
    return rows.select("parent_asin", "modality_text", "modality_image", F.explode("ps").alias("p")).select("parent_asin", "p.predicate_idx", "p.predicate_nl", "modality_text", "modality_image")


@query("state_cross", """SELECT p.predicate_idx, CASE WHEN r.title <> '' THEN 0 ELSE -1 END AS modality_text, CASE WHEN r.has_image THEN 0 ELSE -1 END AS modality_image, count(*) AS n
FROM movie_reviews r, predicate_store p GROUP BY ALL""")
def state_cross(s, d):
    return _state(s, d).groupBy("predicate_idx", "modality_text", "modality_image").agg(F.count(F.lit(1)).alias("n"))


@query("pending_anti", """SELECT p.predicate_idx, count(*) AS n FROM movie_reviews r, predicate_store p
WHERE NOT EXISTS (SELECT 1 FROM tag_meta t WHERE t.parent_asin = r.parent_asin AND t.predicate_canon = p.predicate_nl) GROUP BY 1""")
def pending_anti(s, d):
    done = table(s, d, "tag_meta").select("parent_asin", F.col("predicate_canon").alias("predicate_nl"))
    return _state(s, d).join(done, ["parent_asin", "predicate_nl"], "left_anti").groupBy("predicate_idx").agg(F.count(F.lit(1)).alias("n"))


@query("state_join_predicates", f"""WITH {_SNAP} SELECT p.predicate_type, p.predicate_idx, count(*) AS n, count(tag_value) AS decided FROM snap t JOIN predicate_store p ON p.predicate_nl = t.predicate_canon GROUP BY ALL""")
def state_join_predicates(s, d):
    p = table(s, d, "predicate_store").select("predicate_idx", "predicate_type", "predicate_nl")
    t = snap(s, d)
    return t.join(p, t["predicate_canon"] == p["predicate_nl"]).groupBy("predicate_type", "predicate_idx").agg(F.count(F.lit(1)).alias("n"), F.count("tag_value").alias("decided"))


@query("step_pending", f"""WITH {_SNAP} SELECT CAST(coalesce(settled_tier, 0) AS INTEGER) AS tier, coalesce(settled_modality, 'none') AS modality, count(*) FILTER (WHERE tag_value IS NULL) AS pending, count(*) FILTER (WHERE tag_value IS NOT NULL) AS done
FROM snap GROUP BY 1, 2""")
def step_pending(s, d):
    t = snap(s, d).select(F.coalesce("settled_tier", F.lit(0)).cast("int").alias("tier"), F.coalesce("settled_modality", F.lit("none")).alias("modality"), "tag_value")
    return t.groupBy("tier", "modality").agg(F.count_if(F.col("tag_value").isNull()).alias("pending"), F.count_if(F.col("tag_value").isNotNull()).alias("done"))


@query("known_text_preferred", "SELECT parent_asin, coalesce(tag_is_a_positive_review, tag_positive) AS known FROM movie_reviews")
def known_text_preferred(s, d):
    return reviews(s, d, "tag_is_a_positive_review", "tag_positive").select("parent_asin", F.coalesce("tag_is_a_positive_review", "tag_positive").alias("known"))


@query("two_modality_reconcile", """SELECT parent_asin, CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE a AND b END AS tag FROM
(SELECT parent_asin, tag_is_a_positive_review AS a, tag_is_clearly_positive AS b FROM movie_reviews)""")
def two_modality_reconcile(s, d):
    r = reviews(s, d, "tag_is_a_positive_review", "tag_is_clearly_positive")
    return r.select("parent_asin", verdicts.reconcile(F.col("tag_is_a_positive_review"), F.col("tag_is_clearly_positive")).alias("tag"))


@query("tag_left_join", f"""WITH {_SNAP} SELECT r.parent_asin, t.tag_value, t.confidence FROM movie_reviews r LEFT JOIN snap t ON t.parent_asin = r.parent_asin AND t.predicate_canon = '{POS}'""")
def tag_left_join(s, d):
    t = snap(s, d).where(F.col("predicate_canon") == POS).select("parent_asin", "tag_value", "confidence")
    return reviews(s, d).join(t, "parent_asin", "left")


@query("tag_two_joins", f"""WITH {_SNAP} SELECT count(*) AS n, count(*) FILTER (WHERE a.tag_value AND b.tag_value) AS both, count(*) FILTER (WHERE a.tag_value OR b.tag_value) AS any_of
FROM movie_reviews r LEFT JOIN snap a ON a.parent_asin = r.parent_asin AND a.predicate_canon = '{POS}' LEFT JOIN snap b ON b.parent_asin = r.parent_asin AND b.predicate_canon = '{NEG}'""")
def tag_two_joins(s, d):
    t = snap(s, d)
    one = lambda p, c: t.where(F.col("predicate_canon") == p).select("parent_asin", F.col("tag_value").alias(c))
    j = reviews(s, d).join(one(POS, "a"), "parent_asin", "left").join(one(NEG, "b"), "parent_asin", "left")
    return j.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") & F.col("b")).alias("both"), F.count_if(F.col("a") | F.col("b")).alias("any_of"))


@query("tag_nonempty_columns", """SELECT unnest(list_filter([CASE WHEN count(tag_is_clearly_positive) > 0 THEN 'tag_is_clearly_positive' END, CASE WHEN count(tag_is_a_clearly_positive_review) > 0 THEN 'tag_is_a_clearly_positive_review' END,
 CASE WHEN count(tag_is_a_positive_review) > 0 THEN 'tag_is_a_positive_review' END, CASE WHEN count(tag_is_a_negative_review) > 0 THEN 'tag_is_a_negative_review' END,
 CASE WHEN count(tag_clearly_positive) > 0 THEN 'tag_clearly_positive' END, CASE WHEN count(tag_positive) > 0 THEN 'tag_positive' END], lambda x: x IS NOT NULL)) AS tag FROM movie_reviews""")
def tag_nonempty_columns(s, d):
    names = tags.nonempty_tags(table(s, d, "movie_reviews"))
    return s.createDataFrame([(n,) for n in names], "tag string")


@query("tag_pivot_wide", f"""WITH {_SNAP} SELECT parent_asin, bool_or(tag_value) FILTER (WHERE predicate_canon = '{POS}') AS pos, bool_or(tag_value) FILTER (WHERE predicate_canon = '{NEG}') AS neg FROM snap GROUP BY 1""")
def tag_pivot_wide(s, d):
    return tags.wide(snap(s, d), [POS, NEG]).select("parent_asin", F.col(f"`{POS}`").alias("pos"), F.col(f"`{NEG}`").alias("neg"))


@query("tag_provenance_min_conf", f"WITH {_SNAP} SELECT parent_asin, predicate_canon, tag_value, confidence FROM snap WHERE confidence >= 0.8")
def tag_provenance_min_conf(s, d):
    return snap(s, d).where(F.col("confidence") >= 0.8).select("parent_asin", "predicate_canon", "tag_value", "confidence")


# ---------------------------------------------------------------- three-valued logic

_T3 = "SELECT parent_asin, tag_is_a_positive_review AS a, tag_is_clearly_positive AS b, tag_is_a_negative_review AS c FROM movie_reviews"


def _t3(s, d):
    return reviews(s, d, F.col("tag_is_a_positive_review").alias("a"), F.col("tag_is_clearly_positive").alias("b"), F.col("tag_is_a_negative_review").alias("c"))


_ABC = {x: F.col for x in "abc"}


@query("kleene_and_or", f"""SELECT CASE WHEN a = false OR b = false THEN 'F' WHEN a AND b THEN 'T' ELSE 'U' END AS and_, CASE WHEN a OR b THEN 'T' WHEN a = false AND b = false THEN 'F' ELSE 'U' END AS or_, count(*) AS n FROM ({_T3}) GROUP BY 1, 2""")
def kleene_and_or(s, d):
    leaf = {x: F.col(x) for x in "ab"}
    name = lambda c: F.when(c, "T").when(~c, "F").otherwise("U")
    both, any_ = (logic.fold(logic.parse(t), leaf) for t in ("a AND b", "a OR b"))
    return _t3(s, d).select(name(both).alias("and_"), name(any_).alias("or_")).groupBy("and_", "or_").agg(F.count(F.lit(1)).alias("n"))


@query("needed_leaves", f"""SELECT parent_asin, (a IS NULL AND ((a OR b) IS NULL) AND (((a OR b) AND c) IS NULL)) AS need_a, (b IS NULL AND ((a OR b) IS NULL) AND (((a OR b) AND c) IS NULL)) AS need_b,
 (c IS NULL AND (((a OR b) AND c) IS NULL)) AS need_c FROM ({_T3})""")
def needed_leaves(s, d):
    need = logic.needed(logic.parse("(a OR b) AND c"), {x: F.col(x) for x in "abc"})
    return _t3(s, d).select("parent_asin", *[need[x].alias(f"need_{x}") for x in "abc"])


# ---------------------------------------------------------------- verdicts


@query("verdict_related", f"SELECT parent_asin, {_dir(POS, 6)} AS direction, {_dir(POS, 6, True)} AS forced, {_conf(POS, 6)} AS confidence FROM movie_reviews")
def verdict_related(s, d):
    v, f = JUDGE.verdict(POS, Step(3), False), JUDGE.verdict(POS, Step(3), True)
    return reviews(s, d, "review_text").select("parent_asin", v["direction"].alias("direction"), f["direction"].alias("forced"), v["confidence"].alias("confidence"))


def _cs_ms() -> tuple[Column, Column]:
    yes = lambda q: F.when(q.isNull(), F.lit(0.5)).when(q, F.lit(1.0)).otherwise(F.lit(0.0))
    t = F.col("review_text")
    c = JUDGE.answers(POS, 3)[:3]
    m = [F.length(t) >= 200, F.contains(t, F.lit("."))]
    return (yes(c[0]) + yes(c[1]) + yes(c[2])) / F.lit(3.0), (yes(m[0]) + yes(m[1])) / F.lit(2.0)


_yes = lambda q: f"(CASE WHEN {q} IS NULL THEN 0.5::DOUBLE WHEN {q} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"
_CSMS = f"""SELECT parent_asin, ({" + ".join(_yes(_q(w)) for w in QUESTIONS[POS][:3])}) / 3.0::DOUBLE AS cs,
 ({_yes("(length(review_text) >= 200)")} + {_yes("contains(review_text, '.')")}) / 2.0::DOUBLE AS ms FROM movie_reviews"""
_CM = "CAST(0.7 AS DOUBLE) * (2.0::DOUBLE * abs(cs - 0.5::DOUBLE)) + CAST(0.3 AS DOUBLE) * ms"


@query("verdict_content_meta", f"SELECT parent_asin, cs > 0.5 AS direction, {_CM} AS confidence FROM ({_CSMS})")
def verdict_content_meta(s, d):
    cs, ms = _cs_ms()
    return reviews(s, d, "review_text").select("parent_asin", cs.alias("cs"), ms.alias("ms")).select("parent_asin", verdicts.content_meta(F.col("cs"), F.col("ms")).alias("v")).select("parent_asin", "v.direction", "v.confidence")


@query("verdict_theta", f"SELECT parent_asin, cs > 0.67 AS direction, {_CM} AS confidence FROM ({_CSMS})")
def verdict_theta(s, d):
    cs, ms = _cs_ms()
    return reviews(s, d, "review_text").select("parent_asin", cs.alias("cs"), ms.alias("ms")).select("parent_asin", verdicts.content_meta(F.col("cs"), F.col("ms"), 0.67).alias("v")).select("parent_asin", "v.direction", "v.confidence")


@query("alpha_confidence", f"SELECT parent_asin, 0.5::DOUBLE + (0.4::DOUBLE + (1.0::DOUBLE - 0.4::DOUBLE) * ms) * (cs - 0.5::DOUBLE) AS confidence FROM ({_CSMS})")
def alpha_confidence(s, d):
    cs, ms = _cs_ms()
    return reviews(s, d, "review_text").select("parent_asin", verdicts.alpha_confidence(cs, ms, 0.4).alias("confidence"))


_UNITS = f"SELECT u.parent_asin, cs, ms, CAST(tag_is_a_positive_review AS INTEGER) AS gt FROM ({_CSMS}) u JOIN movie_reviews r USING (parent_asin) WHERE tag_is_a_positive_review IS NOT NULL"


@query("soft_label_units", _UNITS)
def soft_label_units(s, d):
    cs, ms = _cs_ms()
    r = reviews(s, d, "review_text", "tag_is_a_positive_review").where("tag_is_a_positive_review IS NOT NULL")
    return r.select("parent_asin", cs.alias("cs"), ms.alias("ms"), F.col("tag_is_a_positive_review").cast("int").alias("gt"))


@query("alpha_grid", f"""WITH a AS (SELECT i / 100.0::DOUBLE AS alpha FROM range(101) t(i)), c AS (SELECT cs, ms, gt, count(*) AS n FROM ({_UNITS}) GROUP BY ALL)
SELECT alpha, round(CAST(sum(n * abs(0.5::DOUBLE + (alpha + (1.0::DOUBLE - alpha) * ms) * (cs - 0.5::DOUBLE) - gt)) AS DOUBLE) / sum(n), 6) AS mae FROM a, c GROUP BY alpha""")
def alpha_grid(s, d):
    """Mean absolute error for 101 alphas; units are first counted by their few distinct values."""
    cells = soft_label_units(s, d).groupBy("cs", "ms", "gt").agg(F.count(F.lit(1)).alias("n"))
    grid = cells.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(100)))).withColumn("alpha", F.col("i") / F.lit(100.0))
    err = F.abs(verdicts.alpha_confidence(F.col("cs"), F.col("ms"), F.col("alpha")) - F.col("gt"))
    return grid.groupBy("alpha").agg(F.round(F.sum(F.col("n") * err) / F.sum("n"), 6).alias("mae"))


@query("gate_tau", f"SELECT parent_asin, CASE WHEN {_conf(POS, 4)} >= 0.7 THEN {_dir(POS, 4)} END AS strict, CASE WHEN {_conf(POS, 4)} >= 0.6 THEN {_dir(POS, 4)} END AS lenient, {_dir(POS, 4)} AS forced FROM movie_reviews")
def gate_tau(s, d):
    v = JUDGE.verdict(POS, Step(2), False)
    g = lambda tau, force=False: verdicts.gate(v["direction"], v["confidence"], F.lit(tau), force)
    return reviews(s, d, "review_text").select("parent_asin", g(0.7).alias("strict"), g(0.6).alias("lenient"), g(1.0, True).alias("forced"))


# ---------------------------------------------------------------- cascades


def _cascade(s, d, text: str, config: CascadeConfig = CONFIG) -> DataFrame:
    return one_plan(reviews(s, d, "review_text"), plan(text, config), JUDGE)


def _answer(text: str, config: CascadeConfig = CONFIG) -> Query:
    return lambda s, d: _cascade(s, d, text, config).select("parent_asin", "answer")


_P, _N, _A = _leaf(POS), _leaf(NEG), _leaf(ACT)
query("cascade_single_stage", f"SELECT parent_asin, {_dir(POS, 4, True)} AS answer FROM movie_reviews")(_answer(POS, ONE))
query("cascade_three_tier_force", f"SELECT parent_asin, {_P} AS answer FROM movie_reviews")(_answer(POS))
query("cascade_and_tree", f"SELECT parent_asin, ({_P} AND {_A}) AS answer FROM movie_reviews")(_answer(f"{POS} AND {ACT}"))
query("cascade_or_tree", f"SELECT parent_asin, ({_P} OR {_N}) AS answer FROM movie_reviews")(_answer(f"{POS} OR {NEG}"))
query("cascade_nested_tree", f"SELECT parent_asin, (({_P} OR {_N}) AND {_A}) AS answer FROM movie_reviews")(_answer(f"({POS} OR {NEG}) AND {ACT}"))


@query("cascade_two_tier", f"""SELECT parent_asin, coalesce(CASE WHEN {_conf(POS, 2)} >= 0.7 THEN {_dir(POS, 2)} END, CASE WHEN {_conf(POS, 4)} >= 0.6 THEN {_dir(POS, 4)} END) AS before_last,
 CASE WHEN {_conf(POS, 2)} >= 0.7 AND {_dir(POS, 2)} IS NOT NULL THEN 1 WHEN {_conf(POS, 4)} >= 0.6 AND {_dir(POS, 4)} IS NOT NULL THEN 2 ELSE 3 END AS tier FROM movie_reviews""")
def cascade_two_tier(s, d):
    c = _cascade(s, d, POS)
    return c.select("parent_asin", F.when(F.col(f"tier_{POS}") < 3, F.col("answer")).alias("before_last"), F.col(f"tier_{POS}").alias("tier"))


def _chain(leaves: tuple[str, ...], root: str) -> str:
    """Stepwise SQL of an AND of two leaves: which judgements are made, in order."""
    n = {1: 2, 2: 4, 3: 6}
    prev, ctes = "movie_reviews", []
    start = ", ".join(f"CAST(NULL AS BOOLEAN) AS k{i}" for i in range(len(leaves)))
    ctes.append(f"s0 AS (SELECT parent_asin, review_text, {start}, 0 AS c1, 0 AS c2, 0 AS c3 FROM {prev})")
    at = 0
    for tier in (1, 2, 3):
        for i, slug in enumerate(leaves):
            todo = f"(k{i} IS NULL AND ({root}) IS NULL)"
            value = _dir(slug, 6, True) if tier == 3 else f"CASE WHEN {_conf(slug, n[tier])} >= {TAU[tier]} THEN {_dir(slug, n[tier])} END"
            ctes.append(f"s{at + 1} AS (SELECT * REPLACE (CASE WHEN {todo} THEN {value} ELSE k{i} END AS k{i}, c{tier} + CAST({todo} AS INTEGER) AS c{tier}) FROM s{at})")
            at += 1
    return "WITH " + ", ".join(ctes) + f" SELECT CAST(sum(c1) AS BIGINT) AS calls_t1, CAST(sum(c2) AS BIGINT) AS calls_t2, CAST(sum(c3) AS BIGINT) AS calls_t3 FROM s{at}"


@query("cascade_calls_by_step", _chain((POS, ACT), "k0 AND k1"))
def cascade_calls_by_step(s, d):
    return _cascade(s, d, f"{POS} AND {ACT}").agg(*[F.sum(f"calls_t{t}").alias(f"calls_t{t}") for t in (1, 2, 3)])


@query("cascade_staged", f"SELECT parent_asin, ({_P} AND {_A}) AS answer FROM movie_reviews")
def cascade_staged(s, d):
    r = reviews(s, d, "review_text")
    return staged(r.select("parent_asin"), "parent_asin", r, plan(f"{POS} AND {ACT}"), JUDGE).state.select("parent_asin", "answer")


@query("cascade_recorded", f"SELECT parent_asin, {_P} AS answer FROM movie_reviews")
def cascade_recorded(s, d):
    """Replay: the answers of all steps are recorded first, then read as a table."""
    r = reviews(s, d, "review_text")
    cells = [F.struct(F.lit(st.tier).alias("tier"), JUDGE.verdict(POS, st, st.tier == 3).alias("v")) for st in CONFIG.route("objective")]
    rec = r.select("parent_asin", F.explode(F.array(*cells)).alias("x")).select("parent_asin", F.lit(POS).alias("slug"), "x.tier", F.lit("text").alias("modality"), "x.v.direction", "x.v.confidence", F.lit(0.0).alias("cost"))
    return staged(r.select("parent_asin"), "parent_asin", r.select("parent_asin"), plan(POS), RecordedSource(rec)).state.select("parent_asin", "answer")


@query("kill_rates", f"""WITH v AS (SELECT CASE WHEN {_conf(POS, 2)} >= 0.7 THEN {_dir(POS, 2)} END AS p, CASE WHEN {_conf(ACT, 2)} >= 0.7 THEN {_dir(ACT, 2)} END AS a FROM movie_reviews)
SELECT '{POS}' AS predicate, CAST(count(*) FILTER (WHERE p) AS DOUBLE) / count(*) AS k_true, CAST(count(*) FILTER (WHERE NOT p) AS DOUBLE) / count(*) AS k_false, count(*) AS n FROM v
UNION ALL SELECT '{ACT}', CAST(count(*) FILTER (WHERE a) AS DOUBLE) / count(*), CAST(count(*) FILTER (WHERE NOT a) AS DOUBLE) / count(*), count(*) FROM v""")
def kill_rates_q(s, d):
    return kill_rates(reviews(s, d, "review_text"), plan(f"{POS} AND {ACT}"), JUDGE)


@query("leaf_order", f"""WITH v AS (SELECT CASE WHEN {_conf(POS, 2)} >= 0.7 THEN {_dir(POS, 2)} END AS p, CASE WHEN {_conf(ACT, 2)} >= 0.7 THEN {_dir(ACT, 2)} END AS a FROM movie_reviews),
k AS (SELECT '{POS}' AS predicate, 0 AS place, count(*) FILTER (WHERE NOT p) AS k FROM v UNION ALL SELECT '{ACT}', 1, count(*) FILTER (WHERE NOT a) FROM v)
SELECT CAST(row_number() OVER (ORDER BY k DESC, place) AS INTEGER) AS rnk, predicate FROM k""")
def leaf_order_q(s, d):
    rates = read_rates(kill_rates_q(s, d))
    order = logic.leaf_order(plan(f"{POS} AND {ACT}").tree, rates)
    return s.createDataFrame([(i + 1, n) for i, n in enumerate(order)], "rnk int, predicate string")


@query("chunk_assign", "SELECT parent_asin, CAST((row_number() OVER (ORDER BY md5(parent_asin || '-7'), parent_asin) - 1) // 1000 AS BIGINT) AS chunk FROM movie_reviews")
def chunk_assign(s, d):
    return relational.chunks(reviews(s, d), "parent_asin", 7, 1000)


@query("measure_sample", """SELECT parent_asin FROM (SELECT parent_asin, row_number() OVER (ORDER BY md5(parent_asin || '-7'), parent_asin) AS n, count(*) OVER () AS t FROM movie_reviews) WHERE n <= greatest(1, round_even(0.1 * t, 0))""")
def measure_sample(s, d):
    return relational.sample_fraction(reviews(s, d), "parent_asin", 7, 0.1)


@query("route_trim", f"""WITH {_SNAP}, p AS (SELECT DISTINCT predicate_canon, settled_tier AS tier FROM snap WHERE predicate_canon IN ('{POS}', '{NEG}') AND settled_modality = 'text' AND settled_tier IS NOT NULL)
SELECT CAST(tier AS INTEGER) AS tier, 'text' AS modality FROM p GROUP BY tier HAVING count(*) = 2""")
def route_trim(s, d):
    rows = snap(s, d).where(F.col("predicate_canon").isin(POS, NEG) & F.col("settled_tier").isNotNull()).select("predicate_canon", "settled_tier", "settled_modality").distinct().collect()
    seen: dict[str, set[Step]] = {POS: set(), NEG: set()}
    for r in rows:
        seen[r["predicate_canon"]].add(Step(r["settled_tier"], r["settled_modality"]))
    route = trim_routes(CONFIG, seen, {POS: "objective", NEG: "objective"}).route("objective")
    return s.createDataFrame([(x.tier, x.modality) for x in route], "tier int, modality string")


# ---------------------------------------------------------------- reuse of stored answers

FULL = CascadeConfig()
_TRUST = "(tag_value IS NOT NULL AND settled_tier IS NOT NULL AND (confidence IS NULL OR confidence >= CASE settled_tier WHEN 1 THEN 0.9 WHEN 2 THEN 0.8 ELSE 0.0 END OR (settled_tier = 3 AND settled_modality = 'text_image')))"
_VALUE = {"exact": "tag_value", "equivalent": "tag_value", "negation": "NOT tag_value", "broader": "CASE WHEN tag_value THEN true END", "narrower": "CASE WHEN NOT tag_value THEN false END"}


def _prefilter(rel: str) -> Query:
    def run(s, d):
        rows = tags.with_cached(reviews(s, d), snap(s, d), "x", POS, rel.upper(), FULL)
        return rows.where(F.coalesce(F.col("known_x"), F.lit(True))).select("parent_asin", F.col("known_x").alias("known"))

    return run


for _rel, _v in _VALUE.items():
    query(f"prefilter_{_rel}", f"""WITH {_SNAP}, t AS (SELECT parent_asin, CASE WHEN {_TRUST} THEN {_v} END AS known FROM snap WHERE predicate_canon = '{POS}')
SELECT r.parent_asin, t.known FROM movie_reviews r LEFT JOIN t USING (parent_asin) WHERE t.known IS NULL OR t.known""")(_prefilter(_rel))


@query("prefilter_or_tree", f"""WITH {_SNAP}, p AS (SELECT parent_asin, CASE WHEN {_TRUST} THEN tag_value END AS k FROM snap WHERE predicate_canon = '{POS}'), n AS (SELECT parent_asin, CASE WHEN {_TRUST} THEN tag_value END AS k FROM snap WHERE predicate_canon = '{NEG}')
SELECT r.parent_asin, (p.k OR n.k) AS root FROM movie_reviews r LEFT JOIN p USING (parent_asin) LEFT JOIN n USING (parent_asin) WHERE (p.k OR n.k) IS NOT FALSE""")
def prefilter_or_tree(s, d):
    t = snap(s, d)
    rows = tags.with_cached(tags.with_cached(reviews(s, d), t, "p", POS, tags.EXACT, FULL), t, "n", NEG, tags.EXACT, FULL)
    root = logic.fold(logic.parse("p OR n"), {x: F.col(f"known_{x}") for x in "pn"})
    return rows.select("parent_asin", root.alias("root")).where("root IS NULL OR root")


@query("resume_offsets", f"""WITH {_SNAP} SELECT parent_asin, CASE WHEN {_TRUST} THEN 0 WHEN settled_tier = 1 AND settled_modality = 'text' THEN 1 WHEN settled_tier = 2 AND settled_modality = 'text' THEN 2
 WHEN settled_tier = 1 AND settled_modality = 'text_image' THEN 3 WHEN settled_tier = 2 AND settled_modality = 'text_image' THEN 4 WHEN settled_tier = 3 AND settled_modality = 'text' THEN 5 ELSE 0 END AS start_step FROM snap WHERE predicate_canon = '{POS}'""")
def resume_offsets(s, d):
    t = snap(s, d)
    keys = t.where(F.col("predicate_canon") == POS).select("parent_asin")
    return tags.with_cached(keys, t, "x", POS, tags.EXACT, FULL).select("parent_asin", F.col("start_x").alias("start_step"))


def _warm(s, d) -> DataFrame:
    rows = tags.with_cached(reviews(s, d, "review_text"), snap(s, d), POS, POS, tags.EXACT, CONFIG)
    return one_plan(rows, plan(POS), JUDGE)


@query("warm_calls", f"""WITH {_SNAP}, t AS (SELECT parent_asin, CASE WHEN {_TRUST.replace("'text_image'", "'text'")} THEN tag_value END AS k,
  CASE WHEN {_TRUST.replace("'text_image'", "'text'")} THEN 0 WHEN settled_modality = 'text' AND settled_tier = 1 THEN 1 WHEN settled_modality = 'text' AND settled_tier = 2 THEN 2 ELSE 0 END AS st FROM snap WHERE predicate_canon = '{POS}'),
r AS (SELECT m.review_text, t.k, coalesce(t.st, 0) AS st, CASE WHEN {_conf(POS, 2)} >= 0.7 THEN {_dir(POS, 2)} END AS v1, CASE WHEN {_conf(POS, 4)} >= 0.6 THEN {_dir(POS, 4)} END AS v2 FROM movie_reviews m LEFT JOIN t USING (parent_asin))
SELECT count(*) FILTER (WHERE k IS NULL AND st = 0) AS calls_t1, count(*) FILTER (WHERE k IS NULL AND (st = 1 OR st = 0 AND v1 IS NULL)) AS calls_t2,
  count(*) FILTER (WHERE k IS NULL AND (st = 2 OR st = 1 AND v2 IS NULL OR st = 0 AND v1 IS NULL AND v2 IS NULL)) AS calls_t3 FROM r""")
def warm_calls(s, d):
    return _warm(s, d).agg(*[F.sum(f"calls_t{t}").alias(f"calls_t{t}") for t in (1, 2, 3)])


def _fresh(s, d) -> DataFrame:
    c = _cascade(s, d, NEG)
    return c.select("parent_asin", F.lit(NEG).alias("predicate_canon"), F.col("answer").alias("tag_value"), F.col(f"conf_{NEG}").alias("confidence"), F.col(f"tier_{NEG}").cast("smallint").alias("settled_tier"), F.lit("text").alias("settled_modality"))


_FRESH = f"SELECT parent_asin, '{NEG}' AS predicate_canon, {_N} AS tag_value FROM movie_reviews"


@query("tag_flush", f"""WITH {_SNAP}, f AS ({_FRESH}), a AS (SELECT parent_asin, predicate_canon, tag_value FROM snap WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.parent_asin = snap.parent_asin AND f.predicate_canon = snap.predicate_canon)
UNION ALL SELECT * FROM f) SELECT predicate_canon, count(*) AS n, count(*) FILTER (WHERE tag_value) AS n_true FROM a GROUP BY 1""")
def tag_flush(s, d):
    out = tags.flush(snap(s, d).drop("n"), _fresh(s, d))
    return out.groupBy("predicate_canon").agg(F.count(F.lit(1)).alias("n"), F.count_if("tag_value").alias("n_true"))


@query("tag_upsert", f"""WITH {_SNAP}, o AS (SELECT parent_asin, predicate_canon, tag_value FROM snap WHERE confidence < 0.8), n AS (SELECT parent_asin, predicate_canon, tag_value FROM snap WHERE settled_tier >= 2)
SELECT * FROM n UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.parent_asin = o.parent_asin AND n.predicate_canon = o.predicate_canon)""")
def tag_upsert(s, d):
    t = snap(s, d)
    cols = ("parent_asin", "predicate_canon", "tag_value")
    return tags.upsert(t.where("confidence < 0.8").select(*cols), t.where("settled_tier >= 2").select(*cols), ["parent_asin", "predicate_canon"])


@query("tag_insert_ignore", f"""WITH {_SNAP}, o AS (SELECT parent_asin, predicate_canon, tag_value FROM snap WHERE confidence < 0.8), n AS (SELECT parent_asin, predicate_canon, NOT tag_value AS tag_value FROM snap WHERE settled_tier >= 2)
SELECT * FROM o UNION ALL SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE n.parent_asin = o.parent_asin AND n.predicate_canon = o.predicate_canon)""")
def tag_insert_ignore(s, d):
    t = snap(s, d)
    new = t.where("settled_tier >= 2").select("parent_asin", "predicate_canon", (~F.col("tag_value")).alias("tag_value"))
    return tags.insert_missing(t.where("confidence < 0.8").select("parent_asin", "predicate_canon", "tag_value"), new, ["parent_asin", "predicate_canon"])


@query("reuse_scores", """WITH o AS (SELECT DISTINCT predicate, query_label FROM predicate_query_history WHERE query_label <> 'query_004')
SELECT predicate, CAST(count(*) AS DOUBLE) / (SELECT count(DISTINCT query_label) FROM o) AS score FROM o GROUP BY 1""")
def reuse_scores(s, d):
    return tags.reuse_scores(table(s, d, "predicate_query_history"), "query_004")


@query("predicate_usage", "SELECT predicate, query_label, epoch_us(min(first_seen_at)) AS first_seen_us FROM predicate_query_history GROUP BY 1, 2")
def predicate_usage(s, d):
    return table(s, d, "predicate_query_history").groupBy("predicate", "query_label").agg(F.unix_micros(F.min("first_seen_at")).alias("first_seen_us"))


_CELLS = f"""WITH {_SNAP}, t AS (SELECT parent_asin, CASE WHEN {_TRUST} THEN tag_value END AS k FROM snap WHERE predicate_canon = '{POS}'),
r AS (SELECT m.parent_asin, t.k AS cached, {_P} AS p, {_A} AS a FROM movie_reviews m LEFT JOIN t USING (parent_asin))"""


def _cells(s, d) -> DataFrame:
    rows = tags.with_cached(reviews(s, d, "review_text"), snap(s, d), POS, POS, tags.EXACT, FULL).withColumn("cached", F.col(f"known_{POS}")).withColumn(f"start_{POS}", F.lit(0))
    # The first leaf is settled whole before the second is asked: one predicate after the other.
    first = one_plan(rows, CascadePlan(logic.parse(POS), KIND, CONFIG), JUDGE).drop("answer", *[f"calls_t{t}" for t in (1, 2, 3)])
    both = one_plan(first, CascadePlan(logic.parse(f"{POS} AND {ACT}"), KIND, CONFIG), JUDGE)
    return written(both.select("parent_asin", "cached", *[f"{k}_{n}" for k in ("known", "tier") for n in (POS, ACT)]).toDF("parent_asin", "cached", "known_p", "known_a", "tier_p", "tier_a"), "cells").withColumnsRenamed({"known_p": f"known_{POS}", "known_a": f"known_{ACT}", "tier_p": f"tier_{POS}", "tier_a": f"tier_{ACT}"})


@query("cell_classes", _CELLS + f""" SELECT '{POS}' AS predicate, CASE WHEN cached IS NOT NULL THEN 'reused' ELSE 'settled' END AS class, count(*) AS n FROM r GROUP BY 1, 2
UNION ALL SELECT '{ACT}', CASE WHEN coalesce(cached, p) = false THEN 'short_circuited' ELSE 'settled' END, count(*) FROM r GROUP BY 1, 2""")
def cell_classes(s, d):
    c = _cells(s, d)
    cell = lambda n, reused: F.struct(F.lit(n).alias("predicate"), F.when(reused, "reused").when(F.col(f"known_{n}").isNotNull(), "settled").when(F.col(f"tier_{n}").isNotNull(), "abandoned_U").otherwise("short_circuited").alias("class"))
    long = c.select(F.explode(F.array(cell(POS, F.col("cached").isNotNull()), cell(ACT, F.lit(False)))).alias("x")).select("x.*")
    return long.groupBy("predicate", "class").agg(F.count(F.lit(1)).alias("n"))


@query("sc_reasons", _CELLS + f" SELECT '{POS}' AS cause, count(*) AS n FROM r WHERE coalesce(cached, p) = false HAVING count(*) > 0")
def sc_reasons(s, d):
    c = _cells(s, d)
    cause = logic.blockers(logic.parse(f"{POS} AND {ACT}"), {n: F.col(f"known_{n}") for n in (POS, ACT)})[ACT]
    return c.where(F.col(f"known_{ACT}").isNull() & F.col(f"tier_{ACT}").isNull()).groupBy(cause.alias("cause")).agg(F.count(F.lit(1)).alias("n"))


@query("last_event_wins", f"WITH {_SNAP} SELECT parent_asin, predicate_canon, CASE WHEN tag_value THEN 'matched' WHEN NOT tag_value THEN 'not_matched' ELSE 'inconclusive' END AS status FROM snap")
def last_event_wins(s, d):
    t = F.col("tag_value")
    return snap(s, d).select("parent_asin", "predicate_canon", F.when(t, "matched").when(~t, "not_matched").otherwise("inconclusive").alias("status"))


@query("dedup_keep_first", "SELECT review_id, parent_asin FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY loaded_at, parent_asin) AS n FROM movie_reviews WHERE review_id IS NOT NULL) WHERE n = 1")
def dedup_keep_first(s, d):
    return relational.keep_first(reviews(s, d, "review_id", "loaded_at").where("review_id IS NOT NULL"), ["review_id"], [F.col("loaded_at").asc_nulls_last(), F.col("parent_asin")]).select("review_id", "parent_asin")


# ---------------------------------------------------------------- pairs, scores, counts

_RANKED = f"c AS (SELECT {_MID} AS mid, count(*) AS n FROM movie_reviews GROUP BY 1), k AS (SELECT mid, n FROM c JOIN movies m ON m.id = c.mid)"
_MOVIE_A = f"WITH {_RANKED} SELECT mid FROM k ORDER BY n DESC, mid LIMIT 1"


def _movie(s, d) -> DataFrame:
    """One row: the known movie with most reviews."""
    n = table(s, d, "movie_reviews").select(key_text("id").alias("mid")).groupBy("mid").agg(F.count(F.lit(1)).alias("n"))
    k = n.join(table(s, d, "movies").select(F.col("id").alias("mid")), "mid", "left_semi")
    return k.orderBy(F.col("n").desc(), "mid").limit(1).select(F.col("mid").alias("__mid"))


def _of_movie(s, d, *cols: str) -> DataFrame:
    r = table(s, d, "movie_reviews").select("parent_asin", key_text("id").alias("mid"), *cols)
    one = F.broadcast(_movie(s, d))  # one row
    return r.join(one, r["mid"] == one["__mid"], "left_semi")


def _tagged(s, d, slug: str = POS) -> DataFrame:
    r = _of_movie(s, d, "review_text").select("mid", "parent_asin", JUDGE.twice(slug, 3).alias("twice"))
    v = JUDGE.verdict(slug, Step(3), True, F.col("twice"))
    return r.select("mid", "parent_asin", v["direction"].alias("tag"), v["confidence"].alias("conf"))


def _tags_sql(movie: str) -> str:
    return f"SELECT {_MID} AS mid, parent_asin, {_dir(POS, 6, True)} AS tag, {_conf(POS, 6)} AS conf FROM movie_reviews WHERE {_MID} = ({movie})"


def _pairs_sql(op: str, order: str) -> str:
    return f"""WITH t AS ({_tags_sql(_MOVIE_A)}), p AS (SELECT DISTINCT a.mid, a.parent_asin AS rid1, b.parent_asin AS rid2, least(a.conf, b.conf) AS pair_conf
 FROM t a JOIN t b ON a.mid = b.mid AND a.parent_asin < b.parent_asin AND a.tag {op} b.tag), q AS (SELECT *, row_number() OVER (PARTITION BY rid1 ORDER BY rid2) AS rn FROM p)
SELECT mid AS id, rid1, rid2 FROM q ORDER BY {order} LIMIT 10"""


def _pairs(same: bool, conf: str | None) -> Query:
    """The first ten pairs of the movie with most reviews, found without listing its pairs."""
    return lambda s, d: relational.first_pairs(_tagged(s, d), "mid", "parent_asin", "tag", conf, same).select(F.col("mid").alias("id"), "rid1", "rid2")


query("pairs_same_id", _pairs_sql("=", "rn, rid1, rid2"))(_pairs(True, None))
query("pairs_opposite_id", _pairs_sql("<>", "rn, rid1, rid2"))(_pairs(False, None))
query("pairs_opposite_conf", _pairs_sql("<>", "pair_conf DESC, rn, rid1, rid2"))(_pairs(False, "conf"))


@query("pairs_all", f"""WITH t AS ({_tags_sql(_MOVIE_A)}), p AS (SELECT a.parent_asin AS k, count(*) AS n FROM t a JOIN t b ON a.tag <> b.tag GROUP BY 1)
SELECT mid AS id, parent_asin, tag, coalesce(n, 0) AS n_opposite FROM t LEFT JOIN p ON k = parent_asin""")
def pairs_all(s, d):
    """All opposite pairs of the movie with most reviews, as each review with its class and its
    number of partners: the pairs are every review of one class with every one of the other."""
    return relational.pair_partners(_tagged(s, d), "mid", "parent_asin", "tag").select(F.col("mid").alias("id"), "parent_asin", "tag", "n_opposite")


@query("pairs_ordered", f"""WITH t AS ({_tags_sql(_MOVIE_A)}) SELECT a.tag AS tag1, b.tag AS tag2, count(*) AS n FROM t a JOIN t b ON a.parent_asin <> b.parent_asin GROUP BY 1, 2""")
def pairs_ordered(s, d):
    """Ordered pairs (a, b), a <> b, of the movie with most reviews by the classes of both."""
    n = _tagged(s, d).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    x, y = n.select(F.col("tag").alias("tag1"), F.col("n").alias("n1")), n.select(F.col("tag").alias("tag2"), F.col("n").alias("n2"))
    return x.join(y, F.lit(True)).select("tag1", "tag2", (F.col("n1") * (F.col("n2") - (F.col("tag1") == F.col("tag2")).cast("int"))).alias("n")).where("n > 0")  # two rows each


@query("pair_counts", f"""WITH g AS (SELECT {_MID} AS id, count(*) FILTER (WHERE {_dir(POS, 6, True)}) AS t, count(*) FILTER (WHERE NOT {_dir(POS, 6, True)}) AS f FROM movie_reviews GROUP BY 1)
SELECT id, CAST(t * (t - 1) // 2 + f * (f - 1) // 2 AS BIGINT) AS n_same, CAST(t * f AS BIGINT) AS n_opposite FROM g WHERE id IS NOT NULL""")
def pair_counts(s, d):
    """Same and opposite pairs of every movie, from counts: no pair is formed."""
    v = JUDGE.verdict(POS, Step(3), True)
    r = reviews(s, d, "id", "review_text").select(key_text("id").alias("id"), v["direction"].alias("tag")).where("id IS NOT NULL")
    return relational.pair_counts(r, "id", "tag")


@query("semantic_join_baseline", f"""WITH t AS ({_tags_sql(_MOVIE_A)}) SELECT count(*) FILTER (WHERE a.tag = b.tag) AS n_same, count(*) FILTER (WHERE a.tag <> b.tag) AS n_opposite, count(*) AS judged
FROM t a JOIN t b ON a.mid = b.mid AND a.parent_asin < b.parent_asin""")
def semantic_join_baseline(s, d):
    """What judging every pair of the movie with most reviews comes to. The pair predicate
    factors through one judgement per review, so the pairs are counted, not formed."""
    n = _tagged(s, d).groupBy("mid").agg(F.count_if("tag").alias("t"), F.count_if(~F.col("tag")).alias("f"))
    return n.select(F.expr("t * (t - 1) div 2 + f * (f - 1) div 2").alias("n_same"), F.expr("t * f").alias("n_opposite"), F.expr("(t + f) * (t + f - 1) div 2").alias("judged"))


# The same for every movie, whatever its size: no pairs are listed but the ten asked for.
_ALL_TAGS = f"SELECT {_MID} AS mid, parent_asin, {_dir(POS, 6, True)} AS tag, {_conf(POS, 6)} AS conf FROM movie_reviews WHERE {_MID} IS NOT NULL"


def _all_tagged(s, d) -> DataFrame:
    v = JUDGE.verdict(POS, Step(3), True)
    r = reviews(s, d, "id", "review_text").select("parent_asin", key_text("id").alias("id"), v.alias("v")).where("id IS NOT NULL")
    return r.select("id", "parent_asin", F.col("v.direction").alias("tag"), F.col("v.confidence").alias("conf"))


@query("pair_partners", f"""WITH t AS ({_ALL_TAGS}) SELECT mid AS id, parent_asin, tag, count(*) OVER (PARTITION BY mid, tag) - 1 AS n_same,
 count(*) OVER (PARTITION BY mid) - count(*) OVER (PARTITION BY mid, tag) AS n_opposite FROM t""")
def pair_partners(s, d):
    return relational.pair_partners(_all_tagged(s, d), "id", "parent_asin", "tag")


def _first_pairs_sql(op: str, order: str) -> str:
    return f"""WITH t AS ({_ALL_TAGS}), p AS (SELECT a.mid, a.parent_asin AS rid1, b.parent_asin AS rid2, least(a.conf, b.conf) AS pair_conf
 FROM t a JOIN t b ON a.mid = b.mid AND a.parent_asin < b.parent_asin AND a.tag {op} b.tag), q AS (SELECT *, row_number() OVER (PARTITION BY rid1 ORDER BY rid2) AS rn FROM p)
SELECT mid AS id, rid1, rid2, CAST(row_number() OVER (PARTITION BY mid ORDER BY {order}) AS INTEGER) AS place FROM q QUALIFY place <= 10"""


def _first_pairs(same: bool, conf: str | None) -> Query:
    return lambda s, d: relational.first_pairs(_all_tagged(s, d), "id", "parent_asin", "tag", conf, same).select("id", "rid1", "rid2", "place")


query("first_pairs_same_id", _first_pairs_sql("=", "rn, rid1, rid2"))(_first_pairs(True, None))
query("first_pairs_opposite_id", _first_pairs_sql("<>", "rn, rid1, rid2"))(_first_pairs(False, None))
query("first_pairs_opposite_conf", _first_pairs_sql("<>", "pair_conf DESC, rn, rid1, rid2"))(_first_pairs(False, "conf"))


@query("tri_state_counts", f"""SELECT {_MID} AS id, count(*) FILTER (WHERE tag_is_a_positive_review) AS n_true, count(*) FILTER (WHERE NOT tag_is_a_positive_review) AS n_false,
 count(*) FILTER (WHERE tag_is_a_positive_review IS NULL) AS n_open, count(*) AS n FROM movie_reviews WHERE {_MID} IS NOT NULL GROUP BY 1""")
def tri_state_counts(s, d):
    r = reviews(s, d, "id", "tag_is_a_positive_review").select(key_text("id").alias("id"), "tag_is_a_positive_review").where("id IS NOT NULL")
    return relational.tri_state_counts(r, "tag_is_a_positive_review", "id")


_SCORE = "CASE WHEN t.parent_asin IS NOT NULL THEN round(1.0::DOUBLE + 4.0::DOUBLE * CASE WHEN t.tag_value THEN coalesce(t.confidence, 1.0::DOUBLE) WHEN NOT t.tag_value THEN 1.0::DOUBLE - coalesce(t.confidence, 1.0::DOUBLE) ELSE 0.5::DOUBLE END, 4) END"


_MEAN4 = "CAST((2 * sum(score) + count(score)) // (2 * count(score)) AS DOUBLE) / 10000"


def _mean4(df: DataFrame, by: str, score: str) -> DataFrame:
    """Mean score to four digits, half up, in whole ten-thousandths: the same in any order."""
    x = df.withColumn(score, F.round(F.col(score) * 10000).cast("bigint"))
    return x.groupBy(by).agg(F.sum(score).alias("a"), F.count(score).alias("n")).select(by, (F.expr("(2 * a + n) div (2 * n)").cast("double") / 10000).alias(score))


def _scores(s, d) -> DataFrame:
    t = snap(s, d).where(F.col("predicate_canon") == POS)
    return t.select("parent_asin", verdicts.score(F.col("tag_value"), F.col("confidence"), F.lit(True)).alias("score"))


@query("score_rows", f"WITH {_SNAP} SELECT t.parent_asin, {_SCORE} AS score FROM snap t WHERE t.predicate_canon = '{POS}'")
def score_rows(s, d):
    return _scores(s, d)


@query("score_by_group", f"""WITH {_SNAP}, x AS (SELECT t.parent_asin, CAST(round({_SCORE} * 10000) AS BIGINT) AS score FROM snap t WHERE t.predicate_canon = '{POS}')
SELECT {_MID} AS id, {_MEAN4} AS score FROM x JOIN movie_reviews USING (parent_asin) WHERE {_MID} IS NOT NULL GROUP BY 1""")
def score_by_group(s, d):
    r = reviews(s, d, "id").select("parent_asin", key_text("id").alias("id")).where("id IS NOT NULL")
    return _mean4(_scores(s, d).join(r, "parent_asin"), "id", "score")


@query("call_rollup", f"""WITH {_SNAP} SELECT predicate_canon, count(*) AS calls, count(DISTINCT coalesce(CAST(date_trunc('hour', source_updated_at) AS VARCHAR), parent_asin)) AS batches, count(DISTINCT parent_asin) AS n_rows,
 CAST(sum(CASE settled_tier WHEN 1 THEN 13 WHEN 2 THEN 200 WHEN 3 THEN 1330 ELSE 0 END) AS BIGINT) AS cost_e5 FROM snap GROUP BY 1""")
def call_rollup(s, d):
    tier = F.col("settled_tier")
    cost = F.when(tier == 1, 13).when(tier == 2, 200).when(tier == 3, 1330).otherwise(0)
    batch = F.coalesce(F.date_trunc("hour", "source_updated_at").cast("string"), F.col("parent_asin"))
    return snap(s, d).groupBy("predicate_canon").agg(F.count(F.lit(1)).alias("calls"), F.count_distinct(batch).alias("batches"), F.count_distinct("parent_asin").alias("n_rows"), F.sum(cost).alias("cost_e5"))


@query("p95_nearest_rank", f"""WITH v AS (SELECT coalesce(outlet, '') AS outlet, length(review_text) AS n FROM movie_reviews WHERE review_text IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY outlet ORDER BY n) - 1 AS r, count(*) OVER (PARTITION BY outlet) AS m FROM v) SELECT outlet, CAST(n AS INTEGER) AS p95 FROM k WHERE r = CAST(floor(0.95::DOUBLE * (m - 1)) AS BIGINT)""")
def p95_nearest_rank(s, d):
    r = reviews(s, d, "outlet", "review_text").select(F.coalesce("outlet", F.lit("")).alias("outlet"), F.length("review_text").alias("n"))
    return relational.nearest_rank(r, ["outlet"], "n", 0.95, "p95")


@query("tier_counts", f"WITH {_SNAP} SELECT settled_tier, count(*) AS n FROM snap GROUP BY 1")
def tier_counts(s, d):
    return snap(s, d).groupBy("settled_tier").agg(F.count(F.lit(1)).alias("n"))


@query("tag_stats", f"""WITH {_SNAP} SELECT predicate_canon, round(CAST(avg(CAST(c AS DOUBLE)) AS DOUBLE), 6) AS mean, round(stddev_pop(CAST(c AS DOUBLE)), 6) AS sd, min(c) AS lo, max(c) AS hi
FROM (SELECT predicate_canon, CAST(round(confidence * 1000) AS BIGINT) AS c FROM snap WHERE confidence IS NOT NULL AND NOT isnan(confidence)) GROUP BY 1""")
def tag_stats(s, d):
    c = snap(s, d).where("confidence IS NOT NULL AND NOT isnan(confidence)").select("predicate_canon", F.round(F.col("confidence") * 1000).cast("bigint").alias("c"))
    return c.groupBy("predicate_canon").agg(F.round(F.avg("c"), 6).alias("mean"), F.round(F.stddev_pop("c"), 6).alias("sd"), F.min("c").alias("lo"), F.max("c").alias("hi"))


# ---------------------------------------------------------------- quality of results

_GOLD = "upper(trim(sentiment)) = 'POSITIVE'"


def _gold(s, d) -> DataFrame:
    return reviews(s, d, "id", "sentiment", "review_text").withColumn("gold", F.upper(F.trim("sentiment")) == "POSITIVE").withColumn("sys", JUDGE.verdict(POS, Step(3), True)["direction"])


@query("metric_retrieval", f"""WITH r AS (SELECT parent_asin, {_GOLD} AS g, {_dir(POS, 6, True)} AS s FROM movie_reviews), k AS (SELECT parent_asin FROM r WHERE s ORDER BY parent_asin LIMIT 100),
n AS (SELECT (SELECT count(*) FROM k) AS ns, (SELECT count(*) FROM r WHERE g) AS nt, (SELECT count(*) FROM k JOIN r USING (parent_asin) WHERE g) AS hit),
m AS (SELECT CAST(hit AS DOUBLE) / ns AS precision, CAST(least(100, hit) AS DOUBLE) / least(100, nt) AS recall FROM n) SELECT precision, recall, 2 * precision * recall / (precision + recall) AS f1 FROM m""")
def metric_retrieval(s, d):
    r = _gold(s, d)
    return metrics.retrieval(r.where("sys"), r.where("gold"), "parent_asin", 100, [F.col("parent_asin")])


@query("metric_aggregation", f"""WITH n AS (SELECT count(*) FILTER (WHERE {_dir(POS, 6, True)}) AS s, count(*) FILTER (WHERE {_GOLD}) AS g FROM movie_reviews)
SELECT CAST(abs(s - g) AS DOUBLE) / g AS error, 1.0::DOUBLE / (1.0::DOUBLE + CAST(abs(s - g) AS DOUBLE) / g) AS quality FROM n""")
def metric_aggregation(s, d):
    n = _gold(s, d).agg(F.count_if("sys").alias("s"), F.count_if("gold").alias("g"))
    return n.select(metrics.relative_error(F.col("s"), F.col("g")).alias("error")).select("error", metrics.quality(F.col("error")).alias("quality"))


@query("metric_counts", f"""WITH n AS (SELECT count(*) FILTER (WHERE {_dir(POS, 6, True)}) AS st, count(*) FILTER (WHERE NOT {_dir(POS, 6, True)}) AS sf, count(*) FILTER (WHERE {_GOLD}) AS gt, count(*) FILTER (WHERE NOT {_GOLD}) AS gf FROM movie_reviews)
SELECT (CAST(abs(st - gt) AS DOUBLE) / gt + CAST(abs(sf - gf) AS DOUBLE) / gf) / 2 AS error, 1.0::DOUBLE / (1.0::DOUBLE + (CAST(abs(st - gt) AS DOUBLE) / gt + CAST(abs(sf - gf) AS DOUBLE) / gf) / 2) AS quality FROM n""")
def metric_counts(s, d):
    r = _gold(s, d)
    by = lambda c: r.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return metrics.count_error(by("sys"), by("gold"), "k", "n")


@query("metric_pairs", f"""WITH t AS (SELECT parent_asin AS k, {_GOLD} AS g, {_dir(POS, 6, True)} AS s FROM movie_reviews WHERE {_MID} = ({_MOVIE_A})),
p AS (SELECT a.s <> b.s AS s, a.g <> b.g AS g FROM t a JOIN t b ON a.k < b.k), n AS (SELECT count(*) FILTER (WHERE s) AS ns, count(*) FILTER (WHERE g) AS nt, count(*) FILTER (WHERE s AND g) AS hit FROM p),
m AS (SELECT CASE WHEN ns = 0 THEN CASE WHEN nt = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE CAST(hit AS DOUBLE) / ns END AS precision, CASE WHEN nt = 0 THEN 0.0::DOUBLE ELSE CAST(hit AS DOUBLE) / nt END AS recall, ns, nt FROM n)
SELECT precision, recall, CASE WHEN ns = 0 OR nt = 0 OR precision + recall = 0 THEN 0.0::DOUBLE ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM m""")
def metric_pairs(s, d):
    """Of the movie with most reviews, from products of class counts."""
    return _pair_metrics(_of_movie(s, d, "review_text", "sentiment").withColumn("gold", F.upper(F.trim("sentiment")) == "POSITIVE").withColumn("sys", JUDGE.verdict(POS, Step(3), True)["direction"]), "mid").drop("mid")


def _pair_metrics(r: DataFrame, group: str) -> DataFrame:
    cell = {f"{a}{b}": F.count_if((F.col("sys") == (a == "t")) & (F.col("gold") == (b == "t"))) for a in "tf" for b in "tf"}
    n = r.groupBy(group).agg(*[v.alias(k) for k, v in cell.items()], F.count_if("sys").alias("st"), F.count_if(~F.col("sys")).alias("sf"))
    n = n.select(group, F.expr("st * sf").alias("ns"), F.expr("(tt + ft) * (tf + ff)").alias("nt"), F.expr("tt * ff + tf * ft").alias("hit"))
    ns, nt, hit = (F.col(c) for c in ("ns", "nt", "hit"))
    n = n.select(group, "ns", "nt", F.when(ns == 0, (nt == 0).cast("double")).otherwise(hit.cast("double") / ns).alias("precision"), F.when(nt == 0, 0.0).otherwise(hit.cast("double") / nt).alias("recall"))
    p, q = F.col("precision"), F.col("recall")
    return n.select(group, p, q, F.when((ns == 0) | (nt == 0) | (p + q == 0), 0.0).otherwise(2 * p * q / (p + q)).alias("f1"))


@query("metric_pairs_by_movie", f"""WITH t AS (SELECT {_MID} AS id, parent_asin AS k, {_GOLD} AS g, {_dir(POS, 6, True)} AS s FROM movie_reviews WHERE {_MID} IS NOT NULL),
p AS (SELECT a.id, a.s <> b.s AS s, a.g <> b.g AS g FROM t a JOIN t b ON a.id = b.id AND a.k < b.k), c AS (SELECT id, count(*) FILTER (WHERE s) AS ns, count(*) FILTER (WHERE g) AS nt, count(*) FILTER (WHERE s AND g) AS hit FROM p GROUP BY id),
n AS (SELECT i.id, coalesce(ns, 0) AS ns, coalesce(nt, 0) AS nt, coalesce(hit, 0) AS hit FROM (SELECT DISTINCT id FROM t) i LEFT JOIN c ON c.id = i.id),
m AS (SELECT id, CASE WHEN ns = 0 THEN CASE WHEN nt = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE CAST(hit AS DOUBLE) / ns END AS precision, CASE WHEN nt = 0 THEN 0.0::DOUBLE ELSE CAST(hit AS DOUBLE) / nt END AS recall, ns, nt FROM n)
SELECT id, precision, recall, CASE WHEN ns = 0 OR nt = 0 OR precision + recall = 0 THEN 0.0::DOUBLE ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM m""")
def metric_pairs_by_movie(s, d):
    """metric_pairs of every movie, from products of class counts."""
    return _pair_metrics(_gold(s, d).select(key_text("id").alias("id"), "gold", "sys").where("id IS NOT NULL"), "id")


_XY = f"""xy AS (SELECT m.audience_score AS x, g.n AS y FROM movies m JOIN (SELECT {_MID} AS mid, CAST(100 * count(*) FILTER (WHERE {_dir(POS, 6, True)}) // count(*) AS BIGINT) AS n FROM movie_reviews GROUP BY 1) g ON g.mid = m.id
 WHERE m.audience_score IS NOT NULL AND NOT isnan(m.audience_score))"""


def _xy(s, d) -> DataFrame:
    v = JUDGE.verdict(POS, Step(3), True)["direction"]
    r = reviews(s, d, "id", "review_text").select(key_text("id").alias("mid"), v.alias("t")).groupBy("mid").agg(F.expr("(100 * count_if(t)) div count(1)").alias("y"))
    m = table(s, d, "movies").where("audience_score IS NOT NULL AND NOT isnan(audience_score)").select(F.col("id").alias("mid"), F.col("audience_score").alias("x"))
    return m.join(r, "mid").select("x", "y")


@query("metric_spearman", f"""WITH {_XY}, r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry FROM xy)
SELECT round(corr(rx, ry), 6) AS rho FROM r""")
def metric_spearman(s, d):
    return metrics.spearman(_xy(s, d), "x", "y")


@query("metric_kendall", f"""WITH {_XY}, c AS (SELECT x, y, count(*) AS n FROM xy GROUP BY 1, 2),
p AS (SELECT CAST(sum(a.n * b.n * sign(a.x - b.x) * sign(a.y - b.y)) AS DOUBLE) / 2 AS s FROM c a, c b), t AS (SELECT CAST(sum(n) AS DOUBLE) AS n FROM c),
tx AS (SELECT CAST(sum(m * (m - 1)) AS DOUBLE) AS t FROM (SELECT sum(n) AS m FROM c GROUP BY x)), ty AS (SELECT CAST(sum(m * (m - 1)) AS DOUBLE) AS t FROM (SELECT sum(n) AS m FROM c GROUP BY y))
SELECT round(2 * p.s / sqrt((t.n * (t.n - 1) - tx.t) * (t.n * (t.n - 1) - ty.t)), 6) AS tau FROM p, t, tx, ty""")
def metric_kendall(s, d):
    return metrics.kendall(_xy(s, d), "x", "y")


# ---------------------------------------------------------------- the ten benchmark questions


@query("q1", f"SELECT parent_asin FROM movie_reviews WHERE {_P} AND {_N} = false ORDER BY parent_asin LIMIT 5")
def q1(s, d):
    """Five clearly positive reviews of any movie: positive, and not negative. Reviews are
    judged in the order of their keys, block by block, until there are five."""

    def judge(part: DataFrame) -> tuple[DataFrame, int]:
        c = one_plan(one_plan(part, plan(POS), JUDGE).drop("answer", *[f"calls_t{t}" for t in (1, 2, 3)]), plan(NEG), JUDGE)
        return written(c.select("parent_asin", (F.col(f"known_{POS}") & ~F.col(f"known_{NEG}")).alias("answer")), "judged"), 0

    state, _ = judge_until(reviews(s, d, "review_text"), "parent_asin", judge, 5)
    return state.where("answer").select("parent_asin").orderBy("parent_asin").limit(5)


@query("q2", f"WITH t AS ({_tags_sql(_MOVIE_A)}) SELECT parent_asin FROM t WHERE tag ORDER BY parent_asin LIMIT 5")
def q2(s, d):
    # Sorted by the key with the judgement as a column: a filter would be pushed below the
    # movie's join and judge every review.
    best = F.when(F.col("tag"), F.col("parent_asin"))
    return _tagged(s, d).select(best.alias("parent_asin")).orderBy(F.col("parent_asin").asc_nulls_last()).limit(5).where("parent_asin IS NOT NULL")


@query("q3", f"WITH t AS ({_tags_sql(_MOVIE_A)}) SELECT count(*) FILTER (WHERE tag) AS n FROM t")
def q3(s, d):
    return _tagged(s, d).agg(F.count_if("tag").alias("n"))


@query("q4", f"WITH t AS ({_tags_sql(_MOVIE_A)}) SELECT round(CAST(count(*) FILTER (WHERE tag) AS DOUBLE) / count(*), 6) AS ratio FROM t")
def q4(s, d):
    return _tagged(s, d).agg(F.count_if("tag").alias("t"), F.count(F.lit(1)).alias("n")).select(relational.ratio(F.col("t"), F.col("n")).alias("ratio"))


query("q5", SQL["pairs_same_id"])(QUERIES["pairs_same_id"])
query("q6", SQL["pairs_opposite_id"])(QUERIES["pairs_opposite_id"])
query("q7", SQL["pairs_all"])(QUERIES["pairs_all"])


@query("q8", f"""WITH t AS ({_tags_sql(_MOVIE_A)}) SELECT sentiment, count(t.parent_asin) AS n FROM (SELECT unnest(['POSITIVE', 'NEGATIVE']) AS sentiment) c
LEFT JOIN t ON sentiment = CASE WHEN tag THEN 'POSITIVE' ELSE 'NEGATIVE' END GROUP BY 1""")
def q8(s, d):
    """Reviews by class; a class without reviews counts 0."""
    n = _tagged(s, d).groupBy(F.when(F.col("tag"), "POSITIVE").otherwise("NEGATIVE").alias("sentiment")).agg(F.count(F.lit(1)).alias("n"))
    classes = s.createDataFrame([("POSITIVE",), ("NEGATIVE",)], "sentiment string")
    return classes.join(n, "sentiment", "left").select("sentiment", F.coalesce("n", F.lit(0)).alias("n"))


@query("q9", f"WITH t AS ({_tags_sql(_MOVIE_A)}) SELECT parent_asin, round(1.0::DOUBLE + 4.0::DOUBLE * CASE WHEN tag THEN conf ELSE 1.0::DOUBLE - conf END, 4) AS score FROM t")
def q9(s, d):
    return _tagged(s, d).select("parent_asin", verdicts.score(F.col("tag"), F.col("conf"), F.lit(True)).alias("score"))


@query("review_scores", f"WITH t AS ({_ALL_TAGS}) SELECT mid AS id, parent_asin, round(1.0::DOUBLE + 4.0::DOUBLE * CASE WHEN tag THEN conf ELSE 1.0::DOUBLE - conf END, 4) AS score FROM t")
def review_scores(s, d):
    """The score of q9 for every review of every movie."""
    return _all_tagged(s, d).select("id", "parent_asin", verdicts.score(F.col("tag"), F.col("conf"), F.lit(True)).alias("score"))


@query("q10", f"""WITH t AS (SELECT {_MID} AS id, CASE WHEN {_dir(POS, 6, True)} THEN {_conf(POS, 6)} ELSE 1.0::DOUBLE - {_conf(POS, 6)} END AS r FROM movie_reviews WHERE {_MID} IS NOT NULL)
SELECT id, {_MEAN4} AS score FROM (SELECT id, CAST(round(round(1.0::DOUBLE + 4.0::DOUBLE * r, 4) * 10000) AS BIGINT) AS score FROM t) GROUP BY 1""")
def q10(s, d):
    v = JUDGE.verdict(POS, Step(3), True)
    r = reviews(s, d, "id", "review_text").select(key_text("id").alias("id"), v.alias("v")).where("id IS NOT NULL")
    x = r.select("id", verdicts.score(F.col("v.direction"), F.col("v.confidence"), F.lit(True)).alias("score"))
    return _mean4(x, "id", "score")


# ---------------------------------------------------------------- vectorised judges, streams


def _word_client(slug: str, texts: list[str]) -> list[str]:
    return ["true" if any(w in t.lower() for g in QUESTIONS[slug] for w in g) else "false" for t in texts]


@query("vector_judge", f"SELECT parent_asin, coalesce({' OR '.join(_q(w) for w in QUESTIONS[POS])}, false) AS answer FROM movie_reviews")
def vector_judge(s, d):
    r = reviews(s, d, "review_text")
    out = staged(r.select("parent_asin"), "parent_asin", r, plan(POS, ONE), VectorSource(_word_client, "review_text", batch=64))
    return out.state.select("parent_asin", "answer")


@query("incremental_tagging", f"SELECT parent_asin, {_dir(POS, 4, True)} AS tag_value FROM movie_reviews")
def incremental_tagging(s, d):
    from grainfold.streaming.incremental import tag_stream

    return tag_stream(s, f"{d}/movie_reviews.parquet", plan(POS, ONE), JUDGE, POS).select("parent_asin", "tag_value")
