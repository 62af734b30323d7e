"""Queries of the general data operators (problems 1, 2, 3 and 7) and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainfold.operators.orphans import classify_references, orphan_report
from grainfold.operators.packed import explode_packed
from grainfold.operators.skew import Measure, eager_join_aggregate, heavy_from_states, key_text, rollup_states
from grainfold.operators.units import to_common_scale
from grainfold.session import table, written


def _states(spark: SparkSession, d: str) -> DataFrame:
    reviews = table(spark, d, "movie_reviews").select("parent_asin", "id", "loaded_at")
    movies = table(spark, d, "movies").select("id", "added_at", "deleted_at")
    return classify_references(
        reviews,
        movies,
        row_key=F.col("parent_asin"),
        ref_key=key_text("id"),
        at=F.col("loaded_at"),
        parent_key=F.col("id"),
        valid_from=F.col("added_at"),
        valid_to=F.col("deleted_at"),
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _states(spark, d).where("state <> 'present'").select("row_key").withColumnRenamed("row_key", "parent_asin")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_states(spark, d), "movie_reviews")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    names = (r[0] for r in table(spark, d, "genre_names").select("genre_name").toLocalIterator())
    return explode_packed(table(spark, d, "movies"), F.col("genre"), names, [F.col("id")], value="genre", pos="pos").select("id", "pos", "genre")


def _scores(spark: SparkSession, d: str) -> DataFrame:
    reviews = table(spark, d, "movie_reviews").select("parent_asin", "original_score", "review_text", "outlet")
    outlets = table(spark, d, "outlets").where("outlet IS NOT NULL").groupBy(F.col("outlet").alias("__outlet")).agg(F.max("score_max").alias("__max"))
    joined = reviews.join(outlets, reviews["outlet"] == outlets["__outlet"], "left")
    return to_common_scale(
        joined,
        keep=[F.col("parent_asin")],
        quantity=F.col("original_score"),
        text=F.col("review_text"),
        fallback=F.col("__max"),
        grades=table(spark, d, "grade_scale"),
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).where("score IS NOT NULL").select("parent_asin", F.col("score").alias("score_1000"))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Rows by notation, with how many could be brought to the common scale."""
    return _scores(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n_rows"), F.count("score").alias("n_scored"))


def _conf() -> F.Column:
    c = F.col("sentiment_conf")
    return F.when(~F.isnan(c) & c.between(0, 1), c)


def _per_movie(spark: SparkSession, d: str) -> DataFrame:
    reviews = table(spark, d, "movie_reviews").select("id", "sentiment_conf")
    movies = table(spark, d, "movies").select("id", "audience_score")
    return eager_join_aggregate(
        reviews,
        movies,
        key_text("id"),
        F.col("id"),
        [Measure("conf", _conf())],
        [Measure("audience", F.col("audience_score"))],
    )


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Heavy ids, from the joined states: they are stored, so both tables are read once."""
    return heavy_from_states(written(_per_movie(spark, d), "states"), "id", "left_rows", 2).select("id")


def p7_per_movie(spark: SparkSession, d: str) -> DataFrame:
    s = _per_movie(spark, d).where("id IS NOT NULL")
    mean = lambda a, n: F.when(F.col(n) > 0, F.col(a).cast("double") / F.col(n))
    return s.select(
        "id",
        F.col("left_rows").alias("n_reviews"),
        F.col("join_rows").alias("n_joined"),
        mean("conf_sum", "conf_n").alias("mean_conf"),
        mean("audience_join_sum", "audience_join_n").alias("mean_audience"),
    )


def p7_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Totals over the whole join by whether the movie is known, from the compact states."""
    sums = ["left_rows", "join_rows", "conf_n", "conf_join_n"]
    return rollup_states(_per_movie(spark, d), [(F.col("right_rows") > 0).alias("known")], sums)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_report": p1_report,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_report": p3_report,
    "p7_found": p7_found,
    "p7_per_movie": p7_per_movie,
    "p7_rollup": p7_rollup,
}

_MID = "nullif(lower(trim(id)), '')"
_P1 = f"""
WITH r AS (SELECT parent_asin, {_MID} AS mid, loaded_at FROM movie_reviews),
s AS (SELECT r.parent_asin, r.mid, r.loaded_at,
    count(m.id) AS parents,
    coalesce(bool_or(m.added_at <= r.loaded_at AND (m.deleted_at IS NULL OR r.loaded_at < m.deleted_at)), false) AS present,
    coalesce(bool_or(m.added_at <= r.loaded_at AND (m.deleted_at IS NULL OR m.deleted_at > m.added_at)), false) AS opened
  FROM r LEFT JOIN movies m ON m.id = r.mid WHERE r.mid IS NOT NULL GROUP BY ALL)
"""
SQL: dict[str, str] = {
    "p1_found": _P1 + "SELECT parent_asin FROM s WHERE NOT present",
    "p1_report": _P1
    + """SELECT 'movie_reviews' AS table_name, CAST(date_trunc('month', loaded_at AT TIME ZONE 'UTC') AS DATE) AS month,
  CASE WHEN parents = 0 THEN 'missing' WHEN loaded_at IS NULL THEN 'undated' WHEN opened THEN 'deleted' ELSE 'late' END AS state,
  count(*) AS orphans, count(DISTINCT mid) AS keys FROM s WHERE NOT present GROUP BY ALL""",
    "p7_found": f"""WITH c AS (SELECT {_MID} AS id, count(*) AS n FROM movie_reviews GROUP BY 1)
SELECT id FROM c WHERE id IS NOT NULL AND n * 100 >= 2 * (SELECT sum(n) FROM c)""",
    "p7_per_movie": f"""WITH r AS (SELECT {_MID} AS id,
    CASE WHEN NOT isnan(sentiment_conf) AND sentiment_conf BETWEEN 0 AND 1 THEN CAST(sentiment_conf AS DECIMAL(20,8)) END AS conf FROM movie_reviews),
j AS (SELECT r.id, r.conf, m.id AS mid, CASE WHEN NOT isnan(m.audience_score) THEN CAST(m.audience_score AS DECIMAL(20,8)) END AS aud
  FROM r LEFT JOIN movies m ON m.id = r.id WHERE r.id IS NOT NULL)
SELECT id, count(*) AS n_reviews, count(mid) AS n_joined,
  CASE WHEN count(conf) > 0 THEN CAST(sum(conf) AS DOUBLE) / count(conf) END AS mean_conf,
  CASE WHEN count(aud) > 0 THEN CAST(sum(aud) AS DOUBLE) / count(aud) END AS mean_audience
FROM j GROUP BY id""",
    "p7_rollup": f"""WITH r AS (SELECT {_MID} AS id, NOT isnan(sentiment_conf) AND sentiment_conf BETWEEN 0 AND 1 AS ok FROM movie_reviews)
SELECT m.id IS NOT NULL AS known, count(*) AS left_rows, count(m.id) AS join_rows,
  count(*) FILTER (WHERE ok) AS conf_n, count(*) FILTER (WHERE ok AND m.id IS NOT NULL) AS conf_join_n
FROM r LEFT JOIN movies m ON m.id = r.id GROUP BY 1""",
}


def _p2_sql() -> str:
    """Plain segmentation: names that hold a separator are matched first, then runs without one."""
    marks = "\\s\"''“”‘’«»„`\\[\\](){}"
    return f"""WITH n AS (SELECT string_agg(regexp_replace(genre_name, '([+.])', '\\\\\\1', 'g'), '|' ORDER BY length(genre_name) DESC) AS p FROM genre_names WHERE regexp_matches(genre_name, '[,;|/&]')),
v AS (SELECT id, list_filter(list_transform(regexp_extract_all(genre, '(?i)[{marks}]*(?:' || p || ')[{marks}]*(?:$|[,;|/&\\t\\n\\r·•，；、])|[^,;|/&\\t\\n\\r·•，；、]+'),
    lambda x: regexp_replace(regexp_replace(x, '^[{marks}]+', ''), '[{marks},;|/&·•，；、]+$', '')), lambda x: x <> '') AS l FROM movies, n WHERE genre IS NOT NULL)
SELECT id, CAST(unnest(range(1, len(l) + 1)) AS INTEGER) AS pos, unnest(l) AS genre FROM v"""


def _p3_sql() -> str:
    words = {"zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "twelve": 12, "twenty": 20, "one hundred": 100, "a hundred": 100, "hundred": 100}
    num = f"(\\d+(?:[.,]\\d+)?|(?:{'|'.join(sorted(words, key=len, reverse=True))})(?: and a half)?)"
    cases = " ".join(f"WHEN '{w}' THEN {n * 100}" for w, n in words.items())
    val = lambda x: f"CASE WHEN regexp_matches({x}, '^\\d') THEN CAST(CAST(replace({x}, ',', '.') AS DECIMAL(18,2)) * 100 AS BIGINT) ELSE CASE replace({x}, ' and a half', '') {cases} END + CASE WHEN {x} LIKE '% and a half' THEN 50 ELSE 0 END END"
    unit, link, in_text = "(?: ?(?:stars?|points?|pts?))?", " ?(?:/|out of|of a possible|on a scale of|of|sur|von) ?", " ?(?:/|out of|of a possible|on a scale of|sur|von) ?"
    ratio, share, bare = f"^{num}{unit}{link}{num}{unit}$", f"^{num} ?(?:%|pct|percent|per cent)$", f"^{num}{unit}$"
    at = lambda c, p, i: f"regexp_extract({c}, '{p}', {i})"
    return f"""WITH r AS (SELECT parent_asin, outlet, trim(regexp_replace(regexp_replace(trim(lower(original_score)), '\\s+', ' ', 'g'), '^(rating|grade|score) ?: ?|[()]', '', 'g')) AS q,
    regexp_replace(regexp_replace(lower(review_text), '[*_\\x{{200B}}]', '', 'g'), '\\s+', ' ', 'g') AS t FROM movie_reviews WHERE original_score IS NOT NULL),
k AS (SELECT *, CASE WHEN regexp_full_match(q, '[★½☆]+') THEN 'stars' WHEN regexp_matches(q, '^[a-z] ?(\\+|-|plus|minus)?$') THEN 'grade' WHEN regexp_matches(q, '{ratio}') THEN 'ratio' WHEN regexp_matches(q, '{share}') THEN 'share' WHEN regexp_matches(q, '{bare}') THEN 'bare' END AS kind FROM r),
v AS (SELECT k.parent_asin, k.t, o.score_max, kind,
  CASE kind WHEN 'stars' THEN 100 * (length(q) - length(replace(q, '★', ''))) + 50 * (length(q) - length(replace(q, '½', ''))) WHEN 'grade' THEN 100 * g.pct WHEN 'ratio' THEN {val(at("q", ratio, 1))} WHEN 'share' THEN {val(at("q", share, 1))} WHEN 'bare' THEN {val(at("q", bare, 1))} END AS v,
  CASE kind WHEN 'stars' THEN 100 * length(q) WHEN 'grade' THEN 10000 WHEN 'ratio' THEN {val(at("q", ratio, 2))} WHEN 'share' THEN 10000 END AS s
  FROM k LEFT JOIN outlets o ON o.outlet = k.outlet LEFT JOIN grade_scale g ON kind = 'grade' AND g.grade = upper(replace(replace(replace(q, ' ', ''), 'plus', '+'), 'minus', '-'))),
m AS (SELECT parent_asin, kind, v, CASE WHEN kind = 'bare' THEN coalesce(list_filter(list_transform(regexp_extract_all(t, '\\b{num}{unit}{in_text}{num}\\b'),
    lambda x: {{'a': {val(at("x", "^" + num, 1))}, 'b': {val(at("x", in_text + num + "$", 1))}}}), lambda x: x.a = v)[1].b, 100 * score_max) ELSE s END AS s FROM v)
"""


_P3 = _p3_sql()
SQL["p2_found"] = _p2_sql()
SQL["p3_found"] = _P3 + """SELECT parent_asin, CAST((2000 * v + s) // (2 * s) AS INTEGER) AS score_1000 FROM m WHERE s > 0 AND v <= s AND v >= 0"""
SQL["p3_report"] = _P3 + """SELECT CASE WHEN kind IN ('stars', 'share') THEN 'ratio' ELSE coalesce(kind, 'none') END AS kind, count(*) AS n_rows, count(*) FILTER (WHERE s > 0 AND v <= s AND v >= 0) AS n_scored
FROM (SELECT kind, v, s FROM m UNION ALL SELECT NULL, NULL, NULL FROM movie_reviews WHERE original_score IS NULL) GROUP BY 1"""
