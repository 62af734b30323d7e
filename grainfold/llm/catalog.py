"""Queries of the training-text operators (problems 4, 5, 6, 8, 9 and 10) and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainfold.llm import copies, neardup
from grainfold.llm.leaks import leaks
from grainfold.llm.mixing import Mixture, mix
from grainfold.llm.splitting import Split, own_stretches, split_files, split_texts
from grainfold.llm.topn import top_n
from grainfold.operators.skew import key_text
from grainfold.session import shared_dir, table

REVIEW_SIMILARITY = neardup.Similarity(run=3, at_least=Fraction(1, 2), min_words=20)


def _near(spark: SparkSession, d: str) -> neardup.NearDuplicates:
    reviews = table(spark, d, "movie_reviews").select("parent_asin", "id", "review_text")
    return neardup.near_duplicates(reviews, F.col("parent_asin"), key_text("id"), F.col("review_text"), REVIEW_SIMILARITY)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.expand_pairs(_near(spark, d))


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    return neardup.duplicate_classes(_near(spark, d)).withColumnRenamed("key", "parent_asin")


def _reviews(spark: SparkSession, d: str) -> tuple:
    return table(spark, d, "movie_reviews").select("parent_asin", "id", "review_text"), F.col("parent_asin"), key_text("id"), F.col("review_text")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.formatting_copies(*_reviews(spark, d)).select(F.col("first").alias("key_a"), F.col("copy").alias("key_b"))


def p5_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return copies.collapse(*_reviews(spark, d)).select(F.col("key").alias("parent_asin"), F.col("grp").alias("id"), "copies")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    reviews = table(spark, d, "movie_reviews").select("parent_asin", "id", "sentiment_conf")
    conf = F.when(F.col("sentiment_conf").between(0, 1), F.col("sentiment_conf"))
    return top_n(reviews, key_text("id"), conf, F.col("parent_asin"), 5).select(F.col("grp").alias("id"), "rnk", F.col("item").alias("parent_asin"))


def _leaks(spark: SparkSession, d: str, phrases_only: bool = False) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    items = table(spark, d, "eval_items").select("item_id", "passage")
    return leaks(docs, F.col("doc_id"), F.col("text"), items, F.col("item_id"), F.col("passage"), phrases_only=phrases_only)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d, phrases_only=True).select("doc_id", F.col("item_id").cast("int").alias("item_id"))


def p8_matches(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d)


def _mixture(spark: SparkSession, d: str) -> Mixture:
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    return mix(docs, F.col("doc_id"), F.col("source"), F.col("text"), table(spark, d, "mix_targets"))


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).rates


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).shares


SPLIT = Split(limit=1024, overlap=64)


def _docs(spark: SparkSession, d: str) -> tuple:
    return table(spark, d, "documents").select("doc_id", "text"), F.col("doc_id"), F.col("text"), SPLIT


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Texts above the limit are those that come out in more than one piece."""
    return split_texts(*_docs(spark, d), bodies=False).where("piece = 2").select("doc_id")


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_texts(*_docs(spark, d))


def _measures() -> list:
    return [F.sum(F.octet_length("body")).alias("n_bytes"), F.sum(F.length("body")).alias("n_chars"), F.sum(F.length("body") - F.length(F.replace("body", F.lit("e"), F.lit("")))).alias("n_e")]


def p10_whole(spark: SparkSession, d: str) -> DataFrame:
    """Of each text, cut in ranges of 4 KB: what its pieces hold besides the overlaps."""
    docs, doc_id, text, _ = _docs(spark, d)
    pieces = split_texts(docs, doc_id, text, Split(limit=256, overlap=32, range_bytes=4096, halo=1024))
    return own_stretches(pieces).groupBy("doc_id").agg(*_measures())


def p10_files(spark: SparkSession, d: str) -> DataFrame:
    """The same over the whole corpus laid down as text files, read by byte ranges."""
    docs = table(spark, d, "documents").select("text").where("text IS NOT NULL AND text <> ''")
    path = f"{shared_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs.write.text(path)
    files = spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("doc_id"), "path")
    return own_stretches(split_files(files, F.col("doc_id"), F.col("path"), SPLIT)).agg(*_measures())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p4_found": p4_found,
    "p4_classes": p4_classes,
    "p5_found": p5_found,
    "p5_collapsed": p5_collapsed,
    "p6_found": p6_found,
    "p8_found": p8_found,
    "p8_matches": p8_matches,
    "p9_rates": p9_rates,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_pieces": p10_pieces,
    "p10_whole": p10_whole,
    "p10_files": p10_files,
}

_MID = "nullif(lower(trim(id)), '')"
_BARE = "regexp_replace(lower({}), '[^\\pL\\pN]', '', 'g')"
# Letters (l) and, of a text that begins with a label and has two or more, the sorted letters
# of its parts (p): a part goes on to the next label behind ; | or a line end. Each round
# hands the smallest key on by l, then by p.
_RECORDS = f"""
WITH t AS (SELECT parent_asin, {_MID} AS mid, review_text AS t,
    string_split(regexp_replace(review_text, '(^|[;|\\n])([^\\pL\\pN;|\\n]*[\\pL\\pN]+[^\\pL\\pN;|\\n]*:)', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS bits
  FROM movie_reviews WHERE review_text IS NOT NULL AND {_MID} IS NOT NULL),
r0 AS (SELECT parent_asin, mid, {_BARE.format("t")} AS l, CASE WHEN len(bits) > 2 AND {_BARE.format("bits[1]")} = ''
    THEN array_to_string(list_sort(list_transform(bits[2:], lambda x: {_BARE.format("x")})), chr(2)) END AS p, parent_asin AS f FROM t),
r1 AS (SELECT * REPLACE (min(f) OVER (PARTITION BY mid, l) AS f) FROM r0), r2 AS (SELECT * REPLACE (CASE WHEN p IS NULL THEN f ELSE min(f) OVER (PARTITION BY mid, p) END AS f) FROM r1),
r3 AS (SELECT * REPLACE (min(f) OVER (PARTITION BY mid, l) AS f) FROM r2), r4 AS (SELECT * REPLACE (CASE WHEN p IS NULL THEN f ELSE min(f) OVER (PARTITION BY mid, p) END AS f) FROM r3),
records AS (SELECT * REPLACE (min(f) OVER (PARTITION BY mid, l) AS f) FROM r4)
"""
_MEASURES = "CAST(sum(strlen({0})) AS BIGINT) AS n_bytes, CAST(sum(length({0})) AS BIGINT) AS n_chars, CAST(sum(length({0}) - length(replace({0}, 'e', ''))) AS BIGINT) AS n_e"
_WORDS = "regexp_extract_all(lower({}), '[\\pL\\pN]+')"
# Texts with the same words are compared once (d); links come from the runs that two of them share.
_LINKED = f"""rw AS (SELECT parent_asin AS k, {_WORDS.format("review_text")} AS w FROM movie_reviews WHERE review_text IS NOT NULL),
n AS (SELECT *, row_number() OVER () AS d, list_distinct(list_transform(range(1, len(w) - 1), lambda i: hash(w[i], w[i + 1], w[i + 2]))) AS runs FROM (SELECT DISTINCT w FROM rw WHERE len(w) >= 20)),
rd AS (SELECT k, d FROM rw JOIN n USING (w)), s AS (SELECT d, unnest(runs) AS run FROM n),
c AS (SELECT a.d AS a, b.d AS b, count(*) AS shared FROM s a JOIN s b ON a.run = b.run AND a.d < b.d GROUP BY ALL),
links AS (SELECT a, b FROM c JOIN n x ON x.d = a JOIN n y ON y.d = b WHERE 2 * shared >= len(x.runs) + len(y.runs) - shared UNION ALL SELECT d, d FROM n)
"""
_RUNS13 = "SELECT {0}, array_to_string(w[k:k + 12], ' ') AS run FROM (SELECT {0}, w, unnest(range(1, len(w) - 11)) AS k FROM (SELECT {0}, {1} AS w FROM {2} WHERE {3} <> ''))"
SQL: dict[str, str] = {
    "p4_found": _RECORDS.rstrip() + ", " + _LINKED + """SELECT DISTINCT least(x.k, y.k) AS key_a, greatest(x.k, y.k) AS key_b FROM links l JOIN rd x ON x.d = l.a JOIN rd y ON y.d = l.b
LEFT JOIN records p ON p.parent_asin = x.k LEFT JOIN records q ON q.parent_asin = y.k WHERE x.k <> y.k AND NOT coalesce(p.f = q.f, false)""",
    "p8_found": f"""SELECT DISTINCT doc_id, item_id FROM ({_RUNS13.format("doc_id", _WORDS.format("text"), "documents", "text")}) JOIN ({_RUNS13.format("item_id", _WORDS.format("passage"), "eval_items", "passage")}) USING (run)""",
    "p10_whole": f"SELECT doc_id, {_MEASURES.format('text')} FROM documents WHERE text <> '' GROUP BY doc_id",
    "p10_files": f"SELECT {_MEASURES.format('text || chr(10)')} FROM documents WHERE text <> ''",
    "p5_found": _RECORDS + "SELECT f AS key_a, parent_asin AS key_b FROM records WHERE parent_asin <> f",
    "p5_collapsed": _RECORDS + "SELECT f AS parent_asin, mid AS id, count(*) AS copies FROM records GROUP BY ALL",
    "p6_found": f"""SELECT id, CAST(rnk AS INTEGER) AS rnk, parent_asin FROM (
  SELECT {_MID} AS id, parent_asin, row_number() OVER (PARTITION BY {_MID} ORDER BY sentiment_conf DESC, parent_asin) AS rnk
  FROM movie_reviews WHERE NOT isnan(sentiment_conf) AND sentiment_conf BETWEEN 0 AND 1 AND {_MID} IS NOT NULL) WHERE rnk <= 5""",
}
