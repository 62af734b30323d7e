"""What a judge gets to see of a row: text put together from several tables, and images."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainfold.functions.text import bullets, mini_filter, shorten
from grainfold.operators.relational import global_rank


@dataclass(frozen=True)
class SourceTable:
    """columns of a table as text, or as image addresses; join_on: its column that holds the
    row's key (None: the main table); filters: column -> condition in the mini-language;
    order: a unique column by which its rows stand."""

    table: str
    columns: tuple[str, ...]
    order: str
    modality: str = "text"
    join_on: str | None = None
    filters: Mapping[str, str] = field(default_factory=dict)


def _rows(src: SourceTable, tables: Mapping[str, DataFrame], key: str) -> DataFrame:
    t = tables[src.table]
    for column, spec in src.filters.items():
        t = t.where(mini_filter(column, spec))
    on = F.col(src.join_on or key)
    return t.where(on.isNotNull()).select(on.alias("__on"), F.col(src.order).alias("__order"), *src.columns)


def _line(t: DataFrame, column: str) -> Column:
    """`column: value`, arrays as bullets, several lines below the name; null for nothing."""
    c = F.col(column)
    v = bullets(c.cast("array<string>")) if isinstance(t.schema[column].dataType, T.ArrayType) else F.trim(c.cast("string"))
    v = F.when(v != "", v)
    return F.concat(F.lit(f"{column}:"), F.when(F.contains(v, F.lit("\n")), F.lit("\n")).otherwise(F.lit(" ")), v)


def text_sections(keys: DataFrame, key: str, sources: Sequence[SourceTable], tables: Mapping[str, DataFrame], rows_a_part: int = 1000) -> DataFrame:
    """(key, section, part, text): one section per text source, headed by its name, its rows
    numbered if there are several. A section comes in parts of at most rows_a_part rows, so
    that no key's rows are gathered in one place; its parts in order are the section."""
    out = None
    for i, src in enumerate(s for s in sources if s.modality == "text"):
        t = _rows(src, tables, key)
        ranked = global_rank(t, ["__on", "__order"], "__rn")
        first = ranked.groupBy("__on").agg(F.min("__rn").alias("__first"), F.count(F.lit(1)).alias("__n"))
        at = F.col("__rn") - F.col("__first")
        body = F.concat_ws("\n", F.when(F.col("__n") > 1, F.concat(F.lit("### row "), (at + 1).cast("string"))), *[_line(t, c) for c in src.columns])
        lines = ranked.join(first, "__on").select("__on", F.floor(at / rows_a_part).cast("int").alias("part"), F.struct("__rn", body.alias("line")).alias("line"))
        parts = lines.groupBy("__on", "part").agg(F.array_join(F.transform(F.sort_array(F.collect_list("line")), lambda x: x["line"]), "\n").alias("text"))
        head = F.lit(f"## SOURCE: {src.table}")
        own = keys.select(key).join(parts, F.col(key) == F.col("__on"), "left")
        text = F.when(F.col("part").isNull(), F.concat(head, F.lit("\n(no rows matched)"))).when(F.col("part") == 0, F.concat_ws("\n", head, F.when(F.col("text") != "", F.col("text")))).otherwise(F.col("text"))
        own = own.select(key, F.lit(i).alias("section"), F.coalesce("part", F.lit(0)).alias("part"), text.alias("text"))
        out = own if out is None else out.unionByName(own)
    return out


def image_addresses(keys: DataFrame, key: str, sources: Sequence[SourceTable], tables: Mapping[str, DataFrame]) -> DataFrame:
    """(key, column, url): the non-empty image addresses of all image sources."""
    out = None
    for src in (s for s in sources if s.modality == "image"):
        t = _rows(src, tables, key).select("__on", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.trim(F.col(c)).alias("url")) for c in src.columns])).alias("x"))
        own = keys.select(key).join(t, F.col(key) == F.col("__on")).select(key, "x.column", "x.url").where("url <> ''")
        out = own if out is None else out.unionByName(own)
    return out


def first_image(images: Column) -> Column:
    """The address of the first image whose variant is MAIN, else of the first usable one; large
    before hi_res before thumb. images: array of (variant, large, hi_res, thumb)."""
    usable = F.transform(images, lambda x: F.struct(x["variant"].alias("variant"), F.coalesce(*[F.when(x[c] != "", x[c]) for c in ("large", "hi_res", "thumb")]).alias("url")))
    usable = F.filter(usable, lambda x: x["url"].isNotNull())
    main = F.filter(usable, lambda x: F.upper(x["variant"]) == "MAIN")
    return F.coalesce(F.get(main, F.lit(0))["url"], F.get(usable, F.lit(0))["url"])


def review_lines(reviews: DataFrame, key: str, text: str, order: str, most_chars: int = 1200) -> DataFrame:
    """(key, place, text): the reviews that go with a listing, in order, each cut to
    `most_chars` characters; one row each, so that no listing gathers all of its own."""
    ranked = global_rank(reviews.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(key, F.col(order).alias("__order"), text), [key, "__order"], "__rn")
    first = ranked.groupBy(key).agg(F.min("__rn").alias("__first"))
    return ranked.join(first, key).select(key, (F.col("__rn") - F.col("__first") + 1).alias("place"), shorten(F.col(text), most_chars).alias("text"))
