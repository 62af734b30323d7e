"""Names, filters and text blocks."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TAG_PREFIX, NAME_LIMIT = "tag_", 63


def canonicalize(phrase: str) -> str:
    """Tag name of a predicate phrase, at most 63 characters long."""
    return (TAG_PREFIX + re.sub(r"[^a-z0-9]+", "_", phrase.strip().lower()).strip("_"))[:NAME_LIMIT]


def canonical_column(phrase: Column) -> Column:
    low = F.regexp_replace(F.lower(F.trim(phrase)), "[^a-z0-9]+", "_")
    return F.substring(F.concat(F.lit(TAG_PREFIX), F.btrim(low, F.lit("_"))), 1, NAME_LIMIT)


def canonical_names(phrases: list[str]) -> dict[str, str]:
    """phrase -> tag name; raises where two phrases share a name only because it was cut."""
    out: dict[str, str] = {}
    for p in phrases:
        name = canonicalize(p)
        for q, other in out.items():
            if other == name and re.sub(r"[^a-z0-9]+", "_", q.strip().lower()).strip("_") != re.sub(r"[^a-z0-9]+", "_", p.strip().lower()).strip("_"):
                raise ValueError(f"tag name collision: {p!r} and {q!r}")
        out[p] = name
    return out


def decanonicalize(name: str) -> str:
    return name.removeprefix(TAG_PREFIX).replace("_", " ")


#: Longest operators first, so that ">=" is not read as ">".
_OPERATORS = (">=", "<=", "!=", ">", "<", "=")


def coerce(value: str) -> int | float | str:
    """A whole number, else a number, else a string without its quotes."""
    v = value.strip()
    for kind in (int, float):
        try:
            return kind(v)
        except ValueError:
            pass
    return v[1:-1] if len(v) > 1 and v[0] == v[-1] and v[0] in "'\"" else v


def mini_filter(column: str, spec: str) -> Column:
    """`">= 4"`, `"= 'x'"`, `"abc"` (equality) as a condition on a column."""
    c, s = F.col(column), str(spec).strip()
    for op in _OPERATORS:
        if s.startswith(op):
            v = F.lit(coerce(s[len(op) :]))
            return {">=": c >= v, "<=": c <= v, "!=": c != v, ">": c > v, "<": c < v, "=": c == v}[op]
    return c == F.lit(coerce(s))


#: The operators of structural conditions.
COMPARISONS = ("<", "<=", ">", ">=", "=", "!=", "LIKE")


def compare(column: str, op: str, value: object) -> Column:
    """A structural condition: < <= > >= = != LIKE."""
    if op.upper() not in COMPARISONS:
        raise ValueError(f"unknown operator {op}")
    c, v = F.col(column), F.lit(value)
    table = {"<": lambda: c < v, "<=": lambda: c <= v, ">": lambda: c > v, ">=": lambda: c >= v, "=": lambda: c == v, "!=": lambda: c != v, "LIKE": lambda: c.like(str(value))}
    return table[op.upper()]()


def shorten(text: Column, limit: int, mark: str = "...") -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - len(mark)), F.lit(mark))).otherwise(text)


def bullets(items: Column) -> Column:
    """One "- item" line per non-empty item; null for none."""
    kept = F.filter(items, lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(kept) > 0, F.array_join(F.transform(kept, lambda x: F.concat(F.lit("- "), x)), "\n"))


def text_block(title: Column, features: Column, description: Column) -> Column:
    """Title, features and description, each under its heading; absent parts are left out."""
    part = lambda head, body: F.when(body.isNotNull() & (body != ""), F.concat(F.lit(head), body))
    return F.concat_ws("\n\n", part("Title: ", title), part("Features:\n", bullets(features)), part("Description:\n", bullets(description)))


def listing_block(title: Column, features: Column, image: Column, most: int = 12) -> Column:
    """A listing: title, at most `most` features and how many were left out, image address."""
    n = F.coalesce(F.size(features), F.lit(0))
    more = F.when(n > most, F.concat(F.lit("("), (n - most).cast("string"), F.lit(" more omitted)")))
    return F.concat_ws("\n", title, bullets(F.slice(features, 1, most)), more, F.concat(F.lit("Image: "), image))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.length(text) / 4).cast("int")


def mime_type(path: Column) -> Column:
    p = F.lower(path)
    return F.when(p.endswith(".png"), "image/png").when(p.endswith(".webp"), "image/webp").when(p.endswith(".gif"), "image/gif").otherwise("image/jpeg")
