"""Tolerant scans of markup text with SQL functions: tags, links and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tags(html: Column) -> Column:
    """Names of start tags in order, in lower case."""
    return F.transform(F.regexp_extract_all(html, F.lit("<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1)), F.lower)


def links(html: Column) -> Column:
    """Targets of href attributes in quotes, in order."""
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))


def plain_text(html: Column) -> Column:
    """Text without scripts, styles, comments and tags; runs of white space are one space."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"[ \t\n\r\f\x0B]+", " "))


def tag_counts(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, tag, n)."""
    return pages.select(key, F.explode(tags(F.col(html))).alias("tag")).groupBy(key, "tag").agg(F.count(F.lit(1)).alias("n"))


def page_selection(text: Column) -> Column:
    """'1,3,5-7' as an array of page numbers, in its order, repeats kept."""
    def part(p: Column) -> Column:
        low = F.split(p, "-")[0].cast("int")
        return F.sequence(low, F.coalesce(F.get(F.split(p, "-"), F.lit(1)).cast("int"), low))

    return F.flatten(F.transform(F.split(F.regexp_replace(text, " ", ""), ","), part))
