"""Pages of lines as SVG text, with SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def decimal(value: Column, scale: int = 10_000) -> Column:
    """An integer count of 1 / scale as a plain number without trailing zeros."""
    whole, rest = F.abs(value), F.lpad((F.abs(value) % scale).cast("string"), len(str(scale)) - 1, "0")
    text = F.concat(F.floor(whole / scale).cast("string"), F.lit("."), rest)
    text = F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")
    return F.concat(F.when((value < 0) & (text != "0"), "-").otherwise(""), text)


def pages(lines: DataFrame, keys: list[str], order: list[str], width: int, height: int) -> DataFrame:
    """(keys, svg) from lines (keys, order, x, y, text); x and y in ten-thousandths. Painted in ``order``."""
    element = F.concat(F.lit('<text x="'), decimal(F.col("x")), F.lit('" y="'), decimal(F.col("y")), F.lit('">'), escaped(F.col("text")), F.lit("</text>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, element.alias("__e")))), lambda x: x["__e"]), "")
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">'
    return lines.groupBy(*keys).agg(F.concat(F.lit(head), body, F.lit("</svg>")).alias("svg"))
