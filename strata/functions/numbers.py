"""Numbers as text, roundings and unit conversions; integers throughout, so results are exact."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The numerals of roman numbers, and the signs that mark notes.
_ROMAN = [(1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")]
_SIGNS = ["*", "†", "‡", "§"]


def floor_div(a: Column, b: Column | int) -> Column:
    """Quotient rounded towards minus infinity."""
    b = F.lit(b) if isinstance(b, int) else b
    return ((a - F.pmod(a, b)) / b).cast("long")


def roman(n: Column) -> Column:
    """Lower-case roman numeral; a space for 0, null below."""
    table = F.array(*(F.struct(F.lit(v).alias("v"), F.lit(s).alias("s")) for v, s in _ROMAN))
    start = F.struct(n.cast("long").alias("left"), F.lit("").alias("out"))
    fold = F.aggregate(
        table,
        start,
        lambda a, x: F.struct((a["left"] % x["v"]).alias("left"), F.concat(a["out"], F.repeat(x["s"], (a["left"] / x["v"]).cast("int"))).alias("out")),
        lambda a: a["out"],
    )
    return F.when(n == 0, " ").when(n > 0, fold)


def letters(n: Column) -> Column:
    """a to z, then aa, bb and so on; a space for 0."""
    return F.when(n == 0, " ").when(n > 0, F.repeat(F.char((n - 1) % 26 + 97), floor_div(n - 1, 26).cast("int") + 1))


def note_sign(n: Column) -> Column:
    """The four signs in turn, doubled after each round."""
    return F.when(n > 0, F.repeat(F.get(F.array(*map(F.lit, _SIGNS)), ((n - 1) % 4).cast("int")), floor_div(n - 1, 4).cast("int") + 1))


def number_text(n: Column, form: Column) -> Column:
    """A number in one of the named formats; null for an unknown one."""
    return (
        F.when(form == "decimal", n.cast("string"))
        .when(form == "lowerRoman", roman(n))
        .when(form == "upperRoman", F.upper(roman(n)))
        .when(form == "lowerLetter", letters(n))
        .when(form == "upperLetter", F.upper(letters(n)))
        .when(form == "numberInDash", F.concat(F.lit("- "), n.cast("string"), F.lit(" -")))
        .when(form == "decimalZero", F.when(n < 10, F.concat(F.lit("0"), n.cast("string"))).otherwise(n.cast("string")))
        .when(form == "hex", F.hex(n.cast("long")))
        .when(form == "chicago", note_sign(n))
    )


def picture(n: Column, shape: Column) -> Column:
    """Digits right-aligned over '0' (shown) and '#' (a space); a longer number stays whole."""
    digits = n.cast("string")
    free = F.greatest(F.length(shape) - F.length(digits), F.lit(0))
    return F.concat(F.translate(F.substring(shape, F.lit(1), free), "#", " "), digits)


def first_cap(text: Column) -> Column:
    """Only the first character in upper case; the rest stays."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))


def caps(text: Column) -> Column:
    """The first character of each word between single spaces in upper case; the rest stays."""
    return F.array_join(F.transform(F.split(text, " ", -1), first_cap), " ")


def half_up(a: Column, b: int) -> Column:
    """a / b to the nearest integer, ties upwards."""
    return floor_div(2 * a + b, 2 * b)


def half_down(a: Column, b: int) -> Column:
    """Ties downwards."""
    return -half_up(-a, b)


def half_away(a: Column, b: int) -> Column:
    """Ties away from zero."""
    return F.when(a >= 0, half_up(a, b)).otherwise(half_down(a, b))


def half_even(a: Column, b: int) -> Column:
    """Ties to the even neighbour."""
    up = half_up(a, b)
    tie = F.pmod(2 * a + b, F.lit(2 * b)) == 0
    return F.when(tie & (F.pmod(up, F.lit(2)) == 1), up - 1).otherwise(up)


def twips_to_px(twips: Column, dpi: int = 300) -> Column:
    """Device pixels, half up; 1440 twips are an inch."""
    return half_up(twips * dpi, 1440)


def emu_to_twips(emu: Column) -> Column:
    """635 to a twip, downwards."""
    return floor_div(emu, 635)


def border_twips(eighths: Column, double: Column) -> Column:
    """Width of a border stated in eighths of a point; a double one is three times as wide."""
    return floor_div(F.when(double, eighths * 3).otherwise(eighths) * 20, 8)


def quarter(width: Column) -> Column:
    """A quarter, half up: the least width of a squeezed space's loss."""
    return floor_div(width + 2, 4)


def truth(present: Column, value: Column, absent: Column) -> Column:
    """A switch: no element means ``absent``, an element without a value is true, and only 1, true and on are."""
    return F.when(~present, absent).otherwise(F.coalesce(F.lower(value).isin("1", "true", "on"), F.lit(True)))
