"""Rules of fonts, colours, baselines and modes: columns in integers, so results are exact."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.numbers import floor_div, half_up
from strata.operators import sweeps


def from_mode(mode: Column, least: int = 15) -> Column:
    """Whether a document is of this mode or later; one that states none is older."""
    return F.coalesce(mode >= least, F.lit(False))


def truth_table(rules: Mapping[str, tuple[int, bool]], mode: Column) -> list[Column]:
    """One flag for each rule (mode it changes at, whether it holds from there on)."""
    return [(from_mode(mode, least) == F.lit(holds)).alias(name) for name, (least, holds) in rules.items()]


def colour(value: Column) -> Column:
    """RRGGBB in capitals; null for 'auto', 'none', nothing or anything that isn't six hexadecimal digits."""
    return F.when(F.upper(value).rlike("^[0-9A-F]{6}$"), F.upper(value))


def tinted(value: Column, tint: Column, shade: Column) -> Column:
    """A colour mixed with white by tint / 255 or with black by shade / 255 (255 or null leaves it), each part half up."""

    def part(k: int) -> Column:
        v = F.conv(F.substring(value, 2 * k + 1, 2), 16, 10).cast("long")
        light = F.when(tint.isNull(), v).otherwise(half_up(v * tint + 255 * (255 - tint), 255))
        dark = F.when(shade.isNull(), light).otherwise(half_up(light * shade, 255))
        return F.lpad(F.hex(dark), 2, "0")

    return F.concat(*(part(k) for k in range(3)))


def theme_colour(df: DataFrame, slots: DataFrame, mapping: DataFrame, slot: str, literal: str, tint: Column, shade: Column) -> DataFrame:
    """df with ``resolved``: the theme slot's colour, through the document's mapping of names, tinted; else the literal one.

    ``mapping``: slot, theme_slot (a slot without a row stands for itself); ``slots``: theme_slot, rgb.
    """
    named = df.join(mapping.withColumnRenamed("slot", slot), slot, "left").withColumn("theme_slot", F.coalesce("theme_slot", slot))
    found = named.join(slots, "theme_slot", "left")
    return found.withColumn("resolved", F.coalesce(F.when(F.col("rgb").isNotNull(), tinted(F.col("rgb"), tint, shade)), colour(F.col(literal)))).drop("theme_slot", "rgb")


def device_size(half_points: Column, dpi: int = 300, exact: bool = False) -> Column:
    """Pixels of a size in half points: rounded half up, or in 1/144ths where exact."""
    return half_points * dpi if exact else half_up(half_points * dpi, 144)


def script_size(half_points: Column, percent: int = 65) -> Column:
    """Half points of a raised or lowered character: half up, two at least."""
    return F.greatest(half_up(half_points * percent, 100), F.lit(2))


def script_raise(own: Column, bound: Column) -> Column:
    """The stated raise, but no more than the bound."""
    return F.least(own, bound)


def baseline(top: Column, height: Column, above: Column, below: Column, unit: int, exact: Column) -> Column:
    """Row of a line's baseline; all sizes in 1/unit of a pixel, nothing standing below the text.

    With half a pixel or more left of the height it is rounded up from the bottom edge, else down from the top edge;
    a line of exact pitch gives the fraction up in the middle, any other below.
    """
    left = F.pmod(height, F.lit(unit))
    bottom = half_up(top + height, unit) - half_up(below, unit)
    plain = half_up(top, unit) + half_up(above - F.when(exact, floor_div(left, 2)).otherwise(left), unit)
    return F.when(left * 2 >= unit, bottom).otherwise(plain)


def by_face(chars: DataFrame, faces: DataFrame, covered: DataFrame, char: str = "ch") -> DataFrame:
    """chars (face, ch, ...) with ``drawn_by``: its own face if that has the character, else the first other by rank, else null.

    ``faces``: face, rank; ``covered``: face, ch. Decided once for each distinct (face, character).
    """
    pairs = chars.select("face", char).distinct()
    able = covered.join(faces, "face").groupBy(char).agg(F.min(F.struct("rank", "face")).alias("first"))
    own = covered.select("face", char, F.lit(True).alias("own"))
    decided = pairs.join(own, ["face", char], "left").join(able, char, "left")
    decided = decided.select("face", char, F.when(F.col("own"), F.col("face")).otherwise(F.col("first.face")).alias("drawn_by"))
    return chars.join(decided, ["face", char], "left")


def through_theme(df: DataFrame, theme: DataFrame, scripts: DataFrame) -> DataFrame:
    """df (explicit, reference, lang) with ``face``: the theme's face for the reference and the language's script, its latin one, then the explicit one.

    ``theme``: reference, script, typeface ('' counts as none); ``scripts``: lang, script.
    """
    faces = theme.where("typeface <> ''")
    own = faces.withColumnRenamed("typeface", "by_script")
    latin = faces.where("script = 'latin'").select("reference", F.col("typeface").alias("by_latin"))
    found = df.join(scripts, "lang", "left").join(own, ["reference", "script"], "left").join(latin, "reference", "left")
    return found.withColumn("face", F.coalesce("by_script", "by_latin", "explicit")).drop("by_script", "by_latin", "script")


def stated(*layers: Column) -> Column:
    """The first layer that states anything: a stated 0 or '' counts."""
    return F.coalesce(*layers)


def merged_tabs(base: Column, own: Column) -> Column:
    """Tab stops of two layers (maps of position to kind) as one: own wins, and 'clear' deletes."""
    union = F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(own, k)), own)
    return F.map_filter(union, lambda _, v: v != "clear")


def css_twips(value: Column) -> Column:
    """A CSS length in twips, half up: pt, in, cm, mm, pc and px; a bare number is in pixels of a 96th inch; null for anything else."""
    number = F.regexp_extract(value, r"^\s*(-?[0-9]*\.?[0-9]+)\s*(pt|in|cm|mm|pc|px|)\s*$", 1)
    unit = F.regexp_extract(value, r"^\s*(-?[0-9]*\.?[0-9]+)\s*(pt|in|cm|mm|pc|px|)\s*$", 2)
    each = F.when(unit == "pt", 20).when(unit == "in", 1440).when(unit == "cm", 1440 / 2.54).when(unit == "mm", 144 / 2.54).when(unit == "pc", 240).otherwise(15)
    return F.when(number != "", F.floor(number.cast("double") * each + 0.5).cast("long"))


def may_compress(over: Column, room: Column, before: Column, slack: Column, spaces: Column) -> Column:
    """Whether a line may be squeezed: its overrun is within the room, and twice the overrun times the words before no more than slack times spaces."""
    return (over <= room) & (2 * over * before <= slack * spaces)


def may_hyphenate(in_a_row: Column, limit: Column, gap: Column, zone: Column, capital: Column, caps_allowed: Column) -> Column:
    """Whether a line may end in a hyphen: under the limit of such lines in a row (0 or null: none), a gap wider than the zone, and capitals only where allowed."""
    return ((F.coalesce(limit, F.lit(0)) == 0) | (in_a_row < limit)) & (gap > zone) & (~capital | caps_allowed)


def by_coverage(chars: DataFrame, faces: DataFrame, held: DataFrame) -> DataFrame:
    """(face, at, drawn_by) of chars (face, at): the face itself where one of its intervals holds the code point, else the face of least rank that has one, else null.

    ``faces``: face and rank; ``held``: face, low and high (code points, both ends included).
    """
    own = sweeps.covered(chars, held, "face")
    others = sweeps.first_covering(own.where("NOT covered"), held.join(faces, "face").select("low", "high", "rank", F.col("face").alias("name")))
    return own.join(others, "at", "left").select("face", "at", F.when(F.col("covered"), F.col("face")).otherwise(F.col("name")).alias("drawn_by"))
