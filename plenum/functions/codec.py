"""Measures as people write them (``1in``, ``11pt``, ``1.15x``, ``exact 12pt``) and back.

Measures travel as ``struct<rule string, raw bigint>``; the pointer leaf decides the type.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plenum.functions.values import leaf

# Leaves by type; twips per unit.
LENGTH_LEAVES = [
    "space_before", "space_after", "char_spacing", "indent_left", "indent_right", "indent_first_line",
    "indent_hanging", "top", "right", "bottom", "left", "header", "footer", "gutter", "width",
    "height", "content_width", "default_tab_stop",
]
FONT_LEAVES = ["size", "size_cs", "position"]
UNIT_TWIPS = {"in": 1440.0, "pt": 20.0, "pc": 240.0, "pi": 240.0, "mm": 1440.0 / 25.4, "cm": 1440.0 / 2.54}
DERIVED_LEAVES = ["content_width"]


def is_derived(pointer: Column) -> Column:
    return leaf(pointer).isin(DERIVED_LEAVES)


def kind_of(pointer: Column) -> Column:
    name = leaf(pointer)
    outside = name.isin("header", "footer") & ~F.contains(pointer, F.lit("/margins/"))
    return (
        F.when(outside, "native").when(name.isin(LENGTH_LEAVES), "length")
        .when(name.isin(FONT_LEAVES), "font_size").when(name == "line_spacing", "line_spacing")
        .otherwise("native"))


def short_decimal(number: Column) -> Column:
    """At most four decimals, no trailing zeros: ``1``, ``1.25``."""
    text = F.round(number, 4).cast("decimal(18,4)").cast("string")
    return F.regexp_replace(text, r"\.?0+$", "")


def encode(pointer: Column, raw: Column, rule: Column) -> Column:
    """Typed measure to text; native values are not touched here."""
    length = F.when(
        (F.abs(raw) >= 720) & (F.abs(raw) * 100 % 1440 == 0),
        F.concat(short_decimal(raw / 1440), F.lit("in")),
    ).otherwise(F.concat(short_decimal(raw / 20), F.lit("pt")))
    spacing = F.when(rule == "auto", F.concat(short_decimal(raw / 240), F.lit("x"))).otherwise(
        F.concat(rule, F.lit(" "), short_decimal(raw / 20), F.lit("pt")))
    kind = kind_of(pointer)
    return (
        F.when(kind == "length", length)
        .when(kind == "font_size", F.concat(short_decimal(raw / 2), F.lit("pt")))
        .when(kind == "line_spacing", spacing))


# one pattern for every written measure: rule, number, unit or x
WRITTEN = r"^\s*(?:(exact|atLeast)\s+)?([-+]?\d*\.?\d+)\s*([A-Za-z]*)\s*$"


def decode(pointer: Column, text: Column) -> Column:
    """Text to ``struct<rule, raw>``; null where the text is not a measure of the leaf's type.

    A bare number is in native units; rounding is half-even.
    """
    kind = kind_of(pointer)
    rule, unit = F.regexp_extract(text, WRITTEN, 1), F.lower(F.regexp_extract(text, WRITTEN, 3))
    number = F.regexp_extract(text, WRITTEN, 2).try_cast("double")
    points = F.try_element_at(F.create_map(*[F.lit(v) for k, t in UNIT_TWIPS.items() for v in (k, t / 20.0)]), unit)
    per_point = F.when(kind == "font_size", 2.0).otherwise(20.0)
    scale = (
        F.when((kind == "line_spacing") & (rule == ""), F.when(unit == "x", 240.0))
        .when(kind == "native", F.lit(None).cast("double"))
        .when(unit == "", 1.0).otherwise(points * per_point))
    return F.struct(
        F.when(kind == "line_spacing", F.regexp_replace(rule, "^$", "auto")).alias("rule"),
        F.rint(number * scale).cast("bigint").alias("raw"))


def round_trips(pointer: Column, raw: Column, rule: Column, decoded: Column) -> Column:
    """Did the written form read back (``decoded``) as the same measure?"""
    kind = kind_of(pointer)
    same = (decoded["raw"] == raw) & decoded["rule"].eqNullSafe(F.when(kind == "line_spacing", rule))
    return (kind == "native") | F.coalesce(same, F.lit(False))
