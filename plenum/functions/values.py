"""Typed values and their vote buckets.

A value travels through the engine as ``(tag, num, str, rule)``; ``bkey`` is the bucket it
votes in. The tag is part of the bucket, so a length of 240 never meets a font size of 240.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bucket widths in twips by pointer leaf (one point = 20 twips, one hundredth of
# an inch = 14.4 twips); half a point for a length nobody named; 12/240 of a line.
POINT_LEAVES = ["space_before", "space_after", "char_spacing"]
INCH_LEAVES = [
    "indent_left", "indent_right", "indent_first_line", "indent_hanging",
    "top", "right", "bottom", "left", "header", "footer", "gutter", "width", "height",
]
POINT_TWIPS = 20.0
HUNDREDTH_INCH_TWIPS = 14.4
OTHER_LENGTH_TWIPS = 10.0
LINE_240THS = 12.0


def leaf(pointer: Column) -> Column:
    """Last token of a JSON Pointer."""
    return F.substring_index(pointer, "/", -1)


def granularity(name: Column) -> Column:
    return (
        F.when(name.isin(POINT_LEAVES), F.lit(POINT_TWIPS))
        .when(name.isin(INCH_LEAVES), F.lit(HUNDREDTH_INCH_TWIPS))
        .otherwise(F.lit(OTHER_LENGTH_TWIPS))
    )


def number_text(num: Column) -> Column:
    """One spelling per number (six decimals), whatever engine prints it."""
    return F.coalesce(num.try_cast("decimal(38,6)").cast("string"), num.cast("string"))


def bkey(pointer: Column, tag: Column, num: Column, text: Column, rule: Column) -> Column:
    """Bucket key; rounding is half-even (``rint``), null values get a null bucket."""
    as_int = lambda c: F.rint(c).cast("bigint").cast("string")
    return (
        F.when(tag == "len", F.concat(F.lit("len:"), as_int(num / granularity(leaf(pointer)))))
        .when(tag == "line", F.concat(F.lit("line:"), rule, F.lit(":"), as_int(num / LINE_240THS)))
        .when(tag == "sz", F.concat(F.lit("sz:"), as_int(num)))
        .when(tag == "n", F.concat(F.lit("n:"), number_text(num)))
        .otherwise(F.concat(tag, F.lit(":"), text))
    )


def shown(num: Column, text: Column) -> Column:
    """A value as text: the string if it is one, else the number in its one spelling."""
    return F.coalesce(text, number_text(num))
