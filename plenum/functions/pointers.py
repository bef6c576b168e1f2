"""JSON Pointers as columns, and the nest/flatten jobs over a pointer table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def escape(token: Column) -> Column:
    return F.replace(F.replace(token, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def unescape(token: Column) -> Column:
    return F.replace(F.replace(token, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))


def ptr(*tokens: Column) -> Column:
    return F.concat(*[part for t in tokens for part in (F.lit("/"), escape(t))])


def split(pointer: Column) -> Column:
    return F.transform(F.split(F.substring(pointer, 2, 1 << 30), "/"), lambda t: unescape(t))


def under(pointer: Column, prefix: str) -> Column:
    """At or below ``prefix``, on whole tokens."""
    prefix = prefix.rstrip("/")
    return (pointer == prefix) | F.startswith(pointer, F.lit(prefix + "/"))


def nest(rows: DataFrame, key: str, depth: int) -> DataFrame:
    """``(key, pointer, json)`` to one nested JSON text per key.

    One aggregation per level, deepest first; a level holds only the pointers of one document.
    """
    work = rows.select(key, "pointer", F.col("json").cast("string").alias("json"))
    levels = F.size(F.split("pointer", "/")) - 1
    for level in range(depth, 0, -1):
        here, rest = work.where(levels == level), work.where(levels < level)
        member = F.concat(F.to_json(F.array(unescape(F.substring_index("pointer", "/", -1)))), F.lit(":"), F.col("json"))
        member = F.regexp_replace(member, r'^\[(.*?)\]:', "$1:")
        parent = F.regexp_replace("pointer", "/[^/]*$", "")
        folded = (
            here.select(key, parent.alias("pointer"), member.alias("member"))
            .groupBy(key, "pointer").agg(F.array_sort(F.collect_list("member")).alias("members"))
            .select(key, "pointer", F.concat(F.lit("{"), F.array_join("members", ","), F.lit("}")).alias("json"))
        )
        work = rest.unionByName(folded)
    return work.select(key, "json")


def flatten(docs: DataFrame, key: str, json: str, depth: int) -> DataFrame:
    """One nested JSON text per key to ``(key, pointer, value)``; the inverse of :func:`nest`."""
    work = docs.select(key, F.lit("").alias("pointer"), F.col(json).alias("json"))
    done = None
    for _ in range(depth):
        opened = work.select(key, "pointer", F.explode(F.from_json("json", "map<string,string>")).alias("k", "v"))
        work = opened.select(key, F.concat("pointer", F.lit("/"), escape(F.col("k"))).alias("pointer"),
                             F.col("v").alias("json"))
        leaf_rows = work.where(~F.coalesce(F.startswith("json", F.lit("{")), F.lit(False)))
        done = leaf_rows if done is None else done.unionByName(leaf_rows)
        work = work.where(F.startswith("json", F.lit("{")))
    return done.withColumnRenamed("json", "value")
