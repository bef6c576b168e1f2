"""The profile and its overrides on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# document names stay in these tables; the others may be shared
NAMED = ("evidence", "corpus")
TABLES = ("rules", "slots", "role_styles", *NAMED)


def write_profile(tables: dict[str, DataFrame], path: str) -> None:
    unknown = set(tables) - set(TABLES)
    if unknown:
        raise ValueError(f"not part of a profile: {sorted(unknown)}")
    for name, df in tables.items():
        if name not in NAMED and "doc" in df.columns:
            raise ValueError(f"{name} would carry document names out of the corpus")
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_profile(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in (names or TABLES)}


KNOWN = "pins map<string,string>, muted array<string>, severity map<string,string>, placeholders map<string,string>"


def read_overrides(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """One JSON object per file to four tables, and whatever else it holds as text."""
    raw = spark.read.text(path, wholetext=True)
    known = raw.select(F.from_json("value", KNOWN).alias("o"), F.from_json("value", "map<string,string>").alias("all"))
    pin = known.select(F.explode("o.pins").alias("pointer", "v")).select("pointer", F.coalesce(F.get_json_object("v", "$.value"), "v").alias("pin_value"))
    return {
        "pins": pin,
        "muted": known.select(F.explode("o.muted").alias("pointer")),
        "severity": known.select(F.explode("o.severity").alias("pointer", "severity")),
        "placeholders": known.select(F.explode("o.placeholders").alias("name", "spec")),
        "extra": known.select(F.explode(F.map_filter("all", lambda k, v: ~k.isin("pins", "muted", "severity", "placeholders"))).alias("key", "value")),
    }


def write_overrides(spark: SparkSession, tables: dict[str, DataFrame], path: str) -> None:
    """The reverse; a file a person edits, so it is one small JSON text."""
    def obj(df, k, v, quoted=True):
        entry = F.concat(F.to_json(F.array(k)), F.lit(":"), F.to_json(F.array(v)) if quoted else F.col(v))
        clean = F.regexp_replace(entry, r'^\[(".*?")\]:\[(.*)\]$', "$1:$2") if quoted else F.regexp_replace(entry, r'^\[(".*?")\]:', "$1:")
        return df.select(clean.alias("e")).groupBy().agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list("e")), ","), F.lit("}")).alias("j"))
    parts = {
        "pins": obj(tables["pins"], "pointer", "pin_value"), "severity": obj(tables["severity"], "pointer", "severity"),
        "placeholders": obj(tables["placeholders"], "name", "spec", False),
        "muted": tables["muted"].groupBy().agg(F.to_json(F.array_sort(F.collect_list("pointer"))).alias("j"))}
    out = None
    for name, df in parts.items():
        one = df.select(F.concat(F.lit(f'"{name}":'), "j").alias("s"))
        out = one if out is None else out.unionByName(one)
    extra = tables["extra"].select(F.concat(F.regexp_replace(F.to_json(F.array("key")), r"^\[(.*)\]$", "$1"), F.lit(":"), F.when(F.col("value").rlike(r'^[\[{0-9tfn-]'), F.col("value")).otherwise(
        F.regexp_replace(F.to_json(F.array("value")), r"^\[(.*)\]$", "$1"))).alias("s"))
    whole = out.unionByName(extra).groupBy().agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list("s")), ",\n"), F.lit("}")).alias("value"))
    whole.coalesce(1).write.mode("overwrite").text(path)
