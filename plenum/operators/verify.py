"""Invariants of a transformation: text multisets, counts, references."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plenum.functions import keys as K

POINT_TOLERANCE = 0.06  # fixed value


def snapshot(blocks: DataFrame) -> DataFrame:
    """Ordered text keys, body and chrome apart. ``blocks``: doc, idx, text, chrome, in_del."""
    key = K.match_key(F.col("text"))
    return blocks.where("not in_del").withColumn("key", key).where("key <> ''").select("doc", "chrome", F.col("idx").alias("seq"), "key")


def counts(elements: DataFrame) -> DataFrame:
    """Elements per kind. ``elements``: doc, name."""
    return elements.groupBy("doc", "name").agg(F.count(F.lit(1)).alias("n"))


def text_faults(before: DataFrame, after: DataFrame) -> DataFrame:
    """R2: lost, invented and reordered text per document.

    Both sides go through one partitioning by document. Keys are counted per side; the order is compared
    by sums and xors over hashes of (position, key), which differ when any key stands somewhere else.
    Only 128 bits of a key travel: what counts is which keys are equal.
    """
    digest = F.struct(F.xxhash64("key"), F.xxhash64(F.lit("second"), "key"))
    side = lambda df, was: df.where("not chrome").select("doc", "seq", digest.alias("key"), F.lit(was).alias("was"))
    both = side(before, True).unionByName(side(after, False)).repartition("doc")
    placed = both.withColumn("at", F.row_number().over(Window.partitionBy("doc", "was").orderBy("seq", "key")))
    mark = F.xxhash64("at", "key")
    per_key = placed.groupBy("doc", "key").agg(
        F.count(F.when(F.col("was"), 1)).alias("b"), F.count(F.when(~F.col("was"), 1)).alias("a"),
        F.sum(F.when(F.col("was"), mark).otherwise(-mark.cast("decimal(20,0)")).cast("decimal(38,0)")).alias("s"), F.bit_xor(mark).alias("x"))
    per = per_key.groupBy("doc").agg(
        F.sum(F.when(F.col("a") == 0, F.col("b")).otherwise(0)).alias("lost"), F.sum(F.when(F.col("b") == 0, F.col("a")).otherwise(0)).alias("invented"),
        F.sum("b").alias("n_b"), F.sum("a").alias("n_a"), F.sum("s").alias("s"), F.bit_xor("x").alias("x"))
    moved = (F.col("lost") == 0) & (F.col("invented") == 0) & ((F.col("n_b") != F.col("n_a")) | (F.col("s") != 0) | (F.col("x") != 0))
    fault = lambda name, when, n: F.when(when, F.struct(F.lit(name).alias("fault"), F.col(n).alias("n")))
    return per.select("doc", F.inline(F.array_compact(F.array(
        fault("lost", F.col("lost") > 0, "lost"), fault("invented", F.col("invented") > 0, "invented"), fault("reordered", moved, "n_b")))))


def count_faults(before: DataFrame, after: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """R2: counted things that became fewer, or more than the allowed gain."""
    joined = before.withColumnRenamed("n", "was").join(after.withColumnRenamed("n", "now"), ["doc", "name"], "full")
    joined = joined.select("doc", "name", F.coalesce("was", F.lit(0)).alias("was"), F.coalesce("now", F.lit(0)).alias("now"))
    if allowed is not None:
        joined = joined.join(allowed, ["name"], "left")
    gain = F.coalesce("gain", F.lit(0)) if allowed is not None else F.lit(0)
    return joined.select("doc", "name", "was", "now", F.when(F.col("now") < F.col("was"), "lost").when(F.col("now") > F.col("was") + gain, "gained").alias("fault")).where("fault is not null")


def dangling(child: DataFrame, parent: DataFrame, on: list[str], fault: str) -> DataFrame:
    """References that do not resolve; one row per distinct missing key."""
    return child.select(*on).distinct().join(parent.select(*on).distinct(), on, "left_anti").select(
        F.lit(fault).alias("fault"), F.concat_ws("/", *[F.col(c).cast("string") for c in on]).alias("subject"))


def unpaired(starts: DataFrame, ends: DataFrame) -> DataFrame:
    """Range marks that start and never end, or end and never start. doc, part, mark."""
    on = ["doc", "part", "mark"]
    return dangling(starts, ends, on, "opened, not closed").unionByName(dangling(ends, starts, on, "closed, not opened"))


def final_section(children: DataFrame) -> DataFrame:
    """The closing section must be there, once, and last. ``children``: doc, pos, tag."""
    sect = F.col("tag") == "sectPr"
    per = children.groupBy("doc").agg(F.count(F.when(sect, 1)).alias("n"), F.max(F.when(sect, F.col("pos"))).alias("at"), F.max("pos").alias("last"))
    fault = F.when(F.col("n") == 0, "section end missing").when(F.col("n") > 1, "section end repeated").when(F.col("at") != F.col("last"), "section end not last")
    return per.select("doc", fault.alias("fault")).where("fault is not null")


class Refused(ValueError):
    """Raised before anything is written."""


def gate(faults: DataFrame, limit: int = 20) -> None:
    """Any fault means nothing is written. Only the first few are fetched for the message."""
    rows = faults.limit(limit).collect()
    if rows:
        raise Refused(f"{len(rows)}{'+' if len(rows) == limit else ''} fault(s), e.g. " + "; ".join(str(r.asDict()) for r in rows[:3]))


def guarded_write(df: DataFrame, faults: DataFrame, path: str) -> None:
    """Write only if the gate lets it through."""
    gate(faults)
    df.write.mode("overwrite").parquet(path)


def rendering_diff(ours: DataFrame, theirs: DataFrame, numbers: list[str], texts: list[str]) -> DataFrame:
    """Positional differences of two renderings up to the first text divergence of a document.

    Both: doc, pos, key, plus the properties. Numbers differ beyond .06 pt; undefined is skipped.
    """
    o = ours.select("doc", "pos", F.col("key").alias("ko"), *[F.col(c).alias(f"o_{c}") for c in numbers + texts])
    t = theirs.select("doc", "pos", F.col("key").alias("kt"), *[F.col(c).alias(f"t_{c}") for c in numbers + texts])
    both = o.join(t, ["doc", "pos"])
    cut = both.where("ko <> kt").groupBy("doc").agg(F.min("pos").alias("cut"))
    safe = both.join(cut, "doc", "left").where("cut is null or pos < cut")
    checks = [F.when(F.abs(F.col(f"o_{c}") - F.col(f"t_{c}")) > POINT_TOLERANCE, F.struct(F.lit(c).alias("prop"), F.col(f"o_{c}").cast("string").alias("ours"), F.col(f"t_{c}").cast("string").alias("theirs"))) for c in numbers]
    checks += [F.when(F.col(f"o_{c}") != F.col(f"t_{c}"), F.struct(F.lit(c).alias("prop"), F.col(f"o_{c}").cast("string").alias("ours"), F.col(f"t_{c}").cast("string").alias("theirs"))) for c in texts]
    return safe.select("doc", "pos", F.inline(F.array_compact(F.array(*checks))))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in one and not the other, counting repeats; empty for a fixed point."""
    return a.exceptAll(b).unionByName(b.exceptAll(a))
