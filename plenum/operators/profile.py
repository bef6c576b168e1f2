"""The learned profile over its life: rules, evidence, pins, syncing with the exemplar."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.functions import codec
from plenum.functions import values as V
from plenum.skew import small


def apply_pins(voted: DataFrame, pins: DataFrame) -> DataFrame:
    """Pins over learned values: unknown, redundant or overriding. ``pins``: pointer, pin_value."""
    learned = voted.select("pointer", V.shown(F.col("num"), F.col("str")).alias("learned"), "agreement", "n_docs", "in_donor")
    status = (F.when(F.col("pin_value").isNull(), "learned").when(F.col("learned").isNull(), "unknown")
              .when(F.col("learned") == F.col("pin_value"), "redundant").otherwise("overriding"))
    return learned.join(pins, "pointer", "full").where("in_donor or pin_value is not null").select(
        "pointer", F.coalesce("pin_value", "learned").alias("value"), status.alias("status"), "learned", "agreement", "n_docs")


def sync(rules: DataFrame, current: DataFrame) -> DataFrame:
    """What the edited exemplar says differently; each becomes a pin. Derived values are skipped.

    ``rules``: pointer, bkey, value; ``current``: pointer, bkey, value.
    """
    now = current.select("pointer", F.col("bkey").alias("now_bkey"), F.col("value").alias("pin_value"))
    return rules.where(~codec.is_derived(F.col("pointer"))).join(now, "pointer").where("bkey <> now_bkey").select("pointer", F.col("value").alias("learned"), "pin_value")


def sync_placeholders(known: DataFrame, found: DataFrame) -> DataFrame:
    """S3: placeholders added to or removed from the exemplar, the rest merged (found values win).

    Both: name, type, template.
    """
    k = known.select("name", F.col("type").alias("ktype"), F.col("template").alias("ktpl"), F.lit(1).alias("k"))
    f = found.select("name", F.col("type").alias("ftype"), F.col("template").alias("ftpl"), F.lit(1).alias("f"))
    change = F.when(F.col("k").isNull(), "added").when(F.col("f").isNull(), "removed").otherwise("kept")
    return k.join(f, "name", "full").select("name", change.alias("change"), F.coalesce("ftype", "ktype").alias("type"), F.coalesce("ftpl", "ktpl").alias("template"))


def rules_table(voted: DataFrame, pins: DataFrame | None = None, muted: DataFrame | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """The rules a profile carries: everything common enough, not muted, pins applied."""
    out = voted.where("in_donor").withColumn("value", V.shown(F.col("num"), F.col("str"))).withColumn("of", F.col("n_docs"))
    if muted is not None:
        out = out.join(small(muted.select("pointer").distinct()), "pointer", "left_anti")
    out = out.join(small(pins.select("pointer", "pin_value")), "pointer", "left") if pins is not None else out.withColumn("pin_value", F.lit(None).cast("string"))
    out = out.join(small(overrides.select("pointer", F.col("severity").alias("_sev"))), "pointer", "left") if overrides is not None else out.withColumn("_sev", F.lit(None).cast("string"))
    severity = F.when(codec.is_derived(F.col("pointer")), "off").otherwise(F.coalesce("_sev", "severity"))
    return out.select(
        "corpus", "pointer", F.coalesce("pin_value", "value").alias("value"), "bkey", "tag", "status", severity.alias("severity"),
        F.round("coverage", 4).alias("coverage"), F.round("agreement", 4).alias("agreement"), "observed_in", "of", F.col("pin_value").isNotNull().alias("pinned"), "weak")


def unstable_values(rules: DataFrame) -> DataFrame:
    """Measures that would not read back as written; a profile with any of them is refused."""
    raw = F.col("value").try_cast("double")
    measured = rules.where(codec.kind_of(F.col("pointer")).isin("length", "font_size")).withColumn("raw", raw.cast("bigint"))
    none = F.lit(None).cast("string")
    d = codec.decode(F.col("pointer"), codec.encode(F.col("pointer"), F.col("raw"), none))
    return measured.withColumn("d", d).where((raw != F.col("raw")) | ~codec.round_trips(F.col("pointer"), F.col("raw"), none, F.col("d"))).select("pointer", "value")


def evidence(doc_votes: DataFrame, voted: DataFrame) -> DataFrame:
    """Who said what: one row per (pointer, document) with its stance and self-agreement.

    Long rows rather than a map per pointer, so a pointer every document speaks on stays distributed.
    """
    modal = voted.select("corpus", "pointer", F.col("bkey").alias("modal_bkey"), V.shown(F.col("num"), F.col("str")).alias("value"))
    return doc_votes.join(modal, ["corpus", "pointer"]).select(
        "corpus", "pointer", F.col("modal_bkey"), "doc", F.when(F.col("bkey") == F.col("modal_bkey"), "agreeing").otherwise("dissenting").alias("stance"),
        F.round("internal_agreement", 4).alias("internal_agreement"))


def show(rules: DataFrame, everything: bool = False, top: int = 30) -> DataFrame:
    """Enforced rules in pointer order, the first thirty or all."""
    rows = rules.where(F.lit(everything) | (F.col("severity") != "off")).orderBy("pointer")
    return rows if everything else rows.limit(top)
