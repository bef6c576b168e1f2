"""What each aligned column is: fixed wording, a field, or free text; and the field's name and type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.functions import keys as K
from plenum.operators.skeleton import OPTIONAL, PRESENT, column_stats, split_variable_part
from plenum.skew import small

# Fixed values
VERBATIM = 0.95
FIELD_WORDS = 12
BARE_FIELD_WORDS = 6
NAME_CONFIDENCE = 0.70
NOT_BOILERPLATE = ["title", "caption", "toc"]
SENTENCE_END = "[.?!:;]$"
LABEL = r"^\s*([A-Za-z][A-Za-z0-9 /&'.-]{1,40}?)\s*[:\x{2013}-]\s*$"
DOC_PROPERTY = r'(?i)DOCPROPERTY\s+"?([A-Za-z0-9_ .-]+)"?'
BY = ["corpus", "section", "col"]


def _short(text: Column, limit: int) -> Column:
    return (F.size(F.split(text, " ")) <= limit) & ~text.rlike(SENTENCE_END)


def classify_columns(aligned: DataFrame, totals: DataFrame) -> DataFrame:
    """One slot per column with its kind, text, frame and enforced flag.

    Texts are counted per distinct value first, so the size of a column does not matter.
    """
    stats = column_stats(aligned, totals)
    texts = aligned.groupBy(*BY, "text").agg(F.count(F.lit(1)).alias("n"))
    flat = K.collapse(F.col("text"))
    top = texts.groupBy(*BY).agg(
        F.min(F.struct((-F.col("n")).alias("neg"), F.col("text"))).alias("m"), F.sum("n").alias("present"),
        F.bool_and(_short(flat, BARE_FIELD_WORDS)).alias("bare"))
    kinds = aligned.groupBy(*BY, "kind").agg(F.count(F.lit(1)).alias("n")).groupBy(*BY).agg(
        F.min(F.struct((-F.col("n")).alias("neg"), F.col("kind")))["kind"].alias("role"))
    parts = split_variable_part(aligned.select(*BY, "doc", "text"), BY).where("is_field")
    frames = parts.groupBy(*BY, "prefix", "suffix").agg(
        F.bool_and((F.col("middle") == "") | _short(F.col("middle"), FIELD_WORDS)).alias("value_like"))
    slot = (
        stats.select(*BY, "is_heading", "members", "occupancy", "place").join(top, BY).join(kinds, BY).join(frames, BY, "left")
        .withColumn("agreement", -F.col("m.neg") / F.col("present")).withColumn("optional", F.col("occupancy") < PRESENT))
    kind = (
        F.when(F.col("occupancy") < OPTIONAL, "free_content").when(F.col("agreement") >= VERBATIM, "boilerplate")
        .when(F.coalesce("value_like", F.lit(False)) | F.col("bare"), "placeholder").otherwise("free_content"))
    framed = (F.col("kind") == "placeholder") & F.coalesce("value_like", F.lit(False))
    return (
        slot.withColumn("kind", kind).withColumn("framed", framed)
        .withColumn("prefix", F.when(F.col("framed"), F.col("prefix")))
        .withColumn("suffix", F.when(F.col("framed"), F.col("suffix")))
        .withColumn("text", F.when(F.col("kind") == "boilerplate", F.col("m.text")).when(F.col("framed"), F.concat("prefix", "suffix")).otherwise(""))
        .withColumn("modal_text", F.col("m.text"))
        .withColumn("needs_review", (F.col("kind") == "free_content") & F.col("optional") & (F.col("occupancy") >= OPTIONAL))
        .withColumn("enforced", (F.col("kind") == "boilerplate") & ~F.col("is_heading") & ~F.col("optional")
                    & ~F.col("role").isin(NOT_BOILERPLATE) & (F.col("section") == ""))
        .drop("m", "present", "bare", "value_like"))


def ordered(slots: DataFrame) -> DataFrame:
    """Slots common enough for the skeleton, numbered in document order.

    At 40 % occupancy or more their number is at most 2.5 times the mean document length.
    """
    kept = slots.where(F.col("occupancy") >= OPTIONAL)
    order = Window.partitionBy("corpus").orderBy("place", "section", "col")
    return kept.withColumn("index", F.row_number().over(order) - 1).withColumn(
        "previous_text", F.coalesce(F.lag("modal_text").over(order), F.lit("")))


def slot_values(aligned: DataFrame, slots: DataFrame) -> DataFrame:
    """Each document's value in each placeholder: the middle of its frame, or the whole text."""
    fields = slots.where("kind = 'placeholder'").select(*BY, "framed", "prefix", "suffix")
    flat = K.collapse(F.col("text"))
    body = F.expr("substring(flat, length(prefix) + 1, greatest(length(flat) - length(prefix) - length(suffix), 0))")
    return (
        aligned.join(small(fields), BY).withColumn("flat", flat)
        .select(*BY, "doc", "pos", "sdt_tag", "instruction",
                F.when(F.col("framed"), F.trim(body)).otherwise(F.col("flat")).alias("value")))


def name_candidates(slots: DataFrame, values: DataFrame, properties: DataFrame | None = None,
                    known: DataFrame | None = None, tag_prefix: str = "plenum.") -> DataFrame:
    """Every name a placeholder could take, one row per source: (rank, name, confidence, source)."""
    fields = slots.where("kind = 'placeholder'")
    out = []

    def add(df: DataFrame, rank: int, name: Column, confidence: float, source: str):
        out.append(df.select(*BY, F.lit(rank).alias("rank"), name.alias("name"),
                             F.lit(confidence).alias("confidence"), F.lit(source).alias("source")))

    if known is not None:
        marker = F.concat(F.lit("{"), F.col("name"), F.lit("}"))
        spec = known.where(F.contains("template", marker)).select(
            "name", F.trim(F.expr("substring(template, 1, instr(template, concat('{', name, '}')) - 1)")).alias("_p"),
            F.trim(F.expr("substring(template, instr(template, concat('{', name, '}')) + length(name) + 2)")).alias("_s"))
        hit = fields.where("framed").withColumn("_p", F.trim("prefix")).withColumn("_s", F.trim("suffix")).join(spec, ["_p", "_s"])
        add(hit.groupBy(*BY).agg(F.min("name").alias("name")), 1, F.col("name"), 1.0, "a confirmed name")
    ours = F.startswith("sdt_tag", F.lit(tag_prefix))
    tags = values.where("coalesce(sdt_tag, '') <> ''").groupBy(*BY).agg(
        F.coalesce(F.min(F.when(ours, F.substring("sdt_tag", len(tag_prefix) + 1, 1000))), F.min("sdt_tag")).alias("name"))
    add(tags, 2, F.col("name"), 1.0, "a content control")
    said = F.nullif(F.trim(F.regexp_extract(F.coalesce("instruction", F.lit("")), DOC_PROPERTY, 1)), F.lit(""))
    add(values.withColumn("p", said).where("p is not null").groupBy(*BY).agg(F.min("p").alias("p")), 3,
        K.slug(F.col("p")), 0.95, "document property")
    if properties is not None:
        props = properties.select("corpus", "doc", F.col("name").alias("pname"), F.trim("value").alias("value")).where("value <> ''")
        n = values.groupBy(*BY).agg(F.count(F.lit(1)).alias("n_values"))
        hits = values.where("value <> ''").join(props, ["corpus", "doc", "value"]).groupBy(*BY, "pname").agg(F.count(F.lit(1)).alias("hits"))
        best = hits.groupBy(*BY).agg(F.min(F.struct((-F.col("hits")).alias("neg"), F.col("pname"))).alias("m")).join(n, BY)
        enough = -F.col("m.neg") >= F.greatest(F.lit(2), F.floor(F.col("n_values") / 2))
        add(best.where(enough), 4, K.slug(F.col("m.pname")), 0.85, "a document property")
    own = F.nullif(F.trim(F.regexp_replace(F.trim(F.coalesce("prefix", F.lit(""))), r"[:\x{2013}-]+$", "")), F.lit(""))
    beside = F.nullif(F.regexp_extract("previous_text", LABEL, 1), F.lit(""))
    add(fields.withColumn("label", F.coalesce(own, beside)).where("label is not null"), 5, K.slug(F.col("label")), 0.60, "the label beside it")
    add(fields, 6, F.concat(F.lit("field_"), F.col("index").cast("string")), 0.30, "its position")
    total = out[0]
    for more in out[1:]:
        total = total.unionByName(more)
    return total


def name_slots(slots: DataFrame, candidates: DataFrame) -> DataFrame:
    """The best candidate per placeholder; repeated names get ``_2``, ``_3``… in order."""
    best = candidates.groupBy(*BY).agg(F.min(F.struct("rank", "name", "confidence", "source")).alias("c"))
    named = slots.join(best, BY, "left").select(
        *slots.columns, F.col("c.name").alias("base"), F.col("c.confidence").alias("name_confidence"), F.col("c.source").alias("name_source"))
    nth = F.row_number().over(Window.partitionBy("corpus", "base").orderBy("index"))
    repeated = F.col("base").isNotNull() & (F.col("_nth") > 1)
    guess = F.col("base").isNotNull() & (F.col("name_confidence") <= 0.60)
    return (
        named.withColumn("_nth", nth)
        .withColumn("name", F.when(repeated, F.concat("base", F.lit("_"), F.col("_nth").cast("string"))).otherwise(F.col("base")))
        .withColumn("needs_review", F.col("needs_review") | repeated | guess).drop("_nth", "base"))


# What looks like a date, the formats tried, a person's name.
DATE_SHAPE = r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
SEPARATED = r"(^|\s)\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}(\s|$)"
DATE_FORMATS = ["yyyy-M-d", "yyyy/M/d", "yyyy.M.d", "M/d/yyyy", "d/M/yyyy", "M-d-yyyy", "d-M-yyyy", "d.M.yyyy", "M.d.yyyy",
                "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "MMM yyyy", "MMMM yyyy", "yyyy-M-d HH:mm:ss", "yyyy-M-d HH:mm"]
PERSON = r"^[A-Z][A-Za-z.'-]*(?:\s+[A-Z][A-Za-z.'-]*){1,3}$"


def is_date(value: Column) -> Column:
    shaped = (F.size(F.split(value, r"\s+")) <= 5) & (value.rlike(DATE_SHAPE) | value.rlike(SEPARATED))
    parsed = F.coalesce(*[F.try_to_timestamp(value, F.lit(f)) for f in DATE_FORMATS])
    return F.when(shaped, parsed.isNotNull()).otherwise(False)


def distinct_values(values: DataFrame, by: list[str]) -> DataFrame:
    return values.where("value <> ''").groupBy(*by, "value").agg(F.count(F.lit(1)).alias("n"))


def infer_types(values: DataFrame, by: list[str]) -> DataFrame:
    """Date, number, enum, person, identifier or text, from the distinct values of a column."""
    d = distinct_values(values, by)
    per = d.groupBy(*by).agg(
        F.bool_and(is_date(F.col("value"))).alias("dates"),
        F.bool_and(F.replace("value", F.lit(","), F.lit("")).try_cast("double").isNotNull()).alias("numbers"),
        F.bool_and(F.col("value").rlike(PERSON)).alias("people"), F.count(F.lit(1)).alias("n_distinct"), F.sum("n").alias("n_values"))
    few = (F.col("n_distinct") <= 5) & (F.col("n_values") >= 2 * F.col("n_distinct")) & (F.col("n_values") >= 4)
    kind = (
        F.when(F.col("dates"), "date").when(F.col("numbers"), "number").when(few, "enum").when(F.col("people"), "person")
        .when(F.col("pattern").isNotNull(), "identifier").otherwise("text"))
    return per.join(shared_patterns(values, by), by, "left").select(
        *by, kind.alias("value_type"), F.when(kind == "identifier", F.col("pattern")).alias("pattern"), "n_distinct", "n_values")


PIECES = "[A-Z]+|[a-z]+|[0-9]+|[^A-Za-z0-9]+"
ESCAPED = r"([()\[\]{}?*+\-|^$\\.&~# \t\n\r\x0b\f])"


def shared_patterns(values: DataFrame, by: list[str]) -> DataFrame:
    """A regular expression from the shape all values share; no row where there is none."""
    shapes = distinct_values(values, by).select(*by, F.regexp_extract_all("value", F.lit(PIECES), F.lit(0)).alias("ps"))
    same = shapes.groupBy(*by).agg(F.min(F.size("ps")).alias("lo"), F.max(F.size("ps")).alias("hi")).where("lo = hi")
    piece = F.col("piece")
    kind = (F.when(piece.rlike("^[0-9]+$"), "digit").when(piece.rlike(r"^\p{Lu}+$"), "upper").when(piece.rlike(r"^\p{Ll}+$"), "lower").otherwise("literal"))
    at = (
        shapes.select(*by, F.posexplode("ps").alias("at", "piece")).withColumn("kind", kind)
        .groupBy(*by, "at").agg(
            F.min("kind").alias("k1"), F.max("kind").alias("k2"), F.min("piece").alias("p1"), F.max("piece").alias("p2"),
            F.min(F.length("piece")).alias("l1"), F.max(F.length("piece")).alias("l2")))
    good = (F.col("k1") == F.col("k2")) & ((F.col("k1") != "literal") | (F.col("p1") == F.col("p2")))
    quantity = F.when(F.col("l1") == F.col("l2"), F.format_string("{%d}", "l1")).otherwise(F.format_string("{%d,%d}", "l1", "l2"))
    text = (
        F.when(F.col("k1") == "literal", F.regexp_replace("p1", ESCAPED, r"\\$1"))
        .when(F.col("k1") == "digit", F.concat(F.lit("\\d"), quantity)).when(F.col("k1") == "upper", F.concat(F.lit("[A-Z]"), quantity))
        .otherwise(F.concat(F.lit("[a-z]"), quantity)))
    whole = at.withColumn("good", good).withColumn("part", text).groupBy(*by).agg(
        F.bool_and("good").alias("good"), F.array_sort(F.collect_list(F.struct("at", "part"))).alias("ps"))
    joined = F.array_join(F.transform("ps", lambda x: x["part"]), "")
    return (
        whole.where("good").join(same, by).select(*by, joined.alias("body")).where(F.col("body").rlike(r"[\[\\]"))
        .select(*by, F.concat(F.lit("^"), F.col("body"), F.lit("$")).alias("pattern")))


def locate_in_donor(slots: DataFrame, aligned: DataFrame, values: DataFrame, donors: DataFrame) -> DataFrame:
    """The block and value the exemplar contributed to each slot; null where it has none."""
    d = small(donors.select("corpus", F.col("doc").alias("donor")))
    here = aligned.join(d, "corpus").where("doc = donor").select(*BY, F.col("pos").alias("donor_index"), K.collapse(F.col("text")).alias("_t"))
    mine = values.join(d, "corpus").where("doc = donor").select(*BY, F.col("value").alias("_v"))
    return slots.join(here, BY, "left").join(mine, BY, "left").withColumn("donor_value", F.coalesce("_v", "_t")).drop("_v", "_t")


def unconfident(named: DataFrame) -> DataFrame:
    """Required placeholders whose name is a guess."""
    return named.where(f"kind = 'placeholder' and not optional and name_confidence < {NAME_CONFIDENCE}")


def required_sections(slots: DataFrame) -> DataFrame:
    """J8."""
    return slots.where("is_heading and not optional")


def specs(named: DataFrame, types: DataFrame) -> DataFrame:
    """The placeholder table a person can edit."""
    frame = F.when(F.col("framed"), F.concat("prefix", F.lit("{"), F.col("name"), F.lit("}"), F.col("suffix")))
    return named.where("kind = 'placeholder'").join(types, BY, "left").select(
        *BY, "name", F.coalesce("value_type", F.lit("text")).alias("type"), (~F.col("optional")).alias("required"),
        "pattern", "needs_review", frame.alias("template"))


def prompts(located: DataFrame, texts: DataFrame, settings: DataFrame | None = None) -> DataFrame:
    """The exemplar's block with its value replaced by a prompt or a configured default.

    ``texts``: corpus, donor_index, text; ``settings``: name, default, prompt. A value that is
    missing or occurs more than once is skipped with the reason.
    """
    rows = located.where("kind = 'placeholder' and donor_index is not null").join(
        texts.select("corpus", "donor_index", F.col("text").alias("block")), ["corpus", "donor_index"])
    if settings is not None:
        rows = rows.join(settings, "name", "left")
    else:
        rows = rows.withColumn("default", F.lit(None).cast("string")).withColumn("prompt", F.lit(None).cast("string"))
    value = F.col("donor_value")
    times = F.expr("(length(block) - length(replace(block, donor_value, ''))) div length(donor_value)")
    reason = (F.when(F.trim(value) == "", "no value").when(times == 0, "value not found in its block")
              .when(times > 1, "value not unique in its block"))
    shown = F.coalesce("default", "prompt", K.humanise(F.col("name")))
    return rows.withColumn("reason", reason).withColumn("shown", shown).select(
        "corpus", "name", "donor_index", "reason", F.col("default").isNull().alias("is_prompt"),
        F.when(F.col("reason").isNull(), F.expr("replace(block, donor_value, shown)")).alias("text"))
