"""What each block is, from independent evidence combined with a noisy-or.

Signals and scores stay inside the block's row (arrays of at most a dozen entries); the document
passes are windows over one partitioning by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights and cut-offs of the evidence.
REVIEW_BELOW = 0.55
COMMON_SHARE = 0.70
STYLE_ROLES = [
    ("^title$", "title"), ("^subtitle$", "subtitle"), (r"^heading \d$", None),
    ("^(caption|figure caption|table caption)$", "caption"), (r"^toc \d$", "toc"),
    ("^(quote|intense quote|block text)$", "quote"), (r"^list bullet ?\d?$", "list_bullet"),
    (r"^list (number|paragraph) ?\d?$", "list_number"),
    (r"^(body text|normal|default paragraph|plain text|body text \d|no spacing)$", "body"),
]


def _doc():
    return Window.partitionBy("doc").orderBy("idx")


def _so_far():
    return _doc().rowsBetween(Window.unboundedPreceding, 0)


def role_for_style_name(name: Column) -> Column:
    """Role a (normalised) style name declares, or null."""
    out = None
    for pattern, role in STYLE_ROLES:
        value = F.concat(F.lit("heading"), F.substring(name, 9, 1)) if role is None else F.lit(role)
        out = F.when(name.rlike(pattern), value) if out is None else out.when(name.rlike(pattern), value)
    return out


_PCT = "concat(cast(cast(rint({x} * 100) as bigint) as string), '%')"
_X = "concat(cast(cast(rint(size_ratio * 10) / 10 as decimal(10,1)) as string), 'x')"
# the evidence table: (role, weight, evidence, prior, condition), in reporting order
_SIGNALS = [
    ("style_role", "0.35D", f"concat('style ', style_name, ' is shared by ', {_PCT.format(x='share')}, ' of the paragraphs')",
     True, f"style_role is not null and share >= {COMMON_SHARE}"),
    ("style_role", "0.95D", "concat('style ', style_name, ', which the profile uses')",
     False, f"style_role is not null and share < {COMMON_SHARE} and known_style"),
    ("style_role", "0.85D", "concat('style ', style_name, ', unknown to the profile')",
     False, f"style_role is not null and share < {COMMON_SHARE} and not known_style"),
    ("concat('heading', cast(outline_level + 1 as string))", "0.90D",
     "concat('outlined at depth ', cast(outline_level as string))", False, "outline_level is not null and outline_level < 9"),
    ("if(is_bullet, 'list_bullet', 'list_number')", "0.95D", "concat('list numbering, level ', cast(coalesce(ilvl, 0) as string))",
     False, "numbered"),
    ("'caption'", "0.92D", "concat('counts up a ', seq_kind, ' sequence')", False, "seq_kind in ('Figure', 'Table')"),
    ("'caption'", "0.70D", "concat('opens with caption wording, ', if(follows_graphic, 'follows', 'precedes'), ' a graphic')",
     False, "coalesce(seq_kind not in ('Figure', 'Table'), true) and caption_lead and (follows_graphic or precedes_graphic)"),
    ("'title'", "0.65D", f"concat({_X}, ' as large as body text, among the first paragraphs')",
     False, "not numbered and size_ratio >= 1.8 and words < 25 and body_ordinal <= 3"),
    ("'heading'", "0.65D", f"concat({_X}, ' as large as body text')", False,
     "not numbered and ((size_ratio >= 1.8 and words < 25 and coalesce(body_ordinal > 3, true))"
     " or (size_ratio >= 1.12 and not (size_ratio >= 1.8 and words < 25) and words < 30 and not ends_with_terminal))"),
    ("'caption'", "0.55D", f"concat({_X}, ' of body text size, beside a graphic')", False,
     "not numbered and size_ratio <= 0.92 and (follows_graphic or precedes_graphic)"),
    ("'body'", "0.60D", "'sized like body text'", False,
     "not numbered and size_ratio between 0.93 and 1.07"),
    ("'heading'", "0.60D", "'short bold line without end mark that stays with the next'", False,
     "bold and words > 0 and words < 12 and not ends_with_terminal and keep_next"),
    ("'heading'", "0.45D", "'few words, all capitals'", False,
     "all_caps and words > 0 and words < 12 and not ends_with_terminal"),
]


def signals(blocks: DataFrame, known_styles: list[str] | None = None, placeholders: list[str] | None = None,
            tag_prefix: str = "plenum.") -> DataFrame:
    """``signals`` array per paragraph; empty text and a known tagged control decide alone."""
    names = placeholders or []
    name = F.regexp_replace(F.coalesce("sdt_tag", F.lit("")), "^" + tag_prefix.replace(".", "\\."), "")
    declared = F.when(name != "", name.isin(names) if names else F.lit(False)).otherwise(False)
    fired = ",\n".join(
        f"if({cond}, struct({i} as seq, {role} as role, {weight} as weight, {text} as evidence, {str(prior).lower()} as prior), null)"
        for i, (role, weight, text, prior, cond) in enumerate(_SIGNALS))
    alone = "array(struct({n} as seq, '{role}' as role, 0.99D as weight, {text} as evidence, false as prior))"
    default = "array(struct(90 as seq, 'body' as role, 0.50D as weight, 'no sign of anything but body text' as evidence, false as prior))"
    prepared = (
        blocks.where("kind = 'p'")
        .withColumn("numbered", F.coalesce(F.col("num_id") != 0, F.lit(False)))
        .withColumn("_sr", role_for_style_name(F.col("style_name")))
        .withColumn("style_role", F.expr("if(_sr = 'body' and numbered, null, _sr)"))
        .withColumn("known_style", F.col("style_name").isin(known_styles) if known_styles else F.lit(False))
        .withColumn("declared", declared)
        .withColumn("_fired", F.expr(f"array_compact(array({fired}))"))
    )
    return prepared.withColumn("signals", F.expr(
        f"""case when is_empty then {alone.format(n=91, role='empty', text="'blank'")}
        when declared then {alone.format(n=92, role='placeholder', text="concat('control with tag ', sdt_tag)")}
        when exists(_fired, s -> not s.prior) then _fired else concat(_fired, {default}) end"""
    )).drop("_sr", "_fired", "style_role", "known_style", "declared", "numbered")


def score(signalled: DataFrame) -> DataFrame:
    """Noisy-or per role with priors as a floor, generic headings merged, three alternatives."""
    scored = signalled.withColumn("_s", F.expr("""
        transform(array_distinct(transform(signals, s -> s.role)), r -> named_struct(
          'role', r,
          'score', greatest(
             1 - aggregate(filter(signals, s -> s.role = r and not s.prior), 1.0D, (a, s) -> a * (1 - s.weight)),
             coalesce(array_max(transform(filter(signals, s -> s.role = r and s.prior), s -> s.weight)), 0.0D)),
          'seq', array_min(transform(filter(signals, s -> s.role = r), s -> s.seq))))"""))
    merged = (
        scored
        .withColumn("_h", F.expr("get(filter(_s, x -> x.role = 'heading'), 0).score"))
        .withColumn("_best", F.expr(
            "get(array_sort(transform(filter(_s, x -> x.role rlike '^heading.'), x -> struct(-x.score as n, x.seq as seq, x.role as role))), 0).role"))
        .withColumn("_m", F.expr("""
          if(_h is not null and _best is not null,
             transform(filter(_s, x -> x.role <> 'heading'),
                       x -> struct(if(x.role = _best, 1 - (1 - x.score) * (1 - _h), x.score) as score, x.role as role)),
             transform(_s, x -> struct(x.score as score, x.role as role)))"""))
        .withColumn("_r", F.expr("array_sort(transform(_m, x -> struct(-round(x.score, 12) as n, x.role as role, x.score as score)))"))
    )
    return (
        merged.withColumn("role", F.expr("_r[0].role")).withColumn("confidence", F.expr("_r[0].score"))
        .withColumn("alternatives", F.expr(
            "transform(slice(_r, 2, 3), x -> struct(x.role as role, round(x.score, 3) as score))"))
        .withColumn("level", level_of(F.col("role")))
        .drop("_s", "_h", "_best", "_m", "_r")
    )


def level_of(role: Column) -> Column:
    return F.nullif(F.regexp_extract(role, r"^heading(\d+)$", 1), F.lit("")).cast("int")


def one_title(scored: DataFrame) -> DataFrame:
    """The first title stays, later ones are headings."""
    nth = F.count(F.when(F.col("role") == "title", 1)).over(_so_far())
    late = (F.col("role") == "title") & (nth > 1)
    return scored.withColumn("role", F.when(late, "heading").otherwise(F.col("role")))


def assign_levels(scored: DataFrame) -> DataFrame:
    """Rank the formats of unlevelled headings, starting at the smallest level in use."""
    open_ = F.col("role") == "heading"
    order = Window.partitionBy("doc", open_).orderBy(
        -F.coalesce("size", F.lit(0)), ~F.coalesce("bold", F.lit(False)), F.coalesce("indent_left", F.lit(0)))
    base = F.greatest(F.lit(1), F.coalesce(F.min("level").over(Window.partitionBy("doc")), F.lit(1)))
    level = F.when(open_, F.least(F.lit(9), F.col("_base") + F.col("_rank") - 1)).otherwise(F.col("level"))
    return (
        scored.withColumn("_base", base).withColumn("_rank", F.dense_rank().over(order))
        .withColumn("_open", open_).withColumn("level", level.cast("int"))
        .withColumn("role", F.when(F.col("_open"), F.concat(F.lit("heading"), F.col("level").cast("string"))).otherwise(F.col("role")))
        .drop("_base", "_rank", "_open")
    )


def enforce_consistency(scored: DataFrame) -> DataFrame:
    """E5: three or more blocks of one format share the role with the most confidence behind it."""
    real = scored.where("not is_empty")
    by_role = real.groupBy("doc", "signature", "role").agg(
        F.round(F.sum("confidence"), 9).alias("votes"), F.count(F.lit(1)).alias("n"))
    winner = by_role.groupBy("doc", "signature").agg(
        F.max(F.struct("votes", "role")).alias("w"), F.sum("n").alias("n")).where("n >= 3")
    joined = scored.join(
        winner.select("doc", "signature", F.col("w.role").alias("_role"),
                      F.least(F.lit(0.95), F.col("w.votes") / F.col("n")).alias("_conf")),
        ["doc", "signature"], "left")
    moved = F.col("_role").isNotNull() & ~F.col("is_empty") & (F.col("_role") != F.col("role"))
    return (
        joined.withColumn("_moved", moved)
        .withColumn("confidence", F.when(F.col("_moved"), F.col("_conf")).otherwise(F.col("confidence")))
        .withColumn("level", F.when(F.col("_moved"), level_of(F.col("_role"))).otherwise(F.col("level")))
        .withColumn("role", F.when(F.col("_moved"), F.col("_role")).otherwise(F.col("role")))
        .drop("_role", "_conf", "_moved")
    )


def repair_level_skips(scored: DataFrame) -> DataFrame:
    """A level may exceed the one before by one at most.

    The sequential rule ``l'[i] = min(l[i], l'[i-1] + 1)`` is ``i + min over j <= i of (l[j] - j)``.
    """
    nth = F.count("level").over(_so_far())
    fixed = F.col("_i") + F.min(F.col("level") - F.col("_i")).over(_so_far())
    skipped = F.col("level").isNotNull() & (F.col("_fixed") < F.col("level"))
    return (
        scored.withColumn("_i", nth).withColumn("_fixed", fixed.cast("int")).withColumn("_skip", skipped)
        .withColumn("confidence", F.when(F.col("_skip"), F.col("confidence") * 0.9).otherwise(F.col("confidence")))
        .withColumn("level", F.when(F.col("_skip"), F.col("_fixed")).otherwise(F.col("level")))
        .withColumn("role", F.when(F.col("_skip"), F.concat(F.lit("heading"), F.col("_fixed").cast("string"))).otherwise(F.col("role")))
        .drop("_i", "_fixed", "_skip")
    )


def classify(context: DataFrame, known_styles: list[str] | None = None, placeholders: list[str] | None = None,
             tag_prefix: str = "plenum.") -> DataFrame:
    """E1-E6 in order; adds role, level, confidence, alternatives, needs_review."""
    scored = score(signals(context, known_styles, placeholders, tag_prefix))
    done = repair_level_skips(enforce_consistency(assign_levels(one_title(scored))))
    return done.withColumn("needs_review", F.col("confidence") < REVIEW_BELOW)


def role_counts(classified: DataFrame) -> DataFrame:
    """Histogram of roles per document."""
    return classified.groupBy("doc", "role").agg(F.count(F.lit(1)).alias("n"))


def explain(signalled: DataFrame, needle: str) -> DataFrame:
    """Every signal of the blocks whose text contains ``needle``."""
    return signalled.where(F.contains("text", F.lit(needle))).select("doc", "idx", F.inline("signals"))


def role_ballots(classified: DataFrame, corpus: Column | None = None) -> DataFrame:
    """confident, non-empty body blocks vote for the look of their role."""
    base = F.concat(F.lit("/roles/"), F.col("role"))
    voters = classified.where("not is_empty and not needs_review and role <> 'empty' and ctx_kind = 'body'")
    entry = "struct('{p}' as leaf, '{t}' as tag, {n} as num, {s} as str)"
    entries = ",".join([
        entry.format(p="/run/size", t="sz", n="cast(size as double)", s="cast(null as string)"),
        entry.format(p="/run/bold", t="b", n="cast(null as double)", s="cast(bold as string)"),
        entry.format(p="/para/alignment", t="s", n="cast(null as double)", s="alignment"),
        entry.format(p="/para/indent_left", t="len", n="cast(indent_left as double)", s="cast(null as string)"),
    ])
    corpus = F.lit("all") if corpus is None else corpus
    return (
        voters.select(corpus.cast("string").alias("corpus"), "doc", base.alias("base"), F.expr(f"inline(array({entries}))"))
        .where("num is not null or str is not null")
        .select("corpus", "doc", F.concat("base", "leaf").alias("pointer"), "tag", "num", "str",
                F.lit(None).cast("string").alias("rule"))
    )
