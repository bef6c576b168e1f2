"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

*Seeds* are the e-mail addresses, IP addresses, card numbers and phone numbers that fixed patterns find.
Every seed induces *lexical patterns*: the word before it, the two words before it, and the letters it
opens with when they end in ``=`` or ``:``. Every other token that holds a digit is an unknown *instance*
of the patterns around it. Patterns and instances form a bipartite graph that Spark scores in rounds: a
pattern is worth the share of its distinct instances that are believed (seeds fully, others as far as they
are by now), an instance is believed as far as its trusted patterns do not all err. Patterns with enough
believed instances and a high enough share are trusted, and what they vouch for with enough confidence is
reported as kind ``context``, next to the seeds, which always stay.

Positions come from marking the matches of one regular expression, cutting the text at the marks and summing
the lengths of the pieces: a running sum inside one document, over as many rows as it has matches. The
regular expressions are the stated ones, made possessive and anchored at the starts of runs, so that no text
makes them run quadratically; a possessive quantifier changes nothing where what follows cannot begin with
the repeated characters.

Defined cases: null counts as empty; a text without matches has counts 0 and empty spans; the mark sign is
read as another control character, which no pattern contains; spans never overlap a seed; repeated rows are
reported one by one and count once as instances; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plenum.llm.common import documents, settle, with_rows

NAME = "op8_contextual_pii"
ORACLE = None  # the scored graph is iterative; the seeds are tested against plain matching
MARK, STAND_IN = "\x01", "\x02"
CONTEXT_CHARS = 64
ROUNDS = 3
MIN_BELIEVED = 3.0
MIN_SHARE = 0.6
MIN_CONFIDENCE = 0.8

KINDS = ("email", "ip", "card", "phone", "context")
PATTERNS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", "[0-9][.][0-9]"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", "[0-9][\x20-]?[0-9]"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "[+][0-9]"),
    # a whole token with a digit in it, without the punctuation it ends in
    "context": (r"(?<![A-Za-z0-9_=@:/.+-])(?=[A-Za-z_=@:/.+-]*+[0-9])[A-Za-z0-9_=@:/.+-]*[A-Za-z0-9]", "[0-9]"),
}


def _pieces(text: Column, kind: str) -> Column:
    """Pieces of the text between and at the matches, in turn: their lengths, matches whole, gaps by their ends."""
    pattern, hint = PATTERNS[kind]
    cut = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK)
    return F.when(text.rlike(hint), F.transform(cut, lambda x, i: F.struct(
        F.length(x).cast("long").alias("size"), F.when(i % 2 == 1, x).otherwise(F.substring(x, -CONTEXT_CHARS, CONTEXT_CHARS)).alias("piece"))))


def _luhn(digits: Column) -> Column:
    at = F.sequence(F.lit(1), F.length(digits))
    each = F.transform(at, lambda i: F.struct(F.substring(F.reverse(digits), i, F.lit(1)).cast("int").alias("d"), (i % 2 == 0).alias("twice")))
    value = lambda x: F.when(~x["twice"], x["d"]).when(x["d"] > 4, 2 * x["d"] - 9).otherwise(2 * x["d"])
    return F.aggregate(each, F.lit(0), lambda total, x: total + value(x)) % 10 == 0


def _valid(kind: Column, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    part = lambda p: F.regexp_replace(p, "^0+", "")
    octets = F.forall(F.split(match, "[.]"), lambda p: (F.length(part(p)) <= 2) | ((F.length(part(p)) == 3) & (part(p) <= "255")))
    card = F.length(digits).between(13, 19) & _luhn(F.when(F.length(digits).between(13, 19), digits).otherwise(F.lit("1")))
    return (F.when(kind == "ip", octets).when(kind == "card", card)
            .when(kind == "phone", F.length(digits).between(9, 15)).otherwise(F.lit(True)))


def matches(rows: DataFrame) -> DataFrame:
    """``rows(row, text)`` to ``(row, kind, start, end, match, before)``: valid seeds and all tokens with a digit."""
    text = F.translate(F.coalesce("text", F.lit("")), MARK, STAND_IN)
    lists = F.array(*[F.struct(F.lit(k).alias("kind"), _pieces(F.col("text"), k).alias("pieces")) for k in KINDS])
    pieces = rows.select("row", text.alias("text")).select("row", F.explode(lists).alias("x")).select("row", "x.kind", F.posexplode("x.pieces").alias("pos", "x"))
    line = Window.partitionBy("row", "kind").orderBy("pos")
    placed = pieces.select(
        "row", "kind", "pos", F.col("x.piece").alias("match"),
        F.sum("x.size").over(line.rowsBetween(Window.unboundedPreceding, -1)).alias("start"),
        F.sum("x.size").over(line.rowsBetween(Window.unboundedPreceding, 0)).alias("end"),
        F.lag("x.piece").over(line).alias("before")).where("pos % 2 = 1")
    return placed.where(_valid(F.col("kind"), F.col("match"))).select("row", "kind", "start", "end", "match", "before")


def free_tokens(spans: DataFrame) -> DataFrame:
    """Seeds, and those tokens that touch no seed of their document."""
    seed = F.col("kind") != "context"
    line = Window.partitionBy("row").orderBy("start")
    upto = line.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    on = line.rangeBetween(Window.currentRow, Window.unboundedFollowing)
    marked = spans.withColumn("left", F.max(F.when(seed, F.col("end"))).over(upto)).withColumn("right", F.min(F.when(seed, F.col("start"))).over(on))
    hit = F.coalesce(F.col("left") > F.col("start"), F.lit(False)) | F.coalesce(F.col("right") < F.col("end"), F.lit(False))
    return marked.where(seed | ~hit).drop("left", "right")


def graph(spans: DataFrame) -> DataFrame:
    """Distinct edges ``(pattern, instance, seed)``."""
    before = F.lower("before")
    one = F.regexp_extract(before, r"(\S+)\s+$", 1)
    two = F.regexp_extract(before, r"(\S+\s+\S+)\s+$", 1)
    head = F.regexp_extract(F.lower("match"), r"^([a-z_]{3,32}[=:])", 1)
    named = [F.when(c != "", F.concat(F.lit(tag), F.regexp_replace(c, r"\s+", " "))) for tag, c in (("1 ", one), ("2 ", two), ("= ", head))]
    edges = spans.select(F.explode(F.array(*named)).alias("pattern"), F.lower("match").alias("instance"), (F.col("kind") != "context").alias("seed"))
    return edges.where("pattern is not null").groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))


def believe(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``(instance, belief)`` of the instances that are no seeds and that trusted patterns vouch for."""
    belief = None
    for _ in range(rounds):
        now = edges.withColumn("belief", F.col("seed").cast("double"))
        if belief is not None:
            now = edges.join(belief, "instance", "left").withColumn("belief", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("belief", F.lit(0.0))))
        # rounded, so that sums in another order decide the same
        worth = now.groupBy("pattern").agg(F.round(F.sum("belief"), 6).alias("believed"), F.count(F.lit(1)).alias("n"))
        trusted = worth.where((F.col("believed") >= MIN_BELIEVED) & (F.col("believed") >= MIN_SHARE * F.col("n"))).select("pattern", (F.col("believed") / F.col("n")).alias("share"))
        vouched = edges.where(~F.col("seed")).join(trusted, "pattern")
        doubt = F.sum(F.log(F.greatest(1 - F.col("share"), F.lit(1e-6))))
        belief = settle(vouched.groupBy("instance").agg(F.round(1 - F.exp(doubt), 6).alias("belief")))
    return belief


def spans(docs: DataFrame) -> DataFrame:
    """Written table ``(row, kind, start, end)`` of seeds and of what their contexts lead to; ``docs(row, text)``."""
    known = settle(free_tokens(matches(docs)))
    edges = settle(graph(known))
    found = believe(edges).where(F.col("belief") >= MIN_CONFIDENCE).select("instance")
    tokens = known.where("kind = 'context'").withColumn("instance", F.lower("match")).join(found, "instance", "left_semi")
    return settle(known.where("kind <> 'context'").select("row", "kind", "start", "end").unionByName(tokens.select("row", "kind", "start", "end")))


def by_document(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(row, doc_id, text)``: counts of seeds, digest of seeds, all spans in order."""
    rank = reduce(lambda c, k: c.when(F.col("kind") == k[1], k[0]), list(enumerate(KINDS))[1:], F.when(F.col("kind") == KINDS[0], 0))
    shown = F.concat_ws(":", "kind", "start", "end")
    per = spans(docs.select("row", "text")).groupBy("row").agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in KINDS],
        F.sort_array(F.collect_list(F.struct(rank.alias("rank"), "start", "end", shown.alias("shown")))).alias("all"))
    text = lambda xs: F.concat_ws(",", F.transform(xs, lambda x: x["shown"]))
    base = F.filter(F.col("all"), lambda x: x["rank"] < len(KINDS) - 1)
    joined = docs.select("row", "doc_id").join(per.select("row", *[f"n_{k}" for k in KINDS], text(F.col("all")).alias("spans"), text(base).alias("base")), "row", "left")
    return joined.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
                         F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_rows(documents(spark, sf_dir).select("doc_id", "text"), "row").select("row", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = by_document(docs)
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_context")
