"""Phrase collocations by a parse into content-triggered, overlapping chunks.

*Parse.* Words have a fixed order. Every word of a piece triggers one chunk: itself and up to two words on either
side, as long as these come later in the order (on the right, not earlier). Chunks overlap, but a phrase of up to
three words has one least word (leftmost among equals), lies in that word's chunk, and is assigned to it alone. So
the parse covers every phrase once, and all occurrences of a phrase stand in chunks of one trigger.

*Dictionary.* Equal chunks are one entry with a parse frequency, reduced in each task; entries are dealt out by
(language, trigger), a row per trigger and lot, with its chunks packed in it. Phrases are counted inside distinct
chunks, weighted by frequency, where they arrive: no phrase is shuffled, and since counts are of words, not of
hashes, they are exact. A trigger with fewer occurrences than a candidate needs is left unread.

*Order.* By hash, but the ``COMMON`` most frequent words of a bounded sample come last, the most frequent the very
last. A frequent word then triggers only chunks of words still more frequent, which repeat and reduce to few entries;
that is what keeps a third of all words in one word from meeting in one task. The order never changes a count.

*Scores.* Phrases that occur often enough to be candidates, or parts of one, form a table far smaller than the corpus.
Candidates meet the frequencies of their parts there (parts that very many candidates share are broadcast, see
``join_facts``), and are scored in whole decimals of 38 digits; an overflow is an error, never a wrong number.

Defined cases: null text is empty, a null language is ``und`` and one with it; empty pieces hold no words; phrases
never cross pieces or documents; texts of any length are taken whole; ties are in the order of score, frequency and
phrase; repeated rows count each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plenum.llm.common import documents, join_facts, settle, shuffle_partitions, utf8_column

NAME = "op13_collocation_parse"
LEAST, WITHIN, TOP = 10, 50, 2000
COMMON, SAMPLE_ROWS = 4096, 2000
FLUSH_WORDS, PART_BYTES, PART_TEXT = 1_000_000, 32 << 20, 2 << 20
UNKNOWN = "und"
_BITS = 21  # of a word's number in a lot; a lot has fewer words than that allows
_CUTS = b".,;:!?\n\x0b\x0c\r"
_BETWEEN = re.compile(rb"[\x20\x09.,;:!?\x0A-\x0D]")
# A to Z in lower case; what ends a piece becomes a carriage return, a tab a blank
_TABLE = bytes(13 if b in _CUTS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))

ORACLE = """
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
         regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]') AS pieces
  FROM documents),
p AS (SELECT lang, list_filter(regexp_split_to_array(unnest(pieces), '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM d),
g AS (
  SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
  FROM p, (SELECT unnest([1, 2, 3]) AS size) WHERE len(w) >= size),
f AS (SELECT lang, size, phrase, count(*) AS n FROM g GROUP BY ALL),
total AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND n >= 10),
cuts AS (
  SELECT c.*, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
  FROM c, (SELECT unnest([1, 2]) AS k) WHERE k < size),
scored AS (
  SELECT cuts.lang, cuts.size, cuts.phrase, a, k, x.n AS l, y.n AS r,
         ((1000000::HUGEINT * a * a) // (x.n::HUGEINT * y.n))::BIGINT AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = head JOIN f y ON y.lang = cuts.lang AND y.phrase = tail),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, part, max(a) AS m FROM (
    SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS part FROM c WHERE size = 3) GROUP BY ALL),
kept AS (
  SELECT best.* FROM best LEFT JOIN longer ON longer.lang = best.lang AND part = phrase AND size = 2
  WHERE m IS NULL OR 100 * m < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, total.n AS n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""


def tokens(raw: bytes) -> list[bytes]:
    """Words and piece ends (a lone carriage return); empty entries stand for further blanks."""
    return raw.translate(_TABLE).replace(b"\r", b" \r ").split(b" ")


class _Numbers(dict):
    """Numbers of the words of a lot, given as they come; 0 is no word, 1 the end of a piece."""

    def __init__(self):
        super().__init__({b"": 0, b"\r": 1})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def order_of(words: list[bytes], common: dict[bytes, int]) -> np.ndarray:
    """Place of every word in the order of triggers."""
    high = 1 << 63
    return np.array([high + common[w] if w in common else xxhash.xxh3_64_intdigest(w) >> 1 for w in words], np.uint64)


def chunks(ids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of every word of ``ids``: its place in ``ids``, the words two and one to its left, one and two to its right (0: not in its chunk)."""
    wide = np.concatenate([[1, 1], ids, [1, 1]])
    rank, word = order[wide], wide > 1
    n = len(ids)
    at = lambda k: (wide[2 + k: 2 + k + n], rank[2 + k: 2 + k + n], word[2 + k: 2 + k + n])
    own, own_rank, is_word = at(0)
    sides = []
    for step in (-1, 1):
        (w1, r1, ok1), (w2, r2, ok2) = at(step), at(2 * step)
        later = (lambda r: r > own_rank) if step < 0 else (lambda r: r >= own_rank)
        one = ok1 & later(r1)
        two = one & ok2 & later(r2)
        sides.append((np.where(one, w1, 0), np.where(two, w2, 0)))
    pick = np.flatnonzero(is_word)
    (l1, l2), (r1, r2) = sides
    return pick, l2[pick], l1[pick], r1[pick], r2[pick]


def entries(ids: np.ndarray, lang: np.ndarray, triggers: np.ndarray, words: list[bytes], common: dict[bytes, int]):
    """The dictionary of a lot: languages' numbers, triggers, occurrences, and the packed chunks of each."""
    pick, l2, l1, r1, r2 = (c[triggers] for c in chunks(ids, order_of(words, common)))
    keys = [lang[pick], ids[pick], l1, l2, r1, r2]
    if max(len(words), int(lang.max(initial=0)) + 1) < 1 << _BITS:
        sort = [k[0] << 2 * _BITS | k[1] << _BITS | k[2] for k in (keys[:3], keys[3:])]
    else:
        sort = keys
    by = np.lexsort(sort[::-1])
    keys = [k[by] for k in keys]
    changed = lambda some: np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in some])])) if len(by) else by
    new, first = changed(keys), changed(keys[:2])
    times = np.diff(np.append(new, len(by)))
    lang, w, l1, l2, r1, r2 = (k[new] for k in keys)
    first = np.searchsorted(new, first)  # the first entry of every trigger
    names = pa.array(words, pa.binary())
    fields = [names.take(pa.array(f)) for f in (l2, l1, r1, r2)]
    lines = pc.binary_join_element_wise(*fields, pc.cast(pc.cast(pa.array(times), pa.string()), pa.binary()), b"", b"\t")
    offsets = np.zeros(1, np.int32)
    if len(lines):
        offsets = np.frombuffer(lines.buffers()[1], np.int32, len(lines) + 1)[np.append(first, len(lines))]
    packed = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), lines.buffers()[2]])
    return lang[first], names.take(pa.array(w[first])), np.add.reduceat(times, first) if len(first) else times, packed


PARSED = "lang string, word binary, total long, chunks binary"


def parse(texts: DataFrame, common: dict[bytes, int]) -> DataFrame:
    """``(lang, text)`` to dictionary rows ``PARSED``."""
    shared = texts.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        numbers, langs, held, of, live, size = _Numbers(), {}, [], [], [], 0

        def flush():
            nonlocal numbers, langs, size
            words = list(numbers)
            words[1] = b""
            ids = np.concatenate(held)
            lang, word, total, packed = entries(ids, np.concatenate(of), np.concatenate(live)[ids > 1], words, shared.value)
            names = pa.array(list(langs), pa.string())
            for at in range(0, len(total), 50_000):
                s = slice(at, at + 50_000)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(lang[s])), word[s], pa.array(total[s]), packed[s]], ["lang", "word", "total", "chunks"])
            numbers, langs, size = _Numbers(), {}, 0
            for some in (held, of, live):
                some.clear()

        for batch in batches:
            raw, at = utf8_column(batch.column(1))
            for i, lang in enumerate(batch.column(0).to_pylist()):
                for found, told, open_ in parts_of(raw[at[i]: at[i + 1]]):
                    ids = np.fromiter(map(numbers.__getitem__, found), np.int64, len(found))
                    ids = np.append(ids[ids > 0], 1) if not open_ else ids[ids > 0]
                    trigger = np.ones(len(ids), bool)
                    trigger[:told] = False
                    if open_:
                        trigger[-2:] = False
                    held.append(np.append(ids, 1))
                    live.append(np.append(trigger, False))
                    of.append(np.full(len(ids) + 1, langs.setdefault(lang, len(langs)), np.int64))
                    size += len(ids)
                    if size >= FLUSH_WORDS:
                        yield from flush()
        if size:
            yield from flush()

    return texts.mapInArrow(run, PARSED)


def parts_of(raw: bytes):
    """A text's tokens, in parts where it is very long: how many of the first have triggered already, whether two at the end must wait."""
    low, carried = 0, []
    while low < len(raw):
        cut = _BETWEEN.search(raw, low + PART_TEXT) if len(raw) - low > PART_TEXT else None
        high = cut.start() if cut else len(raw)
        found = carried + tokens(raw[low:high])
        yield found, max(0, len(carried) - 2), high < len(raw)
        carried = list(islice((t for t in reversed(found) if t), 4))[::-1]
        low = high


def count_trigger(word: bytes, blobs: list[bytes], least: int):
    """Phrases of one trigger that occur at least ``least`` times, as ``(phrase, words, times)``; the word itself apart."""
    fields = b"".join(blobs).split(b"\t")
    times = list(map(int, fields[4::5]))
    l2, l1, r1, r2 = (fields[k:-1:5] for k in range(4))
    left: dict[bytes, int] = {}
    right: dict[bytes, int] = {}
    for w, n in zip(l1, times):
        left[w] = left.get(w, 0) + n
    for w, n in zip(r1, times):
        right[w] = right.get(w, 0) + n
    left = {w: n for w, n in left.items() if w and n >= least}
    right = {w: n for w, n in right.items() if w and n >= least}
    for w, n in left.items():
        yield b"%b %b" % (w, word), 2, n
    for w, n in right.items():
        yield b"%b %b" % (word, w), 2, n
    three: dict[tuple[bytes, bytes, int], int] = {}
    for a, b, c, d, n in zip(l2, l1, r1, r2, times):
        ahead, behind = b in left, c in right  # no phrase is more frequent than its parts
        if ahead and a:
            three[a, b, 0] = three.get((a, b, 0), 0) + n
        if ahead and behind:
            three[b, c, 1] = three.get((b, c, 1), 0) + n
        if behind and d:
            three[c, d, 2] = three.get((c, d, 2), 0) + n
    for (x, y, k), n in three.items():
        if n >= least:
            yield b" ".join((x, y, word) if k == 0 else (x, word, y) if k == 1 else (word, x, y)), 3, n


def _count(least: int):
    """Rows sorted by language and trigger to phrases; one row without a phrase holds a language's words of the partition."""
    def run(batches):
        out: list[tuple] = []
        sums: dict[str, int] = {}
        key, total, blobs = None, 0, []

        def done():
            lang, word = key
            sums[lang] = sums.get(lang, 0) + total
            if total >= least:
                out.append((lang, word, 1, total))
                out.extend((lang, *found) for found in count_trigger(word, blobs, least))

        def rows():
            cols = [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.binary(), pa.int32(), pa.int64()))]
            out.clear()
            return pa.RecordBatch.from_arrays([cols[0], cols[1].cast(pa.string()), *cols[2:]], ["lang", "phrase", "words", "n"])

        for batch in batches:
            for lang, word, n, packed in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if key != (lang, word):
                    if key is not None:
                        done()
                    key, total, blobs = (lang, word), 0, []
                total += n
                blobs.append(packed)
            if len(out) > 50_000:
                yield rows()
        if key is not None:
            done()
        out.extend((lang, None, 0, n) for lang, n in sums.items())
        yield rows()

    return run


def common_words(texts: DataFrame, common: int = COMMON, sample_rows: int = SAMPLE_ROWS) -> dict[bytes, int]:
    """The most frequent words of about ``sample_rows`` rows, the most frequent with the highest number."""
    share = min(1.0, sample_rows / max(1, texts.select("lang").count()))
    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(share * 1_000_000))

    def run(batches):
        for batch in batches:
            held: dict[bytes, int] = {}
            raw, at = utf8_column(batch.column(0))
            for low, high in zip(at, at[1:]):
                for word in tokens(raw[low:high]):
                    held[word] = held.get(word, 0) + 1
            held.pop(b"", None)
            held.pop(b"\r", None)
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    counts = some.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "word").limit(common).collect()
    return {bytes(row.word): len(top) - i for i, row in enumerate(top)}


FREQUENT = "lang string, phrase string, words int, n long"


def frequent(docs: DataFrame, least: int = LEAST, **sample) -> DataFrame:
    """``FREQUENT`` phrases of ``docs(lang, text)`` with at least ``least`` occurrences; rows without a phrase add up to a language's words."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = parse(texts, common_words(texts, **sample))
    bytes_ = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(shuffle_partitions(docs.sparkSession), -(-bytes_ // PART_BYTES))
    dealt = rows.repartition(parts, "lang", "word").sortWithinPartitions("lang", "word")
    return dealt.mapInArrow(_count(least), FREQUENT)


def _key(phrase, lang):
    return F.concat(phrase, F.lit("\t"), lang)  # no phrase has a tab


def collocations(docs: DataFrame, least: int = LEAST, within: int = WITHIN, top: int = TOP, **sample) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``top`` phrases of every language."""
    found = settle(frequent(docs, least, **sample))
    totals = found.where("words = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    known = found.where("words > 0")
    candidates = known.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).select(
        "lang", "phrase", "words", "a", "k", _key(F.array_join(F.slice("w", 1, F.col("k")), " "), F.col("lang")).alias("head"),
        _key(F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " "), F.col("lang")).alias("tail"))
    cuts = settle(cuts)
    for part, name in (("head", "l"), ("tail", "r")):
        facts = known.select(_key(F.col("phrase"), F.col("lang")).alias(part), F.col("n").alias(name))
        cuts = join_facts(cuts, facts, cuts.groupBy(part).agg(F.count(F.lit(1)).alias("rows_held")), part)
    big = lambda c: F.col(c).cast("decimal(19,0)")
    ratio = cuts.select("lang", "phrase", "words", "a", "k", "l", "r", (big("a") * big("a")).cast("decimal(31,0)").alias("aa"), (big("l") * big("r")).alias("lr"))
    ratio = ratio.withColumn("score", F.expr("(aa * 1000000BD) div lr"))
    best = ratio.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    longer = candidates.where("words = 3").select("lang", "a", F.explode(F.array(*[F.array_join(F.slice("w", i, 2), " ") for i in (1, 2)])).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(longer, ["lang", "phrase"], "left").where((F.col("words") == 3) | F.col("longer").isNull() | (100 * F.col("longer") < within * F.col("a")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))
    ranked = kept.withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))
