"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent letter n-grams (one to three, words marked off by
one boundary sign), most frequent first. A document gets the same list over its whole text, and its
distance to a language is the sum of how far each of its n-grams is out of place there; an n-gram the
profile lacks counts as the full length of the profile. The nearest profile names the language.

Profiles are learned from at most about ``max_train_rows`` labelled rows, chosen by a hash of the
document id; n-grams are counted per batch, summed by Spark, and only the profiles themselves
(languages x ``profile_size`` n-grams) reach the driver.

Defined cases: null text, empty text or text without a letter is ``und`` with score 0, as is every row
when nothing could be learned; rows with a null language teach nothing; ties between n-grams go to the
smaller code, ties between languages to the name that sorts first; repeated rows are answered one by
one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plenum.llm.common import documents, held_out

NAME = "op9_language_rank_profiles"
ORACLE = None  # ranking n-grams of whole texts has no practical SQL
PROFILE_SIZE = 300
MAX_TRAIN_ROWS = 20_000
UNKNOWN = "und"
SLICE = 1 << 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x10000)])


def ngrams(text: str | None) -> np.ndarray:
    """Codes of all 1- to 3-grams of letters and word boundaries; empty without letters."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = _letters()[np.minimum(points, 0xFFFF)]
    far = points > 0xFFFF
    if far.any():
        letter[far] = [chr(c).isalpha() for c in points[far]]
    if not letter.any():
        return np.zeros(0, np.int64)
    line = np.concatenate([[0], np.where(letter, points, 0), [0]])
    line = line[np.concatenate([[True], (line[1:] != 0) | (line[:-1] != 0)])]
    inner = line != 0
    line[~inner] = 1  # no letter has this code, so grams of any length keep distinct codes
    two = line[:-1] << 21 | line[1:]
    three = two[:-1] << 21 | line[2:]
    three = three[inner[1:-1]]  # a boundary inside would only restate two words' edges
    return np.concatenate([line[inner], two, three])


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.sort(codes)
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.diff(np.append(first, len(codes)))


def ranked(codes: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams, most frequent first."""
    gram, n = counted(codes)
    return gram[np.lexsort((gram, -n))[:size]]


def text_slices(batch, column: int, limit: int = SLICE):
    """Row ranges of a batch whose texts have about ``limit`` bytes, so that only so much is unpacked at a time."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    upto = np.cumsum(lengths, dtype=np.int64)
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + limit, side="right")))
        yield batch.slice(low, high - low)
        low = high


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of several lists of n-grams as one list."""
    gram, n = (np.concatenate([p[i] for p in parts]) for i in range(2))
    order = np.argsort(gram, kind="stable")
    gram, n = gram[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, np.int64)
    return gram[first], np.add.reduceat(n, first) if len(first) else n


def _count_by_language(batches):
    """Counts per batch and language; n-grams are counted text slice by text slice, never gathered uncounted."""
    for batch in batches:
        of: dict[str, list] = {}
        for part in text_slices(batch, 1):
            codes: dict[str, list] = {}
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                codes.setdefault(lang, []).append(ngrams(text))
            for lang, each in codes.items():
                held = of.setdefault(lang, [])
                held.append(counted(np.concatenate(each)))
                if len(held) > 8:
                    held[:] = [_added(held)]
        for lang, held in of.items():
            gram, n = _added(held)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram), pa.array(n, pa.int64())], ["lang", "gram", "n"])


def learn(labelled: DataFrame, profile_size: int = PROFILE_SIZE, max_train_rows: int = MAX_TRAIN_ROWS) -> dict[str, list[int]]:
    """Profiles of ``labelled(doc_id, text, lang)``; the caller leaves out what may not be learned from."""
    rows = labelled.where("lang is not null and text is not null")
    share = min(1.0, max_train_rows / max(1, rows.select("lang").count()))
    rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    counts = rows.select("lang", "text").mapInArrow(_count_by_language, "lang string, gram long, n long")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counts.withColumn("rank", rank).where(F.col("rank") <= profile_size).orderBy("lang", "rank").collect()
    profiles: dict[str, list[int]] = {}
    for row in top:
        profiles.setdefault(row.lang, []).append(row.gram)
    return profiles


class Profiles:
    """Ranks of all profiles side by side, looked up by n-gram."""

    def __init__(self, profiles: dict[str, list[int]], size: int):
        self.names, self.size = sorted(profiles), size
        self.vocabulary = np.unique(np.array([g for p in profiles.values() for g in p], np.int64))
        self.rank = np.full((len(self.vocabulary) + 1, max(1, len(self.names))), -1, np.int64)
        for j, name in enumerate(self.names):
            self.rank[np.searchsorted(self.vocabulary, profiles[name]), j] = np.arange(len(profiles[name]))

    def nearest(self, text: str | None) -> tuple[str, float]:
        grams = ranked(ngrams(text), self.size)
        if not len(grams) or not self.names:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.vocabulary, grams)
        known = self.vocabulary[np.minimum(at, len(self.vocabulary) - 1)] == grams
        there = self.rank[np.where(known, at, len(self.vocabulary))]
        off = np.where(there < 0, self.size, np.minimum(self.size, np.abs(there - np.arange(len(grams))[:, None])))
        total = off.sum(axis=0)
        best = int(total.argmin())
        return self.names[best], 1.0 - float(total[best]) / (len(grams) * self.size)


def predict(rows: DataFrame, profiles: dict[str, list[int]], profile_size: int = PROFILE_SIZE) -> DataFrame:
    """``rows(key, text)`` to ``(key, lang_pred, score)``; ``key`` is any long column placed first."""
    shared = rows.sparkSession.sparkContext.broadcast(profiles)

    def run(batches):
        model = Profiles(shared.value, profile_size)
        for batch in batches:
            for part in text_slices(batch, 1):
                found = [model.nearest(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                    ["key", "lang_pred", "score"])

    return rows.mapInArrow(run, "key long, lang_pred string, score double")


def trainable(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id")))


def keep_known(docs: DataFrame, profile_size: int = PROFILE_SIZE) -> DataFrame:
    """``docs``, with all its columns, without the rows whose text is ``und``, that is, has no letter.

    No text goes for being far out of place in every profile; without profiles, rows with a letter stay too.
    """
    shared, at = docs.sparkSession.sparkContext.broadcast(learn(trainable(docs))), docs.columns.index("text")

    def run(batches):
        model = Profiles(shared.value, profile_size)
        for batch in batches:
            for part in text_slices(batch, at):
                yield part.filter(pa.array([model.nearest(t)[0] != UNKNOWN if model.names else len(ngrams(t)) > 0 for t in part.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = predict(docs.select(F.col("doc_id").cast("long").alias("key"), F.col("text").cast("string")), learn(trainable(docs)))
    return found.select(F.col("key").alias("doc_id"), held_out(F.col("key")).alias("held_out"), "lang_pred", "score")
