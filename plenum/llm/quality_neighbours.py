"""Document quality by nearest-neighbour voting over latent-semantic vectors.

A text becomes counts of *form terms*: hashed trigrams of the sequence of character classes (lower,
upper, digit, blank, line end, every punctuation mark on its own; runs of one class taken together)
plus terms for how words and lines repeat. Weighted by log frequency times inverse document frequency,
the terms are projected on the leading singular directions of a labelled sample. Every document's
vector is multiplied, block by block, with all vectors of the sample: an exact cosine search, no
index. The labels of the nearest neighbours vote with their similarity.

The sample is bounded by ``max_reference`` rows (chosen by a hash of the document id among rows that may
be learned from), so the broadcast holds at most ``max_reference x dims`` floats whatever the corpus size.

Defined cases: null counts as empty; an empty text has the zero vector, all similarities zero, and gets
the share of label 1 in the sample; labels that are null are not used; a document with several labels
counts once per label; without any label every score is 0.5; ties between neighbours go to the one with
the smaller document id; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.llm.common import documents, held_out, utf8_column

NAME = "op1_quality_neighbours"
ORACLE = None  # singular vectors are outside SQL
MAX_REFERENCE = 6_000
HASHED_TERMS = 1024
REPEAT_TERMS = 24
DIMS = 64
NEIGHBOURS = 15
THRESHOLD = 0.3
BLOCK = 2048


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    table = np.arange(256, dtype=np.int64)
    table[:] = 1
    table[ord("a"): ord("z") + 1] = 1
    table[0x80:] = 1
    table[ord("A"): ord("Z") + 1] = 2
    table[ord("0"): ord("9") + 1] = 3
    table[[9, 11, 12, 13, 32]] = 4
    table[10] = 5
    for i, c in enumerate(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
        table[c] = 6 + i
    return table


def _repeats(data: bytes) -> list[float]:
    """Shares in 0..1: words equal to the one before, words seen before, lines seen before, words of long lines."""
    words = data.split()
    if not words:
        return [0.0, 0.0, 0.0]
    lines = [x for x in data.split(b"\n") if x.strip()]
    same = sum(map(bytes.__eq__, words, words[1:]))
    return [same / len(words), 1 - len(set(words)) / len(words), 1 - len(set(lines)) / max(1, len(lines))]


def term_counts(data: bytes) -> np.ndarray:
    """Counts of form terms of one text."""
    out = np.zeros(HASHED_TERMS + REPEAT_TERMS, np.float32)
    if not data:
        return out
    kind = _classes()[np.frombuffer(data, np.uint8)]
    kind = kind[np.concatenate([[True], kind[1:] != kind[:-1]])]
    kind = np.concatenate([[0], kind, [0]])
    code = (kind[:-2] * 40 + kind[1:-1]) * 40 + kind[2:]
    out[:HASHED_TERMS] = np.bincount((code * 2654435761 >> 8) % HASHED_TERMS, minlength=HASHED_TERMS)
    for i, share in enumerate(_repeats(data)):
        level = min(7, int(share * 16))  # eight steps, finer than a linear scale would be for common shares
        out[HASHED_TERMS + 8 * i + level] = max(1.0, out[:HASHED_TERMS].max(initial=0.0))
    return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int = NEIGHBOURS

    def project(self, counts: np.ndarray) -> np.ndarray:
        z = weighted(counts, self.idf) @ self.axes
        norm = np.linalg.norm(z, axis=1, keepdims=True)
        return (z / np.where(norm > 1e-9, norm, 1)).astype(np.float32)

    def score(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        out = np.empty(len(counts))
        k = min(self.neighbours, len(self.labels))
        prior = float(self.labels.mean())
        for at in range(0, len(counts), BLOCK):
            near = np.round(self.project(counts[at: at + BLOCK]) @ self.vectors.T, 5)  # rounded so that the order of sums cannot decide a tie
            top = np.argsort(-near, axis=1, kind="stable")[:, :k] if near.shape[1] <= 4 * k else self._top(near, k)
            weight = np.maximum(np.take_along_axis(near, top, 1), 0).astype(np.float64) ** 8
            total = weight.sum(axis=1)
            out[at: at + BLOCK] = np.where(total > 0, (weight * self.labels[top]).sum(axis=1) / np.where(total > 0, total, 1), prior)
        return np.clip(out, 0.0, 1.0)

    @staticmethod
    def _top(near: np.ndarray, k: int) -> np.ndarray:
        """Indices of the ``k`` greatest per row; the earlier row of the sample wins a tie."""
        cut = -np.partition(-near, k - 1, axis=1)[:, k - 1: k]
        above, level = near > cut, near == cut
        free = k - above.sum(axis=1, keepdims=True)
        take = above | (level & (np.cumsum(level, axis=1) <= free))
        return np.nonzero(take)[1].reshape(len(near), k)


def _encode(batches):
    for batch in batches:
        raw, at = utf8_column(batch.column(2))
        rows = [term_counts(raw[a:b]).tobytes() for a, b in zip(at[:-1], at[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], ["doc_id", "label", "terms"])


def sample_terms(docs: DataFrame, labels: DataFrame, max_reference: int = MAX_REFERENCE) -> tuple[np.ndarray, np.ndarray]:
    """Term counts and labels of the bounded sample; ``labels(doc_id, label)`` holds only rows that may be learned from."""
    labels = labels.where("label is not null and doc_id is not null")
    share = min(1.0, max_reference / max(1, labels.count()))
    chosen = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", F.col("label").cast("int").alias("label"), "text")
    found = rows.mapInArrow(_encode, "doc_id long, label int, terms binary").collect()
    found.sort(key=lambda r: (r.doc_id, r.label, bytes(r.terms)))
    counts = np.array([np.frombuffer(r.terms, np.float32) for r in found]).reshape(len(found), HASHED_TERMS + REPEAT_TERMS)
    return counts, np.array([r.label for r in found], np.float64)


def fit(counts: np.ndarray, labels: np.ndarray, dims: int = DIMS, neighbours: int = NEIGHBOURS) -> Model:
    width = HASHED_TERMS + REPEAT_TERMS
    if not len(labels):
        return Model(np.ones(width), np.zeros((width, 1)), np.zeros((0, 1), np.float32), labels, neighbours)
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 1.0
    x = weighted(counts, idf)
    _, axes = np.linalg.eigh(x.T.astype(np.float64) @ x)
    model = Model(idf.astype(np.float32), axes[:, ::-1][:, :dims].astype(np.float32), np.zeros((0, dims)), labels, neighbours)
    model.vectors = model.project(counts)
    return model


def score(rows: DataFrame, model: Model) -> DataFrame:
    """``rows(key, text)`` to ``(key, score)``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            raw, at = utf8_column(batch.column(1))
            for lo in range(0, batch.num_rows, BLOCK):
                hi = min(lo + BLOCK, batch.num_rows)
                counts = np.array([term_counts(raw[at[i]: at[i + 1]]) for i in range(lo, hi)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(shared.value.score(counts))], ["key", "score"])

    return rows.mapInArrow(run, "key long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label")).where(~held_out(F.col("doc_id")))
    model = fit(*sample_terms(docs, labels))
    found = score(docs.select(F.col("doc_id").cast("long").alias("key"), F.col("text").cast("string")), model)
    return found.select(F.col("key").alias("doc_id"), held_out(F.col("key")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
