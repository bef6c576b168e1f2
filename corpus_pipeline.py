"""From raw documents to token ids: language, exact copies, near copies, mixture, pieces.

Every stage takes ``(spark, docs, sf_dir)``, works on all rows its predecessor kept and returns the columns of
documents; the last one adds the ids. Between stages the rows are written as Parquet in the folder that
``spark.checkpoint.dir`` names and read again, so a lost executor costs at most one stage.

Defined cases: null texts and texts without a letter go in the first stage; a null id or source is a value like any
other (a null id counts as the smallest among exact copies, as the greatest among near ones); repeated rows are exact
copies, of which one stays; texts of any length are taken whole; ties are settled by the smallest id; further columns are carried through, also where
their names are those of inner columns, except that ``piece_ids``, ``n_pieces``, ``decoded_text`` and ``round_trip``
give way to the last stage's; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plenum.llm import exact_blocks, language_ranks, piece_viterbi, super_minhash, temperature_mix
from plenum.llm.common import documents, settle


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a language; null texts and texts without a letter go."""
    return language_ranks.keep_known(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of texts that are equal but for white space."""
    return exact_blocks.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of texts linked by a similarity of 0.8 on five-word shingles."""
    return super_minhash.drop_near_copies(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the temperature mixture of their source draws them, within the token count of its input."""
    return temperature_mix.resample(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, their number and the decoded text beside the columns of documents."""
    return piece_viterbi.encoded(docs, keep=False)  # the next run's stages use the same workers


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("mixture", mixture), ("pieces", pieces)]

ORACLE_SQL = None  # rank profiles, similarity groups, bisection and segmentation are outside SQL; the tests hold brute force against it


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
