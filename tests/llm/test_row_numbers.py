"""Results stand when a table is split into other tasks between building and running a query."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from plenum.llm import common, contextual_pii, exact_blocks, phrase_automata, suffix_doubling, super_minhash, temperature_mix
from plenum.llm.common import with_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Documents in twelve files, as a query reads them."""
    folder = str(tmp_path_factory.mktemp("split"))
    spark.read.parquet(f"{SF}/documents.parquet").repartition(12).write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.fixture()
def changing(spark, monkeypatch):
    """From the first written intermediate on, scans are split otherwise."""
    real, calls = common.settle, []
    before = spark.conf.get("spark.sql.files.minPartitionNum", None)

    def settle(df):
        spark.conf.set("spark.sql.files.minPartitionNum", "3" if len(calls) % 2 else "12")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1m" if len(calls) % 2 else "40k")
        calls.append(1)
        return real(df)

    for module in (contextual_pii, exact_blocks, phrase_automata, suffix_doubling, super_minhash, temperature_mix):
        monkeypatch.setattr(module, "settle", settle)
    yield calls
    spark.conf.unset("spark.sql.files.minPartitionNum") if before is None else spark.conf.set("spark.sql.files.minPartitionNum", before)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def rows_of(df):
    return Counter(tuple(map(str, r)) for r in df.collect())


QUERIES = {m.NAME: lambda spark, table, m=m: m.query(spark, table) for m in (phrase_automata, super_minhash, suffix_doubling, contextual_pii, temperature_mix, exact_blocks)}
STAGES = {f.__name__: lambda spark, table, f=f: f(spark.read.parquet(f"{table}/documents.parquet")) for f in (exact_blocks.drop_copies, super_minhash.drop_near_copies, temperature_mix.resample)}
WANTED = {}


@pytest.mark.parametrize("name", [*QUERIES, *STAGES])
def test_steady_result(spark, table, name):
    WANTED[name] = rows_of({**QUERIES, **STAGES}[name](spark, table))
    assert WANTED[name]


@pytest.mark.parametrize("name", [*QUERIES, *STAGES])
def test_changed_splits(spark, table, changing, name):
    assert rows_of({**QUERIES, **STAGES}[name](spark, table)) == WANTED[name] and changing


def test_numbers_are_unique_and_hold(spark, table):
    docs = spark.read.parquet(f"{table}/documents.parquet")
    shapes = {"scan": docs, "narrow": docs.select("doc_id", "text").where("doc_id % 2 = 0"), "shuffled": docs.repartition(5), "exploded": docs.withColumn("x", F.explode(F.array(F.lit(1), F.lit(2)))),
              "joined": docs.join(docs.select(F.col("doc_id").alias("other"), "lang").limit(9), "lang"), "made": spark.createDataFrame([(i,) for i in range(50)], "doc_id long"),
              "row names": docs.select("doc_id", F.lit(1).alias("file_path"), F.lit(2).alias("row_index"))}
    for name, df in shapes.items():
        numbered = with_rows(df, "row")
        assert numbered.columns == [*df.columns, "row"], name
        n, distinct = numbered.agg(F.count("row"), F.countDistinct("row")).first()
        assert n == distinct == df.count(), name
        spark.conf.set("spark.sql.files.minPartitionNum", "7")
        both = numbered.alias("a").join(numbered.alias("b"), "row").where("a.doc_id <> b.doc_id").count()
        spark.conf.unset("spark.sql.files.minPartitionNum")
        assert both == 0, name
    assert with_rows(docs.limit(0), "row").count() == 0


def test_numbers_of_files_need_no_python_workers(spark, table):
    plan = with_rows(spark.read.parquet(f"{table}/documents.parquet"), "row")._jdf.queryExecution().toString()
    assert "ExistingRDD" not in plan and "LocalTableScan" in plan


def test_an_intermediate_is_given_back_alone(spark, table):
    import os

    from plenum import skew
    first, second = skew.settle(spark.range(3)), skew.settle(spark.range(4))
    folder = first.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    assert os.path.isdir(folder)
    skew.give_back(first)
    assert not os.path.exists(folder) and second.count() == 4 and not any(p.endswith(folder.rsplit("/", 1)[1]) for p in skew._SETTLED)
