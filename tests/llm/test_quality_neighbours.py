import numpy as np
from pyspark.sql import functions as F

from plenum.llm import quality_neighbours as qn

SF = "/root/testdata/sf0.01"


def test_blocked_search_matches_plain_voting():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 4, (120, qn.HASHED_TERMS + qn.REPEAT_TERMS)).astype(np.float32)
    counts[60:80] = counts[:20]  # ties
    labels = rng.integers(0, 2, 100).astype(float)
    model = qn.fit(counts[:100], labels, dims=8, neighbours=5)
    got = model.score(counts)
    sims = np.round(model.project(counts) @ model.vectors.T, 5)
    for row, value in zip(sims, got):
        best = sorted(range(100), key=lambda j: (-row[j], j))[:5]
        w = np.maximum(row[best], 0).astype(float) ** 8
        assert abs(value - (w * labels[best]).sum() / w.sum()) < 1e-9


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = qn.query(spark, SF).join(labels, "doc_id").where("held_out and quality is not null").select("quality", "predicted", "score").collect()
    assert len(got) > 20
    assert np.mean([r.quality == r.predicted for r in got]) > 0.9
    assert all(0 <= r.score <= 1 for r in got)


def test_edges(make_docs, store, spark):
    rows = [(1, None), (2, ""), (3, "plain words here"), (3, "plain words here"), (None, "a"), (6, "very long " * 40000)]
    labels = spark.createDataFrame([(3, 1, 0), (6, 0, 0), (2, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = qn.query(spark, store(make_docs(rows), labels=labels)).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    none = qn.query(spark, store(make_docs(rows), labels=labels.where("false"))).collect()
    assert {r.score for r in none} == {0.5}
    assert qn.query(spark, store(make_docs([]), labels=labels)).count() == 0


def test_labels_of_held_out_rows_change_nothing(make_docs, store, spark):
    rows = [(i, ("word " if i % 2 else "W!! ") * (i + 1)) for i in range(40)]
    a = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    b = a.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    docs = make_docs(rows)
    assert sorted(map(tuple, qn.query(spark, store(docs, labels=a)).collect())) == sorted(map(tuple, qn.query(spark, store(docs, labels=b)).collect()))
