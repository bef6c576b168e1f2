from collections import Counter

import pytest
from pyspark.sql import functions as F

from plenum.llm import language_ranks as lr

SF = "/root/testdata/sf0.01"


def plain_grams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    if not words:
        return Counter()
    line = "_" + "_".join(words) + "_"
    out = Counter(c for c in line if c != "_")
    out.update(line[i:i + 2] for i in range(len(line) - 1))
    out.update(line[i:i + 3] for i in range(len(line) - 2) if line[i + 1] != "_")
    return out


def code(gram):
    out = 0
    for c in gram:
        out = out << 21 | (1 if c == "_" else ord(c))
    return out


@pytest.mark.parametrize("text", ["a", "Éa b!", "x1y  zz\nzz", "日本 語x", "𐐀b 𐐀", "12 - 3", ""])
def test_ngrams_match_plain_counting(text):
    gram, n = lr.counted(lr.ngrams(text))
    assert dict(zip(gram.tolist(), n.tolist())) == {code(g): k for g, k in plain_grams(text).items()}


def test_distance_matches_plain_definition():
    texts = {"aa": "abra kadabra", "bb": "zig zag zug zug"}
    profiles = {k: lr.ranked(lr.ngrams(t), 10).tolist() for k, t in texts.items()}
    model = lr.Profiles(profiles, 10)
    for text in ("kadabra zug", "abra", "q", "zag"):
        mine = lr.ranked(lr.ngrams(text), 10).tolist()
        far = {k: sum(abs(p.index(g) - i) if g in p else 10 for i, g in enumerate(mine)) for k, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        assert model.nearest(text) == (best, 1 - far[best] / (10 * len(mine)))


def test_held_out_accuracy(spark):
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = lr.query(spark, SF).join(truth, "doc_id").where("held_out and lang_pred <> 'und'")
    n, right = got.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 150 and right / n > 0.95


def test_edges(make_docs, store, spark):
    rows = [(1, None), (2, ""), (3, "123 !!"), (4, "word"), (4, "word"), (None, "mot"), (7, "long text " * 30000)]
    docs = make_docs(rows).withColumn("lang", F.lit("xx"))
    got = lr.query(spark, store(docs)).collect()
    assert len(got) == 7
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1, 2, 3)) and by[4].lang_pred == "xx"
    kept = lr.keep_known(docs)
    assert kept.columns == docs.columns and kept.count() == 4
    assert lr.query(spark, store(make_docs([]))).count() == 0
    assert {r.lang_pred for r in lr.query(spark, store(make_docs(rows))).collect()} == {"und"}  # nothing to learn from
