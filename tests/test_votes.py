"""Numeric cases of the vote: twelve documents unless said otherwise."""

import pytest
from pyspark.sql import functions as F

from plenum.operators import corpus as C
from plenum.operators import profile as PR
from plenum.operators import votes as O

SCHEMA = "corpus string, doc string, pointer string, tag string, num double, str string, rule string"


def obs(spark, rows, pointer="/styles/paragraph/normal/run/size", tag="sz"):
    out = []
    for doc, value in rows:
        text = tag in ("s", "b")
        out.append(("all", doc, pointer, tag, None if text else float(value), value if text else None, None))
    return spark.createDataFrame(out, SCHEMA)


def docs(spark, n=12):
    return spark.createDataFrame([("all", f"d{i}") for i in range(1, n + 1)], "corpus string, doc string")


def one(spark, rows, n=12, **kw):
    return O.vote_all(obs(spark, rows, **kw), docs(spark, n)).first()


@pytest.mark.parametrize("rows, coverage, agreement, status, severity, value", [
    ([(f"d{i}", 1) for i in range(1, 4)], .25, 1.0, "informational", "off", 1),
    ([(f"d{i}", 22) for i in range(1, 13)], 1.0, 1.0, "normative", "error", 22),
    ([(f"d{i}", 22 if i < 11 else 24) for i in range(1, 13)], 1.0, 10 / 12, "contested", "warn", 22),
    ([(f"d{i}", i) for i in range(1, 13)], 1.0, 1 / 12, "undecided", "off", 1),
    ([(f"d{i}", 20) for i in range(1, 7)], .5, 1.0, "optional_consistent", "error-if-present", 20),
])
def test_status(spark, rows, coverage, agreement, status, severity, value):
    v = one(spark, rows)
    assert (v.coverage, v.status, v.severity) == (coverage, status, severity)
    assert v.agreement == pytest.approx(agreement)
    assert v.num == value


def test_one_document_one_vote(spark):
    rows = [("d1", 120)] * 300 + [("d2", 240), ("d3", 240)]
    v = one(spark, rows, n=3, pointer="/x/space_after", tag="len")
    assert (v.num, v.modal_count, v.observed_in) == (240, 2, 3)


def test_internal_agreement(spark):
    dv = {r.doc: r for r in O.document_votes(obs(spark, [("d1", 22)] * 8 + [("d1", 24)] * 2 + [("d2", 22)])).collect()}
    assert dv["d1"].internal_agreement == .8 and dv["d2"].internal_agreement == 1.0


def test_near_lengths_share_a_bucket_and_keep_an_observed_value(spark):
    v = one(spark, [("d1", 1440), ("d2", 1443), ("d3", 1438)], n=3, pointer="/page/left", tag="len")
    assert (v.modal_count, v.num) == (3, 1440)


def test_line_rule_is_part_of_the_bucket(spark):
    df = spark.createDataFrame([("all", "a", "/p", "line", 240.0, None, "auto"), ("all", "b", "/p", "line", 240.0, None, "exact")], SCHEMA)
    assert {r.bkey for r in O.bucketed(df).collect()} == {"line:auto:20", "line:exact:20"}


def test_banker_rounding(spark):
    df = obs(spark, [("a", 25), ("b", 35)], pointer="/x/other", tag="len")
    assert [r.bkey for r in O.bucketed(df).orderBy("num").collect()] == ["len:2", "len:4"]


def test_order_does_not_matter(spark):
    rows = [("d1", "b"), ("d2", "a"), ("d3", "c"), ("d3", "a")]
    seen = set()
    for k in range(3):
        df = obs(spark, rows[k:] + rows[:k], pointer="/p", tag="s").repartition(k + 1)
        seen.add(tuple(sorted(map(str, O.vote_all(df).collect()))))
    assert len(seen) == 1


def test_silent(spark):
    dv = O.document_votes(obs(spark, [("d1", 1), ("d2", 1)]))
    assert {r.doc for r in O.silent(dv, docs(spark, 4), pointers_per_chunk=1).collect()} == {"d3", "d4"}


def vectors(spark, rows):
    return C.vote_vectors(O.document_votes(obs(spark, rows, pointer="/a").unionByName(obs(spark, rows, pointer="/b"))))


def test_split_of_two_conventions(spark):
    rows = [(f"d{i}", 22 if i <= 3 else 24) for i in range(1, 7)]
    s = C.split(vectors(spark, rows)).first()
    assert (s.size_a, s.size_b, s.strength) == (3, 3, float("inf"))


def test_identical_documents_do_not_split(spark):
    assert C.split(vectors(spark, [(f"d{i}", 22) for i in range(1, 7)])).count() == 0


def test_any_number_of_vectors(spark):
    assert C.distances(vectors(spark, [(f"d{i}", i) for i in range(1, 41)])).count() == 40 * 39 // 2


def test_single_value_is_the_first_of_the_modal_bucket(spark):
    rows = [("all", "d", "/p/top", "len", float(v), None, None, i) for i, v in enumerate((900, 1443, 1440, 1438))]
    obs = spark.createDataFrame(rows, "corpus string, doc string, pointer string, tag string, num double, str string, rule string, seq long")
    assert O.single_values(obs).first().num == 1443.0


def test_pins(spark):
    v = O.vote_all(obs(spark, [(f"d{i}", 22) for i in range(1, 4)]))
    pins = spark.createDataFrame([("/styles/paragraph/normal/run/size", "22.000000"), ("/typo", "1")], "pointer string, pin_value string")
    assert {r.pointer: r.status for r in PR.apply_pins(v, pins).collect()} == {"/styles/paragraph/normal/run/size": "redundant", "/typo": "unknown"}


def test_small_corpus_warning(spark):
    d = docs(spark, 2)
    dv = O.document_votes(obs(spark, [("d1", 1), ("d2", 1)]))
    v = O.votes(dv, O.corpus_sizes(d))
    none = v.limit(0).selectExpr("corpus", "'' medoid_a", "'' medoid_b", "0L size_a", "0L size_b")
    w = C.warnings(O.corpus_sizes(d), C.agreement_by_document(dv, v, d), v, none).collect()
    assert [(r.kind, r.message) for r in w] == [("small", "with 2 document(s) agreement moves in steps of 50%")]


def _plain_split(profiles, members):
    """Exhaustive search over all pairs of medoids."""
    names = sorted(profiles)

    def distance(x, y):
        both = profiles[x].keys() & profiles[y].keys()
        return 0.0 if x == y else sum(profiles[x][k] != profiles[y][k] for k in both) / len(both) if both else 1.0

    d = {(x, y): distance(x, y) for x in names for y in names}
    _, a, b = min((round(sum(min(d[n, a], d[n, b]) * members[n] for n in names), 9), a, b) for i, a in enumerate(names) for b in names[i + 1:])
    one = {n for n in names if d[n, a] <= d[n, b]}
    return a, b, sum(members[n] for n in one), sum(members[n] for n in names if n not in one), d


@pytest.mark.parametrize("tile", [3, 7, 250])
def test_pruned_split_is_the_exhaustive_one(spark, monkeypatch, tile):
    import random
    monkeypatch.setattr(C, "TILE", tile)
    rng = random.Random(tile)
    rows, want = [], {}
    for corpus in ("x", "y", "z", "one"):
        profiles, members = {}, {}
        for i in range({"x": 24, "y": 17, "z": 2, "one": 1}[corpus]):
            side = rng.random() < .5
            profile = {f"/p{k}": str((k + side) % 2 if rng.random() < .8 else rng.randint(0, 3)) for k in range(8) if rng.random() < .8}
            profiles[f"v{i:02d}"], members[f"v{i:02d}"] = profile, rng.randint(1, 4)
            rows.append((corpus, f"v{i:02d}", members[f"v{i:02d}"], profile))
        if len(profiles) > 1:
            want[corpus] = _plain_split(profiles, members)
    vectors = spark.createDataFrame(rows, "corpus string, vector string, members long, profile map<string,string>")
    got = {r.corpus: (r.medoid_a, r.medoid_b, r.size_a, r.size_b) for r in C.best_medoids(vectors).collect()}
    assert got == {c: w[:4] for c, w in want.items()}
    every = C.distances(vectors).collect()
    assert {(r.corpus, r.a, r.b): r.distance for r in every} == {(c, a, b): x for c, w in want.items() for (a, b), x in w[4].items() if a < b}
    some = vectors.select("corpus", F.col("vector").alias("a")).join(vectors.select("corpus", F.col("vector").alias("b")), "corpus").where("a < b and substr(b, 3) = '7'")
    assert all(r.distance == want[r.corpus][4][r.a, r.b] for r in C.distances(vectors, some).collect())


def test_buckets_alone_are_those_of_the_verdicts(spark):
    rows = [(d, float(v), "ab"[v % 2]) for d in range(4) for v in (1, 1, 2, 30, 30 + d, 47)] + [(9, None, None), (9, 5.0, None)]
    specs = [("/x/width", "len", F.col("v")), ("/x/n", "n", F.col("v")), ("/x/s", "s", F.col("s"))]
    df = spark.createDataFrame(rows, "d int, v double, s string")
    full = O.document_votes(O.ballots(df, F.col("d"), specs))
    near = O.document_buckets(df, F.col("d"), specs)
    assert sorted(near.select("doc", "pointer", "bkey").collect()) == sorted(full.select("doc", "pointer", "bkey").collect())
    sizes = O.corpus_sizes(full)
    cols = ["pointer", "bkey", "observed_in", "modal_count", "coverage", "agreement", "status"]
    assert sorted(O.bucket_votes(near.withColumn("corpus", F.lit("all")), sizes).select(*cols).collect()) == sorted(O.votes(full, sizes).select(*cols).collect())
    # rows meet by document before they become ballots
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert plan.index("REBALANCE_PARTITIONS_BY_COL") > plan.index("Generate") > plan.index("hashpartitioning(doc")


@pytest.mark.parametrize("most", [1, 5, 40, 200])
def test_best_pair_is_the_exhaustive_one_for_any_classes(most):
    import random

    import numpy as np
    for seed in range(12):
        rng = random.Random(seed)
        found = {}
        for _ in range(40):
            found[tuple((f"/p{k}", str(rng.randint(0, 1 + 2 * k))) for k in range(6) if rng.random() < (.7, 1)[seed % 2])] = 0
        profiles = {f"v{i:02d}": dict(p) for i, p in enumerate(found)}
        members = {v: rng.randint(1, 3) for v in profiles}
        names = sorted(profiles, key=lambda v: rng.random())
        got = C._best_pair(C._codes([profiles[v] for v in names]), np.array([members[v] for v in names], float), names, most)
        assert got[1:3] == _plain_split(profiles, members)[:2]


def _three_ways(spark, n):
    import random
    rng = random.Random(n)
    rows = [(c, f"v{i:04d}", rng.randint(1, 3), {"/a": str(rng.randint(0, 2)), "/b": str(rng.randint(0, 1)), "/c": str(rng.randint(0, 40)), "/d": f"{c}{i}"}) for c in "xy" for i in range(n)]
    return spark.createDataFrame(rows, "corpus string, vector string, members long, profile map<string,string>")


def test_split_in_one_task_is_that_by_tiles(spark, monkeypatch):
    vectors = _three_ways(spark, 60)
    cols = ["corpus", "medoid_a", "medoid_b", "size_a", "size_b", F.round("strength", 9), "is_split"]
    one = sorted(C.best_medoids(vectors).select(*cols).collect())
    monkeypatch.setattr(C, "TILE", 20)
    monkeypatch.setattr(C, "CELLS", 0)
    assert len(one) == 2 and one == sorted(C.best_medoids(vectors).select(*cols).collect())


def test_split_of_many_vectors_holds_no_distance_matrix(spark, monkeypatch):
    monkeypatch.setattr(C, "_blocks", None)  # would hold 2,000 x 2,000 distances of each corpus
    assert C.best_medoids(_three_ways(spark, 2000)).count() == 2
    import numpy as np
    names = [f"v{i:04d}" for i in range(2000)]
    profiles = [dict(r.profile) for r in _three_ways(spark, 2000).where("corpus = 'x'").collect()]
    assert C._best_pair(C._codes(profiles), np.ones(2000), names, C.CLASSES)[3] < 2000  # of 1,999,000 pairs


def test_blocks_are_read_a_few_at_a_time(spark):
    from plenum.skew import settle
    assert len(settle(spark.range(0, 200, 1, 1), 64).inputFiles()) == 4


def test_warnings_of_a_large_corpus_hold_few_numbers_at_once(spark):
    import tracemalloc

    import pandas as pd
    rows = [r.asDict() for r in _three_ways(spark, 3000).where("corpus = 'x'").select("corpus", "vector", "members", "profile").collect()]
    pdf = pd.DataFrame(rows)
    tracemalloc.start()
    C._searched(("x",), pdf)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20  # the distances of its vectors alone would be 72 MB; steps of four million numbers held 132 MB
