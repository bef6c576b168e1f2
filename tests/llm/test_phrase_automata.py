import hashlib
import random
import re

import pytest

from plenum.llm import phrase_automata as pa

SF = "/root/testdata/sf0.001"


def brute(rows):
    words = [[w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w] for _, t in rows]
    places = {}
    for i, w in enumerate(words):
        for p in range(len(w) - 19):
            places.setdefault(tuple(w[p:p + 20]), []).append((rows[i][0], i, p))
    key = lambda d: float("inf") if d is None else d
    out = []
    for i, (d, _) in enumerate(rows):
        w, hit = words[i], set()
        for p in range(len(w) - 19):
            if any(key(e) < key(d) or (j == i and s < p) for e, j, s in places[tuple(w[p:p + 20])]):
                hit.update(range(p, p + 20))
        kept = " ".join(x for k, x in enumerate(w) if k not in hit)
        out.append((d, len(w), len(hit), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_matches_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rows_of(pa.query(spark, SF)) == brute(rows)


@pytest.mark.parametrize("sizes", [{}, {"shard_phrases": 3, "task_documents": 4}])
def test_passages_and_edges(make_docs, spark, sizes):
    rng = random.Random(11)
    base = [f"w{rng.randrange(90)}é" for _ in range(150)]
    cut = lambda: base[(a := rng.randrange(120)): a + rng.randint(10, 60)]
    rows = [(40, " ".join(base)), (41, "\t".join(base)), (None, " ".join(base)), (None, " ".join(base)), (41, " ".join(base))]
    rows += [(i, "  ".join([*cut(), f"own{i}", *cut(), *cut()])) for i in range(1, 35)]
    rows += [(50, None), (51, ""), (52, "a " * 19), (53, "a " * 20), (54, "a " * 300), (55, "a b " * 100), (56, " ".join(base[:19])), (57, " ".join(base[3:23])),
             (58, " ".join(base[:30] * 3)), (59, "x" * 50_000 + " " + " ".join(base[5:45])), (60, " ".join(base[:25]) + " " + " ".join(base[25:60]))]
    got = pa.removed(pa.keyed(make_docs(rows)), with_text=False, **sizes).select("doc_id", "n_words", "n_removed", "kept")
    assert rows_of(got) == brute(rows)


def test_kept_text(make_docs):
    words = [f"w{i}" for i in range(60)]
    by = {r.doc_id: r for r in pa.removed(pa.keyed(make_docs([(1, " ".join(words)), (2, "head " + " ".join(words[10:40]) + " tail")]))).collect()}
    assert by[2].kept == "head tail" and [tuple(s) for s in by[2].spans] == [(1, 31)] and by[1].n_removed == 0
    assert pa.removed(pa.keyed(make_docs([]))).count() == 0


def test_phrases_that_share_the_first_hash_are_all_kept(make_docs, monkeypatch):
    """Every phrase gets the same first hash; what a worker runs is sent along with it."""
    real = pa.chosen
    monkeypatch.setattr(pa, "chosen", lambda *h: (found := real(*h)) | {"g": found["g"] * 0})
    one, two = ([f"{k}{i}" for i in range(40)] for k in "ab")
    rows = [(1, " ".join(one)), (2, " ".join(two)), (3, " ".join([*one[5:35], "x", *two[:30]])), (4, " ".join(two[10:]))]
    got = pa.removed(pa.keyed(make_docs(rows)), with_text=False).select("doc_id", "n_words", "n_removed", "kept")
    assert rows_of(got) == brute(rows)
