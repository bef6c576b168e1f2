import math
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from plenum.llm import temperature_mix as tm

SF = "/root/testdata/sf0.01"


def h(*values):
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else struct.pack("<i", v) if abs(v) < 2 ** 31 and not isinstance(v, Long) else struct.pack("<q", v)
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed - 2 ** 64 if seed >= 2 ** 63 else seed


class Long(int):
    pass


def entropy(w):
    return -sum(x * math.log(x) for x in w if x)


def plain_exponent(totals, budget, share, limit):
    t = sum(totals)
    w = lambda a: [(x / t) ** a / sum((y / t) ** a for y in totals) for x in totals]
    repeats = lambda a: max(budget * v / x for v, x in zip(w(a), totals))

    def bisect(low, high, keep_low):
        for _ in range(80):
            mid = (low + high) / 2
            low, high = (mid, high) if keep_low(mid) else (low, mid)
        return low

    want = share * math.log(len(totals))
    a = 1.0 if entropy(w(1)) >= want else bisect(0, 1, lambda x: entropy(w(x)) >= want)
    if repeats(a) <= limit or repeats(1.0) > limit:
        return a if repeats(a) <= limit else 1.0
    return bisect(a, 1.0, lambda x: repeats(x) > limit)


@pytest.mark.parametrize("totals, budget, share, limit", [
    ([1000, 10, 5], 1015, 0.9, 1000.0), ([1000, 10, 5], 1015, 0.9, 3.0), ([7, 7, 7], 21, 0.99, 4.0), ([900, 50, 50], 2000, 0.1, 1.5), ([900, 50, 50], 1000, 1.0, 1e9),
])
def test_exponent_matches_plain_bisection(spark, totals, budget, share, limit):
    frame = spark.createDataFrame(list(enumerate(totals)), "source long, tokens long")
    assert abs(tm.exponent(frame, float(budget), share, limit) - plain_exponent(totals, budget, share, limit)) < 1e-8


def test_draw_matches_plain_loop(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = tm.costs(docs)
    plan = tm.weights(rows, budget=300_000)
    got = {r.doc_id: r.copies for r in tm.draw(rows, plan, block_tokens=2000, seed=5).collect()}
    of = {}
    for d in docs.collect():
        of.setdefault(d.source, []).append((d.doc_id, 1 + len([w for w in re.split(r"[\x20\x09-\x0D]+", d.text) if w])))
    for p in plan.collect():
        mine = of[p.source]
        assert p.total == sum(t for _, t in mine)
        blocks = {}
        for d, t in mine:
            blocks.setdefault(h(5, Long(d)) % math.ceil(p.total / 2000), []).append((d, t))
        order = sorted(blocks, key=lambda b: (h(5, p.source, Long(b)), b))
        room, used = p.target % p.total, 0
        for b in order:
            size = sum(t for _, t in blocks[b])
            left, open_ = room, True
            for d, t in sorted(blocks[b], key=lambda x: (h(6, Long(x[0])), x[0])):
                left -= t
                taken = room > 0 and (size <= room or left >= 0)
                assert got[d] == p.target // p.total + taken, (p.source, d)
            room -= size
        drawn = sum(got[d] * t for d, t in mine)
        assert p.target - max(t for _, t in mine) < drawn <= p.target


def test_mixture_meets_its_targets(spark):
    plan = tm.weights(tm.costs(spark.read.parquet(f"{SF}/documents.parquet")), entropy_share=0.999, max_repeats=8.0).collect()
    w = [p.weight for p in plan]
    assert abs(sum(w) - 1) < 1e-9 and abs(entropy(w) / math.log(len(w)) - 0.999) < 1e-6


def test_edges(make_docs, store, spark):
    rows = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "x"), (5, "long " * 50000)]
    docs = make_docs(rows).withColumn("source", F.when(F.col("doc_id") == 2, "s").when(F.col("doc_id") == 5, "t"))
    got = tm.query(spark, store(docs)).collect()
    assert len(got) == 6 and {r.source for r in got} == {"", "s", "t"} and all(r.copies >= 0 for r in got)
    again = tm.resample(docs)
    assert again.columns == docs.columns and again.count() == sum(r.copies for r in got)
    one = tm.mix(make_docs(rows)).collect()
    assert {(r.weight, r.copies) for r in one} == {(1.0, 1)}
    assert tm.query(spark, store(make_docs([]))).count() == 0
    assert tm.resample(make_docs([])).count() == 0
