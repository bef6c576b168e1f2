import hashlib
import random

import numpy as np

from plenum.llm import suffix_doubling as sd

SF = "/root/testdata/sf0.001"


def brute(rows):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    first = {}
    for i in order:
        d, t = rows[i]
        raw = (t or "").encode()
        for p in range(len(raw) - 49):
            first.setdefault(raw[p:p + 50], sd.LAST if d is None else d)
    out = []
    for d, t in rows:
        raw, own = (t or "").encode(), sd.LAST if d is None else d
        hit = bytearray(len(raw))
        for p in range(len(raw) - 49):
            if first[raw[p:p + 50]] < own:
                hit[p:p + 50] = b"\1" * 50
        spans = sum(1 for p in range(len(raw)) if hit[p] and (p == 0 or not hit[p - 1]))
        kept = bytes(b for b, h in zip(raw, hit) if not h)
        out.append((d, len(raw), sum(hit), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_matches_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rows_of(sd.query(spark, SF)) == brute(rows)


def test_rims_overlaps_and_edges(make_docs, store, spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdé", k=rng.randint(1, 9)))
    base = " ".join(word() for _ in range(200))
    rows = [(50, base), (60, base), (60, base), (None, base), (70, base[100:149]), (71, base[100:150]), (72, "x" + base[100:151] + "y"), (73, base[80:140] + base[110:300])]
    rows += [(i, base[(a := rng.randrange(900)): a + rng.randint(30, 200)] + word() + base[(b := rng.randrange(900)): b + rng.randint(30, 200)]) for i in range(1, 45)]
    rows += [(80, None), (81, ""), (82, "a" * 49), (83, "a" * 50), (84, "a" * 1000), (85, "ab" * 400), (86, "b" + "ab" * 60), (87, "日本語" * 40), (88, "本語日" * 40)]
    want = brute(rows)
    assert rows_of(sd.query(spark, store(make_docs(rows)))) == want
    monkeypatch.setattr(sd, "SEGMENT", 64)  # in this process only: the functions below run here
    got = list(sd._positions(np.arange(4))(iter(_batches(rows))))
    assert got
    assert sd.query(spark, store(make_docs([]))).count() == 0


def _batches(rows):
    import pyarrow as pa
    return [pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array([sd.LAST if d is None else d for d, _ in rows]), pa.array([t for _, t in rows])], ["row", "doc", "text"])]


def test_segments_change_nothing(monkeypatch):
    """The three task functions chained by hand, with texts cut into many segments."""
    rng = random.Random(8)
    base = "".join(rng.choices("abcd ", k=3000))
    rows = [(1, base), (2, base[500:2500]), (3, "zz" + base[700:900] + "yy" + base[2000:])]
    want = brute(rows)
    for size in (64, 333, 1 << 20):
        monkeypatch.setattr(sd, "SEGMENT", size)
        monkeypatch.setattr(sd, "FLUSH", 100)
        marks = [r for b in sd.rank_seeds(iter(sd._positions(np.arange(4))(iter(_batches(rows))))) for r in b.to_pylist()]
        import pyarrow as pa
        kind = pa.list_(pa.struct([("q", pa.int32()), ("n", pa.int16()), ("x", pa.int16()), ("open", pa.bool_())]))
        per = [[{k: m[k] for k in ("q", "n", "x", "open")} for m in marks if m["row"] == i] for i in range(3)]
        batch = pa.RecordBatch.from_arrays([pa.array(range(3)), pa.array([1, 2, 3]), pa.array([t for _, t in rows]), pa.array(per, kind)], ["row", "doc", "text", "marks"])
        runs = [r for b in sd.rank_pairs(iter(sd._rims(np.arange(4))(iter([batch])))) for r in b.to_pylist()]
        runs_kind = pa.list_(pa.struct([("q", pa.int32()), ("n", pa.int32())]))
        last = pa.RecordBatch.from_arrays([*batch.columns, pa.array([[{"q": r["q"], "n": r["n"]} for r in runs if r["row"] == i] for i in range(3)], runs_kind)],
                                          ["row", "doc", "text", "marks", "runs"])
        got = [r for b in sd._finish(False)(iter([last])) for r in b.to_pylist()]
        assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept"].decode()) for r in got), key=str) == want


def test_kept_text_and_spans(make_docs):
    base = "".join(random.Random(1).choices("abcdefgh ", k=300))
    docs = make_docs([(1, base), (2, "head " + base[50:200] + " tail")])
    by = {r.doc_id: r for r in sd.removed(sd.keyed(docs)).collect()}
    assert by[2].kept == b"head  tail" and [tuple(s) for s in by[2].spans] == [(5, 155)] and by[1].kept == base.encode()


def _hot(n):
    rng = random.Random(5)
    own = lambda k: "".join(rng.choices("abcdefghijklmnop", k=k))
    rows = [(i, own(60) + "0123456789 LICENCE 0123456789" + own(60)) for i in range(n)]
    return rows + [(n + i, rows[i][1][20 + i % 9: 120]) for i in range(0, n, 3)]


def test_a_hot_seed_is_dealt_over_many_buckets():
    """A string with other surroundings in every document: neither its positions nor its rims meet in one bucket."""
    import pyarrow as pa
    rows = _hot(300)
    share = lambda many: max(many.values()) / sum(many.values())
    seeds, rims = {}, {}
    for b in sd._positions(np.arange(64))(iter(_batches(rows))):
        for bucket, blob in zip(*b.to_pydict().values()):
            seeds[bucket] = seeds.get(bucket, 0) + len(sd.unpack(blob)[0]["g"])
    assert share(seeds) < 0.1
    kind = pa.list_(pa.struct([("q", pa.int32()), ("n", pa.int16()), ("x", pa.int16()), ("open", pa.bool_())]))
    at = [[{"q": 40, "n": 20, "x": 20, "open": True}] for _ in rows[:300]]
    batch = pa.RecordBatch.from_arrays([*_batches(rows[:300])[0].columns, pa.array(at, kind)], ["row", "doc", "text", "marks"])
    for b in sd._rims(np.arange(64))(iter([batch])):
        for bucket, blob in zip(*b.to_pydict().values()):
            rims[bucket] = rims.get(bucket, 0) + len(sd.unpack(blob)[0]["g"])
    assert share(rims) < 0.1


def test_a_hot_seed_changes_no_result(make_docs, spark, store, monkeypatch):
    rows = _hot(300)
    monkeypatch.setattr(sd, "PART_BYTES", 10_000)
    monkeypatch.setattr(sd, "PART_STRINGS", 10_000)
    assert rows_of(sd.query(spark, store(make_docs(rows)))) == brute(rows)


def test_every_bucket_has_a_partition_of_its_own(spark):
    for parts in (1, 7, 50):
        labels = sd.even_labels(spark, parts)
        rows = spark.createDataFrame([(int(x),) for x in labels], "bucket int")
        got = rows.repartition(parts, "bucket").groupBy(sd.F.spark_partition_id()).count().collect()
        assert len(labels) == parts == len(got) and all(r["count"] == 1 for r in got)
