import hashlib
import re

import pytest

from plenum.llm import exact_blocks as eb


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    out = []
    for (d, _), n in zip(rows, norm):
        same = [(-len(t or ""), e, i) for i, ((e, t), m) in enumerate(zip(rows, norm)) if m == n]
        out.append((d, min(same)[1], len(same), hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("size", [3, 16, 4096])
def test_groups_match_brute_force(make_docs, size):
    long = "abc defgé " * 300
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "ab"), (6, "a  b"), (7, long), (8, long.replace(" ", "")), (9, long + "x"),
            (10, " ab"), (11, "ab" * 5), (12, "ab" * 6), (13, "ba" * 6), (14, "ab" * 9)]
    got = eb.groups(eb.keyed(make_docs(rows)), size).select("doc_id", "keep_id", "group_size", "text_sha256").collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_repeated_rows_keep_one(make_docs):
    docs = make_docs([(1, "x"), (1, "x"), (None, "x"), (2, "y")])
    got = eb.groups(eb.keyed(docs)).where("kept").select("doc_id").collect()
    assert sorted(r[0] is not None and r[0] or 0 for r in got) == [0, 2]
    left = eb.drop_copies(docs)
    assert left.columns == docs.columns and left.count() == 2


def test_shared_fingerprints_are_told_apart(spark):
    rows = [(0, 0, 5, b"aa"), (1, 0, 5, b"bb"), (2, 0, 5, b"aa"), (3, 0, 6, b"cc")]
    blocks = spark.createDataFrame(rows, "row long, idx int, print long, block binary")
    names = {r.row: r.name for r in eb.name_blocks(blocks).withColumnRenamed("name", "nm").selectExpr("row", "nm as name").collect()}
    assert names[0] == names[2] and len(set(names.values())) == 3


def test_empty_table(make_docs):
    assert eb.groups(eb.keyed(make_docs([]))).count() == 0
    assert eb.drop_copies(make_docs([])).count() == 0
