from collections import Counter

import zlib

import pytest

from wareloom.llm import sharding

SCHEMA = "doc_id long, text string, row string, total int"
DOCS = [(i, f"text {i % 7}" * (i % 5), "x", 1) for i in range(257)] + [
    (None, "no id", "x", 1), (3, None, None, None), (3, None, None, None), (9, "", "y", 2), (9, "é" * 3000, "y", 2)]


def result(spark, rows, **more):
    return sharding.shard(spark.createDataFrame(rows, SCHEMA), **more).collect()


@pytest.mark.parametrize("shards", [1, 2, 16, 300])
def test_law_of_rows(spark, shards):
    got = result(spark, DOCS, shards=shards)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((d, len((t or "").encode()) + 1) for d, t, *_ in DOCS)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    sizes = [len(by.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())


def test_checksums_and_position_of(spark):
    got = result(spark, DOCS)
    text = {(d, len((t or "").encode()) + 1): zlib.crc32((t or "").encode()) for d, t, *_ in DOCS}
    assert all(r.text_crc32 == text[r.doc_id, r.size] for r in got)
    key = lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])
    want = sorted(((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in DOCS), key=key)
    where = [sharding.position_of(i, len(want)) for i in range(len(want))]
    assert Counter((*w, p % 16, p // 16) for w, p in zip(want, where)) == Counter(
        (r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got)


def test_same_for_any_partitioning(spark):
    rows = spark.createDataFrame(DOCS, SCHEMA)
    a = sharding.shard(rows.repartition(1)).collect()
    b = sharding.shard(rows.repartition(9)).collect()
    assert Counter(a) == Counter(b)


def test_rows_equal_in_all_columns(spark):
    got = result(spark, [(5, "same", "x", 1)] * 3000)
    assert sorted(r.slot * 16 + r.shard for r in got) == list(range(3000))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 1000, 4097])
def test_permutation(n):
    assert sorted(sharding.position_of(i, n) for i in range(n)) == list(range(n))


def test_empty(spark):
    assert result(spark, []) == []
