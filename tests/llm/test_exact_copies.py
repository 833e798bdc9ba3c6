import hashlib
from collections import Counter

from pyspark.sql import functions as F

from wareloom.llm import exact_copies

SCHEMA = "doc_id long, text string, digest string, sha string"
DOCS = [(i, f"t{i % 40}" if i % 3 else f"alone {i}", "d", "s") for i in range(200)] + [
    (500, None, None, None), (501, "", "d", "s"), (None, "t1", "d", "s"), (None, "only here", "d", "s"),
    (7, "t7", "d", "s"), (199, "t39", "other", "s"), (600, "long " * 40_000, "d", "s"), (601, "long " * 40_000, "d", "s")]


def expected(rows):
    groups = {}
    for d, t, *_ in rows:
        groups.setdefault(t or "", []).append(d)
    out, first = Counter(), set()
    for d, t, *_ in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if ids else None
        kept = d == keep and (t or "", d) not in first
        first |= {(t or "", d)} if kept else set()
        out[d, keep, len(groups[t or ""]), kept, hashlib.sha256((t or "").encode()).hexdigest()] += 1
    return out


def got(df):
    return Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect())


def test_against_brute_force(spark):
    assert got(exact_copies.dedup(spark.createDataFrame(DOCS, SCHEMA))) == expected(DOCS)


def test_hits_across_micro_batches(spark, tmp_path):
    spark.createDataFrame(DOCS, SCHEMA).repartition(5).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    assert got(exact_copies.dedup(docs, files_per_trigger=1)) == expected(DOCS)


def test_shared_digests_are_told_apart_by_bytes(spark):
    weak = lambda text: F.substring(F.unhex(F.sha2(text, 256)), 1, 1)  # noqa: E731  256 values for 240 texts
    assert got(exact_copies.dedup(spark.createDataFrame(DOCS, SCHEMA), digest=weak)) == expected(DOCS)


def test_keep_last_keeps_columns(spark):
    rows = exact_copies.keep_last(spark.createDataFrame(DOCS, SCHEMA)).collect()
    assert rows[0].asDict().keys() == {"doc_id", "text", "digest", "sha"}
    want = sorted((d, t) for d, _, _, kept, t in expected(DOCS) if kept and d is not None)
    have = sorted((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in rows if r.doc_id is not None)
    assert have == want and sum(r.doc_id is None for r in rows) == 1


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_copies.dedup(empty).collect() == [] and exact_copies.keep_last(empty).collect() == []
