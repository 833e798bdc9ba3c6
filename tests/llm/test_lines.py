"""Line deduplication against a plain version."""

import hashlib
import re

import numpy as np
import pytest

from wareloom.llm import lines
from wareloom.llm.first_seen import later

SCHEMA = "doc_id long, text string, did string, line string"


def plain(rows):
    def key(line):
        return re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate(str.maketrans(lines.UPPER, lines.LOWER))

    rank = lambda i: (i is not None, i or 0)
    least = {}
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            k = key(line)
            if len(k) >= 10:
                least[k] = min(least.get(k, rank(i)), rank(i))
    out = []
    for i, text, *_ in rows:
        own = (text or "").split("\n")
        kept = [x for x in own if len(key(x)) < 10 or least[key(x)] == rank(i)]
        out.append((i, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def cases():
    common = "The common license line of all"
    rows = [(i, "\n".join([f"own line number {i}", common, "short", f"shared by ten {i // 10}", ""]), None, "x") for i in range(200)]
    rows += [(7, common + "\nanother text of the same id", None, None), (7, common + "\nanother text of the same id", "y", None)]
    rows += [(300, None, None, None), (301, "", None, None), (302, "\n\n\n", None, None), (302, "\n\n\n", None, None)]
    rows += [(303, " \t" + common.upper() + " \r\v", None, None), (304, common.replace("e", "é"), None, None)]
    rows += [(305, ("A very long line " * 2000 + "\n") * 30, None, None), (306, "A very long line " * 2000, None, None)]
    rows += [(None, "known to a row without id", None, None), (1, "known to a row without id\nKNOWN TO a row without id", None, None)]
    rows += [(307, "exactly 10\nonly 9 ch\nonce\n" + "exactly 10\n" * 3, None, None), (308, "exactly 10\nonly 9 ch", None, None), (309, "ÀÉÎÕÜàéîõü", None, None), (310, "ÀÉÎÕÜàéîõü ", None, None)]
    return rows


def test_lines_equal_plain(spark):
    rows = cases()
    for some in (rows, rows[::-1], rows[:0], rows[-1:]):
        docs = spark.createDataFrame(some, SCHEMA)
        got = sorted(map(tuple, lines.dedup(docs).collect()), key=str)
        assert got == plain(some)


def test_drop_lines_carries_all_columns(spark):
    rows = cases()
    docs = spark.createDataFrame(rows, SCHEMA)
    got = lines.drop_lines(docs)
    assert got.columns == docs.columns
    want = {r[:1] + (r[3],) for r in plain(rows)}
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    found = got.collect()
    assert len(found) == len(rows) and {(r.doc_id, digest(r.text)) for r in found} == want
    assert [r.text for r in found if r.doc_id == 300] == [None]


def test_bitmaps_hold_the_dropped_lines_only(spark):
    docs = spark.createDataFrame(cases(), SCHEMA)
    found = lines.keep_bitmaps(docs).collect()
    assert found and all(r.n_dropped > 0 for r in found)
    for r in found:
        assert (~lines.unpacked(bytes(r.keep), r.n_lines)).sum() == r.n_dropped
    keep = lines.packed(100_000, np.arange(0, 100_000, 2))
    assert len(keep) < 500 and lines.unpacked(keep, 100_000).sum() == 50_000


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_one_key_over_many_partitions(spark, partitions):
    """A key of nearly all rows, and rows equal in all columns, spread over partitions and are settled exactly."""
    rows = [(1, 1, 5 + i % 50, i % 7) for i in range(3000)] + [(1, 1, 9, 3)] * 2000 + [(k, 0, k, 0) for k in range(-50, 50)] + [(2, 2, 4, 4)] * 500
    df = spark.createDataFrame(rows, "h long, g long, did long, pos long").repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = sorted(map(tuple, later(df, ["h", "g"], "did", "t").collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    least = {}
    for h, g, did, _ in rows:
        least[h, g] = min(least.get((h, g), did), did)
    assert got == sorted(r for r in rows if r[2] > least[r[0], r[1]])
