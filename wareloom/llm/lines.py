"""Line deduplication by range-partitioned line hashes; decisions travel as bitmaps, texts do not.

A document's lines are the parts of its text between line feeds. A line's key is the line without white space at both ends
and with A-Z in lower case. A key of at least ``MIN_LENGTH`` code points that several documents hold keeps its lines in the smallest doc_id
only; there all of them stay. Rows (key hash, document, position) are range-partitioned by hash with a secondary sort by
document and position; the first document of each hash is met first, and whatever follows from another document is dropped
(``first_seen``: a very common line spreads over many partitions). The dropped positions of a document become one compressed bitmap:
bit i of the zlib-packed bits says whether line i stays. Documents that lose nothing have no bitmap.

Keys are compared by 96 bits of two hashes.

Edge cases: a null or empty text is one empty line; a null doc_id is the smallest; rows that share a doc_id count as one document; rows
equal in doc_id and text are treated alike; texts are never cut; an empty table gives no rows; other columns are carried by
``drop_lines`` only, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, col, ship, text_or_empty, trim, wrapped, written
from .first_seen import later

MIN_LENGTH = 10
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def packed(n_lines: int, dropped) -> bytes:
    """The keep bitmap of n_lines lines without those at the dropped positions."""
    keep = np.ones(n_lines, bool)
    keep[dropped] = False
    return zlib.compress(np.packbits(keep).tobytes())


def unpacked(bitmap: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines).astype(bool)


def kept_text(text: str, bitmap: bytes | None) -> tuple[int, int, str]:
    """(number of lines, number dropped, the rest)."""
    if bitmap is None:
        return text.count("\n") + 1, 0, text
    lines = text.split("\n")
    keep = unpacked(bitmap, len(lines))
    return len(lines), len(lines) - int(keep.sum()), "\n".join(compress(lines, keep.tolist()))


def _identified(docs: DataFrame) -> dict[str, Column]:
    """What tells documents apart; rows equal in both lose the same lines."""
    return {"did": F.coalesce(col("doc_id").cast("long"), F.lit(NULL_ID)), "th": F.xxhash64(text_or_empty())}


def keep_bitmaps(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """did, th (doc_id, NULL_ID for a null one, and hash of the text), n_lines, n_dropped, keep; of documents that lose lines."""
    ship(docs.sparkSession)
    lines = docs.select(*[c.alias(n) for n, c in _identified(docs).items()], F.split(text_or_empty(), "\n", -1).alias("lines"))
    keyed = lines.select("did", "th", F.size("lines").cast("long").alias("n"), F.posexplode("lines").alias("pos", "line")).withColumn(
        "key", line_key(F.col("line"))).where(F.length("key") >= min_length)
    slim = keyed.select(F.xxhash64("key").alias("h"), F.hash("key").cast("long").alias("g"), "did", "th", "n", F.col("pos").cast("long").alias("pos"))
    gone = later(slim, ["h", "g"], "did", "line-drops")
    # A document's own lines: bounded by the document.
    per_doc = gone.groupBy("did", "th", "n").agg(F.collect_set("pos").alias("gone"))

    @F.pandas_udf("binary")
    def pack(n: pd.Series, gone: pd.Series) -> pd.Series:
        return pd.Series([packed(int(a), np.asarray(b, np.int64)) for a, b in zip(n, gone)])

    return written(per_doc.select(
        "did", "th", F.col("n").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"), pack("n", "gone").alias("keep")),
        "line-bitmaps")


def dedup(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row."""
    bitmaps = keep_bitmaps(docs, min_length)
    texts = docs.select(col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), *[c.alias(n) for n, c in _identified(docs).items()])

    def digest(frames):
        for f in frames:
            rows = []
            for text, bitmap in zip(f["text"], f["keep"]):
                n, gone, kept = kept_text(text, bitmap)
                rows.append((n, gone, hashlib.sha256(kept.encode()).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_lines", "n_dropped", "kept_sha256"])
            out.insert(0, "doc_id", [None if x == NULL_ID else x for x in f["did"]])
            yield out.assign(doc_id=out["doc_id"].astype("Int64"))
        trim()

    joined = texts.join(bitmaps.select("did", "th", "keep"), ["did", "th"], "left").select("did", "text", "keep")
    return joined.mapInPandas(digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def drop_lines(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """The documents, all columns, with the remaining lines as their texts; a null text stays null."""
    bitmaps = keep_bitmaps(docs, min_length).select(F.col("did").alias("_did"), F.col("th").alias("_th"), F.col("keep").alias("_keep"))

    @F.pandas_udf("string")
    def cut(text: pd.Series, bitmap: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else kept_text(t, b)[2] for t, b in zip(text, bitmap)], dtype=object)

    tagged = wrapped(docs, **_identified(docs))
    joined = tagged.join(bitmaps, (tagged["did"] == F.col("_did")) & (tagged["th"] == F.col("_th")), "left")
    text = F.when(F.col("_keep").isNull(), F.col("row").getField("text")).otherwise(cut(F.col("row").getField("text"), F.col("_keep")))
    fields = [text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    return joined.select(*fields)
