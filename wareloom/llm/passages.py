"""Substring deduplication by relative Lempel-Ziv parsing.

A window is ``width`` consecutive words of one document. Words covered by a window that also starts earlier (smaller doc_id,
or same document and earlier start) are removed.

The reference is cut into blocks by content: each window picks the ``GRAM``-word gram with the least hash, and the
windows that pick one gram form a block, some 26 words long. Equal text gives equal blocks wherever it stands. All
blocks of all documents are indexed by (gram, content). A document is parsed greedily against that index: it is
already a sequence of blocks, and each block that the index holds earlier extends the factor before it. Factors end
where the next block is new. There, at factor boundaries, single windows may still be repeated; they all share their gram
with a different block, so exactly the windows of grams with more than one content are looked up one by one.

Spark deals blocks by gram, and those of a gram with very many contents (``SPLIT``; a first pass over the texts counts
them) by gram and content: such a gram is known to have several contents, so its blocks need not meet. Single windows
are dealt by their own hash, as only equal ones must meet. Each task first settles the repetitions among the documents it has read and sends on
only the earliest of equal blocks; the others are known by then and are dealt by document. So a passage found in a third of all documents costs
its group one block a batch, however many copies there are. Contents are compared by 64-bit hashes within one gram only (itself 64 bits).

Edge cases: words are ``[^\\x20\\x09-\\x0D]+``; a null text has none; texts under ``width`` words keep all; rows equal
in doc_id and text are treated alike, and rows with equal doc_id and start count as equally early; a null doc_id is the
smallest; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, col, partitions, ship, written
from .words import Rolled, Words, batches, scramble

WIDTH = 20
GRAM = 8
#: Text that one group of grams stands for, about: bounds the memory of a grouped task.
GROUP_BYTES = 24 << 20
#: Blocks of one task that are settled and packed together.
PACK = 2_000_000
#: A gram of so many contents is dealt by content. Counted are those of each pack with OFTEN contents or more, so a gram that
#: stays whole has less than SPLIT + OFTEN * packs.
SPLIT, OFTEN = 1 << 14, 8
#: Windows of one group in the second pass, about.
GROUP_WINDOWS = 1 << 20


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Least of each n neighbours, by doubling."""
    size, m = 1, x
    while size * 2 <= n:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return m if size == n else np.minimum(m[: len(x) - n + 1], m[n - size :])


def blocks(words: Words, rolled: Rolled, width: int) -> tuple[np.ndarray, ...]:
    """(text, first word, end word, gram, content) of each block; places count from the batch's first word."""
    n, none = len(words.hash), np.zeros(0, np.int64)
    gram = min(GRAM, width)
    if n < width:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    i = np.arange(n - gram + 1)
    g = rolled.hash(i, i + gram)
    span = width - gram + 1
    least = sliding_min(g, span)
    at = np.full(len(least), span - 1)
    for r in range(span - 2, -1, -1):  # leftmost
        at[g[r : r + len(least)] == least] = r
    s = np.flatnonzero(words.text[: n - width + 1] == words.text[width - 1 :])
    if not len(s):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    p = s + at[s]
    first = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
    last = np.append(first[1:], len(s)) - 1
    a, e, p = s[first], s[last] + width, p[first]
    content = rolled.hash(a, e) + (p - a).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
    return words.text[a], a, e, g[p], scramble(content)


def later(h, u, did, a) -> tuple[np.ndarray, np.ndarray]:
    """(order by key and place, whether an equal key stands strictly earlier), in that order."""
    order = np.lexsort((a, did, u, h))
    h, u, did, a = h[order], u[order], did[order], a[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (u[1:] != u[:-1])
    lead = np.flatnonzero(new)[np.cumsum(new) - 1] if len(h) else np.zeros(0, np.int64)
    return order, (did != did[lead]) | (a != a[lead])


def dealt(h: np.ndarray, u: np.ndarray, groups: int, hot: np.ndarray | None) -> np.ndarray:
    """Group of each block: by gram, those of hot grams (or all, without hot) by gram and content."""
    own = scramble(h * np.uint64(3) + u)
    return ((own if hot is None else np.where(np.isin(h, hot), own, h)) % np.uint64(groups)).astype(np.int64)


def contents(h: np.ndarray, u: np.ndarray) -> pd.DataFrame:
    """(h, n): grams of a pack with OFTEN contents or more."""
    order = np.lexsort((u, h))
    h, u = h[order], u[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (u[1:] != u[:-1])
    gram, n = np.unique(h[new], return_counts=True)
    return pd.DataFrame({"h": gram[n >= OFTEN].view(np.int64), "n": n[n >= OFTEN]})


def packed(did, th, doc, a, e, h, u, groups: int, hot: np.ndarray | None) -> pd.DataFrame:
    """(pid, payload): repetitions within the batch are settled, the rest is packed by group."""
    order, dup = later(h, u, did[doc], a)
    doc, a, e, h, u = doc[order], a[order], e[order], h[order], u[order]
    # A span that stands earlier is settled: it only has to be handed on, and is dealt by its document.
    pid = np.where(dup, (scramble(th[doc].view(np.uint64)) % np.uint64(groups)).astype(np.int64), dealt(h, u, groups, hot))
    order = np.lexsort((dup, pid))
    doc, a, e, h, u, pid, dup = (x[order] for x in (doc, a, e, h, u, pid, dup))
    edges = np.flatnonzero(np.concatenate(([True], pid[1:] != pid[:-1]))) if len(pid) else []
    rows = []
    for i, j in zip(edges, [*edges[1:], len(pid)]):
        used, local = np.unique(doc[i:j], return_inverse=True)
        fresh = int((~dup[i:j]).sum())
        rows.append((int(pid[i]), b"".join((
            np.array([len(used), fresh, j - i - fresh], np.int64).tobytes(), did[used].tobytes(), th[used].tobytes(),
            local.astype(np.uint32).tobytes(), a[i:j].astype(np.uint32).tobytes(), (e[i:j] - a[i:j]).astype(np.uint16).tobytes(),
            h[i : i + fresh].tobytes(), u[i : i + fresh].tobytes()))))
    return pd.DataFrame(rows, columns=["pid", "payload"])


def gathered(parts, pack):
    """Batches' blocks, packed some PACK at a time."""
    held, docs, size = [], 0, 0
    for did, th, doc, a, e, h, u in parts:
        if size and size + len(a) > PACK:
            yield pack(*map(np.concatenate, zip(*held)))
            held, docs, size = [], 0, 0
        held.append((did, th, doc + docs, a, e, h, u))
        docs += len(did)
        size += len(a)
    if held:
        yield pack(*map(np.concatenate, zip(*held)))


def unpacked(payload: bytes):
    n_docs, fresh, known = np.frombuffer(payload, np.int64, 3)
    n, at = fresh + known, 24

    def take(kind, count):
        nonlocal at
        out = np.frombuffer(payload, kind, count, at)
        at += out.nbytes
        return out

    did, th = take(np.int64, n_docs), take(np.int64, n_docs)
    doc, a, size = take(np.uint32, n), take(np.uint32, n), take(np.uint16, n)
    return did[doc], th[doc], a.astype(np.int64), a.astype(np.int64) + size, take(np.uint64, fresh), take(np.uint64, fresh)


SPANS = "did long, th long, a int, e int, h long"


def settle(frame: pd.DataFrame, hot: np.ndarray | None = None) -> pd.DataFrame:
    """Spans that stand earlier elsewhere (h null), and the earliest blocks of grams with several contents.

    Hot grams have several. Without hot (single windows) the earliest are not listed.
    """
    parts = [unpacked(p) for p in frame["payload"]]
    fresh = [(d[: len(h)], t[: len(h)], a[: len(h)], e[: len(h)], h, u) for d, t, a, e, h, u in parts]
    known = [(d[len(h) :], t[len(h) :], a[len(h) :], e[len(h) :]) for d, t, a, e, h, u in parts]
    did, th, a, e, h, u = (np.concatenate(x) for x in zip(*fresh))
    order, dup = later(h, u, did, a)
    did, th, a, e, h, u = (x[order] for x in (did, th, a, e, h, u))
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    gram = np.cumsum(new) - 1
    same = np.zeros(int(gram[-1]) + 1 if len(gram) else 0, np.int64)  # contents of each gram
    content = np.ones(len(h), bool)
    content[1:] = new[1:] | (u[1:] != u[:-1])
    np.add.at(same, gram[content], 1)
    edge = ~dup & ((same[gram] > 1) | np.isin(h, hot)) if hot is not None else np.zeros(len(h), bool)
    columns = [np.concatenate([x[dup], *[k[i] for k in known], x[edge]]) for i, x in enumerate((did, th, a, e))]
    plain = len(columns[0]) - int(edge.sum())
    out = pd.DataFrame({"did": columns[0], "th": columns[1], "a": columns[2].astype(np.int32), "e": columns[3].astype(np.int32)})
    out["h"] = pd.array(np.concatenate([np.zeros(plain, np.int64), h[edge].view(np.int64)]), "Int64")
    out.loc[: plain - 1, "h"] = pd.NA
    return out


def _texts(frame: pd.DataFrame):
    """Batches of (ids, text hashes, words, rolled hashes) and the frame's rows they stand for."""
    encoded = [t.encode() for t in frame["text"]]
    did, th = frame["did"].to_numpy(), frame["th"].to_numpy()
    at = 0
    for group in batches(encoded):
        rows = slice(at, at + len(group))
        at += len(group)
        words = Words(group)
        yield did[rows], th[rows], words, Rolled(words.hash), rows


def spans(docs: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): texts has did, th, text; spans has did, th, a, e: words [a, e) of a document to remove."""
    spark = docs.sparkSession
    ship(spark)
    if not GRAM <= width <= 2**15:
        raise ValueError("width out of range")
    text = F.coalesce(col("text"), F.lit(""))
    texts = docs.select(F.coalesce(col("doc_id").cast("long"), F.lit(NULL_ID)).alias("did"), F.xxhash64(text).alias("th"), text.alias("text"))
    size = docs.agg(F.sum(F.octet_length(col("text")).cast("long"))).first()[0] or 0
    groups = max(4 * partitions(spark), -(-size // GROUP_BYTES))

    def parsed(frames):
        for frame in frames:
            frame = frame.drop_duplicates(["did", "th"])
            for did, th, words, rolled, _ in _texts(frame):
                doc, a, e, h, u = blocks(words, rolled, width)
                yield did, th, doc, a - words.first[doc], e - words.first[doc], h, u

    def count(frames):
        with np.errstate(over="ignore"):
            yield from gathered(parsed(frames), lambda did, th, doc, a, e, h, u: contents(h, u))

    often = texts.mapInPandas(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(f"n >= {SPLIT}")
    # Bounded by the number of blocks divided by SPLIT.
    shared = spark.sparkContext.broadcast(np.array([r.h for r in often.select("h").collect()], np.int64).view(np.uint64))

    def parse(frames):
        with np.errstate(over="ignore"):
            yield from gathered(parsed(frames), lambda *x: packed(*x, groups, shared.value))

    def boundaries(frames):
        def parts():
            for frame in frames:
                for did, th, words, rolled, rows in _texts(frame):
                    starts, grams, owner = [], [], []
                    for i, (a, e, h) in enumerate(zip(frame["a"][rows], frame["e"][rows], frame["h"][rows])):
                        n = e - a - width + 1
                        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                        starts.append(np.repeat(a, n) + inner)
                        grams.append(np.repeat(h, n))
                        owner.append(np.full(len(inner), i))
                    a, h, doc = (np.concatenate(x).astype(np.int64) for x in (starts, grams, owner))
                    place = a + words.first[doc]
                    u = rolled.hash(place, place + width)
                    yield did, th, doc, a, a + width, h.view(np.uint64), u

        with np.errstate(over="ignore"):
            yield from gathered(parts(), lambda *x: packed(*x, many, None))

    def first(frame: pd.DataFrame) -> pd.DataFrame:
        return settle(frame, shared.value)

    def second(frame: pd.DataFrame) -> pd.DataFrame:
        return settle(frame)

    payload = "pid int, payload binary"
    found = written(texts.mapInPandas(parse, payload).groupBy("pid").applyInPandas(first, SPANS), "passages")
    windows = found.where("h IS NOT NULL").agg(F.sum(F.expr(f"cast(e - a - {width - 1} AS bigint)"))).first()[0] or 0
    many = max(4 * partitions(spark), -(-windows // GROUP_WINDOWS))
    edges = found.where("h IS NOT NULL").groupBy("did", "th").agg(
        F.collect_list("a").alias("a"), F.collect_list("e").alias("e"), F.collect_list("h").alias("h"))
    again = edges.join(texts, ["did", "th"]).mapInPandas(boundaries, payload).groupBy("pid").applyInPandas(second, SPANS)
    whole = found.where("h IS NULL").drop("h").unionByName(again.where("h IS NULL").drop("h"))
    return texts, whole


def dedup(docs: DataFrame, width: int = WIDTH, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text) of every row."""
    texts, found = spans(docs, width)
    per_doc = found.groupBy("did", "th").agg(F.collect_list("a").alias("a"), F.collect_list("e").alias("e"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")

    def cut(frames):
        for frame in frames:
            rows = []
            for did, text, a, e in zip(frame["did"], frame["text"], frame["a"], frame["e"]):
                words = text.encode().split()  # at ASCII white space
                n = removed = len(words)
                if a is not None and len(a):
                    depth = np.zeros(n + 1, np.int64)
                    np.add.at(depth, a, 1)
                    np.add.at(depth, e, -1)
                    keep = np.cumsum(depth[:-1]) == 0
                    words = list(compress(words, keep.tolist()))
                kept = b" ".join(words)
                rows.append((None if did == NULL_ID else did, n, removed - len(words), hashlib.sha256(kept).hexdigest(), kept.decode())[: 5 if with_text else 4])
            out = pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: 5 if with_text else 4])
            yield out.assign(doc_id=out["doc_id"].astype("Int64"))

    return texts.join(per_doc, ["did", "th"], "left").mapInPandas(cut, schema)
