"""Near-duplicate classes by order MinHash.

A text's k-mers are its runs of ``K`` words, labelled by occurrence (the second time a run appears it counts as another). A
sketch holds the ``TAKE`` labelled k-mers with the least hashes, kept in text order, so it agrees for texts that share
k-mers in the same order; ``SKETCHES`` sketches make a text's buckets. Candidates are verified by aligning the labelled
k-mers within a band: with M k-mers on the longest common chain, similarity is M / (n1 + n2 - M), and two texts
are linked from ``THRESHOLD`` on. Whatever lies outside the band would push the similarity below the threshold.

Equal texts are one node. A bucket's members are first compared with its pivot, the member that meets most others;
components of the links so far are formed; then, in buckets that still hold several components, each member outside
the largest is compared with the members of other components, but for pairs whose rare k-mers prove that the
similarity stays below the threshold (see ``remaining``). So no pair of a bucket is left out unless it is in one class already or
cannot be linked, and no large class is expanded into pairs. Two texts with similarity 0.8 meet in a bucket for sure if neither has more than
``SHORT`` k-mers: such a text also has a bucket for each set of k-mers that a linked text may share with it. Longer ones meet with probability
above 1 - 3e-5 (24 sketches, each alike with some 0.8 ** 4, less for few k-mers as they are drawn without putting back).

Result: a row a document with class_id, the least doc_id of its class, class_size and kept (one document of each class: the
least doc_id). Edge cases: words are ``[^\\x20\\x09-\\x0D]+``; a text under K words has one k-mer, all its words; null and
empty texts are equal and link to nothing else; a null doc_id is never a class_id unless all of the class are null; of rows
that share doc_id and text one is kept; an empty table gives no rows; other columns are carried by ``keep_one`` only.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import dealt_join
from .common import col, ship, trim, wrapped, written
from .components import components
from .words import Rolled, Words, batches, scramble

K = 5
THRESHOLD = 0.8
SKETCHES = 24
TAKE = 4
#: Texts of so many k-mers also have a bucket for each common chain that a link allows.
SHORT = 12
#: A k-mer of more texts than this is not rare.
RARE = 100
MULTIPLIERS = scramble(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def labelled(grams: np.ndarray) -> np.ndarray:
    """k-mers made distinct by the number of equal ones before them."""
    order = np.argsort(grams, kind="stable")
    g = grams[order]
    new = np.ones(len(g), bool)
    new[1:] = g[1:] != g[:-1]
    start = np.flatnonzero(new)
    nth = np.arange(len(g)) - start[np.cumsum(new) - 1]
    out = np.empty_like(grams)
    out[order] = scramble(g + nth.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    return out


def kmers(texts: list[bytes]) -> list[np.ndarray]:
    """The labelled k-mers of each text, in order."""
    out = []
    with np.errstate(over="ignore"):
        for group in batches(texts):
            words = Words(group)
            rolled = Rolled(words.hash)
            for first, last in zip(words.first, words.last):
                if first == last:
                    out.append(np.zeros(0, np.uint64))
                    continue
                start = np.arange(first, max(last - K + 1, first + 1))
                out.append(labelled(rolled.hash(start, np.minimum(start + K, last))))
    return out


def sketches(labels: np.ndarray) -> np.ndarray:
    """SKETCHES hashes of the TAKE least labelled k-mers in text order; empty without k-mers."""
    n = len(labels)
    if not n:
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        hashed = MULTIPLIERS[:, None] * labels[None, :]
        if n > TAKE:
            at = np.sort(np.argpartition(hashed, TAKE - 1, axis=1)[:, :TAKE], axis=1)
        else:
            at = np.broadcast_to(np.arange(n), (SKETCHES, n))
        out = np.arange(1, SKETCHES + 1, dtype=np.uint64)
        for j in range(at.shape[1]):
            out = scramble(out * np.uint64(0x9FB21C651E98DF25) + labels[at[:, j]])
    return out.view(np.int64)


def chains(labels: np.ndarray) -> list[int]:
    """Hashes of what a linked text may share with a short one: all its k-mers but r, in order, where THRESHOLD allows r to be missing."""
    n, out = len(labels), []
    if not 0 < n <= SHORT:
        return out
    for r in range(n):
        if (n - r) / n < THRESHOLD:
            break
        keep = np.array(list(combinations(range(n), n - r)), np.int64).reshape(-1, n - r)
        h = np.full(len(keep), n - r, np.uint64)
        for j in range(n - r):
            h = scramble(h * np.uint64(0x9FB21C651E98DF25) + labels[keep[:, j]])
        out += h.view(np.int64).tolist()
    return out


def buckets(labels: np.ndarray) -> np.ndarray:
    """Keys of the buckets: the sketches by place, then a short text's chains."""
    with np.errstate(over="ignore"):
        return np.concatenate([sketches(labels), np.array(chains(labels), np.int64)])


def similarity(x: np.ndarray, y: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Alignment similarity of two sequences of distinct labels, exact from the threshold on, else some value below it."""
    n = len(x) + len(y)
    if not len(x) or not len(y):
        return 0.0
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if len(i) / (n - len(i)) < threshold:  # the chain has at most the common labels
        return len(i) / (n - len(i)) if len(i) else 0.0
    band = int(n * (1 - threshold) / (1 + threshold)) + 1
    near = np.abs(i - j) <= band
    i, j = i[near], j[near]
    j = j[np.argsort(i)]
    if len(j) and (np.diff(j) > 0).all():
        m = len(j)
    else:  # longest increasing run of places, by patience sorting
        tails: list[int] = []
        for v in j.tolist():
            at = bisect_left(tails, v)
            if at == len(tails):
                tails.append(v)
            else:
                tails[at] = v
        m = len(tails)
    return m / (n - m)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked; the texts of both ends are joined in."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("a_text"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("b_text"))

    def check(frames):
        @lru_cache(8)
        def of(text: str) -> np.ndarray:
            return kmers([text.encode()])[0]

        for f in frames:
            ok = np.array([similarity(of(a), of(b)) >= THRESHOLD for a, b in zip(f["a_text"], f["b_text"])], bool)
            yield f.loc[ok, ["a", "b"]]
        of.cache_clear()
        trim()

    return pairs.join(left, "a").join(right, "b").select("a", "b", "a_text", "b_text").mapInPandas(check, "a binary, b binary")


def kmer_rows(texts: DataFrame) -> DataFrame:
    """node, kmer: a row a labelled k-mer of each text."""

    def explode(frames):
        for f in frames:
            for i in range(0, len(f), 256):
                found = kmers([t.encode() for t in f["text"][i : i + 256]])
                sizes = [len(x) for x in found]
                yield pd.DataFrame({"node": f["node"][i : i + 256].repeat(sizes).to_numpy(),
                                    "kmer": np.concatenate(found).view(np.int64)})
        trim()

    return texts.select("node", "text").mapInPandas(explode, "node binary, kmer long")


def remaining(open_: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that may be linked, in buckets that still hold several components.

    A k-mer of few texts (RARE at most) is rare. Two texts share at most as many k-mers as the smaller number of
    not rare ones, plus the rare ones they share. So a pair without shared rare k-mers is ruled out by two numbers, before any
    pair is formed where a bucket has no text of a fitting size; and pairs with shared rare k-mers are found through
    these, RARE texts each at most.
    """
    label = open_.select("node", "label").distinct()
    grams = written(kmer_rows(texts.join(label.select("node"), "node")), "near-kmers")
    few = grams.groupBy("kmer").agg(F.count("*").alias("df")).where(f"df <= {RARE}")
    rare = written(grams.join(few, "kmer"), "near-rare")
    size = grams.groupBy("node").agg(F.count("*").alias("n")).join(
        rare.groupBy("node").agg(F.count("*").alias("rare")), "node", "left").fillna(0, ["rare"]).join(label, "node")
    size = written(size, "near-sizes")

    # Without a shared rare k-mer: bucket by bucket, each member outside the largest component against the others.
    live = open_.join(size.select("node", "n", "rare"), "node")
    least = live.groupBy("band", "key").agg(F.min("n").alias("least"))
    live = live.join(least, ["band", "key"]).where(f"(n - rare) / {THRESHOLD}D - rare >= least - 1e-6")
    minor = live.where("label <> largest").select(
        "band", "key", F.col("node").alias("x"), F.col("label").alias("x_label"), F.col("n").alias("x_n"), F.col("rare").alias("x_rare"))
    most = "least(n - rare, x_n - x_rare)"
    pairs = minor.join(live, ["band", "key"]).where("x_label <> label").where(
        f"{most} >= {THRESHOLD}D * (n + x_n - {most}) - 1e-6").select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b"))

    # With shared rare k-mers.
    held = rare.where("df > 1").select("node", "kmer").join(label, "node")
    other = held.select("kmer", F.col("node").alias("x"), F.col("label").alias("x_label"))
    both = held.join(other, "kmer").where("node < x AND label <> x_label").groupBy(
        F.col("node").alias("a"), F.col("x").alias("b")).agg(F.count("*").alias("shared"))
    end = lambda c: size.select(F.col("node").alias(c), F.col("n").alias(f"{c}_n"), F.col("rare").alias(f"{c}_rare"))
    most = "(least(a_n - a_rare, b_n - b_rare) + shared)"
    near = both.join(end("a"), "a").join(end("b"), "b").where(f"{most} >= {THRESHOLD}D * (a_n + b_n - {most}) - 1e-6")
    return pairs.unionByName(near.select("a", "b")).distinct()


def node(text):
    return F.unhex(F.md5(text))


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows has node and doc_id of every row; classes has node, label, for nodes that are linked."""
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce(col("text"), F.lit(""))
    keyed = docs.select(col("doc_id").alias("doc_id"), node(text.cast("binary")).alias("node"), text.alias("text"))

    def sketch(frames):
        for f in frames:
            found = [buckets(x) for x in kmers([t.encode() for t in f["text"]])]
            yield pd.DataFrame({"doc_id": f["doc_id"].astype("Int64"), "node": f["node"], "keys": found})
            del found
        trim()

    rows = written(keyed.mapInPandas(sketch, "doc_id long, node binary, keys array<long>"), "near-rows")
    # Equal texts are one node before anything is expanded.
    nodes = rows.groupBy("node").agg(F.first("keys").alias("keys"))
    member = nodes.select("node", F.posexplode("keys").alias("band", "key")).withColumn("band", F.least("band", F.lit(SKETCHES)))
    shared = member.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    member = written(member.join(shared, ["band", "key"]), "near-buckets")
    # The pivot of a bucket is the member that meets most others in all of its buckets: of a family of edited
    # copies that is the text they were made from, which each of them resembles more than they do each other.
    fame = member.groupBy("node").agg(F.sum("n").alias("fame"))
    pivots = member.join(fame, "node").groupBy(F.col("band").alias("_band"), F.col("key").alias("_key")).agg(
        F.max(F.struct("fame", "node")).alias("p"), F.count("*").alias("_size")).select("_band", "_key", F.col("p.node").alias("pivot"), "_size")
    # What a dealt join looks up is written before: it is read three times, and the driver keeps every plan with all its branches.
    pivots = written(pivots, "near-pivots")
    ends = lambda a, b: [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]
    # Buckets, classes and texts with a large share of the rows are dealt over many tasks in each of these joins.
    bucket = [("band", "_band"), ("key", "_key")]
    first = written(dealt_join(member, pivots, bucket, "_size", F.xxhash64("node")).where("node <> pivot").select(*ends("pivot", "node")).distinct(), "near-pairs")
    involved = member.select("node").distinct()
    texts = written(keyed.groupBy("node").agg(F.min("text").alias("text")).join(involved, "node"), "near-texts")
    links = written(verified(first, texts), "near-links")
    labels = written(components(links), "near-labels")

    # Buckets that still hold several components: members outside the largest against the others.
    known = written(member.select("band", "key", "node").join(labels, "node", "left").select(
        "band", "key", "node", F.coalesce("label", "node").alias("label")), "near-known")
    sizes = known.groupBy("band", "key", "label").agg(F.count("*").alias("n"))
    largest = sizes.groupBy(F.col("band").alias("_band"), F.col("key").alias("_key")).agg(
        F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("parts"), F.sum("n").alias("_size")).where(
        "parts > 1").select("_band", "_key", F.col("top.label").alias("largest"), "_size")
    largest = written(largest, "near-largest")
    open_ = written(dealt_join(known, largest, bucket, "_size", F.xxhash64("node")), "near-open")
    rest = remaining(open_, texts)
    rest = rest.join(first, ["a", "b"], "left_anti")
    more = written(verified(rest, texts), "near-links")
    if not more.isEmpty():
        labels = written(components(links.unionByName(more)), "near-labels")
    return rows.select("doc_id", "node"), labels


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, class_size, kept of every row."""
    rows, labels = classes(docs)
    counted = rows.groupBy("node", "doc_id").agg(F.count("*").alias("c"))
    nodes = written(counted.groupBy("node").agg(F.count("*").alias("_ids")).join(labels, "node", "left").select(
        F.col("node").alias("_node"), F.coalesce("label", "node").alias("label"), "_ids"), "near-nodes")
    named = written(dealt_join(counted, nodes, [("node", "_node")], "_ids", F.xxhash64("doc_id")), "near-named")
    sums = written(named.groupBy(F.col("label").alias("_label")).agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("least"), F.sum("c").alias("class_size"),
        F.count("*").alias("_ids")), "near-sums")
    out = dealt_join(named, sums, [("label", "_label")], "_ids", F.xxhash64("doc_id"))
    # Rows equal in doc_id and text: one of them stays; the others are listed too.
    out = out.withColumn("run", F.expr("explode(sequence(0L, (c - 1) div 4096))")).withColumn(
        "i", F.expr("explode(sequence(run * 4096, least(c, (run + 1) * 4096) - 1))"))
    return out.select(
        "doc_id", F.col("least.doc_id").alias("class_id"), "class_size",
        (F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("node") == F.col("least.node")) & (F.col("i") == 0)).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents with one of each class, all columns: the least doc_id stays."""
    rows, labels = classes(docs)
    named = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    stay = named.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("least")).select(
        F.col("least.doc_id").alias("_id"), F.col("least.node").alias("_node"))
    tagged = wrapped(docs, at=node(F.coalesce(col("text"), F.lit("")).cast("binary")), doc_id=col("doc_id"))
    held = tagged.join(stay, (tagged["at"] == stay["_node"]) & tagged["doc_id"].eqNullSafe(stay["_id"]), "left_semi")
    return held.dropDuplicates(["at", "doc_id"]).select("row.*")
