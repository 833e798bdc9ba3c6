"""Exact deduplication by a stateful stream.

A structured stream reads the rows' digests and keeps, per digest and for ever, the number of rows, the stable
identifier of the row that stays (the largest doc_id) and where its content is found (its file). The keyed state is
disk-backed (RocksDB), checkpointed in the shared folder and read back as a table. Digests are only a first
sieve: on hits the full bytes are compared, and texts that share a digest but differ are told apart by their bytes.

Edge cases: a null text is empty; a null doc_id is lower than every other; of rows that share doc_id and text
one is kept; an empty table gives no rows. Other columns are carried by ``keep_last`` only.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import dealt_join
from .common import col, scratch, text_or_empty, wrapped, written

#: Rows of one (digest, doc_id) are expanded in runs of this length.
RUN = 4096
#: Many small stores: no preallocated files, as the setting's own description advises; a store's memory is given
#: back with its commit, the state itself is on disk.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def streamed_state(slim: DataFrame, path: str, files_per_trigger: int) -> DataFrame:
    """digest, n, keep_id, locator: the keyed state after the whole of the table at path went through the stream."""
    spark = slim.sparkSession
    place = scratch(spark, "copies-state")
    with _settings(spark, STATE_SETTINGS):
        stream = (
            spark.readStream.schema(slim.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
            .groupBy("digest").agg(F.sum("c").alias("n"), F.max(F.struct("doc_id", "file")).alias("last"))
        )
        query = (
            stream.writeStream.outputMode("update").format("noop").option("checkpointLocation", place)
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
        state = spark.read.format("statestore").load(place)
    names = state.schema["value"].dataType.fieldNames()
    return state.select(
        F.col("key.digest").alias("digest"), F.col(f"value.{names[0]}").alias("n"),
        F.col(f"value.{names[1]}.doc_id").alias("keep_id"), F.col(f"value.{names[1]}.file").alias("locator"))


def classes(docs: DataFrame, digest=sha256, files_per_trigger: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): rows has digest, text_sha256, doc_id, c; groups has digest, text_sha256, n, keep_id.

    text_sha256 belongs to the key, so that texts which merely share a digest stay apart.
    """
    spark = docs.sparkSession
    text = text_or_empty()
    base = docs.select(col("doc_id").alias("doc_id"), text.alias("text"), F.input_file_name().alias("file"))
    keyed = base.withColumn("digest", digest(F.col("text")))
    # Copies within one file are counted before the state sees them: a key has one row a file at most.
    slim = keyed.groupBy("digest", F.sha2("text", 256).alias("text_sha256"), "doc_id", "file").agg(F.count("*").alias("c"))
    path = scratch(spark, "copies-rows")
    slim.write.parquet(path)
    rows = spark.read.schema(slim.schema).parquet(path)
    if rows.isEmpty():
        return rows, rows.groupBy("digest", "text_sha256").agg(F.sum("c").alias("n"), F.max("doc_id").alias("keep_id"))
    state = written(streamed_state(slim, path, files_per_trigger), "copies-groups")
    # Full bytes on hits: the least and the greatest text of a digest agree only if all do. Partial results
    # are combined before the shuffle, so that a large group of copies costs a row a task.
    seen = keyed.groupBy("digest").agg(F.min("text").alias("low"), F.max("text").alias("high"), F.count("*").alias("n"))
    clash = written(seen.where("n > 1 AND low <> high").select("digest"), "copies-clashes")
    names = rows.groupBy("digest").agg(F.max("text_sha256").alias("text_sha256"))
    groups = state.join(clash, "digest", "left_anti").join(names, "digest").select("digest", "text_sha256", "n", "keep_id")
    if not clash.isEmpty():
        # Texts behind one digest are grouped by the bytes themselves.
        apart = keyed.join(clash, "digest", "left_semi").groupBy("digest", "text").agg(
            F.count("*").alias("n"), F.max("doc_id").alias("keep_id"))
        groups = groups.unionByName(apart.select("digest", F.sha2("text", 256).alias("text_sha256"), "n", "keep_id"))
    return rows, groups


def dedup(docs: DataFrame, digest=sha256, files_per_trigger: int = 1000) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    rows, groups = classes(docs, digest, files_per_trigger)
    per_id = rows.groupBy("digest", "text_sha256", "doc_id").agg(F.sum("c").alias("c"))
    own = per_id.groupBy("digest", "text_sha256").agg(F.count("*").alias("_ids"))
    lookup = groups.join(own, ["digest", "text_sha256"]).select(
        F.col("digest").alias("_digest"), F.col("text_sha256").alias("_sha"), "n", "keep_id", "_ids")
    # A text that a large share of the rows hold is dealt over many tasks.
    named = dealt_join(per_id, lookup, [("digest", "_digest"), ("text_sha256", "_sha")], "_ids", F.xxhash64("doc_id"))
    runs = named.withColumn("run", F.expr(f"explode(sequence(0L, (c - 1) div {RUN}))"))
    each = runs.withColumn("i", F.expr(f"explode(sequence(run * {RUN}, least(c, (run + 1) * {RUN}) - 1))"))
    return each.select(
        "doc_id", "keep_id", F.col("n").alias("group_size"),
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("i") == 0)).alias("kept"), "text_sha256")


def keep_last(docs: DataFrame) -> DataFrame:
    """The documents without copies, all columns: of equal texts the row with the largest doc_id."""
    _, groups = classes(docs)
    stay = groups.select(F.col("text_sha256").alias("_sha"), F.col("keep_id").alias("_id"))
    tagged = wrapped(docs, sha=F.sha2(text_or_empty(), 256), doc_id=col("doc_id"))
    held = tagged.join(stay, (tagged["sha"] == stay["_sha"]) & tagged["doc_id"].eqNullSafe(stay["_id"]), "left_semi")
    return held.dropDuplicates(["sha", "doc_id"]).select("row.*")
