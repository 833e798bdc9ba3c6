"""Dense numbers, running ids and exact samples without a global sort.

All helpers split the work by a bounded number of buckets: rows are numbered
inside a bucket and shifted by the bucket's offset. Only per-bucket totals meet
in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wareloom.functions.draws import div

BLOCK = 1024            # positions per block of a running id
GROUP = 4096            # blocks per group of the two-level prefix sum
FLAT_LIMIT = 65_536     # rows that one window task may hold
TASK_ROWS = 8_000_000   # generated rows per task at most
WIDE_TASK_ROWS = 1_000_000  # the same where a task groups its rows by nearly unique keys
SMALL_TASK_ROWS = 50_000
MOST_TASKS = 16_384     # tasks of rows that only stream through them; beyond it each has more rows
BROADCAST_BLOCKS = 262_144
BUCKET_ROWS = 16_384    # aim of rows per hash bucket
MAX_BUCKETS = 65_536
STEPS = 256             # parts of a ranked table
PER_STEP = 64           # sampled keys a part: sizes vary by an eighth


def tasks_for(spark: SparkSession, n: int, most: int = TASK_ROWS) -> int:
    """Tasks for n generated rows: one per core, fewer for small and more for huge tables.

    Small tables then become one file, and a lost task of a huge one is cheap to repeat.
    """
    few = min(spark.sparkContext.defaultParallelism, (n + SMALL_TASK_ROWS - 1) // SMALL_TASK_ROWS)
    many = (n + most - 1) // most
    return max(1, few, min(many, MOST_TASKS) if most >= TASK_ROWS else many)


def prefix_offsets(totals: DataFrame, key: str, value: str, n_keys: int) -> DataFrame:
    """(key, _offset): the sum of ``value`` over all smaller keys.

    ``totals`` has at most one row per key in [0, n_keys). Above ``FLAT_LIMIT`` keys
    the sum is taken per group of keys and shifted by the groups before, level by
    level, so one task never sees more than ``FLAT_LIMIT`` rows.
    """
    running = F.sum(value).over
    if n_keys <= FLAT_LIMIT:
        w = W.orderBy(key).rowsBetween(W.unboundedPreceding, W.currentRow)
        return totals.select(key, (running(w) - F.col(value)).alias("_offset"))
    group = f"{key}_group"  # a new name on every level
    grouped = totals.withColumn(group, div(F.col(key), GROUP))
    heads = prefix_offsets(
        grouped.groupBy(group).agg(F.sum(value).alias("_head_total")), group, "_head_total", (n_keys + GROUP - 1) // GROUP
    ).withColumnRenamed("_offset", "_head")
    w = W.partitionBy(group).orderBy(key).rowsBetween(W.unboundedPreceding, W.currentRow)
    inner = grouped.withColumn("_inner", running(w) - F.col(value))
    return inner.join(heads, group).select(key, (F.col("_head") + F.col("_inner")).alias("_offset"))


def expand_with_running_id(
    spark: SparkSession, n: int, count_of: Callable[[str], Column], block: int = BLOCK, source: DataFrame | None = None
) -> DataFrame:
    """(position, ordinal, running_id) with ``count_of("position")`` rows per position.

    Running ids are 1, 2, 3, … in order of (position, ordinal). The plan starts from
    one row per block; blocks expand in place, and since the range (or the hash of
    the block) already groups a block in one task, neither the totals nor the running
    sum inside a block shuffle the positions. Only block totals travel. With a
    ``source`` of the positions (a column of that name) these come from its rows; each
    block of them then meets in one task for the running sum.
    """
    n_blocks = (n + block - 1) // block
    tasks = tasks_for(spark, n)

    def positions(blocks: DataFrame) -> DataFrame:
        first = F.col("_block") * F.lit(block)
        last = F.least(first + F.lit(block), F.lit(n)) - F.lit(1)
        return (
            blocks.withColumn("position", F.explode(F.sequence(first, last)))
            .withColumn("_c", count_of("position").cast("bigint"))
            .where(F.col("_c") > 0)
        )

    def blocks() -> DataFrame:
        return spark.range(0, n_blocks, 1, tasks).withColumnRenamed("id", "_block")

    def given(df: DataFrame) -> DataFrame:
        counted = df.withColumn("_block", div(F.col("position"), block)).withColumn("_c", count_of("position").cast("bigint"))
        return counted.where(F.col("_c") > 0)

    totals = (positions(blocks()) if source is None else given(source)).groupBy("_block").agg(F.sum("_c").alias("_total"))
    offsets = prefix_offsets(totals, "_block", "_total", n_blocks)
    if source is not None:
        expanded = given(source).join(F.broadcast(offsets) if n_blocks <= BROADCAST_BLOCKS else offsets, "_block")
    elif n_blocks <= BROADCAST_BLOCKS:  # at most four megabytes
        placed = blocks().join(F.broadcast(offsets), "_block")
    else:
        placed = blocks().join(offsets, "_block").repartition(tasks, "_block")
    w = W.partitionBy("_block").orderBy("position").rowsBetween(W.unboundedPreceding, W.currentRow)
    before = F.col("_offset") + F.sum("_c").over(w) - F.col("_c")
    return (
        (positions(placed) if source is None else expanded)
        .withColumn("_before", before)  # before the expansion, which one select would place below the window
        .select("position", "_before", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_c"))).alias("ordinal"))
        .select("position", "ordinal", (F.col("_before") + F.col("ordinal")).alias("running_id"))
    )


def dense_index(spark: SparkSession, keys: DataFrame, low: int, high: int) -> DataFrame:
    """(key, index) of distinct whole numbers in [low, high]: their place in ascending order, from 1.

    Keys are counted per block of neighbouring values, so any gaps between them cost nothing and no sort spans the table.
    """
    shifted = keys.select((F.col(keys.columns[0]).cast("bigint") - F.lit(low)).alias("position"))
    ranked = expand_with_running_id(spark, high - low + 1, lambda _: F.lit(1), source=shifted)
    return ranked.select((F.col("position") + F.lit(low)).alias("key"), F.col("running_id").alias("index"))


def _bucket_bits(n: int) -> int:
    bits = 0
    while (1 << bits) < MAX_BUCKETS and (n >> bits) > BUCKET_ROWS:
        bits += 1
    return bits


def hash_rank(df: DataFrame, draw: str, ties: list[str], n: int, keep: int | None = None) -> DataFrame:
    """Add ``_rank`` = 1..n in order of (draw, ties), for a draw uniform in [0, 2**52).

    A uniform draw fills the buckets evenly, whatever the data look like. With
    ``keep`` only the ranks up to it are returned, and whole buckets beyond it are
    dropped before the shuffle.
    """
    bits = _bucket_bits(n)
    # A shift is never NULL; a division could be, and the join below would then push a
    # null filter with a copy of the whole draw expression to the scan.
    keyed = df.withColumn("_bucket", F.shiftright(F.col(draw), 52 - bits))
    if bits == 0:
        offsets = None
        ranked = keyed.withColumn("_offset", F.lit(0).cast("bigint"))
    else:
        totals = keyed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_total"))
        offsets = prefix_offsets(totals, "_bucket", "_total", 1 << bits)
        # At most MAX_BUCKETS rows of two bigints: one megabyte, whatever n is.
        ranked = keyed.join(F.broadcast(offsets), "_bucket")
        if keep is not None:
            ranked = ranked.where(F.col("_offset") < F.lit(keep))
    w = W.partitionBy("_bucket").orderBy(draw, *ties)
    ranked = ranked.withColumn("_rank", F.col("_offset") + F.row_number().over(w))
    if keep is not None:
        ranked = ranked.where(F.col("_rank") <= F.lit(keep))
    return ranked.drop("_bucket", "_offset")


def sample_rows(df: DataFrame, draw: str, ties: list[str], k: int, n: int) -> DataFrame:
    """Exactly k of n rows without replacement; ``_rank`` is the sample position."""
    return hash_rank(df, draw, ties, n, keep=k)


def stepped(df: DataFrame, group: list[str], key: str, steps: int = STEPS) -> DataFrame:
    """Add ``_step``: groups with a large share of the rows are cut, in order of ``key``, into steps of about n / steps rows.

    The cuts are every ``PER_STEP``-th of the keys of a sample that holds PER_STEP * steps rows on average, taken by hash of group
    and key, so a step's size follows the rows and not the values. A group that is small beside all rows has no
    cut and is one step. Equal rows share a step: rows that should part need distinct keys.
    """
    n = df.select(F.count(F.lit(1)).alias("n"))
    hashed = F.pmod(F.xxhash64(*[F.col(g) for g in group], F.col(key), F.lit("step")), n.scalar())
    ends = (
        df.where(hashed < F.lit(PER_STEP * steps))
        .groupBy(*[F.col(g).alias(f"_c{i}") for i, g in enumerate(group)])
        .agg(F.sort_array(F.collect_list(key)).alias("_all"))
        .withColumn("_cuts", F.filter("_all", lambda x, i: i % PER_STEP == PER_STEP - 1)).where(F.size("_cuts") > 0).drop("_all")
        # Every sixteenth cut leads to the sixteen at most that are compared one by one.
        .withColumn("_coarse", F.filter("_cuts", lambda x, i: i % 16 == 15))
    )
    # At most ``steps`` cuts on average over all groups together, whatever the number of rows.
    if group:
        joined = df.join(F.broadcast(ends), _same(group, "_c"), "left")
    else:
        joined = df.withColumns({c: ends.select(c).scalar() for c in ("_cuts", "_coarse")})
    below = lambda cuts: F.size(F.filter(cuts, lambda x: x < F.col(key)))
    near = F.col("_near") * F.lit(16)
    return (
        joined.withColumn("_near", F.when(F.col("_cuts").isNotNull(), below(F.col("_coarse"))))
        .withColumn("_step", F.when(
            F.col("_near").isNotNull(), near + below(F.slice("_cuts", near + F.lit(1), F.lit(16)))).otherwise(F.lit(0)))
        .drop("_cuts", "_coarse", "_near", *[f"_c{i}" for i in range(len(group))])
    )


def _placed(things: DataFrame, group: list[str], key: str, weight: Column, steps: int) -> DataFrame:
    """Add ``_first`` (1 + the weight of what has a smaller key), ``_dense`` and the group's ``_rows`` and ``_keys``; keys are distinct."""
    parts = stepped(things.withColumn("_w", weight), group, key, steps)
    w = W.partitionBy(*group, "_step").orderBy(key)
    inner = parts.withColumns({
        "_first": F.coalesce(F.sum("_w").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "_dense": F.row_number().over(w).cast("bigint"),
    })
    # One row a group and step; a group's window holds its steps only.
    names = [F.col(g).alias(f"_g{i}") for i, g in enumerate(group)]
    sizes = parts.groupBy(*names, F.col("_step").alias("_s")).agg(F.sum("_w").alias("_size"), F.count(F.lit(1)).alias("_count"))
    whole = W.partitionBy(*[f"_g{i}" for i in range(len(group))])
    before = whole.orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.withColumns({
        "_before": F.coalesce(F.sum("_size").over(before), F.lit(0)), "_before_keys": F.coalesce(F.sum("_count").over(before), F.lit(0)),
        "_rows": F.sum("_size").over(whole), "_keys": F.sum("_count").over(whole),
    }).drop("_size", "_count")
    out = inner.join(offsets, _same(group) & (F.col("_step") == F.col("_s")))
    return out.withColumns({
        "_first": F.col("_first") + F.col("_before") + F.lit(1), "_dense": F.col("_dense") + F.col("_before_keys"),
    }).drop("_w", "_s", "_step", "_before", "_before_keys", *[f"_g{i}" for i in range(len(group))])


def _ascending(df: DataFrame, value: str, descending: bool) -> Column:
    """A key that grows as the rank does; the complement of a whole number cannot overflow."""
    if not descending:
        return F.col(value)
    return F.bitwise_not(value) if isinstance(df.schema[value].dataType, T.IntegralType) else F.negative(value)


def value_rank(
    df: DataFrame, value: str, ties: list[str], group: list[str] | None = None,
    kind: str = "row_number", descending: bool = True, steps: int = STEPS,
) -> DataFrame:
    """Add ``_rank`` of ``value`` and the group's size ``_n`` without one task per group.

    ``kind`` is row_number (ties broken by ``ties``, which tell the rows of a group apart), rank or dense_rank (``_n`` then counts
    distinct values). Groups are cut into steps of even size (see ``stepped``), ranked inside a step and shifted by what the
    steps before hold. row_number cuts between rows, so equal values part by their ties. The others rank the distinct values,
    each with its number of rows, and give the ranks back to the rows; a value that holds more than its share of them is dealt by a hash of
    the ties. So neither one value in most rows nor an extreme one fills a task.
    Values are numbers or dates and must not be NULL or NaN; a date ranks ascending.
    """
    group = group or []
    if kind == "row_number":
        keyed = df.withColumn("_rank_key", F.struct(_ascending(df, value, descending).alias("v"), *[F.col(t).alias(f"t{i}") for i, t in enumerate(ties)]))
        placed = _placed(keyed, group, "_rank_key", F.lit(1).cast("bigint"), steps)
        return placed.withColumnsRenamed({"_dense": "_rank", "_rows": "_n"}).drop("_rank_key", "_first", "_keys")
    names = [f"_v{i}" for i in range(len(group))]
    counts = df.groupBy(*[F.col(g).alias(n) for g, n in zip(group, names)], _ascending(df, value, descending).alias("_rank_key")).agg(
        F.count(F.lit(1)).alias("_c"))
    placed = _placed(counts, names, "_rank_key", F.col("_c"), steps)
    ranks = placed.select(
        *names, F.col("_rank_key").alias("_rank_value"), "_c",
        *([F.col("_first").alias("_rank"), F.col("_rows").alias("_n")] if kind == "rank" else [F.col("_dense").alias("_rank"), F.col("_keys").alias("_n")]))
    mine = df.withColumn("_rank_key", _ascending(df, value, descending))
    return dealt_join(mine, ranks, list(zip([*group, "_rank_key"], [*names, "_rank_value"])), "_c", F.xxhash64(*ties), steps).drop("_rank_key")


def dealt_join(
    df: DataFrame, lookup: DataFrame, on: list[tuple[str, str]], size: str, deal: Column, steps: int = STEPS, total: int | None = None
) -> DataFrame:
    """Rows with the further columns of the one row that ``lookup`` has for their key; ``size`` is how many rows share the key.

    ``on`` pairs the rows' key columns with the lookup's, which are dropped, as ``size`` is. Fewer than ``steps`` keys can hold more
    than their share of all rows each: these are dealt by ``deal`` over ``steps`` copies of their lookup row, so no key fills a task.
    ``total`` is the number of all rows, or one not much above it, where that is known; else the sizes are summed.
    """
    large = F.col(size) * F.lit(steps) > (lookup.select(F.sum(size)).scalar() if total is None else F.lit(total))
    hot = lookup.where(large).select(*[F.col(c).alias(f"_h{i}") for i, (_, c) in enumerate(on)], F.lit(True).alias("_hot"))
    is_hot, same = F.lit(True), F.lit(True)
    for i, (own, other) in enumerate(on):
        is_hot = is_hot & F.col(own).eqNullSafe(F.col(f"_h{i}"))
        same = same & F.col(own).eqNullSafe(F.col(other))
    dealt = df.join(F.broadcast(hot), is_hot, "left").withColumn(
        "_deal", F.when(F.col("_hot"), F.pmod(deal, F.lit(steps))).otherwise(F.lit(0)).cast("int")
    ).drop("_hot", *[f"_h{i}" for i in range(len(on))])
    copies = lookup.withColumn("_d", F.explode(F.when(large, F.sequence(F.lit(0), F.lit(steps - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(copies, same & (F.col("_deal") == F.col("_d"))).drop("_deal", "_d", size, *[c for _, c in on])


def group_quantiles(df: DataFrame, col: str, probs: list[float], group: list[str], steps: int = STEPS) -> DataFrame:
    """(group columns, _rows, q0, q1, …): exact nearest-rank quantiles of every group; NULL values do not count.

    Equal values are counted before the shuffle, and large groups are cut into steps (see ``value_rank``).
    """
    names = [f"_v{i}" for i in range(len(group))]
    counts = df.where(F.col(col).isNotNull()).groupBy(*[F.col(g).alias(n) for g, n in zip(group, names)], F.col(col).alias("_rank_key")).agg(
        F.count(F.lit(1)).alias("_c"))
    placed = _placed(counts, names, "_rank_key", F.col("_c"), steps)
    hits = []
    for i, p in enumerate(probs):
        wanted = F.greatest(F.lit(1), F.ceil(F.lit(float(p)) * F.col("_rows")))
        hits.append(F.max(F.when((F.col("_first") <= wanted) & (wanted < F.col("_first") + F.col("_c")), F.col("_rank_key"))).alias(f"q{i}"))
    return placed.groupBy(*[F.col(n).alias(g) for g, n in zip(group, names)]).agg(F.max("_rows").alias("_rows"), *hits)


def _same(group: list[str], prefix: str = "_g") -> Column:
    cond = F.lit(True)
    for i, g in enumerate(group):
        cond = cond & F.col(g).eqNullSafe(F.col(f"{prefix}{i}"))
    return cond


def ntile_of(rank: Column, n: Column, tiles: int) -> Column:
    """The tile of a 1-based row number among n rows; the first tiles take the remainder."""
    size, extra = div(n, tiles), n % F.lit(tiles)
    wide = extra * (size + F.lit(1))
    return (
        F.when(rank <= wide, F.call_function("div", rank - F.lit(1), size + F.lit(1)))
        .otherwise(extra + F.call_function("div", rank - F.lit(1) - wide, F.greatest(size, F.lit(1))))
        + F.lit(1)
    ).cast("int")
