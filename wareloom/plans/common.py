"""Pieces shared by all industries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wareloom.config import GenConfig
from wareloom.functions import pools
from wareloom.functions.draws import SPAN, Draws, div, growth_day_index, quarter_label
from wareloom.operators.ranking import WIDE_TASK_ROWS, tasks_for

CHUNK = 4096            # positions that one dealt row of a key's share expands into, at least
PIECES = 256            # dealt rows a task, so that their hash spreads them evenly
BLOCK = 256             # positions that a literal array gives; long shares expand by it


def positions(
    spark: SparkSession, cfg: GenConfig, entity: str, n: int | None = None, name: str = "id", split: bool = False
) -> DataFrame:
    """Positions 0..n-1, by default one an entity; the only source of a generated table.

    Where the config has the entity's keys, each key expands into its own share of the
    positions (n div count, rounded up), and the range is not used. Pieces of the shares
    are dealt over the tasks first and expand there, so no position is shuffled.
    ``split`` adds the number ``_share`` of the key, from 0, and the ``_place`` in its share.
    """
    count = cfg.n(entity)
    n = count if n is None else n
    times = -(-n // count)
    if entity not in cfg.keys:
        out = spark.range(0, n, 1, tasks_for(spark, n)).withColumnRenamed("id", name)
        return _split(out, name, times) if split else out
    share = _numbered(cfg.keys[entity])
    if times == 1:
        out = share.select(F.col("_share").alias(name), *(["_share", F.lit(0).cast("bigint").alias("_place")] if split else []))
    else:
        tasks = tasks_for(spark, n)
        length = max(CHUNK, -(-n // (tasks * PIECES)))
        chunks = share.select((F.col("_share") * F.lit(times)).alias("_first"), F.explode(
            F.sequence(F.lit(0).cast("bigint"), F.lit((times - 1) // length).cast("bigint"))
        ).alias("_chunk")).repartition(tasks, "_first", "_chunk")
        start = F.col("_chunk") * F.lit(length)
        start, end = F.col("_first") + start, F.col("_first") + F.least(start + F.lit(length), F.lit(times).cast("bigint"))
        own = ["_first", div(F.col("_first"), times).alias("_share")] if split else []
        if times <= 4 * BLOCK:
            out = chunks.select(*own, F.explode(F.sequence(start, end - F.lit(1))).alias(name))
        else:
            blocks = chunks.select(*own, end.alias("_end"), F.explode(
                F.sequence(start, end - F.lit(1), F.lit(BLOCK).cast("bigint"))).alias("_start"))
            steps, left = F.expr(f"sequence(0L, {BLOCK - 1}L)"), F.col("_end") - F.col("_start")
            out = blocks.select(*(["_first", "_share"] if split else []), "_start", F.explode(
                F.when(left >= F.lit(BLOCK), steps).otherwise(F.slice(steps, F.lit(1), left.cast("int")))).alias("_step"))
            out = out.withColumn(name, F.col("_start") + F.col("_step")).drop("_start", "_step")
        if split:
            out = out.select(name, "_share", (F.col(name) - F.col("_first")).alias("_place"))
    return out if n == times * count else out.where(F.col(name) < F.lit(n))


def _numbered(keys: DataFrame) -> DataFrame:
    return keys.select((F.col(keys.columns[0]).cast("bigint") - F.lit(1)).alias("_share"))


def _split(df: DataFrame, name: str, times: int) -> DataFrame:
    return df.select("*", div(F.col(name), times).alias("_share"), (F.col(name) % F.lit(times)).alias("_place"))


def positions_at(spark: SparkSession, cfg: GenConfig, entity: str, n: int, picks: DataFrame, k: int) -> DataFrame:
    """(id, _share, _place, _times): the rows of ``positions`` at the k ones, below n, that ``picks`` asks for in its column ``_pick``.

    A position occurs as often as its key does, beside how many ``_times`` it is asked for. The picks are shuffled once, to
    the task of their key, where they are counted and meet the keys; nothing expands.
    """
    times = -(-n // cfg.n(entity))
    tasks = tasks_for(spark, k, WIDE_TASK_ROWS)
    own = div(F.col("_pick"), times)
    asked = picks.repartition(tasks, own).select(own.alias("_share"), "_pick")
    counted = asked.groupBy("_share", "_pick").agg(F.count(F.lit(1)).alias("_times"))
    if entity in cfg.keys:
        counted = counted.join(_numbered(cfg.keys[entity]).hint("merge"), "_share")
    return counted.select(F.col("_pick").alias("id"), "_share", (F.col("_pick") % F.lit(times)).alias("_place"), "_times")


def keyed(spark: SparkSession, cfg: GenConfig, entity: str, key: str, n: int | None = None) -> DataFrame:
    """Surrogate keys 1..n."""
    if entity not in cfg.keys:  # a range of the keys themselves: sums per key then need no shuffle
        n = cfg.n(entity) if n is None else n
        return spark.range(1, n + 1, 1, tasks_for(spark, n)).withColumnRenamed("id", key)
    return positions(spark, cfg, entity, n).select((F.col("id") + F.lit(1)).alias(key))


def spread(spark: SparkSession, cfg: GenConfig, df: DataFrame, key: str, rows: int) -> DataFrame:
    """Rows of given keys, dealt over the tasks for the ``rows`` that they expand into; a file of keys may be one task."""
    return df.repartition(tasks_for(spark, rows, WIDE_TASK_ROWS), key) if cfg.keys else df


def seeded(spark: SparkSession, cfg: GenConfig, table: str, entity: str, key: str, n: int | None = None) -> tuple[DataFrame, Draws]:
    u = Draws(cfg.seed, f"{cfg.industry}.{table}")
    return u.attach(keyed(spark, cfg, entity, key, n), key), u


def date_key(u: Draws, cfg: GenConfig, name: str = "date_key") -> Column:
    """1-based day of the window: uniform, or along the growth curve when opted in."""
    if cfg.growth_dates and cfg.growth > 0:
        share = u.bits(name) / F.lit(float(SPAN))
        day = growth_day_index(share, u.bits(f"{name}:day"), cfg.start_date, cfg.end_date, cfg.growth)
        return F.lit(1) + day
    return u.randint(name, 1, cfg.n_days)


def day_of(cfg: GenConfig, key: Column) -> Column:
    """Calendar day of a date key, by arithmetic instead of a join."""
    return F.date_add(F.lit(cfg.start_date), (key - F.lit(1)).cast("int"))


def dim_date(spark: SparkSession, cfg: GenConfig) -> DataFrame:
    d = F.col("full_date")
    return (
        spark.range(1, cfg.n_days + 1, 1, tasks_for(spark, cfg.n_days)).withColumnRenamed("id", "date_key")
        .withColumn("full_date", day_of(cfg, F.col("date_key")))
        .select(
            "date_key",
            "full_date",
            F.year(d).alias("year"),
            quarter_label(d).alias("quarter"),
            F.month(d).alias("month"),
            F.date_format(d, "MMMM").alias("month_name"),
            F.weekofyear(d).alias("week"),
            F.dayofmonth(d).alias("day"),
            F.weekday(d).alias("day_of_week"),
            F.date_format(d, "EEEE").alias("day_name"),
            (F.weekday(d) >= 5).alias("is_weekend"),
            ((F.month(d) == 12) & F.dayofmonth(d).isin(24, 25, 31)).alias("is_holiday"),
        )
    )


def first_name(u: Draws) -> Column:
    return u.choice("first_name", pools.FIRST_NAMES)


def last_name(u: Draws) -> Column:
    return u.choice("last_name", pools.LAST_NAMES)


def city(u: Draws, name: str = "city") -> Column:
    return u.choice(name, pools.CITIES)


def state(u: Draws) -> Column:
    return u.choice("state", pools.STATES)


def product_name(u: Draws, category: Column) -> Column:
    """``Word Catg 123``: a word, four letters of the category and a number."""
    return F.concat_ws(
        " ", u.choice("word", pools.WORDS), F.left(category, F.lit(4)), u.randint("model", 100, 999).cast("string")
    )


def int_col(c: Column) -> Column:
    return c.cast("int")
