"""Selections: best group, first of a key, static picks, numbering in a wanted order, merges and live state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import leading_int
from tidemark.operators.ordered import Log


def channels(text: Column) -> Column:
    """The leading number of a CHANNELS value, if above 0."""
    n = leading_int(text)
    return F.when(n > 0, n)


def channel_flags(n: Column) -> tuple[Column, Column]:
    """Aggregates over a group: whether all are known to be mono, and whether any has two channels or more."""
    return F.bool_and(F.coalesce(n == 1, F.lit(False))), F.bool_or(F.coalesce(n >= 2, F.lit(False)))


def clamp_start(t: Column, total: Column, tail: Column) -> Column:
    """A start within the log: not below 0 (nor null or NaN), not past the start of the last element."""
    return F.when(t.isNull() | F.isnan(t.cast("double")) | (t <= 0), 0).otherwise(F.least(t, total - tail)).cast("bigint")


def best_group(rows: DataFrame, keys: list[str], group: str, language: str, wide: str, pos: str) -> DataFrame:
    """The group of each key with the most different languages; ties: one with a wide member, then the first seen."""
    per = rows.groupBy(*keys, group).agg(F.countDistinct(language).alias("langs"), F.max(F.col(wide).cast("int")).alias("__wide"), F.min(pos).alias("__pos"))
    top = F.max_by(F.struct(group, "langs"), F.struct("langs", "__wide", -F.col("__pos")))
    return per.groupBy(*keys).agg(top.alias("t")).select(*keys, f"t.{group}", "t.langs")


def first_of(rows: DataFrame, keys: list[str], preferred: Column, order: list[str]) -> DataFrame:
    """The first row of each key, preferred ones before others. An aggregate, so it combines before its shuffle."""
    whole = F.struct(*(c for c in rows.columns))
    top = F.min_by(whole, F.struct((~preferred).cast("int"), *order))
    return rows.groupBy(*keys).agg(top.alias("t")).select(*(F.col(f"t.{c}") for c in rows.columns))


def static_picks(ladder: DataFrame, key: str, rate: str, pos: str, index: int, cap: int) -> DataFrame:
    """By key: the lowest, the highest, the one at an index (the last if there are fewer), and the highest at most cap, else the lowest.

    Aggregates and a bounded rank, so no key's ladder is ever held whole.
    """
    step = F.struct(rate, pos)
    ends = ladder.groupBy(key).agg(F.min(step).alias("low"), F.max(step).alias("high"), F.max(F.when(F.col(rate) <= cap, step)).alias("capped"))
    ranked = ladder.select(key, rate, pos).withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(rate, pos))).where(F.col("__r") <= index + 1)
    at = ranked.groupBy(key).agg(F.max_by(pos, "__r").alias("seventh"))
    return ends.join(at, key).select(key, F.col(f"low.{pos}").alias("lowest"), F.col(f"high.{pos}").alias("highest"), "seventh", F.coalesce(F.col(f"capped.{pos}"), F.col(f"low.{pos}")).alias("under"))


def assign_numbers(have: DataFrame, key: str, name: str, wanted: list[str], base: int) -> DataFrame:
    """Numbers from base on for the wanted names that each key has, in the order wanted; missing ones use none up."""
    place = F.array_position(F.array(*(F.lit(w.lower()) for w in wanted)), F.lower(name))
    rows = have.withColumn("__place", place).where(F.col("__place") > 0)
    number = F.row_number().over(Window.partitionBy(key).orderBy("__place")) + (base - 1)
    return rows.select(key, name, number.cast("bigint").alias("pid"))


def merge_streams(streams: list[tuple[DataFrame, int]], keys: list[str], at: str, order: list[str]) -> DataFrame:
    """One stream in the order of time, ties by each stream's rank, then order; place numbers the result."""
    out = None
    for frame, rank in streams:
        own = frame.withColumn("rank", F.lit(rank))
        out = own if out is None else out.unionByName(own)
    return out.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(at, "rank", *order)).cast("bigint"))


def anchors(parts: DataFrame, log: Log, first: str, span: str, n: str, lone: int = 1920, duration: Column | None = None) -> DataFrame:
    """Where each part begins if parts follow each other without gaps: the first at its own time, each next one a frame
    after the end of the one before. An empty part has no anchor; with a duration (seconds) it takes that long, once there
    is a part before it."""
    some = F.col(n) > 0
    frame = F.when(F.col(n) > 1, F.floor(F.col(span) / (F.col(n) - 1))).otherwise(lone)
    silent = F.floor(duration * 90_000 + 0.5) if duration is not None else F.lit(0)
    rows = parts.withColumn("__first", F.first(F.when(some, F.col(first)), ignorenulls=True).over(log.so_far))
    rows = rows.withColumn("__length", F.when(some, F.col(span) + frame).when(F.col("__first").isNotNull(), silent).otherwise(0))
    start = F.col("__first") + F.coalesce(F.sum("__length").over(log.before), F.lit(0))
    return rows.withColumn("anchor", F.when(some, start).cast("bigint")).drop("__length", "__first")


def live_state(tip: Column, cursor: Column, target: int, sync: int, max_lag: int, offset: int, since: Column | None = None, live: Column | None = None, vod_buffer: int = 30) -> tuple[Column, Column, Column]:
    """Lag behind the live edge, buffer left of the sync target, and where to skip to (null: nowhere).

    since: seconds since the list was loaded, by which the edge has moved on, up to one target duration. live: false for
    lists that have ended, which lag nothing and have a constant buffer.
    """
    lag = F.greatest(F.lit(0), tip - cursor + 1) * target
    if since is not None:
        lag = lag + F.least(since, F.lit(target))
    running = F.lit(True) if live is None else live
    lag = F.when(running & (tip >= 0), lag).otherwise(0)
    skip = F.when(running & (tip >= 0) & (lag > max_lag), F.greatest(cursor, tip - offset + 1))
    kind = "bigint" if since is None else "double"
    return lag.cast(kind), F.when(running, F.greatest(F.lit(0), F.lit(sync) - lag)).otherwise(vod_buffer).cast(kind), skip.cast("bigint")


def initial_cursor(first: Column, last: Column, live: Column, offset: int = 6) -> Column:
    """The number to begin with: the first one, or in a live list `offset` from its end."""
    return F.when(live, F.greatest(first, last - offset + 1)).otherwise(first).cast("bigint")
