"""Running values over keyed, ordered logs in which one key may hold much of the table: a scan in two levels.

A window gives each key to one task. Where keys are too large for that, spread finds those with more than a share of all rows and cuts
each, by quantiles of its first order column, into parts of about that share. scanned then takes three steps: one partial state
for each part of such a key (an aggregate), an exclusive scan over the partial states (a row a part, so a bounded number), and a window
inside each part, to whose values the state before the part is added. That holds for any associative state, and what a running value needs of it is
a Prefix. Keys of the usual size are one part and go through the window alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Log:
    """What identifies a log (keys) and orders it; order must be unique within a key for reproducible results.

    cuts: (keys, bounds) of the keys that are scanned in parts, see spread."""

    keys: tuple[str, ...]
    order: tuple[str, ...]
    cuts: DataFrame | None = None

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    @property
    def so_far(self) -> WindowSpec:
        return self.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    @property
    def before(self) -> WindowSpec:
        return self.window.rowsBetween(Window.unboundedPreceding, -1)

    @property
    def whole(self) -> WindowSpec:
        return self.window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    @property
    def after(self) -> WindowSpec:
        """The rows behind each, nearest last: backwards, as a frame that only grows is read once."""
        return Window.partitionBy(*self.keys).orderBy(*(F.desc_nulls_last(x) for x in self.order)).rowsBetween(Window.unboundedPreceding, -1)

    def within(self, *more: str) -> Log:
        """The log of each value of more inside a key; a key that is cut stays so."""
        return Log((*self.keys, *more), self.order, self.cuts)


@dataclass(frozen=True)
class Prefix:
    """A running value: its partial state over a part (an aggregate; given the order as a struct), the state of the parts before one (given the
    partial states and a log of parts), its value inside a log, and the value from the state before (null in a first part) and that inside."""

    partial: Callable[[Column], Column]
    across: Callable[[Column, Log], Column]
    inside: Callable[[Log], Column]
    merged: Callable[[Column, Column], Column]


def sum_of(value: Column, before: bool = False) -> Prefix:
    """The sum of value so far, or of the rows before; null where there is none."""
    return Prefix(lambda order: F.sum(value), lambda p, log: F.sum(p).over(log.before), lambda log: F.sum(value).over(log.before if before else log.so_far), lambda a, b: F.coalesce(a + b, a, b))


def max_of(value: Column) -> Prefix:
    return Prefix(lambda order: F.max(value), lambda p, log: F.max(p).over(log.before), lambda log: F.max(value).over(log.so_far), lambda a, b: F.greatest(a, b))


def last_of(value: Column, before: bool = False) -> Prefix:
    """The latest value that isn't null, up to the row or before it."""
    return Prefix(
        lambda order: F.max_by(value, F.when(value.isNotNull(), order)), lambda p, log: F.last(p, ignorenulls=True).over(log.before),
        lambda log: F.last(value, ignorenulls=True).over(log.before if before else log.so_far), lambda a, b: F.coalesce(b, a),
    )


def next_of(value: Column) -> Prefix:
    """The first value that isn't null in the rows behind."""
    return Prefix(
        lambda order: F.min_by(value, F.when(value.isNotNull(), order)), lambda p, log: F.last(p, ignorenulls=True).over(log.after),
        lambda log: F.last(value, ignorenulls=True).over(log.after), lambda a, b: F.coalesce(b, a),
    )


def neighbour_of(value: Column, ahead: bool = False) -> Prefix:
    """struct<v> of the row before (ahead: behind), null where there is none."""
    own = F.struct(value.alias("v"))
    take, step = (F.min_by, F.lead) if ahead else (F.max_by, F.lag)
    return Prefix(lambda order: take(own, order), lambda p, log: step(p).over(log.window), lambda log: step(own).over(log.window), lambda a, b: F.coalesce(b, a))


def number(base: int = 0) -> Prefix:
    """The number of the row in its log, from base on."""
    return Prefix(lambda order: F.count(F.lit(1)), lambda p, log: F.sum(p).over(log.before), lambda log: F.row_number().over(log.window).cast("bigint") + (base - 1), lambda a, b: F.coalesce(a, F.lit(0)) + b)


def whole(aggregate: Callable[[Column], Column], value: Column, again: Callable[[Column], Column] | None = None) -> Prefix:
    """An aggregate of the whole log on each row; again: how partial ones go together, where that isn't the aggregate itself."""
    return Prefix(lambda order: aggregate(value), lambda p, log: (again or aggregate)(p).over(log.whole), lambda log: aggregate(value).over(log.whole), lambda a, b: F.coalesce(a, b))


def _same(left: list[Column], right: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, (x.eqNullSafe(y) for x, y in zip(left, right, strict=True)))


def spread(df: DataFrame, log: Log, most: int = 1000, least: int = 100_000) -> Log:
    """log, with each key that holds more than 1/most of df's rows (and `least` of them) cut into parts of about that many.

    There are fewer than `most` such keys with fewer than 2 * most parts, whatever the table; they are found by a count of the keys and
    come to the driver. The first order column has to be a number, date or time; rows equal in it stay in one part.
    """
    counts = df.groupBy(*log.keys).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    share = max(least, -(-total // most))
    hot = counts.where(F.col("n") > share)
    names = [f"__k{i}" for i in range(len(log.keys))]
    found = hot.toDF(*names, "n").collect()
    if not found:
        return replace(log, cuts=None)
    spark = df.sparkSession
    keys = spark.createDataFrame([r[: len(names)] for r in found], hot.select(*log.keys).toDF(*names).schema)
    # Quantiles by the largest key's number of parts; a smaller one uses some of them.
    parts = -(-max(r.n for r in found) // share)
    rows = df.join(F.broadcast(keys), _same([df[k] for k in log.keys], [keys[n] for n in names])).select(*names, F.col(log.order[0]).alias("__at"))
    marks = F.percentile_approx("__at", [i / parts for i in range(1, parts)], 10 * parts)
    bounds = rows.groupBy(*names).agg(F.array_distinct(marks).alias("__bounds"))
    return replace(log, cuts=spark.createDataFrame(bounds.collect(), bounds.schema))


PART = "__part"


def in_parts(df: DataFrame, log: Log) -> DataFrame:
    """df with the part that each row of a cut key is in (PART; 0 for other keys) and whether its key is cut."""
    cuts, at = log.cuts, F.col(log.order[0])
    # The cuts may be of fewer keys than the log has, see Log.within.
    names = [c for c in cuts.columns if c != "__bounds"]
    keys = list(log.keys[: len(names)])
    rows = df.join(F.broadcast(cuts), _same([df[k] for k in keys], [cuts[n] for n in names]), "left").drop(*names)
    part = F.when(F.col("__bounds").isNull() | at.isNull(), 0).otherwise(F.size(F.filter("__bounds", lambda b: b <= at)))
    return rows.withColumns({"__cut": F.col("__bounds").isNotNull(), PART: part}).drop("__bounds")


def scanned(df: DataFrame, log: Log, *stages: dict[str, Prefix]) -> DataFrame:
    """df with the running values of the stages, each of which may use columns of the ones before."""
    if log.cuts is None:
        for stage in stages:
            df = df.withColumns({name: p.inside(log) for name, p in stage.items()})
        return df
    keys, names = list(log.keys), [f"__k{i}" for i in range(len(log.keys))]
    columns, rows = df.columns, in_parts(df, log)
    order, inner, across = F.struct(*log.order), log.within(PART), Log(log.keys, (PART,))
    for stage in stages:
        partial = rows.where("__cut").groupBy(*keys, PART).agg(*(p.partial(order).alias(f"__p{i}") for i, p in enumerate(stage.values())))
        states = partial.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.col(PART).alias("__at_part"), *(p.across(F.col(f"__p{i}"), across).alias(f"__s{i}") for i, p in enumerate(stage.values())))
        rows = rows.join(F.broadcast(states), _same([rows[k] for k in keys] + [rows[PART]], [states[n] for n in names] + [states["__at_part"]]), "left").drop(*names, "__at_part")
        made = {name: p.merged(F.col(f"__s{i}"), p.inside(inner)) for i, (name, p) in enumerate(stage.items())}
        rows = rows.withColumns(made).drop(*(f"__s{i}" for i in range(len(stage))))
        columns = [*(c for c in columns if c not in stage), *stage]
    return rows.select(*columns)
