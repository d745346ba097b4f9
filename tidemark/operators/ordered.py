"""Operators over keyed, ordered logs: running sums, carried values, runs, folds, watermarks, counters.

Each takes a DataFrame and a Log that names its key and order columns, and adds columns. All windows of one Log share a
partitioning and an ordering, so Spark plans one exchange and one sort for any number of them. A window gives a key to one task (it
spills, but is one task): with a Log from `spread`, keys that hold much of a table are scanned in parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.prefix import Log, last_of, max_of, neighbour_of, next_of, number, scanned, spread, sum_of, whole

__all__ = ["Log", "spread"]


def timeline(df: DataFrame, log: Log, length: str, start: str = "start", total: str = "total", seq: str = "seq", base: int = 0) -> DataFrame:
    """Start of each element as the sum of those before it, the log's total length, and numbers from base on."""
    kind = df.schema[length].dataType
    rows = scanned(df, log, {start: sum_of(F.col(length), before=True), total: whole(F.sum, F.col(length)), seq: number(base)})
    return rows.withColumns({start: F.coalesce(start, F.lit(0)).cast(kind), total: F.col(total).cast(kind)})


def carry(df: DataFrame, log: Log, value: Column, name: str) -> DataFrame:
    """The latest non-null value up to and including each row."""
    return scanned(df, log, {name: last_of(value)})


def bind_to_next(df: DataFrame, log: Log, is_target: Column, flags: dict[str, Column]) -> DataFrame:
    """Only the target rows, each with whether (1 or 0) any row since the last target (itself included) had each flag."""
    counts = {f"__n_{k}": sum_of(F.coalesce(v.cast("int"), F.lit(0))) for k, v in flags.items()}
    last = {f"__l_{k}": last_of(F.when(is_target, F.col(f"__n_{k}")), before=True) for k in flags}
    rows = scanned(df, log, counts, last).where(is_target)
    return rows.withColumns({k: (F.col(f"__n_{k}") > F.coalesce(f"__l_{k}", F.lit(0))).cast("bigint") for k in flags}).drop(*counts, *last)


def chained_offset(df: DataFrame, log: Log, explicit: Column, length: str, name: str = "offset", resource: str | None = None) -> DataFrame:
    """Explicit offsets where given; else the end of the element before; null before the first explicit one.

    resource: a column that ends a chain: after an element without a length, whose resource isn't that of the last one with
    a length, there is no end to go on from until the next explicit offset.
    """
    n = F.col(length)
    # What was explicit last, less the lengths before it, plus those before the row.
    stages = [{"__before": sum_of(F.coalesce(n, F.lit(0)), before=True)}, {"__base": last_of(F.when(F.col("__given").isNotNull(), F.col("__given") - F.coalesce("__before", F.lit(0))))}]
    start = F.col("__base") + F.coalesce("__before", F.lit(0))
    if resource is not None:
        # The resource of the last element with a length since an explicit offset.
        own = F.struct(F.when(n.isNotNull(), F.col(resource)).alias("r"))
        stages[0]["__resource"] = last_of(F.when(F.col("__given").isNotNull() | n.isNotNull(), own), before=True)
        other = F.col("__given").isNull() & n.isNull() & (F.col("__resource.r") != F.col(resource))
        stages[1]["__ended"] = last_of(F.when(F.col("__given").isNotNull(), False).when(other, True))
        start = F.when(~F.coalesce("__ended", F.lit(False)), start)
    rows = scanned(df.withColumn("__given", explicit), log, *stages)
    return rows.withColumn(name, start.cast("bigint")).drop("__given", "__before", "__base", "__resource", "__ended")


def runs(df: DataFrame, log: Log, starts: Column, aggs: dict[str, Column], run: str = "run") -> DataFrame:
    """One row for each run of rows that begins at `starts`; rows before the first start are run 0."""
    numbered = scanned(df, log, {run: sum_of(starts.cast("int"))}).withColumn(run, F.coalesce(run, F.lit(0)).cast("bigint"))
    return numbered.groupBy(*log.keys, run).agg(*(v.alias(k) for k, v in aggs.items()))


def in_order(order: tuple[str, ...], *values: str) -> Column:
    """Array of structs of order and values, sorted by order; for folds and ordered concatenation of bounded groups."""
    return F.array_sort(F.collect_list(F.struct(*order, *values)))


#: Rows of a chunk that is folded as one array.
CHUNK = 512


def ewma_of(df: DataFrame, log: Log, half_lives: tuple[float, ...], weight: Column, value: Column) -> DataFrame:
    """(keys, means, weight) of each key's log: bias-corrected exponentially weighted means, one for each half-life.

    A mean over two stretches is that of the later one plus the earlier one faded by the later one's weight, so stretches of
    CHUNK rows are folded on their own and then combined: no array holds a key's whole log.
    """
    rows = df.select(*log.keys, *log.order, weight.alias("__w"), value.alias("__v")).where("__w is not null and __v is not null")
    rows = scanned(rows, log, {"__n": number()}).withColumn("__chunk", F.floor(F.col("__n") / CHUNK))
    own = F.array_sort(F.collect_list(F.struct(*log.order, F.col("__w").alias("w"), F.col("__v").alias("v"))))
    zero = F.struct(*(F.lit(0.0).alias(f"e{i}") for i in range(len(half_lives))), F.lit(0.0).alias("w"))
    fade = lambda h, w: F.pow(F.lit(0.5 ** (1 / h)), w)
    step = lambda a, x: F.struct(*((x["v"] * (1 - fade(h, x["w"])) + fade(h, x["w"]) * a[f"e{i}"]).alias(f"e{i}") for i, h in enumerate(half_lives)), (a["w"] + x["w"]).alias("w"))
    join = lambda a, x: F.struct(*((x["s"][f"e{i}"] + fade(h, x["s"]["w"]) * a[f"e{i}"]).alias(f"e{i}") for i, h in enumerate(half_lives)), (a["w"] + x["s"]["w"]).alias("w"))
    parts = rows.groupBy(*log.keys, "__chunk").agg(F.aggregate(own, zero, step).alias("s"))
    whole = parts.groupBy(*log.keys).agg(F.aggregate(F.array_sort(F.collect_list(F.struct("__chunk", "s"))), zero, join).alias("a"))
    left = lambda h: 1 - fade(h, F.col("a.w"))
    means = F.array(*(F.when(left(h) == 0, F.col(f"a.e{i}")).otherwise(F.col(f"a.e{i}") / left(h)) for i, h in enumerate(half_lives)))
    return whole.select(*log.keys, means.alias("means"), F.col("a.w").alias("weight"))


#: The shortest time a sample counts as (ms), the weight from which an estimate counts, the delay assumed before, the least delay.
LEAST_MS, ENOUGH, FIRST_DELAY, LEAST_DELAY = 50.0, 0.001, 100.0, 5.0


def bandwidth(df: DataFrame, log: Log, ms: Column, size: Column, ttfb: Column, half_lives: tuple[float, float] = (3.0, 9.0), first: float = 500_000.0) -> DataFrame:
    """(keys, can_estimate, estimate, ttfb) of each key's loads: bits a second as the lesser of a fast and a slow mean, and
    the mean delay to the first byte; what is assumed before there are loads enough. A load without a delay leaves that mean alone."""
    seconds = F.greatest(ms.cast("double"), F.lit(LEAST_MS)) / 1000
    rates = ewma_of(df, log, half_lives, seconds, size * 8.0 / seconds).withColumnRenamed("weight", "rate_weight").withColumnRenamed("means", "rate")
    heavy = F.sqrt(F.lit(2.0)) * F.exp(-F.pow(ttfb / 1000.0, F.lit(2.0)) / 2)
    delays = ewma_of(df, log, half_lives[1:], heavy, F.greatest(ttfb.cast("double"), F.lit(LEAST_DELAY))).withColumnRenamed("weight", "delay_weight").withColumnRenamed("means", "delay")
    both = df.select(*log.keys).distinct().join(rates, list(log.keys), "left").join(delays, list(log.keys), "left")
    can = F.coalesce(F.col("rate_weight") >= ENOUGH, F.lit(False))
    known = F.coalesce(F.col("delay_weight") >= ENOUGH, F.lit(False))
    return both.select(*log.keys, can.alias("can_estimate"), F.when(can, F.least(F.col("rate")[0], F.col("rate")[1])).otherwise(first).alias("estimate"), F.when(known, F.col("delay")[0]).otherwise(FIRST_DELAY).alias("ttfb"))


def watermark_dedup(df: DataFrame, log: Log, value: str, epoch_starts: Column, segment: str) -> DataFrame:
    """Rows whose value is above the mark of earlier segments of their epoch (an epoch begins at epoch_starts): the value
    of the last row kept in the last segment that kept any."""
    from tidemark.operators.scan import above_last_kept

    epochs = scanned(df, log, {"epoch": sum_of(epoch_starts.cast("int"))}).withColumn("epoch", F.coalesce("epoch", F.lit(0)).cast("bigint"))
    return above_last_kept(epochs, log, value, "epoch", segment, "__kept").where("__kept").drop("__kept")


def running_max(df: DataFrame, log: Log, value: Column, name: str) -> DataFrame:
    return scanned(df, log, {name: max_of(value)})


def counter(df: DataFrame, log: Log, name: str, modulo: int, stretch: Column | None = None) -> DataFrame:
    """Numbers the rows of each key from 0, modulo a count.

    stretch: a value that never falls in the order of the log (such as its hour). Rows are then numbered within their stretch,
    from the number of rows in earlier ones, so that no task has a whole key.
    """
    if stretch is None:
        return scanned(df, log, {name: number()}).withColumn(name, F.pmod(F.col(name), F.lit(modulo)))
    rows = df.withColumn("__stretch", stretch)
    sums = rows.groupBy(*log.keys, "__stretch").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*log.keys).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    found = rows.join(sums, [*log.keys, "__stretch"])
    place = F.col("__before") + F.row_number().over(log.within("__stretch").window) - 1
    return found.withColumn(name, F.pmod(place, F.lit(modulo)).cast("bigint")).drop("__stretch", "__before")


def spans(df: DataFrame, log: Log, at: str, name: str = "span", alone: int = 3600) -> DataFrame:
    """Distance to the next row; the last row gets the mean distance, or `alone` if it has no other."""
    t = F.col(at)
    rows = scanned(df, log, {"__n": whole(F.count, F.lit(1), F.sum), "__first": whole(F.min, t), "__last": whole(F.max, t), "__next": neighbour_of(t, ahead=True)})
    n = F.col("__n")
    mean = F.when(n > 1, F.floor((F.col("__last") - F.col("__first")) / (n - 1))).otherwise(alone)
    return rows.withColumn(name, F.coalesce(F.col("__next.v") - t, mean).cast("bigint")).drop("__n", "__first", "__last", "__next")


def changes(df: DataFrame, log: Log, value: Column, name: str, modulo: int) -> DataFrame:
    """How often value has changed so far, modulo a count."""
    marked = df.withColumn("__value", value)
    new = F.coalesce((F.col("__was.v") != F.col("__value")).cast("int"), F.lit(0))
    rows = scanned(marked, log, {"__was": neighbour_of(F.col("__value"))}, {name: sum_of(new)})
    return rows.withColumn(name, F.pmod(F.col(name), F.lit(modulo)).cast("bigint")).drop("__value", "__was")


def replay(df: DataFrame, log: Log, at: str, start: str, seek: Column, pause: Column, swap: Column) -> DataFrame:
    """A session's log under its commands: epoch, kept, shown, swapped.

    seek (a target or null) begins an epoch on its own row; rows that start before its target are not kept. pause (true:
    pause, false: resume, null: neither) holds rows from its own on until the next resume, whose `at` is when they are
    shown (null: never). swap (a value or null) takes effect on the row after it.
    """
    rows = scanned(df, log, {
        "epoch": sum_of(seek.isNotNull().cast("int")), "__target": last_of(seek), "__held": last_of(pause),
        "__resumed": next_of(F.when(~pause, F.col(at))), "swapped": last_of(swap, before=True),
    })
    shown = F.when(F.coalesce("__held", F.lit(False)), F.col("__resumed")).otherwise(F.col(at))
    return rows.withColumns({"kept": F.coalesce(F.col(start) >= F.col("__target"), F.lit(True)), "shown": shown}).drop("__target", "__held", "__resumed")
