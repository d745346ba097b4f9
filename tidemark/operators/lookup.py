"""Lookups between ordered tables, without range joins: both sides are put in one order and carried forward."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, take: list[str], clamp: bool = False) -> DataFrame:
    """Each left row with the columns `take` of the latest right row of its keys at or before left_at.

    One exchange and one sort of both sides together. clamp: left rows before the first right row get that one.
    Among right rows at the same time the greatest by `take` is used.
    """
    own = left.withColumn("__at", F.col(left_at)).withColumn("__right", F.lit(0)).withColumn("__got", F.lit(None))
    packed = F.struct(*take)
    other = right.select(*keys, F.col(right_at).alias("__at"), packed.alias("__got")).groupBy(*keys, "__at").agg(F.max("__got").alias("__got")).withColumn("__right", F.lit(-1))
    own = own.withColumn("__got", F.col("__got").cast(other.schema["__got"].dataType))
    both = own.unionByName(other, allowMissingColumns=True)
    by = Window.partitionBy(*keys).orderBy("__at", "__right")
    found = F.last("__got", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    if clamp:
        # What a row lacks is the first one of all: a frame over the whole key is read once, one to its end once a row.
        found = F.coalesce(found, F.first("__got", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    out = both.withColumn("__found", found).where("__right = 0")
    return out.select(*left.columns, *(F.col(f"__found.{c}").alias(c) for c in take))


def segment_at(probes: DataFrame, segments: DataFrame, keys: list[str], t: str, start: str, length: str, seq: str) -> DataFrame:
    """Each probe with the number of the first segment that ends after t: t below 0 gives the first, past the end null.

    One exchange and one sort of probes and segments together; a segment's row tells its key's first one as well.
    """
    own = probes.withColumns({"__at": F.col(t), "__side": F.lit(0)})
    real = F.when(F.col(length) > 0, F.struct(F.col(seq).alias("seq"), (F.col(start) + F.col(length)).alias("end")))
    other = segments.select(*keys, F.col(start).alias("__at"), F.lit(-1).alias("__side"), real.alias("__got"), F.struct(F.col(start).alias("start"), F.col(seq).alias("seq")).alias("__head"))
    both = own.unionByName(other, allowMissingColumns=True)
    by = Window.partitionBy(*keys).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumns({"__found": F.last("__got", ignorenulls=True).over(by), "__first": F.min("__head").over(Window.partitionBy(*keys))}).where("__side = 0")
    hit = F.when(F.col(t) < 0, F.col("__first.seq")).when(F.col(t) < F.col("__found.end"), F.col("__found.seq"))
    return found.select(*probes.columns, hit.alias(seq))


def by_sequence(probes: DataFrame, segments: DataFrame, keys: list[str], seq: str, take: list[str]) -> DataFrame:
    """Each probe with the columns `take` of the segment of its number; null outside the list."""
    return probes.join(segments.select(*keys, seq, *take), [*keys, seq], "left")


def reanchor(positions: DataFrame, segments: DataFrame, keys: list[str], t: str, start: str, length: str, seq: str, past_end: str = "last") -> DataFrame:
    """Positions (keys, t, their own seq) with the number to go on from in another list of segments: the one that t is in; past
    its end the last one (past_end='last') or the position's own ('same')."""
    own = positions.withColumnRenamed(seq, "__own")
    found = segment_at(own, segments, keys, t, start, length, seq)
    if past_end == "last":
        found = found.join(segments.groupBy(*keys).agg(F.max_by(seq, F.struct(start, seq)).alias("__last")), keys, "left")
        return found.withColumn(seq, F.coalesce(seq, "__last")).drop("__own", "__last")
    return found.withColumn(seq, F.coalesce(seq, "__own")).drop("__own")


def by_uri(rows: DataFrame, bodies: DataFrame, uri: str, name: str, most: int = 100_000) -> DataFrame:
    """rows with the body of the uri they name (bodies: uri, body; one each is used), null without one. The distinct uris in use
    are broadcast if there are at most `most`; else a join does it."""
    wanted = rows.where(F.col(uri).isNotNull()).select(F.col(uri).alias("__uri")).distinct()
    known = bodies.select(F.col("uri").alias("__uri"), F.col("body").alias(name)).join(wanted, "__uri", "left_semi").groupBy("__uri").agg(F.min(name).alias(name))
    few = known.limit(most + 1).count() <= most
    return rows.join(F.broadcast(known) if few else known, F.col(uri) == F.col("__uri"), "left").drop("__uri")


def follow(changes: DataFrame, groups: DataFrame, keys: list[str], on: str, value: str, order: list[str], key: list[str]) -> DataFrame:
    """Each change with the value of its group if there is one, else the value that held before."""
    found = changes.join(groups.select(*keys, on, value), [*keys, on], "left")
    by = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return found.withColumn(value, F.last(value, ignorenulls=True).over(by))


def top_level(ladder: list[int], fits) -> Column:
    """Highest index of an ascending ladder for which fits(index, bitrate) holds, or null. A row-local fold: no join."""
    found = F.lit(None).cast("int")
    for i, rate in enumerate(ladder):
        found = F.when(fits(i, rate), F.lit(i)).otherwise(found)
    return found


def best_level(ladder: list[int], bandwidth: Column, current: Column, buffer: Column, ttfb: Column, duration: Column, low: Column, cap: Column, keep: float = 0.95, up: float = 0.7, slack: float = 4.0) -> Column:
    """The highest affordable level: bandwidth, discounted more for going up, covers its bitrate and the segment loads
    before the buffer runs dry; failing that the same with slack; failing that the floor."""

    def fits(extra: float):
        def one(i: int, rate: int) -> Column:
            b = bandwidth * F.when(F.lit(i) > current, F.lit(up)).otherwise(F.lit(keep))
            return (F.lit(i) >= low) & (F.lit(i) <= cap) & ((b >= rate) | (F.lit(i) == low)) & (ttfb + F.lit(float(rate)) * duration / b <= buffer + extra)

        return one

    return F.coalesce(top_level(ladder, fits(0.0)), top_level(ladder, fits(slack)), F.least(low, cap)).cast("bigint")


def abandon_level(ladder: list[int], level: Column, buffer: Column, loaded: Column, expected: Column, elapsed: Column, ttfb: Column, duration: Column) -> Column:
    """The level to drop to in mid-load, or -1 to go on: only past half of the expected time, when what remains outlasts
    the buffer, to the highest lower level that loads within the tolerance and sooner than the rest would."""
    rate = F.nullif(loaded * 8000.0 / F.greatest(F.lit(1.0), elapsed - ttfb), F.lit(0.0))
    rest = F.greatest(expected - loaded, F.lit(0)) * 8.0 / rate
    tolerance = F.least(buffer, duration + ttfb / 1000.0)
    projected = ttfb / 1000.0 + 8.0 * expected / rate

    def fits(i: int, bits: int) -> Column:
        t = ttfb / 1000.0 + F.lit(float(bits)) * duration / rate
        return (F.lit(i) < level) & (t < tolerance) & (t < projected)

    guard = (level > 0) & ttfb.isNotNull() & (expected > 0) & (loaded * 2 >= expected) & (rest >= buffer)
    return F.when(guard, F.coalesce(top_level(ladder, fits), F.lit(-1))).otherwise(F.lit(-1)).cast("bigint")
