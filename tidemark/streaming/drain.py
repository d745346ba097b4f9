"""Cues that go with the segments of another stream: a join of two running streams by media time, with state that time bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TICKS = 90_000


def moment(ticks: Column) -> Column:
    """Media time in ticks as a timestamp, which watermarks need. It begins a day after the epoch, as a stream's first watermark is the
    epoch and takes what lies on it for late."""
    return F.timestamp_micros(F.floor(ticks * 100 / 9).cast("bigint") + 86_400_000_000)


def drained(segments: DataFrame, cues: DataFrame, key: str, most: int, late: int, start: str = "start", end: str = "end", pts: str = "pts") -> DataFrame:
    """Each cue with the segment of its key that it falls in (start <= pts < end, in ticks), as soon as both have come.

    Both streams are running ones. A segment is at most `most` ticks long, and rows may come as late as `late` ticks behind the newest of
    their stream; what is later is dropped, as is a cue that no segment takes. So a side is kept for most + late ticks of media time,
    however long the streams run. The columns of both come out, those of segments first; only the key may share a name.
    """
    delay = lambda ticks: f"{-(-ticks * 1000 // TICKS)} milliseconds"
    own = segments.withColumn("__from", moment(F.col(start))).withWatermark("__from", delay(late))
    other = cues.withColumnRenamed(key, "__key").withColumn("__at", moment(F.col(pts))).withWatermark("__at", delay(late))
    within = (F.col("__at") >= F.col("__from")) & (F.col("__at") <= F.col("__from") + F.expr(f"interval {delay(most)}"))
    met = own.join(other, (F.col(key) == F.col("__key")) & within & (F.col(pts) >= F.col(start)) & (F.col(pts) < F.col(end)))
    return met.drop("__from", "__at", "__key")
