"""Timed text as tables: the cues of each segment in 90 kHz ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import clock_ticks


def cues(segments: DataFrame) -> DataFrame:
    """(seq, pos, pts, duration_ticks, payload) of the cues of segments (seq, body, fallback_base); null pts never occurs.

    The base of a segment's times is its time map, else its fallback, else 0. Bodies without the magic give no rows.
    """
    body = F.regexp_replace(F.regexp_replace("body", "^﻿", ""), "\r\n|\r", "\n")
    rows = segments.select("seq", "fallback_base", body.alias("body")).where(F.startswith("body", F.lit("WEBVTT")))
    found = F.regexp_extract("body", "(?m)^X-TIMESTAMP-MAP=(.*)$", 1)
    mpegts = F.nullif(F.regexp_extract(found, r"MPEGTS:\s*([0-9]+)", 1), F.lit("")).try_cast("bigint")
    local = clock_ticks(F.regexp_extract(found, r"LOCAL:\s*([0-9:.]+)", 1))
    rows = rows.withColumn("base", F.coalesce(F.when(found != "", F.coalesce(mpegts, F.lit(0)) - local), F.col("fallback_base"), F.lit(0)))
    blocks = rows.select("seq", "base", F.posexplode(F.split("body", "\n\n+")).alias("pos", "block")).where(~F.col("block").rlike("^(WEBVTT|NOTE|STYLE|REGION)"))
    timing = r"(?m)^\s*([0-9:.]+)\s*-->\s*([0-9:.]+)[^\n]*$"
    start, end = (clock_ticks(F.regexp_extract("block", timing, i)) for i in (1, 2))
    timed = blocks.where(F.col("block").rlike(timing)).withColumns({"start": start, "end": end}).where("start >= 0 and end >= 0")
    payload = F.concat(F.rtrim(F.regexp_extract("block", r"(?s)(?:^|\n)([^\n]*-->.*)$", 1)), F.lit("\n"))
    return timed.select("seq", "pos", (F.col("base") + F.col("start")).alias("pts"), F.greatest(F.lit(0), F.col("end") - F.col("start")).alias("duration_ticks"), payload.alias("payload"))
