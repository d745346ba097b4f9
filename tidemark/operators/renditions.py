"""Choices among alternate renditions: which are wanted, by language and group, and which group plays.

Rows have key (the presentation), pos (their order in it), group_id, name, language, is_default, channels and uri. What is first
seen first wins a tie, as everywhere here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.selection import channel_flags, channels, first_of


def language_key() -> Column:
    return F.lower(F.coalesce("language", "name"))


def playable(rows: DataFrame) -> DataFrame:
    """Rows with a uri of their own; others are part of the main stream."""
    return rows.where(F.coalesce(F.col("uri"), F.lit("")) != "")


def wanted(rows: DataFrame, names: list[str] | None) -> DataFrame:
    """Rows whose language or name is one of the names, in any case, with `lang` (the language's key); None: all."""
    rows = rows.withColumn("lang", language_key())
    if names is None:
        return rows
    low = [n.lower() for n in names]
    return rows.where(F.lower("language").isin(low) | F.lower("name").isin(low))


def language_groups(rows: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One row for each key, lang and group_id: the first default one, else the first."""
    found = wanted(playable(rows), names)
    return first_of(found, ["key", "lang", "group_id"], F.col("is_default"), ["pos"])


def _group_order(rows: DataFrame) -> DataFrame:
    """(key, group_id, langs, seen): how many languages a group has, and when it is first met, language by language."""
    per = rows.groupBy("key", "lang", "group_id").agg(F.min("pos").alias("at"))
    first = per.groupBy("key", "lang").agg(F.min("at").alias("lang_at"))
    return per.join(first, ["key", "lang"]).groupBy("key", "group_id").agg(F.count("*").alias("langs"), F.min(F.struct("lang_at", "at")).alias("seen"))


def initial_group(rows: DataFrame, starts: DataFrame, names: list[str] | None = None, pinned: str | None = None) -> DataFrame:
    """(key, group_id) to begin with: the pinned one; else the start's (starts: key, start_group) if it has any wanted language;
    else the one with the most languages."""
    own = wanted(playable(rows), names)
    groups = _group_order(own).join(starts.select("key", F.col("start_group")), "key", "left")
    best = F.max_by("group_id", F.struct((F.col("group_id").eqNullSafe(F.col("start_group"))).cast("int"), "langs", (-F.col("seen.lang_at")).alias("x"), (-F.col("seen.at")).alias("y")))
    out = groups.groupBy("key").agg(best.alias("group_id"))
    return out if pinned is None else out.withColumn("group_id", F.lit(pinned))


def chosen(rows: DataFrame, names: list[str] | None = None, pinned: str | None = None) -> DataFrame:
    """One row for each language of the group with the most renditions (or the pinned one): the first default one, else the first."""
    own = wanted(playable(rows), names)
    if pinned is None:
        groups = own.groupBy("key", "group_id").agg(F.count("*").alias("n"), F.min("pos").alias("at"))
        best = groups.groupBy("key").agg(F.max_by("group_id", F.struct("n", (-F.col("at")).alias("x"))).alias("group_id"))
        own = own.join(best, ["key", "group_id"], "left_semi")
    else:
        own = own.where(F.col("group_id") == pinned)
    return first_of(own, ["key", "lang"], F.col("is_default"), ["pos"])


def inline_audio_group(rows: DataFrame, names: list[str] | None = None, allow_mono: bool = False) -> DataFrame:
    """(key, group_id, langs): of groups that aren't all mono (of all, if all are), the one with the most languages, then one with
    stereo, then the first."""
    own = wanted(playable(rows), names).withColumn("wide", channels(F.col("channels")))
    mono, stereo = channel_flags(F.col("wide"))
    groups = own.groupBy("key", "group_id").agg(F.count_distinct("lang").alias("langs"), mono.alias("mono"), stereo.cast("int").alias("stereo"), F.min("pos").alias("at"))
    order = F.struct((F.lit(1) if allow_mono else (~F.col("mono")).cast("int")).alias("m"), "langs", "stereo", (-F.col("at")).alias("x"))
    top = F.max_by(F.struct("group_id", "langs"), order)
    return groups.groupBy("key").agg(top.alias("t")).select("key", "t.group_id", "t.langs")


def inline_subtitle_group(rows: DataFrame, starts: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(key, group_id, langs): the group with the most languages, then the start variant's (starts: key, start_group), then the first."""
    own = wanted(playable(rows), names)
    groups = _group_order(own).join(starts.select("key", "start_group"), "key", "left")
    order = F.struct("langs", F.col("group_id").eqNullSafe(F.col("start_group")).cast("int").alias("s"), (-F.col("seen.lang_at")).alias("x"), (-F.col("seen.at")).alias("y"))
    return groups.groupBy("key").agg(F.max_by(F.struct("group_id", "langs"), order).alias("t")).select("key", "t.group_id", "t.langs")


def variant_groups(variants: DataFrame, rows: DataFrame, group: str) -> DataFrame:
    """Variants with how many renditions, and how many playable ones, the group has that they name."""
    n = rows.groupBy("key", F.col("group_id").alias(group)).agg(F.count("*").alias("members"), F.count_if(F.coalesce(F.col("uri"), F.lit("")) != "").alias("playable"))
    return variants.join(n, ["key", group], "left").fillna(0, ["members", "playable"])
