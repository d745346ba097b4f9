"""Playlists as tables: lines, media segments, variants and renditions, with windows over each playlist's lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import attributes, hex_value, leading_float, leading_int
from tidemark.operators.ordered import Log, chained_offset
from tidemark.operators.prefix import last_of, scanned, sum_of
from tidemark.sources.fetch import base_of, resolved, with_resolved

LINES = Log(("uri",), ("pos",))


def lines(playlists: DataFrame, *keep: str) -> DataFrame:
    """(uri, pos, line) of each line of playlists (uri, text), white space trimmed, and its columns in keep."""
    split = playlists.select("uri", *keep, F.posexplode(F.split("text", "\r\n|\r|\n")).alias("pos", "line"))
    return split.withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", ""))


def is_master(text: Column) -> Column:
    return text.rlike("(?m)^#EXT-X-STREAM-INF[: ]")


def tag(name: str) -> Column:
    """What follows the tag and its colon, or null on other lines."""
    return F.when(F.startswith("line", F.lit(f"#{name}:")), F.substr("line", F.lit(len(name) + 3)))


def _attribute(attrs: Column, name: str) -> Column:
    return F.nullif(F.try_element_at(attrs, F.lit(name)), F.lit(""))


def _uris(playlists: DataFrame) -> DataFrame:
    """lines of playlists that begin with the magic, with is_uri, `run`, the number of uri lines before each line, and `base`, what
    relative uris of the list start from (read once a list)."""
    rows = lines(playlists.where(F.startswith("text", F.lit("#EXTM3U"))).withColumn("base", base_of(F.col("uri"))), "base")
    marked = rows.withColumn("is_uri", (F.col("line") != "") & ~F.startswith("line", F.lit("#")))
    return marked.withColumn("run", F.coalesce(F.sum(F.col("is_uri").cast("int")).over(LINES.before), F.lit(0)))


def key_of(a: Column) -> Column:
    """struct<method, uri, iv, format, versions> of a key tag's attributes: a method other than the two known ones is NONE."""
    method = F.when(_attribute(a, "METHOD").isin("AES-128", "SAMPLE-AES"), _attribute(a, "METHOD")).otherwise("NONE")
    fields = F.struct(method.alias("method"), _attribute(a, "URI").alias("uri"), hex_value(_attribute(a, "IV")).alias("iv"), _attribute(a, "KEYFORMAT").alias("format"), _attribute(a, "KEYFORMATVERSIONS").alias("versions"))
    return F.when(a.isNotNull(), fields)


def byte_range(text: Column) -> tuple[Column, Column]:
    """(length, offset) of length[@offset]; the length is null where either isn't a number."""
    offset = leading_int(F.when(F.contains(text, F.lit("@")), F.substring_index(text, "@", -1)))
    return F.when(offset.isNotNull() | ~F.contains(text, F.lit("@")), leading_int(F.substring_index(text, "@", 1))), offset


#: White space of a line's ends with its end, and the same at the end of all; both as the trimming of lines takes them.
_LINE_END, _SPACE = "[ \\t\\x0B\\f]*+[\\r\\n]\\s*+", " \t\n\x0b\f\r"
#: A segment with what binds to it: all lines up to one of its length, then tags, then its uri. It begins where the one before ended; no part goes back.
_STRETCH = r"\G(?s:.*?)\n#EXTINF:[^\n]*+(?:\n#[^\n]*+)*+\n[^#\n][^\n]*+"


def _values(name: str) -> Column:
    """What follows the tag on each line of a stretch that has it; null if none does."""
    return F.when(F.contains("stretch", F.lit(f"\n#{name}:")), F.regexp_extract_all("stretch", F.lit(rf"\n#{name}:([^\n]*)"), F.lit(1)))


def _newest(values: Column) -> Column:
    """The last of an array that isn't null."""
    return F.try_element_at(F.filter(values, lambda x: x.isNotNull()), F.lit(-1))


def _ranges(texts: Column) -> Column:
    """The readable ones of an array of byte ranges, as structs of length and offset."""
    after = F.transform(texts, lambda t: F.struct(t.alias("t"), F.contains(t, F.lit("@")).alias("told"), leading_int(F.when(F.contains(t, F.lit("@")), F.substring_index(t, "@", -1))).alias("offset")))
    return F.filter(F.transform(after, lambda x: F.struct(F.when(x["offset"].isNotNull() | ~x["told"], leading_int(F.substring_index(x["t"], "@", 1))).alias("length"), x["offset"].alias("offset"))), lambda x: x["length"].isNotNull())


def media_segments(playlists: DataFrame) -> DataFrame:
    """One row for each segment: uri, index, media_sequence, segment_uri, duration, start_time_sec, title, byte_length,
    byte_offset, discontinuity, key (see key_of), init_uri, init_length, init_offset, program_date_time.

    A uri line is a segment if a length tag stands between it and the uri line before. Tags since the last segment bind to it;
    a key or init section holds until the next; a byte range without an offset starts where the last one ended, unless a
    segment of another uri without a range stands between, and is dropped where there is no such end. A duration is the number
    that its text begins with, else 0; an unreadable date is null. Uris are resolved against the playlist's. A text without the
    magic has no segments. Of several ranges before one segment, one with an offset counts before one without, then the last.
    """
    # Lines are cut into stretches of one segment each in their own row: only segments pass the windows, in one exchange and one sort.
    loose = reduce(lambda a, b: a | b, (F.contains("text", F.lit(x)) for x in ("\r", "\t", "\x0b", "\f", " \n", "\n ", "\n\n")))
    text = F.rtrim(F.when(loose, F.regexp_replace("text", _LINE_END, "\n")).otherwise(F.col("text")), F.lit(_SPACE))
    found = F.when(F.startswith("text", F.lit("#EXTM3U")), F.regexp_extract_all(F.concat(F.lit("\n"), text), F.lit(_STRETCH), F.lit(0)))
    # In a column of its own before they are cut, the base is read once a list.
    rows = playlists.withColumn("base", base_of(F.col("uri"))).select("uri", "base", F.posexplode(found).alias("pos", "stretch"))
    told = lambda line: F.nullif(F.regexp_extract(line, "^[^,]*,(.*)$", 1), F.lit(""))
    rows = rows.withColumns({
        "line": F.substring_index("stretch", "\n", -1), "inf": F.substring_index(F.substring_index("stretch", "\n#EXTINF:", -1), "\n", 1),
        "key_attributes": attributes(F.try_element_at(_values("EXT-X-KEY"), F.lit(-1))), "ranges": _ranges(_values("EXT-X-BYTERANGE")),
        "map": F.try_element_at(F.filter(F.transform(_values("EXT-X-MAP"), attributes), lambda a: _attribute(a, "URI").isNotNull()), F.lit(-1)),
        "first_sequence": _newest(F.transform(_values("EXT-X-MEDIA-SEQUENCE"), leading_int)), "date": _newest(F.transform(_values("EXT-X-PROGRAM-DATE-TIME"), lambda x: F.try_to_timestamp(x))),
        "discontinuity": F.contains(F.concat("stretch", F.lit("\n")), F.lit("\n#EXT-X-DISCONTINUITY\n")),
    })
    init_length, init_offset = byte_range(_attribute(F.col("map"), "BYTERANGE"))
    whole = init_length.isNotNull() & init_offset.isNotNull()
    rows = rows.withColumns({
        "title": F.coalesce(told(F.col("inf")), _newest(F.transform(_values("EXTINF"), told))), "duration": F.coalesce(leading_float(F.substring_index("inf", ",", 1)), F.lit(0.0)),
        "ranged": F.coalesce(F.try_element_at(F.filter("ranges", lambda r: r["offset"].isNotNull()), F.lit(-1)), F.try_element_at("ranges", F.lit(-1))),
        "own_key": key_of(F.col("key_attributes")), "map_uri": _attribute(F.col("map"), "URI"),
    })
    # Python functions can't stand inside conditions, so uris are resolved as columns of their own, before the exchange; null stays null.
    rows = with_resolved(rows, F.col("uri"), F.col("base"), {"segment_uri": F.col("line"), "key_uri": F.col("own_key.uri"), "init_uri": F.col("map_uri")}).select(
        "uri", "pos", "title", "duration", "discontinuity", "date", "first_sequence", "segment_uri", F.col("ranged.length").alias("length"), F.col("ranged.offset").alias("given"),
        F.when(F.col("own_key").isNotNull(), F.col("own_key").withField("uri", F.col("key_uri"))).alias("key"),
        F.when(F.col("map").isNotNull(), F.struct("init_uri", F.when(whole, init_length).alias("init_length"), F.when(whole, init_offset).alias("init_offset"))).alias("init"),
    )
    rows = scanned(rows, LINES, {name: last_of(F.col(name)) for name in ("key", "init", "first_sequence")} | {"start_time_sec": sum_of(F.col("duration"), before=True)})
    rows = chained_offset(rows, LINES, F.col("given"), "length", "byte_offset", resource="segment_uri")
    return rows.select(
        "uri", F.col("pos").alias("index"), (F.coalesce("first_sequence", F.lit(0)) + F.col("pos")).cast("bigint").alias("media_sequence"), "segment_uri", "duration",
        F.coalesce("start_time_sec", F.lit(0.0)).alias("start_time_sec"), "title",
        F.when(F.col("byte_offset").isNotNull(), F.col("length")).alias("byte_length"), F.when(F.col("length").isNotNull(), F.col("byte_offset")).alias("byte_offset"),
        "discontinuity", "key", "init.init_uri", "init.init_length", "init.init_offset", F.col("date").alias("program_date_time"),
    )


def media_playlists(playlists: DataFrame) -> DataFrame:
    """One row for each playlist with the magic: version, target_duration, media_sequence, discontinuity_sequence, end_list,
    playlist_type, n_segments, total_duration. The last readable value of a tag counts; a type other than two is null."""
    rows = _uris(playlists)
    newest = lambda value: F.max_by(value, F.when(value.isNotNull(), F.col("pos")))
    kind = F.trim(tag("EXT-X-PLAYLIST-TYPE"))
    tags = rows.groupBy("uri").agg(
        newest(leading_int(tag("EXT-X-VERSION"))).alias("version"), newest(leading_float(tag("EXT-X-TARGETDURATION"))).alias("target_duration"),
        newest(leading_int(tag("EXT-X-MEDIA-SEQUENCE"))).alias("media_sequence"), newest(leading_int(tag("EXT-X-DISCONTINUITY-SEQUENCE"))).alias("discontinuity_sequence"),
        F.bool_or(F.col("line") == "#EXT-X-ENDLIST").alias("end_list"), newest(F.when(kind.isin("VOD", "EVENT"), kind)).alias("playlist_type"),
    )
    sums = media_segments(playlists).groupBy("uri").agg(F.count("*").alias("n_segments"), F.sum("duration").alias("total_duration"))
    out = tags.join(sums, "uri", "left")
    none = {"version": 1, "target_duration": 0.0, "media_sequence": 0, "discontinuity_sequence": 0, "n_segments": 0, "total_duration": 0.0}
    return out.fillna(none)


def variants(playlists: DataFrame, strict: bool = False) -> DataFrame:
    """One row for each variant of master playlists; the last STREAM-INF before a uri counts. A variant without a bandwidth has a null
    bitrate, or with strict ends the job."""
    rows = _uris(playlists)
    of_run = Window.partitionBy("uri", "run").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("a", attributes(F.last(tag("EXT-X-STREAM-INF"), ignorenulls=True).over(of_run))).where(F.col("is_uri") & F.col("a").isNotNull())
    a = F.col("a")
    bitrate = leading_int(_attribute(a, "BANDWIDTH"))
    if strict:
        bitrate = F.coalesce(bitrate, F.raise_error(F.concat(F.lit("a variant without BANDWIDTH in "), F.col("uri"))).cast("bigint"))
    size = lambda i: F.nullif(F.regexp_extract(_attribute(a, "RESOLUTION"), r"^([0-9]+)x([0-9]+)", i), F.lit("")).try_cast("int")
    return rows.select(
        "uri", (F.row_number().over(LINES.window) - 1).alias("pos"), resolved(F.col("uri"), F.col("line"), F.col("base")).alias("variant_uri"), bitrate.alias("bitrate"),
        leading_int(_attribute(a, "AVERAGE-BANDWIDTH")).alias("average_bitrate"), _attribute(a, "CODECS").alias("codecs"), size(1).alias("width"), size(2).alias("height"),
        _attribute(a, "FRAME-RATE").try_cast("double").alias("frame_rate"), _attribute(a, "AUDIO").alias("audio_group"), _attribute(a, "SUBTITLES").alias("subtitle_group"), _attribute(a, "CLOSED-CAPTIONS").alias("caption_group"), _attribute(a, "NAME").alias("name"),
    )


def renditions(playlists: DataFrame) -> DataFrame:
    """One row for each alternate rendition (audio, subtitles, closed captions) that has a type, group and name."""
    rows = lines(playlists).withColumn("a", attributes(tag("EXT-X-MEDIA"))).where("a is not null")
    a = F.col("a")
    yes = lambda n: F.coalesce(_attribute(a, n) == "YES", F.lit(False))
    out = rows.withColumn("rendition_uri", _attribute(a, "URI")).withColumn("rendition_uri", resolved(F.col("uri"), F.col("rendition_uri"))).select(
        "uri", "pos", _attribute(a, "TYPE").alias("type"), _attribute(a, "GROUP-ID").alias("group_id"), _attribute(a, "NAME").alias("name"), _attribute(a, "LANGUAGE").alias("language"),
        _attribute(a, "ASSOC-LANGUAGE").alias("assoc_language"), _attribute(a, "CHARACTERISTICS").alias("characteristics"),
        yes("DEFAULT").alias("is_default"), yes("AUTOSELECT").alias("autoselect"), yes("FORCED").alias("forced"), _attribute(a, "CHANNELS").alias("channels"), "rendition_uri",
    )
    return out.where("type in ('AUDIO', 'SUBTITLES', 'CLOSED-CAPTIONS') and group_id is not null and name is not null")


def independent(text: Column) -> Column:
    """Whether a master playlist says that its segments decode on their own."""
    return text.rlike("(?m)^#EXT-X-INDEPENDENT-SEGMENTS\\s*$")
