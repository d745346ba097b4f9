"""Units to transport packets: how many each needs, continuity counters over units, then the packets of each unit."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BinaryType

from tidemark.functions.flat import binaries, flat, numbers, repeated, stretches
from tidemark.functions.framing import big_endian, joined, language_descriptor, pat, pes_unit, pmt, pointed, registration_descriptor
from tidemark.functions.scalars import language_code, pack_clock
from tidemark.operators.lookup import as_of
from tidemark.operators.ordered import Log, running_max
from tidemark.operators.prefix import scanned, sum_of
from tidemark.operators.scan import bucket_starts
from tidemark.operators.selection import merge_streams
from tidemark.sources import boxes
from tidemark.sources.packets import SIZE, SYNC, demux
from tidemark.sources.shared import written

#: Bytes of a packet after its header; flags of an adaptation field.
ROOM = 184
DISCONTINUITY, RANDOM_ACCESS, CLOCK = 0x80, 0x40, 0x10


@arrow_udf(BinaryType())
def _packets(pid: pa.Array, cc: pa.Array, flags: pa.Array, clock: pa.Array, data: pa.Array) -> pa.Array:
    """The packets of each unit end to end, a batch in vector operations: the field that fills what the payload leaves has its length, flags, clock, then stuffing."""
    (raw, at), (clocks, clock_at) = flat(data), flat(clock)
    pid, cc, flags = numbers(pid), numbers(cc), numbers(flags)
    sizes, fields = np.diff(at), np.diff(clock_at)
    heads = ROOM - np.where(flags == 0, 0, 2 + fields)
    made = []
    for low, high in stretches(at):
        n = 1 + np.maximum(0, -(-(sizes[low:high] - heads[low:high]) // ROOM))
        unit, j = repeated(n)
        unit, first = unit + low, j == 0
        start = np.where(first, 0, heads[unit] + (j - 1) * ROOM)
        free = ROOM - np.minimum(sizes[unit] - start, np.where(first, heads[unit], ROOM))
        cells = np.full((len(unit), SIZE), 0xFF, np.uint8)
        cells[:, 0], cells[:, 1], cells[:, 2] = SYNC, pid[unit] >> 8 | first * 0x40, pid[unit] & 0xFF
        cells[:, 3] = np.where(free == 0, 0x10, 0x30) | cc[unit] + j & 15
        cells[free > 0, 4] = free[free > 0] - 1
        cells[free > 1, 5] = np.where(first, flags[unit], 0)[free > 1]
        timed = np.flatnonzero(first & (fields[unit] > 0))
        cells[timed, 6:12] = clocks[clock_at[unit[timed]][:, None] + np.arange(6)]
        cells[np.arange(SIZE) >= 4 + free[:, None]] = raw[at[low] : at[high]]
        made.append(binaries(cells.reshape(-1), n * SIZE))
    return pa.concat_arrays(made) if made else pa.array([], pa.binary())


def packetize(units: DataFrame, log: Log, epoch: str | None = None) -> DataFrame:
    """units with `packets` (array of 188-byte packets) and `body` (the packets end to end), in place of `data`.

    units has pid, data, pcr (a clock for the first packet, or null), key and break (flags of the first packet), and the
    columns of log. Counters run over the units of a pid in the order of log; with a log whose large keys are cut (see prefix.spread)
    no task has a whole one of these. epoch: a column at each new value of which they begin anew (what stands behind a break). Empty or null data gives one packet with stuffing only.
    """
    data = F.coalesce("data", F.lit(b""))
    flags = F.when(F.coalesce("break", F.lit(False)), DISCONTINUITY).otherwise(0) + F.when(F.coalesce("key", F.lit(False)), RANDOM_ACCESS).otherwise(0) + F.when(F.col("pcr").isNotNull(), CLOCK).otherwise(0)
    clock = F.when(F.col("pcr").isNotNull(), big_endian(pack_clock(F.col("pcr")), 6)).otherwise(F.lit(b""))
    rows = units.withColumns({"data": data, "__flags": flags, "__clock": clock})
    head = F.lit(ROOM) - F.when(F.col("__flags") == 0, 0).otherwise(2 + F.length("__clock"))
    rows = rows.withColumn("__head", head)
    rows = rows.withColumn("__n", (1 + F.ceil(F.greatest(F.lit(0), F.length("data") - F.col("__head")) / ROOM)).cast("int"))
    rows = scanned(rows, log.within("pid", *([epoch] if epoch else [])), {"__cc": sum_of(F.col("__n").cast("bigint"), before=True)}).withColumn("__cc", F.coalesce("__cc", F.lit(0)))

    rows = rows.withColumn("body", _packets("pid", "__cc", "__flags", "__clock", "data"))
    each = F.sequence(F.lit(0), F.floor(F.length("body") / SIZE).cast("int") - 1)
    return rows.withColumn("packets", F.transform(each, lambda j: F.substring("body", j * SIZE + 1, F.lit(SIZE)))).drop("data", "__flags", "__clock", "__head", "__n", "__cc")


def interleave(video: DataFrame, others: list[DataFrame], keys: list[str], at: str, order: list[str]) -> DataFrame:
    """Video and other streams as one, in order of time: rank (0: video), place, and the video time (bucket) that each row
    goes with, the latest at or before it. Rows before the first video go with that one; without video, bucket is null."""
    times = video.select(*keys, F.col(at).alias("bucket")).distinct()
    routed = [as_of(x, times, keys, at, "bucket", ["bucket"], clamp=True) for x in others]
    return merge_streams([(x, i) for i, x in enumerate([video.withColumn("bucket", F.col(at)), *routed])], keys, at, order)


#: Pid and stream type of pictures.
VIDEO_PID, VIDEO_TYPE = 256, 0x1B
#: Pids of the tables; stream type of private units; stream ids of video, of the first audio stream and of subtitles; the format name of timed text.
PAT_PID, PMT_PID, PRIVATE_TYPE = 0, 0x1000, 0x06
VIDEO_ID, AUDIO_ID, PRIVATE_ID, TEXT_FORMAT = 0xE0, 0xC0, 0xBD, "VTT "


def mux(samples: DataFrame, log: Log, part: str, versions: DataFrame | None = None, clock_at_keys: bool = False, epochs: DataFrame | None = None) -> DataFrame:
    """Samples to transport packets: (keys, part, place, pid, packets, body), bodies to be joined in that order.

    samples: the keys of log, part (a chunk of the output, in the order of log), kind (video, audio or text), rank (0 for video, then
    one number for each other stream), pid, type, language, pts, dts, data, is_key, and the order of log within a part.
    Every part begins with both tables; then come the units by decoding time (other streams: by pts), then rank. The first packet of
    a picture has the clock (clock_at_keys: of key pictures only). Audio streams have ids from 0xC0 on, text ones 0xBD and a
    registration. versions: (keys, part, version, fresh): the tables' version, 0 without a row; fresh marks the first picture's break. epochs: (keys, part, epoch): counters begin anew with each epoch of a key.
    """
    keys = [*log.keys, part]
    at = F.when(F.col("kind") == "video", F.col("dts")).otherwise(F.col("pts"))
    rows = samples.withColumn("__at", at)
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("__at", "rank", *log.order)) + 1)
    by, first = Window.partitionBy(*keys), F.col("place") == 2
    video = F.col("kind") == "video"
    # A part's first row carries its tables, so samples are read once.
    rows = rows.withColumn("streams", F.array_sort(F.collect_set(F.struct("rank", "type", "pid", "kind", "language")).over(by)))
    if versions is not None:
        rows = rows.withColumn("__picture", F.min(F.when(video, F.col("place"))).over(by)).join(versions.select(*keys, F.col("version").alias("__version"), F.col("fresh").alias("__fresh")), keys, "left")
        version, fresh = F.coalesce("__version", F.lit(0)), F.coalesce("__fresh", F.lit(False)) & (F.col("place") == F.col("__picture"))
    else:
        version, fresh = F.lit(0), F.lit(False)
    rows = rows.withColumns({"streams": F.when(first, F.filter("streams", lambda s, i: (i == 0) | (F.get("streams", i - 1)["rank"] != s["rank"]))), "version": F.when(first, version)})
    described = lambda s: F.concat(F.when(s["language"].isNotNull(), language_descriptor(language_code(s["language"]))).otherwise(F.lit(b"")), F.when(s["kind"] == "text", registration_descriptor(TEXT_FORMAT)).otherwise(F.lit(b"")))
    entries = F.transform("streams", lambda s: F.struct(s["type"].alias("type"), s["pid"].alias("pid"), described(s).alias("descriptors")))
    rows = rows.withColumns({"__pat": pointed(pat(F.lit(1), F.lit(PMT_PID), F.col("version"))), "__pmt": pointed(pmt(F.lit(1), F.element_at("streams", 1)["pid"], entries, F.col("version")))})
    stream_id = F.when(video, VIDEO_ID).when(F.col("kind") == "audio", F.lit(AUDIO_ID - 1) + F.col("rank")).otherwise(PRIVATE_ID)
    unit = pes_unit(stream_id, F.col("pts"), F.when(video, F.col("dts")).otherwise(F.col("pts")), F.coalesce("data", F.lit(b"")), ~video, F.col("kind") != "text")
    key = video & F.coalesce(F.col("is_key"), F.lit(False))
    row = lambda *values: F.struct(*(v.cast(t).alias(c) for v, (c, t) in zip(values, (("place", "int"), ("pid", "int"), ("data", "binary"), ("pcr", "bigint"), ("key", "boolean"), ("break", "boolean")), strict=True)))
    table = lambda place, pid, data: row(F.lit(place), F.lit(pid), F.col(data), F.lit(None), F.lit(False), F.lit(False))
    # In a column of its own each part of a unit is made once.
    rows = rows.withColumn("__unit", unit)
    own = row(F.col("place"), F.col("pid"), F.col("__unit"), F.when(key if clock_at_keys else video, F.col("dts")), key, video & fresh)
    all_ = F.array(table(0, PAT_PID, "__pat"), table(1, PMT_PID, "__pmt"), own)
    rows = rows.select(*keys, F.explode(F.slice(all_, F.when(first, 1).otherwise(3), F.lit(3))).alias("r")).select(*keys, "r.*")
    if epochs is not None:
        rows = rows.join(epochs.select(*keys, F.col("epoch").alias("__epoch")), keys, "left")
    made = packetize(rows, Log(log.keys, (part, "place")), None if epochs is None else "__epoch")
    return made.select(*keys, "place", "pid", "packets", "body")


def streams_of(muxed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, body) of muxed units: the bytes of each part end to end. A group is one part of the output."""
    parts = F.array_sort(F.collect_list(F.struct("place", "body")))
    return muxed.groupBy(*keys).agg(joined(F.transform(parts, lambda x: x["body"])).alias("body"))


def inline_rows(video: DataFrame, others: list[DataFrame], keys: list[str], order: list[str], width: int) -> DataFrame:
    """Video and other streams as one, with the part of each row, for stretches of video of about `width` ticks.

    A part begins with a picture that is width or more after the first of the part before; other rows go to the part of the
    latest such picture at or before their pts, those before the first to the first. Without video the part is null.
    """
    rows = bucket_starts(video, Log(tuple(keys), ("dts", *order)), "dts", width, "part")
    times = rows.select(*keys, F.col("part").alias("__start")).distinct()
    for x in others:
        rows = rows.unionByName(as_of(x, times, keys, "pts", "__start", ["__start"], clamp=True).withColumnRenamed("__start", "part"))
    return rows


def inline(video: DataFrame, others: list[DataFrame], keys: list[str], order: list[str], width: int) -> DataFrame:
    """The rows of inline_rows, muxed part by part (see mux for the columns)."""
    return mux(inline_rows(video, others, keys, order, width), Log(tuple(keys), tuple(order)), "part")


def payload_of(units: DataFrame, kind: str) -> DataFrame:
    """(seq, body): the payloads of one kind of demuxed units end to end, as elementary output has them. A group is one body."""
    parts = F.array_sort(F.collect_list(F.struct("first", "payload")))
    return units.where(F.col("kind") == kind).groupBy("seq").agg(joined(F.transform(parts, lambda x: x["payload"])).alias("body"))


def canonical(segments: DataFrame, inits: DataFrame, stream: str, init: str) -> DataFrame:
    """(stream, seq, body): fragmented segments (stream, seq, init, body) as transport streams, one for each with its own tables and counters.

    inits (init, body): the init sections. Of each the first video track counts, if it is described by avc: its samples become
    pictures between start codes, with the parameter sets in key ones. What pts lacks to dts moves the pts of its segment, and of
    the stream's later ones, by the most so far. Segments without such samples give no row.
    """
    tracks = boxes.codecs(inits.select(F.col(init).alias("seq"), "body"))
    first = F.min_by(F.struct("track_id", "timescale", "avc"), "track_id")
    # Written, so that its size is known where it is joined: a few of them are broadcast, as many segments have one init section.
    track = written(tracks.where("kind = 'vide'").groupBy(F.col("seq").alias(init)).agg(first.alias("t")).where("t.avc.length_size is not null").select(init, "t.track_id", "t.timescale", "t.avc"), "tracks")
    files = segments.select(F.struct(F.col(stream).alias("stream"), F.col("seq").alias("seq"), F.col(init).alias("init")).alias("seq"), F.col(init), "body")
    made = boxes.payloads(files, track.drop("avc"), [init]).withColumn(init, F.col("seq.init")).join(track.select(init, "avc"), init)
    # Read twice: what moves the stamps of a segment comes from all segments before it. Only a row a segment passes the window.
    made = written(boxes.pictures(made, F.col("avc"), F.lit(0), ["seq", "need"]), "pictures").select(F.col("seq.stream").alias("stream"), F.col("seq.seq").alias("part"), "need", "i", "dts", "pts", "is_key", "data")
    needs = made.groupBy("stream", "part").agg(F.max("need").alias("need"))
    shifts = running_max(needs, Log(("stream",), ("part",)), F.col("need"), "shift").select("stream", "part", "shift")
    # One exchange, by segment, for all that follows.
    made = made.drop("need").repartition("stream", "part").join(shifts, ["stream", "part"]).withColumn("pts", F.col("pts") + F.col("shift"))
    none = F.lit(None).cast("string")
    samples = made.select("stream", "part", "i", "dts", "pts", "is_key", "data", F.lit("video").alias("kind"), F.lit(0).alias("rank"), F.lit(VIDEO_PID).alias("pid"), F.lit(VIDEO_TYPE).alias("type"), none.alias("language"), F.col("part").alias("__part"))
    muxed = mux(samples, Log(("stream", "part"), ("i",)), "__part")
    return streams_of(muxed, ["stream", "part"]).select(F.col("stream").alias(stream), F.col("part").alias("seq"), "body")


#: The ways to put a stream out: as it came, one kind of payload alone, or always as a transport stream.
MODES = ("ts", "es-audio", "es-video", "ts-canonical")


def output(bodies: DataFrame, mode: str, parts: DataFrame | None = None) -> DataFrame:
    """(seq, body) of segment bodies (seq, format, body) in a mode of MODES. Elementary modes take only transport streams (others
    give no row); the canonical one passes those on and puts parts (seq, body: other formats, muxed; see mux and streams_of) beside them."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    if mode == "ts":
        return bodies.select("seq", "body")
    streams = bodies.where("format = 'ts'").select("seq", "body")
    if mode == "ts-canonical":
        return streams if parts is None else streams.unionByName(parts.select("seq", "body"))
    return payload_of(demux(streams), mode.removeprefix("es-"))
