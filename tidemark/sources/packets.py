"""Transport stream packets and packetised elementary streams as tables: single packets in bit arithmetic on hexadecimal digits, whole streams
in vector operations over batches of bodies."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.flat import binaries, flat, numbers, repeated, stretches, within
from tidemark.functions.framing import adts_frames, frame_ticks, id3_size, joined
from tidemark.functions.scalars import unpack_stamp
from tidemark.functions.tables import id3_stamp, map_entries, program_map, synced
from tidemark.operators.ordered import Log

SIZE, SYNC = 188, 0x47


def number(data: Column, at: int | Column, n: int) -> Column:
    """n bytes (7 at most) from 0-based `at` on as an unsigned number; null past the end."""
    part = F.substring(data, (at + 1) if isinstance(at, int) else (at + F.lit(1)), F.lit(n))
    return F.when(F.length(part) == n, F.conv(F.hex(part), 16, 10).cast("bigint"))


_PACKET = ("i", "pid", "starts", "control", "cc", "payload", "malformed")


def packets(streams: DataFrame, keep: list[str] = ()) -> DataFrame:
    """(seq, i, pid, starts, control, cc, payload, malformed) of the packets of streams (seq, body), and its columns in keep; whole ones only."""
    n = F.floor(F.length("body") / SIZE).cast("int")
    rows = streams.where(n > 0).select("seq", *keep, "body", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    rows = rows.select("seq", *keep, "i", F.substring("body", F.col("i") * SIZE + 1, F.lit(SIZE)).alias("p"))
    head, control = number(F.col("p"), 0, 4), number(F.col("p"), 3, 1)
    rows = rows.withColumns({"head": head, "control": F.shiftright(control, 4).bitwiseAND(F.lit(3))})
    at = F.when(F.col("control") == 1, 4).when(F.col("control") == 3, number(F.col("p"), 4, 1) + 5)
    return rows.select(
        "seq", *keep, "i", F.shiftright("head", 8).bitwiseAND(F.lit(0x1FFF)).alias("pid"), (F.shiftright("head", 22).bitwiseAND(F.lit(1)) == 1).alias("starts"), "control",
        F.col("head").bitwiseAND(F.lit(15)).alias("cc"), F.when(at < SIZE, F.substring("p", at.cast("int") + 1, F.lit(SIZE))).alias("payload"), (F.shiftright("head", 24) != SYNC).alias("malformed"),
    )


def assemble(rows: DataFrame, by: str = "pid") -> DataFrame:
    """(seq, by, run, data, first, n_packets): payloads of one pid (or what `by` names) joined from each start to the next, the number
    of its first packet and of packets with a payload; more columns of rows come from the first packet. Packets that don't begin with
    the sync byte are skipped. A group is one unit, never a stream."""
    order = Log(("seq", by), ("i",))
    numbered = rows.where("payload is not null and not malformed").withColumn("run", F.coalesce(F.sum(F.col("starts").cast("int")).over(order.so_far), F.lit(0)))
    parts = F.array_sort(F.collect_list(F.struct("i", "payload")))
    more = [F.min_by(c, "i").alias(c) for c in rows.columns if c not in (*_PACKET, "seq", by)] + ([] if by == "pid" else [F.min_by("pid", "i").alias("pid")])
    return numbered.groupBy("seq", by, "run").agg(joined(F.transform(parts, lambda x: x["payload"])).alias("data"), F.min("i").alias("first"), F.count("*").alias("n_packets"), *more)


def pes(units: DataFrame) -> DataFrame:
    """units with pts, dts and the payload of their data; rows without the start code, 19 bytes or a payload go.

    Without a decoding stamp it equals the other. A presentation stamp over a minute later is set to the decoding one.
    """
    d = F.col("data")
    rows = units.where((F.length(d) >= 19) & (number(d, 0, 3) == 1) & (F.length(d) > 9 + number(d, 8, 1)))
    flags = number(d, 7, 1)
    pts = F.when(flags >= 0x80, unpack_stamp(number(d, 9, 5)))
    dts = F.when(flags.bitwiseAND(F.lit(0x40)) > 0, unpack_stamp(number(d, 14, 5)))
    rows = rows.withColumns({"pts": pts, "dts": F.coalesce(dts, pts), "payload": F.substring(d, (number(d, 8, 1) + 10).cast("int"), F.length(d))})
    return rows.withColumn("pts", F.when(F.col("pts") - F.col("dts") > 60 * 90_000, F.col("dts")).otherwise(F.col("pts"))).drop("data")


def whole_packets(raw: np.ndarray, at: np.ndarray, skip: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The whole packets of bodies end to end (see flat), each body from skip on: a row of bytes each, its body's place, its number in it."""
    n = np.maximum(0, np.diff(at) - skip) // SIZE
    begin = at[:-1] + skip
    inside = raw if (n * SIZE == np.diff(at)).all() else raw[within(begin, begin + n * SIZE, len(raw))]
    return inside.reshape(-1, SIZE), *repeated(n)


def read_packets(cells: np.ndarray) -> tuple[np.ndarray, ...]:
    """pid, control, starts, where the payload begins, whether there is one, and whether the sync byte is right, of packets."""
    pid, control = (cells[:, 1].astype(np.int64) & 0x1F) << 8 | cells[:, 2], cells[:, 3] >> 4 & 3
    begin = np.where(control == 1, 4, np.where(control == 3, cells[:, 4].astype(np.int64) + 5, SIZE))
    return pid, control, cells[:, 1] & 0x40 > 0, np.minimum(begin, SIZE - 1), begin < SIZE, cells[:, 0] == SYNC


def tables_in(streams: DataFrame) -> DataFrame:
    """(stream, epoch, seq, at, i, pid, section) of streams (stream, epoch, seq, body): packets that hold tables, and one with i = -1 for
    each segment. at: where packets begin.

    Those are the packets of pid 0 and of pids whose first start holds no unit. One pass over the bodies, which stay in it.
    """
    names = ["stream", "epoch", "seq", "at", "i", "pid", "section"]
    kept = streams.select("stream", "epoch", "seq")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "at int, i int, pid int, section binary"])

    def found(raw: np.ndarray, at: np.ndarray):
        """(row, at, i, pid, section) of bodies end to end; the rows of segments have i = -1."""
        sizes = np.diff(at)
        # A body in step from its first byte on, with a table there, needs no search.
        byte = lambda k: np.where(sizes > k, raw[np.minimum(at[:-1] + k, len(raw) - 1)] if len(raw) else 0, 0)
        plain = (byte(0) == SYNC) & (byte(SIZE) == SYNC) & (byte(2 * SIZE) == SYNC) & ((sizes == 3 * SIZE) | (byte(3 * SIZE) == SYNC)) & (byte(1) & 0x1F == 0) & (byte(2) == 0)
        skip = np.zeros(len(sizes), np.int64)
        for r in np.flatnonzero(~plain).tolist():
            skip[r] = max(0, synced(raw[at[r] : at[r + 1]]))
        cells, row, i = whole_packets(raw, at, skip)
        pid, _, starts, begin, payload, good = read_packets(cells)
        key = row << 13 | pid
        keys, first = np.unique(key[good & payload & starts], return_index=True)
        first = np.flatnonzero(good & payload & starts)[first]
        head = np.minimum(begin[first][:, None] + np.arange(3), SIZE - 1)
        unit = (begin[first] + 3 <= SIZE) & (np.take_along_axis(cells[first], head, 1) == (0, 0, 1)).all(1)
        own = np.flatnonzero(good & payload & np.isin(key, keys[~unit | (keys & 0x1FFF == 0)]))
        # Behind its pointer field, where the packet starts a table.
        low = begin[own] + np.where(starts[own], 1 + cells[own, begin[own]].astype(np.int64), 0)
        sections = binaries(cells[own][np.arange(SIZE) >= low[:, None]], np.maximum(0, SIZE - low))
        each = np.arange(len(sizes))
        return each, skip, row[own], i[own], pid[own], sections

    def run(batches):
        for batch in batches:
            batch = batch.filter(batch.column("body").is_valid())
            raw, at = flat(batch.column("body"))
            for low, high in stretches(at):
                each, skip, row, i, pid, sections = found(raw[at[low] : at[high]], at[low : high + 1] - at[low])
                place, int32 = pa.array(low + np.concatenate([each, row])), lambda *x: pa.array(np.concatenate(x).astype(np.int32))
                pids = pa.array(np.concatenate([each, pid]).astype(np.int32), mask=np.arange(len(place)) < len(each))
                cells = [int32(skip, skip[row]), int32(each * 0 - 1, i), pids, pa.concat_arrays([pa.nulls(len(each), pa.binary()), sections])]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(place) for c in range(3)), *cells], names)

    return streams.select("stream", "epoch", "seq", "body").mapInArrow(run, schema)


def versions(streams: DataFrame) -> DataFrame:
    """(stream, seq, at, maps) of streams (stream, epoch, seq, body): the program maps that count in each segment, in order: an array of i
    (the packet that holds the map, -1 for the one in force before the segment) and map. A map is a packet of the pid that the
    latest association table names; both tables last over the segments of an epoch. Segments in which none counts are left out.

    Only table packets and a row a segment pass the windows.
    """
    order = Log(("stream", "epoch"), ("seq", "i"))
    rows = tables_in(streams).withColumn("names", F.when(F.col("pid") == 0, number(F.col("section"), 10, 2).bitwiseAND(F.lit(0x1FFF))))
    rows = rows.withColumn("in_force", F.last("names", ignorenulls=True).over(order.before)).where("i < 0 or (pid = in_force and pid > 0)")
    read = rows.withColumn("map", F.when(F.col("section").isNotNull(), program_map(map_entries(F.col("section")))))
    read = read.withColumn("map", F.last("map", ignorenulls=True).over(order.so_far)).where("map is not null")
    return read.groupBy("stream", "seq").agg(F.first("at").alias("at"), F.array_sort(F.collect_list(F.struct("i", "map"))).alias("maps"))


def demux(streams: DataFrame, stream: str | None = None, restart: str | None = None, strict: bool = False) -> DataFrame:
    """(seq, kind, codec, pid, first, pts, dts, payload, n_packets) of the elementary units of streams (seq, body).

    Each body is a segment. With `stream` (a column) the segments of a stream, in the order of seq (unique), share their tables: one without
    any is read by those before it, up to a segment where the column restart is true, which begins anew. The program map in force at a
    packet decides what it belongs to, so a stream may move to another pid at any packet. Bytes before the first packet in step are
    skipped (see tables.synced), and so are broken packets, other pids and what comes before the first map. Units end with their segment. streams is read twice: for tables, then for units. A map with a
    stream that cannot be played counts without that stream, or with strict ends the job.
    """
    key = F.col(stream) if stream else F.col("seq")
    bodies = streams.select(key.alias("stream"), "seq", "body")
    own = Log(("stream",), ("seq",))
    if restart:
        # Epochs are counted on a narrow row a segment.
        flags = streams.select(key.alias("stream"), "seq", F.coalesce(F.col(restart), F.lit(False)).cast("int").alias("flag"))
        bodies = bodies.join(flags.select("stream", "seq", F.sum("flag").over(own.so_far).alias("epoch")), ["stream", "seq"])
    else:
        bodies = bodies.withColumn("epoch", F.lit(0).cast("bigint"))
    told = bodies.join(versions(bodies), ["stream", "seq"]).select("stream", "seq", "maps", F.expr("substring(body, at + 1)").alias("body"))
    units = told.mapInArrow(unit_rows(strict), ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in told.select("stream", "seq").schema), UNITS]))
    out = ["kind", "codec", "pid", "first", "pts", "dts", "payload", "n_packets"]
    return units.select(F.col("stream").alias(stream), "seq", *out) if stream else units.select("seq", *out)


UNITS = "kind string, codec string, pid long, first int, pts long, dts long, payload binary, n_packets long"
KINDS = ("video", "audio", "id3")


def unit_rows(strict: bool) -> Callable:
    """For mapInArrow over (stream, seq, maps, body): the units (see assemble and pes) of each body under its maps, a batch in vector operations."""

    def found(raw: np.ndarray, at: np.ndarray, map_at: np.ndarray, map_i: np.ndarray, pids: list[np.ndarray], errors: pa.Array):
        """For each unit: its body, kind, map, then the columns from pid on."""
        cells, row, i = whole_packets(raw, at)
        pid, _, starts, begin, payload, good = read_packets(cells)
        # A map counts from the packet behind it on; maps lie in the order of bodies and places.
        places, place = np.repeat(np.arange(len(map_at) - 1), np.diff(map_at)) << 32 | map_i + 1, row << 32 | i + 1
        behind = np.searchsorted(places, place, "left")
        is_map = (behind < map_at[row + 1]) & (places[np.minimum(behind, len(places) - 1)] == place)
        own, known = np.maximum(behind - 1, 0), (behind > map_at[row]) & ~is_map
        if strict and len(bad := np.flatnonzero(known & np.asarray(errors.is_valid())[own])):
            raise ValueError(errors[own[bad[0]]].as_py())
        kind = np.select([pid == p[own] for p in pids], range(3), 3)
        kept = np.flatnonzero(known & (kind < 3) & payload & good)
        # A unit is the packets of a kind of a body from one start to the next.
        kept = kept[np.argsort(row[kept] << 2 | kind[kept], kind="stable")]
        group = row[kept] << 2 | kind[kept]
        head = np.flatnonzero(starts[kept] | np.concatenate([[True], group[1:] != group[:-1]])[: len(kept)])
        n = np.diff(np.append(head, len(kept)))
        data = cells[kept][np.arange(SIZE) >= begin[kept][:, None]]
        sizes = np.add.reduceat(SIZE - begin[kept], head) if len(head) else np.zeros(0, np.int64)
        low = np.cumsum(sizes) - sizes
        d = data[np.minimum(low[:, None] + np.arange(19), max(0, len(data) - 1))].astype(np.int64) if len(head) else np.zeros((0, 19), np.int64)
        whole = (sizes >= 19) & (d[:, 0] == 0) & (d[:, 1] == 0) & (d[:, 2] == 1) & (sizes > 9 + d[:, 8])
        d, low, sizes, n, top = d[whole], low[whole], sizes[whole], n[whole], kept[head[whole]]
        stamp = lambda k: (d[:, k] >> 1 & 7) << 30 | d[:, k + 1] << 22 | d[:, k + 2] >> 1 << 15 | d[:, k + 3] << 7 | d[:, k + 4] >> 1
        shown, told = d[:, 7] >= 0x80, d[:, 7] & 0x40 > 0
        pts, dts = stamp(9), np.where(told, stamp(14), stamp(9))
        pts = np.where(shown & (pts - dts > 60 * 90_000), dts, pts)
        skip = 9 + d[:, 8]
        bytes_ = binaries(data[within(low + skip, low + sizes, len(data))], sizes - skip)
        return row[top], kind[top], own[top], [pa.array(pid[top]), pa.array(i[top].astype(np.int32)), pa.array(pts, mask=~shown), pa.array(dts, mask=~(shown | told)), bytes_, pa.array(n)]

    def run(batches):
        for batch in batches:
            raw, at = flat(batch.column("body"))
            maps = batch.column("maps")
            map_at, entries = np.asarray(maps.offsets, np.int64) - maps.offsets[0].as_py(), maps.flatten()
            field = lambda name: pa.compute.struct_field(entries, ["map", name])  # noqa: B023, E731
            map_i, pids = numbers(pa.compute.struct_field(entries, ["i"])), [numbers(field(f"{k}_pid"), -1) for k in KINDS]
            errors, codecs = field("error"), pa.concat_arrays([field("video_codec"), field("audio_codec"), pa.nulls(len(entries), pa.string())])
            for low, high in stretches(at):
                a, b = map_at[low], map_at[high]
                row, kind, own, cells = found(raw[at[low] : at[high]], at[low : high + 1] - at[low], map_at[low : high + 1] - a, map_i[a:b], [p[a:b] for p in pids], errors[a:b])
                place = pa.array(low + row)
                told = [batch.column(0).take(place), batch.column(1).take(place), pa.array(KINDS).take(pa.array(kind)), codecs.take(pa.array(kind * len(entries) + a + own))]
                yield pa.RecordBatch.from_arrays([*told, *cells], ["stream", "seq", *(c.split()[0] for c in UNITS.split(", "))])

    return run


def malformed(streams: DataFrame) -> DataFrame:
    """(seq, n_packets, n_malformed) of each stream's whole packets."""
    return packets(streams).groupBy("seq").agg(F.count("*").alias("n_packets"), F.count_if("malformed").alias("n_malformed"))


def raw_audio(bodies: DataFrame) -> DataFrame:
    """(seq, i, pts, duration, data) of the frames of raw audio bodies (seq, body), each behind an optional tag: times run on from the
    tag's stamp, 0 without one, by the frame length of the first frame's rate. A body that doesn't begin with a frame has none."""
    rows = bodies.select("seq", "body", id3_size(F.col("body")).alias("head"), id3_stamp("body").alias("stamp"))
    rows = rows.withColumn("body", F.expr("substring(body, head + 1)")).withColumn("frames", adts_frames("body"))
    ticks = frame_ticks(F.get("frames", F.lit(0))["rate"])
    rows = rows.select("seq", "body", F.coalesce("stamp", F.lit(0)).alias("stamp"), ticks.alias("duration"), F.posexplode("frames").alias("i", "f"))
    data = F.substring("body", F.col("f.at") + 1, F.col("f.size"))
    return rows.select("seq", "i", (F.col("stamp") + F.col("i") * F.col("duration")).alias("pts"), "duration", data.alias("data"))
