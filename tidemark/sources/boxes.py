"""Fragmented media files as tables: boxes, tracks and samples. A body is walked once, in the task that reads it."""

from __future__ import annotations

import struct
from itertools import accumulate, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tidemark.functions.codec import audio_config, avc_config
from tidemark.functions.framing import RATES, adts_header, coded_units, start_coded
from tidemark.sources.packets import number

#: Sample entries of pictures and audio; boxes that hold boxes, and the bytes before the first of these.
PICTURES, AUDIO = (b"avc1", b"avc3", b"hvc1", b"hev1"), (b"mp4a", b"enca")
HOLDERS = dict.fromkeys((b"moov", b"trak", b"mdia", b"minf", b"stbl", b"mvex", b"moof", b"traf"), 0) | {b"stsd": 8} | dict.fromkeys(PICTURES, 78) | dict.fromkeys(AUDIO, 28)
ENTRIES = "moov.trak.mdia.minf.stbl.stsd"


def walked(data: bytes, strict: bool = False) -> list[tuple[str, int, int, int, int]]:
    """Every box of a body: its dotted path, where its parent, itself and its payload begin, and where it ends.

    Size 0 reaches to the end, size 1 has 64 bits; a box that is too short or overruns ends the walk there, or with strict is an error.
    """
    found = []

    def inside(low: int, high: int, path: str, parent: int) -> None:
        while low + 8 <= high:
            size, kind, head = int.from_bytes(data[low : low + 4], "big"), data[low + 4 : low + 8], 8
            if size == 1:
                size, head = int.from_bytes(data[low + 8 : low + 16], "big"), 16
            stop = high if size == 0 else low + size
            if stop < low + head or stop > high:
                if strict:
                    raise ValueError(f"a box at {low} says {size} bytes, {high - low} are left")
                return
            name = path + kind.decode("latin-1")
            found.append((name, parent, low, low + head, stop))
            if kind in HOLDERS:
                inside(low + head + HOLDERS[kind], stop, f"{name}.", low)
            low = stop

    inside(0, len(data), "", -1)
    return found


@pandas_udf(ArrayType(StructType([StructField("path", StringType()), *(StructField(x, IntegerType()) for x in ("parent", "at", "payload", "stop"))])))
def walk(body: pd.Series) -> pd.Series:
    """What walked says of a body, as an array; null gives null."""
    return pd.Series([None if x is None else [dict(zip(("path", "parent", "at", "payload", "stop"), b, strict=True)) for b in walked(x)] for x in body])


def boxes(files: DataFrame, *paths: str) -> DataFrame:
    """(seq, path, parent, at, stop, data) of files (seq, body): the boxes of the given paths (all if none is given)."""
    rows = files.withColumn("b", F.explode(walk("body")))
    rows = rows.where(F.col("b.path").isin(*paths)) if paths else rows
    data = F.substring(F.col("body"), F.col("b.payload") + 1, F.col("b.stop") - F.col("b.payload"))
    return rows.select("seq", "b.path", "b.parent", "b.at", "b.stop", data.alias("data"))


def codecs(files: DataFrame) -> DataFrame:
    """(seq, track_id, kind, timescale, fourcc, width, height, avc, audio) of each track, by its first sample entry; kind is the
    handler's four letters.

    avc and audio are the structs of its configuration; their fields are null where the entry has none of that kind.
    A body is walked once, and boxes find their track by carrying its place forward in the order of the file.
    """
    entries = [f"{ENTRIES}.{x.decode()}" for x in (*PICTURES, *AUDIO)]
    configs = [f"{e}.{c}" for e in entries for c in ("avcC", "esds")]
    rows = boxes(files, "moov.trak", "moov.trak.tkhd", "moov.trak.mdia.mdhd", "moov.trak.mdia.hdlr", ENTRIES, *entries, *configs)
    path, at, d = F.col("path"), F.col("at"), F.col("data")
    # Holders are only placed; of the table of entries the first one's head is read.
    rows = rows.withColumn("data", F.when(path == ENTRIES, F.substring(d, 1, 96)).when(~path.isin("moov.trak", *entries), d))
    in_file = Window.partitionBy("seq").orderBy("at")
    rows = rows.withColumn("trak", F.last(F.when(path == "moov.trak", at), ignorenulls=True).over(in_file))
    own = lambda name, value: F.min_by(value, F.when(path == name, at))
    wide = lambda: F.when(number(d, 0, 1) == 1, number(d, 20, 4)).otherwise(number(d, 12, 4))
    found = rows.groupBy("seq", "trak").agg(
        own("moov.trak.tkhd", wide()).alias("track_id"), own("moov.trak.mdia.mdhd", wide()).alias("timescale"), own("moov.trak.mdia.hdlr", F.substring(d, 9, 4).cast("string")).alias("kind"),
        F.max(F.when(path == ENTRIES, d)).alias("table"), F.min(F.when(path.isin(*entries), at)).alias("entry"),
        F.min(F.when(path.isin(*configs), F.struct("at", "parent", "path", "data"))).alias("own"),
    )
    table, whole = F.col("table"), number(F.col("table"), 4, 4) > 0
    config = lambda name: F.when((F.col("own.parent") == F.col("entry")) & F.col("own.path").endswith(name), F.col("own.data"))
    picture = whole & (F.col("kind") == "vide")
    return found.select(
        "seq", "track_id", "kind", "timescale", F.when(whole, F.substring(table, 13, 4).cast("string")).alias("fourcc"), F.when(picture, number(table, 40, 2)).alias("width"),
        F.when(picture, number(table, 42, 2)).alias("height"), avc_config(config("avcC")).alias("avc"), audio_config(config("esds")).alias("audio"),
    )


def tracks(files: DataFrame) -> DataFrame:
    """(seq, track_id, kind, timescale) of each track that says all of them; kind is the handler's four letters."""
    return codecs(files).select("seq", "track_id", "kind", "timescale").where("track_id is not null and kind is not null")


def _number(data: bytes, at: int, n: int) -> int:
    return int.from_bytes(data[at : at + n], "big")


def _signed(x: int) -> int:
    return x - ((x >> 31) << 32)


def fragment_rows(data: bytes, strict: bool = False) -> list[tuple[int, list[tuple[int, int, int, int]]]]:
    """(track, rows of dts, cts, size, offset) of each track fragment of a body, from one walk.

    A sample without its own length or duration has the fragment's default, else 0. A run that says more samples than it holds ends with
    the last whole one. Runs of a fragment follow each other in time; composition offsets are signed; offsets count from the start of the body.
    """
    found, children = walked(data, strict), {}
    for path, parent, at, payload, stop in found:
        if path.startswith("moof.traf."):
            children.setdefault((path, parent), []).append((at, payload, stop))
    out = []
    for path, moof, traf, _, _ in found:
        if path != "moof.traf" or not (heads := children.get(("moof.traf.tfhd", traf))):
            continue
        low = heads[0][1]
        flags, at = _number(data, low + 1, 3), low + 8
        base = _number(data, at, 8) if flags & 0x1 else moof
        at += (8 if flags & 0x1 else 0) + (4 if flags & 0x2 else 0)
        lasts = _number(data, at, 4) if flags & 0x8 else 0
        at += 4 if flags & 0x8 else 0
        long = _number(data, at, 4) if flags & 0x10 else 0
        times = children.get(("moof.traf.tfdt", traf))
        clock = 0 if not times else _number(data, times[0][1] + 4, 8 if data[times[0][1]] == 1 else 4)
        runs = children.get(("moof.traf.trun", traf), ())
        rows = []
        for _, low, stop in runs:
            flags, n, at = _number(data, low + 1, 3), _number(data, low + 4, 4), low + 8
            begin = base + (_signed(_number(data, at, 4)) if flags & 0x1 else 0)
            at += (4 if flags & 0x1 else 0) + (4 if flags & 0x4 else 0)
            fields = [b for b in (0x100, 0x200, 0x400, 0x800) if flags & b]
            n = max(0, min(n, (stop - at) // (4 * len(fields)))) if fields else n
            cells = struct.unpack_from(f">{n * len(fields)}I", data, at) if n else ()
            of = lambda b, other: cells[fields.index(b) :: len(fields)] if b in fields else repeat(other, n)  # noqa: B023, E731
            *dts, clock = accumulate(of(0x100, lasts), initial=clock)
            *begins, _ = accumulate(of(0x200, long), initial=begin)
            rows.extend(zip(dts, map(_signed, of(0x800, 0)), of(0x200, long), begins, strict=True))
        if runs:
            out.append((_number(data, heads[0][1] + 4, 4), rows))
    return out


#: Bytes of samples that go out together.
BATCH = 4 << 20


def fragments(files: DataFrame, keep: list[str], track: str | None = None, cut: bool = False, strict: bool = False) -> DataFrame:
    """(keep, track_id, i, dts, cts, size, offset) of each sample of the fragments of files (keep, body), in the track's own ticks.

    track: a column with the only track to read. cut: adds `data`, the sample itself; one that its body doesn't hold whole is left out.
    strict: such a sample, or a broken box, ends the job. A body is walked once, in the task that reads it, and no row of a sample carries it.
    """
    kept = files.select(*keep)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "`track_id` long, `i` int, dts long, cts long, size long, offset long", *(["data binary"] if cut else [])])
    names = [*keep, "track_id", "i", "dts", "cts", "size", "offset", *(["data"] if cut else [])]

    def run(batches):
        for batch in batches:
            rows, parts, size = [], [], 0
            bodies, only = batch.column("__body"), batch.column("__track").to_pylist() if track else None

            def out():
                cells = np.array(rows, np.int64)  # noqa: B023
                own = [batch.column(i).take(pa.array(cells[:, 0])) for i in range(len(keep))]  # noqa: B023
                own += [pa.array(cells[:, 1]), pa.array(cells[:, 2].astype(np.int32)), *(pa.array(cells[:, i]) for i in range(3, 7))]
                return pa.RecordBatch.from_arrays(own + ([pa.array(parts, pa.binary())] if cut else []), names)  # noqa: B023

            for r in range(batch.num_rows):
                data = bodies[r].as_py()
                for of, cells in fragment_rows(data, strict) if data else ():
                    if only and only[r] != of:
                        continue
                    for i, x in enumerate(cells):
                        if cut:
                            *_, n, low = x
                            if low < 0 or low + n > len(data):
                                if strict:
                                    raise ValueError(f"a sample of track {of} reaches past its body")
                                continue
                            parts.append(data[low : low + n])
                            size += n
                        rows.append((r, of, i, *x))
                    size += 64 * len(cells)
                if size > BATCH and rows:
                    yield out()
                    rows, parts, size = [], [], 0
            if rows:
                yield out()

    sent = files.select(*keep, *([F.col(track).alias("__track")] if track else []), F.col("body").alias("__body"))
    return sent.mapInArrow(run, schema)


def samples(files: DataFrame) -> DataFrame:
    """(seq, track_id, i, dts, cts, size, offset) of each sample of the fragments of files (seq, body); see fragment_rows."""
    return fragments(files, ["seq"])


def first_track(tracks_: DataFrame, kind: str, on: list[str]) -> DataFrame:
    """(on, track_id, timescale) of the first track of a kind ('vide' or 'soun')."""
    top = F.min_by(F.struct("track_id", "timescale"), "track_id")
    return tracks_.where(F.col("kind") == kind).groupBy(*on).agg(top.alias("t")).select(*on, "t.track_id", "t.timescale")


def payloads(files: DataFrame, track: DataFrame, on: list[str], strict: bool = False) -> DataFrame:
    """(seq, track_id, i, dts, pts, need, data) of the samples of one track (see first_track), cut from files and in 90 kHz ticks.

    need: by how much pts falls short of dts, 0 at least; a stream's shift is the greatest so far (see ordered.running_max).
    on: what files and track share. A sample that its file doesn't hold whole is left out; see fragments for strict.
    """
    named = files.select("seq", *(c for c in on if c != "seq"), "body").join(track, on).withColumn("__only", F.col("track_id"))
    rows = fragments(named, ["seq", "timescale"], "__only", cut=True, strict=strict)
    scaled = lambda x: F.floor(x * 90_000 / F.col("timescale") + 0.5).cast("bigint")
    dts, pts = scaled(F.col("dts")), scaled(F.col("dts") + F.col("cts"))
    return rows.select("seq", "track_id", "i", dts.alias("dts"), pts.alias("pts"), F.greatest(F.lit(0), dts - pts).alias("need"), "data")


def pictures(rows: DataFrame, avc: Column, shift: Column, keep: list[str] = ("seq",)) -> DataFrame:
    """(keep, i, dts, pts, is_key, data) of rows of payloads as pictures: data between start codes, the parameter sets first in key ones, is_key, and pts moved by shift."""
    own, sets = rows.withColumn("__coded", start_coded("data", avc["length_size"])), F.concat(avc["sps"], avc["pps"])
    key, data = F.col("__coded.is_key"), F.col("__coded.data")
    coded = F.when(key, F.concat(coded_units(sets), data)).otherwise(data)
    return own.select(*keep, "i", "dts", (F.col("pts") + shift).alias("pts"), key.alias("is_key"), coded.alias("data"))


def audio_frames(rows: DataFrame, audio: Column) -> DataFrame:
    """Rows of payloads as audio frames with their headers; pts is dts. audio: the struct of the track's configuration."""
    index = F.array_position(F.array(*map(F.lit, RATES)), audio["rate"]) - 1
    head = adts_header(audio["object_type"], index, audio["channels"], F.length("data"))
    return rows.select("seq", "i", F.col("dts").alias("pts"), F.concat(head, "data").alias("data"))
