"""Builders and readers of stream framing as Column expressions: unit headers, program tables, audio frame headers, NAL units."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, StructField, StructType

from tidemark.functions.flat import binaries, flat, numbers, stretches, within
from tidemark.functions.scalars import crc32_mpeg2_short, pack_stamp

#: Sampling rates by their index in an audio frame header.
RATES = [96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350]
#: Samples of an audio frame, ticks of a second.
FRAME_SAMPLES, TICKS = 1024, 90_000
START_CODE = re.compile(b"\x00\x00\x01")


def big_endian(x: Column, n: int) -> Column:
    """The n low bytes of a number that isn't negative, most significant first."""
    return F.unhex(F.lpad(F.hex(x), 2 * n, "0"))


def joined(parts: Column) -> Column:
    """An array of binaries end to end, in time linear in their size (a fold of concat is quadratic). The casts keep all bytes."""
    return F.array_join(F.transform(parts, lambda x: x.cast("string")), "").cast("binary")


def pes_unit(stream_id: Column, pts: Column, dts: Column, payload: Column, bounded: Column, aligned: Column | None = None) -> Column:
    """A packetised unit. The decoding stamp is written only where it differs; unbounded ones (video) have length 0."""
    two = dts.isNotNull() & (dts != pts)
    stamps = F.when(two, F.concat(big_endian(pack_stamp(pts, 3), 5), big_endian(pack_stamp(dts, 1), 5))).otherwise(big_endian(pack_stamp(pts, 2), 5))
    size = F.length(stamps) + 3 + F.length(payload)
    size = F.when(bounded & (size <= 0xFFFF), size).otherwise(0)
    flags = F.when(two, 0xC0).otherwise(0x80)
    return F.concat(F.unhex(F.lit("000001")), big_endian(stream_id, 1), big_endian(size, 2), F.unhex(F.lit("80") if aligned is None else F.when(aligned, "84").otherwise("80")), big_endian(flags, 1), big_endian(F.length(stamps), 1), stamps, payload)


def section(table_id: int, number: Column, version: Column, body: Column) -> Column:
    """A program table section with its length and checksum."""
    size = F.length(body) + 9
    head = F.concat(big_endian(F.lit(table_id), 1), big_endian(size.bitwiseOR(F.lit(0xB000)), 2), big_endian(number, 2), big_endian((version % 32 * 2).bitwiseOR(F.lit(0xC1)), 1), F.unhex(F.lit("0000")))
    whole = F.concat(head, body)
    return F.concat(whole, big_endian(crc32_mpeg2_short(whole), 4))


def pat(program: Column, pmt_pid: Column, version: Column) -> Column:
    """The table that names one program's map."""
    return section(0, F.lit(1), version, F.concat(big_endian(program, 2), big_endian(pmt_pid.bitwiseOR(F.lit(0xE000)), 2)))


def language_descriptor(code: Column) -> Column:
    """ISO 639 descriptor of a code of three letters."""
    return F.concat(F.unhex(F.lit("0A04")), code.cast("binary"), F.unhex(F.lit("00")))


def registration_descriptor(code: str) -> Column:
    """Registration descriptor of a format of four letters."""
    return F.concat(F.unhex(F.lit("0504")), F.lit(code).cast("binary"))


def pointed(section: Column) -> Column:
    """A section behind a pointer field of 0, as a packet begins it."""
    return F.concat(F.unhex(F.lit("00")), section)


def pmt(program: Column, pcr_pid: Column, streams: Column, version: Column) -> Column:
    """The program map of streams, array<struct<type, pid, descriptors>>."""
    entry = lambda s: F.concat(big_endian(s["type"], 1), big_endian(s["pid"].bitwiseOR(F.lit(0xE000)), 2), big_endian(F.length(s["descriptors"]).bitwiseOR(F.lit(0xF000)), 2), s["descriptors"])
    return section(2, program, version, F.concat(big_endian(pcr_pid.bitwiseOR(F.lit(0xE000)), 2), F.unhex(F.lit("F000")), joined(F.transform(streams, entry))))


def adts_header(object_type: Column, rate_index: Column, channels: Column, payload_bytes: Column) -> Column:
    """The 7 bytes before a raw audio frame; null where the frame is longer than 13 bits can say. Channels end at 7."""
    size = payload_bytes.cast("bigint") + 7
    bits = F.lit(0xFFF1 << 40 | 0x7FF << 2)
    for value, low in ((object_type - 1, 38), (rate_index, 34), (F.least(channels, F.lit(7)), 30), (size, 13)):
        bits = bits.bitwiseOR(F.shiftleft(value.cast("bigint"), low))
    return F.when(size < 1 << 13, big_endian(bits, 7))


@pandas_udf(ArrayType(StructType([StructField(x, IntegerType()) for x in ("at", "size", "rate")])))
def adts_frames(body: pd.Series) -> pd.Series:
    """Where each frame of an audio body lies, and its rate; stops at the first broken header. Null gives null."""

    def walk(data: bytes | None) -> list[dict] | None:
        if data is None:
            return None
        at, found = 0, []
        while at + 7 <= len(data) and data[at] == 0xFF and data[at + 1] & 0xF6 == 0xF0:
            size = int.from_bytes(data[at + 3 : at + 6], "big") >> 5 & 0x1FFF
            index = data[at + 2] >> 2 & 15
            if size < 7 or at + size > len(data) or index >= len(RATES):
                break
            found.append({"at": at, "size": size, "rate": RATES[index]})
            at += size
        return found

    return pd.Series([walk(x) for x in body])


def frame_ticks(rate: Column) -> Column:
    return F.floor(FRAME_SAMPLES * TICKS / rate + 0.5).cast("bigint")


@pandas_udf(ArrayType(BinaryType()))
def annex_b(body: pd.Series) -> pd.Series:
    """The NAL units between start codes; what stands before the first and empty units are left out. Null gives null."""

    def split(data: bytes | None) -> list[bytes] | None:
        # A zero before a start code belongs to it (4-byte form) or is padding.
        return None if data is None else [n for part in START_CODE.split(data)[1:] if (n := part.rstrip(b"\x00"))]

    return pd.Series([split(x) for x in body])


@pandas_udf(ArrayType(BinaryType()))
def length_prefixed(body: pd.Series, size: pd.Series) -> pd.Series:
    """The NAL units of a sample whose units each follow their length in `size` bytes; stops at 0 or an overrun."""

    def split(data: bytes | None, width: int) -> list[bytes] | None:
        if data is None:
            return None
        at, found = 0, []
        while at + width <= len(data):
            n = int.from_bytes(data[at : at + width], "big")
            at += width
            if not n or at + n > len(data):
                break
            found.append(data[at : at + n])
            at += n
        return found

    return pd.Series([split(x, int(w)) for x, w in zip(body, size, strict=True)])


@arrow_udf(BooleanType())
def key_picture(body: pa.Array) -> pa.Array:
    """is_key of the units between start codes (see annex_b), a batch in vector operations. Null gives null."""
    raw, at = flat(body)
    found = np.zeros(len(body), bool)
    code = np.flatnonzero((raw[:-3] == 0) & (raw[1:-2] == 0) & (raw[2:-1] == 1) & (raw[3:] & 31 == 5))
    row = np.searchsorted(at, code, "right") - 1
    found[row[code + 3 < at[row + 1]]] = True
    return pa.array(found, mask=np.asarray(body.is_null()))


@arrow_udf(StructType([StructField("is_key", BooleanType()), StructField("data", BinaryType())]))
def start_coded(body: pa.Array, size: pa.Array) -> pa.Array:
    """The units of length_prefixed with 4-byte start codes end to end, and their is_key, a batch in vector operations. Null gives nulls."""
    raw, at = flat(body)
    width, keys, datas = numbers(size), np.zeros(len(body), bool), []
    for low, high in stretches(at):
        begins, ends, rows = [], [], []
        row, place = np.arange(low, high), at[low:high].copy()
        while len(row):
            # The next unit of every row that has one.
            more = place + width[row] <= at[row + 1]
            row, place = row[more], place[more]
            n = np.zeros(len(row), np.int64)
            for k in range(int(width[row].max(initial=0))):
                more = k < width[row]
                n[more] = n[more] << 8 | raw[place[more] + k]
            place = place + width[row]
            more = (n > 0) & (place + n <= at[row + 1])
            row, place, n = row[more], place[more], n[more]
            begins.append(place)
            ends.append(place + n)
            rows.append(row)
            place = place + n
        begin, end, row = (np.concatenate(x) for x in (begins, ends, rows))
        order = np.argsort(begin)
        begin, end, row = begin[order], end[order], row[order]
        keys[row[raw[begin] & 31 == 5]] = True
        to = np.cumsum(end - begin + 4)
        out = np.zeros(int(to[-1]) if len(to) else 0, np.uint8)
        out[to - (end - begin) - 1] = 1
        out[within(to - (end - begin), to, len(out))] = raw[at[low] : at[high]][within(begin - at[low], end - at[low], int(at[high] - at[low]))]
        datas.append(binaries(out, np.bincount(row - low, end - begin + 4, high - low).astype(np.int64)))
    data = pa.concat_arrays(datas) if datas else pa.array([], pa.binary())
    none = np.asarray(body.is_null()) | np.asarray(size.is_null())
    return pa.StructArray.from_arrays([pa.array(keys, mask=none), pa.compute.if_else(pa.array(none), pa.scalar(None, pa.binary()), data)], ["is_key", "data"])


def coded_units(nals: Column) -> Column:
    """Units with 4-byte start codes, end to end."""
    return joined(F.transform(nals, lambda n: F.concat(F.unhex(F.lit("00000001")), n)))


def to_annex_b(nals: Column, parameters: Column) -> Column:
    """Units with 4-byte start codes, the parameter sets first where one of them is a key picture."""
    return F.when(is_key(nals), F.concat(coded_units(parameters), coded_units(nals))).otherwise(coded_units(nals))


def nal_type(nal: Column) -> Column:
    return F.conv(F.hex(F.substring(nal, 1, 1)), 16, 10).cast("int").bitwiseAND(F.lit(31))


def is_key(nals: Column) -> Column:
    return F.exists(nals, lambda n: nal_type(n) == 5)


def id3_size(body: Column) -> Column:
    """Bytes of the tag that a body begins with, header included; 0 if there is none or it is cut short."""
    digit = lambda i: F.conv(F.hex(F.substring(body, i, 1)), 16, 10).cast("int").bitwiseAND(F.lit(127))
    size = F.shiftleft(digit(7), 21) + F.shiftleft(digit(8), 14) + F.shiftleft(digit(9), 7) + digit(10) + 10
    return F.when(F.hex(F.substring(body, 1, 3)).eqNullSafe(F.lit("494433")) & (F.length(body) >= 10) & (size <= F.length(body)), size).otherwise(0)


def classified(nals: Column) -> Column:
    """NAL units with their types: array<struct<type, data>>; an empty unit has type 0."""
    return F.transform(nals, lambda n: F.struct(F.coalesce(F.when(F.length(n) > 0, nal_type(n)), F.lit(0)).alias("type"), n.alias("data")))


def id3_prefixed(body: Column) -> Column:
    """Whether a body begins with the letters of such a tag, whole or not."""
    return F.coalesce(F.hex(F.substring(body, 1, 3)) == "494433", F.lit(False))
