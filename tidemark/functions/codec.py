"""Codec configuration records of tracks as structs: parameter sets of pictures, the layout of audio."""

from __future__ import annotations

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from tidemark.functions.framing import RATES

#: Object types of audio that are read; tags of nested descriptors and the fixed bytes after their lengths.
AUDIO_OBJECTS, DESCRIPTORS = (0x40, 0x67), ((3, 3), (4, 13), (5, 0))
_AVC = ("profile", "compatibility", "level", "length_size")
_AUDIO = ("object_type", "rate_index", "rate", "channels")


@pandas_udf(StructType([*(StructField(x, IntegerType()) for x in _AVC), StructField("sps", ArrayType(BinaryType())), StructField("pps", ArrayType(BinaryType()))]))
def avc_config(data: pd.Series) -> pd.DataFrame:
    """A picture configuration; all fields are null if it is null, cut short, not of version 1 or has lengths of 3 bytes."""

    def read(d: bytes | None) -> tuple:
        none = (None,) * 6
        if d is None or len(d) < 7 or d[0] != 1 or d[4] & 3 == 2:
            return none
        at, sets, many = 6, [], d[5] & 31
        for _ in range(2):
            units = []
            for _ in range(many):
                size = int.from_bytes(d[at : at + 2], "big")
                units.append(d[at + 2 : at + 2 + size])
                at += 2 + size
            if at > len(d) or (not sets and at == len(d)):
                return none
            sets.append(units)
            many, at = (d[at], at + 1) if len(sets) == 1 else (0, at)
        return (d[1], d[2], d[3], (d[4] & 3) + 1, *sets)

    return pd.DataFrame([read(x) for x in data], columns=[*_AVC, "sps", "pps"], dtype=object)


@pandas_udf(StructType([StructField(x, IntegerType()) for x in _AUDIO]))
def audio_config(data: pd.Series) -> pd.DataFrame:
    """The audio layout inside an elementary stream descriptor; all fields are null if it is null, cut short or no AAC."""

    def inner(d: bytes) -> bytes | None:
        at = 4
        for tag, fixed in DESCRIPTORS:
            if d[at] != tag:
                return None
            at, size = at + 1, 0
            for _ in range(4):
                size, at = size << 7 | d[at] & 127, at + 1
                if d[at - 1] < 128:
                    break
            if tag == 4 and d[at] not in AUDIO_OBJECTS:
                return None
            if tag == 3:
                flags = d[at + 2]
                # Flags announce another id, an address behind its length, and a clock id.
                fixed += 2 * (flags >> 7) + (1 + d[at + 3 + 2 * (flags >> 7)] if flags & 64 else 0) + 2 * (flags >> 5 & 1)
            at += fixed
        return d[at : at + size]

    def read(d: bytes | None) -> tuple:
        try:
            config = inner(d) if d is not None else None
        except IndexError:
            config = None
        if config is None or len(config) < 2:
            return (None,) * 4
        bits = f"{int.from_bytes(config, 'big'):0{8 * len(config)}b}" + "0" * 48
        take = lambda low, n: int(bits[low : low + n], 2)
        kind, at = (32 + take(5, 6), 11) if take(0, 5) == 31 else (take(0, 5), 5)
        index, at = take(at, 4), at + 4
        rate, at = (take(at, 24), at + 24) if index == 15 else (RATES[index] if index < len(RATES) else 0, at)
        return kind, index, rate, take(at, 4)

    return pd.DataFrame([read(x) for x in data], columns=list(_AUDIO), dtype="Int32")
