"""Reading what streams say of themselves: where packets begin, what a program map names, the stamp in a private tag."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

PACKET, SYNC = 188, 0x47
#: Stream types of a program map, the class and codec each stands for.
STREAM_TYPES = {
    0x03: ("audio", "mp3"), 0x04: ("audio", "mp3"), 0x0F: ("audio", "aac"), 0x15: ("id3", None), 0x1B: ("video", "avc"), 0x24: ("video", "hevc"),
    0x81: ("audio", "ac3"), 0xC1: ("audio", "ac3"), 0xCF: ("audio", "aac"), 0xDB: ("video", "avc"),
}
#: Private data, which the descriptor AC3_TAG makes audio; types that are an error.
PRIVATE, AC3_TAG, UNSUPPORTED = 0x06, 0x6A, (0x87, 0xC2)
#: Fixed value: the owner of a private frame that holds a transport stamp.
STAMP_OWNER = b"com.apple.streaming.transportStreamTimestamp"


def synced(data: bytes) -> int:
    """Where whole packets begin: sync bytes follow each other to the end of the search window and a packet has pid 0.

    Candidates are searched over 5 packets; one at 0 needs three packets in step, a later one stays in step for up to
    99 packets. -1 if there is none, or if the first candidate falls out of step.
    """
    raw = np.frombuffer(data, np.uint8)
    n = len(raw)
    window = min(5 * PACKET, n - PACKET) + 1
    # A packet is in step if the next one begins with a sync byte, or the body ends with it.
    step = np.zeros(n, bool)
    if n >= PACKET:
        step[: n - PACKET] = (raw[:-PACKET] == SYNC) & (raw[PACKET:] == SYNC)
        step[n - PACKET] = raw[n - PACKET] == SYNC
    at = 0
    while at < window:
        later = np.flatnonzero(step[at:window])
        if not len(later):
            return -1
        at += int(later[0])
        chain = step[at::PACKET]
        held = len(chain) if chain.all() else int(np.argmin(chain))
        first = at + PACKET * np.arange(held)
        tables = np.flatnonzero((raw[first + 1] & 0x1F == 0) & (raw[first + 2] == 0))
        if at:
            window = min(at + 99 * PACKET, n - PACKET) + 1
        enough = (window - at) // PACKET
        last = max(1, min(enough, 2) if at == 0 else enough)
        if len(tables) and max(last, int(tables[0])) < held:
            return at
        if held < len(chain):
            return -1
        at += 1
    return -1


@pandas_udf(IntegerType())
def sync_offset(body: pd.Series) -> pd.Series:
    """What synced says of a body; null gives null."""
    return pd.Series([None if x is None else synced(x) for x in body], dtype="Int32")


@pandas_udf(ArrayType(StructType([StructField("type", IntegerType()), StructField("pid", IntegerType()), StructField("tags", ArrayType(IntegerType()))])))
def map_entries(section: pd.Series) -> pd.Series:
    """The streams of a program map section with the tags of their descriptors; a cut section gives its whole entries."""

    def walk(data: bytes | None) -> list[dict] | None:
        if data is None:
            return None
        field = lambda at: int.from_bytes(data[at : at + 2], "big") & 0xFFF
        end, at, found = min(len(data), field(1) - 1), 12 + field(10), []
        while at + 5 <= end:
            size, tags, low = field(at + 3), [], at + 5
            # A descriptor without content at the very end names nothing.
            while low + 2 < min(at + 5 + size, len(data)):
                tags.append(data[low])
                low += 2 + data[low + 1]
            found.append({"type": data[at], "pid": int.from_bytes(data[at + 1 : at + 3], "big") & 0x1FFF, "tags": tags})
            at += 5 + size
        return found

    return pd.Series([walk(x) for x in section])


def program_map(entries: Column) -> Column:
    """struct<video_pid, video_codec, audio_pid, audio_codec, id3_pid, error> of map_entries: the first stream of each class.

    Missing ones are null. A type that cannot be played sets error and leaves the row, so one stream doesn't end a job.
    """
    typed = lambda e, pick: F.coalesce(*(F.when(e["type"] == t, F.lit(v[pick])) for t, v in STREAM_TYPES.items()), F.when((e["type"] == PRIVATE) & F.array_contains(e["tags"], AC3_TAG), F.lit(("audio", "ac3")[pick])))
    named = F.transform(entries, lambda e: F.struct(e["pid"].alias("pid"), typed(e, 0).alias("kind"), typed(e, 1).alias("codec")))
    first = lambda kind: F.get(F.filter(named, lambda e: e["kind"] == kind), F.lit(0))
    bad = F.get(F.filter(entries, lambda e: e["type"].isin(*UNSUPPORTED)), F.lit(0))
    error = F.when(bad.isNotNull(), F.concat(F.lit("unsupported stream type "), F.hex(bad["type"])))
    return F.struct(
        first("video")["pid"].alias("video_pid"), first("video")["codec"].alias("video_codec"), first("audio")["pid"].alias("audio_pid"),
        first("audio")["codec"].alias("audio_codec"), first("id3")["pid"].alias("id3_pid"), error.alias("error"),
    )


@pandas_udf(LongType())
def id3_stamp(body: pd.Series) -> pd.Series:
    """The transport stamp in the tag that a body begins with; null without a whole tag, such a frame, or in 63 bits."""

    def seven(data: bytes) -> int:
        return sum((b & 127) << 7 * (3 - i) for i, b in enumerate(data))

    def find(data: bytes | None) -> int | None:
        if data is None or len(data) < 10 or data[:3] != b"ID3" or (end := 10 + seven(data[6:10])) > len(data):
            return None
        at = 10
        while at + 10 <= end and data[at : at + 4] not in (bytes(4), b"    "):
            size, plain = seven(data[at + 4 : at + 8]), int.from_bytes(data[at + 4 : at + 8], "big")
            owner, _, value = data[at + 10 : at + 10 + size].partition(b"\x00")
            if data[at : at + 4] == b"PRIV" and owner == STAMP_OWNER and len(value) >= 8:
                stamp = int.from_bytes(value[:8], "big")
                return stamp if stamp < 1 << 63 else None
            # Older tags have plain sizes: taken where the other kind would leave the tag.
            at += 10 + (plain if at + 10 + size > end >= at + 10 + plain else size)
        return None

    return pd.Series([find(x) for x in body], dtype="Int64")
