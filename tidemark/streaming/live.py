"""Live playlists as a streaming source: lists that are loaded again and again while they grow, until they end.

The offset of a batch is, for each list, the media sequence from which on nothing has been given out, and whether the list has ended; it is
written to the stream's checkpoint, so a restart goes on where the last batch stopped. A row is the state of one list at one load
with the range of new segments; segments_of reads these with the library's own parser, and follow writes each
batch's segments to a folder of its own, which a repeated batch replaces.
"""

from __future__ import annotations

import json
import re
import time
import urllib.request
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tidemark.sources import playlists

LOADS = "uri string, text string, first bigint, stop bigint, ended boolean"
#: A list is loaded again after half its target duration, and half a second at least.
LEAST_WAIT, WAIT_SHARE = 0.5, 0.5
#: Lists that are loaded at the same time.
LOADERS = 32


def load(uri: str, timeout: float = 20) -> str:
    with urllib.request.urlopen(uri, timeout=timeout) as response:
        return response.read().decode("utf-8", "replace")


def number_of(text: str, tag: str, default: float) -> float:
    found = re.findall(rf"(?m)^\s*#{tag}:\s*([0-9.]+)", text)
    return float(found[-1]) if found else default


def extent(text: str) -> tuple[int, int, bool, float]:
    """(first media sequence, that behind the last segment, ended, target duration) of a list's text."""
    first = int(number_of(text, "EXT-X-MEDIA-SEQUENCE", 0))
    lines = [x.strip() for x in re.split(r"\r\n|\r|\n", text)]
    n, told = 0, False
    for line in lines:
        if line.startswith("#EXTINF:"):
            told = True
        elif line and not line.startswith("#"):
            n, told = n + told, False
    return first, first + n, "#EXT-X-ENDLIST" in lines, number_of(text, "EXT-X-TARGETDURATION", 0)


class Load(InputPartition):
    def __init__(self, rows: list[tuple]):
        self.rows = rows


class Reader(DataSourceStreamReader):
    """Loads each list when its wait is over; a list that can't be loaded is tried again the next time."""

    def __init__(self, options: dict[str, str]):
        self.uris = options["uris"].split("\n")
        self.behind = int(options.get("behind", 0))
        self.texts: dict[str, str] = {}
        self.due = dict.fromkeys(self.uris, 0.0)
        self.at: dict[str, list] | None = None

    def initialOffset(self) -> dict:
        return {uri: [-1, False] for uri in self.uris}

    def _loaded(self, uri: str) -> None:
        try:
            text = load(uri)
        except (OSError, ValueError):
            self.due[uri] = time.monotonic() + LEAST_WAIT
            return
        *_, target = extent(text)
        self.texts[uri] = text
        self.due[uri] = time.monotonic() + max(LEAST_WAIT, target * WAIT_SHARE)

    def latestOffset(self) -> dict:
        now = dict(self.at or self.initialOffset())
        due = [u for u in self.uris if self.due[u] <= time.monotonic() and not now.get(u, [0, False])[1]]
        with ThreadPoolExecutor(LOADERS) as pool:
            list(pool.map(self._loaded, due))
        for uri in self.uris:
            if uri in self.texts:
                _, stop, ended, _ = extent(self.texts[uri])
                # A list never goes back.
                before = now.get(uri, [-1, False])
                now[uri] = [max(stop, before[0]), ended or before[1]]
        self.at = now
        return now

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for uri, (stop, ended) in end.items():
            begun = start.get(uri, [-1, False])
            if [stop, ended] == begun:
                continue
            if uri not in self.texts:
                # After a restart: what the batch had is what the list still has of it.
                self._loaded(uri)
            if uri in self.texts:
                first, last, is_over, _ = extent(self.texts[uri])
                # A live list is entered some segments before its end.
                low = begun[0] if begun[0] >= 0 else first if is_over or not self.behind else max(first, last - self.behind)
                out.append(Load([(uri, self.texts[uri], low, stop, ended)]))
        return out or [Load([])]

    def read(self, partition: Load) -> Iterator[tuple]:
        yield from partition.rows


class LivePlaylists(DataSource):
    """Format live_playlists. Options: uris, one a line; behind: how many segments before its end a running list is entered (0: at its first)."""

    @classmethod
    def name(cls) -> str:
        return "live_playlists"

    def schema(self) -> str:
        return LOADS

    def streamReader(self, schema) -> Reader:
        return Reader(self.options)


def segments_of(loads: DataFrame) -> DataFrame:
    """The new media segments (see playlists.media_segments) of rows of the source; tags of earlier segments count where the list still has them."""
    found = playlists.media_segments(loads.select("uri", "text"))
    return found.join(loads.select("uri", "first", "stop"), "uri").where("media_sequence >= first and media_sequence < stop").drop("first", "stop")


def has_ended(progress: dict | None) -> bool:
    """Whether all lists of a stream's source have ended, by its last progress."""
    if not progress:
        return False
    end = progress["sources"][0]["endOffset"]
    end = json.loads(end) if isinstance(end, str) else end
    return bool(end) and all(ended for _, ended in end.values())


def follow(spark: SparkSession, uris: list[str], path: str, checkpoint: str, behind: int = 0, every: str = "500 milliseconds", seconds: float | None = None) -> bool:
    """Writes the segments of live lists to path, a folder a batch, until all lists have ended or the time is over; whether they have ended.

    A batch that is repeated after a failure replaces its folder, so each segment is there once. Segments that leave a list while nothing
    reads it are a gap.
    """
    spark.dataSource.register(LivePlaylists)
    stream = spark.readStream.format("live_playlists").option("uris", "\n".join(uris)).option("behind", behind).load()

    def put(batch: DataFrame, number: int) -> None:
        segments_of(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    def write(batch: DataFrame, number: int) -> None:
        # In a thread of its own: the stream's has little room left for the plan.
        with ThreadPoolExecutor(1) as pool:
            pool.submit(inheritable_thread_target(batch.sparkSession)(put), batch, number).result()

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
    until = None if seconds is None else time.monotonic() + seconds
    try:
        while until is None or time.monotonic() < until:
            if query.exception():
                raise query.exception()
            if has_ended(query.lastProgress and json.loads(query.lastProgress.json)):
                return True
            time.sleep(0.1)
        return False
    finally:
        query.stop()
