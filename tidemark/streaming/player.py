"""A player's session as a running stream with processor state: seek, pause and resume, swap, skip to live, and the cues' mark.

What a session is at is one value in the state store, and the rows that a pause holds are a list there: they go out when it ends, in this
batch or a later one. Rows come in pieces and are dropped once they are through, so a key's batch is never held. They must arrive in
order, as a source that is partitioned by key gives them.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import asdict, dataclass, fields, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

NEW = "start bigint, epoch bigint, kept boolean, fresh boolean, swapped bigint, shown bigint"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Columns:
    """What the columns of a stream are called: `at` (when a row is shown unless it is held), length, seq (its segment), and what is null on rows
    without: seek (a target), pause (true, or false to resume), swap (a value), cue (held against the mark), tip (the newest segment there is)."""

    at: str = "at"
    length: str = "length"
    seq: str = "seq"
    seek: str = "seek"
    pause: str = "pause"
    swap: str = "swap"
    cue: str = "cue"
    tip: str = "tip"


@dataclass(frozen=True)
class Live:
    """How far behind a session may fall (seconds), how many segments before the tip it then goes on, and how long one is (0: never skips)."""

    most: int = 30
    offset: int = 3
    target: int = 0


@dataclass
class Now:
    """Where a session is: length so far, seeks so far, the last one's target, where it skipped to, whether it is paused, what was swapped
    in last, and the mark: of earlier segments, the segment at hand, and the last cue kept in it."""

    total: int = 0
    epoch: int = 0
    target: int | None = None
    skip: int | None = None
    held: bool = False
    swap: int | None = None
    mark: int | None = None
    segment: int | None = None
    last: int | None = None

    def take(self, row: dict, names: Columns, live: Live) -> dict:
        """What a row adds (NEW, without shown), and the session after it."""
        seq, cue, swapped = row[names.seq], row[names.cue], self.swap
        start = self.total
        self.total += row[names.length] or 0
        if row[names.seek] is not None:
            self.epoch, self.target = self.epoch + 1, row[names.seek]
            self.mark = self.segment = self.last = None
        tip = row[names.tip]
        if live.target and tip is not None and seq is not None and max(0, tip - seq + 1) * live.target > live.most:
            # The rows up to there go, and cues may begin anew.
            self.skip = max(seq, tip - live.offset + 1)
            self.mark = self.segment = self.last = None
        if self.skip is not None and seq is not None and seq >= self.skip and not (tip is not None and live.target and max(0, tip - seq + 1) * live.target > live.most):
            self.skip = None
        kept = (self.target is None or start >= self.target) and (self.skip is None or seq is None or seq >= self.skip)
        fresh = False
        if kept and cue is not None:
            if seq != self.segment:
                self.segment, self.mark, self.last = seq, self.mark if self.last is None else self.last, None
            fresh = self.mark is None or cue > self.mark
            self.last = cue if fresh else self.last
        if row[names.pause] is not None:
            self.held = row[names.pause]
        if row[names.swap] is not None:
            self.swap = row[names.swap]
        return {"start": start, "epoch": self.epoch, "kept": kept, "fresh": fresh, "swapped": swapped}


class Session(StatefulProcessor):
    def __init__(self, schema: StructType, names: Columns, live: Live):
        self.schema, self.names, self.live = schema, names, live

    def init(self, handle: StatefulProcessorHandle) -> None:
        kinds = {"epoch": "bigint", "held": "boolean"}
        self.now = handle.getValueState("now", ", ".join(f"{f.name} {kinds.get(f.name, 'bigint')}" for f in fields(Now)))
        self.waiting = handle.getListState("waiting", "row binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = Now(*self.now.get()) if self.now.exists() else Now()
        for piece in rows:
            plain = piece.astype(object).where(piece.notna(), None)
            held, out = [], []
            for row in plain.to_dict("records"):
                row = {k: self._typed(k, v) for k, v in row.items()}
                paused = now.held
                made = row | now.take(row, self.names, self.live)
                if paused and not now.held:
                    # What has waited, in the store and here, goes out before the row that resumes.
                    yield from self._released(held, row[self.names.at])
                    held = []
                    self.waiting.clear()
                if now.held:
                    held.append((pickle.dumps(made),))
                else:
                    out.append(made | {"shown": row[self.names.at]})
            if held:
                self.waiting.appendList(held)
            if out:
                yield self._frame(out)
        self.now.update(tuple(asdict(now).values()))

    def _released(self, held: list[tuple], at: int) -> Iterator[pd.DataFrame]:
        some = []
        for own in (self.waiting.get(), held):
            for (row,) in own:
                some.append(pickle.loads(bytes(row)) | {"shown": at})
                if len(some) == 1000:
                    yield self._frame(some)
                    some = []
        if some:
            yield self._frame(some)

    def _typed(self, name: str, value):
        kind = self.schema[name].dataType.typeName() if name in self.schema.names else ""
        return None if value is None else int(value) if kind in ("long", "integer", "short", "byte") else bool(value) if kind == "boolean" else value

    def _frame(self, rows: list[dict]) -> pd.DataFrame:
        columns = {}
        for f in self.schema:
            kind = {"long": "Int64", "integer": "Int32", "boolean": "boolean"}.get(f.dataType.typeName(), "object")
            columns[f.name] = pd.Series([r[f.name] for r in rows], dtype=kind)
        return pd.DataFrame(columns)

    def close(self) -> None:
        pass


def play(stream: DataFrame, key: str, names: Columns = Columns(), live: Live = Live()) -> DataFrame:
    """stream with NEW: start (lengths so far), epoch (seeks so far), kept (neither before the last seek's target nor before where the session
    skipped to), fresh (a kept cue above the mark of earlier segments, which a seek or a skip clears), swapped (the last swap before the row) and
    shown: when; rows of a pause go out with the row that ends it, at its time.

    Needs the state store that keeps lists (STORE), which is set for the session where it isn't.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    schema = StructType([*stream.schema.fields, *StructType.fromDDL(NEW).fields])
    return stream.groupBy(key).transformWithStateInPandas(statefulProcessor=Session(schema, replace(names), live), outputStructType=schema, outputMode="Append", timeMode="None")
