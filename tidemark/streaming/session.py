"""A session's log under its commands, as a stateful stream: what ordered.replay says of a whole log, row by row as it arrives."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "total bigint, epoch bigint, target bigint, held boolean, swap bigint, begun boolean"
NEW = "start bigint, epoch bigint, kept boolean, held boolean, swapped bigint"


def carried(values: pd.Series, before: int | bool | None) -> tuple[np.ndarray, list]:
    """Which values there are, and the latest of them up to each row; before: what held before the first."""
    there = values.notna().to_numpy()
    place = np.maximum.accumulate(np.where(there, np.arange(len(values)), -1))
    kind = type(before) if isinstance(before, bool) else int
    return there, [before if i < 0 else kind(values.iloc[i]) for i in place.tolist()]


def follow(stream: DataFrame, key: str, order: list[str], length: str, seek: str, pause: str, swap: str) -> DataFrame:
    """stream with start (lengths so far), epoch (seeks so far), kept (not before the last seek's target), held (between a pause
    and its resume) and swapped (the last swap before the row).

    seek, pause and swap are columns of stream, null on rows without that command; a null length counts 0. Rows of a key must
    arrive in order; those of one batch are put in order here, and a batch's rows of a key are held in a task, so bound a batch
    at the source. The state of a key is six values.
    """

    def run(own: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(order, kind="stable").reset_index(drop=True)
        total, epoch, target, held, last, begun = state.get if state.exists else (0, 0, 0, False, 0, False)
        lengths = np.array([0 if x is None or x != x else int(x) for x in rows[length]], np.int64)
        ends = total + np.cumsum(lengths)
        sought, targets = carried(rows[seek], target if epoch else None)
        _, holds = carried(rows[pause], held)
        _, swaps = carried(rows[swap], last if begun else None)
        starts = ends - lengths
        kept = [t is None or bool(s >= t) for s, t in zip(starts, targets, strict=True)]
        epochs = epoch + np.cumsum(sought)
        before = [last if begun else None, *swaps[:-1]]
        out = rows.assign(start=starts, epoch=epochs, kept=kept, held=holds, swapped=pd.array(before, "Int64"))
        state.update((int(ends[-1]), int(epochs[-1]), targets[-1] or 0, holds[-1], swaps[-1] or 0, swaps[-1] is not None))
        yield out

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema), NEW])
    return stream.groupBy(key).applyInPandasWithState(run, schema, STATE, "append", GroupStateTimeout.NoTimeout)
