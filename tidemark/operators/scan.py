"""Ordered scans: rows of each key in order, streamed through a task with a small state carried from batch to batch.

For folds that neither a window nor an aggregate expresses. Rows are dealt by key and sorted, so a key of any size passes a
task in batches and is never held whole.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.operators.ordered import Log

#: A step sees the columns of some rows of one key, in order, and the state so far (None at first); it gives one value for
#: each row, or null, and the state after them.
Step = Callable[[dict[str, np.ndarray], tuple | None], tuple[np.ndarray, tuple]]


def scan(df: DataFrame, log: Log, read: tuple[str, ...], name: str, kind: str, step: Step) -> DataFrame:
    """df with a column `name` of type `kind` that step makes. Keys are told apart with nulls equal."""
    keys, at = log.keys, [df.columns.index(c) for c in (*log.keys, *read)]

    def run(batches):
        held, state = None, None
        for batch in batches:
            own = [np.array(batch.column(i).to_pylist(), object) for i in at[: len(keys)]]
            values = {c: batch.column(i).to_numpy(zero_copy_only=False) for c, i in zip(read, at[len(keys) :], strict=True)}
            new = np.zeros(batch.num_rows, bool)
            for k in own:
                new[1:] |= k[1:] != k[:-1]
            edges = [0, *np.flatnonzero(new).tolist(), batch.num_rows] if batch.num_rows else []
            out = []
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                key = tuple(k[low] for k in own)
                if held is None or key != held:
                    held, state = key, None
                made, state = step({c: v[low:high] for c, v in values.items()}, state)
                out.append(made)
            column = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(column, from_pandas=True)], [*batch.schema.names, name])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{name}` {kind}"])
    return df.repartition(*keys).sortWithinPartitions(*keys, *log.order).mapInArrow(run, schema)


def bucket_starts(df: DataFrame, log: Log, at: str, width: int, name: str = "bucket") -> DataFrame:
    """df with the start of each row's bucket: one begins when `at` is width or more after the start of the last one.

    `at` is a whole number that doesn't fall in the order of the log; rows without it have no bucket.
    """

    def step(values: dict[str, np.ndarray], state: tuple | None) -> tuple[np.ndarray, tuple]:
        times, start = values[at], None if state is None else state[0]
        known = np.array([x is not None and x == x for x in times], bool)
        out = np.empty(len(times), object)
        own = times[known].astype(np.int64)
        made, i = np.empty(len(own), np.int64), 0
        while i < len(own):
            if start is None or own[i] >= start + width:
                start = int(own[i])
            j = int(np.searchsorted(own, start + width, "left"))
            made[i : max(j, i + 1)] = start
            i = max(j, i + 1)
        out[known] = made
        return out, (start,)

    return scan(df, log, (at,), name, "bigint", step)


def above_last_kept(df: DataFrame, log: Log, value: str, epoch: str, segment: str, name: str = "kept") -> DataFrame:
    """df with whether a row's value is above the mark: the value of the last row kept in the last segment, of the same
    epoch, that kept any. Rows of a segment are held against earlier ones only. A null value is not kept."""

    def step(values: dict[str, np.ndarray], state: tuple | None) -> tuple[np.ndarray, tuple]:
        v, e, s = values[value], values[epoch], values[segment]
        # (epoch, segment, mark of earlier segments, last kept of this one)
        at, part, mark, last = state or (None, None, None, None)
        out = np.zeros(len(v), bool)
        for i in range(len(v)):
            if e[i] != at:
                at, part, mark, last = e[i], s[i], None, None
            elif s[i] != part:
                part, mark, last = s[i], mark if last is None else last, None
            if v[i] is not None and v[i] == v[i] and (mark is None or v[i] > mark):
                out[i], last = True, v[i]
        return out, (at, part, mark, last)

    return scan(df, log, (value, epoch, segment), name, "boolean", step)
