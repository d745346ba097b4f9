"""High-water-mark dedup as a stateful stream: the mark of each key lives in the state store between batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.sources.shared import fresh


def dedup(stream: DataFrame, key: str, segment: str, order: list[str], value: str, reset: str) -> DataFrame:
    """Rows whose value is above the mark of their key: the value of the last row kept in the last segment that kept any.

    Rows of a segment are held against the mark of earlier segments, so equal values within one segment stay. A row with
    `reset` clears the mark from its segment on. A null value is not kept. Segments must arrive in order and not be split over batches;
    rows of one batch are put in order here. A key's state is one number; its rows of one batch are held in a task, so bound a batch at the source.
    """
    names = stream.columns

    def run(own: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values([segment, *order], kind="stable")
        mark = state.get[0] if state.exists else None
        values, resets, segments = rows[value].to_numpy(), rows[reset].eq(True).to_numpy(), rows[segment].to_numpy()
        edges = [0, *(np.flatnonzero(segments[1:] != segments[:-1]) + 1).tolist(), len(rows)]
        kept = np.zeros(len(rows), bool)
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            if resets[low:high].any():
                mark = None
            known = ~pd.isna(values[low:high])
            kept[low:high] = known if mark is None else known & (np.where(known, values[low:high], mark) > mark)
            if kept[low:high].any():
                mark = values[low:high][kept[low:high]][-1]
        state.update((int(mark),))
        yield rows[kept]

    return stream.groupBy(key).applyInPandasWithState(run, stream.schema, "mark long", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over all that is there now, into a table in the folder that executors share, and reads that."""
    spark: SparkSession = stream.sparkSession
    path = fresh(spark, name)
    stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
