"""The transactional sink: files by key, counters, failed jobs, repeated batches."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tidemark.sources import sinks


def read(path, totals):
    return {k: b"".join((path / p).read_bytes() for p in v["parts"]) for k, v in totals.items()}


def left_in(path):
    return sorted(str(p.relative_to(path)) for p in path.rglob("*") if p.is_file()) if path.exists() else []


def test_files_and_counters_are_those_of_the_table(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "event_type", F.concat("props", F.lit("\n")).cast("binary").alias("body"), (F.col("event_id") % 7).alias("s")).repartition(7)
    told = sinks.write_files(events, str(tmp_path / "o"), "event_type", ["event_id"], seconds="s", tasks=8)
    rows = events.orderBy("event_id").collect()
    kinds = {r.event_type for r in rows}
    assert read(tmp_path / "o", told) == {k: b"".join(bytes(r.body) for r in rows if r.event_type == k) for k in kinds}
    assert {k: (v["bytes"], v["seconds"], v["chunks"]) for k, v in told.items()} == {k: (sum(len(r.body) for r in rows if r.event_type == k), sum(r.s for r in rows if r.event_type == k), sum(r.event_type == k for r in rows)) for k in kinds}
    # A file fills several parts, and nothing else is left.
    assert max(len(v["parts"]) for v in told.values()) > 1 and len(left_in(tmp_path / "o")) == 1 + sum(len(v["parts"]) for v in told.values())


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    rows = spark.range(100).select(F.lit("a/b").alias("f"), "id", F.when(F.col("id") < 99, F.lit(b"x")).otherwise(F.raise_error(F.lit("broken"))).alias("body"))
    with pytest.raises(Exception, match="broken"):
        sinks.write_files(rows, str(tmp_path / "o"), "f", ["id"])
    assert left_in(tmp_path / "o") == [] and sinks.totals(str(tmp_path / "o")) == {}
    odd = spark.createDataFrame([("a/b", 2, bytearray(b"y"), None), ("a/b", 1, bytearray(b"x"), 1.5), (None, 1, None, 2.0), ("c", None, bytearray(), 1.0)], "f string, id long, body binary, s double")
    told = sinks.write_files(odd, f"file://{tmp_path}/o", "f", ["id"], seconds="s")
    assert read(tmp_path / "o", told) == {"a/b": b"xy", "": b"", "c": b""} and {k: v["seconds"] for k, v in told.items()} == {"a/b": 1.5, "": 2.0, "c": 1.0}


def test_a_repeated_batch_is_there_once(spark, tmp_path):
    path = str(tmp_path / "o")
    for i in (1, 2):
        spark.createDataFrame([("a", [i], bytearray(b"%d" % i), 1.0)], sinks.CHUNKS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.dataSource.register(sinks.MediaFiles)
    stream = spark.readStream.schema(sinks.CHUNKS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream.writeStream.format("media_files").option("path", path).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    told = sinks.totals(path)
    assert sorted(read(tmp_path / "o", told)["a"]) == sorted(b"12") and told["a"]["seconds"] == 2.0 and len(sinks.lists(path)) == 2
    again = sinks.StreamWriter({"path": path})
    message = sinks.Written([("a", [1], "none", 1, 1.0, 1)])
    again.commit([message, None], 0)
    assert sinks.totals(path) == told
