"""Cues joined to segments of a running stream: the same as the batch lookup, and state that doesn't grow."""

import random

from pyspark.sql import functions as F

from tests.conftest import plain
from tidemark.operators import lookup
from tidemark.streaming import drain

SEGMENT, CUE = "k string, seq long, start long, end long", "k string, cue long, pts long"


def test_cues_go_with_the_segment_of_their_time(spark, tmp_path):
    r = random.Random(2)
    segments, cues, n = [], [], 0
    for batch in range(6):
        # Six-second segments of two streams; cues come in any order within a batch, some before their segment.
        own = [(k, batch * 10 + i, (batch * 10 + i) * 540_000, (batch * 10 + i + 1) * 540_000) for k in "ab" for i in range(10)]
        said = [(r.choice("abc"), n + i, r.randrange(batch * 5_400_000, (batch + 1) * 5_400_000)) for i in range(60)]
        n += 60
        segments.append(own)
        cues.append(said)
    for i in range(6):
        spark.createDataFrame(r.sample(segments[i], len(segments[i])), SEGMENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "segments"))
        spark.createDataFrame(cues[i], CUE).coalesce(1).write.mode("append").parquet(str(tmp_path / "cues"))
    stream = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    met = drain.drained(stream("segments", SEGMENT), stream("cues", CUE), "k", most=600_000, late=900_000)
    query = met.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("k", "cue", "seq")
    left, right = spark.createDataFrame([x for b in cues for x in b], CUE), spark.createDataFrame([x for b in segments for x in b], SEGMENT)
    want = lookup.as_of(left, right, ["k"], "pts", "start", ["seq"]).where("seq is not null").select("k", "cue", "seq")
    assert plain(got.collect()) == plain(want.collect()) and want.count() > 200
    kept = [sum(op.numRowsTotal for op in p.stateOperators) for p in query.recentProgress if p.stateOperators]
    # 80 rows come with a batch; what is kept stays about that.
    assert len(kept) >= 6 and max(kept) < 200 and kept[-1] <= 120
    assert got.where(F.col("k") == "c").count() == 0
