"""Player sessions on a stream: commands over batches and a restart, held against one pass by hand and against the batch replay."""

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import plain
from tidemark.operators import ordered
from tidemark.operators.ordered import Log
from tidemark.streaming import player

SCHEMA = "k string, i long, at long, length long, seq long, seek long, pause boolean, swap long, cue long, tip long"


def run(spark, parts, path, live=player.Live(), start=0):
    """Runs the stream over parts, a file and a batch each."""
    for i, part in enumerate(parts, start):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    query = player.play(stream, "k", live=live).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{path}/out")


def test_commands_over_batches_and_a_restart(spark, tmp_path):
    row = lambda i, seq, **more: ("a", i, 100 + i, 10, seq, *(more.get(x) for x in ("seek", "pause", "swap", "cue", "tip")))
    first = [row(0, 0, cue=5), row(1, 1, cue=5, swap=7), row(2, 1, cue=6, pause=True)]
    second = [row(3, 2, cue=7), ("b", 0, 1, 1, 0, None, True, None, None, None)]
    third = [row(4, 3, pause=False, cue=6), row(5, 4, seek=70, cue=1), row(6, 5, cue=2), row(7, 6, cue=3, tip=20), row(8, 17, cue=1, tip=20), row(9, 18, cue=1, tip=20), row(10, 19, cue=4, tip=20)]
    live = player.Live(30, 3, 6)
    got = run(spark, [first, second], str(tmp_path), live)
    # Paused rows have not gone out.
    assert sorted(r.i for r in got.collect()) == [0, 1]
    rows = {r.i: r for r in run(spark, [third], str(tmp_path), live, 2).where("k = 'a'").collect()}
    assert [(rows[i].shown, rows[i].swapped) for i in range(5)] == [(100, None), (101, None), (104, 7), (104, 7), (104, 7)]
    assert [(rows[i].start, rows[i].epoch, rows[i].kept) for i in range(4, 8)] == [(40, 0, True), (50, 1, False), (60, 1, False), (70, 1, False)]
    # 5; not 5 of the next segment but 6; 7; not 6. After the skip the mark begins anew, at 18.
    assert [rows[i].fresh for i in range(5)] == [True, False, True, True, False] and [(rows[i].kept, rows[i].fresh) for i in range(8, 11)] == [(False, False), (True, True), (True, True)]


@pytest.mark.parametrize("seed", [1, 2])
def test_any_split_gives_what_the_replay_gives(spark, tmp_path, seed):
    r = random.Random(seed)
    pick = lambda p, v: v if r.random() < p else None
    rows = [(r.choice("ab"), i, i * 10, r.randrange(9), i // 3, pick(0.1, r.randrange(200)), pick(0.3, r.random() < 0.5), pick(0.2, i), None, None) for i in range(120)]
    edges = sorted(r.sample(range(1, 120), 3))
    parts = [rows[a:b] for a, b in zip([0, *edges], [*edges, 120], strict=True)]
    got = run(spark, parts, str(tmp_path)).select("k", "i", "start", "epoch", "kept", "swapped", "shown")
    log = Log(("k",), ("i",))
    whole = ordered.timeline(spark.createDataFrame(rows, SCHEMA), log, "length")
    want = ordered.replay(whole, log, "at", "start", F.col("seek"), F.col("pause"), F.col("swap")).where("shown is not null")
    assert plain(got.collect()) == plain(want.select("k", "i", "start", "epoch", "kept", "swapped", "shown").collect())
