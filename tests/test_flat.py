"""Bytes read and made in batches: the same as value by value, whatever the stretches; samples are read once."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from tests.test_players import av
from tidemark.functions import flat, framing
from tidemark.functions import scalars as S
from tidemark.operators import muxing
from tidemark.operators.ordered import Log
from tidemark.sources import packets


def bodies():
    """Values that are full of start codes, zeros and small lengths; null, empty and cut ones among them."""
    some = random.Random(7)
    return [None, b"", b"\x00", b"\x00\x00\x01", b"\x00\x00\x01\x65"] + [bytes(some.choice((0, 0, 0, 1, 2, 5, 0x65, 0x41)) for _ in range(some.randrange(40))) for _ in range(300)]


def test_start_codes_in_batches_equal_single_values(spark, monkeypatch):
    values, sets = bodies(), F.array(F.lit(b"\x67s"))
    for size in (1, 2, 4):
        rows = spark.createDataFrame([(i, None if v is None else bytearray(v), size) for i, v in enumerate(values)], "i int, v binary, n int")
        nals = rows.withColumn("u", framing.length_prefixed("v", "n")).withColumn("a", framing.annex_b("v"))
        want = nals.select("i", framing.is_key(F.col("u")), framing.coded_units(F.col("u")), framing.to_annex_b(F.col("u"), sets), framing.is_key(F.col("a"))).orderBy("i").collect()
        got = rows.withColumn("c", framing.start_coded("v", "n")).select("i", "c.is_key", "c.data", framing.key_picture("v")).orderBy("i").collect()
        assert [(w[0], w[1], w[2], w[4]) for w in want] == [tuple(g) for g in got]
        monkeypatch.setattr(flat, "STRETCH", 64)
        small = framing.start_coded.func(pa.array(values, pa.binary()), pa.array([size] * len(values), pa.int32()))
        monkeypatch.undo()
        assert [x["data"] for x in small.to_pylist()] == [g[2] and bytes(g[2]) if g[2] is not None else None for g in got]


def test_short_checksum(spark):
    values = [random.Random(n).randbytes(n) for n in range(40)]
    rows = spark.createDataFrame([(bytearray(v),) for v in values] + [(None,)], "v binary").select("v", S.crc32_mpeg2_short(F.col("v")).alias("c")).collect()
    assert all(r.c == (None if r.v is None else S.crc32_mpeg2_of(bytes(r.v))) for r in rows)


def test_streams_in_small_stretches(spark, monkeypatch):
    muxed = muxing.streams_of(muxing.mux(av(spark), Log(("k",), ("o",)), "part"), ["part"])
    streams = [bytes(r.body) for r in muxed.orderBy("part").collect()] + [b"", b"x" * 100]
    maps = pa.array([[{"i": 1, "map": {"video_pid": 256, "video_codec": "avc", "audio_pid": 257, "audio_codec": "aac", "id3_pid": None, "error": None}}]] * len(streams))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(streams))), pa.array(range(len(streams))), maps, pa.array(streams)], ["stream", "seq", "maps", "body"])
    read = lambda: [r for b in packets.unit_rows(False)(iter([batch])) for r in b.to_pylist()]
    whole = read()
    monkeypatch.setattr(flat, "STRETCH", 500)
    assert read() == whole and [(r["seq"], r["kind"], r["first"], len(r["payload"])) for r in whole] == [
        (0, "video", 2, 300), (0, "video", 6, 300), (0, "audio", 4, 50), (0, "audio", 8, 50), (1, "video", 2, 300), (1, "video", 5, 300), (1, "audio", 4, 50), (1, "audio", 7, 50),
    ]


def test_mux_reads_samples_once_and_demux_groups_no_packets(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    muxed = muxing.mux(av(spark), Log(("k",), ("o",)), "part")
    assert plan(muxed).count("Scan ExistingRDD") == 1
    assert "collect_list(struct(i, i, payload" not in plan(packets.demux(muxing.streams_of(muxed, ["part"]).withColumnRenamed("part", "seq")))
