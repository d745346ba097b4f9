"""Queries against their SQL at the smallest size, and golden vectors for parsers and level choices."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import lookup, ordered, selection
from tidemark.plans import catalog, media, players
from tidemark.sources import cues, packets, playlists

@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(equals_sql, name):
    equals_sql(catalog.QUERIES, catalog.SQL, name)


def test_every_query_has_sql():
    assert all(set(m.QUERIES) == set(m.SQL) for m in (catalog, media, players))


MEDIA = """#EXTM3U
#EXT-X-MEDIA-SEQUENCE:7
#EXT-X-MAP:URI="init.mp4"
#EXTINF:6.0,first
#EXT-X-BYTERANGE:100@50
a.ts
#EXT-X-KEY:METHOD=AES-128,URI="k,1"
#EXTINF:6,
#EXT-X-BYTERANGE:30
a.ts
#EXT-X-DISCONTINUITY
#EXT-X-PROGRAM-DATE-TIME:2024-01-01T00:00:00Z
#EXTINF:x,
b.ts
#EXTINF:4,
c.ts"""


def test_media_segments(spark):
    rows = playlists.media_segments(spark.createDataFrame([("u", MEDIA.replace("\n", "\r\n"))], "uri string, text string")).orderBy("index").collect()
    assert [(r.media_sequence, r.segment_uri, r.duration, r.start_time_sec, r.byte_length, r.byte_offset, r.discontinuity) for r in rows] == [
        (7, "a.ts", 6.0, 0.0, 100, 50, False), (8, "a.ts", 6.0, 6.0, 30, 150, False), (9, "b.ts", 0.0, 12.0, None, None, True), (10, "c.ts", 4.0, 12.0, None, None, False),
    ]
    assert [r.init_uri for r in rows] == ["init.mp4"] * 4 and rows[0].key is None and (rows[3].key.method, rows[3].key.uri) == ("AES-128", "k,1") and rows[2].program_date_time and rows[0].title == "first"


def segments_of(spark, *lines):
    text = "\n".join(["#EXTM3U", *lines])
    return playlists.media_segments(spark.createDataFrame([("http://h/a/p.m3u8?x", text)], "uri string, text string")).orderBy("index").collect()


def test_ranges_end_with_another_resource(spark):
    inf = "#EXTINF:1,"
    rows = segments_of(spark, "#EXT-X-BYTERANGE:100@50", inf, "a.ts", inf, "b.ts", "#EXT-X-BYTERANGE:30", inf, "a.ts", "#EXT-X-BYTERANGE:9@0", inf, "c.ts", inf, "c.ts", "#EXT-X-BYTERANGE:5", inf, "d.ts", "#EXT-X-BYTERANGE:x@1", inf, "d.ts", "#EXT-X-BYTERANGE:7", inf, "d.ts")
    assert [(r.byte_length, r.byte_offset) for r in rows] == [(100, 50), (None, None), (None, None), (9, 0), (None, None), (5, 9), (None, None), (7, 14)]


def test_uris_without_a_length_are_no_segments(spark):
    rows = segments_of(spark, "x.ts", "#EXT-X-DISCONTINUITY", "#EXTINF:6abc,t", "../y.ts", "z.ts", "#EXTINF:.5e1", "http://o/z.ts", "#EXTINF:-", "w.ts")
    assert [(r.segment_uri, r.duration, r.start_time_sec, r.discontinuity, r.title) for r in rows] == [("http://h/y.ts", 6.0, 0.0, True, "t"), ("http://o/z.ts", 5.0, 6.0, False, None), ("http://h/a/w.ts", 0.0, 11.0, False, None)]
    assert segments_of(spark) == [] and playlists.media_segments(spark.createDataFrame([("u", "no magic\n#EXTINF:1,\na")], "uri string, text string")).count() == 0


def test_segments_pass_one_exchange_and_no_line_does(spark):
    frame = spark.createDataFrame([("u", MEDIA)], "uri string, text string")
    plan = playlists.media_segments(frame)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1


def test_lines_with_space_and_tails_without_a_uri(spark):
    """White space of all kinds around lines and between; tags of a stretch that come twice; what no uri follows; a list of thousands of lines without a segment."""
    text = " \r\n\t #EXT-X-MEDIA-SEQUENCE:4 \r\r \n#EXT-X-MEDIA-SEQUENCE:x\n#EXTINF:1,a \n \x0b#EXTINF:2,\n#EXT-X-BYTERANGE:9@8\n#EXT-X-BYTERANGE:7\n#EXT-X-BYTERANGE:x\n#EXT-X-DISCONTINUITY \n#EXT-X-PROGRAM-DATE-TIME:2024-01-01T00:00:00Z\n#EXT-X-PROGRAM-DATE-TIME:x\n\f one.ts \x0b\r\ntwo.ts\n#EXTINF:3\n#EXT-X-DISCONTINUITY:1\n../a b.ts\r#EXTINF:4,\n#EXT-X-KEY:METHOD=NONE\n"
    rows = segments_of(spark, text)
    assert [(r["index"], r.media_sequence, r.segment_uri, r.duration, r.start_time_sec, r.title, r.byte_length, r.byte_offset, r.discontinuity, r.key) for r in rows] == [
        (0, 4, "http://h/a/one.ts", 2.0, 0.0, "a", 9, 8, True, None), (1, 5, "http://h/a b.ts", 3.0, 2.0, None, None, None, False, None),
    ]
    assert rows[0].program_date_time is not None and rows[1].program_date_time is None
    assert segments_of(spark, *(f"v{i}.m3u8" for i in range(20_000)), *("#EXTINF:1," for _ in range(3_000))) == []
    many = segments_of(spark, *(x for i in range(3_000) for x in ("#EXTINF:1,", "#a", f"v{i}.ts")))
    assert len(many) == 3_000 and (many[-1].segment_uri, many[-1].start_time_sec) == ("http://h/a/v2999.ts", 2999.0)
    assert len(segments_of(spark, *("#b" for _ in range(20_000)), "#EXTINF:1,", *("#c" for _ in range(20_000)), "x")) == 1


def test_keys_and_playlists(spark):
    rows = segments_of(spark, '#EXT-X-KEY:METHOD=AES-128,URI="k",IV=0xABC', '#EXT-X-MAP:URI="i.mp4",BYTERANGE="10@5"', "#EXTINF:1,", "a", "#EXT-X-KEY:METHOD=NONE", '#EXT-X-MAP:X="y"', "#EXTINF:1,", "b", "#EXT-X-KEY:METHOD=OTHER", "#EXTINF:1,", "c")
    assert [(r.key.method, r.key.uri, r.key.iv and bytes(r.key.iv).hex()) for r in rows] == [("AES-128", "http://h/a/k", "0abc"), ("NONE", None, None), ("NONE", None, None)]
    assert {(r.init_uri, r.init_length, r.init_offset) for r in rows} == {("http://h/a/i.mp4", 10, 5)}
    texts = [("a", "#EXTM3U\n#EXT-X-ENDLIST"), ("b", "#EXTM3U\n#EXT-X-ENDLIST:1\n#EXT-X-PLAYLIST-TYPE: EVENT \n#EXT-X-TARGETDURATION:x"), ("c", "#EXT")]
    got = {r.uri: r for r in playlists.media_playlists(spark.createDataFrame(texts, "uri string, text string")).collect()}
    assert set(got) == {"a", "b"} and got["a"].end_list and not got["b"].end_list and got["b"].playlist_type == "EVENT" and (got["b"].target_duration, got["b"].version, got["b"].n_segments) == (0.0, 1, 0)
    flags = spark.createDataFrame([("#EXTM3U\n#EXT-X-INDEPENDENT-SEGMENTS\n#EXT-X-STREAM-INF:BANDWIDTH=1\nv",), ("#EXTM3U\n#EXTINF:1,\nv",)], "t string")
    assert [tuple(r) for r in flags.select(playlists.is_master(F.col("t")), playlists.independent(F.col("t"))).collect()] == [(True, True), (False, False)]
    assert flags.select(S.ticks(F.lit(1.5)).alias("x")).first().x == 135000


def test_master(spark):
    text = '#EXTM3U\n#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="g",NAME="A",LANGUAGE="en",DEFAULT=YES,URI="a.m3u8"\n#EXT-X-MEDIA:TYPE=AUDIO,NAME="no group"\n#EXT-X-STREAM-INF:BANDWIDTH=1\n#EXT-X-STREAM-INF:BANDWIDTH=2000,RESOLUTION=640x360,CODECS="a,b",AUDIO="g"\nv.m3u8\n'
    frame = spark.createDataFrame([("u", text)], "uri string, text string")
    (v,) = playlists.variants(frame).collect()
    assert (v.variant_uri, v.bitrate, v.width, v.height, v.codecs, v.audio_group) == ("v.m3u8", 2000, 640, 360, "a,b", "g")
    (r,) = playlists.renditions(frame).collect()
    assert (r.group_id, r.language, r.is_default, r.forced) == ("g", "en", True, False)


def test_bracket_lookup(spark):
    segments = ordered.timeline(spark.createDataFrame([(1, i, d) for i, d in enumerate((6, 6, 6, 4))], "k int, i int, d int").withColumn("d", F.col("d").cast("double")), ordered.Log(("k",), ("i",)), "d")
    probes = spark.createDataFrame([(1, t) for t in (0.0, 5.999, 6.0, 11.5, 21.99, 22.0, 1000.0, -1.0)] + [(2, 0.0)], "k int, t double")
    got = {(r.k, r.t): r.seq for r in lookup.segment_at(probes, segments, ["k"], "t", "start", "d", "seq").collect()}
    assert got == {(1, 0.0): 0, (1, 5.999): 0, (1, 6.0): 1, (1, 11.5): 1, (1, 21.99): 3, (1, 22.0): None, (1, 1000.0): None, (1, -1.0): 0, (2, 0.0): None}


def test_abandon_vectors(spark):
    cases = [(0, 1.0, 500000, 1000000, 5000.0, 100.0, -1), (4, 1.0, 0, 8000000, 200.0, None, -1), (4, 1.0, 100000, 8000000, 1000.0, 100.0, -1), (4, 2.0, 4000000, 7780000, 8000.0, 100.0, 1), (4, 2.0, 4000000, 7780000, 16000.0, 100.0, 0), (4, 10.0, 4000000, 7780000, 8000.0, 100.0, -1)]
    frame = spark.createDataFrame(cases, "l int, b double, n long, e long, t double, f double, want int")
    level = lookup.abandon_level(catalog.LADDER, *(F.col(c) for c in "lbnetf"), F.lit(10.0))
    assert all(r.got == r.want for r in frame.withColumn("got", level).collect())


def test_ewma_vector(spark):
    rows = [(0, 0.2, 40e6), (1, 0.2, 40e6), (2, 0.2, 40e6), (3, 10.0, 0.2e6)]
    frame = spark.createDataFrame([(0, *r) for r in rows], "k int, i int, d double, v double")
    assert ordered.ewma_of(frame, ordered.Log(("k",), ("i",)), (3.0, 9.0), F.col("d"), F.col("v")).first().means == pytest.approx([759473.286652489, 1691194.8549990745])


def test_cues(spark):
    bodies = [
        (0, "WEBVTT\nX-TIMESTAMP-MAP=MPEGTS:900000,LOCAL:00:00:00.000\n\nNOTE x\n\n1\n00:01.500 --> 00:04.000\nhi\nyou", None), (1, "WEBVTT\n\n00:01.000 --> 00:02.000\na", 5000000),
        (2, "WEBVTT\r\n\r\n01:00.000 --> 00:59.000\r\na", None), (3, "no magic\n\n00:01.000 --> 00:02.000\na", None),
    ]
    got = {r.seq: (r.pts, r.duration_ticks) for r in cues.cues(spark.createDataFrame(bodies, "seq int, body string, fallback_base long")).collect()}
    assert got == {0: (1035000, 225000), 1: (5090000, 90000), 2: (5400000, 0)}


def test_packets_and_pes(spark):
    header = bytes.fromhex("000001e0000080800a") + (0x2100010001 | (333333333 >> 30 & 7) << 33 | (333333333 >> 15 & 0x7FFF) << 17 | (333333333 & 0x7FFF) << 1).to_bytes(5, "big") + b"\xff" * 5
    unit = header + bytes(range(256))
    first = bytes([0x47, 0x41, 0x00, 0x10]) + unit[:184]
    rest = unit[184:]
    stuffing = 188 - 4 - 2 - len(rest)
    second = bytes([0x47, 0x01, 0x00, 0x31, stuffing + 1, 0]) + b"\xff" * stuffing + rest
    frame = spark.createDataFrame([(0, bytearray(first + second))], "seq int, body binary")
    rows = packets.packets(frame).orderBy("i").collect()
    assert [(r.pid, r.starts, r.cc, r.malformed) for r in rows] == [(256, True, 0, False), (256, False, 1, False)]
    (r,) = packets.pes(packets.assemble(packets.packets(frame))).collect()
    assert (r.pts, r.dts, bytes(r.payload)) == (333333333, 333333333, bytes(range(256)))


def test_scalars(spark):
    frame = spark.createDataFrame([("1",), ("2,JOC",), ("  6  ,/16",), ("abc",), (None,)], "c string")
    assert [r[0] for r in frame.select(selection.channels(F.col("c"))).collect()] == [1, 2, 6, None, None]
    frame = spark.createDataFrame([(b"123456789",), (b"",), (None,)], "b binary")
    assert [r[0] for r in frame.select(S.crc32_mpeg2("b")).collect()] == [0x0376E6E7, 0xFFFFFFFF, None]
    assert S.crc32_mpeg2_of(b"123456789") == 0x0376E6E7
