"""Rendition choice, lookups, estimates, muxing, demuxing, scans and sessions: queries against SQL, and cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import framing
from tidemark.functions import scalars as S
from tidemark.operators import lookup, muxing, ordered, renditions, scan, selection
from tidemark.operators.ordered import Log
from tidemark.plans import players
from tidemark.sources import boxes, fetch, packets
from tidemark.streaming import session, watermark


@pytest.mark.parametrize("name", sorted(players.SQL))
def test_query_equals_sql(equals_sql, name):
    equals_sql(players.QUERIES, players.SQL, name)


def test_reanchor_rounds_half_as_sql(spark, tmp_path):
    import duckdb

    # User 1's position is 2.5, which is 2: inside the first segment of user 0, that ends at 3.
    rows = [(0, 0, 0.03), (1, 0, 0.05), (2, 1, 0.05)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").selectExpr("event_id", "timestamp_micros(event_id) as ts", "user_id", "'view' as event_type", "value").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = players.QUERIES["switch_reanchor"](spark, str(tmp_path)).orderBy("user_id").collect()
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(f"select user_id, rendition_seq, video_seq from ({players.SQL['switch_reanchor']}) order by user_id").fetchall()
    assert [tuple(r) for r in got] == want and want[1] == (1, 0, 0)


RENDITIONS = "key int, pos int, group_id string, name string, language string, is_default boolean, channels string, uri string"


def rows_of(spark, *rows):
    """(group, name, language, default, channels, uri) in this order."""
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], RENDITIONS)


def test_wanted_names_and_groups(spark):
    rows = rows_of(spark, ("a", "English", "en", False, "2", "u0"), ("a", "Eng 2", "EN", True, "2", "u1"), ("b", "English", "en", False, "1", "u2"), ("b", "Deutsch", "de", False, "1", "u3"), ("c", "Norsk", None, False, None, "u4"), ("c", "x", "en", True, None, None))
    got = lambda df: sorted((r.lang, r.group_id, r.pos) for r in df.collect())
    assert got(renditions.language_groups(rows, ["EN"])) == [("en", "a", 1), ("en", "b", 2)]
    assert got(renditions.language_groups(rows, ["norsk"])) == [("norsk", "c", 4)]
    assert got(renditions.language_groups(rows)) == [("de", "b", 3), ("en", "a", 1), ("en", "b", 2), ("norsk", "c", 4)]
    starts = lambda g: spark.createDataFrame([(1, g)], "key int, start_group string")
    first = lambda *a, **k: renditions.initial_group(*a, **k).first().group_id
    assert first(rows, starts("c"), ["en"]) == "a" and first(rows, starts("b"), ["en"]) == "b" and first(rows, starts(None)) == "b" and first(rows, starts("a"), None, pinned="zz") == "zz"
    assert got(renditions.chosen(rows)) == [("en", "a", 1)] and got(renditions.chosen(rows, None, "b")) == [("de", "b", 3), ("en", "b", 2)] and got(renditions.chosen(rows, ["xx"])) == []


def test_inline_groups(spark):
    rows = rows_of(spark, ("m", "A", "en", False, "1", "u"), ("m", "B", "de", False, "1", "u"), ("s", "A", "en", False, "2", "u"), ("n", "A", "en", False, None, "u"))
    pick = lambda df: tuple(df.select("group_id", "langs").first())
    assert pick(renditions.inline_audio_group(rows)) == ("s", 1) and pick(renditions.inline_audio_group(rows, allow_mono=True)) == ("m", 2)
    assert pick(renditions.inline_audio_group(rows.where("group_id = 'm'"))) == ("m", 2)
    starts = spark.createDataFrame([(1, "n")], "key int, start_group string")
    assert pick(renditions.inline_subtitle_group(rows.where("group_id <> 'm'"), starts)) == ("n", 1) and pick(renditions.inline_subtitle_group(rows, starts)) == ("m", 2)


def test_lookups_by_number_and_time(spark):
    segments = spark.createDataFrame([(1, 7, 0.0, 6.0), (1, 8, 6.0, 6.0)], "k int, seq int, start double, d double")
    probes = spark.createDataFrame([(1, 7), (1, 9), (2, 7)], "k int, seq int")
    assert {(r.k, r.seq): r.d for r in lookup.by_sequence(probes, segments, ["k"], "seq", ["d"]).collect()} == {(1, 7): 6.0, (1, 9): None, (2, 7): None}
    at = spark.createDataFrame([(1, 6.5, 3), (1, 99.0, 4)], "k int, t double, seq int")
    found = lambda **k: sorted((r.t, r.seq) for r in lookup.reanchor(at, segments, ["k"], "t", "start", "d", "seq", **k).collect())
    assert found() == [(6.5, 8), (99.0, 8)] and found(past_end="same") == [(6.5, 8), (99.0, 4)]
    fetched = spark.createDataFrame([("k1", None, bytearray(b"x\xff")), ("k2", "http://z/", bytearray(b"y")), ("k3", None, None)], "uri string, final_uri string, body binary")
    rows = spark.createDataFrame([(1, "k1"), (2, "k3"), (3, None)], "i int, init_uri string")
    assert {r.i: r.init and bytes(r.init) for r in lookup.by_uri(rows, fetch.bodies(fetched), "init_uri", "init").collect()} == {1: b"x\xff", 2: None, 3: None}
    assert sorted(map(tuple, fetch.texts(fetched).collect())) == [("http://z/", "y"), ("k1", "x\ufffd")]


def test_estimates_before_and_after_samples(spark):
    rows = spark.createDataFrame([("a", 1, 1000, 125_000, None), ("b", 1, 0, 0, 2000), ("c", 1, None, None, None)], "k string, i int, ms int, size int, ttfb int")
    got = {r.k: r for r in ordered.bandwidth(rows, Log(("k",), ("i",)), F.col("ms"), F.col("size"), F.col("ttfb")).collect()}
    assert got["a"].estimate == pytest.approx(1e6) and got["a"].ttfb == 100.0 and got["b"].estimate == 0 and got["b"].ttfb == pytest.approx(2000)
    assert not got["c"].can_estimate and (got["c"].estimate, got["c"].ttfb) == (500_000.0, 100.0)


def test_long_logs_fold_in_chunks(spark):
    values = [(0, i, (i * 37 % 100 + 50) / 1000, float(i * 7919 % 1000)) for i in range(1500)]
    frame = spark.createDataFrame(values, "k int, i int, w double, v double")
    want = []
    for h in (3.0, 9.0):
        a, e, total = 0.5 ** (1 / h), 0.0, 0.0
        for _, _, w, v in values:
            e, total = v * (1 - a**w) + a**w * e, total + w
        want.append(e / (1 - a**total))
    assert ordered.ewma_of(frame, Log(("k",), ("i",)), (3.0, 9.0), F.col("w"), F.col("v")).first().means == pytest.approx(want)


def test_live_and_ended_lists(spark):
    lag, buffer, skip = selection.live_state(F.col("tip"), F.col("cur"), 6, 12, 30, 3, since=F.col("since"), live=F.col("live"))
    rows = spark.createDataFrame([(10, 10, 2.0, True), (10, 4, 99.0, True), (10, 1, 0.0, True), (10, 1, 0.0, False), (-1, 0, 5.0, True)], "tip int, cur int, since double, live boolean")
    assert [tuple(r) for r in rows.select(lag, buffer, skip).collect()] == [(8.0, 4.0, None), (48.0, 0.0, 8), (60.0, 0.0, 8), (0.0, 30.0, None), (0.0, 12.0, None)]
    cursor = selection.initial_cursor(F.col("a"), F.col("b"), F.col("live"))
    assert [r[0] for r in spark.createDataFrame([(3, 20, True), (18, 20, True), (3, 20, False)], "a int, b int, live boolean").select(cursor).collect()] == [15, 18, 3]


def test_scans_carry_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = spark.createDataFrame([(k, t) for k in ("a", None) for t in (0, 4, 9, 10, 11, 25, 26)] + [("b", None), ("b", 3)], "k string, t long")
        got = scan.bucket_starts(rows, Log(("k",), ("t",)), "t", 10)
        assert [r.bucket for r in got.where("k = 'a'").orderBy("t").collect()] == [0, 0, 0, 10, 10, 25, 25]
        assert [r.bucket for r in got.where("k is null").orderBy("t").collect()] == [0, 0, 0, 10, 10, 25, 25] and [r.bucket for r in got.where("k = 'b'").orderBy("t").collect()] == [None, 3]
        # Kept: 5, then 3 (same segment); 4 above the last kept, though not above the greatest; not 4 again; 1 in the next epoch.
        cues = spark.createDataFrame([(1, i, *x) for i, x in enumerate([(0, 0, 5), (0, 0, 3), (0, 1, 4), (0, 2, 4), (0, 2, None), (1, 2, 1)])], "k int, i int, e int, s int, v int")
        assert [r.i for r in scan.above_last_kept(cues, Log(("k",), ("i",)), "v", "e", "s").where("kept").orderBy("i").collect()] == [0, 1, 2, 5]
        assert scan.bucket_starts(rows.limit(0), Log(("k",), ("t",)), "t", 10).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_counter_over_stretches(spark):
    rows = spark.createDataFrame([("a", i) for i in range(40)] + [("b", 5)], "k string, i int")
    got = {(r.k, r.i): r.cc for r in ordered.counter(rows, Log(("k",), ("i",)), "cc", 16, F.floor(F.col("i") / 7)).collect()}
    assert got == {("a", i): i % 16 for i in range(40)} | {("b", 5): 0}


SAMPLES = "k int, part int, o int, kind string, rank int, pid int, type int, language string, pts long, dts long, data binary, is_key boolean"


def av(spark):
    made = [(1, part, o, "video", 0, 256, 0x1B, None, 9000 * o + 3600, 9000 * o, bytearray([o]) * 300, o == 0) for part in (0, 1) for o in range(2)]
    made += [(1, part, o, "audio", 1, 257, 0x0F, "eng", 9000 * o, None, bytearray([64 + o]) * 50, None) for part in (0, 1) for o in range(2)]
    return spark.createDataFrame(made + [(1, 0, 9, "text", 2, 272, 6, "de", 100, None, bytearray(b"hello cue"), None)], SAMPLES)


def test_mux_writes_tables_clock_and_order(spark):
    versions = spark.createDataFrame([(1, 1, 3, True)], "k int, part int, version int, fresh boolean")
    rows = muxing.mux(av(spark), Log(("k",), ("o",)), "part", versions).orderBy("part", "place").collect()
    assert [(r.part, r.pid) for r in rows] == [(0, 0), (0, 0x1000), (0, 256), (0, 257), (0, 272), (0, 256), (0, 257), (1, 0), (1, 0x1000), (1, 256), (1, 257), (1, 256), (1, 257)]
    flags = [(r.part, bytes(r.packets[0])[5]) for r in rows if r.pid == 256]
    # Clock on every picture, key pictures marked, the break on the first of the fresh part.
    assert flags == [(0, 0x50), (0, 0x10), (1, 0xD0), (1, 0x10)]
    assert [bytes(r.packets[0])[3] & 15 for r in rows if r.pid == 0] == [0, 1] and bytes(rows[7].body).find(b"\xc7\x00\x00") > 0
    assert b"VTT " in bytes(rows[1].body) and b"eng" in bytes(rows[1].body) and b"VTT " not in bytes(rows[8].body)
    few = muxing.mux(av(spark), Log(("k",), ("o",)), "part", clock_at_keys=True).where("pid = 256").orderBy("part", "place").collect()
    assert [bytes(r.packets[0])[3] >> 4 for r in few] == [3, 1, 3, 1]


def test_demux_follows_the_tables(spark):
    muxed = muxing.mux(av(spark), Log(("k",), ("o",)), "part")
    bodies = muxing.streams_of(muxed, ["part"]).withColumnRenamed("part", "seq")
    rows = packets.demux(bodies).orderBy("seq", "kind", "first").collect()
    assert [(r.seq, r.kind, r.codec, r.pid, r.pts, r.dts, bytes(r.payload)) for r in rows if r.seq == 1] == [
        (1, "audio", "aac", 257, 0, 0, b"@" * 50), (1, "audio", "aac", 257, 9000, 9000, b"A" * 50), (1, "video", "avc", 256, 3600, 0, bytes(300)), (1, "video", "avc", 256, 12600, 9000, bytes([1]) * 300),
    ]
    assert {(r.seq, bytes(r.body)) for r in muxing.payload_of(packets.demux(bodies), "audio").collect()} == {(s, b"@" * 50 + b"A" * 50) for s in (0, 1)}
    # Units before the tables, and streams without them, give nothing.
    late = bodies.withColumn("body", F.expr("concat(substring(body, 377), substring(body, 1, 376))"))
    assert packets.demux(late).count() == 0 and packets.demux(bodies.withColumn("body", F.unhex(F.lit("00" * 400)))).count() == 0
    assert sorted(map(tuple, packets.malformed(spark.createDataFrame([(0, bytearray(b"G" + bytes(187) + bytes(188) + b"x"))], "seq int, body binary")).collect())) == [(0, 2, 1)]


def test_counters_begin_anew_behind_a_break(spark):
    epochs = spark.createDataFrame([(1, 0, 0), (1, 1, 1)], "k int, part int, epoch int")
    rows = muxing.mux(av(spark), Log(("k",), ("o",)), "part", epochs=epochs).orderBy("part", "place").collect()
    assert [bytes(r.packets[0])[3] & 15 for r in rows if r.pid == 0] == [0, 0] and [(r.part, bytes(r.packets[0])[3] & 15) for r in rows if r.pid == 257] == [(0, 0), (0, 1), (1, 0), (1, 1)]


def test_strict_readers_end_the_job(spark):
    from tidemark.sources import playlists

    lists = spark.createDataFrame([("u", "#EXTM3U\n#EXT-X-STREAM-INF:CODECS=x\nv.m3u8")], "uri string, text string")
    assert playlists.variants(lists).first().bitrate is None
    told = program(4096, 256, 257).replace(b"\x0f\xe1\x01", b"\x87\xe1\x01")
    streams = spark.createDataFrame([(0, bytearray(told + unit(256, b"a" * 500)))], "seq int, body binary")
    assert packets.demux(streams).count() == 1
    files = spark.createDataFrame([(0, bytearray(b"\x00\x00\x00\x0amoof"))], "seq int, body binary")
    assert boxes.fragments(files, ["seq"]).count() == 0
    for broken, said in ((playlists.variants(lists, strict=True), "BANDWIDTH"), (packets.demux(streams, strict=True), "unsupported"), (boxes.fragments(files, ["seq"], strict=True), "says 10 bytes")):
        with pytest.raises(Exception, match=said):
            broken.collect()


def packet(pid, payload, start=True, sync=0x47):
    free = 184 - len(payload)
    field = b"" if free == 0 else bytes([free - 1]) + (b"\x00" + b"\xff" * (free - 2) if free > 1 else b"")
    return bytes([sync, (0x40 if start else 0) | pid >> 8, pid & 255, 0x30 if free else 0x10]) + field + payload


def program(pmt_pid, video, audio):
    """An association table and a map."""
    entries = b"".join(bytes([kind, 0xE0 | pid >> 8, pid & 255, 0xF0, 0]) for kind, pid in ((0x1B, video), (0x0F, audio)) if pid)
    told = b"\x00\x02\xb0" + bytes([13 + len(entries)]) + b"\x00\x01\xc1\x00\x00\xe1\x00\xf0\x00" + entries + bytes(4)
    return packet(0, b"\x00\x00\xb0\x0d\x00\x01\xc1\x00\x00\x00\x01" + bytes([0xE0 | pmt_pid >> 8, pmt_pid & 255]) + bytes(4)) + packet(pmt_pid, told)


def unit(pid, data, broken=False):
    whole = b"\x00\x00\x01\xe0\x00\x00\x80\x80\x05\x21\x00\x01\x00\x01" + data
    parts = [whole[i : i + 184] for i in range(0, len(whole), 184)]
    return b"".join(packet(pid, x, i == 0, 0 if broken and i == 1 else 0x47) for i, x in enumerate(parts))


def test_demux_skips_broken_packets_and_follows_maps(spark):
    a, b, c, d = (bytes([x]) * 500 for x in b"abcd")
    segments = [
        ("s", 0, program(4096, 256, 257) + unit(256, a) + unit(256, b, broken=True) + unit(257, c), False),
        # No tables: the map of the segment before counts. The pid of the map is told again, with the pictures elsewhere.
        ("s", 1, unit(256, a) + unit(300, d) + program(5000, 300, None) + unit(300, b) + unit(256, c) + unit(257, c), None),
        ("s", 2, unit(300, c), False),
        # A packet of the former map's pid is no map any more.
        ("s", 3, program(4096, 256, None)[188:] + unit(300, d), False),
        ("s", 4, unit(300, a), True),
        ("s", 5, unit(300, a), False), ("t", 0, unit(300, a), False), ("t", 1, b"", False), ("t", 2, None, False),
    ]
    frame = spark.createDataFrame([(s, i, None if x is None else bytearray(x), f) for s, i, x, f in segments], "s string, seq int, body binary, breaks boolean")
    rows = packets.demux(frame, "s", "breaks").orderBy("seq", "first").collect()
    assert [(r.s, r.seq, r.kind, r.pid, bytes(r.payload)) for r in rows] == [
        ("s", 0, "video", 256, a), ("s", 0, "video", 256, b[:316]), ("s", 0, "audio", 257, c), ("s", 1, "video", 256, a), ("s", 1, "video", 300, b), ("s", 2, "video", 300, c), ("s", 3, "video", 300, d),
    ]
    alone = packets.demux(frame.where("s = 's'")).orderBy("seq", "first").collect()
    assert [(r.seq, r.pid, bytes(r.payload)) for r in alone] == [(0, 256, a), (0, 256, b[:316]), (0, 257, c), (1, 300, b)]


def test_inline_rows_and_silence(spark):
    rows = av(spark).where("part = 0").drop("part")
    video, audio = rows.where("kind = 'video'"), rows.where("kind = 'audio'")
    placed = muxing.inline_rows(video, [audio.withColumn("pts", F.col("pts") - 5)], ["k"], ["o"], 9000)
    assert sorted((r.kind, r.pts, r.part) for r in placed.collect()) == [("audio", -5, 0), ("audio", 8995, 0), ("video", 3600, 0), ("video", 12600, 9000)]
    assert {r.part for r in muxing.inline_rows(video.limit(0), [audio], ["k"], ["o"], 9000).collect()} == {None}
    parts = spark.createDataFrame([(1, 0, None, None, 0), (1, 1, 1000, 3840, 3), (1, 2, None, None, 0), (1, 3, 9, 0, 1)], "k int, i int, first long, span long, n long")
    got = selection.anchors(parts, Log(("k",), ("i",)), "first", "span", "n", duration=F.lit(2.0)).orderBy("i").collect()
    assert [r.anchor for r in got] == [None, 1000, None, 1000 + 3840 + 1920 + 180_000]


def test_pictures_and_audio_frames_of_fragments(spark):
    nal = lambda *units: b"".join(len(u).to_bytes(4, "big") + u for u in units)
    rows = spark.createDataFrame([(1, 1, 0, 0, 3000, 0, bytearray(nal(b"\x65a", b"\x41b"))), (1, 1, 1, 3000, 3000, 0, bytearray(nal(b"\x41c")))], "seq int, track_id long, i int, dts long, pts long, need long, data binary")
    avc = F.struct(F.lit(4).alias("length_size"), F.array(F.lit(b"\x67s")).alias("sps"), F.array(F.lit(b"\x68p")).alias("pps"))
    a, b = boxes.pictures(rows, avc, F.lit(90)).orderBy("i").collect()
    code = b"\x00\x00\x00\x01"
    assert (a.pts, a.is_key, bytes(a.data)) == (3090, True, code + b"\x67s" + code + b"\x68p" + code + b"\x65a" + code + b"\x41b") and (b.is_key, bytes(b.data)) == (False, code + b"\x41c")
    audio = F.struct(F.lit(2).alias("object_type"), F.lit(44100).alias("rate"), F.lit(2).alias("channels"))
    (f, _) = boxes.audio_frames(rows, audio).orderBy("i").collect()
    assert f.pts == 0 and bytes(f.data)[:3].hex() == "fff150" and bytes(f.data)[7:] == bytes(rows.first().data)


def test_clear_bodies_and_options(spark):
    key, iv = F.unhex(F.lit("00" * 16)), F.unhex(F.lit("01" * 16))
    coded = F.substring(F.aes_encrypt(F.lit(b"plain"), key, F.lit("CBC"), F.lit("PKCS"), iv), F.lit(17), F.lit(99))
    frame = spark.range(1).select(coded.alias("c"), key.alias("k"), iv.alias("v"))
    body = lambda method, k=F.col("k"), c=F.col("c"): tuple(frame.select(S.clear_body(F.lit(method), c, k, F.col("v")).alias("r")).select("r.*").first())
    assert body("AES-128") == (b"plain", None) and body(None)[1] is None and body("SAMPLE-AES") == (None, "unsupported method SAMPLE-AES")
    assert body("AES-128", F.lit(None).cast("binary")) == (None, "no key") and body("AES-128", c=F.lit(b"123")) == (None, "not decrypted")
    said = spark.createDataFrame([("index:3",), ("maxBitrate:9x",), ("lowest",), ("auto",), (None,), ("index:",)], "t string")
    assert [r[0] and tuple(r[0]) for r in said.select(S.quality(F.col("t"))).collect()] == [("index", 3), ("maxBitrate", 9), ("lowest", None), None, None, None]
    assert framing is not None and spark.range(1).select(S.poll_delay(F.lit(0.1)), S.poll_delay(F.lit(6.0))).first() == (500, 3000)


def test_sessions_follow_commands_between_batches(spark, tmp_path):
    rows = [(1, 0, 10, None, None, None), (1, 1, 10, 25, True, 7), (1, 2, None, None, None, None), (1, 3, 10, None, False, None), (2, 0, 5, None, None, 1)]
    schema = "k int, i int, d int, seek int, pause boolean, swap int"
    for part in (rows[:2], rows[2:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = watermark.drain(session.follow(stream, "k", ["i"], "d", "seek", "pause", "swap"), "session-test").orderBy("k", "i").collect()
    assert [(r.start, r.epoch, r.kept, r.held, r.swapped) for r in got] == [(0, 0, True, False, None), (10, 1, False, True, None), (20, 1, False, True, 7), (20, 1, False, False, 7), (0, 0, True, False, None)]


def test_output_modes(spark):
    bodies = muxing.streams_of(muxing.mux(av(spark), Log(("k",), ("o",)), "part"), ["part"]).select(F.col("part").alias("seq"), F.when(F.col("part") == 0, "ts").otherwise("fmp4").alias("format"), "body")
    parts = spark.createDataFrame([(1, bytearray(b"made"))], "seq int, body binary")
    got = lambda mode, p=None: {r.seq: bytes(r.body) for r in muxing.output(bodies, mode, p).collect()}
    raw = {r.seq: bytes(r.body) for r in bodies.collect()}
    assert got("ts") == raw and got("ts-canonical", parts) == {0: raw[0], 1: b"made"} and got("es-audio") == {0: b"@" * 50 + b"A" * 50}
    with pytest.raises(ValueError):
        muxing.output(bodies, "mp3")


def test_raw_audio_and_unit_types(spark):
    head = bytes.fromhex("fff15080") + ((100 + 7) << 5 | 0x1FFC0000).to_bytes(4, "big")[1:]
    frame = bytearray(bytes.fromhex("fff150800d7ffc") + bytes(100))
    rows = spark.createDataFrame([(0, frame + frame[:50]), (1, bytearray(b"xx") + frame), (2, bytearray()), (3, None)], "seq int, body binary")
    assert [(r.seq, r.i, r.pts, r.duration, len(r.data)) for r in packets.raw_audio(rows).collect()] == [(0, 0, 0, 2090, 107)] and len(head) == 7
    units = spark.range(1).select(framing.classified(F.array(F.lit(b"\x65x"), F.lit(b""), F.lit(b"\x41"))).alias("u")).first().u
    assert [u.type for u in units] == [5, 0, 1]
    junk = muxing.streams_of(muxing.mux(av(spark), Log(("k",), ("o",)), "part"), ["part"]).select(F.col("part").alias("seq"), F.concat(F.unhex(F.lit("0102")), "body").alias("body"))
    assert packets.demux(junk).count() == 8
