"""Framing, muxing, boxes, fetching and the stateful stream: queries against SQL, golden vectors, round trips."""

import http.server
import io
import threading

import pytest
from pyspark.sql import functions as F

from tidemark.functions import codec, framing, tables
from tidemark.operators import muxing
from tidemark.operators.ordered import Log
from tidemark.plans import media
from tidemark.sources import boxes, fetch, packets, sinks
from tidemark.streaming import watermark

def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize("name", sorted(media.SQL))
def test_query_equals_sql(equals_sql, name):
    equals_sql(media.QUERIES, media.SQL, name)


def test_packets_of_units(spark):
    rows = [(1, 0, 400, None, False, False), (1, 1, 50, None, False, False), (1, 2, 183, None, False, False), (1, 3, 0, None, False, False), (1, 4, 184, 7200, True, True)]
    units = spark.createDataFrame([(k, o, 256, bytearray(bytes(range(200)) * 2)[:n], p, a, b) for k, o, n, p, a, b in rows], "k int, o int, pid int, data binary, pcr long, key boolean, break boolean")
    made = {r.o: [bytes(p) for p in r.packets] for r in muxing.packetize(units, Log(("k",), ("o",))).collect()}
    assert [len(made[o]) for o in range(5)] == [3, 1, 1, 1, 2] and all(len(p) == 188 and p[0] == 0x47 for v in made.values() for p in v)
    assert [p[3] & 15 for o in range(5) for p in made[o]] == list(range(8))
    assert [p[1] >> 6 & 1 for p in made[0]] == [1, 0, 0] and made[1][0][3] >> 4 == 3 and made[1][0].endswith(bytes(range(50)))
    assert made[2][0][3:5] == bytes([0x34, 0]) and made[4][0][4:6] == bytes([7, 0xD0])
    assert int.from_bytes(made[4][0][6:12], "big") >> 15 == 7200 and made[4][0][12:] + made[4][1][-8:] == (bytes(range(200)) * 2)[:184]


def test_unit_headers(spark):
    short, both = one(spark, framing.pes_unit(F.lit(0xC0), F.lit(9000), F.lit(9000), F.lit(b"abc"), F.lit(True)), framing.pes_unit(F.lit(0xE0), F.lit(9000), F.lit(3600), F.lit(b"abc"), F.lit(False)))
    assert (len(short), short[7], short[4:6].hex()) == (9 + 5 + 3, 0x80, "000b") and (len(both), both[7], both[4:6].hex()) == (9 + 10 + 3, 0xC0, "0000")
    frame = spark.createDataFrame([(0, 1, 0, both)], "seq int, pid int, run long, data binary")
    (r,) = packets.pes(frame).collect()
    assert (r.pts, r.dts, bytes(r.payload)) == (9000, 3600, b"abc")


def test_program_tables(spark):
    streams = F.array(F.struct(F.lit(0x1B).alias("type"), F.lit(256).alias("pid"), F.lit(b"").alias("descriptors")), F.struct(F.lit(15).alias("type"), F.lit(257).alias("pid"), framing.language_descriptor(F.lit("nor")).alias("descriptors")))
    pat, pmt = one(spark, framing.pat(F.lit(1), F.lit(0x1000), F.lit(0)), framing.pmt(F.lit(1), F.lit(256), streams, F.lit(3)))
    assert (len(pat), pat[2], pat[:12].hex()) == (16, 13, "00b00d0001c100000001f000") and pmt[:-4].hex() == "02b01d0001c70000e100f0001be100f0000fe101f0060a046e6f7200"


def test_audio_frames(spark):
    head = one(spark, framing.adts_header(F.lit(2), F.lit(4), F.lit(2), F.lit(100)), framing.adts_header(F.lit(2), F.lit(4), F.lit(2), F.lit(8185)))
    assert head[0][:3].hex() == "fff150" and int.from_bytes(head[0][3:6], "big") >> 5 & 0x1FFF == 107 and head[1] is None
    body = bytes(head[0]) + bytes(100)
    frame = spark.createDataFrame([(bytearray(body * 2 + b"xx"),), (bytearray(b"\xff"),), (None,)], "b binary")
    assert [r[0] and [tuple(x) for x in r[0]] for r in frame.select(framing.adts_frames("b")).collect()] == [[(0, 107, 44100), (107, 107, 44100)], [], None]
    assert one(spark, framing.frame_ticks(F.lit(48000)), framing.frame_ticks(F.lit(44100))) == (1920, 2090)


def test_nal_units(spark):
    rows = spark.createDataFrame([(bytearray(b"junk\x00\x00\x01\x65a\x00\x00\x00\x01\x41b\x00\x00\x01"), bytearray(b"\x00\x00\x00\x02\x65a\x00\x00\x00\x01\x41\x00\x00\x00\x09x"))], "a binary, l binary")
    r = rows.select(framing.annex_b("a").alias("a"), framing.length_prefixed("l", F.lit(4)).alias("l")).select("*", framing.is_key(F.col("a")).alias("key")).first()
    assert [bytes(x) for x in r.a] == [b"ea", b"Ab"] and [bytes(x) for x in r.l] == [b"ea", b"A"] and r.key
    tag = b"ID3\x04\x00\x00\x00\x00\x00\x05hello"
    got = spark.createDataFrame([(bytearray(tag + b"x"),), (bytearray(tag[:-1]),), (bytearray(b""),), (None,)], "b binary").select(framing.id3_size(F.col("b"))).collect()
    assert [x[0] for x in got] == [15, 0, 0, 0]


def test_tracks_and_broken_boxes(spark):
    def box(kind, *parts):
        body = b"".join(parts)
        return (len(body) + 8).to_bytes(4, "big") + kind + body

    def trak(n, kind, scale):
        return box(b"trak", box(b"tkhd", bytes(12), n.to_bytes(4, "big"), bytes(8)), box(b"mdia", box(b"mdhd", bytes(12), scale.to_bytes(4, "big"), bytes(8)), box(b"hdlr", bytes(8), kind, bytes(12))))

    file = box(b"ftyp", b"isom") + box(b"moov", trak(1, b"vide", 90000), trak(2, b"soun", 48000))
    frame = spark.createDataFrame([(0, bytearray(file)), (1, bytearray(file[:30])), (2, bytearray(b""))], "seq int, body binary")
    assert sorted(map(tuple, boxes.tracks(frame).collect())) == [(0, 1, "vide", 90000), (0, 2, "soun", 48000)]
    assert [(r.seq, r.path) for r in boxes.boxes(frame.where("seq > 0")).collect()] == [(1, "ftyp")]
    assert boxes.samples(frame).count() == 0


def test_urls_are_resolved_alike_with_and_without_python(spark):
    bases = ["http://h/p/a.m3u8", "https://h:8/p/q/a.m3u8?x=1#y", "http://h", "http://h/", "http://h/a/../b/c", "http://h//a/b", "HTTP://H/x", "file:///a/b", "u", "", "http://h/a;b/c", "http://h/.a/b", "http://h/a/b.c/", "http://h?x", None]
    parts = ["s.ts", "a/b.ts", "/s/t.ts", "//o/x", "http://o/z.ts", "https://o", "../x.ts", "./x", "a/../b", "x?y", "x#y", "", "a:b", ".x", "a//b", "/", "a b", "/a/./b", "http://o/a?b", "~%41.ts", "a;b", None]
    frame = spark.createDataFrame([(a, b) for a in bases for b in parts], "a string, b string")
    rows = frame.select("a", "b", fetch.resolved(F.col("a"), F.col("b")).alias("x"), fetch.resolve_url("a", "b").alias("y")).collect()
    assert [(r.a, r.b, r.x) for r in rows if r.x != r.y] == [] and sum(r.x is not None for r in rows) > 200


def test_fetch_retries_and_ranges(spark):
    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append(self.path)
            status = 404 if self.path == "/gone" else 503 if seen.count(self.path) < 3 else 200
            self.send_response(status)
            self.end_headers()
            if status == 200:
                self.wfile.write((self.headers["Range"] or "whole").encode())

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    rows = spark.createDataFrame([(f"{base}/a", None, None), (f"{base}/b", 10, 5), (f"{base}/gone", None, None), (None, None, None)], "uri string, offset long, length long")
    got = {r.uri: r for r in fetch.fetch(rows, base_ms=1).collect()}
    server.shutdown()
    a, b, gone, none = (got[x] for x in (f"{base}/a", f"{base}/b", f"{base}/gone", None))
    assert (bytes(a.body), a.status, a.attempts) == (b"whole", 200, 3) and bytes(b.body) == b"bytes=10-14" and (gone.status, gone.body, gone.attempts) == (404, None, 1) and none.error == "no uri"


def test_neighbouring_ranges_are_one_request(spark):
    seen, data = [], bytes(range(256)) * 40

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append((self.path, self.headers["Range"]))
            low, high = map(int, self.headers["Range"][6:].split("-")) if self.headers["Range"] else (0, len(data) - 1)
            self.send_response(404 if self.path == "/gone" else 206)
            self.end_headers()
            if self.path != "/gone":
                self.wfile.write(data[low : high + 1])

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    asked = [("/a", i * 100, 100) for i in range(20)] + [("/a", 150, 10), ("/a", 0, 100), ("/a", 9000, 50), ("/a", 4090, 20), ("/a", 4096, 10), ("/b", 10, 5), ("/b", None, None), ("/b", None, None), ("/gone", 0, 5), ("/gone", 5, 5), ("/a", 10_239, 100)]
    rows = spark.createDataFrame([(base + u, o, n) for u, o, n in asked] + [(None, None, None)], "uri string, offset long, length long")
    got = {(r.uri and r.uri[len(base) :], r.offset, r.length): r for r in fetch.fetch_ranges(rows, gap=50, stretch=4096, base_ms=1).collect()}
    server.shutdown()
    want = {(u, o, n): None if u == "/gone" else data if o is None else data[o : o + n] for u, o, n in asked}
    assert {k: r.body and bytes(r.body) for k, r in got.items() if k[0]} == want and got[(None, None, None)].error == "no uri"
    # Twenty ranges and one inside them together; the stretch ends at 4096; the others alone.
    assert sorted(seen, key=str) == sorted([("/a", "bytes=0-1999"), ("/a", "bytes=4090-4109"), ("/a", "bytes=4096-4105"), ("/a", "bytes=9000-9049"), ("/a", "bytes=10239-10338"), ("/b", "bytes=10-14"), ("/b", None), ("/gone", "bytes=0-9")], key=str)


def test_sinks(spark, tmp_path):
    chunks = spark.createDataFrame([("a", 2, bytearray(b"c")), ("a", 1, bytearray(b"b")), ("b", 0, bytearray(b"a")), ("b", 9, None)], "lang string, place int, body binary")
    out = io.BytesIO()
    assert sinks.pour(chunks, ["place"], out) == (3, 3) and out.getvalue() == b"abc"
    sinks.write_ordered(chunks, str(tmp_path / "o"), "lang", ["place"])
    assert spark.read.parquet(str(tmp_path / "o")).where("lang = 'a'").count() == 2


def test_stream_keeps_its_mark_between_batches(spark, tmp_path):
    # Kept: 5, 5 (same segment), not 5 (later), 3 after the reset, not 2.
    rows = [(1, 0, 0, 5, False), (1, 0, 1, 5, False), (1, 1, 0, 5, False), (1, 2, 0, 3, True), (1, 3, 0, 2, None), (1, 4, 0, 9, False), (1, 5, 0, None, True), (1, 6, 0, 1, None)]
    schema = "k int, seg int, pos int, v long, cut boolean"
    for i, part in enumerate((rows[:2], rows[2:4], rows[4:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = watermark.drain(watermark.dedup(stream, "k", "seg", ["pos"], "v", "cut"), "test")
    assert sorted((r.seg, r.pos) for r in got.collect()) == [(0, 0), (0, 1), (2, 0), (4, 0), (6, 0)]


def test_sync_search(spark):
    def packet(pid):
        return bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10]) + b"\xff" * 184

    good = packet(0) + packet(256) * 5
    cases = [(good, 0), (b"G" + good, 1), (packet(256) * 6, -1), (packet(0) * 2, 0), (packet(0), -1), (good[:-1], 0), (bytes(1200) + good, -1), (packet(0) + bytes(400), -1), (b"", -1), (b"G", -1), (None, None)]
    frame = spark.createDataFrame([(i, None if b is None else bytearray(b)) for i, (b, _) in enumerate(cases)], "i int, b binary")
    got = dict(frame.select("i", tables.sync_offset("b")).collect())
    assert [got[i] for i in range(len(cases))] == [w for _, w in cases]


def test_program_map_cases(spark):
    entry = lambda kind, pid, tail=b"": bytes([kind]) + (0xE000 | pid).to_bytes(2, "big") + (0xF000 | len(tail)).to_bytes(2, "big") + tail
    section = lambda *e: bytes([2]) + (0xB000 | 13 + len(b"".join(e))).to_bytes(2, "big") + bytes.fromhex("0001c10000e100f000") + b"".join(e) + bytes(4)
    whole = section(entry(0x1B, 5), entry(0x24, 6), entry(6, 7), entry(0x0F, 8), entry(0x87, 9))
    rows = [(0, whole), (1, section()), (2, whole[:24]), (3, b""), (4, None), (5, section(entry(6, 7, b"\x6a\x00")))]
    frame = spark.createDataFrame([(i, None if b is None else bytearray(b)) for i, b in rows], "i int, b binary").select("i", tables.map_entries("b").alias("e"))
    got = {r.i: tuple(r.m) if r.m else None for r in frame.select("i", tables.program_map(F.col("e")).alias("m")).collect()}
    none = (None,) * 6
    assert got[0] == (5, "avc", 8, "aac", None, "unsupported stream type 87") and got[2] == (5, "avc", None, None, None, None)
    assert got[1] == got[3] == got[4] == got[5] == none


def test_private_stamp_cases(spark):
    tag = lambda frames, extra=0: b"ID3\x04\x00\x00\x00\x00" + bytes([len(frames) >> 7, len(frames) & 127]) + frames[: len(frames) - extra]
    frame = lambda name, data, size=None: name + (size or len(data)).to_bytes(4, "big") + b"\x00\x00" + data
    own = frame(b"PRIV", tables.STAMP_OWNER + b"\x00" + (77).to_bytes(8, "big"))
    # A frame of 200 bytes with a plain size: read as the other kind it would end inside itself, at padding.
    cases = [(tag(own), 77), (tag(own, 1), None), (tag(frame(b"TXXX", b"x" * 5) + own), 77), (tag(bytes(20) + own), None), (tag(frame(b"PRIV", tables.STAMP_OWNER + b"\x00123")), None), (b"", None), (None, None)]
    rows = spark.createDataFrame([(i, None if b is None else bytearray(b)) for i, (b, _) in enumerate(cases)], "i int, b binary")
    got = dict(rows.select("i", tables.id3_stamp("b")).collect())
    assert [got[i] for i in range(len(cases))] == [w for _, w in cases]


def test_codec_records(spark):
    avc = bytes.fromhex("01640028ffe10002674201000168")
    esds = bytes.fromhex("00000000038080801a000100048080801240150000000000000000000000058080800411b00000")
    rows = [(0, avc, esds), (1, avc[:-1], esds[:12]), (2, b"\x02" + avc[1:], esds[:4] + b"\x09" + esds[5:]), (3, b"", b""), (4, None, None)]
    frame = spark.createDataFrame([(i, *(None if b is None else bytearray(b) for b in r)) for i, *r in rows], "i int, a binary, e binary")
    got = {r.i: r for r in frame.select("i", codec.avc_config("a").alias("a"), codec.audio_config("e").alias("e")).collect()}
    assert tuple(got[0].a)[:4] == (0x64, 0, 0x28, 4) and [bytes(x) for x in got[0].a.sps] == [b"gB"] and [bytes(x) for x in got[0].a.pps] == [b"h"]
    assert tuple(got[0].e) == (2, 3, 48000, 6)
    assert all(got[i].a.profile is None and got[i].e.rate is None for i in (1, 2, 3, 4))
