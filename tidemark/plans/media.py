"""Queries of framing, muxing, boxes and the stateful stream, each over bytes that Spark builds from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import framing, tables
from tidemark.functions.scalars import crc32_mpeg2
from tidemark.operators import muxing, ordered
from tidemark.operators.ordered import Log
from tidemark.plans.catalog import USER
from tidemark.plans.registry import is_type, log, registry, table
from tidemark.sources import boxes, fetch, packets
from tidemark.streaming import watermark

QUERIES, SQL, query = registry()


@query("""select doc_id, (doc_id * 3600)::bigint as pts, ceil((octet_length(encode(text)) + 14) / 184.0)::bigint as n_packets, sha256(text) as payload_sha256 from documents where octet_length(encode(text)) >= 5""")
def ts_roundtrip(spark, sf_dir):
    text = F.col("text").cast("binary")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), text.alias("text")).where("text is not null")
    pts = F.col("seq") * 3600
    data = framing.pes_unit(F.lit(0xE0), pts, pts, F.col("text"), F.lit(False))
    units = docs.select("seq", F.lit(256).alias("pid"), data.alias("data"), F.lit(None).cast("bigint").alias("pcr"), F.lit(False).alias("key"), F.lit(False).alias("break"))
    streams = muxing.packetize(units, Log(("seq",), ("pid",))).select("seq", "body")
    found = packets.pes(packets.assemble(packets.packets(streams)))
    return found.select(F.col("seq").alias("doc_id"), "pts", "n_packets", F.sha2("payload", 256).alias("payload_sha256"))


@query("""select doc_id, i::bigint as i, (least(1000, n - i * 1000) + 7)::bigint as size, (doc_id * 3600 + i * 1920)::bigint as pts from (select doc_id, octet_length(encode(text)) as n, unnest(range(0, (octet_length(encode(text)) + 999) // 1000)) as i from documents)""")
def adts_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("b")).where("length(b) > 0")
    part = lambda i: F.substring(F.col("b"), i * 1000 + 1, F.lit(1000))
    frame = lambda i: F.concat(framing.adts_header(F.lit(2), F.lit(3), F.lit(2), F.length(part(i))), part(i))
    bodies = docs.select("doc_id", framing.joined(F.transform(F.sequence(F.lit(0), ((F.length("b") - 1) / 1000).cast("int")), frame)).alias("body"))
    frames = bodies.select("doc_id", F.posexplode(framing.adts_frames("body")).alias("i", "f"))
    i = F.col("i").cast("bigint")
    return frames.select("doc_id", i.alias("i"), F.col("f.size").cast("bigint").alias("size"), (F.col("doc_id") * 3600 + i * framing.frame_ticks(F.col("f.rate"))).alias("pts"))


@query("""select doc_id, len(w) + case when k then 2 else 0 end as n, k as is_key from (select doc_id, w, len(list_filter(w, lambda x: list_contains(['05', '25', '45', '65', '85', 'A5', 'C5', 'E5'], hex(encode(x))[1:2]))) > 0 as k
from (select doc_id, list_filter(string_split(text, ' '), lambda x: x <> '') as w from documents where text is not null))""")
def nal_units(spark, sf_dir):
    words = F.filter(F.split("text", " "), lambda w: w != "")
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.transform(words, lambda w: w.cast("binary")).alias("w"))
    coded = framing.to_annex_b(F.col("w"), F.array(F.unhex(F.lit("6742")), F.unhex(F.lit("68CE"))))
    found = docs.select("doc_id", framing.annex_b(coded).alias("nals"))
    return found.select("doc_id", F.size("nals").cast("bigint").alias("n"), framing.is_key(F.col("nals")).alias("is_key"))


@query("""select s_suppkey, '00B00D0001' || format('{:02X}', 193 + (s_suppkey % 32) * 2) || '00000001' || format('{:04X}', 57344 + s_suppkey % 4096) as table_hex, true as checks from supplier""")
def program_tables(spark, sf_dir):
    key = F.col("s_suppkey")
    made = table(spark, sf_dir, "supplier").select("s_suppkey", framing.pat(F.lit(1), key % 4096, key % 32).alias("t"))
    # The checksum of a section with its checksum is zero.
    return made.select("s_suppkey", F.hex(F.expr("substring(t, 1, length(t) - 4)")).alias("table_hex"), (crc32_mpeg2("t") == 0).alias("checks"))


@query("""select page_id, case when regexp_matches(url, '^(?i:https?)://') then lower(split_part(url, '://', 1)) || regexp_extract(url, '^[A-Za-z]+(://[^/?#]*)', 1) else '' end || '/seg/' || page_id || '.ts' as segment_url from pages where url is not null""")
def absolute_url(spark, sf_dir):
    relative = F.concat(F.lit("/seg/"), F.col("page_id").cast("string"), F.lit(".ts"))
    return table(spark, sf_dir, "pages").where("url is not null").select("page_id", fetch.resolved(F.col("url"), relative).alias("segment_url"))


def _box(name: str, *parts):
    size = sum((F.length(p) for p in parts), F.lit(8))
    return F.concat(framing.big_endian(size, 4), F.lit(name).cast("binary"), *parts)


@query(""", s as (select l_orderkey, l_linenumber as d, l_quantity::bigint as z, row_number() over w - 1 as i, count(*) over (partition by l_orderkey) as n, coalesce(sum(l_linenumber) over (w rows between unbounded preceding and 1 preceding), 0) as t,
coalesce(sum(l_quantity::bigint) over (w rows between unbounded preceding and 1 preceding), 0) as o from lineitem window w as (partition by l_orderkey order by l_linenumber, l_quantity))
select l_orderkey, i::bigint as i, (l_orderkey * 10 + t)::bigint as dts, z as size, (80 + 8 * n + o)::bigint as "offset" from s""")
def fragment_samples(spark, sf_dir):
    zero, n = F.unhex(F.lit("00000000")), F.size("s")
    entries = framing.joined(F.transform("s", lambda x: F.concat(framing.big_endian(x["d"], 4), framing.big_endian(x["z"], 4))))
    head = _box("tfhd", F.unhex(F.lit("00020000")), framing.big_endian(F.lit(1), 4))
    time = _box("tfdt", F.unhex(F.lit("01000000")), framing.big_endian(F.col("seq") * 10, 8))
    run = _box("trun", F.unhex(F.lit("00000301")), framing.big_endian(n, 4), framing.big_endian(n * 8 + 80, 4), entries)
    body = F.concat(_box("moof", _box("traf", head, time, run)), _box("mdat", zero))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("seq")).agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").cast("bigint").alias("d"), F.col("l_quantity").cast("bigint").alias("z")))).alias("s"))
    found = boxes.samples(lines.select("seq", body.alias("body")))
    return found.select(F.col("seq").alias("l_orderkey"), F.col("i").cast("bigint").alias("i"), "dts", "size", "offset")


@query("""select k as c_custkey, case when k % 4 in (2, 3) then 256 end as video_pid, case k % 4 when 2 then 'hevc' when 3 then 'avc' end as video_codec, case k % 4 when 1 then 256 else 257 end as audio_pid,
case when k % 4 = 1 then 'ac3' else ['aac', 'ac3', 'mp3'][k % 3 + 1] end as audio_codec, case when k % 4 = 0 then 256 end as id3_pid from (select c_custkey as k from customer)""")
def program_map_read(spark, sf_dir):
    k = F.col("c_custkey")
    pick = lambda values, of: F.element_at(F.array(*map(F.lit, values)), (of % len(values) + 1).cast("int"))
    stream = lambda kind, pid: F.struct(kind.alias("type"), F.lit(pid).alias("pid"), F.when(kind == 6, F.unhex(F.lit("0A04656E67006A0100"))).otherwise(F.lit(b"")).alias("descriptors"))
    section = framing.pmt(F.lit(1), F.lit(256), F.array(stream(pick((0x15, 0x06, 0x24, 0x1B), k), 256), stream(pick((0x0F, 0x81, 0x03), k), 257)), k % 32)
    entries = table(spark, sf_dir, "customer").select(k, tables.map_entries(section).alias("e"))
    return entries.select(k, tables.program_map(F.col("e")).alias("m")).select(k, *(f"m.{x}" for x in ("video_pid", "video_codec", "audio_pid", "audio_codec", "id3_pid")))


@query("""select c_custkey, case when c_custkey % 7 = 0 then -1 else c_custkey % 300 end::int as "offset" from customer""")
def sync_search(spark, sf_dir):
    k = F.col("c_custkey")
    packet = lambda pid: F.concat(F.lit("47"), pid, F.lit("10"), F.repeat(F.lit("FF"), F.lit(184)))
    first = packet(F.when(k % 7 == 0, "4100").otherwise("4000"))
    body = F.unhex(F.concat(F.repeat(F.lit("00"), (k % 300).cast("int")), first, F.repeat(packet(F.lit("4100")), F.lit(5))))
    return table(spark, sf_dir, "customer").select(k, tables.sync_offset(body).alias("offset"))


@query("""select c_custkey, case when c_custkey % 5 > 0 then c_custkey * 3600 end as pts from customer""")
def private_stamp(spark, sf_dir):
    k, zero = F.col("c_custkey"), F.unhex(F.lit("0000"))
    frame = lambda name, data: F.concat(F.lit(name).cast("binary"), framing.big_endian(F.length(data), 4), zero, data)
    owner = F.when(k % 5 > 0, tables.STAMP_OWNER.decode()).otherwise("somebody").cast("binary")
    frames = F.concat(frame("TXXX", F.repeat(F.lit("A"), (k % 50).cast("int")).cast("binary")), frame("PRIV", F.concat(owner, F.unhex(F.lit("00")), framing.big_endian(k * 3600, 8))))
    tag = F.concat(F.unhex(F.lit("49443304000000")), framing.big_endian(F.length(frames), 3), frames)
    return table(spark, sf_dir, "customer").select(k, tables.id3_stamp(tag).alias("pts"))


@query("""select c_custkey, 1::bigint as track_id, 'avc1' as fourcc, (640 + c_custkey % 100)::bigint as width, (360 + c_custkey % 50)::bigint as height, 4 as length_size, '6764' || format('{:08X}', c_custkey) as sps, null::int as rate, null::int as channels from customer
union all select c_custkey, 2, 'mp4a', null, null, null, null, [96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350][c_custkey % 13 + 1], (c_custkey % 8)::int from customer""")
def codec_config(spark, sf_dir):
    k = F.col("seq")
    zeros = lambda n: F.unhex(F.lit("00" * n))
    avc = _box("avcC", F.unhex(F.lit("01640028FFE100066764")), framing.big_endian(k, 4), F.unhex(F.lit("01000468EE3C80")))
    picture = _box("avc1", zeros(24), framing.big_endian(640 + k % 100, 2), framing.big_endian(360 + k % 50, 2), zeros(50), avc)
    layout = framing.big_endian(F.lit(2 << 11) + k % 13 * 128 + k % 8 * 8, 2)
    audio = _box("mp4a", zeros(28), _box("esds", F.unhex(F.lit("0000000003160001000411401500000000000000000000000502")), layout))

    def trak(n: int, kind: str, entry):
        described = _box("minf", _box("stbl", _box("stsd", F.unhex(F.lit("0000000000000001")), entry)))
        return _box("trak", _box("tkhd", zeros(12), framing.big_endian(F.lit(n), 4), zeros(8)), _box("mdia", _box("hdlr", zeros(8), F.lit(kind).cast("binary"), zeros(12)), described))

    files = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("seq")).withColumn("body", _box("moov", trak(1, "vide", picture), trak(2, "soun", audio)))
    found = boxes.codecs(files)
    return found.select(k.alias("c_custkey"), "track_id", "fourcc", "width", "height", "avc.length_size", F.hex(F.col("avc.sps")[0]).alias("sps"), "audio.rate", "audio.channels")


@query(""", s as (select *, coalesce(sum(dur) over (w rows between unbounded preceding and 1 preceding), 0) as start, count(case when event_type = 'signup' then dur end) over w as epoch,
last_value(case when event_type = 'signup' then dur * 20 end ignore nulls) over w as target, coalesce(last_value(case event_type when 'error' then true when 'purchase' then false end ignore nulls) over w, false) as held,
first_value(case when event_type = 'purchase' then us end ignore nulls) over (w rows between 1 following and unbounded following) as resumes,
last_value(case when event_type = 'view' then event_id end ignore nulls) over (w rows between unbounded preceding and 1 preceding) as swapped from log window w as (partition by user_id order by ts, event_id))
select event_id, epoch, coalesce(start >= target, true) as kept, case when held then resumes else us end as shown, swapped from s""")
def session_replay(spark, sf_dir):
    rows = log(spark, sf_dir)
    user = ordered.spread(rows, USER)
    rows = ordered.timeline(rows, user, "dur")
    pause = F.when(is_type("error"), True).when(is_type("purchase"), False)
    done = ordered.replay(rows, user, "us", "start", F.when(is_type("signup"), F.col("dur") * 20), pause, F.when(is_type("view"), F.col("event_id")))
    return done.select("event_id", "epoch", "kept", "shown", "swapped")


@query(""", v as (select distinct user_id, dts as b from log where event_type = 'view')
select event_id, row_number() over (partition by user_id order by dts, case event_type when 'view' then 0 when 'click' then 1 else 2 end, event_id)::bigint as place,
coalesce((select max(b) from v where v.user_id = m.user_id and b <= m.dts), (select min(b) from v where v.user_id = m.user_id)) as bucket from log m where event_type in ('view', 'click', 'signup')""")
def interleaved(spark, sf_dir):
    rows = log(spark, sf_dir).select("user_id", "dts", "event_id", "event_type")
    video, *others = (rows.where(is_type(t)) for t in ("view", "click", "signup"))
    return muxing.interleave(video, others, ["user_id"], "dts", ["event_id"]).select("event_id", "place", "bucket")


@query(""", e as (select *, coalesce(sum((event_type = 'error')::int) over (partition by user_id order by ts, event_id), 0) as epoch from log),
m as (select *, max(dur) over (partition by user_id, epoch order by ts, event_id rows between unbounded preceding and 1 preceding) as mark from e)
select event_id, user_id, dur from m where dur is not null and (mark is null or dur > mark)""")
def dedup_stream(spark, sf_dir):
    # A pattern: a stream takes a plain path for a folder, and the table may be one file.
    path = f"{sf_dir}/event[s].parquet"
    schema = spark.read.parquet(path).schema
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(path).select("event_id", "user_id", F.floor(F.col("value") * 100 + 0.5).cast("bigint").alias("dur"), us.alias("us"), is_type("error").alias("error"))
    return watermark.drain(watermark.dedup(events, "user_id", "us", ["event_id"], "dur", "error"), "dedup-stream").select("event_id", "user_id", "dur")
