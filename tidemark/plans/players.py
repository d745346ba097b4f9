"""Queries of playlists, rendition choice, lookups, estimates, muxing, demuxing and sessions, each over what Spark builds from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import framing, tables
from tidemark.functions import scalars as S
from tidemark.operators import lookup, muxing, ordered, renditions, scan, selection
from tidemark.operators.ordered import Log
from tidemark.plans.catalog import USER
from tidemark.plans.registry import is_type, log, registry, table
from tidemark.sources import boxes, cues, packets, playlists
from tidemark.sources.shared import written
from tidemark.streaming import session, watermark

QUERIES, SQL, query = registry()


def order_playlists(spark, sf_dir):
    """A playlist for each order, a segment for each line item but the fifth, with ranges, keys and breaks on some."""
    n, p, s, q = (F.col(f"x.{c}") for c in ("n", "p", "s", "q"))
    text = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))
    length, real = q.cast("bigint"), n % 6 != 5

    def item(x):
        n, p, s, q = x["n"], x["p"], x["s"], x["q"].cast("bigint")
        real = n % 6 != 5
        return F.concat_ws(
            "\n", F.when(s % 7 == 0, "#EXT-X-DISCONTINUITY"),
            F.when(s % 11 == 0, text("#EXT-X-KEY:METHOD=", F.when(s % 2 == 0, "AES-128").otherwise("FOO"), ',URI="k', p, '"')),
            F.when(real & (s % 5 == 0), text("#EXT-X-BYTERANGE:", q, "@", p)), F.when(real & (s % 5).isin(1, 2), text("#EXT-X-BYTERANGE:", q)),
            F.when(real, text("#EXTINF:", q, ".5", F.when(n % 3 == 0, "abc").otherwise(""), ",t", n)), text("u", p % 2, ".ts"),
        )

    items = F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_quantity").alias("q"))))
    o = F.col("l_orderkey")
    rows = table(spark, sf_dir, "lineitem").groupBy(o).agg(items.alias("items"))
    body = F.array_join(F.transform("items", item), "\n")
    head = text("#EXTM3U\n#EXT-X-VERSION:3\n#EXT-X-TARGETDURATION:6.5x\n#EXT-X-MEDIA-SEQUENCE:", o, F.when(o % 3 == 0, "\n#EXT-X-PLAYLIST-TYPE:VOD\n").otherwise("\n"))
    return rows.select(text("http://h/p/", o, ".m3u8").alias("uri"), F.concat(head, body, F.when(o % 2 == 0, "\n#EXT-X-ENDLIST").otherwise("")).alias("text"))


WALK = """with recursive l as (select l_orderkey as o, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) as i, l_linenumber as n, l_partkey as p, l_suppkey as s, l_quantity::bigint as q from lineitem),
w as (select o, 0::bigint as i, null::bigint as fin, null::varchar as res, false as gap, null::varchar as method, null::varchar as kuri, 0::bigint as k, 0.0::double as total, false as seg, null::varchar as u, null::double as dur, null::bigint as blen, null::bigint as boff, null::bigint as n from (select distinct o from l)
union all
select o, i, case when not seg then fin when blen is not null then boff + blen when res is distinct from u then null else fin end, case when not seg then res when blen is not null then u when res is distinct from u then null else res end,
  gap, method, kuri, k, total, seg, u, dur, blen, boff, n
from (select w.o, l.i, w.fin, w.res, (w.gap and not w.seg) or l.s % 7 = 0 as gap, case when l.s % 11 = 0 then case when l.s % 2 = 0 then 'AES-128' else 'NONE' end else w.method end as method, case when l.s % 11 = 0 then 'http://h/p/k' || l.p else w.kuri end as kuri,
  w.k + w.seg::int as k, w.total + case when w.seg then w.dur else 0 end as total, l.n % 6 <> 5 as seg, 'http://h/p/u' || (l.p % 2) || '.ts' as u, l.q + 0.5::double as dur,
  case when l.n % 6 = 5 then null when l.s % 5 = 0 or (l.s % 5 in (1, 2) and w.fin is not null) then l.q end as blen, case when l.n % 6 = 5 then null when l.s % 5 = 0 then l.p when l.s % 5 in (1, 2) then w.fin end as boff, l.n
  from w join l on l.o = w.o and l.i = w.i + 1))
"""


@query(WALK + """select 'http://h/p/' || o || '.m3u8' as uri, k::int as "index", (o + k)::bigint as media_sequence, u as segment_uri, dur as duration, total as start_time_sec, 't' || n as title, blen as byte_length, boff as byte_offset, gap as discontinuity, method, kuri as key_uri from w where seg""")
def playlist_segments(spark, sf_dir):
    found = playlists.media_segments(order_playlists(spark, sf_dir))
    return found.select("uri", "index", "media_sequence", "segment_uri", "duration", "start_time_sec", "title", "byte_length", "byte_offset", "discontinuity", F.col("key.method").alias("method"), F.col("key.uri").alias("key_uri"))


@query("""with s as (select l_orderkey as o, count(*) filter (l_linenumber % 6 <> 5) as n, coalesce(sum(l_quantity::bigint + 0.5) filter (l_linenumber % 6 <> 5), 0)::double as total from lineitem group by l_orderkey)
select 'http://h/p/' || o || '.m3u8' as uri, 3::bigint as version, 6.5::double as target_duration, o::bigint as media_sequence, 0::bigint as discontinuity_sequence, o % 2 = 0 as end_list, case when o % 3 = 0 then 'VOD' end as playlist_type, n::bigint as n_segments, total as total_duration from s""")
def playlist_info(spark, sf_dir):
    return playlists.media_playlists(order_playlists(spark, sf_dir))


@query("""with c as (select c_custkey as k from customer)
select k, 'http://h/v' || k || '.m3u8' as variant_uri, (k + 1) * 1000 as bitrate, case when k % 3 > 0 then 640 + k end::int as width, case when k % 3 > 0 then 360 end::int as height, 'g' || (k % 4) as audio_group, 29.97::double as frame_rate, 2::bigint as n_audio, case when k % 2 = 0 then 1 end::bigint as n_captions from c""")
def master_variants(spark, sf_dir):
    k = F.col("c_custkey")
    text = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))
    media = text('#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="g', k % 4, '",NAME="A, b",LANGUAGE="en",URI="a.m3u8"\n#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="g",NAME="C"\n#EXT-X-MEDIA:TYPE=VIDEO,GROUP-ID="g",NAME="V"\n#EXT-X-MEDIA:TYPE=AUDIO,NAME="none"\n')
    caption = F.when(k % 2 == 0, '#EXT-X-MEDIA:TYPE=CLOSED-CAPTIONS,GROUP-ID="c",NAME="CC"\n').otherwise("")
    stream = text("#EXT-X-STREAM-INF:BANDWIDTH=1\n#EXT-X-STREAM-INF:BANDWIDTH=", (k + 1) * 1000, F.when(k % 3 > 0, text(",RESOLUTION=", k + 640, "x360")).otherwise(",RESOLUTION=big"), ',FRAME-RATE=29.97,AUDIO="g', k % 4, '"\nv', k, ".m3u8\n")
    rows = table(spark, sf_dir, "customer").select(text("http://h/m", k, ".m3u8").alias("uri"), text("#EXTM3U\n", media, caption, stream).alias("text"))
    n = playlists.renditions(rows).groupBy("uri").agg(F.count_if(F.col("type") == "AUDIO").alias("n_audio"), F.nullif(F.count_if(F.col("type") == "CLOSED-CAPTIONS"), F.lit(0)).alias("n_captions"))
    found = playlists.variants(rows).join(n, "uri")
    return found.select(F.regexp_extract("uri", "m([0-9]+)[.]", 1).cast("bigint").alias("k"), "variant_uri", "bitrate", "width", "height", "audio_group", "frame_rate", "n_audio", "n_captions")


@query("""select event_id, event_id as i, (user_id + 0.25)::double as f, case when event_id % 3 > 0 then (event_id % 1000 + 1)::int end as width, event_id % 2 = 0 as yes, lpad(upper(to_hex(event_id + 1)), (length(to_hex(event_id + 1)) + length(to_hex(event_id + 1)) % 2)::int, '0') as h from events""")
def typed_attributes(spark, sf_dir):
    e = F.col("event_id")
    text = F.concat(F.lit("I="), e.cast("string"), F.lit("x,F="), F.col("user_id").cast("string"), F.lit(".25s,R="), F.when(e % 3 > 0, F.concat((e % 1000 + 1).cast("string"), F.lit("x9"))).otherwise("wide"), F.lit(",H=0x"), F.hex(e + 1), F.lit(",B="), F.when(e % 2 == 0, "YES").otherwise("yes"))
    a = table(spark, sf_dir, "events").select(e, S.attributes(text).alias("a"))
    get = lambda n: F.try_element_at("a", F.lit(n))
    return a.select(e, S.leading_int(get("I")).alias("i"), S.leading_float(get("F")).alias("f"), S.size_value(get("R"))["width"].alias("width"), S.yes_value(get("B")).alias("yes"), F.hex(S.hex_value(get("H"))).alias("h"))


@query("""select c_custkey, ['aac', 'fmp4', 'ts', 'ts', 'unknown', 'unknown'][c_custkey % 6 + 1] as format from customer""")
def body_formats(spark, sf_dir):
    kinds = ["FFF15080", "00000018667479706D703432", "47" + "00" * 187 + "47", "4700", "47" + "00" * 188, "0001"]
    body = F.unhex(F.element_at(F.array(*map(F.lit, kinds)), (F.col("c_custkey") % 6 + 1).cast("int")))
    return table(spark, sf_dir, "customer").select("c_custkey", S.body_format(body).alias("format"))


@query("""select c_custkey as k, [null, 'highest', 'index', 'maxBitrate', null, null][k % 6 + 1] as kind, case k % 6 when 2 then k when 3 then k * 1000 end::bigint as value, [9.0, 4.0, null][k % 3 + 1]::double as slow, [500000, 250000, null][k % 3 + 1]::int as first, 2 as n_names, greatest(500, k % 13 * 500)::bigint as poll from customer""")
def option_parsers(spark, sf_dir):
    k = F.col("c_custkey")
    said = F.when(k % 6 == 0, "best").when(k % 6 == 1, "highest").when(k % 6 == 2, F.concat(F.lit("index:"), k.cast("string"))).when(k % 6 == 3, F.concat(F.lit("maxBitrate:"), (k * 1000).cast("string"), F.lit("b"))).when(k % 6 == 4, "index:x").otherwise("7")
    q, p = S.quality(said), S.preset(F.when(k % 3 == 0, "default").when(k % 3 == 1, "unstable").otherwise("other"))
    return table(spark, sf_dir, "customer").select(k.alias("k"), q["kind"].alias("kind"), q["value"].alias("value"), p["slow"].alias("slow"), p["estimate"].alias("first"), F.size(S.names(F.concat(F.lit(" en,,"), k.cast("string"), F.lit(" ,")))).alias("n_names"), S.poll_delay(k % 13).alias("poll"))


@query("""select c_custkey as k, case when k % 3 > 0 then k end as length, 'b:' || k as a, (case when k % 3 > 0 and k > 0 then k else ceil((k + 1) * 1000 * 6.5 / 8) end)::bigint as expected, greatest(10, least(20, k)) as clamped from customer""")
def response_fields(spark, sf_dir):
    k = F.col("c_custkey")
    head = F.concat(F.lit("HTTP/1.1 200\r\nX-A: z\r\nx-a : b:"), k.cast("string"), F.when(k % 3 > 0, F.concat(F.lit("\r\nContent-Length: "), k.cast("string"), F.lit(" "))).otherwise("\r\nContent-Length: no"))
    m = S.header_map(head)
    length = S.content_length(F.try_element_at(m, F.lit("content-length")))
    return table(spark, sf_dir, "customer").select(k.alias("k"), length.alias("length"), F.try_element_at(m, F.lit("x-a")).alias("a"), S.expected_bytes(length, (k + 1) * 1000, F.lit(6.5)).alias("expected"), S.clamp(k, F.lit(10), F.lit(20)).alias("clamped"))


def customer_renditions(spark, sf_dir):
    """Renditions: a presentation for each nation; some without a uri or a language, some default, with channels."""
    k = F.col("c_custkey")
    lang = F.element_at(F.array(*map(F.lit, ("EN", "de", "fr", "es", "it"))), (k % 5 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("key"), k.alias("pos"), F.concat(F.lit("g"), (F.floor(k / 3) % 4).cast("string")).alias("group_id"), F.concat(F.lit("N"), (k % 7).cast("string")).alias("name"),
        F.when(k % 4 > 0, lang).alias("language"), (F.col("c_acctbal") > 5000).alias("is_default"), F.element_at(F.array(*map(F.lit, ("1", "2,JOC", None, "6"))), (F.floor(k / 3) % 4 + 1).cast("int")).alias("channels"),
        F.when(k % 9 > 0, F.concat(F.lit("u"), k.cast("string"))).alias("uri"),
    )


SQL_RENDITIONS = """r as (select c_nationkey as key, c_custkey as pos, 'g' || (c_custkey // 3 % 4) as group_id, 'n' || (c_custkey % 7) as lname, case when c_custkey % 4 > 0 then lower(['EN', 'de', 'fr', 'es', 'it'][c_custkey % 5 + 1]) end as llang,
c_acctbal > 5000 as is_default, ['1', '2,JOC', null, '6'][c_custkey // 3 % 4 + 1] as channels from customer where c_custkey % 9 > 0), all_ as (select *, coalesce(llang, lname) as lang from r), picked as (select * from all_ where llang in ('en', 'fr', 'n3') or lname in ('en', 'fr', 'n3'))"""
WANTED = ["en", "FR", "n3"]


@query(f"""with {SQL_RENDITIONS} select key, lang, group_id, pos from (select *, row_number() over (partition by key, lang, group_id order by is_default desc, pos) as x from picked) where x = 1""")
def language_groups(spark, sf_dir):
    return renditions.language_groups(customer_renditions(spark, sf_dir), WANTED).select("key", "lang", "group_id", "pos")


@query(f"""with {SQL_RENDITIONS}, h as (select key, lang, group_id, min(pos) as spot from picked group by all), g as (select *, min(spot) over (partition by key, lang) as lang_spot from h),
c as (select key, group_id, count(*) as n, min((lang_spot, spot)) as seen from g group by key, group_id)
select key, group_id from (select *, row_number() over (partition by key order by (group_id = 'g' || (key % 6)) desc, n desc, seen) as x from c) where x = 1""")
def initial_group(spark, sf_dir):
    rows = customer_renditions(spark, sf_dir)
    starts = rows.select("key").distinct().withColumn("start_group", F.concat(F.lit("g"), (F.col("key") % 6).cast("string")))
    return renditions.initial_group(rows, starts, WANTED)


@query(f"""with {SQL_RENDITIONS}, c as (select key, group_id, count(*) as n, min(pos) as spot from picked group by all), b as (select key, arg_max(group_id, (n, -spot)) as group_id from c group by key)
select key, group_id, lang, pos from (select s.*, row_number() over (partition by key, lang order by is_default desc, pos) as x from picked s semi join b using (key, group_id)) where x = 1""")
def chosen_renditions(spark, sf_dir):
    return renditions.chosen(customer_renditions(spark, sf_dir), WANTED).select("key", "group_id", "lang", "pos")


@query(f"""with {SQL_RENDITIONS}, c as (select key, group_id, count(distinct lang) as langs, bool_and(coalesce(channels = '1', false)) as mono, max((channels in ('2,JOC', '6'))::int) as stereo, min(pos) as spot from all_ group by all)
select key, group_id, langs::bigint as langs from (select *, row_number() over (partition by key order by mono, langs desc, coalesce(stereo, 0) desc, spot) as x from c) where x = 1""")
def inline_audio_group(spark, sf_dir):
    return renditions.inline_audio_group(customer_renditions(spark, sf_dir))


@query(f"""with {SQL_RENDITIONS}, h as (select key, lang, group_id, min(pos) as spot from all_ group by all), g as (select *, min(spot) over (partition by key, lang) as lang_spot from h), c as (select key, group_id, count(*) as n, min((lang_spot, spot)) as seen from g group by key, group_id)
select key, group_id, n::bigint as langs from (select *, row_number() over (partition by key order by n desc, (group_id = 'g' || (key % 6)) desc, seen) as x from c) where x = 1""")
def inline_subtitle_group(spark, sf_dir):
    rows = customer_renditions(spark, sf_dir)
    starts = rows.select("key").distinct().withColumn("start_group", F.concat(F.lit("g"), (F.col("key") % 6).cast("string")))
    return renditions.inline_subtitle_group(rows, starts)


@query("""with r as (select c_nationkey as key, 'g' || (c_custkey // 3 % 4) as g, c_custkey % 9 > 0 as own from customer) select s_suppkey, coalesce(n, 0)::bigint as members, coalesce(p, 0)::bigint as playable
from supplier left join (select key, g, count(*) as n, count(*) filter (own) as p from r group by all) on key = s_nationkey and g = 'g' || (s_suppkey % 5)""")
def variant_groups(spark, sf_dir):
    variants = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("key"), F.concat(F.lit("g"), (F.col("s_suppkey") % 5).cast("string")).alias("audio_group"))
    return renditions.variant_groups(variants, customer_renditions(spark, sf_dir), "audio_group").select("s_suppkey", "members", "playable")


TIMELINE = "seg as (select user_id, event_id, dur, (row_number() over w - 1)::bigint as seq, coalesce(sum(dur) over (w rows between unbounded preceding and 1 preceding), 0)::bigint as start from log window w as (partition by user_id order by ts, event_id))"


@query(f""", {TIMELINE} select p.event_id, p.seq, s.event_id as found from (select event_id, user_id, event_id % 40 as seq from log) p left join seg s on s.user_id = p.user_id and s.seq = p.seq""")
def segment_by_sequence(spark, sf_dir):
    segments = ordered.timeline(log(spark, sf_dir), USER, "dur").withColumn("found", F.col("event_id"))
    probes = log(spark, sf_dir).select("event_id", "user_id", (F.col("event_id") % 40).alias("seq"))
    return lookup.by_sequence(probes, segments, ["user_id"], "seq", ["found"]).select("event_id", "seq", "found")


@query(f""", {TIMELINE}, p as (select user_id, max(seq) as own, (sum(dur) * (user_id % 5 + 1) / 4)::bigint as t from seg group by user_id), o as (select user_id + 1 as user_id, seq, start, dur from seg)
select p.user_id, coalesce((select min(seq) from o where o.user_id = p.user_id and p.t < o.start + o.dur), (select arg_max(seq, (start, seq)) from o where o.user_id = p.user_id)) as rendition_seq,
coalesce((select min(seq) from o where o.user_id = p.user_id and p.t < o.start + o.dur), own) as video_seq from p""")
def switch_reanchor(spark, sf_dir):
    segments = ordered.timeline(log(spark, sf_dir), USER, "dur")
    own = segments.groupBy("user_id").agg(F.max("seq").alias("seq"), F.sum("dur").alias("total"))
    own = own.select("user_id", "seq", S.half_even(F.col("total") * (F.col("user_id") % 5 + 1) / 4).alias("t"))
    other = segments.withColumn("user_id", F.col("user_id") + 1)
    found = lookup.reanchor(own, other, ["user_id"], "t", "start", "dur", "seq")
    same = lookup.reanchor(own, other, ["user_id"], "t", "start", "dur", "seq", past_end="same").select("user_id", F.col("seq").alias("video_seq"))
    return found.join(same, "user_id").select("user_id", F.col("seq").alias("rendition_seq"), "video_seq")


@query("""select o_orderkey, case when o_orderkey % 4 in (0, 1) and (o_orderkey % 4 = 0 or o_custkey % 60 < 50) then sha256(o_orderpriority) end as plain,
case when o_orderkey % 4 >= 2 then 'unsupported method SAMPLE-AES' when o_orderkey % 4 = 1 and o_custkey % 60 >= 50 then 'no key' end as error from orders""")
def decrypted_segments(spark, sf_dir):
    key, o = F.unhex(F.lpad(F.hex(F.col("c") % 60), 32, "0")), F.col("o_orderkey")
    keys = table(spark, sf_dir, "customer").where("c_custkey < 50").select(F.concat(F.lit("k"), F.col("c_custkey").cast("string")).alias("uri"), F.unhex(F.lpad(F.hex("c_custkey"), 32, "0")).alias("body"))
    rows = table(spark, sf_dir, "orders").select(o, F.col("o_custkey").alias("c"), F.col("o_orderpriority").cast("binary").alias("plain"))
    method = F.when(o % 4 == 0, "NONE").when(o % 4 == 1, "AES-128").otherwise("SAMPLE-AES")
    iv = S.sequence_iv(o)
    coded = F.substring(F.aes_encrypt("plain", key, F.lit("CBC"), F.lit("PKCS"), iv), F.lit(17), F.lit(1 << 20))
    rows = rows.select(o, method.alias("method"), F.concat(F.lit("k"), (F.col("c") % 60).cast("string")).alias("key_uri"), F.when(o % 4 == 0, F.col("plain")).otherwise(coded).alias("coded"))
    clear = lookup.by_uri(rows, keys, "key_uri", "key").withColumn("r", S.clear_body(F.col("method"), F.col("coded"), F.col("key"), iv))
    return clear.select(o, F.sha2("r.body", 256).alias("plain"), "r.error")


@query("""with s as (select user_id, min(event_id) as a, max(event_id) as b from events group by user_id) select user_id, case when user_id % 2 = 0 then greatest(a, b - 6 + 1) else a end::bigint as begins from s""")
def initial_cursors(spark, sf_dir):
    ends = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("event_id").alias("a"), F.max("event_id").alias("b"))
    return ends.select("user_id", selection.initial_cursor(F.col("a"), F.col("b"), F.col("user_id") % 2 == 0).alias("begins"))


@query(""", loads as (select user_id, ts, event_id, greatest(event_id % 400, 50)::double / 1000 as w, case when event_id % 3 > 0 then (event_id % 2000)::double end as t, (dur * 8)::double as bits from log),
f as (select user_id, list_reduce(list_prepend({'a': 0.0::double, 'b': 0.0::double, 'w': 0.0::double, 't': 0.0::double, 'u': 0.0::double}, list({'a': bits, 'b': bits, 'w': w, 't': t, 'u': 0.0::double} order by ts, event_id)),
 lambda s, x: {'a': x.a / x.w * (1 - pow(pow(0.5::double, 1 / 3.0::double), x.w)) + pow(pow(0.5::double, 1 / 3.0::double), x.w) * s.a, 'b': x.b / x.w * (1 - pow(pow(0.5::double, 1 / 9.0::double), x.w)) + pow(pow(0.5::double, 1 / 9.0::double), x.w) * s.b, 'w': s.w + x.w,
 't': case when x.t is null then s.t else greatest(x.t, 5) * (1 - pow(pow(0.5::double, 1 / 9.0::double), sqrt(2.0::double) * exp(-pow(x.t / 1000, 2) / 2))) + pow(pow(0.5::double, 1 / 9.0::double), sqrt(2.0::double) * exp(-pow(x.t / 1000, 2) / 2)) * s.t end,
 'u': s.u + case when x.t is null then 0 else sqrt(2.0::double) * exp(-pow(x.t / 1000, 2) / 2) end}) as s from loads group by user_id)
select user_id, s.w >= 0.001 as can_estimate, round(least(s.a / (1 - pow(pow(0.5::double, 1 / 3.0::double), s.w)), s.b / (1 - pow(pow(0.5::double, 1 / 9.0::double), s.w))), 3) as estimate,
round(case when s.u >= 0.001 then s.t / (1 - pow(pow(0.5::double, 1 / 9.0::double), s.u)) else 100 end, 6) as ttfb from f""")
def bandwidth_estimate(spark, sf_dir):
    e = F.col("event_id")
    found = ordered.bandwidth(log(spark, sf_dir), USER, e % 400, F.col("dur"), F.when(e % 3 > 0, e % 2000))
    return found.select("user_id", "can_estimate", F.round("estimate", 3).alias("estimate"), F.round("ttfb", 6).alias("ttfb"))


@query(""", t as (select event_id, event_id % 2 = 0 as live, event_id % 90 - 3 as tip, event_id % 71 as cursor, (event_id % 9)::double as since from log),
l as (select *, case when live and tip >= 0 then greatest(0, tip - cursor + 1) * 6 + least(since, 6) else 0 end as lag from t)
select event_id, lag::double as lag, case when live then greatest(0, 12 - lag) else 30 end::double as buffer, case when live and tip >= 0 and lag > 30 then greatest(cursor, tip - 3 + 1) end::bigint as skip_to from l""")
def live_lag(spark, sf_dir):
    e = F.col("event_id")
    lag, buffer, skip = selection.live_state(e % 90 - 3, e % 71, target=6, sync=12, max_lag=30, offset=3, since=(e % 9).cast("double"), live=e % 2 == 0)
    return log(spark, sf_dir).select("event_id", lag.alias("lag"), buffer.alias("buffer"), skip.alias("skip_to"))


@query(""", f as (select user_id, list(event_id order by dts, event_id) as ids, list_reduce(list_prepend({'s': null::bigint, 'o': []::bigint[]}, list({'s': dts, 'o': []::bigint[]} order by dts, event_id)),
 lambda a, x: case when a.s is null or x.s >= a.s + 7776000000 then {'s': x.s, 'o': list_append(a.o, x.s)} else {'s': a.s, 'o': list_append(a.o, a.s)} end) as r from log group by user_id)
select unnest(ids) as event_id, unnest(r.o) as bucket from f""")
def bucket_rows(spark, sf_dir):
    return scan.bucket_starts(log(spark, sf_dir), Log(("user_id",), ("dts", "event_id")), "dts", 7_776_000_000).select("event_id", "bucket")


@query(""", s as (select user_id, us // 3600000000 as hour, min(dts) filter (event_type <> 'error') as a, max(dts) filter (event_type <> 'error') as b, count(*) filter (event_type <> 'error') as n, count(*) as secs from log group by all),
d as (select *, first_value(a ignore nulls) over w as begun, case when n > 0 then b - a + case when n > 1 then (b - a) // (n - 1) else 1920 end when first_value(a ignore nulls) over w is not null then secs * 90000 else 0 end as len from s window w as (partition by user_id order by hour rows between unbounded preceding and current row))
select user_id, hour, case when n > 0 then begun + coalesce(sum(len) over (partition by user_id order by hour rows between unbounded preceding and 1 preceding), 0) end::bigint as anchor from d""")
def audio_anchor_gaps(spark, sf_dir):
    heard = F.when(~is_type("error"), F.col("dts"))
    parts = log(spark, sf_dir).groupBy("user_id", F.floor(F.col("us") / 3_600_000_000).alias("hour")).agg(F.min(heard).alias("first_pts"), (F.max(heard) - F.min(heard)).alias("span"), F.count(heard).alias("n"), F.count("*").alias("secs"))
    return selection.anchors(parts, Log(("user_id",), ("hour",)), "first_pts", "span", "n", duration=F.col("secs")).select("user_id", "hour", "anchor")


DAY = 86_400_000_000


def event_samples(spark, sf_dir):
    """Events as samples of three streams: views are pictures, clicks audio, signups text; a part is a user's day."""
    e, dts = F.col("event_id"), F.pmod("dts", F.lit(1 << 32))
    kind = F.when(is_type("view"), "video").when(is_type("click"), "audio").otherwise("text")
    pick = lambda v, a, t: F.when(F.col("kind") == "video", v).when(F.col("kind") == "audio", a).otherwise(t)
    rows = log(spark, sf_dir).where(F.col("event_type").isin("view", "click", "signup")).withColumn("kind", kind)
    return rows.select(
        "user_id", "ts", e, F.floor(F.col("us") / DAY).alias("part"), "kind", pick(0, 1, 2).alias("rank"), pick(256, 257, 272).alias("pid"), pick(0x1B, 0x0F, 6).alias("type"),
        pick(F.lit(None), F.lit("eng"), F.lit("ger")).alias("language"), (dts + pick(e % 3 * 3600, F.lit(0), F.lit(0))).alias("pts"), dts.alias("dts"), F.col("props").cast("binary").alias("data"), (e % 4 == 0).alias("is_key"),
    )


SQL_SAMPLES = """, x as (select user_id, ts, event_id, us // 86400000000 as part, case event_type when 'view' then 'video' when 'click' then 'audio' else 'text' end as kind, case event_type when 'view' then 0 when 'click' then 1 else 2 end as rank,
dts % 4294967296 as dts, dts % 4294967296 + case when event_type = 'view' then event_id % 3 * 3600 else 0 end as pts, coalesce(props, '') as props from log where event_type in ('view', 'click', 'signup'))"""


@query(SQL_SAMPLES + """, u as (select user_id, part, (row_number() over (partition by user_id, part order by dts, rank, ts, event_id) + 1)::int as place, [256, 257, 272][rank + 1] as pid,
 (9 + case when kind = 'video' and pts <> dts then 10 else 5 end + octet_length(encode(props))) as size, case when kind = 'video' then 176 else 184 end as room from x),
a as (select user_id, part, place, pid, 1 + greatest(0, (size - room + 183) // 184) as n from u union all select distinct user_id, part, 0, 0, 1 from x union all select distinct user_id, part, 1, 4096, 1 from x)
select user_id, part, place::int as place, pid::int as pid, n::int as n_packets, (coalesce(sum(n) over (partition by user_id, pid order by part, place rows between unbounded preceding and 1 preceding), 0) % 16)::bigint as cc from a""")
def mux_units(spark, sf_dir):
    muxed = muxing.mux(event_samples(spark, sf_dir), Log(("user_id",), ("ts", "event_id")), "part")
    cc = packets.number(F.element_at("packets", 1), 3, 1).bitwiseAND(F.lit(15))
    return muxed.select("user_id", "part", "place", "pid", F.size("packets").alias("n_packets"), cc.alias("cc"))


def event_streams(spark, sf_dir):
    muxed = muxing.mux(event_samples(spark, sf_dir), Log(("user_id",), ("ts", "event_id")), "part")
    bodies = muxing.streams_of(muxed, ["user_id", "part"])
    return written(bodies.select((F.col("user_id") * 100_000 + F.col("part")).alias("seq"), "body"), "event-streams")


@query(SQL_SAMPLES + """select user_id * 100000 + part as seq, kind, [256, 257][rank + 1]::bigint as pid, pts, dts, sha256(props) as payload_sha256 from x where kind <> 'text' and octet_length(encode(props)) >= 5""")
def demux_units(spark, sf_dir):
    found = packets.demux(event_streams(spark, sf_dir))
    return found.select("seq", "kind", F.col("pid").cast("bigint").alias("pid"), "pts", "dts", F.sha2("payload", 256).alias("payload_sha256"))


@query(SQL_SAMPLES + """, y as (select *, repeat(props, 8) as said, 256 + 44 * (part // 6 % 2) as vpid from x where kind <> 'text'),
p as (select user_id, part, part // 2 as seq, bool_or(kind = 'video') as v, bool_or(kind = 'audio') as a, 256 + 44 * (part // 6 % 2) as vpid from x group by user_id, part),
q as (select *, last_value(case when seq % 5 = 0 then seq end ignore nulls) over (partition by user_id order by part) as epoch from p),
m as (select user_id, part, seq, last_value(case when part % 3 <> 1 then {'v': case when v then vpid end, 'a': case when a then 257 end} end ignore nulls) over (partition by user_id, epoch order by part) as map from q),
z as (select y.*, m.seq, case when kind = 'audio' or event_id % 5 > 0 then said else left(said, case when pts <> dts then 157 else 162 end) || substr(said, case when pts <> dts then 342 else 347 end) end as left_ from y join m using (user_id, part) where case kind when 'video' then map.v = vpid else map.a = 257 end)
select user_id, seq::bigint as seq, kind, case kind when 'video' then vpid else 257 end::bigint as pid, pts, dts, sha256(left_) as payload_sha256 from z where props <> '' and octet_length(encode(said)) >= 5""")
def demux_versions(spark, sf_dir):
    """Streams whose program maps move pictures to another pid, also inside a segment, with segments without tables, breaks and broken packets."""
    part = F.col("part")
    samples = event_samples(spark, sf_dir).withColumn("data", F.repeat(F.col("data").cast("string"), F.lit(8)).cast("binary"))
    samples = samples.withColumn("pid", F.when(F.col("kind") == "video", 256 + 44 * (F.floor(part / 6) % 2)).otherwise(F.col("pid")).cast("int"))
    muxed = muxing.mux(samples, Log(("user_id",), ("ts", "event_id")), "part")
    # The second packet of some pictures loses its sync byte; a picture is known by its place.
    places = samples.withColumn("place", F.row_number().over(Window.partitionBy("user_id", "part").orderBy(F.when(F.col("kind") == "video", F.col("dts")).otherwise(F.col("pts")), "rank", "ts", "event_id")) + 1)
    hit = places.where("kind = 'video' and event_id % 5 = 0").select("user_id", "part", "place", F.lit(True).alias("hit"))
    broken = F.transform("packets", lambda x, j: F.when(F.coalesce("hit", F.lit(False)) & (j == 1), F.concat(F.unhex(F.lit("00")), F.substring(x, 2, 187))).otherwise(x))
    sent = muxed.join(hit, ["user_id", "part", "place"], "left").where("place > 1 or part % 3 <> 1").withColumn("body", framing.joined(broken))
    sent = sent.withColumns({"seq": F.floor(part / 2), "place": F.struct("part", "place")})
    bodies = muxing.streams_of(sent, ["user_id", "seq"]).withColumn("breaks", F.col("seq") % 5 == 0)
    found = packets.demux(written(bodies, "event-streams"), "user_id", "breaks")
    return found.select("user_id", "seq", "kind", F.col("pid").cast("bigint").alias("pid"), "pts", "dts", F.sha2("payload", 256).alias("payload_sha256"))


@query(SQL_SAMPLES + """select user_id * 100000 + part as seq, sha256(string_agg(props, '' order by dts, ts, event_id)) as body_sha256 from x where kind = 'video' and octet_length(encode(props)) >= 5 group by all""")
def elementary_output(spark, sf_dir):
    bodies = event_streams(spark, sf_dir).withColumn("format", F.lit("ts"))
    return muxing.output(bodies, "es-video").select("seq", F.sha2("body", 256).alias("body_sha256"))


@query("""with n as (select c_custkey as k, c_custkey % 9 + 1 as n from customer) select k, n::bigint as n_packets, case when k % 3 = 0 then n else n - 1 end::bigint as n_malformed from n""")
def malformed_packets(spark, sf_dir):
    k = F.col("c_custkey")
    good, bad = F.lit("47" + "00" * 187), F.lit("48" + "00" * 187)
    body = F.unhex(F.concat(F.when(k % 3 == 0, bad).otherwise(good), F.repeat(bad, (k % 9).cast("int")), F.lit("47")))
    return packets.malformed(table(spark, sf_dir, "customer").select(k.alias("seq"), body.alias("body"))).select(F.col("seq").alias("k"), "n_packets", "n_malformed")


@query("""select c_custkey as k, i::bigint as i, (case when c_custkey % 2 = 0 then c_custkey * 3600 else 0 end + i * 2090)::bigint as pts, 2090::bigint as duration, (c_custkey % 20 + 7)::bigint as size from (select c_custkey, unnest(range(0, c_custkey % 4)) as i from customer)""")
def raw_audio_frames(spark, sf_dir):
    k, zero = F.col("c_custkey"), F.unhex(F.lit("0000"))
    data = F.concat(F.lit(tables.STAMP_OWNER), F.unhex(F.lit("00")), framing.big_endian(k * 3600, 8))
    stamp = F.concat(F.lit("PRIV").cast("binary"), framing.big_endian(F.length(data), 4), zero, data)
    tag = F.when(k % 2 == 0, F.concat(F.unhex(F.lit("49443304000000")), framing.big_endian(F.length(stamp), 3), stamp)).otherwise(F.lit(b""))
    raw = F.unhex(F.repeat(F.lit("00"), (k % 20).cast("int")))
    # The first frame's rate counts for all.
    frame = lambda i: F.concat(framing.adts_header(F.lit(2), F.when(i == 0, 4).otherwise(3), F.lit(2), F.length(raw)), raw)
    frames = framing.joined(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), (k % 4).cast("int") - 1)), frame))
    body = F.concat(tag, F.when(k % 4 > 0, frames).otherwise(F.lit(b"")), F.unhex(F.lit("00FF")))
    found = packets.raw_audio(table(spark, sf_dir, "customer").select(k.alias("seq"), body.alias("body")))
    return found.select(F.col("seq").alias("k"), F.col("i").cast("bigint").alias("i"), "pts", "duration", F.length("data").cast("bigint").alias("size"))


@query("""select doc_id, len(w)::bigint as n, list_sum([length(x) + 0 for x in w])::bigint as size, [('0x' || hex(encode(x))[1:2])::int % 32 for x in w][1] as first_type from (select doc_id, list_filter(string_split(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' '), lambda x: x <> '') as w from documents where text is not null) where len(w) > 0 and octet_length(encode(array_to_string(w, ''))) = length(array_to_string(w, ''))""")
def length_prefixed_units(spark, sf_dir):
    words = F.filter(F.split(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), " "), lambda w: w != "")
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", words.alias("w")).where("size(w) > 0 and octet_length(array_join(w, '')) = length(array_join(w, ''))")
    coded = framing.joined(F.transform("w", lambda w: F.concat(framing.big_endian(F.length(w), 2), w.cast("binary"))))
    units = docs.select("doc_id", coded.alias("c")).select("doc_id", framing.length_prefixed("c", F.lit(2)).alias("u")).select("doc_id", framing.classified(F.col("u")).alias("u"))
    size = F.aggregate("u", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x["data"]))
    return units.select("doc_id", F.size("u").cast("bigint").alias("n"), size.alias("size"), F.element_at("u", 1)["type"].alias("first_type"))


@query("""select c_custkey as k, c_custkey % 3 = 0 as tagged, c_custkey % 2 = 0 as master, case when c_custkey % 4 = 3 then 1 else 3 end::bigint as n_lines, floor((c_custkey + 0.25) * 90000 + 0.5)::bigint as ticks from customer""")
def small_predicates(spark, sf_dir):
    k = F.col("c_custkey")
    body = F.unhex(F.when(k % 3 == 0, "4944330400").otherwise("4944"))
    text = F.when(k % 4 == 3, "#EXTM3U #EXT-X-STREAM-INF:no").otherwise(F.concat(F.lit("#EXTM3U\r\n"), F.when(k % 2 == 0, "#EXT-X-STREAM-INF:BANDWIDTH=1").otherwise("#EXTINF:1,"), F.lit("\rx")))
    rows = table(spark, sf_dir, "customer").select(k.cast("string").alias("uri"), k.alias("k"), text.alias("text"), framing.id3_prefixed(body).alias("tagged"))
    n = playlists.lines(rows).groupBy("uri").agg(F.count("*").alias("n_lines"))
    return rows.join(n, "uri").select("k", "tagged", playlists.is_master(F.regexp_replace("text", "\r\n|\r", "\n")).alias("master"), "n_lines", S.ticks(F.col("k") + 0.25).alias("ticks"))


@query(""", c as (select user_id, us // 3600000000 as hour, event_id, row_number() over (partition by user_id, us // 3600000000 order by event_id) - 1 as n from log)
select user_id * 1000000 + hour as seq, n::bigint as n, ((user_id * 1000 + case when hour % 2 = 0 then 900000 - 90000 else 5000000 end) + (n * 1500 * 90))::bigint as pts, ((case when n % 3 = 2 then 0 else 1000 end) * 90)::bigint as ticks, event_id as said from c""")
def timed_text(spark, sf_dir):
    hour = F.floor(F.col("us") / 3_600_000_000)
    rows = log(spark, sf_dir).withColumn("hour", hour).groupBy("user_id", "hour").agg(F.array_sort(F.collect_list("event_id")).alias("ids"))
    clock = lambda ms: F.concat(F.lpad(F.floor(ms / 60_000).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.floor(ms / 1000) % 60).cast("string"), 2, "0"), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))
    cue = lambda x, n: F.concat(F.lit("id\n"), clock(n * 1500), F.lit(" --> "), clock(F.when(n % 3 == 2, n * 1500).otherwise(n * 1500 + 1000)), F.lit(" align:start\n"), x.cast("string"))
    even = F.col("hour") % 2 == 0
    head = F.concat(F.lit("WEBVTT"), F.when(even, F.concat(F.lit("\nX-TIMESTAMP-MAP=LOCAL:00:01.000,MPEGTS:"), (F.col("user_id") * 1000 + 900_000).cast("string"))).otherwise(""), F.lit("\n\nNOTE none\n\n"))
    bodies = rows.select((F.col("user_id") * 1_000_000 + F.col("hour")).alias("seq"), F.concat(head, F.array_join(F.transform("ids", cue), "\n\n")).alias("body"), (F.col("user_id") * 1000 + 5_000_000).alias("fallback_base"))
    found = cues.cues(bodies)
    place = F.row_number().over(Window.partitionBy("seq").orderBy("pos")) - 1
    return found.select("seq", place.cast("bigint").alias("n"), "pts", F.col("duration_ticks").alias("ticks"), F.regexp_extract("payload", "\n([0-9]+)\n$", 1).cast("bigint").alias("said"))


@query(SQL_SAMPLES + """, v as (select * from x where kind = 'video'), f as (select user_id, list_distinct(list_reduce(list_prepend({'s': null::bigint, 'o': []::bigint[]}, list({'s': dts, 'o': []::bigint[]} order by dts, ts, event_id)),
 lambda a, y: case when a.s is null or y.s >= a.s + 777600000 then {'s': y.s, 'o': list_append(a.o, y.s)} else a end).o) as starts from v group by user_id)
select x.user_id, event_id, coalesce(list_max(list_filter(starts, lambda s: s <= x.pts)), list_min(starts)) as part from x join f using (user_id) where kind = 'audio'
union all select v.user_id, event_id, list_max(list_filter(starts, lambda s: s <= v.dts)) from v join f using (user_id)""")
def inline_parts(spark, sf_dir):
    rows = event_samples(spark, sf_dir).drop("part")
    video, audio = rows.where("kind = 'video'"), rows.where("kind = 'audio'")
    users = video.select("user_id").distinct()
    parts = muxing.inline(video, [audio.join(users, "user_id", "left_semi").withColumn("data", F.col("event_id").cast("string").cast("binary"))], ["user_id"], ["ts", "event_id"], 777_600_000)
    # Each row's part, by place: the units of a part in the order of mux.
    placed = muxing.inline_rows(video, [audio.join(users, "user_id", "left_semi")], ["user_id"], ["ts", "event_id"], 777_600_000)
    counted = parts.where("pid in (256, 257)").groupBy("user_id", "part").agg(F.count("*").alias("n"))
    same = placed.groupBy("user_id", "part").agg(F.count("*").alias("m")).join(counted, ["user_id", "part"]).where("m = n").select("user_id", "part")
    return placed.join(same, ["user_id", "part"]).select("user_id", "event_id", "part")


@query(""", v as (select user_id, us // 3600000000 as seq, count(*) as n from log where event_type = 'view' group by all), a as (select user_id, us // 3600000000 as seq, count(*) as n from log where event_type = 'click' group by all)
select v.user_id, v.seq, v.n as pictures, a.n as frames from v left join a using (user_id, seq)""")
def inline_segments(spark, sf_dir):
    hours = log(spark, sf_dir).withColumn("seq", F.floor(F.col("us") / 3_600_000_000))
    count = lambda t, name: hours.where(is_type(t)).groupBy("user_id", "seq").agg(F.count("*").alias(name))
    return lookup.by_sequence(count("view", "pictures"), count("click", "frames"), ["user_id"], "seq", ["frames"]).select("user_id", "seq", "pictures", "frames")


def _box(name: str, *parts):
    size = sum((F.length(p) for p in parts), F.lit(8))
    return F.concat(framing.big_endian(size, 4), F.lit(name).cast("binary"), *parts)


@query(""", s as (select l_orderkey, l_linenumber as d, l_quantity::bigint as z, row_number() over w - 1 as i, coalesce(sum(l_linenumber) over (w rows between unbounded preceding and 1 preceding), 0) as t from lineitem window w as (partition by l_orderkey order by l_linenumber, l_quantity))
select l_orderkey, i::bigint as i, floor((l_orderkey * 10 + t) * 90000 / 48000.0 + 0.5)::bigint as dts, floor((l_orderkey * 10 + t + i - 2) * 90000 / 48000.0 + 0.5)::bigint as pts, sha256(repeat(chr((97 + i)::int), z::int)) as data_sha256 from s""")
def fragment_payloads(spark, sf_dir):
    n = F.size("s")
    entries = framing.joined(F.transform("s", lambda x, i: F.concat(framing.big_endian(x["d"], 4), framing.big_endian(x["z"], 4), framing.big_endian(F.pmod(i - 2, F.lit(1 << 32)), 4))))
    head = _box("tfhd", F.unhex(F.lit("00020000")), framing.big_endian(F.lit(1), 4))
    time = _box("tfdt", F.unhex(F.lit("01000000")), framing.big_endian(F.col("seq") * 10, 8))
    run = _box("trun", F.unhex(F.lit("01000B01")), framing.big_endian(n, 4), framing.big_endian(n * 12 + 80, 4), entries)
    data = framing.joined(F.transform("s", lambda x, i: F.repeat(F.char(i + 97), x["z"].cast("int")).cast("binary")))
    body = F.concat(_box("moof", _box("traf", head, time, run)), _box("mdat", data))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("seq")).agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").cast("bigint").alias("d"), F.col("l_quantity").cast("bigint").alias("z")))).alias("s"))
    files = lines.select("seq", body.alias("body"), F.lit("a").alias("init"))
    tracks = lines.select("seq").limit(1).select(F.lit("a").alias("init"), F.explode(F.array(F.struct(F.lit(1).cast("bigint").alias("track_id"), F.lit("vide").alias("kind"), F.lit(48_000).cast("bigint").alias("timescale")), F.struct(F.lit(2).cast("bigint").alias("track_id"), F.lit("vide").alias("kind"), F.lit(1).cast("bigint").alias("timescale")))).alias("t")).select("init", "t.*")
    found = boxes.payloads(files, boxes.first_track(tracks, "vide", ["init"]), ["init"])
    return found.select(F.col("seq").alias("l_orderkey"), F.col("i").cast("bigint").alias("i"), "dts", "pts", F.sha2("data", 256).alias("data_sha256"))


@query("""with l as (select l_orderkey as o, l_linenumber as d, l_quantity::bigint as z, row_number() over w - 1 as i, coalesce(sum(l_linenumber) over (w rows between unbounded preceding and 1 preceding), 0) as t from lineitem window w as (partition by l_orderkey order by l_linenumber, l_quantity)),
s as (select l_orderkey % 50 as stream, o as seq, i, z, case when o % 2 = 0 then 48000 else 90000 end as scale, o * 10 + t as dts, o * 10 + t + i * 5 - o % 7 as pts, o from (select *, o as l_orderkey from l)),
k as (select *, floor(dts * 90000 / scale::double + 0.5)::bigint as a, floor(pts * 90000 / scale::double + 0.5)::bigint as b from s),
n as (select stream, seq, max(greatest(0, a - b)) as need from k group by all), m as (select stream, seq, max(need) over (partition by stream order by seq) as shift from n)
select k.stream, k.seq, i::bigint as i, a as dts, b + shift as pts, z % 3 = 0 as is_key, sha256(case when z % 3 = 0 then unhex('00000001676400' || lpad(upper(to_hex(scale)), 8, '0') || '0000000168EE3C80') else ''::blob end || unhex('00000001') || encode(case when z % 3 = 0 then 'e' else 'A' end || repeat(chr((97 + i)::int), z::int))) as data_sha256 from k join m using (stream, seq)""")
def canonical_output(spark, sf_dir):
    """Fragmented segments put out as transport streams by their init sections, and read back."""
    n, o = F.size("s"), F.col("seq")
    zeros = lambda k: F.unhex(F.lit("00" * k))
    nal = lambda x, i: F.concat(F.when(x["z"] % 3 == 0, "e").otherwise("A"), F.repeat(F.char(i + 97), x["z"].cast("int"))).cast("binary")
    sized = lambda x, i: F.concat(framing.big_endian(F.length(nal(x, i)), 4), nal(x, i))
    entries = framing.joined(F.transform("s", lambda x, i: F.concat(framing.big_endian(x["d"], 4), framing.big_endian(x["z"] + 5, 4), framing.big_endian(F.pmod(i * 5 - o % 7, F.lit(1 << 32)), 4))))
    head, time = _box("tfhd", F.unhex(F.lit("00020000")), framing.big_endian(F.lit(1), 4)), _box("tfdt", F.unhex(F.lit("01000000")), framing.big_endian(o * 10, 8))
    run = _box("trun", F.unhex(F.lit("01000B01")), framing.big_endian(n, 4), framing.big_endian(n * 12 + 80, 4), entries)
    body = F.concat(_box("moof", _box("traf", head, time, run)), _box("mdat", framing.joined(F.transform("s", sized))))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("seq")).agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").cast("bigint").alias("d"), F.col("l_quantity").cast("bigint").alias("z")))).alias("s"))
    segments = written(lines.select((o % 50).alias("stream"), "seq", F.when(o % 2 == 0, "even").otherwise("odd").alias("init"), body.alias("body")), "segments")
    # An init section for each clock, with a parameter set that says it; audio comes first.
    scale = F.when(F.col("init") == "even", 48_000).otherwise(90_000)
    avc = _box("avcC", F.unhex(F.lit("01640028FFE10007676400")), framing.big_endian(scale, 4), F.unhex(F.lit("01000468EE3C80")))
    picture = _box("avc1", zeros(24), framing.big_endian(F.lit(640), 2), framing.big_endian(F.lit(360), 2), zeros(50), avc)

    def trak(number: int, kind: str, *entry):
        described = _box("minf", _box("stbl", _box("stsd", F.unhex(F.lit("0000000000000001")), *entry)))
        return _box("trak", _box("tkhd", zeros(12), framing.big_endian(F.lit(number), 4), zeros(8)), _box("mdia", _box("mdhd", zeros(12), framing.big_endian(scale, 4), zeros(8)), _box("hdlr", zeros(8), F.lit(kind).cast("binary"), zeros(12)), described))

    inits = segments.select("init").distinct().withColumn("body", _box("moov", trak(2, "soun", _box("mp4a", zeros(28))), trak(1, "vide", picture)))
    units = packets.demux(written(muxing.canonical(segments, inits, "stream", "init"), "canonical"), "stream")
    # Payloads stay in the task that reads them.
    units = units.select("stream", "seq", "first", "dts", "pts", framing.key_picture("payload").alias("is_key"), F.sha2("payload", 256).alias("data_sha256"))
    i = F.row_number().over(Window.partitionBy("stream", "seq").orderBy("first")) - 1
    return units.select("stream", "seq", i.cast("bigint").alias("i"), "dts", "pts", "is_key", "data_sha256")


@query(""", s as (select *, coalesce(sum(dur) over (w rows between unbounded preceding and 1 preceding), 0)::bigint as start, count(*) filter (event_type = 'signup') over w as epoch,
last_value(case when event_type = 'signup' then dur * 20 end ignore nulls) over w as target, coalesce(last_value(case event_type when 'error' then true when 'purchase' then false end ignore nulls) over w, false) as held,
last_value(case when event_type = 'view' then event_id end ignore nulls) over (w rows between unbounded preceding and 1 preceding) as swapped from log window w as (partition by user_id order by ts, event_id))
select event_id, start, epoch, coalesce(start >= target, true) as kept, held, swapped from s""")
def session_stream(spark, sf_dir):
    # A pattern: a stream takes a plain path for a folder, and the table may be one file.
    path = f"{sf_dir}/event[s].parquet"
    schema = spark.read.parquet(path).schema
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    dur = S.half_up(F.col("value") * 100)
    pause = F.when(is_type("error"), True).when(is_type("purchase"), False)
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(path)
    events = events.select("event_id", "user_id", us.alias("us"), dur.alias("dur"), F.when(is_type("signup"), dur * 20).alias("seek"), pause.alias("pause"), F.when(is_type("view"), F.col("event_id")).alias("swap"))
    out = session.follow(events, "user_id", ["us", "event_id"], "dur", "seek", "pause", "swap")
    return watermark.drain(out, "session-stream").select("event_id", "start", "epoch", "kept", "held", "swapped")
