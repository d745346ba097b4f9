"""The library's operators on the driver's tables: a query for each, with the same result in plain SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import lookup, ordered, selection
from tidemark.operators.ordered import Log
from tidemark.operators.prefix import scanned, sum_of, whole
from tidemark.operators.scan import bucket_starts
from tidemark.plans.registry import is_type, log, registry, table

QUERIES, SQL, query = registry()
USER = Log(("user_id",), ("ts", "event_id"))
TYPE = Log(("event_type",), ("ts", "event_id"))
#: Bitrates of the ladder the level queries use.
LADDER = [250_000, 460_000, 840_000, 2_150_000, 6_220_000]
#: The same in SQL.
SQL_LADDER = "(values (0, 250000), (1, 460000), (2, 840000), (3, 2150000), (4, 6220000)) l(i, rate)"


@query("""select event_id, user_id, (row_number() over w - 1)::bigint as seq, coalesce(sum(dur) over (w rows between unbounded preceding and 1 preceding), 0)::bigint as start, sum(dur) over (partition by user_id)::bigint as total
from log window w as (partition by user_id order by ts, event_id)""")
def timeline_start(spark, sf_dir):
    rows = log(spark, sf_dir)
    return ordered.timeline(rows, ordered.spread(rows, USER), "dur").select("event_id", "user_id", "seq", "start", "total")


@query(""", seg as (select user_id, dur, (row_number() over w - 1)::bigint as seq, coalesce(sum(dur) over (w rows between unbounded preceding and 1 preceding), 0)::bigint as start, sum(dur) over (partition by user_id)::bigint as total from log
window w as (partition by user_id order by ts, event_id)),
probe as (select distinct user_id, k, floor(total * k / 8.0)::bigint as t from seg, (values (-1), (0), (1), (3), (5), (7), (8), (9)) v(k))
select p.user_id, k, t, case when t < 0 then 0 else (select min(seq) from seg s where s.user_id = p.user_id and t < s.start + s.dur) end as seq from probe p""")
def segment_at_time(spark, sf_dir):
    segments = ordered.timeline(log(spark, sf_dir), USER, "dur")
    probes = segments.groupBy("user_id").agg(F.first("total").alias("total")).select("user_id", "total", F.explode(F.array(*map(F.lit, (-1, 0, 1, 3, 5, 7, 8, 9)))).alias("k"))
    probes = probes.select("user_id", "k", F.floor(F.col("total") * F.col("k") / 8).cast("bigint").alias("t"))
    return lookup.segment_at(probes, segments, ["user_id"], "t", "start", "dur", "seq")


@query(""", seg as (select user_id, sum(dur)::bigint as total, arg_max(dur, (ts, event_id)) as tail from log group by user_id)
select user_id, k, case when t <= 0 then 0 else least(t, total - tail) end::bigint as clamped from (select *, k * 5000 as t from seg, (values (-1), (0), (1), (3), (9)) v(k))""")
def clamp_start(spark, sf_dir):
    ends = log(spark, sf_dir).groupBy("user_id").agg(F.sum("dur").alias("total"), F.max_by("dur", F.struct("ts", "event_id")).alias("tail"))
    probes = ends.select("*", F.explode(F.array(*map(F.lit, (-1, 0, 1, 3, 9)))).alias("k"))
    return probes.select("user_id", "k", selection.clamp_start(F.col("k") * 5000, F.col("total"), F.col("tail")).alias("clamped"))


@query("""select event_id, last_value(case when event_type = 'purchase' then dur end ignore nulls) over (partition by user_id order by ts, event_id) as key_value from log""")
def carry_key(spark, sf_dir):
    rows = log(spark, sf_dir)
    return ordered.carry(rows, ordered.spread(rows, USER), F.when(is_type("purchase"), F.col("dur")), "key_value").select("event_id", "key_value")


@query(""", run as (select *, coalesce(sum((event_type = 'view')::int) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as r from log)
select event_id, gap::bigint as gap, marked::bigint as marked from (select *, max((event_type = 'error')::int) over (partition by user_id, r) as gap, max((event_type = 'click')::int) over (partition by user_id, r) as marked from run) where event_type = 'view'""")
def pending_bind(spark, sf_dir):
    return ordered.bind_to_next(log(spark, sf_dir), USER, is_type("view"), {"gap": is_type("error"), "marked": is_type("click")}).select("event_id", "gap", "marked")


@query(""", run as (select *, sum((event_type = 'signup')::int) over (partition by user_id order by ts, event_id) as r from log)
select event_id, (first_value(case when event_type = 'signup' then event_id * 1000 end) over w + coalesce(sum(dur) over (w rows between unbounded preceding and 1 preceding), 0))::bigint as "offset" from run window w as (partition by user_id, r order by ts, event_id)""")
def implicit_offset(spark, sf_dir):
    explicit = F.when(is_type("signup"), F.col("event_id") * 1000)
    return ordered.chained_offset(log(spark, sf_dir), USER, explicit, "dur").select("event_id", "offset")


@query(""", run as (select *, sum((event_type = 'signup')::int) over (partition by user_id order by ts, event_id)::bigint as run from log)
select user_id, run, count(*)::bigint as n, sum(dur)::bigint as size, string_agg(event_id::varchar, ',' order by ts, event_id) as parts from run group by user_id, run""")
def run_assembly(spark, sf_dir):
    ids = F.array_join(F.transform(ordered.in_order(USER.order), lambda x: x["event_id"].cast("string")), ",")
    return ordered.runs(log(spark, sf_dir), USER, is_type("signup"), {"n": F.count("*"), "size": F.sum("dur"), "parts": ids})


@query(""", f as (select user_id, list_reduce(list_prepend({'a': 0.0::double, 'b': 0.0::double, 'w': 0.0::double}, list({'a': value::double, 'b': (event_id % 1000 + 1)::double, 'w': 0.0::double} order by ts, event_id)),
 lambda s, x: {'a': (8 * x.b / (greatest(x.a, 50) / 1000)) * (1 - pow(pow(0.5::double, 1 / 3.0::double), greatest(x.a, 50) / 1000)) + pow(pow(0.5::double, 1 / 3.0::double), greatest(x.a, 50) / 1000) * s.a,
  'b': (8 * x.b / (greatest(x.a, 50) / 1000)) * (1 - pow(pow(0.5::double, 1 / 9.0::double), greatest(x.a, 50) / 1000)) + pow(pow(0.5::double, 1 / 9.0::double), greatest(x.a, 50) / 1000) * s.b, 'w': s.w + greatest(x.a, 50) / 1000}) as s from log group by user_id)
select user_id, round(s.a / (1 - pow(pow(0.5::double, 1 / 3.0::double), s.w)), 3) as fast, round(s.b / (1 - pow(pow(0.5::double, 1 / 9.0::double), s.w)), 3) as slow,
 round(least(s.a / (1 - pow(pow(0.5::double, 1 / 3.0::double), s.w)), s.b / (1 - pow(pow(0.5::double, 1 / 9.0::double), s.w))), 3) as estimate from f""")
def ewma_dual(spark, sf_dir):
    seconds = F.greatest(F.col("value"), F.lit(50.0)) / 1000
    size = (F.col("event_id") % 1000 + 1).cast("double")
    out = ordered.ewma_of(log(spark, sf_dir), USER, (3.0, 9.0), seconds, size * 8 / seconds)
    m = F.col("means")
    return out.select("user_id", F.round(m[0], 3).alias("fast"), F.round(m[1], 3).alias("slow"), F.round(F.least(m[0], m[1]), 3).alias("estimate"))


@query(f""", u as (select user_id, sum(dur)::double * 200 / count(*) as bw, user_id % 5 as cur, (user_id % 7) * 2.0 as buf, user_id % 3 as low from log group by user_id),
t as (select u.*, i, rate, bw * case when i > cur then 0.7::double else 0.95::double end as b from u, {SQL_LADDER} where i >= low),
ok as (select *, (b >= rate or i = low) and 0.1::double + rate * 10 / b <= buf as strict, (b >= rate or i = low) and 0.1::double + rate * 10 / b <= buf + 4 as relaxed from t)
select user_id, coalesce(max(i) filter (strict), max(i) filter (relaxed), any_value(low))::bigint as level from ok group by user_id""")
def level_pick(spark, sf_dir):
    users = log(spark, sf_dir).groupBy("user_id").agg((F.sum("dur").cast("double") * 200 / F.count("*")).alias("bw"))
    u = F.col("user_id")
    level = lookup.best_level(LADDER, F.col("bw"), u % 5, (u % 7) * 2.0, F.lit(0.1), F.lit(10.0), u % 3, F.lit(4))
    return users.select("user_id", level.alias("level"))


@query(f""", p as (select event_id, event_id % 5 as level, (event_id % 4 + 1)::double as buf, dur * 100 as loaded, 7780000 as expected, (event_id % 11 + 1) * 1500.0::double as elapsed, case when event_id % 13 <> 0 then 100.0::double end as ttfb from log),
r as (select *, nullif(loaded * 8000.0::double / greatest(1, elapsed - ttfb), 0) as rate from p),
t as (select r.*, i, ttfb / 1000 + l.rate::double * 10 / r.rate as t from r, {SQL_LADDER})
select event_id, coalesce(max(case when level > 0 and loaded * 2 >= expected and greatest(expected - loaded, 0) * 8.0::double / rate >= buf and i < level and t < least(buf, 10 + ttfb / 1000) and t < ttfb / 1000 + 8.0::double * expected / rate then i end), -1)::bigint as target from t group by event_id""")
def abandon_pick(spark, sf_dir):
    e = F.col("event_id")
    target = lookup.abandon_level(LADDER, e % 5, (e % 4 + 1).cast("double"), F.col("dur") * 100, F.lit(7_780_000), (e % 11 + 1) * 1500.0, F.when(e % 13 != 0, F.lit(100.0)), F.lit(10.0))
    return log(spark, sf_dir).select("event_id", target.alias("target"))


@query("""with l as (select p_brand, p_partkey, floor(p_retailprice * 100 + 0.5)::bigint as rate, row_number() over (partition by p_brand order by floor(p_retailprice * 100 + 0.5)::bigint, p_partkey) - 1 as i, count(*) over (partition by p_brand) as n from part)
select p_brand, max(p_partkey) filter (i = 0) as lowest, max(p_partkey) filter (i = n - 1) as highest, max(p_partkey) filter (i = least(7, n - 1)) as seventh, max_by(p_partkey, (rate <= 120000, case when rate <= 120000 then i else -i end)) as under from l group by p_brand""")
def static_pick(spark, sf_dir):
    ladder = table(spark, sf_dir, "part").withColumn("rate", S.half_up(F.col("p_retailprice") * 100))
    return selection.static_picks(ladder, "p_brand", "rate", "p_partkey", index=7, cap=120_000)


@query(f"""select event_id, coalesce(max(i) filter (rate <= dur * 50), 0)::bigint as cap from log, {SQL_LADDER} group by event_id""")
def cap_level(spark, sf_dir):
    cap = F.coalesce(lookup.top_level(LADDER, lambda i, rate: F.lit(rate) <= F.col("dur") * 50), F.lit(0))
    return log(spark, sf_dir).select("event_id", cap.cast("bigint").alias("cap"))


@query(""", e as (select *, sum((event_type = 'error')::int) over (partition by user_id order by ts, event_id)::bigint as epoch, us // 3600000000 as hour from log),
f as (select user_id, list_reduce(list_prepend({'e': -1::bigint, 'h': null::bigint, 'v': null::bigint, 'm': null::bigint, 'k': []::bigint[], 'i': null::bigint}, list({'e': epoch, 'h': hour, 'v': dur, 'm': null::bigint, 'k': []::bigint[], 'i': event_id} order by ts, event_id)),
 lambda a, x: case when x.e <> a.e then {'e': x.e, 'h': x.h, 'v': x.v, 'm': null::bigint, 'k': case when x.v is null then a.k else list_append(a.k, x.i) end, 'i': null::bigint}
  when x.v is not null and (case when x.h <> a.h then coalesce(a.v, a.m) else a.m end is null or x.v > case when x.h <> a.h then coalesce(a.v, a.m) else a.m end)
   then {'e': x.e, 'h': x.h, 'v': x.v, 'm': case when x.h <> a.h then coalesce(a.v, a.m) else a.m end, 'k': list_append(a.k, x.i), 'i': null::bigint}
  else {'e': x.e, 'h': x.h, 'v': case when x.h <> a.h then null else a.v end, 'm': case when x.h <> a.h then coalesce(a.v, a.m) else a.m end, 'k': a.k, 'i': null::bigint} end) as r from e group by user_id)
select e.event_id, e.epoch from e join (select unnest(r.k) as event_id from f) k using (event_id)""")
def dedup_watermark(spark, sf_dir):
    rows = log(spark, sf_dir).withColumn("hour", F.floor(F.col("us") / 3_600_000_000))
    return ordered.watermark_dedup(rows, USER, "dur", is_type("error"), "hour").select("event_id", "epoch")


@query(""", t as (select event_id, dur % 100 as last_seq, max(dur % 100) over (partition by user_id order by ts, event_id) as tip, event_id % 90 as cursor from log)
select event_id, tip, (greatest(0, tip - cursor + 1) * 6)::bigint as lag, greatest(0, 12 - greatest(0, tip - cursor + 1) * 6)::bigint as buffer, case when greatest(0, tip - cursor + 1) * 6 > 30 then greatest(cursor, tip - 3 + 1) end::bigint as skip_to from t""")
def live_tip_lag(spark, sf_dir):
    rows = ordered.running_max(log(spark, sf_dir), USER, F.col("dur") % 100, "tip").withColumn("cursor", F.col("event_id") % 90)
    lag, buffer, skip = selection.live_state(F.col("tip"), F.col("cursor"), target=6, sync=12, max_lag=30, offset=3)
    return rows.select("event_id", "tip", lag.alias("lag"), buffer.alias("buffer"), skip.alias("skip_to"))


@query(""", h as (select user_id, us // 3600000000 as hour, greatest(0, max(dur % 97 - event_id % 101)) as need from log group by all)
select user_id, hour, max(need) over (partition by user_id order by hour)::bigint as shift from h""")
def pts_shift(spark, sf_dir):
    need = F.greatest(F.lit(0), F.max(F.col("dur") % 97 - F.col("event_id") % 101))
    hours = log(spark, sf_dir).groupBy("user_id", F.floor(F.col("us") / 3_600_000_000).alias("hour")).agg(need.alias("need"))
    return ordered.running_max(hours, Log(("user_id",), ("hour",)), F.col("need").cast("bigint"), "shift").select("user_id", "hour", "shift")


@query(""", s as (select user_id, us // 3600000000 as hour, min(dts) as first_pts, max(dts) - min(dts) as span, count(*) as n from log group by all),
d as (select *, case when n > 1 then span // (n - 1) else 1920 end as frame, row_number() over (partition by user_id order by hour) as k from s)
select user_id, hour, (first_value(first_pts) over w + coalesce(sum(span + frame) over (w rows between unbounded preceding and 1 preceding), 0))::bigint as anchor from d window w as (partition by user_id order by hour)""")
def audio_anchor(spark, sf_dir):
    parts = log(spark, sf_dir).groupBy("user_id", F.floor(F.col("us") / 3_600_000_000).alias("hour")).agg(F.min("dts").alias("first_pts"), (F.max("dts") - F.min("dts")).alias("span"), F.count("*").alias("n"))
    return selection.anchors(parts, Log(("user_id",), ("hour",)), "first_pts", "span", "n").select("user_id", "hour", "anchor")


@query(""", b as (select distinct user_id, dts from log),
s as (select *, lead(dts) over (partition by user_id order by dts) as nxt, count(*) over (partition by user_id) as n, min(dts) over (partition by user_id) as lo, max(dts) over (partition by user_id) as hi from b)
select user_id, dts, coalesce(nxt - dts, case when n > 1 then (hi - lo) // (n - 1) else 3600 end)::bigint as span from s""")
def bucket_span(spark, sf_dir):
    return ordered.spans(log(spark, sf_dir).select("user_id", "dts").distinct(), Log(("user_id",), ("dts",)), "dts").select("user_id", "dts", "span")


@query(""", f as (select user_id, list_reduce(list_prepend({'s': null::bigint, 'n': 0::bigint}, list({'s': dts, 'n': 0::bigint} order by dts)), lambda a, x: case when a.s is null or x.s >= a.s + 7776000000 then {'s': x.s, 'n': a.n + 1} else a end) as r from log group by user_id)
select user_id, r.s as last_start, r.n as buckets from f""")
def bucket_anchor(spark, sf_dir):
    rows = bucket_starts(log(spark, sf_dir).select("user_id", "dts"), Log(("user_id",), ("dts",)), "dts", 7_776_000_000)
    return rows.groupBy("user_id").agg(F.max("bucket").alias("last_start"), F.count_distinct("bucket").alias("buckets"))


@query(""", v as (select user_id, us, event_id from log where event_type = 'view'), c as (select user_id, us, event_id from log where event_type = 'click')
select c.event_id, coalesce((select max_by(v.event_id, (v.us, v.event_id)) from v where v.user_id = c.user_id and v.us <= c.us), (select min_by(v.event_id, (v.us, v.event_id)) from v where v.user_id = c.user_id)) as bucket from c""")
def route_asof(spark, sf_dir):
    rows = log(spark, sf_dir).select("user_id", "us", "event_id", "event_type")
    clicks, views = rows.where(is_type("click")), rows.where(is_type("view")).select("user_id", F.col("us").alias("at"), F.col("event_id").alias("bucket"))
    return lookup.as_of(clicks.drop("event_type"), views, ["user_id"], "us", "at", ["bucket"], clamp=True).select("event_id", "bucket")


@query("""select event_id, row_number() over (partition by user_id order by dts, case event_type when 'view' then 0 when 'click' then 1 else 2 end, event_id)::bigint as place from log where event_type in ('view', 'click', 'signup')""")
def merge_dts(spark, sf_dir):
    rows = log(spark, sf_dir)
    streams = [(rows.where(is_type(t)), i) for i, t in enumerate(("view", "click", "signup"))]
    return selection.merge_streams(streams, ["user_id"], "dts", ["event_id"]).select("event_id", "place")


@query("""select event_id, ((row_number() over (partition by event_type order by ts, event_id) - 1) % 16)::bigint as cc from log""")
def cc_counter(spark, sf_dir):
    return ordered.counter(log(spark, sf_dir), TYPE, "cc", 16, F.floor(F.col("us") / 3_600_000_000)).select("event_id", "cc")


@query(""", l as (select *, dur // 10000 as level, lag(dur // 10000) over (partition by user_id order by ts, event_id) as was from log)
select event_id, (sum((coalesce(was <> level, false))::int) over (partition by user_id order by ts, event_id) % 32)::bigint as version from l""")
def psi_version(spark, sf_dir):
    rows = log(spark, sf_dir)
    return ordered.changes(rows, ordered.spread(rows, USER), F.floor(F.col("dur") / 10000), "version", 32).select("event_id", "version")


@query("""with want(pos, name) as (values (0, 'signup'), (1, 'nothing'), (2, 'click'), (3, 'view')), have as (select distinct user_id, event_type from events)
select user_id, event_type, (256 + row_number() over (partition by user_id order by pos))::bigint as pid from have join want on lower(event_type) = name""")
def pid_assign(spark, sf_dir):
    return selection.assign_numbers(table(spark, sf_dir, "events").select("user_id", "event_type").distinct(), "user_id", "event_type", ["signup", "nothing", "click", "view"], 0x101)


@query("""with g as (select s_nationkey as grp, count(distinct s_suppkey % 7) as langs, max((s_acctbal > 0)::int) as stereo, min(s_suppkey) as pos, s_nationkey % 5 as region from supplier group by s_nationkey)
select region, grp, langs::bigint as langs from (select *, row_number() over (partition by region order by langs desc, stereo desc, pos) as r from g) where r = 1""")
def group_coverage(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("grp"), (F.col("s_suppkey") % 7).alias("language"), (F.col("s_acctbal") > 0).alias("wide"), F.col("s_suppkey").alias("pos"), (F.col("s_nationkey") % 5).alias("region"))
    return selection.best_group(s, ["region"], "grp", "language", "wide", "pos").select("region", "grp", "langs")


@query("""select c_nationkey, bool_and(c_acctbal > -900 and c_acctbal < 9000) as all_mono, bool_or(c_acctbal >= 9000) as has_stereo from customer group by c_nationkey""")
def group_allmono(spark, sf_dir):
    mono, wide = selection.channel_flags(F.when(F.col("c_acctbal") >= 9000, 2).when(F.col("c_acctbal") > -900, 1))
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(mono.alias("all_mono"), wide.alias("has_stereo"))


@query("""select user_id, event_type, event_id from (select *, row_number() over (partition by user_id, event_type order by (value > 400) desc, ts, event_id) as r from events) where r = 1""")
def default_dedup(spark, sf_dir):
    return selection.first_of(table(spark, sf_dir, "events"), ["user_id", "event_type"], F.col("value") > 400, ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("""select c_custkey from customer c where not exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_orderpriority = '1-URGENT')""")
def anti_inline(spark, sf_dir):
    inlined = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(inlined, "c_custkey", "left_anti")


@query(""", g as (select user_id, dur % 10 as grp, max(event_id) as rendition from log where event_type = 'signup' group by all), c as (select l.*, g.rendition from log l left join g on g.user_id = l.user_id and g.grp = l.dur % 10)
select event_id, last_value(rendition ignore nulls) over (partition by user_id order by ts, event_id) as rendition from c""")
def rendition_follow(spark, sf_dir):
    rows = log(spark, sf_dir).withColumn("grp", F.col("dur") % 10)
    groups = rows.where(is_type("signup")).groupBy("user_id", "grp").agg(F.max("event_id").alias("rendition"))
    return lookup.follow(rows, groups, ["user_id"], "grp", "rendition", ["ts", "event_id"], ["user_id"]).select("event_id", "rendition")


@query(r"""with p as (select page_id, lower(split_part(split_part(url, '?', 1), '#', 1)) || case page_id % 4 when 0 then '.ts' when 1 then '.m4s' when 2 then '.aac' else '' end as u from pages)
select page_id, case when u like '%.aac' then 'aac' when regexp_matches(u, '\.(ts|m2ts)$') then 'ts' when regexp_matches(u, '\.(m4s|m4a|mp4)$') then 'fmp4' else 'unknown' end as format from p""")
def format_sniff(spark, sf_dir):
    i = F.col("page_id") % 4
    bare = F.substring_index(F.substring_index("url", "?", 1), "#", 1)
    url = F.concat(bare, F.when(i == 0, ".ts").when(i == 1, ".m4s").when(i == 2, ".aac").otherwise(""), F.lit("?x=.aac#t"))
    return table(spark, sf_dir, "pages").select("page_id", S.media_format(url).alias("format"))


@query("""select event_id, user_id as bandwidth, 'a,' || event_type as codecs, dur as twice, null::varchar as missing from log""")
def attr_list(spark, sf_dir):
    text = F.concat(F.lit("BANDWIDTH="), F.col("user_id").cast("string"), F.lit(',CODECS="a,'), F.col("event_type"), F.lit('",X=1,X='), F.col("dur").cast("string"))
    got = log(spark, sf_dir).select("event_id", S.attributes(text).alias("a"))
    return got.select("event_id", S.leading_int(F.try_element_at("a", F.lit("BANDWIDTH"))).alias("bandwidth"), F.try_element_at("a", F.lit("CODECS")).alias("codecs"), S.leading_int(F.try_element_at("a", F.lit("X"))).alias("twice"), F.try_element_at("a", F.lit("NONE")).alias("missing"))


@query("""select event_id, ((us // 1000) % 86400000 * 90)::bigint as ticks from log""")
def webvtt_ticks(spark, sf_dir):
    text = F.date_format(F.timestamp_micros("us"), "HH:mm:ss.SSS")
    return log(spark, sf_dir).select("event_id", S.clock_ticks(text).alias("ticks"))


@query("""select event_id, dts % 8589934592 as pts, (137438953472 + 4294967296 + 65536 + 1 + ((dts >> 30) & 7) * 8589934592 + ((dts >> 15) & 32767) * 131072 + (dts & 32767) * 2)::bigint as field from log""")
def pts_codec(spark, sf_dir):
    field = S.pack_stamp(F.col("dts"))
    return log(spark, sf_dir).select("event_id", S.unpack_stamp(field).alias("pts"), field.alias("field"))


@query("""select event_id, ((dts % 8589934592) * 32768 + 32256)::bigint as field from log""")
def pcr_codec(spark, sf_dir):
    return log(spark, sf_dir).select("event_id", S.pack_clock(F.col("dts")).alias("field"))


@query("""select event_id, lpad(upper(to_hex(us)), 32, '0') as iv from log""")
def iv_hex(spark, sf_dir):
    return log(spark, sf_dir).select("event_id", F.hex(S.sequence_iv(F.col("us"))).alias("iv"))


@query(r"""with l as (select n_nationkey, regexp_replace(lower(n_name), '[^a-z]', '', 'g') as x, n_name from nation) select n_nationkey, case when x = '' then 'und' else rpad(x[1:3], 3, ' ') end as code, regexp_replace(lower(n_name || ' & Co'), '[^a-z0-9._-]+', '-', 'g') as slug from l""")
def lang_norm_slug(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", S.language_code(F.col("n_name")).alias("code"), S.slug(F.concat("n_name", F.lit(" & Co"))).alias("slug"))


@query("""select event_id, least(200 * pow(2.0::double, event_id % 10), 5000) as delay, (event_id % 600 in (408, 425, 429) or event_id % 600 between 500 and 599) as again from events""")
def retry_delay(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", S.retry_delay(F.col("event_id") % 10).alias("delay"), S.retryable(F.col("event_id") % 600).alias("again"))


@query("""select event_id, sum(dur) over w::bigint as bytes_written, greatest(0, sum(event_id % 7) over w * 1000000 - (us - min(us) over (partition by user_id)))::bigint as ahead from log window w as (partition by user_id order by ts, event_id rows between unbounded preceding and current row)""")
def sink_progress(spark, sf_dir):
    rows = log(spark, sf_dir)
    found = scanned(rows, ordered.spread(rows, USER), {"bytes_written": sum_of(F.col("dur")), "seconds": sum_of(F.col("event_id") % 7), "begun": whole(F.min, F.col("us"))})
    ahead = F.greatest(F.lit(0), F.col("seconds") * 1_000_000 - (F.col("us") - F.col("begun")))
    return found.select("event_id", "bytes_written", ahead.alias("ahead"))


@query("""with u as (select page_id, url, hex(encode(url)) as h from pages),
b as (select page_id, url, [(('0x' || h[2 * (i // 8) + 1 : 2 * (i // 8) + 2])::bigint >> (7 - i % 8)) & 1 for i in range(4 * length(h))] as bits from u)
select page_id, case when url is not null then list_reduce(list_prepend(4294967295::bigint, bits), lambda c, x: xor((c << 1) & 4294967295, case when xor(c >> 31, x) = 1 then 79764919 else 0 end)) end as crc from b""")
def crc_mpeg2(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.crc32_mpeg2(F.col("url").cast("binary")).alias("crc"))


@query("""select doc_id, sha256(text) as plain from documents""")
def aes_roundtrip(spark, sf_dir):
    key, iv = F.unhex(F.lit("000102030405060708090A0B0C0D0E0F")), S.sequence_iv(F.col("doc_id"))
    whole = F.expr("aes_encrypt(cast(text as binary), unhex('000102030405060708090A0B0C0D0E0F'), 'CBC', 'PKCS', unhex(lpad(hex(doc_id), 32, '0')))")
    body = table(spark, sf_dir, "documents").select("doc_id", whole.alias("c"))
    return body.select("doc_id", F.sha2(S.decrypt_cbc(F.expr("substring(c, 17)"), key, iv), 256).alias("plain"))
