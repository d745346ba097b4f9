"""URL rules against SQL, the trees on held-out labels, and awkward urls."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import url_filter
from tidemark.llm.queries import RULES, op2_url_filter

SF = "/root/testdata/sf0.01"
PARTS = r"""
with u as (select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages),
p as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
r as (select * from (values {rules}) r(own, prefix, verdict)),
f as (select page_id, arg_max({{'rule': own || prefix, 'verdict': verdict}}, length(own || prefix)) as best from p join r on (host = own or suffix(host, '.' || own)) and prefix(path, prefix) group by page_id)
select page_id, host, path, best.rule as rule, best.verdict as verdict from p left join f using (page_id)"""


def test_rules_equal_sql(spark):
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    con = duckdb.connect()
    con.execute(f"create view pages as select page_id, url from '{SF}/pages.parquet' union all select * from (values (-1, null), (-2, 'x'), (-3, 'a://EXAMPLE.com/en/7?x'), (-4, 'b://org?/es/')) v")
    want = {r[0]: r[1:] for r in con.execute(PARTS.format(rules=rules)).fetchall()}
    extra = spark.createDataFrame([(-1, None), (-2, "x"), (-3, "a://EXAMPLE.com/en/7?x"), (-4, "b://org?/es/")], "page_id long, url string")
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").unionByName(extra)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, RULES).collect()}
    assert set(got) == set(want)
    for page, (host, path, rule, verdict) in want.items():
        assert got[page][:3] == (host, path, rule) and (got[page][3] == verdict if rule else got[page][3] in ("allow", "block"))


def test_rules_say_what_the_contract_says(spark, tmp_path):
    said = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"
    want = {rule: verdict for verdict, rule in (x.split(" ") for x in said.split(", "))}
    assert {host + path: verdict for host, path, verdict in RULES} == want
    urls = [f"http://{'a.' * (i % 2)}{rule}{i}" for rule in want for i in range(4)]
    spark.createDataFrame(enumerate(urls), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: (r.rule, r.verdict) for r in op2_url_filter(spark, str(tmp_path)).collect()}
    assert got == {4 * k + i: (rule, verdict) for k, (rule, verdict) in enumerate(want.items()) for i in range(4)}


def test_the_trees_decide_what_no_rule_does(spark):
    rows = op2_url_filter(spark, "/root/testdata/sf0.1").where("rule is null").groupBy("verdict").count().collect()
    share = {r["verdict"]: r["count"] for r in rows}
    assert min(share.get("allow", 0), share.get("block", 0)) >= 0.05 * sum(share.values())


def test_trees_on_held_out_labels(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 9)))

    def one(i):
        bad = i % 3 == 0
        host = f"{word()}.{'cheap' if bad and i % 2 else 'plain'}{i % 40}.com"
        return f"http://{host}/{word()}/{rng.randrange(10**9) if bad else word()}{'?a=1&b=2&c=3' if bad else ''}", "block" if bad else "allow"

    frame = spark.createDataFrame([one(i) for i in range(900)], "url string, verdict string")
    known = url_filter.with_rule(frame, [], "url").select("url", "host", "path", (F.col("verdict") == "block").cast("double").alias("label"))
    judge = url_filter.fit(known)
    assert judge.auc >= 0.95 and judge.blocked_of_block >= 0.9 and judge.blocked_of_allow <= 0.1
    # Copies of one url don't change what is learnt.
    hot = known.unionByName(known.limit(1).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(500)))).drop("n"))
    assert url_filter.fit(hot).limit == judge.limit


def test_all_labelled_urls_are_learnt_from(spark):
    # 30,000 urls of least hash, of which the long ones are allowed; the blocked ones with parameters, longer still, have the greatest hashes.
    plain = spark.range(60_000).selectExpr("concat('http://h.com/', if(id % 10 = 0, '', 'long/long/long/'), id) as url", "if(id % 10 = 0, 'block', 'allow') as verdict").where("xxhash64(url) < 0")
    loud = spark.range(4_000).selectExpr("concat('http://h.com/long/long/long/long/', id, '?a=1&b=2&c=3') as url", "'block' as verdict").where("xxhash64(url) > 0")
    new = spark.range(5_000, 5_100).selectExpr("id as page_id", "concat('http://h.com/long/long/long/long/', id, '?a=1&b=2&c=3') as url")
    assert plain.count() > 25_000
    assert {r.verdict for r in url_filter.judge(new, [], labelled=plain.unionByName(loud)).collect()} == {"block"}


def test_the_limit_comes_from_all_folds(spark):
    # All folds but the last have labels that lengths tell; in the last, which alone set the limit before, they are turned round.
    urls = spark.range(1_500).selectExpr("concat('http://h.com/', if(id % 2 = 0, '', 'long/long/long/'), id) as url", "id % 2 as long")
    fold = F.pmod(F.xxhash64("url", F.lit(21)), F.lit(url_filter.FOLDS))
    known = url_filter.with_rule(urls.withColumn("label", F.when(fold == url_filter.FOLDS - 1, 1 - F.col("long")).otherwise(F.col("long")).cast("double")), [], "url").select("url", "host", "path", "label")
    judge = url_filter.fit(known)
    own = known.where(fold == url_filter.FOLDS - 1).count() / known.count()
    assert judge.blocked_of_block - judge.blocked_of_allow == pytest.approx(1 - 2 * own, abs=0.03)


def test_bins_equal_brute_force_and_are_no_plain_numbers(spark):
    rng = np.random.default_rng(5)
    n = 2_000
    values = np.stack([rng.integers(0, 3 + 40 * (i % 3), n) if f not in url_filter.RATIOS else rng.integers(0, 999, n) / 1000 + 0.0004 for i, f in enumerate(url_filter.FEATURES)], 1).astype(float)
    values[:, 1], values[:, 2], values[:3, 2] = 7, 0, 9
    frame = spark.createDataFrame(values.tolist(), ", ".join(f"__{f} double" for f in url_filter.FEATURES))
    bins = url_filter.binning(frame, n)
    for f, own, limits in zip(url_filter.FEATURES, values.T, bins.getSplitsArray(), strict=True):
        own = np.sort(np.floor(own * 1000 + 1e-6) / 1000)
        firsts = {}
        for x in np.unique(own):
            firsts.setdefault(int((own < x).sum()) * url_filter.BINS // n, x)
        kept = sorted(firsts.values())
        assert limits[1:-1] == pytest.approx(kept[1:] or kept), f
    assert bins.getSplitsArray()[2][1:-1] == [9] and bins.getSplitsArray()[1][1:-1] == [7]
    attrs = url_filter.with_features(frame, bins).schema["__features"].metadata["ml_attr"]["attrs"]
    assert set(attrs) == {"nominal"} and len(attrs["nominal"]) == len(url_filter.FEATURES) and max(len(a["vals"]) for a in attrs["nominal"]) <= url_filter.BINS


def test_limit_and_area_equal_brute_force():
    rng = np.random.default_rng(2)
    score, label = rng.integers(0, 9, 200) / 10, rng.integers(0, 2, 200)
    counts = [(s, float(((score == s) & (label == 0)).sum()), float(((score == s) & (label == 1)).sum())) for s in np.unique(score).tolist()]
    limit, area, caught, wrong = url_filter.held_out_figures(counts)
    a, b = score[label == 1], score[label == 0]
    assert area == pytest.approx((a[:, None] > b).mean() + 0.5 * (a[:, None] == b).mean())
    assert (caught, wrong) == pytest.approx(((a >= limit).mean(), (b >= limit).mean()))
    assert caught - wrong == pytest.approx(max((a >= x).mean() - (b >= x).mean() for x in score))


def test_suffix_rates_leave_out_the_own_fold(spark):
    rows = [("a.x.com", 1.0, 0), ("b.x.com", 0.0, 1), ("c.x.com", 1.0, 1), ("d.y.org", 1.0, 2)]
    frame = spark.createDataFrame(rows, "host string, label double, fold int").withColumns({"__last_1": F.substring_index("host", ".", -1), "__last_2": F.substring_index("host", ".", -2)})
    got = {r.host: r for r in url_filter.with_rates(frame, url_filter.suffix_statistics(frame), 0.75, True, "fold").collect()}
    prior = url_filter.PRIOR_WEIGHT * 0.75
    assert got["a.x.com"]["__rate_2"] == pytest.approx((1 + prior) / (2 + url_filter.PRIOR_WEIGHT)) and got["b.x.com"]["__rate_1"] == pytest.approx((1 + prior) / (1 + url_filter.PRIOR_WEIGHT))
    assert got["d.y.org"]["__rate_1"] == pytest.approx(0.75)


def test_awkward_urls(spark):
    long = "http://a.com/" + "x/%20é" * 20_000
    rows = [(1, long), (1, long), (2, None), (3, ""), (4, "://"), (5, "http://a.b.org/es/1"), (6, "http://example.com/en/7")]
    frame = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 as host", "2 as verdict", "3 as block_score", "4 as `x.y`", "5 as copies", "6 as label", "7 as fold")
    got = url_filter.judge(frame, RULES).collect()
    assert len(got) == 7 and len({(r.host, r.path, r.verdict) for r in got if r.page_id == 1}) == 1 and got[0]["x.y"] == 4
    assert {r.host for r in got if r.page_id in (2, 3, 4)} == {""} and url_filter.judge(frame.limit(0), RULES).count() == 0
