"""Running values of a key that fills several tasks: the same as by one window, and no part above its share."""

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import plain
from tidemark.operators import ordered, prefix
from tidemark.operators.ordered import Log

LOG = Log(("k", "j"), ("t", "i"))


@pytest.fixture(scope="module")
def rows(spark):
    """Half of all rows in one key, whose second column is null; times with ties and nulls."""
    r = random.Random(5)
    pick = lambda p, v: v if r.random() < p else None
    made = [(None if i % 2 else "a", "x" if i % 2 else r.choice("xyz"), pick(0.97, r.randrange(300)), i, pick(0.9, r.randrange(50)), pick(0.2, r.randrange(9)), pick(0.2, r.random() < 0.5)) for i in range(600)]
    return spark.createDataFrame(made, "k string, j string, t int, i int, v int, seek int, pause boolean").cache()


@pytest.fixture(scope="module")
def cut(rows):
    return ordered.spread(rows, LOG, most=8, least=1)


def test_parts_have_their_share(rows, cut):
    sizes = prefix.in_parts(rows, cut).groupBy("k", "j", prefix.PART).agg(F.count("*").alias("n"), F.min("t").alias("a"), F.max("t").alias("b")).collect()
    hot = sorted((r for r in sizes if r.k is None), key=lambda r: r[prefix.PART])
    assert len(hot) >= 4 and max(r.n for r in sizes) <= 2 * 600 / 8 and all(x.b < y.a for x, y in zip(hot, hot[1:], strict=False))
    assert ordered.spread(rows, LOG, most=8).cuts is None


CASES = {
    "timeline": lambda d, g: ordered.timeline(d, g, "v"), "carry": lambda d, g: ordered.carry(d, g, F.col("seek"), "c"), "running_max": lambda d, g: ordered.running_max(d, g, F.col("v"), "m"),
    "bind": lambda d, g: ordered.bind_to_next(d, g, F.col("v") > 30, {"s": F.col("seek") > 4, "p": F.col("pause")}), "counter": lambda d, g: ordered.counter(d, g, "n", 16),
    "offset": lambda d, g: ordered.chained_offset(d, g, F.col("seek"), "v", resource="j"), "runs": lambda d, g: ordered.runs(d, g, F.col("seek") > 4, {"n": F.count("*"), "s": F.sum("v")}),
    "spans": lambda d, g: ordered.spans(d.where("t is not null"), g, "t"), "changes": lambda d, g: ordered.changes(d, g, F.floor(F.col("v") / 10), "c", 32),
    "replay": lambda d, g: ordered.replay(d.withColumn("at", F.col("i") * 2), g, "at", "v", F.col("seek"), F.col("pause"), F.col("v")),
    "ewma": lambda d, g: ordered.ewma_of(d, g, (3.0,), F.lit(0.1), F.col("v").cast("double")).select("k", "j", F.round("weight", 6), F.round(F.col("means")[0], 6)),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_parts_give_what_one_window_gives(rows, cut, name):
    want = plain(CASES[name](rows, LOG).collect())
    assert want and plain(CASES[name](rows, cut).collect()) == want


def test_packets_of_a_cut_key_count_on(rows):
    from tidemark.operators.muxing import packetize

    log = Log(("k",), ("t", "i"))
    units = rows.where("t is not null").withColumns({"pid": F.lit(256) + F.col("i") % 2, "data": F.repeat(F.lit("x"), F.col("v") * 20).cast("binary"), "pcr": F.lit(None).cast("long"), "key": F.lit(False), "break": F.lit(False)})
    made = lambda g: plain(packetize(units, g).select("i", F.sha2("body", 256)).collect())
    assert made(ordered.spread(units, log, most=8, least=1)) == made(log)


def test_empty_table(rows):
    none = rows.limit(0)
    assert ordered.timeline(none, ordered.spread(none, LOG, least=1), "v").count() == 0


def test_spread_order_that_is_no_number_is_refused_only_where_a_key_is_hot(rows):
    assert ordered.spread(rows, Log(("k",), ("j",)), least=1000).cuts is None
