"""Steps of connected components: right on odd shapes, with plans that don't outgrow the driver."""

import random

from tidemark.llm import components


def roots(edges):
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}


def test_components_of_odd_shapes_in_small_plans(spark, monkeypatch):
    rng = random.Random(5)
    path = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 160)]
    high = [(299, i) for i in range(200, 240)]
    mixed = [(rng.randrange(400, 480), rng.randrange(400, 480)) for _ in range(60)]
    edges = path + star + high + mixed + [(b, a) for a, b in star] + [(-5, 7), (500, 500)]
    plans, whole = [], components.cut

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return whole(df, name)

    monkeypatch.setattr(components, "cut", seen)
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == roots(edges) and len(got) == len(roots(edges))
    # The one plan of a step held 32 exchanges and more, which Spark's driver writes down again at each of their ends.
    assert max(p.count("Exchange hash") for p in plans) <= 5
    # What is stars already takes one round.
    plans.clear()
    assert {r.node: r.root for r in components.components(spark.createDataFrame(star, "a long, b long")).collect()} == roots(star)
    assert len(plans) == 3
    assert components.components(spark.createDataFrame([(1, 1)], "a long, b long")).collect() == []
