"""SimHash, mixing, substrings, neighbours, chat and urls against brute force and awkward inputs."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tidemark.llm import ann, chat, components, mixing, simhash, substring, url_filter
from tidemark.llm.queries import RULES

DOCS = "doc_id long, text string, source string"


def corpus(n=120, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(3)) for _ in range(300)]
    say = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage, base = say(60), say(150).split(" ")
    rows = []
    for i in range(n):
        kind = i % 6
        if kind == 0:
            own = list(base)
            for _ in range(rng.randrange(3)):
                own[rng.randrange(150)] = rng.choice(words)
            text = " ".join(own)
        elif kind == 1:
            text = say(rng.randrange(40)) + "\n" + passage + " " + say(20)
        elif kind == 2:
            text = " ".join(["a b"] * rng.randrange(1, 60))
        elif kind == 3:
            text = rng.choice([None, "", " \t ", "one", "One two"])
        else:
            text = say(rng.randrange(200))
        rows.append((i if i % 17 else rng.randrange(20), text, rng.choice(["s0", "s1", "s2", None])))
    return [*rows, rows[7], rows[7], (None, say(50), "s1")]


def naive_fp(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 8])
def test_simhash_equals_brute_force(spark, bucket):
    rows = corpus()
    got = simhash.near_duplicates(spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as fp"), bucket=bucket).collect()
    fps = [naive_fp(t) for _, t, _ in rows]
    root = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    least = {}
    for r, (i, _, _) in zip(root, rows, strict=True):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    key = lambda x: tuple(-1 if v is None else v for v in x)
    want = sorted(((i, f, least.get(r)) for (i, _, _), f, r in zip(rows, fps, root, strict=True)), key=key)
    assert sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got), key=key) == want
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_simhash_of_a_very_long_text(spark):
    text = " ".join(f"w{i % 977}" for i in range(400_000))
    rows = [(1, text, "s"), (2, text.upper(), "s"), (3, "w1 w2 w3", "s")]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def wide_links(fps):
    """Pairs that SIMILAR links: at most 77 of 512 bits apart, at most 30 of the first 128, and within one bit in one of 8 segments of the first 192."""

    def near(x):
        return x.bit_count() <= 77 and (x & (1 << 128) - 1).bit_count() <= 30 and any((x >> a & (1 << 24) - 1).bit_count() <= 1 for a in range(0, 192, 24))

    return [(i, j) for i in range(len(fps)) for j in range(i) if near(fps[i] ^ fps[j])]


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 16])
def test_wide_fingerprints_equal_brute_force(spark, bucket):
    rng = random.Random(8)
    centres = [rng.getrandbits(512) for _ in range(4)]
    flip = lambda x, most: x ^ sum(1 << b for b in rng.sample(range(512), rng.randrange(most)))
    fps = [flip(rng.choice(centres), 70) for _ in range(150)] + [flip(centres[0] ^ (1 << 40) - 1, 12) for _ in range(60)]
    fps = sorted(set(fps))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    word = lambda f, i: signed(f >> 64 * i & (1 << 64) - 1)
    frame = spark.createDataFrame([(word(f, 0), word(f, 1), word(f, 2), bytearray(f.to_bytes(64, "little"))) for f in fps], "fp long, fp_1 long, fp_2 long, fp_all binary")
    nodes = [r.node for r in frame.withColumn("node", simhash.node_of(["fp", "fp_1"])).collect()]
    found = {r.node: r.root for r in components.components(simhash.links(frame, simhash.SIMILAR, bucket)).collect()}
    root, first = roots(len(fps), wide_links(fps)), {}
    got = [found.get(n, n) for n in nodes]
    assert all(first.setdefault(g, r) == r for g, r in zip(got, root)) and len(set(got)) == len(set(root)) < len(fps)


def test_wide_fingerprints_of_texts(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(900)}" for _ in range(700)]
    near = [*words[:300], "other", *words[301:]]
    rows = [(1, " ".join(words), "s"), (2, " ".join(near).upper(), "s"), (3, None, "s"), (4, "one two", "s"), (5, " ".join(words[:350]), "s"), (6, " ".join(words), "s")]
    got = {r.doc_id: r for r in simhash.fingerprints(spark.createDataFrame(rows, DOCS), setting=simhash.SIMILAR).collect()}
    apart = lambda a, b: (int.from_bytes(got[a].fp_all, "little") ^ int.from_bytes(got[b].fp_all, "little")).bit_count()
    assert apart(1, 6) == 0 and got[3].fp_all == bytes(64) and 0 < apart(1, 2) < 40 and 77 < apart(1, 5) < 180 and apart(1, 4) > 200
    assert got[1].fp_all[:8] == (got[1].fp % (1 << 64)).to_bytes(8, "little")
    # In pieces, too.
    hashes, edges = np.array([rng.getrandbits(64) for _ in range(50)], np.uint64), np.array([0, 3, 3, 20, 50])
    whole, simhash.SHINGLES = simhash.folded(hashes, edges, 3), 7
    assert (simhash.folded(hashes, edges, 3) == whole).all()
    simhash.SHINGLES = 1 << 16
    many = np.array([rng.getrandbits(64) for _ in range(2000)], np.uint64)
    assert int(simhash.folded(many, np.array([0, 2000]), 1)[0, 0]) == sum(1 << k for k in range(64) if 2 * sum(int(h) >> k & 1 for h in many) > 2000)
    for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        assert int(whole[i, 0]) == sum(1 << k for k in range(64) if 2 * sum(int(h) >> k & 1 for h in hashes[a:b]) > b - a)


def test_simhash_links_every_close_pair_in_crowded_buckets(spark):
    rng = random.Random(1)
    centres = [rng.getrandbits(64) for _ in range(3)]
    fps = {rng.choice(centres) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(7))) for _ in range(400)}
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    for bucket in (8, 1024):
        found = {r.node: r.root for r in components.components(simhash.links(frame, bucket=bucket)).collect()}
        root = roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if ((fps[i] ^ fps[j]) % (1 << 64)).bit_count() <= 3])
        for i, f in enumerate(fps):
            assert found.get(f, f) == fps[root[i]]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def naive_substrings(rows, window):
    docs = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, _ in rows]
    seen = {}
    for d, w in enumerate(docs):
        for p in range(len(w) - window + 1):
            seen.setdefault(tuple(w[p : p + window]), []).append((d, p))
    gone = [set() for _ in docs]
    for places in seen.values():
        if len(places) > 1:
            for d, p in places:
                gone[d] |= set(range(p, p + window))
    return [(i, len(w), len(g), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in g).encode()).hexdigest()) for (i, _, _), w, g in zip(rows, docs, gone, strict=True)]


@pytest.mark.parametrize("window,phrase,part", [(35, 10, 1000), (12, 4, 50)])
def test_substrings_equal_brute_force(spark, window, phrase, part):
    rows = corpus(150, 8)
    got = substring.remove_recurring(spark.createDataFrame(rows, DOCS).selectExpr("*", "'x' as key", "2 as n_words"), window=window, phrase=phrase, per_part=part).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, naive_substrings(rows, window)))
    assert substring.remove_recurring(spark.createDataFrame([], DOCS)).count() == 0


def test_substrings_are_located_by_the_automaton():
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    texts = pa.array([f"{a} x {b}", f"y {b}", ""])
    phrases = [" ".join(f"b{i}" for i in range(k, k + 10)) for k in (3, 30)]
    shard = substring.Shard(texts, pa.array(phrases), 35, 10)
    places = {p for at in (61, 122) for k in (3, 30) for p in range(at + k - 25, at + k + 1)}
    whole = [*range(0, 121 - 34), *range(121, 182 - 34)]
    assert shard.starts.tolist() == [p for p in whole if p in places]
    assert not len(substring.Shard(texts, pa.array([], pa.string()), 35, 10).starts)
    assert not len(substring.Shard(texts, pa.array(["b1 b2 b3 b4 b5 b6 b7 b8 b9 b11"]), 35, 10).starts)


def test_substrings_of_a_very_long_text(spark):
    rng = random.Random(2)
    passage, long = " ".join(f"p{i}" for i in range(40)), " ".join(f"w{rng.randrange(10**7)}" for _ in range(250_000))
    rows = [(1, f"{long} {passage} end", "s"), (2, f"start {passage}", "s"), (2, None, "s")]
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring.remove_recurring(spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as h", "2 as n", "3 as `a.b`")).collect())
    assert got == [(1, 250_041, 40), (2, 0, 0), (2, 41, 40)]


def test_mixing_meets_targets(spark):
    rows = corpus(300, 5)
    for bucket in (mixing.BUCKET, 3):
        got = mixing.mix(spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as size"), bucket=bucket).collect()
        assert len(got) == len(rows)
        size = {}
        for r in got:
            assert 0 <= r.taken <= 3 * r.size
            size.setdefault(r.source, [0, 0, r.target, r.source_size])
            size[r.source][0] += r.size
            size[r.source][1] += r.taken
        assert all(s == whole and abs(t - goal) <= 1 and goal <= 3 * whole + 1e-6 for s, t, goal, whole in size.values())
        assert abs(sum(x[2] for x in size.values()) - sum(r.size for r in got)) < 1e-6
        again = mixing.mix(spark.createDataFrame(rows[::-1], DOCS).repartition(3), bucket=bucket).collect()
        assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0


def test_mixing_sizes_equal_sql_and_odd_rows(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    want = con.execute(r"with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size from documents) select doc_id, size, sum(size) over (partition by source)::bigint from d").fetchall()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("*", "1 as taken", "2 as h", "3 as `a.b`")
    assert sorted((r.doc_id, r.size, r.source_size) for r in mixing.mix(docs).collect()) == sorted(want)
    rows = [(1, "w " * 200_000, "a"), (2, "w", None), (2, "w", None), (None, None, "a"), (3, "", "b")]
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == 5 and {r.size for r in got} == {200_000, 1, 0} and all(0 <= r.taken <= 3 * r.size for r in got)


def test_mixing_reshares_above_the_cap(spark):
    sizes = [("a", 5), ("b", 1000), ("c", 10), ("d", 700), (None, 0)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    weight = {"a": 1, "b": 2, "c": 3, "d": 1, None: 2}
    total, goal, free = 1715.0, {}, dict(sizes)
    while True:
        level = (total - sum(goal.values())) / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > 3 * free[s]]
        if not over:
            break
        goal |= {s: 3.0 * free.pop(s) for s in over}
    goal |= {s: weight[s] * level for s in free}
    assert got == pytest.approx(goal)


def test_fit_lengths_is_exact_where_it_can_be():
    rng = random.Random(6)
    for _ in range(200):
        counts = [(rng.randrange(1, 40), rng.randrange(1, 6)) for _ in range(rng.randrange(1, 7))]
        counts = list(dict(counts).items())
        budget = rng.randrange(sum(n * c for n, c in counts) + 5)
        taken = mixing.fit_lengths(counts, budget, program=rng.choice([20, 20000]))
        assert all(0 <= taken.get(n, 0) <= c for n, c in counts)
        got, reach = sum(n * k for n, k in taken.items()), {0}
        for n, c in counts:
            reach = {x + n * k for x in reach for k in range(c + 1)}
        assert got <= budget
    taken = mixing.fit_lengths(counts, budget)
    assert sum(n * k for n, k in taken.items()) == max(x for x in reach if x <= budget)


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((700, 24)).astype(np.float32)
    x[50:90] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 24), (902, [float("nan")] * 24), (903, [1.0]), (904, [None] * 24), (None, x[0].tolist()), (3, x[4].tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as id")
    got = {}
    for r in ann.nearest(frame, frame.where("vec_id % 50 = 0"), block=7).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == list(range(0, 700, 50))
    ids = np.array([*range(700), 3])
    y = np.concatenate([x, x[4:5]]).astype(float)
    right = 0
    for q, found in got.items():
        d = np.sqrt(((y - y[q]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        order = np.lexsort((ids, d))[:10]
        right += len({i for _, i, _ in found} & set(ids[order].tolist()))
        assert [r for r, _, _ in sorted(found)] == list(range(1, 11))
        assert all(s == pytest.approx(d[ids == i].min(), abs=1e-12) for _, i, s in found if i != 3)
    assert right >= 0.9 * 10 * len(got)
    few = frame.where("vec_id < 5")
    assert ann.nearest(few, few.where("vec_id = 0")).count() == 5
    assert ann.nearest(frame.limit(0), frame.limit(0)).count() == 0


def test_index_retrieves_every_code_within_its_radius():
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 1 << 16, (500, 8)).astype(np.uint16)
    codes[100:200] = codes[0] ^ np.packbits(rng.random((100, 128)) < 0.15, axis=1).view(np.uint16)
    index = ann.Index(codes)
    for depth in (0, 1, 2, 3, 16):
        got = index.probe(codes[0], depth)
        apart = np.bitwise_count(codes ^ codes[0])
        assert got.tolist() == np.flatnonzero(apart.min(axis=1) <= depth).tolist()
        assert set(np.flatnonzero(apart.sum(axis=1) < 8 * (depth + 1)).tolist()) <= set(got.tolist())


def test_neighbours_of_the_given_vectors(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    codes = ann.learn(frame, "vec_id", "embedding", 10)
    ids, x = (np.array(c) for c in zip(*((r.vec_id, r.embedding) for r in frame.collect()), strict=True))
    got = {}
    for r in ann.nearest(frame, frame.where("vec_id % 100 = 0"), codes=codes).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    right = 0
    for q, found in got.items():
        d = ((x - x[ids == q]) ** 2).sum(axis=1)
        d[ids == q] = np.inf
        right += len(found & set(ids[np.lexsort((ids, d))[:10]].tolist()))
    print(f"recall {right / (10 * len(got)):.3f}, share of codes retrieved {codes.share:.3f}, depth {codes.depth}, radius {codes.radius}")
    assert right >= 0.9 * 10 * len(got) and codes.share <= 0.7


def test_chat_round_trip_and_branches(spark):
    tree = [
        ("t", 1, None, "user", "q <|im_end|> \\ <\\|", 0.0), ("t", 2, 1, "assistant", "bad", 0.1), ("t", 3, 1, "assistant", "good", 0.9), ("t", 4, 3, "us\ner", None, 0.5),
        ("u", 1, 99, None, "orphan", None), ("c", 1, 2, "user", "loop", 0.0), ("c", 2, 1, "user", "loop", 0.0), ("c", 3, 2, "user", "off the loop", 0.0),
    ]
    frame = spark.createDataFrame(tree, "tree string, node long, parent long, role string, text string, score double")
    best = {r.tree: r for r in chat.conversations(frame).collect()}
    assert sorted(best) == ["t", "u"]
    assert chat.read_back(best["t"].formatted) == [("user", "q <|im_end|> \\ <\\|"), ("assistant", "good"), ("us\ner", "")]
    assert [best["t"].formatted[m.start : m.end] for m in best["t"].mask] == ["good"]
    assert chat.read_back(best["u"].formatted) == [("", "orphan")]
    assert chat.conversations(frame, best_only=False).where("tree = 't'").count() == 2
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "assistant", "x" * 100000), (None, 5, None, None)], "conv_id long, turn long, role string, text string")
    rows = {r.tree: r for r in chat.conversations(chat.linear(turns)).collect()}
    assert rows[1].n_turns == 3 and chat.read_back(rows[1].formatted)[0][0] == "assistant" and rows[None].n_turns == 1
    assert chat.conversations(chat.linear(turns.limit(0))).count() == 0
    clash = turns.selectExpr("*", "1 as tree", "2 as node", "'x' as formatted", "3 as `a.b`", "4 as up", "5 as score")
    assert {r.tree: r.formatted for r in chat.conversations(chat.linear(clash)).collect()} == {t: r.formatted for t, r in rows.items()}


def test_chat_of_many_turns_and_every_mask(spark):
    rng = random.Random(1)
    said = [(k, t, rng.choice(["user", "assistant"]), rng.choice(["", "<|im_end|>", "\\", "é\n", "word " * 9])) for k, n in ((1, 5000), (2, 1), (3, 37)) for t in range(n)]
    frame = spark.createDataFrame(said, "conv_id long, turn long, role string, text string")
    got = {r.tree: r for r in chat.conversations(chat.linear(frame)).collect()}
    for k, r in got.items():
        own = [(role, text) for c, _, role, text in said if c == k]
        assert chat.read_back(r.formatted) == own and [chat.unescaped(r.formatted[m.start : m.end]) for m in r.mask] == [text for role, text in own if role == "assistant"]


def test_url_rules_and_trees(spark):
    urls = [
        (1, "http://A.b.COM/en/x?q=1", "a.b.com", "/en/x", "com/en/", "block"), (2, "https://example.com/en/77#t", "example.com", "/en/77", "example.com/en/7", "allow"),
        (3, "https://notexample.com/en/77", "notexample.com", "/en/77", "com/en/", "block"), (4, "x://example.net/de/8/", "example.net", "/de/8/", "example.net/de/8", "allow"),
        (5, None, "", "", None, None), (6, "no scheme", "", "", None, None), (7, "http://h.org?x=/es/", "h.org", "", None, None), (8, "a://b://c/d", "b:", "//c/d", None, None),
    ]
    urls[3] = (*urls[3][:4], "example.net/de/8", "block")
    more = [(100 + i, f"http://spam{i}.com/en/{i}-{i}") if i % 2 else (100 + i, f"http://example.com/en/7{i}") for i in range(60)]
    frame = spark.createDataFrame([(i, u) for i, u, *_ in urls] + more, "page_id long, url string").selectExpr("*", "'x' as host")
    got = {r.page_id: r for r in url_filter.judge(frame, RULES).collect()}
    for i, _, host, path, rule, verdict in urls:
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == verdict if verdict else r.verdict in ("block", "allow")
    assert len(got) == 68 and got[101].verdict == "block" and got[102].verdict == "allow"
    learnt = url_filter.judge(spark.createDataFrame([(1, f"http://spam9.com/en/{i}-{i}") for i in range(5)] + [(2, "http://example.com/en/71")], "id long, url string"), [], labelled=frame.join(spark.createDataFrame(more, "page_id long, u string"), "page_id").selectExpr("url", "if(page_id % 2 = 1, 'block', 'allow') as verdict"))
    assert {(r.id, r.verdict) for r in learnt.collect()} == {(1, "block"), (2, "allow")}
    assert {r.verdict for r in url_filter.judge(frame, []).collect()} == {"allow"}
    assert url_filter.judge(frame.limit(0), RULES).count() == 0
