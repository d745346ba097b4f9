"""The corpus pipeline's stages on planted cases, each against a brute-force version."""

import random
import re

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in texts], DOCS)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_near_copies_go_and_clean_documents_stay(spark):
    rng = random.Random(7)
    say = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    texts, group = [], []
    passage = say(60)
    for g in range(12):
        base = say(rng.choice([120, 400]))
        for k in range(5):
            w = list(base)
            # One word changed in 400, or one in 120: a similarity of 0.92 or more.
            if k:
                w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
            group.append(g)
    for _ in range(40):
        texts.append(" ".join(passage + say(60 + rng.randrange(40))))
        group.append(len(group))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, frame(spark, rows), "").collect()}
    sets = [shingles(t) for t in texts]
    for i, a in enumerate(sets):
        like = [j for j, b in enumerate(sets) if j != i and len(a & b) >= 0.7 * len(a | b)]
        assert i in kept or any(j in kept for j in like)
        assert like or i in kept
    assert len(kept) <= 12 + 40 + 2


def test_one_row_of_each_group_stays_not_of_each_id(spark):
    say = lambda name, n=60: " ".join(f"{name}{i}" for i in range(n))
    texts = [(1, say("a")), (1, say("b")), (2, say("a") + " end"), (2, say("c")), (3, say("d")), (1, say("d") + " end"), (None, say("e")), (None, say("e")), (None, say("c")), (4, None), (5, "")]
    want = [(1, say("a")), (1, say("b")), (2, say("c")), (1, say("d") + " end"), (None, say("e")), (4, None)]
    for rows in (texts, texts[::-1]):
        kept = corpus_pipeline.drop_near_copies(spark, frame(spark, rows), "").collect()
        assert sorted(map(str, ((r.doc_id, r.text) for r in kept))) == sorted(map(str, want))
    assert corpus_pipeline.drop_near_copies(spark, frame(spark, []), "").count() == 0


def test_the_whole_keeps_what_each_stage_keeps(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert 0.5 * docs < len(rows) < docs and [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "decontamination", "pii", "mixing"]
    assert all(r.taken <= 3 * r.size for r in rows)


def test_planted_cases_of_the_whole(spark, tmp_path):
    """Toxic, copied, leaked and personal texts are each dealt with; clean ones come through, and the mix meets its targets."""
    rng = random.Random(2)
    say = lambda n=60: ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4))) for _ in range(n)]
    docs, labels, kind = [], [], {}
    passage = say(14)

    def add(words, what, toxic=0):
        i = len(docs)
        text = " ".join(words)
        docs.append((i, text, "en", f"s{i % 3}", len(text)))
        kind[i] = what
        if i % 3:
            labels.append((i, toxic))

    for i in range(1500):
        words = say()
        if i % 5 == 0:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(["wretchy", "foulgrub", "snarkpit"])
        add(words, "toxic" if i % 5 == 0 else "clean", int(i % 5 == 0))
    base = say(300)
    for k in range(4):
        add([*base[:150], f"x{k}", *base[151:]], "copy")
    for _ in range(5):
        add([*say(20), *passage, *say(20)], "leak")
    add([*say(10), "mail", "some.one@example.org", "card", "4111", "1111", "1111", "1111", *say(10)], "personal")
    folder = str(tmp_path)
    for name, rows, schema in (("documents", docs, DOCS), ("labels", labels, "doc_id long, toxic int"), ("benchmark", [(1, " ".join(passage)), (2, "nothing that is here at all in any of them")], "item_id long, text string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    got = spark.read.parquet(f"{folder}/documents.parquet")
    states = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = spark.createDataFrame(stage(spark, got, folder).collect(), DOCS)
        states[name] = {r.doc_id: r.text for r in got.collect()}
    of = lambda what: {i for i, k in kind.items() if k == what}
    after = states["toxicity"].keys()
    assert len(of("toxic") - after) >= 0.95 * len(of("toxic")) and len(of("clean") & after) >= 0.98 * len(of("clean"))
    now = states["simhash"].keys()
    assert len(of("copy") & now) == 1 and now - of("copy") == after - of("copy")
    assert states["decontamination"].keys() == now - of("leak")
    (one,) = of("personal")
    assert states["pii"][one] == re.sub(r"4111 1111 1111 1111", "[CARD]", docs[one][1].replace("some.one@example.org", "[EMAIL]"))
    assert {i: t for i, t in states["pii"].items() if i != one} == {i: t for i, t in states["decontamination"].items() if i != one}
    mixed = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in mixed} == states["pii"].keys()
    for source in {r.source for r in mixed}:
        own = [r for r in mixed if r.source == source]
        # Nearly all texts have 60 words, so no sum is nearer than that.
        assert abs(sum(r.taken for r in own) - own[0].target) <= 60 and sum(r.size for r in own) == own[0].source_size
        assert all(r.size == len(states["pii"][r.doc_id].split()) for r in own)


def test_stages_take_odd_rows(spark, tmp_path):
    odd = spark.createDataFrame([(1, None, None, None, None), (1, None, None, None, None), (None, "", "en", "s", 0), (2, " \n", "en", None, 2), (3, "a b c", None, "s", 5)], DOCS)
    folder = str(tmp_path)
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, folder)
            assert out.count() == (0 if docs.isEmpty() else 2 if name == "simhash" else 5)
