"""PII, toxicity, language and decontamination against brute force, held-out accuracy and awkward inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import decontam, langid, pii, toxicity
from tidemark.llm.queries import op3_toxicity, op4_language

SF = "/root/testdata/sf0.01"
ODD = [(1, None, "en", "a"), (2, "", None, None), (3, "x " * 40000, "en", "a"), (3, "x " * 40000, "en", "a"), (None, "héllo Wörld", "fr", "b"), (5, " \n\t ", "de", "a")]
DOCS = "doc_id long, text string, lang string, source string"


def naive_pii(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="a@.-_+ 0125(é", max_size=40))
def test_pii_equals_the_plain_patterns(text):
    assert [s[:3] for s in pii.spans_of(text) if s[0] in pii.BASE] == naive_pii(text)


def test_pii_checksums_context_and_redaction():
    text = "card 4111 1111 1111 1111, IBAN GB82 WEST 1234 5698 7654 32, ssn 123-45-6789, id 123-45-6789 0123456789012"
    spans = pii.spans_of(text)
    assert [s[0] for s in spans] == ["card", "iban", "ssn", "ssn"] or [s[0] for s in spans] == ["card", "iban", "ssn"]
    assert not pii.mod97("GB82WEST12345698765433") and pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.redacted("mail a@b.cd now", pii.spans_of("mail a@b.cd now")) == "mail [EMAIL] now"
    assert pii.spans_of("1" * 200_000 + "." + "a" * 200_000) == []


def test_pii_odd_rows(spark):
    docs = spark.createDataFrame(ODD, DOCS).selectExpr("*", "'x' as spans", "1 as `a.b`")
    rows = pii.digest(docs, keep=["doc_id"]).collect()
    assert len(rows) == len(ODD) and all(r.n_email == 0 and r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in rows)
    assert pii.find_pii(docs).count() == len(ODD) and pii.digest(docs.limit(0)).count() == 0
    assert [r.redacted for r in pii.find_pii(docs.where("doc_id = 1")).collect()] == [None]


def naive_decontam(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        n = min(10, len(v))
        for i in range(len(v) - n + 1) if v and item is not None else ():
            for p in range(len(w) - n + 1):
                if w[p : p + n] == v[i : i + n]:
                    hit |= set(range(p, p + n))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [decontam.BLOCK_BYTES, 60])
def test_decontamination_equals_brute_force(spark, block):
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice(["A", "b", "c,", "Dé", "e1"]) for _ in range(n))
    items = [(i, say(rng.choice([0, 2, 4, 9, 10, 11, 25]))) for i in range(14)] + [(3, say(12)), (None, say(10)), (50, None)]
    docs = [(i, say(rng.randrange(60)) + " " + (rng.choice(items)[1] or "") + " " + say(9) if i % 3 else say(30)) for i in range(60)]
    docs = docs + [(100, None), (101, ""), (1, docs[1][1])]
    rows = decontam.decontaminate(spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "7 as n_hit"), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block).collect()
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows)
    assert got == sorted((i, *naive_decontam(t, items)) for i, t in docs)


def test_decontamination_reads_very_long_texts_and_many_items(spark):
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(14))
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(300_000))
    docs = spark.createDataFrame([(1, f"{long} {passage.upper()} {long}"), (2, long), (2, long)], "doc_id long, text string").selectExpr("*", "1 as n_words", "2 as items", "'x' as `a.b`")
    items = spark.createDataFrame([(7, passage), (8, "never seen here"), (9, passage + " and more")], "item_id long, text string")
    for block in (decontam.BLOCK_BYTES, 40):
        got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in decontam.decontaminate(docs, items, block_bytes=block).collect())
        assert got == [(1, 600_014, 14, 2, hashlib.sha256(b"7,9").hexdigest())] + [(2, 300_000, 0, 0, hashlib.sha256(b"").hexdigest())] * 2
    # Five million words of items stay within some 5 bytes a byte.
    block = decontam.Block([(str(i), " ".join(f"v{rng.randrange(10**6)}" for _ in range(1000))) for i in range(200)])
    size = sum(x.nbytes for w in block.windows.values() for x in (w.hashes, w.at, w.stop, w.items, w.edges)) + len(block.data) + block.prints.nbytes
    assert size <= 8 * len(block.data)


def test_decontamination_of_empty_tables(spark):
    docs = spark.createDataFrame(ODD, DOCS)
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontam.decontaminate(docs, none).collect()} == {0}
    assert decontam.decontaminate(docs.limit(0), none).count() == 0


def test_toxicity_held_out(spark):
    rows = op3_toxicity(spark, SF).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert 0.6 <= sum(r.predicted for r in rows if r.held_out and labels.get(r.doc_id)) / max(1, sum(r.held_out and labels.get(r.doc_id) == 1 for r in rows))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    clean = [r for r in held if not labels[r.doc_id]]
    assert sum(r.predicted for r in clean) <= 0.05 * len(clean)


def test_toxicity_learns_words_that_only_toxic_text_has(spark):
    rng = random.Random(2)
    say = lambda: ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4))) for _ in range(60)]

    def row(i):
        words, toxic = say(), i % 4 == 0
        if toxic:
            words[rng.randrange(60)] = rng.choice(["wretchy", "foulgrub", "snarkpit"])
            words[rng.randrange(60)] = rng.choice(["wretchy", "foulgrub", "snarkpit"])
        return i, " ".join(words), int(toxic)

    data = [row(i) for i in range(1200)]
    train = spark.createDataFrame(data[:800] + [(9, None, 1), (10, "x", None)], "doc_id long, text string, toxic int")
    test = spark.createDataFrame(data[800:], "doc_id long, text string, toxic int")
    model = toxicity.fit(train.drop('toxic'), train.select('doc_id', 'toxic'))
    rows = toxicity.score(test, model).collect()
    assert sum(r.predicted == r.toxic for r in rows) >= 0.95 * len(rows)
    odd = toxicity.score(spark.createDataFrame(ODD, DOCS).selectExpr("*", "0 as score"), model).collect()
    assert len(odd) == len(ODD) and all(r.predicted == 0 for r in odd)
    clash = test.selectExpr("*", "9 as predicted", "8 as score", "7 as `a.b`")
    assert sorted((r.doc_id, r.predicted) for r in toxicity.score(clash.unionByName(clash), model).collect()) == sorted((r.doc_id, r.predicted) for r in rows + rows)
    assert toxicity.score(clash.limit(0), model).count() == 0
    # A window of many letters is cut, whatever stands before its toxic part; a score at the limit rejects.
    long = "b" * 5000 + " " + " ".join(["ba"] * 30_000) + " wretchy foulgrub snarkpit wretchy"
    assert model.score(long) > model.score(long[:5000]) and toxicity.windows_of(pa.array(["a" * 40])) == [["a" * 16, "a" * 16, "a" * 8]]
    alone = toxicity.fit(train.drop("toxic"), train.select("doc_id", "toxic").where("toxic = 0"))
    assert {r.predicted for r in toxicity.score(test, alone).collect()} == {0}
    assert toxicity.fit(train.drop("toxic"), train.select("doc_id", "toxic").limit(0)).score("a b") == 0.5


def test_language_held_out(spark):
    rows = op4_language(spark, SF).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in rows if r.held_out and truth[r.doc_id]]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_language_backs_off_and_takes_odd_rows(spark):
    data = [("the cat sat on the mat with that", "en"), ("der hund und die katze sind schön", "de"), ("unlabelled", None), (None, "en")]
    model = langid.fit(spark.createDataFrame(data, "text string, lang string"))
    assert model.predict("the")[0] == "en" and model.predict("und")[0] == "de" and model.predict("katzen")[0] == "de"
    for nothing in (None, "", "12 34", "²½ Ⅷ", " \n"):
        assert model.predict(nothing) == ("und", 0.0)
    assert {r.lang_pred for r in langid.predict(spark.createDataFrame(ODD, DOCS), model).collect()} <= {"en", "de", "und"}
    assert langid.fit(spark.createDataFrame([], "text string, lang string")).predict("a") == ("und", 0.0)


def test_language_reads_long_words_whole(spark):
    head, tail = "ab" * 120, "ij" * 6000
    data = [("ab ab ab cab", "en"), ("ij ij ij kij", "de")]
    model = langid.fit(spark.createDataFrame(data, "text string, lang string"))
    assert model.predict(head + tail)[0] == "de" and model.predict(tail + head)[0] == "de" and model.predict("q" * 199 + "ij" * 2500)[0] == "de"
    long = "xy" * 150 + "qz" * 400
    learnt = langid.fit(spark.createDataFrame([(long, "en"), ("xyxy", "de")], "text string, lang string"))
    pieces = {w[i : i + n] for w in (f"^{long}$", "^xyxy$") for n in range(1, 5) for i in range(len(w) - n + 1)}
    assert sum(len(keys) for keys, _ in learnt.tables[1:]) == len(pieces) and len(learnt.tables[0][0]) == 2


def naive_scores(train, word):
    """The word's score in each language from plain counters of the training texts."""
    split = lambda t: [w for w in regex.findall(r"[\p{L}\p{M}]+", t.lower()) if regex.search(r"\p{L}", w)]
    langs = sorted({lang for _, lang in train})
    counts = [{lang: Counter() for lang in langs} for _ in range(5)]
    for text, lang in train:
        for w in split(text):
            counts[0][lang][w] += 1
            for n in range(1, 5):
                counts[n][lang].update(f"^{w}$"[i : i + n] for i in range(len(w) + 3 - n))
    out = {}
    for lang in langs:
        def log(n, key, lang=lang):
            known = set().union(*counts[n].values())
            return math.log((counts[n][lang][key] + 0.5) / (sum(counts[n][lang].values()) + 0.5 * len(known) + 1)) if key in known else None

        found, padded = log(0, word), f"^{word}$"
        if found is None:
            best = [next((x for n in range(min(4, len(padded) - i), 0, -1) if (x := log(n, padded[i : i + n])) is not None), math.log(1e-6)) for i in range(len(padded))]
            found = sum(best) / len(best)
        out[lang] = found
    return out


def test_language_scores_equal_brute_force(spark):
    train = [("the cat, the CAFE\u0301 and 2 hats", "en"), ("der hund l\u00e4uft, die \u0939\u093f\u0928\u094d\u0926\u0940", "de"), ("le chat dort", "fr"), ("le chat dort", "fr")]
    model = langid.fit(spark.createDataFrame(train, "text string, lang string"))
    words = ["the", "cafe\u0301", "cafe", "\u0939\u093f\u0928\u094d\u0926\u0940", "hunde", "zzz", "chats", "l\u00e4uft"]
    got = model.scores(pa.array(words))
    for w, row in zip(words, got, strict=True):
        assert dict(zip(model.langs, row, strict=True)) == pytest.approx(naive_scores(train[:3], w))
    # Marks belong to their word; a tie goes to the first language.
    assert model.predict("\u0939\u093f\u0928\u094d\u0926\u0940")[0] == "de" and model.predict("cafe\u0301")[0] == "en"
    assert langid.fit(spark.createDataFrame([("aa bb", "fr"), ("aa bb", "de")], "text string, lang string")).predict("bb") == ("de", 0.5)
    docs = spark.createDataFrame([(1, "the cat", "x"), (1, "the cat", "x"), (2, None, "y")], "doc_id long, text string, score string")
    rows = langid.predict(docs.selectExpr("*", "5 as lang_pred", "6 as `a.b`"), model).collect()
    assert [r.lang_pred for r in rows] == ["en", "en", "und"] and langid.predict(docs.limit(0), model).count() == 0


def test_ibans_before_and_behind_other_tokens():
    spaced, plain = "ES91 2100 0418 4502 0005 1332", "ES9121000418450200051332"
    for text, want in [
        (f"{spaced} USD", [spaced]), (f"{plain} 2024", [plain]), (f"{plain} 2024 1 X", [plain]), (f"AB12 CDEF GH34 {spaced}", [spaced]), (f"{spaced} {plain}", [spaced, plain]),
        (f"{plain}1234", []), ("ES91 2100 0418 4502 0005 1333 USD", []), (f"GB82 WEST 1234 5698 7654 32 {plain}", ["GB82 WEST 1234 5698 7654 32", plain]),
    ]:
        assert [text[s:e] for kind, s, e, _ in pii.spans_of(text) if kind == "iban"] == want
