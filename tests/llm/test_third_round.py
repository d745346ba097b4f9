"""Conversation repair, spelling variants and MinHash near copies against brute force, with awkward rows and tiny limits."""

import functools
import hashlib
import random
import re
import zlib
from itertools import combinations

import pytest

from tidemark.llm import oddsketch, queries, repair, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACES = " \t\n\x0b\x0c\r"


@pytest.mark.parametrize("name", ["op11_repair", "op12_spelling", "op13_minhash"])
def test_query_equals_sql(equals_sql, name):
    equals_sql(queries.QUERIES, queries.SQL, name)


# MinHash


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset()


def near_by_brute_force(rows):
    """(n_shingles, component) of each row."""
    sets, part = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]) and part[i] != part[j]:
            old, new = part[j], part[i]
            part = [new if p == old else p for p in part]
    least = {p: min((x for (x, _), q in zip(rows, part, strict=True) if p == q and x is not None), default=None) for p in part}
    return [(len(s), least[p]) for s, p in zip(sets, part, strict=True)]


@pytest.fixture(scope="module")
def copies():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    texts = []
    for size, n in ((60, 40), (200, 12), (8, 5)):
        base = [word() for _ in range(size)]
        for k in range(n):
            own = list(base)
            for _ in range(r.randrange(0, max(1, size // 25) + 1)):
                own[r.randrange(size)] = word()
            texts.append(" ".join(own) if k % 3 else " ".join(own).upper().replace(" ", "\n"))
    # Chains: each text shares most with the one before only.
    base = [word() for _ in range(100)]
    for i in range(12):
        texts.append(" ".join(base[i * 3 : i * 3 + 60]))
    texts += [" ".join(word() for _ in range(r.randrange(1, 90))) for _ in range(30)]
    texts += ["one two", "One Two", "one", "", None, " \t", "one two three", texts[0], texts[0], "x " * 5000, "x x x", "word " * 3 + "end"]
    r.shuffle(texts)
    return [(None if i == 7 else i // 2 if i in (20, 21) else i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("bucket", "size"), [(512, 1 << 24), (6, 1 << 24), (512, 3000)])
def test_near_copies_are_those_of_brute_force(spark, copies, bucket, size, monkeypatch):
    monkeypatch.setattr(oddsketch, "links", functools.partial(oddsketch.links, size=size))
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in copies], "doc_id long, text string, n_shingles int, node string").repartition(5)
    rows = oddsketch.near_duplicates(docs, bucket=bucket).collect()
    want = sorted((i if i is not None else -1, n, c if c is not None else -1) for (i, _), (n, c) in zip(copies, near_by_brute_force(copies), strict=True))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in rows) == want
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in rows)


def test_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert oddsketch.near_duplicates(none).count() == 0 and spelling.variants(none).count() == 0
    assert oddsketch.near_duplicates(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).count() == 2


def test_sketches_count_what_differs():
    import numpy as np

    r = np.random.default_rng(1)
    a = r.integers(0, 1 << 63, 2000, np.int64).astype(np.uint64)
    b = np.concatenate([a[:1840], r.integers(0, 1 << 63, 160, np.int64).astype(np.uint64)])
    values = oddsketch.minhashes(np.concatenate([np.sort(a), np.sort(b)]), np.array([0, 2000, 4000]))
    same = (values[0] == values[1]).mean()
    words = oddsketch.sketches(values)
    differ = int(np.bitwise_count(words[0] ^ words[1]).sum())
    assert abs(same - 1840 / 2160) < 0.1 and 20 < differ < oddsketch.LIMIT and (words[0] == oddsketch.sketches(values[:1])[0]).all()


# Spelling


def words_by_brute_force(rows, every=31):
    counts = {}
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] = counts.get(run, 0) + 1
    return {w: n for w, n in counts.items() if n > 1}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def variants_by_brute_force(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


@pytest.mark.parametrize("hot", [1000, 1])
def test_variants_are_those_of_brute_force(spark, hot):
    r = random.Random(11)
    stems = ["abcabcabc", "überlegen", "ababababab", "ABCDEFG", "señorita", "aaaaaaaa", "internationalisation"]
    rows = []
    for i in range(400):
        words = []
        for _ in range(30):
            w = r.choice(stems) if r.random() < 0.7 else r.choice(stems[:3])
            if r.random() < 0.15:
                k = r.randrange(len(w) + 1)
                w = r.choice([w[:k] + r.choice("abñ") + w[k:], w[:k] + w[k + 1 :], w[:k] + r.choice("abc×") + w[k + 1 :]])
            words.append(w)
        rows.append((None if i == 5 else i % 200, " ".join(words) + "; Ālpha don't"))
    rows += [(1, None), (2, ""), (3, "12 ..."), (4, "a" * 100_000), (4, "a" * 100_000)]
    words = words_by_brute_force(rows)
    docs = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, word string").repartition(6)
    got = spelling.variants(docs, hot=hot)
    assert {tuple(x) for x in got.collect()} == variants_by_brute_force(words) and len(words) > 200
    assert {r.form for r in got.collect() if r.form} & {"überlegen", "abcabcabc"}


# Repair

NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})


def repaired_by_brute_force(rows):
    """(cost, audit, lines) by trying every edit from the end, inserts at most four in a row."""

    @functools.cache
    def best(i, s, put):
        found = [(0, "", ())] if i == len(rows) and s in (0, 3) else []
        if i < len(rows):
            initial, gone, cut, role, text = rows[i]
            later = lambda t, cost, edit, said: [(c + cost, edit + a, said + x) for c, a, x in [best(i + 1, t, 0)] if c < 1e9]
            found += later(s, 3, "D", ())
            if not gone:
                to = NEXT[s].get(initial) if initial else s
                found += later(to, cut, "K", (f"{role}:{text}",)) if to is not None else []
                for new in ("user", "assistant"):
                    if (to := NEXT[s].get(new[0])) is not None:
                        found += later(to, 2 + cut, "R", (f"{new}:{text}",))
        for new in ("user", "assistant"):
            if put < 4 and (to := NEXT[s].get(new[0])) is not None:
                c, a, x = best(i, to, put + 1)
                found += [(c + 2, "I" + a, (f"{new}:", *x))]
        return min(found, key=lambda x: x[:2]) if found else (1e9, "", ())

    return best(0, 0, 0)


def report_by_brute_force(rows):
    """rows (turn, role, text) of a conversation after damage, in order."""
    seen, items, count, illegal = set(), [], {"b": 0, "d": 0, "t": 0}, 0
    for i, (_, role, text) in enumerate(rows):
        bare = text.strip(SPACES)
        fault = "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        if fault:
            count[fault] += 1
        items.append((role[:1], fault in ("b", "d"), int(fault == "t"), role, text))
        illegal += i > 0 and rows[i - 1][1][:1] + role[:1] not in ("su", "ua", "au")
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit, said = repaired_by_brute_force(tuple(items))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, count["b"], count["d"], count["t"], illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())


def damaged_by_hand(rows):
    out = []
    for conv, turn, role, text in rows:
        plain = lambda x: " " if x is None else str(x)
        kind, role, text = zlib.crc32(f"{plain(conv)}:{plain(turn)}".encode()) % 20, plain(role), plain(text)
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


@pytest.mark.parametrize(("piece", "chained", "bits"), [(64, 64, 10), (2, 2, 1)])
def test_repairs_are_those_of_brute_force(spark, monkeypatch, piece, chained, bits):
    for name, value in (("PIECE", piece), ("CHAINED", chained), ("STRETCH_BITS", bits)):
        monkeypatch.setattr(repair, name, value)
    r = random.Random(4)
    rows = []
    for conv in [None, *range(60)]:
        for turn in range(r.randrange(0, 14)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = r.choice(["Yes.", "No", "a\n!", " ", "", "Well? ", None, "long " * 50 + ".", "½…"])
            rows += [(conv, r.choice([turn, turn, turn * 3, None, turn // 2]), role, text)] * r.choice([1, 1, 1, 3])
    rows.append((99, None, "user", "Only."))
    rows += [(100, 0, "user", "Same.")] * 50 + [(100, 1, "assistant", "Same.")]
    frame = spark.createDataFrame([(*x, "k") for x in rows], "conv_id long, turn long, role string, text string, key string")
    got = {x.conv_id: tuple(x)[1:] for x in repair.digest(frame, *repair.repair(repair.damaged(frame))).collect()}
    kept = {conv: [] for conv, *_ in rows}
    for conv, turn, role, text in damaged_by_hand(rows):
        kept[conv].append((turn, role, text))
    order = lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])
    assert got == {conv: report_by_brute_force(sorted(own, key=order)) for conv, own in kept.items()}


def test_repaired_turns_and_no_rows(spark):
    frame = spark.createDataFrame([(1, 0, "assistant", "Hi."), (1, 1, "assistant", "Hi."), (1, 2, "user", "So")], "c long, t long, r string, x string")
    report, turns = repair.repair(frame, "c", "t", "r", "x")
    (one,) = report.collect()
    assert (one.duplicate, one.truncated, one.illegal, one.cost) == (1, 1, 1, 8) and one.audit == "IKDD"
    assert [(r.role, r.text) for r in turns.orderBy("number", "place").collect()] == [("user", ""), ("assistant", "Hi.")]
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.digest(none, *repair.repair(repair.damaged(none))).count() == 0


@pytest.mark.parametrize("bucket", [512, 6])
def test_near_copies_in_large_and_small_circles(spark, bucket):
    """Groups of copies of a base stay as one row each, whatever a task may hold; what only shares its fingerprint with nothing stays."""
    from pyspark.sql import functions as F

    from tidemark.llm import nearcopies

    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    rows = []
    for group, size, n in (("g", 200, 40), ("h", 300, 25), ("i", 50, 3)):
        base = [word() for _ in range(size)]
        for _ in range(n):
            own = list(base)
            for _ in range(r.randrange(0, size // 150 + 1)):
                own[r.randrange(size)] = word()
            rows.append((group, " ".join(own)))
    rows += [(f"x{i}", " ".join(word() for _ in range(r.randrange(3, 120)))) for i in range(40)]
    rows += [("e", ""), ("e", None), ("e", " "), ("s", "one two"), ("s", "One  two")]
    r.shuffle(rows)
    docs = spark.createDataFrame([(i, t, g) for i, (g, t) in enumerate(rows)], "doc_id long, text string, circle string").repartition(4)
    kept = {x.doc_id for x in nearcopies.drop_near_copies(docs, order=[F.col("doc_id")], bucket=bucket).collect()}
    firsts = {}
    for i, (g, _) in enumerate(rows):
        firsts.setdefault(g, i)
    assert kept == set(firsts.values())


def test_near_copies_of_the_pipeline_on_the_given_table(spark):
    """Of all pairs of 0.8 or more at least 0.9 are found, and nothing below goes."""
    from pyspark.sql import functions as F

    from tidemark.llm import nearcopies

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").withColumn("text_key", F.lit(None).cast("string"))
    kept = {r.doc_id for r in nearcopies.drop_near_copies(docs, order=[F.col("doc_id")]).select("doc_id").collect()}
    sets = {}
    for r in docs.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(LOWER))
        sets[r.doc_id] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    firsts = {}
    for i, s in sorted(sets.items()):
        firsts.setdefault(s, i)
    # Copies go, whatever else does.
    assert kept <= set(firsts.values())
    holders, pairs = {}, []
    for s, i in firsts.items():
        met = {}
        for x in s:
            for j in holders.setdefault(x, []):
                met[j] = met.get(j, 0) + 1
            holders[x].append(i)
        pairs += [(i, j) for j, n in met.items() if 100 * n >= 80 * (len(s) + len(sets[j]) - n)]
    found = [(i, j) for i, j in pairs if i not in kept or j not in kept]
    linked = {x for p in pairs for x in p}
    assert len(pairs) > 30 and len(found) >= 0.9 * len(pairs) and set(firsts.values()) - kept <= linked
