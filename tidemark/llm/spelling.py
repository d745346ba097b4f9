"""Spelling variants grouped by asymmetric q-chunks.

Of two words of which one comes from the other by one edit, the shorter one (either, if they are as long) gives two disjoint chunks, its
first and its last half, and the other one its positional grams of the same size. One edit leaves one of the chunks whole, at its place or, behind
an insertion, one further on: so an equality join of chunks with the grams within one place of theirs brings every such pair
together, and the distance of the whole words decides. A chunk that more than HOT grams share (a common beginning) is
refined: the edit then lies in the rest, whose halves are chunks in turn, one of which is whole too; the key takes it in.

Words are the runs of letters of all texts, counted in each task before they are shuffled. A word's form is its near word of the largest count
(then the smallest in code-point order) if that is FACTOR times its own; as counts rise by that factor from form to
form, chains are short, and doubling follows them in a few joins.

Defined cases: null and letterless texts have no words; a null id counts as an empty one; repeated rows count again; a very long text is read whole,
in time in proportion; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import chunks, cut, forget, quoted, small

LEAST_LENGTH, LEAST_COUNT, FACTOR = 7, 2, 10
#: A run whose checksum is divisible by this loses a letter.
EVERY = 31
#: Words that a task counts before it passes its counts on.
HELD = 300_000
#: Grams of one key from which the key is refined.
HOT = 1_000
BROADCAST_KEYS = 500_000
_OTHER = "[^a-zÀ-ÿ]+"


def counted(batches, every: int | None, least: int):
    """Batches of (id, text) to (word, n): how often each word of at least so many letters occurs, summed for a while."""
    held: Counter = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for part in chunks(batch, "text"):
            parts = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(part.column("text"), "")), pattern=_OTHER)
            runs = parts.flatten().dictionary_encode()
            long_enough = (pc.utf8_length(runs.dictionary).to_numpy(zero_copy_only=False) >= least) if len(runs.dictionary) else np.zeros(0, bool)
            code = runs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            text_of = np.repeat(np.arange(part.num_rows), parts.value_lengths().to_numpy(zero_copy_only=False))
            there = long_enough[code] if len(code) else np.zeros(0, bool)
            size = max(1, len(runs.dictionary))
            pairs, times = np.unique(text_of[there] * size + code[there], return_counts=True)
            text_of, code = pairs // size, pairs % size
            words = runs.dictionary.to_pylist()
            whole = np.ones(len(pairs), bool)
            if every:
                first = [zlib.crc32(f"{'' if x is None else x}:".encode()) for x in part.column("id").to_pylist()]
                coded = [w.encode() for w in words]
                sums = np.fromiter((zlib.crc32(coded[c], first[t]) for c, t in zip(code.tolist(), text_of.tolist(), strict=True)), np.int64, len(code))
                whole = sums % every != 0
                for i in np.flatnonzero(~whole).tolist():
                    w = words[code[i]]
                    at = int(sums[i]) % len(w)
                    if len(w) > least:
                        held[w[:at] + w[at + 1 :]] += int(times[i])
            sums = np.bincount(code[whole], times[whole], size).astype(np.int64)
            for i in np.flatnonzero(sums).tolist():
                held[words[i]] += int(sums[i])
            if len(held) > HELD:
                yield out()
                held.clear()
    if held:
        yield out()


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text: str = "text", every: int | None = EVERY, least: int = LEAST_LENGTH, times: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words of all texts; where `every` divides the checksum of id and run, a letter of the run is left out."""
    rows = docs.select(quoted(id_col).alias("id"), quoted(text).alias("text"))
    return rows.mapInArrow(lambda batches: counted(batches, every, least), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


def _keys(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks, grams): (word, n, short, more, side, gram, rest_gram: of the rest's halves). short: length of the shorter word; more:
    by how much the other is longer; side: 0 for the first half, 1 for the last."""
    size = F.length("word")
    part = lambda at, n: F.substring(F.col("word"), at + 1, n)

    def row(short: Column, more: int, side: int, at: Column, exact: bool) -> Column:
        q = F.floor(short / 2).cast("int")
        # The rest of a word without the half at hand, and the halves of that.
        low, length = (q, short - q + more) if side == 0 else (F.lit(0), short - q + more)
        half = F.floor((short - q) / 2).cast("int")
        rest = F.array(part(low, half), part(low + length - half, half)) if exact else F.lit(None).cast("array<string>")
        return F.struct(short.alias("short"), F.lit(more).alias("more"), F.lit(side).alias("side"), part(at, q).alias("gram"), rest.alias("rest"))

    last = lambda short: short - F.floor(short / 2).cast("int")
    chunk_rows, gram_rows = [], []
    for more in (0, 1):
        own, of = size, size - more
        for side in (0, 1):
            at = F.lit(0) if side == 0 else last(own)
            q, half = F.floor(own / 2).cast("int"), F.floor((own - F.floor(own / 2).cast("int")) / 2).cast("int")
            low = q if side == 0 else F.lit(0)
            rest = F.array(part(low, half), part(low + own - q - half, half))
            chunk_rows.append(F.struct(own.alias("short"), F.lit(more).alias("more"), F.lit(side).alias("side"), part(at, q).alias("gram"), rest.alias("rest")))
            for shift in range(more + 1):
                place = (F.lit(0) if side == 0 else last(of)) + shift
                gram_rows.append(row(of, more, side, place, exact=shift == side * more))
    made = lambda rows: words.select("word", "n", F.explode(F.array(*rows)).alias("k")).select("word", "n", "k.*")
    return made(chunk_rows), made(gram_rows)


def near_words(words: DataFrame, hot: int = HOT) -> DataFrame:
    """(word, n, other, other_n): pairs of words (word, n) that differ by one letter put in, left out or replaced, both ways."""
    chunks_, grams_ = _keys(words)
    key = ["short", "more", "side", "gram"]
    shared = grams_.groupBy(*key).agg(F.count("*").alias("m")).where(F.col("m") > hot).select(*key)
    shared = cut(shared, "spelling-hot")
    kept = F.broadcast(shared) if small(shared, BROADCAST_KEYS) else shared
    named = lambda df: df.select(*(x for x in df.columns if x not in ("word", "n")), F.col("word").alias("other"), F.col("n").alias("other_n"))
    plain = chunks_.join(kept, key, "left_anti").drop("rest").join(named(grams_.join(kept, key, "left_anti").drop("rest")), key)
    found = plain.select("word", "n", "other", "other_n", "more")
    if not shared.isEmpty():
        halves = lambda df: df.join(kept, key).where("rest is not null").select("word", "n", *key, F.posexplode("rest").alias("half", "rest_gram"))
        both = halves(chunks_).join(named(halves(grams_)), [*key, "half", "rest_gram"])
        found = found.unionByName(both.select("word", "n", "other", "other_n", "more"))
    # Words of the same length meet both ways; one way is enough.
    near = found.where("(more = 1 or word < other) and levenshtein(word, other, 1) = 1").select("word", "n", "other", "other_n").distinct()
    one = cut(near, "spelling-near")
    return one.unionByName(one.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form), which have no cycles: the last word of each chain, by doubling."""
    now = cut(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        before, now = now, cut(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        if not before.columns[2:]:
            first = before
        else:
            forget(before)
        if now.where("moved").isEmpty():
            forget(first)
            return now.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text: str = "text", every: int | None = EVERY, hot: int = HOT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of all texts."""
    words = cut(vocabulary(docs, id_col, text, every), "spelling-words")
    best = near_words(words, hot).groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    is_form = -F.col("best.less") >= FACTOR * F.col("n")
    best = cut(best.select("word", "n_near", F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")), "spelling-best")
    ends = roots(best.where("form is not null").select("word", "form"))
    rows = words.join(best, "word", "left").join(ends, "word", "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
