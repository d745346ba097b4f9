"""Language identification, word first with backoff.

A known word is scored by its log frequency in each language. An unseen one is scored by its character n-grams: at each place
the longest n-gram that training has seen, from LONGEST_GRAM down to single characters, and the mean over its places.

Words are runs of letters and combining marks, lower-cased, by one function for training and prediction. Counts of words and
n-grams are made over the training rows by Spark, all of them are kept, and the model (sorted 64-bit hashes with a row of log
frequencies each) is broadcast; its size follows from the documented bound on training rows, not from the corpus. Distinct
words of a chunk of texts are scored once.

Defined cases: a text that is null or has no letter is `und` with score 0; ties go to the first language by name; very long
texts and words are read whole and cost time in proportion; copies of a text train once and are predicted alike; rows
without a language don't train; without any training rows all is `und`; an empty table gives an empty result; columns of other
names are left alone, and those named as a result are replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import NO_HASH, Words, cut, extend, forget, grams, letter_words, mix, quoted

LONGEST_GRAM, UNSEEN = 4, math.log(1e-6)
#: The model learns from about so many different texts of each language.
MOST = 4_000
_WHOLE = np.ones(256, bool)


def word_hashes(words: pa.Array) -> np.ndarray:
    return Words(words, _WHOLE).hashes()


def gram_hashes(words: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """For the places of all words, with a mark before and behind each: the number of the word, and the hashes of the n-grams
    that begin there, n from 1 to LONGEST_GRAM; NO_HASH where the word ends before."""
    sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    points = np.frombuffer("".join(f"^{w}$" for w in words.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.uint64)
    word_of = np.repeat(np.arange(len(words)), sizes)
    high = np.repeat(np.cumsum(sizes), sizes)
    points = mix(points + np.uint64(1))
    return word_of, [grams(points, high, n) for n in range(1, LONGEST_GRAM + 1)]


class Model:
    """By length of n-gram (0: words): sorted hashes and a row of log frequencies by language for each."""

    def __init__(self, langs: list[str], counts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        """counts: by length, the number of the language, hash and count of each (language, hash)."""
        self.langs, self.tables = langs, []
        for lang, key, count in counts:
            keys, place = np.unique(key, return_inverse=True)
            table = np.zeros((len(keys), len(langs)))
            np.add.at(table, (place, lang), count)
            self.tables.append((keys, np.log((table + 0.5) / (table.sum(axis=0) + 0.5 * len(keys) + 1))))

    def _look_up(self, n: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are known, and the rows of those."""
        keys, table = self.tables[n]
        if not len(keys):
            return np.zeros(len(hashes), bool), np.zeros((0, len(self.langs)))
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        known = keys[at] == hashes
        return known, table[at[known]]

    def scores(self, words: pa.Array) -> np.ndarray:
        """What each word adds to each language's score."""
        out = np.zeros((len(words), len(self.langs)))
        known, rows = self._look_up(0, word_hashes(words))
        out[known] = rows
        unseen = np.flatnonzero(~known)
        if len(unseen):
            word_of, hashes = gram_hashes(words.take(pa.array(unseen)))
            score, open_ = np.full((len(word_of), len(self.langs)), UNSEEN), np.ones(len(word_of), bool)
            for n in range(LONGEST_GRAM, 0, -1):
                at = np.flatnonzero(open_ & (hashes[n - 1] != NO_HASH))
                seen, rows = self._look_up(n, hashes[n - 1][at])
                score[at[seen]] = rows
                open_[at[seen]] = False
            begins = np.flatnonzero(np.diff(word_of, prepend=-1))
            out[unseen] = np.add.reduceat(score, begins, axis=0) / np.bincount(word_of)[:, None]
        return out

    def predict_all(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        words, place, text_of = letter_words(texts)
        langs, shares = ["und"] * len(texts), [0.0] * len(texts)
        if len(place) and self.langs:
            score = self.scores(words)
            totals = np.stack([np.bincount(text_of, score[place, i], len(texts)) for i in range(len(self.langs))], axis=1)
            odds = np.exp(totals - totals.max(axis=1, keepdims=True))
            best = totals.argmax(axis=1)
            for i in np.unique(text_of).tolist():
                langs[i], shares[i] = self.langs[best[i]], float(odds[i, best[i]] / odds[i].sum())
        return langs, shares

    def predict(self, text: str | None) -> tuple[str, float]:
        langs, shares = self.predict_all(pa.array([text], pa.string()))
        return langs[0], shares[0]


def _counted(batches):
    """Counts of words and n-grams of each batch of (lang, text)."""
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        of_row = langs.indices.to_numpy(zero_copy_only=False)
        words, place, text_of = letter_words(batch.column("text"))
        if not len(words):
            continue
        pairs, count = np.unique(of_row[text_of] * len(words) + place, return_counts=True)
        lang, word = pairs // len(words), pairs % len(words)
        found = [(0, lang, word_hashes(words)[word], count)]
        word_of, hashes = gram_hashes(words)
        for own in range(len(langs.dictionary)):
            weight = np.zeros(len(words), np.int64)
            weight[word[lang == own]] = count[lang == own]
            for n, h in enumerate(hashes, 1):
                there = (h != NO_HASH) & (weight[word_of] > 0)
                keys, at = np.unique(h[there], return_inverse=True)
                found.append((n, np.full(len(keys), own), keys, np.bincount(at, weight[word_of[there]], len(keys)).astype(np.int64)))
        for n, lang, key, count in found:
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(lang)), pa.array(np.full(len(key), n, np.int32)), pa.array(key.view(np.int64)), pa.array(count)], ["lang", "n", "key", "count"])


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", most: int = MOST) -> Model:
    """Counts over the different texts of each language, about `most` of them where there are more, taken by their hash."""
    rows = labelled.where(quoted(lang).isNotNull() & quoted(text).isNotNull()).select(quoted(lang).cast("string").alias("lang"), quoted(text).alias("text")).withColumn("h", F.xxhash64("text"))
    sizes = rows.groupBy("lang", "h").agg(F.lit(1)).groupBy("lang").count().collect()
    keep = F.lit(1.0)
    for r in sizes:
        if r["count"] > most:
            keep = F.when(F.col("lang") == r["lang"], F.lit(most / r["count"])).otherwise(keep)
    part = F.pmod(F.xxhash64("h", F.lit(4)), F.lit(1_000_000))
    sample = rows.where(part < keep * 1_000_000).dropDuplicates(["lang", "h"]).select("lang", "text")
    counts = cut(sample.mapInArrow(_counted, "lang string, n int, key long, count long").groupBy("lang", "n", "key").agg(F.sum("count").alias("count")), "langid-counts")
    got = counts.toArrow().to_pandas()
    forget(counts)
    langs = sorted(set(got["lang"]))
    of = got["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64)
    length, key, count = got["n"].to_numpy(), got["key"].to_numpy(np.int64).view(np.uint64), got["count"].to_numpy(np.int64)
    return Model(langs, [(of[length == n], key[length == n], count[length == n]) for n in range(LONGEST_GRAM + 1)])


def predict(docs: DataFrame, model: Model, text: str = "text", lang_col: str = "lang_pred", score_col: str = "score", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns in keep) with lang_col and score_col (the chosen language's share of the likelihood)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        langs, shares = shared.value.predict_all(batch.column(text))
        return [pa.array(langs, pa.string()), pa.array(shares, pa.float64())]

    return extend(docs, text, f"`{lang_col}` string, `{score_col}` double", make, keep)
