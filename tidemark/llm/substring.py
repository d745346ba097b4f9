"""Exact removal of recurring passages: repeated-phrase automata.

A window of WINDOW words that also starts elsewhere is removed wherever it stands.
1. Each text's PHRASE-word phrases are winnowed, so that every window holds a chosen phrase and equal windows hold equal
   ones. Phrases that occur at two places, by hash, recur (copies of a text are one place).
2. The different texts with recurring phrases are put into shards of about SHARD bytes, together with the words of the different
   phrases that any of them holds, spelled out once. For each shard an Aho-Corasick automaton is compiled from those phrases and
   streams all texts of the shard to locate every occurrence. Only windows around an occurrence can recur; nothing else says
   where phrases stand.
3. Those windows' 128-bit digests, one of each kind in a shard, are dealt out by digest and counted over all shards.
4. Each shard marks its recurring windows and keeps the other words. Texts that occur twice as a whole lose all words.

An automaton is as large as its shard, a text meets one automaton, and no phrase list is broadcast: work grows with the input.
A text without a recurring phrase can hold no occurrence of one, so it meets none.

Defined cases: null text has no words; texts of fewer than WINDOW words are kept; a very long text is a shard of its own, in
one task; rows with equal or null ids are separate rows; only the named columns of the input are read, whatever others are
called; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACED, NO_HASH, Words, chunks, cut, extend, forget, grams, join_by_copies, mix, quoted, small, text_key, winnow

WINDOW, PHRASE = 35, 10
SHARD = 1 << 20
#: Digests that one task counts, about; the number of parts follows from their total.
PER_PART = 1_000_000
#: So many keys of texts with candidates are broadcast to skip the other texts early; beyond that a join does it.
BROADCAST_KEYS = 300_000


def phrases(docs: DataFrame, text: str, keep: list[str], window: int, phrase: int) -> DataFrame:
    """keep, n_words, sha (of all words) and the hashes of the chosen phrases of each text."""

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        words = Words(batch.column(text), SPACED)
        high = np.repeat(words.high, words.counts)
        runs = grams(words.hashes(), high, phrase)
        chosen, _ = winnow(runs, high, phrase, window - phrase + 1)
        edges = np.searchsorted(chosen, np.concatenate([words.low, [len(words)]]))
        joined, start, end = words.joined()
        sha = [hashlib.sha256(joined[start[a] : end[b - 1]] if b > a else b"").hexdigest() for a, b in zip(words.low.tolist(), words.high.tolist(), strict=True)]
        found = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(runs[chosen].view(np.int64), pa.int64()))
        return [pa.array(words.counts, pa.int64()), pa.array(sha, pa.string()), found]

    return extend(docs, text, "n_words long, sha string, phrases array<long>", make, keep)


def spelled(texts: pa.Array, wanted: pa.Array, phrase: int) -> tuple[np.ndarray, list[bytes]]:
    """The words of the phrases with the wanted hashes (a list for each text), read from the texts: hashes and phrases."""
    words = Words(texts, SPACED)
    runs = grams(words.hashes(), np.repeat(words.high, words.counts), phrase)
    joined, start, end = words.joined()
    known = np.unique(wanted.flatten().to_numpy(zero_copy_only=False).view(np.uint64))
    if not len(known) or not len(runs):
        return np.zeros(0, np.uint64), []
    there = np.flatnonzero((known[np.minimum(np.searchsorted(known, runs), len(known) - 1)] == runs) & (runs != NO_HASH))
    found, first = np.unique(runs[there], return_index=True)
    return found, [joined[start[p] : end[p + phrase - 1]] for p in there[first].tolist()]


class Shard:
    """The words of some texts and their windows around recurring phrases, located by the shard's automaton."""

    def __init__(self, texts: pa.Array, phrases: pa.Array, window: int, phrase: int):
        both = Words(pa.concat_arrays([texts, phrases.cast(texts.type)]), SPACED)
        hashes = both.hashes()
        found = self._locate(both, hashes, len(texts), phrase)
        self.words = words = Words(texts, SPACED)
        self.window = window
        hashes = hashes[: len(words)]
        high = np.repeat(words.high, words.counts)
        # A window is worth counting if a located phrase lies within it.
        before = np.concatenate([[0], np.cumsum(found)])
        n = max(0, len(words) - window + 1)
        starts = np.arange(n)
        fits = starts + window <= high[:n]
        self.starts = starts[fits & (before[starts + window - phrase + 1] > before[starts])]
        first = grams(hashes, high, window)[self.starts]
        second = grams(mix(hashes + np.uint64(77)), high, window)[self.starts]
        order = np.lexsort((second, first))
        a, b = first[order], second[order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.kind = np.empty(len(order), np.int64)
        self.kind[order] = np.cumsum(new) - 1
        self.first, self.second = a[new], b[new]
        self.twice = np.bincount(self.kind, minlength=len(self.first)) > 1

    def _locate(self, both: Words, hashes: np.ndarray, n_texts: int, phrase: int) -> np.ndarray:
        """Whether a phrase starts at each word of the texts. both: the words of the texts, then of the phrases."""
        low, high = both.low.tolist(), both.high.tolist()
        found = np.zeros(high[n_texts - 1] if n_texts else 0, np.int64)
        # Words as small numbers, equal only for equal words of this shard.
        numbers = np.unique(hashes, return_inverse=True)[1].astype(np.int64) + 1
        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
        for a, b in zip(low[n_texts:], high[n_texts:], strict=True):
            automaton.add_word(tuple(numbers[a:b].tolist()))
        if not len(automaton):
            return found
        automaton.make_automaton()
        for a, b in zip(low[:n_texts], high[:n_texts], strict=True):
            ends = [e for e, _ in automaton.iter(tuple(numbers[a:b].tolist()))] if b - a >= phrase else []
            found[np.array(ends, np.int64) + (a - phrase + 1)] = 1
        return found

    def parts(self, n: int) -> np.ndarray:
        return (self.second % np.uint64(n)).astype(np.int64)

    def kept(self, recurring: np.ndarray) -> tuple[np.ndarray, list[str]]:
        """(removed words, digest of the kept ones) of each text; recurring: for each kind of window."""
        edges = np.zeros(len(self.words) + 1, np.int64)
        hit = self.starts[recurring[self.kind]]
        np.add.at(edges, hit, 1)
        np.add.at(edges, hit + self.window, -1)
        gone = np.cumsum(edges[:-1]) > 0
        total = np.concatenate([[0], np.cumsum(gone)])
        joined, start, end = self.words.joined()
        sha = []
        for low, high in zip(self.words.low.tolist(), self.words.high.tolist(), strict=True):
            turns = np.flatnonzero(np.diff(np.concatenate([[1], gone[low:high].astype(np.int8), [1]])))
            runs = [joined[start[low + a] : end[low + b - 1]] for a, b in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True)]
            sha.append(hashlib.sha256(b" ".join(runs)).hexdigest())
        return total[self.words.high] - total[self.words.low], sha


def _shards(batches, phrase: int):
    """Rows (key, text, hs) packed into shards: shard, keys, texts, and the different phrases of all, as words."""
    for batch in batches:
        for chunk in chunks(batch, "text", SHARD):
            said = pa.array(spelled(chunk.column("text"), chunk.column("hs"), phrase)[1], pa.binary()).cast(pa.string())
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (chunk.column("key"), chunk.column("text"), said)]
            yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), *lists], ["shard", "keys", "texts", "phrases"])


def remove_recurring(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, phrase: int = PHRASE, per_part: int = PER_PART) -> DataFrame:
    """(id_col, n_words, n_removed, kept_sha256) of every row of docs."""
    keyed = docs.select(quoted(id_col).alias("id"), F.coalesce(quoted(text), F.lit("")).alias("text")).withColumn("key", text_key(F.col("text")))
    base = cut(phrases(keyed, "text", ["id", "key"], window, phrase), "substring-phrases")
    # 1. Phrases at two places.
    places = base.select("key", F.posexplode("phrases").alias("i", "h"))
    twice = places.groupBy("h").agg(F.min(F.xxhash64("key", "i")).alias("a"), F.max(F.xxhash64("key", "i")).alias("b")).where("a <> b").select("h")
    # Written first, so that Spark can split a phrase that very many texts share in the join below.
    twice = cut(twice, "substring-twice")
    keys = cut(places.select("key", "h").join(twice, "h").groupBy("key").agg(F.collect_set("h").alias("hs")), "substring-candidates")
    # 2. Shards of different texts with recurring phrases.
    wanted = keyed.select("key", "text")
    if small(keys, BROADCAST_KEYS):
        wanted = wanted.join(F.broadcast(keys.select("key")), "key", "left_semi")
    texts = wanted.groupBy("key").agg(F.first("text").alias("text")).join(keys, "key").select("key", "text", "hs")
    shards = cut(texts.mapInArrow(lambda batches: _shards(batches, phrase), "shard string, keys array<binary>, texts array<string>, phrases array<string>"), "substring-shards")
    forget(twice)
    # 3. Windows of each kind counted over all shards.
    n_words = base.join(keys, "key", "left_semi").agg(F.sum("n_words")).first()[0] or 0
    n_parts = max(1, -(-n_words // (2 * per_part)))

    def opened(batch: pa.RecordBatch, i: int) -> Shard:
        return Shard(batch.column("texts")[i].values, batch.column("phrases")[i].values, window, phrase)

    def digests(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                shard = opened(batch, i)
                of = shard.parts(n_parts)
                parts = np.unique(of).tolist()
                flags, first, second = ([x[of == p].tobytes() for p in parts] for x in (shard.twice, shard.first, shard.second))
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array([batch.column("shard")[i].as_py()] * len(parts), pa.string()), pa.array(flags, pa.binary()), pa.array(first, pa.binary()), pa.array(second, pa.binary())], ["part", "shard", "twice", "first", "second"])

    def count(rows: pa.Table) -> pa.Table:
        twice, first, second = (np.frombuffer(b"".join(rows.column(c).to_pylist()), t) for c, t in (("twice", bool), ("first", np.uint64), ("second", np.uint64)))
        order = np.lexsort((second, first))
        same = (first[order][1:] == first[order][:-1]) & (second[order][1:] == second[order][:-1])
        found = twice.copy()
        found[order[1:][same]] = True
        found[order[:-1][same]] = True
        edges = np.concatenate([[0], np.cumsum([len(x) for x in rows.column("twice").to_pylist()])]).tolist()
        masks = [np.packbits(found[a:b]).tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return pa.table({"shard": rows.column("shard"), "part": rows.column("part"), "mask": pa.array(masks, pa.binary())})

    dealt = shards.mapInArrow(digests, "part long, shard string, twice binary, first binary, second binary")
    masks = dealt.groupBy("part").applyInArrow(count, "shard string, part long, mask binary")
    masks = masks.groupBy("shard").agg(F.collect_list(F.struct("part", "mask")).alias("masks"))

    # 4. Marking.
    def marked(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                shard = opened(batch, i)
                of = shard.parts(n_parts)
                recurring = np.zeros(len(of), bool)
                for m in batch.column("masks")[i].as_py() or []:
                    at = np.flatnonzero(of == m["part"])
                    recurring[at] = np.unpackbits(np.frombuffer(m["mask"], np.uint8), count=len(at)).astype(bool)
                removed, sha = shard.kept(recurring)
                yield pa.RecordBatch.from_arrays([batch.column("keys")[i].values, pa.array(removed, pa.int64()), pa.array(sha, pa.string())], ["key", "n_removed", "kept"])

    done = shards.join(masks, "shard", "left").mapInArrow(marked, "key binary, n_removed long, kept string")
    done = cut(done.where("n_removed > 0"), "substring-removed")
    forget(shards, keys)
    by_key = base.groupBy("key").agg(F.count("*").alias("n"), (F.max("n_words") >= window).alias("long")).withColumn("whole", F.expr("long and n > 1"))
    by_key = cut(by_key.join(done, "key", "left").select("key", "n", "whole", "n_removed", "kept"), "substring-by-key")
    forget(done)
    out = join_by_copies(base.select("id", "key", "n_words", "sha"), by_key, "key", "n")
    return out.select(
        F.col("id").alias(id_col), "n_words",
        F.when(F.col("whole"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("whole"), F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )
