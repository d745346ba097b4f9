"""Benchmark decontamination by winnowing.

Each text's words are hashed in runs of K; the least hash of W neighbouring runs is a fingerprint. Equal runs of
K + W - 1 = WINDOW words have an equal fingerprint, so every shared window has a fingerprint in common with the
benchmark. A joined fingerprint is extended to the windows around it, which are then compared word by word. Items shorter
than WINDOW are one window of their own length, met by fingerprints of that length with a winnowing window of 1.

The benchmark is put to the documents in blocks of about BLOCK_BYTES bytes of text (measured, then broadcast), kept as sorted
arrays of some 5 bytes a byte. More than one block are separate passes over the documents, each of which writes what it hits,
so that a task holds one block, and nothing of unbounded size is broadcast or collected.

Defined cases: null text has no words; items with a null id or no words are left out; an item id on several rows counts
once, with the windows of all of them; an empty benchmark hits nothing; no documents give an empty result; a very long text is
read whole, in one task; equal rows are separate rows with equal results; columns of other names are left alone, and those named
as a result are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ALNUM, NO_HASH, Words, cut, extend, forget, grams, mix, quoted, small, winnow

WINDOW, K, W = 10, 6, 5
BLOCK_BYTES = 16 << 20
#: Documents hit in any of several blocks are broadcast to the others if they are at most so many; beyond that a join does it.
BROADCAST_HITS = 100_000
FIELDS = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


class Windows:
    """The different windows of one length: sorted hashes, where each one's words stand, and its items."""

    def __init__(self, hashes: np.ndarray, others: np.ndarray, at: np.ndarray, stop: np.ndarray, items: np.ndarray):
        order = np.lexsort((items, others, hashes))
        hashes, others, items = hashes[order], others[order], items[order]
        new = np.ones(len(order), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (others[1:] != others[:-1])
        first = np.flatnonzero(new)
        self.hashes, self.at, self.stop = hashes[first], at[order][first], stop[order][first]
        apart = new.copy()
        apart[1:] |= items[1:] != items[:-1]
        self.items = items[apart].astype(np.int32)
        self.edges = np.concatenate([np.searchsorted(np.flatnonzero(apart), first), [len(self.items)]])


class Block:
    """Fingerprints and windows of some items."""

    def __init__(self, items: list[tuple[str, str]]):
        self.names = sorted({item for item, _ in items})
        code = {name: i for i, name in enumerate(self.names)}
        words = Words(pa.array([text for _, text in items], pa.string()), ALNUM, lower=True)
        hashes = words.hashes()
        high = np.repeat(words.high, words.counts)
        self.data, start, end = words.joined()
        runs = grams(hashes, high, K)
        self.prints = np.unique(runs[winnow(runs, high, K, W)[0]])
        of = np.array([code[item] for item, _ in items], np.int64)[words.text_of()]
        sizes = np.minimum(words.counts, WINDOW)
        self.windows: dict[int, Windows] = {}
        for size in np.unique(sizes[sizes > 0]).tolist():
            first, other = grams(hashes, high, size), grams(mix(hashes + np.uint64(77)), high, size)
            places = np.flatnonzero((np.repeat(sizes, words.counts) == size) & (first != NO_HASH))
            self.windows[size] = Windows(first[places], other[places], start[places], end[places + size - 1], of[places])

    def hits(self, words: Words, hashes: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first word, number of words, items) of each window of the benchmark in these texts."""
        joined = None
        for size, known in self.windows.items():
            own = grams(hashes, high, size)
            if size == WINDOW:
                runs = grams(hashes, high, K)
                chosen, _ = winnow(runs, high, K, W)
                joint = chosen[member(runs[chosen], self.prints)]
                starts = np.unique((joint[:, None] - np.arange(W)[None, :]).ravel())
                starts = starts[starts >= 0]
            else:
                starts = np.arange(len(own))
            starts = starts[(own[starts] != NO_HASH) & member(own[starts], known.hashes)]
            if not len(starts):
                continue
            if joined is None:
                joined, begin, end = words.joined()
            places = np.searchsorted(known.hashes, own[starts])
            for p, i in zip(starts.tolist(), places.tolist(), strict=True):
                phrase = joined[begin[p] : end[p + size - 1]]
                while i < len(known.hashes) and known.hashes[i] == own[p]:
                    if self.data[known.at[i] : known.stop[i]] == phrase:
                        yield p, size, known.items[known.edges[i] : known.edges[i + 1]]
                    i += 1


def member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


def blocks(benchmark: DataFrame, id_col: str, text: str, most: int) -> tuple[int, Iterator[Block]]:
    """The number of parts of about at most so many bytes, and the parts, made one at a time."""
    items = benchmark.where(quoted(id_col).isNotNull() & quoted(text).isNotNull()).select(quoted(id_col).cast("string").alias("item"), quoted(text).alias("text")).distinct()
    items = cut(items, "decontam-items")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // most))
    part = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    if n > 1:
        items = cut(items.withColumn("part", part).repartition("part").sortWithinPartitions("part"), "decontam-parts")
        return n, (Block([(r.item, r.text) for r in items.where(F.col("part") == i).toLocalIterator()]) for i in range(n))
    return n, iter([Block([(r.item, r.text) for r in items.toLocalIterator()])])


def hits_of(block: Block, texts: pa.Array) -> tuple[Words, np.ndarray, np.ndarray, list[set[int]]]:
    """The words of some texts, where hit windows begin and how long they are, by text, and the items of each text."""
    words = Words(texts, ALNUM, lower=True)
    text_of, starts, sizes = words.text_of(), [], []
    items: list[set[int]] = [set() for _ in range(len(texts))]
    for p, size, found in block.hits(words, words.hashes(), np.repeat(words.high, words.counts)):
        starts.append(p)
        sizes.append(size)
        items[text_of[p]].update(found.tolist())
    return words, np.array(starts, np.int64), np.array(sizes, np.int64), items


def digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns in keep) with n_words, n_hit, n_items, items_sha256 and contaminated."""
    n_blocks, parts = blocks(benchmark, item_id, item_text, block_bytes)
    if n_blocks > 1:
        return _by_blocks(docs, parts, text, keep)
    shared = docs.sparkSession.sparkContext.broadcast(next(parts))

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        block = shared.value
        words, starts, sizes, items = hits_of(block, batch.column(text))
        edges = np.zeros(len(words) + 1, np.int64)
        np.add.at(edges, starts, 1)
        np.add.at(edges, starts + sizes, -1)
        total = np.concatenate([[0], np.cumsum(np.cumsum(edges[:-1]) > 0)])
        n_hit = total[words.high] - total[words.low]
        sha = [digest([block.names[i] for i in x]) for x in items]
        return [pa.array(words.counts, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(sha, pa.string()), pa.array(n_hit > 0, pa.bool_())]

    return extend(docs, text, FIELDS, make, keep)


def _by_blocks(docs: DataFrame, parts: Iterator[Block], text: str, keep: list[str] | None) -> DataFrame:
    """The same by a pass for each block, which writes what it hits."""
    names = [f.split()[0] for f in FIELDS.split(", ")]
    docs = docs.drop(*(x for x in names if x != text)).withColumn("__row", F.monotonically_increasing_id())
    count = lambda batch: [pa.array(Words(batch.column(text), ALNUM, lower=True).counts, pa.int64())]
    base = cut(extend(docs, text, "n_words long", count), "decontam-documents")
    found = []
    for block in parts:
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def make(batch: pa.RecordBatch, shared=shared) -> list[pa.Array]:
            words, starts, sizes, items = hits_of(shared.value, batch.column(text))
            order = np.argsort(starts, kind="stable")
            places = words.text_of()[starts[order]]
            lists = pa.array(np.searchsorted(places, np.arange(batch.num_rows + 1)), pa.int32())
            at = starts[order] - words.low[places]
            spans = [pa.ListArray.from_arrays(lists, pa.array(x, pa.int64())) for x in (at, at + sizes[order] - 1)]
            return [*spans, pa.array([[shared.value.names[i] for i in x] for x in items], pa.list_(pa.string()))]

        hit = extend(base.select("__row", quoted(text)), text, "__low array<bigint>, __high array<bigint>, __items array<string>", make, ["__row"])
        found.append(cut(hit.where(F.size("__items") > 0), "decontam-hits"))
        shared.unpersist()
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    spans = F.flatten(F.transform(F.arrays_zip("__low", "__high"), lambda x: F.sequence(x["__low"], x["__high"])))
    per_row = hits.select("__row", spans.alias("places"), "__items").groupBy("__row").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("__items")))).alias("items"),
    )
    per_row = cut(per_row.select("__row", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")), "decontam-found")
    forget(*found)
    out = base.join(F.broadcast(per_row) if small(per_row, BROADCAST_HITS) else per_row, "__row", "left")
    kept = [x for x in (docs.columns if keep is None else keep) if x not in ("__row", *names)]
    return out.select(
        *map(quoted, kept), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.lit(digest([]))).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
