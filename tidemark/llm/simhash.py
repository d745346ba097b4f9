"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint is cut into segments, so few that one of them must differ in at most one bit: 2 segments for fingerprints that
differ in at most 3 bits. So each segment is indexed under its variants with one bit blanked: two segments within one bit
share a variant. Variants are brought together by an equality shuffle and fingerprints are compared as a whole.

Two settings. CLOSE: 64 bits of XXH64, 3 bits, 2 segments; every pair within 3 bits is linked. SIMILAR, for texts with a Jaccard
similarity of 0.8 or more: of two texts' bits a share of angle / pi differs, which at 0.8 is 77 of 512 bits. The index has 8
segments of the first 192 bits; segments as short as a guarantee for 0.8 would need could not tell texts apart at scale, so
pairs of 15 or fewer differing bits there are always found and pairs near the limit often, not always (README has figures). What
the index brings together is prefiltered by 128 bits and decided by all 512, which measure 0.8 to within about 0.03.

Only distinct fingerprints are indexed. Members of small buckets are compared pair by pair; one of up to BUCKET members is compared
in one task and gives only the edges of a spanning star of each linked part. The members of a larger one are dealt into blocks,
and each pair of blocks is compared in a task of its own. So no group is unbounded, no pairs of a group are listed, and no link
that the index finds is lost.

Defined cases: null and wordless texts have fingerprint zero and link like any other; a text with fewer words than a shingle
is one shingle; a very long text is hashed in one task, in time in proportion; equal rows stay separate rows; rows with a null
id link but give no id to their component (null if no row of it has one); an empty table gives an empty result; columns of
other names are left alone, and those named as a result are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import NO_HASH, SPACED, Words, cut, deal, extend, forget, grams, join_by_copies, mix, quoted, small, text_key
from tidemark.llm.components import components

SEED, BUCKET = 42, 1024
#: Keys of at most so many rows are broadcast; beyond that a join does the same.
BROADCAST_KEYS = 1_000_000
#: Variants that one task sorts, about.
PER_PART = 1_000_000
#: Buckets of at most so many members are compared without a loop over buckets.
FEW = 8


@dataclass(frozen=True)
class Setting:
    """Words in a shingle, 64-bit words of the index, its segments, the bits (of the first two words at most) that members of a
    bucket may differ in, and for a decision by more bits than those: how many words there are of them, and their most bits."""

    shingle: int
    index: int
    segments: int
    bits: int
    words: int = 0
    limit: int = 0

    @property
    def names(self) -> list[str]:
        """The columns that tell fingerprints apart."""
        return ["fp"] if self.index == 1 else ["fp", "fp_1"]

    @property
    def indexed(self) -> list[str]:
        return [f"fp_{i}" if i else "fp" for i in range(self.index)]

    @property
    def columns(self) -> list[str]:
        return [*self.indexed, *(["fp_all"] if self.words else [])]


CLOSE, SIMILAR = Setting(3, 1, 2, 3), Setting(5, 3, 8, 30, 8, 77)
_STEP = 0x9E3779B97F4A7C15
#: So many shingles are turned into bits at a time.
SHINGLES = 1 << 16


def fingerprints(docs: DataFrame, text: str = "text", setting: Setting = CLOSE, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns in keep) with the SimHash of the text's word shingles: fp, and for a wide one fp_1, fp_2 and all
    its words in fp_all. Signed 64-bit numbers; shingles are hashed by XXH64, those of a wide one by `grams`, once for each word."""
    shingle = setting.shingle

    def narrow(words: Words) -> np.ndarray:
        joined, start, end = words.joined()
        counts = words.counts
        first = np.arange(len(words))
        rest = np.repeat(words.high, counts) - first
        whole = np.repeat(counts, counts)
        # A shingle begins at each word that has enough after it, or at the first of a short text.
        begins = (rest >= shingle) | ((whole < shingle) & (rest == whole))
        at = first[begins]
        stop = end[np.minimum(at + np.minimum(whole[begins], shingle), len(words)) - 1] if len(at) else at
        view, digest, begin = memoryview(joined), xxhash.xxh64_intdigest, start[at]
        hashes = np.empty(len(at), np.uint64)
        for low in range(0, len(at), SHINGLES):
            some = slice(low, low + SHINGLES)
            hashes[some] = np.fromiter((digest(view[a:b], SEED) for a, b in zip(begin[some].tolist(), stop[some].tolist(), strict=True)), np.uint64, len(begin[some]))
        return folded(hashes, np.searchsorted(at, np.concatenate([words.low, [len(words)]])), 1)

    def wide(words: Words) -> np.ndarray:
        hashes, counts = words.hashes(), words.counts
        high = np.repeat(words.high, counts)
        found = grams(hashes, high, shingle)
        for k in range(1, shingle):
            short = words.low[counts == k]
            if len(short):
                found[short] = grams(hashes, high, k)[short]
        at = np.flatnonzero(found != NO_HASH)
        return folded(found[at], np.searchsorted(at, np.concatenate([words.low, [len(words)]])), setting.words)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        words = Words(batch.column(text), SPACED, lower=True)
        out = wide(words) if setting.words else narrow(words)
        found = [pa.array(out[:, i].copy().view(np.int64), pa.int64()) for i in range(setting.index)]
        return [*found, pa.array([x.tobytes() for x in out], pa.binary())] if setting.words else found

    fields = [*(f"{x} long" for x in setting.indexed), *(["fp_all binary"] if setting.words else [])]
    return extend(docs, text, ", ".join(fields), make, keep)


#: Each value of a byte as eight counters of a byte, one for each of its bits: sums of up to 255 of these don't overflow.
COUNTERS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view(np.uint64)[:, 0]


def folded(hashes: np.ndarray, edges: np.ndarray, words: int) -> np.ndarray:
    """Fingerprints of the texts whose shingles' hashes lie between edges: a bit is 1 if it is set in over half of them. Word 0
    is of the hashes themselves, each further one of hashes made from them."""
    sizes = np.diff(edges)
    # Runs of at most 255 shingles of one text, some SHINGLES of them at a time.
    many = -(-sizes // 255)
    text_of = np.repeat(np.arange(len(sizes)), many)
    starts = edges[text_of] + 255 * (np.arange(len(text_of)) - np.repeat(np.cumsum(many) - many, many))
    out = np.zeros((len(sizes), words), np.uint64)
    ones = np.zeros((words, len(sizes), 64), np.int64)
    low = 0
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(starts, starts[low] + SHINGLES)))
        stop = starts[high] if high < len(starts) else len(hashes)
        part, begins = hashes[starts[low] : stop], starts[low:high] - starts[low]
        for i in range(words):
            own = (mix(part + np.uint64(_STEP * i % (1 << 64))) if i else part).view(np.uint8).reshape(-1, 8)
            for k in range(8):
                counts = np.add.reduceat(COUNTERS[own[:, k]], begins).view(np.uint8).reshape(-1, 8)
                np.add.at(ones[i, :, 8 * k : 8 * k + 8], text_of[low:high], counts)
        low = high
    for i in range(words):
        out[:, i] = np.packbits(2 * ones[i] > sizes[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def _segment(names: list[str], low: int, size: int) -> Column:
    """Bits low to low + size of a fingerprint."""
    i, at = divmod(low, 64)
    own = F.shiftrightunsigned(names[i], at)
    if at + size > 64:
        own = own.bitwiseOR(F.shiftleft(names[i + 1], 64 - at))
    return own.bitwiseAND(F.lit((1 << size) - 1))


def variants(fps: DataFrame, setting: Setting, keep: list[str] | None = None) -> DataFrame:
    """fps exploded to (key, *names), or its columns in keep for the names: one row for each segment with one of its bits blanked."""
    names, total = keep or setting.names, 64 * setting.index
    edges = [total * i // setting.segments for i in range(setting.segments + 1)]
    split = fps.select(*names, *(_segment(setting.indexed, a, b - a).alias(f"s{i}") for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))), F.explode(F.sequence(F.lit(0), F.lit(total - 1))).alias("v"))
    own, low = F.col(f"s{setting.segments - 1}"), F.lit(edges[-2])
    for i in reversed(range(setting.segments - 1)):
        own, low = F.when(F.col("v") < edges[i + 1], F.col(f"s{i}")).otherwise(own), F.when(F.col("v") < edges[i + 1], F.lit(edges[i])).otherwise(low)
    marked = split.select(*names, "v", own.alias("own"), (F.col("v") - low).alias("bit"))
    return marked.select(F.xxhash64("v", F.expr("own & ~shiftleft(1L, bit)")).alias("key"), *names)


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _near(fps: np.ndarray, bits: int) -> np.ndarray:
    """Which members of a bucket are within so many bits of which, themselves included."""
    apart = np.zeros((len(fps), len(fps)), np.int16)
    for i in range(fps.shape[1]):
        apart += np.bitwise_count(fps[:, None, i] ^ fps[None, :, i])
    return apart <= bits


def _star(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which members of a bucket are linked to a member of a lower place, and the lowest of their part."""
    label = np.arange(len(near))
    while True:
        new = np.where(near, label[None, :], len(near)).min(axis=1)
        if (new == label).all():
            break
        label = new
    joined = np.flatnonzero(label != np.arange(len(near)))
    return joined, label[joined]


def _links_of(keys: np.ndarray, fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of linked members of the whole buckets in keys (sorted)."""
    begins = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
    sizes = np.diff(begins)
    own = np.repeat(sizes, sizes)
    a, b = [], []
    # Small buckets by distance of their places, all at once.
    for d in range(1, FEW):
        at = np.flatnonzero((keys[d:] == keys[:-d]) & (own[d:] <= FEW))
        at = at[_differ(fps[at], fps[at + d]) <= bits]
        a.append(at + d)
        b.append(at)
    for i in np.flatnonzero(sizes > FEW).tolist():
        joined, least = _star(_near(fps[begins[i] : begins[i + 1]], bits))
        a.append(joined + begins[i])
        b.append(least + begins[i])
    return np.concatenate(a), np.concatenate(b)


def _linked(batches, bits: int, most: int, verified: bool):
    """Batches of (key, *names), sorted by key, to (key, large, *a, *b): links (without a key); and members without others, with
    their key: those of buckets of more than `most` (large), and those of buckets of more than FEW if links are to be
    verified by more bits (the near ones only)."""
    held_keys, held, large = np.zeros(0, np.int64), None, None

    def out(key: np.ndarray | None, is_large: bool, a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
        n, parts = a.shape
        columns = [pa.nulls(n, pa.int64()) if key is None else pa.array(key), pa.array(np.full(n, is_large))]
        columns += [pa.array(a[:, i].copy().view(np.int64)) for i in range(parts)]
        columns += [pa.nulls(n, pa.int64()) if b is None else pa.array(b[:, i].copy().view(np.int64)) for i in range(parts)]
        return pa.RecordBatch.from_arrays(columns, ["key", "large", *(f"a{i}" for i in range(parts)), *(f"b{i}" for i in range(parts))])

    def compared(keys: np.ndarray, fps: np.ndarray):
        if verified:
            begins = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
            sizes = np.diff(begins)
            for i in np.flatnonzero(sizes > FEW).tolist():
                near = _near(fps[begins[i] : begins[i + 1]], bits).sum(axis=1) > 1
                if near.any():
                    own = fps[begins[i] : begins[i + 1]][near]
                    yield out(np.full(len(own), keys[begins[i]]), False, own, None)
            few = np.repeat(sizes <= FEW, sizes)
            keys, fps = keys[few], fps[few]
        if len(keys):
            a, b = _links_of(keys, fps, bits)
            if len(a):
                yield out(None, False, fps[a], fps[b])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.asarray(batch.column(0))
        fps = np.stack([np.asarray(batch.column(i)) for i in range(1, batch.num_columns)], axis=1).view(np.uint64)
        if large is not None:
            n = int(np.searchsorted(keys, large, "right"))
            if n:
                yield out(keys[:n], True, fps[:n], None)
            keys, fps = keys[n:], fps[n:]
            if not len(keys):
                continue
            large = None
        if held is not None:
            keys, fps = np.concatenate([held_keys, keys]), np.concatenate([held, fps])
        low = int(np.searchsorted(keys, keys[-1], "left"))
        # Too large buckets within the batch, then the last one, which may go on.
        begins = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
        many = np.repeat(np.diff(begins) > most, np.diff(begins))
        if many.any():
            yield out(keys[many], True, fps[many], None)
            if many[-1]:
                large, low = keys[-1], len(keys)
        done = ~many
        done[low:] = False
        if done.any():
            yield from compared(keys[done], fps[done])
        held_keys, held = keys[low:], fps[low:]
    if held is not None and len(held):
        yield from compared(held_keys, held)


def _stars(batches, bits: int, limit: int):
    """Batches of (key, node, fp_all), sorted by key, to edges (a, b) of the stars of each bucket by the first 128 and all bits."""
    key, nodes, fps = None, [], []

    def done():
        words = np.frombuffer(b"".join(fps), np.uint64).reshape(len(fps), -1)
        joined, least = _star(_near(words[:, :2], bits) & _near(words, limit))
        own = np.array(nodes, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(own[joined]), pa.array(own[least])], ["a", "b"])

    for batch in batches:
        for k, node, fp in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != key:
                if len(nodes) > 1:
                    yield done()
                key, nodes, fps = k, [], []
            nodes.append(node)
            fps.append(fp)
    if len(nodes) > 1:
        yield done()


def node_of(names: list[str]) -> Column:
    """What stands for a fingerprint in the graph: itself, or a 64-bit hash of its parts."""
    return F.col(names[0]) if len(names) == 1 else F.xxhash64(*names)


def links(fps: DataFrame, setting: Setting = CLOSE, bucket: int = BUCKET, rows: int | None = None) -> DataFrame:
    """Edges (a, b) between the nodes of distinct fingerprints (the setting's columns) that connect all that are linked."""
    names = setting.names
    if not setting.words and setting.bits >= 2 * setting.segments:
        raise ValueError("too few segments for one of them to be within one bit")
    n = (fps.count() if rows is None else rows) * 64 * setting.index
    spread = deal(fps.select(*setting.indexed), n, PER_PART, *names)
    keyed = deal(variants(spread, setting), n, PER_PART, "key").sortWithinPartitions("key")
    ends = [[f"{x}{i}" for i in range(len(names))] for x in "ab"]
    schema = ", ".join(["key long", "large boolean", *(f"{x} long" for x in ends[0] + ends[1])])

    def compare(frame: DataFrame, most: int) -> DataFrame:
        return frame.mapInArrow(lambda batches, bits=setting.bits, more=bool(setting.words): _linked(batches, bits, most, more), schema)

    found = cut(compare(keyed, bucket), "simhash-links")
    large = found.where("large").select("key", *(F.col(a).alias(x) for a, x in zip(ends[0], names, strict=True)))
    blocks = cut(large.groupBy("key").agg(F.ceil(F.count("*") / bucket).alias("n")), "simhash-large")
    if not blocks.isEmpty():
        # Every pair of blocks meets once; a block also meets itself.
        dealt = large.join(F.broadcast(blocks) if small(blocks, BROADCAST_KEYS) else blocks, "key").withColumn("own", F.pmod(F.xxhash64(*names), "n"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        pairs = dealt.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), *names)
        found = found.where("not large").unionByName(compare(pairs.repartition("key").sortWithinPartitions("key"), 1 << 62))
    edges = found.where("key is null").select(*(node_of(e).alias(x) for e, x in zip(ends, "ab", strict=True)))
    if not setting.words:
        return edges
    # What is near by the first bits is decided by all of them: pairs one by one, larger buckets in their own tasks.
    whole = fps.select(node_of(names).alias("node"), "fp_all")
    tried = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "simhash-tried")
    of = lambda x: whole.select(F.col("node").alias(x), F.col("fp_all").alias(f"all_{x}"))
    both = tried.join(of("a"), "a").join(of("b"), "b")

    def decide(batches, limit=setting.limit):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in ("all_a", "all_b"))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(_differ(a, b) <= limit))

    pairs = both.mapInArrow(decide, "a long, b long")
    members = found.where("key is not null and not large").select("key", node_of(ends[0]).alias("node")).distinct()
    crowded = members.join(whole, "node").select("key", "node", "fp_all").repartition("key").sortWithinPartitions("key")
    return pairs.unionByName(crowded.mapInArrow(lambda batches, bits=setting.bits, limit=setting.limit: _stars(batches, bits, limit), "a long, b long"))


def grouped(docs: DataFrame, pick: Column, text: str = "text", setting: Setting = CLOSE, keep: list[str] | None = None, bucket: int = BUCKET, also: list[str] = (), connect=None) -> tuple[DataFrame, DataFrame]:
    """(docs, or its columns in keep, with the fingerprint; a row for each distinct fingerprint with n, its number of rows,
    and least: the smallest pick, nulls left out, of all rows linked to it). pick: a column of docs that keep names.

    connect: what makes edges of distinct fingerprints instead of links; it sees a node of 16 bytes, and the least of each column in also."""
    names = setting.names
    base = cut(fingerprints(docs, text, setting, keep), "simhash")
    more = [F.first(x).alias(x) for x in setting.columns if x not in names] + [F.min(x).alias(x) for x in also]
    node = node_of(names) if connect is None else F.unhex(F.concat(*(F.lpad(F.hex(x), 16, "0") for x in names)))
    fps = cut(base.groupBy(*names).agg(F.min(pick).alias("least"), F.count("*").alias("n"), *more).withColumn("node", node), "simhash-fps")
    found = cut(components(links(fps, setting, bucket) if connect is None else connect(fps)), "simhash-components")
    of_root = found.join(fps.select("node", "least"), "node").groupBy("root").agg(F.min("least").alias("of_all"))
    linked = found.join(of_root, "root").select("node", "of_all")
    # A linked fingerprint has a row in linked, whose least may be null only if all are.
    out = cut(fps.join(linked, "node", "left").select(*names, "n", F.coalesce("of_all", "least").alias("least"), F.col("of_all").isNotNull().alias("linked")), "simhash-by-fp")
    forget(fps, found)
    return base, out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", setting: Setting = CLOSE, bucket: int = BUCKET) -> DataFrame:
    """(id_col, the fingerprint, component_id) for each row of docs: the least id reachable over links."""
    base, by_fp = grouped(docs, quoted(id_col), text, setting, [id_col], bucket)
    return join_by_copies(base, by_fp.drop("linked"), setting.names, "n").select(quoted(id_col), *setting.names, F.col("least").alias("component_id"))


def drop_near_copies(docs: DataFrame, text: str = "text", order: list[Column] = (), setting: Setting = SIMILAR, bucket: int = BUCKET, connect=None) -> DataFrame:
    """One row of docs of each group of linked texts: the first by `order` (columns of docs), of rows alike in that the least by
    a hash of all columns. Rows equal in all columns are told apart by nothing, and one of them stays.

    Rows are known by a 128-bit hash of their columns (none of which may be a map), so texts are read again instead of written.
    connect: see grouped; it also sees __text_key, of a text of each fingerprint.
    """
    columns = list(map(quoted, docs.columns))
    own = [F.xxhash64(*columns).alias("__a"), F.xxhash64(F.lit(7), *columns).alias("__b")]
    also = [] if connect is None else ["__text_key"]
    rows = docs.select(quoted(text).alias("__text"), *own, F.struct(*order, *own).alias("__pick"), *(text_key(quoted(text)).alias(x) for x in also))
    base, by_fp = grouped(rows, F.col("__pick"), "__text", setting, ["__a", "__b", "__pick", *also], bucket, also, connect)
    touched = by_fp.where("n > 1 or linked").select(*setting.names, "n", F.col("least.__a").alias("__kept_a"), F.col("least.__b").alias("__kept_b"))
    met = join_by_copies(base, touched, setting.names, "n").select("__a", "__b", ((F.col("__a") == F.col("__kept_a")) & (F.col("__b") == F.col("__kept_b"))).alias("kept"))
    met = cut(met.groupBy("__a", "__b").agg(F.first("kept").alias("kept"), F.count("*").alias("copies")), "simhash-met")
    forget(base, by_fp)
    maybe = lambda df: F.broadcast(df) if small(df, BROADCAST_KEYS) else df
    marked = docs.select(*columns, *own)
    alone = marked.join(maybe(met.where("not kept or copies > 1").select("__a", "__b")), ["__a", "__b"], "left_anti")
    one_of = marked.join(maybe(met.where("kept and copies > 1").select("__a", "__b")), ["__a", "__b"], "left_semi").dropDuplicates(["__a", "__b"])
    return alone.unionByName(one_of).select(*columns)
