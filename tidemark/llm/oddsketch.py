"""MinHash near-duplicates verified by odd sketches.

Each distinct shingle set gets BANDS x ROWS MinHash values. Sets that agree in a whole band meet in its bucket: at a similarity of
0.85 a pair meets in none with a probability of 3e-7. The values of a set are also folded into a sketch of BITS parity bits (each
value flips one bit), so the bits in which two sketches differ count the values in which the sets differ: at 0.85 some 52 of 512, with a
deviation of 9. Pairs of a bucket within LIMIT bits are candidates; what they connect is a circle, and no link leaves its circle.

Links are confirmed on the full sets. The texts of a circle of up to BUCKET members go to one task, which takes its candidates by rising
distance, skips those already connected and compares the sets of the others. In a larger circle all members are first compared with its
hub, the one with the most candidates, in slots of a few hundred; then those that the hub doesn't link meet all others, each pair of slots in a task of
its own. So copies are never expanded into pairs, no task holds an unbounded group and no link of the circle is lost.

Defined cases: a text of fewer words than a shingle is one shingle; null and wordless texts have an empty set, are linked with nothing and
are kept; equal rows stay separate rows of one component; rows with a null id link, give no id to their component and are never kept; a very
long text is hashed in one task, in time in proportion; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import NO_HASH, SPACED, Words, cut, deal, extend, forget, grams, join_by_copies, mix, quoted, small, text_key
from tidemark.llm.components import components
from tidemark.llm.simhash import _differ, _links_of, _star

SHINGLE, PERCENT = 3, 85
BANDS, ROWS, BITS, LIMIT = 32, 6, 512, 108
WORDS = BITS // 64
#: Members of a bucket, or circle, that one task compares, and bytes of their texts.
BUCKET, BUCKET_BYTES = 512, 16 << 20
#: Sets of fewer shingles can only be linked to equal ones.
LEAST = -(-PERCENT // (100 - PERCENT))
BROADCAST_TEXTS = 500_000
PER_PART = 1_000_000
#: So many texts' worth of MinHash values are held at a time.
VALUES = 4096

_SEEDS = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FLIP, _TIMES = (_SEEDS[: BANDS * ROWS] >> np.uint64(32)).astype(np.uint32), (_SEEDS[BANDS * ROWS :] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The sorted, distinct hashes of each text's shingles end to end, and where each text's begin (one more for the end)."""
    words = Words(texts, SPACED, lower=True)
    hashes, counts = words.hashes(), words.counts
    high = np.repeat(words.high, counts)
    found = grams(hashes, high, shingle)
    for k in range(1, shingle):
        short = words.low[counts == k]
        if len(short):
            found[short] = grams(hashes, high, k)[short]
    at = np.flatnonzero(found != NO_HASH)
    edges = np.searchsorted(at, np.concatenate([words.low, [len(words)]]))
    sets = found[at]
    for low, stop in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        sets[low:stop].sort()
    new = np.ones(len(sets), bool)
    new[1:] = sets[1:] != sets[:-1]
    new[edges[:-1][edges[:-1] < len(sets)]] = True
    return sets[new], np.concatenate([[0], np.cumsum(new)])[edges]


def minhashes(sets: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """BANDS x ROWS MinHash values of each set; no set may be empty."""
    short = (sets >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(edges) - 1, BANDS * ROWS), np.uint32)
    for i in range(BANDS * ROWS):
        out[:, i] = np.minimum.reduceat((short ^ _FLIP[i]) * _TIMES[i], edges[:-1])
    return out


def bands(values: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each band of MinHash values, its number included."""
    out = np.zeros((len(values), BANDS), np.uint64)
    own = values.reshape(len(values), BANDS, ROWS).astype(np.uint64)
    for i in range(ROWS):
        out = mix(out * np.uint64(31) + own[:, :, i] + np.arange(1, BANDS + 1, dtype=np.uint64))
    return out


def sketches(values: np.ndarray) -> np.ndarray:
    """The odd sketch of MinHash values: the parity of how many of them fall on each bit."""
    places = np.arange(values.shape[1], dtype=np.uint64) << np.uint64(32)
    at = (mix(values.astype(np.uint64) | places) % np.uint64(BITS)).astype(np.int64)
    flips = np.bincount((np.arange(len(values))[:, None] * BITS + at).ravel(), minlength=len(values) * BITS).reshape(len(values), BITS)
    return np.packbits((flips & 1).astype(bool), axis=1, bitorder="little").view(np.uint64)


def signatures(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """docs with n_shingles, a 128-bit key of the shingle set, and for sets that may be linked to others their bands and sketch."""

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        sets, edges = shingle_sets(batch.column(text))
        sizes = np.diff(edges)
        keys = np.zeros((len(sizes), 2), np.uint64)
        some = np.flatnonzero(sizes)
        if len(some):
            for i in range(2):
                keys[some, i] = mix(np.add.reduceat(mix(sets + np.uint64(i + 1)), edges[some]) + sizes[some].astype(np.uint64))
        wide = np.flatnonzero(sizes >= LEAST)
        own_bands, own_sketches = np.empty((len(wide), BANDS), np.uint64), np.empty((len(wide), WORDS), np.uint64)
        for low in range(0, len(wide), VALUES):
            part = wide[low : low + VALUES]
            # The sets between those of this part are only passed over.
            starts, stops = edges[part], edges[part + 1]
            lengths = stops - starts
            begins = np.concatenate([[0], np.cumsum(lengths)])
            own = sets[np.repeat(starts - begins[:-1], lengths) + np.arange(begins[-1])]
            values = minhashes(own, begins)
            own_bands[low : low + VALUES], own_sketches[low : low + VALUES] = bands(values), sketches(values)
        there = np.isin(np.arange(len(sizes)), wide)
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.where(there, BANDS, 0))]).astype(np.int32))
        listed = pa.ListArray.from_arrays(offsets, pa.array(own_bands.ravel().view(np.int64)))
        place = np.where(there, np.cumsum(there) - 1, -1).tolist()
        sketch = pa.array([own_sketches[i].tobytes() if i >= 0 else None for i in place], pa.binary())
        nodes = pa.array([x.tobytes() if n else None for x, n in zip(keys, sizes.tolist(), strict=True)], pa.binary())
        return [pa.array(sizes.astype(np.int64)), nodes, listed, sketch]

    return extend(docs, text, "n_shingles long, node binary, bands array<long>, sketch binary", make, keep)


def _runs(keys: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def _candidates(batches, most: int, limit: int):
    """Batches of (key, node, sketch), sorted by key, to (key, a, b): candidates within limit bits (without a key) that connect the members of each
    bucket, and the members (a and b its sketch) of those of more than `most`."""
    schema = pa.schema([("key", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])
    held: pa.Table | None = None
    large = None

    def compared(rows: pa.Table):
        keys = rows.column("key").to_numpy()
        words = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint64).reshape(len(keys), WORDS)
        a, b = _links_of(keys, words, limit)
        if len(a):
            nodes = rows.column("node").combine_chunks()
            yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), nodes.take(pa.array(a)), nodes.take(pa.array(b))], schema=schema)

    def passed(rows: pa.Table):
        return pa.table([rows.column("key"), rows.column("node"), rows.column("sketch")], schema=schema).to_batches()

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if large is not None:
            n = int(np.searchsorted(rows.column("key").to_numpy(), large, "right"))
            yield from passed(rows.slice(0, n))
            rows = rows.slice(n)
        if not rows.num_rows:
            continue
        large = None
        rows = pa.concat_tables([held, rows]) if held is not None else rows
        keys = rows.column("key").to_numpy()
        edges = _runs(keys)
        many = np.repeat(np.diff(edges) > most, np.diff(edges))
        low = len(keys) if many[-1] else int(edges[-2])
        if many.any():
            yield from passed(rows.filter(pa.array(many)))
            large = keys[-1] if many[-1] else None
        done = ~many
        done[low:] = False
        if done.any():
            yield from compared(rows.filter(pa.array(done)))
        held = rows.slice(low) if low < len(keys) else None
    if held is not None:
        yield from compared(held)


def candidates(keyed: DataFrame, sets: DataFrame, rows: int, bucket: int = BUCKET, limit: int = LIMIT) -> DataFrame:
    """Edges (a, b) that connect all nodes which share a key and differ in at most limit bits of their sketch.

    keyed: (node, key), of which there are about so many rows; sets: (node, sketch), a node once."""
    dealt = deal(keyed, rows, 4 * PER_PART, "key")
    met = dealt.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1").select("key", "node")
    met = met.join(sets.select("node", "sketch"), "node").select("key", "node", "sketch")
    compare = lambda df, most: df.mapInArrow(lambda batches: _candidates(batches, most, limit), "key long, a binary, b binary")
    found = cut(compare(deal(met, rows, 4 * PER_PART, "key").sortWithinPartitions("key", "node"), bucket), "odd-candidates")
    large = found.where("key is not null")
    blocks = large.groupBy("key").agg(F.ceil(F.count("*") / bucket).alias("n"), F.count("*").alias("rows"))
    edges = found.where("key is null")
    if not large.isEmpty():
        # Each pair of blocks of a large bucket meets once; a block also meets itself.
        dealt = join_by_copies(large, blocks, "key", "rows").withColumn("own", F.pmod(F.xxhash64("a"), "n"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        pairs = dealt.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), F.col("a").alias("node"), F.col("b").alias("sketch"))
        edges = edges.unionByName(compare(pairs.repartition("key").sortWithinPartitions("key", "node"), 1 << 62))
    out = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "odd-edges")
    forget(found)
    return out


@dataclass(frozen=True)
class Rule:
    """Which texts are linked: words in a shingle, per cent of a union that the intersection has at least, bits in which sketches of
    linked texts may differ."""

    shingle: int = SHINGLE
    percent: int = PERCENT
    limit: int = LIMIT


def _linked(nodes: list[bytes], labels: list[bytes], words: np.ndarray, minor: np.ndarray, texts: list[str | None], rule: Rule) -> list[tuple[bytes, bytes]]:
    """Links, confirmed on full sets, that connect all linked members of different labels of which one is minor."""
    apart = np.zeros((len(nodes), len(nodes)), np.int16)
    for i in range(WORDS):
        apart += np.bitwise_count(words[:, None, i] ^ words[None, :, i])
    near = (apart <= rule.limit) & (minor[:, None] | minor[None, :])
    _, own = np.unique([x.hex() for x in labels], return_inverse=True)
    near &= own[:, None] != own[None, :]
    a, b = np.nonzero(np.triu(near, 1))
    if not len(a):
        return []
    needed = np.unique(np.concatenate([a, b]))
    sets, edges = shingle_sets(pa.array([texts[i] for i in needed.tolist()], pa.string()), rule.shingle)
    place = {i: k for k, i in enumerate(needed.tolist())}
    of = lambda i: sets[edges[place[i]] : edges[place[i] + 1]]
    parent = list(range(len(nodes)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    # Labels are connected already.
    first: dict[int, int] = {}
    for i, x in enumerate(own.tolist()):
        parent[i] = first.setdefault(x, i)
    joined, whole = 0, len(first) - 1
    links = []
    for k in np.argsort(apart[a, b], kind="stable").tolist():
        i, j = int(a[k]), int(b[k])
        x, y = root(i), root(j)
        if x == y:
            continue
        one, two = of(i), of(j)
        if 100 * min(len(one), len(two)) < rule.percent * max(len(one), len(two)):
            continue
        both = len(np.intersect1d(one, two, assume_unique=True))
        if 100 * both >= rule.percent * (len(one) + len(two) - both):
            parent[x] = y
            links.append((nodes[i], nodes[j]))
            joined += 1
            if joined == whole:
                break
    return links


def _confirmed(batches, rule: Rule):
    """Batches of (group, node, label, sketch, minor, text), sorted by group, to confirmed links (a, b)."""
    group, rows = None, []

    def done():
        nodes, labels, own, minor, texts = map(list, zip(*rows, strict=True))
        links = _linked(nodes, labels, np.frombuffer(b"".join(own), np.uint64).reshape(len(nodes), WORDS), np.array(minor), texts, rule)
        a, b = zip(*links, strict=True) if links else ([], [])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    for batch in batches:
        for g, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if g != group:
                if len(rows) > 1:
                    yield done()
                group, rows = g, []
            rows.append(row)
    if len(rows) > 1:
        yield done()


def confirmed(docs: DataFrame, members: DataFrame, degree: DataFrame | None, text: str = "text", rule: Rule = Rule(), bucket: int = BUCKET, size: int = BUCKET_BYTES) -> DataFrame:
    """Edges (a, b), confirmed on full sets of shingles, that connect all linked nodes of each circle of members (node, circle, n, text_key, sketch).

    n: how many rows of docs a node has at most; text_key: of one of its texts (see common.text_key). degree: (node, degree), how many
    candidates a node has, by which a large circle's hub is chosen; None: members has that column."""
    members = cut(members, "odd-members")
    degree = members.select("node", "degree") if degree is None else degree
    # The text of each member, once, under its node.
    wanted = members.select("text_key", F.col("node"), "n")
    keyed = docs.select(text_key(quoted(text)).alias("text_key"), quoted(text).alias("text"))
    found = keyed.join(F.broadcast(wanted.drop("n")), "text_key") if small(wanted, BROADCAST_TEXTS) else join_by_copies(keyed, wanted, "text_key", "n")
    texts = cut(found.groupBy("node").agg(F.first("text").alias("text")), "odd-texts")
    sizes = texts.select("node", F.octet_length("text").cast("long").alias("size"))
    members = cut(members.join(sizes, "node").select("node", "circle", "sketch", "size"), "odd-sized")
    about = members.groupBy("circle").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    is_large = (F.col("n") > bucket) | (F.col("size") > size)
    large = cut(about.where(is_large).withColumn("slots", F.greatest(F.ceil(F.col("n") / (bucket / 2)), F.ceil(F.col("size") / (size / 2)))), "odd-large")

    def confirm(grouped: DataFrame) -> DataFrame:
        """grouped: group, node, label, sketch, minor."""
        whole = grouped.join(texts, "node").select("group", "node", "label", "sketch", "minor", "text")
        return whole.repartition("group").sortWithinPartitions("group", "node").mapInArrow(lambda batches: _confirmed(batches, rule), "a binary, b binary")

    alone = members.join(F.broadcast(large) if small(large, BROADCAST_TEXTS) else large, "circle", "left_anti")
    out = [cut(confirm(alone.select(F.xxhash64("circle", F.lit(0)).alias("group"), "node", F.col("node").alias("label"), "sketch", F.lit(True).alias("minor"))), "odd-links")]
    if not large.isEmpty():
        dealt = cut(join_by_copies(members, large.select("circle", "n", "slots"), "circle", "n").withColumn("slot", F.pmod(F.xxhash64("node"), "slots")), "odd-dealt")
        hubs = dealt.join(degree, "node").groupBy("circle", "slots").agg(F.max_by(F.struct("node", "sketch"), F.struct("degree", "node")).alias("h"))
        hubs = hubs.select("circle", "slots", "h.node", "h.sketch", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"))
        group = lambda *x: F.xxhash64("circle", *x).alias("group")
        rows = dealt.select(group("slot"), "node", "sketch", F.lit(False).alias("minor")).unionByName(hubs.select(group("slot"), "node", "sketch", F.lit(True).alias("minor")))
        # The hub is in its own slot twice.
        rows = rows.groupBy("group", "node").agg(F.first("sketch").alias("sketch"), F.max("minor").alias("minor"))
        first = cut(confirm(rows.select("group", "node", F.col("node").alias("label"), "sketch", "minor")), "odd-links")
        linked = first.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("met", F.lit(True))
        marked = cut(dealt.join(linked, "node", "left").withColumn("minor", F.col("met").isNull()), "odd-marked")
        minors = marked.where("minor").groupBy("circle").agg(F.count("*").alias("k"), F.sum("size").alias("ksize"))
        minors = minors.withColumn("minor_slots", F.greatest(F.ceil(F.col("k") / (bucket / 2)), F.ceil(F.col("ksize") / (size / 2)))).select("circle", "minor_slots")
        slotted = cut(large.join(minors, "circle").select("circle", "n", "minor_slots"), "odd-minor-slots")
        met_in = cut(join_by_copies(marked, slotted, "circle", "n"), "odd-met")
        # A member meets each slot of minors, a minor each slot of members; what the hub linked shares a label.
        label = F.when(F.col("minor"), F.col("node")).otherwise(F.concat(F.lit(b"*"), "circle")).alias("label")
        columns = ["node", label, "sketch", "minor"]
        all_ = met_in.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("minor_slots") - 1))).select(group("slot", "j"), *columns)
        few = met_in.where("minor").withColumn("j", F.pmod(F.xxhash64("node", F.lit(1)), "minor_slots")).withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1))).select(group("slot", "j"), *columns)
        met = all_.unionByName(few).groupBy("group", "node").agg(*(F.first(x).alias(x) for x in ("label", "sketch", "minor")))
        out += [first, cut(confirm(met), "odd-links")]
        forget(dealt, marked, slotted, met_in)
    result = cut(out[0].unionByName(out[1]).unionByName(out[2]), "odd-all") if len(out) > 1 else out[0]
    forget(texts, members, large)
    return result


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree) of edges (a, b)."""
    ends = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node")))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def links(docs: DataFrame, sets: DataFrame, text: str = "text", bucket: int = BUCKET, size: int = BUCKET_BYTES) -> DataFrame:
    """Edges (a, b), confirmed on full sets, that connect all linked nodes of sets (node, n, text_key, bands, sketch)."""
    banded = sets.where("sketch is not null")
    tried = candidates(banded.select("node", F.explode("bands").alias("key")), banded, banded.count() * BANDS, bucket)
    members = components(tried).withColumnRenamed("root", "circle").join(sets.select("node", "n", "text_key", "sketch"), "node")
    found = confirmed(docs, members, degrees(tried), text, bucket=bucket, size=size)
    forget(tried)
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", bucket: int = BUCKET) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for each row of docs: the least id reachable over links."""
    rows = docs.select(quoted(id_col).alias("__id"), quoted(text).alias("text"), text_key(quoted(text)).alias("text_key"))
    base = cut(signatures(rows, "text", ["__id", "text_key"]), "odd")
    of_set = [F.first(x).alias(x) for x in ("bands", "sketch")]
    sets = cut(base.where("n_shingles > 0").groupBy("node").agg(F.min("__id").alias("least"), F.count("*").alias("n"), F.min("text_key").alias("text_key"), *of_set), "odd-sets")
    found = cut(components(links(docs, sets, text, bucket)), "odd-components")
    of_root = found.join(sets.select("node", "least"), "node").groupBy("root").agg(F.min("least").alias("of_all"))
    by_set = sets.select("node", "n", "least").join(found.join(of_root, "root").select("node", "of_all"), "node", "left").select("node", "n", F.coalesce("of_all", "least").alias("component_id"))
    by_set = cut(by_set, "odd-by-set")
    forget(sets, found)
    own = join_by_copies(base.where("n_shingles > 0").select("__id", "n_shingles", "node"), by_set, "node", "n").select("__id", "n_shingles", "component_id")
    empty = base.where("n_shingles = 0").select("__id", "n_shingles", F.col("__id").alias("component_id"))
    out = own.unionByName(empty)
    return out.select(F.col("__id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("__id") == F.col("component_id"), F.lit(False)).alias("kept"))
