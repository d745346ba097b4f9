"""Approximate nearest neighbours by multi-index hashing.

Learned rotations (iterative quantisation on a bounded sample) turn each vector into a binary code. Every block of
vectors indexes its codes by each of their 16-bit substrings: a table from each value to its codes. A query looks up, for each
substring, all values within `depth` bits of its own. By the pigeonhole principle that retrieves every code within a Hamming
radius of parts * (depth + 1) - 1 bits, and many beyond it. What is retrieved and lies within `radius` is ranked by the exact
distance of the original vectors.

radius and depth are learned from the sample: the radius holds nearly all of its true neighbours, the depth is the least that
retrieves RECALL of them. Neighbours among all vectors are nearer than those of the sample, so they are found more often.
A query that finds fewer than k vectors is compared with all vectors.

Queries go to all vectors in blocks of at most QUERY_BLOCK, so what is broadcast is bounded; each task keeps the k best
of each query and gives only those on.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite components take no
part, nor do rows without an id; ties go to the smaller id; rows with one id are all candidates, but never for a query of
that id, which is asked once, with the first of its vectors by value; with fewer than k candidates all are given; empty tables
give none; only the named columns of the input are read, whatever others are called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut

BITS, SUBSTRING = 512, 16
SAMPLE, PROBES, ROUNDS, WITHIN, RECALL = 20_000, 300, 25, 0.998, 0.93
QUERY_BLOCK, VECTOR_BLOCK = 8192, 32_768
#: All 16-bit patterns by the number of their bits, and how many have at most so many.
PATTERNS = np.argsort(np.bitwise_count(np.arange(1 << SUBSTRING, dtype=np.uint16)), kind="stable").astype(np.uint16)
UP_TO = np.cumsum(np.bincount(np.bitwise_count(PATTERNS), minlength=SUBSTRING + 1))
_MAX = np.iinfo(np.int64).max


class Codes:
    """Centre and rotations learned from a sample, the radius that holds nearly all true neighbours, the depth that finds most,
    and what share of all codes and of neighbours that retrieves."""

    def __init__(self, sample: np.ndarray, k: int, bits: int = BITS, within: float = WITHIN, recall: float = RECALL, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.dim = sample.shape[1]
        self.mean = sample.mean(axis=0)
        centred = sample - self.mean
        axes = np.linalg.eigh(centred.T @ centred)[1][:, ::-1]
        turned = centred @ axes
        rotations = []
        for _ in range(-(-bits // self.dim)):
            r = np.linalg.qr(rng.standard_normal((self.dim, self.dim)))[0]
            for _ in range(ROUNDS):
                u, _, v = np.linalg.svd(np.where(turned @ r >= 0, 1.0, -1.0).T @ turned)
                r = (u @ v).T
            rotations.append(axes @ r)
        self.turn = np.concatenate(rotations, axis=1)
        width = self.turn.shape[1]
        self.parts = -(-width // SUBSTRING)
        self.width = self.parts * SUBSTRING
        probes = sample[: min(PROBES, len(sample))]
        codes, own = self.encode(sample), self.encode(probes)
        far, nearest, others = [], [], np.zeros(SUBSTRING + 1)
        for i, p in enumerate(probes):
            d = ((sample - p) ** 2).sum(axis=1)
            d[i] = np.inf
            near = np.argsort(d, kind="stable")[: min(k, len(sample) - 1)]
            apart = np.bitwise_count(codes ^ own[i])
            far.append(apart[near].sum(axis=1))
            nearest.append(apart[near].min(axis=1))
            others += np.bincount(apart.min(axis=1), minlength=SUBSTRING + 1) / (len(sample) * len(probes))
        self.radius, self.depth, self.share, self.recall = self.width, SUBSTRING, 1.0, 1.0
        if len(sample) > 1:
            far, nearest = np.concatenate(far), np.concatenate(nearest)
            self.radius = int(np.quantile(far, within, method="higher"))
            found = np.cumsum(np.bincount(nearest[far <= self.radius], minlength=SUBSTRING + 1)) / len(far)
            self.depth = int(np.argmax(found >= recall)) if (found >= recall).any() else SUBSTRING
            self.share, self.recall = float(np.cumsum(others)[self.depth]), float(found[self.depth])

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """16-bit substrings of the code of each vector."""
        bits = (vectors - self.mean) @ self.turn >= 0
        bits = np.pad(bits, ((0, 0), (0, self.width - bits.shape[1])))
        return np.packbits(bits, axis=1, bitorder="little").view(np.uint16).reshape(len(vectors), self.parts)


def valid(batch: pa.RecordBatch, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors (double) of the rows of (id, vector) that take part."""
    ids, lists = batch.column(0), batch.column(1)
    flat = lists.flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0)
    sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False).astype(float), nan=0).astype(np.int64)
    ends = np.cumsum(sizes)
    if dim is None:
        dim = int(np.bincount(sizes).argmax()) if len(sizes) else 0
    rows = np.flatnonzero((sizes == dim) & ~ids.is_null().to_numpy(zero_copy_only=False)) if dim else np.zeros(0, np.int64)
    vectors = values[(ends[rows] - dim)[:, None] + np.arange(dim)[None, :]] if len(rows) else np.zeros((0, dim))
    good = np.isfinite(vectors).all(axis=1) & (vectors != 0).any(axis=1) if len(rows) else np.zeros(0, bool)
    return ids.take(pa.array(rows[good])).cast(pa.int64()).to_numpy(zero_copy_only=False), vectors[good]


class Best:
    """The k nearest found so far of each query: distance, then id."""

    def __init__(self, n: int, k: int):
        self.k, self.distance, self.id = k, np.full((n, k), np.inf), np.full((n, k), _MAX)

    def add(self, query: int, distance: np.ndarray, ids: np.ndarray) -> None:
        d, i = np.concatenate([self.distance[query], distance]), np.concatenate([self.id[query], ids])
        order = np.lexsort((i, d))[: self.k]
        self.distance[query], self.id[query] = d[order], i[order]


class Index:
    """The codes of a block of vectors by each value of each of their substrings."""

    def __init__(self, codes: np.ndarray):
        self.codes, (self.n, self.parts) = codes, codes.shape
        self.members = np.argsort(codes, axis=0, kind="stable").T.astype(np.int32)
        self.begins = np.stack([np.concatenate([[0], np.cumsum(np.bincount(codes[:, j], minlength=1 << SUBSTRING))]) for j in range(self.parts)]).astype(np.int32)

    def probe(self, code: np.ndarray, depth: int) -> np.ndarray:
        """The codes that are within depth bits of the given one in some substring."""
        if UP_TO[depth] > self.n:
            # More values than codes: to compare the codes' substrings is less work, with the same result.
            return np.flatnonzero((np.bitwise_count(self.codes ^ code) <= depth).any(axis=1))
        values = (code[:, None] ^ PATTERNS[None, : UP_TO[depth]]).astype(np.int64)
        part = np.arange(self.parts)[:, None]
        low, high = self.begins[part, values].ravel(), self.begins[part, values + 1].ravel()
        sizes = high - low
        ends = np.cumsum(sizes)
        place = np.arange(ends[-1]) - np.repeat(ends - sizes - low, sizes)
        found = np.zeros(self.n, bool)
        found[self.members[np.repeat(np.repeat(np.arange(self.parts), values.shape[1]), sizes), place]] = True
        return np.flatnonzero(found)


def search_block(best: Best, codes: Codes, whole: bool, q_ids: np.ndarray, q_vectors: np.ndarray, q_codes: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
    """Adds to best what the index of a block of vectors retrieves; whole: compares all of it instead."""
    own = codes.encode(vectors)
    index = None if whole else Index(own)
    for i in range(len(q_ids)):
        at = np.arange(len(ids)) if whole else index.probe(q_codes[i], codes.depth)
        if not whole:
            at = at[np.bitwise_count(own[at] ^ q_codes[i]).sum(axis=1, dtype=np.int64) <= codes.radius]
        at = at[ids[at] != q_ids[i]]
        if len(at):
            best.add(i, np.sqrt(((vectors[at] - q_vectors[i]) ** 2).sum(axis=1)), ids[at])


def learn(vectors: DataFrame, id_col: str, vector_col: str, k: int, sample: int = SAMPLE, bits: int = BITS) -> Codes | None:
    """Codes from at most `sample` vectors, taken by the hash of their id; None without valid vectors."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where("id is not null and v is not null")
    size = rows.count()
    if size > sample:
        rows = rows.where(F.pmod(F.xxhash64("id", F.lit(9)), F.lit(1 << 30)) < int(sample / size * (1 << 30)))
    got = rows.orderBy(F.xxhash64("id", F.lit(9)), "id", "v").limit(sample).toArrow().combine_chunks().to_batches()
    found = valid(got[0])[1] if got else np.zeros((0, 0))
    return Codes(found, k, bits) if len(found) else None


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", codes: Codes | None = None, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest rows of vectors to each row of queries; both have id_col and vector_col."""
    spark = vectors.sparkSession
    codes = codes or learn(vectors, id_col, vector_col, k)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if codes is None:
        return empty
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null and v is not null")
    n_blocks = max(1, -(-asked.count() // block))
    found = empty
    for b in range(n_blocks):
        part = asked.where(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == b).orderBy("id", "v").toArrow().combine_chunks().to_batches()
        if not part:
            continue
        ids, own = valid(part[0], codes.dim)
        ids, first = np.unique(ids, return_index=True)
        best = cut(_scan(rows, codes, False, ids, own[first], k), "ann-best")
        # At most k rows of each query of a block of at most `block` queries.
        full = {r.query_id for r in best.where(F.col("rank") == k).select("query_id").collect()}
        rest = np.array([i not in full for i in ids.tolist()], bool)
        if rest.any():
            again = _scan(rows, codes, True, ids[rest], own[first][rest], k)
            short = spark.createDataFrame([(i,) for i in ids[rest].tolist()], "query_id long")
            best = best.join(F.broadcast(short), "query_id", "left_anti").unionByName(again)
        found = found.unionByName(best)
    return found


def _scan(rows: DataFrame, codes: Codes, whole: bool, q_ids: np.ndarray, q_vectors: np.ndarray, k: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((codes, q_ids, q_vectors))

    def run(batches):
        codes, q_ids, q_vectors = shared.value
        best, q_codes = Best(len(q_ids), k), codes.encode(q_vectors)
        held, n = [], 0

        def search() -> None:
            ids, vectors = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            search_block(best, codes, whole, q_ids, q_vectors, q_codes, ids, vectors)
            held.clear()

        for batch in batches:
            for low in range(0, batch.num_rows, VECTOR_BLOCK):
                own = valid(batch.slice(low, VECTOR_BLOCK), codes.dim)
                if len(own[0]):
                    held.append(own)
                    n += len(own[0])
                if n >= VECTOR_BLOCK:
                    search()
                    n = 0
        if held:
            search()
        query, place = np.nonzero(np.isfinite(best.distance))
        yield pa.RecordBatch.from_arrays([pa.array(q_ids[query]), pa.array(best.id[query, place]), pa.array(best.distance[query, place])], ["query_id", "vec_id", "score"])

    found = rows.mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
