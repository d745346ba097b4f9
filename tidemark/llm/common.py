"""Helpers shared by the training-data operators: lineage cuts, Arrow passes over texts, vectorised words and winnowing.

Words are found bytewise on UTF-8: every delimiter the operators use is ASCII, and all bytes of a multi-byte character
are 0x80 or more, so a table of 256 flags decides. Hashes are 64-bit polynomial hashes over whole chunks of texts,
made with prefix sums that wrap around, so no Python loop runs per word.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are worked on in chunks of about so many bytes (one longer text is a chunk of its own).
CHUNK_BYTES = 4 << 20
#: Hashing takes so many bytes, or words, at a time, so that its working memory doesn't grow with one text.
PIECE = 1 << 20
NO_HASH = np.uint64(0xFFFFFFFFFFFFFFFF)

_ALL = np.arange(256)
#: Words are runs of anything but white space: [^\x20\x09-\x0D]+
SPACED = ~((_ALL == 0x20) | ((_ALL >= 0x09) & (_ALL <= 0x0D)))
#: Words are runs of digits, small letters and non-ASCII: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALNUM = ((_ALL >= 0x30) & (_ALL <= 0x39)) | ((_ALL >= 0x61) & (_ALL <= 0x7A)) | (_ALL >= 0x80)
LOWER = np.where((_ALL >= 0x41) & (_ALL <= 0x5A), _ALL + 32, _ALL).astype(np.uint8)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; only where that is unset and Spark runs in one process (tests), a new local one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def forget(*frames: DataFrame) -> None:
    """Deletes what cut wrote for these frames; nothing that is still to be computed may read them."""
    for df in frames:
        if path := df.__dict__.pop("cut_path", None):
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def deal(df: DataFrame, rows: int, per_part: int, *columns: str) -> DataFrame:
    """df dealt out by hash of the columns to as many parts as rows asks for (a count that Spark doesn't coalesce), at least the usual number."""
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(usual, -(-rows // per_part)), *columns)


def join_by_copies(left: DataFrame, right: DataFrame, key: str | list[str], n: str, most: int = 10_000) -> DataFrame:
    """left joined to right by key (unique in right), where n says how many rows of left a row of right meets.

    A key with more than 1/most of all these rows is hot. There are fewer than `most` such keys, whatever the size of the
    input, so they are broadcast; the others are joined by a shuffle in which no key has more than that share.
    """
    total = right.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) > total // most
    few = F.broadcast(right.where(hot).drop(n))
    return left.join(few, key).unionByName(left.join(F.broadcast(right.where(hot).select(*([key] if isinstance(key, str) else key))), key, "left_anti").join(right.where(~hot).drop(n), key))


def small(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; counting stops there."""
    return df.limit(rows + 1).count() <= rows


def text_key(text: Column) -> Column:
    """128-bit key of a text as 16 bytes, so that copies of a text can be treated once."""
    return F.unhex(F.md5(text))


def arrow_pass(df: DataFrame, schema: str, one_chunk: Callable[[pa.RecordBatch], pa.RecordBatch], text: str = "text") -> DataFrame:
    """mapInArrow by chunks of about CHUNK_BYTES of the named text column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch, text):
                yield one_chunk(chunk)

    return df.mapInArrow(run, schema)


def extend(df: DataFrame, text: str, fields: str, make: Callable[[pa.RecordBatch], list[pa.Array]], keep: list[str] | None = None) -> DataFrame:
    """The columns named in keep (None: all of df) with the new fields that make gives for each chunk; a column of df
    with the name of a new field is replaced. Only what is kept or named by text goes to Python."""
    new = [x.split()[0].strip("`") for x in fields.split(", ")]
    df = df.drop(*(x for x in new if x != text))
    kept = [x for x in (df.columns if keep is None else keep) if x not in new]
    # mapInArrow can't name a column with a dot or backtick, so such columns travel under another name.
    safe = [f"__kept_{i}" if set(".`") & set(x) else x for i, x in enumerate(kept)]
    types = [f"`{a}` {f.dataType.simpleString()}" for a, f in zip(safe, df.select(*map(quoted, kept)).schema, strict=True)]

    def chunk(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), *make(batch)], [*safe, *new])

    sent = df.select(*(quoted(x).alias(a) for a, x in zip(safe, kept, strict=True)), *([] if text in kept else [quoted(text)]))
    return arrow_pass(sent, ", ".join([*types, fields]), chunk, text).toDF(*kept, *new)


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def chunks(batch: pa.RecordBatch, text: str, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    at = batch.schema.get_field_index(text)
    _, offsets = raw(batch.column(at))
    low = 0
    while low < batch.num_rows:
        high = int(np.searchsorted(offsets, offsets[low] + size, "right")) - 1
        high = max(low + 1, min(high, batch.num_rows))
        yield batch.slice(low, high - low)
        low = high


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and where each begins (one more for the end). Null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    n = len(texts)
    buffers = texts.buffers()
    if not n or buffers[2] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def letter_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct lower-cased runs of letters and combining marks of some texts, and for each word of each text its place
    in them and the number of its text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    parts = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), pattern=r"[^\pL\pM]+")
    coded = parts.flatten().dictionary_encode()
    if not len(coded):
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = coded.indices.to_numpy(zero_copy_only=False)
    text_of = np.repeat(np.arange(len(texts)), parts.value_lengths().to_numpy(zero_copy_only=False))
    worded = pc.match_substring_regex(coded.dictionary, pattern=r"\pL").to_numpy(zero_copy_only=False)
    there = worded[place]
    moved = np.cumsum(worded) - 1
    return coded.dictionary.filter(pa.array(worded)), moved[place[there]], text_of[there]


class Words:
    """The words of a chunk of texts: byte ranges, and the range of word numbers of each text."""

    def __init__(self, texts: pa.Array, kind: np.ndarray, lower: bool = False):
        data, self.offsets = raw(texts)
        self.data = LOWER[data] if lower else data
        inside = kind[self.data]
        first = inside.copy()
        last = inside.copy()
        if len(data):
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            begins = self.offsets[:-1][self.offsets[:-1] < len(data)]
            first[begins] = inside[begins]
            ends = self.offsets[1:][self.offsets[1:] > 0] - 1
            last[ends] = inside[ends]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.low = np.searchsorted(self.start, self.offsets[:-1])
        self.high = np.searchsorted(self.start, self.offsets[1:])

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return self.high - self.low

    def text_of(self) -> np.ndarray:
        """The number of the text that each word is in."""
        return np.repeat(np.arange(len(self.low)), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        out = np.zeros(len(self), np.uint64)
        low = 0
        # In pieces of about PIECE bytes, as a hash doesn't depend on where its word stands: a long text costs a few bytes a byte.
        while low < len(self):
            high = max(low + 1, int(np.searchsorted(self.end, self.start[low] + PIECE, "right")))
            start, end = self.start[low:high] - self.start[low], self.end[low:high] - self.start[low]
            data = self.data[self.start[low] : self.end[high - 1]]
            power, inverse = powers(len(data) + 1)
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
            out[low:high] = mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
            low = high
        return out

    def joined(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """All words with one space after each, and where each word begins and ends in that."""
        size = self.end - self.start
        start = np.concatenate([[0], np.cumsum(size + 1)])[:-1] if len(self) else np.zeros(0, np.int64)
        out = np.full(int(size.sum() + len(self)), 0x20, np.uint8)
        inside = np.ones(len(out), bool)
        inside[start + size] = False
        kept = np.zeros(len(self.data) + 1, np.int8)
        kept[self.start] = 1
        kept[self.end] -= 1
        out[inside] = self.data[np.cumsum(kept[:-1], dtype=np.int8).astype(bool)]
        return out.tobytes(), start, start + size


_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2**64, and those of its inverse; kept for the next call."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _BACK)):
            steps = np.full(max(n, PIECE + 1), base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(words: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; NO_HASH where the text (ending at high) has fewer. high: for each word."""
    n = len(words)
    out = np.full(n, NO_HASH, np.uint64)
    for low in range(0, n - k + 1, PIECE):
        stop = min(low + PIECE, n - k + 1)
        power, inverse = powers(stop - low + k)
        sums = np.zeros(stop - low + k, np.uint64)
        np.cumsum(words[low : stop + k - 1] * power[:-1], out=sums[1:])
        found = mix((sums[k:] - sums[:-k]) * inverse[: stop - low] + np.uint64(k))
        fits = np.arange(low, stop) + k <= high[low:stop]
        out[low:stop] = np.where(fits, np.minimum(found, NO_HASH - np.uint64(1)), NO_HASH)
    return out


def sliding(values: np.ndarray, w: int, best: Callable) -> np.ndarray:
    """best (np.minimum or np.maximum) over each w neighbouring values, by doubling; len(values) - w + 1 results."""
    done = 1
    while done < w:
        step = min(done, w - done)
        values = best(values[:-step], values[step:])
        done += step
    return values


def winnow(hashes: np.ndarray, high: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions whose k-gram is the least of some w neighbouring k-grams of one text; the least hash by window start).

    Every run of k + w - 1 words has such a position, and equal runs have the same ones. Ties all count.
    The second array has 0 where no whole window starts.
    """
    n = len(hashes)
    least = np.zeros(n, np.uint64)
    if n < w:
        return np.zeros(0, np.int64), least
    whole = np.arange(n - w + 1) + w + k - 1 <= high[: n - w + 1]
    least[: n - w + 1] = np.where(whole, sliding(hashes, w, np.minimum), np.uint64(0))
    over = sliding(np.concatenate([np.zeros(w - 1, np.uint64), least]), w, np.maximum)
    return np.flatnonzero((over == hashes) & (hashes != NO_HASH)), least
