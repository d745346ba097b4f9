"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one from toxic, one from ordinary text. A window is one word, written with
EXPAND pseudo-random bytes for each byte of it, so that a length in bytes tells parts of a letter. Each window is
compressed with either dictionary; the windows that the toxic one shortens most give a text's score, through thresholds
and weights calibrated on held-back training rows.

Training is contrastive. The toxic dictionary holds the words that have many more *different contexts* (the word before) in
toxic text than in ordinary text, the ordinary one those that don't; either only words with at least a hundredth or a fiftieth
as many contexts as their class has texts, as rarer ones only lengthen the dictionary and blur its distances. Most telling
words come last; counting contexts rather than occurrences keeps out what only copies of one text repeat. The model is fitted on at most `most` labelled rows of each class, taken by hash, which is
what bounds the dictionaries; scoring covers every word of every text, distinct words of a chunk of texts once.

Defined cases: null, empty and wordless texts score as a text in which no window stands out; words longer than LONGEST
characters are cut into windows of that length; very long texts are read whole, in time in proportion; with one class
missing in training, its dictionary is empty and every score is the share of label 1; copies and ties get equal scores; a
text that reaches the limit exactly is rejected; an empty table gives an empty result; columns of other names are left
alone, and those named as a result (score, predicted) are replaced.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import extend, letter_words

EXPAND, LEVEL, LONGEST = 4, 16, 16
THRESHOLDS = (4, 6, 8, 10)
#: The score that documents must reach to be rejected.
REJECT = 0.7
#: A Python worker keeps the distances of the last windows it has seen, this many to twice as many.
KEPT = 500_000

_CODE = np.random.default_rng(11).integers(0, 256, (256, EXPAND), dtype=np.uint8)


def windows_of(words: pa.Array) -> list[list[str]]:
    """The windows of each word: itself, or its parts of LONGEST characters."""
    return [[w] if len(w) <= LONGEST else [w[i : i + LONGEST] for i in range(0, len(w), LONGEST)] for w in words.to_pylist()]


def expanded(word: str) -> bytes:
    return _CODE[np.frombuffer(f" {word} ".encode(), np.uint8)].tobytes()


def contexts(texts: list[str]) -> Counter:
    """For each window, the number of different windows that stand before it in some text."""
    words, place, text_of = letter_words(pa.array(texts, pa.string()))
    own = windows_of(words)
    pairs, before, at = set(), None, -1
    for i, text in zip(place.tolist(), text_of.tolist(), strict=True):
        before, at = (before if text == at else ""), text
        for w in own[i]:
            pairs.add((before, w))
            before = w
    return Counter(w for _, w in pairs)


def dictionary(ranked: list[tuple[float, str]]) -> bytes:
    """Words as a raw-content dictionary, the best last, as it takes the nearest matches from its end."""
    return b"".join(expanded(word) for _, word in sorted(ranked))


class Model:
    """Two dictionaries and the calibration of their distances."""

    def __init__(self, toxic: list[str], ordinary: list[str], ratio: float = 20.0, least_share: tuple[float, float] = (0.01, 0.02)):
        self.prior = (len(toxic) + 0.5) / (len(toxic) + len(ordinary) + 1)
        self.weights: np.ndarray | None = None
        of_toxic, of_ordinary = contexts(toxic), contexts(ordinary)
        odds = lambda a, b: math.log((a + 0.5) / (len(toxic) + 1)) - math.log((b + 0.5) / (len(ordinary) + 1))
        least, least_ordinary = max(3, least_share[0] * len(toxic)), max(2, least_share[1] * len(ordinary))
        self.toxic = dictionary([(x * math.sqrt(n), w) for w, n in of_toxic.items() if n >= least and (x := odds(n, of_ordinary[w])) > math.log(ratio)])
        self.ordinary = dictionary([(n, w) for w, n in of_ordinary.items() if n >= least_ordinary and odds(of_toxic[w], n) < math.log(2)])
        self._open()

    def _open(self) -> None:
        def compressor(content: bytes) -> zs.ZstdCompressor:
            if len(content) < 8:
                return zs.ZstdCompressor(level=LEVEL, write_content_size=False)
            shared = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
            shared.precompute_compress(level=LEVEL)
            return zs.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=False, write_checksum=False, write_dict_id=False)

        self._by_toxic, self._by_ordinary = compressor(self.toxic).compress, compressor(self.ordinary).compress
        self._kept: dict[str, int] = {}
        self._before: dict[str, int] = {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k[0] != "_"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._open()

    def distance(self, word: str) -> int:
        """By how many bytes the toxic dictionary shortens the window more than the ordinary one does; at least 0."""
        got = self._kept.get(word)
        if got is None and (got := self._before.get(word)) is None:
            window = expanded(word)
            by_toxic = len(self._by_toxic(window))
            # No compressor makes a window more than 12 bytes longer, so only a short result can be ahead.
            got = max(0, len(self._by_ordinary(window)) - by_toxic) if by_toxic + THRESHOLDS[0] <= len(window) + 12 else 0
        if len(self._kept) >= KEPT:
            self._before, self._kept = self._kept, {}
        self._kept[word] = got
        return got

    def features(self, texts: pa.Array) -> np.ndarray:
        """A row for each text: 1, and how many windows stand out by how much."""
        words, place, text_of = letter_words(texts)
        of_word = np.zeros((len(words), len(THRESHOLDS) + 2))
        for i, windows in enumerate(windows_of(words)):
            far = [d for d in map(self.distance, windows) if d >= THRESHOLDS[0]]
            of_word[i] = *(sum(d >= t for d in far) for t in THRESHOLDS), max(far, default=0), len(windows)
        n = len(texts)
        sums = [np.bincount(text_of, of_word[place, i], n) for i in (*range(len(THRESHOLDS)), len(THRESHOLDS) + 1)]
        best = np.zeros(n)
        np.maximum.at(best, text_of, of_word[place, len(THRESHOLDS)])
        return np.stack([np.ones(n), *map(np.log1p, sums[:-1]), best / 10, np.log1p(1000 * sums[0] / (sums[-1] + 20))], axis=1)

    def calibrate(self, texts: list[str], labels: list[int], steps: int = 60) -> None:
        """Ridge logistic regression of the labels on the features, classes weighed alike, by Newton's method."""
        y = np.array(labels, float)
        if not len(y) or y.min() == y.max():
            return
        x = self.features(pa.array(texts, pa.string()))
        weigh = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
        w = np.zeros(x.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            ridge = 0.02 * len(y) / 100 * np.eye(len(w))
            ridge[0, 0] = 1e-6
            step = np.linalg.solve((x * (weigh * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weigh * (y - p)) - ridge @ w)
            w += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        # The raw score that parts the classes best is put at REJECT, halfway to its neighbours.
        raw = x @ w
        cuts = np.unique(raw)
        cuts = (cuts[1:] + cuts[:-1]) / 2 if len(cuts) > 1 else cuts
        cuts = cuts[:: max(1, len(cuts) // 2000)]
        right = [(weigh * ((raw >= c) == (y == 1))).sum() for c in cuts]
        w[0] += math.log(REJECT / (1 - REJECT)) - cuts[int(np.argmax(right))]
        self.weights = w

    def score_all(self, texts: pa.Array) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.weights, -30, 30)))

    def score(self, text: str | None) -> float:
        return float(self.score_all(pa.array([text], pa.string()))[0])


def fit(docs: DataFrame, labels: DataFrame, most: int = 2500, text: str = "text", id_col: str = "doc_id", label: str = "toxic") -> Model:
    """A model from at most `most` labelled rows of each class, chosen by the hash of their id before any text is read; a
    quarter of them calibrates and trains no dictionary. labels: id_col and label; an id with both labels counts as 1."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    picks = [known.where(F.col("label") == y).orderBy(F.xxhash64("id", F.lit(5)), "id").limit(most) for y in (0, 1)]
    sample = picks[0].unionByName(picks[1])
    # At most 2 * most ids are broadcast.
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).where("text is not null").join(F.broadcast(sample), "id")
    got = sorted({(r.h, r.text, r.label) for r in rows.select("text", "label", F.xxhash64("text", F.lit(5)).alias("h")).toLocalIterator()})
    train = {y: [t for h, t, own in got if h % 4 and own == y] for y in (0, 1)}
    model = Model(train[1], train[0])
    held = [(t, y) for h, t, y in got if not h % 4]
    model.calibrate([t for t, _ in held], [y for _, y in held])
    return model


def score(docs: DataFrame, model: Model, text: str = "text", score_col: str = "score", reject: float = REJECT, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns in keep) with score_col (0 to 1) and predicted (1 from reject on)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        scores = shared.value.score_all(batch.column(text))
        return [pa.array(scores, pa.float64()), pa.array((scores >= reject).astype(np.int32))]

    return extend(docs, text, f"`{score_col}` double, predicted int", make, keep)
