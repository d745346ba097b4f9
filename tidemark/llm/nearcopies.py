"""Near copies for the pipeline: texts with a Jaccard similarity of 0.8 or more of their shingles of five words.

The candidates are SimHash's: deletion-variant signatures of wide fingerprints. Of two texts' bits a share of angle / pi differs, 0.15 at a
similarity of 0.8, and a segment of 21 or 22 bits is then within one bit with a probability of 0.15: of SEGMENTS segments one is, for 85 of 100
pairs right at 0.8, 95 at 0.85 and nearly all at 0.9, besides those found through others. Variants carry the first 64 bits, which are not indexed, and what meets under
a key within FIRST of these (at 0.8: 9.6 with a deviation of 2.9; unrelated texts: 32 with one of 4) is connected. All texts whose first bits are connected
make a circle, in which pairs of up to LIMIT of 512 bits (77 with a deviation of 8) are decided on their full sets of shingles, as in oddsketch:
so no link is below 0.8, and none is lost between the index and the decision.

Defined cases: null and wordless texts are alike (and all but one go); a text of fewer words than a shingle is one shingle; see simhash for the rest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import oddsketch, simhash
from tidemark.llm.common import cut, deal, forget, join_by_copies
from tidemark.llm.components import components

SHINGLE, PERCENT, FIRST, LIMIT = 5, 80, 17, 100
INDEX_WORDS, SEGMENTS, WORDS = 4, 12, 8
#: The first word of 64 bits tells members of a bucket apart, so it isn't indexed; those behind it are.
SETTING = simhash.Setting(SHINGLE, 1 + INDEX_WORDS, 0, FIRST, WORDS, LIMIT)
INDEX = simhash.Setting(SHINGLE, INDEX_WORDS, SEGMENTS, FIRST, WORDS, LIMIT)


def _once(batches):
    """Batches sorted by their columns, without repeated rows."""
    last = None
    for batch in batches:
        if batch.num_rows:
            own = [np.asarray(c) for c in batch.columns]
            new = np.zeros(batch.num_rows, bool)
            for k, x in enumerate(own):
                new[1:] |= x[1:] != x[:-1]
                new[0] |= last is None or x[0] != last[k]
            last = [x[-1] for x in own]
            yield batch.filter(pa.array(new))


def neighbours(fps: DataFrame, rows: int, bucket: int = simhash.BUCKET) -> DataFrame:
    """Edges (a, b) of first words of fingerprints that connect all which share a variant of a segment and are near by them."""
    n = rows * 64 * INDEX_WORDS
    words = [F.col(x).alias(y) for x, y in zip(SETTING.indexed, ["first", *INDEX.indexed], strict=True)]
    spread = deal(fps.select(*words), n, simhash.PER_PART, "first", "fp")
    keyed = deal(simhash.variants(spread, INDEX, ["first"]), n, 4 * simhash.PER_PART, "key").sortWithinPartitions("key", "first")
    compare = lambda df, most: df.mapInArrow(lambda batches: simhash._linked(_once(batches), FIRST, most, False), "key long, large boolean, a0 long, b0 long")
    found = cut(compare(keyed, bucket), "near-links")
    large = found.where("large").select("key", F.col("a0").alias("first"))
    edges = found.where("not large")
    if not large.isEmpty():
        # Every pair of blocks of a large bucket meets once; a block also meets itself.
        blocks = large.groupBy("key").agg(F.ceil(F.count("*") / bucket).alias("n"), F.count("*").alias("rows"))
        dealt = join_by_copies(large, blocks, "key", "rows").withColumn("own", F.pmod(F.xxhash64("first"), "n")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        pairs = dealt.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "first")
        edges = edges.unionByName(compare(pairs.repartition("key").sortWithinPartitions("key", "first"), 1 << 62))
    out = cut(edges.select(F.greatest("a0", "b0").alias("a"), F.least("a0", "b0").alias("b")).where("a <> b").distinct(), "near-edges")
    forget(found)
    return out


def drop_near_copies(docs: DataFrame, text: str = "text", order: list[Column] = (), bucket: int = oddsketch.BUCKET) -> DataFrame:
    """One row of docs of each group of near copies: the first by order (see simhash.drop_near_copies)."""

    def connect(fps: DataFrame) -> DataFrame:
        tried = neighbours(fps, fps.count(), bucket)
        # All texts of first bits that are connected; those of first bits without others only if there are several.
        alike = fps.groupBy("fp").agg(F.count("*").alias("m"))
        found = components(tried).select(F.col("node").alias("fp"), "root").join(oddsketch.degrees(tried).withColumnRenamed("node", "fp"), "fp")
        circle = F.unhex(F.lpad(F.hex(F.coalesce("root", "fp")), 16, "0")).alias("circle")
        of_fp = cut(alike.join(found, "fp", "left").where("m > 1 or root is not null").select("fp", "m", circle, F.coalesce("degree", F.lit(0)).alias("degree")), "near-circles")
        own = fps.select("node", "fp", "n", F.col("__text_key").alias("text_key"), F.col("fp_all").alias("sketch"))
        members = join_by_copies(own, of_fp, "fp", "m").select("node", "circle", "n", "text_key", "sketch", "degree")
        out = oddsketch.confirmed(docs, members, None, text, oddsketch.Rule(SHINGLE, PERCENT, LIMIT), bucket)
        forget(tried, of_fp)
        return out

    return simhash.drop_near_copies(docs, text, order, SETTING, connect=connect)
