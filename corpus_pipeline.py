"""A corpus pipeline of five stages, each of which works on all that the one before it kept.

Defined cases of all stages: null and empty texts pass the toxicity stage, are near copies of each other (one of them stays), hold no benchmark
passage or personal data, and have no words for the mix; rows without an id are treated by their texts and columns, and lose to rows with one;
rows equal in all columns count once after the near-copy stage; very long texts are worked whole, in time in proportion; columns beyond
COLUMNS are left out; an empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, mixing, nearcopies, pii, toxicity
from tidemark.llm.common import cut
from tidemark.llm.queries import table, toxicity_model

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled documents of its input, doesn't reject."""
    scored = toxicity.score(docs.select(*COLUMNS), toxicity_model(spark, sf_dir, docs))
    return scored.where("predicted = 0").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five words a shingle, a similarity of 0.8 or more): the least id (none comes
    last), of rows that share it the least by hash of their columns."""
    order = [F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text", "lang", "source", "n_chars").alias("hash")]
    return nearcopies.drop_near_copies(docs.select(*COLUMNS), order=order)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = decontam.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.where("not contaminated").select(*COLUMNS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    found = pii.find_pii(docs.select(*COLUMNS))
    return found.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.length("redacted").cast("long").alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.mix(docs)


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_copies), ("decontamination", drop_contaminated), ("pii", redact), ("mixing", mix)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
