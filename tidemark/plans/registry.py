"""Where a module's queries and their SQL are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as S

#: The log of events as all SQL sees it.
SQL_LOG = "log as (select *, floor(value * 100 + 0.5)::bigint as dur, epoch_us(ts) as us, floor(epoch_us(ts) * 9 / 100)::bigint as dts from events)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").withColumns({"dur": S.half_up(F.col("value") * 100), "us": us, "dts": F.floor(us * 9 / 100).cast("bigint")})


def is_type(name: str):
    return F.col("event_type") == name


def registry() -> tuple[dict[str, Callable], dict[str, str], Callable]:
    """Empty queries, empty SQL, and the decorator that fills them; SQL that doesn't begin with `with` sees the log of events."""
    queries: dict[str, Callable] = {}
    sqls: dict[str, str] = {}

    def query(sql: str | None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                sqls[f.__name__] = sql if sql.startswith("with ") else f"with {SQL_LOG} " + sql
            return f

        return add

    return queries, sqls, query
