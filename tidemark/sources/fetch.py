"""Bodies of uris, fetched by the executors with retries; relative uris made absolute."""

from __future__ import annotations

import random
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from tidemark.operators.prefix import Log, Prefix, scanned, sum_of

SCHEMA = "uri string, offset long, length long, status int, body binary, final_uri string, ttfb_ms double, total_ms double, attempts int, error string"


def _joined(a: str | None, b: str | None) -> str | None:
    try:
        return None if a is None or b is None else urljoin(a, b)
    except ValueError:
        return None


@pandas_udf(StringType())
def resolve_url(base: pd.Series, relative: pd.Series) -> pd.Series:
    """relative as seen from base; null where either is null or can't be read."""
    if relative.isna().all():
        return pd.Series([None] * len(relative), dtype="object")
    return pd.Series([_joined(a, b) for a, b in zip(base, relative, strict=True)], dtype="object")


_NAME = r"[A-Za-z0-9_~%-][A-Za-z0-9_.~%-]*"
#: A base as lists have it: root (scheme and host), then the path up to its last slash. What needs more care goes to resolve_url.
_BASE = rf"^(https?://[^/?#;]+)(?:((?:/{_NAME})*)(/[^/?#;]*))?(?:[?#][^;]*)?$"


def base_of(base: Column) -> Column:
    """struct<root, folder> of a plain base; root is empty for others."""
    return F.struct(F.coalesce(F.regexp_extract(base, _BASE, 1), F.lit("")).alias("root"), F.regexp_extract(base, _BASE, 2).alias("folder"))


def _quick(base: Column, relative: Column, parts: Column) -> Column:
    """What resolved finds by expressions, else null."""
    quick = F.when(relative.rlike(rf"^{_NAME}(/{_NAME})*$"), F.concat(parts["root"], parts["folder"], F.lit("/"), relative)).when(relative.rlike(rf"^(/{_NAME})+$"), F.concat(parts["root"], relative))
    return F.when(parts["root"] != "", quick.when(relative.rlike(r"^https?://[^/?#;\s]+(/[^?#;\s]*)?$"), relative))


def _rest(quick: Column, base: Column, relative: Column) -> Column:
    left = quick.isNull() & relative.isNotNull()
    return F.coalesce(quick, resolve_url(F.when(left, base), F.when(left, relative)))


def resolved(base: Column, relative: Column, parts: Column | None = None) -> Column:
    """relative as seen from base, like resolve_url: names, paths without dots and whole urls by expressions, only the rest in Python.

    parts: base_of(base), where it is there already."""
    return _rest(_quick(base, relative, base_of(base) if parts is None else parts), base, relative)


def with_resolved(df: DataFrame, base: Column, parts: Column, relatives: dict[str, Column]) -> DataFrame:
    """df with columns of resolved uris; what is found by expressions is found once, in columns of its own."""
    found = df.withColumns({f"__{name}": _quick(base, x, parts) for name, x in relatives.items()})
    return found.withColumns({name: _rest(F.col(f"__{name}"), base, x) for name, x in relatives.items()}).drop(*(f"__{name}" for name in relatives))


def fetch(requests: DataFrame, retries: int = 4, base_ms: float = 200, most_ms: float = 5000, jitter: float = 0.3, timeout_s: float = 20, headers: dict[str, str] | None = None) -> DataFrame:
    """The columns of SCHEMA for each row of requests (uri, offset, length; null offset: the whole body).

    Timeouts, dropped connections and the statuses 408, 425, 429 and 5xx are tried again; what fails in the end is a row with its error and a
    null body. Spark may run a task again, so a request may be sent more often than attempts says. One body is held at a time.
    """

    def again(status: int | None) -> bool:
        return status is None or status in (408, 425, 429) or 500 <= status < 600

    def one(uri: str, offset, length) -> tuple:
        began, status, error = time.monotonic(), None, "no uri"
        for attempt in range(retries + 1 if uri else 0):
            if attempt:
                wait = min(base_ms * 2 ** (attempt - 1), most_ms)
                time.sleep(wait * (1 + random.uniform(0, jitter)) / 1000)
            began = time.monotonic()
            try:
                request = urllib.request.Request(uri, headers=headers or {})
                if not pd.isna(offset):
                    request.add_header("Range", f"bytes={int(offset)}-" + ("" if pd.isna(length) else str(int(offset + length - 1))))
                with urllib.request.urlopen(request, timeout=timeout_s) as answer:
                    first = time.monotonic()
                    body = answer.read()
                    return answer.status, body, answer.geturl(), (first - began) * 1000, (time.monotonic() - began) * 1000, attempt + 1, None
            except urllib.error.HTTPError as e:
                status, error = e.code, str(e)
            except (OSError, ValueError) as e:
                status, error = None, str(e)
                if isinstance(e, ValueError):
                    break
            if not again(status):
                break
        return status, None, None, None, (time.monotonic() - began) * 1000, attempt + 1 if uri else 0, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            for row in batch.itertuples(index=False):
                yield pd.DataFrame([(row.uri, row.offset, row.length, *one(row.uri, row.offset, row.length))], columns=names).astype({"offset": "Int64", "length": "Int64", "status": "Int32"})

    return requests.select("uri", "offset", "length").mapInPandas(run, SCHEMA)


#: Ranges so far apart, or less, are asked for together; a request ends with the stretch of so many bytes that its first range begins in.
GAP, STRETCH = 1 << 16, 32 << 20


def coalesced(requests: DataFrame, gap: int = GAP, stretch: int = STRETCH) -> DataFrame:
    """(uri, offset, length, ranges) of requests (uri, offset, length): one row for all neighbouring ranges of a resource, with an array of them.

    Requests without an offset or length stay alone, equal ones together. Only numbers pass the windows.
    """
    rows = requests.select("uri", "offset", "length").distinct()
    known = F.col("offset").isNotNull() & (F.col("length") > 0)
    ends = rows.where(known).withColumn("__stretch", F.floor(F.col("offset") / stretch))
    log = Log(("uri", "__stretch"), ("offset", "length"))
    ends = scanned(ends, log, {"__reach": running(F.col("offset") + F.col("length"))})
    runs = scanned(ends, log, {"__run": sum_of(F.coalesce((F.col("offset") > F.col("__reach.v") + gap).cast("int"), F.lit(0)))})
    whole = runs.groupBy("uri", "__stretch", "__run").agg(F.min("offset").alias("__low"), F.max(F.col("offset") + F.col("length")).alias("__high"), F.collect_list(F.struct("offset", "length")).alias("ranges"))
    out = whole.select("uri", F.col("__low").alias("offset"), (F.col("__high") - F.col("__low")).alias("length"), "ranges")
    return out.unionByName(rows.where(~F.coalesce(known, F.lit(False))).withColumn("ranges", F.array(F.struct("offset", "length"))))


def running(value: Column) -> Prefix:
    """struct<v>: the greatest value of the rows before."""
    own = F.struct(value.alias("v"))
    return Prefix(lambda order: F.max(own), lambda p, log: F.max(p).over(log.before), lambda log: F.max(own).over(log.before), lambda a, b: F.greatest(a, b))


def fetch_ranges(requests: DataFrame, gap: int = GAP, stretch: int = STRETCH, **options) -> DataFrame:
    """What fetch gives for each different request, but neighbouring ranges of a resource are one request, and are cut apart after it.

    Requests are dealt out by host, so that one host is asked by few tasks. A range past the end of its resource is cut short; total_ms and
    attempts are those of the request that a range came with.
    """
    wanted = coalesced(requests, gap, stretch)
    host = F.regexp_extract("uri", "^[a-zA-Z]+://([^/?#]*)", 1)
    got = fetch(wanted.select("uri", "offset", "length").repartition(host), **options)
    ranges = wanted.select(F.col("uri").alias("__u"), F.col("offset").alias("__o"), F.col("length").alias("__l"), "ranges")
    same = F.col("uri").eqNullSafe(F.col("__u")) & F.col("offset").eqNullSafe(F.col("__o")) & F.col("length").eqNullSafe(F.col("__l"))
    low = F.coalesce("offset", F.lit(0))
    # A request that spans its ranges is cut by all of them before rows are made.
    piece = lambda r: F.when((F.size("ranges") == 1) | F.col("body").isNull(), F.col("body")).otherwise(F.substring("body", (r["offset"] - low + 1).cast("int"), r["length"].cast("int")))
    cut = F.transform("ranges", lambda r: F.struct(r["offset"].alias("offset"), r["length"].alias("length"), piece(r).alias("body")))
    others = [c for c in got.columns if c not in ("offset", "length", "body")]
    rows = got.join(ranges, same).select(*others, F.explode(cut).alias("r"))
    return rows.select("r.offset", "r.length", "r.body", *others).select(*got.columns)


def texts(fetched: DataFrame) -> DataFrame:
    """(uri, text) of fetched bodies, named by where they were found in the end, so that relative uris resolve; bytes that aren't
    UTF-8 become replacement characters; failed fetches are left out."""
    return fetched.where("body is not null").select(F.coalesce("final_uri", "uri").alias("uri"), F.make_valid_utf8("body").cast("string").alias("text"))


def bodies(fetched: DataFrame) -> DataFrame:
    """(uri, body) of fetched bodies by the uri asked for, as keys and init sections are looked up (see lookup.by_uri)."""
    return fetched.where("body is not null").select("uri", "body")
