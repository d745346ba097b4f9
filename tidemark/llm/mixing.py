"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length within each source. A source whose target is r times its size and a rest takes all
its documents r times; the rest is fitted on the length counts: an even share of every length, then the longest lengths
that still fit, and a bounded-knapsack dynamic program over what remains, which meets the budget or comes as near as the
lengths allow. How many documents of a length are wanted is then met by documents in the order of a seeded hash.

Groups in a task: the length counts of one source (as many as it has different lengths), and at most about BUCKET documents
of one source and length. The shares need all sources at once: one narrow row a source passes one task, which bounds sources to
some tens of millions; documents never do.

Defined cases: null text has size 0; a null source is a source of its own, last; documents of size 0 are never needed
and are taken as often as all the rest of their source; equal rows are told apart only by their order, so which of them
is taken doesn't show; a very long text only has a large size; ties of the seeded hash go by id; only the named columns of
the input are read, whatever others are called; an empty table gives none.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, quoted, small

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST, SEED, BUCKET = 3, 17, 256
#: The dynamic program covers a remaining budget of up to so many words.
PROGRAM = 20_000
#: A plan of at most so many rows (source, length) is broadcast.
BROADCAST = 100_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes (source, source_size) with weight and target: shares of the total by weight, none above most times its size.

    Sources are capped in the order of size by weight; the others share what is left, which is the end of resharing the
    excess until none is above.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumns({"weight": w, "name_order": F.row_number().over(by_name)}).withColumn("ratio", F.col("source_size") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", "name_order")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(Window.partitionBy()) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    # What is left of the weights from here on, without a frame that is summed anew for each row.
    rest = F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    rows = rows.withColumn("left", left).withColumn("rest", rest)
    rows = rows.withColumn("capped", (F.col("weight") * F.col("left") / F.col("rest") > most * F.col("source_size")).cast("int"))
    # Once one isn't capped, none after it is.
    first = F.min(F.when(F.col("capped") == 0, F.struct("ratio", "name_order", "left", "rest"))).over(Window.partitionBy())
    level = first["left"] / first["rest"]
    return rows.select("source", "source_size", F.when(F.col("capped") == 1, (most * F.col("source_size")).cast("double")).otherwise(F.col("weight") * level).alias("target"))


def fit_lengths(counts: list[tuple[int, int]], budget: int, program: int = PROGRAM) -> dict[int, int]:
    """How many of the (length, count) to take so that the lengths add up to budget or, failing that, as near below it as found."""
    counts = sorted((n, c) for n, c in counts if n > 0)
    total = sum(n * c for n, c in counts)
    if budget >= total:
        return dict(counts)
    # An even share of every length, keeping back enough for the dynamic program.
    aim = max(0, budget - program // 2)
    taken = {n: c * aim // total for n, c in counts}
    rest = budget - sum(n * k for n, k in taken.items())
    for n, c in reversed(counts):
        if rest <= program // 2:
            break
        more = min(c - taken[n], (rest - program // 2) // n)
        taken[n] += more
        rest -= n * more
    # Short items must remain for what is left; if they don't, take what fits, longest first.
    while rest > program:
        fits = [n for n, c in counts if taken[n] < c and n <= rest]
        if not fits:
            return taken
        taken[fits[-1]] += 1
        rest -= fits[-1]
    reach, steps = 1, []
    full = (1 << (rest + 1)) - 1
    for n, c in counts:
        left, chunk = min(c - taken[n], rest // n), 1
        while left > 0:
            k = min(chunk, left)
            steps.append((n, k, reach))
            reach |= (reach << (n * k)) & full
            left, chunk = left - k, chunk * 2
        if reach >> rest & 1:
            break
    at = reach.bit_length() - 1
    for n, k, before in reversed(steps):
        if not before >> at & 1:
            taken[n] += k
            at -= n * k
    return taken


def plan(counts: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, size, n, base, extra): every document of that length is taken base times, extra of them once more."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        whole, target = int(rows.source_size.iloc[0]), float(rows.target.iloc[0])
        base = int(target // whole) if whole else 0
        taken = fit_lengths(list(zip(rows["size"].tolist(), rows["n"].tolist(), strict=True)), round(target - base * whole)) if whole else {}
        return rows[["source", "size", "n"]].assign(base=base, extra=[taken.get(n, 0) for n in rows["size"]])

    known = counts.join(goals, counts.source.eqNullSafe(goals.source)).select(counts.source, "size", "n", "source_size", "target")
    return known.groupBy("source").applyInPandas(one, "source string, size long, n long, base long, extra long")


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED, bucket: int = BUCKET) -> DataFrame:
    """(id_col, source, size, source_size, target, taken) of every row of docs."""
    key = F.xxhash64(F.lit(seed), quoted(id_col).cast("string"), F.md5(quoted(text)))
    rows = docs.select(quoted(id_col).alias("id"), quoted(source).cast("string").alias("source"), size_of(quoted(text)).alias("size"), key.alias("h"))
    rows = cut(rows, "mix-sizes")
    counts = cut(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-counts")
    goals = targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, most)
    goals = cut(goals, "mix-targets")
    planned = cut(plan(counts, goals), "mix-plan")
    few = small(planned, BROADCAST)
    # Only lengths of which some but not all are wanted need an order; hash parts keep each group small.
    some = planned.where("extra > 0 and extra < n").select(F.col("source").alias("s"), F.col("size").alias("z"), "n", "extra", F.ceil(F.col("n") / bucket).alias("parts"))
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))
    part = F.floor((F.shiftrightunsigned("h", 32).cast("double") / F.lit(float(1 << 32))) * F.col("parts")).cast("long")
    # The new partitioning after the join leaves Spark free to split a hot source and length in the join.
    open_ = rows.join(F.broadcast(some) if few else some, same).withColumn("part", part).select("id", "source", "size", "h", "extra", "part").repartition("source", "size", "part")
    in_part = open_.groupBy("source", "size", "part").agg(F.count("*").alias("m"), F.first("extra").alias("extra"))
    by_part = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    wanted = in_part.withColumn("want", F.col("extra") - F.coalesce(F.sum("m").over(by_part), F.lit(0)))
    wanted = wanted.where("want > 0").select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("part").alias("p"), "want")
    in_order = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("h", "id"))
    chosen = open_.join(wanted, same & (F.col("part") == F.col("p"))).withColumn("r", in_order).where("r <= want")
    chosen = chosen.groupBy("source", "size", "id", "h").agg(F.count("*").alias("k"))
    # Equal rows have equal keys: k of them are chosen, the first k of their own numbering.
    own = F.row_number().over(Window.partitionBy("source", "size", "id", "h").orderBy("h"))
    numbered = rows.withColumn("r", own)
    c = chosen.select(F.col("source").alias("cs"), F.col("size").alias("cz"), F.col("id").alias("ci"), F.col("h").alias("ch"), "k")
    p = planned.select(F.col("source").alias("ps"), F.col("size").alias("pz"), "n", "base", "extra")
    g = goals.select(F.col("source").alias("gs"), "source_size", "target")
    out = numbered.join(c, F.col("source").eqNullSafe(F.col("cs")) & (F.col("size") == F.col("cz")) & F.col("id").eqNullSafe(F.col("ci")) & (F.col("h") == F.col("ch")), "left")
    out = out.join(F.broadcast(p) if few else p, F.col("source").eqNullSafe(F.col("ps")) & (F.col("size") == F.col("pz"))).join(g, F.col("source").eqNullSafe(F.col("gs")))
    once = (F.col("extra") >= F.col("n")) | (F.col("r") <= F.coalesce("k", F.lit(0)))
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", (F.col("size") * (F.col("base") + once.cast("long"))).alias("taken"))
