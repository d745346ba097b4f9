"""Chat formatting of reply trees.

Iterative self-joins double the distance to each message's ancestor, so a tree of depth D takes log2(D) joins; the same
joins enumerate, for every leaf, all messages on its path from the root. Branches are ranked by the mean score of their
messages, and each chosen path is written as one conversation.

The template is <|im_start|>role, newline, text, <|im_end|>, newline. Inside roles and texts a backslash becomes two and
<| becomes <\\|, so no control string occurs in them and reading back is exact.

Links, paths and scores are narrow tables; texts take part only where they are numbered, and where the chosen paths are put
together.

Defined cases: null role or text is empty; a reply to a missing message is a root; messages on a cycle are on no path;
equal rows stay separate turns; branches of equal score go by length, then by their leaf's key; very long texts and
conversations cost time in proportion, but one conversation is one value, so it must fit a task; only the named columns of
the input are read, whatever others are called; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, extend, forget, small

START, END = "<|im_start|>", "<|im_end|>"
#: Paths of at most so many messages are broadcast to the texts; beyond that a join does it.
BROADCAST_PATHS = 1_000_000


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: str) -> str:
    return re.sub(r"\\(n|.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def linear(turns: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The reply tree of conversations that don't branch: each row replies to the row before it. Ties in order go by role,
    then text, nulls first."""
    by = Window.partitionBy(conv).orderBy(F.col(order).asc_nulls_first(), F.col(role).asc_nulls_first(), F.col(text).asc_nulls_first())
    node = F.row_number().over(by).cast("long")
    out = turns.select(F.col(conv).alias("tree"), node.alias("node"), F.col(role).alias("role"), F.col(text).alias("text"))
    return out.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(0.0))


def branches(messages: DataFrame) -> DataFrame:
    """(tree, leaf, node, up) of every message on the path of every leaf; up: steps from the leaf.

    messages: tree, node (unique in its tree), parent (null at a root). Trees are matched null-safely.
    """
    links = messages.select("tree", "node", "parent").alias("m")
    real = messages.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    near = links.join(real, F.col("m.tree").eqNullSafe(F.col("t")) & (F.col("m.parent") == F.col("n")), "left").select("tree", "node", F.col("n").alias("up_node"))
    jump = near = cut(near, "chat-links")
    inner = jump.where("up_node is not null").select(F.col("tree").alias("t"), F.col("up_node").alias("n")).distinct()
    paths = cut(jump.join(inner, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")), "left_anti").select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")), "chat-leaves")
    step, most = 1, max(1, near.count())
    while step < 2 * most:
        ahead = jump.where("up_node is not null").select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up_node").alias("a"))
        # Each step is written once: what it adds to the paths.
        more = paths.join(ahead, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))).select("tree", "leaf", F.col("a").alias("node"), (F.col("up") + step).alias("up"))
        paths = paths.unionByName(cut(more, "chat-paths"))
        far = jump.join(ahead, F.col("tree").eqNullSafe(F.col("t")) & (F.col("up_node") == F.col("n"))).select("tree", "node", F.col("a").alias("up_node"))
        before, jump, step = jump, cut(far, "chat-jumps"), 2 * step
        if before is not near:
            forget(before)
        if jump.isEmpty():
            break
    else:
        # A cycle: only paths that end at a root count.
        roots = near.where("up_node is null").select(F.col("tree").alias("t"), F.col("node").alias("n"))
        whole = paths.join(roots, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))).select(F.col("tree").alias("t"), F.col("leaf").alias("l"), F.col("up").alias("top"))
        paths = paths.join(whole, F.col("tree").eqNullSafe(F.col("t")) & (F.col("leaf") == F.col("l")) & (F.col("up") <= F.col("top"))).select("tree", "leaf", "node", "up")
    return paths


def conversations(messages: DataFrame, best_only: bool = True) -> DataFrame:
    """(tree, leaf, branch_score, n_turns, formatted, mask) of the best branch of each tree, or of every branch.

    mask: the [start, end) code point ranges of formatted that carry loss: the texts of assistant turns.
    """
    messages = cut(messages.select("tree", "node", "parent", "role", "text", F.coalesce("score", F.lit(0.0)).alias("score")), "chat-messages")
    same = lambda: F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))
    paths = branches(messages)
    if best_only:
        scores = messages.select(F.col("tree").alias("t"), F.col("node").alias("n"), "score")
        rank = paths.join(scores, same()).groupBy("tree", "leaf").agg(F.avg("score").alias("s"), F.count("*").alias("d"))
        top = rank.groupBy("tree").agg(F.max_by("leaf", F.struct("s", "d", "leaf")).alias("l")).select(F.col("tree").alias("bt"), "l")
        paths = paths.join(top, F.col("tree").eqNullSafe(F.col("bt")) & (F.col("leaf") == F.col("l")))
    paths = cut(paths.select(F.col("tree").alias("t"), "leaf", F.col("node").alias("n"), "up"), "chat-chosen")
    full = messages.join(F.broadcast(paths) if small(paths, BROADCAST_PATHS) else paths, same())
    said = full.select("tree", "leaf", "score", (-F.col("up")).alias("at"), F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\n")).alias("role"), escaped(F.col("text")).alias("text"))
    # Where a text begins is what the turns before it take up, by a running sum.
    before, after = len(START) + 1, len(END) + 1
    length = F.length("role") + F.length("text") + before + after
    so_far = F.coalesce(F.sum(length).over(Window.partitionBy("tree", "leaf").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    said = said.withColumn("start", (so_far + before + F.length("role")).cast("bigint"))
    rows = said.groupBy("tree", "leaf").agg(F.avg("score").alias("branch_score"), F.array_sort(F.collect_list(F.struct("at", "role", "text", "start"))).alias("turns"))
    parts = F.transform("turns", lambda t: F.concat(F.lit(START), t.role, F.lit("\n"), t.text, F.lit(END + "\n")))
    mask = F.transform(F.filter("turns", lambda t: t.role == "assistant"), lambda t: F.struct(t.start.alias("start"), (t.start + F.length(t.text)).alias("end")))
    return rows.select("tree", "leaf", "branch_score", F.size("turns").cast("long").alias("n_turns"), F.array_join(parts, "").alias("formatted"), mask.alias("mask"))


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    turns = []
    for part in formatted.split(START)[1:]:
        role, _, rest = part.partition("\n")
        turns.append((unescaped(role), unescaped(rest[: -len(END) - 1])))
    return turns


def digest(formatted: DataFrame, keep: list[str]) -> DataFrame:
    """The columns in keep with digests of what is read back from the output and of the text under the loss mask."""

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        rows = []
        for text, mask in zip(batch.column("formatted").to_pylist(), batch.column("mask").to_pylist(), strict=True):
            turns = read_back(text)
            loss = "".join(unescaped(text[r["start"] : r["end"]]) for r in mask)
            said = "".join(f"{role}\n{own}\n" for role, own in turns)
            rows.append([len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)])
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        return [pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()], strict=True)]

    return extend(formatted.drop("n_turns"), "formatted", "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long", make, [*keep, "mask"]).drop("mask")
