"""Conversations repaired at least cost by Knuth's lightest-derivation agenda.

What a conversation may look like is a small automaton over the initials of its roles, (s?(ua)+)?. An item says that the rows from some place on
lead from a state to the end; its value is the least cost of that and the audit, the initials of its edits in order. A row's edit (Keep,
Rerole, Delete) or an Insert puts its initial before the audit of a later item, so each rule is a superior function: values never fall, and two
audits of an item keep their order under it. The agenda pops items by (cost, rows, audit) and the first value popped of an item is final.

A conversation is worked in pieces of PIECE different rows, and the agenda gives for each piece the best way from each state to each: two such
tables chain into one, since of equally cheap ways between the same states none is the beginning of another. So no task needs a whole
conversation until its repaired texts are hashed, which streams. Equal rows are one row with a count, whose copies are deleted together.

Defined cases: rows go by turn (nulls first), then role, then text; a null role or text is one space; a null conversation is one of its own; a row
whose role is empty adds no initial; equal rows count as copies, of which all but the first are duplicates; very long texts and conversations cost
time in proportion; the audit of a conversation is one value; an empty table gives none; only the named columns are read.
"""

from __future__ import annotations

import hashlib
import heapq
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, forget, quoted, small

PIECE, CHAINED = 64, 64
#: Turns of one stretch are numbered in one task.
STRETCH_BITS = 10
BROADCAST_ROWS = 300_000
SPACES = " \t\n\x0b\x0c\r"
#: The costs of the edits.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States: nothing yet, after s, after u, after a. By state: where each initial leads; the last is what may follow from a state if a role is chosen.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
CHOSEN = (2, 2, 3, 2)
STATES, ENDS = range(4), (0, 3)
NAMES = {2: "user", 3: "assistant"}
_MARKS = str.maketrans("", "", "0123")


@lru_cache(1 << 16)
def ways(rows: tuple[tuple[str, str, int], ...]) -> tuple[tuple[tuple[int, str] | None, ...], ...]:
    """For rows (initial, fault, copies): the best (cost, audit) from each state before them to each state after them."""
    n = len(rows)
    table: list[list[tuple[int, str] | None]] = [[None] * 4 for _ in STATES]
    for end in STATES:
        agenda, final = [(0, 0, "", n, end)], set()
        while agenda:
            cost, done, audit, at, state = heapq.heappop(agenda)
            if (at, state) in final:
                continue
            final.add((at, state))
            if at == 0:
                table[state][end] = (cost, audit)
            for before in STATES:
                if CHOSEN[before] == state:
                    heapq.heappush(agenda, (cost + INSERT, done, "I" + audit, at, before))
            if at:
                initial, fault, copies = rows[at - 1]
                # Copies behind the first are deleted, before anything is put in.
                rest, tail = DELETE * (copies - 1), "D" * (copies - 1) + audit
                put = lambda c, e, before: heapq.heappush(agenda, (cost + c + rest, done + 1, e + tail, at - 1, before))  # noqa: B023, E731
                put(DELETE, "D", state)
                if fault in ("blank", "duplicate"):
                    continue
                more = TRUNCATED if fault == "truncated" else 0
                for before in STATES:
                    if (NEXT[before].get(initial) if initial else before) == state:
                        put(KEEP + more, "K", before)
                    if CHOSEN[before] == state:
                        put(REROLE + more, "R", before)
    return tuple(map(tuple, table))


def better(a: tuple[int, str] | None, b: tuple[int, str] | None) -> tuple[int, str] | None:
    """The cheaper way, by audit without its marks if they cost the same."""
    if a is None or b is None:
        return b if a is None else a
    if a[0] != b[0]:
        return min(a, b, key=lambda x: x[0])
    return min(a, b, key=lambda x: x[1].translate(_MARKS))


def chained(first, then):
    """The best ways through two pieces."""
    out = [[None] * 4 for _ in STATES]
    for s in STATES:
        for t in STATES:
            for r in STATES:
                if first[s][r] is not None and then[r][t] is not None:
                    out[s][t] = better(out[s][t], (first[s][r][0] + then[r][t][0], first[s][r][1] + then[r][t][1]))
    return out


def key_of(conv: Column) -> Column:
    """A conversation as a text that is never null."""
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


def damaged(rows: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """rows (conv, order, role, text) with planted faults, by crc32(conv:order) % 20: 0 drops a row, 1 empties its text, 2 takes out its
    stops, 3 repeats it, 4 makes it a user's. Nulls are one space."""
    plain = lambda c: F.coalesce(quoted(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(plain(conv), F.lit(":"), plain(order)).cast("binary")) % 20
    own = rows.select(quoted(conv).alias("conv"), quoted(order).alias("order"), plain(role).alias("role"), plain(text).alias("text"), kind.alias("kind")).where("kind <> 0")
    said = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    own = own.select("conv", "order", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), said.alias("text"), F.explode(times).alias("copy"))
    return own.drop("copy").toDF(conv, order, role, text)


def numbered(rows: DataFrame, conv: str, order: str, role: str, text: str) -> DataFrame:
    """(key, order, number, piece, role, text, copies, fault, initial) of the different rows of each conversation, in order from 0."""
    plain = lambda c: F.coalesce(quoted(c).cast("string"), F.lit(" "))
    own = rows.select(key_of(quoted(conv)).alias("key"), quoted(order).alias("order"), plain(role).alias("role"), plain(text).alias("text"))
    own = own.groupBy("key", "order", "role", "text").agg(F.count("*").alias("copies"))
    # Numbers run within a stretch of turns, from the count of the stretches before.
    own = cut(own.withColumn("stretch", F.coalesce(F.shiftright(F.col("order").cast("long"), STRETCH_BITS), F.lit(-(1 << 60)))), "repair-merged")
    sums = own.groupBy("key", "stretch").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("key", "stretch", before.alias("before")).where("before > 0")
    place = F.row_number().over(Window.partitionBy("key", "stretch").orderBy(F.col("order").asc_nulls_first(), "role", "text")) - 1
    later = own.withColumn("place", place).join(F.broadcast(sums) if small(sums, BROADCAST_ROWS) else sums, ["key", "stretch"], "left")
    out = later.withColumn("number", (F.coalesce("before", F.lit(0)) + F.col("place")).cast("long"))
    out = out.withColumns({"piece": F.floor(F.col("number") / PIECE), "said": F.md5("text")})
    out = cut(out.select("key", "order", "number", "piece", "role", "text", "copies", "said"), "repair-numbered")
    repeated = out.groupBy("key", "role", "said").agg(F.count("*").alias("n"), F.min("number").alias("first")).where("n > 1").drop("n")
    marked = out.join(F.broadcast(repeated) if small(repeated, BROADCAST_ROWS) else repeated, ["key", "role", "said"], "left")
    bare = F.rtrim("text", F.lit(SPACES))
    fault = F.when(F.length(bare) == 0, "blank").when(F.col("number") > F.col("first"), "duplicate").when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "truncated").otherwise("")
    marked = marked.select("key", "order", "number", "piece", "role", "text", "copies", fault.alias("fault"), F.substring("role", 1, 1).alias("initial"))
    return cut(marked, "repair-rows")


_TABLE = "key string, piece long, first string, last string, blank long, duplicate long, truncated long, illegal long, costs array<long>, audits array<string>"
_ARROW = pa.schema([("key", pa.string()), ("piece", pa.int64()), ("first", pa.string()), ("last", pa.string()), *((x, pa.int64()) for x in ("blank", "duplicate", "truncated", "illegal")), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))])
LEGAL = ("su", "ua", "au")


def _grouped(batches, of: int):
    """The rows of batches, sorted by their first `of` columns, by those columns."""
    last, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:of] != last:
                if held:
                    yield last, held
                last, held = row[:of], []
            held.append(row[of:])
    if held:
        yield last, held


def _written(rows):
    """Rows of tables to batches."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) == 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _ARROW.types, strict=True)], schema=_ARROW)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


def _flat(table) -> tuple[list, list]:
    cells = [x for row in table for x in row]
    return [x and x[0] for x in cells], [x and x[1] for x in cells]


def _pieces(batches):
    """Rows (key, piece, number, initial, fault, copies), sorted, to a table for each piece; audits begin with their state."""

    def made():
        for (key, piece), rows in _grouped(batches, 2):
            own = tuple(("" if i == "" else i if i in "sua" else "?", f, c) for _, i, f, c in rows)
            table = [[x and (x[0], f"{s}{x[1]}") for x in row] for s, row in enumerate(ways(own))]
            count = {f: sum(1 for _, _, g, _ in rows if g == f) for f in ("blank", "duplicate", "truncated")}
            for _, _, f, c in rows:
                count["blank" if f == "blank" else "duplicate"] += c - 1
            initials = [i for _, i, _, _ in rows]
            illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)) + sum(c - 1 for _, _, _, c in rows)
            yield key, piece, initials[0], initials[-1], count["blank"], count["duplicate"], count["truncated"], illegal, *_flat(table)

    return _written(made())


def _chains(batches):
    """Tables of (key, group, piece, ...), sorted, to one for each (key, group)."""

    def made():
        for (key, group), rows in _grouped(batches, 2):
            table, last = None, None
            for _, first, _, _, _, _, _, costs, audits in reversed(rows):
                own = [[None if costs[4 * s + t] is None else (costs[4 * s + t], audits[4 * s + t]) for t in STATES] for s in STATES]
                table = own if table is None else chained(own, table)
            counts = [sum(r[i] for r in rows) for i in (3, 4, 5, 6)]
            counts[3] += sum(a[2] + b[1] not in LEGAL for a, b in zip(rows, rows[1:], strict=False))
            yield key, group, rows[0][1], rows[-1][2], *counts, *_flat(table)

    return _written(made())


def _edited(batches):
    """Rows (key, piece, part, number, role, text, initial, copies), sorted, to the turns that the edits of their part leave."""
    schema = pa.schema([("key", pa.string()), ("number", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def turns():
        for (key, _, part), rows in _grouped(batches, 3):
            state, at, place = int(part[0]), 1, 0

            def put_in(number: int):
                nonlocal state, at, place
                while at < len(part) and part[at] == "I":  # noqa: B023
                    state = CHOSEN[state]
                    yield key, number, place, NAMES[state], ""  # noqa: B023
                    at, place = at + 1, place + 1

            for number, role, text, initial, copies in rows:
                yield from put_in(number)
                edit = part[at]
                at += copies
                if edit == "D":
                    continue
                if edit == "R":
                    state = CHOSEN[state]
                elif initial:
                    state = NEXT[state][initial]
                yield key, number, place, role if edit == "K" else NAMES[state], text
                place += 1
            yield from put_in(rows[-1][0])

    held, size = [], 0
    for row in turns():
        held.append(row)
        size += len(row[4])
        if len(held) == 1000 or size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def repair(rows: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(a report, the repaired turns) of the conversations of rows.

    report: key (see key_of), gaps, blank, duplicate, truncated, illegal, cost, audit. turns: key, number, place (which order them), role, text.
    """
    own = numbered(rows, conv, order, role, text)
    narrow = own.select("key", "piece", "number", "initial", "fault", "copies").repartition("key", "piece").sortWithinPartitions("key", "piece", "number")
    tables = cut(narrow.mapInArrow(_pieces, _TABLE), "repair-tables")
    while (tables.agg(F.max("piece")).first()[0] or 0) > 0:
        grouped = tables.select("key", F.floor(F.col("piece") / CHAINED).alias("group"), *(x for x in tables.columns if x != "key"))
        before, tables = tables, cut(grouped.repartition("key", "group").sortWithinPartitions("key", "group", "piece").mapInArrow(_chains, _TABLE), "repair-tables")
        forget(before)
    # The end may be nothing at all or follow an a; the cheaper way, then the lesser audit.
    way = F.array_min(F.filter(F.array(*(F.struct(F.col("costs")[t].alias("cost"), F.translate(F.col("audits")[t], "0123", "").alias("audit"), F.col("audits")[t].alias("marked")) for t in ENDS)), lambda x: x["cost"].isNotNull()))
    best = cut(tables.select("key", "blank", "duplicate", "truncated", "illegal", way.alias("w")), "repair-best")
    gaps = own.groupBy("key").agg(F.coalesce(F.max("order") - F.min("order") + 1 - F.count_distinct("order"), F.lit(0)).cast("long").alias("gaps"))
    report = best.join(gaps, "key").select("key", "gaps", "blank", "duplicate", "truncated", "illegal", F.col("w.cost").alias("cost"), F.col("w.audit").alias("audit"))
    parts = best.select("key", F.posexplode(F.regexp_extract_all("w.marked", F.lit("([0-3][A-Z]*)"))).alias("piece", "part"))
    edits = own.join(parts.withColumn("piece", F.col("piece").cast("long")), ["key", "piece"]).select("key", "piece", "part", "number", "role", "text", "initial", "copies")
    turns = edits.repartition("key", "piece").sortWithinPartitions("key", "piece", "number").mapInArrow(_edited, "key string, number long, place long, role string, text string")
    return report, turns


def _hashed(batches):
    """Turns (key, number, place, role, text), sorted, to the digest of role:text of each key, a line each; turns stream through."""
    key, digest = None, None
    for batch in batches:
        keys, hexes = [], []
        for k, _, _, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != key:
                if digest:
                    keys.append(key)
                    hexes.append(digest.hexdigest())
                key, digest = k, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(hexes, pa.string())], ["key", "repaired_sha256"])
    if digest:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], ["key", "repaired_sha256"])


def digest(originals: DataFrame, report: DataFrame, turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """The report of every conversation of originals, zeros and an empty audit where nothing is left of it, with a digest of its repaired turns."""
    hashes = turns.repartition("key").sortWithinPartitions("key", "number", "place").mapInArrow(_hashed, "key string, repaired_sha256 string")
    every = originals.select(quoted(conv).alias("conv"), key_of(quoted(conv)).alias("key")).distinct()
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    rows = every.join(report, "key", "left").join(hashes, "key", "left")
    return rows.select(F.col("conv").alias(conv), *(F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in numbers), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))
