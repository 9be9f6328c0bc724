"""Conversation structure repair by Wagner-Fischer alignment.

The turns of a conversation, in order, are aligned to the alternating grammar string `(s?(ua)+)?` of each feasible length:
keeping a turn costs nothing, a new role REROLE, deletion DELETE, an inserted turn INSERT, and a truncated turn that stays
TRUNCATED more. All lengths share their last symbols, so one matrix by (turns left, symbols left) has the cost of every
length in its first row. An Ukkonen band keeps the cells that the incumbent cost allows: a cell off the number of turns that
can stay is worth at least the deletions or insertions between, and the band doubles until the best cost lies inside it, with
all its ties. Of the lengths of least cost the audits (the initials of the edits, in order) are traced back and compared.

A conversation of up to LONG turns and LONG_CHARS is aligned inside one task. A longer one, which may hold a third of all
rows, is dealt out by range of its order and cut into blocks of BLOCK turns. A block is aligned from each of the four states
that the grammar can be in (nothing yet, after s, after u, after a) to each; costs of blocks chain backwards, so each block
knows what follows costs for each state, then chosen states chain forwards. Blocks end in a turn, never in an insertion, so no
audit of a block is the beginning of another one, and the least audits of blocks make the least audit of all.

Turns have the order of turn (nulls first), role, text. Repeated rows are turns of their own; null roles and texts are one
space, and null conversation ids are one conversation. Roles count by their first character; an empty role has none. Long
texts are taken whole, an empty table gives an empty table, and other columns are neither read nor returned.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Turns, and characters, of a conversation that one task takes whole; turns of a block of a longer one (divides 2**33).
LONG, LONG_CHARS, BLOCK = 1_000, 4_000_000, 128
#: Ids of long conversations that are broadcast; more of them are joined by sort and merge.
BROADCAST_IDS = 100_000
#: States of the grammar: nothing yet, after s, after u, after a; and what is left to insert when the turns end there.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
TAIL = ("", "II", "I", "")
FINAL = tuple(INSERT * len(x) for x in TAIL)
NEVER = 1 << 40
ROLES = {"u": "user", "a": "assistant"}
VISIBLE = re.compile(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D]*\Z)")
SUMS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
TURNS = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))


# --- alignment of the codes of turns: x must go, s u a o by the initial of the role, in upper case if truncated ---


class Matrix(NamedTuple):
    """Costs of aligning the turns from i on to the last r symbols of an alternating string that ends in `last`."""

    codes: str
    last: str
    lows: list[int]
    rows: list[list[int]]

    def at(self, i: int, r: int) -> int:
        k = r - self.lows[i]
        return self.rows[i][k] if 0 <= k < len(self.rows[i]) else NEVER

    def symbol(self, r: int) -> str:
        return self.last if r % 2 else ("u" if self.last == "a" else "a")

    def step(self, i: int, r: int) -> tuple[int, str] | None:
        """Cost and initial of meeting turn i with the next symbol."""
        c = self.codes[i]
        if c == "x":
            return None
        same = c.lower() == self.symbol(r)
        return (0 if same else REROLE) + (TRUNCATED if c.isupper() else 0), "K" if same else "R"

    def audit(self, i: int, r: int) -> str:
        """The least of the cheapest audits from here on: an edit stands at the front, so the least one that keeps the cost."""
        out = []
        while i < len(self.codes) or r:
            cost = self.at(i, r)
            if i < len(self.codes) and DELETE + self.at(i + 1, r) == cost:
                out.append("D")
                i += 1
            elif r and INSERT + self.at(i, r - 1) == cost:
                out.append("I")
                r -= 1
            else:
                out.append(self.step(i, r)[1])
                i, r = i + 1, r - 1
        return "".join(out)


def matrix(codes: str, last: str, slack: int) -> Matrix:
    """Wagner-Fischer from the end, in the band of what may cost slack beyond the deletions that are required."""
    m, can_stay = len(codes), 0
    found = Matrix(codes, last, [0] * (m + 1), [[0]] * (m + 1))
    for i in range(m - 1, -1, -1):
        can_stay += codes[i] != "x"
        low = max(0, can_stay - slack // DELETE)
        row: list[int] = []
        below, at, c = found.rows[i + 1], found.lows[i + 1], codes[i]
        extra = TRUNCATED if c.isupper() else 0
        end = len(below)
        for r in range(low, can_stay + slack // INSERT + 1):
            k = r - at
            best = below[k] + DELETE if 0 <= k < end else NEVER
            if row and (x := row[-1] + INSERT) < best:
                best = x
            if c != "x" and 0 < k <= end and (x := below[k - 1] + extra + (0 if c.lower() == found.symbol(r) else REROLE)) < best:
                best = x
            row.append(best)
        found.lows[i], found.rows[i] = low, row
    return found


#: For each state the parity of the length that leads from it to an end in u and in a; the next symbol follows from it.
PARITY = {START: (1, 0), AFTER_S: (1, 0), AFTER_U: (0, 1), AFTER_A: (1, 0)}


def ways(codes: str, state: int, ends: tuple[Matrix, Matrix]) -> Iterator[tuple[int, int, int, int, int]]:
    """(cost, exit state, number of turns up to and with a kept s, matrix, length) of each feasible length from a state."""
    heads = [(0, 0, state)]
    if state == START:
        heads += [(DELETE * i + (TRUNCATED if c == "S" else 0), i + 1, AFTER_S) for i, c in enumerate(codes) if c in "sS"]
    for spent, i, at in heads:
        for e, (end, parity) in enumerate(zip(ends, PARITY[at], strict=True)):
            low = end.lows[i]
            for r in range(low + (low + parity) % 2, low + len(end.rows[i]), 2):
                if r:
                    yield spent + end.at(i, r), (AFTER_U, AFTER_A)[e], i, e, r
        yield spent + DELETE * (len(codes) - i), at, i, 1, 0


def banded(codes: str, state: int, after: tuple[int, ...] | None) -> tuple[tuple[Matrix, Matrix], list[tuple[int, int, int, int, int]]]:
    """Ways whose costs, with those after their exits, are certain; without `after` those to each exit are."""
    base, slack = DELETE * codes.count("x"), 8
    while True:
        ends = matrix(codes, "u", slack), matrix(codes, "a", slack)
        found = list(ways(codes, state, ends))
        if after is None:
            needed = max((min((w[0] for w in found if w[1] == e), default=0) for e in range(4)), default=0)
        else:
            # What follows costs at least the least of `after`, so more than this much less can't be spent here.
            needed = min(w[0] + after[w[1]] for w in found) - min(after)
        if needed <= base + slack or slack > 8 * (len(codes) + 2):
            return ends, found
        slack *= 2


def costs(codes: str) -> list[int]:
    """The least cost from each state (first index) to each, in one list."""
    out = []
    for state in range(4):
        found = banded(codes, state, None)[1]
        out += [min((w[0] for w in found if w[1] == e), default=NEVER) for e in range(4)]
    return out


@lru_cache(100_000)
def best(codes: str, state: int = START, after: tuple[int, ...] = FINAL) -> tuple[str, int, int]:
    """The least audit among the cheapest ones, its exit state, and its cost without what follows."""
    ends, found = banded(codes, state, after)
    least = min(w[0] + after[w[1]] for w in found)
    audits = []
    for cost, exit_state, i, e, r in found:
        if cost + after[exit_state] == least:
            head = "D" * (i - 1) + "K" if i else ""
            audits.append((head + (ends[e].audit(i, r) if r else "D" * (len(codes) - i)), exit_state, cost))
    return min(audits)


def repaired(audit: str, state: int, turns: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Roles and texts that an audit leaves of turns, from a state on."""
    out, k = [], 0
    for edit in audit:
        if edit == "D":
            k += 1
            continue
        nxt = "a" if state == AFTER_U else "u"
        role, text = (ROLES[nxt], "") if edit == "I" else turns[k]
        k += edit != "I"
        if edit == "R":
            role = ROLES[nxt]
        out.append((role, text))
        state = AFTER_S if edit == "K" and role[:1] == "s" else AFTER_U if nxt == "u" else AFTER_A
    return out


def initial(role: str) -> str:
    return role[:1] if role[:1] in ("s", "u", "a") else "o"


def code(role: str, text: str, seen: bool) -> tuple[str, str]:
    """The code of a turn, and its first fault: blank, duplicate, truncated or none."""
    last = VISIBLE.search(text)
    fault = "blank" if not last else "duplicate" if seen else "truncated" if last[0] not in ".!?" else ""
    return ("x" if fault in ("blank", "duplicate") else initial(role).upper() if fault else initial(role)), fault


def illegal(initials: str) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


# --- tables ---


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text and copies (0, 1 or 2) of each row, damaged by the remainder of crc32(`conv:turn`) by 20: 0 drops
    the row, 1 empties its text, 2 removes its stops, 3 repeats it, 4 gives it the role user. Nulls in roles and texts, and in
    the hashed text, are one space; ids and turns keep theirs."""
    whole = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(whole(conv), F.lit(":"), whole(turn)).cast("binary")) % 20
    return rows.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.when(h == 4, F.lit("user")).otherwise(whole(role)).alias("role"),
        F.when(h == 1, F.lit("")).when(h == 2, F.translate(whole(text), ".!?", "")).otherwise(whole(text)).alias("text"), F.when(h == 0, 0).when(h == 3, 2).otherwise(1).alias("copies"),
    )


def _schema(conv: T.DataType) -> T.StructType:
    fields = [T.StructField("conv", conv), T.StructField("part", T.LongType(), False), *(T.StructField(n, T.LongType(), False) for n in SUMS)]
    return T.StructType([*fields, T.StructField("audit", T.StringType(), False), T.StructField("turns", TURNS, False)])


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _in_order(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


def _streamed(df: DataFrame, names: list[str], schema: T.StructType, step: Callable[[Iterator[tuple]], Iterator[tuple]], at_a_time: int = 256) -> DataFrame:
    """step over the rows of each partition, in their order."""
    out = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = []
        for row in step(_in_order(batches, names)):
            some.append(row)
            if len(some) == at_a_time:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), out, strict=True)], schema=out)
                some = []
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), out, strict=True)], schema=out)

    return df.select(names).mapInArrow(run, schema)


def _whole(conv: object, turns: list[int], said: list[tuple[str, str]]) -> tuple:
    seen: set[tuple[str, str]] = set()
    codes, faults = [], {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
    for one in said:
        c, fault = code(*one, one in seen)
        seen.add(one)
        codes.append(c)
        faults[fault] += 1
    audit, state, cost = best("".join(codes))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    audit, cost = audit + TAIL[state], cost + FINAL[state]
    kept = [{"role": r, "text": t} for r, t in repaired(audit, START, said)]
    return conv, 0, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal("".join(initial(r) for r, _ in said)), cost, audit, kept


def _short(rows: DataFrame) -> DataFrame:
    """Conversations that are aligned whole, each in the task that holds it."""

    def step(many: Iterator[tuple]) -> Iterator[tuple]:
        conv, turns, said, any_row = None, [], [], False
        for c, turn, role, text, copies in many:
            if any_row and c != conv:
                yield _whole(conv, turns, said)
                turns, said = [], []
            conv, any_row = c, True
            if copies:
                said += [(role, text)] * copies
                turns += [] if turn is None else [turn]
        if any_row:
            yield _whole(conv, turns, said)

    dealt = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    return _streamed(dealt, ["conv", "turn", "role", "text", "copies"], _schema(rows.schema["conv"].dataType), step)


def _long(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Conversations that no task takes whole, block by block."""
    conv = rows.schema["conv"].dataType
    order = ["conv", "turn", "role", "text", "salt"]
    each = rows.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).withColumn("salt", F.xxhash64(F.monotonically_increasing_id(), "copy"))
    # Ids rise with the order of rows inside and across partitions, so they are places; equal rows are parted by the salt.
    ordered = scratch.write(each.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()).drop("salt", "copies", "copy"), "ordered")
    same = F.sha2(F.concat(F.length("role"), F.lit(":"), F.col("role"), F.col("text")), 256)
    first = ordered.groupBy("conv", same.alias("same")).agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(last == "", "blank").when(F.col("first").isNull(), "duplicate").when(~last.isin(".", "!", "?"), "truncated").otherwise("")
    mark = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("o")
    coded = ordered.join(first.hint("merge"), "place", "left").select(
        "conv", "place", "role", "text", mark.alias("mark"), fault.alias("fault"),
        F.when(fault.isin("blank", "duplicate"), "x").when(fault == "truncated", F.upper(mark)).otherwise(mark).alias("code"),
    )
    said = F.array_sort(F.collect_list(F.struct("place", "code", "mark", "role", "text")))
    joined = lambda name: F.array_join(F.transform("said", lambda x: x[name]), "")
    count = lambda name: F.count_if(F.col("fault") == name).alias(name)
    blocks = coded.groupBy("conv", F.floor(F.col("place") / BLOCK).alias("block")).agg(said.alias("said"), count("blank"), count("duplicate"), count("truncated"))
    blocks = scratch.write(blocks.withColumns({"codes": joined("code"), "marks": joined("mark")}), "blocks")

    longs = lambda n, name: T.StructField(name, T.ArrayType(T.LongType(), False), False)
    head = [T.StructField("conv", conv), T.StructField("block", T.LongType(), False)]

    def matrices(many: Iterator[tuple]) -> Iterator[tuple]:
        for c, b, codes in many:
            yield c, b, costs(codes)

    def backwards(many: Iterator[tuple]) -> Iterator[tuple]:
        """What follows a block costs from each of its exits."""
        now, after = (), FINAL
        for c, b, m in many:
            if now != (c,):
                now, after = (c,), FINAL
            yield c, b, list(after)
            after = tuple(min(m[4 * p + e] + after[e] for e in range(4)) for p in range(4))

    def audits(many: Iterator[tuple]) -> Iterator[tuple]:
        for c, b, codes, marks, after in many:
            of = [best(codes, p, tuple(after)) for p in range(4)]
            yield c, b, [x[0] for x in of], [x[1] for x in of], [x[2] for x in of], marks[0], marks[-1], illegal(marks)

    def forwards(many: Iterator[tuple]) -> Iterator[tuple]:
        """The audit and the state before it of each block; the last one of a conversation has what is inserted at its end."""
        held, before = None, ""
        for c, b, audit, exits, cost, one, end, bad in many:
            fresh = held is None or held[0] != c
            if fresh and held:
                yield *held[:-1], held[3] + TAIL[held[-1]], held[4] + FINAL[held[-1]]
            elif held:
                yield *held[:-1], held[3], held[4]
            state = START if fresh else held[-1]
            held = (c, b, 0 if fresh else held[2] + 1, audit[state], cost[state], state, bad + (0 if fresh else illegal(before + one)), exits[state])
            before = end
        if held:
            yield *held[:-1], held[3] + TAIL[held[-1]], held[4] + FINAL[held[-1]]

    costed = _streamed(blocks, ["conv", "block", "codes"], T.StructType([*head, longs(16, "m")]), matrices)
    after = _streamed(costed.repartition("conv").sortWithinPartitions("conv", F.desc("block")), ["conv", "block", "m"], T.StructType([*head, longs(4, "after")]), backwards)
    after = scratch.write(after, "after")
    on = lambda right: [F.col("l.conv").eqNullSafe(F.col(f"{right}.conv")), F.col("l.block") == F.col(f"{right}.block")]
    known = blocks.alias("l").join(after.hint("merge").alias("r"), on("r")).select("l.conv", "l.block", "codes", "marks", "after")
    strings = T.StructField("audits", T.ArrayType(T.StringType(), False), False)
    ends = [T.StructField("first", T.StringType()), T.StructField("last", T.StringType()), T.StructField("bad", T.LongType(), False)]
    traced = _streamed(known, ["conv", "block", "codes", "marks", "after"], T.StructType([*head, strings, longs(4, "exits"), longs(4, "costs"), *ends]), audits)
    fields = ["part", "_audit", "_cost", "state", "illegal", "audit", "cost"]
    chosen = T.StructType([*head, *(T.StructField(f, T.StringType() if "audit" in f else T.LongType(), False) for f in fields)])
    chain = _streamed(traced.repartition("conv").sortWithinPartitions("conv", "block"), ["conv", "block", "audits", "exits", "costs", "first", "last", "bad"], chosen, forwards)
    chain = scratch.write(chain, "chain")
    by_turn = ordered.filter("turn IS NOT NULL").groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    numbered = chain.alias("l").join(by_turn.hint("merge").alias("g"), F.col("l.conv").eqNullSafe(F.col("g.conv")) & (F.col("part") == 0), "left").select("l.*", F.coalesce("gaps", F.lit(0)).alias("gaps"))
    parts = numbered.alias("l").join(blocks.hint("merge").alias("r"), on("r")).select("l.conv", "part", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "state", "said")

    def turned(many: Iterator[tuple]) -> Iterator[tuple]:
        for *known, audit, state, said in many:
            yield *known, audit, [{"role": r, "text": t} for r, t in repaired(audit, state, [(x["role"], x["text"]) for x in said])]

    return _streamed(parts, parts.columns, _schema(conv), turned, at_a_time=16)


def _split(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """Rows of short conversations, and of long ones where there are any."""
    sizes = rows.groupBy("conv").agg(F.sum("copies").alias("n"), F.sum(F.col("copies") * F.length("text")).alias("chars"))
    ids = scratch.write(sizes.filter((F.col("n") > LONG) | (F.col("chars") > LONG_CHARS)).select(F.col("conv").alias("long_conv")), "long")
    if not (n := ids.count()):
        return rows, None
    ids, same = ids.hint("broadcast" if n <= BROADCAST_IDS else "merge"), F.col("conv").eqNullSafe(F.col("long_conv"))
    return rows.join(ids, same, "left_anti"), rows.join(ids, same, "left_semi")


def _prepared(rows: DataFrame, conv: str, turn: str, role: str, text: str, copies: Column | None) -> DataFrame:
    whole = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), whole(role).alias("role"), whole(text).alias("text"), (F.lit(1) if copies is None else copies).cast("int").alias("copies"))


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: Column | None = None) -> DataFrame:
    """conv, part, gaps, blank, duplicate, truncated, illegal, cost, audit and turns (array of role and text) of each
    conversation: in one row (part 0), or, for one of over LONG turns or LONG_CHARS, in rows of consecutive parts, whose numbers
    add up and whose audits and turns join. A row counts as often as copies says; with none it but names its conversation."""
    rows, scratch = _prepared(rows, conv, turn, role, text, copies), Scratch(rows.sparkSession, "conversations")
    short, long = _split(rows, scratch)
    parts = _short(short) if long is None else _short(short).union(_long(long, scratch))
    return parts.withColumnRenamed("conv", conv)


def digests(parts: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row for each conversation of repair(): its sums, audit, and repaired_sha256 over `role:text` of the repaired turns,
    joined by newlines. Parts of one conversation stream through one task in their order, as the hash of a text has to."""
    import hashlib

    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    lean = parts.select(F.col(conv).alias("conv"), "part", *SUMS, "audit", F.size("turns").alias("n"), said.alias("said"))
    out = T.StructType([lean.schema["conv"], *(T.StructField(n, T.LongType(), False) for n in SUMS), T.StructField("audit", T.StringType(), False), T.StructField("repaired_sha256", T.StringType(), False)])

    def step(many: Iterator[tuple]) -> Iterator[tuple]:
        now = None
        for c, part, *sums, audit, n, text in many:
            if part == 0:
                if now:
                    yield now[0], *now[1], "".join(now[2]), now[3].hexdigest()
                now = [c, [0] * len(SUMS), [], hashlib.sha256(), False]
            now[1] = [a + b for a, b in zip(now[1], sums, strict=True)]
            now[2].append(audit)
            if n:
                now[3].update((("\n" if now[4] else "") + text).encode("utf-8", "surrogatepass"))
                now[4] = True
        if now:
            yield now[0], *now[1], "".join(now[2]), now[3].hexdigest()

    return _streamed(lean.repartition("conv").sortWithinPartitions("conv", "part"), lean.columns, out, step).withColumnRenamed("conv", conv)


def report(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: Column | None = None) -> DataFrame:
    """digests() of repair(); conversations of one part are hashed in the row that holds them, without another shuffle."""
    rows, scratch = _prepared(rows, conv, turn, role, text, copies), Scratch(rows.sparkSession, "conversations")
    short, long = _split(rows, scratch)
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    found = _short(short).select("conv", *SUMS, "audit", F.sha2(said, 256).alias("repaired_sha256"))
    if long is not None:
        found = found.union(digests(_long(long, scratch), "conv"))
    return found.withColumnRenamed("conv", conv)
