"""Repair of conversation structure by Hirschberg's divide and conquer.

A conversation should read ``(s?(ua)+)?`` by the initials of its roles: perhaps a system turn, then user and assistant in turn.
Four states stand for what was read last: nothing (0), the system turn (1), a user (2), an assistant (3); 0 and 3 may end it.
Each row is kept, given another role or deleted, and empty turns may be inserted before it, at the costs below.

Forward and backward cost vectors over the four states meet in the middle of a stretch of rows. Among the cheapest crossings
the one with the least audit is chosen: beside its costs a forward vector keeps the order of the least audits that lead to
each state (no such audit starts with another one, as all of them end with the same row). Both halves are solved in the same way,
so memory grows with the rows of a stretch and never with the table of costs.

One conversation may hold any share of all rows. Rows are range partitioned by (conversation, turn), so a long conversation
lies in stretches of many partitions; every stretch is summed up as one cost matrix, the crossings between stretches are chosen
on these matrices, and then all stretches are solved at once.

Results for odd input: a null role or text counts as one space; null turns come first; rows of one turn are ordered by role and
text; equal rows are rows of their own (the later ones duplicates); a null conv_id is a conversation; other columns are not read;
an empty table gives an empty result; texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stored

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
NEVER = 1 << 40
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
#: The cheapest ways to change the state by insertions alone: (from, to, number of insertions).
PADDINGS = [(START, USER, 1), (START, ASSISTANT, 2), (SYSTEM, USER, 1), (SYSTEM, ASSISTANT, 2), (USER, ASSISTANT, 1), (ASSISTANT, USER, 1)]
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: A row is 3 * initial + fault, with initials s, u, a, other and faults none, truncated, blank or duplicate.
MUST_GO = 2
FAULTS = ("blank", "duplicate", "truncated")
SUMS = "struct<rows:long,illegal:long,head:string,tail:string,costs:array<long>,order:array<int>>"

Vector = tuple[tuple[int, ...], tuple[int, ...]]  # costs by state, and the order of their least audits


def _steps(kind: int) -> dict[tuple[int, int], tuple[int, str]]:
    """(cost, edits) of the cheapest, then ASCII-least way over one row, by (state before, state after)."""
    initial, fault = divmod(kind, 3)
    late = TRUNCATED if fault == 1 else 0
    moves = [(s, s, DELETE, "D") for s in range(4)]
    if fault != MUST_GO:
        by_initial = [[(START, SYSTEM)], [(START, USER), (SYSTEM, USER), (ASSISTANT, USER)], [(USER, ASSISTANT)], []]
        moves += [(*m, KEEP + late, "K") for m in by_initial[initial]]
        moves += [(*m, REROLE + late, "R") for m in by_initial[1] + by_initial[2]]
    found: dict[tuple[int, int], tuple[int, str]] = {}
    for before, via, n in [*[(s, s, 0) for s in range(4)], *PADDINGS]:
        for s, after, cost, edit in moves:
            if s == via:
                way = (n * INSERT + cost, "I" * n + edit)
                found[before, after] = min(found.get((before, after), way), way)
    return found


#: By kind. These tables and memories are plain values, as workers get this module's functions without the module.
STEPS = [_steps(kind) for kind in range(12)]
#: Vectors less their least cost are few, so nearly all are looked up.
FORWARD: dict[tuple[Vector, int], tuple[int, Vector]] = {}
BACKWARD: dict[tuple[tuple[int, ...], int], tuple[int, ...]] = {}


def forward(vector: Vector, kind: int) -> tuple[int, Vector]:
    """The least cost after one more row, and the vector less that cost."""
    known = FORWARD.get((vector, kind))
    if known is None:
        costs, order = vector
        ways = {}
        for (before, after), (cost, edits) in STEPS[kind].items():
            way = (costs[before] + cost, order[before], edits)
            ways[after] = min(ways.get(after, way), way)
        totals = [ways[s][0] if s in ways else NEVER for s in range(4)]
        rank = sorted(range(4), key=lambda s: ways[s][1:] if s in ways else (9, ""))
        low = min(totals)
        known = FORWARD[vector, kind] = low, (tuple(min(t - low, NEVER) for t in totals), tuple(rank.index(s) for s in range(4)))
    return known


def backward(costs: tuple[int, ...], kind: int) -> tuple[int, ...]:
    """Costs from each state before a row to the end, given those after it; less the least one."""
    known = BACKWARD.get((costs, kind))
    if known is None:
        totals = [NEVER] * 4
        for (before, after), (cost, _) in STEPS[kind].items():
            totals[before] = min(totals[before], cost + costs[after])
        low = min(totals)
        known = BACKWARD[costs, kind] = tuple(min(t - low, NEVER) for t in totals)
    return known


def at(state: int) -> Vector:
    return tuple(0 if s == state else NEVER for s in range(4)), tuple(0 if s == state else 1 for s in range(4))


def crossing(vector: Vector, ahead: tuple[int, ...]) -> int:
    """The state of the cheapest crossing, by least audit among equal ones."""
    costs, order = vector
    return min(range(4), key=lambda s: (costs[s] + ahead[s], order[s]))


def edits(kinds: bytes, first: int, last: int) -> Iterator[str]:
    """The edits of each row of a stretch that is entered in state ``first`` and left in state ``last``, rows in order."""
    todo = [(0, len(kinds), first, last)] if kinds else []
    while todo:
        low, high, enter, leave = todo.pop()
        if high - low == 1:
            yield STEPS[kinds[low]][enter, leave][1]
            continue
        middle = (low + high) // 2
        vector = at(enter)
        for k in range(low, middle):
            vector = forward(vector, kinds[k])[1]
        ahead = at(leave)[0]
        for k in range(high - 1, middle - 1, -1):
            ahead = backward(ahead, kinds[k])
        meet = crossing(vector, ahead)
        todo += [(middle, high, meet, leave), (low, middle, enter, meet)]


class Stretch:
    """The sums of one run of rows: a vector for every state in which it may be entered, and adjacent initials that break the pattern."""

    def __init__(self, initial: str):
        self.vectors, self.costs = [at(s) for s in range(4)], [0] * 4
        self.rows = self.illegal = 0
        self.head, self.tail = initial, ""

    def add(self, kind: int, initial: str) -> None:
        self.illegal += self.rows > 0 and self.tail + initial not in ("su", "ua", "au")
        self.rows, self.tail = self.rows + 1, initial
        for s in range(4):
            low, self.vectors[s] = forward(self.vectors[s], kind)
            self.costs[s] += low

    def summary(self) -> dict:
        costs = [min(c + self.costs[s], NEVER) for s in range(4) for c in self.vectors[s][0]]
        return {"rows": self.rows, "illegal": self.illegal, "head": self.head, "tail": self.tail, "costs": costs, "order": [o for v in self.vectors for o in v[1]]}


def through(vector: Vector, part: dict) -> Vector:
    """The vector after a whole stretch."""
    costs, order = vector
    best = []
    for after in range(4):
        best.append(min((costs[s] + part["costs"][4 * s + after], order[s], part["order"][4 * s + after]) for s in range(4)))
    rank = sorted(range(4), key=lambda s: best[s][1:])
    return tuple(min(b[0], NEVER) for b in best), tuple(rank.index(s) for s in range(4))


def joined_up(parts: list[dict]) -> tuple[int, list[int], str]:
    """Cost, the states at the bounds of all stretches and the insertions at the end, for one conversation.

    Stretches are as many as partitions at most, so here the vectors of all bounds are kept instead of halving once more.
    """
    ahead = [tuple(0 if s in ENDS else next(n * INSERT for a, b, n in PADDINGS if (a, b) == (s, ASSISTANT)) for s in range(4))]
    for part in reversed(parts):
        ahead.append(tuple(min(part["costs"][4 * s + t] + ahead[-1][t] for t in range(4)) for s in range(4)))
    ahead.reverse()
    bounds = [START]
    for n, part in enumerate(parts):
        bounds.append(crossing(through(at(bounds[-1]), part), ahead[n + 1]))
    last = bounds[-1]
    return ahead[0][START], bounds, "" if last in ENDS else "I" * next(n for a, b, n in PADDINGS if (a, b) == (last, ASSISTANT))


def turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rid, role, text) of all rows, and what is judged of them, in order within stretches.

    The second table holds the rows (conv_id, turn, rid, seg, pos, fault, kind) and, for each stretch, one row with its ``sums``.
    """
    given = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))
    rows = stored(conversations.select("conv_id", "turn", *given, F.monotonically_increasing_id().alias("rid")), "turns")
    end = F.regexp_replace("text", r"[\x20\x09-\x0D]+\z", "")
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    narrow = rows.select("conv_id", "turn", "role", said.alias("said"), "rid", F.substring("role", 1, 1).alias("initial"), (end == "").alias("blank"), (~end.rlike(r"[.!?]\z")).alias("open"))
    # The first of equal turns comes from a partial aggregation; its number tells it from the others, so no key is hot.
    first = narrow.groupBy("conv_id", "said").agg(F.min(F.struct(F.col("turn").isNotNull().alias("given"), "turn", "rid"))["rid"].alias("rid")).select("rid", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("open"), "truncated")
    which = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    severity = F.when(F.col("fault") == "truncated", 1).when(F.col("fault").isNotNull(), MUST_GO).otherwise(0)
    judged = narrow.join(first, "rid", "left").withColumn("fault", fault).withColumn("kind", which * 3 + severity)
    order = ["conv_id", "turn", "role", "said", "rid"]
    placed = judged.select(*order, "initial", "fault", "kind").repartitionByRange(*order).sortWithinPartitions(*order)
    columns = f"conv_id {narrow.schema['conv_id'].dataType.simpleString()}, turn {narrow.schema['turn'].dataType.simpleString()}, rid long, seg long, pos long, fault string, kind int, sums {SUMS}"
    return rows.select("rid", "role", "text"), stored(placed.mapInArrow(into_stretches(columns), columns), "stretches")


def arrow_schema(columns: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(columns))


def into_stretches(columns: str):
    """Rows come sorted; each run of one conversation in a partition is a stretch and gets a row with its sums behind it."""
    schema = arrow_schema(columns)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, n, stretch, conv = TaskContext.get().partitionId() << 32, -1, None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if stretch is None or row["conv_id"] != conv:
                    if stretch is not None:
                        out.append({"conv_id": conv, "seg": base + n, "sums": stretch.summary()})
                    n, stretch, conv = n + 1, Stretch(row["initial"]), row["conv_id"]
                out.append({**{c: row[c] for c in ("conv_id", "turn", "rid", "fault", "kind")}, "seg": base + n, "pos": stretch.rows})
                stretch.add(row["kind"], row["initial"])
            yield pa.RecordBatch.from_pylist(out, schema)
        if stretch is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, "seg": base + n, "sums": stretch.summary()}], schema)

    return number


def by_conversation(batches: Iterator[pa.RecordBatch], schema: pa.Schema, begin, step, end) -> Iterator[pa.RecordBatch]:
    """Fold rows that come sorted by conversation: ``begin()`` makes a state, ``step(state, row)`` changes it, ``end(conv_id, state)`` gives rows."""
    state, conv = None, None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if state is None or row["conv_id"] != conv:
                if state is not None:
                    out += end(conv, state)
                state, conv = begin(), row["conv_id"]
            step(state, row)
        yield pa.RecordBatch.from_pylist(out, schema)
    if state is not None:
        yield pa.RecordBatch.from_pylist(end(conv, state), schema)


def bounds(stretches: DataFrame) -> DataFrame:
    """(conv_id, seg, enter, leave) of every stretch; the last one of a conversation also has its last insertions, cost and illegal pairs."""
    columns = f"conv_id {stretches.schema['conv_id'].dataType.simpleString()}, seg long, enter int, leave int, last string, cost long, illegal long"
    schema = arrow_schema(columns)

    def resolve(conv, parts: list[dict]) -> list[dict]:
        sums = [p["sums"] for p in parts]
        cost, states, last = joined_up(sums)
        illegal = sum(s["illegal"] for s in sums) + sum(a["tail"] + b["head"] not in ("su", "ua", "au") for a, b in zip(sums, sums[1:], strict=False))
        out = [{"conv_id": conv, "seg": p["seg"], "enter": states[k], "leave": states[k + 1]} for k, p in enumerate(parts)]
        out[-1] |= {"last": last, "cost": cost, "illegal": illegal}
        return out

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return by_conversation(batches, schema, list, list.append, resolve)

    sums = stretches.where("sums IS NOT NULL").select("conv_id", "seg", "sums")
    return stored(sums.repartition("conv_id").sortWithinPartitions("conv_id", "seg").mapInArrow(solve, columns), "bounds")


def edit_rows(kinds: bytes, enter: int, leave: int, last: str | None) -> Iterator[tuple[int, int, str, str | None]]:
    """(row, place before or at the row, edit, new role) of a stretch."""
    state = enter
    for pos, way in enumerate([*edits(kinds, enter, leave), last or ""]):
        for sub, edit in enumerate(way):
            role = None
            if edit in "IR":
                state = ASSISTANT if state == USER else USER
                role = ROLES[state]
            elif edit == "K":
                state = (SYSTEM, USER, ASSISTANT)[kinds[pos] // 3]
            yield pos, sub, edit, role


def repair(stretches: DataFrame, resolved: DataFrame) -> DataFrame:
    """(conv_id, place, edit, new_role, rid): every edit of every row and every insertion (without a rid), in order of ``place``."""
    columns = f"conv_id {stretches.schema['conv_id'].dataType.simpleString()}, place struct<seg:long,pos:long,sub:int>, edit string, new_role string, rid long"
    schema = arrow_schema(columns)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, rids, about = bytearray(), [], None

        def rows() -> Iterator[pa.RecordBatch]:
            out = []
            for pos, sub, edit, role in edit_rows(bytes(kinds), about["enter"], about["leave"], about["last"]):
                out.append({"conv_id": about["conv_id"], "place": {"seg": about["seg"], "pos": pos, "sub": sub}, "edit": edit, "new_role": role, "rid": None if edit == "I" else rids[pos]})
                if len(out) == 4096:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
            ready.extend(out)

        ready: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if about is not None and row["seg"] != about["seg"]:
                    yield from rows()
                    kinds, rids = bytearray(), []
                about = row
                kinds.append(row["kind"])
                rids.append(row["rid"])
            yield pa.RecordBatch.from_pylist(ready, schema)
            ready.clear()
        if about is not None:
            yield from rows()
            yield pa.RecordBatch.from_pylist(ready, schema)

    body = stretches.where("sums IS NULL").select("conv_id", "seg", "pos", "kind", "rid")
    known = body.join(resolved.select("seg", "enter", "leave", "last"), "seg")
    return known.repartition("seg").sortWithinPartitions("seg", "pos").mapInArrow(solve, columns)


def with_texts(edited: DataFrame, rows: DataFrame) -> DataFrame:
    """Edits with the role and text of the repaired row; inserted rows have an empty text."""
    own = F.coalesce("rid", -1 - F.abs(F.xxhash64("place") % F.lit(1 << 62)))  # insertions have no row to meet and spread by their place
    met = edited.withColumn("rid", own).join(rows, "rid", "left")
    return met.select("conv_id", "place", "edit", F.coalesce("new_role", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def repaired(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the rows of the repaired conversations and, with edit D, those that were deleted."""
    rows, stretches = turns(conversations)
    return with_texts(repair(stretches, bounds(stretches)), rows)


def digests(edited: DataFrame) -> DataFrame:
    """(conv_id, audit, repaired_sha256). Rows stream through in order: a conversation's text is never held whole."""
    columns = f"conv_id {edited.schema['conv_id'].dataType.simpleString()}, audit string, repaired_sha256 string"
    schema = arrow_schema(columns)

    def begin() -> dict:
        return {"audit": [], "hash": hashlib.sha256(), "lines": 0}

    def step(state: dict, row: dict) -> None:
        state["audit"].append(row["edit"])
        if row["edit"] != "D":
            state["hash"].update(("\n" * (state["lines"] > 0) + row["line"]).encode())
            state["lines"] += 1

    def end(conv, state: dict) -> list[dict]:
        return [{"conv_id": conv, "audit": "".join(state["audit"]), "repaired_sha256": state["hash"].hexdigest()}]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return by_conversation(batches, schema, begin, step, end)

    line = F.when(F.col("edit") != "D", F.concat("role", F.lit(":"), "text"))
    return edited.select("conv_id", "place", "edit", line.alias("line")).repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(fold, columns)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with the faults of the contract: a twentieth of the rows dropped, emptied, cut, repeated or given to the user."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = conversations.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")], (F.crc32(name.cast("binary")) % 20).alias("_d"))
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_d") == 4, "user").otherwise(F.col("role"))
    times = F.sequence(F.lit(1), F.when(F.col("_d") == 3, 2).otherwise(1))
    return rows.where("_d <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_n")).drop("_n")


def repair_report(conversations: DataFrame) -> DataFrame:
    """The contract's row per conversation: faults after the damage, cost and audit of the repair, digest of its result."""
    rows, stretches = turns(damaged(conversations))
    resolved = bounds(stretches)
    body = stretches.where("sums IS NULL")
    turn_count = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long")
    seen = body.groupBy("conv_id").agg(turn_count.alias("gaps"), *[F.count_if(F.col("fault") == f).alias(f) for f in FAULTS])
    costs = resolved.where("cost IS NOT NULL").select("conv_id", "illegal", "cost")
    told = digests(with_texts(repair(stretches, resolved), rows))
    out = conversations.select("conv_id").distinct()
    for part in (seen, costs, told):
        named = part.withColumnRenamed("conv_id", "_conv")
        out = out.join(named, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *FAULTS, "illegal", "cost")]
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
