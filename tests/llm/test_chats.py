import hashlib
import random
import re
import zlib
from heapq import heappop, heappush

import pytest

from recordloom.llm import chats as C

LEGAL = ("su", "ua", "au")


def shortest(rows):
    """Cheapest, then ASCII-least audit by Dijkstra's search over (rows done, state); rows are (role, text, fault)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, k, state, out = heappop(heap)
        if (k, state) in done:
            continue
        done.add((k, state))
        if k == len(rows) and state in ("", "a"):
            return cost, audit, "\n".join(out)

        def follow(role, initial=None):
            new = role[:1] if initial is None else initial
            return new if (state, new) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")} else None

        for role in ("user", "assistant"):
            if follow(role):
                heappush(heap, (cost + 5, audit + "I", k, follow(role), (*out, role + ":")))
        if k < len(rows):
            role, text, fault = rows[k]
            heappush(heap, (cost + 2, audit + "D", k + 1, state, out))
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                if follow(role):
                    heappush(heap, (cost + extra, audit + "K", k + 1, follow(role), (*out, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if follow(new):
                        heappush(heap, (cost + extra + 1, audit + "R", k + 1, follow(new), (*out, f"{new}:{text}")))


def with_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        told = text.rstrip(" \t\n\v\f\r")
        out.append((role, text, "blank" if not told else "duplicate" if (role, text) in seen else "truncated" if told[-1] not in ".!?" else None))
        seen.add((role, text))
    return out


def damage(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            row = (turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            yield from [(conv, row)] * (2 if kind == 3 else 1)


def brute(rows, ordered=None):
    """The report's rows; ``ordered`` names an order for rows of one turn."""
    convs = {r[0]: [] for r in rows}
    for conv, row in damage(rows):
        convs[conv].append(row)
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, *(ordered(r) if ordered else ())))
        judged = with_faults(own)
        turns = [r[0] for r in own if r[0] is not None]
        cost, audit, text = shortest(judged)
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(judged, judged[1:], strict=False)]
        counts = [sum(f == name for *_, f in judged) for name in C.FAULTS]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        yield conv, gaps, *counts, sum(p not in LEGAL for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest()


COLUMNS = ["conv_id", "gaps", *C.FAULTS, "illegal", "cost", "audit", "repaired_sha256"]


def said(row):
    return row[1], hashlib.sha256(f"{len(row[1])}:{row[1]}{row[2]}".encode()).hexdigest()


def test_report_equals_shortest_paths_on_the_table(spark, same):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").union(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").selectExpr("conv_id + 100000", "turn", "role", "text"))
    same(C.repair_report(table), COLUMNS, brute([tuple(r) for r in table.collect()]))


def odd_chats():
    rng = random.Random(3)
    texts = ["Yes.", "no", "", " \t", "Why?", None, "x" * 40000 + ".", "Yes."]
    rows = [(rng.choice([None, 1, 2, 3, 4]), rng.choice([None, 0, 1, 2, 5, 9]), rng.choice(["user", "assistant", "system", "tool", "", None, "util"]), rng.choice(texts)) for _ in range(90)]
    return rows + [(77, n, "user" if n % 3 else "assistant", f"{n % 41}{'.' * (n % 4 > 0)}") for n in range(700)] + [(8, 1, "user", "Hm.")] * 6


@pytest.mark.parametrize("parts", ["1", "7"])
def test_nulls_ties_repeats_and_long_conversations(spark, same, parts):
    frame = spark.createDataFrame([(*r, "x", 1) for r in odd_chats()], "conv_id long, turn long, role string, text string, place string, kind int")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        same(C.repair_report(frame), COLUMNS, brute(odd_chats(), said))
        stretches = C.turns(frame)[1].where("sums IS NOT NULL AND conv_id = 77").count()
        assert stretches == 1 if parts == "1" else stretches > 1
        assert C.repair_report(frame.where("false")).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_rows_of_the_repaired_conversations(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Well?"), (1, 2, "user", "Well?"), (2, 0, "system", "Be kind.")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = C.repaired(frame).orderBy("conv_id", "place").collect()
    assert [(r.conv_id, r.edit, r.role, r.text) for r in found] == [(1, "R", "user", "Hello."), (1, "R", "assistant", "Well?"), (1, "D", "user", "Well?"), (2, "D", "system", "Be kind.")]
    kept = ["".join(r.role[0] for r in found if r.conv_id == c and r.edit != "D") for c in (1, 2)]
    assert all(re.fullmatch("(s?(ua)+)?", k) for k in kept)


@pytest.mark.parametrize("seed", range(4))
def test_halving_finds_the_least_audit(seed):
    rng = random.Random(seed)
    for _ in range(150):
        rows = [(rng.choice(["user", "assistant", "system", "tool"]), f"t{n}", rng.choice([None, None, "truncated", "blank"])) for n in range(rng.randint(0, 14))]
        kinds = bytes({"s": 0, "u": 1, "a": 2}.get(r[0][0], 3) * 3 + {None: 0, "truncated": 1, "blank": 2}[r[2]] for r in rows)
        cuts = sorted({0, len(kinds), *[rng.randint(0, len(kinds)) for _ in range(3)]})
        parts = []
        for low, high in zip(cuts, cuts[1:], strict=False):
            stretch = C.Stretch(rows[low][0][:1])
            for k in range(low, high):
                stretch.add(kinds[k], rows[k][0][:1])
            parts.append(stretch.summary())
        cost, states, last = C.joined_up(parts)
        audit = "".join("".join(C.edits(kinds[low:high], a, b)) for low, high, a, b in zip(cuts, cuts[1:], states, states[1:], strict=False)) + last
        assert (cost, audit) == shortest(rows)[:2]
