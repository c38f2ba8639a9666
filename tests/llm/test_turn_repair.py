import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from mosaiq.llm import turn_repair
from mosaiq.llm.queries import op11_edit_lattice

PATTERN = re.compile(r"(s?(ua)+)?")
SHAPE = "conv_id long, turn long, role string, text string"


def best_edits(codes):
    """Cheapest cost and least audit by a plain recursion from the end over (place, state)."""
    n, big = len(codes), (10**9, "")
    best = [[big] * 4 for _ in range(n + 1)]
    best[n][0] = best[n][3] = (0, "")
    for i in range(n, -1, -1):
        if i < n:
            c = codes[i]
            late = int(c.isupper())
            for s in range(4):
                found = [(best[i + 1][s][0] + 3, "D" + best[i + 1][s][1])]
                if c != "-":
                    k = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((s, c.lower()))
                    if k is not None:
                        found.append((best[i + 1][k][0] + late, "K" + best[i + 1][k][1]))
                    r = best[i + 1][3 if s == 2 else 2]
                    found.append((r[0] + 2 + late, "R" + r[1]))
                best[i][s] = min(found)
        for _ in range(4):
            for s in range(4):
                t = best[i][3 if s == 2 else 2]
                best[i][s] = min(best[i][s], (t[0] + 2, "I" + t[1]))
    return best[0][0]


def expected(rows):
    """The contract in plain Python."""
    space = lambda v: " " if v is None else str(v)
    groups = {}
    for conv, turn, role, text in rows:
        role, text = space(role), space(text)
        fault = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        got = groups.setdefault(conv, [])
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        got.extend([] if fault == 0 else [(turn, role, text)] * (2 if fault == 3 else 1))
    out = {}
    for conv, got in groups.items():
        got.sort(key=lambda m: (m[0] is not None, m[0] or 0))
        known = {m[0] for m in got if m[0] is not None}
        counts, seen, codes = [0, 0, 0], set(), ""
        for _, role, text in got:
            found = re.findall(r"[^\x20\x09-\x0D]", text)
            code = role[:1] if role[:1] in ("s", "u", "a") else "x"
            if not found:
                counts[0] += 1
                code = "-"
            elif (role, text) in seen:
                counts[1] += 1
                code = "-"
            elif found[-1] not in ".!?":
                counts[2] += 1
                code = code.upper()
            seen.add((role, text))
            codes += code
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(got, got[1:]))
        cost, audit = best_edits(codes)
        state, at, lines = 0, iter(got), []
        for letter in audit:
            role, text = ("", "") if letter == "I" else next(at)[1:]
            if letter == "D":
                continue
            if letter != "K":
                role = "assistant" if state == 2 else "user"
            state = {"s": 1, "u": 2, "a": 3}[role[0]]
            lines.append(f"{role}:{text}")
        assert PATTERN.fullmatch("".join(x[0] for x in lines))
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def as_rows(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.select("conv_id", *turn_repair.COUNTS, "audit", "repaired_sha256").collect()}


def run(df):
    damaged = turn_repair.damage(df)
    return as_rows(turn_repair.digests(turn_repair.repair(damaged, dropped=F.col("dropped"))))


def made(seed, conversations, most=9):
    """Turns are unique within a conversation but for whole rows that repeat, so that their order is the contract's."""
    r, rows = random.Random(seed), []
    for conv in range(conversations):
        turns = r.sample([None, *range(20)], r.randint(1, most))
        for turn in turns:
            role = r.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None])
            text = r.choice(["Hello.", "Why?", "cut off", "  ", "", None, "Yes!", "No. \n", "é.", "\x85", "a" * 300 + "."])
            rows += [(conv or None, turn, role, text)] * r.choice([1, 1, 1, 1, 2])
    return rows


def test_search_is_the_cheapest_and_least():
    r = random.Random(1)
    for n in range(9):
        for _ in range(400):
            codes = "".join(r.choice("suaxSUAX-uaua") for _ in range(n))
            assert turn_repair.cheapest(codes)[:2] == best_edits(codes), codes
    for codes in ("ua" * 300, "u" * 300, "s" * 200 + "ax" * 50, "-" * 300):
        assert turn_repair.cheapest(codes)[:2] == best_edits(codes)


def test_pieces_chain_to_the_whole():
    r = random.Random(2)
    for _ in range(300):
        parts = ["".join(r.choice("suaSUAx-uaua") for _ in range(r.randint(0, 5))) for _ in range(r.randint(1, 4))]
        after, follow = list(turn_repair.ENDS), []
        for k, part in enumerate(reversed(parts)):
            follow.insert(0, tuple(after))
            costs = turn_repair.crossing_costs(part, k == 0)
            after = [min(costs[4 * s + e] + after[e] for e in range(4)) for s in range(4)]
        state, audit = 0, ""
        for k, part in enumerate(parts):
            _, piece, state = turn_repair.cheapest(part, state, follow[k], k == len(parts) - 1)
            audit += piece
        assert (after[0], audit) == best_edits("".join(parts))


@pytest.mark.parametrize("partitions", [1, 5])
def test_against_brute_force(spark, partitions):
    rows = made(3, 150)
    assert run(spark.createDataFrame(rows, SHAPE).repartition(partitions)) == expected(rows)


@pytest.mark.parametrize("piece", [1, 3])
def test_long_conversations_in_pieces(spark, monkeypatch, piece):
    monkeypatch.setattr(turn_repair, "PIECE_ROWS", piece)
    rows = made(4, 40, 20)
    assert run(spark.createDataFrame(rows, SHAPE).repartition(3)) == expected(rows)


def test_repeats_across_ranges(spark):
    rows = [(7, t, ["user", "assistant"][t % 2], ["Same.", f"Say {t % 50}."][t % 3 > 0]) for t in range(3000)] + [(8, None, "user", "Same.")] * 500
    assert run(spark.createDataFrame(rows, SHAPE).repartition(6)) == expected(rows)


def test_edges(spark):
    nothing = spark.createDataFrame([], SHAPE)
    assert turn_repair.repair(nothing).count() == 0
    clash = spark.createDataFrame([(1, 0, "user", "Hi.", 5), (1, 1, "assistant", "Yo.", 6)], SHAPE + ", place int").withColumn("range", F.lit(1)).withColumn("order", F.lit("x"))
    repaired = turn_repair.repair(clash)
    assert [tuple(r) for r in turn_repair.messages(repaired).select("role", "text").orderBy("position").collect()] == [("user", "Hi."), ("assistant", "Yo.")]
    assert turn_repair.report(repaired).first()["audit"] == "KK"


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert as_rows(op11_edit_lattice(spark, folder)) == expected(rows)
