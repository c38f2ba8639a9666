"""Conversation structure repair by bidirectional Dijkstra over an edit lattice.

A conversation's messages, in the order of their turns, are edited until the initials of their roles read `(s?(ua)+)?`.
A node of the lattice is (messages consumed, state of that pattern); Keep costs 0, Rerole to user or assistant 2, Delete 3
and Insert of an empty user or assistant message 2; a truncated message that is not deleted adds 1. Blank messages and
repeats of an earlier message (same role and text) can only be deleted. A forward and a reverse heap meet; both go on
until no path of equal cost can cross outside of what they settled, and among all crossings of least cost the audit
(the edits' initials in order) that is least in ASCII order is taken. From a node a letter leads to one node only, so the
least audit is read off by walking forward over the edges that lie on cheapest paths.

Messages are dealt by ranges of (conversation, turn, hash of role and text) and streamed in that order, so a conversation
may be of any size: it is cut into pieces of at most PIECE_ROWS messages or PIECE_BYTES bytes. A conversation that lies
within one range in one piece is repaired at once. Of the others each piece yields its costs from each state to each
state; these, one record a piece, are chained from the end; every piece is then searched with the costs of what follows
it, and the pieces are put together in a stream.

Null roles and texts count as one space. Messages of one turn are taken by a hash of role and text; null turns come first.
Whole rows that repeat are duplicates of each other. Null ids form one conversation. A role whose initial is not s, u or a
(the empty one too) is rerolled or deleted. Rows marked as dropped only keep their conversation in the result; without
messages it has zeros and an empty audit. An empty table gives an empty result. Only the four columns are read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from mosaiq.llm.common import materialize

PIECE_ROWS, PIECE_BYTES = 4096, 8 << 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
INF = 1 << 60
#: States: nothing yet, after s, after u, after a. What a kept initial leads to, and the state that an inserted or rerolled message leads to.
STEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NEXT = (2, 2, 3, 2)
ROLE = (None, None, "user", "assistant")
ENDS = (0, INF, INF, 0)
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
BLANKS = " \t\n\v\f\r"


def moves(codes: str, i: int, state: int, insert: bool) -> Iterator[tuple[str, int, int, int]]:
    """(letter, messages consumed, state, cost) of the edits at a node, by letter. Codes: initial, in capitals if truncated; - if it must go."""
    if i < len(codes):
        yield "D", i + 1, state, DELETE
    if insert:
        yield "I", i, NEXT[state], INSERT
    if i < len(codes) and (code := codes[i]) != "-":
        late = TRUNCATED if code.isupper() else 0
        if (kept := STEP[state].get(code.lower())) is not None:
            yield "K", i + 1, kept, KEEP + late
        yield "R", i + 1, NEXT[state], REROLE + late


def moves_into(codes: str, i: int, state: int, insert: bool) -> Iterator[tuple[int, int, int]]:
    """(messages consumed, state, cost) of the nodes from which an edit leads to this one."""
    if insert:
        for before in range(4):
            if NEXT[before] == state:
                yield i, before, INSERT
    if i:
        yield i - 1, state, DELETE
        if (code := codes[i - 1]) != "-":
            late = TRUNCATED if code.isupper() else 0
            for before in range(4):
                if STEP[before].get(code.lower()) == state:
                    yield i - 1, before, KEEP + late
                if NEXT[before] == state:
                    yield i - 1, before, REROLE + late


def cheapest(codes: str, entry: int = 0, exits: tuple = ENDS, last: bool = True) -> tuple[int, str, int]:
    """(cost, audit, state at the end): the cheapest edits of the coded messages from a state, with the costs of ending in each state.

    Unless it is the last piece nothing is inserted after its last message: the next piece does that."""
    n = len(codes)
    if not n:
        start = [(exits[entry], "", entry)]
        if last:  # what must still be inserted at the very end
            state, cost, audit = entry, 0, ""
            for _ in range(2):
                state, cost, audit = NEXT[state], cost + INSERT, audit + "I"
                start.append((cost + exits[state], audit, state))
        return min(start)
    forward, reverse = {(0, entry): 0}, {(n, s): c for s, c in enumerate(exits) if c < INF}
    ahead, behind = [(0, 0, entry)], [(c, n, s) for (_, s), c in reverse.items()]
    heapq.heapify(behind)
    settled, met, best = set(), set(), INF
    least = lambda heap: heap[0][0] if heap else 0  # noqa: E731 - a side that is done bounds nothing
    while (ahead or behind) and least(ahead) + least(behind) <= best:
        if ahead and (not behind or ahead[0][0] <= behind[0][0]):
            cost, i, state = heapq.heappop(ahead)
            if (i, state) in settled:
                continue
            settled.add((i, state))
            if i == n:  # the edge to the common end
                best = min(best, cost + exits[state])
            for _, j, to, step in moves(codes, i, state, last or i < n):
                if cost + step < forward.get((j, to), INF):
                    forward[j, to] = cost + step
                    heapq.heappush(ahead, (cost + step, j, to))
                if (j, to) in met:
                    best = min(best, cost + step + reverse[j, to])
        else:
            cost, i, state = heapq.heappop(behind)
            if (i, state) in met:
                continue
            met.add((i, state))
            for j, before, step in moves_into(codes, i, state, last or i < n):
                if cost + step < reverse.get((j, before), INF):
                    reverse[j, before] = cost + step
                    heapq.heappush(behind, (cost + step, j, before))
                if (j, before) in settled:
                    best = min(best, forward[j, before] + step + cost)
    # Crossings of least cost, and the settled nodes from which cheapest edits lead to one.
    crossing = [u for u in settled if u[0] == n and forward[u] + exits[u[1]] == best or any(v in met and forward[u] + step + reverse[v] == best for _, v, step in _steps(codes, u, last))]
    alive, open_ = set(crossing), list(crossing)
    while open_:
        i, state = open_.pop()
        for j, before, step in moves_into(codes, i, state, last or i < n):
            u = (j, before)
            if u in settled and u not in alive and forward[u] + step == forward[i, state]:
                alive.add(u)
                open_.append(u)
    node, spent, audit = (0, entry), 0, []
    while not (node[0] == n and spent + exits[node[1]] == best):
        for letter, v, step in _steps(codes, node, last):
            if v in met and spent + step + reverse[v] == best or v in alive and forward[v] == spent + step:
                node, spent = v, spent + step
                audit.append(letter)
                break
        else:
            raise AssertionError("no cheapest edit leaves a node of a cheapest path")
    return best, "".join(audit), node[1]


def _steps(codes: str, node: tuple[int, int], last: bool) -> Iterator[tuple[str, tuple[int, int], int]]:
    i, state = node
    return ((letter, (j, to), step) for letter, j, to, step in moves(codes, i, state, last or i < len(codes)))


cheapest_cached = lru_cache(1 << 16)(cheapest)


def crossing_costs(codes: str, last: bool) -> list[int]:
    """Least cost from each state at the start to each state at the end: 16 numbers, by start, then end."""
    columns = []
    for end in range(4):
        cost = [INF] * 4
        cost[end] = 0
        for i in range(len(codes), -1, -1):
            if i < len(codes):
                code, step = codes[i], [DELETE + c for c in cost]
                if code != "-":
                    late = TRUNCATED if code.isupper() else 0
                    for s in range(4):
                        kept = STEP[s].get(code.lower())
                        step[s] = min(step[s], REROLE + late + cost[NEXT[s]], INF if kept is None else KEEP + late + cost[kept])
                cost = step
            if last or i < len(codes):
                for _ in range(3):
                    cost = [min(cost[s], INSERT + cost[NEXT[s]]) for s in range(4)]
        columns.append(cost)
    return [min(columns[e][s], INF) for s in range(4) for e in range(4)]


def apply_audit(audit: str, state: int, messages: list[tuple[str, str]]) -> list[dict]:
    """The messages after the edits."""
    out, at = [], iter(messages)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(at)
        if letter == "K":
            state = STEP[state][role[:1]]
            out.append({"role": role, "text": text})
        elif letter != "D":
            state = NEXT[state]
            out.append({"role": ROLE[state], "text": text})
    return out


def faults(messages: list[tuple[str, str]], repeated: frozenset = frozenset()) -> tuple[str, int, int, int]:
    """(codes, blank, duplicate, truncated); repeated: places of messages that repeat one of an earlier piece."""
    codes, seen, counts = [], set(), [0, 0, 0]
    for k, (role, text) in enumerate(messages):
        end = text.rstrip(BLANKS)
        if not end:
            counts[0] += 1
            codes.append("-")
        elif (role, text) in seen or k in repeated:
            counts[1] += 1
            codes.append("-")
        else:
            seen.add((role, text))
            late = end[-1] not in ".!?"
            counts[2] += late
            initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
            codes.append(initial.upper() if late else initial)
    return "".join(codes), *counts


def illegal_pairs(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def missing_turns(turns: list[int | None]) -> int:
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


def _shapes(key: StructField) -> tuple[StructType, StructType]:
    """Schemas of the first pass (a finished conversation, or a piece with its messages) and of the result."""
    messages = "array<struct<role:string,text:string>>"
    raw = StructType.fromDDL(f"piece long, closed boolean, raw array<struct<turn:long,role:string,text:string>>, messages {messages}, {', '.join(f'{c} long' for c in COUNTS)}, audit string")
    done = StructType.fromDDL(f"place long, last boolean, messages {messages}, {', '.join(f'{c} long' for c in COUNTS)}, audit string")
    return StructType([key, StructField("range", raw["piece"].dataType), *raw]), StructType([key, *done])


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for a in range(0, batch.num_rows, 512):
            yield from batch.slice(a, 512).to_pylist()


def _batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in batches of some 4 MB of their texts, 512 rows at most."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(m["text"]) for m in (row.get("messages") or row.get("raw") or ()))
        if len(held) >= 512 or size > 4 << 20:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _whole(messages: list[dict]) -> dict:
    pairs = [(m["role"], m["text"]) for m in messages]
    codes, blank, duplicate, truncated = faults(pairs)
    cost, audit, _ = cheapest_cached(codes) if len(codes) <= 64 else cheapest(codes)
    counts = (missing_turns([m["turn"] for m in messages]), blank, duplicate, truncated, illegal_pairs([p[0][:1] for p in pairs]), cost)
    return {**dict(zip(COUNTS, counts)), "audit": audit, "messages": apply_audit(audit, 0, pairs)}


def repair(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", dropped: Column | None = None) -> DataFrame:
    """The repaired conversations: (conv_id, place, last, messages, counts, audit), one row a piece, counts and audit on the last one."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    live = F.lit(True) if dropped is None else ~F.coalesce(dropped, F.lit(False))
    named = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"), live.alias("live"))
    dealt = named.withColumn("order", F.xxhash64("role", "text"))
    # the last key deals equal messages to several ranges: their order is of no account
    dealt = dealt.repartitionByRange("conv_id", F.col("turn").asc_nulls_first(), "order", F.monotonically_increasing_id())
    dealt = dealt.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "order", "role", "text").drop("order")
    key = StructField("conv_id", named.schema["conv_id"].dataType)
    first_pass, shape = _shapes(key)
    sent = _arrow(first_pass)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId()

        def pieces() -> Iterator[dict]:
            base = {"range": place, **dict.fromkeys(["raw", "messages", *COUNTS, "audit"])}
            conv, held, size, number, whole, started = None, [], 0, 0, False, False
            for row in _rows(batches):
                if started and row["conv_id"] != conv:
                    yield base | {"conv_id": conv, "piece": number, "closed": whole} | (_whole(held) if whole else {"raw": held})
                    held, size, number, whole = [], 0, number + 1, True  # the next one starts within this range
                elif len(held) >= PIECE_ROWS or size >= PIECE_BYTES:
                    yield base | {"conv_id": conv, "piece": number, "closed": False, "raw": held}
                    held, size, number, whole = [], 0, number + 1, False
                conv, started = row["conv_id"], True
                if row["live"]:
                    held.append({"turn": row["turn"], "role": row["role"], "text": row["text"]})
                    size += len(row["text"])
            if started:  # it may go on in the next range
                yield base | {"conv_id": conv, "piece": number, "closed": False, "raw": held}

        yield from _batches(pieces(), sent)

    passed = materialize(dealt.mapInArrow(cut, first_pass), "conversations")
    done = passed.filter("closed").select("conv_id", F.lit(0).cast("long").alias("place"), F.lit(True).alias("last"), "messages", *COUNTS, "audit")
    return done.unionByName(_joined(passed.filter("not closed").select("conv_id", "range", "piece", "raw"), key, shape))


def _joined(pieces: DataFrame, key: StructField, shape: StructType) -> DataFrame:
    """Conversations that are in several pieces or may be."""
    at = ["range", "piece"]
    # messages that repeat one of an earlier piece
    every = pieces.select("conv_id", *at, F.posexplode("raw").alias("pos", "m")).select("conv_id", *at, "pos", F.sha2(F.concat(F.sha2("m.role", 256), "m.text"), 256).alias("said"))
    first = every.groupBy("conv_id", "said").agg(F.min(F.struct(*at)).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("conv_id").alias("c"), F.col("said").alias("s"), "first")
    later = every.join(first, every["conv_id"].eqNullSafe(first["c"]) & (every["said"] == first["s"])).filter(F.struct(*at) > F.col("first"))
    gone = later.groupBy(*at).agg(F.collect_list("pos").alias("gone"))  # at most the messages of a piece
    marked = pieces.join(gone, at, "left")
    coded = StructType([key, *StructType.fromDDL("range long, piece long, codes string, turn array<long>, counts array<long>, ends array<string>, costs array<long>, tail array<long>")])
    to = _arrow(coded)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[dict]:
            for row in _rows(batches):
                pairs = [(m["role"], m["text"]) for m in row["raw"]]
                codes, *counts = faults(pairs, frozenset(row["gone"] or ()))
                turns = [m["turn"] for m in row["raw"] if m["turn"] is not None]
                initials = [p[0][:1] for p in pairs]
                yield {
                    "conv_id": row["conv_id"], "range": row["range"], "piece": row["piece"], "codes": codes,
                    "turn": [turns[0], turns[-1], len(set(turns))] if turns else [], "counts": [*counts, illegal_pairs(initials)],
                    "ends": [initials[0], initials[-1]] if initials else [], "costs": crossing_costs(codes, False), "tail": crossing_costs(codes, True),
                }

        yield from _batches(found(), to)

    codes = materialize(marked.mapInArrow(code, coded), "conversation-codes")

    def chain(group: pd.DataFrame) -> pd.DataFrame:
        """For each piece what ending it in each state costs from there on. One record a piece."""
        group = group.sort_values(["range", "piece"])
        after, out = list(ENDS), []
        for k, row in enumerate(reversed(list(group.itertuples()))):
            out.append((row.range, row.piece, len(group) - 1 - k, k == 0, after))
            costs = row.tail if k == 0 else row.costs
            after = [min(int(costs[4 * s + e]) + after[e] for e in range(4)) for s in range(4)]
            after = [min(c, INF) for c in after]
        return pd.DataFrame(out, columns=["range", "piece", "place", "last", "after"])

    followed = codes.select("conv_id", *at, "costs", "tail").groupBy("conv_id").applyInPandas(chain, "range long, piece long, place long, last boolean, after array<long>")
    ready = pieces.join(codes.drop("conv_id", "costs", "tail").join(followed, at), at)
    ready = ready.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "place")
    out = _arrow(shape)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[dict]:
            for row in _rows(batches):
                if row["place"] == 0:
                    state, cost, audits, totals, turns, before = 0, 0, [], [0] * 4, [], None
                exits = tuple(row["after"])
                spent, audit, end = cheapest(row["codes"], state, exits, row["last"])
                messages = apply_audit(audit, state, [(m["role"], m["text"]) for m in row["raw"]])
                cost, state = cost + spent - exits[end], end
                audits.append(audit)
                totals = [a + b for a, b in zip(totals, row["counts"])]
                if row["ends"]:
                    totals[3] += before is not None and illegal_pairs([before, row["ends"][0]])
                    before = row["ends"][1]
                if t := row["turn"]:
                    turns = [turns[0], t[1], turns[2] + t[2] - (turns[1] == t[0])] if turns else list(t)
                row = {"conv_id": row["conv_id"], "place": row["place"], "last": row["last"], "messages": messages}
                if row["last"]:
                    row |= dict(zip(COUNTS, [turns[1] - turns[0] + 1 - turns[2] if turns else 0, *totals, cost])) | {"audit": "".join(audits)}
                yield dict.fromkeys([*COUNTS, "audit"]) | row

        yield from _batches(found(), out)

    return ready.mapInArrow(walk, shape)


def report(repaired: DataFrame) -> DataFrame:
    """Per conversation its counts, the cost and the audit."""
    return repaired.filter("last").select("conv_id", *COUNTS, "audit")


def messages(repaired: DataFrame) -> DataFrame:
    """The repaired messages one by one: conv_id, place of the piece, place in the piece, role, text."""
    return repaired.select("conv_id", "place", F.posexplode("messages").alias("position", "m")).select("conv_id", "place", "position", "m.role", "m.text")


def digests(repaired: DataFrame) -> DataFrame:
    """report() with the SHA-256 of `role:text` of all repaired messages, joined by newlines. Conversations in several pieces are hashed in a stream."""
    line = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n")
    one = F.col("last") & (F.col("place") == 0)
    short = repaired.filter(one).select("conv_id", *COUNTS, "audit", F.sha2(line, 256).alias("repaired_sha256"))
    shape = StructType([repaired.schema["conv_id"], *StructType.fromDDL(f"{', '.join(f'{c} long' for c in COUNTS)}, audit string, repaired_sha256 string")])
    out = _arrow(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[dict]:
            for row in _rows(batches):
                if row["place"] == 0:
                    digest, empty = hashlib.sha256(), True
                if row["lines"] is not None:
                    digest.update((b"" if empty else b"\n") + row["lines"].encode())
                    empty = False
                if row["last"]:
                    yield {c: row[c] for c in ("conv_id", *COUNTS, "audit")} | {"repaired_sha256": digest.hexdigest()}

        yield from _batches(found(), out)

    lines = F.when(F.size("messages") > 0, line)
    long = repaired.filter(~one).select("conv_id", "place", "last", lines.alias("lines"), *COUNTS, "audit")
    return short.unionByName(long.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "place").mapInArrow(run, shape))


def damage(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) with a fault by crc32 of `conv_id:turn` modulo 20, nulls as one space; `dropped` marks what a fault took away."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(fault == 1, F.lit("")).when(fault == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    role = F.when(fault == 4, F.lit("user")).otherwise(space("role"))
    copies = F.explode(F.when(fault == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (fault == 0).alias("dropped"), copies.alias("copy")).drop("copy")
