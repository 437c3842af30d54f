"""Conversations brought back into the form (system)? (user assistant)* at the least cost, with an audit of the edits.

Each message is kept, given the role of user or assistant, or deleted, and empty messages may be put in.
The roles that may follow are four states (nothing yet, after system, after user, after assistant), so a
stretch of messages is a table of costs from state to state. The cheapest edits are found by divide and
conquer: costs run forward over the first half and backward over the second one, the state in which both
meet is chosen, and each half is solved between its states; only vectors of four costs are held. Among
crossings of one cost the one with the least audit wins: the forward costs carry the rank of their audits,
and no audit of the same messages begins another one, so the rank of the first half decides.

The same meeting works between tasks. Messages are dealt by ranges of (conversation, turn), so that one
conversation of any length is spread; each stretch gives its costs from state to state, the stretches of a
conversation meet in states, and then each stretch is solved by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import settle

NEVER = 1 << 60
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
FREE, GONE, TRUNCATED = 0, 1, 2
#: From a state (0 nothing yet, 1 after system, 2 after user, 3 after assistant): roles that may follow, and the state then.
FOLLOWS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ROLES = {"u": "user", "a": "assistant"}
#: Cost and insertions that end a conversation in each state.
ENDS = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))
NOTHING = hashlib.sha256(b"").hexdigest()

Vector = tuple[tuple[int, ...], tuple[int, ...]]


def _inserted(state: int) -> tuple[str, int]:
    """What an insertion adds in a state, and the state then; one role at most can follow."""
    return next((role, to) for role, to in FOLLOWS[state].items() if role in ROLES)


@cache
def steps(code: int) -> tuple[tuple[tuple[int, str] | None, ...], ...]:
    """Cost and least audit of one message from each state to each; insertions before it belong to it.

    A code is the role (0 s, 1 u, 2 a, 3 another) and, times four, the fault.
    """
    role, fault = "sua?"[code % 4], code // 4
    late = CUT_OFF if fault == TRUNCATED else 0
    table: list[list[tuple[int, str] | None]] = [[None] * 4 for _ in range(4)]
    for start in range(4):
        state = start
        for inserts in range(4):
            ways = [(DELETE, "D", state)]
            if fault != GONE:
                ways += [(REROLE + late, "R", to) for r, to in FOLLOWS[state].items() if r in ROLES]
                ways += [(KEEP + late, "K", FOLLOWS[state][role])] if role in FOLLOWS[state] else []
            for cost, edit, to in ways:
                found = (cost + INSERT * inserts, "I" * inserts + edit)
                table[start][to] = min(found, table[start][to] or found)
            state = _inserted(state)[1]
    return tuple(map(tuple, table))


@cache
def _forward(vector: Vector, code: int) -> tuple[Vector, int]:
    """Costs and ranks of audits after one more message, costs above the least one, and that."""
    costs, ranks = vector
    best: list[tuple[int, int, str] | None] = [None] * 4
    for start, row in enumerate(steps(code)):
        for to, step in enumerate(row):
            if step and costs[start] < NEVER:
                found = (costs[start] + step[0], ranks[start], step[1])
                best[to] = min(found, best[to] or found)
    least = min(b[0] for b in best if b)
    order = sorted(b[1:] for b in best if b)
    return (tuple(b[0] - least if b else NEVER for b in best), tuple(order.index(b[1:]) if b else 4 for b in best)), least


@cache
def _backward(costs: tuple[int, ...], code: int) -> tuple[int, ...]:
    """Costs to the end from each state before one message, above the least one."""
    out = [min((step[0] + costs[to] for to, step in enumerate(row) if step and costs[to] < NEVER), default=NEVER) for row in steps(code)]
    least = min(out)
    return tuple(c - least if c < NEVER else c for c in out)


def unit(state: int) -> Vector:
    return tuple(0 if s == state else NEVER for s in range(4)), (0, 0, 0, 0)


def run_forward(start: int, codes: bytes) -> tuple[Vector, int]:
    vector, cost = unit(start), 0
    for code in codes:
        vector, more = _forward(vector, code)
        cost += more
    return vector, cost


def crossing(forward: Vector, backward: tuple[int, ...]) -> int:
    """The state in which both halves cost least together; of several the one with the least audit before it."""
    return min((c + b, rank, s) for s, (c, rank, b) in enumerate(zip(*forward, backward, strict=True)) if c < NEVER and b < NEVER)[2]


def audit_between(codes: bytes, start: int, end: int) -> str:
    """The least audit among the cheapest ones from one state to another."""
    done: list[str] = []
    open_: list[tuple[int, int, int, int]] = [(0, len(codes), start, end)]
    while open_:
        lo, hi, p, q = open_.pop()
        if hi - lo == 1:
            done.append(steps(codes[lo])[p][q][1])
        elif hi > lo:
            mid = (lo + hi) // 2
            vector = run_forward(p, codes[lo:mid])[0]
            costs = unit(q)[0]
            for code in reversed(codes[mid:hi]):
                costs = _backward(costs, code)
            state = crossing(vector, costs)
            open_ += [(mid, hi, state, q), (lo, mid, p, state)]
    return "".join(done)


def meet(stretches: list[list[tuple[Vector, int]]]) -> tuple[int, list[int]]:
    """Least cost of a conversation and the states between its stretches, from each stretch's costs by start.

    The way of `audit_between` with stretches for messages; the last state is the one before the end.
    """

    def ahead(vector: Vector, stretch: list[tuple[Vector, int]]) -> Vector:
        best: list[tuple[int, int, int] | None] = [None] * 4
        for start, ((costs, ranks), cost) in enumerate(stretch):
            for to in range(4):
                if vector[0][start] < NEVER and costs[to] < NEVER:
                    found = (vector[0][start] + costs[to] + cost, vector[1][start], ranks[to])
                    best[to] = min(found, best[to] or found)
        order = sorted(b[1:] for b in best if b)
        return tuple(b[0] if b else NEVER for b in best), tuple(order.index(b[1:]) if b else 4 for b in best)

    def back(costs: tuple[int, ...], stretch: list[tuple[Vector, int]]) -> tuple[int, ...]:
        return tuple(min((cost + c + costs[to] for to, c in enumerate(v[0]) if c < NEVER and costs[to] < NEVER), default=NEVER) for v, cost in stretch)

    vector = unit(0)
    for stretch in stretches:
        vector = ahead(vector, stretch)
    ends = tuple(cost for cost, _ in ENDS)
    last = crossing(vector, ends)
    states = [0] * len(stretches) + [last]
    open_ = [(0, len(stretches), 0, last)]
    while open_:
        lo, hi, p, q = open_.pop()
        if hi - lo > 1:
            mid = (lo + hi) // 2
            vector = unit(p)
            for stretch in stretches[lo:mid]:
                vector = ahead(vector, stretch)
            costs = unit(q)[0]
            for stretch in reversed(stretches[mid:hi]):
                costs = back(costs, stretch)
            states[mid] = crossing(vector, costs)
            open_ += [(lo, mid, p, states[mid]), (mid, hi, states[mid], q)]
    vector = unit(0)
    for stretch in stretches:
        vector = ahead(vector, stretch)
    return vector[0][last] + ends[last], states


_PIECES = "key string, part int, codes binary, first int, last int, blank bigint, duplicate bigint, truncated bigint, illegal bigint, costs array<bigint>"
_ILLEGAL = [[(a, b) not in ((0, 1), (1, 2), (2, 1)) for b in range(4)] for a in range(4)]


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            yield from batch.slice(at, 1024).to_pylist()


def _batches(rows: Iterable[dict], schema: pa.Schema, size: int = 1024) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation of a sorted partition: the codes of its messages, its faults and its costs from state to state."""
    schema = pa.schema([("key", pa.string()), ("part", pa.int32()), ("codes", pa.binary()), ("first", pa.int32()), ("last", pa.int32()), *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")], ("costs", pa.list_(pa.int64()))])

    def found() -> Iterator[dict]:
        for (key, part), rows in groupby(_rows(batches), lambda r: (r["key"], r["part"])):
            codes, faults = bytearray(), {"blank": 0, "duplicate": 0, "truncated": 0}
            for r in rows:
                seen_before = r["n"] - int(r["first"])
                if r["fault"] == "blank":
                    faults["blank"] += r["n"]
                    codes += bytes([r["role"] + 4 * GONE]) * r["n"]
                    continue
                if r["first"]:
                    faults["truncated"] += r["fault"] == "truncated"
                    codes.append(r["role"] + 4 * (TRUNCATED if r["fault"] else FREE))
                faults["duplicate"] += seen_before
                codes += bytes([r["role"] + 4 * GONE]) * seen_before
            packed = bytes(codes)
            costs = [x for p in range(4) for vector, cost in [run_forward(p, packed)] for x in (*vector[0], *vector[1], cost)]
            illegal = sum(_ILLEGAL[a % 4][b % 4] for a, b in zip(packed, packed[1:], strict=False))
            yield {"key": key, "part": part, "codes": packed, "first": packed[0] % 4, "last": packed[-1] % 4, **faults, "illegal": illegal, "costs": costs}

    yield from _batches(found(), schema, 64)


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", pa.string()), ("cost", pa.int64()), ("between", pa.int64()), ("places", pa.list_(pa.struct([("part", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("tail", pa.string())])))])

    def found() -> Iterator[dict]:
        for r in _rows(batches):
            parts = r["stretches"]
            tables = [[((tuple(s["costs"][9 * p : 9 * p + 4]), tuple(s["costs"][9 * p + 4 : 9 * p + 8])), s["costs"][9 * p + 8]) for p in range(4)] for s in parts]
            cost, states = meet(tables)
            between = sum(_ILLEGAL[a["last"]][b["first"]] for a, b in zip(parts, parts[1:], strict=False))
            places = [{"part": s["part"], "start": states[i], "end": states[i + 1], "tail": ENDS[states[-1]][1] if i == len(parts) - 1 else ""} for i, s in enumerate(parts)]
            yield {"key": r["key"], "cost": cost, "between": between, "places": places}

    yield from _batches(found(), schema, 64)


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", pa.string()), ("part", pa.int32()), ("piece", pa.string())])
    solved = ({"key": r["key"], "part": r["part"], "piece": audit_between(r["codes"], r["start"], r["end"]) + r["tail"]} for r in _rows(batches))
    yield from _batches(solved, schema, 64)


def repaired(rows: Iterable[dict], audit: str) -> Iterator[tuple[str, str, str]]:
    """Edit, role and text of each message that an audit leaves or puts in, in order; `rows` may be a stream."""
    rows, state = iter(rows), 0
    for edit in audit:
        if edit == "I":
            role, state = _inserted(state)
            yield edit, ROLES[role], ""
            continue
        row = next(rows)
        if edit == "R":
            role, state = _inserted(state)
            yield edit, ROLES[role], row["text"]
        elif edit == "K":
            state = FOLLOWS[state][row["role"][:1]]
            yield edit, row["role"], row["text"]


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, Iterator[dict]]]:
    """Key, audit and messages of each conversation of a sorted partition, as a stream."""
    for key, rows in groupby(_rows(batches), lambda r: r["key"]):
        yield key, next(rows)["audit"], (r for r in rows for _ in range(r["copies"]))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", pa.string()), ("repaired_sha256", pa.string())])

    def found() -> Iterator[dict]:
        for key, audit, rows in _conversations(batches):
            state, line = hashlib.sha256(), ""
            for _, role, text in repaired(rows, audit):
                state.update(f"{line}{role}:{text}".encode())
                line = "\n"
            yield {"key": key, "repaired_sha256": state.hexdigest()}

    yield from _batches(found(), schema)


def _messages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", pa.string()), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    told = ({"key": key, "position": i, "edit": edit, "role": role, "text": text} for key, audit, rows in _conversations(batches) for i, (edit, role, text) in enumerate(repaired(rows, audit)))
    yield from _batches(told, schema)


def _key(conversation: Column) -> Column:
    """A key that is never null, so that rows without a conversation are one."""
    return F.coalesce(F.concat(F.lit("#"), conversation.cast("string")), F.lit(""))


def _unkey(key: Column) -> Column:
    return F.when(key != "", F.substring(key, 2, 20)).cast("bigint")


def damage(conversations: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """key, turn, role, text and copies: rows damaged by a checksum of conversation and turn.

    By the checksum modulo 20: 0 is dropped, 1 loses its text, 2 its `.!?`, 3 comes twice, 4 gets the role of
    user. Null role and text, and nulls in the checksum, are one space.
    """
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conversation, turn)]
    kind = F.crc32(F.concat(named[0], F.lit(":"), named[1])) % 20
    said = F.coalesce(F.col(text), F.lit(" "))
    return conversations.select(
        _key(F.col(conversation)).alias("key"), F.col(turn).cast("bigint").alias("turn"), F.when(kind == 4, "user").otherwise(F.coalesce(F.col(role), F.lit(" "))).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(said, "[.!?]", "")).otherwise(said).alias("text"), F.when(kind == 3, 2).otherwise(1).alias("copies"), kind.alias("__kind"),
    ).where("__kind <> 0").drop("__kind")


def _content() -> Column:
    """Checksum of role and text."""
    return F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))


def find_repairs(rows: DataFrame) -> DataFrame:
    """Per conversation of rows (key, turn, role, text, copies): gaps, faults, cost and audit.

    Rows follow each other by turn (nulls first); rows of one turn by role and a checksum of the text. Equal
    rows are counted before they move, so any number of them is one row. An empty table gives none. `gaps` is
    null where it is beyond 64 bits.
    """
    role = F.substring("role", 1, 1)
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank").when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated")
    runs = (
        rows.select("key", "turn", "copies", F.col("role").alias("said_by"), F.when(role == "s", 0).when(role == "u", 1).when(role == "a", 2).otherwise(3).alias("role"), fault.alias("fault"), _content().alias("content"))
        .groupBy("key", "turn", "said_by", "role", "fault", "content").agg(F.sum("copies").alias("n"))
    )
    place = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    firsts = runs.groupBy("key", "content").agg(F.min(place).alias("at"))
    known = runs.join(firsts, ["key", "content"]).withColumn("first", F.col("at") == place)
    order = ["key", F.col("turn").asc_nulls_first(), "said_by", "content"]
    dealt = known.repartitionByRange(*order).sortWithinPartitions(*order).select("key", F.spark_partition_id().alias("part"), "role", "fault", "n", "first")
    pieces = settle(dealt.mapInArrow(_stretches, _PIECES))

    told = pieces.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("part", "first", "last", "costs"))).alias("stretches"))
    met = settle(told.mapInArrow(_meetings, "key string, cost bigint, between bigint, places array<struct<part: int, start: int, end: int, tail: string>>"))
    places = met.select("key", F.explode("places").alias("p")).select("key", "p.*")
    audits = pieces.select("key", "part", "codes").join(places, ["key", "part"]).mapInArrow(_audits, "key string, part int, piece string")
    whole = audits.groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "piece"))), lambda x: x["piece"]), "").alias("audit"))
    sums = pieces.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")])
    big = [f(F.col("turn")).cast("decimal(38,0)") for f in (F.max, F.min)]
    turns = runs.groupBy("key").agg((big[0] - big[1] + 1 - F.count_distinct("turn")).alias("gaps"))
    gaps = F.coalesce("gaps", F.lit(0).cast("decimal(38,0)")).try_cast("bigint")
    return (
        whole.join(met.select("key", "cost", "between"), "key").join(sums, "key").join(turns, "key")
        .select("key", gaps.alias("gaps"), "blank", "duplicate", "truncated", (F.col("illegal") + F.col("between")).alias("illegal"), "cost", "audit")
    )


def _streams(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Audits and then the messages of each conversation, in order; what reads them holds one row at a time."""
    said = rows.select("key", F.lit(1).alias("kind"), "turn", "role", "text", "copies", _content().alias("content"), F.lit(None).cast("string").alias("audit"))
    head = found.select("key", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).alias("copies"), F.lit(b"").alias("content"), "audit")
    return head.unionByName(said).repartition("key").sortWithinPartitions("key", "kind", F.col("turn").asc_nulls_first(), "role", "content").select("key", "role", "text", "copies", "audit")


def repair_messages(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired messages: conv_id, position, edit (K, R or I), role and text."""
    done = _streams(rows, found).mapInArrow(_messages, "key string, position bigint, edit string, role string, text string")
    return done.select(_unkey(F.col("key")).alias("conv_id"), "position", "edit", "role", "text")


def repair_digest(conversations: DataFrame) -> DataFrame:
    """Per conversation that the table has: faults after damage, cost and audit of the repair, checksum of the repaired messages.

    A conversation without rows after the damage has zeros, no audit and the checksum of nothing. The checksum
    of a conversation reads its messages in order, one at a time; by its nature it cannot be split.
    """
    rows = damage(conversations)
    found = settle(find_repairs(rows))
    sums = _streams(rows, found).mapInArrow(_digests, "key string, repaired_sha256 string")
    named = conversations.select(_key(F.col("conv_id")).alias("key")).distinct()
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    gaps = F.when(F.col("audit").isNull(), 0).otherwise(F.col("gaps")).cast("bigint").alias("gaps")
    done = named.join(found, "key", "left").join(sums, "key", "left")
    return done.select(_unkey(F.col("key")).alias("conv_id"), gaps, *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(NOTHING)).alias("repaired_sha256"))
