"""Repair of conversations against an exhaustive search over edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from gridweave.llm import conversation_repair as repair

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id bigint, turn bigint, role string, text string, part int, key string, copies int, audit string"


def damaged(rows):
    out = []
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if kind == 0:
            continue
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        out += [(c, t, "user" if kind == 4 else r, x)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0))


def faults(rows):
    seen, out = set(), []
    for _, _, r, x in rows:
        bare = x.strip(SPACE)
        out.append("blank" if not bare else "duplicate" if (r, x) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((r, x))
    return out


def cheapest(rows, found):
    """Uniform-cost search over whole edit strings; of one cost the least string comes first."""
    heap, form = [(0, "", 0, "")], re.compile("(s?(ua)+)?")
    done = set()
    while True:
        cost, audit, at, roles = heapq.heappop(heap)
        if (at, roles) in done and at < len(rows):
            continue
        done.add((at, roles))
        if at == len(rows) and form.fullmatch(roles):
            return cost, audit
        for role in "ua":
            if len(audit) < 2 * len(rows) + 4:
                heapq.heappush(heap, (cost + 5, audit + "I", at, roles + role))
        if at < len(rows):
            late = 5 * (found[at] == "truncated")
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, roles))
            if found[at] in ("", "truncated"):
                heapq.heappush(heap, (cost + late, audit + "K", at + 1, roles + (rows[at][2][:1] or "?")))
                for role in "ua":
                    heapq.heappush(heap, (cost + 1 + late, audit + "R", at + 1, roles + role))


def told(rows, audit):
    rows, out = iter(rows), []
    for edit in audit:
        after = "assistant" if out and out[-1].startswith("user") else "user"
        if edit == "I":
            out.append(after + ":")
        else:
            _, _, r, x = next(rows)
            out += [] if edit == "D" else [f"{r if edit == 'K' else after}:{x}"]
    return hashlib.sha256("\n".join(out).encode()).hexdigest()


def expected(rows):
    out = []
    for c in {r[0] for r in rows}:
        mine = damaged([r for r in rows if r[0] == c])
        found = faults(mine)
        cost, audit = cheapest(mine, found)
        turns = {r[1] for r in mine} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(mine, mine[1:], strict=False)]
        out.append([c, gaps, *[found.count(f) for f in ("blank", "duplicate", "truncated")], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, told(mine, audit)])
    return sorted(out, key=str)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", 7, "x") for r in rows], SCHEMA)


def got(df):
    return sorted(([r[c] for c in COLUMNS] for r in df.collect()), key=str)


def drawn(seed, conversations, longest):
    rng = random.Random(seed)
    rows = []
    for c in [*range(conversations), None]:
        turn = rng.randrange(-2, 3)
        for _ in range(rng.randrange(1, longest)):
            turn += rng.choice([1, 1, 1, 2, 5])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["One.", "Two?", "three", "", " \t", None, "é!\n ", ".\x85", "four\x1c", "Five. "])
            rows.append((c, turn, role, text))
    return rows


def test_repairs_equal_an_exhaustive_search(spark):
    rows = drawn(3, 60, 7)
    assert got(repair.repair_digest(frame(spark, rows))) == expected(rows)


def test_a_conversation_over_many_tasks(spark):
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice([f"Text {t}.", f"text {t}", "ok."])) for t in range(3000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        results.append(got(repair.repair_digest(frame(spark, rows))))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert results[0] == results[1]
    [[_, _, blank, duplicate, truncated, _, cost, audit, digest]] = results[0]
    mine = damaged(rows)
    found = faults(mine)
    assert [blank, duplicate, truncated] == [found.count(f) for f in ("blank", "duplicate", "truncated")]
    assert len(audit.replace("I", "")) == len(mine) and digest == told(mine, audit)
    priced = {"K": 0, "R": 1, "D": 2, "I": 5}
    at, late = 0, 0
    for edit in audit:
        if edit != "I":
            late += 5 * (edit != "D" and found[at] == "truncated")
            assert edit == "D" or found[at] in ("", "truncated")
            at += 1
    assert cost == sum(map(priced.get, audit)) + late


def test_divide_and_conquer_equals_one_pass_over_all_audits():
    rng = random.Random(9)
    for _ in range(300):
        codes = bytes(rng.randrange(12) for _ in range(rng.randrange(1, 9)))
        best = {0: (0, "")}
        for code in codes:
            nxt = {}
            for p, (cost, audit) in best.items():
                for q, step in enumerate(repair.steps(code)[p]):
                    if step:
                        found = (cost + step[0], audit + step[1])
                        nxt[q] = min(found, nxt.get(q, found))
            best = nxt
        want = min((cost + repair.ENDS[q][0], audit + repair.ENDS[q][1], q) for q, (cost, audit) in best.items())
        cuts = sorted(rng.sample(range(1, len(codes)), min(2, len(codes) - 1)))
        pieces = [codes[a:b] for a, b in zip([0, *cuts], [*cuts, len(codes)], strict=True)]
        cost, states = repair.meet([[repair.run_forward(p, piece) for p in range(4)] for piece in pieces])
        audit = "".join(repair.audit_between(piece, states[i], states[i + 1]) for i, piece in enumerate(pieces)) + repair.ENDS[states[-1]][1]
        assert (cost, audit) == want[:2]


def test_nulls_empty_tables_and_repeated_rows(spark):
    assert got(repair.repair_digest(frame(spark, []))) == []
    rows = [(None, None, None, None), (None, None, "user", "Hi."), (4, None, "user", "Hi."), (4, None, "user", "Hi."), (4, 2**62, "assistant", "Yes."), (4, -(2**62), "user", "x" * 100_000), (5, None, "assistant", "")]
    out = {r[0]: r for r in got(repair.repair_digest(frame(spark, rows)))}
    want = {r[0]: r for r in expected([r for r in rows if r[1] is None or abs(r[1]) < 2**61])}
    assert set(out) == {None, 4, 5} and out[5] == want[5] and out[None][2:4] == want[None][2:4]
    assert out[4][3] >= 1 and len(out[4][8]) == 64


def test_repaired_messages_take_turns(spark):
    rows = repair.damage(frame(spark, drawn(11, 30, 9)))
    said = repair.repair_messages(rows, repair.find_repairs(rows)).collect()
    by = {}
    for r in sorted(said, key=lambda r: r["position"]):
        by.setdefault(r["conv_id"], []).append(r["role"][:1])
    assert by and all(re.fullmatch("s?(ua)+", "".join(roles)) for roles in by.values())


@pytest.mark.parametrize("text,kept", [(" . ", True), ("a" + " " * 200_000, False)])
def test_long_white_space(spark, text, kept):
    found = repair.find_repairs(repair.damage(frame(spark, [(9, 3, "user", text)]))).first()
    assert (found["truncated"] == 0) == kept
