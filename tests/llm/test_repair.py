"""Conversation repair against a program over whole audits, cut conversations, odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from quarry.llm import repair

NUMBER = {"s": 0, "u": 1, "a": 2, "t": 3}
BEGINS, WHOLE = re.compile(r"s?(ua)*u?\Z"), re.compile(r"(s?(ua)+)?\Z")


def least(rows):
    """(cost, audit) of rows of (initial, fault): all ways with up to three insertions anywhere, by the roles they give."""

    def inserted(now):
        out, edge = dict(now), dict(now)
        for _ in range(3):
            new = {}
            for roles, (cost, audit) in edge.items():
                for r in "ua":
                    if BEGINS.match(roles + r):
                        new[roles + r] = min(new.get(roles + r, (99, "")), (cost + 2, audit + "I"))
            for roles, way in new.items():
                out[roles] = min(out.get(roles, way), way)
            edge = new
        return out

    now = {"": (0, "")}
    for initial, fault in rows:
        new = {}
        for roles, (cost, audit) in inserted(now).items():
            ways = [(roles, 3, "D")]
            if fault not in (1, 2):
                extra = int(fault == 3)
                ways += [(roles + initial, extra, "K")] + [(roles + r, 2 + extra, "R") for r in "ua"]
            for to, c, e in ways:
                if BEGINS.match(to):
                    way = (cost + c, audit + e)
                    new[to] = min(new.get(to, way), way)
        now = new
    return min(way for roles, way in inserted(now).items() if WHOLE.match(roles))


def drawn(rng):
    letters = rng.choice(["suat", "ua", "ssu", "a", "t"])
    return [(rng.choice(letters), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(1, 7))]


def finished(ways):
    return min((c + 2 * len(repair.TAIL[q]), r, a + repair.TAIL[q]) for q, c, r, a in ways)


def test_least_audit_of_all():
    rng = random.Random(1)
    for _ in range(600):
        rows = drawn(rng)
        cost, _, audit = finished(repair.solve([(NUMBER[i], f) for i, f in rows]))
        assert (cost, audit) == least(rows)


def test_pieces_join_to_the_whole():
    rng = random.Random(2)
    nothing = {k: None for k in ("turn", "last_turn", "least", "most")} | {k: 0 for k in ("turns", "blank", "duplicate", "truncated", "illegal", "opens", "ends")}
    for _ in range(400):
        rows = [(NUMBER[i], f) for i, f in drawn(rng) + drawn(rng)]
        cuts = sorted(rng.sample(range(1, len(rows)), min(len(rows) - 1, rng.randint(0, 4))))
        pieces = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
        solved = [{e: repair.solve(p, e) for e in repair.STATES} for p in pieces]
        facts, path = repair.join_pieces([(nothing, {e: [w[:3] for w in ws] for e, ws in s.items()}) for s in solved])
        audit = "".join(next(w[3] for w in s[e] if w[0] == q) for s, (e, q) in zip(solved, path, strict=True)) + repair.TAIL[path[-1][1]]
        cost, _, want = finished(repair.solve(rows))
        assert (facts["cost"], audit) == (cost, want)


def plain_report(rows):
    """The report of one conversation's (turn, role, text) by the definitions."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    seen, coded, counts = set(), [], [0, 0, 0, 0]
    for _, role, text in rows:
        bare = text.rstrip(repair.WHITE)
        fault = 1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0
        seen.add((role, text))
        counts[fault] += 1
        coded.append((role[:1] if role[:1] in ("s", "u", "a") else "t", fault))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(x[0] + y[0] not in ("su", "ua", "au") for x, y in zip(coded, coded[1:], strict=False))
    cost, audit = least(coded)
    left, out, last = iter(rows), [], ""
    for e in audit:
        _, role, text = next(left) if e != "I" else (None, None, "")
        if e in "IR":
            role = "assistant" if last == "u" else "user"
        if e != "D":
            out.append(f"{role}:{text}")
            last = role[0]
    return (gaps, *counts[1:], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
SCHEMA = "conv_id long, turn long, role string, text string, draw int, piece string"


def talks(rng):
    texts = ["Yes.", "No!", "why", "", " \t\n", "Sure?  ", "a\nb.", "é. ", "x" * 3_000 + "."]
    rows = []
    for conv in [*range(40), None]:
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, rng.choice([turn, turn, turn * 2, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice([*texts, None])))
    return rows + [(41, None, "user", "Hi.")] * 3 + [(42, 1, "system", "Alone.")]


def expected(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    return {conv: plain_report(r) for conv, r in by.items()}


@pytest.mark.parametrize("partitions", [1, 40])
def test_reports_of_odd_rows(spark, partitions):
    rows = talks(random.Random(3))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)  # 40: most conversations lie across ranges
    try:
        got = repair.repair_digest(spark.createDataFrame([(*r, 0, "p") for r in rows], SCHEMA)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in got} == expected(rows)
    assert len(got) == len({r[0] for r in rows})


def test_damage_and_conversations_without_rows(spark):
    rows = [(c, t, ["user", "assistant"][t % 2], f"Turn {t}. No. {c}") for c in range(60) for t in range(3)] + [(99, None, None, None), (None, 7, "user", "Who?")]
    left = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if draw == 1:
            text = ""
        elif draw == 2:
            text = re.sub("[.!?]", "", text)
        elif draw == 4:
            role = "user"
        left += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(draw, 1)
    df = spark.createDataFrame([(*r, 0, "p") for r in rows + [(77, 0, "user", "Gone.")]], SCHEMA)
    got = repair.with_untouched(repair.repair_digest(repair.damage(df.where("conv_id IS DISTINCT FROM 77"))), df).collect()
    want = {r[0]: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in [*rows, (77,)]} | expected(left)
    assert {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in got} == want
    assert len(got) == len(want)


def test_repaired_turns_and_nothing(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "Hello."), (1, 1, "tool", "data."), (1, 2, "assistant", "Bye.")], "conv_id long, turn long, role string, text string")
    got = [(r["position"], r["edit"], r["role"], r["text"]) for r in repair.repaired_turns(df).orderBy("position").collect()]
    assert got == [(0, "I", "user", ""), (1, "K", "assistant", "Hello."), (2, "R", "user", "data."), (3, "K", "assistant", "Bye.")]
    assert repair.repair_digest(df.limit(0)).count() == 0
    assert repair.with_untouched(repair.repair_digest(repair.damage(df.limit(0))), df.limit(0)).count() == 0
