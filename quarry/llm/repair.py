"""Conversation structure repair: the cheapest edits that make roles alternate, by a rank-compressed dynamic program.

A layer of the program is a turn, a state the last role that was put out. A
step is a macro edit: an insertion or none, then the turn deleted, kept or
given another role. Its codes (D, IK, IR, K, R) are prefix-free, so of two
audits of equal length in turns the smaller one is told by the rank of what
stands before and the code alone: a layer keeps a rank for each state instead of
an audit, and one byte as pointer to its parent; the audit is read back at the
end. Steps are (min, +) products, so a conversation may be cut anywhere: each
piece is solved for every state it may be entered in, and pieces are joined.

Rows are dealt to tasks by ranges of (conversation, turn), so a conversation
that holds a large part of all rows is spread over tasks; faults and edits are
found on rows without texts. The texts travel once, for the last step, which
reads each conversation as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import shuffle_partitions, slices, stored

WHITE = " \t\n\x0b\x0c\r"
INSERT, DELETE, REROLE, TRUNCATED = 2, 3, 2, 1
#: States: nothing put out yet, or the initial of the last role.
START, S, U, A = range(4)
STATES = (START, S, U, A)
OTHER = 3
INITIALS = {"s": 0, "u": 1, "a": 2}
LEGAL = frozenset({(0, 1), (1, 2), (2, 1)})
#: Macro edits in the order of their codes. An insertion before a deletion is never cheapest and least (it may follow it),
#: nor are two before a turn (without them the same roles are legal).
CODES = ("D", "IK", "IR", "K", "R")
#: Insertions after the last turn that make a state final.
TAIL = {START: "", S: "II", U: "I", A: ""}
FAULTS = ("", "blank", "duplicate", "truncated")
SLICE_BYTES = 4 << 20


def _next(state: int) -> int:
    """The state after a user or an assistant is put out, whichever is legal."""
    return A if state == U else U


def _steps(initial: int, fault: int) -> list[list[tuple[int, int]]]:
    """For each target state, (parent, weight) of its macro edits; weights pack cost, rank and code (see solve)."""
    out: list[list[tuple[int, int]]] = [[] for _ in STATES]
    for p in STATES:
        out[p].append((p, _packed(DELETE, 0, p)))
        if fault in (1, 2):
            continue
        extra = TRUNCATED if fault == 3 else 0
        for inserted in (0, 1):
            q, cost = (_next(p), INSERT) if inserted else (p, 0)
            kept = {0: S if q == START else None, 1: U if q != U else None, 2: A if q == U else None}.get(initial)
            if kept is not None:
                out[kept].append((p, _packed(cost + extra, CODES.index("IK" if inserted else "K"), p)))
            out[_next(q)].append((p, _packed(cost + extra + REROLE, CODES.index("IR" if inserted else "R"), p)))
    return out


def _packed(cost: int, code: int, parent: int) -> int:
    """cost, then 2 bits for the parent's rank, 3 for the code, 2 for the parent."""
    return cost << 7 | code << 2 | parent


STEPS = {(i, f): _steps(i, f) for i in range(4) for f in range(4)}


def solve(rows: list[tuple[int, int]], entry: int = START) -> list[tuple[int, int, int, str]]:
    """(state, cost, rank, audit) of each state that rows of (initial, fault) lead to from entry, without a tail."""
    base = {entry: 0}  # state -> cost << 7 | rank << 5
    layers = bytearray()
    for row in rows:
        best = [min((base[p] + w for p, w in ways if p in base), default=-1) for ways in STEPS[row]]
        ranked = sorted((v >> 2 & 31, q) for q, v in enumerate(best) if v >= 0)
        base = {q: best[q] >> 7 << 7 | rank << 5 for rank, (_, q) in enumerate(ranked)}
        layers.extend(v & 31 if v >= 0 else 0 for v in best)
    out = []
    for q, v in base.items():
        edits, state = [], q
        for at in range(len(layers) - 4, -1, -4):
            step = layers[at + state]
            edits.append(CODES[step >> 2])
            state = step & 3
        out.append((q, v >> 7, v >> 5 & 3, "".join(reversed(edits))))
    return out


@dataclass
class Run:
    """Rows of one conversation that follow one another, and what is counted on them."""

    conv_id: object = None
    first: tuple = ()
    last_turn: int | None = None
    rows: list[tuple[int, int]] = field(default_factory=list)
    least: int | None = None
    most: int | None = None
    turns: int = 0
    counts: list[int] = field(default_factory=lambda: [0, 0, 0, 0])
    illegal: int = 0

    def add(self, turn: int | None, initial: int, fault: int, later: int, copies: int) -> None:
        if turn is not None:
            self.turns += not self.rows or turn != self.last_turn
            self.least = turn if self.least is None else self.least
            self.most = turn
        self.last_turn = turn
        for k in range(copies):
            self.illegal += bool(self.rows) and (self.rows[-1][0], initial) not in LEGAL
            self.rows.append((initial, fault if k == 0 else later))
            self.counts[fault if k == 0 else later] += 1

    def facts(self) -> dict:
        turn, role, digest = self.first
        return {
            "conv_id": self.conv_id, "turn": turn, "role": role, "digest": digest, "least": self.least, "most": self.most, "turns": self.turns, "blank": self.counts[1],
            "duplicate": self.counts[2], "truncated": self.counts[3], "illegal": self.illegal, "last_turn": self.last_turn, "opens": self.rows[0][0], "ends": self.rows[-1][0],
        }


_FACTS = "turn long, role string, digest string, least long, most long, turns long, blank long, duplicate long, truncated long, illegal long, last_turn long, opens int, ends int"
_SOLVED = "piece long, whole boolean, entry int, state int, cost long, rank int, audit string"


def _arrow(schema: str, conv: pa.DataType) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([("conv_id", conv), *((n, kinds[k]) for n, k in (c.split() for c in schema.split(", ")))])


def _lean(rows: DataFrame) -> DataFrame:
    """Equal rows as one with their number, without texts: the initial's number, blank and truncated texts."""
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    initial = F.coalesce(*[F.when(F.substring("role", 1, 1) == k, v) for k, v in INITIALS.items()], F.lit(OTHER))
    truncated = ~F.substring(bare, -1, 1).isin(".", "!", "?")
    return rows.select("conv_id", "turn", "role", F.md5("text").alias("digest"), initial.alias("initial"), (bare == "").alias("blank"), truncated.alias("truncated")).groupBy(
        "conv_id", "turn", "role", "digest", "initial", "blank", "truncated"
    ).agg(F.count(F.lit(1)).alias("copies"))


def _rows(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text; a null role or text is one space."""
    space = F.lit(" ")
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), space).alias(c) for c in ("role", "text")])


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest (of the text), initial, copies, fault of the first of equal rows and of the later ones.

    A fault is a place in FAULTS: blank, else duplicate (role and text stand in
    an earlier row), else truncated, else none.
    """
    lean = stored(_lean(rows), "turns")
    key = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    again = lean.groupBy("conv_id", "role", "digest").agg(F.min(key).alias("begun"), F.count(F.lit(1)).alias("n")).where("n > 1").select(*[F.col(c).alias(f"_{c}") for c in ("conv_id", "role", "digest", "begun")])
    same = F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("digest") == F.col("_digest")) & (F.col("role") == F.col("_role"))
    repeats = F.col("_begun").isNotNull() & ~key.eqNullSafe(F.col("_begun"))
    fault = F.when(F.col("blank"), 1).when(repeats, 2).when(F.col("truncated"), 3).otherwise(0)
    return lean.join(again, same, "left").select("conv_id", "turn", "role", "digest", "initial", "copies", fault.alias("fault"), F.when(F.col("blank"), 1).otherwise(2).alias("later"))


def _pieces(found: DataFrame, n: int) -> DataFrame:
    """Solved runs of rows dealt by ranges: a conversation inside a range as a whole, those at its ends for every entry."""
    order = ("conv_id", "turn", "role", "digest")
    kind = found.schema["conv_id"].dataType

    def solved(run: Run, piece: int | None) -> list[dict]:
        facts = run.facts()
        if piece is None:
            state, cost, rank, audit = min(solve(run.rows), key=lambda x: (x[1] + INSERT * len(TAIL[x[0]]), x[2]))
            return [facts | {"piece": -1, "whole": True, "entry": START, "state": state, "cost": cost + INSERT * len(TAIL[state]), "rank": rank, "audit": audit + TAIL[state]}]
        return [facts | {"piece": piece, "whole": False, "entry": e, "state": q, "cost": c, "rank": r, "audit": a} for e in STATES for q, c, r, a in solve(run.rows, e)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, now, out = TaskContext.get().partitionId(), 0, None, []
        arrow = None
        for batch in batches:
            arrow = arrow or _arrow(f"{_FACTS}, {_SOLVED}", batch.schema.field("conv_id").type)
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "digest", "initial", "fault", "later", "copies")]
            for conv, turn, role, digest, initial, fault, later, copies in zip(*columns, strict=True):
                if now is None or conv != now.conv_id:
                    if now is not None:
                        out += solved(now, None if at else 2 * part)
                        at += 1
                    now = Run(conv, (turn, role, digest))
                now.add(turn, initial, fault, later, copies)
            if len(out) > 500:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        if now is not None:
            yield pa.RecordBatch.from_pylist(out + solved(now, 2 * part + (at > 0)), schema=arrow)

    dealt = found.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return dealt.mapInArrow(run, f"conv_id {kind.simpleString()}, {_FACTS}, {_SOLVED}")


def join_pieces(pieces: list[tuple[dict, dict[int, list[tuple[int, int, int]]]]]) -> tuple[dict, list[tuple[int, int]]]:
    """Facts of a conversation and (entry, state) of each piece, from pieces in order: facts, and by entry (state, cost, rank)."""
    facts = dict(pieces[0][0])
    for f, _ in pieces[1:]:
        facts["turns"] += f["turns"] - (f["turn"] is not None and f["turn"] == facts["last_turn"])
        facts["illegal"] += f["illegal"] + ((facts["ends"], f["opens"]) not in LEGAL)
        for k in ("blank", "duplicate", "truncated"):
            facts[k] += f[k]
        facts["least"] = f["least"] if facts["least"] is None else facts["least"]
        facts["most"] = facts["most"] if f["most"] is None else f["most"]
        facts["last_turn"], facts["ends"] = f["last_turn"], f["ends"]
    now, back = {START: (0, 0)}, []
    for _, ways in pieces:
        best: dict[int, tuple] = {}
        for p, (cost, rank) in now.items():
            for q, c, r in ways[p]:
                way = (cost + c, rank, r, p)
                best[q] = min(best.get(q, way), way)
        ranked = sorted((w[1], w[2], q) for q, w in best.items())
        now = {q: (best[q][0], i) for i, (_, _, q) in enumerate(ranked)}
        back.append({q: w[3] for q, w in best.items()})
    state = min(now, key=lambda q: (now[q][0] + INSERT * len(TAIL[q]), now[q][1]))
    facts["cost"] = now[state][0] + INSERT * len(TAIL[state])
    path = []
    for parents in reversed(back):
        path.append((parents[state], state))
        state = parents[state]
    return facts, path[::-1]


def _joined(pieces: DataFrame) -> DataFrame:
    """piece, entry, state, tail and the conversation's facts on its first piece. A group has some rows for each range."""
    kind = pieces.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", *(c.split()[0] for c in _FACTS.split(", "))]

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        plain = group.astype(object).where(group.notna(), None)
        parts: list[tuple[dict, dict[int, list]]] = []
        ids = []
        for piece, rows in plain.sort_values("piece").groupby("piece", sort=True):
            ways: dict[int, list] = {e: [] for e in STATES}
            for r in rows.itertuples():
                ways[r.entry].append((r.state, r.cost, r.rank))
            parts.append(({n: rows.iloc[0][n] for n in names}, ways))
            ids.append(piece)
        facts, path = join_pieces(parts)
        out = [{**({} if i else facts), "_piece": p, "_entry": e, "_state": q, "tail": TAIL[q] if i == len(ids) - 1 else "", "leads": i == 0} for i, (p, (e, q)) in enumerate(zip(ids, path, strict=True))]
        frame = pd.DataFrame(out, columns=["_piece", "_entry", "_state", "tail", "leads", *_TOTALS])
        return frame.astype({c: "Int64" for c in _TOTALS})

    schema = "_piece long, _entry int, _state int, tail string, leads boolean, " + ", ".join(f"{c} long" for c in _TOTALS)
    light = pieces.select(F.col("conv_id").cast(kind), *names[1:], "piece", "entry", "state", "cost", "rank")
    return light.groupBy("conv_id").applyInPandas(fold, schema)


_TOTALS = ("least", "most", "turns", "blank", "duplicate", "truncated", "illegal", "cost")


def plans(rows: DataFrame) -> DataFrame:
    """Edits of each run of rows: conv_id, turn, role and digest of its first row, audit, leads, and _TOTALS where it leads its conversation."""
    solved = stored(_pieces(stored(faults(rows), "faults"), shuffle_partitions(rows.sparkSession)), "pieces")
    key = ("conv_id", "turn", "role", "digest")
    whole = solved.where("whole").select(*key, "audit", F.lit(True).alias("leads"), *_TOTALS)
    parts = solved.where("NOT whole")
    # At most two pieces for each range of rows.
    chosen = F.broadcast(_joined(parts))
    picked = parts.drop(*_TOTALS).join(chosen, (F.col("piece") == F.col("_piece")) & (F.col("entry") == F.col("_entry")) & (F.col("state") == F.col("_state")))
    return whole.unionByName(picked.select(*key, F.concat("audit", "tail").alias("audit"), "leads", *_TOTALS))


_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_ZERO = {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": ""}


class _Editor:
    """Applies the audits of one conversation's runs to its rows, one after the other."""

    def __init__(self) -> None:
        self.edits: Iterator[str] = iter("")
        self.last = ""

    def _put(self) -> str:
        self.last = "a" if self.last == "u" else "u"
        return "assistant" if self.last == "a" else "user"

    def row(self, role: str, text: str) -> list[tuple[str, str, str]]:
        out = []
        for edit in self.edits:
            if edit == "I":
                out.append(("I", self._put(), ""))
                continue
            if edit == "K":
                self.last = role[:1]
                out.append(("K", role, text))
            elif edit == "R":
                out.append(("R", self._put(), text))
            return out
        raise ValueError("a conversation has more rows than edits")

    def end(self) -> list[tuple[str, str, str]]:
        return [("I", self._put(), "") for _ in self.edits]


def repair(conversations: DataFrame) -> DataFrame:
    """The repaired turns of each conversation, behind a row that reports on it.

    Turn rows: conv_id, position (from 0), edit (I, K or R), role, text; the
    report's columns are null. Report rows: conv_id, position null, gaps, blank,
    duplicate, truncated, illegal, cost, audit. A conversation's rows stand in
    one partition, the report first, then turns in order.

    Roles must read s?(ua)+ by initials, or nothing; edits are the cheapest
    (keep 0, insert an empty user or assistant 2, change a role to user or
    assistant 2, delete 3, and 1 for a truncated row that stays; blank and
    duplicate rows are deleted) and of those the least audit. Rows are taken by
    turn, nulls first, then by role and the digest of the text, so repeated
    rows follow one another and all but the first are duplicates. A null role
    or text is one space; a role whose initial is not s, u or a can't be kept.
    A null conv_id is a conversation of its own. Other columns are dropped; an
    empty table gives no rows. Audits must fit a row: a byte for each turn.
    """
    rows = _rows(conversations)
    kind = rows.schema["conv_id"].dataType.simpleString()
    nothing = {c: F.lit(None).cast("long") for c in _TOTALS}
    edits = stored(plans(rows), "edits").select("conv_id", "turn", "role", "digest", F.lit(1).alias("kind"), F.col("audit").alias("text"), "leads", *_TOTALS)
    turns = rows.select("conv_id", "turn", "role", F.md5("text").alias("digest"), F.lit(2).alias("kind"), "text", F.lit(False).alias("leads"), *[v.alias(k) for k, v in nothing.items()])
    order = ("conv_id", "turn", "role", "digest", "kind")
    n = shuffle_partitions(rows.sparkSession)
    dealt = edits.unionByName(turns).repartition(n, "conv_id").sortWithinPartitions(*order)
    schema = f"conv_id {kind}, position long, edit string, role string, text string, {_REPORT}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        conv, editor, at, arrow = None, None, 0, None

        def turn(found: list[tuple[str, str, str]]) -> None:
            nonlocal at
            for edit, role, text in found:
                out.append({"conv_id": conv, "position": at, "edit": edit, "role": role, "text": text})
                at += 1

        for whole in batches:
            arrow = arrow or _arrow(f"position long, edit string, role string, text string, {_REPORT}", whole.schema.field("conv_id").type)
            for part in slices(whole, "text", SLICE_BYTES):
                for r in part.to_pylist():
                    if r["kind"] == 2:
                        turn(editor.row(r["role"], r["text"]))
                        continue
                    if r["leads"]:
                        if editor:
                            turn(editor.end())
                        conv, editor, at = r["conv_id"], _Editor(), 0
                        gaps = 0 if r["least"] is None else r["most"] - r["least"] + 1 - r["turns"]
                        out.append({"conv_id": conv, "gaps": gaps, "audit": None} | {k: r[k] for k in ("blank", "duplicate", "truncated", "illegal", "cost")})
                    editor.edits = iter(r["text"])
                    out.append({"conv_id": conv, "audit": r["text"]})
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out.clear()
        if editor:
            turn(editor.end())
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return dealt.mapInArrow(run, schema)


def repaired_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, position, edit, role and text of the repaired conversations; see repair."""
    return repair(conversations).where("position IS NOT NULL").select("conv_id", "position", "edit", "role", "text")


def repair_digest(conversations: DataFrame) -> DataFrame:
    """The report of each conversation and repaired_sha256 of its role:text lines, read from the repaired turns as a stream."""
    rows = repair(conversations)
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        report, audit, digest, arrow = None, [], None, None
        for batch in batches:
            out = []
            arrow = arrow or _arrow(f"{_REPORT}, repaired_sha256 string", batch.schema.field("conv_id").type)
            for r in batch.to_pylist():
                if r["position"] is not None:
                    digest.update((("\n" if r["position"] else "") + r["role"] + ":" + r["text"]).encode())
                elif r["audit"] is not None:
                    audit.append(r["audit"])
                else:
                    if report:
                        out.append(report | {"audit": "".join(audit), "repaired_sha256": digest.hexdigest()})
                    report, audit, digest = {k: r[k] for k in ("conv_id", *_ZERO)}, [], hashlib.sha256()
            yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if report:
            yield pa.RecordBatch.from_pylist([report | {"audit": "".join(audit), "repaired_sha256": digest.hexdigest()}], schema=arrow)

    return rows.mapInArrow(run, f"conv_id {kind}, {_REPORT}, repaired_sha256 string")


def with_untouched(report: DataFrame, conv_ids: DataFrame) -> DataFrame:
    """report, and zeros with the digest of nothing for each of conv_ids that it lacks (all its rows were gone)."""
    known = report.withColumn("known", F.lit(True)).unionByName(
        conv_ids.select("conv_id").distinct().select("conv_id", *[F.lit(v).cast("string" if v == "" else "long").alias(k) for k, v in _ZERO.items()], F.lit(hashlib.sha256(b"").hexdigest()).alias("repaired_sha256"), F.lit(False).alias("known"))
    )
    columns = [c for c in report.columns if c != "conv_id"]
    return known.groupBy("conv_id").agg(F.max(F.struct("known", *columns)).alias("r")).select("conv_id", *[F.col(f"r.{c}").alias(c) for c in columns])


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with faults drawn by crc32 of conv_id:turn (nulls: one space) modulo 20.

    0 drops the row, 1 empties its text, 2 removes its end marks, 3 repeats it
    with the same turn, 4 makes its role user. Null roles and texts are one space.
    """
    rows = _rows(conversations)
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw: Column = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("draw") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("draw", draw).where("draw <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")
