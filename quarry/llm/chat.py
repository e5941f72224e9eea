"""Chat formatting: field-path fingerprints select declarative mappings to canonical turns.

A record's layout is recognised by the nested field paths it carries, a
table's by those of its schema. The present paths of a declared vocabulary are
sorted and hashed; the fingerprint picks a mapping that says where roles and
texts lie. Canonical turns are then
rendered with control markers; any marker or escape character inside a text is
escaped, so the rendered string can be read back exactly. All of it is
DataFrame expressions.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
TURNS = "array<struct<role: string, text: string>>"


@dataclass(frozen=True)
class Turns:
    """An array of turns: its path, the fields of role and text, and other names of roles."""

    array: str
    role: str
    text: str
    roles: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Rows:
    """A row for each turn: the fields of conversation, order, role and text, and other names of roles."""

    conversation: str
    order: str
    role: str
    text: str
    roles: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Layout:
    """Paths that a record must carry, and turns by (role, path of text), by an array or by rows. optional paths may be missing."""

    name: str
    turns: tuple[tuple[str, str], ...] | Turns | Rows
    optional: tuple[str, ...] = ()

    @property
    def paths(self) -> tuple[str, ...]:
        if isinstance(self.turns, Rows):
            return (self.turns.conversation, self.turns.order, self.turns.role, self.turns.text)
        if isinstance(self.turns, Turns):
            return (f"{self.turns.array}[].{self.turns.role}", f"{self.turns.array}[].{self.turns.text}")
        return tuple(p for _, p in self.turns)


LAYOUTS = (
    Layout("messages", Turns("messages", "role", "content")),
    Layout("conversations", Turns("conversations", "from", "value", {"human": "user", "gpt": "assistant"})),
    Layout("dialogue", Turns("dialogue", "speaker", "utterance", {"customer": "user", "agent": "assistant"})),
    Layout("instruction", (("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")), ("system", "input")),
    Layout("prompt", (("system", "system"), ("user", "prompt"), ("assistant", "completion")), ("system",)),
    Layout("question", (("system", "context"), ("user", "question"), ("assistant", "answer")), ("context",)),
    Layout("rows", Rows("conv_id", "turn", "role", "text")),
    Layout("posts", Rows("thread_id", "position", "from", "value", {"human": "user", "gpt": "assistant"})),
    Layout("utterances", Rows("dialogue_id", "index", "speaker", "utterance", {"customer": "user", "agent": "assistant"})),
)


def path_fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


def fingerprints(layouts=LAYOUTS) -> dict[str, Layout]:
    """Layout by fingerprint, for every choice of its optional paths."""
    out = {}
    for layout in layouts:
        need = [p for p in layout.paths if p not in layout.optional]
        for bits in range(1 << len(layout.optional)):
            out[path_fingerprint(need + [p for i, p in enumerate(layout.optional) if bits >> i & 1])] = layout
    return out


def schema_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Leaf paths of a schema: names joined by dots, [] for the elements of an array."""
    if isinstance(schema, T.StructType):
        return [p for f in schema for p in schema_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(schema, T.ArrayType):
        return schema_paths(schema.elementType, prefix + "[]")
    return [prefix]


def _at(record: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(record, "$." + path, kind)


def _present(record: Column, path: str) -> Column:
    array, inner, leaf = path.partition("[].")
    if not inner:
        return _at(record, path, "string").isNotNull()
    return F.exists(_elements(record, array), lambda e: _at(e, leaf, "string").isNotNull())


def _elements(record: Column, array: str) -> Column:
    return F.coalesce(_at(record, array, "array<variant>"), F.array().cast("array<variant>"))


def _turns(record: Column, layout: Layout) -> Column:
    if isinstance(layout.turns, Turns):
        t = layout.turns

        def turn(e: Column) -> Column:
            role = F.coalesce(_at(e, t.role, "string"), F.lit(""))
            named = role
            for old, new in t.roles.items():
                named = F.when(role == old, F.lit(new)).otherwise(named)
            return F.struct(named.alias("role"), F.coalesce(_at(e, t.text, "string"), F.lit("")).alias("text"))

        return F.transform(_elements(record, t.array), turn).cast(TURNS)
    each = [F.when(_present(record, p), F.struct(F.lit(role).alias("role"), _at(record, p, "string").alias("text"))) for role, p in layout.turns]
    return F.array_compact(F.array(*each)).cast(TURNS)


def turns_of_records(df: DataFrame, record: str = "record", layouts=LAYOUTS) -> DataFrame:
    """Adds fingerprint, layout and turns to JSON records of mixed layouts.

    A record that is null, not JSON or of no known layout keeps its row, with a
    null layout and turns null. Absent or null texts and roles are empty.
    Fields outside the vocabulary don't matter.
    """
    layouts = [x for x in layouts if not isinstance(x.turns, Rows)]
    known = sorted({p for x in layouts for p in x.paths})
    v = F.try_parse_json(F.col(record))
    paths = F.array_compact(F.array(*[F.when(_present(v, p), F.lit(p)) for p in known]))
    mark = F.sha2(F.array_join(paths, "\n"), 256)
    table = fingerprints(layouts)
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for layout in layouts:
        mine = F.col("fingerprint").isin([k for k, x in table.items() if x == layout])
        name = F.when(mine, F.lit(layout.name)).otherwise(name)
        turns = F.when(mine, _turns(v, layout)).otherwise(turns)
    return df.withColumn("fingerprint", mark).withColumn("layout", name).withColumn("turns", turns)


def row_layout(schema: T.StructType, layouts=LAYOUTS) -> Layout:
    """The layout of a table with a row for each turn, by the fingerprint of those of its fields that row layouts know."""
    of_rows = [x for x in layouts if isinstance(x.turns, Rows)]
    known = {p for x in of_rows for p in x.paths}
    mark = path_fingerprint([p for p in schema_paths(schema) if p in known])
    found = fingerprints(of_rows).get(mark)
    if found is None:
        raise ValueError(f"no layout of rows has the fingerprint {mark} of the fields {sorted(known & set(schema_paths(schema)))}")
    return found


def turns_of_rows(rows: DataFrame, layouts=LAYOUTS) -> DataFrame:
    """conv_id and turns of a table with a row for each turn; the fingerprint of its fields picks the mapping that is read.

    Turns are in the mapping's order, then role and text where turns tie;
    repeated rows are turns of their own. Null roles and texts are empty. Other
    columns are ignored; a table of no known layout is refused. One
    conversation is one output string, so it must fit a row.
    """
    m = row_layout(rows.schema, layouts).turns
    role = F.coalesce(F.col(m.role).cast("string"), F.lit(""))
    named = role
    for old, new in m.roles.items():
        named = F.when(role == old, F.lit(new)).otherwise(named)
    canonical = rows.select(F.col(m.conversation).alias("conv_id"), F.col(m.order).alias("turn"), named.alias("role"), F.coalesce(F.col(m.text).cast("string"), F.lit("")).alias("text"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    grouped = canonical.groupBy("conv_id").agg(ordered.alias("turns"))
    return grouped.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))


def escape(text: Column) -> Column:
    """No control marker can begin inside: backslashes are doubled, then <| becomes <\\|."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render(df: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Adds formatted and loss_spans ([start, end) in code points: texts of the learnt roles) to turns.

    No turns give an empty string without spans; null turns give nulls. Equal
    rows are rendered alike; texts may be empty or of any length that a row holds.
    """
    pieces = F.transform("turns", lambda t: F.concat(F.lit(START), escape(t["role"]), F.lit(SEP), escape(t["text"]), F.lit(END)))
    # Lengths of a turn: what comes before its text, its text; the end marker follows.
    sizes = F.transform(
        "turns",
        lambda t: F.struct(
            (F.length(escape(t["role"])) + len(START) + len(SEP)).alias("head"), F.length(escape(t["text"])).alias("body"), t["role"].isin(*learn).alias("learn")
        ),
    )
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["head"]
        span = F.struct(begin.alias("start"), (begin + x["body"]).alias("end"))
        return F.struct(
            (begin + x["body"] + len(END)).alias("at"), F.when(x["learn"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans")
        )

    return df.withColumn("formatted", F.array_join(pieces, "")).withColumn("loss_spans", F.aggregate(sizes, zero, step, lambda a: a["spans"]))


def read_back(df: DataFrame) -> DataFrame:
    """Adds turns and loss_text read from formatted and loss_spans alone: exactly what was rendered; nulls stay null."""
    parts = F.filter(F.split("formatted", r"<\|im_start\|>"), lambda p, i: i > 0)
    turn = F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.substring_index(p, SEP, 1)).alias("role"),
            unescape(F.substring_index(F.substring_index(p, SEP, -1), END, 1)).alias("text"),
        ),
    )
    loss = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return df.withColumn("turns", turn).withColumn("loss_text", F.array_join(loss, ""))


def chat_digest(formatted: DataFrame) -> DataFrame:
    """Counts and digests of what formatted and loss_spans hold, a row for each that comes in; an empty string has no turns."""
    back = read_back(formatted.select("conv_id", "formatted", "loss_spans"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
