"""Chat formatting by schema fingerprints.

DataFrame functions only. A record is JSON text in any known layout, or a struct column in one. Its nested
field paths, without the types of their values, are hashed; the hash selects a declarative
mapping from the layout to canonical turns, an array of (role, text). The paths of a JSON text are found
row by row; those of a struct column are its schema's, found once, so no text passes through JSON.
Turns are rendered with a template whose control strings are escaped inside texts, and are read back exactly.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import chain, combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """A layout: its field paths, one text for each set of optional fields, in the notation of
    paths(); the schema to read a record r with; and SQL over r for the canonical turns."""

    name: str
    paths: tuple[str, ...]
    schema: str
    turns: str


def _objects(required: list[str], optional: list[str]) -> tuple[str, ...]:
    some = chain.from_iterable(combinations(optional, k) for k in range(len(optional) + 1))
    return tuple("OBJECT<" + ", ".join(sorted([*required, *x])) + ">" for x in some)


_SYSTEM = "if(r.system is null, array(), array(named_struct('role', 'system', 'text', r.system)))"
# Names that speakers have in layouts with `from`, `speaker` or free roles.
_SPEAKERS = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def _list(key: str, role: str, text: str, speakers: dict[str, str] | None = None) -> Mapping:
    """A list of messages under `key`."""
    said = f"coalesce(x.`{role}`, '')"
    for a, b in (speakers or {}).items():
        said = f"if(x.`{role}` = '{a}', '{b}', {said})"
    arrays = [f"{key}: ARRAY<OBJECT<{', '.join(sorted(f))}>>" for f in ([role, text], [role], [text])]
    return Mapping(
        f"{key}({role},{text})",
        tuple(p for a in [*arrays, f"{key}: ARRAY"] for p in _objects([a], ["id", "system"])),
        f"`{key}` array<struct<`{role}`:string,`{text}`:string>>, system string",
        f"concat({_SYSTEM}, transform(r.`{key}`, x -> named_struct('role', {said}, 'text', coalesce(x.`{text}`, ''))))",
    )


def _pair(prompt: str, answer: str, more: str | None = None) -> Mapping:
    """A prompt and an answer, and perhaps more to the prompt."""
    asked = f"coalesce(r.`{prompt}`, '')"
    if more:
        asked = f"concat({asked}, if(coalesce(r.`{more}`, '') = '', '', concat('\\n\\n', r.`{more}`)))"
    names = [prompt, answer, *([more] if more else [])]
    return Mapping(
        f"({','.join(names)})",
        _objects([prompt, answer], ["id", "system", *([more] if more else [])]),
        ", ".join(f"`{x}` string" for x in [*names, "system"]),
        f"concat({_SYSTEM}, array(named_struct('role', 'user', 'text', {asked}), "
        f"named_struct('role', 'assistant', 'text', coalesce(r.`{answer}`, ''))))",
    )


MAPPINGS = (
    _list("messages", "role", "content"),
    _list("conversations", "from", "value", _SPEAKERS),
    _list("conversation", "role", "content", _SPEAKERS),
    _list("dialog", "speaker", "text", _SPEAKERS),
    _pair("instruction", "output", "input"),
    _pair("prompt", "completion"),
    _pair("prompt", "response"),
    _pair("question", "answer", "context"),
)


def fingerprint_of(paths: str) -> str:
    return hashlib.sha256(paths.encode()).hexdigest()[:16]


def paths(record: Column) -> Column:
    """A record's nested field paths: the schema of its variant without the types of scalars."""
    schema = F.schema_of_variant(F.try_parse_json(record))
    schema = F.regexp_replace(schema, r": (?:[A-Z]+|DECIMAL\(\d+,\d+\))(?=[,>])", "")
    return F.regexp_replace(schema, r"ARRAY<[A-Z]+>", "ARRAY")


def paths_of(kind: DataType) -> str:
    """The nested field paths of a column type, in the notation of paths()."""
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        inner = [f.name if not isinstance(f.dataType, StructType | ArrayType) else f"{f.name}: {paths_of(f.dataType)}" for f in fields]
        return f"OBJECT<{', '.join(inner)}>"
    if isinstance(kind, ArrayType):
        inner = paths_of(kind.elementType)
        return f"ARRAY<{inner}>" if inner else "ARRAY"
    return ""


def _shaped(x: Column, has: DataType, wanted: DataType) -> Column:
    """x with the fields of another type, by name; null for those it lacks."""
    if isinstance(wanted, StructType):
        own = {f.name: f.dataType for f in has.fields}
        fields = [(_shaped(x.getField(f.name), own[f.name], f.dataType) if f.name in own else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted.fields]
        return F.when(x.isNotNull(), F.struct(*fields))
    if isinstance(wanted, ArrayType):
        return F.transform(x, lambda e: _shaped(e, has.elementType, wanted.elementType))
    return x.cast(wanted)


def to_turns(records: DataFrame) -> DataFrame:
    """Replaces `record` (JSON text or a struct) by fingerprint, layout and turns; other columns stay.

    Null, malformed and unknown records have a null layout and null turns. JSON text is read by
    Spark's variant, so a JSON record of more than 128 MiB, or with a text of more than 20,000,000 characters, counts as
    malformed; a struct column has no such limits.
    """
    kept = [c for c in records.columns if c.lower() not in ("record", "fingerprint", "layout", "turns")]
    kind = records.schema["record"].dataType
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    if isinstance(kind, StructType):
        mark, there = fingerprint_of(paths_of(kind)), F.col("record").isNotNull()
        known = [m for m in MAPPINGS if mark in map(fingerprint_of, m.paths)]
        own = F.struct(*(F.col(f"`{c}`") for c in kept)).alias("own") if kept else F.lit(None).alias("own")
        read = F.lit(None)
        for m in known:
            schema = StructType.fromDDL(m.schema)
            read = F.array(_shaped(F.col("record"), kind, schema))
            layout, turns = F.when(F.col("there"), m.name), F.when(F.col("there"), F.expr(f"transform(rs, r -> {m.turns})[0]").cast(TURNS))
        cut = records.select(own, there.alias("there"), read.alias("rs"))
        return cut.select(*(["own.*"] if kept else []), F.when(F.col("there"), mark).alias("fingerprint"), layout.alias("layout"), turns.alias("turns"))
    marked = records.withColumn("fingerprint", F.substring(F.sha2(paths(F.col("record")), 256), 1, 16))
    for m in MAPPINGS:
        known = F.col("fingerprint").isin([fingerprint_of(p) for p in m.paths])
        schema = m.schema.replace("'", "\\'")
        read = F.expr(f"transform(array(from_json(record, '{schema}')), r -> {m.turns})[0]").cast(TURNS)
        layout, turns = F.when(known, m.name).otherwise(layout), F.when(known, read).otherwise(turns)
    return marked.select(*kept, "fingerprint", layout.alias("layout"), turns.alias("turns"))


def records_of_rows(rows: DataFrame) -> DataFrame:
    """conv_id, record: rows of (conv_id, turn, role, text), one turn each, as a list of messages.

    Turns are in order of turn (null first), then role, then text; null roles and texts
    are empty. Null conv_ids are one conversation; repeated rows are turns said twice. A conversation is one
    row here and in the output: its formatted text can't be larger than a Spark string, and must fit in a task.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    said = F.transform(F.sort_array(F.collect_list("x")), lambda x: F.struct(x["content"].alias("content"), x["role"].alias("role")))
    return rows.select("conv_id", turn.alias("x")).groupBy("conv_id").agg(F.struct(said.alias("messages")).alias("record"))


# --- template --------------------------------------------------------------------

#: Control strings of the template. Inside texts each is broken by a backslash after its first character.
CONTROL = r"([<\[])(/?(?:s>|INST\]|SYS\]|ROLE))"
#: The line feed between two turns: it follows a closing control string, which no text holds.
_BETWEEN = r"(?<=\[/INST\]|</s>|\[/SYS\]|\[/ROLE\])\n"
#: The opening of a turn of any other role. Possessive, so that a role of any length takes no stack.
_ROLE = r"(?s)^\[ROLE ([^\\\]]*+(?:\\.[^\\\]]*+)*+)\] "
_ENDS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>"), "system": ("[SYS] ", " [/SYS]")}


def escape(text: Column) -> Column:
    """Backslashes doubled, then control strings broken: none is left."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _opening(role: Column) -> Column:
    other = F.concat(F.lit("[ROLE "), F.regexp_replace(escape(role), r"\]", r"\\]"), F.lit("] "))
    for name, (a, _) in _ENDS.items():
        other = F.when(role == name, a).otherwise(other)
    return other


def _closing(role: Column) -> Column:
    other = F.lit(" [/ROLE]")
    for name, (_, b) in _ENDS.items():
        other = F.when(role == name, b).otherwise(other)
    return other


def render(turns: DataFrame) -> DataFrame:
    """Replaces `turns` by formatted and loss_spans; other columns stay.

    formatted joins the turns by line feeds; loss_spans are the [start, end) code points of
    the assistant's texts in it, escaped as they stand there.
    """
    kept = [c for c in turns.columns if c.lower() not in ("turns", "formatted", "loss_spans")]
    pieces = F.transform(
        "turns",
        lambda t: F.struct(t["role"].alias("role"), _opening(t["role"]).alias("a"), escape(t["text"]).alias("text"), _closing(t["role"]).alias("b")),
    )
    cut = turns.select(*kept, pieces.alias("_pieces"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(s: Column, p: Column) -> Column:
        begin = s["at"] + F.length(p["a"])
        end = begin + F.length(p["text"])
        return F.struct(
            (end + F.length(p["b"]) + 1).alias("at"),
            F.when(p["role"] == "assistant", F.concat(s["spans"], F.array(F.struct(begin.alias("start"), end.alias("end")))))
            .otherwise(s["spans"]).alias("spans"),
        )

    return cut.select(
        *kept,
        F.array_join(F.transform("_pieces", lambda p: F.concat(p["a"], p["text"], p["b"])), "\n").alias("formatted"),
        F.aggregate("_pieces", start, step, lambda s: s["spans"]).alias("loss_spans"),
    )


def read_back(formatted: Column) -> Column:
    """The canonical turns of a formatted text."""

    def turn(t: Column) -> Column:
        size = F.length(t)
        head = F.regexp_extract(t, _ROLE, 1)
        role, skip, tail = unescape(head), F.length(head) + 8, F.lit(len(" [/ROLE]"))
        for name, (a, b) in _ENDS.items():
            here = t.startswith(a)
            role = F.when(here, name).otherwise(role)
            skip, tail = F.when(here, len(a)).otherwise(skip), F.when(here, len(b)).otherwise(tail)
        return F.struct(role.alias("role"), unescape(F.substring(t, skip + 1, size - skip - tail)).alias("text"))

    return F.when(formatted == "", F.array().cast(TURNS)).otherwise(F.transform(F.split(formatted, _BETWEEN, -1), turn))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")
