"""Chat formatting: records of many layouts to one template, with a loss mask.

A record is a JSON object. Its nested field paths, without values and types, are hashed to a
fingerprint; a table of declared layouts says which fields hold the turns of a record with that
fingerprint. The canonical turns are written as

    <s>[INST]role[/INST]text</s>

one after another. In roles and texts every control string of the template gets a backslash after its
first character (one more where there are some), which is undone by taking one away, so reading back
gives the same turns. The loss mask is a list of (start, length) over the formatted text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweave.functions.text import let

START, MIDDLE, END = "<s>[INST]", "[/INST]", "</s>"
CONTROL = r"([<\[])(\\*)(/?(?:s>|INST\]))"
ESCAPED = r"([<\[])\\(\\*)(/?(?:s>|INST\]))"
TRAINED_ROLE = "assistant"
TYPES = r": (?:STRING|VOID|BOOLEAN|BIGINT|DOUBLE|FLOAT|DECIMAL\(\d+,\d+\))"


@dataclass(frozen=True)
class Layout:
    """How records with these field paths become turns: a list of messages, or one field per turn."""

    name: str
    paths: str
    messages: str | None = None
    role: str = "role"
    text: str = "content"
    roles: dict[str, str] = field(default_factory=dict)
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()


LAYOUTS = (
    Layout("messages", "OBJECT<messages: ARRAY<OBJECT<content, role>>>", messages="messages"),
    Layout("messages", "OBJECT<messages: ARRAY<OBJECT<content>>>", messages="messages"),
    Layout("shared", "OBJECT<conversations: ARRAY<OBJECT<from, value>>>", messages="conversations", role="from", text="value", roles={"human": "user", "gpt": "assistant"}),
    Layout("pair", "OBJECT<completion, prompt>", turns=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("instruction", "OBJECT<instruction, output>", turns=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("instruction", "OBJECT<input, instruction, output>", turns=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("instruction", "OBJECT<instruction, output, system>", turns=(("system", ("system",)), ("user", ("instruction",)), ("assistant", ("output",)))),
)


def field_paths(record: Column) -> Column:
    """Nested field names of a JSON text, sorted, without types; null for text that is not JSON."""
    return F.regexp_replace(F.schema_of_variant(F.try_parse_json(record)), TYPES, "")


def fingerprint(record: Column) -> Column:
    return F.sha2(field_paths(record), 256)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def _fields() -> str:
    parts = {}
    for layout in LAYOUTS:
        if layout.messages:
            parts[layout.messages] = f"`{layout.messages}` array<struct<`{layout.role}`: string, `{layout.text}`: string>>"
        for _, names in layout.turns:
            parts.update({n: f"`{n}` string" for n in names})
    return ", ".join(parts.values())


def _turns(layout: Layout, parsed: Column) -> Column:
    if layout.messages:
        def role(x: Column) -> Column:
            given = F.coalesce(x[layout.role], F.lit(""))
            known = given
            for theirs, ours in layout.roles.items():
                known = F.when(given == theirs, F.lit(ours)).otherwise(known)
            return known

        return F.transform(parsed[layout.messages], lambda x: F.struct(role(x).alias("role"), F.coalesce(x[layout.text], F.lit("")).alias("text")))
    one = lambda names: F.concat_ws("\n", *[parsed[n] for n in names])
    return F.array(*[F.struct(F.lit(role).alias("role"), one(names).alias("text")) for role, names in layout.turns])


def canonical(records: DataFrame, record: str = "record") -> DataFrame:
    """``records`` with ``layout`` and ``turns`` (array of role, text); null for paths that no layout declares.

    Null roles and texts become empty. Malformed JSON and unknown layouts are kept with null turns.
    """
    marked = records.withColumn("_print", fingerprint(F.col(record))).withColumn("_parsed", F.from_json(F.col(record), _fields()))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role: string, text: string>>")
    for layout in LAYOUTS:
        hit = F.col("_print") == F.sha2(F.lit(layout.paths), 256)
        name = F.when(hit, F.lit(layout.name)).otherwise(name)
        turns = F.when(hit, _turns(layout, F.col("_parsed"))).otherwise(turns)
    return marked.withColumn("layout", name).withColumn("turns", turns).drop("_print", "_parsed")


def formatted(rows: DataFrame, turns: str = "turns") -> DataFrame:
    """``rows`` with ``formatted`` and ``loss_mask`` (array of start, length in code points, from 0)."""
    span = "struct<start: int, length: int>"
    parts = F.transform(F.col(turns), lambda t: F.struct((t["role"] == TRAINED_ROLE).alias("on"), F.concat(F.lit(START), escape(t["role"]), F.lit(MIDDLE)).alias("head"), escape(t["text"]).alias("body")))

    def grow(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.char_length(p["head"])
        size = F.char_length(p["body"])
        more = F.when(p["on"], F.array(F.struct(start.alias("start"), size.alias("length")))).otherwise(F.array().cast(f"array<{span}>"))
        return F.struct((start + size + len(END)).alias("at"), F.concat(acc["spans"], more).alias("spans"))

    empty = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("spans"))
    mask = lambda p: F.aggregate(p, empty, grow, lambda acc: acc["spans"])
    text = lambda p: F.array_join(F.transform(p, lambda x: F.concat(x["head"], x["body"], F.lit(END))), "")
    both = let(parts, lambda p: F.struct(text(p).alias("formatted"), mask(p).alias("loss_mask")))
    return rows.withColumn("_both", both).withColumns({"formatted": F.col("_both.formatted"), "loss_mask": F.col("_both.loss_mask")}).drop("_both")


def read_turns(text: Column) -> Column:
    """The turns of a formatted text."""
    pieces = F.filter(F.split(text, END), lambda p: p != "")

    def turn(p: Column) -> Column:
        middle = F.instr(p, MIDDLE)
        role = F.substring(p, F.lit(len(START) + 1), middle - (len(START) + 1))
        return F.struct(unescape(role).alias("role"), unescape(F.substring(p, middle + len(MIDDLE), F.char_length(p))).alias("text"))

    return F.transform(pieces, turn)


def read_trained(text: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return let(text, lambda t: F.array_join(F.transform(mask, lambda s: unescape(F.substring(t, s["start"] + 1, s["length"]))), ""))
