"""Chat formatting: records of many layouts become canonical turns, turns become one marked text.

A record's schema fingerprint for a mapping is a hash of the nested field paths it holds, among those that the
mapping knows; further fields don't matter. Of the mappings whose fingerprint the record has, the one that asks for most paths
is taken. Columns of a table are fingerprinted once by its schema; JSON records row by row, as variants.

The template writes each turn as <|im_start|>role\\ntext<|im_end|>\\n. In roles and texts a control
string gets one backslash after its first character, or one more if it has some there already, so
no control string is left and taking one backslash away gives the text back.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import col

START, END = "<|im_start|>", "<|im_end|>\n"
# The control strings of public chat templates, without their first character.
CONTROLS = [
    r"\|im_start\|>", r"\|im_end\|>", r"\|endoftext\|>", r"\|eot_id\|>", r"\|begin_of_text\|>", r"\|end_of_text\|>",
    r"\|start_header_id\|>", r"\|end_header_id\|>", r"\|system\|>", r"\|user\|>", r"\|assistant\|>", r"\|end\|>",
    r"/?s>", r"start_of_turn>", r"end_of_turn>", r"<SYS>>", r"</SYS>>", r"/?INST\]",
]
ESCAPE = r"([<\[])(\\*)(" + "|".join(CONTROLS) + ")"
UNESCAPE = r"([<\[])\\(\\*)(" + "|".join(CONTROLS) + ")"
#: Names of roles in other layouts.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatbot": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """How one layout gives turns: single fields that lead, lists of messages under a path, then further single fields, in order.

    lists: (path of an array, role field, text field); lead, fields: (role, path, further paths that are
    appended after a blank line). optional: paths that a record may lack. columns: of a table with one row a turn, those
    of conversation, turn, role and text.
    """

    name: str
    lists: tuple[tuple[str, str, str], ...] = ()
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    optional: tuple[str, ...] = ()
    lead: tuple[tuple[str, tuple[str, ...]], ...] = ()
    columns: tuple[str, ...] = ()

    def paths(self) -> set[str]:
        return {f"{p}[].{f}" for p, *names in self.lists for f in names} | {p for _, ps in self.lead + self.fields for p in ps} | set(self.columns)


_SYSTEM = (("system", ("system",)),)
MAPPINGS = (
    Mapping("messages", lead=_SYSTEM, lists=(("messages", "role", "content"),), optional=("system",)),
    Mapping("conversations", lead=_SYSTEM, lists=(("conversations", "from", "value"),), optional=("system",)),
    Mapping("conversation", lead=_SYSTEM, lists=(("conversation", "role", "content"),), optional=("system",)),
    Mapping("dialogue", lists=(("dialogue", "speaker", "text"),)),
    Mapping("messages_from", lists=(("messages", "from", "value"),)),
    Mapping("preference", lead=_SYSTEM, fields=(("user", ("prompt",)), ("assistant", ("chosen",))), optional=("system",)),
    Mapping("nested", lists=(("data.messages", "role", "content"),)),
    Mapping("prompt_messages", lists=(("prompt", "role", "content"), ("completion", "role", "content"))),
    Mapping("instruction", lead=_SYSTEM, fields=(("user", ("instruction", "input")), ("assistant", ("output",))), optional=("system", "input")),
    Mapping("instruction_response", lead=_SYSTEM, fields=(("user", ("instruction", "context")), ("assistant", ("response",))), optional=("system", "context")),
    Mapping("prompt_completion", lead=_SYSTEM, fields=(("user", ("prompt",)), ("assistant", ("completion",))), optional=("system",)),
    Mapping("prompt_response", lead=_SYSTEM, fields=(("user", ("prompt",)), ("assistant", ("response",))), optional=("system",)),
    Mapping("question_answer", fields=(("user", ("context", "question")), ("assistant", ("answer",))), optional=("context",)),
    Mapping("turn_rows", columns=("conv_id", "turn", "role", "text")),
)
TURN = "struct<role:string,text:string>"


def fingerprint(paths) -> str:
    """The text that is hashed: the known paths, in order. Kept as text here, hashed by Spark."""
    return "\n".join(sorted(paths))


def schema_paths(schema: T.DataType, at: str = "") -> set[str]:
    """The nested field paths of a schema; array elements as []."""
    if isinstance(schema, T.StructType):
        return {p for f in schema.fields for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)}
    if isinstance(schema, T.ArrayType):
        return schema_paths(schema.elementType, at + "[]")
    return {at}


def _variants(m: Mapping) -> list[str]:
    """The fingerprints of a mapping: with each choice of its optional paths."""
    out = [m.paths() - set(m.optional)]
    for p in m.optional:
        out += [x | {p} for x in out]
    return [fingerprint(x) for x in out]


def _kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _held(v: Column, path: str) -> Column:
    """Whether a variant holds a text, number or truth value at a path; below a list, some element, where a list of parts will do too."""
    listed, _, field = path.partition("[].")
    if not field:
        return F.coalesce(~_kind(v, f"$.{path}").rlike("^(ARRAY|OBJECT|VOID)"), F.lit(False))
    items = F.try_variant_get(v, f"$.{listed}", "array<variant>")
    return F.coalesce(F.exists(items, lambda x: F.coalesce(~_kind(x, f"$.{field}").rlike("^(OBJECT|VOID)"), F.lit(False))), F.lit(False))


def record_fingerprints(v: Column, mappings: tuple[Mapping, ...] = MAPPINGS) -> Column:
    """By name of mapping, the hash of those of its paths that a variant holds."""
    paths = sorted({p for m in mappings for p in m.paths()})
    # Bound as a variable of an outer lambda, the record is looked through once, not once a mapping.
    held = F.array(F.array_compact(F.array(*[F.when(_held(v, p), F.lit(p)) for p in paths])))
    prints = lambda h: F.struct(*[F.xxhash64(F.array_join(F.array_intersect(h, F.array(*[F.lit(p) for p in sorted(m.paths())])), "\n")).alias(m.name) for m in mappings])
    return F.transform(held, prints)[0]


def table_fingerprint(schema: T.StructType, m: Mapping) -> str:
    """The hash of those of a mapping's paths that a schema has."""
    return hashlib.sha256(fingerprint(schema_paths(schema) & m.paths()).encode()).hexdigest()


def _turns(v: Column, m: Mapping) -> Column:
    single = lambda fields: [_single(v, role, paths) for role, paths in fields]
    lists = [F.transform(F.coalesce(F.try_variant_get(v, f"$.{path}", "array<variant>"), F.array().cast("array<variant>")), _message(role, text)) for path, role, text in m.lists]
    return F.concat(*single(m.lead), *lists, *single(m.fields))


def _single(v: Column, role: str, paths: tuple[str, ...]) -> Column:
    got = F.array_compact(F.array(*[F.try_variant_get(v, f"$.{p}", "string") for p in paths]))
    turn = F.array(F.struct(F.lit(role).alias("role"), F.array_join(F.filter(got, lambda s: s != ""), "\n\n").alias("text")))
    return F.when(F.size(got) > 0, turn).otherwise(F.array().cast(f"array<{TURN}>"))


def _message(role: str, text: str):
    """A turn of an element of a list. A text that is a list of parts, each a text or an object with one, is these a line each; other parts have none."""

    def turn(x: Column) -> Column:
        parts = F.transform(F.try_variant_get(x, f"$.{text}", "array<variant>"), lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.when(~F.schema_of_variant(p).rlike("^(ARRAY|OBJECT)"), F.try_variant_get(p, "$", "string"))))
        said = F.when(_kind(x, f"$.{text}").startswith("ARRAY"), F.array_join(parts, "\n")).otherwise(F.try_variant_get(x, f"$.{text}", "string"))
        return F.struct(_role(F.try_variant_get(x, f"$.{role}", "string")).alias("role"), F.coalesce(said, F.lit("")).alias("text"))

    return turn


def _role(role: Column) -> Column:
    named = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(F.try_element_at(named, F.lower(role)), role, F.lit(""))


def turns_of_records(df: DataFrame, id_col: str, json_col: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """(conv_id, turn, role, text, layout) of JSON records, a row a turn.

    A record of no known layout, that isn't JSON, that is null, or that is too large for a variant gives one row with null turn, role and text
    and layout 'unknown', so that it can be counted. Null roles and texts in a known layout are empty. Records that
    repeat an id give the turns of each. An empty table gives an empty result; further columns of df play no part.
    """
    mappings = tuple(sorted((m for m in mappings if not m.columns), key=lambda m: -len(m.paths() - set(m.optional))))
    parsed = df.select(col(id_col).alias("conv_id"), F.try_parse_json(col(json_col)).alias("v"))
    printed = parsed.withColumn("f", record_fingerprints(F.col("v"), mappings))
    turns, layout = F.lit(None).cast(f"array<{TURN}>"), F.lit("unknown")
    for m in reversed(mappings):
        is_m = F.coalesce(F.col(f"f.{m.name}").isin(*[F.xxhash64(F.lit(text)) for text in _variants(m)]), F.lit(False))
        turns, layout = F.when(is_m, _turns(F.col("v"), m)).otherwise(turns), F.when(is_m, F.lit(m.name)).otherwise(layout)
    return printed.select("conv_id", layout.alias("layout"), F.posexplode_outer(turns).alias("turn", "t")).select(
        "conv_id", F.col("turn").cast("long"), F.col("t.role").alias("role"), F.col("t.text").alias("text"), "layout"
    )


def turns_of_table(df: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """(conv_id, turn, role, text, layout) of a table; its schema's fingerprint says how to read it.

    A table with a row a turn is that of a mapping with columns; its null roles and texts stay null, repeated rows are turns of their own, rows without
    conv_id one conversation; long texts stay whole. Others are tables of records with conv_id and the fields of a layout.
    An empty table gives an empty result; further columns play no part.
    """
    for m in mappings:
        if m.columns and table_fingerprint(df.schema, m) == hashlib.sha256(fingerprint(m.columns).encode()).hexdigest():
            conv_id, turn, role, text = map(col, m.columns)
            return df.select(conv_id.alias("conv_id"), turn.cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.lit(m.name).alias("layout"))
    rest = [c for c in df.columns if c != "conv_id"]
    if "conv_id" not in df.columns or not rest:
        raise ValueError("a table of records has conv_id and the fields of a layout")
    records = df.select("conv_id", F.to_json(F.struct(*map(col, rest))).alias("json_"))
    return turns_of_records(records, "conv_id", "json_", mappings)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2$3")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    parts = F.split(unescape(role), r"\\\\")
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def format_chat(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, segments, unknown_records): a row a conversation; segments say which parts the loss covers.

    Turns are ordered by turn (nulls last), then role and text. Null roles and texts count as empty.
    The segments' texts joined are `formatted`. The loss covers the texts of assistants, without
    role and markers. A conversation is one training example and one row: its turns meet in
    one task; they are formatted before they do. A conversation whose records all have an unknown layout, among them
    those without messages, is a row with null formatted and segments; unknown_records counts those of any conversation, which have no part in its text. Turns that repeat are all kept, long texts whole; an empty table
    gives an empty result; further columns of `turns` play no part.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    written = turns.select(
        "conv_id",
        (F.col("layout") == "unknown").alias("unknown"),
        F.when(F.col("layout") != "unknown", F.struct(
            F.col("turn").isNull().alias("o"), F.col("turn").alias("turn"), role.alias("role"), text.alias("raw"),
            F.concat(F.lit(START), _escape_role(role), F.lit("\n")).alias("head"), escape(text).alias("text"),
        )).alias("t"),
    )
    together = written.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"), F.count_if("unknown").alias("unknown_records"))
    part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    mine = lambda t: t["role"] == "assistant"
    segments = F.flatten(F.transform("t", lambda t: F.array(part(t["head"], F.lit(False)), part(t["text"], mine(t)), part(F.lit(END), F.lit(False)))))
    return together.select("conv_id", F.when(F.size("t") > 0, segments).alias("segments"), "unknown_records").select(
        "conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", "unknown_records"
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text."""
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda p: p != "")
    body = lambda p: F.substr(p, F.lit(len(START) + 1))
    cut = lambda p: F.instr(body(p), "\n")
    return F.transform(
        pieces,
        lambda p: F.struct(
            _unescape_role(F.substr(body(p), F.lit(1), cut(p) - 1)).alias("role"), unescape(F.substr(body(p), cut(p) + 1)).alias("text")
        ),
    )


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
