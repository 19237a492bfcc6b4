"""Chat formatting: schema fingerprints choose a mapping to turns, a template writes them out.

Spark expressions only. A record may hold its conversation in any of several layouts; the paths of its
nested fields are hashed, and the hash names the declarative mapping to canonical turns.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

TURNS = "array<struct<role:string,text:string>>"

# The strings that mark turns in the output.
START, HEAD, TAIL, STOP = "<s>", "[INST]", "[/INST]", "</s>"
# A control string with any number of backslashes behind its first character. Escaping adds one,
# unescaping takes one away, so a text never holds a bare control string and gets back as it was.
_LOOSE = r"(?<=<)(?=\\*/?s>)|(?<=\[)(?=\\*/?INST\])"
_TIGHT = r"(?<=<)\\(?=\\*/?s>)|(?<=\[)\\(?=\\*/?INST\])"
# Names of roles that mean the same.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "model": "assistant", "bot": "assistant"}


def escape(text: Column) -> Column:
    """The text without bare control strings; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _LOOSE, r"\\")


def unescape(text: Column) -> Column:
    """Undo ``escape``."""
    return F.regexp_replace(text, _TIGHT, "")


@dataclass(frozen=True)
class Layout:
    """How one kind of record holds its turns.

    ``paths`` are its nested fields, ``[]`` standing for the elements of an array. Either ``turns`` names
    an array whose elements have the fields ``role`` and ``text``, or ``fields`` lists roles with the
    fields that make up their turn, in order.
    """

    name: str
    paths: tuple[str, ...]
    turns: str | None = None
    role: str = "role"
    text: str = "content"
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()


LAYOUTS = (
    Layout("messages", ("messages[].content", "messages[].role"), "messages"),
    Layout("turns", ("turns[].role", "turns[].text", "turns[].turn"), "turns", text="text"),
    Layout("from and value", ("conversations[].from", "conversations[].value"), "conversations", "from", "value"),
    Layout("prompt, response", ("prompt", "response"), fields=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("prompt, completion", ("prompt", "completion"), fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("question, answer", ("question", "answer"), fields=(("user", ("question",)), ("assistant", ("answer",)))),
    Layout(
        "instruction", ("instruction", "output"),
        fields=(("user", ("instruction",)), ("assistant", ("output",))),
    ),
    Layout(
        "instruction, input", ("instruction", "input", "output"),
        fields=(("user", ("instruction", "input")), ("assistant", ("output",))),
    ),
    Layout(
        "system, instruction, input", ("system", "instruction", "input", "output"),
        fields=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))),
    ),
)


def shape_of(paths: Sequence[str]) -> str:
    """The shape that ``record_shape`` finds for a record with these field paths."""
    tree: dict = {}
    for path in paths:
        node = tree
        for part in path.replace("[]", ".[]").split("."):
            node = node.setdefault(part, {})

    def show(node: dict) -> str:
        if "[]" in node:
            return f"ARRAY<{show(node['[]'])}>"
        return "OBJECT<" + ", ".join(f"{name}: {show(node[name])}" for name in sorted(node)) + ">" if node else ""

    return show(tree)


def record_shape(record: Column) -> Column:
    """The nested fields of a variant in alphabetical order, without the types of its scalars.

    Two records have one shape exactly if they have the same field paths; a field that is null in
    one of them makes no difference.
    """
    return F.regexp_replace(F.schema_of_variant(record), r"(: |ARRAY<|^)(?!OBJECT<|ARRAY<)[A-Z_]+(\(\d+,\d+\))?", "$1")


def _mapped(record: Column, layout: Layout) -> Column:
    """The turns of a record with this layout."""
    if layout.turns:
        kind = f"array<struct<`{layout.role}`: string, `{layout.text}`: string>>"
        held = F.try_variant_get(record, f"$.{layout.turns}", kind)
        return F.transform(held, lambda t: F.struct(_role(t[layout.role]).alias("role"), _text(t[layout.text]).alias("text")))
    turns = []
    for role, names in layout.fields:
        parts = [F.nullif(F.try_variant_get(record, f"$.{name}", "string"), F.lit("")) for name in names]
        turns.append(F.struct(F.lit(role).alias("role"), F.concat_ws("\n\n", *parts).alias("text")))
    return F.array(*turns)


def _role(role: Column) -> Column:
    known = F.lit(None).cast("string")
    for other, name in ROLES.items():
        known = F.when(role == other, F.lit(name)).otherwise(known)
    return F.coalesce(known, role, F.lit(""))


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def with_turns(records: DataFrame, record: str = "record", layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """Add ``fingerprint`` (the hash of a variant's nested field paths), ``layout`` and the canonical ``turns``.

    A record of unknown shape, a null one and an empty list of messages keep their row with a null
    layout and no turns. Null texts and roles become empty. Roles with other names become user and assistant.
    """
    shape = record_shape(F.col(record))
    layout, turns = F.lit(None).cast("string"), F.array().cast(TURNS)
    for known in reversed(layouts):
        print_ = F.xxhash64(F.lit(shape_of(known.paths)))
        layout = F.when(F.col("fingerprint") == print_, F.lit(known.name)).otherwise(layout)
        turns = F.when(F.col("fingerprint") == print_, F.coalesce(_mapped(F.col(record), known), turns)).otherwise(turns)
    return records.withColumn("fingerprint", F.xxhash64(shape)).withColumns({"layout": layout, "turns": turns})


def with_segments(chats: DataFrame, turns: str = "turns") -> DataFrame:
    """Add ``segments``, pieces of the formatted text with their place in the loss mask, and ``formatted``, all pieces in order.

    Each turn reads ``<s>[INST]role[/INST]text</s>``, role and text escaped. Of all pieces only the texts
    of assistant turns count towards the loss. No turns: no segments and an empty text.
    """
    def pieces(turn: Column) -> Column:
        head = F.concat(F.lit(START + HEAD), escape(turn["role"]), F.lit(TAIL))
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(turn["text"]).alias("text"), (turn["role"] == "assistant").alias("loss")),
            F.struct(F.lit(STOP).alias("text"), F.lit(False).alias("loss")),
        )

    cut = chats.withColumn("segments", F.flatten(F.transform(F.col(turns), pieces)))
    return cut.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, unescaped."""
    pattern = F.lit(r"(?s)<s>\[INST\](.*?)\[/INST\](.*?)</s>")
    return F.zip_with(
        F.regexp_extract_all(formatted, pattern, F.lit(1)), F.regexp_extract_all(formatted, pattern, F.lit(2)),
        lambda role, text: F.struct(unescape(role).alias("role"), unescape(text).alias("text")),
    )


def read_loss(segments: Column) -> Column:
    """All text under the loss mask, unescaped and in order."""
    under = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(under, lambda s: unescape(s["text"])), "")


def gather_turns(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One record per conversation from a table with a row per turn: (key, record).

    Turns come in order of their number; equal numbers by role and text. Rows with a null key are one conversation.
    """
    row = F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    held = rows.groupBy(key).agg(F.sort_array(F.collect_list(row)).alias("turns"))
    return held.select(key, F.to_variant_object(F.struct("turns")).alias("record"))
