"""Chat formatting with layouts chosen by schema fingerprint, DataFrame functions only.

A record's layout is the set of its nested field paths; its fingerprint is a hash of them, taken row
by row from the record itself. A table of declarative mappings says, per fingerprint, where turns,
roles and texts lie. Records then become canonical turns and one formatted string each, from which
turns and the loss mask can be read back.

Template, per turn: `### role: text</turn>` and a newline. Inside roles and texts a backslash is
written as \\b, `#` as \\h and `<` as \\l (and in roles `:` as \\c), so no marker occurs inside them.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import table

OPEN, MID, CLOSE = "### ", ": ", "</turn>\n"
TURN = "array<struct<role:string,text:string>>"
#: conversation -7 of the contract.
PROBE = "\\### Assistant: </turn> ok"


@dataclass(frozen=True)
class Layout:
    """turns: the path of an array of messages with fields role and text; or slots: (role, path) of single texts, in order (absent and null ones are left out). rename: other role names."""

    paths: tuple[str, ...]
    turns: str | None = None
    role: str = "role"
    text: str = "content"
    slots: tuple[tuple[str, str], ...] = ()
    rename: tuple[tuple[str, str], ...] = ()


LAYOUTS = (
    Layout(("messages[].content", "messages[].role"), "messages"),
    Layout(("conversations[].from", "conversations[].value"), "conversations", "from", "value", rename=(("human", "user"), ("gpt", "assistant"))),
    Layout(("turns[].role", "turns[].text"), "turns", "role", "text"),
    Layout(("completion", "prompt"), slots=(("user", "prompt"), ("assistant", "completion"))),
    Layout(("completion", "prompt", "system"), slots=(("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Layout(("instruction", "output"), slots=(("user", "instruction"), ("assistant", "output"))),
    Layout(("input", "instruction", "output"), slots=(("system", "instruction"), ("user", "input"), ("assistant", "output"))),
)


#: Parts of a variant's schema: a field name, the start of an object or array, an end, a plain type.
SCHEMA_PART = r"(`(?:[^`]|``)*`: |\w+: |OBJECT<|ARRAY<|>|[A-Z_]+(?:\([0-9,]+\))?)"


def fingerprint(paths: tuple[str, ...] | list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def layout_fingerprints(layout: Layout) -> list[str]:
    """A layout's fingerprint and, for messages in an array, that of a record whose array is empty."""
    return [fingerprint(layout.paths)] + ([fingerprint((f"{layout.turns}[]",))] if layout.turns else [])


def schema_paths(schema: Column) -> Column:
    """The sorted leaf paths of a variant's schema at any depth, array items as []."""
    start = F.struct(F.array(F.lit("")).alias("open"), F.lit("").alias("name"), F.array().cast("array<string>").alias("paths"))

    def step(acc: Column, part: Column) -> Column:
        inside, name = F.element_at(acc["open"], -1), acc["name"]
        quoted = F.replace(F.substring(part, F.lit(2), F.length(part) - 4), F.lit("``"), F.lit("`"))
        label = F.when(part.startswith("`"), quoted).otherwise(F.substring(part, F.lit(1), F.length(part) - 2))
        field, items = part.endswith(": "), part == "ARRAY<"
        now = F.when(field, F.when(inside == "", label).otherwise(F.concat(inside, F.lit("."), label))).when(items, F.concat(name, F.lit("[]"))).otherwise(name)
        opened = F.when(items | (part == "OBJECT<"), F.array_append(acc["open"], now)).when(part == ">", F.slice(acc["open"], F.lit(1), F.size(acc["open"]) - 1)).otherwise(acc["open"])
        leaf = ~(field | items | (part == "OBJECT<") | (part == ">"))
        return F.struct(opened.alias("open"), now.alias("name"), F.when(leaf, F.array_append(acc["paths"], now)).otherwise(acc["paths"]).alias("paths"))

    return F.array_sort(F.aggregate(F.regexp_extract_all(schema, F.lit(SCHEMA_PART), 1), start, step)["paths"])


def record_fingerprint(record: Column) -> Column:
    """The fingerprint of a variant; null for what is no object."""
    schema = F.schema_of_variant(record)
    return F.when(schema.startswith("OBJECT<"), F.sha2(F.array_join(schema_paths(schema), "\n"), 256))


def _messages(record: Column, layout: Layout) -> Column:
    if layout.turns:
        items = F.try_variant_get(record, f"$.{layout.turns}", f"array<struct<`{layout.role}`:string,`{layout.text}`:string>>")
        made = F.transform(items, lambda m: F.struct(_renamed(m[layout.role], layout).alias("role"), m[layout.text].alias("text")))
        return F.coalesce(made.cast(TURN), F.array().cast(TURN))
    slots = F.array(*[F.struct(F.lit(role).alias("role"), F.try_variant_get(record, f"$.{path}", "string").alias("text")) for role, path in layout.slots])
    return F.filter(slots, lambda s: s["text"].isNotNull()).cast(TURN)


def _renamed(role: Column, layout: Layout) -> Column:
    for old, new in layout.rename:
        role = F.when(role == old, new).otherwise(role)
    return role


def canonical_turns(records: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """records with fingerprint and turns (array of struct(role, text)) of a column of records of mixed layouts: variants, JSON strings or structs.

    Each row's own fingerprint picks its mapping. turns is null where no mapping has the fingerprint,
    and both are null for null records and what is no JSON object. Columns of these two names are
    replaced, others kept. A record must fit in a variant (128 MB).
    """
    kind = records.schema[record].dataType
    value = F.col(f"`{record}`")
    value = F.try_parse_json(value) if isinstance(kind, T.StringType) else F.to_variant_object(value) if isinstance(kind, T.StructType) else value
    at = max([*records.columns, "v"], key=len) + "_"  # a name that records does not have
    marked = records.withColumn(at, value)
    marked = marked.withColumn("fingerprint", record_fingerprint(marked[at]))
    turns = F.lit(None).cast(TURN)
    for layout in layouts:
        turns = F.when(F.col("fingerprint").isin(layout_fingerprints(layout)), _messages(marked[at], layout)).otherwise(turns)
    return marked.withColumn("turns", turns).drop(at)


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("#"), F.lit("\\h")), F.lit("<"), F.lit("\\l"))
    return F.replace(out, F.lit(":"), F.lit("\\c")) if role else out


def unescape(text: Column) -> Column:
    for mark, plain in (("\\c", ":"), ("\\l", "<"), ("\\h", "#"), ("\\b", "\\")):
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def format_turns(turns: Column) -> Column:
    """The formatted string; null roles and texts count as empty, no turns give an empty string."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    one = lambda t: F.concat(F.lit(OPEN), escape(empty(t["role"]), True), F.lit(MID), escape(empty(t["text"])), F.lit(CLOSE))
    return F.array_join(F.transform(turns, one), "")


def read_turns(formatted: Column) -> Column:
    """array of struct(role, text) read back from a formatted string."""
    parts = F.filter(F.split(formatted, CLOSE), lambda p: p != "")

    def turn(p: Column) -> Column:
        head = F.instr(p, MID)
        role = F.substring(p, F.lit(len(OPEN) + 1), head - F.lit(len(OPEN) + 1))
        return F.struct(unescape(role).alias("role"), unescape(p.substr(head + len(MID), F.length(p))).alias("text"))

    return F.transform(parts, turn)


def loss_mask(formatted: Column, role: str = "assistant") -> Column:
    """array of struct(start, length): the spans, from 1, of the escaped texts of a role in a formatted string."""
    parts = F.filter(F.split(formatted, CLOSE), lambda p: p != "")
    zero = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        head = F.instr(p, MID)
        mine = F.substring(p, F.lit(len(OPEN) + 1), head - F.lit(len(OPEN) + 1)) == role
        begin = head + len(MID) - 1
        span = F.struct((acc["at"] + begin).alias("start"), (F.length(p) - begin).alias("length"))
        spans = F.when(mine, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((acc["at"] + F.length(p) + len(CLOSE)).alias("at"), spans.alias("spans"))

    return F.aggregate(parts, zero, step)["spans"]


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under a mask, unescaped, in order."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substring(formatted, s["start"], s["length"]))), "")


def gather_rows(rows: DataFrame) -> DataFrame:
    """Records (conv_id, turns) from a table of one turn a row (conv_id, turn, role, text), by turn; repeated rows stay, ties go by role, then text; nulls first. Other columns are dropped.

    A record is one value, so a conversation must fit in a row; texts are gathered once, partial lists before the shuffle.
    """
    item = F.struct("turn", "role", "text")
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("t"))
    return grouped.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def format_chat(records: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """records with fingerprint, turns, formatted and mask (columns of these names are replaced); formatted and mask are null where turns is."""
    made = canonical_turns(records, record, layouts)
    made = made.withColumn("formatted", format_turns(F.col("turns")))
    return made.withColumn("mask", loss_mask(F.col("formatted")))


def stored_record(turns: Column) -> Column:
    """A conversation as the variant that its exchange layout gives: one question and answer, with or without a system text, as named fields, anything longer as messages."""
    roles, texts = F.transform(turns, lambda t: t["role"]), F.transform(turns, lambda t: t["text"])
    named = lambda *fields: F.to_variant_object(F.struct(*[F.get(texts, F.lit(i)).alias(f) for i, f in enumerate(fields)]))
    whole = F.forall(texts, lambda t: t.isNotNull())
    short = F.when(whole & (roles == F.array(F.lit("user"), F.lit("assistant"))), named("prompt", "completion"))
    short = short.when(whole & (roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant"))), named("system", "prompt", "completion"))
    return short.otherwise(F.to_variant_object(F.struct(turns.alias("turns"))))


def op10_chat_format(spark, sf_dir: str) -> DataFrame:
    probe = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.posexplode(F.array(F.lit("user"), F.lit("assistant"))).alias("turn", "role"), F.lit(PROBE).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    made = format_chat(gather_rows(rows).select("conv_id", stored_record(F.col("turns")).alias("record")))
    turns, loss = read_turns(F.col("formatted")), masked_text(F.col("formatted"), F.col("mask"))
    back = made.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss"))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(flat, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_sql() -> str:
    return f"""WITH a AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL VALUES (-7, 0, 'user', '{PROBE}'), (-7, 1, 'assistant', '{PROBE}')),
b AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
CAST(sum(len(OPEN) + length(role) + len(regexp_extract_all(role, '[\\\\#<:]')) + len(MID) + length(text) + len(regexp_extract_all(text, '[\\\\#<]')) + len(CLOSE)) AS BIGINT) AS formatted_chars
FROM a GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM b""".replace("len(OPEN)", str(len(OPEN))).replace("len(MID)", str(len(MID))).replace("len(CLOSE)", str(len(CLOSE)))
