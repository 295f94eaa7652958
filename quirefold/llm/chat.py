"""Chat formatting: schema fingerprints select mappings to canonical turns; a reversible template.

Records come as JSON.  The nested field paths of a record, without the scalar types, are
hashed, all together to its fingerprint, and each; the hashes select a declarative mapping (``LAYOUTS``) that turns
prompt, instruction and message layouts alike into ``turns``: an array of (role, text).  Fields that no mapping asks for do no harm.

A turn is formatted as ``<turn ROLE>``, a line end, the text, a line end, ``</turn>`` and a line end.
Inside roles and texts a backslash becomes ``\\b``, ``<`` becomes ``\\l`` and ``>`` becomes ``\\g``: no text can
then hold a mark of the template, every backslash begins an escape, and undoing the escapes
gives back each text exactly.  The loss mask is a run for each piece of the output: head, text
and tail of each turn, with its length and whether it counts for the loss (texts of assistants).

Defined results: a null text or role is empty; turns are ordered by ``turn``, nulls first, ties by
role and text, and equal rows stay as they are; a record of unknown layout keeps its fingerprint and
has null turns, output, mask and text read back; what is no JSON has no fingerprint either; null conversation ids are one
conversation; an empty table gives no rows; other columns pass through, those with the names of the outputs are replaced; a
conversation is one output row and so must fit into a row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """A record layout: the nested field paths that it needs, the type to read, and the SQL expression over ``r`` that gives its turns."""

    name: str
    paths: tuple[str, ...]
    ddl: str
    turns: str


def _pairs(name: str, asked: str, said: str) -> Layout:
    return Layout(name, (f"$.{asked}", f"$.{said}"), f"{asked} string, {said} string", f"array(struct('user' AS role, r.{asked} AS text), struct('assistant' AS role, r.{said} AS text))")


#: Layouts, the first that fits counts.
LAYOUTS = (
    Layout("messages", ("$.messages[].role", "$.messages[].content"), "messages array<struct<role:string,content:string>>", "transform(r.messages, m -> struct(m.role AS role, m.content AS text))"),
    Layout("dialogue", ("$.conversations[].from", "$.conversations[].value"), "conversations array<struct<`from`:string,value:string>>", "transform(r.conversations, m -> struct(m.`from` AS role, m.value AS text))"),
    Layout(
        "instruction", ("$.instruction", "$.output"), "instruction string, input string, output string",
        "array(struct('user' AS role, concat(coalesce(r.instruction, ''), if(coalesce(r.input, '') = '', '', concat('\\n\\n', r.input))) AS text), struct('assistant' AS role, r.output AS text))",
    ),
    _pairs("prompt", "prompt", "completion"), _pairs("response", "prompt", "response"), _pairs("question", "question", "answer"),
)
#: Names that layouts give to the canonical roles.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def field_paths(json: Column) -> Column:
    """The nested field paths of a record, sorted, as ``$.messages[].role``; null for what is no JSON.  Scalar types do not count, so a null is like any other scalar."""
    marks = F.regexp_extract_all(F.schema_of_variant(F.try_parse_json(json)), F.lit(r"(?:`(?:[^`]|``)*`|[^`<>,: ]+): |OBJECT<|ARRAY<|>"), 0)

    def step(s: Column, mark: Column) -> Column:
        top = F.coalesce(F.try_element_at(s["open"], F.lit(-1)), F.lit("$"))
        named = F.concat(top, F.lit("."), F.replace(F.regexp_replace(mark, r"^`?(.*?)`?: $", "$1"), F.lit("``"), F.lit("`")))
        at = lambda here, open_, paths: F.struct(here.alias("here"), open_.alias("open"), paths.alias("paths"))
        item = F.concat(s["here"], F.lit("[]"))
        return (
            F.when(mark == ">", at(s["here"], F.slice(s["open"], 1, F.greatest(F.size(s["open"]) - 1, F.lit(0))), s["paths"]))
            .when(mark == "OBJECT<", at(s["here"], F.concat(s["open"], F.array(s["here"])), s["paths"]))
            .when(mark == "ARRAY<", at(item, F.concat(s["open"], F.array(item)), s["paths"]))
            .otherwise(at(named, s["open"], F.concat(s["paths"], F.array(named))))
        )

    start = F.struct(F.lit("$").alias("here"), F.array().cast("array<string>").alias("open"), F.array().cast("array<string>").alias("paths"))
    return F.aggregate(marks, start, step, lambda s: F.array_sort(F.array_distinct(s["paths"])))


def fingerprint(paths: Column) -> Column:
    """Hash of the nested field paths."""
    return F.xxhash64(paths)


def canonical_turns(records: DataFrame, json_col: str = "record") -> DataFrame:
    """``records`` with ``fingerprint``, ``layout`` (null if unknown) and ``turns``.

    Layouts are chosen once a fingerprint: by the hashes of the paths that they need, whatever other fields there are.
    """
    hashed = F.transform(F.col("_chat_paths"), lambda p: F.xxhash64(p))
    layout_of, turns_of = None, None
    for layout in LAYOUTS:
        hit = F.size(F.array_except(F.array(*(F.xxhash64(F.lit(p)) for p in layout.paths)), F.col("_chat_hashes"))) == 0
        turns = F.transform(F.expr(layout.turns.replace("r.", f"from_json(`{json_col}`, '{layout.ddl}').")), lambda t: F.struct(_role(t["role"]).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
        layout_of = F.when(hit, layout.name) if layout_of is None else layout_of.when(hit, layout.name)
        turns_of = F.when(F.col("layout") == layout.name, turns) if turns_of is None else turns_of.when(F.col("layout") == layout.name, turns)
    marked = records.withColumn("_chat_paths", field_paths(F.col(json_col))).withColumn("_chat_hashes", hashed)
    known = marked.withColumn("fingerprint", F.when(F.col("_chat_paths").isNotNull(), fingerprint(F.col("_chat_paths")))).withColumn("layout", layout_of)
    return known.withColumn("turns", turns_of).drop("_chat_paths", "_chat_hashes")


def _role(role: Column) -> Column:
    role = F.coalesce(role, F.lit(""))
    for other, name in ROLES.items():
        role = F.when(role == other, name).otherwise(role)
    return role


def escape(text: Column) -> Column:
    for mark, code in (("\\", "\\b"), ("<", "\\l"), (">", "\\g")):
        text = F.replace(text, F.lit(mark), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for code, mark in (("\\g", ">"), ("\\l", "<"), ("\\b", "\\")):
        text = F.replace(text, F.lit(code), F.lit(mark))
    return text


def format_turns(records: DataFrame, turns_col: str = "turns") -> DataFrame:
    """Adds ``formatted`` and ``loss_mask``, an array of (length, loss) whose lengths add up to the output's."""
    pieces = F.transform(turns_col, lambda t: F.struct(F.concat(F.lit("<turn "), escape(t["role"]), F.lit(">\n")).alias("head"), escape(t["text"]).alias("body"), (t["role"] == "assistant").alias("loss")))
    tail = "\n</turn>\n"
    text = F.array_join(F.transform("_chat_pieces", lambda p: F.concat(p["head"], p["body"], F.lit(tail))), "")
    run = lambda length, loss: F.struct(length.cast("int").alias("length"), loss.alias("loss"))
    mask = F.flatten(F.transform("_chat_pieces", lambda p: F.array(run(F.length(p["head"]), F.lit(False)), run(F.length(p["body"]), p["loss"]), run(F.lit(len(tail)), F.lit(False)))))
    return records.withColumn("_chat_pieces", pieces).withColumn("formatted", text).withColumn("loss_mask", mask).drop("_chat_pieces")


def read_back(formatted: DataFrame) -> DataFrame:
    """From ``formatted`` and ``loss_mask`` alone: ``read_turns`` and ``loss_text``, unescaped.  The mask's runs must fit the pieces, else it raises."""
    part = lambda k: F.regexp_extract_all(F.col("formatted"), F.lit(r"<turn ([^<>]*)>\n([^<>]*)\n</turn>\n"), k)
    heads, bodies = part(F.lit(1)), part(F.lit(2))
    lengths = F.flatten(F.zip_with("_chat_heads", "_chat_bodies", lambda h, b: F.array(F.length(h) + len("<turn >\n"), F.length(b), F.lit(len("\n</turn>\n")))))
    fits = (lengths == F.transform("loss_mask", lambda r: r["length"])) & (F.aggregate("loss_mask", F.lit(0), lambda s, r: s + r["length"]) == F.length("formatted"))
    counted = F.filter(F.transform("_chat_bodies", lambda b, i: F.when(F.element_at("loss_mask", 3 * i + 2)["loss"], b)), lambda b: b.isNotNull())
    loss = F.when(F.col("formatted").isNull(), F.lit(None)).when(fits, F.array_join(F.transform(counted, unescape), "")).otherwise(F.raise_error(F.lit("the loss mask does not fit the output")).cast("string"))
    return (
        formatted.withColumn("_chat_heads", heads)
        .withColumn("_chat_bodies", bodies)
        .withColumn("read_turns", F.zip_with("_chat_heads", "_chat_bodies", lambda h, b: F.struct(unescape(h).alias("role"), unescape(b).alias("text"))))
        .withColumn("loss_text", loss)
        .drop("_chat_heads", "_chat_bodies")
    )


def conversation_records(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows by turn as one JSON record of the message layout for each conversation."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("content"))
    ordered = F.transform(F.array_sort(F.collect_list(turn)), lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    return rows.groupBy(F.col(conv_col).cast("long").alias("conv_id")).agg(ordered.alias("messages")).select("conv_id", F.to_json(F.struct("messages")).alias("record"))
