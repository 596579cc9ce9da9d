"""Chat formatting with typed content parts, in DataFrame expressions only.

A visitor flattens a turn's parts in order: text is escaped, and every image, audio or document
part becomes a placeholder, whose reference and expanded token count are recorded. In texts and
roles ``~``, ``<`` and ``[`` (and, in roles, line ends) become ``~0``, ``~1``, ``~2`` and ``~3``,
so no control string of this template or of another survives inside a text, and the output can
be parsed and unescaped exactly.

Cases: a null text or role is empty; a part of an unknown type is an empty text; turns are in
the order of turn, then role, then text as it was before escaping (nulls first); repeated rows are turns of their own; a
null conv_id is a conversation; an empty table gives no conversation; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|turn|>", "<|end|>\n"
#: Tokens that a placeholder stands for: for each tile, each second or each page.
IMAGE_TILE, AUDIO_SECOND, DOCUMENT_PAGE = 256, 25, 512
PART = "struct<type:string,text:string,ref:string,units:int>"


def escape(text: Column) -> Column:
    for plain, code in (("~", "~0"), ("<", "~1"), ("[", "~2")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in (("\n", "~3"), ("[", "~2"), ("<", "~1"), ("~", "~0")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _attached(part: Column) -> Column:
    return F.coalesce(part["type"].isin("image", "audio", "document"), F.lit(False))


def _tokens(part: Column) -> Column:
    each = F.when(part["type"] == "image", IMAGE_TILE).when(part["type"] == "audio", AUDIO_SECOND).otherwise(DOCUMENT_PAGE)
    return F.greatest(F.coalesce(part["units"], F.lit(1)), F.lit(1)) * each


def visit(parts: Column) -> Column:
    """The parts as one escaped string: texts as they come, placeholders for the rest."""
    one = lambda p: F.when(_attached(p), F.concat(F.lit("<|"), p["type"], F.lit("|>"))).otherwise(escape(F.coalesce(p["text"], F.lit(""))))
    return F.array_join(F.transform(parts, one), "")


def attachments(parts: Column) -> Column:
    """Of every placeholder, in order: its type, reference and expanded token count."""
    return F.transform(F.filter(parts, _attached), lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), _tokens(p).alias("tokens")))


def format_chat(turns: DataFrame, *, learn: str = "assistant") -> DataFrame:
    """One row per conversation of ``turns`` (conv_id, turn, role, parts): formatted text, loss spans (character offsets), attachments."""
    role = F.coalesce(F.col("role"), F.lit(""))
    head = F.concat(F.lit(OPEN), F.replace(escape(role), F.lit("\n"), F.lit("~3")), F.lit("\n"))
    flat = turns.select("conv_id", F.struct(F.col("turn"), role.alias("role"), visit(F.col("parts")).alias("body"), head.alias("head"), attachments(F.col("parts")).alias("attached")).alias("t"))
    # where each turn begins; this window and the grouping below share one shuffle
    order = ("t.turn", "t.role", unescape(F.col("t.body")), "t.body", F.to_json("t.attached"))
    before = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("t.head") + F.length("t.body") + len(CLOSE)
    placed = flat.withColumn("begun", F.coalesce(F.sum(size).over(before), F.lit(0)))
    one = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("begun", "t"))).alias("ts"))
    start = lambda x: x["begun"] + F.length(x["t"]["head"])
    span = lambda x: F.struct(start(x).alias("start"), (start(x) + F.length(x["t"]["body"])).alias("end"))
    return one.select(
        "conv_id",
        F.array_join(F.transform("ts", lambda x: F.concat(x["t"]["head"], x["t"]["body"], F.lit(CLOSE))), "").alias("formatted"),
        F.transform(F.filter("ts", lambda x: x["t"]["role"] == learn), span).alias("loss_spans"),
        F.flatten(F.transform("ts", lambda x: x["t"]["attached"])).alias("attachments"),
    )


def read_chat(formatted: DataFrame) -> DataFrame:
    """Formatted conversations parsed again: turns (role, text), and the text under the loss spans."""
    pieces = F.slice(F.split("formatted", r"<\|turn\|>", -1), 2, 1 << 30)
    turn = lambda p: F.struct(
        unescape(F.substring_index(p, "\n", 1)).alias("role"),
        unescape(F.substr(p, F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p) - F.length(F.substring_index(p, "\n", 1)) - 1 - len(CLOSE))).alias("text"),
    )
    under = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
    return formatted.withColumn("turns", F.transform(pieces, turn)).withColumn("loss_text", under)


def text_parts(text: Column) -> Column:
    """A plain text as typed parts."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("units")))


def chat_digests(conversations: DataFrame) -> DataFrame:
    """Format plain conversations (conv_id, turn, role, text), read them back and digest what was read."""
    back = read_chat(format_chat(conversations.select("conv_id", "turn", "role", text_parts(F.col("text")).alias("parts"))))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
