"""Chat formatting by a grammar that is checked by reading it back.

A conversation is written as turns ``<s>[TAG]body</s>``. TAG is USER, OUT (assistant), SYS or
``ROLE:name``, and ends in ``~`` where the turn is escaped. A text is first written as it is. A deterministic parser
reads the turn back; one that it can't recover, or that holds a control string, is written again with its
control characters escaped. The whole conversation is then read back from its formatted text, which gives the turns of the result; the job fails if one differs from
its source.

Everything is a DataFrame expression. A turn can be tried on its own because the grammar allows ``</s>`` nowhere but at the end of a turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the template: tags by role, and the strings that a text must not hold unescaped.
TAGS = {"user": "USER", "assistant": "OUT", "system": "SYS"}
CONTROL = r"</?s>|\[/?(?:INST|SYS|USER|OUT|ROLE)[^\]]*\]|<</?SYS>>|<\|"
#: Control characters and their escapes; the tilde goes first when escaping and last when reading.
ESCAPES = (("~", "~0"), ("<", "~1"), ("[", "~2"), ("]", "~3"), ("|", "~4"), (":", "~5"))


def escape(text: Column) -> Column:
    for raw, safe in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for raw, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def render(role: Column, text: Column, escaped: Column) -> Column:
    """A turn as text."""
    tag = F.concat(F.lit("ROLE:"), escape(role))
    for name, short in TAGS.items():
        tag = F.when(role == name, F.lit(short)).otherwise(tag)
    return F.concat(F.lit("<s>["), tag, F.when(escaped, F.lit("~#")).otherwise(F.lit("")), F.lit("]"), F.when(escaped, escape(text)).otherwise(text), F.lit("</s>"))


def parse(turn: Column) -> Column:
    """Reads a turn back: struct of role, text, escaped and body; null where it doesn't follow the grammar."""
    part = lambda k: F.regexp_extract(turn, r"(?s)\A<s>\[([A-Z]+(?::[^\]]*?)?)(~#)?\](.*)</s>\z", k)
    return F.when(
        turn.rlike(r"(?s)\A<s>\[([A-Z]+(?::[^\]]*?)?)(~#)?\].*</s>\z") & ~part(3).rlike(CONTROL),
        F.struct(_role(part(1)).alias("role"), F.when(part(2) == "~#", unescape(part(3))).otherwise(part(3)).alias("text"), (part(2) == "~#").alias("escaped"), part(3).alias("body")),
    )


def _role(tag: Column) -> Column:
    role = unescape(F.substring(tag, 6, 2**31 - 1))
    for name, short in TAGS.items():
        role = F.when(tag == short, F.lit(name)).otherwise(role)
    return role


def format_chats(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation: conversation, formatted, n_turns, turns and loss_spans.

    ``turns`` of the result is what the parser read back from ``formatted``, in order (role, text, and the span of
    its body as start and length in code points, from 1); loss_spans are the bodies of assistant turns with whether they are escaped. Turns are
    ordered by turn, then role and text, so ties and repeated rows keep a fixed place; all rows count. A null role or text is
    an empty one; rows without a conversation id form the conversation null. An empty table gives no rows. A conversation is one row
    of the result, so it must fit a row; conversations are spread over the tasks. Other columns are ignored."""
    said = turns.select(F.col(conversation).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # first round: as it is; what the parser doesn't give back is escaped
    first = said.withColumn("got", parse(render(F.col("role"), F.col("text"), F.lit(False))))
    hard = ~(F.col("got.role").eqNullSafe(F.col("role")) & F.col("got.text").eqNullSafe(F.col("text")))
    second = first.select("conv", "turn", "role", "text", render(F.col("role"), F.col("text"), hard).alias("line"))
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    body = F.length(parse(F.col("line"))["body"]).cast("long")
    placed = second.select(
        "conv", "line", "role", "text", F.row_number().over(order).alias("pos"), body.alias("len"), hard_line(F.col("line")).alias("escaped"),
        F.sum(F.length("line").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("end"),
    )
    placed = placed.withColumn("start", F.col("end") - F.col("len") - 3)
    all_turns = F.array_sort(F.collect_list(F.struct("pos", "line", "role", "text", "escaped", "start", "len")))
    whole = placed.groupBy("conv").agg(all_turns.alias("t")).withColumn("formatted", F.array_join(F.col("t.line"), ""))
    whole = whole.withColumn("back", read_back(F.col("formatted")))
    same = F.col("back.role").eqNullSafe(F.col("t.role")) & F.col("back.text").eqNullSafe(F.col("t.text"))
    whole = whole.withColumn("back", F.when(same, F.col("back")).otherwise(F.raise_error(F.lit("a conversation doesn't survive its round trip"))))
    span = lambda x: F.struct(x["start"].alias("start"), x["len"].alias("len"), x["escaped"].alias("escaped"))
    return whole.select(
        F.col("conv").alias(conversation),
        "formatted",
        F.size("back").cast("long").alias("n_turns"),
        F.transform(F.arrays_zip("back", "t"), lambda x: F.struct(x["back"]["role"].alias("role"), x["back"]["text"].alias("text"), x["t"]["start"].alias("start"), x["t"]["len"].alias("len"))).alias("turns"),
        F.transform(F.filter("t", lambda x: x["role"] == "assistant"), span).alias("loss_spans"),
    )


def hard_line(line: Column) -> Column:
    """Whether a rendered turn is escaped."""
    return F.regexp_extract(line, r"(?s)\A<s>\[[A-Z]+(?::[^\]]*?)?(~#)?\]", 1) == "~#"


def read_back(formatted: Column) -> Column:
    """The deterministic parser on a whole conversation: an array of parsed turns."""
    lines = F.filter(F.split(formatted, "(?<=</s>)"), lambda x: x != "")
    return F.transform(lines, parse)


def read_span(formatted: Column, span: Column) -> Column:
    """The text under a loss span of a whole conversation, unescaped."""
    body = F.substring(formatted, span["start"].cast("int"), span["len"].cast("int"))
    return F.when(span["escaped"], unescape(body)).otherwise(body)
