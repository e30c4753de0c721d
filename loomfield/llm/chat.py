"""Chat formatting: render, parse again, escape until the parse equals the source.

A rendered conversation is a sequence of turns

    <s>[INST] role [/INST]\n text </s>\n      (text as it is)
    <s>[INST] role [/INST]\\\n text </s>\n    (a backslash before the line end: role and text are escaped)

The grammar is deterministic: a turn ends at the first end mark, and what
holds a control string isn't a turn.  Texts that
hold a control string do not come back from the first rendering; their turns
are escaped (a backslash is put into each control string, backslashes are
doubled) and the conversation is parsed again.  `identical` reports the
comparison; after escaping it holds for every input.

Rows of one conversation are ordered by turn, role and text; null text and
null role are empty strings, a null conversation id is an id of its own, a
repeated turn is a turn of its own, a conversation without rows has no row,
extra columns are ignored.  One conversation is one string, so its rows must
meet in one task; conversations do not.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The control strings of the template.
BEGIN, HEAD_END, END = "<s>[INST] ", " [/INST]", "</s>\n"
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")


def escape(text: Column) -> Column:
    """Reversible: no control string and no line end directly after a head is left."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    """Single backslashes stand only inside broken control strings, all others are doubled."""
    out = text
    for c in CONTROL:
        out = F.replace(out, F.lit(c[0] + "\\" + c[1:]), F.lit(c))
    return F.replace(out, F.lit("\\\\"), F.lit("\\"))


def _render(turns: Column, escaped) -> Column:
    """escaped: turn -> Column, whether this turn is escaped."""
    one = lambda t: F.when(
        escaped(t), F.concat(F.lit(BEGIN), escape(t["role"]), F.lit(HEAD_END + "\\\n"), escape(t["text"]), F.lit(END))
    ).otherwise(F.concat(F.lit(BEGIN), t["role"], F.lit(HEAD_END + "\n"), t["text"], F.lit(END)))
    return F.array_join(F.transform(turns, one), "")


def parse(formatted: Column) -> Column:
    """Array of (role, text, body_start, body_length) in the formatted string's code points; what isn't a turn gives a null role."""
    pieces = F.split(formatted, "</s>\n", -1)
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(p: Column) -> Column:
        rest = F.when(p.startswith(BEGIN), F.substr(p, F.lit(len(BEGIN) + 1)))
        at = F.instr(rest, HEAD_END)
        tail = F.substr(rest, at + len(HEAD_END))
        raw = F.substr(tail, F.lit(1), F.lit(1)) == "\n"
        role, body = F.substr(rest, F.lit(1), at - 1), F.substr(tail, F.when(raw, F.lit(2)).otherwise(F.lit(3)))
        inside = F.concat(role, F.lit("\n"), body)
        role = F.when((at > 0) & ~_holds_control(inside), role)
        return F.struct(F.when(raw, role).otherwise(unescape(role)).alias("role"), F.when(raw, body).otherwise(unescape(body)).alias("text"), F.length(p).alias("piece"), F.length(body).alias("length"))

    return F.transform(pieces, turn)


def _bodies(parsed: str) -> Column:
    """Add where each body starts (0-based code points): pieces and end marks before it."""
    ends = F.transform(parsed, lambda t, i: F.aggregate(F.slice(parsed, 1, i + 1), F.lit(0).cast("int"), lambda a, x: a + x["piece"] + len(END)))
    return F.transform(F.arrays_zip(F.col(parsed).alias("t"), ends.alias("e")), lambda x: F.struct(x["t"]["role"].alias("role"), x["t"]["text"].alias("text"), (x["e"] - len(END) - x["t"]["length"]).alias("start"), x["t"]["length"].alias("length")))


def _plain(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def format_chats(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """One row a conversation: conv_id, formatted, turns (as parsed), loss_spans (start, length of each `learn` body), identical."""
    fields = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    convs = rows.groupBy(F.col(conv_id).alias("conv_id")).agg(F.sort_array(F.collect_list(fields)).alias("source"))
    plain = convs.withColumn("formatted", _render(F.col("source"), lambda t: F.lit(False))).withColumn("parsed", parse(F.col("formatted")))
    # Round two: turns that did not come back.  Counts differ if a text holds an end mark, so turns are tested by their own rendering.
    clash = lambda t: ~_survives(t)
    again = F.when(_plain(F.col("parsed")) == _plain(F.col("source")), F.col("formatted")).otherwise(_render(F.col("source"), clash))
    final = plain.withColumn("formatted", again).withColumn("parsed", parse(F.col("formatted")))
    final = final.withColumn("turns", _bodies("parsed")).withColumn("identical", _plain(F.col("turns")) == _plain(F.col("source")))
    spans = F.transform(F.filter("turns", lambda t: t["role"] == learn), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))
    return final.withColumn("loss_spans", spans).select("conv_id", "formatted", "turns", "loss_spans", "identical")


def _survives(t: Column) -> Column:
    """Whether a turn rendered as it is parses back to itself: none of the strings that the parser looks for is inside."""
    return ~_holds_control(F.concat(t["role"], F.lit("\n"), t["text"]))


def _holds_control(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.instr(text, c) > 0 for c in CONTROL])


def read_back(chats: DataFrame) -> DataFrame:
    """Digests of what the formatted strings themselves hold: parsed turns, and the unescaped text under the loss mask."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    # The mask covers bodies as formatted; a backslash before the body's line end tells that it is escaped.
    under = F.array_join(
        F.transform(
            "loss_spans",
            lambda s: F.when(F.substr("formatted", s["start"] - 1, F.lit(1)) == "\\", unescape(F.substr("formatted", s["start"] + 1, s["length"]))).otherwise(F.substr("formatted", s["start"] + 1, s["length"])),
        ),
        "",
    )
    out = chats.withColumn("_loss", under)
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "identical",
    )
