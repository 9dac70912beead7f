"""Chat transcripts from event logs: fold, render with reversible escapes, and read back.  Column expressions only.

A log holds events of conversations: ``message`` opens a turn's text, ``delta`` appends to it,
``edit`` replaces it, ``regenerate`` discards it for deltas to come.  Logs are partitioned by
conversation and turn, sorted by sequence, and folded to final messages; messages are then
gathered by conversation and rendered.

Template: every turn is ``### role: text</turn>`` and a newline.  Inside roles and texts ``&``,
``<`` and ``#`` become ``&amp;``, ``&lt;`` and ``&num;`` (in roles ``:`` becomes ``&col;`` too), so
no text can hold a marker, and the reverse gives the text back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
# Characters and their escapes, in the order of escaping; unescaping goes backwards.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("#", "&num;"), (":", "&col;"))
LOSS_ROLE = "assistant"


def escape(text: Column, role: bool = False) -> Column:
    for plain, coded in ESCAPES if role else ESCAPES[:3]:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column, role: bool = False) -> Column:
    for plain, coded in reversed(ESCAPES if role else ESCAPES[:3]):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def messages(events: DataFrame) -> DataFrame:
    """Final messages (conversation, turn, copy, role, text) of a log (conversation, turn, copy, seq, event, role, text).

    Events of one turn apply by seq, equal ones by event, role and text.  What stands before the last ``message``, ``edit`` or
    ``regenerate`` of a turn is gone; a turn's role is that of its last event that names one.  ``copy`` tells apart turns that share a
    number.  Null texts are empty; a null role is empty; a turn of deltas alone is a message.
    """
    event = F.struct("seq", "event", "role", "text")
    log = events.groupBy("conversation", "turn", "copy").agg(F.array_sort(F.collect_list(event)).alias("log"))
    last = F.aggregate(
        "log", F.struct(F.lit(0).alias("at"), F.lit(0).alias("reset"), F.lit("").alias("role")),
        lambda s, x: F.struct(
            (s["at"] + 1).alias("at"),
            F.when(x["event"].isin("message", "edit", "regenerate"), s["at"]).otherwise(s["reset"]).alias("reset"),
            F.coalesce(x["role"], s["role"]).alias("role"),
        ),
    )
    folded = log.select("conversation", "turn", "copy", "log", last.alias("last"))
    kept = F.slice("log", F.col("last.reset") + 1, F.size("log"))
    text = F.array_join(F.transform(kept, lambda x: F.when(x["event"] == "regenerate", "").otherwise(F.coalesce(x["text"], F.lit("")))), "")
    return folded.select("conversation", "turn", "copy", F.col("last.role").alias("role"), text.alias("text"))


def render(final: DataFrame) -> DataFrame:
    """One row for each conversation: formatted text, and the loss mask as spans (start, end; code points) of what assistants say."""
    turn = F.concat(F.lit(OPEN), escape(F.col("role"), True), F.lit(MIDDLE), escape(F.col("text")), F.lit(CLOSE))
    order = Window.partitionBy("conversation").orderBy("turn", "copy", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = final.select("*", turn.alias("shown")).select(
        "*", F.coalesce(F.sum(F.length("shown")).over(order), F.lit(0)).alias("at"), F.count("*").over(order).alias("number")
    )
    end = F.col("at") + F.length("shown") - len(CLOSE)
    each = placed.select("conversation", "number", "shown", F.when(F.col("role") == LOSS_ROLE, F.struct((end - F.length(escape(F.col("text")))).alias("start"), end.alias("end"))).alias("loss"))
    gathered = each.groupBy("conversation").agg(F.array_sort(F.collect_list(F.struct("number", "shown", "loss"))).alias("turns"))
    return gathered.select(
        "conversation",
        F.array_join(F.transform("turns", lambda t: t["shown"]), "").alias("formatted"),
        F.filter(F.transform("turns", lambda t: t["loss"]), lambda x: x.isNotNull()).alias("loss"),
    )


def read_back(formatted: Column) -> Column:
    """Turns (role, text) that a formatted conversation holds."""
    shown = F.slice(F.split(formatted, CLOSE, -1), F.lit(1), F.size(F.split(formatted, CLOSE, -1)) - 1)

    def turn(x):
        split_at = F.instr(x, MIDDLE)
        role = F.substring(x, F.lit(len(OPEN) + 1), split_at - len(OPEN) - 1)
        text = F.substring(x, split_at + len(MIDDLE), F.length(x))
        return F.struct(unescape(role, True).alias("role"), unescape(text).alias("text"))

    return F.transform(shown, turn)


def under_mask(formatted: Column, loss: Column) -> Column:
    """Unescaped text under the loss mask, nothing between its spans."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def format_conversations(events: DataFrame) -> DataFrame:
    """Fold and render a log: conversation, formatted, loss.  An empty log gives no rows; a null conversation is one of its own."""
    return render(messages(events))
