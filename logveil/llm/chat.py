"""Chat formatting by prefix-target expansion.

Each assistant turn becomes an example of its own: all preceding turns are its
context and only that reply is trainable.  Turns after the last reply, or a
conversation without a reply, make one more example with nothing to train, so
that the output holds every turn.

The template is `<|im_start|>role\\ntext<|im_end|>\\n`.  Inside roles and texts a
backslash is put into each `<|` (and one more into `<\\|`, `<\\\\|`, ...), so no
text can hold a control string and the escape can be undone exactly.

Defined results: null texts and roles are empty; turns are ordered by turn
(null first), then role, then text, so ties and repeated rows have one order; a
null conv_id is a conversation like any other; an empty table gives no example;
other columns of the input are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    """Roles also lose their line breaks, which would end the header."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def expand(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) to examples.

    Columns: conv_id; example (from 0); n_turns of the example; formatted; loss_start and
    loss_end (the trainable span in code points of `formatted`; null without a target).
    """
    body, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    part = F.concat(F.lit(START), _escape_role(role), F.lit("\n"), escape(body), F.lit(f"{END}\n"))
    rows = turns.select("conv_id", F.struct(F.col("turn").alias("turn"), role.alias("role"), body.alias("body"), part.alias("part"), F.length(escape(body)).alias("chars")).alias("__turn"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("__turn")).alias("__turns"))
    size = F.size("__turns")
    last = F.transform("__turns", lambda t, i: F.when((t["role"] == "assistant") | (i == size - 1), F.struct((i + 1).alias("n"), (t["role"] == "assistant").alias("target"))))
    examples = grouped.select("conv_id", "__turns", F.posexplode(F.array_compact(last)).alias("example", "__last"))
    n = F.col("__last.n")
    texts = F.transform(F.slice("__turns", F.lit(1), n), lambda t: t["part"])
    end = F.length("formatted") - len(END) - 1
    shaped = examples.select("conv_id", "example", n.alias("n_turns"), F.array_join(texts, "").alias("formatted"), F.when(F.col("__last.target"), F.element_at("__turns", n)["chars"]).alias("__chars"))
    return shaped.select("conv_id", "example", "n_turns", "formatted", F.when(F.col("__chars").isNotNull(), end - F.col("__chars")).alias("loss_start"), F.when(F.col("__chars").isNotNull(), end).alias("loss_end"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted example, as an array of (role, text)."""
    parts = F.split(F.substring(formatted, F.lit(len(START) + 1), F.length(formatted)), r"<\|im_start\|>")
    return F.transform(
        F.filter(parts, lambda p: p != ""),
        lambda p: F.struct(
            _unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(F.substring(p, F.instr(p, "\n") + 1, F.length(p) - F.instr(p, "\n") - len(END) - 1)).alias("text"),
        ),
    )


def read_loss(formatted: Column, start: Column, end: Column) -> Column:
    """The text under the loss mask; null without one."""
    return F.when(start.isNotNull(), unescape(F.substring(formatted, start + 1, end - start)))
