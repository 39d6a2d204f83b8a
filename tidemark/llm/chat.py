"""Chat formatting by prefix-target expansion, in DataFrame functions only.

A turn is written as ``### role: text</turn>`` and a line feed. Inside roles and
texts the characters that the template uses are escaped (a backslash and a
letter), so no text can look like a mark, and the escapes are undone exactly.

Every assistant turn becomes an example of its own: all turns before it are the
context, and only the reply's text is under the loss mask (``loss_start`` to
``loss_end``, code points). A conversation that does not end with an assistant
turn has one more row, its whole text with no mask, so no turn is lost.

Results for odd input: null roles and texts are empty; turns of equal number come
in order of role and text, repeated rows are repeated turns; rows without a
conversation id form one conversation; an empty table gives no examples; other
columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TARGET = "assistant"
HEAD, MID, TAIL = "### ", ": ", "</turn>\n"

# Fixed values of the template: each reserved character and its escape. The backslash
# is escaped first and restored last; ":" and line feeds are reserved in roles alone.
IN_TEXT = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))
IN_ROLE = (*IN_TEXT, (":", "\\c"), ("\n", "\\n"))


def escape(text: Column, table=IN_TEXT) -> Column:
    for plain, code in table:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, table=IN_TEXT) -> Column:
    for plain, code in reversed(table):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def expand(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Examples ``conv_id``, ``example`` (1, 2, ...), ``text``, ``loss_start``, ``loss_end``, ``last``.

    ``last`` marks the row that holds the whole conversation. A conversation's
    turns meet in one row, because its formatted text is one value.
    """
    none = F.lit("")
    one = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), none).alias("role"), F.coalesce(F.col(text_col), none).alias("text"))
    grouped = turns.select(F.col(id_col).alias("conv_id"), one.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    written = grouped.select(
        "conv_id",
        F.transform(
            "turns",
            lambda t: F.struct(
                (t["role"] == TARGET).alias("target"),
                F.concat(F.lit(HEAD), escape(t["role"], IN_ROLE), F.lit(MID)).alias("head"),
                escape(t["text"]).alias("body"),
            ),
        ).alias("turns"),
    )
    ends = written.select(
        "conv_id",
        "turns",
        F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.get("turns", i - 1)["target"] | (i == F.size("turns"))).alias("ends"),
    )
    each = ends.select("conv_id", "turns", F.posexplode("ends").alias("k", "end"))
    before = F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("end") - 1), lambda t: F.concat(t["head"], t["body"], F.lit(TAIL))), "")
    parts = each.select("conv_id", (F.col("k") + 1).alias("example"), before.alias("context"), F.get("turns", F.col("end") - 1).alias("t"), (F.col("end") == F.size("turns")).alias("last"))
    start = F.length("context") + F.length("t.head")
    return parts.select(
        "conv_id",
        "example",
        F.concat("context", "t.head", "t.body", F.lit(TAIL)).alias("text"),
        F.when(F.col("t.target"), start).alias("loss_start"),
        F.when(F.col("t.target"), start + F.length("t.body")).alias("loss_end"),
        "last",
    )


def read_turns(text: Column) -> Column:
    """The turns of a formatted text: an array of ``role`` and ``text``, unescaped."""
    # No escaped text holds "<", so the tail splits exactly; the last piece is empty.
    pieces = F.filter(F.split(text, TAIL), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substring_index(F.substring(p, len(HEAD) + 1, 1 << 30), MID, 1), IN_ROLE).alias("role"),
            unescape(F.substr(p, F.instr(p, MID) + len(MID))).alias("text"),
        ),
    )


def loss_text(text: str = "text") -> Column:
    """The text under the loss mask, unescaped; null where there is no mask."""
    return unescape(F.substr(F.col(text), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
