"""Chat formatting by prefix-target expansion, in SQL functions only.

Every assistant turn becomes an example of its own: all turns before it are context, and of the
whole only that reply is trainable. A conversation that doesn't end in an assistant turn has one
more example without trainable text, so that no turn is lost. An example is a string and the
code points of it (start, length) that the loss counts.

Examples hold all preceding turns, so the output grows with the square of a conversation's
turns; that is what the method asks for. A conversation is one row while it is formatted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A turn is BEGIN, role, MIDDLE, text, END.
BEGIN, MIDDLE, END = "<s>[INST] ", " [/INST] ", "</s>"
#: Strings that steer a reader of the output; in roles and texts they are broken up by MARK + "1".
CONTROL = ("</s>", "<s>", "[INST]", "[/INST]")
MARK = "\ue000"
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    """text without any control string; unescape() gives it back."""
    text = F.replace(text, F.lit(MARK), F.lit(MARK + "0"))
    for c in CONTROL:
        text = F.replace(text, F.lit(c), F.lit(f"{c[0]}{MARK}1{c[1:]}"))
    return text


def unescape(text: Column) -> Column:
    """The text that escape() was given: a MARK is always followed by 0 or 1 there, so neither step sees what isn't its own."""
    return F.replace(F.replace(text, F.lit(MARK + "1"), F.lit("")), F.lit(MARK + "0"), F.lit(MARK))


def format_conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Examples of every conversation: conv_id, example (from 1), context_turns, formatted, loss_start, loss_length (code points, from 0).

    Turns are ordered by turn, nulls first, then role and text, so repeated and tied rows have a
    place; null roles and texts count as empty; each row with a null conv_id is a conversation of
    its own, as nothing says which of them belong together. An empty table gives no rows; other
    columns are ignored.
    """
    rows = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    whole = rows.filter("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    lost = rows.filter("conv_id is null")
    if not lost.isEmpty():  # a union would hide that conversations are dealt by id already, which read_back() makes use of
        whole = whole.unionByName(lost.select("conv_id", F.array("t").alias("ts")))
    whole = whole.select(
        "conv_id",
        F.transform("ts", lambda t: F.concat(F.lit(BEGIN), escape(t.role), F.lit(MIDDLE), escape(t.text), F.lit(END))).alias("marked"),
        F.transform("ts", lambda t: F.when(t.role == TRAINED_ROLE, F.char_length(escape(t.text))).otherwise(-1)).alias("lengths"),
    )
    places = F.filter(F.sequence(F.lit(1), F.size("marked")), lambda i: (F.element_at("lengths", i) >= 0) | (i == F.size("marked")))
    examples = whole.select("conv_id", "marked", "lengths", F.posexplode(places).alias("p", "k"))
    formatted = examples.select(
        "conv_id",
        (F.col("p") + 1).alias("example"),
        F.col("k").alias("context_turns"),
        F.array_join(F.slice("marked", F.lit(1), F.col("k")), "").alias("formatted"),
        F.greatest(F.element_at("lengths", F.col("k")), F.lit(0)).alias("loss_length"),
    )
    return formatted.select(
        "conv_id",
        "example",
        "context_turns",
        "formatted",
        (F.char_length("formatted") - len(END) - F.col("loss_length")).alias("loss_start"),
        "loss_length",
    )


def read_back(examples: DataFrame) -> DataFrame:
    """What the examples say: conv_id, turns (array of role and text, unescaped), losses (each example's trainable text in order), formatted_chars.

    Examples without conv_id are a conversation each.
    """
    loss = F.struct("example", unescape(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_length"))).alias("text"))
    found = examples.filter("conv_id is not null").groupBy("conv_id").agg(
        F.sort_array(F.collect_list(loss)).alias("losses"),
        F.sum(F.char_length("formatted")).alias("formatted_chars"),
        F.max_by("formatted", "context_turns").alias("last"),
    )
    single = (F.array(loss).alias("losses"), F.char_length("formatted").cast("long").alias("formatted_chars"), F.col("formatted").alias("last"))
    found = found.unionByName(examples.filter("conv_id is null").select("conv_id", *single))
    pieces = F.transform(
        F.filter(F.split("last", "\\Q" + END + "\\E", -1), lambda x: x != ""), lambda x: F.substring(x, F.lit(len(BEGIN) + 1), F.char_length(x))
    )
    turns = F.transform(
        pieces,
        lambda x: F.struct(
            unescape(F.substring_index(x, MIDDLE, 1)).alias("role"),
            unescape(F.substring(x, F.char_length(F.substring_index(x, MIDDLE, 1)) + len(MIDDLE) + 1, F.char_length(x))).alias("text"),
        ),
    )
    return found.select("conv_id", turns.alias("turns"), F.transform("losses", lambda x: x.text).alias("losses"), "formatted_chars")
