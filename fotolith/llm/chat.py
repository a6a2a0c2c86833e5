"""Chat formatting with a grammar round trip, in DataFrame expressions only.

Grammar of a formatted conversation::

    conversation = { turn }
    turn         = "<s>[INST]" role "[/INST]" text "</s>"

``role`` and ``text`` contain none of the four control strings. The parser is
deterministic: it splits at ``</s>``, checks the opening, splits once at
``[/INST]``, refuses control strings inside, and undoes escapes. Every
conversation is first rendered raw and parsed again. Where the recovered turns
differ from the source, its contents are escaped and it is rendered and parsed
once more, until both are identical; a conversation that still differs raises.

Escaping adds one backslash after the first character of a control string that
may already hold backslashes (``</s>`` to ``<\\/s>``, ``<\\/s>`` to ``<\\\\/s>``), so
escaped text never contains a control string and the way back is unique.

Defined results: null texts and null roles are empty strings; turns are ordered
by turn (null first), then role and text; repeated rows are kept as turns of
their own; a null conv_id is a conversation; an empty table gives no rows; extra
columns are not read. One conversation becomes one row, which is the unit of
the result: it has to fit a Spark row, so turns of a conversation meet in one
task, after lists were built on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<s>[INST]", "[/INST]", "</s>"
#: Java regular expressions of control strings: bare, with any backslashes, with one at least.
BARE = r"[<\[](?:/?s>|/?INST\])"
ANY = r"([<\[])(\\*)(/?s>|/?INST\])"
ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\])"
#: Times that content is escaped at most; one is always enough.
ROUNDS = 1


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ANY, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def collect_turns(rows: DataFrame) -> DataFrame:
    """``conv_id, turns``: the ordered role and text of each conversation."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return (
        rows.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(turn)).alias("turns"))
        .select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    )


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE))), "")


def cut(formatted: Column) -> Column:
    """The turns of a formatted conversation, each without its closing string."""
    parts = F.split(formatted, CLOSE, -1)
    return F.slice(parts, 1, F.size(parts) - 1)


def parse(formatted: Column) -> Column:
    """The recovered turns; role and text are null where the grammar is broken."""

    def one(piece: Column) -> Column:
        body = F.split(F.substring(piece, len(OPEN) + 1, F.length(piece)), r"\[/INST\]", 2)
        role, text = F.get(body, 0), F.get(body, 1)
        sound = F.startswith(piece, F.lit(OPEN)) & (F.size(body) == 2) & ~F.rlike(role, F.lit(BARE)) & ~F.rlike(text, F.lit(BARE))
        return F.struct(F.when(sound, unescape(role)).alias("role"), F.when(sound, unescape(text)).alias("text"))

    return F.transform(cut(formatted), one)


def mask(formatted: Column) -> Column:
    """The loss mask: per turn the code points before, under and after the loss, the closing string included."""

    def one(piece: Column) -> Column:
        head = F.locate(MIDDLE, piece) + len(MIDDLE) - 1
        hit = F.startswith(piece, F.lit(f"{OPEN}assistant{MIDDLE}"))
        whole = F.length(piece) + len(CLOSE)
        under = F.when(hit, F.length(piece) - head).otherwise(0)
        return F.struct(
            F.when(hit, head).otherwise(whole).alias("before"), under.alias("loss"), F.when(hit, F.lit(len(CLOSE))).otherwise(0).alias("after")
        )

    return F.transform(cut(formatted), one)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the mask, unescaped and joined."""
    pairs = F.zip_with(cut(formatted), spans, lambda p, m: unescape(F.substring(p, m["before"] + 1, m["loss"])))
    return F.array_join(pairs, "")


def format_conversations(rows: DataFrame) -> DataFrame:
    """``conv_id, formatted, turns, mask, escaped`` of ``rows(conv_id, turn, role, text)``.

    ``turns`` are those read back from ``formatted``; they are checked to equal
    the source.
    """
    df = collect_turns(rows)
    df = df.withColumn("formatted", render(F.col("turns")))
    df = df.withColumn("escaped", ~parse(F.col("formatted")).eqNullSafe(F.col("turns")))
    for _ in range(ROUNDS):
        safe = F.transform("turns", lambda t: F.struct(escape(t["role"]).alias("role"), escape(t["text"]).alias("text")))
        df = df.withColumn("formatted", F.when(F.col("escaped"), render(safe)).otherwise(F.col("formatted")))
    df = df.withColumn("back", parse(F.col("formatted")))
    turns = F.when(F.col("back").eqNullSafe(F.col("turns")), F.col("back")).otherwise(F.raise_error(F.lit("chat: a conversation does not survive the round trip")))
    return df.select("conv_id", "formatted", turns.alias("turns"), mask(F.col("formatted")).alias("mask"), "escaped")
