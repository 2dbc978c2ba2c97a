"""Chat formatting by event-sourced reconstruction, with DataFrame functions only.

Events of a conversation are partitioned by conversation and folded in sequence order into final messages:

* ``message``     starts message `message` with its role and text, replacing what it had;
* ``delta``       appends streamed text to it;
* ``edit``        replaces its text;
* ``regenerate``  replaces its text and voids all earlier events of later messages.

The fold is written with window functions (running counts of resets, running maxima of regenerations), so that a
long conversation is sorted and spilled by Spark and never folded in Python.

Template: every turn is ``<turn>`` role newline text ``</turn>`` newline. A control string inside a text gets one
more backslash behind its ``<`` (``</turn>`` becomes ``<\\/turn>``, ``<\\/turn>`` becomes ``<\\\\/turn>``), which is
undone exactly on reading.

Edge cases: null text is empty; null role is empty; null kind is ``message``; a null conversation id is a
conversation of its own; null sequence numbers come first; events with equal sequence numbers are ordered by kind,
role and text; repeated rows are repeated events; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<turn>", "</turn>\n"
KINDS = ("message", "delta", "edit", "regenerate")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*/?turn>)", r"<\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*/?turn>)", "<$1")


def escape_role(role: Column) -> Column:
    """A role takes one line: backslashes are doubled and newlines become backslash n."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    kept = F.regexp_replace(unescape(role), r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
    return F.replace(kept, F.lit("\\\\"), F.lit("\\"))


def reconstruct(events: DataFrame) -> DataFrame:
    """(conv_id, seq, message, kind, role, text) -> (conv_id, message, role, text): one row for each final message."""
    e = events.select(
        "conv_id", "seq", "message", F.coalesce("kind", F.lit("message")).alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text")
    )
    later = Window.partitionBy("conv_id").orderBy("message").rangeBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("void", F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).over(later))
    e = e.filter(F.col("void").isNull() | (F.col("seq") > F.col("void")))
    order = [F.col(c).asc_nulls_first() for c in ("seq", "kind", "role", "text")]
    upto = Window.partitionBy("conv_id", "message").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("conv_id", "message")
    e = e.withColumn("version", F.sum(F.when(F.col("kind") == "delta", 0).otherwise(1)).over(upto))
    e = e.withColumn("said", F.last("role", ignorenulls=True).over(upto)).withColumn("at", F.count(F.lit(1)).over(upto))
    e = e.withColumn("final", F.max("version").over(whole)).filter(F.col("version") == F.col("final"))
    parts = F.sort_array(F.collect_list(F.struct("at", "text")))
    return e.groupBy("conv_id", "message").agg(
        F.coalesce(F.max_by("said", "at"), F.lit("")).alias("role"), F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text")
    )


def render(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, message, role, text) -> (conv_id, formatted, loss): one row a conversation, its text and loss mask.

    loss has, for each turn whose role is learned, its index, the code point span [start, end) in formatted, and the
    same span counted from the turn's own start.
    """
    order = Window.partitionBy("conv_id").orderBy("message")
    role, text = escape_role(F.col("role")), escape(F.col("text"))
    m = messages.select("conv_id", "message", F.col("role").isin(*loss_roles).alias("learned"), role.alias("role"), text.alias("text"))
    m = m.withColumn("turn", F.row_number().over(order) - 1)
    m = m.withColumn("start", F.char_length("role") + len(OPEN) + 1).withColumn("end", F.col("start") + F.char_length("text"))
    m = m.withColumn("before", F.coalesce(F.sum(F.col("end").cast("long") + len(CLOSE)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    span = F.struct("turn", (F.col("before") + F.col("start")).alias("start"), (F.col("before") + F.col("end")).alias("end"), F.col("start").alias("own_start"), F.col("end").alias("own_end"))
    m = m.withColumn("rendered", F.concat(F.lit(OPEN), "role", F.lit("\n"), "text", F.lit(CLOSE)))
    rows = m.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "rendered", F.when(F.col("learned"), span).alias("span")))).alias("rows"))
    return rows.select(
        "conv_id",
        F.array_join(F.transform("rows", lambda r: r["rendered"]), "").alias("formatted"),
        F.transform(F.filter("rows", lambda r: r["span"].isNotNull()), lambda r: r["span"]).alias("loss"),
    )


def parse(formatted: DataFrame) -> DataFrame:
    """Reads (conv_id, formatted, loss) back: adds turns (role, text) and loss_text, the unescaped text under the mask."""
    chunks = F.split("formatted", CLOSE)
    df = formatted.withColumn("chunks", F.slice(chunks, 1, F.greatest(F.size(chunks) - 1, F.lit(0))))
    body = F.transform("chunks", lambda c: F.substring(c, len(OPEN) + 1, 2**31 - 1))
    turns = F.transform(
        body,
        lambda b: F.struct(
            unescape_role(F.substring_index(b, "\n", 1)).alias("role"),
            unescape(F.substr(b, F.locate("\n", b) + 1)).alias("text"),
        ),
    )
    said = F.transform("loss", lambda s: unescape(F.substr(F.get("chunks", s["turn"]), s["own_start"] + 1, s["own_end"] - s["own_start"])))
    return df.select("conv_id", "formatted", "loss", turns.alias("turns"), F.array_join(said, "").alias("loss_text"))


def turn_events(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) rows as events: each row is a message, in order of turn, then role and text."""
    order = Window.partitionBy("conv_id").orderBy(*[F.col(c).asc_nulls_first() for c in ("turn", "role", "text")])
    n = F.row_number().over(order).cast("long")
    return rows.select("conv_id", n.alias("seq"), n.alias("message"), F.lit("message").alias("kind"), "role", "text")
