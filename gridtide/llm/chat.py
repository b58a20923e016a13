"""Conversations as training windows with a loss mask, DataFrame functions only.

Method: budgeted windows.  Prefix sums of the turns' tokens choose spans of
whole turns; every window keeps the conversation's system turn, repeats a
limited history before its span, and the repeated turns are masked, so each
assistant turn is a target once.

A turn is written ``<turn ROLE>TEXT</turn>`` and a line break.  Inside roles and
texts ``\\``, ``<`` and ``>`` are written ``\\b``, ``\\l`` and ``\\g``: no text can
hold a mark, and reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tokens of a window, and of them those for repeated history.
BUDGET = 2048
HISTORY = 256
OPEN, CLOSE, END = "<turn ", ">", "</turn>\n"


def escape(text: Column) -> Column:
    for plain, written in (("\\", "\\b"), ("<", "\\l"), (">", "\\g")):
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for plain, written in ((">", "\\g"), ("<", "\\l"), ("\\", "\\b")):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def format_windows(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv, window, n_context, n_turns, n_tokens, text, loss) of every conversation.

    ``window`` counts from 1.  A window's text begins with ``n_context`` repeated
    turns (the system turn, then history), followed by ``n_turns`` turns of its
    own; ``loss`` holds the (start, end) of its own assistant texts in code
    points, end exclusive.  A turn's tokens are estimated as a quarter of its
    written characters, rounded up.  A window has at most ``budget`` tokens
    unless one turn alone takes more than its share, then that turn is a span
    of its own.  History is the turns right before the span that together have
    at most ``history`` tokens.

    Turns are in order of ``turn`` (null first), then role, then text; equal
    rows are turns of their own.  Null roles and texts are empty; null
    conversations are one conversation; empty tables give no windows.  Other
    columns are not read.
    """
    rows = turns.select(
        F.col(conv).alias("_conv"), F.col(turn).alias("_turn"), F.coalesce(role, F.lit("")).alias("_role"), F.coalesce(text, F.lit("")).alias("_text")
    )
    head = F.concat(F.lit(OPEN), escape(F.col("_role")), F.lit(CLOSE))
    rows = rows.select("*", head.alias("_head"), escape(F.col("_text")).alias("_body"))
    size = F.length("_head") + F.length("_body") + len(END)
    rows = rows.select("*", size.cast("long").alias("_size"), F.ceil(size / 4).alias("_tokens"))
    own = Window.partitionBy("_conv").orderBy("_turn", "_role", "_text")
    whole = Window.partitionBy("_conv")
    rows = rows.select("*", F.row_number().over(own).alias("_n"), F.sum("_tokens").over(own.rowsBetween(Window.unboundedPreceding, 0)).alias("_stop"))
    rows = rows.withColumn("_system", (F.col("_n") == 1) & (F.col("_role") == "system"))
    kept = F.max(F.when(F.col("_system"), F.col("_tokens")).otherwise(0)).over(whole)
    share = F.greatest(F.floor((F.lit(budget - history) - kept) / 2), F.lit(1))
    rows = rows.select("*", share.alias("_share")).withColumn("_long", F.col("_tokens") > F.col("_share"))
    # Long turns stand alone; between them, turns that begin in the same half budget are a span.
    fresh = (F.col("_long") | F.coalesce(F.lag("_long").over(own), F.lit(False))).cast("int")
    rows = rows.select("*", fresh.alias("_fresh"))
    rows = rows.withColumn("_part", F.sum("_fresh").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    begin = F.col("_stop") - F.col("_tokens")
    rows = rows.withColumn("_cell", F.floor((begin - F.min(begin).over(Window.partitionBy("_conv", "_part"))) / F.col("_share")))
    rows = rows.withColumn("_window", F.dense_rank().over(Window.partitionBy("_conv").orderBy("_part", "_cell")))
    rows = rows.select("*", F.max("_window").over(whole).alias("_windows"), F.max("_stop").over(Window.partitionBy("_conv", "_window")).alias("_span_stop"))
    repeated = (
        F.when(F.col("_system"), F.when(F.col("_windows") > 1, F.sequence(F.lit(2), F.col("_windows"))))
        .when((F.col("_window") < F.col("_windows")) & (F.col("_span_stop") - begin <= history), F.array(F.col("_window") + 1))
    )
    places = F.concat(F.array(F.col("_window")), F.coalesce(repeated, F.array().cast("array<int>")))
    placed = rows.select("_conv", "_n", "_role", "_head", "_body", "_size", "_tokens", F.col("_window").alias("_home"), F.explode(places).alias("window"))
    inside = Window.partitionBy("_conv", "window").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("_from", F.sum("_size").over(inside) - F.col("_size") + F.length("_head"))
    mine = F.col("_home") == F.col("window")
    target = F.when(mine & (F.col("_role") == "assistant"), F.struct(F.col("_from").alias("start"), (F.col("_from") + F.length("_body")).alias("end")))
    pieces = F.array_sort(F.collect_list(F.struct("_n", F.concat("_head", "_body", F.lit(END)).alias("t"))))
    return placed.groupBy(F.col("_conv").alias(conv), "window").agg(
        F.count(F.when(~mine, 1)).alias("n_context"),
        F.count(F.when(mine, 1)).alias("n_turns"),
        F.sum("_tokens").alias("n_tokens"),
        F.array_join(F.transform(pieces, lambda x: x["t"]), "").alias("text"),
        F.array_sort(F.collect_list(target)).alias("loss"),
    )


def read_windows(windows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, turns, targets, formatted_chars): what the windows of each conversation say.

    ``turns`` are the (role, text) of all turns in order, each once; ``targets``
    the texts under the loss mask in order.  Only the formatted text, the mask
    and the number of repeated turns are read.
    """
    lines = F.split("text", END)
    own = F.slice(lines, F.col("n_context").cast("int") + 1, F.size(lines) - 1 - F.col("n_context").cast("int"))
    head = lambda x: F.substring_index(x, CLOSE, 1)
    turns = F.transform(
        own,
        lambda x: F.struct(
            unescape(head(x).substr(F.lit(len(OPEN) + 1), F.length(x))).alias("role"),
            unescape(x.substr(F.length(head(x)) + 2, F.length(x))).alias("text"),
        ),
    )
    targets = F.transform("loss", lambda s: unescape(F.col("text").substr((s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    read = windows.select(F.col(conv), "window", turns.alias("turns"), targets.alias("targets"), F.length("text").alias("chars"))
    in_order = F.array_sort(F.collect_list(F.struct("window", "turns", "targets")))
    joined = read.groupBy(conv).agg(in_order.alias("all"), F.sum("chars").alias("formatted_chars"))
    return joined.select(
        conv,
        F.flatten(F.transform("all", lambda w: w["turns"])).alias("turns"),
        F.flatten(F.transform("all", lambda w: w["targets"])).alias("targets"),
        "formatted_chars",
    )
