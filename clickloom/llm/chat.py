"""Conversations as training windows of bounded size, with a loss mask."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.llm.storage import saved

#: The template. A turn is OPEN role SEPARATOR text CLOSE, role and text escaped.
OPEN, SEPARATOR, CLOSE = "### ", ": ", "</turn>\n"


@dataclass(frozen=True)
class ChatOptions:
    """``budget``: tokens of a window, a token being ``chars_per_token`` characters, begun ones too;
    ``history``: tokens of earlier turns repeated at most. A turn over the budget is a window of its own."""

    budget: int = 512
    history: int = 128
    chars_per_token: int = 4


def escape(text: Column, role: bool = False) -> Column:
    r"""``\`` as ``\\``, ``<`` as ``\l``, ``#`` as ``\h``, in roles ``:`` as ``\c``: no control string is left."""
    for plain, coded in (("\\", "\\\\"), ("<", "\\l"), ("#", "\\h"), (":", "\\c"))[: 4 if role else 3]:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    """The inverse: between pairs of backslashes, each code stands for itself."""
    parts = F.split(text, r"\\\\", -1)

    def plain(part: Column) -> Column:
        for char, coded in (("<", "\\l"), ("#", "\\h"), (":", "\\c")):
            part = F.replace(part, F.lit(coded), F.lit(char))
        return part

    return F.array_join(F.transform(parts, plain), "\\")


def format_conversations(turns: DataFrame, options: ChatOptions = ChatOptions()) -> DataFrame:
    """(conv_id, window, text, repeated, loss, over_budget) of ``turns(conv_id, turn, role, text)``.

    Turns are ordered by number, null first, then role and text. A window has
    the system turns with which the conversation begins, then up to ``history``
    tokens of the turns just before, then new turns while the prefix sum of tokens
    stays within ``budget``; a window has at least one new turn. ``repeated`` is how
    many of its turns, its first ones, an earlier window has had. ``loss`` has
    the spans (start, end, code points of ``text``) of the texts of new
    assistant turns: each is a target once. Null roles and texts are empty;
    texts stay whole, and a window whose system and new turns alone exceed the
    budget says so. A null ``conv_id`` is a conversation. Other columns are
    ignored; an empty table gives no rows.

    Prefix sums and window ends come from window functions over the turns, whose
    frames hold turns of ``history`` or ``budget`` tokens. Of a whole conversation
    only a few numbers a turn meet, for the walk from one window to the next; texts
    are put together window by window.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    coded = F.concat(F.lit(OPEN), escape(role, role=True), F.lit(SEPARATOR), escape(text), F.lit(CLOSE))
    start = F.length(F.concat(F.lit(OPEN), escape(role, role=True), F.lit(SEPARATOR)))
    laid = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), coded.alias("coded"), start.alias("start"))
    laid = laid.withColumn("chars", F.length("coded")).withColumn("tokens", F.ceil(F.col("chars") / options.chars_per_token))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    before = F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")
    numbered = saved(
        laid.select("conv_id", "role", "coded", "start", "chars", "tokens", (F.row_number().over(order) - 1).alias("i"), before.alias("before"))
    )
    windows = _walk(_spans(numbered, options))
    none = F.array().cast("array<int>")
    head = F.when(F.col("head") > 0, F.sequence(F.lit(0), F.col("head") - 1)).otherwise(none)
    places = windows.withColumn("place", F.explode(F.concat(head, F.sequence("history", F.col("end") - 1))))
    held = places.join(numbered.withColumnRenamed("conv_id", "conv"), F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("place") == F.col("i")))
    turn = F.struct("i", "role", "start", "chars", "tokens", "coded")
    whole = held.groupBy("conv_id", "window", "first").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int, end:int>>)").alias("spans")),
        lambda s, t: F.struct(
            (s["at"] + t["chars"]).alias("at"),
            F.when(
                (t["role"] == "assistant") & (t["i"] >= F.col("first")),
                F.concat(
                    s["spans"],
                    F.array(F.struct((s["at"] + t["start"]).alias("start"), (s["at"] + t["chars"] - len(CLOSE)).alias("end"))),
                ),
            ).otherwise(s["spans"]).alias("spans"),
        ),
        lambda s: s["spans"],
    )
    return whole.select(
        "conv_id",
        "window",
        F.array_join(F.transform("turns", lambda t: t["coded"]), "").alias("text"),
        F.size(F.filter("turns", lambda t: t["i"] < F.col("first"))).alias("repeated"),
        spans.alias("loss"),
        (F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + t["tokens"]) > options.budget).alias("over_budget"),
    )


def _spans(numbered: DataFrame, options: ChatOptions) -> DataFrame:
    """For each turn the window that would begin with it: (conv_id, i, head, history, end).

    ``head`` system turns, then the turns from ``history`` on up to ``end``. A turn has
    tokens, so that frames by tokens are short and their order is that of the turns.
    """
    order = Window.partitionBy("conv_id").orderBy("before")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    spoken = F.col("role") != "system"
    turn = F.struct(F.col("i"), F.col("before"))
    framed = numbered.select(
        "conv_id",
        "i",
        "before",
        "tokens",
        F.coalesce(F.min(F.when(spoken, F.col("i"))).over(earlier), "i").alias("head"),
        F.coalesce(F.min(F.when(spoken, F.col("before"))).over(earlier), "before").alias("head_tokens"),
        F.collect_list(turn).over(order.rangeBetween(-options.history, 0)).alias("past"),
        F.collect_list(F.col("before") + F.col("tokens")).over(order.rangeBetween(0, options.budget)).alias("ends"),
    )
    room = F.least(F.lit(options.history).cast("long"), F.lit(options.budget) - F.col("head_tokens") - F.col("tokens"))
    fits = lambda t: (t["i"] == F.col("i")) | ((t["i"] >= F.col("head")) & (F.col("before") - t["before"] <= room))
    begun = framed.withColumn("from", F.array_min(F.filter("past", fits)))
    limit = F.lit(options.budget) - F.col("head_tokens") + F.col("from.before")
    count = F.greatest(F.lit(1), F.size(F.filter("ends", lambda e: e <= limit)))
    return begun.select("conv_id", "i", "head", F.col("from.i").alias("history"), (F.col("i") + count).alias("end"))


def _walk(spans: DataFrame, part: int = 1000) -> DataFrame:
    """(conv_id, window, first, head, history, end): from turn 0 on, each window begins where the last one ends.

    Windows are gathered in parts, so that a long walk does not copy all of them at every step.
    """
    span = F.struct(F.col("i").alias("first"), "head", "history", "end")
    whole = spans.groupBy("conv_id").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    kind = "array<struct<first:int, head:int, history:int, end:int>>"
    none = F.expr(f"cast(array() as {kind})")

    def step(state: Column, s: Column) -> Column:
        full = F.size(state["open"]) >= part
        begun = F.struct(
            s["end"].alias("next"),
            F.when(full, F.concat(state["full"], F.array(state["open"]))).otherwise(state["full"]).alias("full"),
            F.when(full, F.array(s)).otherwise(F.concat(state["open"], F.array(s))).alias("open"),
        )
        return F.when(s["first"] == state["next"], begun).otherwise(state)

    start = F.struct(F.lit(0).alias("next"), F.expr(f"cast(array() as array<{kind}>)").alias("full"), none.alias("open"))
    found = F.aggregate("spans", start, step, lambda s: F.concat(F.flatten(s["full"]), s["open"]))
    return whole.select("conv_id", F.posexplode(found).alias("window", "span")).select("conv_id", "window", "span.*")


def read_turns(text: Column) -> Column:
    """The turns (role, text) of a formatted window."""
    pieces = F.filter(F.split(text, CLOSE, -1), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substring(p, len(OPEN) + 1, F.instr(p, SEPARATOR) - len(OPEN) - 1)).alias("role"),
            unescape(F.substring(p, F.instr(p, SEPARATOR) + len(SEPARATOR), F.length(p))).alias("text"),
        ),
    )
