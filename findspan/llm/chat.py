"""Chat formatting: turn-aligned windows within a token budget, with the parts to learn marked.

DataFrame functions only: no Python runs on the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START = "<|im_start|>"
END = "<|im_end|>"


def escaped(text: Column) -> Column:
    """Take ``<|`` out of a text: between ``<`` and ``|`` every run of backslashes gets one more."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    """Undo :func:`escaped`: each such run, now of one backslash at least, loses one."""
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escaped_role(role: Column) -> Column:
    """A role on one line and without marks."""
    return escaped(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescaped_role(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def turn_tokens(text: Column) -> Column:
    """Length of a text for the budget: one token for each started four bytes, and four for the marks."""
    return F.ceil(F.octet_length(text) / 4) + 4


def window_turns(turns: DataFrame, budget: int = 2048, history: int = 256, longest: int = 768) -> DataFrame:
    """Deal the turns of every conversation to windows.

    Gives one row per turn and window: conv_id, win, place (order in the window), role, text, tokens,
    repeated (the turn was new in an earlier window).

    Prefix sums of tokens choose the spans: a turn belongs to the window in whose stride its last
    token falls. The stride is ``budget`` less ``history``, ``longest`` and the system turn (at least
    ``longest``), so that a window whose turns have at most ``longest`` tokens keeps the budget with
    the turn that reaches into its stride, the history and the system turn. Longer turns are never
    cut; their window exceeds the budget. A window repeats those turns of the window before it
    whose start lies within ``history`` tokens of its own, and the system turn (a first turn of role
    ``system``) if it isn't new there.

    Sums run within blocks of 1,024 turn numbers and over the blocks of a conversation, so a very
    long conversation is many tasks. Turns are ordered by turn number, role, text (nulls first);
    repeated rows count as further turns. A missing text or role is empty, a missing conv_id is a
    conversation of its own. No rows give no windows; other columns are not used.
    """
    rows = turns.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = rows.withColumn("tokens", turn_tokens(F.col("text"))).withColumn(
        "block", F.coalesce(F.floor(F.col("turn") / 1024), F.lit(-(1 << 62)))
    )
    # Totals of the blocks before, and the first turn if it is the system's.
    order = ["turn", "role", "text"]
    blocks = rows.groupBy("conv", "block").agg(
        F.sum("tokens").alias("total"), F.count("*").alias("n"),
        F.min(F.struct(*order, F.col("tokens"))).alias("head"),
    )
    by_block = Window.partitionBy("conv").orderBy("block")
    upto_block = by_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head = F.first("head").over(upto_block)
    blocks = blocks.select(
        "conv", "block",
        (F.sum("total").over(upto_block) - F.col("total")).alias("before"),
        (F.sum("n").over(upto_block) - F.col("n")).alias("n_before"),
        F.when(head["role"] == "system", head).alias("system"),
    )
    in_order = Window.partitionBy("conv", "block").orderBy(*order)
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stride = F.greatest(F.lit(longest), F.lit(budget - history - longest) - F.coalesce("system.tokens", F.lit(0)))
    placed = (
        rows.join(blocks, ["conv", "block"])
        .withColumn("upto", F.col("before") + F.sum("tokens").over(so_far))
        .withColumn("place", F.col("n_before") + F.row_number().over(in_order))
        .withColumn("start", F.col("upto") - F.col("tokens"))
        .withColumn("win", F.floor((F.col("upto") - 1) / stride))
        .select("conv", "win", "place", "start", "role", "text", "tokens", "system")
    )
    windows = placed.groupBy("conv", "win").agg(F.min("start").alias("opens"), F.first("system").alias("system"))
    by_win = Window.partitionBy("conv").orderBy("win")
    windows = windows.select(
        "conv", "win", "system", F.row_number().over(by_win).alias("nth"),
        F.lead(F.struct("win", "opens")).over(by_win).alias("next"),
    )
    new = F.struct("win", "place", "role", "text", "tokens", F.lit(False).alias("repeated"))
    again = F.struct(
        F.col("next.win").alias("win"), "place", "role", "text", "tokens", F.lit(True).alias("repeated")
    )
    is_system = (F.col("place") == 1) & F.col("system").isNotNull()
    repeats = F.col("next").isNotNull() & (F.col("next.opens") - F.col("start") <= history) & ~is_system
    copies = F.filter(F.array(new, F.when(repeats, again)), lambda c: c.isNotNull())
    dealt = (
        placed.join(windows.select("conv", "win", "next"), ["conv", "win"])
        .select("conv", F.explode(copies).alias("c"))
        .select("conv", "c.*")
    )
    systems = windows.filter("system is not null and nth > 1").select(
        "conv", "win", F.lit(1).cast("long").alias("place"), "system.role", "system.text", "system.tokens",
        F.lit(True).alias("repeated"),
    )
    return dealt.unionByName(systems).select(
        F.expr("try_cast(conv AS long)").alias("conv_id"), "win", "place", "role", "text", "tokens", "repeated"
    )


def format_windows(
    turns: DataFrame, budget: int = 2048, history: int = 256, longest: int = 768, learn: str = "assistant"
) -> DataFrame:
    """One training text per window: conv_id, win, formatted, n_repeated, spans, tokens, oversize.

    A turn is written as ``<|im_start|>role``, a line end, the escaped text, ``<|im_end|>`` and a line
    end. ``spans`` lists (start, length) in characters of ``formatted`` to learn from: the texts of
    new turns of role ``learn``. Repeated turns come first (``n_repeated`` of them) and are in no
    span, so each text is learned once. See :func:`window_turns` for the windows and for odd input.
    """
    pieces = window_turns(turns, budget, history, longest)
    head = F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n"))
    body = escaped(F.col("text"))
    pieces = pieces.select(
        "conv_id", "win", "tokens",
        F.struct(
            (~F.col("repeated")).alias("new"), "place",
            F.concat(head, body, F.lit(END + "\n")).alias("piece"),
            F.char_length(head).alias("head"), F.char_length(body).alias("body"),
            ((F.col("role") == learn) & ~F.col("repeated")).alias("learn"),
        ).alias("p"),
    )
    # A window holds little more than the budget or one turn, so its pieces fit in a row.
    windows = pieces.groupBy("conv_id", "win").agg(
        F.array_sort(F.collect_list("p")).alias("p"), F.sum("tokens").alias("tokens")
    )
    windows = windows.withColumn("oversize", F.col("tokens") > budget)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(state: Column, p: Column) -> Column:
        span = F.struct((state["at"] + p["head"]).alias("start"), p["body"].alias("length"))
        spans = F.when(p["learn"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((state["at"] + F.char_length(p["piece"])).alias("at"), spans.alias("spans"))

    return windows.select(
        "conv_id", "win",
        F.array_join(F.transform("p", lambda p: p["piece"]), "").alias("formatted"),
        F.size(F.filter("p", lambda p: ~p["new"])).alias("n_repeated"),
        F.aggregate("p", zero, step, lambda s: s["spans"]).alias("spans"),
        "tokens", "oversize",
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """Read the turns back from formatted windows: conv_id, win, turns, learned.

    ``turns`` are the (role, text) of the new turns, ``learned`` the unescaped texts under the spans.
    """
    pieces = F.slice(
        F.split("formatted", r"<\|im_start\|>", -1), F.col("n_repeated") + 2, F.size(F.split("formatted", r"<\|im_start\|>", -1))
    )

    def turn(piece: Column) -> Column:
        line_end = F.locate("\n", piece)
        text = F.substring(piece, line_end + 1, F.char_length(piece) - line_end - len(END) - 1)
        return F.struct(
            unescaped_role(F.substring(piece, F.lit(1), line_end - 1)).alias("role"), unescaped(text).alias("text")
        )

    return windows.select(
        "conv_id", "win", F.char_length("formatted").cast("long").alias("formatted_chars"),
        F.transform(pieces, turn).alias("turns"),
        F.transform("spans", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))).alias("learned"),
    )


def conversation_digest(windows: DataFrame) -> DataFrame:
    """Per conversation, digests of what its windows hold.

    The digest of a conversation is one hash of its whole text, so its turns meet in one row here and
    only here; formatting itself never gathers more than a window.
    """
    read = read_windows(windows).select(
        "conv_id", "formatted_chars",
        F.struct(
            "win", F.size("turns").alias("n"),
            F.array_join(
                F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
            ).alias("turns"),
            F.array_join("learned", "").alias("learned"),
        ).alias("w"),
    )
    whole = read.groupBy("conv_id").agg(
        F.array_sort(F.collect_list("w")).alias("w"), F.sum("formatted_chars").alias("formatted_chars"),
        F.sum("w.n").alias("n_turns"),
    )
    learned = F.array_join(F.transform("w", lambda w: w["learned"]), "")
    return whole.select(
        "conv_id", F.col("n_turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("w", lambda w: w["turns"]), "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
