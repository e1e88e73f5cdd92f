"""Conversations as budgeted training windows, by DataFrame functions only.

A turn is written as ``### role: text</turn>`` and a line feed.  Inside roles and texts a backslash
becomes ``\\b``, ``### `` becomes ``\\h`` and ``</turn>`` becomes ``\\e`` (in roles also ``:``
becomes ``\\c``): afterwards every backslash starts one of these pairs, so replacing them back, the
backslash last, restores any text, whatever it contained.

Windows come from prefix sums.  Turns are numbered and their tokens summed; a turn belongs to the
window in whose stride its first token falls, the stride being what the budget leaves beside the
retained system turn and the repeated history.  Windows therefore end at turns.  A window starts
with the system turn if it began earlier, then repeats the last turns of the window before that fit
``history`` tokens, then has its own turns.  Repeated assistant turns are masked: the loss spans of
a window are its own assistant texts.  Since a turn is never cut, a window exceeds the budget where
its last turn is longer than the rest of the stride plus the slack kept for that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed strings of the template.
HEAD = "### "
BETWEEN = ": "
END = "</turn>"
NEW_LINE = "\n"

_PAIRS = (("\\", "\\b"), (HEAD, "\\h"), (END, "\\e"))
_ROLE_PAIRS = (*_PAIRS, (":", "\\c"))


def _replaced(text: Column, pairs) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escaped(text: Column, role: bool = False) -> Column:
    return _replaced(text, _ROLE_PAIRS if role else _PAIRS)


def unescaped(text: Column, role: bool = False) -> Column:
    pairs = _ROLE_PAIRS if role else _PAIRS
    return _replaced(text, [(new, old) for old, new in reversed(pairs)])


def approximate_tokens(text: Column) -> Column:
    """A token for each four bytes, rounded up, and three for the turn's marks."""
    return F.ceil(F.octet_length(text) / 4) + 3


def format_conversations(
    turns: DataFrame, budget: int = 2048, history: int = 256, system: int = 256, tokens=approximate_tokens
) -> DataFrame:
    """A row for each window of each conversation: ``conv_id``, ``window`` (from 0), ``text``,
    ``n_context`` (leading turns that are repeated), ``loss_spans`` (array of ``begin``, ``end``, in
    code points of ``text``) and ``n_tokens``.

    ``turns`` has ``conv_id``, ``turn``, ``role``, ``text``; rows are ordered by turn.

    Nulls and other cases: a null role or text is empty; a null turn comes first; equal turns are
    ordered by role, then text; rows with a null conv_id form one conversation; a system turn is
    the first row of its conversation with the role ``system``, others are ordinary turns;
    repeated rows are turns of their own; a text longer than a window is a window's last turn, whole,
    and exceeds its budget.  An empty table gives no windows.  Extra columns are left out.
    """
    stride = budget - history - system
    if stride < 1 or not 0 <= history <= stride:
        raise ValueError("the budget leaves no room beside system turn and history")
    plain = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    ordered = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    rows = plain.select(
        "conv_id",
        "role",
        F.row_number().over(ordered).alias("at"),
        escaped(F.col("role"), role=True).alias("mark"),
        escaped(F.col("text")).alias("body"),
        tokens(F.col("text")).cast("long").alias("tokens"),
        F.coalesce(F.sum(tokens(F.col("text"))).over(before), F.lit(0)).cast("long").alias("sum"),
        (F.sum(F.when(F.col("role") == "system", 1).otherwise(0)).over(before)).alias("systems"),
    )
    rows = rows.withColumn("window", F.floor(F.col("sum") / stride))
    along = Window.partitionBy("conv_id").orderBy("at")
    back = Window.partitionBy("conv_id").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    opens = F.coalesce(F.lag("window").over(along) != F.col("window"), F.lit(True))
    rows = rows.withColumn("opens", opens)
    start = F.struct("window", "sum")
    following = F.last(F.when(F.col("opens"), start), ignorenulls=True).over(back)
    is_system = (F.col("role") == "system") & (F.coalesce("systems", F.lit(0)) == 0)
    rows = rows.withColumn("next", following).withColumn("kept", is_system)
    # The first turn of a later window brings the retained one along: one running value, no lists.
    turn = F.struct("at", "role", "mark", "body", "tokens", "window")
    retained = F.first(F.when(F.col("kept"), turn), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("retained", F.when(F.col("opens"), retained))
    near = (~F.col("kept")) & F.col("next").isNotNull() & (F.col("next.sum") - F.col("sum") <= history)

    own = [F.col(c).alias(c) for c in ("at", "role", "mark", "body", "tokens")]
    use = lambda of, window, kind: F.struct(*of, F.struct(window.alias("window"), F.lit(kind).alias("kind")).alias("use"))
    of_retained = [F.col(f"retained.{c}").alias(c) for c in ("at", "role", "mark", "body", "tokens")]
    uses = F.array_compact(F.array(
        use(own, F.col("window"), 2),
        F.when(F.col("retained.window") < F.col("window"), use(of_retained, F.col("window"), 0)),
        F.when(near, use(own, F.col("next.window"), 1)),
    ))
    placed = rows.select("conv_id", F.explode(uses).alias("u")).select("conv_id", "u.*")

    head = F.concat(F.lit(HEAD), "mark", F.lit(BETWEEN))
    piece = F.concat(head, "body", F.lit(END + NEW_LINE))
    within = (
        Window.partitionBy("conv_id", "use.window")
        .orderBy("use.kind", "at")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = placed.withColumn("piece", piece)
    placed = placed.withColumn("offset", F.coalesce(F.sum(F.char_length("piece")).over(within), F.lit(0)))
    begin = F.col("offset") + F.char_length(head)
    span = F.struct(begin.cast("long").alias("begin"), (begin + F.char_length("body")).cast("long").alias("end"))
    trains = (F.col("use.kind") == 2) & (F.col("role") == "assistant")
    parts = F.array_sort(F.collect_list(F.struct("use.kind", "at", "piece", F.when(trains, span).alias("loss"))))
    windows = placed.groupBy("conv_id", F.col("use.window").alias("stride")).agg(
        parts.alias("parts"), F.sum("tokens").alias("n_tokens")
    )
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("stride")) - 1
    return windows.select(
        "conv_id",
        number.cast("long").alias("window"),
        F.array_join("parts.piece", "").alias("text"),
        F.size(F.filter("parts", lambda p: p["kind"] < 2)).alias("n_context"),
        F.filter("parts.loss", lambda x: x.isNotNull()).alias("loss_spans"),
        "n_tokens",
    )


def read_back(windows: DataFrame) -> DataFrame:
    """What the windows of ``format_conversations`` say of each conversation: ``conv_id``,
    ``turns`` (array of ``role``, ``text``, each turn once), ``loss`` (all text under the loss
    mask) and ``formatted_chars``.  Reads nothing but the windows.
    """
    segments = F.split("text", END + NEW_LINE)
    own = F.slice(segments, F.col("n_context") + 1, F.size(segments) - 1 - F.col("n_context"))
    mark = lambda s: F.substring_index(s, BETWEEN, 1)

    def turn(s: Column) -> Column:
        role = F.substr(mark(s), F.lit(len(HEAD) + 1))
        text = F.substr(s, F.char_length(mark(s)) + len(BETWEEN) + 1)
        return F.struct(unescaped(role, role=True).alias("role"), unescaped(text).alias("text"))

    under = F.transform(
        "loss_spans", lambda x: unescaped(F.substr("text", (x["begin"] + 1).cast("int"), (x["end"] - x["begin"]).cast("int")))
    )
    decoded = windows.select(
        "conv_id",
        "window",
        F.transform(own, turn).alias("turns"),
        F.array_join(under, "").alias("loss"),
        F.char_length("text").alias("chars"),
    )
    whole = decoded.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"), F.sum("chars").alias("formatted_chars")
    )
    return whole.select(
        "conv_id", F.flatten("w.turns").alias("turns"), F.array_join("w.loss", "").alias("loss"), "formatted_chars"
    )
