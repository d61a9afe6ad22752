"""Chat formatting in budgeted windows, with DataFrame functions alone.

Turns are dealt by ranges of (conversation, turn), so a conversation of any
length is spread over tasks. Running sums of tokens inside a range, plus the
sums of the ranges before it, give every turn the tokens before it. Spans of
``SEGMENT`` budgets of these prefix sums are segments: groups of a bounded
number of turns, as every turn counts at least one token. In a segment, cuts
follow from differences of prefix sums alone: a window takes turns while the
system turn, the repeated history and its own turns stay within the budget. A
turn is never cut; one that is longer than the budget has a window of its own.

The template puts every turn between ``<s>`` and ``</s>``, with marks for the
role. In texts and roles a backslash goes behind the first character of each
control string, and one more where there are some already, so reading takes
one out again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textmill.llm.shared import written

BUDGET, HISTORY = 512, 128
#: Budgets of tokens in a segment.
SEGMENT = 32
#: Fixed values of the template.
BEGIN, END = "<s>", "</s>"
SYSTEM, USER, OTHER = ("[SYS]", "[/SYS]"), ("[INST]", "[/INST]"), ("[ROLE]", "[/ROLE]")
TAIL = r"(?=\\*/?(?:s>|(?:SYS|INST|ROLE)\]))"


def escaped(text: Column) -> Column:
    """The text without control strings."""
    return F.regexp_replace(text, r"([<\[])" + TAIL, r"$1\\")


def unescaped(text: Column) -> Column:
    """The text that was escaped."""
    return F.regexp_replace(text, r"([<\[])\\" + TAIL, "$1")


def word_tokens(text: Column) -> Column:
    """Words and marks of a text: an estimate of its tokens without a vocabulary."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]"))


def _turns(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, tokens: Callable[[Column], Column]) -> DataFrame:
    """(conv, part, turn, tie, copy, role, form, lead, body, size): formatted turns by ranges, in a table of the shared folder."""
    text = F.coalesce(turns[text_col].cast("string"), F.lit(""))
    role = F.coalesce(turns[role_col].cast("string"), F.lit(""))
    rows = turns.select(turns[conv_col].cast("long").alias("conv"), turns[turn_col].cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.xxhash64(role, text).alias("tie"), F.monotonically_increasing_id().alias("copy"))
    size = F.greatest(tokens(F.col("text")).cast("long"), F.lit(0)) + 4
    rows = rows.select("conv", "turn", "tie", "copy", "role", size.alias("size"), escaped(F.col("text")).alias("body"))
    known = lambda marks: (F.concat(F.lit(BEGIN + marks[0])), F.lit(marks[1] + END))
    named = F.concat(F.lit(BEGIN + OTHER[0]), escaped(F.col("role")), F.lit(OTHER[1]))
    head = F.when(F.col("role") == "system", known(SYSTEM)[0]).when(F.col("role") == "user", known(USER)[0]).when(F.col("role") == "assistant", F.lit(BEGIN)).otherwise(named)
    tail = F.when(F.col("role") == "system", known(SYSTEM)[1]).when(F.col("role") == "user", known(USER)[1]).otherwise(F.lit(END))
    rows = rows.select("conv", "turn", "tie", "copy", "role", "size", F.concat(head, "body", tail).alias("form"), F.length(head).cast("long").alias("lead"), F.length("body").cast("long").alias("body"))
    ranges = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(rows.repartitionByRange(ranges, "conv", "turn", "tie", "copy").withColumn("part", F.spark_partition_id()), "turns")


def _placed(rows: DataFrame) -> DataFrame:
    """Turns with ``start``, the tokens of their conversation before them, and whether they are its system turn."""
    order = ("turn", "tie", "copy")
    sums = rows.groupBy("conv", "part").agg(F.sum("size").alias("size"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = sums.select(F.col("conv").alias("c"), F.col("part").alias("p"), F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("conv", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    run = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = run.join(offset, F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))).withColumn("start", F.col("inside") + F.col("offset"))
    return placed.select("conv", "start", "size", "role", "form", "lead", F.col("body"), ((F.col("start") == 0) & (F.col("role") == "system")).alias("first"))


#: Positions of turns that begin a window. ``base`` is the start of a turn's history, so the window may go on up to ``limit`` tokens.
CUTS = """aggregate(sequence(1, size(t)), named_struct('limit', -1L, 'at', cast(array() as array<int>)), (c, i) -> if(t[i - 1].own and t[i - 1].start + t[i - 1].size > c.limit,
named_struct('limit', t[i - 1].start + {budget}L - if(t[i - 1].first, 0L, fixed) - (t[i - 1].start - t[i - 1].base), 'at', concat(c.at, array(i))), c)).at"""


def chat_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens: Callable[[Column], Column] = word_tokens, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, segment, window, text, repeated, loss array<struct<begin, end>>, n_tokens): training samples of conversations, in order of segment and window.

    ``text`` holds formatted turns: the conversation's system turn (its first
    turn if that has this role), the last turns before the window as far as
    they start within ``history`` tokens of it, then the window's own.
    ``repeated`` is the number of characters before the window's own turns.
    ``loss`` has the places of the texts of its own assistant turns; repeated
    ones are masked. Every turn is some window's own exactly once. Windows stay
    within ``budget`` tokens unless a single own turn doesn't fit.

    A turn has ``tokens(text)`` tokens and four for its marks. Turns are ordered
    by turn, nulls first; ties by a hash of role and text, repeated rows side by
    side. Null texts and roles count as empty. A null id is one conversation.
    Other columns are ignored; an empty table gives no windows.
    """
    if not 0 <= history < budget:
        raise ValueError("the history has to be shorter than the budget")
    rows, stride = _turns(turns, conv_col, turn_col, role_col, text_col, tokens), SEGMENT * budget
    own = _placed(rows).withColumn("segment", F.expr(f"start div {stride}L"))
    # a turn is also context of the next segment where it may start within its first window's history
    places = F.when(F.col("start") >= (F.col("segment") + 1) * stride - history, F.array("segment", F.col("segment") + 1)).otherwise(F.array("segment"))
    dealt = own.withColumn("to", F.explode(places)).withColumn("own", F.col("to") == F.col("segment"))
    near = Window.partitionBy("conv", "to").orderBy("start").rangeBetween(-history, 0)
    along = Window.partitionBy("conv", "to").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    past = F.when(~F.col("first"), F.col("start"))
    dealt = dealt.withColumn("base", F.coalesce(F.min(past).over(near), F.col("start"))).withColumn("behind", F.greatest(F.count(past).over(near) - 1, F.lit(0)).cast("int"))
    dealt = dealt.withColumn("chars", F.coalesce(F.sum(F.length("form")).over(along), F.lit(0)))
    turn = F.struct("start", "size", "own", "first", "base", "behind", "chars", "role", "form", "lead", "body")
    grouped = dealt.groupBy("conv", "to").agg(F.array_sort(F.collect_list(turn)).alias("t"), F.max("own").alias("any")).filter("any").drop("any")
    # of conversations of several segments, the system turn goes to those behind the first
    begins = F.min(F.struct("turn", "tie", "copy", "role", "size", "form")).alias("head")
    heads = rows.groupBy("conv").agg(F.sum("size").alias("total"), begins).filter((F.col("total") > stride) & (F.col("head.role") == "system"))
    heads = heads.select(F.col("conv").alias("c"), F.col("head.size").alias("size"), F.col("head.form").alias("form"))
    joined = grouped.join(heads, F.col("conv").eqNullSafe(F.col("c")), "left")
    here = F.expr("t[0].first")
    fixed, system = F.when(here, F.expr("t[0].size")).otherwise(F.coalesce("size", F.lit(0))), F.when(here, F.expr("t[0].form")).otherwise(F.coalesce("form", F.lit("")))
    cut = joined.select("conv", "to", "t", fixed.cast("long").alias("fixed"), system.alias("system")).withColumn("at", F.expr(CUTS.format(budget=budget)))
    ranges = F.expr("transform(at, (i, k) -> named_struct('window', k, 'i', i, 'past', if(t[i - 1].first, 0, t[i - 1].behind), 'n', if(k + 1 < size(at), at[k + 1], size(t) + 1) - i))")
    window = cut.select("conv", "to", "fixed", "system", "t", F.inline(ranges))
    # context turns stand before the own ones; a window's slice has its history, then its own turns
    window = window.select("conv", "to", "window", "past", F.expr("if(t[i - 1].first, '', system)").alias("system"), F.expr("if(t[i - 1].first, 0L, fixed)").alias("fixed"), F.expr("slice(t, i - past, past + n)").alias("t"))
    window = window.withColumn("shift", F.length("system") - F.expr("t[0].chars"))
    mine = F.expr("filter(slice(t, past + 1, size(t)), x -> x.role = 'assistant')")
    loss = F.transform(mine, lambda x: F.struct((F.col("shift") + x.chars + x.lead).alias("begin"), (F.col("shift") + x.chars + x.lead + x.body).alias("end")))
    return window.select(
        F.col("conv").alias("conv_id"),
        F.col("to").alias("segment"),
        "window",
        F.concat("system", F.array_join(F.transform("t", lambda x: x.form), "")).alias("text"),
        F.expr("shift + t[past].chars").alias("repeated"),
        loss.alias("loss"),
        F.expr("fixed + t[size(t) - 1].start + t[size(t) - 1].size - t[0].start").alias("n_tokens"),
    )


def _without(x: Column, marks: tuple[str, str]) -> Column:
    return F.substring(x, F.lit(len(marks[0]) + 1), F.length(x) - len(marks[0]) - len(marks[1]))


def read_turns(text: Column, repeated: Column) -> Column:
    """The window's own turns, array<struct<role, text>>, read from its formatted text."""
    pieces = F.split(F.substring(text, repeated.cast("int") + 1, F.length(text)), END)

    def turn(x: Column) -> Column:
        x = F.substring(x, F.lit(len(BEGIN) + 1), F.length(x))
        body = F.substring(x, F.locate(OTHER[1], x) + len(OTHER[1]), F.length(x))
        role = F.substring(x, F.lit(len(OTHER[0]) + 1), F.locate(OTHER[1], x) - 1 - len(OTHER[0]))
        kind = lambda r, b: F.struct(r.alias("role"), unescaped(b).alias("text"))
        named = F.when(x.startswith(OTHER[0]), kind(unescaped(role), body)).otherwise(kind(F.lit("assistant"), x))
        return F.when(x.startswith(SYSTEM[0]), kind(F.lit("system"), _without(x, SYSTEM))).when(x.startswith(USER[0]), kind(F.lit("user"), _without(x, USER))).otherwise(named)

    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


def chat_digests(windows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows) per conversation, read from the windows alone.

    A digest of all turns needs them in one value, which Spark bounds at 2 GB a
    conversation; the windows themselves have no such bound.
    """
    loss = F.transform("loss", lambda s: unescaped(F.substring(F.col("text"), s.begin.cast("int") + 1, (s.end - s.begin).cast("int"))))
    rows = windows.select("conv_id", "segment", "window", F.length("text").alias("chars"), read_turns(F.col("text"), F.col("repeated")).alias("turns"), F.array_join(loss, "").alias("learnt"))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), "")
    rows = rows.select("conv_id", "chars", F.size("turns").alias("n"), F.struct("segment", "window", said.alias("said"), "learnt").alias("w"))
    whole = rows.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.count(F.lit(1)).alias("n_windows"), F.array_sort(F.collect_list("w")).alias("w"))
    one = lambda part: F.array_join(F.transform("w", lambda x: x[part]), "")
    return whole.select("conv_id", "n_turns", F.sha2(one("said"), 256).alias("turns_sha256"), F.length(one("learnt")).cast("long").alias("loss_chars"), F.sha2(one("learnt"), 256).alias("loss_sha256"), "formatted_chars", "n_windows")
