"""Chat formatting into budgeted windows, in DataFrame operations only.

A turn is written ``[INST]role[/INST]text</s>``; a window starts with ``<s>``.
Control strings inside roles and texts get one backslash after their first
character, which taking one away undoes exactly.

A turn's tokens are bounded from above by the bytes it is written with: no
byte-level tokenizer makes more tokens than bytes, and the few letters that
lower case or composition lengthens count for more.  Prefix sums of these
bounds cut a conversation into cells.  Turns wholly inside a cell form a
window; a turn that crosses into the next cell forms one of its own.  Every
window starts with the system turn, repeats limited history before its first
turn, and masks both: the text of each assistant turn is a target once.  What
the system turn and the history take is not given to new turns, so a window
keeps the budget unless one turn, or the system turn, is larger than that.

A conversation within one block of turn numbers is formatted where its turns
meet, after the only exchange of texts.  Longer ones are formatted block by
block, with sums carried over a table of blocks, and a block is also sent to
the following blocks that may repeat its end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Tokens of a window, and those of them for history at most (a quarter of what the system turn leaves).
BUDGET, HISTORY = 4096, 1024
#: Turn numbers of a block.
BLOCK = 64
#: Rows of the table of long conversations' blocks up to which it is broadcast.
BROADCAST_BLOCKS = 100_000
#: Bytes of the marks of a turn and of a window.
TURN_MARKS, WINDOW_MARKS = 17, 3
CONTROL = r"(/?(?:s>|INST\]))"
#: Characters that lower case or canonical composition can write with more bytes, and how many more at most.
LONGER, MORE = r"[\u0130\u023A\u023E\u0300-\u036F\u0900-\u0FFF\u2ADC\uFB1D-\uFB4F\x{1D100}-\x{1D1FF}]", 8


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*){CONTROL}", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*){CONTROL}", r"$1$2$3")


def tokens(written: Column) -> Column:
    """An upper bound of the tokens of what is written, for any tokenizer on UTF-8 bytes."""
    return (F.octet_length(written) + MORE * F.regexp_count(written, F.lit(LONGER))).cast("long")


def _written(turns: DataFrame) -> DataFrame:
    """Turns as they are written: conv_id, turn, tie (order among equal turns), role, head, body, cost, block."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    tie = F.shiftrightunsigned(F.xxhash64(role, text), 1)
    turn = F.col("turn").cast("long")
    # null turns, which come first, are dealt into 1024 blocks by their order
    block = F.when(turn.isNull(), F.shiftright(tie, 53) - F.lit(1 << 62)).otherwise(F.floor(turn / BLOCK))
    head = F.concat(F.lit("[INST]"), escape(role), F.lit("[/INST]"))
    named = turns.select("conv_id", turn.alias("turn"), tie.alias("tie"), role.alias("role"), head.alias("head"), escape(text).alias("body"), block.cast("long").alias("block"))
    return named.withColumn("cost", tokens(F.col("head")) + tokens(F.col("body")) + 4)


def _ordered(*keys: str):
    return Window.partitionBy(*keys).orderBy(F.col("turn").asc_nulls_first(), "tie", "role", "body")


BEFORE = (Window.unboundedPreceding, -1)
SYSTEM = ("role", "head", "body", "cost")


def _blocks(written: DataFrame, history: int) -> DataFrame:
    """Blocks of conversations that have more than one: conv, block, what lies before it, its system turn, and its neighbours.

    targets are the later blocks that may repeat turns of this one, infos the
    sums before those earlier blocks whose turns this one may repeat.
    """
    first = F.min(F.struct("turn", "tie", "role", F.struct(*SYSTEM).alias("s"))).alias("first")
    slim = written.groupBy("conv_id", "block").agg(F.count("*").alias("rows"), F.sum("cost").alias("cost"), first)
    several = slim.withColumn("n", F.count("*").over(Window.partitionBy("conv_id"))).where("n > 1")
    order = Window.partitionBy("conv_id").orderBy("block")
    near = history // TURN_MARKS + 1
    start = F.first("first").over(order.rowsBetween(Window.unboundedPreceding, 0))
    system = F.when(start["s"]["role"] == "system", start["s"])
    is_first = F.row_number().over(order) == 1
    took = several.withColumns({"system": system, "cost": F.col("cost") - F.when(is_first & system.isNotNull(), system["cost"]).otherwise(0)})
    before = lambda c: F.coalesce(F.sum(c).over(order.rowsBetween(*BEFORE)), F.lit(0))
    sums = took.select("conv_id", "block", "cost", "system", before("rows").alias("no0"), before("cost").alias("start0"))
    info = F.struct("block", "no0", "start0")
    after = F.collect_list(F.struct("block", "start0")).over(order.rowsBetween(1, near))
    return sums.select(
        F.col("conv_id").alias("b_conv"), F.col("block").alias("b_block"), "system", F.collect_list(info).over(order.rowsBetween(-near, 0)).alias("infos"),
        F.transform(F.filter(after, lambda x: x["start0"] - history < F.col("start0") + F.col("cost")), lambda x: x["block"]).alias("targets"),
    )


def _placed_short(written: DataFrame) -> DataFrame:
    """Turns of conversations of one block with unit, no, start, is_system, the system turn, and mine."""
    order = _ordered("conv_id")
    start = F.first(F.struct(*SYSTEM)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = written.withColumns({"no": F.row_number().over(order).cast("long") - 1, "system": F.when(start["role"] == "system", start)})
    rows = rows.withColumn("is_system", (F.col("no") == 0) & F.col("system").isNotNull())
    sums = F.coalesce(F.sum(F.when(~F.col("is_system"), F.col("cost")).otherwise(0)).over(order.rowsBetween(*BEFORE)), F.lit(0))
    return rows.withColumns({"unit": F.lit(0).cast("long"), "start": sums, "mine": F.lit(True), "alone": F.col("is_system") & F.lead("no").over(order).isNull()})


def _placed_long(written: DataFrame, blocks: DataFrame) -> DataFrame:
    """The same of conversations of several blocks; a unit is a block with the turns of earlier ones that it may repeat."""
    same = F.col("conv_id").eqNullSafe(F.col("b_conv"))
    sent = written.join(blocks.select("b_conv", "b_block", "targets"), same & (F.col("block") == F.col("b_block")))
    sent = sent.withColumn("unit", F.explode(F.concat(F.array("block"), "targets"))).drop("b_conv", "b_block", "targets")
    rows = sent.join(blocks.select("b_conv", "b_block", "system", "infos"), same & (F.col("unit") == F.col("b_block"))).drop("b_conv", "b_block")
    order = _ordered("conv_id", "unit", "block")
    info = F.filter("infos", lambda x: x["block"] == F.col("block"))[0]
    rows = rows.withColumn("info", info).withColumn("no", F.row_number().over(order).cast("long") - 1 + F.col("info.no0")).drop("infos")
    rows = rows.withColumn("is_system", (F.col("no") == 0) & F.col("system").isNotNull())
    sums = F.coalesce(F.sum(F.when(~F.col("is_system"), F.col("cost")).otherwise(0)).over(order.rowsBetween(*BEFORE)), F.lit(0))
    return rows.withColumns({"start": F.col("info.start0") + sums, "mine": F.col("unit") == F.col("block"), "alone": F.lit(False)}).drop("info")


def _windows(placed: DataFrame, budget: int, history: int) -> DataFrame:
    """Windows of placed turns; no exchange beyond that of the turns."""
    rest = budget - WINDOW_MARKS - F.coalesce(F.col("system.cost"), F.lit(0))
    repeat = F.greatest(F.lit(0), F.least(F.lit(history), F.floor(rest / 4))).cast("long")
    room = F.greatest(F.lit(1), rest - repeat)
    cell = lambda x: F.floor(x / room).cast("long")
    end = F.col("start") + F.col("cost")
    celled = placed.withColumns({"cell": F.when(F.col("is_system"), F.lit(0).cast("long")).otherwise(cell(F.col("start"))), "own": F.when(F.col("is_system"), 0).otherwise((cell(F.col("start")) != cell(end - 1)).cast("int"))})
    order = Window.partitionBy("conv_id", "unit").orderBy("start")
    turn = F.struct("no", "role", "head", "body", "start")
    earlier = F.collect_list(F.when(~F.col("is_system"), turn)).over(order.rangeBetween(-history, -1))
    in_window = Window.partitionBy("conv_id", "unit", "cell", "own").orderBy("start")
    rows = celled.withColumn("earlier", earlier).where("mine AND (NOT is_system OR alone)")
    leads = F.row_number().over(in_window) == 1
    kept = F.filter("earlier", lambda x: x["start"] >= F.col("start") - repeat)
    rows = rows.withColumn("earlier", F.when(leads, kept))
    member = F.struct("no", "role", "head", "body", "is_system", "earlier")
    grouped = rows.groupBy("conv_id", "unit", "cell", "own").agg(F.sort_array(F.collect_list(member)).alias("p"), F.first("system").alias("system"))
    piece = lambda x, kind: F.struct(F.lit(kind).alias("kind"), x["role"].alias("role"), x["head"].alias("head"), x["body"].alias("body"))
    fresh = F.filter("p", lambda x: ~x["is_system"])
    repeated = F.coalesce(F.get(F.col("p"), F.lit(0))["earlier"], F.array().cast("array<struct<no:long,role:string,head:string,body:string,start:long>>"))
    # the first window of a conversation is the one with its turn 0, or with turn 1 after a system turn
    is_first = F.get(F.col("p"), F.lit(0))["no"] <= F.when(F.col("system").isNull(), 0).otherwise(1)
    lead = F.struct(F.when(is_first, 2).otherwise(1).alias("kind"), F.lit("system").alias("role"), F.col("system.head").alias("head"), F.col("system.body").alias("body"))
    own = F.concat(F.transform(repeated, lambda x: piece(x, 1)), F.transform(fresh, lambda x: piece(x, 2)))
    pieces = F.when(F.col("system").isNull(), own).otherwise(F.concat(F.array(lead), own))
    named = grouped.select("conv_id", F.struct("unit", "cell", "own").alias("window"), pieces.alias("p"))
    text = F.concat(F.lit("<s>"), F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], F.lit("</s>"))), ""))
    zero = F.struct(F.lit(3).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss"))

    def step(a: Column, x: Column) -> Column:
        start, size = a["at"] + F.char_length(x["head"]), F.char_length(x["body"])
        target = (x["kind"] == 2) & (x["role"] == "assistant")
        span = F.array(F.struct(start.alias("start"), size.alias("length")))
        return F.struct((start + size + 4).alias("at"), F.when(target, F.concat(a["loss"], span)).otherwise(a["loss"]).alias("loss"))

    return named.select(
        "conv_id", "window", text.alias("text"), F.size(F.filter("p", lambda x: x["kind"] == 1)).alias("n_repeated"),
        F.aggregate("p", zero, step, lambda a: a["loss"]).alias("loss"),
    )


def format_chats(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Windows of all conversations: conv_id, window (in order), text, n_repeated, loss.

    turns has conv_id, turn, role, text; other columns are ignored.  Turns are
    ordered by turn, null turns first, and equal ones by a hash of role and
    text; repeated rows are turns of their own; null roles and texts are
    empty; a null conv_id is a conversation.  n_repeated counts the leading
    turns of the window that an earlier window already has; loss lists (start,
    length) in code points of the assistant texts that are targets here.  An
    empty table gives no rows.  Rows of one conversation with one turn number
    that is not null are kept in one task.
    """
    written = _written(turns)
    blocks = cut(_blocks(_written(turns), history))
    n = blocks.count()
    if not n:
        return _windows(_placed_short(written), budget, history)
    near = F.broadcast(blocks) if n <= BROADCAST_BLOCKS else blocks
    named = blocks.select(F.col("b_conv").alias("l_conv")).distinct()
    named = F.broadcast(named) if n <= BROADCAST_BLOCKS else named
    short = written.join(named, F.col("conv_id").eqNullSafe(F.col("l_conv")), "left_anti")
    return _windows(_placed_short(short), budget, history).unionByName(_windows(_placed_long(written, near), budget, history))


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation what its windows say: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    turns = F.split(F.expr("substring(text, 4)"), "</s>", -1)
    fresh = F.slice(turns, F.col("n_repeated") + 1, F.size(turns) - 1 - F.col("n_repeated"))
    told = F.transform(
        fresh,
        lambda t: F.concat(
            unescape(F.substring_index(F.substring(t, 7, 1 << 30), "[/INST]", 1)), F.lit("\n"),
            unescape(F.regexp_replace(t, r"(?s)^\[INST\].*?\[/INST\]", "")), F.lit("\n"),
        ),
    )
    lost = F.transform("loss", lambda s: unescape(F.substring(F.col("text"), s["start"] + 1, s["length"])))
    each = windows.select(
        "conv_id", F.struct("window", F.size(told).cast("long").alias("n"), F.array_join(told, "").alias("told"), F.array_join(lost, "").alias("lost"), F.char_length("text").cast("long").alias("chars")).alias("w")
    )
    whole = each.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("w"))
    total = lambda f: F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + f(x))
    joined = lambda f: F.array_join(F.transform("w", f), "")
    return whole.select(
        "conv_id", total(lambda x: x["n"]).alias("n_turns"), F.sha2(joined(lambda x: x["told"]), 256).alias("turns_sha256"),
        total(lambda x: F.char_length(x["lost"]).cast("long")).alias("loss_chars"), F.sha2(joined(lambda x: x["lost"]), 256).alias("loss_sha256"),
        total(lambda x: x["chars"]).alias("formatted_chars"),
    )
