"""Chat formatting into budgeted windows, in DataFrame functions only.

Prefix sums of turn tokens place each turn in a span: turns whose sum so far falls into the same half of the
span's room stand together, a turn longer than that half stands alone. So spans are turn-aligned and, single
long turns apart, within the budget. A window is the conversation's system turn, as much of the turns just
before the span as the history room takes, and the span; only texts of assistant turns of the span are under
the loss mask, so that repeated targets are masked out.

Turns are written <|im_start|>role, newline, text, <|im_end|>, newline. In roles and texts a backslash is
doubled and control strings get one after their first character; removing them again gives the text back.

Defined cases: null roles and texts count as empty; rows of a null conv_id form a conversation; turns are
ordered by turn (nulls last), role and text, and repeated rows are turns of their own; an empty table gives an
empty one; other columns are left out. Tokens are an estimate by TOKEN and OVERHEAD, not a model's pieces.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import Workspace

BUDGET, HISTORY, BLOCK = 1024, 256, 512
#: Control strings of common chat templates, besides all that begin with <|.
CONTROL_STRINGS = ("<s>", "</s>", "<unk>", "<pad>", "<bos>", "<eos>", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>", "[INST]", "[/INST]", "[SYSTEM_PROMPT]", "[/SYSTEM_PROMPT]", "[TOOL_CALLS]")
#: The first character of a control string, where the rest follows.
CONTROL = "|".join(f"{re.escape(c)}(?={'|'.join(re.escape(x[1:]) for x in (*CONTROL_STRINGS, '<|') if x[0] == c)})" for c in "<[")
START, END = "<|im_start|>", "<|im_end|>\n"
#: What the token estimate counts, besides OVERHEAD a turn.
TOKEN = r"\p{L}{1,5}|\p{N}{1,3}|[^\s\p{L}\p{N}]"
OVERHEAD = 4


def escape(x: Column) -> Column:
    """A doubled backslash for each, and one after the first character of each control string."""
    return F.regexp_replace(F.regexp_replace(x, r"\\", r"\\\\"), f"({CONTROL})", r"$1\\")


def escape_role(x: Column) -> Column:
    return F.regexp_replace(escape(x), "\n", "\\\\\n")


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"(?s)\\(\\?)", "$1")


def chat_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, block: int = BLOCK) -> DataFrame:
    """(conv_id, window, formatted, loss spans, n_context, n_tokens): context turns come first in formatted."""
    key = F.when(F.col("conv_id").isNull(), "\0").otherwise(F.col("conv_id").cast("string"))
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    work = Workspace(turns.sparkSession, "chat")
    t = turns.select("conv_id", key.alias("c"), F.floor(F.col("turn") / block).alias("blk"), "turn", role.alias("role"), text.alias("text"))
    t = t.withColumns({"blk": F.coalesce("blk", F.lit(1 << 62)), "tok": F.regexp_count("text", F.lit(TOKEN)) + OVERHEAD})
    # numbers and sums inside blocks of turns, then over the blocks: a long conversation isn't one task's
    inside = Window.partitionBy("c", "blk").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    t = work.table(t.withColumn("n", F.row_number().over(inside)).drop("turn"), "turns")
    # all that places the turns is computed without their texts
    num = _offset(t.select("c", "blk", "n", "tok", (F.col("role") == "system").alias("is_sys")), {"idx": F.lit(1)})
    num = num.withColumn("is_sys", F.col("is_sys") & (F.col("idx") == 0))
    num = num.join(num.filter("is_sys").select("c", F.col("tok").alias("sys_tok")), "c", "left")
    room = F.greatest(F.lit(budget - history) - F.coalesce("sys_tok", F.lit(0)), F.lit(2))
    num = num.withColumn("half", F.floor(room / 2)).withColumn("hist", F.least(F.lit(history), F.col("half")))
    num = num.withColumn("own_tok", F.when(F.col("is_sys"), 0).otherwise(F.col("tok"))).withColumn("long", (F.col("own_tok") > F.col("half")).cast("int"))
    num = _offset(num, {"before": F.col("own_tok"), "short_before": F.col("own_tok") * (1 - F.col("long")), "longs": F.col("long")})
    seg = F.when(F.col("is_sys"), 0).otherwise(2 * F.col("longs") + F.col("long"))
    num = num.withColumns({"seg": seg, "bucket": F.when(F.col("is_sys"), 0).otherwise(F.floor(F.col("short_before") / F.col("half")))})
    num = work.table(num.select("c", "blk", "n", "idx", "is_sys", "hist", "before", "seg", "bucket"), "numbers")
    spans = num.groupBy("c", "seg", "bucket").agg(F.min("idx").alias("first"), F.min("before").alias("begin"))
    spans = work.table(spans.withColumn("window", F.row_number().over(Window.partitionBy("c").orderBy("first")) - 1), "spans")
    placed = t.join(num.join(spans, ["c", "seg", "bucket"]).select("c", "blk", "n", "idx", "is_sys", "hist", "before", "window"), ["c", "blk", "n"])
    placed = work.table(placed.drop("blk", "n"), "placed")
    work.keep_only("placed", "spans")
    own = placed.select("conv_id", "c", "window", F.lit(2).alias("rank"), "idx", "role", "text", "tok")
    # a turn reaches at most the next two spans, as the history room is half a span at most
    later = placed.filter("not is_sys").select("conv_id", "c", F.explode(F.array(F.col("window") + 1, F.col("window") + 2)).alias("window"), F.lit(1).alias("rank"), "idx", "role", "text", "tok", "before", "hist")
    later = later.join(spans.select("c", "window", "begin"), ["c", "window"]).filter(F.col("begin") - F.col("before") <= F.col("hist"))
    again = spans.filter("window > 0").select("c", "window").join(placed.filter("is_sys").select("c", F.lit(0).alias("rank"), "idx", "role", "text", "tok"), "c")
    rows = own.unionByName(later.drop("before", "hist", "begin")).unionByName(again, allowMissingColumns=True)
    rows = rows.withColumns({"role_out": escape_role(F.col("role")), "text_out": escape(F.col("text"))})
    rows = rows.withColumn("loss", (F.col("rank") == 2) & (F.col("role") == "assistant"))
    windows = rows.groupBy("c", "window").agg(
        F.max("conv_id").alias("conv_id"),
        F.sort_array(F.collect_list(F.struct("rank", "idx", "role_out", "text_out", "loss"))).alias("turns"),
        F.count_if(F.col("rank") < 2).alias("n_context"),
        F.sum("tok").alias("n_tokens"),
    )
    formatted = F.array_join(F.transform("turns", lambda x: F.concat(F.lit(START), x["role_out"], F.lit("\n"), x["text_out"], F.lit(END))), "")
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + len(START) + F.length(x["role_out"]) + 1
        end = begin + F.length(x["text_out"])
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct((end + len(END)).alias("at"), F.when(x["loss"], F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return windows.select("conv_id", "window", formatted.alias("formatted"), F.aggregate("turns", zero, step, lambda a: a["out"]).alias("loss"), "n_context", "n_tokens")


def _offset(t: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Adds exclusive prefix sums over a conversation: inside each block, and the blocks before it."""
    inside = Window.partitionBy("c", "blk").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("c").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    totals = t.groupBy("c", "blk").agg(*[F.sum(v).alias(k) for k, v in sums.items()])
    totals = totals.select("c", "blk", *[F.coalesce(F.sum(k).over(over), F.lit(0)).alias(f"{k}_blocks") for k in sums])
    t = t.withColumns({k: F.coalesce(F.sum(v).over(inside), F.lit(0)) for k, v in sums.items()}).join(totals, ["c", "blk"])
    return t.withColumns({k: F.col(k) + F.col(f"{k}_blocks") for k in sums}).drop(*[f"{k}_blocks" for k in sums])


def read_turns(windows: DataFrame) -> DataFrame:
    """The span's own turns of each window, parsed from formatted: (conv_id, window, turns array<role, text>)."""
    pieces = F.filter(F.split("formatted", r"<\|im_end\|>\n", -1), lambda x: x != "")
    own = F.filter(pieces, lambda _, i: i >= F.col("n_context"))
    role = lambda x: F.regexp_extract(x, r"(?s)^((?:[^\\\n]|\\.)*+)\n", 1)
    parsed = F.transform(F.transform(own, lambda x: F.substr(x, F.lit(len(START) + 1))), lambda x: F.struct(unescape(role(x)).alias("role"), unescape(F.substr(x, F.length(role(x)) + 2)).alias("text")))
    return windows.withColumn("turns", parsed)


def chat_report(turns: DataFrame) -> DataFrame:
    """The digest of op5, read back from the formatted windows."""
    read = read_turns(chat_windows(turns))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss", lambda s: unescape(F.substr("formatted", s["start"] + 1, s["end"] - s["start"]))), "")
    parts = read.select("conv_id", "window", said.alias("said"), loss.alias("loss"), F.size("turns").alias("n"), F.length("formatted").alias("chars"))
    whole = lambda k: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("window", k))), lambda x: x[k]), "")
    out = parts.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), whole("said").alias("said"), whole("loss").alias("loss"), F.sum("chars").alias("formatted_chars"))
    return out.select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
