"""Conversation structure repair: faults of turns and the cheapest edits that give a well-formed conversation.

A repaired conversation is empty, or has alternating user and assistant turns from a user's to an assistant's, after
at most one system turn. Edits keep a turn (0), give it the role of user or assistant (3), delete it (4; blank and
repeated turns must go) or insert an empty turn (3); a truncated turn that isn't deleted costs 3 more. Of equally
cheap repairs the one whose edits' initials (K, R, D, I) come first in ASCII is taken.

Turns are sorted once over all conversations and numbered in that order; runs of at most 1 << BLOCK_BITS of a
conversation are blocks, so that a conversation of any length is many tasks' work. Windows inside blocks find faults;
each block's sorted turn structs are folded by aggregate(), which carries four (cost, audit) structs: the cheapest
way to have written nothing yet, a system turn, a user's turn last, an assistant's last. The fold is run from each of
these four states, and a second one chains the blocks of a conversation by what their folds gave. Two different edit
lists of equal cost that lead to one state never begin with each other, so the least struct stays the least whatever
follows. Two insertions in a row are never cheapest, as deleting a turn costs less than both, so one is tried before
each turn and at the end.

Defined cases: null roles and texts count as one space; turns are ordered by turn (nulls first), role and text, and
repeated rows are turns of their own (the later ones duplicates); rows of a null conv_id form a conversation; an
empty table gives an empty one; other columns are left out. A conversation's audit, and in repair_report its whole
text, which its digest needs, are values of one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import Workspace

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
BLOCK_BITS = 8
STATES = ("none", "system", "user", "assistant")
#: The cost of a state that can't be reached.
FAR = 1 << 40
SPACES = " \t\n\x0b\x0c\r"
#: A row's edit in an audit, with an insertion before it.
EDIT = "I?[DKR]"


def _let(x: Column, use: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(x), lambda v: use(v))[0]


# ---------------------------------------------------------------- the fold


def _cell(cost: Column, audit: Column) -> Column:
    return F.struct(cost.cast("long").alias("cost"), audit.alias("audit"))


def _then(x: Column, cost: int, edit: str) -> Column:
    return _cell(x["cost"] + cost, F.concat(x["audit"], F.lit(edit)))


def _states(none: Column, system: Column, user: Column, assistant: Column) -> Column:
    return F.struct(*[x.alias(s) for s, x in zip(STATES, (none, system, user, assistant), strict=True)])


def _start(state: str) -> Column:
    return _states(*[_cell(F.lit(0 if s == state else FAR), F.lit("")) for s in STATES])


def _inserted(a: Column) -> Column:
    """The states with a turn inserted where that is cheaper."""
    user = F.least(a["user"], _then(F.least(a["none"], a["system"], a["assistant"]), INSERT, "I"))
    return _states(a["none"], a["system"], user, F.least(a["assistant"], _then(a["user"], INSERT, "I")))


def _step(acc: Column, row: Column) -> Column:
    """The states after one more turn (initial, must_go, truncated)."""
    more = F.when(row["truncated"], TRUNCATED).otherwise(0)

    def becomes(x: Column, initial: str) -> Column:
        same = row["initial"] == initial
        return F.when(~row["must_go"], _cell(x["cost"] + more + F.when(same, KEEP).otherwise(REROLE), F.concat(x["audit"], F.when(same, "K").otherwise("R"))))

    def moved(a: Column) -> Column:
        gone = lambda s: _then(a[s], DELETE, "D")
        system = F.when(~row["must_go"] & (row["initial"] == "s"), _cell(a["none"]["cost"] + more + KEEP, F.concat(a["none"]["audit"], F.lit("K"))))
        user = becomes(F.least(a["none"], a["system"], a["assistant"]), "u")
        return _states(gone("none"), F.least(gone("system"), system), F.least(gone("user"), user), F.least(gone("assistant"), becomes(a["user"], "a")))  # least() passes over nulls

    return _let(_inserted(acc), moved)


def _chained(acc: Column, block: Column) -> Column:
    """The states after a block, of which block.fold has the four states for each state before it."""

    def through(to: str) -> Column:
        way = lambda s: _cell(acc[s]["cost"] + block["fold"][s][to]["cost"], F.concat(acc[s]["audit"], block["fold"][s][to]["audit"]))
        return F.least(*map(way, STATES))

    return _states(*map(through, STATES))


def _ended(acc: Column) -> Column:
    return _let(_inserted(acc), lambda a: F.least(a["none"], a["assistant"]))


# ---------------------------------------------------------------- the job


def _placed(turns: DataFrame, work: Workspace) -> DataFrame:
    """(c, conv_id, turn, role, text, n, block): c is a key without nulls, n grows in the order of turns."""
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit("\0"))
    said = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    # the row's place tells equal rows apart, so that many of them aren't one range's
    t = turns.select(key.alias("c"), "conv_id", "turn", said("role"), said("text"), F.monotonically_increasing_id().alias("at"))
    t = t.orderBy("c", F.col("turn").asc_nulls_first(), "role", "text", "at").drop("at").withColumn("n", F.monotonically_increasing_id())
    # a partition's numbers are consecutive and its first is a multiple of the block's size
    return work.table(t.withColumn("block", F.shiftright("n", BLOCK_BITS)), "turns")


def _flagged(placed: DataFrame, work: Workspace) -> DataFrame:
    """(c, n, block, initial, before, blank, duplicate, truncated): at most one of the last three; before is the initial before it in its block."""
    bare = F.rtrim("text", F.lit(SPACES))
    looks = placed.select("c", "n", "block", "role", F.sha2("text", 256).alias("h"), F.substring("role", 1, 1).alias("initial"), (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("open_end"))
    inside = Window.partitionBy("c", "block").orderBy("n")
    same = Window.partitionBy("c", "block", "role", "h").orderBy("n")
    looks = work.table(looks.withColumns({"before": F.lag("initial").over(inside), "nth": F.row_number().over(same)}), "looks")
    # of the firsts of blocks the first of the conversation; numbers are unique, so a saying that fills a conversation isn't one task's
    fresh = looks.filter("nth = 1 and not blank").groupBy("c", "role", "h").agg(F.min("n").alias("n")).select("n", F.lit(True).alias("fresh"))
    duplicate = ~F.col("blank") & F.col("fresh").isNull()
    found = looks.drop("role", "h", "nth").join(fresh, "n", "left")
    return found.select("c", "n", "block", "initial", "before", "blank", duplicate.alias("duplicate"), (~F.col("blank") & ~duplicate & F.col("open_end")).alias("truncated"))


def _illegal(before: Column, initial: Column) -> Column:
    return before.isNotNull() & ~F.concat(before, initial).isin("su", "ua", "au")


def repair(turns: DataFrame, work: Workspace | None = None) -> tuple[DataFrame, DataFrame]:
    """(conversations, repaired turns) of turns (conv_id, turn, role, text).

    Conversations: c (a key), conv_id, blank, duplicate, truncated, illegal, cost, audit. Repaired turns: c, conv_id, position
    (from 0), turn (null if inserted), role, text, edit (K, R or I).
    """
    work = work or Workspace(turns.sparkSession, "repair")
    placed = _placed(turns, work)
    flagged = _flagged(placed, work)
    rows = F.sort_array(F.collect_list(F.struct("n", "initial", (F.col("blank") | F.col("duplicate")).alias("must_go"), "truncated")))
    counts = [F.count_if(c).alias(c) for c in ("blank", "duplicate", "truncated")]
    blocks = flagged.groupBy("c", "block").agg(rows.alias("rows"), *counts, F.count_if(_illegal(F.col("before"), F.col("initial"))).alias("illegal"))
    folds = F.struct(*[F.aggregate("rows", _start(s), _step).alias(s) for s in STATES])
    blocks = work.table(blocks.withColumn("fold", folds), "blocks")
    # between blocks: initials that meet, and how many turns stand before
    over = Window.partitionBy("c").orderBy("block")
    last = F.lag(F.element_at("rows", -1)["initial"]).over(over)
    chain = blocks.select("c", "block", "fold", F.size("rows").alias("size"), "blank", "duplicate", "truncated", (F.col("illegal") + _illegal(last, F.col("rows")[0]["initial"]).cast("int")).alias("illegal"))
    chain = chain.withColumn("before", F.coalesce(F.sum("size").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")]
    chains = chain.groupBy("c").agg(*sums, F.sort_array(F.collect_list(F.struct("block", "before", "size", "fold"))).alias("blocks"))
    whole = F.aggregate("blocks", _start("none"), _chained, _ended)
    chains = work.table(chains.withColumn("whole", whole).withColumn("blocks", F.transform("blocks", lambda b: b.dropFields("fold"))), "chains")
    owners = placed.groupBy("c").agg(F.max("conv_id").alias("conv_id"))
    audits = chains.join(owners, "c").select("c", "conv_id", "blank", "duplicate", "truncated", "illegal", F.col("whole.cost").alias("cost"), F.col("whole.audit").alias("audit"))
    # each block's part of the audit, then each turn's
    parts = lambda edits: F.transform("blocks", lambda b: F.struct(b["block"].alias("block"), F.slice(edits, (b["before"] + 1).cast("int"), b["size"]).alias("edits")))
    out = lambda x: F.length(F.replace(F.array_join(x, ""), F.lit("D"), F.lit("")))  # noqa: E731  how many turns edits give
    # an odd number of turns has a system turn before its pairs
    system = F.length(F.replace("whole.audit", F.lit("D"), F.lit(""))) % 2
    part = chains.select("c", system.alias("system"), F.explode(_let(F.regexp_extract_all("whole.audit", F.lit(EDIT), F.lit(0)), parts)).alias("p")).select("c", "system", "p.*")
    part = part.withColumn("given", F.coalesce(F.sum(out(F.col("edits"))).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    each = part.join(blocks.select("c", "block", "rows"), ["c", "block"])
    each = each.select("c", "system", F.explode(F.zip_with(F.col("rows"), F.transform("edits", lambda e, i: F.struct(e.alias("edit"), (F.col("given") + out(F.slice("edits", 1, i))).alias("at"))), lambda r, e: F.struct(r["n"].alias("n"), e["edit"].alias("edit"), e["at"].alias("at")))).alias("e")).select("c", "system", "e.*")
    role = lambda at: F.when((at - F.col("system")) % 2 == 0, "user").otherwise("assistant")
    ins, op = F.col("edit").startswith("I"), F.right("edit", F.lit(1))
    at = F.col("at") + ins.cast("int")
    empty = F.struct(F.col("at").alias("position"), F.lit(None).cast(turns.schema["turn"].dataType).alias("turn"), role(F.col("at")).alias("role"), F.lit("").alias("text"), F.lit("I").alias("edit"))
    stays = F.struct(at.alias("position"), F.col("turn"), F.when(op == "R", role(at)).otherwise(F.col("role")).alias("role"), F.col("text"), op.alias("edit"))
    # what is null here isn't there: compact drops it
    made = F.array_compact(F.array(F.when(ins, empty), F.when(op != "D", stays)))
    repaired = placed.select("n", "c", "conv_id", "turn", "role", "text").join(each.drop("c"), "n").select("c", "conv_id", F.explode(made).alias("m")).select("c", "conv_id", "m.*")
    last_one = audits.filter(F.col("audit").endswith("I"))
    count = F.length(F.replace("audit", F.lit("D"), F.lit("")))
    ending = last_one.select("c", "conv_id", (count - 1).cast("long").alias("position"), F.lit(None).cast(turns.schema["turn"].dataType).alias("turn"), F.lit("assistant").alias("role"), F.lit("").alias("text"), F.lit("I").alias("edit"))
    return audits, repaired.withColumn("position", F.col("position").cast("long")).unionByName(ending)


# ---------------------------------------------------------------- the report


def damage(turns: DataFrame) -> DataFrame:
    """turns with known faults, by the checksum of conversation and turn modulo 20: 0 goes, 1 loses its text, 2 its marks of an end, 3 comes twice, 4 is a user's."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(k == 1, "").when(k == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text"))
    copies = F.when(k == 0, 0).when(k == 3, 2).otherwise(1)
    return turns.select("conv_id", "turn", F.when(k == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), copies)).alias("copy")).drop("copy")


def repair_report(turns: DataFrame) -> DataFrame:
    """The digest of op11: the damaged turns' faults, their repair and its text, a row for each conversation of turns."""
    work = Workspace(turns.sparkSession, "repair")
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit("\0")).alias("c")
    damaged = damage(turns)
    audits, repaired = repair(damaged, work)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0))
    gaps = damaged.groupBy(key).agg(gaps.cast("long").alias("gaps"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("position", F.concat("role", F.lit(":"), "text").alias("line")))), lambda x: x["line"])
    texts = repaired.groupBy("c").agg(F.sha2(F.array_join(lines, "\n"), 256).alias("sha"))
    every = turns.groupBy(key).agg(F.max("conv_id").alias("conv_id"))
    out = every.join(gaps, "c", "left").join(audits.drop("conv_id"), "c", "left").join(texts, "c", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
