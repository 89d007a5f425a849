"""Keyed property store with provenance: people's values win, equal ones aren't rewritten, unsupported ones go.

properties has a row for each (owner_id, key) with value, source (auto, human or null), at and engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.sources.shared import new_dir

STATE = "map<string,struct<source:string,at:string,engine:string>>"


def parse_state(raw: Column) -> Column:
    """Provenance by key; an empty map for anything malformed."""
    return F.coalesce(F.from_json(raw, STATE), F.from_json(F.lit("{}"), STATE))


def may_write(source: Column, existing: Column) -> Column:
    """Not what a person wrote, and not a value of unknown origin."""
    return ~(source.eqNullSafe(F.lit("human")) | (F.coalesce(existing, F.lit("")) != "") & source.isNull())


def is_empty(value: Column) -> Column:
    return F.coalesce(value, F.lit("")).isin("", "[]", "{}")


def merge_actions(candidates: DataFrame, properties: DataFrame, withdraw: bool = True) -> DataFrame:
    """candidates (owner_id, key, type, value) with existing, source and action: one join on owner and key.

    skipped, removed, unchanged, written or none. withdraw=False, as for variants and collections, leaves what is
    no longer supported.
    """
    current = properties.select("owner_id", "key", F.col("value").alias("existing"), "source")
    joined = candidates.join(current, ["owner_id", "key"], "left")
    removable = F.lit(withdraw) & (F.coalesce("existing", F.lit("")) != "") & F.col("source").eqNullSafe(F.lit("auto"))
    action = (
        F.when(~may_write(F.col("source"), F.col("existing")), "skipped")
        .when(is_empty(F.col("value")), F.when(removable, "removed").otherwise("none"))
        .when(F.col("existing").eqNullSafe(F.col("value")), "unchanged")
        .otherwise("written")
    )
    return joined.withColumn("action", action)


def apply_actions(properties: DataFrame, actions: DataFrame, now: Column, engine: str) -> DataFrame:
    """The store after the actions; rows that nothing touches stay as they are."""
    changed = actions.filter(F.col("action").isin("written", "removed")).select("owner_id", "key", F.col("type").alias("new_type"), F.col("value").alias("new_value"), "action")
    joined = properties.join(changed, ["owner_id", "key"], "full_outer").filter(~F.col("action").eqNullSafe(F.lit("removed")))
    written = F.col("action").eqNullSafe(F.lit("written"))
    pick = lambda new, old: F.when(written, new).otherwise(F.col(old)).alias(old)
    return joined.select("owner_id", "key", pick(F.col("new_type"), "type"), pick(F.col("new_value"), "value"), pick(F.lit("auto"), "source"), pick(now, "at"), pick(F.lit(engine), "engine"))


def outcomes(actions: DataFrame) -> DataFrame:
    """(owner_id, written, skipped, unchanged, removed): keys by action."""
    keys = lambda a: F.sort_array(F.collect_list(F.when(F.col("action") == a, F.col("key")))).alias(a)
    return actions.groupBy("owner_id").agg(*[keys(a) for a in ("written", "skipped", "unchanged", "removed")])


def edit(properties: DataFrame, edits: DataFrame, now: Column, always: tuple[str, ...] = ("facts",)) -> DataFrame:
    """A person's edits (owner_id, key, type, value): changed fields, and the always keys, become human."""
    joined = properties.join(edits.select("owner_id", "key", F.col("type").alias("new_type"), F.col("value").alias("new_value"), F.lit(True).alias("edited")), ["owner_id", "key"], "full_outer")
    human = F.col("edited").eqNullSafe(F.lit(True)) & (~F.col("value").eqNullSafe(F.col("new_value")) | F.col("key").isin(*always))
    pick = lambda new, old: F.when(human, new).otherwise(F.col(old)).alias(old)
    return joined.select("owner_id", "key", pick(F.coalesce("new_type", "type"), "type"), pick(F.col("new_value"), "value"), pick(F.lit("human"), "source"), pick(now, "at"), "engine")


def reset(properties: DataFrame, keys: DataFrame, mode: str = "compat") -> DataFrame:
    """Drops the provenance of (owner_id, key): compat keeps the value, which stays protected; refill drops it too."""
    if mode == "refill":
        return properties.join(keys, ["owner_id", "key"], "left_anti")
    hit = properties.join(keys.withColumn("hit", F.lit(True)), ["owner_id", "key"], "left")
    none = lambda c: F.when(F.col("hit").isNull(), F.col(c)).alias(c)
    return hit.select("owner_id", "key", "type", "value", none("source"), none("at"), none("engine"))


def last_by(rows: DataFrame, keys: list[str], order: str | list[str]) -> DataFrame:
    """The last row of each key by the order columns; null keys are keys, and of equal rows in order the greatest stays."""
    order = [order] if isinstance(order, str) else order
    rest = [c for c in rows.columns if c not in keys]
    stamp = F.struct(*order, *[F.col(c) for c in rest if c not in order])
    last = rows.groupBy(*keys).agg(F.max(F.struct(stamp.alias("s"), F.struct(*rest).alias("r"))).alias("last_one"))
    return last.select(*[F.col(c) if c in keys else F.col("last_one.r")[c].alias(c) for c in rows.columns])


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], order: str | list[str] | None = None) -> DataFrame:
    """table with the rows of changes in place of its own of the same keys, nulls included.

    Of several changes of a key the last by order stays, or without order the greatest row.
    """
    rest = [c for c in changes.columns if c not in keys]
    once = last_by(changes, keys, order or rest) if rest else changes.distinct()
    return delete_keys(table, once, keys).unionByName(once)


def delete_keys(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """table without the rows of these keys; a null key is one."""
    gone = gone.select(*[F.col(k) for k in keys]).distinct().alias("gone")
    table = table.alias("kept")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"kept.`{k}`").eqNullSafe(F.col(f"gone.`{k}`"))
    return table.join(gone, same, "left_anti")


#: Rows of an owner that one task numbers.
BLOCK_BITS = 12


def batches(rows: DataFrame, size: int = 24) -> DataFrame:
    """rows with the number of the call in which a store with a limit per call would take them, by owner.

    Rows are sorted over all owners, null keys last, and numbered in blocks, so that an owner of many rows is many tasks'
    work. The sorted rows are written to the shared folder: a second sort of many rows may part them at other places.
    """
    placed = rows.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rows.columns)]).alias("rest"), "owner_id", "key")
    at = new_dir(rows.sparkSession, "batches")
    placed.orderBy("owner_id", F.asc_nulls_last("key")).select("rest", "owner_id", F.monotonically_increasing_id().alias("place")).write.parquet(at)
    placed = rows.sparkSession.read.parquet(at).withColumn("block", F.shiftright("place", BLOCK_BITS))
    inside = Window.partitionBy("owner_id", "block").orderBy("place")
    placed = placed.withColumn("nth", F.row_number().over(inside) - 1).withColumn("last", F.count("*").over(Window.partitionBy("owner_id", "block")))
    before = Window.partitionBy("owner_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offset = placed.filter("nth = 0").select(F.col("owner_id").alias("o"), F.col("block").alias("b"), F.coalesce(F.sum("last").over(before), F.lit(0)).alias("offset"))
    met = placed.join(offset, F.col("owner_id").eqNullSafe(F.col("o")) & (F.col("block") == F.col("b")))
    return met.select(*[F.col("rest")[f"c{i}"].alias(c) for i, c in enumerate(rows.columns)], F.floor((F.col("offset") + F.col("nth")) / size).alias("batch"))
