"""Freshness: change events and polls as Structured Streaming, and the sweep for what they missed."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.operators.derive import capsule_fields
from factloom.operators.extract import extract
from factloom.operators.merge import apply_actions, merge_actions
from factloom.sources.store import Store


def changes(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    """A stream of change events (product_id, kind, at) from Parquet files; Spark's checkpoint is the cursor."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def distinct_changes(events: DataFrame, within: str = "15 minutes", key: str = "product_id", at: str = "at") -> DataFrame:
    """One event per product and interval; late events are told from repeated ones by the watermark's state."""
    return events.withWatermark(at, within).dropDuplicatesWithinWatermark([key])


def poll(events: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Handles all that has come since the last run, batch by batch, and ends."""
    return events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def refresh(products: DataFrame, properties: DataFrame, now: Column, engine: str, dictionary: str | None = None) -> DataFrame:
    """The property store after extracting and merging these products; the same code for batches and streams."""
    fields = capsule_fields(extract(products, dictionary))
    return apply_actions(properties, merge_actions(fields, properties), now, engine)


def refresh_changed(products: DataFrame, changed: DataFrame, properties: DataFrame, now: Column, engine: str, dictionary: str | None = None, key: str = "product_id") -> DataFrame:
    """refresh for the products that a batch of events names."""
    named = products.join(changed.select(F.col(key).alias("id")).distinct(), "id", "left_semi")
    return refresh(named, properties, now, engine, dictionary)


def sweep_missing(products: DataFrame, properties: DataFrame) -> DataFrame:
    """Products without facts in the store."""
    # explode_outer: the optimizer would push the test of value below what computes it, with every step of that written out again
    have = properties.filter(F.col("key") == "facts").select(F.col("owner_id").alias("id"), F.explode_outer(F.array("value")).alias("value")).filter(F.coalesce("value", F.lit("")) != "").select("id")
    return products.join(have, "id", "left_anti")


def poll_cursor(last: Column | None, started: Column) -> Column:
    """Where a poll begins: the start of the last successful one, or an hour back at first."""
    return started - F.make_interval(hours=F.lit(1)) if last is None else F.coalesce(last, started - F.make_interval(hours=F.lit(1)))


#: What the state of polls keeps: the version (id, updated_at) of each product that we wrote ourselves.
OWN_WRITES = "id long, updated_at timestamp"


def poll_state(spark: SparkSession, path: str, buckets: int = 64) -> Store:
    """Our own last write of each product, and the polls' cursor as a note."""
    return Store(spark, path, OWN_WRITES, ["id"], buckets)


def record_own_writes(state: Store, written: DataFrame) -> None:
    """Remembers products (id, updated_at) that we have written, the last write of each, so that a poll passes over them."""
    state.change(written.select("id", "updated_at"), lambda current, new: current.unionByName(new).groupBy("id").agg(F.max("updated_at").alias("updated_at")))


def changed_by_others(products: DataFrame, since: Column, own_writes: DataFrame) -> DataFrame:
    """Products updated after since, but for the versions that are our own writes."""
    ours = own_writes.select("id", F.col("updated_at").alias("updated_at")).filter(F.col("updated_at") > since)
    return products.filter(F.col("updated_at") > since).join(ours, ["id", "updated_at"], "left_anti")


def poll_once(products: DataFrame, state: Store, started: datetime, handle: Callable[[DataFrame], None]) -> bool:
    """Hands on what others changed since the last successful poll; the cursor moves only after that, and only from where it was.

    Whether it moved: a poll that fails raises and leaves it, one that another has overtaken leaves it too.
    """
    last = state.note("cursor")
    since = datetime.fromisoformat(last) if last else started - timedelta(hours=1)
    handle(changed_by_others(products, F.lit(since), state.read()))
    return state.set_note("cursor", started.isoformat(), last)


def rollup_stream(hits: DataFrame, late: str = "1 day") -> DataFrame:
    """Daily hits per agent and handle from a stream of requests."""
    day = F.window("at", "1 day")
    return hits.withWatermark("at", late).groupBy(day, "agent", "handle").agg(F.count_if(F.col("status") != 404).alias("hits"), F.count_if(F.col("status") == 404).alias("misses")).select(F.to_date("window.start").alias("day"), "agent", "handle", "hits", "misses")
