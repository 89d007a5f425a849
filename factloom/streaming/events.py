"""Change events applied to a store: what was changed last stays, whatever the order and however often events come.

A row of the store is a value of an owner (a product) of a tenant: (tenant, owner, key, value, at, sequence). An event
of kind create or update sets a value, delete takes an owner with all its values, purge a tenant with all its owners. Events
are ordered by (at, sequence); of equal ones delete and purge win, then the greater value. A deleted owner leaves a row of a
null key and a purged tenant a row of its own, so that older events that come later don't bring them back.

The number of the last batch is a note of the version that the batch wrote, so a batch that is played again writes
nothing, and one that failed half way is applied whole the next time.

Defined cases: null tenants and owners are keys as any other, a null key is '', a null time is before all others, other
kinds are passed over, other columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.joins import sized_join
from factloom.sources.store import Store

ROWS = "tenant string, owner string, key string, value string, at timestamp, sequence long"
SETS = ("create", "update")


def _stamp() -> Column:
    return F.struct("at", "sequence")


def _entries(events: DataFrame) -> DataFrame:
    """Events as rows of the store: values, and a null key for a deleted owner."""
    sets = F.col("kind").isin(*SETS)
    rows = events.filter(sets | (F.col("kind") == "delete"))
    return rows.select("tenant", "owner", F.when(sets, F.coalesce("key", F.lit(""))).alias("key"), F.when(sets, F.col("value")).alias("value"), "at", "sequence")


def _joined(rows: DataFrame, gone: DataFrame, keys: list[str], name: str) -> DataFrame:
    """rows that are newer than what went: gone (keys, name) has the stamp of it."""
    # null keys meet by coalescing to a value and a flag, so that the join is one of equal keys
    on = [x for k in keys for x in (F.coalesce(k, F.lit("")).alias(f"on_{k}"), F.isnull(k).alias(f"no_{k}"))]
    names = [x for k in keys for x in (f"on_{k}", f"no_{k}")]
    side = gone.select(*on, name)
    left = rows.select("*", *on)
    met = sized_join(left, side, names, "left") if len(keys) == 1 else left.join(side, names, "left")
    return met.filter(F.col(name).isNull() | (_stamp() > F.col(name))).select(*rows.columns)


def settle(rows: DataFrame, purges: DataFrame) -> DataFrame:
    """The rows that are left of rows and the events among them, in any order and number."""
    best = F.max(F.struct("at", "sequence", "value")).alias("b")
    newest = rows.groupBy("tenant", "owner", "key").agg(best).select("tenant", "owner", "key", "b.value", "b.at", "b.sequence")
    gone = newest.filter("key is null").select("tenant", "owner", _stamp().alias("gone"))
    values = _joined(newest.filter("key is not null"), gone, ["tenant", "owner"], "gone")
    return _joined(values.unionByName(newest.filter("key is null")), purges.select("tenant", _stamp().alias("purged")), ["tenant"], "purged")


class EventStore:
    """A store of owners' values that change events are applied to."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark = spark
        self.rows = Store(spark, f"{path}/rows", ROWS, ["tenant", "owner"], buckets)
        self.purges = Store(spark, f"{path}/purges", "tenant string, at timestamp, sequence long", ["tenant"], buckets)

    def apply(self, events: DataFrame, batch: int | None = None, stream: str = "events") -> bool:
        """Applies (kind, tenant, owner, key, value, at, sequence); whether the batch is new to the store."""
        note = f"batch of {stream}"
        if batch is not None and int(self.rows.note(note) or -1) >= batch:
            return False
        events = events.persist()
        try:
            purges = events.filter("kind = 'purge'").select("tenant", "at", "sequence")
            latest = lambda df: df.groupBy("tenant").agg(F.max(_stamp()).alias("s")).select("tenant", "s.*")
            self.purges.change(latest(purges), lambda current, new: latest(current.unionByName(new)))
            entries, known = _entries(events), self.purges.read()
            hit = entries.select(self.rows.part.alias("p"))
            # a purged tenant's rows may be in any partition; only their keys are read to find these
            owned = self.rows.read().select("tenant", "owner")
            named = purges.select(F.coalesce("tenant", F.lit("")).alias("t"), F.isnull("tenant").alias("n")).distinct()
            theirs = owned.select(self.rows.part.alias("p"), F.coalesce("tenant", F.lit("")).alias("t"), F.isnull("tenant").alias("n"))
            parts = [r["p"] for r in hit.unionByName(sized_join(theirs, named, ["t", "n"], "left_semi").select("p")).distinct().collect()]
            self.rows.change(entries, lambda current, new: settle(current.unionByName(new), known), {} if batch is None else {note: str(batch)}, parts)
        finally:
            events.unpersist()
        return True

    def live(self) -> DataFrame:
        """The values that there are."""
        return self.rows.read().filter("key is not null")

    def forget(self, before: Column) -> None:
        """Removes what deletions before a time have left; older events that come later still would bring their owners back."""
        marks = self.rows.read().filter("key is null").filter(F.col("at") < before)
        self.rows.change(marks.select("tenant", "owner"), lambda current, _: current.filter(F.col("key").isNotNull() | (F.col("at") >= before) | F.col("at").isNull()))

    def handler(self, shape: Callable[[DataFrame], DataFrame] = lambda df: df, stream: str = "events") -> Callable[[DataFrame, int], None]:
        """For foreachBatch: applies each batch of shape(events)."""

        def handle(batch: DataFrame, number: int) -> None:
            self.apply(shape(batch), number, stream)

        return handle
