"""Properties sent to a store behind calls of a limited size, with a ledger of what has arrived.

Rows are sorted over all owners and packed by the place they have, so that calls are full and an owner of many rows is many
calls of many tasks. A call that fails doesn't end the run: what the others sent is entered in the ledger, then the run
fails, and the next one sends what is left. A task that is run again repeats its calls, so the target must take a row
twice, as an upsert does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.sources.shared import new_dir
from factloom.sources.store import Store, Written

SIZE, ATTEMPTS = 24, 3
FIELDS = ("owner_id", "key", "type", "value")


class CallsFailed(RuntimeError):
    """Some calls failed at each attempt; their rows are left for the next run."""


def ledger(spark: SparkSession, path: str, owner: str = "long", buckets: int = 64) -> Store:
    """What has arrived: the last content of each property."""
    return Store(spark, path, f"owner_id {owner}, key string, content string", ["owner_id"], buckets)


def packed(rows: DataFrame, size: int = SIZE) -> DataFrame:
    """(call, rows): at most size rows a call, in the order of owners and keys; a part of the sort ends with a call that isn't full."""
    place = F.monotonically_increasing_id()  # the part's number in the upper bits, then places from 0
    placed = rows.orderBy("owner_id", "key").withColumn("place", place)
    part, inside = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    call = (F.shiftleft(part, 33) + F.floor(inside / size)).alias("call")
    return placed.select(call, "place", F.struct(*rows.columns).alias("row")).groupBy("call").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "row"))), lambda x: x["row"]).alias("rows"))


def _calling(handler: Callable[[list[dict]], None], attempts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors = []
            for rows in batch.column("rows").to_pylist():
                said = None
                for _ in range(attempts):
                    try:
                        handler([{k: r[k] for k in FIELDS} for r in rows])
                        said = None
                        break
                    except Exception as e:  # whatever a target raises is told with the rows
                        said = f"{type(e).__name__}: {e}"[:500]
                errors.append(said)
            yield pa.RecordBatch.from_arrays([batch.column("rows"), pa.array(errors, pa.string())], names=["rows", "error"])

    return run


def send(rows: DataFrame, handler: Callable[[list[dict]], None], arrived: Store, size: int = SIZE, attempts: int = ATTEMPTS) -> Written:
    """Calls handler with size rows (owner_id, key, type, value) at a time for those that haven't arrived as they are."""
    spark = rows.sparkSession
    content = F.sha2(F.to_json(F.struct("type", "value"), {"ignoreNullFields": "false"}), 256).alias("content")
    todo = rows.select(*FIELDS, content)
    same = lambda a, b: a.eqNullSafe(b)
    known = arrived.read().alias("k")
    todo = todo.alias("t").join(known, same(F.col("t.owner_id"), F.col("k.owner_id")) & same(F.col("t.key"), F.col("k.key")) & (F.col("t.content") == F.col("k.content")), "left_anti")
    calls, at = packed(todo, size).select("rows"), new_dir(spark, "calls")
    calls.mapInArrow(_calling(handler, attempts), f"rows {dict(calls.dtypes)['rows']}, error string").write.parquet(at)
    told = spark.read.parquet(at)
    sent = told.filter("error is null").select(F.explode("rows").alias("r")).select("r.owner_id", "r.key", "r.content")
    done = arrived.change(sent, lambda current, new: new.unionByName(current.join(new.select(F.col("owner_id").alias("o"), F.col("key").alias("k")), same(F.col("owner_id"), F.col("o")) & same(F.col("key"), F.col("k")), "left_anti")))
    failed = told.filter("error is not null").agg(F.count("*").alias("n"), F.min("error").alias("error")).first()
    if failed["n"]:
        raise CallsFailed(f"{failed['n']} calls failed, as {failed['error']}")
    return done
