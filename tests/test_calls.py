"""Calls of a limited size: full, in order, resumed after one that fails."""

import json
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from factloom.operators import merge as M
from factloom.sources import calls

SCHEMA = "owner_id long, key string, type string, value string"


def target(folder, fails=()):
    """A store that writes each call to a file and fails at owners until it has been asked so often."""

    def take(rows):
        assert 0 < len(rows) <= 24
        for owner, times in fails:
            if any(r["owner_id"] == owner for r in rows):
                seen = len(list(Path(folder).glob(f"asked-{owner}-*")))
                Path(folder, f"asked-{owner}-{uuid.uuid4().hex}").touch()
                if seen < times:
                    raise ConnectionError("busy")
        Path(folder, f"call-{uuid.uuid4().hex}").write_text(json.dumps(rows))

    return take


def taken(folder):
    return [json.loads(p.read_text()) for p in Path(folder).glob("call-*")]


def test_calls_resume(spark, tmp_path):
    rows = [(i % 40, f"k{i // 40}", "text", f"v{i}") for i in range(300)] + [(None, "k", None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    ledger = calls.ledger(spark, str(tmp_path / "ledger"), buckets=4)
    (tmp_path / "t").mkdir()
    with pytest.raises(calls.CallsFailed, match="ConnectionError: busy"):
        calls.send(df, target(tmp_path / "t", [(7, 2)]), ledger, attempts=1)
    first = [r["value"] for c in taken(tmp_path / "t") for r in c]
    assert len(first) == len(set(first)) < len(rows) and ledger.read().count() == len(first)
    calls.send(df, target(tmp_path / "t", [(7, 2)]), ledger, attempts=3)
    every = [tuple(r.values()) for c in taken(tmp_path / "t") for r in c]
    assert sorted(every, key=repr) == sorted(rows, key=repr)
    calls.send(df, target(tmp_path / "t"), ledger)
    assert len(taken(tmp_path / "t")) == len({json.dumps(c) for c in taken(tmp_path / "t")}) and sum(map(len, taken(tmp_path / "t"))) == len(rows)
    changed = df.withColumn("value", F.when(F.col("owner_id") == 3, "new").otherwise(F.col("value")))
    calls.send(changed, target(tmp_path / "t"), ledger)
    calls.send(df, target(tmp_path / "t"), ledger)  # back to what was: sent again
    assert sum(map(len, taken(tmp_path / "t"))) == len(rows) + 2 * sum(r[0] == 3 for r in rows)


def test_calls_are_full(spark):
    """One owner with nearly all rows is many calls, and all but the last of a part are full."""
    df = spark.range(1000).select(F.when(F.col("id") < 990, 1).otherwise(F.col("id")).alias("owner_id"), F.format_string("%05d", "id").alias("key"))
    sizes = [len(r["rows"]) for r in calls.packed(df).collect()]
    assert sum(sizes) == 1000 and max(sizes) == 24 and sum(n < 24 for n in sizes) <= 4


def test_batches_of_a_large_owner(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_BITS", 4)
    df = spark.range(700).select(F.when(F.col("id") % 3 == 0, F.col("id") % 9).alias("owner_id"), F.format_string("%05d", "id").alias("key"), F.lit(1).alias("batch"), F.lit(2).alias("block")).drop("batch")
    got = {}
    for r in M.batches(df).collect():
        got.setdefault(r["owner_id"], []).append((r["key"], r["batch"]))
    for own in got.values():
        assert [b for _, b in sorted(own)] == [k // 24 for k in range(len(own))]
    assert len(got) == 4 and len(got[None]) == 466


def test_batches_of_rows_that_a_sort_parts_by_a_sample(spark):
    """Beyond a sample's size, two sorts part rows at other places; every row has one batch, null keys the last places."""
    rows = spark.range(200_000, numPartitions=8).select((F.xxhash64("id") % 40).alias("owner_id"), F.when(F.col("id") % 50 > 0, F.hex(F.xxhash64(F.col("id") + 1))).alias("key"), F.col("id").alias("no"))
    got = M.batches(rows).toPandas()
    assert got["no"].is_unique and len(got) == 200_000
    for _, own in got.groupby("owner_id"):
        assert list(own.sort_values(["key", "batch"], na_position="last")["batch"]) == [k // 24 for k in range(len(own))]
