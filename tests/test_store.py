"""The store on disk: only hit partitions are read and written, versions are swapped whole, conflicts and notes."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import merge as M
from factloom.sources.store import Conflict, Store

SCHEMA = "owner_id long, key string, type string, value string, source string, at string, engine string"


def filled(spark, path, n=2000, buckets=16):
    store = Store(spark, str(path), SCHEMA, ["owner_id"], buckets=buckets)
    rows = spark.range(n).select(F.col("id").alias("owner_id"), F.lit("facts").alias("key"), F.lit("json").alias("type"), F.lit("old").alias("value"), F.lit("auto").alias("source"), F.lit("t0").alias("at"), F.lit("1").alias("engine"))
    store.change(rows, lambda current, new: new)
    return store


def candidates(spark, ids, value="new"):
    return spark.createDataFrame([(i, "facts", "json", value) for i in ids], "owner_id long, key string, type string, value string")


def apply(current, new):
    return M.apply_actions(current, M.merge_actions(new, current), F.lit("t1"), "2")


def files(store):
    return {f for f in store.read().inputFiles()}


def test_only_hit_partitions(spark, tmp_path):
    store = filled(spark, tmp_path / "s")
    before = files(store)
    ids = [3, 700]
    hit = {r[0] for r in candidates(spark, ids).select(store.part).collect()}
    done = store.change(candidates(spark, ids), apply)
    after = files(store)
    assert set(done.read) == set(done.written) == hit and done.version == 2
    assert len(before - after) == len(hit) == len(after - before)
    assert {r["owner_id"] for r in store.read().filter("value = 'new'").collect()} == set(ids) and store.read().count() == 2000
    assert store.read(version=1).filter("value = 'new'").count() == 0
    again = store.change(candidates(spark, ids), apply)
    assert store.read().count() == 2000 and again.version == 3
    store.vacuum()
    assert store.read().filter("value = 'new'").count() == 2 and store.manifest().number == 3
    with pytest.raises(Exception, match="1.json"):
        store.read(version=1)


def test_killed_run_leaves_the_old_version(spark, tmp_path):
    store = filled(spark, tmp_path / "s", 100, 4)
    broken = F.udf(lambda v: 1 / 0, "string")
    with pytest.raises(Exception, match="ZeroDivision"):
        store.change(candidates(spark, [1]), lambda current, new: current.withColumn("value", broken("value")))
    assert store.manifest().number == 1 and store.read().filter("value = 'old'").count() == 100
    assert not [r for r in store.files.names("data") if not any(at.startswith(r) for at in store.manifest().parts.values())] or store.vacuum() == []
    assert store.read().count() == 100


def test_of_two_runs_one_fails(spark, tmp_path):
    store = filled(spark, tmp_path / "s", 100, 4)

    def late(current, new):
        other = Store(spark, str(tmp_path / "s"), SCHEMA, ["owner_id"], buckets=4)
        other.change(candidates(spark, [2], "theirs"), apply)
        return apply(current, new)

    with pytest.raises(Conflict):
        store.change(candidates(spark, [1]), late)
    assert {r["value"] for r in store.read().filter("owner_id in (1, 2)").collect()} == {"old", "theirs"}
    store.vacuum()
    assert store.read().count() == 100


def test_partitions_that_empty(spark, tmp_path):
    """Withdrawn rows take their partition with them; null keys are keys; a change of no rows changes nothing; rows of other partitions are refused."""
    store = filled(spark, tmp_path / "s", 3, 64)
    done = store.change(candidates(spark, [0, 1, 2], "[]"), apply)
    assert store.read().count() == 0 and done.written == [] and store.manifest().parts == {}
    store.change(candidates(spark, [None]), apply)
    assert [r["owner_id"] for r in store.read().collect()] == [None]
    assert store.change(candidates(spark, []), apply).version == store.manifest().number == 3
    with pytest.raises(ValueError, match="doesn't hit"):
        store.change(candidates(spark, [5]), lambda current, new: new.selectExpr("owner_id + 1 as owner_id", "key", "type", "value", "'x' as source", "'x' as at", "'x' as engine"))


def test_notes(spark, tmp_path):
    store = filled(spark, tmp_path / "s", 10, 2)
    assert store.note("cursor") is None and store.set_note("cursor", "5", None) and not store.set_note("cursor", "6", "4")
    store.change(candidates(spark, [1]), apply, notes={"batch": "7"})
    assert (store.note("cursor"), store.note("batch")) == ("5", "7") and store.read().count() == 10


def test_upsert_of_repeated_and_null_keys(spark):
    table = spark.createDataFrame([(1, "a", 0), (None, "b", 0), (4, "d", 0)], "k int, v string, n int")
    new = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (None, "z", 1), (3, "c", 1), (3, "c", 1)], "k int, v string, n int")
    got = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert got(M.upsert(table, new, ["k"], "n")) == sorted([(1, "y", 2), (None, "z", 1), (3, "c", 1), (4, "d", 0)], key=repr)
    assert got(M.upsert(table, new, ["k"])) == got(M.upsert(table, new, ["k"], ["n"]))
    assert got(M.delete_keys(table, new, ["k"])) == [(4, "d", 0)]
    assert "NestedLoop" not in M.upsert(table, new, ["k"])._jdf.queryExecution().executedPlan().toString()
