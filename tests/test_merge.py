"""The decision table of merges, and that a second run writes nothing."""

from pyspark.sql import functions as F

from factloom.operators import merge as M

STORE = "owner_id long, key string, type string, value string, source string, at string, engine string"
NEW = "owner_id long, key string, type string, value string"


def store(spark):
    rows = [(1, "human", "old"), (2, None, "old"), (3, "auto", "old"), (4, "auto", ""), (5, "auto", "same"), (6, "auto", "old"), (8, "auto", "kept")]
    return spark.createDataFrame([(i, "facts", "json", v, s, "t0", "1") for i, s, v in rows], STORE)


def candidates(spark):
    rows = [(1, "new"), (2, "new"), (3, "[]"), (4, ""), (5, "same"), (6, "new"), (7, "new")]
    return spark.createDataFrame([(i, "facts", "json", v) for i, v in rows], NEW)


def test_decision_table(spark):
    got = {r["owner_id"]: r["action"] for r in M.merge_actions(candidates(spark), store(spark)).collect()}
    assert got == {1: "skipped", 2: "skipped", 3: "removed", 4: "none", 5: "unchanged", 6: "written", 7: "written"}
    kept = {r["owner_id"]: r["action"] for r in M.merge_actions(candidates(spark), store(spark), withdraw=False).collect()}
    assert kept[3] == "none"


def test_twice_writes_nothing(spark):
    once = M.apply_actions(store(spark), M.merge_actions(candidates(spark), store(spark)), F.lit("t1"), "2")
    values = {r["owner_id"]: (r["value"], r["source"], r["at"]) for r in once.collect()}
    assert values[1] == ("old", "human", "t0") and values[6] == ("new", "auto", "t1") and values[8] == ("kept", "auto", "t0") and 3 not in values
    again = {r["action"] for r in M.merge_actions(candidates(spark), once).collect()}
    assert again <= {"skipped", "unchanged", "none"}


def test_edit_reset_upsert(spark):
    edits = spark.createDataFrame([(5, "facts", "json", "same"), (6, "summary", "text", "mine")], NEW)
    edited = {(r["owner_id"], r["key"]): r["source"] for r in M.edit(store(spark), edits, F.lit("t2")).collect()}
    assert edited[(5, "facts")] == "human" and edited[(6, "summary")] == "human" and edited[(3, "facts")] == "auto"
    keys = spark.createDataFrame([(1, "facts")], "owner_id long, key string")
    compat = {r["owner_id"]: (r["value"], r["source"]) for r in M.reset(store(spark), keys).collect()}
    assert compat[1] == ("old", None)
    assert M.reset(store(spark), keys, "refill").filter("owner_id = 1").count() == 0
    table = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert {tuple(r) for r in M.upsert(table, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert M.delete_keys(table, table.filter("k = 1"), ["k"]).count() == 1
    state = spark.range(1).select(M.parse_state(F.lit("not json")).alias("a"), M.parse_state(F.lit('{"facts":{"source":"human"}}'))["facts"]["source"].alias("b")).first()
    assert state["a"] == {} and state["b"] == "human"
    assert {r["owner_id"]: r["written"] for r in M.outcomes(M.merge_actions(candidates(spark), store(spark))).collect()}[7] == ["facts"]
    assert M.batches(spark.range(50).select(F.lit(1).alias("owner_id"), F.col("id").alias("key"))).select("batch").distinct().count() == 3


def test_upsert_query_keeps_rows_of_equal_keys(spark, tmp_path):
    """0 is its own negative: its change and its added row are two rows; so are those of a repeated key, and a null key stays."""
    from factloom.plans import more

    spark.createDataFrame([(0, "F", "1-URGENT"), (1, "O", "2-HIGH"), (3, "P", "5-LOW"), (3, "P", "5-LOW"), (None, "F", "3-MEDIUM")], "o_orderkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted((r["id"] is None, r["id"] or 0, r["status"]) for r in more.upsert_rows(spark, str(tmp_path)).collect())
    assert got == [(False, -3, "5-LOW"), (False, -3, "5-LOW"), (False, 0, "1-URGENT"), (False, 0, "1-URGENT"), (False, 1, "O"), (False, 3, "5-LOW"), (False, 3, "5-LOW"), (True, 0, "F")]
