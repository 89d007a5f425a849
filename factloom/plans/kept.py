"""Queries of what is kept from run to run (the store, events, roll-ups, owners, counts, cursors), with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from factloom.operators import coverage as V
from factloom.operators import merge as M
from factloom.operators import monitor as O
from factloom.operators import retention as R
from factloom.operators.extract import extract
from factloom.plans.testmap import DICTIONARY, SQL_P, candidates, hits, products, properties, stored, table, with_facts
from factloom.operators.screens import append_log
from factloom.sources.catalogue import fold_children, read_lines, with_settings
from factloom.sources.shared import new_dir
from factloom.sources.store import Store
from factloom.streaming import freshness as S
from factloom.streaming.events import EventStore

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


PROPERTIES = "owner_id long, key string, type string, value string, source string, at string, engine string"


@query(
    "SELECT p_partkey AS owner_id, CASE WHEN p_partkey % 100 = 0 AND a = 'written' OR p_partkey % 6 IN (1, 2, 4) THEN 'auto' WHEN p_partkey % 6 = 0 THEN 'human' END AS source, CASE WHEN p_partkey % 100 = 0 AND a = 'written' THEN '2024-02-01' ELSE '2024-01-01' END AS at "
    "FROM (SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN 'skipped' WHEN p_partkey % 4 = 0 THEN CASE WHEN p_partkey % 6 IN (1, 2, 4) THEN 'removed' ELSE 'none' END WHEN p_partkey % 6 = 1 THEN 'unchanged' ELSE 'written' END AS a FROM part) "
    "WHERE CASE WHEN p_partkey % 100 = 0 THEN a = 'written' OR a <> 'removed' AND p_partkey % 6 <> 3 ELSE p_partkey % 6 <> 3 END"
)
def store_merge(spark, sf_dir):
    """The store on disk after a change of one product in a hundred, which reads and writes these products' partitions only."""
    p = stored(with_facts(spark, sf_dir).select("id", "facts"), "facts")
    store = Store(spark, new_dir(spark, "properties"), PROPERTIES, ["owner_id"], buckets=256)
    store.change(properties(p), lambda current, new: new)
    store.change(candidates(p).filter("owner_id % 100 = 0"), lambda current, new: M.apply_actions(current, M.merge_actions(new, current), F.lit("2024-02-01"), "2"))
    return store.read().select("owner_id", "source", "at")


EVENTS = """
WITH e AS (SELECT CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 40 = 0 THEN 'purge' ELSE 'delete' END ELSE 'update' END AS kind, user_id % 9 AS tenant, user_id AS owner, event_id % 3 AS key, value, ts, event_id FROM events),
purged AS (SELECT tenant, max((ts, event_id)) AS s FROM e WHERE kind = 'purge' GROUP BY 1),
gone AS (SELECT tenant, owner, max((ts, event_id)) AS s FROM e WHERE kind = 'delete' GROUP BY 1, 2),
last AS (SELECT tenant, owner, key, max((ts, event_id)) AS s, arg_max(value, (ts, event_id)) AS value FROM e WHERE kind = 'update' GROUP BY 1, 2, 3)
"""


def change_events(spark, sf_dir):
    """Requests as changes: errors delete a product, or purge a tenant; the others set one of three values."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 40 == 0, "purge").otherwise("delete")).otherwise("update")
    return e.select("event_id", kind.alias("kind"), (F.col("user_id") % 9).cast("string").alias("tenant"), F.col("user_id").cast("string").alias("owner"), (F.col("event_id") % 3).cast("string").alias("key"), F.col("value").cast("string").alias("value"), F.col("ts").alias("at"), F.col("event_id").alias("sequence"))


@query(
    EVENTS + "SELECT CAST(l.tenant AS VARCHAR) AS tenant, CAST(l.owner AS VARCHAR) AS owner, CAST(l.key AS VARCHAR) AS key, CAST(l.value AS DOUBLE) AS value FROM last l LEFT JOIN gone g USING (tenant, owner) LEFT JOIN purged p USING (tenant) WHERE (g.s IS NULL OR l.s > g.s) AND (p.s IS NULL OR l.s > p.s)"
)
def events_applied(spark, sf_dir):
    """What is left after all events, in three batches out of order, one of them played twice and some events repeated."""
    events, store = change_events(spark, sf_dir), EventStore(spark, new_dir(spark, "events"), buckets=16)
    for number, rest in enumerate((2, 0, 0, 1)):
        store.apply(events.filter((F.col("event_id") % 3 == rest) | (F.col("event_id") % 50 == 0)), number - (number > 1))
    return store.live().select("tenant", "owner", "key", F.col("value").cast("double").alias("value"))


@query(
    EVENTS + "SELECT CAST(l.tenant AS VARCHAR) AS tenant, count(*) AS n FROM last l LEFT JOIN gone g USING (tenant, owner) LEFT JOIN purged p USING (tenant) WHERE (g.s IS NULL OR l.s > g.s) AND (p.s IS NULL OR l.s > p.s) GROUP BY 1"
)
def events_streamed(spark, sf_dir):
    """The same by a stream with foreachBatch: values left of each tenant."""
    store, at = EventStore(spark, new_dir(spark, "events"), buckets=16), new_dir(spark, "changes")
    change_events(spark, sf_dir).repartition(4).write.parquet(f"{at}/in")
    stream = S.changes(spark, f"{at}/in", "event_id long, kind string, tenant string, owner string, key string, value string, at timestamp, sequence long", files=2)
    S.poll(stream, f"{at}/checkpoint", store.handler()).awaitTermination()
    return store.live().groupBy("tenant").agg(F.count("*").alias("n"))


BOTS = ("click", "view", "error")
DAILY = "SELECT CAST(ts AS DATE) AS day, CASE WHEN event_type IN ('click', 'view', 'error') THEN event_type ELSE 'other' END AS bot, 'part-' || user_id AS handle, count(*) FILTER (event_type <> 'error') AS hits, count(*) FILTER (event_type = 'error') AS misses FROM events GROUP BY 1, 2, 3"


@query(DAILY)
def hits_three_runs(spark, sf_dir):
    """Daily sums added in three runs, the last of them again, with rows of all days in each: late ones reopen their days."""
    store, h = R.hit_sums(spark, new_dir(spark, "hits")), hits(spark, sf_dir)
    for number, rest in enumerate((0, 1, 2, 2)):
        R.add_hits(store, h.filter(F.col("event_id") % 3 == rest), min(number, 2), BOTS)
    return store.read()


@query("SELECT count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM events WHERE ts >= TIMESTAMP '2024-01-11 00:00:00'")
def raw_hits_kept(spark, sf_dir):
    """Raw rows of the last 30 days; days are dropped whole, without reading a row."""
    store = R.raw_hits(spark, new_dir(spark, "raw"), "event_id long, at timestamp, agent string, handle string")
    R.append_raw(store, hits(spark, sf_dir).select("event_id", "at", "agent", "handle"))
    R.prune(store, datetime.date(2024, 2, 10), days=R.RAW_DAYS)
    return store.read().agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


@query("SELECT event_type AS path, count(*) AS n, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS failure_rate, TRUE AS p50_close, TRUE AS p95_close FROM events GROUP BY 1")
def latency_days(spark, sf_dir):
    """Latencies of merged daily sketches; the ranks of their quantiles are counted in the rows and lie within the stated error."""
    m = hits(spark, sf_dir).select("at", F.col("agent").alias("path"), F.col("value").alias("ms"), (F.col("status") == 200).alias("ok"))
    store = R.latency_sums(spark, new_dir(spark, "latency"))
    for number in range(2):
        R.add_latencies(store, m.filter(F.dayofmonth("at") % 2 == number), number)
    told = R.latency_summary(store.read())
    close = lambda p, q: ((F.avg((F.col("ms") < F.col(p)).cast("double")) <= q + R.SKETCH_ERROR) & (F.avg((F.col("ms") <= F.col(p)).cast("double")) >= q - R.SKETCH_ERROR)).alias(f"{p}_close")
    ranks = m.join(F.broadcast(told.select("path", "p50", "p95")), "path").groupBy("path").agg(close("p50", 0.5), close("p95", 0.95))
    return told.select("path", "n", F.round("failure_rate", 6).alias("failure_rate")).join(ranks, "path")


@query(
    "WITH i AS (SELECT event_id, user_id % 50 AS media_id, event_id // 4 AS product_id, event_id % 4 AS position, event_type NOT IN ('error', 'click') AS human FROM events), "
    "o AS (SELECT *, last_value(CASE WHEN NOT human THEN product_id END IGNORE NULLS) OVER (PARTITION BY media_id ORDER BY product_id, position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS owner FROM i) "
    "SELECT event_id, CASE WHEN NOT human THEN 'written' WHEN owner IS NOT NULL AND owner <> product_id THEN 'shared' ELSE 'kept' END AS action FROM o"
)
def alt_merge_runs(spark, sf_dir):
    """Alt texts merged in two runs of half the products each, the second with the owners of the first."""
    e = table(spark, sf_dir, "events")
    alt = F.when(F.col("event_type") == "error", "").when(F.col("event_type") == "click", "IMG_1234").otherwise("A person wrote this")
    product = F.floor(F.col("event_id") / 4)
    images = e.select("event_id", (F.col("user_id") % 50).alias("media_id"), product.alias("product_id"), product.alias("product_ord"), (F.col("event_id") % 4).alias("position"), alt.alias("alt"), F.lit("suggested").alias("suggestion"))
    half = e.agg(F.max("event_id")).first()[0] // 8
    first, second = images.filter(F.col("product_ord") < half), images.filter(F.col("product_ord") >= half)
    both = O.alt_merge(first, block=64).unionByName(O.alt_merge(second, owners=O.media_owners(first), block=64))
    return both.select("event_id", "action")


@query(SQL_P + "SELECT u.k AS label, count(*) AS n_products FROM (SELECT unnest(facts) AS u FROM f) GROUP BY 1")
def coverage_kept(spark, sf_dir):
    """Counts of an older catalogue after the differences of what has changed, come or gone: those of a recount."""
    now = products(spark, sf_dir, apart=True)
    k = F.col("id") % 10
    was = now.filter(k != 1).withColumn("title", F.when(k == 2, "gizmo").otherwise(F.col("title"))).unionByName(now.filter("id % 50 = 0").withColumn("id", -F.col("id") - 1))
    changed = lambda df, *kinds: extract(df, DICTIONARY).filter((F.col("id") % 10).isin(*kinds) | (F.col("id") < 0)).select("id", "facts")
    counts = V.coverage(extract(was, DICTIONARY))
    return V.merge_counts(counts, V.label_deltas(changed(was, 2), changed(now, 1, 2)))


@query(SQL_P + "SELECT vendor AS collection_id, u.k AS label, count(DISTINCT id) AS n_products FROM (SELECT id, vendor, unnest(facts) AS u FROM f) GROUP BY 1, 2")
def collection_counts_kept(spark, sf_dir):
    """The same by brand, after products have moved from one brand to another."""
    p = with_facts(spark, sf_dir).select("id", "facts", F.col("vendor").alias("collection_id"))
    was = p.withColumn("collection_id", F.when(F.col("id") % 7 == 0, "Brand#1").otherwise(F.col("collection_id")))
    labels = F.explode(F.array_distinct(F.transform("facts", lambda f: f["k"]))).alias("label")
    counts = was.select("collection_id", labels).groupBy("collection_id", "label").agg(F.count("*").alias("n_products"))
    moved = "id % 7 = 0"
    return V.merge_counts(counts, V.label_deltas(was.filter(moved), p.filter(moved), by=["collection_id"]))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderdate > TIMESTAMP '1996-01-01' AND NOT (o_orderkey % 3 = 0 AND o_orderkey % 2 = 0)")
def poll_own_writes(spark, sf_dir):
    """What a poll hands on after a run of ours has written every third order; half of these were then changed by others."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("updated_at"))
    state, out = S.poll_state(spark, new_dir(spark, "polls")), new_dir(spark, "polled")
    S.record_own_writes(state, orders.filter("id % 3 = 0").withColumn("updated_at", F.when(F.col("id") % 2 == 0, F.col("updated_at")).otherwise(F.col("updated_at") - F.expr("INTERVAL 1 SECOND"))))
    state.set_note("cursor", datetime.datetime(1996, 1, 1, tzinfo=datetime.UTC).isoformat(), None)
    S.poll_once(orders, state, datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC), lambda changed: changed.write.parquet(out))
    return spark.read.parquet(out).select("id")


@query("SELECT CAST(ts AS DATE) AS day, event_type AS agent, 'part-' || user_id AS handle, count(*) FILTER (event_type <> 'error') AS hits, count(*) FILTER (event_type = 'error') AS misses FROM events GROUP BY 1, 2, 3")
def hits_streamed(spark, sf_dir):
    """Daily hits by a stream with watermark, in three batches of requests of all days; a store of days is updated as windows grow."""
    at, h, files = new_dir(spark, "hits"), hits(spark, sf_dir).withColumn("at", F.col("at").cast("timestamp")), spark.sparkContext.defaultParallelism
    h.repartition(3 * files, "event_id").select("at", "agent", "handle", "status").write.parquet(f"{at}/in")
    stream = spark.readStream.schema("at timestamp, agent string, handle string, status int").option("maxFilesPerTrigger", files).parquet(f"{at}/in")
    store = Store(spark, f"{at}/sums", "day date, agent string, handle string, hits long, misses long", ["day", "agent", "handle"], part=R.by_day("day"))
    # any batch may have a request of the first day
    late = h.agg(F.date_diff(F.max("at"), F.min("at"))).first()[0] or 0
    grown = S.rollup_stream(stream, f"{max(40, late + 1)} days")
    # sums only grow, so the greatest of a key is its last
    last = lambda current, new: current.unionByName(new).groupBy("day", "agent", "handle").agg(F.max("hits").alias("hits"), F.max("misses").alias("misses"))

    def handle(batch, number):
        batch = batch.persist()
        try:
            store.change(batch, last)
        finally:
            batch.unpersist()

    grown.writeStream.outputMode("update").foreachBatch(handle).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return store.read()


@query("SELECT o_orderkey AS id, 'first' AS page FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25) UNION ALL SELECT o_orderkey, 'second' FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25 OFFSET 25) UNION ALL SELECT o_orderkey, 'back' FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25)")
def pages_both_ways(spark, sf_dir):
    """The first page, the next by its last row, and the one before that by its first."""
    at = new_dir(spark, "pages")
    V.paged_layout(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("updated_at")), at)
    orders = spark.read.parquet(at)
    first = V.page_after(orders)
    last = first.orderBy("updated_at", "id").first()
    second = V.page_after(orders, (last["updated_at"], last["id"]))
    top = second.first()
    back = V.page_before(orders, (top["updated_at"], top["id"]))
    named = lambda df, name: df.select("id", F.lit(name).alias("page"))
    return named(first, "first").unionByName(named(second, "second")).unionByName(named(back, "back"))


@query("SELECT p_partkey AS id FROM part WHERE p_brand = 'Brand#3' AND (contains(lower(p_name), 'red') OR contains(lower(p_brand), 'red'))")
def search_in_collection(spark, sf_dir):
    p = products(spark, sf_dir)
    return V.search(p, 'Red"', p.select(F.col("vendor").alias("collection_id"), F.col("id").alias("product_id")), "Brand#3").select("id")


@query(
    "WITH s AS (SELECT s_suppkey AS id, s_suppkey % 5 AS k, s_nationkey % 4 AS n FROM supplier) "
    "SELECT id AS collection_id, CASE WHEN k IN (0, 2) THEN 'Size, Colour' ELSE '' END AS columns, CAST(CASE WHEN k = 0 THEN n ELSE 0 END AS BIGINT) AS table_rows, CASE WHEN k IN (0, 1) THEN 'About ' || id ELSE '' END AS summary, k IN (0, 1) AS written FROM s"
)
def collection_screen(spark, sf_dir):
    """Suppliers as collections: published whole, without a table, with columns only, with a broken table, not at all."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("collection_id"), (F.col("s_suppkey") % 5).alias("k"), (F.col("s_nationkey") % 4).cast("int").alias("n"))
    rows = F.to_json(F.struct(F.array(F.lit("Size"), F.lit("Colour")).alias("columns"), F.transform(F.slice(F.sequence(F.lit(1), F.lit(4)), F.lit(1), F.col("n")), lambda i: F.struct(i.alias("id"))).alias("rows")))
    text = F.when(F.col("k") == 0, rows).when(F.col("k") == 2, '{"columns": ["Size", "Colour"]}').when(F.col("k") == 3, "{broken")
    field = lambda key, value: s.select(F.col("collection_id").alias("owner_id"), F.lit(key).alias("key"), value.alias("value")).filter("value is not null")
    stored = field("table", text).unionByName(field("summary", F.when(F.col("k") < 2, F.concat(F.lit("About "), F.col("collection_id")))))
    out = V.collection_rows(s.select("collection_id"), stored)
    return out.select("collection_id", F.array_join("columns", ", ").alias("columns"), F.col("table_rows").cast("long").alias("table_rows"), "summary", "written")


@query("SELECT 'gid://x/Product/' || o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'New ' ELSE 'Old ' END || o_orderkey AS title, o_orderkey % 2 = 0 AS available FROM orders")
def export_files(spark, sf_dir):
    """An export of two files: lines of the second replace products of the first."""
    at, key = new_dir(spark, "export"), F.col("o_orderkey")
    line = lambda title, stock: F.to_json(F.struct(F.concat(F.lit("gid://x/Product/"), key).alias("id"), F.concat(F.lit(title), key).alias("title"), stock.alias("inventory")))
    orders = table(spark, sf_dir, "orders")
    orders.select(line("Old ", 1 - key % 2)).write.text(f"{at}/a")
    orders.filter("o_orderkey % 4 = 0").select(line("New ", F.lit(1))).write.text(f"{at}/b")
    return fold_children(read_lines(spark, f"{at}/*")).select("id", "title", "available")


@query("SELECT c_custkey AS tenant, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS dictionary, CASE WHEN c_custkey % 3 = 0 THEN 'a, b' END AS stopwords FROM customer")
def tenant_settings(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("tenant"), "c_mktsegment")
    field = lambda key, value, every: c.filter(F.col("tenant") % every == 0).select("tenant", F.lit(key).alias("key"), value.alias("value"))
    stored = field("dictionary", F.col("c_mktsegment"), 2).unionByName(field("stopwords", F.lit("a, b"), 3)).unionByName(field("unrelated", F.lit("x"), 1))
    return with_settings(c.select("tenant"), stored, ["dictionary", "stopwords"])


@query("SELECT event_type AS agent, count(*) AS n FROM events GROUP BY 1")
def appended_log(spark, sf_dir):
    """A log that three runs have appended to, the last of them twice."""
    at, h = new_dir(spark, "log"), hits(spark, sf_dir).select("event_id", "agent")
    for number, rest in enumerate((0, 1, 2, 2)):
        append_log(h.filter(F.col("event_id") % 3 == rest), at, f"r{min(number, 2)}")
    return spark.read.parquet(at).groupBy("agent").agg(F.count("*").alias("n"))
