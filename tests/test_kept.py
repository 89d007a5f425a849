"""What is kept from run to run: events, roll-ups, sketches, owners of media, counts, cursors and pages, against recounts."""

import collections
import datetime
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import coverage as V
from factloom.operators import monitor as O
from factloom.operators import retention as R
from factloom.plans import kept
from factloom.sources.store import Store
from factloom.streaming import freshness as S
from factloom.streaming.events import EventStore

EVENT = "kind string, tenant string, owner string, key string, value string, at timestamp, sequence long"
DAY = datetime.datetime(2024, 1, 1)

# ---------------------------------------------------------------- events


def made_events(seed, n):
    rng = random.Random(seed)
    some = lambda *x: rng.choice(x)
    at = lambda: some(None, *[DAY + datetime.timedelta(hours=h) for h in range(30)])
    kinds = ["create", "update", "update", "update", "update", "delete", "purge", "unknown"]
    out = [(some(*kinds), some("t", "u", None), some("a", "b", "c", None), some("k", "l", None), f"v{i}", at(), rng.randrange(5)) for i in range(n)]
    return [e if e[0] != "purge" or rng.random() < 0.3 else ("update", *e[1:]) for e in out]


def applied(events):
    """Values left, event by event without regard to their order."""
    stamp = lambda e: (e[5] is not None, e[5] or DAY, e[6])
    best = {}
    for e in events:
        if e[0] in ("create", "update"):
            key = (e[1], e[2], e[3] or "")
            best[key] = max(best.get(key, (stamp(e), "")), (stamp(e), e[4]))
    newest = lambda rows: max(map(stamp, rows), default=None)
    out = set()
    for (tenant, owner, key), (s, value) in best.items():
        gone = newest([e for e in events if e[0] == "delete" and e[1:3] == (tenant, owner)])
        purged = newest([e for e in events if e[0] == "purge" and e[1] == tenant])
        if (gone is None or s > gone) and (purged is None or s > purged):
            out.add((tenant, owner, key, value))
    return out


def left(store):
    return {tuple(r) for r in store.live().select("tenant", "owner", "key", "value").collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_events_in_any_order(spark, tmp_path, seed):
    """Batches out of order, repeated events, late deletes and purges, a batch played twice: as all at once."""
    events = made_events(seed, 90)
    whole = EventStore(spark, str(tmp_path / "whole"), buckets=4)
    whole.apply(spark.createDataFrame(events, EVENT))
    assert left(whole) == applied(events)
    parts = EventStore(spark, str(tmp_path / "parts"), buckets=4)
    order = random.Random(seed).sample(events, len(events))
    for number in range(3):
        batch = spark.createDataFrame(order[number * 30 : number * 30 + 30] + order[:5], EVENT)
        assert parts.apply(batch, number)
        before = parts.rows.manifest().number
        assert not parts.apply(batch, number) and parts.rows.manifest().number == before
    assert left(parts) == applied(events)


def test_events_touch_their_partitions(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "s"), buckets=32)
    rows = [("update", f"t{i % 3}", f"o{i}", "k", "v", DAY, i) for i in range(300)]
    store.apply(spark.createDataFrame(rows, EVENT), 0)
    files = set(store.rows.read().inputFiles())
    store.apply(spark.createDataFrame([("delete", "t1", "o1", None, None, DAY, 999)], EVENT), 1)
    assert len(files - set(store.rows.read().inputFiles())) == 1 and len(left(store)) == 299
    store.apply(spark.createDataFrame([("purge", "t2", None, None, None, DAY, 1000)], EVENT), 2)
    assert {r[0] for r in left(store)} == {"t0", "t1"}
    store.apply(spark.createDataFrame([("update", "t2", "o2", "k", "late", DAY, 5), ("update", "t2", "o2", "k", "new", DAY, 2000)], EVENT), 3)
    assert [r for r in left(store) if r[0] == "t2"] == [("t2", "o2", "k", "new")]
    store.forget(F.lit(DAY + datetime.timedelta(days=1)))
    assert store.rows.read().filter("key is null").count() == 0 and len(left(store)) == 200
    assert store.apply(spark.createDataFrame([], EVENT), 4) and not store.apply(spark.createDataFrame([], EVENT), 4)


def test_stream_of_events_equals_batch(spark, tmp_path):
    events = made_events(9, 80)
    for k in range(4):
        spark.createDataFrame(events[k::4], EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    store = EventStore(spark, str(tmp_path / "s"), buckets=4)
    run = lambda checkpoint: S.poll(S.changes(spark, str(tmp_path / "in"), EVENT, files=1), str(tmp_path / checkpoint), store.handler()).awaitTermination()
    run("c")
    version = store.rows.manifest().number
    run("lost checkpoint")  # all batches come again, with the same numbers
    assert left(store) == applied(events) and store.rows.manifest().number == version and store.rows.note("batch of events") == "3"


# ---------------------------------------------------------------- roll-ups


def made_hits(spark, rows):
    return spark.createDataFrame([(DAY + datetime.timedelta(days=d, hours=h), agent, handle, status) for d, h, agent, handle, status in rows], "at timestamp, agent string, handle string, status int")


def test_late_hits_reopen_their_day(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.randrange(5), rng.randrange(24), rng.choice(["GPTBot", "curl"]), rng.choice(["a", "b", None]), rng.choice([200, 404])) for _ in range(200)]
    store = R.hit_sums(spark, str(tmp_path / "s"))
    first = R.add_hits(store, made_hits(spark, rows[:150]), 0)
    assert len(first.written) == 5
    late = [r for r in rows[150:] if r[0] == 2]
    done = R.add_hits(store, made_hits(spark, late), 1)
    assert done.read == done.written == ["2024-01-03"] and R.add_hits(store, made_hits(spark, late), 1) is None
    R.add_hits(store, made_hits(spark, [r for r in rows[150:] if r[0] != 2]), 2)
    key = lambda df: sorted(map(tuple, df.select("day", "bot", "handle", "hits", "misses").collect()), key=repr)
    assert key(store.read()) == key(O.hits_daily(made_hits(spark, rows)))
    assert R.prune(store, datetime.date(2024, 1, 5), days=2).written == [] and sorted(store.manifest().parts) == ["2024-01-03", "2024-01-04", "2024-01-05"]


@pytest.mark.parametrize(("today", "days", "months", "cut"), [((2024, 3, 31), 0, 1, "2024-02-29"), ((2025, 2, 10), 0, 13, "2024-01-10"), ((2024, 1, 15), 30, 0, "2023-12-16"), ((2024, 5, 31), 0, 12, "2023-05-31")])
def test_prune_by_calendar(spark, tmp_path, today, days, months, cut):
    store = R.raw_hits(spark, str(tmp_path / "s"), "at timestamp, n int")
    near = datetime.date.fromisoformat(cut)
    rows = [(datetime.datetime.combine(near + datetime.timedelta(days=k), datetime.time(5)), k) for k in (-1, 0, 1)]
    R.append_raw(store, spark.createDataFrame([*rows, (None, 9)], "at timestamp, n int"))
    R.prune(store, datetime.date(*today), days, months)
    assert sorted(r["n"] for r in store.read().collect()) == [0, 1, 9]


@pytest.mark.parametrize("shape", ["uniform", "skewed", "few", "sorted"])
def test_merged_sketches(spark, tmp_path, shape):
    """Ranks of 30 merged days within the stated error; the state doesn't grow with distinct values."""
    n = F.col("id")
    ms = {"uniform": F.rand(1) * 1000, "skewed": F.exp(F.randn(2) * 3), "few": (n % 7).cast("double"), "sorted": n.cast("double")}[shape]
    rows = spark.range(60_000).select((F.lit(DAY) + F.make_interval(days=(n % 30).cast("int"))).alias("at"), F.lit("p").alias("path"), ms.alias("ms"), (n % 10 != 0).alias("ok"))
    rows.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    store = R.latency_sums(spark, str(tmp_path / "s"))
    for number in range(3):
        R.add_latencies(store, rows.filter(F.dayofmonth("at") % 3 == number), number)
    told = R.latency_summary(store.read()).first()
    assert told["n"] == 60_000 and told["failure_rate"] == 0.1 and store.read().count() == 30
    for q, value in ((0.5, told["p50"]), (0.95, told["p95"])):
        under, upto = rows.agg(F.avg((F.col("ms") < value).cast("double")), F.avg((F.col("ms") <= value).cast("double"))).first()
        assert under <= q + R.SKETCH_ERROR and upto >= q - R.SKETCH_ERROR
    assert R._merged(store.read(), "path").select(F.length("sketch")).first()[0] < 64_000


def test_latency_without_values(spark, tmp_path):
    rows = spark.createDataFrame([(DAY, "p", None, True), (None, None, 1.0, False)], "at timestamp, path string, ms double, ok boolean")
    store = R.latency_sums(spark, str(tmp_path / "s"))
    R.add_latencies(store, rows)
    got = {r["path"]: (r["n"], r["p95"]) for r in R.latency_summary(store.read()).collect()}
    assert got == {"p": (1, None), None: (1, 1.0)}


# ---------------------------------------------------------------- shared media


def owners_by_hand(images, owners):
    """Actions in the order of products and positions, and the owners after them."""
    owners, out = dict(owners), {}
    for name, media, product, ord_, position, alt in sorted(images, key=lambda x: (x[3] is not None, x[3] or 0, x[4])):
        human = bool(alt and alt.strip()) and not alt.startswith("IMG_")
        owner = owners.get(media)
        out[name] = "written" if not human else "shared" if owner is not None and owner != product else "kept"
        if not human and media is not None:
            owners[media] = product
    return out, owners


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_owners_from_run_to_run(spark, block):
    """A file with a third of all rows, files of null, columns that clash; the second run knows the owners of the first."""
    rng = random.Random(block)
    rows = [(f"i{k}", rng.choice(["hot", "hot", f"m{k % 40}", None]), k // 3, k // 3, k % 3, rng.choice(["", None, "IMG_1234", "A person wrote this", "Another text"])) for k in range(240)]
    schema = "name string, media_id string, product_id int, product_ord int, position int, alt string"
    df = lambda x: spark.createDataFrame(x, schema).withColumns({"suggestion": F.lit("s"), "human": F.lit(1), "block": F.lit(2), "rest": F.lit(3), "m": F.lit(4), "handed": F.lit("x")})
    first, second = [r for r in rows if r[3] < 40], [r for r in rows if r[3] >= 40]
    want, known = owners_by_hand(first, {})
    out = O.alt_merge(df(first), block=block)
    assert {r["name"]: r["action"] for r in out.collect()} == want and out.columns == [*df(first).columns, "action", "alt_out"]
    owners = O.media_owners(df(first))
    assert {r["media_id"]: r["product_id"] for r in owners.collect()} == known
    want, after = owners_by_hand(second, known)
    got = O.alt_merge(df(second), owners=owners, block=block).collect()
    assert {r["name"]: r["action"] for r in got} == want and "shared" in want.values()
    assert all(r["alt_out"] == ("s" if r["action"] == "written" else r["alt"]) and r["handed"] == "x" for r in got)
    assert {r["media_id"]: r["product_id"] for r in O.media_owners(df(second), owners).collect()} == after
    assert O.alt_merge(df(second).limit(0), owners=owners).count() == 0


# ---------------------------------------------------------------- counts


def test_counts_after_random_edits(spark):
    rng = random.Random(5)
    facts = lambda: [(k, "v") for k in rng.sample("ABCDE", rng.randint(0, 4))]
    old = {i: (rng.choice("xy"), facts()) for i in range(60)}
    new = {i: v for i, v in old.items() if rng.random() > 0.1} | {i: (rng.choice("xyz"), facts()) for i in rng.sample(range(90), 30)}
    schema = "id int, collection_id string, facts array<struct<k:string,v:string>>"
    df = lambda x: spark.createDataFrame([(i, *v) for i, v in x.items()], schema)
    gone = {i: v for i, v in old.items() if new.get(i) != v}
    come = {i: v for i, v in new.items() if old.get(i) != v}
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(V.merge_counts(V.coverage(df(old)), V.label_deltas(df(gone), df(come)))) == rows(V.coverage(df(new)))
    per = lambda x: df(x).select("collection_id", F.explode("facts").alias("f")).groupBy("collection_id", F.col("f.k").alias("label")).agg(F.count("*").alias("n_products"))
    assert rows(V.merge_counts(per(old), V.label_deltas(df(gone), df(come), by=["collection_id"]))) == rows(per(new))
    assert V.label_deltas(df(old), df(old)).count() == 0


# ---------------------------------------------------------------- polls and pages


def test_poll_and_own_writes(spark, tmp_path):
    at = lambda h: DAY + datetime.timedelta(hours=h)
    state = S.poll_state(spark, str(tmp_path / "s"), buckets=4)
    seen = []
    handle = lambda changed: seen.append({r["id"] for r in changed.collect()})
    frame = lambda rows: spark.createDataFrame(rows, "id long, updated_at timestamp")
    products = [(i, at(-5)) for i in range(5)] + [(9, at(-0.5))]
    assert S.poll_once(frame(products), state, at(0), handle) and seen == [{9}]  # at first an hour back
    ours = frame([(i, at(1)) for i in range(5)])
    S.record_own_writes(state, ours)
    S.record_own_writes(state, ours)
    products = [(i, at(1)) for i in range(4)] + [(4, at(2)), (9, at(-0.5))]
    assert S.poll_once(frame(products), state, at(3), handle) and seen[1] == {4}  # written by us, then by another
    version = state.note("cursor")
    with pytest.raises(ZeroDivisionError):
        S.poll_once(frame(products), state, at(4), lambda changed: 1 / 0)
    assert state.note("cursor") == version == at(3).isoformat()

    def overtaken(changed):
        assert state.set_note("cursor", at(9).isoformat(), version)

    assert not S.poll_once(frame(products), state, at(5), overtaken) and state.note("cursor") == at(9).isoformat()


def test_pages(spark, tmp_path):
    """Next and back give the same page, ties included; statistics leave files unread."""
    rows = spark.range(4000).select("id", (F.lit(DAY) + F.make_interval(mins=(F.col("id") / 3).cast("int"))).alias("updated_at"))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    V.paged_layout(rows, str(tmp_path / "p"), rows=200)
    stored = spark.read.parquet(str(tmp_path / "p"))
    key = lambda df: [(r["updated_at"], r["id"]) for r in df.collect()]
    first = key(V.page_after(stored))
    second = key(V.page_after(stored, first[-1]))
    third = key(V.page_after(stored, second[-1]))
    assert key(V.page_before(stored, second[0])) == first and key(V.page_before(stored, third[0])) == second
    assert first[0][1] == 3999 and len({*first, *second, *third}) == 75 and V.page_before(stored, first[0]).count() == 0
    files = len(stored.inputFiles())
    near = V.page_before(stored, third[0]).select("id", F.input_file_name().alias("f"))
    assert files >= 16 and len({r["f"] for r in near.collect()}) <= 2
    plan = V.page_before(stored, third[0])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThan(updated_at" in plan and "TakeOrderedAndProject" in plan


def test_streamed_hits_over_many_days_in_many_tasks(spark, tmp_path, monkeypatch):
    """No batch's requests are late for another's; each is summed once, from as many files as there are tasks."""
    rng = random.Random(17)
    rows = [(i, DAY + datetime.timedelta(days=rng.randrange(100), seconds=i), rng.randrange(3), rng.choice(["view", "error"]), 0.5) for i in range(600)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(kept, "new_dir", lambda spark, name: f"{tmp_path}/{name}")
    held, change = [], Store.change
    monkeypatch.setattr(Store, "change", lambda self, changes, *rest: held.append(changes.is_cached) or change(self, changes, *rest))
    want = collections.Counter()
    for _, at, user, kind, _ in rows:
        want[at.date(), kind, f"part-{user}", 0 if kind == "error" else 1] += 1
    got = kept.hits_streamed(spark, str(tmp_path)).collect()
    assert {(r["day"], r["agent"], r["handle"], int(r["hits"] > 0)): r["hits"] + r["misses"] for r in got} == want and len(got) == len(want)
    assert held == [True] * 3 and len(list(tmp_path.glob("hits/in/*.parquet"))) == 3 * spark.sparkContext.defaultParallelism
