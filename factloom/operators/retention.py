"""Request logs that are rolled up by day: sums and sketches that merge, kept in partitions of their day.

A run adds what its own rows sum up to; a late row reopens its day alone. Raw rows and sums are dropped by whole days. A
run's number is noted with the sums it wrote, so that the same run adds nothing twice.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.monitor import AGENTS, hits_daily
from factloom.sources.store import Store, Written

RAW_DAYS, SUM_MONTHS = 30, 13
#: Size of a latency sketch. Ranks of its quantiles are off by SKETCH_ERROR at most, with a probability of 99 %.
SKETCH_K, SKETCH_ERROR = 800, 0.005
SUMS = "day date, bot string, handle string, hits long, misses long"
LATENCIES = "day date, path string, n long, failed long, sketch binary"
NO_DAY = "none"


def by_day(day: str | Column) -> Column:
    """The partition of a day; rows without one have their own."""
    return F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.lit(NO_DAY))


def hit_sums(spark: SparkSession, path: str) -> Store:
    return Store(spark, path, SUMS, ["day", "bot", "handle"], part=by_day("day"))


def latency_sums(spark: SparkSession, path: str) -> Store:
    return Store(spark, path, LATENCIES, ["day", "path"], part=by_day("day"))


def raw_hits(spark: SparkSession, path: str, schema: str, at: str = "at") -> Store:
    return Store(spark, path, schema, [at], part=by_day(at))


def _add(store: Store, sums: DataFrame, merged, run: int | None) -> Written | None:
    if run is not None and int(store.note("run") or -1) >= run:
        return None
    return store.change(sums, merged, {} if run is None else {"run": str(run)})


def add_hits(store: Store, hits: DataFrame, run: int | None = None, bots: tuple[str, ...] = AGENTS) -> Written | None:
    """Adds hits (at, agent, handle, status) to the daily sums; None if the run has added its own already."""
    total = lambda df: df.groupBy("day", "bot", "handle").agg(F.sum("hits").alias("hits"), F.sum("misses").alias("misses"))
    return _add(store, hits_daily(hits, bots), lambda current, new: total(current.unionByName(new)), run)


def latency_daily(metrics: DataFrame) -> DataFrame:
    """(day, path, n, failed, sketch) of requests (at, path, ms, ok): what quantiles are later read from."""
    return metrics.groupBy(F.to_date("at").alias("day"), "path").agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("failed"), F.kll_sketch_agg_double(F.col("ms").cast("double"), F.lit(SKETCH_K)).alias("sketch"))


def _merged(sums: DataFrame, *by: str) -> DataFrame:
    return sums.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("failed").alias("failed"), F.kll_merge_agg_double("sketch", F.lit(SKETCH_K)).alias("sketch"))


def add_latencies(store: Store, metrics: DataFrame, run: int | None = None) -> Written | None:
    """Adds requests (at, path, ms, ok) to the daily sums and sketches; their size doesn't depend on how many values there are."""
    return _add(store, latency_daily(metrics), lambda current, new: _merged(current.unionByName(new), "day", "path"), run)


def latency_summary(sums: DataFrame) -> DataFrame:
    """(path, n, p50, p95, failure_rate) of daily sums, quantiles within SKETCH_ERROR of their ranks."""
    quantile = lambda q: F.when(F.kll_sketch_get_n_double("sketch") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(q)))
    return _merged(sums, "path").select("path", "n", quantile(0.5).alias("p50"), quantile(0.95).alias("p95"), (F.col("failed") / F.col("n")).alias("failure_rate"))


def append_raw(store: Store, rows: DataFrame) -> Written:
    return store.change(rows, lambda current, new: current.unionByName(new.select(*current.columns)))


def prune(store: Store, today: datetime.date, days: int = 0, months: int = 0) -> Written:
    """Drops the days before today less days and months; rows without a day stay."""
    month = today.year * 12 + today.month - 1 - months
    start = datetime.date(month // 12, month % 12 + 1, 1)
    end = (start + datetime.timedelta(days=31)).replace(day=1) - datetime.timedelta(days=1)
    cut = start.replace(day=min(today.day, end.day)) - datetime.timedelta(days=days)
    return store.drop_parts(lambda p: p != NO_DAY and p < cut.isoformat())
