"""Helpers the operators share: the shared folder, size-checked joins, word hashing in numpy and components."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a join's side that may be broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20


# ---------------------------------------------------------------- shared folder


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a temporary one only in local mode, where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    found = f"file://{tempfile.mkdtemp(prefix='factloom-')}"
    spark.sparkContext.setCheckpointDir(found)
    return found


class Workspace:
    """Tables of one run, written below the shared folder: they cut lineage and outlive executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark).rstrip('/')}/factloom/{name}-{uuid.uuid4().hex}"
        self.names: set[str] = set()

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and returns it as read again."""
        at = f"{self.path}/{name}"
        self.names.add(name)
        df.write.mode("overwrite").option("compression", "zstd").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, *names: str) -> None:
        """Removes tables that no plan reads any more."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            with contextlib.suppress(Exception):  # a table that stays is waste, not an error
                at.getFileSystem(conf).delete(at, True)

    def keep_only(self, *names: str) -> None:
        """Removes the tables of the run but those that its result is still to be read from; clear removes these later."""
        self.drop(*(self.names - {*names}))


def clear(spark: SparkSession) -> None:
    """Removes all tables that runs have left below the shared folder; for after their results have been read."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/factloom")
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


# ---------------------------------------------------------------- columns


def put_aside(df: DataFrame, *names: str) -> DataFrame:
    """df, its own columns that have one of these names renamed to name_own (or with more _own, as far as taken)."""
    taken = {c.lower() for c in df.columns} | {n.lower() for n in names}
    new = []
    for c in df.columns:
        to = c
        while c.lower() in {n.lower() for n in names} and (to == c or to.lower() in taken):
            to += "_own"
        taken.add(to.lower())
        new.append(F.col(f"`{c}`").alias(to))
    return df.select(*new)


def packed(df: DataFrame, *without: str) -> Column:
    """The columns of df but some as one struct of neutral names, which no name of an operator's can clash with."""
    return F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns) if c not in without], F.lit(0).alias("z")).alias("rest")


def unpacked(df: DataFrame, *without: str) -> list[Column]:
    """The columns of packed(df) again."""
    return [F.col("rest")[f"c{i}"].alias(c) for i, c in enumerate(df.columns) if c not in without]


# ---------------------------------------------------------------- joins


def by_ids(df: DataFrame, ids: DataFrame, on: str | list[str], how: str) -> DataFrame:
    """Semi or anti join by a written table of ids: broadcast while its bytes are few, shuffled beyond that."""
    size = F.lit(0)
    for name, kind in ids.dtypes:
        size = size + 16 + (F.coalesce(F.octet_length(name), F.lit(0)) if kind in {"string", "binary"} else F.lit(0))
    return with_small(df, ids, on, how, size)


def with_small(df: DataFrame, side: DataFrame, on: str | list[str], how: str, row_bytes: Column) -> DataFrame:
    """Join with a written table whose size is summed first (row_bytes: a column); shuffled if it is large."""
    size = side.agg(F.coalesce(F.sum(row_bytes), F.lit(0)).alias("b")).first()["b"]
    return df.join(F.broadcast(side) if size <= BROADCAST_BYTES else side, on, how)


# ---------------------------------------------------------------- words and shingles in numpy

SEGMENT = 1 << 19
#: Bytes of an Arrow batch on its way to Python, so that a worker's memory doesn't depend on the length of rows.
BATCH_BYTES = 4 << 20


def bounded(df: DataFrame) -> DataFrame:
    """df, whose session now sends batches of at most BATCH_BYTES (or a single longer row) to Python."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df

_MUL = 0x9E3779B97F4A7C15


def _inverse(a: int) -> int:
    return pow(a, -1, 1 << 64)


@lru_cache(maxsize=1)
def _tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd multiplier and of its inverse modulo 2**64."""
    powers = np.full(size + 1, _MUL, np.uint64)
    powers[0] = 1
    back = np.full(size + 1, _inverse(_MUL), np.uint64)
    back[0] = 1
    return np.multiply.accumulate(powers), np.multiply.accumulate(back)


@lru_cache(maxsize=2)
def _values(fold: bool) -> np.ndarray:
    """A random 64-bit value for each byte; with fold, A-Z count as a-z."""
    values = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if fold:
        values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    return values


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _segment_words(data: np.ndarray, begins: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word of data; a word also ends where a text begins (begins, ascending)."""
    word = ~SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    inside = begins[(begins > 0) & (begins < len(data))]
    first[inside] = word[inside]
    last[inside - 1] = word[inside - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    powers, back = _tables(1 << max(SEGMENT.bit_length(), len(data).bit_length()))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_values(fold)[data] * powers[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64)), start, end


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of an Arrow string column; nulls count as empty."""
    import pyarrow as pa

    if column.null_count:
        import pyarrow.compute as pc

        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def words_of(column, fold: bool):
    """Yields (row, word hashes) slices of an Arrow string column: arrays of the rows' numbers and each row's words.

    Whole texts, in slices of about SEGMENT bytes; a longer text is cut at spaces and its words are put together again.
    Yields lo, hi, hashes, bounds: rows lo..hi-1 have the words hashes[bounds[i]:bounds[i + 1]].
    """
    data, offsets = text_buffers(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SEGMENT, "right")) - 1)
        part = data[offsets[lo] : offsets[hi]]
        if hi == lo + 1 and len(part) > 2 * SEGMENT:
            found, at = [], 0
            while at < len(part):
                to = min(len(part), at + SEGMENT)
                while to < len(part) and not SPACE[part[to]]:
                    gap = np.flatnonzero(SPACE[part[to : to + SEGMENT]])
                    to = to + int(gap[0]) if len(gap) else min(len(part), to + SEGMENT)
                found.append(_segment_words(part[at:to], np.zeros(0, np.int64), fold)[0])
                at = to
            hashes = np.concatenate(found)
            bounds = np.array([0, len(hashes)])
        elif len(part):
            begins = offsets[lo : hi + 1] - offsets[lo]
            hashes, start, _ = _segment_words(part, begins[:-1], fold)
            bounds = np.searchsorted(start, begins)
        else:
            hashes, bounds = np.zeros(0, np.uint64), np.zeros(hi - lo + 1, np.int64)
        yield lo, hi, hashes, bounds
        lo = hi


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, by a running Karp-Rabin sum, in slices of about SEGMENT words."""
    n = len(words) - k + 1
    if n > SEGMENT:
        return np.concatenate([windows(words[at : min(at + SEGMENT, n) + k - 1], k) for at in range(0, n, SEGMENT)])
    if n <= 0:
        return np.zeros(0, np.uint64)
    powers, back = _tables(1 << max(SEGMENT.bit_length(), len(words).bit_length()))
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers[: len(words)], out=total[1:])
    # what the sum gains over a window, moved to the same power
    return mix((total[k:] - total[:n]) * back[:n] + np.uint64(k))


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct k-word shingles; the whole sequence if it is shorter; none without words."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return np.unique(windows(words, min(k, len(words))))


# ---------------------------------------------------------------- components


def components(work: Workspace, edges: DataFrame, name: str, rounds: int = 60) -> DataFrame:
    """(node, label): the smallest node reachable by edges (a, b); nodes without an edge are left out.

    Alternating large-star and small-star steps; each round is a few aggregations that combine map-side and
    joins that AQE can split, and its edges are written to the shared folder.
    """
    edges = work.table(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    before = None
    for r in range(1, rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()  # a > b: from each node to the least of its neighbour's
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("m").alias("y")), F.struct(F.col("b").alias("x"), F.col("m").alias("y")))).alias("e"))
        small = small.select(F.col("e.x").alias("a"), F.col("e.y").alias("b")).filter("a <> b").distinct()
        edges = work.table(small, f"{name}-{r}")
        work.drop(f"{name}-{r - 1}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
