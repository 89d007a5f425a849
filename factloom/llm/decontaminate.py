"""Benchmark decontamination by greedy string tiling.

Texts are words (A-Z in lower case). Seeds are the runs of MIN_MATCH words of the benchmark items; a document and
an item that share a seed are a candidate. For each candidate the running Karp-Rabin loop marks the longest
non-overlapping matches, from long search lengths down to MIN_MATCH: windows of the search length are hashed over
the unmarked stretches, equal ones are compared and extended word by word, and matches are marked from the longest
on. The item's coverage is the share of its words under tiles; order doesn't count, so reordered passages are
caught. Every match is a run of shared seeds, so only the document's words around its seeds enter the loop.

A benchmark within BENCHMARK_BYTES is broadcast and its documents are tiled where they are read; a larger one is
joined to the documents by seeds, with a shuffle. Both ways give the same rows. In the join, rows have keys of their
own, so ids may be null or repeated. Tiles of the least length that cover the share asked for hold so many seeds that
an item's most frequent seeds aren't needed: only its rarest ones are joined, at least one of which is shared by
every document it can flag. A bit map of fixed size keeps seeds that no item has from being shuffled. Texts follow
only for pairs that share a seed.

Defined cases: null and empty texts and items of fewer than MIN_MATCH words match nothing; repeated documents and
repeated items give repeated rows; rows without doc_id or item_id are compared and keep their null; ids may be of any
type; an empty table flags nothing; other columns are left out of contaminated and pass through without_contaminated,
which drops the flagged rows, those without doc_id too.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import Workspace, bounded, by_ids, packed, unpacked, windows, words_of

MIN_MATCH, COVERAGE, BENCHMARK_BYTES = 5, 0.5, 16 << 20
FLAGGED = "n_tiles long, covered_words long, item_words long, coverage double, contaminated boolean"
#: Bits of the map of benchmark seeds, as a power of two: 16 MB, whatever the benchmark's size.
SEED_BITS = 27


# ---------------------------------------------------------------- tiling of two word sequences


def tiles(doc: np.ndarray, item: np.ndarray, least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """(start in doc, start in item, length) of the tiles of two arrays of word hashes."""
    free_doc, free_item = np.ones(len(doc), bool), np.ones(len(item), bool)
    out: list[tuple[int, int, int]] = []
    length = max(least, min(len(doc), len(item)) // 2)
    while True:
        found, longest = _matches(doc, item, free_doc, free_item, length)
        if longest > 2 * length:
            length = longest  # look again, only for matches this long
            continue
        for size, i, j in sorted(found, key=lambda m: (-m[0], m[1], m[2])):
            # what an earlier tile has taken from a match is cut off; the rest counts if it is long enough
            taken = np.flatnonzero(~(free_doc[i : i + size] & free_item[j : j + size]))
            size = int(taken[0]) if len(taken) else size
            if size >= length:
                free_doc[i : i + size] = False
                free_item[j : j + size] = False
                out.append((i, j, size))
        if length == least:
            left, _ = _matches(doc, item, free_doc, free_item, least)
            if not left:
                return sorted(out)
        length = max(least, length // 2)


def _matches(doc: np.ndarray, item: np.ndarray, free_doc: np.ndarray, free_item: np.ndarray, length: int) -> tuple[list[tuple[int, int, int]], int]:
    """Maximal matches (size, i, j) of at least the length in unmarked words, and the longest size."""
    table = defaultdict(list)
    hashes, open_ = windows(item, length), _open(free_item, length)
    for j in np.flatnonzero(open_):
        table[hashes[j]].append(int(j))
    found, longest, hashes = [], 0, windows(doc, length)
    for i in np.flatnonzero(_open(free_doc, length)):
        for j in table.get(hashes[i], ()):
            i = int(i)
            if i and j and free_doc[i - 1] and free_item[j - 1] and doc[i - 1] == item[j - 1]:
                continue  # not its first word
            most = min(len(doc) - i, len(item) - j)
            same = (doc[i : i + most] == item[j : j + most]) & free_doc[i : i + most] & free_item[j : j + most]
            size = most if same.all() else int(np.argmin(same))
            if size >= length:
                found.append((size, i, j))
                longest = max(longest, size)
    return found, longest


def _open(free: np.ndarray, length: int) -> np.ndarray:
    """Whether the window of the length at each place is unmarked."""
    if len(free) < length:
        return np.zeros(0, bool)
    total = np.r_[0, np.cumsum(free)]
    return total[length:] - total[:-length] == length


def covered(doc: np.ndarray, item: np.ndarray, least: int) -> tuple[int, int]:
    """Tiles, and words of the item below them."""
    found = tiles(doc, item, least)
    return len(found), sum(x[2] for x in found)


# ---------------------------------------------------------------- candidates


class Index:
    """Seeds of the benchmark: sorted hashes and, for each, the items that have it."""

    def __init__(self, items: list[tuple[int, np.ndarray]], least: int):
        self.items = items
        pairs = [np.unique(windows(words, least)) for _, words in items]
        seeds = np.concatenate(pairs) if pairs else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(items)), [len(x) for x in pairs])
        order = np.lexsort((owner, seeds))
        self.seeds, self.owner = seeds[order], owner[order]
        self.small = np.zeros(1 << 16, bool)  # rules out most windows at once
        self.small[(self.seeds >> np.uint64(48)).astype(np.int64)] = True

    def candidates(self, hashes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(item, places): the items that share seeds with a text, and where in the text."""
        at = np.flatnonzero(self.small[(hashes >> np.uint64(48)).astype(np.int64)])
        lo = np.searchsorted(self.seeds, hashes[at], "left")
        hi = np.searchsorted(self.seeds, hashes[at], "right")
        hit = hi > lo
        at, lo, hi = at[hit], lo[hit], hi[hit]
        if not len(at):
            return
        n = hi - lo
        place = np.repeat(at, n)
        entry = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        owner = self.owner[entry]
        order = np.argsort(owner, kind="stable")
        owner, place = owner[order], place[order]
        cut = np.r_[0, np.flatnonzero(owner[1:] != owner[:-1]) + 1, len(owner)]
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            yield int(owner[i]), place[i:j]


def around(words: np.ndarray, places: np.ndarray, least: int) -> np.ndarray:
    """The words under seeds; a word that equals nothing stands between stretches."""
    inside = np.zeros(len(words) + 1, bool)
    for k in range(least):
        inside[places + k] = True
    at = np.flatnonzero(inside)
    out = words[at]
    gaps = np.flatnonzero(np.diff(at) > 1) + 1
    return np.insert(out, gaps, np.uint64(0))


def _flags(tag: str, rest, ids, found: list[tuple[int, int, int, int, int]]) -> pa.RecordBatch:
    """Rows of (row, item, tiles, covered words, item's words): rest of the row, id of the item, and the figures."""
    row, item, n, size, words = (np.array(x, np.int64) for x in zip(*found, strict=True))
    columns = {tag: rest.take(pa.array(row)), "item_id": ids.take(pa.array(item)), "n_tiles": pa.array(n), "covered_words": pa.array(size), "item_words": pa.array(words)}
    columns |= {"coverage": pa.array(size / words), "contaminated": pa.array(np.ones(len(row), bool))}
    return pa.RecordBatch.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in columns.values()], names=list(columns))


def _flag_broadcast(index, least: int, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, item_ids = index.value
        for batch in batches:
            found = []
            for lo, hi, words, bounds in words_of(batch.column("text"), fold=True):
                hashes = windows(words, least)
                if not len(hashes):
                    continue
                # windows that run into the next text are not this text's
                possible = held.small[(hashes >> np.uint64(48)).astype(np.int64)]
                rows = np.unique(np.searchsorted(bounds, np.flatnonzero(possible), "right") - 1)
                for row in rows:
                    a, b = int(bounds[row]), int(bounds[row + 1])
                    mine = words[a:b]
                    for k, places in held.candidates(hashes[a : max(a, b - least + 1)]):
                        at, item = held.items[k]
                        n, size = covered(around(mine, places, least), item, least)
                        if size >= share * len(item):
                            found.append((lo + int(row), at, n, size, len(item)))
            if found:
                yield _flags("rest", batch.column("rest"), item_ids, found)

    return run


def _each_words(column) -> Iterator[tuple[int, np.ndarray]]:
    """(row, words) of each text."""
    for lo, hi, words, bounds in words_of(column, fold=True):
        for row in range(lo, hi):
            yield row, words[bounds[row - lo] : bounds[row - lo + 1]]


def _item_seeds(least: int):
    """(seed, item, n, words): each seed of an item, how often it has it, and the item's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, words in _each_words(batch.column("text")):
                seeds, n = np.unique(windows(words, least), return_counts=True)
                key = batch.column("item")[row].as_py()
                yield pa.RecordBatch.from_arrays([pa.array(seeds.view(np.int64)), pa.array(np.full(len(seeds), key, np.int64)), pa.array(n), pa.array(np.full(len(seeds), len(words), np.int64))], names=["seed", "item", "n", "words"])

    return run


def _doc_seeds(least: int, bits):
    """(seed, doc) of the documents' seeds that an item may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bits.value
        for batch in batches:
            keys = batch.column("doc").to_numpy(zero_copy_only=False)
            seeds, docs = [], []
            for row, words in _each_words(batch.column("text")):
                found = windows(words, least)
                place = found >> np.uint64(64 - SEED_BITS)
                found = np.unique(found[(known[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1])
                seeds.append(found)
                docs.append(np.full(len(found), keys[row], np.int64))
            if seeds:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(seeds).view(np.int64)), pa.array(np.concatenate(docs))], names=["seed", "doc"])

    return run


def _flag_pairs(least: int, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for (row, doc), (_, item) in zip(_each_words(batch.column("text")), _each_words(batch.column("item_text")), strict=True):
                places = np.flatnonzero(np.isin(windows(doc, least), windows(item, least)))
                n, size = covered(around(doc, places, least), item, least)
                if size >= share * len(item):
                    found.append((row, row, n, size, len(item)))
            if found:
                yield _flags("doc", batch.column("doc"), batch.column("item"), found)

    return run


def _candidates(work: Workspace, docs: DataFrame, items: DataFrame, least: int, share: float) -> DataFrame:
    """(doc, item) pairs that share one of the item's rarest seeds."""
    spark = docs.sparkSession
    seeds = work.table(items.mapInArrow(_item_seeds(least), "seed long, item long, n long, words long"), "seeds")
    seeds = seeds.join(seeds.groupBy("seed").agg(F.sum("n").alias("often")), "seed")
    # a tile covers `least` words for its first seed and one more for each other: so many places are shared at least
    total, shared = F.col("words") - least + 1, F.ceil(share * F.col("words") / least)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("item").orderBy("often", "seed").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rare = work.table(seeds.withColumn("before", before).filter(F.col("before") <= total - shared).select("seed", "item"), "rare")
    place = rare.select(F.shiftrightunsigned("seed", 64 - SEED_BITS).alias("at"))
    words = place.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 AS int)))").alias("bits")).collect()  # of a fixed number at most
    bits = np.zeros(1 << SEED_BITS - 6, np.int64)
    for x in words:
        bits[x["word"]] = x["bits"]
    known = spark.sparkContext.broadcast(bits.view(np.uint64))
    doc_seeds = bounded(docs).select("doc", "text").mapInArrow(_doc_seeds(least, known), "seed long, doc long")
    return work.table(doc_seeds.join(rare, "seed").select("doc", "item").distinct(), "pairs")


def _contaminated(texts: DataFrame, benchmark: DataFrame, least: int, share: float, benchmark_bytes: int) -> DataFrame:
    """(rest, item_id, figures) of texts (rest, text)."""
    spark = texts.sparkSession
    kinds = f"rest {dict(texts.dtypes)['rest']}, item_id {dict(benchmark.dtypes)['item_id']}, {FLAGGED}"
    items = benchmark.filter("text is not null").select("item_id", "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    if size <= benchmark_bytes:
        rows = items.toArrow()
        held = [(row, words) for row, words in _each_words(rows.column("text").combine_chunks()) if len(words) >= least]
        index = spark.sparkContext.broadcast((Index(held, least), rows.column("item_id").combine_chunks()))
        return bounded(texts).mapInArrow(_flag_broadcast(index, least, share), kinds)
    work = Workspace(spark, "decontaminate")
    docs = work.table(texts.withColumn("doc", F.monotonically_increasing_id()), "docs")
    items = work.table(items.withColumn("item", F.monotonically_increasing_id()), "items")
    pairs = _candidates(work, docs, items, least, share)
    near = by_ids(docs.select("doc", "text"), work.table(pairs.select("doc").distinct(), "near"), "doc", "left_semi")
    both = pairs.join(near, "doc").join(items.select("item", F.col("text").alias("item_text")), "item")
    found = bounded(both).select("doc", "item", "text", "item_text").mapInArrow(_flag_pairs(least, share), f"doc long, item_id long, {FLAGGED}").withColumnRenamed("item_id", "item")
    out = found.join(docs.select("doc", "rest"), "doc").join(items.select("item", "item_id"), "item")
    return out.select("rest", "item_id", *[x.split()[0] for x in FLAGGED.split(", ")])


def contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, benchmark_bytes: int = BENCHMARK_BYTES) -> DataFrame:
    """One row for each document (doc_id) and benchmark item (item_id) whose coverage reaches the threshold."""
    texts = docs.filter(F.col("text").isNotNull()).select(F.struct("doc_id").alias("rest"), "text")
    return _contaminated(texts, benchmark, min_match, coverage, benchmark_bytes).select("rest.doc_id", "item_id", *[x.split()[0] for x in FLAGGED.split(", ")])


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the flagged rows: those of a flagged doc_id, or of a flagged text where doc_id is null."""
    work = Workspace(docs.sparkSession, "clean")
    key = lambda d: F.coalesce(d.cast("string"), F.lit(""))
    at = docs.select(packed(docs), F.struct(key(F.col("doc_id")).alias("id"), F.when(F.col("doc_id").isNull(), F.xxhash64("text")).alias("row")).alias("doc_id"), "text")
    flagged = contaminated(at, benchmark, **options).select(F.xxhash64("doc_id.id", "doc_id.row").alias("at")).distinct()
    flagged = work.table(flagged, "flagged")
    left = by_ids(at.withColumn("at", F.xxhash64("doc_id.id", "doc_id.row")), flagged, "at", "left_anti")
    return left.select(*unpacked(docs))
