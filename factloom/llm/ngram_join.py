"""N-gram Jaccard self-join with count-vector R-trees, exact at 100 * intersection >= 75 * union.

Each text is the set of its distinct five-word shingles (A-Z in lower case). Texts with equal sets form a class;
all that follows joins class representatives.

1. Blocks: two sets of that similarity share a shingle among the first quarter of each in any fixed order.
   The order is by how often a shingle's counting bucket occurs in the corpus, rare first, then by hash. All
   classes that have a shingle in their first quarter meet in the block of the least class with it.
2. Count-vector R-tree: a set's shingles are hashed into groups, and the group counts are its point. In each
   block an R-tree over the points is joined with itself; a pair survives if the summed coordinate minima, of
   node rectangles and then of points, can reach the overlap that the threshold asks for. Each block gives a
   star per connected part of its surviving pairs, and the stars' components are the clusters.
3. Verification: the sets of a cluster meet, and pairs that pass the bound and aren't connected yet are compared
   shingle by shingle. Links come out as stars again; their components are exact, as only pairs that are
   connected already are left out.

Blocks and clusters over a size limit are dealt to a grid of tasks, each with two of the parts. Shingles are compared
by 64-bit hashes and whole sets by 128-bit ones; all else is exact.

Defined cases: a text of fewer words than a shingle is one shingle, its whole sequence; null and empty texts have
no shingle and link with nothing; rows of one doc_id count as one node; rows without doc_id keep their set
size and get no component; doc_id is a long, other types are cast to it; an empty table gives an empty one; other
columns are left out of jaccard_components and pass through one_of_each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import Workspace, bounded, by_ids, components, shingle_set, with_small, words_of

SHINGLE, THRESHOLD = 5, 75
#: Counting buckets of shingles (bits of their hash); entries of one shingle range; rows of a block and bytes of a cluster's sets in one task.
BUCKET_BITS, RANGE_ROWS, HOT_ROWS, BLOCK_ROWS, CLUSTER_BYTES = 16, 400_000, 2_000_000, 20_000, 32 << 20
LEAF = 32


# ---------------------------------------------------------------- sets


def sets_of(batch: pa.RecordBatch, column: str, shingle: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted shingle set) of a batch."""
    for lo, hi, words, bounds in words_of(batch.column(column), fold=True):
        for row in range(lo, hi):
            yield row, shingle_set(words[bounds[row - lo] : bounds[row - lo + 1]], shingle)


def _digests(shingle: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        counts = np.zeros(1 << bits, np.int64)
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("counts", pa.binary())])
        for batch in batches:
            n, digest = [], []
            for _, found in sets_of(batch, "text", shingle):
                n.append(len(found))
                digest.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                counts += np.bincount((found >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) if len(found) > 4096 else 0
                if len(found) <= 4096:
                    np.add.at(counts, (found >> np.uint64(64 - bits)).astype(np.int64), 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.nulls(len(n), pa.binary())], schema=schema)
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([0], pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts.tobytes()], pa.binary())], schema=schema)

    return run


def _expand_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each partition's counts, the buckets that occur."""
    for batch in batches:
        for raw in batch.column("counts"):
            counts = np.frombuffer(raw.as_py(), np.int64)
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(counts[at])], names=["bucket", "n"])


# ---------------------------------------------------------------- blocks


def first_part(found: np.ndarray, rarity: np.ndarray, bits: int, threshold: int) -> np.ndarray:
    """The shingles of a set of which one at least is shared with any set of the threshold's similarity."""
    n = len(found)
    keep = n - -(-threshold * n // 100) + 1
    order = np.lexsort((found, rarity[(found >> np.uint64(64 - bits)).astype(np.int64)]))
    return found[order[:keep]]


def _entries(shingle: int, threshold: int, rarity, bits: int, ranges: int, hot_rows: int):
    """Rows (range, hashes, ids) of packed entries; entries of frequent buckets unpacked as (hash, id) with range null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("r", pa.int32()), ("hashes", pa.binary()), ("ids", pa.binary()), ("h", pa.int64()), ("c", pa.int64())])
        counts = rarity.value
        for batch in batches:
            ids, parts, owners = batch.column("doc_id").to_numpy(zero_copy_only=False), [], []
            for row, found in sets_of(batch, "text", shingle):
                if len(found):
                    part = first_part(found, counts, bits, threshold)
                    parts.append(part)
                    owners.append(np.full(len(part), ids[row], np.int64))
            if not parts:
                continue
            h, c = np.concatenate(parts), np.concatenate(owners)
            hot = counts[(h >> np.uint64(64 - bits)).astype(np.int64)] > hot_rows
            if hot.any():
                k = int(hot.sum())
                yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary()), pa.array(h[hot].view(np.int64)), pa.array(c[hot])], schema=schema)
                h, c = h[~hot], c[~hot]
            r = ((h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(r, kind="stable")
            h, c, r = h[order], c[order], r[order]
            at = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.zeros(0, np.int64)
            to = np.r_[at[1:], len(r)]
            yield pa.RecordBatch.from_arrays([pa.array(r[at]), pa.array([h[i:j].tobytes() for i, j in zip(at, to, strict=True)], pa.binary()), pa.array([c[i:j].tobytes() for i, j in zip(at, to, strict=True)], pa.binary()), pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.int64())], schema=schema)

    return run


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of the rows of one key, of batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(i, j - i)
            if held and held[0].column(key)[0] != part.column(key)[0]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _hubs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hub, c): for each shingle of several classes, the least one and each other, once a range."""
    for group in runs(batches, "r"):
        h = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in group.column("hashes")])
        c = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in group.column("ids")])
        order = np.lexsort((c, h))
        h, c = h[order], c[order]
        first = np.r_[True, h[1:] != h[:-1]]
        hub = c[np.flatnonzero(first)][np.cumsum(first) - 1]
        keep = hub != c
        pairs = np.unique(np.stack([hub[keep], c[keep]]), axis=1)
        for lo in range(0, pairs.shape[1], 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0, lo : lo + 50_000]), pa.array(pairs[1, lo : lo + 50_000])], names=["hub", "c"])


# ---------------------------------------------------------------- count vectors and the R-tree


def count_vector(found: np.ndarray) -> np.ndarray:
    """Counts of a set's shingles by hashed group: a power of two of groups, about a quarter of the set."""
    groups = 16
    while groups < len(found) // 4:
        groups *= 2
    while True:
        counts = np.bincount((found & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
        if counts.max() <= 255:
            return counts.astype(np.uint8)
        groups *= 2


def folded(vector: np.ndarray, groups: int) -> np.ndarray:
    """The same counts in fewer groups."""
    return vector.reshape(-1, groups).sum(axis=0, dtype=np.uint16)


def needed(a: np.ndarray, b: np.ndarray, threshold: int) -> np.ndarray:
    """Least overlap of sets of these sizes: threshold * (a + b) / (100 + threshold), rounded up."""
    return -(-threshold * (a + b) // (100 + threshold))


class RTree:
    """A packed R-tree of two levels over count vectors: leaves of points that are near in size and counts."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        spread = points.var(axis=0)
        axis = np.argsort(-spread)[:2]
        rough = np.argsort(points[:, axis[0]], kind="stable")
        slab = LEAF * max(1, int(np.sqrt(len(points) / LEAF)))
        order = np.concatenate([part[np.argsort(points[part, axis[-1]], kind="stable")] for part in np.array_split(rough, -(-len(rough) // slab))])
        self.leaves = [order[i : i + LEAF] for i in range(0, len(order), LEAF)]
        self.points, self.sizes = points, sizes
        self.upper = np.stack([points[x].max(axis=0) for x in self.leaves])
        self.small = np.array([sizes[x].min() for x in self.leaves])

    def join(self, other: RTree, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(i, js): points of this tree, and those of the other that may overlap enough."""
        for k, leaf in enumerate(self.leaves):
            bound = np.minimum(self.upper[k], other.upper).sum(axis=1, dtype=np.int64)
            near = np.flatnonzero(bound >= needed(self.small[k], other.small, threshold))
            if not len(near):
                continue
            js = np.concatenate([other.leaves[x] for x in near])
            points, sizes = other.points[js], other.sizes[js]
            for i in leaf:
                bound = np.minimum(self.points[i], points).sum(axis=1, dtype=np.int64)
                ok = (bound >= needed(self.sizes[i], sizes, threshold)) & (100 * np.minimum(self.sizes[i], sizes) >= threshold * np.maximum(self.sizes[i], sizes))
                if ok.any():
                    yield i, js[ok]


def size_band(sizes: np.ndarray, threshold: int) -> np.ndarray:
    """Sizes of linked sets are in the same band or in neighbouring ones."""
    return np.floor(np.log(sizes) / np.log(100 / threshold) + 1e-9).astype(np.int64)


def surviving(vectors: list[np.ndarray], sizes: np.ndarray, threshold: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, js): pairs of points that pass the R-tree's bound, each found once or twice."""
    if len(sizes) == 2:
        groups = min(len(vectors[0]), len(vectors[1]))
        bound = int(np.minimum(folded(vectors[0], groups), folded(vectors[1], groups)).sum())
        if 100 * sizes.min() >= threshold * sizes.max() and bound >= needed(sizes[0], sizes[1], threshold):
            yield 0, np.array([1])
        return
    band = size_band(sizes, threshold)
    for b in np.unique(band):
        mine, next_ = np.flatnonzero(band == b), np.flatnonzero(band == b + 1)
        both = np.r_[mine, next_]
        if len(both) < 2:
            continue
        groups = min(len(vectors[x]) for x in both)
        tree = RTree(np.stack([folded(vectors[x], groups) for x in mine]), sizes[mine])
        for i, js in tree.join(tree, threshold):
            js = js[js > i]
            if len(js):
                yield mine[i], mine[js]
        if len(next_):
            more = RTree(np.stack([folded(vectors[x], groups) for x in next_]), sizes[next_])
            for i, js in tree.join(more, threshold):
                yield mine[i], next_[js]


class Union:
    """Disjoint sets of 0..n-1."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def find(self, i: int) -> int:
        while self.of[i] != i:
            self.of[i] = self.of[self.of[i]]
            i = self.of[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.of[max(i, j)] = min(i, j)

    def roots(self) -> np.ndarray:
        of = self.of
        while (of != of[of]).any():
            of = of[of]
        self.of = of
        return of


def _stars(ids: np.ndarray, union: Union) -> tuple[np.ndarray, np.ndarray]:
    """(least id, other id) of each part."""
    roots = union.roots()
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, roots, ids)
    a = least[roots]
    keep = a != ids
    return a[keep], ids[keep]


def _pairs_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], names=["a", "b"])


def _block_stars(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_a, out_b = [], []
        for group in runs(batches, "task"):
            if group.num_rows < 2:
                continue
            ids, sizes = group.column("c").to_numpy(), group.column("n").to_numpy()
            vectors = [np.frombuffer(x.as_py(), np.uint8) for x in group.column("vector")]
            union = Union(len(ids))
            for i, js in surviving(vectors, sizes, threshold):
                for j in js if len(js) < 8 else js[union.roots()[js] != union.find(i)]:
                    union.join(i, j)
            a, b = _stars(ids, union)
            out_a.append(a)
            out_b.append(b)
        if out_a:
            yield _pairs_batch(np.concatenate(out_a), np.concatenate(out_b))

    return run


def _verified_stars(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_a, out_b = [], []
        for group in runs(batches, "task"):
            if group.num_rows < 2:
                continue
            ids = group.column("c").to_numpy()
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in group.column("shingles")]
            union = Union(len(ids))
            for i, js in surviving([count_vector(x) for x in sets], np.array([len(x) for x in sets]), threshold):
                for j in js:
                    if union.find(i) != union.find(j) and linked(sets[i], sets[j], threshold):
                        union.join(i, j)
            a, b = _stars(ids, union)
            out_a.append(a)
            out_b.append(b)
        if out_a:
            yield _pairs_batch(np.concatenate(out_a), np.concatenate(out_b))

    return run


def linked(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    """Whether two sorted sets have the similarity."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= threshold * (len(a) + len(b) - both)


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("c", pa.int64()), ("n", pa.int64()), ("vector", pa.binary()), ("shingles", pa.binary())])
        for batch in batches:
            held: list[np.ndarray] = []
            size, done = 0, 0
            for row, found in sets_of(batch, "text", shingle):
                held.append(found)
                size += found.nbytes
                if size > 4 << 20 or row == batch.num_rows - 1:
                    vectors = [count_vector(x).tobytes() if len(x) else b"" for x in held]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(done, len(held)), pa.array([len(x) for x in held], pa.int64()), pa.array(vectors, pa.binary()), pa.array([x.tobytes() for x in held], pa.binary())], schema=schema)
                    held, size, done = [], 0, row + 1

    return run


def _dealt(work: Workspace, members: DataFrame, key: str, weight: str, most: int) -> DataFrame:
    """members with a column task: the key itself, or for a heavy key each pair of its parts in which a member is."""
    heavy = members.groupBy(key).agg(F.sum(weight).alias("__w")).filter(F.col("__w") > most).select(key, F.ceil(2 * F.col("__w") / most).cast("int").alias("__parts"))
    heavy = work.table(heavy, f"heavy-{key}")
    part = F.pmod(F.xxhash64("c"), F.col("__parts")).cast("int")
    other = F.explode(F.when(F.col("__parts").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("__parts") - 1)))
    dealt = with_small(members, heavy, [key], "left", F.lit(16)).withColumn("__mine", part).withColumn("__other", other)
    return dealt.withColumn("task", F.xxhash64(key, F.least("__mine", "__other"), F.greatest("__mine", "__other"))).drop("__parts", "__mine", "__other")


# ---------------------------------------------------------------- the join


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD, hot_rows: int = HOT_ROWS, block_rows: int = BLOCK_ROWS, cluster_bytes: int = CLUSTER_BYTES) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id long, text)."""
    spark = docs.sparkSession
    work = Workspace(spark, "jaccard")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = work.table(bounded(texts).mapInArrow(_digests(shingle, BUCKET_BITS), "doc_id long, n long, digest binary, counts binary"), "sets")
    rows = found.filter("counts is null").select("doc_id", "n", "digest")
    counts = found.filter("counts is not null").select("counts").mapInArrow(_expand_counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    rarity = np.zeros(1 << BUCKET_BITS, np.int64)  # of fixed size, whatever the corpus
    for x in counts:
        rarity[x["bucket"]] = x["n"]
    shared = spark.sparkContext.broadcast(rarity)
    entries = int(rarity.sum()) * (100 - threshold) // 100
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-entries // RANGE_ROWS))

    classes = rows.filter("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("c"), F.count("*").alias("copies"))
    classes = work.table(classes, "classes")
    copies = rows.join(classes.filter("copies > 1"), "digest").filter("doc_id <> c").select("doc_id")
    copies = copies.join(classes.select(F.col("c").alias("doc_id")), "doc_id", "left_anti")
    copies = work.table(copies.distinct(), "copies")
    reps = by_ids(texts.filter("doc_id is not null and text is not null"), copies, "doc_id", "left_anti")

    packed = reps.mapInArrow(_entries(shingle, threshold, shared, BUCKET_BITS, ranges, hot_rows), "r int, hashes binary, ids binary, h long, c long")
    if rarity.max() > hot_rows:
        packed = work.table(packed, "entries")
        each = packed.filter("r is null").select("h", "c").distinct()
        each = each.join(each.groupBy("h").agg(F.min("c").alias("hub")), "h").filter("hub <> c").select("hub", "c")
    else:
        each = None
    cold = packed.filter("r is not null").select("r", "hashes", "ids").repartition(min(ranges, 20_000), "r").sortWithinPartitions("r")
    blocks = cold.mapInArrow(_hubs, "hub long, c long")
    blocks = work.table((blocks.unionByName(each) if each is not None else blocks).distinct(), "blocks")
    members = blocks.unionByName(blocks.select("hub", F.col("hub").alias("c")).distinct())
    wanted = work.table(members.select(F.col("c").alias("doc_id")).distinct(), "wanted")
    sets = by_ids(texts.filter("text is not null"), wanted, "doc_id", "left_semi").mapInArrow(_sets(shingle), "c long, n long, vector binary, shingles binary")
    sets = work.table(sets.filter("n > 0"), "vectors")

    tasks = _dealt(work, members.withColumn("one", F.lit(1)), "hub", "one", block_rows).select("task", "c")
    tasks = tasks.join(sets.select("c", "n", "vector"), "c")
    stars = tasks.repartition("task").sortWithinPartitions("task").mapInArrow(_block_stars(threshold), "a long, b long")
    clusters = work.table(components(work, stars, "cluster").select(F.col("node").alias("c"), F.col("label").alias("cluster")), "clusters")
    held = clusters.join(sets.select("c", "n", "shingles"), "c")
    held = _dealt(work, held.withColumn("bytes", 8 * F.col("n")), "cluster", "bytes", cluster_bytes).select("task", "c", "shingles")
    links = held.repartition("task").sortWithinPartitions("task").mapInArrow(_verified_stars(threshold), "a long, b long")
    labels = work.table(components(work, links, "label"), "labels")

    work.keep_only("sets", "classes", "labels")
    by_class = classes.join(labels.withColumnRenamed("node", "c"), "c", "left").select("digest", F.coalesce("label", "c").alias("component_id"))
    joined = rows.join(by_class, "digest", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs without the rows of linked groups but the one of the smallest doc_id; of its repeated rows one stays.

    Rows without doc_id stay, as do texts without a shingle.
    """
    work = Workspace(docs.sparkSession, "unique")
    groups = jaccard_components(docs.select("doc_id", "text"), **options)
    gone = work.table(groups.filter("n_shingles > 0 and doc_id <> component_id").select("doc_id").distinct(), "gone")
    left = by_ids(docs, gone, "doc_id", "left_anti")
    again = work.table(groups.filter("n_shingles > 0 and doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "again")
    repeated = by_ids(left.filter("doc_id is not null and text is not null"), again, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return by_ids(left, again, "doc_id", "left_anti").unionByName(repeated) if again.limit(1).count() else left
