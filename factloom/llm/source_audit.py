"""Source divergence audit: how far the words of a language's sources lie from each other and from the language.

Words are counted map-side, a few MB of text at a time, so that only counts are shuffled. Each kept term of a language
is pivoted into one wide vector of counts indexed by the language's sources, and of probabilities in billionths;
higher-order functions emit what the term adds to each pair of sources, and a hash aggregation, combined map-side,
sums that. Sums of a group and of a language are computed from the kept terms first; sources are the only thing that
is broadcast, if their bytes are few.

All arithmetic is exact: p = 1 + floor(10^9 (count + 2) / (N + 2 V)) in decimals of 38 digits, f = floor((p - q)^2 / (p + q))
in longs, which hold 10^18.

Defined cases: null text, lang and source count as ''; repeated rows are documents of their own; a language without kept
terms gives pairs of value 0 and no terms; an empty table gives an empty one; other columns are left out. A language's
sources are a value of one row, as the result has a row for each two of them.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import Workspace, bounded, text_buffers, with_small

MIN_DOCS, TOP, SCALE = 10, 10, 1_000_000_000
#: Words counted before a task gives its counts on.
HELD = 1 << 18
#: What a byte counts as: letters, in lower case, and all bytes of characters beyond ASCII are parts of terms, others separate them.
BYTES = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
COUNTS = "lang string, source string, term string, n long, docs long"


# ---------------------------------------------------------------- counts


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by language and source; a row of a null term for each group itself."""
    n: dict[tuple[str, str], Counter] = defaultdict(Counter)
    docs: dict[tuple[str, str], Counter] = defaultdict(Counter)

    def given() -> pa.RecordBatch:
        keys = [(lang, source, t) for (lang, source), c in n.items() for t in (None, *c)]
        columns = [pa.array([k[i] for k in keys], pa.string()) for i in (0, 1)]
        columns.append(pa.array([k[2] and k[2].decode() for k in keys], pa.string()))
        columns += [pa.array([0 if t is None else x[lang, source][t] for lang, source, t in keys], pa.int64()) for x in (n, docs)]
        n.clear()
        docs.clear()
        return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    held = 0
    for batch in batches:
        data, offsets = text_buffers(batch.column("text"))
        for lang, source, i, j in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), offsets[:-1], offsets[1:], strict=True):
            words = data[i:j].tobytes().translate(BYTES).split()
            of, once = n[lang, source], docs[lang, source]
            before = len(of)
            of.update(words)
            once.update(set(words))
            held += len(of) - before
            if held > HELD:
                yield given()
                held = 0
    if n:
        yield given()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of documents (text, lang, source); of each group a row without a term too."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    found = bounded(docs.select(said("lang"), said("source"), said("text"))).mapInArrow(_counted, COUNTS)
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


# ---------------------------------------------------------------- divergence


def probability(count: Column, total: Column, size: Column) -> Column:
    """In billionths, smoothed by two occurrences of each term, and 1 at least; counts may be beyond 10^9."""
    whole = lambda x: x.cast("decimal(19,0)")
    return F.call_function("div", (whole(count) + 2) * F.lit(SCALE).cast("decimal(10,0)"), whole(total) + whole(size) * F.lit(2).cast("decimal(1,0)")) + 1


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _vectors(counts: DataFrame, work: Workspace, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """(wide vectors of the kept terms: lang, term, p by source, whole q, counts; languages: lang, size, sources)."""
    terms = counts.filter("term is not null").groupBy("lang", "term")
    kept = terms.agg(F.collect_list(F.struct("source", "n")).alias("found"), F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = work.table(kept.filter(F.col("docs") >= min_docs).drop("docs"), "kept")
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("size"), F.sum("n").alias("total"))
    of_source = kept.select("lang", F.explode("found").alias("f")).groupBy("lang", "f.source").agg(F.sum("f.n").alias("total"))
    groups = counts.filter("term is null").select("lang", "source").join(of_source, ["lang", "source"], "left")
    sources = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("total", F.lit(0)).alias("total")))).alias("sources"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    langs = work.table(sources.join(of_lang, "lang", "left").select("lang", zero("size"), zero("total"), "sources"), "langs")
    row = 64 + F.octet_length("lang") + F.aggregate("sources", F.lit(0), lambda a, s: a + 40 + F.octet_length(s["source"]))
    wide = with_small(kept, langs, "lang", "inner", row)
    by_source = F.map_from_entries("found")
    vector = F.transform("sources", lambda s: F.coalesce(F.try_element_at(by_source, s["source"]), F.lit(0)))
    wide = wide.select("lang", "term", "size", "sources", vector.alias("vector"), probability(F.col("n"), F.col("total"), F.col("size")).alias("q"))
    p = F.zip_with("vector", "sources", lambda n, s: probability(n, s["total"], F.col("size")))
    return work.table(wide.select("lang", "term", "q", "vector", p.alias("p")), "wide"), langs


def divergences(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): a language's other sources by their distance, and the terms that stand out most."""
    work = Workspace(docs.sparkSession, "sources")
    counts = work.table(term_counts(docs), "counts")
    wide, langs = _vectors(counts, work, min_docs)
    work.drop("counts", "kept")
    # of each two sources once, by their places
    pairs = F.flatten(F.transform("p", lambda x, i: F.transform(F.slice("p", i + 2, F.size("p")), lambda y, j: F.struct(i.alias("i"), (i + j + 1).alias("j"), divergence(x, y).alias("f")))))
    sums = wide.select("lang", F.explode(pairs).alias("e")).groupBy("lang", "e.i", "e.j").agg(F.sum("e.f").alias("value"))
    sums = work.table(sums, "sums")
    both = sums.unionByName(sums.select("lang", F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    names = work.table(langs.select("lang", "size", F.posexplode("sources").alias("at", "s")).select("lang", "at", F.col("s.source").alias("source")), "names")
    other = langs.select("lang", F.explode(F.sequence(F.lit(0), F.size("sources") - 1)).alias("i"), F.size("sources").alias("k"))
    other = other.select("lang", "i", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("j")).filter("i <> j").join(both, ["lang", "i", "j"], "left")
    named = lambda df, at, c: df.join(names.select("lang", F.col("at").alias(at), F.col("source").alias(c)), ["lang", at])
    pair = named(named(other, "i", "source"), "j", "item").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    spot = F.transform(F.zip_with("p", "vector", lambda p, n: F.struct(p.alias("p"), n.alias("n"))), lambda x, i: F.struct(i.alias("i"), x["p"].alias("p"), x["n"].alias("n")))
    term = wide.select("lang", "term", "q", F.explode(F.filter(spot, lambda x: (x["n"] > 0) & (x["p"] > F.col("q")))).alias("x")).select("lang", "x.i", "term", divergence(F.col("x.p"), F.col("q")).alias("value"))
    best = Window.partitionBy("lang", "i").orderBy(F.desc("value"), "term")
    term = term.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    term = named(term, "i", "source").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    pair = pair.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return pair.unionByName(term)
