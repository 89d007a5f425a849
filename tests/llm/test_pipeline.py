"""The pipeline against the operators' brute-force versions."""

import corpus_pipeline
from factloom.llm.queries import oracle_sql, queries
from tests.llm.test_operators import base_counts, brute_components


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, given, kept = docs.columns, {}, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / name)
        given[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
        stage(spark, docs, sf).write.parquet(out)
        docs = spark.read.parquet(out)
        assert k + 1 == len(corpus_pipeline.STAGES) or docs.columns == columns
        kept[name] = {r["doc_id"] for r in docs.collect()}
    failed = {i for i, t in given["quality_rules"].items() if (c := base_counts(t))[0] < 50 or 100 * c[4] > 50 * c[0]}
    assert not failed & kept["quality_rules"]
    assert kept["line_dedup"] == kept["quality_rules"]
    groups = brute_components(list(given["ngram_jaccard_join"].items()))
    assert kept["ngram_jaccard_join"] == {c for _, _, c in groups}
    assert kept["sentencepiece"] == kept["benchmark_decontamination"] < kept["ngram_jaccard_join"]


def test_names():
    assert set(oracle_sql()) <= set(queries()) and len(queries()) == 13


def test_copies_reach_the_join_whole(spark):
    """Groups of exact copies: one whole document of each stays, and none that line dedup empties."""
    text = lambda k: "\n".join(f"{w} group {'abcd'[k]} tells its own story of {w} here" for w in ("first", "second", "third"))
    shared = [f"subscribe {x} to our weekly letter for more" for x in ("now", "today")]
    rows = [(k, text(0)) for k in range(3)] + [(10 + k, text(1) + "\n" + shared[0]) for k in range(1000)]
    rows += [(2000, text(2) + "\n" + shared[0]), (2001, text(3) + "\n" + shared[0]), (2002, shared[0]), (2002, shared[0]), (None, text(0))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = corpus_pipeline.line_dedup(spark, docs, "")
    got = {r["doc_id"]: r["text"] for r in left.collect()}
    assert left.count() == len(rows) - 2 and 2002 not in got
    assert {got[k] for k in range(3)} == {text(0)} and {got[10 + k] for k in range(1000)} == {rows[3][1]}
    assert (got[2000], got[2001], got[None]) == (text(2), text(3), text(0))
    kept = corpus_pipeline.ngram_jaccard_join(spark, left, "").collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"]) for r in kept) == sorted([(True, 0, text(0)), (True, 10, rows[3][1]), (True, 2000, text(2)), (True, 2001, text(3)), (False, 0, text(0))])


def test_passages_of_two_documents(spark):
    """A long line of two different texts stays in the first only; short and merely similar ones stay in both."""
    long = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    near, short = long[::-1], "a short line of seven words only"
    rows = [(1, f"one begins\n{long}\n{short}"), (2, f"two begins\n{long} \n{short}"), (3, f"three begins\n{near} other"), (6, f"six begins\n{near} one"), (4, f"four\n{'9 ' * 60}"), (5, f"five\n{'8 ' * 60}")]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert got == {k: t for k, t in rows} | {2: f"two begins\n{short}"}
