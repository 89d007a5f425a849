"""The driver's contract."""

import sys

import __spark_entry__ as entry


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_without_llm(monkeypatch):
    """Without the llm folders the rest still imports."""
    for name in [n for n in sys.modules if n.startswith("factloom.llm") or n in {"corpus_pipeline", "__spark_entry__"}]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    import __spark_entry__ as bare

    assert bare.llm is None and "coverage" in bare.queries() and not any(k.startswith("op") and k[2].isdigit() for k in bare.queries())
