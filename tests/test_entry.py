import sys

import __spark_entry__ as entry


def test_registry():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) > 150


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["k", "share"] and df.count() > 0


def test_imports_without_the_optional_operators(monkeypatch):
    import importlib

    for name in [m for m in sys.modules if m.startswith(("clinmill.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "clinmill.llm.queries", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    try:
        again = importlib.reload(entry)
        assert not any(k.startswith("op") and k[2].isdigit() for k in again.queries())
        assert "pipeline" not in again.queries()
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
