import importlib
import sys

import __spark_entry__


def test_contract(spark):
    found, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(found) and len(found) > 100
    assert __spark_entry__.entry(spark).columns == ["p_partkey", "p_name", "p_type", "p_size", "p_retailprice"]


def test_without_the_llm_package(monkeypatch):
    for name in [n for n in sys.modules if n.startswith("quern.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "quern.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.delattr(sys.modules["quern"], "llm", raising=False)
    try:
        again = importlib.reload(__spark_entry__)
        assert again.queries() and not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in again.queries())
    finally:
        monkeypatch.undo()
        importlib.reload(__spark_entry__)
