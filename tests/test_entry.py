"""The driver's contract."""

import importlib
import sys

import pytest

import __spark_entry__


def test_queries_and_sql_agree():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and all(map(callable, queries.values()))


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and df.columns[0] == "cite_id"


def test_works_without_the_subpackage(monkeypatch):
    for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("lodestone.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "lodestone.llm", None)
    lodestone = importlib.import_module("lodestone")
    if hasattr(lodestone, "llm"):
        monkeypatch.delattr(lodestone, "llm")
    try:
        entry = importlib.reload(__spark_entry__)
        assert "hybrid_wrrf" in entry.queries() and "pipeline" not in entry.queries()
    finally:
        monkeypatch.undo()
        importlib.reload(__spark_entry__)


def test_other_import_errors_surface(monkeypatch):
    monkeypatch.setitem(sys.modules, "lodestone.plans.catalogue", None)
    plans = importlib.import_module("lodestone.plans")
    if hasattr(plans, "catalogue"):
        monkeypatch.delattr(plans, "catalogue")
    with pytest.raises(ImportError):
        importlib.reload(__spark_entry__)
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
