import importlib
import os
import sys

import pytest

SF = "/root/testdata/sf0.001"


def test_entry_without_the_optional_subpackage(monkeypatch):
    monkeypatch.setitem(sys.modules, "textquarry.llm", None)
    monkeypatch.setitem(sys.modules, "textquarry.llm.queries", None)
    for name in ("__spark_entry__",):
        sys.modules.pop(name, None)
    e = importlib.import_module("__spark_entry__")
    assert "p3_found" in e.queries() and "p1_found" not in e.queries()
    sys.modules.pop("__spark_entry__")


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_every_core_query_runs(spark):
    from textquarry import queries

    assert set(queries.SQL) <= set(queries.QUERIES)
    held = []
    for name, query in queries.QUERIES.items():
        held.append((name, query(spark, SF).limit(5)))
        if len(held) > 1:  # what is derived from a result can be read after another query has run
            before, derived = held.pop(0)
            assert derived.count() >= 0, before
    assert held[0][1].count() >= 0
