"""Every registered query of the engine beside its SQL."""

import pytest

from tests.compare import assert_same, connect
from tracelane.plans.oracles import ORACLE_SQL
from tracelane.plans.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, name):
    assert_same(QUERIES[name](spark, sf), connect(sf), ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry_imports_without_the_text_operators(monkeypatch):
    import importlib.util

    import __spark_entry__ as entry

    find = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name.startswith(("tracelane.llm", "corpus_pipeline")) else find(name, *a))
    assert set(entry.queries()) == set(QUERIES)
    assert set(entry.oracle_sql()) == set(ORACLE_SQL)
