import oracle
import pytest

from tessera.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_matches_sql(spark, small, name):
    oracle.check(spark, small, catalogue.QUERIES[name], catalogue.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, small, name):
    assert catalogue.QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())


def test_a_subpackage_that_cannot_be_imported_is_left_out(monkeypatch):
    import sys

    import __spark_entry__

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)  # importing it raises ImportError
    for name in list(sys.modules):
        if name.startswith("tessera.llm"):
            monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "tessera.llm", None)
    assert set(__spark_entry__.queries()) == set(catalogue.QUERIES) and set(__spark_entry__.oracle_sql()) == set(catalogue.SQL)
