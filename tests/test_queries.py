"""Every query of the core against its SQL, and the driver's contract."""

import pytest
from oracle import FOLDER, same

from lexigrove.operators import queries as keyed
from lexigrove.plans import engine_queries as engine
from lexigrove.plans import queries as searches

QUERIES, SQL = keyed.QUERIES | searches.QUERIES | engine.QUERIES, keyed.SQL | searches.SQL | engine.SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    same(spark, QUERIES[name], SQL[name])


def test_all_core_queries_have_sql():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["seq"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_is_indexed_on_the_spot(spark, capsys):
    searches.event_corpus(spark, FOLDER).search(searches.Term("k", "69")).explain()
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and "Join" not in plan and "Generate" not in plan


def test_term_lookup_is_pushed_down(spark, capsys):
    searches.corpus(spark, FOLDER).match(searches._RELAY).explain()
    plan = capsys.readouterr().out
    assert "EqualTo(field,job)" in plan and "EqualTo(term,relay-alpha)" in plan
    searches.corpus(spark, FOLDER).match(searches.Regexp("host", "^rk0")).explain()
    assert "StringStartsWith(term,rk0)" in capsys.readouterr().out
