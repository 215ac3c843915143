import pytest

from docloom.oracles import ORACLES
from docloom.queries import QUERIES
from tests.oracle import check

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_duckdb(spark, name):
    check(spark, name, QUERIES[name], ORACLES[name], SMALL)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SMALL).collect()


def test_entry(spark):
    import __spark_entry__ as entry

    assert len(entry.entry(spark).collect()) == 50
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_push_down(spark, capsys):
    from docloom.queries import catalog

    events = catalog(spark, SMALL).collection("events").where("event_type", "=", "click").where("value", ">", 50).order_by("ts", "desc").limit(5).select("event_id", "value").df()
    events.explain("formatted")
    plan = capsys.readouterr().out
    assert "EqualTo(event_type,click)" in plan and "GreaterThan(value,50" in plan and "TakeOrderedAndProject" in plan and "props" not in plan
