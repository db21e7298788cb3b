"""Every query with SQL of its own against DuckDB, over the smallest tables."""

import pytest

import oracle
from engine_data import DATA
from spanloom import tools
from spanloom.plans import registry

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", registry.ORACLES)
def test_query_against_sql(spark, con, name):
    more, less, mine, theirs = oracle.compare(registry.QUERIES[name](spark, SF), registry.ORACLES[name], con)
    assert mine == theirs
    assert not more and not less, (list(more.items())[:3], list(less.items())[:3])


@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - registry.ORACLES.keys()))
def test_query_without_sql_has_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["tool_find_symbol", "tool_outline", "tool_find_callers", "tool_find_callees"])
def test_every_page_of_a_reply(spark, con, monkeypatch, name):
    monkeypatch.setattr(tools, "PAGE", 3)
    assert len(con.sql(registry.ORACLES[name])) > 3 or name == "tool_outline"
    more, less, *_ = oracle.compare(registry.QUERIES[name](spark, SF), registry.ORACLES[name], con)
    assert not more and not less, (list(more.items())[:3], list(less.items())[:3])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns[0] == "dst"
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_stands_without_the_corpus_operators():
    """As if the subpackage and its pipeline were deleted."""
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['spanloom.llm'] = sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; names = e.queries(); assert 'callers' in names and not any(n.startswith('op') for n in names) and 'pipeline' not in names and set(e.oracle_sql()) <= set(names)"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, check=True)
