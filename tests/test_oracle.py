"""Every registered query equals its DuckDB oracle on the driver's tables."""

import os

import pytest

import __spark_entry__ as E
from oracle.compare import canonical, duckdb_connection, run_oracle

SF_DIRS = [d for d in ("/root/testdata/sf0.01", "/root/testdata/sf0.001") if os.path.isdir(d)]
SQL = E.oracle_sql()


_CONNECTIONS = {}


def _connection(sf_dir):
    """One DuckDB connection for each scale factor."""
    if sf_dir not in _CONNECTIONS:
        _CONNECTIONS[sf_dir] = duckdb_connection(sf_dir)
    return _CONNECTIONS[sf_dir]


@pytest.fixture(scope="module", params=SF_DIRS)
def sf(request):
    return request.param, _connection(request.param)


def test_every_query_has_an_oracle():
    assert set(E._QUERIES) <= set(SQL)


@pytest.mark.parametrize("key", sorted(E._QUERIES))
def test_query_matches_oracle(spark, sf, key):
    sf_dir, con = sf
    df = E.queries()[key](spark, sf_dir)
    scols, srows = df.columns, [tuple(r) for r in df.collect()]
    ocols, orows = run_oracle(con, SQL[key])
    assert sorted(scols) == sorted(ocols)
    assert len(srows) == len(orows)
    assert canonical(scols, srows) == canonical(ocols, orows)


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["country_code", "country_name", "athlete_count", "result_count"]
    assert len(rows) >= 0


def test_expected_figures_sf001(spark):
    """Figures stated in FIXTURES.md §5 (sf0.01)."""
    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("no sf0.01 data")
    q = E.queries()
    assert q["athletes_count"](spark, d).first()["total"] == 125
    assert q["athlete_results_count"](spark, d).first()["total"] == 31
    assert q["timeline"](spark, d).count() == 4
    assert q["regional_comparison"](spark, d).count() == 6
    assert q["competition_athletes_count"](spark, d).first()["total"] == 356
    s = q["country_summary"](spark, d).first()
    assert s["total_results"] == 4596


def test_participant_groups_sf001(spark):
    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("no sf0.01 data")
    from podium.plans.drilldowns import competition_participants

    assert competition_participants(E.tables(spark, d), 7).count() == 491


@pytest.mark.parametrize("key", sorted(E._QUERIES))
def test_shuffle_paths_match_oracle(spark, key):
    """The same queries with the broadcast bound at 0 rows: every dimension
    join takes the shuffle path (salted NULL keys, pre-joined race context)."""
    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no sf0.001 data")
    from podium.sources.fixtures import derived_tables

    t = derived_tables(spark, d, broadcast_max_rows=0)
    df = E._text_arrays(E._QUERIES[key](t))
    ocols, orows = run_oracle(_connection(d), SQL[key])
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(ocols, orows)
