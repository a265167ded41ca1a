"""What is kept or looked up inside the plan: pages from a kept order, counts
per owner, identities and race bounds as subqueries, broadcasts by bytes."""

from __future__ import annotations

import dataclasses
import json
import uuid

import pytest
from pyspark.sql import functions as F

import podium.operators.paging as paging
from podium.operators.paging import PageSpec, page
from podium.plans import dashboard as D
from podium.plans import drilldowns as R
from podium.plans import listings as L
from podium.plans import responses as RS
from podium.session import scratch_dir
from podium.sources.lake import write_tables
from podium.sources.schemas import SCHEMAS
from podium.sources.sinks import append_results
from podium.sources.tables import load_tables

from helpers import make_tables

N = 6000  # results


def results(first: int, n: int) -> list[tuple]:
    """Linked ones, orphans with an athlete's name or another, dangling ids."""
    return [(i, i % 300 + 1, None if i % 4 == 0 else i % 50 + 1, None if i % 13 == 0 else f"G F{i % 60}",
             ("SGP", "MAS", "THA", None)[i % 4 if i % 5 else 3], i % 9, None if i % 7 == 0 else "" if i % 11 == 0 else "9.9",
             1.0, 2.0, False) for i in range(first, first + n)]


@pytest.fixture(scope="module")
def lakes(spark):
    t = make_tables(
        spark, countries=[("SGP", "Singapore"), ("MAS", "Malaysia")], ranking_categories=[(1, "A")],
        disciplines=[("D", "Dash", "Sprints")], events=[(1, "100m", "100m", "D")],
        athletes=[(i, f"F{i}", "G", f"G F{i}", None, "M", ("SGP", "MAS", None)[i % 3], None) for i in range(1, 45)],
        competitions=[(i, f"Meet {i}", "Hall", "A", "SGP", 1, None, None, 2001, True, None) for i in range(1, 31)],
        races=[(i, (i - 1) // 10 + 1, 1, None, None) for i in range(1, 301)], results=results(1, N))
    path = write_tables(t, scratch_dir(spark, f"test-kept-{uuid.uuid4().hex[:8]}"), results_files=8)
    append_results(spark.createDataFrame(results(N + 1, 300), SCHEMAS["results"]), path, batch="more")
    return load_tables(spark, path), load_tables(spark, path, with_companions=False, with_athlete_layout=False)


def all_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def reads_results(df) -> bool:
    return any("/results" in f for f in df.inputFiles())


def rows_scanned(df, table: str) -> int:
    """Rows that the scans of a table handed on in the run of ``df``."""
    df.collect()

    def scans(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return scans(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return scans(node.plan())
        below = node.children()
        n = sum(scans(below.apply(i)) for i in range(below.size()))
        if kind == "FileSourceScanExec" and f"/{table}" in node.relation().location().rootPaths().mkString(","):
            n += node.metrics().apply("numOutputRows").value()
        return n
    return scans(df._jdf.queryExecution().executedPlan())


def jobs_of(spark, build) -> int:
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "build")
    try:
        build()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext._jsc.clearJobGroup()


# --- look-ups inside the plan --------------------------------------------------

REPORTS = {
    "athlete_results": lambda t: R.athlete_results(t, 7),
    "athlete_results_count": lambda t: R.athlete_results_count(t, 7),
    "competition_results": lambda t: R.competition_results(t, 2),
    "competition_results_count": lambda t: R.competition_results_count(t, 2),
}


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_building_a_drilldown_starts_no_job_and_the_scan_is_pruned(spark, lakes, name):
    kept, plain = lakes
    for dim in SCHEMAS:  # the sizes of the dimensions are taken once
        kept.broadcastable(dim)
    assert jobs_of(spark, lambda: REPORTS[name](kept)) == 0
    table = "results" if name.startswith("competition") else "results_by_athlete"
    assert 0 < rows_scanned(REPORTS[name](kept), table) < N / 2
    assert all_rows(REPORTS[name](kept)) == all_rows(REPORTS[name](plain))


def test_identity_against_a_plain_reading(lakes):
    t, _ = lakes
    rows = t.results.collect()
    for athlete, name in ((7, "G F7"), (44, "G F44"), (50, None), (999, None)):  # 50: results, but no such athlete
        ids = sorted(r["id"] for r in rows if r["mark"] and name and (
            r["athlete_id"] == athlete or (r["athlete_id"] is None and r["athlete_name"] == name)))
        assert sorted(r["id"] for r in R.athlete_result_rows(t, athlete).collect()) == ids
        assert R.athlete_results_count(t, athlete).first()["total"] == len(ids)


def test_a_competition_without_races_has_no_results(lakes):
    t, _ = lakes
    assert R.competition_results(t, 999).collect() == []
    assert R.competition_results_count(t, 999).first()["total"] == 0


def test_athlete_without_a_name_has_linked_results_only(spark):
    t = make_tables(spark, events=[(1, "e", "e", None)], races=[(1, 1, 1, None, None)],
                    competitions=[(1, "c", None, None, None, None, None, None, None, None, None)],
                    athletes=[(1, None, None, None, None, None, None, None)],
                    results=[(1, 1, 1, None, None, 1, "9", None, None, None), (2, 1, None, None, None, 1, "9", None, None, None)])
    assert [r["id"] for r in R.athlete_results(t, 1).collect()] == [1]
    doc = json.loads(RS.athlete_results(t, 1).to_json().first()["json"])
    assert doc["found"] is True and "athlete_name" not in doc and doc["total"] == 1


def test_response_names_the_athlete(lakes):
    t, _ = lakes
    doc = json.loads(RS.athlete_results(t, 7, 1, 3).to_json().first()["json"])
    assert (doc["athlete_id"], doc["athlete_name"], doc["found"], len(doc["results"])) == (7, "G F7", True, 3)
    doc = json.loads(RS.athlete_results(t, 999).to_json().first()["json"])
    assert (doc["found"], doc["total"], doc["results"]) == (False, 0, [])


# --- pages from a kept order -----------------------------------------------------

@pytest.fixture
def sorts(monkeypatch):
    made = []
    keep = paging.keep_order
    monkeypatch.setattr(paging, "keep_order", lambda *a: made.append(a) or keep(*a))
    return made


def test_deep_pages_of_a_list_sort_once(lakes, sorts, monkeypatch):
    monkeypatch.setattr(paging, "TOP_K_ROWS", 10)
    t = dataclasses.replace(lakes[0], kept_orders={})
    pages = [L.competitions_list_basic(t, "meet", n, 7) for n in (5, 3, 2, 1, 6)]
    assert len(sorts) == 1
    got = [[r["id"] for r in p.collect()] for p in pages]
    assert got == [[29, 30], [*range(15, 22)], [*range(8, 15)], [*range(1, 8)], []]
    # A page of the first rows alone sorts nothing away.
    assert L.competitions_list_basic(dataclasses.replace(t, kept_orders={}), "meet", 1, 7).count() == 7
    assert len(sorts) == 1


def test_other_terms_orders_columns_and_tables_have_their_own_order(spark, lakes, sorts, monkeypatch):
    monkeypatch.setattr(paging, "TOP_K_ROWS", 4)
    t = dataclasses.replace(lakes[0], kept_orders={})
    for by, way in (("full_name", "ASC"), ("full_name", "DESC"), ("country_code", "ASC")):
        every = L.athletes_list(t, None, by, way, 1, 44)
        thirds = [r["id"] for n in (1, 2, 3, 4, 5) for r in L.athletes_list(t, None, by, way, n, 10).collect()]
        assert [r["id"] for r in every.collect()] == thirds and len(thirds) == 44
    assert len(sorts) == 3
    assert {r["id"] for r in L.athletes_list(t, "F4", per_page=10).collect()} == {4, 40, 41, 42, 43, 44}
    assert len(sorts) == 4
    # Frames that differ in a name only are alike to Spark; here they are two lists.
    a, b = (spark.range(50).withColumn(c, F.col("id") * 2) for c in "ab")
    orders = {}
    for df in (a, b, a):
        assert page(df, [("id", True)], PageSpec(2, 20), None, orders).columns == df.columns
    assert len(sorts) == 6
    L.athletes_list(dataclasses.replace(t, kept_orders={}), None, page_no=2, per_page=10)
    assert len(sorts) == 7


def test_pages_over_several_parts_ties_and_nulls(spark):
    rows = [(i, None if i % 5 == 0 else i % 3) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, k long").repartition(6)
    kept = paging.keep_order(df, paging.order_of([("k", True), ("id", False)]))
    expected = sorted(rows, key=lambda r: (r[1] is not None, -(r[1] or 0), r[0]))
    assert sum(n for *_, n in kept.parts) == 1000
    for offset, size in ((0, 1000), (195, 10), (0, 1), (999, 5), (1000, 5), (130, 700)):
        assert [tuple(r) for r in kept.cut(offset, size).collect()] == expected[offset:offset + size]
    empty = paging.keep_order(df.limit(0), paging.order_of([("id", False)]))
    assert empty.cut(0, 5).collect() == [] and empty.cut(0, 5).columns == ["id", "k"]


# --- counts per owner ------------------------------------------------------------

COUNTRIES = ("SGP", "MAS", "THA")
OWNED = {"regional_comparison": lambda t: D.regional_comparison(t, COUNTRIES),
         "country_summary": lambda t: D.country_summary(t, "SGP")}


@pytest.mark.parametrize("bound", [1_000_000, 20, 0])
@pytest.mark.parametrize("name", sorted(OWNED))
def test_owner_counts_stand_for_the_fact(lakes, name, bound):
    kept, plain = (dataclasses.replace(t, broadcast_max_rows=bound, _rows={}) for t in lakes)
    assert plain.owner_counts is None
    report = OWNED[name](kept)
    assert all_rows(report) == all_rows(OWNED[name](plain))
    assert not reads_results(report) and reads_results(OWNED[name](plain))


def test_an_athlete_who_changes_country_takes_the_results_along(lakes):
    moved = F.when(F.col("id") == 4, F.lit("THA")).otherwise(F.col("country_code")).alias("country_code")
    renamed = F.when(F.col("id") == 6, F.lit("G F3")).otherwise(F.col("full_name")).alias("full_name")
    reports = []
    for t in lakes:
        athletes = t.athletes.withColumns({"country_code": moved, "full_name": renamed})
        t = dataclasses.replace(t, athletes=athletes, _rows={}, _bytes={})
        reports.append({name: all_rows(report(t)) for name, report in OWNED.items()})
    assert reports[0] == reports[1]
    assert reports[0] != {name: all_rows(report(lakes[0])) for name, report in OWNED.items()}


# --- broadcasts by bytes -----------------------------------------------------------

def test_broadcasts_are_bounded_by_bytes_too(spark):
    names = [(c * 3, c * 1000) for c in "abcd"]
    t = make_tables(spark, countries=names, athletes=[(1, None, None, "é", None, None, None, ["xx", None])])
    assert t.bytes("countries") == 4 * (2 * 8 + 3 + 1000)
    assert t.bytes("athletes") == 8 * 8 + 2 + 2 * 8 + 2
    assert t.bytes("races") == 0 and t.broadcastable("countries")
    narrow = dataclasses.replace(t, broadcast_max_bytes=3000)
    assert not narrow.broadcastable("countries")
    assert narrow.fits("countries", t.countries.limit(2)) and not narrow.fits("countries", t.countries.limit(3))
    assert "BroadcastHint" not in str(narrow.dim("countries")._jdf.queryExecution().analyzed())
