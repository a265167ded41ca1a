"""Lake round trip, parameterised SQL, sinks."""

import json
import os
import uuid

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from oracle.compare import canonical
from podium.operators.paging import PageSpec, asc, page, page_info
from podium.plans import drilldowns as R
from podium.plans import listings as L
from podium.session import scratch_dir
from podium.sources.fixtures import write_lake
from podium.sources.sinks import append, append_results, envelope, json_rows
from podium.sources.sql import run_sql
from podium.sources.tables import load_tables

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no sf0.001 data")


@pytest.fixture(scope="module")
def lake(spark):
    out = scratch_dir(spark, f"test-lake-{uuid.uuid4().hex[:8]}")
    write_lake(spark, SF, out, results_files=4)
    return out


@pytest.mark.parametrize("key", sorted(E._QUERIES))
def test_lake_equals_derived(spark, lake, key):
    t_lake = load_tables(spark, lake)
    t_view = E.tables(spark, SF)
    a = E._text_arrays(E._QUERIES[key](t_lake))
    b = E._text_arrays(E._QUERIES[key](t_view))
    assert canonical(a.columns, [tuple(r) for r in a.collect()]) == \
        canonical(b.columns, [tuple(r) for r in b.collect()])


def test_lake_schema_is_declared(spark, lake):
    t = load_tables(spark, lake)
    assert t.results_by_athlete is not None  # the optional athlete layout was written and found
    assert t.results_by_athlete.count() == t.results.count()
    assert load_tables(spark, lake, with_athlete_layout=False).results_by_athlete is None
    assert [f.name for f in t.results.schema] == ["id", "race_id", "athlete_id", "athlete_name", "nationality",
                                                  "place", "mark", "wind", "points", "qualified"]


def test_parameterised_sql_matches_dataframe(spark):
    t = E.tables(spark, SF)
    df = run_sql(t, """
        SELECT COUNT(r.id) AS total FROM results r JOIN races ra ON r.race_id = ra.id
        WHERE ra.competition_id = :cid AND r.mark IS NOT NULL AND r.mark != ''""", cid=7)
    assert df.first()["total"] == R.competition_results_count(t, 7).first()["total"]
    page_df = run_sql(t, "SELECT id FROM athletes WHERE full_name ILIKE :pat ORDER BY id LIMIT :n OFFSET :o",
                      pat="%given7 %", n=3, o=1)
    assert len(page_df.collect()) <= 3


def test_append_counts_rows(spark):
    t = E.tables(spark, SF)
    out = scratch_dir(spark, f"test-append-{uuid.uuid4().hex[:8]}")
    n1 = append(t.competitions.select("id", "name"), out)
    n2 = append(t.competitions.select("id", "name").filter(F.col("id") < 4), out)
    assert n1 == t.competitions.count() and n2 == 3
    assert spark.read.parquet(out).count() == n1 + n2


def test_envelope_keeps_page_order(spark):
    t = E.tables(spark, SF)
    spec = PageSpec(1, 5)
    order = [asc("full_name"), asc("id")]
    rows = page(L._searched_athletes(t, None).select("id", "full_name", "birth_date"), order, spec)
    env = envelope(rows, "athletes", order, page_info(L.athletes_count(t), spec), {"source": "test"})
    doc = json.loads(env.first()["json"])
    assert [a["id"] for a in doc["athletes"]] == [r["id"] for r in rows.collect()]
    assert doc["total"] == t.athletes.count() and doc["per_page"] == 5 and doc["source"] == "test"
    assert json.loads(json_rows(rows).first()["json"])["id"] == doc["athletes"][0]["id"]


def test_responses(spark):
    from podium.plans import responses as RS

    t = E.tables(spark, SF)
    doc = json.loads(RS.competitions(t, 1, 5).to_json().first()["json"])
    rows = [r["id"] for r in L.competitions_list(t, None, 1, 5).collect()]
    assert [c["id"] for c in doc["competitions"]] == rows
    assert doc["total"] == L.competitions_with_results_count(t).first()["total"] and doc["per_page"] == 5
    a = json.loads(RS.athlete_results(t, 8).to_json().first()["json"])
    assert a["found"] is True and a["athlete_name"] and a["total"] == len(a["results"])
    missing = json.loads(RS.athlete_results(t, -1).to_json().first()["json"])
    assert missing["found"] is False and missing["results"] == [] and missing["total"] == 0
    d = json.loads(RS.country_stats_json(t, as_of="2001-08-01").first()["json"])
    assert set(d) == {"summary", "gender_distribution", "discipline_breakdown", "timeline",
                      "top_athletes", "regional_comparison"}
    counts = [x["result_count"] for x in d["regional_comparison"]]
    assert counts == sorted(counts, reverse=True) and len(counts) == 6
    assert d["summary"]["total_athletes"] >= 0


def test_large_pages_come_as_lines(spark):
    from podium.plans import responses as RS

    t = E.tables(spark, SF)
    small = json.loads(RS.competition_results(t, 7, 1, 10_000).to_json().first()["json"])
    lines = [json.loads(r["json"]) for r in RS.competition_results(t, 7, 1, 10 ** 9).to_json().collect()]
    head, rows = lines[0], [r for line in lines[1:] for r in line["results"]]
    assert rows == small["results"] and head["total"] == small["total"] == len(rows)
    assert head["competition_id"] == 7
    assert RS.athlete_search(t, "given7", 100).size == 50


def test_first_version_and_dimension_responses(spark):
    from podium.plans import responses as RS

    t = E.tables(spark, SF)
    for made, key in ((RS.competitions_basic(t, 1, 3), "competitions"), (RS.athletes_basic(t, 1, 3), "athletes"),
                      (RS.competition_results_basic(t, 7, 1, 3), "results"),
                      (RS.athlete_results_basic(t, 8, 1, 3), "results"),
                      (RS.disciplines(t), "disciplines"), (RS.countries(t), "countries")):
        doc = json.loads(made.to_json().first()["json"])
        assert len(doc[key]) == min(made.size, doc["total"])
    assert json.loads(RS.competitions_basic(t, 1, 3).to_json().first()["json"])["total"] == t.competitions.count()
    people = json.loads(RS.competition_athletes(t, 7, 1, 2).to_json().first()["json"])
    assert people["total"] == R.competition_participants(t, 7).count()
    assert people["pages"] == -(-people["total"] // 2)


def test_deep_and_large_pages_are_distributed(spark):
    from pyspark.sql import functions as F

    from podium.operators.paging import TOP_K_ROWS

    df = spark.range(400_000).select((F.col("id") * 7919 % 400_000).alias("id"), F.lit("x").alias("v"))
    keys = [("id", True)]
    third = page(df, keys, PageSpec(3, 150_000))
    got = [r["id"] for r in third.collect()]
    assert got == list(range(99_999, -1, -1))
    deep = page(df, keys, PageSpec(39_999, 10))
    assert [r["id"] for r in deep.collect()] == list(range(19, 9, -1))
    assert page(df, keys, PageSpec(50_000, 10)).count() == 0
    for out in (third, deep):
        assert "TakeOrdered" not in out._jdf.queryExecution().executedPlan().toString()
    assert PageSpec(1, 100).size + PageSpec(1, 100).offset <= TOP_K_ROWS
    shallow = page(df, keys, PageSpec(2, 10))
    assert [r["id"] for r in shallow.collect()] == list(range(399_989, 399_979, -1))
    assert [r["id"] for r in page(df, keys, PageSpec(1, 3), after=(100,)).collect()] == [99, 98, 97]


def test_reports_take_a_seek_position(spark):
    t = E.tables(spark, SF)
    for report, keys in ((lambda **k: L.competitions_list(t, None, 1, 4, **k), L.MOST_RESULTS),
                         (lambda **k: L.competitions_list_basic(t, None, 1, 4, **k), L.NEWEST),
                         (lambda **k: L.athletes_list(t, None, page_no=1, per_page=4, **k), L.BY_NAME),
                         (lambda **k: R.competition_results(t, 7, 1, 4, **k), R.NEWEST_RACE),
                         (lambda **k: R.competition_athletes(t, 7, 1, 4, **k), R.MOST_ACTIVE)):
        first = report().collect()
        nxt = report(after=tuple(first[1][name] for name, _ in keys)).collect()
        assert [r["id"] for r in nxt][:2] == [r["id"] for r in first][2:]


def test_append_keeps_both_layouts_in_step(spark):
    out = scratch_dir(spark, f"test-steps-{uuid.uuid4().hex[:8]}")
    write_lake(spark, SF, out, results_files=2)
    more = load_tables(spark, out).results.withColumn("id", F.col("id") + 10 ** 15)

    def rows(key, t):
        df = E._text_arrays(E._QUERIES[key](t))
        return canonical(df.columns, [tuple(r) for r in df.collect()])

    n = more.count()
    assert append_results(more, out) == n
    both, plain = load_tables(spark, out), load_tables(spark, out, with_athlete_layout=False, with_companions=False)
    assert both.results_by_athlete is not None and both.results.count() == 2 * n
    keys = [k for k in E._QUERIES if k not in ("country_dashboard", "list_positions", "appended_competitions") and not k.startswith("lake_")]
    for key in keys:
        assert rows(key, both) == rows(key, plain), key
    # an append that stopped after the fact: the copy is not read
    append(more.withColumn("id", F.col("id") + 10 ** 15), os.path.join(out, "results"))
    after = load_tables(spark, out)
    assert after.results_by_athlete is None and after.results.count() == 3 * n
    # and stays unread until the layouts are written again
    append_results(more.limit(5).withColumn("id", F.col("id") + 10 ** 16), out)
    assert load_tables(spark, out).results_by_athlete is None and load_tables(spark, out).results.count() == 3 * n + 5


def test_lake_plans_prune_the_fact(spark, lake):
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    t = load_tables(spark, lake)

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    comp = plan(R.competition_results(t, 7))
    assert "GreaterThanOrEqual(race_id," in comp and "LessThanOrEqual(race_id," in comp
    ath = plan(R.athlete_results(t, 8))
    assert "results_by_athlete" in ath and "EqualTo(athlete_id,8)" in ath
