"""Property tests: Spark expressions and operators against plain-Python
references on generated inputs (each example is one small Spark job)."""

import datetime as D

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from helpers import make_tables
from podium.functions import exprs as X
from podium.functions import search as S
from podium.operators.facts import attributed_results
from podium.operators.paging import PageSpec, asc, desc, page, seek_page

SETTINGS = settings(max_examples=15, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])

dates = st.dates(min_value=D.date(1950, 1, 1), max_value=D.date(2030, 12, 31))


def py_age(b: D.date, t: D.date) -> int:
    return t.year - b.year - (1 if (t.month, t.day) < (b.month, b.day) else 0)


@SETTINGS
@given(st.lists(st.tuples(dates, dates), min_size=1, max_size=40))
def test_age_matches_python(spark, pairs):
    df = spark.createDataFrame(pairs, "b date, t date")
    got = [r["age"] for r in df.select(X.age_years("b", df["t"]).alias("age")).collect()]
    assert got == [py_age(b, t) for b, t in pairs]


def py_gender(g):
    if g is not None and (g.lower() == "m" or g == "male"):
        return "Male"
    if g is not None and (g.lower() == "f" or g == "female"):
        return "Female"
    return "Unknown" if g is None else g


@SETTINGS
@given(st.lists(st.one_of(st.none(), st.sampled_from(["M", "m", "male", "Male", "F", "f", "female", "x", ""]),
                          st.text(alphabet="mMfFaelx ", max_size=6)), min_size=1, max_size=30))
def test_gender_category_matches_python(spark, genders):
    df = spark.createDataFrame([(g,) for g in genders], "gender string")
    got = [r["g"] for r in df.select(X.gender_category("gender").alias("g")).collect()]
    assert got == [py_gender(g) for g in genders]


@SETTINGS
@given(st.text(alphabet="ab%_\\ ", max_size=6))
def test_like_pattern_literal_chars(term):
    p = S.like_pattern(term)
    assert p.startswith("%") and p.endswith("%")
    # every backslash escapes %, _ or a backslash (a trailing one escapes the
    # closing %, as PostgreSQL reads '%term\\%' too)
    i = 1
    while i < len(p) - 1:
        if p[i] == "\\":
            assert p[i + 1] in "%_\\"
            i += 2
        else:
            i += 1


rows_strategy = st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 3)),
                                   st.one_of(st.none(), st.sampled_from(["a", "b", "c"]))),
                         min_size=0, max_size=25)


@SETTINGS
@given(rows_strategy, st.integers(1, 6), st.booleans())
def test_seek_pages_concatenate_to_the_sorted_list(spark, rows, size, descending):
    data = [(i + 1, a, b) for i, (a, b) in enumerate(rows)]
    df = spark.createDataFrame(data, "id long, a int, b string")
    keys = [("a", descending), ("b", False), ("id", False)]
    order = [desc("a") if descending else asc("a"), asc("b"), asc("id")]
    full = [tuple(r) for r in df.orderBy(*order).collect()]
    got, after = [], None
    for _ in range(len(data) + 1):
        pg = [tuple(r) for r in seek_page(df, keys, after, size).collect()]
        if not pg:
            break
        got += pg
        after = (pg[-1][1], pg[-1][2], pg[-1][0])
    assert got == full
    n_pages = (len(full) + size - 1) // size
    by_offset = [tuple(r) for p in range(1, n_pages + 1) for r in page(df, order, PageSpec(p, size)).collect()]
    assert by_offset == full


ATHLETES = [(1, "A", "X", "X A", None, None, "SGP", None), (2, "B", "Y", "Y B", None, None, "MAS", None),
            (3, "C", "Z", "Z C", None, None, "THA", None)]
fact_rows = st.lists(st.tuples(st.one_of(st.none(), st.integers(1, 4)),
                               st.one_of(st.none(), st.sampled_from(["X A", "Y B", "Q"])),
                               st.sampled_from(["SGP", "MAS", "THA", "VNM"]),
                               st.sampled_from([None, "", "1.0"])), min_size=0, max_size=30)


def py_attribution(results, countries):
    by_id = {a[0]: a for a in ATHLETES}
    out = []
    for rid, aid, name, nat, mark in results:
        if mark is None or mark == "":
            continue
        if aid is not None:
            a = by_id.get(aid)
            if a is not None and a[6] in countries:
                out.append((rid, a[3], a[6]))
        elif nat in countries:
            out.append((rid, name, nat))
    return sorted(out, key=str)


@SETTINGS
@given(fact_rows, st.sampled_from([["SGP"], ["SGP", "MAS"], ["VNM", "THA"]]))
def test_attribution_forms_match_union_semantics(spark, rows, countries):
    results = [(i + 1, 1, aid, name, nat, 1, mark, 0.0, 0.0, False) for i, (aid, name, nat, mark) in enumerate(rows)]
    expected = py_attribution([(r[0], r[2], r[3], r[4], r[6]) for r in results], countries)
    for bound in (1_000_000, 0):  # broadcast probe vs salted shuffle join
        t = make_tables(spark, broadcast_max_rows=bound, athletes=ATHLETES, results=results)
        got = sorted(((r["id"], r["owner_name"], r["owner_country"])
                      for r in attributed_results(t, countries).collect()), key=str)
        assert got == expected
