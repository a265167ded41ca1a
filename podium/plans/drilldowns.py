"""Result drill-downs per competition and per athlete (also covering results
not linked to an athlete), and the participants of a competition.

Every drill-down narrows the fact before any join: a competition's races are
a dimension subset whose id range is pushed to the fact scan; an athlete's
predicate is a literal filter on the fact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import search as S
from ..functions.exprs import category_or_default, race_type_or_default, valid_mark
from ..operators.facts import (RESULT_COLS, first_per_key, join_dim,
                               results_of_competition, valid_results,
                               with_athletes, with_race_context)
from ..operators.paging import (LIST_PAGE_CAP, RESULTS_PAGE_SIZE, Key, PageSpec,
                                asc, page)
from ..sources.companions import GRAM
from ..sources.tables import Tables

V1_ATHLETE_PAGE_SIZE = 50
GRAMS_LOOKED_UP = 3   # of a search term's grams, the rarest
NAMES_PUSHED = 200    # names that go to the scan as a list (spark.sql.parquet.pushdown.inFilterThreshold)

NEWEST_RACE: list[Key] = [("race_date", True), ("place", False), ("id", False)]
NEWEST_LINKED: list[Key] = [("race_date", True), ("id", False)]


def _total(df: DataFrame, name: str = "total") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


# race-context columns of the v1 and v2 result rows
V1_CONTEXT = ["race_date", "race_type", "event_title", "discipline_code", "d_name", "d_category"]
V2_CONTEXT = ["ra_race_type", "event_name", "discipline_code", "d_name", "d_category", "c_start_date"]


def _v2_columns(df: DataFrame, extra: list | None = None,
                athlete_name_from_athlete: bool = True) -> DataFrame:
    """The v2 result row: the result's columns with ``athlete_name``
    overridden by the athlete's name when linked, plus display fallbacks."""
    cols = [F.col(c) for c in RESULT_COLS if c != "athlete_name"]
    name = F.coalesce("a_full_name", "athlete_name") if athlete_name_from_athlete else F.col("athlete_name")
    return df.select(*cols, name.alias("athlete_name"),
                     F.coalesce("a_country_code", "nationality").alias("athlete_country"),
                     F.col("c_start_date").alias("race_date"),
                     race_type_or_default("ra_race_type").alias("race_type"),
                     "event_name", "discipline_code",
                     F.coalesce("d_name", "event_name").alias("discipline_name"),
                     category_or_default("d_category").alias("category"),
                     *(extra or []))


def _v2_rows(t: Tables, r: DataFrame, extra_context: list[str] | None = None) -> DataFrame:
    """J5 J6 J8 for already narrowed results: one join to the race context
    (races, events, competitions inner; disciplines left), then athletes
    (left, nullable key)."""
    j = with_race_context(t, r, V2_CONTEXT + (extra_context or []))
    return with_athletes(t, j, {"a_full_name": "full_name", "a_country_code": "country_code"})


def _v1_rows(t: Tables, r: DataFrame) -> DataFrame:
    """v1 rows for results already carrying :data:`V1_CONTEXT`: linked
    athletes only (inner join), the athlete's name and country."""
    j = with_athletes(t, r, {"a_full_name": "full_name", "a_country_code": "country_code"}, "inner")
    cols = [F.col(c) for c in RESULT_COLS if c != "athlete_name"]
    return j.select(*cols, F.col("a_full_name").alias("athlete_name"),
                    F.col("a_country_code").alias("athlete_country"),
                    "race_date", "race_type", "event_title", "discipline_code",
                    F.col("d_name").alias("discipline_name"), F.col("d_category").alias("category"))


# --- per competition ----------------------------------------------------------

def competition_results_basic(t: Tables, competition_id: int, page_no: int = 1,
                              per_page: int = RESULTS_PAGE_SIZE, after: tuple | None = None) -> DataFrame:
    """v1: every result (no mark test) of linked athletes only (inner join);
    race's own date; newest race first, then place."""
    r = results_of_competition(t, competition_id, cols=V1_CONTEXT)
    return page(_v1_rows(t, r), NEWEST_RACE, PageSpec(page_no, per_page), after, t.kept_orders)


def competition_results_basic_count(t: Tables, competition_id: int) -> DataFrame:
    """The true total of :func:`competition_results_basic`."""
    return _total(_v1_rows(t, results_of_competition(t, competition_id, cols=V1_CONTEXT)))


def competition_result_rows(t: Tables, competition_id: int) -> DataFrame:
    """All v2 result rows of a competition (valid marks, orphans included),
    unpaged and distributed."""
    r = results_of_competition(t, competition_id, valid_results(t), cols=V2_CONTEXT)
    j = with_athletes(t, r, {"a_full_name": "full_name", "a_country_code": "country_code"})
    return _v2_columns(j)


def competition_results(t: Tables, competition_id: int, page_no: int = 1,
                        per_page: int = RESULTS_PAGE_SIZE, after: tuple | None = None) -> DataFrame:
    """v2: a page of the competition's valid results, newest first, then place."""
    return page(competition_result_rows(t, competition_id), NEWEST_RACE, PageSpec(page_no, per_page), after,
                t.kept_orders)


def competition_results_count(t: Tables, competition_id: int) -> DataFrame:
    return _total(results_of_competition(t, competition_id, valid_results(t)))


PARTICIPANT_COLS = ["id", "full_name", "family_name", "given_name", "country_code",
                    "gender", "birth_date", "country_name", "result_count", "best_place",
                    "events_participated"]


MOST_ACTIVE: list[Key] = [("result_count", True)] + [(c, False) for c in PARTICIPANT_COLS if c != "result_count"]


def competition_participants(t: Tables, competition_id: int) -> DataFrame:
    """Participants: one row per distinct (result name, athlete, nationality,
    country) combination with results, best place and distinct events.
    Orphans get id 0; missing name parts become ''."""
    r = results_of_competition(t, competition_id, valid_results(t), cols=["event_name"])
    j = with_athletes(t, r)
    j = j.withColumn("_country", F.coalesce("a_country_code", "nationality"))
    j = join_dim(t, j, "countries", "_country", {"country_name": "name"}, "left", dim_key="code")
    g = (j.groupBy("athlete_name", "a_id", "a_full_name", "a_family_name", "a_given_name",
                   "a_country_code", "nationality", "a_gender", "a_birth_date", "country_name")
          .agg(F.count("id").alias("result_count"), F.min("place").alias("best_place"),
               F.count_distinct("event_name").alias("events_participated")))
    return g.select(F.coalesce("a_id", F.lit(0).cast("long")).alias("id"),
                    F.coalesce("a_full_name", "athlete_name").alias("full_name"),
                    F.coalesce("a_family_name", F.lit("")).alias("family_name"),
                    F.coalesce("a_given_name", F.lit("")).alias("given_name"),
                    F.coalesce("a_country_code", "nationality").alias("country_code"),
                    F.col("a_gender").alias("gender"), F.col("a_birth_date").alias("birth_date"),
                    "country_name", "result_count", "best_place", "events_participated")


def competition_athletes(t: Tables, competition_id: int, page_no: int = 1,
                         per_page: int = RESULTS_PAGE_SIZE, after: tuple | None = None) -> DataFrame:
    """A page of participants, most results first (page size capped at 200).
    Every output column takes part in the order, so pages are stable."""
    return page(competition_participants(t, competition_id), MOST_ACTIVE,
                PageSpec(page_no, per_page, LIST_PAGE_CAP), after, t.kept_orders)


def competition_participants_count(t: Tables, competition_id: int) -> DataFrame:
    """The true total of :func:`competition_athletes`: its rows."""
    return _total(competition_participants(t, competition_id))


def competition_athletes_count(t: Tables, competition_id: int) -> DataFrame:
    """The reference's participant total: distinct result names."""
    r = results_of_competition(t, competition_id, valid_results(t))
    return r.agg(F.count_distinct("athlete_name").alias("total"))


# --- per athlete --------------------------------------------------------------

def athlete_results_basic(t: Tables, athlete_id: int, page_no: int = 1,
                          per_page: int = V1_ATHLETE_PAGE_SIZE, after: tuple | None = None) -> DataFrame:
    """v1: results linked to the athlete id (no mark test), newest race first."""
    return page(athlete_result_rows_basic(t, athlete_id), NEWEST_LINKED, PageSpec(page_no, per_page), after, t.kept_orders)


def athlete_results_basic_count(t: Tables, athlete_id: int) -> DataFrame:
    """The true total of :func:`athlete_results_basic`."""
    return _total(athlete_result_rows_basic(t, athlete_id))


def athlete_result_rows_basic(t: Tables, athlete_id: int) -> DataFrame:
    """All v1 result rows linked to an athlete id, unpaged and distributed."""
    r = t.results_for_athletes.filter(F.col("athlete_id") == F.lit(athlete_id))
    j = with_race_context(t, r, V1_CONTEXT + ["competition_name", "venue"])
    return j.select(*RESULT_COLS, "race_date", "race_type", "event_title", "discipline_code",
                    F.col("d_name").alias("discipline_name"), F.col("d_category").alias("category"),
                    "competition_name", "venue")


def athlete_field(t: Tables, athlete_id: int, name: str) -> Column:
    """One field of one athlete as a scalar subquery; NULL for an unknown one."""
    return t.athletes.filter(F.col("id") == F.lit(athlete_id)).select(name).limit(1).scalar()


def _athlete_identity(t: Tables, athlete_id: int) -> Column:
    """Linked to the id, or an orphan carrying exactly the athlete's name.

    The name and whether there is such an athlete are looked up by subqueries
    of the plan itself, so building it starts no job. The id and the name's
    value are pushed to the fact scan when it starts. For an unknown athlete
    the look-ups are NULL and no row qualifies.
    """
    linked = F.col("athlete_id") == F.lit(athlete_id)
    orphan = F.col("athlete_id").isNull() & (F.col("athlete_name") == athlete_field(t, athlete_id, "full_name"))
    # A condition of its own: as a part of the first one it would keep that from the scan.
    known = F.col("athlete_id").isNull() | athlete_field(t, athlete_id, "id").isNotNull()
    return (linked | orphan) & known


def athlete_results(t: Tables, athlete_id: int, page_no: int = 1,
                    per_page: int = RESULTS_PAGE_SIZE, order: str = "id", after: tuple | None = None) -> DataFrame:
    """v2: valid results of an athlete by id, plus orphans with the athlete's
    exact name; one row per result id (newest competition, best place).
    ``order='id'`` is the reference's order; ``'recent'`` is newest first.
    An unknown athlete gives no rows."""
    rows = athlete_result_rows(t, athlete_id)
    sort: list[Key] = [("id", False)] if order == "id" else [("start_date", True), ("place", False), ("id", False)]
    return page(rows, sort, PageSpec(page_no, per_page), after, t.kept_orders)


def athlete_result_rows(t: Tables, athlete_id: int) -> DataFrame:
    """All v2 result rows of an athlete (by id, plus orphans with the exact
    name), one per result id, unpaged and distributed."""
    r = valid_results(t, t.results_for_athletes).filter(_athlete_identity(t, athlete_id))
    rows = _v2_columns(_v2_rows(t, r, ["competition_name"]),
                       extra=["competition_name", F.col("c_start_date").alias("start_date")])
    return first_per_key(rows, "id", [(F.col("start_date"), True), (F.col("place"), False)])


def athlete_results_count(t: Tables, athlete_id: int) -> DataFrame:
    r = valid_results(t, t.results_for_athletes).filter(_athlete_identity(t, athlete_id))
    return r.agg(F.count_distinct("id").alias("total"))


def _name_pattern(name: str) -> str:
    n = (name or "").strip()
    if len(n) < 2:
        raise ValueError("Athlete name must be at least 2 characters")
    return S.like_pattern(n)


def matching_names(t: Tables, pattern: str) -> DataFrame:
    """(athlete_name, n): the names of valid results that match an ILIKE
    pattern, from the tables kept beside the fact.

    The pattern's literal runs give three letters in a row that a name must
    hold; of these the rarest are looked up, their names intersected and the
    pattern itself decides. Without such a run all distinct names are tried.
    """
    names = t.athlete_names
    grams = sorted({r[i:i + GRAM] for r in S.literal_runs(pattern, GRAM) for i in range(len(r) - GRAM + 1)})
    if grams:
        sizes = {r["gram"]: r["n"] for r in t.gram_counts.filter(F.col("gram").isin(grams))
                 .groupBy("gram").agg(F.sum("n").alias("n")).collect()}  # a row for each of the term's grams
        rarest = sorted(grams, key=lambda g: (sizes.get(g, 0), g))[:GRAMS_LOOKED_UP]
        held = (t.name_grams.filter(F.col("gram").isin(rarest)).groupBy("athlete_name")
                .agg(F.count_distinct("gram").alias("_grams")).filter(F.col("_grams") == len(rarest)))
        names = names.join(held.select("athlete_name"), "athlete_name", "left_semi")
    return (names.filter(F.col("athlete_name").ilike(pattern))
            .groupBy("athlete_name").agg(F.sum("n").cast("long").alias("n")))


def _results_named(t: Tables, name: str) -> DataFrame:
    """Valid results whose own name matches.

    With the name index only the matching names' rows are fetched from the copy
    sorted by name: a short list of names is pushed to the scan, a longer one
    is a semi join. Without it the fact is scanned.
    """
    pattern = _name_pattern(name)
    if t.results_by_name is None or t.athlete_names is None:
        return t.results.filter(F.col("athlete_name").ilike(pattern) & valid_mark())
    names = matching_names(t, pattern).select("athlete_name")
    few = [r["athlete_name"] for r in names.limit(NAMES_PUSHED + 1).collect()]
    if len(few) <= NAMES_PUSHED:
        return t.results_by_name.filter(F.col("athlete_name").isin(few) if few else F.lit(False))
    return t.results_by_name.join(names, "athlete_name", "left_semi").select(*RESULT_COLS)


def athlete_results_by_name(t: Tables, name: str, page_no: int = 1,
                            per_page: int = RESULTS_PAGE_SIZE, after: tuple | None = None) -> DataFrame:
    """Valid results whose own ``athlete_name`` matches the ILIKE term
    (stripped, at least two characters), newest competition first."""
    return page(athlete_result_rows_by_name(t, name), NEWEST_RACE, PageSpec(page_no, per_page), after, t.kept_orders)


def athlete_result_rows_by_name(t: Tables, name: str) -> DataFrame:
    """All valid result rows whose own name matches, unpaged and distributed."""
    return _v2_columns(_v2_rows(t, _results_named(t, name), ["competition_name"]),
                       extra=["competition_name"], athlete_name_from_athlete=False)


def athlete_results_by_name_count(t: Tables, name: str) -> DataFrame:
    """How many valid results carry a matching name; with the name index the
    sum of the names' own counts, and no result is read."""
    if t.athlete_names is None:
        return _total(_results_named(t, name))
    return matching_names(t, _name_pattern(name)).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total"))


# --- rows the results page filters in the browser -------------------------------

def results_basic_rows(t: Tables, competition_id: int | None = None) -> DataFrame:
    """v1 competition result rows (all competitions when ``competition_id`` is
    None)."""
    if competition_id is None:
        r = with_race_context(t, t.results, V1_CONTEXT)
    else:
        r = results_of_competition(t, competition_id, cols=V1_CONTEXT)
    return _v1_rows(t, r)


def results_text_search(t: Tables, term: str, competition_id: int | None = None) -> DataFrame:
    """Literal, case-insensitive contains over athlete, event title and
    discipline of v1 result rows (no wildcards; NULL never matches)."""
    rows = results_basic_rows(t, competition_id)
    return rows.filter(S.contains_literal(["athlete_name", "event_title", "discipline_name"], term))


# --- the athlete results page in the browser ------------------------------------

def athlete_card(t: Tables, athlete_id: int) -> DataFrame:
    """The athlete card above the results: name, country label (name, else
    code, else Unknown), gender label and birth date of one athlete."""
    from ..functions.exprs import country_label, gender_label_card
    from .listings import athletes_labelled

    a = athletes_labelled(t).filter(F.col("id") == F.lit(athlete_id))
    return a.select("id", "full_name", country_label("country_name", "country_code").alias("country_label"),
                    gender_label_card("gender").alias("gender_label"), "birth_date")


RESULT_SORT_KEYS = ("place", "event", "discipline", "competition", "start_date", "race_date")


def _result_sort(by: str):
    """User-chosen column sorts of a result page: (expression, is_text)."""
    return {
        "place": (F.col("place"), False),
        "event": (F.col("event_name"), True),
        "discipline": (F.coalesce(F.nullif(F.col("discipline_name"), F.lit("")), F.col("event_name")), True),
        "competition": (F.col("competition_name"), True),
        "start_date": (F.col("start_date"), False),
        "race_date": (F.col("race_date"), False),
    }[by]


def sort_result_page(rows: DataFrame, by: str, descending: bool = False,
                     collation: str | None = None) -> DataFrame:
    """Re-sort a page of result rows by a user-chosen column; text columns
    can sort in a locale order (``collation='UNICODE'``). ``id`` breaks ties."""
    expr, is_text = _result_sort(by)
    if is_text and collation:
        expr = F.collate(expr, collation)
    key = expr.desc_nulls_last() if descending else expr.asc_nulls_last()
    return rows.orderBy(key, asc("id"))


def athlete_results_sorted(t: Tables, athlete_id: int, by: str = "discipline",
                           descending: bool = False, collation: str | None = "UNICODE",
                           page_no: int = 1, per_page: int = RESULTS_PAGE_SIZE) -> DataFrame:
    """The athlete results page (as :func:`athlete_results`) re-sorted by a
    column the user picked."""
    return sort_result_page(athlete_results(t, athlete_id, page_no, per_page), by, descending, collation)
