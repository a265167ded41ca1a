"""Searchable, sortable, paged listings of competitions and athletes, their
true totals, and the athlete quick search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import search as S
from ..operators.facts import join_dim, valid_results
from ..operators.joins import one_row
from ..operators.paging import (AUTOCOMPLETE_CAP, AUTOCOMPLETE_DEFAULT,
                                LIST_PAGE_CAP, LIST_PAGE_SIZE, Key, PageSpec, asc,
                                athlete_sort_keys, page, page_info)
from ..sources.tables import Tables


def _total(df: DataFrame, name: str = "total") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


# --- competitions -------------------------------------------------------------

def competitions_labelled(t: Tables) -> DataFrame:
    """Competitions with country and ranking category names (left joins)."""
    c = join_dim(t, t.competitions, "countries", "country_code", {"country_name": "name"}, "left",
                 dim_key="code")
    return join_dim(t, c, "ranking_categories", "ranking_category_id",
                    {"ranking_category_name": "name"}, "left")


def _searched_competitions(t: Tables, term: str | None, min_len: int = 1,
                           strip: bool = False) -> DataFrame:
    c = competitions_labelled(t)
    pred = S.competition_search(term, min_len=min_len, strip=strip)
    return c if pred is None else c.filter(pred)


NEWEST: list[Key] = [("start_date", True), ("id", False)]
MOST_RESULTS: list[Key] = [("result_count", True), *NEWEST]
BY_NAME: list[Key] = [("full_name", False), ("id", False)]


def competitions_list_basic(t: Tables, search: str | None = None, page_no: int = 1,
                            per_page: int = LIST_PAGE_SIZE, after: tuple | None = None) -> DataFrame:
    """v1: all matching competitions, newest first (no page cap)."""
    return page(_searched_competitions(t, search), NEWEST, PageSpec(page_no, per_page), after, t.kept_orders)


def competitions_basic_count(t: Tables, search: str | None = None) -> DataFrame:
    """The true total of :func:`competitions_list_basic`."""
    return _total(_searched_competitions(t, search))


def _valid_of(t: Tables, competitions: DataFrame) -> DataFrame:
    """``(competition_id, n)`` parts of the valid results of the given
    competitions (a frame with ``id``): their races are picked first, so that
    the fact only meets races that matter.

    Where valid results per race are kept beside the fact, those are summed and
    no result is read. Else, within the races bound, each result probes the broadcast races; beyond it
    the fact is counted per ``race_id`` first (map-side partial counts), so
    the shuffle carries one row per race.
    """
    ids = t.dim("competitions", competitions.select(F.col("id").alias("_c")))
    races = (t.races.select(F.col("id").alias("_race"), "competition_id")
             .join(ids, F.col("competition_id") == F.col("_c")).drop("_c"))
    valid = valid_results(t).select("race_id")
    if t.race_counts is not None:
        valid = t.race_counts
    elif t.broadcastable("races"):
        valid = valid.withColumn("n", F.lit(1).cast("long"))
    else:
        valid = valid.groupBy("race_id").agg(F.count(F.lit(1)).alias("n"))
    return valid.join(t.dim("races", races), F.col("race_id") == F.col("_race")).select("competition_id", "n")


def _competitions_with_results(t: Tables, term: str | None) -> DataFrame:
    """Matching competitions with their ``result_count``; HAVING COUNT > 0
    makes the outer joins to races and results inner."""
    c = _searched_competitions(t, term)
    counts = (_valid_of(t, c).groupBy("competition_id").agg(F.sum("n").cast("long").alias("result_count")))
    # counted for existing competitions only, so the competitions bound covers it
    return c.join(t.dim("competitions", counts), F.col("id") == F.col("competition_id")).drop("competition_id")


def competitions_list(t: Tables, search: str | None = None, page_no: int = 1,
                      per_page: int = LIST_PAGE_SIZE, after: tuple | None = None) -> DataFrame:
    """v2: competitions having valid results, with ``result_count``, most
    results first; page size capped at 200."""
    return page(_competitions_with_results(t, search), MOST_RESULTS, PageSpec(page_no, per_page, LIST_PAGE_CAP), after,
                t.kept_orders)


def competitions_with_results_count(t: Tables, search: str | None = None) -> DataFrame:
    """The true total of :func:`competitions_list` (same search rule)."""
    return _total(_competitions_with_results(t, search))


def competitions_count(t: Tables, search: str | None = None) -> DataFrame:
    """The total as the reference computes it: all matching competitions
    (term stripped, two characters or more), or 0 when none of them has a
    valid result."""
    c = _searched_competitions(t, search, min_len=2, strip=True)
    scored = _valid_of(t, c).limit(1).agg(F.count(F.lit(1)).alias("scored"))
    row = one_row(c.agg(F.count_distinct("id").alias("n")), scored)
    return row.select(F.when(F.col("scored") > 0, F.col("n")).otherwise(F.lit(0)).cast("long").alias("total"))


# --- athletes -----------------------------------------------------------------

def athletes_labelled(t: Tables) -> DataFrame:
    return join_dim(t, t.athletes, "countries", "country_code", {"country_name": "name"}, "left",
                    dim_key="code")


def _searched_athletes_basic(t: Tables, search: str | None) -> DataFrame:
    a = athletes_labelled(t)
    pred = S.athlete_search_basic(search)
    return a if pred is None else a.filter(pred)


def athletes_list_basic(t: Tables, search: str | None = None, page_no: int = 1,
                        per_page: int = LIST_PAGE_SIZE, after: tuple | None = None) -> DataFrame:
    """v1: names or country name contain the raw term; by full name."""
    return page(_searched_athletes_basic(t, search), BY_NAME, PageSpec(page_no, per_page), after, t.kept_orders)


def athletes_basic_count(t: Tables, search: str | None = None) -> DataFrame:
    """The true total of :func:`athletes_list_basic`."""
    return _total(_searched_athletes_basic(t, search))


def _searched_athletes(t: Tables, search: str | None) -> DataFrame:
    a = athletes_labelled(t)
    pred = S.athlete_search(search)
    return a if pred is None else a.filter(pred)


def athletes_list(t: Tables, search: str | None = None, sort_by: str = "full_name",
                  sort_order: str = "ASC", page_no: int = 1,
                  per_page: int = LIST_PAGE_SIZE, after: tuple | None = None) -> DataFrame:
    """v2: gated two-mode search, allow-listed sort, page size capped at 200."""
    return page(_searched_athletes(t, search), athlete_sort_keys(sort_by, sort_order),
                PageSpec(page_no, per_page, LIST_PAGE_CAP), after, t.kept_orders)


def athletes_count(t: Tables, search: str | None = None) -> DataFrame:
    return _total(_searched_athletes(t, search))


def athletes_autocomplete(t: Tables, q: str | None, limit: int = AUTOCOMPLETE_DEFAULT) -> DataFrame:
    """Quick search: nothing for terms under two characters; at most 50."""
    a = _searched_athletes(t, q).select("id", "full_name", "country_name", "country_code")
    if S.gate(q, min_len=2, strip=True) is None:
        return a.limit(0)
    return page(a, athlete_sort_keys(), PageSpec(1, min(int(limit), AUTOCOMPLETE_CAP)))


def competition_picker(t: Tables, term: str) -> DataFrame:
    """Competition picker: literal, case-insensitive contains on the name
    (no wildcards), over the listed competitions (id, name)."""
    c = t.competitions.select("id", "name")
    return c.filter(S.contains_literal(["name"], term)).orderBy(asc("name"), asc("id"))


def competitions_page_info(t: Tables, search: str | None = None, page_no: int = 1,
                           per_page: int = LIST_PAGE_SIZE) -> DataFrame:
    """Pagination block of the v2 competition list: page, per_page (capped),
    true total, page count and the shown row range."""
    return page_info(competitions_with_results_count(t, search), PageSpec(page_no, per_page, LIST_PAGE_CAP))
