"""Dimension listings, table counts, country look-ups, and the per-row
display fields the user interface derives (age, labels, tiers, flags)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.search import ilike_any
from ..operators.facts import with_race_context
from ..operators.joins import one_row
from ..operators.paging import asc, desc
from ..sources.tables import Tables
from .listings import athletes_labelled

# ---- fixed values: the reference's look-up patterns ---------------------------
FINDER_NAME_TERMS = ("singapore",)
FINDER_CODE_TERMS = ("sg", "sin")
COUNTRY_ATHLETES_LIMIT = 20
TOP_COUNTRIES_N = 10
# -----------------------------------------------------------------------------


def disciplines_list(t: Tables) -> DataFrame:
    return t.disciplines.orderBy(asc("discipline_name"), asc("discipline_code"))


def countries_list(t: Tables) -> DataFrame:
    return t.countries.orderBy(asc("name"), asc("code"))


def _count(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def table_counts(t: Tables) -> DataFrame:
    """One row: competitions, athletes, results and events."""
    return one_row(_count(t.competitions, "competitions"), _count(t.athletes, "athletes"),
                   _count(t.results, "results"), _count(t.events, "events"))


def dimension_sizes(t: Tables) -> DataFrame:
    return one_row(_count(t.countries, "countries"), _count(t.disciplines, "disciplines"))


def athletes_total(t: Tables) -> DataFrame:
    return t.athletes.agg(F.count(F.lit(1)).alias("total_athletes"))


def discipline_categories(t: Tables) -> DataFrame:
    """Disciplines per category; a missing category is a group of its own."""
    return (t.disciplines.groupBy("category").agg(F.count(F.lit(1)).alias("discipline_count"))
            .orderBy(asc("category")))


def country_finder(t: Tables, name_terms=FINDER_NAME_TERMS, code_terms=FINDER_CODE_TERMS) -> DataFrame:
    """Countries whose name or code matches any of the ILIKE terms."""
    pred = None
    for term in name_terms:
        p = ilike_any(["name"], term)
        pred = p if pred is None else pred | p
    for term in code_terms:
        p = ilike_any(["code"], term)
        pred = p if pred is None else pred | p
    return t.countries.filter(pred).select("code", "name").distinct().orderBy(asc("name"), asc("code"))


def country_athletes(t: Tables, name_terms=FINDER_NAME_TERMS, code_terms=FINDER_CODE_TERMS,
                     n: int = COUNTRY_ATHLETES_LIMIT) -> DataFrame:
    """First ``n`` athletes (by id) whose code, country name or full name
    matches the look-up terms."""
    pred = None
    for term in code_terms:
        p = ilike_any(["country_code"], term)
        pred = p if pred is None else pred | p
    for term in name_terms:
        p = ilike_any(["country_name", "full_name"], term)
        pred = p if pred is None else pred | p
    return athletes_labelled(t).filter(pred).orderBy(asc("id")).limit(n)


def top_countries(t: Tables, n: int = TOP_COUNTRIES_N) -> DataFrame:
    """Athletes per country code, top ``n``; a missing code is a group."""
    return (t.athletes.groupBy("country_code").agg(F.count(F.lit(1)).alias("athlete_count"))
            .orderBy(desc("athlete_count"), asc("country_code")).limit(n))


def athlete_profile(t: Tables, as_of: _dt.date | str | None = None) -> DataFrame:
    """Per athlete: both gender labels, age on ``as_of``, country label and
    the discipline tags (first two, overflow count, all)."""
    a = athletes_labelled(t)
    return a.select(
        "id", "full_name", "gender",
        X.gender_label_list("gender").alias("gender_label"),
        X.gender_label_card("gender").alias("gender_card"),
        "birth_date", X.age_years("birth_date", as_of).alias("age"),
        X.country_label("country_name", "country_code").alias("country_label"),
        X.array_text(X.first_items("disciplines", 2)).alias("disciplines_shown"),
        X.overflow_count("disciplines", 2).alias("disciplines_more"),
        X.array_text("disciplines", ", ").alias("disciplines_all"))


def result_display(t: Tables) -> DataFrame:
    """Per result: medal and finish tier from the place, wind and points
    text, qualified flag, discipline and category labels."""
    r = with_race_context(t, t.results, ["event_name", "d_name", "d_category"])
    return r.select("id", "place",
                    X.medal_tag("place").alias("medal"),
                    X.finish_tier("place").alias("tier"),
                    X.wind_text("wind").alias("wind_text"),
                    X.points_text("points").alias("points_text"),
                    X.yes_no("qualified").alias("qualified_text"),
                    X.discipline_label("d_name", "event_name").alias("discipline_label"),
                    X.category_label("d_category").alias("category_label"))


def competition_display(t: Tables) -> DataFrame:
    """Per competition: ISO dates, end date only when multi-day, flags."""
    c = t.competitions
    md = X.multi_day("start_date", "end_date")
    return c.select("id", "name", "season",
                    X.iso_date("start_date").alias("start_text"),
                    F.when(md, X.iso_date("end_date")).alias("end_text"),
                    md.alias("multi_day"),
                    X.yes_no("has_results").alias("has_results_text"))
