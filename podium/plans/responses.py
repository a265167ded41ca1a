"""Responses as the original application returned them, without the web
layer: one page of rows plus its pagination block (or total), both lazy
DataFrames, and their JSON envelope on demand.

Totals follow the decisions in the README: every page goes with the true total
of its own rows (competitions that have results, participant rows).
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.paging import (AUTOCOMPLETE_CAP, LIST_PAGE_CAP, LIST_PAGE_SIZE,
                                RESULTS_PAGE_SIZE, PageSpec, asc, athlete_sort_keys,
                                desc, order_of, page_info)
from ..sources.sinks import envelope, json_rows
from ..sources.tables import Tables
from . import dashboard as D
from . import drilldowns as R
from . import listings as L
from . import overview as O


# Pages up to this size are folded into one JSON envelope (one row, one task);
# larger ones come as distributed JSON lines.
ENVELOPE_ROWS = 10_000


@dataclass
class Response:
    """``rows`` under ``key`` (at most ``size`` rows), the one-row ``info``
    block, fixed ``extra`` fields, and the order that keeps ``rows`` in page
    order."""
    key: str
    rows: DataFrame
    order: list
    size: int
    info: DataFrame | None = None
    extra: dict[str, object] = field(default_factory=dict)

    def to_json(self) -> DataFrame:
        """The response as JSON (column ``json``). A page of at most
        :data:`ENVELOPE_ROWS` rows is one envelope. A larger one is JSON lines
        that add up to it: one line with the page block and the extra fields,
        then one line ``{key: [row]}`` for each row, still distributed."""
        if self.size <= ENVELOPE_ROWS:
            return envelope(self.rows, self.key, order_of(self.order), self.info, self.extra)
        fields = [F.lit(v).alias(k) for k, v in self.extra.items()]
        spark = self.rows.sparkSession
        head = spark.range(1).select(*fields) if self.info is None else self.info.select("*", *fields)
        lines = self.rows.select(F.array(F.struct(*self.rows.columns)).alias(self.key))
        return json_rows(head).union(json_rows(lines))

    def write_json(self, path: str) -> None:
        """:meth:`to_json` written as text files, one JSON document a line."""
        self.to_json().write.mode("overwrite").text(path)


def competitions(t: Tables, page_no: int = 1, per_page: int = LIST_PAGE_SIZE,
                 search: str | None = None) -> Response:
    spec = PageSpec(page_no, per_page, LIST_PAGE_CAP)
    return Response("competitions", L.competitions_list(t, search, page_no, per_page),
                    L.MOST_RESULTS, spec.size,
                    page_info(L.competitions_with_results_count(t, search), spec))


def athletes(t: Tables, page_no: int = 1, per_page: int = LIST_PAGE_SIZE, search: str | None = None,
             sort_by: str = "full_name", sort_order: str = "ASC") -> Response:
    spec = PageSpec(page_no, per_page, LIST_PAGE_CAP)
    return Response("athletes", L.athletes_list(t, search, sort_by, sort_order, page_no, per_page),
                    athlete_sort_keys(sort_by, sort_order), spec.size, page_info(L.athletes_count(t, search), spec))


def competition_results(t: Tables, competition_id: int, page_no: int = 1,
                        per_page: int = RESULTS_PAGE_SIZE) -> Response:
    spec = PageSpec(page_no, per_page)
    return Response("results", R.competition_results(t, competition_id, page_no, per_page),
                    R.NEWEST_RACE, spec.size,
                    page_info(R.competition_results_count(t, competition_id), spec),
                    {"competition_id": competition_id})


def competition_athletes(t: Tables, competition_id: int, page_no: int = 1,
                         per_page: int = RESULTS_PAGE_SIZE) -> Response:
    spec = PageSpec(page_no, per_page, LIST_PAGE_CAP)
    return Response("athletes", R.competition_athletes(t, competition_id, page_no, per_page), R.MOST_ACTIVE,
                    spec.size, page_info(R.competition_participants_count(t, competition_id), spec),
                    {"competition_id": competition_id})


def athlete_results(t: Tables, athlete_id: int, page_no: int = 1,
                    per_page: int = RESULTS_PAGE_SIZE) -> Response:
    """An unknown athlete gives an empty page and total 0 (the original
    answered 404)."""
    spec = PageSpec(page_no, per_page)
    return Response("results", R.athlete_results(t, athlete_id, page_no, per_page), [("id", False)],
                    spec.size, page_info(R.athlete_results_count(t, athlete_id), spec),
                    {"athlete_id": athlete_id, "athlete_name": R.athlete_field(t, athlete_id, "full_name"),
                     "found": R.athlete_field(t, athlete_id, "id").isNotNull()})


def athlete_results_by_name(t: Tables, name: str, page_no: int = 1,
                            per_page: int = RESULTS_PAGE_SIZE) -> Response:
    spec = PageSpec(page_no, per_page)
    return Response("results", R.athlete_results_by_name(t, name, page_no, per_page),
                    R.NEWEST_RACE, spec.size,
                    page_info(R.athlete_results_by_name_count(t, name), spec),
                    {"athlete_name": name.strip()})


def athlete_search(t: Tables, q: str | None, limit: int = 10) -> Response:
    return Response("athletes", L.athletes_autocomplete(t, q, limit), athlete_sort_keys(),
                    min(int(limit), AUTOCOMPLETE_CAP))


# --- first API version ------------------------------------------------------------

def competitions_basic(t: Tables, page_no: int = 1, per_page: int = LIST_PAGE_SIZE,
                       search: str | None = None) -> Response:
    spec = PageSpec(page_no, per_page)
    return Response("competitions", L.competitions_list_basic(t, search, page_no, per_page), L.NEWEST, spec.size,
                    page_info(L.competitions_basic_count(t, search), spec))


def athletes_basic(t: Tables, page_no: int = 1, per_page: int = LIST_PAGE_SIZE,
                   search: str | None = None) -> Response:
    spec = PageSpec(page_no, per_page)
    return Response("athletes", L.athletes_list_basic(t, search, page_no, per_page), L.BY_NAME, spec.size,
                    page_info(L.athletes_basic_count(t, search), spec))


def competition_results_basic(t: Tables, competition_id: int, page_no: int = 1,
                              per_page: int = RESULTS_PAGE_SIZE) -> Response:
    spec = PageSpec(page_no, per_page)
    return Response("results", R.competition_results_basic(t, competition_id, page_no, per_page), R.NEWEST_RACE,
                    spec.size, page_info(R.competition_results_basic_count(t, competition_id), spec),
                    {"competition_id": competition_id})


def athlete_results_basic(t: Tables, athlete_id: int, page_no: int = 1,
                          per_page: int = R.V1_ATHLETE_PAGE_SIZE) -> Response:
    spec = PageSpec(page_no, per_page)
    return Response("results", R.athlete_results_basic(t, athlete_id, page_no, per_page), R.NEWEST_LINKED,
                    spec.size, page_info(R.athlete_results_basic_count(t, athlete_id), spec),
                    {"athlete_id": athlete_id})


# --- whole dimensions ---------------------------------------------------------------

def _dimension(t: Tables, name: str, rows: DataFrame, keys: list) -> Response:
    total = t.table(name).agg(F.count(F.lit(1)).alias("total"))
    return Response(name, rows, keys, t.rows(name), total)


def disciplines(t: Tables) -> Response:
    return _dimension(t, "disciplines", O.disciplines_list(t), [("discipline_name", False), ("discipline_code", False)])


def countries(t: Tables) -> Response:
    return _dimension(t, "countries", O.countries_list(t), [("name", False), ("code", False)])


def stats(t: Tables) -> DataFrame:
    """The overview counts, one row."""
    return O.table_counts(t)


def country_stats(t: Tables, country: str = D.DEFAULT_COUNTRY,
                  countries: tuple[str, ...] = D.DEFAULT_COUNTRIES,
                  as_of: _dt.date | str | None = None) -> dict[str, DataFrame]:
    """All dashboard sections over one read of the fact."""
    return D.country_dashboard(t, country, countries, as_of)


def _section_orders() -> dict[str, list[Column]]:
    return {
        "gender_distribution": [desc("count"), asc("gender_category")],
        "discipline_breakdown": [desc("result_count"), asc("discipline_name"), asc("category")],
        "timeline": [desc("year")],
        "top_athletes": [desc("result_count"), asc("full_name"), asc("country_code")],
        "regional_comparison": [desc("result_count"), asc("country_code")],
    }


def country_stats_json(t: Tables, country: str = D.DEFAULT_COUNTRY,
                       countries: tuple[str, ...] = D.DEFAULT_COUNTRIES,
                       as_of: _dt.date | str | None = None) -> DataFrame:
    """The dashboard as one JSON document: the summary figures and one array
    per section, in each section's order. Each section has at most ten rows,
    one per year, one per listed country, or (gender) one per spelling that
    the data hold."""
    parts = country_stats(t, country, countries, as_of)
    orders = _section_orders()
    tagged = parts["summary"].select(F.lit("summary").alias("section"), F.lit(0).alias("_pos"),
                                     F.struct(*parts["summary"].columns).alias("summary"))
    for name, order in orders.items():
        df = parts[name]
        pos = F.row_number().over(Window.orderBy(*order))
        tagged = tagged.unionByName(df.select(F.lit(name).alias("section"), pos.alias("_pos"),
                                              F.struct(*df.columns).alias(name)),
                                    allowMissingColumns=True)
    aggs = [F.first("summary", ignorenulls=True).alias("summary")]
    for name in orders:
        items = F.collect_list(F.when(F.col("section") == name, F.struct(F.col("_pos"), F.col(name).alias("v"))))
        aggs.append(F.transform(F.array_sort(items), lambda x: x["v"]).alias(name))
    doc = tagged.agg(*aggs)
    return doc.select(F.to_json(F.struct("*"), {"dateFormat": "yyyy-MM-dd"}).alias("json"))
