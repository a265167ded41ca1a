"""Explicit schemas of the eight competition tables (star schema).

``results`` is the only large table (the fact); the rest are dimensions.
"""

from __future__ import annotations

from pyspark.sql.types import (ArrayType, BooleanType, DateType, DoubleType,
                               IntegerType, LongType, StringType, StructField,
                               StructType)


def _s(*fields: tuple[str, object, bool]) -> StructType:
    return StructType([StructField(n, t, nullable) for n, t, nullable in fields])


COUNTRIES = _s(("code", StringType(), False), ("name", StringType(), True))

RANKING_CATEGORIES = _s(("id", IntegerType(), False), ("name", StringType(), True))

DISCIPLINES = _s(("discipline_code", StringType(), False),
                 ("discipline_name", StringType(), True),
                 ("category", StringType(), True))

# The reference calls this table ``events``; v1 reads ``event_title``, v2
# ``event_name``, so both are carried.
EVENTS = _s(("id", LongType(), False), ("event_name", StringType(), True),
            ("event_title", StringType(), True),
            ("discipline_code", StringType(), True))

ATHLETES = _s(("id", LongType(), False), ("family_name", StringType(), True),
              ("given_name", StringType(), True), ("full_name", StringType(), True),
              ("birth_date", DateType(), True), ("gender", StringType(), True),
              ("country_code", StringType(), True),
              ("disciplines", ArrayType(StringType()), True))

COMPETITIONS = _s(("id", LongType(), False), ("name", StringType(), True),
                  ("venue", StringType(), True), ("area", StringType(), True),
                  ("country_code", StringType(), True),
                  ("ranking_category_id", IntegerType(), True),
                  ("start_date", DateType(), True), ("end_date", DateType(), True),
                  ("season", IntegerType(), True), ("has_results", BooleanType(), True),
                  ("disciplines", ArrayType(StringType()), True))

RACES = _s(("id", LongType(), False), ("competition_id", LongType(), True),
           ("event_id", LongType(), True), ("race_date", DateType(), True),
           ("race_type", StringType(), True))

RESULTS = _s(("id", LongType(), False), ("race_id", LongType(), True),
             ("athlete_id", LongType(), True), ("athlete_name", StringType(), True),
             ("nationality", StringType(), True), ("place", IntegerType(), True),
             ("mark", StringType(), True), ("wind", DoubleType(), True),
             ("points", DoubleType(), True), ("qualified", BooleanType(), True))

SCHEMAS: dict[str, StructType] = {
    "competitions": COMPETITIONS,
    "ranking_categories": RANKING_CATEGORIES,
    "countries": COUNTRIES,
    "athletes": ATHLETES,
    "disciplines": DISCIPLINES,
    "events": EVENTS,
    "races": RACES,
    "results": RESULTS,
}

FACT = "results"
DIMENSIONS = tuple(n for n in SCHEMAS if n != FACT)
