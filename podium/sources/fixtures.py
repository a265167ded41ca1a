"""Competition tables derived from the driver's TPC-H-like test tables.

Test and bench input only (the specification is ``FIXTURES.md`` §3). Every
table is a lazy projection of one raw table, except ``results`` (one join of
``lineitem`` with ``orders``) and ``races`` (each supplier expanded to its 20
races with a generator, not a cross join). Row counts grow with the inputs.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lake import write_tables
from .tables import DEFAULT_BROADCAST_MAX_ROWS, Tables, from_frames

# ---- fixed values (FIXTURES.md §3) -----------------------------------------
# Country codes by key % 12; other keys get 'N' + two digits.
COUNTRY_CODES = ["SGP", "MAS", "THA", "PHI", "INA", "VNM"]
# Country names of nation keys 0..5; other nations keep n_name.
COUNTRY_NAMES = ["Singapore", "Malaysia", "Thailand", "Philippines", "Indonesia", "Vietnam"]
# Discipline category by brand number % 4 (3 -> NULL).
CATEGORIES = ["Jumps", "Sprints", "Throws"]
# Athlete gender by market segment (other segments -> NULL).
GENDER_BY_SEGMENT = {"MACHINERY": "M", "BUILDING": "male", "AUTOMOBILE": "f",
                     "HOUSEHOLD": "Female"}
# Race type by race number % 4 (0 -> NULL).
RACE_TYPES = [None, "Final", "Heat", "Semifinal"]
# Discipline lists: athletes by key % 4 (0 -> NULL), competitions by key % 3.
ATHLETE_DISCIPLINES = [None, "Sprints", "Sprints,Jumps", "Sprints,Jumps,Throws"]
COMPETITION_DISCIPLINES = ["Sprints", "Sprints,Jumps", "Sprints,Jumps,Throws"]
RACES_PER_COMPETITION = 20
ATHLETE_EPOCH = "1970-01-01"
SEASON_EPOCH = "1995-01-01"
# -----------------------------------------------------------------------------

RAW_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def _case(key: Column, values: list, default: Column | None = None) -> Column:
    """``CASE key WHEN 0 THEN values[0] ... ELSE default END``."""
    out = None
    for i, v in enumerate(values):
        lit = F.lit(v).cast("string")
        out = F.when(key == i, lit) if out is None else out.when(key == i, lit)
    return out.otherwise(default if default is not None else F.lit(None).cast("string"))


def country_code(x: Column) -> Column:
    m = x % 12
    return _case(m, COUNTRY_CODES, F.concat(F.lit("N"), F.lpad(m.cast("string"), 2, "0")))


def person_name(x: Column) -> Column:
    return F.concat(F.lit("Given"), (x % 89).cast("string"),
                    F.lit(" FAMILY"), (x % 53).cast("string"))


def _days(epoch: str, n: Column) -> Column:
    return F.date_add(F.lit(epoch).cast("date"), n.cast("int"))


def _list(key: Column, values: list) -> Column:
    return F.split(_case(key, values), ",")


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def derive(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    r = {n: raw(spark, sf_dir, n) for n in RAW_TABLES}

    nation = r["nation"]
    countries = nation.filter(F.col("n_nationkey") < 11).select(
        country_code(F.col("n_nationkey")).alias("code"),
        _case(F.col("n_nationkey"), COUNTRY_NAMES, F.col("n_name")).alias("name"))

    ranking_categories = r["region"].select(F.col("r_regionkey").alias("id"),
                                            F.col("r_name").alias("name"))

    brand_no = F.substring(F.col("p_brand"), 7, 1_000_000).cast("int")
    disciplines = (r["part"].filter(brand_no % 5 != 0)
                   .select(F.col("p_brand").alias("discipline_code"),
                           F.concat(F.lit("Discipline "),
                                    F.substring(F.col("p_brand"), 7, 1_000_000)).alias("discipline_name"),
                           _case(brand_no % 4, CATEGORIES).alias("category"))
                   .distinct())

    title = F.concat(F.col("p_name"), F.lit(" "), F.col("p_type"))
    events = r["part"].select((F.col("p_partkey") + 1).alias("id"),
                              title.alias("event_name"), title.alias("event_title"),
                              F.col("p_brand").alias("discipline_code"))

    c = F.col("c_custkey")
    gender = None
    for seg, g in GENDER_BY_SEGMENT.items():
        cond = F.col("c_mktsegment") == seg
        gender = F.when(cond, F.lit(g)) if gender is None else gender.when(cond, F.lit(g))
    athletes = r["customer"].select(
        (c + 1).alias("id"),
        F.concat(F.lit("FAMILY"), (c % 53).cast("string")).alias("family_name"),
        F.concat(F.lit("Given"), (c % 89).cast("string")).alias("given_name"),
        person_name(c).alias("full_name"),
        F.when(c % 11 == 0, F.lit(None).cast("date"))
         .otherwise(_days(ATHLETE_EPOCH, (c * 37) % 12000)).alias("birth_date"),
        gender.otherwise(F.lit(None).cast("string")).alias("gender"),
        country_code(c).alias("country_code"),
        _list(c % 4, ATHLETE_DISCIPLINES).alias("disciplines"))

    s = F.col("s_suppkey")
    start = _days(SEASON_EPOCH, (s * 53) % 2400)
    competitions = r["supplier"].select(
        (s + 1).alias("id"), F.col("s_name").alias("name"),
        F.concat(F.lit("Venue "), (s % 13).cast("string")).alias("venue"),
        F.concat(F.lit("Area "), (F.col("s_nationkey") % 5).cast("string")).alias("area"),
        country_code(s).alias("country_code"),
        (s % 6).cast("int").alias("ranking_category_id"),
        start.alias("start_date"),
        _days(SEASON_EPOCH, (s * 53) % 2400 + s % 3).alias("end_date"),
        F.year(start).alias("season"),
        (s % 17 != 0).alias("has_results"),
        _list(s % 3, COMPETITION_DISCIPLINES).alias("disciplines"))

    k = F.col("k")
    races = (r["supplier"]
             .select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(RACES_PER_COMPETITION - 1))).alias("k"))
             .select((s * RACES_PER_COMPETITION + k + 1).alias("id"),
                     (s + 1).alias("competition_id"),
                     (s * RACES_PER_COMPETITION + k + 1).alias("event_id"),
                     _days(SEASON_EPOCH, (s * 53) % 2400 + k % 3).alias("race_date"),
                     _case(k % 4, RACE_TYPES).alias("race_type")))

    li = r["lineitem"]
    ln, ok = F.col("l_linenumber"), F.col("o_custkey")
    results = (li.join(r["orders"].select("o_orderkey", "o_custkey"),
                       F.col("l_orderkey") == F.col("o_orderkey"))
               .select(
                   (((F.col("l_orderkey") * 10 + ln) * 100000 + F.col("l_partkey")) * 10000
                    + F.col("l_suppkey")).alias("id"),
                   (F.col("l_suppkey") * RACES_PER_COMPETITION + F.col("l_partkey") % 20 + 1).alias("race_id"),
                   F.when(ln == 7, F.lit(None).cast("long")).otherwise(ok + 1).alias("athlete_id"),
                   F.when(ln == 5, F.lit(None).cast("string")).otherwise(person_name(ok)).alias("athlete_name"),
                   country_code(ok + F.when(ln == 3, 1).otherwise(0)).alias("nationality"),
                   F.when(F.col("l_quantity") >= 50, F.lit(None).cast("int"))
                    .otherwise(F.col("l_quantity").cast("int")).alias("place"),
                   F.when((ln == 2) & (F.col("l_returnflag") == "N"), F.lit(None).cast("string"))
                    .when((ln == 6) | (F.col("l_suppkey") % 17 == 0), F.lit(""))
                    .otherwise(F.floor(F.col("l_extendedprice")).cast("long").cast("string")).alias("mark"),
                   F.when(ln == 1, F.lit(2.0)).when(ln == 3, F.lit(-1.0)).when(ln == 4, F.lit(0.00005))
                    .otherwise(F.col("l_discount")).alias("wind"),
                   F.when(F.col("l_tax") == 0, F.lit(0.0))
                    .when(ln == 2, F.col("l_quantity") + F.lit(0.5))
                    .otherwise(F.col("l_quantity") * 20).alias("points"),
                   (F.col("l_returnflag") == "A").alias("qualified")))

    return {"countries": countries, "ranking_categories": ranking_categories,
            "disciplines": disciplines, "events": events, "athletes": athletes,
            "competitions": competitions, "races": races, "results": results}


def derived_tables(spark: SparkSession, sf_dir: str,
                   broadcast_max_rows: int = DEFAULT_BROADCAST_MAX_ROWS) -> Tables:
    """The eight competition tables as lazy DataFrames over ``sf_dir``."""
    # A result is a line of an order; parquet has their number in its footers.
    return from_frames(derive(spark, sf_dir), broadcast_max_rows, raw(spark, sf_dir, "lineitem").count())


def write_lake(spark: SparkSession, sf_dir: str, out: str, results_files: int | None = None,
               athlete_layout: bool = True) -> str:
    """Write the derived tables as a lake (:func:`.lake.write_tables`)."""
    return write_tables(derived_tables(spark, sf_dir), out, results_files, athlete_layout)
