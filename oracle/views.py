"""DuckDB text of the eight competition views (FIXTURES.md §3), with explicit
casts so column types equal the Spark schemas. Used only by the oracle SQL:
each oracle query is ``WITH <views>, <shared relations> <report query>``.
"""

from __future__ import annotations


def code(x: str) -> str:
    return (f"(CASE ({x}) % 12 WHEN 0 THEN 'SGP' WHEN 1 THEN 'MAS' WHEN 2 THEN 'THA' "
            f"WHEN 3 THEN 'PHI' WHEN 4 THEN 'INA' WHEN 5 THEN 'VNM' "
            f"ELSE 'N' || lpad(cast(({x}) % 12 as varchar), 2, '0') END)")


def name(x: str) -> str:
    return f"('Given' || cast(({x}) % 89 as varchar) || ' FAMILY' || cast(({x}) % 53 as varchar))"


VIEWS = {
    "countries": f"""
select {code('n_nationkey')} as code,
  CASE n_nationkey WHEN 0 THEN 'Singapore' WHEN 1 THEN 'Malaysia' WHEN 2 THEN 'Thailand'
    WHEN 3 THEN 'Philippines' WHEN 4 THEN 'Indonesia' WHEN 5 THEN 'Vietnam' ELSE n_name END as name
from nation where n_nationkey < 11""",
    "ranking_categories": """
select cast(r_regionkey as integer) as id, r_name as name from region""",
    "disciplines": """
select distinct p_brand as discipline_code,
  'Discipline ' || substr(p_brand, 7) as discipline_name,
  CASE cast(substr(p_brand, 7) as integer) % 4 WHEN 0 THEN 'Jumps' WHEN 1 THEN 'Sprints'
    WHEN 2 THEN 'Throws' ELSE NULL END as category
from part where cast(substr(p_brand, 7) as integer) % 5 <> 0""",
    "meet_events": """
select cast(p_partkey + 1 as bigint) as id,
  p_name || ' ' || p_type as event_name,
  p_name || ' ' || p_type as event_title,
  p_brand as discipline_code
from part""",
    "athletes": f"""
select cast(c_custkey + 1 as bigint) as id,
  'FAMILY' || cast(c_custkey % 53 as varchar) as family_name,
  'Given' || cast(c_custkey % 89 as varchar) as given_name,
  {name('c_custkey')} as full_name,
  CASE WHEN c_custkey % 11 = 0 THEN NULL
       ELSE cast(date '1970-01-01' + cast((c_custkey * 37) % 12000 as integer) as date) END as birth_date,
  CASE c_mktsegment WHEN 'MACHINERY' THEN 'M' WHEN 'BUILDING' THEN 'male' WHEN 'AUTOMOBILE' THEN 'f'
    WHEN 'HOUSEHOLD' THEN 'Female' ELSE NULL END as gender,
  {code('c_custkey')} as country_code,
  string_split(CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Sprints' WHEN 2 THEN 'Sprints,Jumps'
    ELSE 'Sprints,Jumps,Throws' END, ',') as disciplines
from customer""",
    "competitions": f"""
select cast(s_suppkey + 1 as bigint) as id,
  s_name as name,
  'Venue ' || cast(s_suppkey % 13 as varchar) as venue,
  'Area ' || cast(s_nationkey % 5 as varchar) as area,
  {code('s_suppkey')} as country_code,
  cast(s_suppkey % 6 as integer) as ranking_category_id,
  cast(date '1995-01-01' + cast((s_suppkey * 53) % 2400 as integer) as date) as start_date,
  cast(date '1995-01-01' + cast((s_suppkey * 53) % 2400 + s_suppkey % 3 as integer) as date) as end_date,
  cast(year(date '1995-01-01' + cast((s_suppkey * 53) % 2400 as integer)) as integer) as season,
  s_suppkey % 17 <> 0 as has_results,
  string_split(CASE s_suppkey % 3 WHEN 0 THEN 'Sprints' WHEN 1 THEN 'Sprints,Jumps'
    ELSE 'Sprints,Jumps,Throws' END, ',') as disciplines
from supplier""",
    "races": """
select cast(s_suppkey * 20 + k + 1 as bigint) as id,
  cast(s_suppkey + 1 as bigint) as competition_id,
  cast(s_suppkey * 20 + k + 1 as bigint) as event_id,
  cast(date '1995-01-01' + cast((s_suppkey * 53) % 2400 + k % 3 as integer) as date) as race_date,
  CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Final' WHEN 2 THEN 'Heat' ELSE 'Semifinal' END as race_type
from supplier cross join (select p_partkey as k from part where p_partkey < 20) ks""",
    "results": f"""
select cast(((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey as bigint) as id,
  cast(l_suppkey * 20 + l_partkey % 20 + 1 as bigint) as race_id,
  cast(CASE WHEN l_linenumber = 7 THEN NULL ELSE o_custkey + 1 END as bigint) as athlete_id,
  CASE WHEN l_linenumber = 5 THEN NULL ELSE {name('o_custkey')} END as athlete_name,
  {code('o_custkey + CASE WHEN l_linenumber = 3 THEN 1 ELSE 0 END')} as nationality,
  CASE WHEN l_quantity >= 50 THEN NULL ELSE cast(l_quantity as integer) END as place,
  CASE WHEN l_linenumber = 2 AND l_returnflag = 'N' THEN NULL
       WHEN l_linenumber = 6 OR l_suppkey % 17 = 0 THEN ''
       ELSE cast(cast(floor(l_extendedprice) as bigint) as varchar) END as mark,
  cast(CASE l_linenumber WHEN 1 THEN 2.0 WHEN 3 THEN -1.0 WHEN 4 THEN 0.00005 ELSE l_discount END as double) as wind,
  CASE WHEN l_tax = 0 THEN cast(0 as double) WHEN l_linenumber = 2 THEN cast(l_quantity + 0.5 as double) ELSE cast(l_quantity * 20 as double) END as points,
  l_returnflag = 'A' as qualified
from lineitem join orders on l_orderkey = o_orderkey""",
}

