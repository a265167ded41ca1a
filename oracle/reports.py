"""Oracle SQL (DuckDB) for every registered report, built from the rules of

``valid``     results that count (a mark that is not empty)
``owned``     every valid result with the person it belongs to: the linked
              athlete, or name and nationality where none is linked
``meeting``   each race with its event, discipline and competition
``listed``    competitions with country and ranking category names
``people``    athletes with their country's name

NULL placement and a unique tie-break are spelled out wherever a LIMIT or a
position follows.
"""

from __future__ import annotations

from .views import VIEWS

# ---- fixed query parameters (FIXTURES.md §5) --------------------------------
AS_OF = "2001-08-01"
COUNTRY = "SGP"
COUNTRIES = ("SGP", "MAS", "THA", "PHI", "INA", "VNM")
COMPETITION_ID = 7
ATHLETE_ID = 8
NAME_TERM = "%given7 %"
COMPETITION_TERM = "1"
VENUE_TERM = " venue 1 "
CODE_TERM = "SGP"
COUNTRY_TERM = "malay"
LITERAL_TERM = "GIVEN7 "
PICKER_TERM = "Supplier#00000001"
# -----------------------------------------------------------------------------

SHARED = {
    "valid": "select * from results where coalesce(mark, '') <> ''",
    "owned": """
select v.*, person.country_code as person_country,
  if(v.athlete_id is null, v.athlete_name, person.full_name) as owner_name,
  if(v.athlete_id is null, v.nationality, person.country_code) as owner_country
from valid v left join athletes person on person.id = v.athlete_id""",
    "meeting": """
select race.id as race_key, race.competition_id, race.race_date as day_of_race, race.race_type as kind,
  event.event_name, event.event_title, event.discipline_code,
  branch.discipline_name as branch_name, branch.category as branch_category,
  coalesce(branch.discipline_name, event.event_name) as shown_discipline,
  coalesce(branch.category, 'Track & Field') as shown_category,
  meet.id is not null as has_meet, meet.name as meet_name, meet.venue as meet_venue, meet.start_date as meet_start
from races race
join meet_events event on event.id = race.event_id
left join disciplines branch using (discipline_code)
left join competitions meet on meet.id = race.competition_id""",
    "listed": """
select meet.* exclude (disciplines), array_to_string(meet.disciplines, ',') as disciplines,
  land.name as country_name, class.name as ranking_category_name
from competitions meet
left join countries land on land.code = meet.country_code
left join ranking_categories class on class.id = meet.ranking_category_id""",
    "people": """
select person.* exclude (disciplines), array_to_string(person.disciplines, ',') as disciplines,
  person.disciplines as discipline_array, land.name as country_name
from athletes person left join countries land on land.code = person.country_code""",
    "scored_meets": """
select competition_id, count(*) as result_count
from valid join races on races.id = valid.race_id group by competition_id""",
}

MINE = f"'{COUNTRY}'"
MEMBERS = ", ".join(f"'{c}'" for c in COUNTRIES)

# Columns of a result as stored, and as the second API version shows it.
STORED = "r.id, r.race_id, r.athlete_id, r.nationality, r.place, r.mark, r.wind, r.points, r.qualified"
SHOWN = """m.meet_start as race_date, coalesce(m.kind, 'Final') as race_type, m.event_name, m.discipline_code,
  m.shown_discipline as discipline_name, m.shown_category as category"""
FIRST_API = """person.full_name as athlete_name, person.country_code as athlete_country, m.day_of_race as race_date,
  m.kind as race_type, m.event_title, m.discipline_code, m.branch_name as discipline_name,
  m.branch_category as category"""
LINKED = """from results r join athletes person on person.id = r.athlete_id join meeting m on m.race_key = r.race_id"""
SHOWN_NAME = """coalesce(person.full_name, r.athlete_name) as athlete_name,
  coalesce(person.country_code, r.nationality) as athlete_country"""
COUNTED = """from valid r join meeting m on m.race_key = r.race_id and m.has_meet
left join athletes person on person.id = r.athlete_id"""
BY_MEET_DAY = "race_date desc nulls first, place asc nulls last, id"


def _like(term: str, *columns: str) -> str:
    return "(" + " or ".join(f"coalesce({c}, '') ilike '%{term}%'" for c in columns) + ")"


def _page(rows: str, order: str, size: int, skip: int = 0) -> str:
    return f"select * from ({rows}) order by {order} limit {size} offset {skip}"


def _how_many(rows: str, name: str = "total") -> str:
    return f"select count(*) as {name} from ({rows})"


Q: dict[str, str] = {}

# --- competitions ---------------------------------------------------------------

_FOUND = f"select * from listed where {_like(COMPETITION_TERM, 'name', 'venue', 'country_name')}"
_FOUND_SCORED = f"select f.*, s.result_count from ({_FOUND}) f join scored_meets s on s.competition_id = f.id"

Q["competitions_list_basic"] = _page(_FOUND, "start_date desc nulls first, id", 50)
Q["competitions_list"] = _page(_FOUND_SCORED, "result_count desc, start_date desc nulls first, id", 50)
Q["competitions_with_results_count"] = _how_many(_FOUND_SCORED)
# A term of one character is no search; the count is 0 if no meet found has a result.
Q["competitions_count"] = """
select if(exists (select 1 from competitions c join scored_meets s on s.competition_id = c.id),
          (select count(*) from competitions), 0)::bigint as total"""
_AT_VENUE = f"select id from listed where {_like(VENUE_TERM.strip(), 'name', 'venue', 'country_name')}"
Q["competitions_search_count"] = f"""
select if(exists (select 1 from ({_AT_VENUE}) f join scored_meets s on s.competition_id = f.id),
          (select count(*) from ({_AT_VENUE})), 0)::bigint as total"""
Q["competition_picker"] = f"""
select id, name from competitions where contains(lower(name), lower('{PICKER_TERM}'))
order by name nulls last, id"""
Q["competitions_page_info"] = f"""
select 1::bigint as page, 50::bigint as per_page, total, ceil(total / 50.0)::bigint as pages,
  1::bigint as first_row, least(50, total)::bigint as last_row
from ({Q["competitions_with_results_count"]})"""
Q["competition_display"] = """
select id, name, season, start_date::varchar as start_text,
  if(end_date is distinct from start_date, end_date::varchar, null) as end_text,
  end_date is distinct from start_date as multi_day,
  if(has_results, 'Yes', 'No') as has_results_text
from competitions"""

# --- athletes -------------------------------------------------------------------

_SHORT_CODE = _like(CODE_TERM, "full_name", "family_name", "given_name", "country_code", "country_name")
_PERSON_COLUMNS = "* exclude (discipline_array)"

Q["athletes_list_basic"] = _page(
    f"select {_PERSON_COLUMNS} from people where "
    + _like(COUNTRY_TERM, "full_name", "family_name", "given_name", "country_name"),
    "full_name nulls last, id", 5, 5)
Q["athletes_list"] = _page(f"select {_PERSON_COLUMNS} from people where {_SHORT_CODE}",
                           "birth_date desc nulls first, id", 50)
Q["athletes_count"] = _how_many(f"select id from people where {_SHORT_CODE}")
Q["athletes_autocomplete"] = _page(
    "select id, full_name, country_name, country_code from people where "
    + _like(NAME_TERM, "full_name", "family_name", "given_name"), "full_name nulls last, id", 10)
Q["athletes_total"] = "select count(*) as total_athletes from athletes"
Q["country_athletes"] = _page(
    f"select {_PERSON_COLUMNS} from people where " + _like("sg", "country_code") + " or "
    + _like("sin", "country_code") + " or " + _like("singapore", "country_name", "full_name"), "id", 20)

_GENDER_CARD = """case when coalesce(gender, '') = '' then 'Unknown'
  when gender = 'M' or lower(gender) = 'male' then 'Male' else 'Female' end"""
_LAND = "coalesce(nullif(country_name, ''), nullif(country_code, ''), 'Unknown')"
Q["athlete_card"] = f"""
select id, full_name, {_LAND} as country_label, {_GENDER_CARD} as gender_label, birth_date
from people where id = {ATHLETE_ID}"""
Q["athlete_profile"] = f"""
select id, full_name, gender, if(gender = 'M', 'Male', 'Female') as gender_label, {_GENDER_CARD} as gender_card,
  birth_date, (year(date '{AS_OF}') - year(birth_date)
    - (strftime(date '{AS_OF}', '%m%d') < strftime(birth_date, '%m%d'))::integer)::integer as age, {_LAND} as country_label,
  array_to_string(discipline_array[:2], ',') as disciplines_shown,
  nullif(greatest(len(discipline_array) - 2, 0), 0)::integer as disciplines_more,
  array_to_string(discipline_array, ', ') as disciplines_all
from people"""

# --- results of a competition -----------------------------------------------------

_HERE = f"m.competition_id = {COMPETITION_ID}"
Q["competition_results_basic"] = _page(f"select {STORED}, {FIRST_API} {LINKED} where {_HERE}", BY_MEET_DAY, 100)
Q["competition_results"] = _page(f"select {STORED}, {SHOWN_NAME}, {SHOWN} {COUNTED} where {_HERE}", BY_MEET_DAY, 100)
_HERE_COUNTED = f"select v.* from valid v join races on races.id = v.race_id where competition_id = {COMPETITION_ID}"
Q["competition_results_count"] = _how_many(_HERE_COUNTED)
Q["competition_athletes_count"] = f"select count(distinct athlete_name) as total from ({_HERE_COUNTED})"

_PARTICIPANTS = f"""
select coalesce(part.athlete, 0) as id, coalesce(person.full_name, part.athlete_name) as full_name,
  coalesce(person.family_name, '') as family_name, coalesce(person.given_name, '') as given_name,
  coalesce(person.country_code, part.nationality) as country_code, person.gender, person.birth_date,
  land.name as country_name, part.result_count, part.best_place, part.events_participated
from (
  select person.id as athlete, r.athlete_name, r.nationality, count(*) as result_count, min(r.place) as best_place,
    count(distinct m.event_name) as events_participated
  from valid r join meeting m on m.race_key = r.race_id
  left join athletes person on person.id = r.athlete_id
  where {_HERE} group by all) part
left join athletes person on person.id = part.athlete
left join countries land on land.code = coalesce(person.country_code, part.nationality)"""
Q["competition_athletes"] = _page(_PARTICIPANTS, ", ".join(
    ["result_count desc"] + [f"{c} nulls last" for c in (
        "id", "full_name", "family_name", "given_name", "country_code", "gender", "birth_date", "country_name",
        "best_place", "events_participated")]), 100)
Q["competition_participants_count"] = _how_many(_PARTICIPANTS)

# --- results of an athlete ----------------------------------------------------------

_THEIRS = f"""(r.athlete_id = {ATHLETE_ID} or r.athlete_id is null and
  r.athlete_name = (select full_name from athletes where id = {ATHLETE_ID}))"""
Q["athlete_results_basic"] = _page(f"""
select {STORED}, r.athlete_name, m.day_of_race as race_date, m.kind as race_type, m.event_title, m.discipline_code,
  m.branch_name as discipline_name, m.branch_category as category, m.meet_name as competition_name,
  m.meet_venue as venue
from results r join meeting m on m.race_key = r.race_id and m.has_meet where r.athlete_id = {ATHLETE_ID}""",
                                   "race_date desc nulls first, id", 50)
_ATHLETE_ROWS = f"""
select {STORED}, {SHOWN_NAME}, {SHOWN}, m.meet_name as competition_name, m.meet_start as start_date
{COUNTED} where {_THEIRS}
qualify row_number() over (partition by r.id order by m.meet_start desc nulls first, r.place nulls last) = 1"""
Q["athlete_results"] = _page(_ATHLETE_ROWS, "id", 100)
Q["athlete_results_count"] = f"select count(distinct id) as total from valid r where {_THEIRS}"
# The page as re-sorted by discipline, with each row's place in that order. The
# agreed locale order ignores case first; these labels hold ASCII letters, digits
# and spaces only, for which lower case gives the same order.
Q["athlete_results_sorted"] = f"""
select *, row_number() over (order by lower(coalesce(nullif(discipline_name, ''), event_name)) nulls last, id)::integer
  as position
from ({Q["athlete_results"]})"""
Q["athlete_results_by_name"] = _page(f"""
select {STORED}, r.athlete_name, coalesce(person.country_code, r.nationality) as athlete_country, {SHOWN},
  m.meet_name as competition_name
{COUNTED} where r.athlete_name ilike '%{NAME_TERM}%'""", BY_MEET_DAY, 100)
Q["athlete_results_by_name_count"] = _how_many(f"select id from valid where athlete_name ilike '%{NAME_TERM}%'")

# --- rows as the results page shows them ----------------------------------------------

_SOUGHT = " or ".join(f"contains(lower(coalesce({c}, '')), lower('{LITERAL_TERM}'))"
                      for c in ("person.full_name", "m.event_title", "m.branch_name"))
Q["results_text_search"] = f"select {STORED}, {FIRST_API} {LINKED} where {_SOUGHT}"
# Numbers as JavaScript prints them: no trailing ".0"; halves round up.
Q["result_display"] = """
select r.id, r.place,
  coalesce(['gold', 'silver', 'bronze'][if(r.place between 1 and 3, r.place, null)], 'default') as medal,
  case when r.place <= 3 then 'gold' when r.place <= 8 then 'blue' else 'default' end as tier,
  if(coalesce(r.wind, 0) = 0, '-', rtrim(rtrim(printf('%.10f', r.wind), '0'), '.') || ' m/s') as wind_text,
  if(coalesce(r.points, 0) = 0, '-', floor(r.points + 0.5)::bigint::varchar) as points_text,
  if(r.qualified, 'Yes', 'No') as qualified_text,
  coalesce(nullif(m.branch_name, ''), m.event_name) as discipline_label,
  coalesce(nullif(m.branch_category, ''), 'Track & Field') as category_label
from results r join meeting m on m.race_key = r.race_id"""

# --- overview -----------------------------------------------------------------------

Q["disciplines"] = "select * from disciplines order by discipline_name nulls last, discipline_code"
Q["countries"] = "select * from countries order by name nulls last, code"
Q["table_counts"] = """
select max(n) filter (which = 'c') as competitions, max(n) filter (which = 'a') as athletes,
  max(n) filter (which = 'r') as results, max(n) filter (which = 'e') as events
from (select 'c' as which, count(*) as n from competitions union all select 'a', count(*) from athletes
      union all select 'r', count(*) from results union all select 'e', count(*) from meet_events)"""
Q["dimension_sizes"] = """
select * from (select count(*) as countries from countries), (select count(*) as disciplines from disciplines)"""
Q["country_finder"] = f"""
select distinct code, name from countries where {_like("singapore", "name")} or {_like("sg", "code")}
  or {_like("sin", "code")} order by name nulls last, code"""
Q["top_countries"] = _page("select country_code, count(*) as athlete_count from athletes group by country_code",
                           "athlete_count desc, country_code nulls last", 10)
Q["discipline_categories"] = """
select category, count(*) as discipline_count from disciplines group by category order by category nulls last"""

# --- one country ----------------------------------------------------------------------

# A result is the country's by the OR rule if its person or its nationality is.
_EITHER = f"(coalesce(person_country = {MINE}, false) or coalesce(nationality = {MINE}, false))"
Q["country_summary"] = f"""
select (select count(*) from athletes where country_code = {MINE}) as total_athletes,
  count(distinct owner_name) filter (owner_country = {MINE}) as athletes_with_results,
  (select count(*) from competitions where country_code = {MINE}) as total_competitions,
  count(*) filter ({_EITHER}) as total_results
from owned"""
Q["gender_distribution"] = f"""
select case lower(gender) when 'm' then 'Male' when 'f' then 'Female'
    else case gender when 'male' then 'Male' when 'female' then 'Female' else coalesce(gender, 'Unknown') end
  end as gender_category, count(*) as count
from athletes where country_code = {MINE} group by gender_category order by count desc, gender_category nulls last"""
Q["top_athletes"] = _page(f"""
select owner_name as full_name, owner_country as country_code, count(*) as result_count,
  count(distinct races.competition_id) as competition_count
from owned join races on races.id = owned.race_id where owner_country = {MINE}
group by owner_name, owner_country""", "result_count desc, full_name nulls last, country_code", 10)
Q["discipline_breakdown"] = _page(f"""
select shown_discipline as discipline_name, shown_category as category,
  count(distinct athlete_name) as athlete_count, count(*) as result_count
from owned join meeting on race_key = race_id where {_EITHER}
group by shown_discipline, shown_category""", "result_count desc, discipline_name nulls last, category", 10)
Q["timeline"] = f"""
select year(start_date)::bigint as year, count(*) as competition_count,
  coalesce(sum(races_held), 0)::bigint as race_count, coalesce(sum(result_count), 0)::bigint as result_count
from competitions meet
left join (select competition_id, count(*) as races_held from races group by competition_id) h
  on h.competition_id = meet.id
left join scored_meets s on s.competition_id = meet.id
where country_code = {MINE} and start_date >= date '{AS_OF}' - interval 5 year
group by year(start_date) order by year desc"""
Q["regional_comparison"] = f"""
select totals.*, land.name as country_name
from (select owner_country as country_code, count(distinct owner_name) as athlete_count, count(*) as result_count
      from owned where owner_country in ({MEMBERS}) group by owner_country) totals
left join countries land on land.code = totals.country_code
order by result_count desc, country_code"""

_SECTIONS = {"summary": "country_summary", **{k: k for k in (
    "gender_distribution", "discipline_breakdown", "timeline", "top_athletes", "regional_comparison")}}
Q["country_dashboard"] = "\nunion all by name ".join(
    f"select '{section}' as section, * from ({Q[key]})" for section, key in _SECTIONS.items())

# --- what the checks of rows alone can't see: order, sinks, parameterised SQL --------------

Q["list_positions"] = "\nunion all ".join(
    f"""select '{name}' as list, {key}::varchar as key, row_number() over (order by {order})::integer as position
from ({Q[name]})""" for name, key, order in (
        ("disciplines", "discipline_code", "discipline_name nulls last, discipline_code"),
        ("countries", "code", "name nulls last, code"),
        ("timeline", "year", "year desc"),
        ("regional_comparison", "country_code", "result_count desc, country_code")))
Q["parameterised_sql"] = f"""
select competition_id, count(*) as results from ({_HERE_COUNTED.replace("v.*", "competition_id")}) group by all"""
Q["appended_competitions"] = "select id, name, start_date from competitions"
# An append in batches changes where rows lie, not what the reports give.
Q["lake_results"] = "select * from results"
for _key in ("athlete_results", "competitions_list", "timeline", "country_summary", "regional_comparison"):
    Q[f"lake_{_key}"] = Q[_key]
for _key in ("results_by_name", "results_by_name_count"):
    Q[f"lake_{_key}"] = Q[f"athlete_{_key}"]
Q["countries_json"] = """select '{"code":"' || code || '","name":"' || name || '"}' as json from countries"""


def oracle_sql() -> dict[str, str]:
    shared = ",\n".join(f"{n} as ({body}\n)" for n, body in {**VIEWS, **SHARED}.items())
    return {k: f"with {shared}\n{v.strip()}" for k, v in Q.items()}
