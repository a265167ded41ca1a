"""Column expressions shared by the reports: domain rules, display fallbacks
and the labels the user interface derives per row. All are built-in Spark
expressions (whole-stage codegen, no Python per row)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -----------------------------------------------------------
DEFAULT_RACE_TYPE = "Final"
DEFAULT_CATEGORY = "Track & Field"
UNKNOWN = "Unknown"
MALE, FEMALE = "Male", "Female"
MEDALS = {1: "gold", 2: "silver", 3: "bronze"}
TIER_GOLD_MAX, TIER_BLUE_MAX = 3, 8
TAG_DEFAULT = "default"
YES, NO = "Yes", "No"
WIND_UNIT = " m/s"
NO_VALUE = "-"
RECENT_YEARS = 5
# -----------------------------------------------------------------------------


def c(name: str | Column) -> Column:
    return F.col(name) if isinstance(name, str) else name


def valid_mark(mark: str | Column = "mark") -> Column:
    """A result counts when its mark is neither NULL nor the empty string."""
    m = c(mark)
    return m.isNotNull() & (m != "")


def blank_to_null(x: str | Column) -> Column:
    """'' counts as missing (JavaScript truthiness of strings)."""
    return F.nullif(c(x), F.lit(""))


# Display fallbacks (server side: COALESCE only, '' stays '').
def race_type_or_default(x: str | Column = "race_type") -> Column:
    return F.coalesce(c(x), F.lit(DEFAULT_RACE_TYPE))


def category_or_default(x: str | Column = "category") -> Column:
    return F.coalesce(c(x), F.lit(DEFAULT_CATEGORY))


# --- three gender normalisers, kept apart on purpose -------------------------

def gender_category(g: str | Column = "gender") -> Column:
    """Server rule: lower 'm' or exactly 'male' -> Male; lower 'f' or exactly
    'female' -> Female; anything else stays as written, NULL -> Unknown."""
    g = c(g)
    return (F.when((F.lower(g) == "m") | (g == "male"), F.lit(MALE))
             .when((F.lower(g) == "f") | (g == "female"), F.lit(FEMALE))
             .otherwise(F.coalesce(g, F.lit(UNKNOWN))))


def gender_label_list(g: str | Column = "gender") -> Column:
    """Athlete list: exactly 'M' -> Male, everything else (NULL too) Female."""
    return F.when(c(g) == "M", F.lit(MALE)).otherwise(F.lit(FEMALE))


def gender_label_card(g: str | Column = "gender") -> Column:
    """Athlete card: missing or '' -> Unknown; 'M' or lower 'male' -> Male;
    else Female."""
    g = c(g)
    return (F.when(g.isNull() | (g == ""), F.lit(UNKNOWN))
             .when((g == "M") | (F.lower(g) == "male"), F.lit(MALE))
             .otherwise(F.lit(FEMALE)))


def as_of_date(as_of: _dt.date | str | Column | None) -> Column:
    if as_of is None:
        return F.current_date()
    if isinstance(as_of, Column):
        return as_of
    return F.lit(str(as_of)).cast("date")


def age_years(birth: str | Column = "birth_date",
              as_of: _dt.date | str | Column | None = None) -> Column:
    """Whole years, birthday-aware: one less until month/day is reached.
    (Not months_between/12, which is wrong for 29 February.) NULL -> NULL."""
    b, t = c(birth), as_of_date(as_of)
    not_yet = (F.month(t) < F.month(b)) | \
        ((F.month(t) == F.month(b)) & (F.dayofmonth(t) < F.dayofmonth(b)))
    return (F.year(t) - F.year(b) - F.when(not_yet, 1).otherwise(0)).cast("int")


def recent_floor(as_of: _dt.date | str | Column | None = None,
                 years: int = RECENT_YEARS) -> Column:
    """``as_of - INTERVAL 'n years'``; 29 February clamps to 28 February."""
    return F.add_months(as_of_date(as_of), -12 * years)


def country_label(name: str | Column = "country_name",
                  code: str | Column = "country_code") -> Column:
    """Country name, else code, else Unknown ('' counts as missing)."""
    return F.coalesce(blank_to_null(name), blank_to_null(code), F.lit(UNKNOWN))


def medal_tag(place: str | Column = "place") -> Column:
    p = c(place)
    out = None
    for k, v in MEDALS.items():
        out = F.when(p == k, F.lit(v)) if out is None else out.when(p == k, F.lit(v))
    return out.otherwise(F.lit(TAG_DEFAULT))


def finish_tier(place: str | Column = "place") -> Column:
    """<=3 gold, <=8 blue, else default; a missing place is default."""
    p = c(place)
    return (F.when(p <= TIER_GOLD_MAX, F.lit("gold"))
             .when(p <= TIER_BLUE_MAX, F.lit("blue"))
             .otherwise(F.lit(TAG_DEFAULT)))


def wind_text(w: str | Column = "wind") -> Column:
    """'<wind> m/s' as the original's client prints a number; 0, NULL and NaN
    show '-'. No trailing '.0'; an exponent from 1e21 up and below 1e-6 only:
    2 m/s, 0.00005 m/s, 1e+21 m/s, 1e-20 m/s, -Infinity m/s."""
    w = c(w)
    text, size = w.cast("string"), F.abs(w)
    mantissa = F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", "")
    power = F.substring_index(text, "E", -1)
    short = F.concat(mantissa, F.when(power.startswith("-"), F.lit("e")).otherwise(F.lit("e+")), power)
    shown = (F.when(size == float("inf"), text)
             .when((size >= 1e21) | (size < 1e-6), short)
             .when(size >= 1e15, F.regexp_replace(F.format_number(w, 0), ",", ""))
             .otherwise(F.regexp_replace(text.try_cast("decimal(38,18)").cast("string"), r"\.?0+$", "")))
    return F.when(w.isNull() | F.isnan(w) | (w == 0), F.lit(NO_VALUE)).otherwise(F.concat(shown, F.lit(WIND_UNIT)))


def points_text(p: str | Column = "points") -> Column:
    """Points rounded to whole numbers; 0 and NULL show '-'."""
    p = c(p)
    return (F.when(p.isNull() | (p == 0), F.lit(NO_VALUE))
             .otherwise(F.format_string("%.0f", p)))


def yes_no(flag: str | Column) -> Column:
    return F.when(c(flag), F.lit(YES)).otherwise(F.lit(NO))


def iso_date(d: str | Column) -> Column:
    return F.date_format(c(d), "yyyy-MM-dd")


def discipline_label(name: str | Column = "discipline_name",
                     event: str | Column = "event_name") -> Column:
    return F.coalesce(blank_to_null(name), c(event))


def category_label(cat: str | Column = "category") -> Column:
    return F.coalesce(blank_to_null(cat), F.lit(DEFAULT_CATEGORY))


def first_items(arr: str | Column, n: int = 2) -> Column:
    """The first ``n`` items of an array (NULL array -> NULL)."""
    return F.slice(c(arr), 1, n)


def overflow_count(arr: str | Column, n: int = 2) -> Column:
    """How many items are hidden after the first ``n``; NULL when none."""
    a = c(arr)
    return F.when(F.size(a) > n, F.size(a) - n).cast("int")


def multi_day(start: str | Column = "start_date", end: str | Column = "end_date") -> Column:
    """End date differs from start date (NULL-safe)."""
    return ~c(end).eqNullSafe(c(start))


def array_text(arr: str | Column, sep: str = ",") -> Column:
    return F.array_join(c(arr), sep)
