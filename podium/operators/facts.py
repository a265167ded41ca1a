"""Fact-table building blocks: valid results, dimension joins with prefixed
columns, race-selective reads, attribution of results to athletes, and the
first row per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampType

from ..functions.exprs import valid_mark
from ..sources.companions import OWNER_KEYS
from ..sources.schemas import RESULTS
from ..sources.tables import Tables
from .joins import left_join_nullable, lookup

RESULT_COLS = [f.name for f in RESULTS.fields]


def valid_results(t: Tables, results: DataFrame | None = None) -> DataFrame:
    """Results with a mark that is neither NULL nor ''."""
    return (t.results if results is None else results).filter(valid_mark())


def join_dim(t: Tables, df: DataFrame, dim_name: str, key: str,
             cols: dict[str, str], how: str = "inner",
             dim: DataFrame | None = None, dim_key: str = "id",
             spread_by: str = "id") -> DataFrame:
    """Join ``df.key`` to ``dim_name.dim_key`` and add ``cols``
    (``{new_name: dimension_column}``). ``dim`` may be a filtered subset of
    the dimension; only the listed columns travel into the join. In a
    shuffled left join, NULL keys are salted with ``spread_by``."""
    src = t.table(dim_name) if dim is None else dim
    k = f"_k_{dim_name}"
    d = src.select(F.col(dim_key).alias(k), *[F.col(s).alias(a) for a, s in cols.items()])
    if how == "left" and df.schema[key].nullable and spread_by in df.columns:
        return left_join_nullable(t, df, key, dim_name, d, k, spread_by, dim is not None).drop(k)
    return lookup(t, df, dim_name, d, F.col(key) == F.col(k), how).drop(k)


# Columns a race context can carry: {new_name: (table, column)}.
RACE_CONTEXT_COLS = {
    "competition_id": ("races", "competition_id"),
    "event_id": ("races", "event_id"),
    "race_date": ("races", "race_date"),
    "race_type": ("races", "race_type"),
    "ra_race_type": ("races", "race_type"),
    "event_name": ("events", "event_name"),
    "event_title": ("events", "event_title"),
    "discipline_code": ("events", "discipline_code"),
    "d_name": ("disciplines", "discipline_name"),
    "d_category": ("disciplines", "category"),
    "c_start_date": ("competitions", "start_date"),
    "competition_name": ("competitions", "name"),
    "venue": ("competitions", "venue"),
}


def race_context(t: Tables, cols: list[str], races: DataFrame | None = None) -> DataFrame:
    """One row per race (``_k_races`` = race id) with the requested columns
    of races, events (inner), disciplines (left) and competitions (inner).

    The dimensions are joined to each other first, so the fact meets them in
    a single join: one broadcast probe when races are within the bound, else
    one shuffle of the fact instead of one per dimension. Rows never exceed
    the races dimension's, so the races bound covers the context.
    """
    want = {c: RACE_CONTEXT_COLS[c] for c in cols}
    tables = {tb for tb, _ in want.values()}
    src = t.races if races is None else races
    base = {"_k_races": "id", "_ra_event": "event_id", "_ra_comp": "competition_id"}
    base.update({c: col for c, (tb, col) in want.items() if tb == "races"})
    ctx = src.select(*[F.col(v).alias(k) for k, v in base.items()])
    if tables & {"events", "disciplines"}:
        ev = {c: col for c, (tb, col) in want.items() if tb == "events"}
        ev.setdefault("_ev_disc", "discipline_code")
        ctx = join_dim(t, ctx, "events", "_ra_event", ev)
        if "disciplines" in tables:
            ctx = join_dim(t, ctx, "disciplines", "_ev_disc",
                           {c: col for c, (tb, col) in want.items() if tb == "disciplines"}, "left",
                           dim_key="discipline_code")
    if "competitions" in tables:
        ctx = join_dim(t, ctx, "competitions", "_ra_comp",
                       {c: col for c, (tb, col) in want.items() if tb == "competitions"})
    return ctx.select("_k_races", *cols)


def with_race_context(t: Tables, df: DataFrame, cols: list[str],
                      races: DataFrame | None = None) -> DataFrame:
    """Add race-context columns to ``df`` through ``df.race_id`` (inner, as
    the reference's chain of inner joins through races and events).

    Within the races bound every dimension is broadcast on its own: the
    broadcasts build in parallel and each carries only its columns. Beyond
    it, the dimensions are pre-joined into :func:`race_context` so the fact
    is shuffled once instead of once per dimension.
    """
    if not t.broadcastable("races"):
        ctx = race_context(t, cols, races)
        return lookup(t, df, "races", ctx, F.col("race_id") == F.col("_k_races"), "inner").drop("_k_races")
    want = {c: RACE_CONTEXT_COLS[c] for c in cols}
    tables = {tb for tb, _ in want.values()}
    ra = {c: col for c, (tb, col) in want.items() if tb == "races"}
    if tables & {"events", "disciplines"}:
        ra["_ra_event"] = "event_id"
    if "competitions" in tables:
        ra["_ra_comp"] = "competition_id"
    j = join_dim(t, df, "races", "race_id", ra, dim=races)
    if tables & {"events", "disciplines"}:
        ev = {c: col for c, (tb, col) in want.items() if tb == "events"}
        ev["_ev_disc"] = "discipline_code"
        j = join_dim(t, j, "events", "_ra_event", ev)
        if "disciplines" in tables:
            j = join_dim(t, j, "disciplines", "_ev_disc",
                         {c: col for c, (tb, col) in want.items() if tb == "disciplines"}, "left",
                         dim_key="discipline_code")
    if "competitions" in tables:
        j = join_dim(t, j, "competitions", "_ra_comp",
                     {c: col for c, (tb, col) in want.items() if tb == "competitions"})
    return j.drop("_ra_event", "_ra_comp", "_ev_disc")


ATHLETE_COLS = {"a_id": "id", "a_full_name": "full_name", "a_family_name": "family_name",
                "a_given_name": "given_name", "a_country_code": "country_code",
                "a_gender": "gender", "a_birth_date": "birth_date"}


def with_athletes(t: Tables, df: DataFrame, cols: dict[str, str] | None = None,
                  how: str = "left", athletes: DataFrame | None = None) -> DataFrame:
    return join_dim(t, df, "athletes", "athlete_id", cols or ATHLETE_COLS, how, dim=athletes)


def race_bounds_filter(t: Tables, races: DataFrame) -> Column:
    """A pushable ``race_id BETWEEN lo AND hi`` covering the given races.

    The bounds are two scalar subqueries over a dimension subset: no job runs
    while the plan is built, and their values reach the scan when it starts.
    The join that follows stays exact; the range only lets the parquet reader
    skip row groups of a fact laid out by ``race_id``. Without races the bounds
    are NULL and no row qualifies.
    """
    # First and last by order, not MIN and MAX: Spark merges two aggregates of
    # one table into one subquery, whose fields no longer reach the scan.
    ids = races.select("id").filter(F.col("id").isNotNull())
    lo, hi = (ids.orderBy(end).limit(1).scalar() for end in (F.asc("id"), F.desc("id")))
    return F.col("race_id").between(lo, hi)


def results_of_competition(t: Tables, competition_id: int, results: DataFrame | None = None,
                           cols: list[str] | None = None) -> DataFrame:
    """Results of one competition: its races (a dimension subset) joined to
    the fact, with the fact pre-filtered to the races' id range. ``cols``
    are race-context columns to add (:data:`RACE_CONTEXT_COLS`)."""
    races = t.races.filter(F.col("competition_id") == F.lit(competition_id))
    r = t.results if results is None else results
    r = r.filter(race_bounds_filter(t, races))
    return with_race_context(t, r, cols or ["competition_id"], races)


def attributed_results(t: Tables, countries: list[str],
                       results: DataFrame | None = None) -> DataFrame:
    """Valid results attributed to an owner (name, country) in ``countries``.

    A result with ``athlete_id`` belongs to that athlete (a dangling id
    belongs to nobody); an orphan (NULL ``athlete_id``) belongs to
    ``(athlete_name, nationality)``. Same rows as the reference's UNION ALL
    of the two branches, in one scan of the fact: one left join to the
    athletes of those countries (broadcast, or salted for NULL keys).
    Adds ``owner_name``, ``owner_country``. Reads the athlete-sorted copy of
    the fact when the lake has one, so later aggregations by owner combine
    map-side (each task holds a disjoint range of athletes).
    """
    r = valid_results(t, t.results_for_athletes if results is None else results).filter(
        F.col("athlete_id").isNotNull() | F.col("nationality").isin(countries))
    athletes = t.athletes.filter(F.col("country_code").isin(countries))
    j = with_athletes(t, r, {"a_full_name": "full_name", "a_country_code": "country_code"}, "left", athletes)
    orphan = F.col("athlete_id").isNull()
    owned = (j.withColumn("owner_name", F.when(orphan, F.col("athlete_name")).otherwise(F.col("a_full_name")))
              .withColumn("owner_country", F.when(orphan, F.col("nationality")).otherwise(F.col("a_country_code"))))
    return owned.filter(F.col("owner_country").isNotNull()).drop("a_full_name", "a_country_code")


def owner_groups(t: Tables, countries: list[str], also: tuple[str, ...] = ()) -> DataFrame:
    """Valid results as weighted rows ``(athlete_id, athlete_name,
    nationality, <also>, n, owner_name, owner_country, a_country_code)``;
    ``n`` is the number of results a row stands for.

    While the athletes of ``countries`` fit a broadcast, each result is one
    row (``n`` = 1) probing them map-side, and the caller's aggregation
    combines partially. Beyond that, results are first counted per
    ``(athlete_id, athlete_name, nationality, <also>)`` so the shuffled join
    carries one row per group instead of one per result; NULL ``athlete_id``
    groups are salted by a hash of the rest. Rows owned by nobody are kept
    (``owner_country`` NULL) so callers can apply other rules. Reads the
    athlete-sorted copy of the fact when it is in step, where each task holds
    a disjoint range of athletes and the aggregation by athlete or owner
    collapses map-side. Where results are kept counted by who they may belong
    to (``Tables.owner_counts``), a call without ``also`` reads those counts and
    no result; the athletes are joined as they now are, so a changed country
    or name shows at once.
    """
    owned = F.col("athlete_id").isNotNull() | F.col("nationality").isin(countries)
    r = valid_results(t, t.results_for_athletes).filter(owned)
    athletes = t.athletes.filter(F.col("country_code").isin(countries))
    keys = [*OWNER_KEYS, *also]
    if t.owner_counts is not None and not also:
        g = t.owner_counts.filter(owned).withColumn("_spread", F.xxhash64(*keys[1:]))
    elif t.fits("athletes", athletes):
        g = r.select(*keys, F.lit(1).cast("long").alias("n"), F.col("id").alias("_spread"))
    else:
        g = r.groupBy(*keys).agg(F.count("id").alias("n")).withColumn("_spread", F.xxhash64(*keys[1:]))
    j = join_dim(t, g, "athletes", "athlete_id", {"a_full_name": "full_name", "a_country_code": "country_code"}, "left",
                 dim=athletes, spread_by="_spread")
    orphan = F.col("athlete_id").isNull()
    return (j.withColumn("owner_name", F.when(orphan, F.col("athlete_name")).otherwise(F.col("a_full_name")))
             .withColumn("owner_country", F.when(orphan, F.col("nationality")).otherwise(F.col("a_country_code")))
             .drop("_spread", "a_full_name"))


def first_per_key(df: DataFrame, key: str, order: list[tuple[Column, bool]]) -> DataFrame:
    """``DISTINCT ON (key) ... ORDER BY key, <order>``: the first row of each
    key in ``order``, (expression, descending) with PostgreSQL's NULL placement
    (NULLs last ascending, first descending).

    An aggregate, not a window: tasks keep one row per key before the shuffle.
    Descending keys must be numbers, dates or timestamps. Of rows that tie any
    may be picked.
    """
    # A struct compares field by field, NULL as the smallest: ascending keys
    # carry whether they are NULL before them, descending ones turn negative.
    parts = []
    for value, descending in order:
        if descending:
            kind = df.select(value).schema[0].dataType
            number = F.unix_date(value) if isinstance(kind, DateType) else value.cast("double") if isinstance(
                kind, TimestampType) else value
            parts += [value.isNotNull(), -number]
        else:
            parts += [value.isNull(), value]
    rest = [c for c in df.columns if c != key]
    first = F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*parts))
    return df.groupBy(key).agg(first.alias("_first")).select(
        *[F.col(f"`{key}`") if c == key else F.col("_first")[c].alias(c) for c in df.columns])
