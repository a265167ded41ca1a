"""Country dashboard: key figures, gender split, discipline breakdown, yearly
timeline, top athletes and regional comparison.

Two different country rules are in play and are kept apart:

* attribution (``owner_country``): a linked result belongs to its athlete's
  country, an orphan to its ``nationality`` — top athletes, regional
  comparison, athletes with results;
* the OR rule: the athlete's country *or* the result's nationality is the
  country — result totals and the discipline breakdown.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import category_or_default, gender_category, recent_floor
from ..operators.facts import join_dim, owner_groups, race_context, valid_results, with_race_context
from ..operators.joins import one_row
from ..operators.paging import asc, desc
from ..session import checkpointed
from ..sources.tables import Tables

# ---- fixed values: the reference's country constants ------------------------
DEFAULT_COUNTRY = "SGP"
DEFAULT_COUNTRIES = ("SGP", "MAS", "THA", "PHI", "INA", "VNM")
TOP_N = 10
# -----------------------------------------------------------------------------


def _or_rule(country: str):
    """The result is the country's: its athlete's country or its nationality
    is (``a_country_code`` is only known for athletes of joined countries)."""
    return F.coalesce(F.col("a_country_code") == country, F.lit(False)) | F.coalesce(
        F.col("nationality") == country, F.lit(False))


def _race_groups(t: Tables, countries: list[str], keep, *by) -> DataFrame:
    """Valid results that satisfy ``keep``, weighted (``n``), with ``by`` and
    race: what the joins to the race context carry. Within the races bound
    each result probes the broadcast context as it is and is aggregated once,
    by the caller; beyond it results are counted per ``by`` and race first, so
    that the shuffled join carries groups."""
    g = owner_groups(t, countries, ("race_id",)).filter(keep)
    if t.broadcastable("races"):
        return g.select(*by, "race_id", "n")
    return g.groupBy(*by, "race_id").agg(F.sum("n").cast("long").alias("n"))


def _with_discipline(t: Tables, df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Add ``discipline_name`` (discipline, else event name) and ``category``
    (else 'Track & Field') with one join to the race context."""
    j = with_race_context(t, df, ["event_name", "d_name", "d_category"] + (extra or []))
    return (j.withColumn("discipline_name", F.coalesce("d_name", "event_name"))
             .withColumn("category", category_or_default("d_category")))


def _summary_facts(g: DataFrame, country: str, or_rule) -> DataFrame:
    """The two key figures that come from results, from weighted rows."""
    return g.agg(F.count_distinct(F.when(F.col("owner_country") == country, F.col("owner_name")))
                 .alias("athletes_with_results"),
                 F.coalesce(F.sum(F.when(or_rule, F.col("n"))), F.lit(0)).cast("long").alias("total_results"))


def _summary_row(t: Tables, country: str, facts: DataFrame) -> DataFrame:
    """The four key figures in one row (``facts`` carries the two figures
    computed from results)."""
    row = one_row(t.athletes.filter(F.col("country_code") == country).agg(F.count(F.lit(1)).alias("total_athletes")),
                  facts,
                  t.competitions.filter(F.col("country_code") == country)
                  .agg(F.count(F.lit(1)).alias("total_competitions")))
    return row.select("total_athletes", "athletes_with_results", "total_competitions", "total_results")


# --- the six reports, each as its own plan ----------------------------------

def country_summary(t: Tables, country: str = DEFAULT_COUNTRY) -> DataFrame:
    """One row: athletes of the country, athletes with results (attributed,
    distinct names), competitions held there, results (OR rule).

    The two result figures come from one scan of the fact, counted per
    (athlete, name, nationality) before the join to the country's athletes;
    ``a_country_code`` is non-NULL exactly when the linked athlete is of the
    country.
    """
    g = owner_groups(t, [country])
    return _summary_row(t, country, _summary_facts(g, country, _or_rule(country)))


def gender_distribution(t: Tables, country: str = DEFAULT_COUNTRY) -> DataFrame:
    return (t.athletes.filter(F.col("country_code") == country)
            .groupBy(gender_category("gender").alias("gender_category"))
            .agg(F.count(F.lit(1)).alias("count"))
            .orderBy(desc("count"), asc("gender_category")))


def _top_athletes(df: DataFrame, n: int) -> DataFrame:
    """From weighted rows with owner and competition."""
    return (df.groupBy(F.col("owner_name").alias("full_name"), F.col("owner_country").alias("country_code"))
              .agg(F.sum("n").cast("long").alias("result_count"),
                   F.count_distinct("competition_id").alias("competition_count"))
              .orderBy(desc("result_count"), asc("full_name"), asc("country_code"))
              .limit(n))


def top_athletes(t: Tables, country: str = DEFAULT_COUNTRY, n: int = TOP_N) -> DataFrame:
    """Top ``n`` attributed athletes by results, with distinct competitions."""
    g = _race_groups(t, [country], F.col("owner_country") == country, "owner_name", "owner_country")
    return _top_athletes(with_race_context(t, g, ["competition_id"]), n)


def _discipline_breakdown(df: DataFrame, n: int) -> DataFrame:
    """From weighted rows with result name and discipline."""
    return (df.groupBy("discipline_name", "category")
              .agg(F.count_distinct("athlete_name").alias("athlete_count"),
                   F.sum("n").cast("long").alias("result_count"))
              .filter(F.col("result_count") > 0)
              .orderBy(desc("result_count"), asc("discipline_name"), asc("category"))
              .limit(n))


def discipline_breakdown(t: Tables, country: str = DEFAULT_COUNTRY, n: int = TOP_N) -> DataFrame:
    """Top ``n`` disciplines by results of the country (OR rule); athletes
    are distinct result names, so nameless results add none."""
    return _discipline_breakdown(_with_discipline(t, _race_groups(t, [country], _or_rule(country), "athlete_name")), n)


def _timeline_selection(t: Tables, country: str, as_of, years: int) -> tuple[DataFrame, DataFrame]:
    """The country's competitions since ``as_of - years`` as ``(c_id, year)``
    and their races as ``(ra_id, ra_comp)`` (subsets of two dimensions)."""
    comps = (t.competitions
             .filter((F.col("country_code") == country) & (F.col("start_date") >= recent_floor(as_of, years)))
             .select(F.col("id").alias("c_id"), F.year("start_date").cast("long").alias("year")))
    sel = (t.races.select(F.col("id").alias("ra_id"), F.col("competition_id").alias("ra_comp"))
           .join(t.dim("competitions", comps.select("c_id")), F.col("ra_comp") == F.col("c_id"))
           .select("ra_id", "ra_comp"))
    return comps, sel


def _timeline_rollup(t: Tables, comps: DataFrame, sel: DataFrame, results_per_comp: DataFrame) -> DataFrame:
    """Per year: competitions, their races, and valid results
    (``results_per_comp`` = ``(r_comp, n_results)``). ``id`` is the key of
    competitions and races, so counting rows per key equals COUNT(DISTINCT)."""
    races_per_comp = sel.groupBy(F.col("ra_comp").alias("k_comp")).agg(F.count("ra_id").alias("n_races"))
    j = (comps.join(t.dim("competitions", races_per_comp), F.col("c_id") == F.col("k_comp"), "left")
              .join(t.dim("competitions", results_per_comp), F.col("c_id") == F.col("r_comp"), "left"))
    return (j.groupBy("year")
             .agg(F.count("c_id").alias("competition_count"),
                  F.coalesce(F.sum("n_races"), F.lit(0)).cast("long").alias("race_count"),
                  F.coalesce(F.sum("n_results"), F.lit(0)).cast("long").alias("result_count"))
             .orderBy(desc("year")))


def timeline(t: Tables, country: str = DEFAULT_COUNTRY,
             as_of: _dt.date | str | None = None, years: int = 5) -> DataFrame:
    """Per year of the country's competitions since ``as_of - years``:
    competitions, races and valid results (years without results stay).

    Valid results are counted per competition on the fact side (a hash probe
    into the broadcast selected races, then map-side partial counts), so only
    one row per selected competition leaves each task. Where valid results per
    race are kept beside the fact, no result is read.
    """
    comps, sel = _timeline_selection(t, country, as_of, years)
    valid = valid_results(t).select("race_id", "id")
    if t.race_counts is None and t.broadcastable("races"):
        # probe the broadcast selected races, then count per competition
        per_comp = valid.join(t.dim("races", sel), F.col("race_id") == F.col("ra_id"))
        results_per_comp = per_comp.groupBy(F.col("ra_comp").alias("r_comp")).agg(F.count("id").alias("n_results"))
    else:
        # count per race first: only per-race rows meet the selected races
        per_race = t.race_counts
        if per_race is None:
            per_race = valid.groupBy("race_id").agg(F.count("id").alias("n"))
        results_per_comp = (per_race.join(t.dim("races", sel), F.col("race_id") == F.col("ra_id"))
                            .groupBy(F.col("ra_comp").alias("r_comp"))
                            .agg(F.sum("n").cast("long").alias("n_results")))
    return _timeline_rollup(t, comps, sel, results_per_comp)


def _regional(t: Tables, df: DataFrame) -> DataFrame:
    """Per owner country of weighted rows: distinct owner names and results."""
    agg = (df.groupBy(F.col("owner_country").alias("country_code"))
             .agg(F.count_distinct("owner_name").alias("athlete_count"),
                  F.sum("n").cast("long").alias("result_count")))
    out = join_dim(t, agg, "countries", "country_code", {"country_name": "name"}, "left",
                   dim_key="code")
    return (out.select("country_code", "country_name", "athlete_count", "result_count")
               .orderBy(desc("result_count"), asc("country_code")))


def regional_comparison(t: Tables, countries: tuple[str, ...] | list[str] = DEFAULT_COUNTRIES) -> DataFrame:
    """Per country of ``countries``: distinct attributed athlete names and
    results; country names joined after aggregating. The fact is counted per
    (athlete, name, nationality) before the athlete join."""
    g = owner_groups(t, list(countries))
    return _regional(t, g.filter(F.col("owner_country").isin(list(countries))))


# --- all six over one shared base --------------------------------------------

def dashboard_base(t: Tables, country: str = DEFAULT_COUNTRY,
                   countries: tuple[str, ...] | list[str] = DEFAULT_COUNTRIES) -> DataFrame:
    """Counts (``n``) of the valid results that are attributed to one of the
    countries or are the country's by the OR rule, as two narrow aggregates in
    one frame: per owner and, for the country's own, competition (``owner_*``,
    ``competition_id``), and per result name and discipline (``athlete_name``,
    ``discipline_name``, ``category``; only the OR rule's results). One read of
    the fact and one join to the race context, whose rows split in two."""
    sel = sorted(set(countries) | {country})
    g = owner_groups(t, sel, ("race_id",)).withColumn("or_rule", _or_rule(country))
    g = g.filter(F.col("owner_country").isin(sel) | F.col("or_rule"))
    if not t.broadcastable("races"):
        g = (g.groupBy("owner_name", "owner_country", "or_rule", "athlete_name", "race_id")
             .agg(F.sum("n").cast("long").alias("n")))
    # A left join: attribution counts results of unknown races too.
    context = race_context(t, ["competition_id", "event_name", "d_name", "d_category"])
    g = g.join(t.dim("races", context.withColumn("_known", F.lit(True))), F.col("race_id") == F.col("_k_races"), "left")
    known = F.coalesce("_known", F.lit(False))
    own = F.col("owner_country") == country
    owned = F.when(F.col("owner_country").isin(sel), F.struct(
        F.lit("owned").alias("part"), F.col("owner_name").alias("name"), F.col("owner_country").alias("country"),
        F.when(own & known, F.col("competition_id")).alias("competition_id"), (own & known).alias("known"),
        F.lit(None).cast("string").alias("discipline_name"), F.lit(None).cast("string").alias("category")))
    ruled = F.when(F.col("or_rule"), F.struct(
        F.lit("ruled").alias("part"), F.col("athlete_name").alias("name"), F.lit(None).cast("string").alias("country"),
        F.lit(None).cast("long").alias("competition_id"), known.alias("known"),
        F.coalesce("d_name", "event_name").alias("discipline_name"),
        category_or_default("d_category").alias("category")))
    parts = F.explode(F.filter(F.array(owned, ruled), lambda x: x.isNotNull()))
    keys = ["part", "name", "country", "competition_id", "known", "discipline_name", "category"]
    return (g.select("n", parts.alias("_p")).select("n", *[F.col("_p")[k].alias(k) for k in keys])
            .groupBy(*keys).agg(F.sum("n").cast("long").alias("n")))


def country_dashboard(t: Tables, country: str = DEFAULT_COUNTRY,
                      countries: tuple[str, ...] | list[str] = DEFAULT_COUNTRIES,
                      as_of: _dt.date | str | None = None, n: int = TOP_N,
                      materialize: bool = True) -> dict[str, DataFrame]:
    """The six reports as DataFrames; four of them over one read of the fact.
    The shared base holds groups, not results, and is checkpointed to the
    cluster's checkpoint folder (lineage cut, survives executor loss; the
    session removes the files once the frames are gone). The timeline goes by
    the competitions' host country and has its own, pre-aggregated read."""
    base = dashboard_base(t, country, countries)
    if materialize:
        base = checkpointed(base)
    owned = base.filter("part = 'owned'").withColumnsRenamed({"name": "owner_name", "country": "owner_country"})
    ruled = base.filter("part = 'ruled'").withColumnRenamed("name", "athlete_name")
    facts = base.agg(
        F.count_distinct(F.when((F.col("part") == "owned") & (F.col("country") == country), F.col("name")))
        .alias("athletes_with_results"),
        F.coalesce(F.sum(F.when(F.col("part") == "ruled", F.col("n"))), F.lit(0)).cast("long").alias("total_results"))
    return {
        "summary": _summary_row(t, country, facts),
        "gender_distribution": gender_distribution(t, country),
        "discipline_breakdown": _discipline_breakdown(ruled.filter("known"), n),
        "timeline": timeline(t, country, as_of),
        "top_athletes": _top_athletes(owned.filter("known"), n),
        "regional_comparison": _regional(t, owned.filter(F.col("owner_country").isin(list(countries)))),
    }


DASHBOARD_SECTIONS = ("summary", "gender_distribution", "discipline_breakdown", "timeline",
                      "top_athletes", "regional_comparison")


def dashboard_frame(parts: dict[str, DataFrame]) -> DataFrame:
    """The dashboard dict as one DataFrame (the JSON envelope's rows): one
    ``section`` column plus the union of all sections' columns."""
    out = None
    for name in DASHBOARD_SECTIONS:
        df = parts[name].select(F.lit(name).alias("section"), "*")
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out
