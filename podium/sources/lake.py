"""Writing a lake: the eight tables as parquet, with the tables kept beside
the fact."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame

from ..session import tasks_for
from .companions import ATHLETE_LAYOUT, COMPANIONS, packed, record, write_companions
from .schemas import FACT, SCHEMAS
from .tables import Tables

BLOOM_COLUMNS = ("athlete_id", "athlete_name")


def write_tables(t: Tables, out: str, results_files: int | None = None, athlete_layout: bool = True) -> str:
    """Write the tables under ``out``, one folder each.

    ``results`` is range-partitioned and sorted by ``(race_id, id)`` so that
    parquet min/max statistics let race-selective reads skip row groups; the
    ``id`` in the range key lets a race holding a large share of the rows be
    split over several partitions instead of landing in one task. Parquet
    bloom filters on ``athlete_id`` and ``athlete_name`` help athlete
    predicates on that layout once chunks outgrow dictionary encoding.

    The tables of :mod:`.companions` are written beside it. With
    ``athlete_layout`` they include a second copy of the fact, ranged and
    sorted by ``(athlete_id, athlete_name, id)``: it doubles the fact's storage
    and turns every athlete drill-down from a full scan into a read of the
    athlete's row groups (NULL ids sort first, by name, so orphans matched by
    name are clustered too).
    """
    spark = t.spark
    for n in SCHEMAS:
        df: DataFrame = t.table(n)
        w = df.write
        if n == FACT:
            df = df.repartitionByRange(results_files, "race_id", "id") if results_files else df
            w = df.sortWithinPartitions("race_id", "id").write.options(**packed("parquet"))
            for c in BLOOM_COLUMNS:
                w = w.option(f"parquet.bloom.filter.enabled#{c}", "true")
        with tasks_for(spark, t.results_expected if n == FACT else None):
            w.mode("overwrite").parquet(os.path.join(out, n))
    names = [n for n in COMPANIONS if athlete_layout or n != ATHLETE_LAYOUT]
    write_companions(spark.read.schema(SCHEMAS[FACT]).parquet(os.path.join(out, FACT)), out, names, files=results_files)
    record(spark, out, names)
    return out
