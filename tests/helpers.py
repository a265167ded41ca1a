"""Build small literal table sets for edge tests."""

from __future__ import annotations

from podium.sources.schemas import SCHEMAS
from podium.sources.tables import from_frames


def make_tables(spark, broadcast_max_rows: int = 1_000_000, **rows):
    frames = {n: spark.createDataFrame(rows.get(n, []), SCHEMAS[n]) for n in SCHEMAS}
    return from_frames(frames, broadcast_max_rows)
