"""Parameterised SQL over the competition tables.

The tables are exposed as temp views and the text runs through
``spark.sql`` with named parameter markers (``:name``), which Spark binds as
literals — no string formatting of values, and the same Catalyst plan as the
DataFrame form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .tables import Tables


def run_sql(t: Tables, text: str, prefix: str = "", **params: object) -> DataFrame:
    """``SELECT`` over the eight tables with ``:name`` markers bound to
    ``params`` (markers also work inside ILIKE, LIMIT and OFFSET)."""
    t.register_views(prefix)
    return t.spark.sql(text, args=params or None)
