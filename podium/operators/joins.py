"""Join helpers: dimension lookups behind the size check, the NULL-key split
for outer joins on a nullable key, and combining one-value aggregates into
one row without a cross join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import Tables


def lookup(t: Tables, df: DataFrame, dim_name: str, dim: DataFrame,
           on: Column, how: str = "inner") -> DataFrame:
    """Join ``df`` with ``dim`` (a projection/subset of dimension ``dim_name``).

    ``dim`` is broadcast when the dimension passed the row-count check; the
    fact then streams through a hash probe with no shuffle. Otherwise the
    join is planned by Catalyst/AQE (sort-merge, runtime broadcast
    conversion, skew splitting).
    """
    return df.join(t.dim(dim_name, dim), on, how)


def left_join_nullable(t: Tables, df: DataFrame, key: str, dim_name: str,
                       dim: DataFrame, dim_key: str, spread_by: str = "id",
                       is_subset: bool = False) -> DataFrame:
    """``df LEFT JOIN dim ON df.key = dim.dim_key`` where ``df.key`` may be NULL.

    With a broadcast dimension (or subset of it, ``is_subset``) this is one
    hash probe. Otherwise NULL keys
    (which can be a large share of the rows and would all hash to one
    shuffle partition) are salted: they join on the row's own ``spread_by``
    value instead, which spreads them over all partitions, and the
    ``key IS NOT NULL`` guard in the join condition keeps them unmatched.
    One scan, one shuffle, no hot partition.
    """
    if t.fits(dim_name, dim if is_subset else None):
        return df.join(F.broadcast(dim), F.col(key) == F.col(dim_key), "left")
    salted = F.coalesce(F.col(key), F.col(spread_by).cast(df.schema[key].dataType))
    return df.join(dim, (salted == F.col(dim_key)) & F.col(key).isNotNull(), "left")


def one_row(*parts: DataFrame, default: int | None = 0) -> DataFrame:
    """Put the columns of one-row aggregates side by side in one row.

    Each part is a global aggregate (exactly one row) with its own column
    names. The parts are unioned by name (each row fills only its own
    columns) and folded by one global aggregate: no join, no cross product.
    A NULL value becomes ``default``.
    """
    names = [c for p in parts for c in p.columns]
    if len(set(names)) != len(names):
        raise ValueError(f"duplicate column names in one_row parts: {names}")
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True),
               [p.select(*[F.col(c).cast("long").alias(c) for c in p.columns]) for p in parts])
    cols = []
    for name in names:
        v = F.max(name)
        if default is not None:
            v = F.coalesce(v, F.lit(default).cast("long"))
        cols.append(v.alias(name))
    return u.agg(*cols)
