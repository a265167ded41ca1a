"""The table set every report reads, and the size-checked broadcast policy.

``Tables`` holds one lazy DataFrame per table. Dimensions are broadcast only
after their rows have been checked against ``broadcast_max_rows`` and the bytes
of their values against ``broadcast_max_bytes``; both are taken once per table
and memoised, so every filtered subset of a dimension inherits the bounds. Above
them the join is left to Catalyst
and AQE (sort-merge, with runtime broadcast conversion and skew splitting).
The fact table ``results`` is never broadcast.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from . import companions
from .companions import ATHLETE_LAYOUT
from .schemas import FACT, SCHEMAS

# Rows a dimension may have and still be broadcast (after column pruning a
# dimension row is a few dozen bytes, so this stays far below executor memory).
DEFAULT_BROADCAST_MAX_ROWS = 1_000_000
# Bytes its values may have (a few long texts weigh more than many short rows).
DEFAULT_BROADCAST_MAX_BYTES = 256 << 20
FIXED_BYTES = 8  # counted for each value beside the bytes of texts


def _value_bytes(df: DataFrame) -> Column:
    """The sum of the bytes of a frame's values, texts by their length."""
    size = F.lit(FIXED_BYTES * len(df.columns)).cast("long")
    for f in df.schema.fields:
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, ArrayType):
            size += F.coalesce(F.size(col) * FIXED_BYTES + F.octet_length(F.array_join(col, "")), F.lit(0))
        elif isinstance(f.dataType, StringType):
            size += F.coalesce(F.octet_length(col), F.lit(0))
    return F.sum(size)


@dataclass
class Tables:
    competitions: DataFrame
    ranking_categories: DataFrame
    countries: DataFrame
    athletes: DataFrame
    disciplines: DataFrame
    events: DataFrame
    races: DataFrame
    results: DataFrame
    broadcast_max_rows: int = DEFAULT_BROADCAST_MAX_ROWS
    broadcast_max_bytes: int = DEFAULT_BROADCAST_MAX_BYTES
    # Optional second layout of the fact, sorted by athlete (same rows and
    # columns as ``results``); athlete drill-downs read it when present.
    results_by_athlete: DataFrame | None = None
    # Further tables kept beside the fact, see :mod:`.companions`.
    results_by_name: DataFrame | None = None
    race_counts: DataFrame | None = None
    athlete_names: DataFrame | None = None
    name_grams: DataFrame | None = None
    gram_counts: DataFrame | None = None
    owner_counts: DataFrame | None = None
    # About how many results there are, where that is known without a pass over
    # them: it sizes the tasks that write them, nothing else.
    results_expected: int | None = None
    # Sorted lists that deep pages of these tables needed, see operators.paging.
    kept_orders: dict = field(default_factory=dict, repr=False)
    _rows: dict[str, int] = field(default_factory=dict, repr=False)
    _bytes: dict[str, int] = field(default_factory=dict, repr=False)

    @property
    def spark(self) -> SparkSession:
        return self.results.sparkSession

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)

    @property
    def results_for_athletes(self) -> DataFrame:
        """The fact in the layout that suits athlete predicates."""
        return self.results if self.results_by_athlete is None else self.results_by_athlete

    def rows(self, name: str) -> int:
        """Row count of a table, computed once (parquet answers from footers)."""
        if name not in self._rows:
            self._rows[name] = self.table(name).count()
        return self._rows[name]

    def bytes(self, name: str) -> int:
        """Bytes of a table's values, computed once (one aggregated row)."""
        if name not in self._bytes:
            self._bytes[name] = self.table(name).agg(_value_bytes(self.table(name))).first()[0] or 0
        return self._bytes[name]

    def broadcastable(self, name: str) -> bool:
        """Whether a dimension is within both bounds. Bytes are only measured
        for one that has few enough rows."""
        if name == FACT:
            return False
        return self.rows(name) <= self.broadcast_max_rows and self.bytes(name) <= self.broadcast_max_bytes

    def fits(self, name: str, subset: DataFrame | None = None) -> bool:
        """Whether a dimension, or else the given subset of it, is within the
        bounds. A subset of a dimension beyond them (one country's athletes) is
        measured by itself, up to one row more than may be broadcast."""
        if self.broadcastable(name):
            return True
        if name == FACT or subset is None or not self.broadcast_max_rows:
            return False
        held = subset.limit(self.broadcast_max_rows + 1)
        n, size = held.agg(F.count(F.lit(1)), _value_bytes(held)).first()
        return n <= self.broadcast_max_rows and (size or 0) <= self.broadcast_max_bytes

    def dim(self, name: str, df: DataFrame | None = None) -> DataFrame:
        """``df`` (default: the whole dimension) with a broadcast hint when the
        dimension's checked rows and bytes are within the bounds; a subset of a
        dimension is never larger than the dimension."""
        df = self.table(name) if df is None else df
        return F.broadcast(df) if self.broadcastable(name) else df

    def register_views(self, prefix: str = "") -> None:
        """Expose the tables to ``spark.sql`` as temp views."""
        for n in SCHEMAS:
            self.table(n).createOrReplaceTempView(prefix + n)


def _conform(df: DataFrame, name: str) -> DataFrame:
    """Select the schema's columns in order, cast to the declared types."""
    schema = SCHEMAS[name]
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def load_tables(spark: SparkSession, path: str, fmt: str = "parquet",
                broadcast_max_rows: int = DEFAULT_BROADCAST_MAX_ROWS,
                with_athlete_layout: bool = True, with_companions: bool = True) -> Tables:
    """Read the eight tables from a lake folder (``<path>/<table>``), the fact
    with the batches committed so far, and the tables kept beside the fact as
    far as they hold the same rows (:func:`companions.in_step`).

    The declared schema is passed to the reader, so no inference pass runs and
    column pruning / filter pushdown reach the files.
    """
    dfs = {}
    batches = companions.committed(spark, path)
    for n, schema in SCHEMAS.items():
        p = os.path.join(path, n)
        if n == FACT and batches:
            dfs[n] = companions.read_batches(spark, path, n, batches, fmt)
            continue
        if fmt == "parquet" and not os.path.exists(p) and os.path.exists(p + ".parquet"):
            p = p + ".parquet"
        dfs[n] = spark.read.format(fmt).schema(schema).load(p)
    beside = {}
    for n in companions.in_step(spark, path, fmt):
        wanted = with_athlete_layout if n == ATHLETE_LAYOUT else with_companions
        if wanted and all(n in names for names in batches.values()):
            beside[n] = companions.read_batches(spark, path, n, batches, fmt)
    return Tables(**dfs, broadcast_max_rows=broadcast_max_rows, **beside)


# Tables keyed by a numeric ``id`` can be read in parallel id ranges.
ID_KEYED = ("results", "athletes", "competitions", "races", "events", "ranking_categories")


def _jdbc_ranged(spark: SparkSession, url: str, table: str, properties: dict[str, str],
                 partitions: int) -> DataFrame:
    """Read ``table`` in ``partitions`` parallel ranges of ``id``; the bounds
    come from one MIN/MAX query pushed to the database."""
    b = spark.read.jdbc(url, f"(SELECT MIN(id) AS lo, MAX(id) AS hi FROM {table}) b",
                        properties=properties).first()
    lo, hi = int(b["lo"] or 0), int(b["hi"] or 0)
    return spark.read.jdbc(url, table, column="id", lowerBound=lo, upperBound=hi + 1,
                           numPartitions=max(1, partitions), properties=properties)


def load_jdbc(spark: SparkSession, url: str, properties: dict[str, str],
              num_partitions: int = 256, dim_partitions: int = 16, fetch_size: int = 10_000,
              broadcast_max_rows: int = DEFAULT_BROADCAST_MAX_ROWS) -> Tables:
    """Read the eight tables from a live database over JDBC.

    The fact is read in ``num_partitions`` parallel id ranges and the
    id-keyed dimensions in ``dim_partitions`` ranges, so reads scale with
    executors instead of streaming through one connection; the two small
    code-keyed dimensions (countries, disciplines) are read in one piece.
    Credentials come from ``properties``; nothing is stored here.
    """
    props = {**properties, "fetchsize": str(fetch_size)}
    dfs = {}
    for n in SCHEMAS:
        if n in ID_KEYED:
            df = _jdbc_ranged(spark, url, n, props, num_partitions if n == FACT else dim_partitions)
        else:
            df = spark.read.jdbc(url, n, properties=props)
        dfs[n] = _conform(df, n)
    return Tables(**dfs, broadcast_max_rows=broadcast_max_rows)


def from_frames(frames: dict[str, DataFrame],
                broadcast_max_rows: int = DEFAULT_BROADCAST_MAX_ROWS, results_expected: int | None = None) -> Tables:
    """Wrap in-memory or derived DataFrames, conformed to the schemas."""
    return Tables(**{n: _conform(frames[n], n) for n in SCHEMAS},
                  broadcast_max_rows=broadcast_max_rows, results_expected=results_expected)
