"""Helpers the operators share: tables in the shared folder, row locators and
distributed numbering."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from ..session import scratch_dir

# Of a row group whose rows hold long arrays, before compression.
GROUP_BYTES = 2 << 20


def shared_path(df_or_spark, name: str) -> str:
    """A fresh path in the shared folder that ``spark.checkpoint.dir`` names."""
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    return scratch_dir(spark, f"{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, name: str, group_rows: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage is cut, and
    values assigned while writing (row numbers) are fixed from then on.

    Spark reads arrays in batches of up to 4096 rows of a row group, each batch
    whole in memory. Where rows hold long arrays, a row group of at most
    ``group_rows`` rows, fewer where they fill :data:`GROUP_BYTES`, keeps that
    batch from growing with the file."""
    path = shared_path(df, name)
    writer = df.write.option("compression", "zstd")
    if group_rows:
        writer = writer.options(**{"parquet.block.row.count.limit": group_rows, "parquet.block.size": GROUP_BYTES,
                                   "parquet.page.size.row.check.min": 1})
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _hashes(kind: DataType) -> bool:
    """Whether Spark's hash functions take values of this type."""
    if isinstance(kind, StructType):
        return all(_hashes(f.dataType) for f in kind.fields)
    if isinstance(kind, ArrayType):
        return _hashes(kind.elementType)
    return not isinstance(kind, (MapType, VariantType))


def row_key(df: DataFrame) -> tuple[Column, Column]:
    """Two 64-bit fingerprints over all columns of a row (NULL counts as a
    value). Rows with equal keys are repeats of one row. Maps and variants
    count as their JSON text, so maps of equal entries in another order are
    different rows."""
    parts = []
    for f in df.schema.fields:
        c = df[f"`{f.name}`"]
        parts += [c.isNull(), c if _hashes(f.dataType) else F.to_json(
            F.struct(c.alias("v")), {"ignoreNullFields": "false"})]
    return F.xxhash64(F.lit(11), *parts), F.xxhash64(F.lit(2711), *parts)


def numbered(df: DataFrame, order: Sequence[str], name: str, sums: Sequence[str] = ()) -> DataFrame:
    """Number the rows of a narrow table 1, 2, … in ascending ``order``, and
    give the running total of each column in ``sums`` over all rows before.

    The table is range-partitioned on the whole order key, so rows with a
    common leading key spread over many tasks; each partition's totals (one
    row per partition, the only rows that meet in one task) are prefix-summed
    and added to the running values inside the partition.

    Adds ``n`` (long, from 1) and ``<c>_before`` for each sum column.
    """
    ranged = written(
        df.repartitionByRange(*[F.col(c).asc() for c in order])
        .sortWithinPartitions(*order)
        .withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), name)
    totals = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(f"{c}_sum") for c in sums])
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
                            *[F.coalesce(F.sum(f"{c}_sum").over(before), F.lit(0)).alias(f"{c}_offset") for c in sums])
    inside = Window.partitionBy("part").orderBy("at")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition of the range exchange: its size is bounded by the
    # number of shuffle partitions, whatever the input.
    return (ranged.join(F.broadcast(offsets), "part")
            .withColumns({"n": F.col("rows_before") + F.row_number().over(inside),
                          **{f"{c}_before": F.col(f"{c}_offset") + F.coalesce(F.sum(c).over(earlier), F.lit(0))
                             for c in sums}})
            .drop("part", "at", "rows_before", *[f"{c}_offset" for c in sums]))
