"""Sinks: append with an observed row count, JSON rows, and the JSON
response envelope of a page."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..session import tasks_for
from . import companions
from .schemas import FACT, SCHEMAS


def append(df: DataFrame, path: str, fmt: str = "parquet",
           partition_by: list[str] | None = None) -> int:
    """Append ``df`` to a lake folder and return the number of rows written.

    The count is an observed metric of the write itself (no second pass).
    Each task writes its own files and Spark commits them through the output
    committer, so a lost executor's task is retried without duplicates.
    """
    obs = Observation("append")
    w = df.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode("append").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
    return int(obs.get["rows"])


def append_results(df: DataFrame, path: str, fmt: str = "parquet", batch: str | None = None,
                   expected: int | None = None) -> int:
    """Append results to a lake as one batch, with all tables kept beside the
    fact, and return the number of rows added.

    The batch lies in a folder of its own and counts from the moment it is
    noted as complete, so readers see all of its layouts or none. A batch that
    is already noted adds nothing, so a caller may retry with the same id; what
    an interrupted attempt left behind is written anew. The other layouts are
    made from the fact's part as written, so they hold the same rows even if
    ``df`` would not give them twice. One id must not be written by two callers
    at a time. ``expected`` is about how many rows the batch has, if the caller
    knows: it sizes the tasks that write the fact's part, nothing else.
    """
    spark = df.sparkSession
    batch = batch or uuid.uuid4().hex
    folder = companions.batch_folder(path, batch)
    if batch in companions.committed(spark, path):
        return 0
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS[FACT]]
    obs = Observation("append_results")
    with tasks_for(spark, expected):
        (df.select(*columns).repartitionByRange("race_id", "id").sortWithinPartitions("race_id", "id")
         .observe(obs, F.count(F.lit(1)).alias("rows")).write.options(**companions.packed(fmt)).format(fmt)
         .mode("overwrite").save(os.path.join(folder, FACT)))
    rows = int(obs.get["rows"])
    names = companions.in_step(spark, path, fmt)
    written = spark.read.format(fmt).schema(SCHEMAS[FACT]).load(os.path.join(folder, FACT))
    companions.write_companions(written, folder, names, fmt)
    companions.commit(spark, path, batch, rows, names)
    return rows


def append_jdbc(df: DataFrame, url: str, table: str, properties: dict[str, str],
                batch_size: int = 10_000) -> int:
    """Append ``df`` to a database table (one transaction per partition)."""
    obs = Observation("append_jdbc")
    (df.observe(obs, F.count(F.lit(1)).alias("rows")).write
       .option("batchsize", str(batch_size))
       .jdbc(url, table, mode="append", properties=properties))
    return int(obs.get["rows"])


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON object per row (dates as ISO ``yyyy-MM-dd``), computed on
    executors."""
    return df.select(F.to_json(F.struct(*df.columns), {"dateFormat": "yyyy-MM-dd"}).alias("json"))


def write_json(df: DataFrame, path: str) -> None:
    """Write rows as JSON lines (distributed)."""
    df.write.mode("overwrite").option("dateFormat", "yyyy-MM-dd").json(path)


def envelope(page_rows: DataFrame, key: str, order: list[Column],
             info: DataFrame | None = None, extra: dict[str, object] | None = None) -> DataFrame:
    """The response envelope of one page, as a one-row DataFrame with a JSON
    string: ``{key: [rows...], <info columns>..., <extra>...}``.

    ``page_rows`` must be a page (a bounded LIMIT, at most a few hundred
    rows): its rows are gathered into one array, kept in ``order``. ``info``
    is a one-row DataFrame (for instance
    :func:`podium.operators.paging.page_info`). No join: the page rows and the
    info row are unioned and folded by one aggregate.
    """
    pos = F.row_number().over(Window.orderBy(*order))
    tagged = page_rows.select(F.struct(pos.alias("_pos"), F.struct(*page_rows.columns).alias("_r")).alias("_row"))
    aggs = [F.transform(F.array_sort(F.collect_list("_row")), lambda x: x["_r"]).alias(key)]
    info_cols: list[str] = []
    if info is not None:
        info_cols = list(info.columns)
        tagged = tagged.unionByName(info.select(F.struct(*info_cols).alias("_info")), allowMissingColumns=True)
        aggs.append(F.first("_info", ignorenulls=True).alias("_info"))
    out = tagged.agg(*aggs)
    fields = [F.col(key)] + [F.col("_info")[c].alias(c) for c in info_cols]
    fields += [F.lit(v).alias(k) for k, v in (extra or {}).items()]
    return out.select(F.to_json(F.struct(*fields), {"dateFormat": "yyyy-MM-dd"}).alias("json"))
