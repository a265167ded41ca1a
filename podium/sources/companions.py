"""Tables kept beside the fact, derived from it and added to with every batch.

==================  =========================================================
results_by_athlete  the fact, ranged and sorted by athlete
results_by_name     valid results that carry a name, ranged and sorted by it
race_counts         valid results per race
owner_counts        valid results per athlete, name and nationality they carry
athlete_names       the distinct names of valid results, each with its results
name_grams          for every three letters in a row the names that hold them
gram_counts         for every three letters in a row how many names hold them
==================  =========================================================

All of them add up: what a batch gives is put beside what is there, and readers
sum the counts. The fact and its companions of a batch lie in a folder of their
own (``batches/<batch>/<table>``) and count from the moment the batch is noted
in ``commits``; the batches noted when a lake is loaded are its snapshot. What
lies in the lake's own folders is the base; its companions are used while the
base consists of the files that it had when they were recorded as equal.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.exprs import valid_mark
from ..session import tasks_for
from .schemas import FACT, SCHEMAS

GRAM = 3
OWNER_KEYS = ("athlete_id", "athlete_name", "nationality")  # who a result may belong to
ATHLETE_LAYOUT = "results_by_athlete"
LAYOUT_RECORD = "results_layouts"
COMMITS, BATCHES = "commits", "batches"
_COMMIT = "batch string, rows long, layouts array<string>"


def _named(results: DataFrame) -> DataFrame:
    return results.filter(valid_mark() & F.col("athlete_name").isNotNull())


def _names(results: DataFrame) -> DataFrame:
    return _named(results).groupBy("athlete_name").agg(F.count(F.lit(1)).alias("n"))


def _grams(results: DataFrame) -> DataFrame:
    # As ILIKE sees a name: in lower case.
    low = F.lower("athlete_name")
    grams = F.transform(F.sequence(F.lit(1), F.length(low) - (GRAM - 1)), lambda i: F.substring(low, i, F.lit(GRAM)))
    return (_named(results).select("athlete_name").distinct().filter(F.length(low) >= GRAM)
            .select(F.explode(F.array_distinct(grams)).alias("gram"), "athlete_name"))


@dataclass(frozen=True)
class Companion:
    """``derive`` makes its rows from results, ``order`` is their layout."""
    schema: StructType
    derive: Callable[[DataFrame], DataFrame]
    order: tuple[str, ...]
    options: tuple[tuple[str, str], ...] = ()
    # Made from the athlete's copy where that is written too: it has the same
    # rows, those of an athlete and of a name side by side, so tasks count them
    # before the shuffle and what is shuffled whole compresses better.
    by_athlete: bool = False


# Pages of few rows, so that the rows of single names can be picked out.
_SMALL_PAGES = (("parquet.page.row.count.limit", "2000"),)
COMPANIONS: dict[str, Companion] = {
    "results_by_athlete": Companion(SCHEMAS[FACT], lambda r: r, ("athlete_id", "athlete_name", "id")),
    "results_by_name": Companion(SCHEMAS[FACT], _named, ("athlete_name", "id"), _SMALL_PAGES, True),
    "race_counts": Companion(
        StructType().add("race_id", "long").add("n", "long"),
        lambda r: r.filter(valid_mark()).groupBy("race_id").agg(F.count(F.lit(1)).alias("n")), ("race_id",)),
    "owner_counts": Companion(
        StructType([f for f in SCHEMAS[FACT] if f.name in OWNER_KEYS]).add("n", "long"),
        lambda r: r.filter(valid_mark()).groupBy(*OWNER_KEYS).agg(F.count(F.lit(1)).alias("n")), OWNER_KEYS, by_athlete=True),
    "athlete_names": Companion(StructType().add("athlete_name", "string").add("n", "long"), _names, ("athlete_name",),
                               by_athlete=True),
    "name_grams": Companion(StructType().add("gram", "string").add("athlete_name", "string"), _grams, ("gram", "athlete_name"),
                            _SMALL_PAGES, True),
    "gram_counts": Companion(StructType().add("gram", "string").add("n", "long"),
                             lambda r: _grams(r).groupBy("gram").agg(F.count(F.lit(1)).alias("n")), ("gram",), by_athlete=True),
}


def schema_of(table: str) -> StructType:
    return COMPANIONS[table].schema if table in COMPANIONS else SCHEMAS[table]


def packed(fmt: str) -> dict[str, str]:
    """Write options of the fact and its companions, which hold its rows up to
    three times."""
    return {"compression": "zstd"} if fmt == "parquet" else {}


def write_companions(results: DataFrame, folder: str, names: Iterable[str], fmt: str = "parquet",
                     files: int | None = None) -> None:
    """(Over)write the named companions of ``results``, the fact's part as
    written, under ``folder``."""
    spark, copy = results.sparkSession, None
    with tasks_for(spark, results.count()):
        for name in names:
            made = COMPANIONS[name]
            keys = [F.col(k).asc_nulls_first() for k in made.order]
            df = made.derive(copy if copy is not None and made.by_athlete else results).select(*made.schema.names)
            df = df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)
            path = os.path.join(folder, name)
            df.sortWithinPartitions(*keys).write.options(**packed(fmt), **dict(made.options)).format(fmt).mode(
                "overwrite").save(path)
            if name == ATHLETE_LAYOUT:
                copy = spark.read.format(fmt).schema(made.schema).load(path)


def _found(read: Callable[[], object]):
    """What ``read`` gives, or None where its path does not exist."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _state(spark: SparkSession, path: str, names: Iterable[str], fmt: str) -> str | None:
    """A fingerprint of the files that the base of the fact and of the named
    companions consist of right now; None if one of them is missing. Every
    write adds or replaces files under new names, so any write changes it."""
    held = []
    for table in (FACT, *names):
        files = _found(lambda: spark.read.format(fmt).schema(schema_of(table)).load(os.path.join(path, table))
                       .inputFiles())
        if files is None:
            return None
        held += sorted(f"{table}/{f.rsplit('/', 1)[-1]}" for f in files)
    return hashlib.sha256("\n".join(held).encode()).hexdigest()


def record(spark: SparkSession, path: str, names: Iterable[str], fmt: str = "parquet") -> None:
    """Note that the named companions are those of the base, as it now is."""
    names = list(names)
    state = _state(spark, path, names, fmt)
    if state is not None:
        spark.createDataFrame([(names, state)], "names array<string>, state string").coalesce(1).write.mode(
            "overwrite").json(os.path.join(path, LAYOUT_RECORD))


def in_step(spark: SparkSession, path: str, fmt: str = "parquet") -> tuple[str, ...]:
    """The companions that belong to the base as it is. A write to one of them
    or to the base outside a batch leaves all of them out."""
    noted = _found(lambda: spark.read.schema("names array<string>, state string")
                   .json(os.path.join(path, LAYOUT_RECORD)).first())
    if noted is None or noted["state"] != _state(spark, path, noted["names"], fmt):
        return ()
    return tuple(noted["names"])


def committed(spark: SparkSession, path: str) -> dict[str, tuple[str, ...]]:
    """The batches that count, each with the companions it has."""
    rows = _found(lambda: spark.read.schema(_COMMIT).json(os.path.join(path, COMMITS)).collect()) or []
    return {r["batch"]: tuple(r["layouts"]) for r in sorted(rows, key=lambda r: r["batch"])}


def commit(spark: SparkSession, path: str, batch: str, rows: int, names: Iterable[str]) -> None:
    spark.createDataFrame([(batch, rows, list(names))], _COMMIT).coalesce(1).write.mode("append").json(
        os.path.join(path, COMMITS))


def batch_folder(path: str, batch: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_-]+", batch):
        raise ValueError(f"a batch id consists of letters, digits, '_' and '-': {batch!r}")
    return os.path.join(path, BATCHES, batch)


def read_batches(spark: SparkSession, path: str, table: str, batches: Iterable[str], fmt: str = "parquet") -> DataFrame:
    """A table's base and its part in the given batches."""
    folders = [os.path.join(path, table), *(os.path.join(batch_folder(path, b), table) for b in batches)]
    return spark.read.format(fmt).schema(schema_of(table)).load(folders)
