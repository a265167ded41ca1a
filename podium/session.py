"""Session helpers: a builder with the settings the reports rely on, and the
shared checkpoint folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every report assumes. AQE re-plans joins at runtime (broadcast
# conversion, skew splitting, partition coalescing); UTC keeps dates stable.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    # Lists of names are pushed to the scan name by name, not as one range.
    "spark.sql.parquet.pushdown.inFilterThreshold": "200",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Rows a task sorts at most where a table is written, and the shuffled bytes up
# to which Spark puts small partitions together for that: a row of the fact
# takes some 200 bytes in a sort, a third more for a join below it.
ROWS_PER_TASK = 1_000_000
WRITE_ADVISORY_BYTES = 32 << 20


@contextmanager
def tasks_for(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """Shuffles in this block start from one partition per
    :data:`ROWS_PER_TASK` of ``rows``, or more where the session has more, so
    that what a task sorts doesn't grow with the table and stays in memory. AQE
    still puts small partitions together, by the session's advisory size or
    else :data:`WRITE_ADVISORY_BYTES`."""
    n = -(-(rows or 0) // ROWS_PER_TASK)
    parts, initial = "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    advisory = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = {k: spark.conf.get(k, None) for k in (parts, initial, advisory)}
    if n > int(spark.conf.get(parts)):
        spark.conf.set(parts, str(n))
    if before[initial] is not None and n > int(before[initial]):
        spark.conf.set(initial, str(n))
    if before[advisory] is None:
        spark.conf.set(advisory, str(WRITE_ADVISORY_BYTES))
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def build_session(master: str = "local[*]", app: str = "podium",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Create (or reuse) a session with :data:`DEFAULT_CONF` applied.

    ``shuffle_partitions`` should be sized to the data: about one partition
    per 128 MB of shuffled data on a cluster, about the core count locally.
    """
    b = SparkSession.builder.master(master).appName(app)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there; it is read, never overridden. Only
    a local session (tests) with nothing configured gets a folder of its own;
    on a cluster a missing setting is an error, since a machine-local folder
    would not survive the loss of that machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or \
        sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        conf_dir = tempfile.mkdtemp(prefix="podium-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    Reliable (not local) checkpointing: the files survive the loss of any
    executor, so later stages never recompute the inputs.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, name)
