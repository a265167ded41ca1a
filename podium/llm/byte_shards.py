"""Sharding by global byte-size prefix sums: contiguous shards of near-equal
bytes.

Documents are put in one global order (a hash of the text, then doc_id: equal
texts lie side by side, and the order does not depend on how the input is
stored). Each range partition's bytes are totalled, the totals are
prefix-summed, and a document belongs to the shard in which the middle of its
byte interval falls when the whole length is cut at equal targets. A shard
misses the target by at most half a document at either end.

Scale: only keys and sizes are shuffled (not the texts), range-partitioned on
the whole order key, so copies of one text spread over many tasks.

Cases: NULL text has no bytes (size is the 16 bytes of overhead). NULL
doc_id sorts first. Rows that repeat are documents of their own. Empty input
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, numbered, row_key, written

SHARDS = 40
OVERHEAD = 16


def shard_plan(docs: DataFrame, shards: int = SHARDS, overhead: int = OVERHEAD) -> DataFrame:
    """One row per document: ``k1``, ``k2`` (row key), ``doc_id``, ``size``,
    ``text_crc32``, ``shard`` (0 to shards-1) and ``slot`` (place in the
    shard, gapless from 0)."""
    k1, k2 = row_key(docs)
    text = F.coalesce(docs["text"], F.lit(""))
    sized = written(docs.select(k1.alias("k1"), k2.alias("k2"), docs["doc_id"],
                                (F.octet_length(text) + overhead).cast("long").alias("size"),
                                F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("text_hash")), "shard-sizes")
    rows = numbered(sized, ["text_hash", "doc_id", "k1", "k2"], "shard-order", ["size"])
    total = sized.agg(F.sum("size").alias("s")).first()["s"] or 1
    # Twice the middle of the byte interval, to stay in whole numbers.
    middle = F.col("size_before").cast("decimal(38,0)") * 2 + F.col("size")
    shard = F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(2 * total)).cast("int"))
    rows = rows.withColumn("shard", shard)
    firsts = rows.groupBy("shard").agg(F.min("n").alias("first"))
    # One row per shard: the number of shards is a parameter.
    return (rows.join(F.broadcast(firsts), "shard")
            .select("k1", "k2", "doc_id", "size", "text_crc32", "shard", (F.col("n") - F.col("first")).alias("slot")))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, overhead: int = OVERHEAD) -> None:
    """Write the rows of ``docs`` with ``shard`` and ``slot`` as Parquet
    folders ``shard=<n>``, each in slot order."""
    n1, n2 = free_name(docs, "k1"), free_name(docs, "k2")
    plan = shard_plan(docs, shards, overhead).select(F.col("k1").alias(n1), F.col("k2").alias(n2), "shard", "slot")
    slots = plan.groupBy(n1, n2).agg(F.collect_list(F.struct("shard", "slot")).alias("places"))
    k1, k2 = row_key(docs)
    placed = (docs.withColumns({n1: k1, n2: k2}).dropDuplicates([n1, n2]).join(slots, [n1, n2])
              .withColumn("place", F.explode("places")).drop(n1, n2, "places"))
    (placed.select(*docs.columns, "place.shard", "place.slot").repartition("shard").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
