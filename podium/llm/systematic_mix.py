"""Mixing sources to target weights by systematic sampling (DataFrame
operations only).

Every source gets a target number of words (weights shared out, a source
never above ``cap`` times its own words, the excess shared again by weight).
Within a source each document expects ``target / words of the source`` copies.
The expected copies are prefix-summed over the source's documents, one random
offset is added, and a document is emitted once for each integer the running
sum crosses: floor or ceiling of the expectation, so never more than ``cap``
times. Documents run in order of size, which spreads long and short texts
evenly over the crossings: a source's words miss its target by no more than
about its longest document.

Scale: the prefix sums use range-partitioned totals
(:func:`podium.llm.common.numbered`), so a source with a third of all rows is
spread over many tasks. Sources are numbered the same way, and the shares are
found by a few one-row aggregates over the source table.

Cases: NULL text has size 0 and is taken 0 words; sources without words have
target 0. NULL is a source of its own, last in order. Rows that repeat are
documents of their own. Empty input gives an empty result. The offset depends
on ``seed`` alone, so reruns agree.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, numbered, row_key, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
SEED = 20


def offset(seed: int = SEED) -> float:
    """The one random offset in [0, 1)."""
    return random.Random(seed).random()


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE,
                   cap: int = CAP) -> DataFrame:
    """(source, ordinal, rows_of, source_size, target) from rows with
    ``source`` and ``size``."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows_of"))
    per = numbered(per.withColumn("last", F.col("source").isNull()), ["last", "source"], "mix-sources", ["rows_of"])
    turn = F.expr(f"array({','.join(str(int(w)) for w in weights)})")
    per = written(per.select("source", "source_size", "rows_of", F.col("n").alias("ordinal"), "rows_of_before",
                             F.element_at(turn, (((F.col("n") - 1) % len(weights)) + 1).cast("int")).alias("weight")),
                  "mix-weights")
    total = per.agg(F.sum("source_size").alias("s")).first()["s"] or 0
    # Water level: sources whose cap lies below level * weight are full; what
    # they leave is shared by weight among the others, until none is above.
    level, full = 0.0, -1
    while True:
        at_cap = F.col("source_size") * cap <= F.lit(level) * F.col("weight")
        now = per.agg(F.sum(F.when(at_cap, F.col("source_size") * cap).otherwise(0)).alias("words"),
                      F.sum(F.when(at_cap, 0).otherwise(F.col("weight"))).alias("weight"),
                      F.count(F.when(at_cap, 1)).alias("full")).first()
        if now["full"] == full or not now["weight"]:
            break
        full, level = now["full"], (share * total - now["words"]) / now["weight"]
    return per.withColumn("target", F.least((F.col("source_size") * cap).cast("double"),
                                            F.lit(level) * F.col("weight")))


def copies_plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: int = CAP,
                seed: int = SEED) -> DataFrame:
    """One row per document: ``k1``, ``k2`` (row key), ``doc_id``, ``size``,
    ``source_size``, ``target``, ``copies`` and ``taken`` (words, repeats
    counted)."""
    k1, k2 = row_key(docs)
    sized = written(docs.select(k1.alias("k1"), k2.alias("k2"), docs["doc_id"], docs["source"],
                                F.coalesce(F.regexp_count(docs["text"], F.lit(WORD)), F.lit(0)).cast("long")
                                .alias("size")), "mix-sizes")
    sources = written(source_targets(sized, weights, share, cap), "mix-targets")
    rows = sized.join(sources.withColumnRenamed("source", "of"), sized["source"].eqNullSafe(F.col("of"))).drop("of")
    rows = numbered(rows.select("k1", "k2", "doc_id", "size", "ordinal"),
                    ["ordinal", "size", "doc_id", "k1", "k2"], "mix-order")
    rows = rows.join(sources.select("ordinal", "source_size", "target", "rows_of_before"), "ordinal")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rank = F.col("n") - F.col("rows_of_before")
    crossed = (F.floor(F.lit(offset(seed)) + rank * rate) - F.floor(F.lit(offset(seed)) + (rank - 1) * rate))
    return (rows.withColumn("copies", crossed.cast("long"))
            .select("k1", "k2", "doc_id", "size", "source_size", "target", "copies",
                    (F.col("copies") * F.col("size")).alias("taken")))


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: int = CAP,
          seed: int = SEED) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as the plan takes it."""
    n1, n2, n3 = (free_name(docs, c) for c in ("k1", "k2", "copies"))
    plan = (copies_plan(docs, weights, share, cap, seed).filter("copies > 0")
            .groupBy(F.col("k1").alias(n1), F.col("k2").alias(n2)).agg(F.sum("copies").alias(n3)))
    k1, k2 = row_key(docs)
    # Repeats of a whole row share a key: their copies are emitted from one.
    once = docs.withColumns({n1: k1, n2: k2}).join(plan, [n1, n2]).dropDuplicates([n1, n2])
    each = free_name(docs, "copy")
    return once.withColumn(each, F.explode(F.sequence(F.lit(1), F.col(n3)))).drop(n1, n2, n3, each)
