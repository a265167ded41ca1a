"""Exact dedup by deterministic block naming (DataFrame operations only).

A text is cut into blocks of ``block_chars`` characters. The distinct blocks
of the corpus are sorted and named by integers; then adjacent names are paired
and the distinct pairs are sorted and named, halving each document's row of
names, until one name is left. Documents with the same number of blocks and
the same last name hold the same text, and no others do.

Blocks are moved under a 128-bit fingerprint, but identity never rests on it:
the first pass groups the blocks by fingerprint *and content* and counts the
contents of each fingerprint; if two contents ever share one, the pass is
repeated with the next salt. Names of pairs are exact by construction.

Scale: block contents are shuffled once, after a map-side combine that keeps
one copy per task; every later shuffle carries integers. A text shared by a
third of all rows is a hot key only in joins (names to rows), which Spark
splits, and in aggregates, which combine map-side. A long text spreads over
as many rows as it has blocks.

Cases: NULL text counts as ''; all empty texts are equal. Rows that repeat a
(doc_id, text) are members of their group like any others, and exactly one of
them stays. NULL doc_id is smaller than any other. Empty input gives an empty
result. Columns beyond ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, row_key, written

BLOCK_CHARS = 4096


def _blocks(text, block_chars: int):
    """A text's blocks, in order; none for ''. One linear pass of a regular
    expression (substring by position would walk the text once per block)."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0))


def _fingerprint(block, salt: int):
    return F.struct(F.xxhash64(F.lit(2 * salt), block).alias("a"), F.xxhash64(F.lit(2 * salt + 1), block).alias("b"))


def _sorted_names(distinct: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Integer names in sort order of distinct keys. The number is the place
    in a range-partitioned sort; it is fixed once the table is written."""
    return written(distinct.repartitionByRange(*[F.col(k).asc() for k in keys]).sortWithinPartitions(*keys)
                   .withColumn("name", F.monotonically_increasing_id()), name)


def _name_blocks(docs: DataFrame, block_chars: int) -> tuple[DataFrame, int]:
    """(a, b, name) of every distinct block, and the salt under which no two
    block contents share a fingerprint."""
    text = F.coalesce(F.col("text"), F.lit(""))
    for salt in itertools.count():
        contents = (docs.select(F.explode(_blocks(text, block_chars)).alias("block"))
                    .select(_fingerprint(F.col("block"), salt).alias("fp"), "block")
                    .select("fp.a", "fp.b", "block").distinct())
        names = _sorted_names(contents.groupBy("a", "b").agg(F.count(F.lit(1)).alias("contents")), ["a", "b"],
                              "block-names")
        if names.filter("contents > 1").isEmpty():
            return names.drop("contents"), salt


def text_identities(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document: ``row`` (a number for this call), ``k1``, ``k2``
    (row key), ``doc_id``, ``text_sha256``, ``n_blocks`` and ``name``; equal
    (n_blocks, name) if and only if the texts are equal."""
    names, salt = _name_blocks(docs, block_chars)
    text = F.coalesce(docs["text"], F.lit(""))
    k1, k2 = row_key(docs)
    base = written(docs.select(F.monotonically_increasing_id().alias("row"), k1.alias("k1"), k2.alias("k2"),
                               docs["doc_id"], F.sha2(text, 256).alias("text_sha256"),
                               F.transform(_blocks(text, block_chars), lambda b: _fingerprint(b, salt)).alias("fps")),
                   "dedup-rows")
    last = [base.filter(F.size("fps") == 0).select("row", F.lit(0).alias("n_blocks"), F.lit(-1).cast("long").alias("name"))]
    most = base.agg(F.max(F.size("fps")).alias("m")).first()["m"] or 0
    level = written(
        base.select("row", F.size("fps").alias("n_blocks"), F.posexplode("fps").alias("pos", "fp"))
        .select("row", "n_blocks", F.col("n_blocks").alias("left_over"), "pos", "fp.a", "fp.b")
        .join(names, ["a", "b"]).drop("a", "b"), "dedup-level") if most else None
    while most:
        last.append(level.filter("left_over = 1").select("row", "n_blocks", "name"))
        if most == 1:
            break
        pairs = (level.filter("left_over > 1")
                 .groupBy("row", "n_blocks", "left_over", F.expr("pos div 2").cast("int").alias("pos"))
                 .agg(F.max(F.expr("if(pos % 2 = 0, name, null)")).alias("a"),
                      F.coalesce(F.max(F.expr("if(pos % 2 = 1, name, null)")), F.lit(-1)).alias("b")))
        pair_names = _sorted_names(pairs.select("a", "b").distinct(), ["a", "b"], "pair-names")
        level = written(pairs.join(pair_names, ["a", "b"])
                        .select("row", "n_blocks", F.expr("cast((left_over + 1) div 2 as int)").alias("left_over"),
                                "pos", "name"), "dedup-level")
        most = (most + 1) // 2
    identity = last[0]
    for part in last[1:]:
        identity = identity.union(part)
    return base.drop("fps").join(identity, "row")


def exact_copies(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document: ``k1``, ``k2`` (row key), ``doc_id``, ``keep_id``
    (largest doc_id of the equal texts), ``group_size``, ``kept`` (exactly one
    row of each group) and ``text_sha256``."""
    rows = written(text_identities(docs, block_chars), "dedup-identities")
    # Written, so that both sides of the join are plain exchanges, whose hot
    # keys Spark splits.
    groups = written(rows.groupBy("n_blocks", "name").agg(F.count(F.lit(1)).alias("group_size"),
                                                          F.max(F.struct("doc_id", "row")).alias("keep")),
                     "dedup-groups")
    return (rows.join(groups, ["n_blocks", "name"])
            .select("k1", "k2", "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size",
                    (F.col("row") == F.col("keep.row")).alias("kept"), "text_sha256"))


def drop_copies(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` (all columns) that stay: one for each text."""
    kept = exact_copies(docs, block_chars).filter("kept")
    n1, n2 = free_name(docs, "k1"), free_name(docs, "k2")
    k1, k2 = row_key(docs)
    kept = kept.select(F.col("k1").alias(n1), F.col("k2").alias(n2))
    # Repeats of a whole row share a key; one of them stays.
    return (docs.withColumns({n1: k1, n2: k2}).join(kept, [n1, n2], "left_semi")
            .dropDuplicates([n1, n2]).drop(n1, n2))
