"""Merkle manifest of a dataset, checked by a recursive query.

Every row is a leaf: H (lowercase hex sha256 of the inputs one after another)
of its fields, each as its UTF-8 byte count, ``:`` and its value, or ``-`` for
NULL. The leaves of a language, ascending by doc_id, are folded by eights into
nodes until one is left, its subroot; the subroots, ordered by language, are
folded likewise into the root.

The manifest holds the leaves and, level by level, the nodes: each row has the
digests of its members and a link to its parent. A ``WITH RECURSIVE`` query
starts at every leaf with the digest of the row as it is offered (unchanged or
tampered with), follows the links, puts the digest in its place among the
members, hashes, and appends the other members to the proof, up to the root.

Scale: positions come from a distributed sort and prefix sums, and each level
is an aggregation of groups of eight. A leaf climbs within its bucket of 4096
neighbours; the few nodes above are repeated for each bucket below them, so no
join key has more than 4096 rows though all paths meet in one root. The climb
moves a pointer and a digest a level; the proofs meet once at the end. Only
the root and the number of levels reach the driver. All of it is Spark SQL.

Cases: NULL languages are a group of their own, before the others; NULL
doc_ids come first. Rows of one doc_id are ordered by their digest, so rows
that repeat are leaves side by side. An empty proof hashes the empty string; a
single row is leaf, subroot and root. Only A to Z of the text change when a
row is tampered with. Texts of any length are hashed whole. Further columns,
whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 8
BUCKET_LEVELS = 4
BUCKET = FAN ** BUCKET_LEVELS
TOP = -1  # the tree over the subroots
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_NODE = ("tree long, level int, pos long, members binary, digest string, up_tree long, up_level int, up_pos long, "
         "up_place int")

_CLIMB = """
WITH RECURSIVE climb(n, step, bucket, tree, level, pos, place, folded, siblings) AS (
  SELECT n, 0, bucket, up_tree, up_level, up_pos, up_place, offered, CAST(NULL AS BINARY) FROM {leaves}
  UNION ALL
  SELECT c.n, c.step + 1, c.bucket, p.up_tree, p.up_level, p.up_pos, p.up_place,
         sha2(concat(lower(hex(substring(p.members, 1, 32 * c.place))), c.folded,
                     lower(hex(substring(p.members, 32 * c.place + 33)))), 256),
         concat(substring(p.members, 1, 32 * c.place), substring(p.members, 32 * c.place + 33))
  FROM climb c JOIN {nodes} p
    ON c.bucket = p.bucket AND c.tree = p.tree AND c.level = p.level AND c.pos = p.pos)
SELECT n, step, folded, siblings FROM climb
"""


@dataclass
class Manifest:
    """``leaves``: n (from 1), doc_id, lang, leaf, offered, bucket, tree and
    the link to the parent. ``nodes``: the inner nodes, with the digests of
    their members and the link to their parent, those above a bucket once for
    each. ``subroots``: tree, lang, subroot. ``root``: NULL without rows."""
    leaves: DataFrame
    nodes: DataFrame
    subroots: DataFrame
    root: str | None


def leaf_digest(fields: list[Column]) -> Column:
    """H of the fields, as stated above."""
    parts = []
    for c in fields:
        text = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def lower_cased_sample(doc_id: Column, text: Column) -> Column:
    """The text with A to Z in lower case where 3 divides crc32(doc_id)."""
    return F.when(F.crc32(doc_id.cast("string")) % 3 == 0, F.translate(text, UPPER, LOWER)).otherwise(text)


def _parent(top_of_tree: Column, trees: int) -> list[Column]:
    """The link to a node's parent. The node at the top of its tree belongs to
    the tree over the subroots, if there is more than one of them."""
    in_top = F.col("tree") == TOP
    last = in_top | F.lit(trees < 2)
    def link(within: Column, above: Column, kind: str) -> Column:
        return F.when(~top_of_tree, within.cast(kind)).when(~last, above.cast(kind))
    return [link(F.col("tree"), F.lit(TOP), "long").alias("up_tree"),
            link(F.col("level") + 1, F.lit(1), "int").alias("up_level"),
            link(F.expr(f"pos div {FAN}"), F.expr(f"tree div {FAN}"), "long").alias("up_pos"),
            link(F.expr(f"pos % {FAN}"), F.expr(f"tree % {FAN}"), "int").alias("up_place")]


def _levels(base: DataFrame, widest: int, trees: int, name: str) -> list[DataFrame]:
    """The levels above ``base`` (tree, pos, width, digest); ``width`` is how
    many nodes the tree has at that level."""
    found, level = [], 0
    while widest > 1:
        level += 1
        members = F.array_sort(F.collect_list(F.struct("pos", "digest")))
        grouped = (base.filter("width > 1").groupBy("tree", F.expr(f"pos div {FAN}").alias("pos"))
                   .agg(F.max(F.expr(f"(width + {FAN - 1}) div {FAN}")).alias("width"), members.alias("held"))
                   .withColumn("hexes", F.array_join(F.transform("held", lambda x: x["digest"]), ""))
                   .withColumn("level", F.lit(level)))
        base = written(grouped.select("tree", "level", "pos", "width", F.unhex("hexes").alias("members"),
                                      F.sha2("hexes", 256).alias("digest"), *_parent(F.col("width") == 1, trees)),
                       f"merkle-{name}-{level}")
        found.append(base)
        widest = -(-widest // FAN)
    return found


def _per_bucket(nodes: DataFrame, trees: DataFrame) -> DataFrame:
    """Inner nodes with each bucket of leaves below them."""
    low = (nodes.filter(F.col("level") <= BUCKET_LEVELS)
           .withColumn("b", F.expr(f"pos div CAST(pow({FAN}, {BUCKET_LEVELS} - level) AS LONG)")))
    # A higher node's buckets are those of its range of leaves.
    wide = F.expr(f"CAST(pow({FAN}, level - {BUCKET_LEVELS}) AS LONG)")
    high = nodes.filter(F.col("level") > BUCKET_LEVELS).withColumn("from_b", F.col("pos") * wide).withColumn(
        "to_b", F.col("from_b") + wide - 1)
    extent = trees.select(F.col("tree").alias("_tree"), "buckets", "buckets_before")
    low = low.filter(F.col("tree") != TOP).join(extent, F.col("tree") == F.col("_tree"))
    high = (high.filter(F.col("tree") != TOP).join(extent, F.col("tree") == F.col("_tree"))
            .withColumn("b", F.explode(F.sequence("from_b", F.least(F.col("to_b"), F.col("buckets") - 1)))))
    # A node over subroots lies above all buckets of its range of trees.
    span = F.expr(f"CAST(pow({FAN}, level) AS LONG)")
    top = (nodes.filter(F.col("tree") == TOP)
           .withColumn("_tree", F.explode(F.sequence(F.col("pos") * span, (F.col("pos") + 1) * span - 1)))
           .join(extent, "_tree").withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("buckets") - 1))))
    columns = ["tree", "level", "pos", "members", "up_tree", "up_level", "up_pos", "up_place"]
    return reduce(DataFrame.unionByName, [
        df.select((F.col("buckets_before") + F.col("b")).alias("bucket"), *columns) for df in (low, high, top)])


def build(docs: DataFrame, offered: dict[str, Column] | None = None, fields: tuple[str, ...] = FIELDS) -> Manifest:
    """The manifest of ``docs``. ``offered`` names fields that differ in the
    copy of the rows that is to be checked, with their values."""
    spark = docs.sparkSession
    known = [docs[f] for f in fields]
    claimed = [(offered or {}).get(f, docs[f]) for f in fields]
    rows = written(docs.select(docs["doc_id"], docs["lang"], leaf_digest(known).alias("leaf"),
                               leaf_digest(claimed).alias("offered")), "merkle-rows")
    rows = written(numbered(rows, ["lang", "doc_id", "leaf", "offered"], "merkle-ranges"), "merkle-leaves")
    trees = (rows.groupBy("lang").agg(F.count(F.lit(1)).alias("width"), F.min("n").alias("first"))
             .withColumn("buckets", F.expr(f"(width + {BUCKET - 1}) div {BUCKET}")))
    trees = written(numbered(trees, ["lang"], "merkle-languages", ["buckets"]).withColumn("tree", F.col("n") - 1)
                    .drop("n"), "merkle-trees")
    size = trees.agg(F.count(F.lit(1)).alias("trees"), F.max("width").alias("widest")).first()
    n_trees, widest = size["trees"], size["widest"] or 0
    # One row per language, which Spark broadcasts by its size on disk, or else splits a hot language.
    leaves = (rows.join(trees.withColumnRenamed("lang", "_lang"), F.col("lang").eqNullSafe(F.col("_lang")))
              .withColumn("pos", F.col("n") - F.col("first")).withColumn("level", F.lit(0)))
    leaves = written(leaves.select("n", "doc_id", "lang", "leaf", "offered", "tree", "pos", "width",
                                   F.expr(f"buckets_before + pos div {BUCKET}").alias("bucket"),
                                   *_parent(F.col("width") == 1, n_trees)), "merkle-placed")
    levels = _levels(leaves.select("tree", "pos", "width", F.col("leaf").alias("digest")), widest, n_trees, "level")
    ends = [df.filter("width = 1").select("tree", "digest")
            for df in (leaves.withColumnRenamed("leaf", "digest"), *levels)]
    subroots = written(reduce(DataFrame.unionByName, ends).join(trees.select("tree", "lang"), "tree")
                       .select("tree", "lang", F.col("digest").alias("subroot")), "merkle-subroots")
    base = subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("pos"),
                           F.lit(n_trees).cast("long").alias("width"), F.col("subroot").alias("digest"))
    over = _levels(base, n_trees, n_trees, "top")
    nodes = [df.drop("width") for df in (*levels, *over)]
    nodes = reduce(DataFrame.unionByName, nodes) if nodes else spark.createDataFrame([], _NODE)
    last = (over[-1] if over else base).filter("width = 1").select("digest").first()
    return Manifest(leaves, written(_per_bucket(nodes, trees), "merkle-nodes"), subroots,
                    None if last is None else last["digest"])


def climbed(manifest: Manifest) -> DataFrame:
    """(n, step, folded, siblings): each leaf's way to the root."""
    spark = manifest.leaves.sparkSession
    # Spark stops a recursive query at a number of rows unless told not to; here the levels bound it.
    name = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        return written(spark.sql(_CLIMB, leaves=manifest.leaves, nodes=manifest.nodes), "merkle-climb")
    finally:
        spark.conf.set(name, before)


def verified(manifest: Manifest) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for
    each leaf."""
    steps = F.array_sort(F.collect_list(F.when(F.col("step") > 0, F.struct("step", "siblings"))))
    way = (climbed(manifest).groupBy("n")
           .agg(steps.alias("steps"), F.max_by("folded", "step").alias("folded_root"))
           .select("n", "folded_root", F.sha2(F.array_join(F.transform(
               "steps", lambda x: F.lower(F.hex(x["siblings"]))), ""), 256).alias("proof_sha256")))
    root = F.lit(manifest.root).cast("string")
    return (manifest.leaves.select("n", "doc_id", "leaf", "tree").join(way, "n")
            .join(manifest.subroots.select("tree", "subroot"), "tree")
            .select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root",
                    (F.col("folded_root") == root).alias("verified")))
