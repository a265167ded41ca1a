"""Exact top-k search by inner product over an impact-ordered index, score at
a time.

Vectors are dealt into blocks. A block's index holds posting segments: for
each dimension and quantised impact (32 levels of a component's magnitude) the
local numbers and components of the vectors there. A block of queries is
answered level by level, from the highest impact down: every posting of the
level adds its *quantised* component times the query's to the accumulators.
After each round the largest part a query may still be off by is known (what
lies in lower levels of each dimension, and the quantisation of what has been
added). A vector whose accumulator lies further below the k-th one than twice
that can't be a member: that is the proof on which a query stops, once few
vectors are left. All that may still be members are then rescored exactly.

Scale: blocks of vectors and blocks of queries meet in tiles; a tile's memory
is bounded by ``block_rows`` and ``query_rows``. From each tile come at most k
rows per query. Equal rows are counted before they are dealt and dealt by
vec_id and vector, so neither a hot row nor a hot vec_id fills a block. Equal
vectors only make ties, which are kept until rescored.

Cases: vectors that are NULL or hold a NULL or non-finite component take no
part, nor do rows with NULL vec_id. Shorter vectors count as padded with
zeros; an empty vector scores 0. Components beyond a long saturate. A repeated
row (same vec_id, same vector) takes a place for each time it is there, and is
asked for once; different vectors under one vec_id are rows of their own, and
none of them is a candidate of the other. Further columns, whatever their
names, are ignored; a vector of any length is used whole. Fewer
than k candidates: all are returned. Empty input gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SCALE = 256
TOP = 5
EVERY = 50
LEVELS = 32
LEVELS_A_ROUND = 4
BLOCK_ROWS = 4096
QUERY_ROWS = 2048
QUERY_BATCH = 256
EXACT = 2 ** 52  # whole numbers below are exact as doubles


def usable(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the rows that take part, components as whole numbers."""
    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    x = F.transform("embedding", lambda e: e.cast("double"))
    return (vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
            .select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
            .filter(F.forall("x", finite))
            .select("vec_id", F.transform("x", lambda e: F.floor(e * F.lit(float(scale)))).alias("v")))


def _matrix(rows, width: int | None = None) -> np.ndarray:
    width = max((len(r) for r in rows), default=0) if width is None else width
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, :min(len(r), width)] = r[:width]
    return out


def _segments(group: pd.DataFrame) -> pd.DataFrame:
    """The posting segments of one block, and by local number its vec_ids (dim
    -1) and how often each row is there (dim -2)."""
    group = group.sort_values("vec_id", ignore_index=True)
    m = _matrix(group["v"].tolist())
    block = int(group["block"].iat[0])
    none = np.zeros(0, np.int32)
    out = [(block, -1, 0, none, group["vec_id"].to_numpy(np.int64)),
           (block, -2, 0, none, group["copies"].to_numpy(np.int64))]
    size = np.abs(m.astype(np.float64))
    # An impact is the magnitude's place among 32 equal steps up to the block's largest.
    impact = np.minimum(LEVELS - 1, (size * (LEVELS / (size.max(initial=0) + 1))).astype(np.int64))
    for d in range(m.shape[1]):
        held = np.flatnonzero(m[:, d])
        held = held[np.argsort(-impact[held, d], kind="stable")]
        edges = np.flatnonzero(np.diff(impact[held, d], prepend=-1)) if len(held) else []
        for part in np.split(held, edges[1:]) if len(held) else []:
            out.append((block, d, int(impact[part[0], d]), part.astype(np.int32), m[part, d]))
    return pd.DataFrame(out, columns=["block", "dim", "impact", "docs", "components"])


FOUND = ["query_id", "query_key", "vec_id", "score", "copies"]
INDEX = "block long, dim int, impact int, docs array<int>, components array<long>"


def build_index(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, int]:
    """The written index of all distinct rows (vec_id, v, copies), and its
    number of blocks."""
    blocks = max(1, -(-rows.count() // block_rows))
    dealt = rows.withColumn("block", F.expr(f"pmod(xxhash64(vec_id, v), {blocks})"))
    return written(dealt.groupBy("block").applyInPandas(_segments, INDEX), "impact-index"), blocks


def _search_block(index: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best of one block for each query (all that may be, with ties
    broken by smaller vec_id)."""
    ids, copies = (np.asarray(index.loc[index["dim"] == d, "components"].iat[0], np.int64) for d in (-1, -2))
    segments = index[index["dim"] >= 0].sort_values("impact", ascending=False, kind="stable")
    dims, impacts = segments["dim"].to_numpy(), segments["impact"].to_numpy()
    width, n = int(dims.max(initial=-1)) + 1, len(ids)
    exact = np.zeros((n, width), np.int64)
    lengths = [len(x) for x in segments["docs"]]
    docs = np.concatenate([np.asarray(x, np.int64) for x in segments["docs"]]) if len(segments) else np.zeros(0, np.int64)
    comps = np.concatenate([np.asarray(x, np.int64) for x in segments["components"]]) if len(segments) else docs
    dim_of, impact_of = np.repeat(dims, lengths), np.repeat(impacts, lengths)
    exact[docs, dim_of] = comps
    found = []
    q_ids, q_keys = queries["query_id"].to_numpy(np.int64), queries["query_key"].to_numpy(np.int64)
    q_all = _matrix(queries["v"].tolist(), width)
    most = np.abs(exact.astype(np.float64)).max(initial=0)
    for at in range(0, len(q_ids), QUERY_BATCH):
        part = slice(at, at + QUERY_BATCH)
        q, own = q_all[part], q_ids[part]
        if np.abs(q.astype(np.float64)).sum(axis=1).max(initial=0) * most >= EXACT:
            members = ((i, np.arange(n)) for i in range(len(q)))
            wide = True
        else:
            members = _possible(q.astype(np.float64), own, ids, n, width, docs, comps, dim_of, impact_of, k)
            wide = False
        for i, at_most in members:
            at_most = at_most[ids[at_most] != own[i]]
            if wide:
                scores = [sum(int(a) * int(b) for a, b in zip(exact[c], q[i])) for c in at_most]
                scores = np.array([max(-2 ** 63 + 1, min(2 ** 63 - 1, s)) for s in scores], np.int64)
            else:
                scores = (exact[at_most].astype(np.float64) @ q[i].astype(np.float64)).astype(np.int64)
            best = np.lexsort((ids[at_most], -scores))[:k]
            found += [(own[i], q_keys[at + i], ids[at_most[b]], scores[b], copies[at_most[b]]) for b in best]
    return pd.DataFrame(found, columns=FOUND).astype("int64")


def _possible(q, own, ids, n, width, docs, comps, dim_of, impact_of, k):
    """(query, vectors that may be among its k best), level by level."""
    sums = np.zeros((len(q), n))
    mine = [np.flatnonzero(ids == o) for o in own]
    active = np.arange(len(q))
    off = np.zeros(width)  # largest difference of a quantised component, by dimension
    rounds = sorted({int(x) // LEVELS_A_ROUND for x in np.unique(impact_of)}, reverse=True)
    few = max(4 * k, n // 16)
    for r in [*rounds, None]:
        if r is None:
            lower = np.zeros(0, bool)
        else:
            now = impact_of // LEVELS_A_ROUND == r
            lower = impact_of // LEVELS_A_ROUND < r
            # A posting's quantised component: the middle of its dimension's
            # smallest and largest magnitude at that impact, with its sign.
            size = np.abs(comps[now]).astype(np.float64)
            cell = impact_of[now] * width + dim_of[now]
            lo, hi = np.full(LEVELS * width, np.inf), np.zeros(LEVELS * width)
            np.minimum.at(lo, cell, size)
            np.maximum.at(hi, cell, size)
            middle = np.floor((lo[cell] + hi[cell]) / 2)
            added = np.zeros((width, n))
            added[dim_of[now], docs[now]] = np.sign(comps[now]) * middle
            np.maximum.at(off, dim_of[now], np.abs(size - middle))
            sums[active] += q[active] @ added
        rest = off.copy()
        if lower.any():
            np.maximum.at(rest, dim_of[lower], np.abs(comps[lower]).astype(np.float64))
        done = []
        for i in active:
            row = sums[i].copy()
            row[mine[i]] = -np.inf
            slack = 2 * (np.abs(q[i]) @ rest)
            kth = np.partition(row, n - k)[n - k] if n > k else -np.inf
            may = np.flatnonzero(row >= kth - slack) if kth > -np.inf else np.arange(n)
            if r is None or len(may) <= few or not lower.any():
                done.append(i)
                yield i, may
        active = np.setdiff1d(active, done, assume_unique=True)
        if not len(active):
            return


def top_k(vectors: DataFrame, k: int = TOP, every: int = EVERY, scale: int = SCALE, block_rows: int = BLOCK_ROWS,
          query_rows: int = QUERY_ROWS) -> DataFrame:
    """For each row whose vec_id is divisible by ``every`` the k other rows of
    highest inner product: ``query_id``, ``rank`` (from 1), ``vec_id``,
    ``score``; ties go to the smaller vec_id."""
    rows = written(usable(vectors, scale).groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("copies")), "search-vectors")
    index, blocks = build_index(rows, block_rows)
    queries = (rows.filter(F.col("vec_id") % every == 0)
               .select(F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("query_key"), "v"))
    chunks = max(1, -(-queries.count() // query_rows))
    left = index.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
    right = (queries.withColumn("chunk", F.expr(f"pmod(xxhash64(query_id), {chunks})"))
             .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))))

    def search(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(index) or not len(queries):
            return pd.DataFrame(columns=FOUND).astype("int64")
        return _search_block(index, queries, k)

    near = (left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk"))
            .applyInPandas(search, ", ".join(f"{c} long" for c in FOUND))
            .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least("copies", F.lit(k))))))
    order = Window.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    return (near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
