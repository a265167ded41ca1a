"""Ranked lexical search by a hybrid of term- and document-at-a-time.

The index holds blocks of documents; a block has its documents' lengths and,
for each of its terms, the list of (document, occurrences). Searching a block,
a query's short lists are worked first, term at a time: their contributions
are summed into one accumulator per document, and the accumulators are from
then on one iterator with known bounds. The long lists follow document at a
time, in windows of neighbouring documents: the largest contribution of each
list in each window and the largest accumulator bound what a document there
can reach. Windows are visited by falling bound, and those below the score to
beat are skipped with all their postings. Inside a window the lists are taken by falling bound, and documents
that the rest cannot lift are dropped. The score to beat is the query's k-th
best so far: from some first blocks, then from the task's own earlier blocks.

Terms are the maximal runs of ASCII letters and digits and of all characters
beyond ASCII, with A to Z in lower case. Scores are integers, see
:func:`impacts`.

Scale: indexing is one map over the documents and searching one map over the
blocks; only totals, one row per block and query term, and each task's best k
of a query are shuffled. Queries go to the tasks in chunks of at most
``CHUNK_CHARS`` characters (and one query), however many there are, each with
one pass over the index.

Cases: NULL and empty texts have no terms; such documents are not counted and
such queries give no rows. Equal scores are ordered by doc_id, NULL last.
Documents that repeat are ranked one by one; queries of equal item_id and text
are one, those of one item_id and different texts are each answered. A text of
any length is indexed whole; a block ends with the document that fills it. An
empty index or query table gives no rows. Further columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, written

K = 10
BLOCK_DOCS = 4096
BLOCK_TERMS = 1 << 21
WINDOW = 64
LONG_SHARE = 16  # a list of more than 1 in so many of a block's documents is long
CHUNK_CHARS = 1 << 22
GROUP_BLOCKS = 1  # in a row group of a written index: a reader holds all of its lists at once

# Fixed values of the score.
SCALE, STEP, LENGTH_PERCENT = 1_000_000_000, 1000, 75
_SIGNS = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()

INDEX = ("n_docs long, n_terms long, doc_ids array<long>, lengths array<long>, terms array<string>, ends array<int>, "
         "docs array<int>, tfs array<int>")


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text, with repeats, in UTF-8. All bytes of characters
    beyond ASCII are above 0x7F, so runs of bytes are runs of characters."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_SIGNS).split(b" ") if text else []


def _counted(text: str | None) -> Counter:
    found = Counter(terms_of(text))
    found.pop(b"", None)
    return found


class _Block:
    """Documents of a block while it is filled."""

    def __init__(self):
        self.vocabulary: dict[bytes, int] = {}
        self.doc_ids, self.lengths, self.terms, self.tfs, self.sizes = [], [], [], [], []
        self.n_terms = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        found, known = _counted(text), self.vocabulary
        length = sum(found.values())
        self.doc_ids.append(doc_id)
        self.lengths.append(length)
        self.terms.extend([known.setdefault(t, len(known)) for t in found])
        self.tfs.extend(found.values())
        self.sizes.append(len(found))
        self.n_terms += length

    def row(self) -> pa.RecordBatch:
        names = sorted(self.vocabulary)
        place = np.empty(len(names), np.int64)
        place[[self.vocabulary[t] for t in names]] = np.arange(len(names))
        term = place[np.array(self.terms, np.int64)]
        order = np.argsort(term, kind="stable")  # documents stay ascending in each list
        docs = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)[order]
        ends = np.cumsum(np.bincount(term, minlength=len(names))).astype(np.int32)
        lengths = np.array(self.lengths, np.int64)

        def one(values, kind) -> pa.Array:
            flat = pa.array(values, kind)
            return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)

        return pa.RecordBatch.from_arrays(
            [pa.array([int((lengths > 0).sum())], pa.int64()), pa.array([self.n_terms], pa.int64()),
             one(self.doc_ids, pa.int64()), one(lengths, pa.int64()), one([t.decode() for t in names], pa.string()),
             one(ends, pa.int32()), one(docs, pa.int32()), one(np.array(self.tfs, np.int32)[order], pa.int32())],
            names=["n_docs", "n_terms", "doc_ids", "lengths", "terms", "ends", "docs", "tfs"])


def index(docs: DataFrame, block_docs: int = BLOCK_DOCS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The index of all ``docs`` (doc_id, text), one row per block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block()
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                block.add(doc_id.as_py(), text.as_py())
                if len(block.sizes) >= block_docs or block.n_terms >= block_terms:
                    yield block.row()
                    block = _Block()
        if block.sizes:
            yield block.row()

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, INDEX)


def impacts(tfs: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What an occurrence count is worth in a document of some length, before
    the term's weight: 10^9 tf div (1000 tf + 8 m), where m = 25 + (75 n N) div
    L. In 64-bit integers."""
    m = 100 - LENGTH_PERCENT + (LENGTH_PERCENT * lengths * n_docs) // max(n_terms, 1)
    return (SCALE * tfs) // (STEP * tfs + 8 * m)


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Lists:
    """The lists of one block that a set of queries may need."""

    def __init__(self, row: dict, wanted: pa.Array, n_docs: int, n_terms: int, window: int = WINDOW,
                 long_share: int = LONG_SHARE):
        self.doc_ids, self.size, self.window = row["doc_ids"], len(row["doc_ids"]), window
        self.windows = -(-self.size // window)
        self.at: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.long: dict[str, tuple[np.ndarray, np.ndarray]] = {}  # where each window starts, its largest impact
        terms, ends = row["terms"], row["ends"]
        for i in np.flatnonzero(pc.is_in(terms, wanted).to_numpy(zero_copy_only=False)):
            term = terms[i].as_py()
            start, end = int(ends[i - 1]) if i else 0, int(ends[i])
            docs = row["docs"][start:end]
            worth = impacts(row["tfs"][start:end].astype(np.int64), row["lengths"][docs], n_docs, n_terms)
            self.at[term] = docs, worth
            if len(docs) * long_share > self.size:
                starts = np.searchsorted(docs, np.arange(self.windows + 1) * window)
                held = starts[1:] > starts[:-1]
                top = np.zeros(self.windows, np.int64)
                top[held] = np.maximum.reduceat(worth, starts[:-1][held])
                self.long[term] = starts, top


def best_of_block(lists: Lists, query: dict[str, int], k: int, best: list[tuple], least: int) -> tuple[list[tuple], int]:
    """The best ``k`` of ``best`` and the block, as (-score, doc_id is NULL,
    doc_id), and how many postings were read. ``query`` gives each term's
    weight times its occurrences. Documents below ``least`` may be left out:
    k documents are known to reach it."""
    read = 0
    # Short lists, term at a time.
    held = np.zeros(lists.windows * lists.window, np.int64)
    long = []
    for term, w in query.items():
        if w and term in lists.at:
            if term in lists.long:
                long.append((term, w))
            else:
                docs, worth = lists.at[term]
                held[docs] += w * worth
                read += len(docs)
    bounds = held.reshape(lists.windows, lists.window).max(axis=1)
    tops = [w * lists.long[t][1] for t, w in long]
    bounds = reduce(np.add, tops, bounds)
    least = max(least, 1, -best[-1][0] if len(best) >= k else 0)
    # Long lists, document at a time, window by window.
    open_windows = np.flatnonzero(bounds >= least)
    for at in open_windows[np.argsort(-bounds[open_windows], kind="stable")]:
        if bounds[at] < least:
            break
        lo = int(at) * lists.window
        score = held[lo:lo + lists.window].copy()
        rest = sum(int(top[at]) for top in tops)
        for i in sorted(range(len(long)), key=lambda i: -tops[i][at]):
            if not tops[i][at]:
                break
            alive = score + rest >= least
            if not alive.any():
                break
            rest -= int(tops[i][at])
            term, w = long[i]
            docs, worth = lists.at[term]
            starts = lists.long[term][0]
            part = slice(starts[at], starts[at + 1])
            score[docs[part] - lo] += w * worth[part]
            read += part.stop - part.start
        found = np.flatnonzero(score >= least)
        if len(found):
            best = best + [(-int(score[i]), (d := lists.doc_ids[lo + i]) is None, d or 0) for i in found]
            best = sorted(best)[:k]
            if len(best) == k:
                least = max(least, -best[-1][0])
    return best, read


def _row(batch: pa.RecordBatch, i: int) -> dict:
    def numbers(name: str) -> np.ndarray:
        return batch.column(name)[i].values.to_numpy(zero_copy_only=False)
    return {"doc_ids": batch.column("doc_ids")[i].as_py(), "lengths": numbers("lengths").astype(np.int64),
            "terms": batch.column("terms")[i].values, "ends": numbers("ends"), "docs": numbers("docs"),
            "tfs": numbers("tfs")}


def _frequencies(blocks: DataFrame, wanted: set[str]) -> dict[str, int]:
    """In how many documents each wanted term is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        asked = pa.array(sorted(wanted), pa.string())
        for batch in batches:
            for i in range(batch.num_rows):
                terms, ends = batch.column(0)[i].values, batch.column(1)[i].values.to_numpy(zero_copy_only=False)
                there = pc.is_in(terms, asked)
                sizes = np.diff(ends, prepend=0)[there.to_numpy(zero_copy_only=False)]
                total.update(dict(zip(terms.filter(there).to_pylist(), sizes.tolist())))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())],
                                         names=["term", "df"])

    found = blocks.select("terms", "ends").mapInArrow(run, "term string, df long")
    return {r["term"]: r["df"] for r in found.groupBy("term").agg(F.sum("df").alias("df")).collect()}


def _searched(blocks: DataFrame, queries: list[tuple[int, dict[str, int]]], n_docs: int, n_terms: int, k: int,
              least: dict[int, int]) -> DataFrame:
    """(q, doc_id, score): for each task and query its best k at most."""
    wanted = {t for _, query in queries for t in query}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple]] = {q: [] for q, _ in queries}
        asked = pa.array(sorted(wanted), pa.string())
        for batch in batches:
            for i in range(batch.num_rows):
                lists = Lists(_row(batch, i), asked, n_docs, n_terms)
                for q, query in queries:
                    best[q], _ = best_of_block(lists, query, k, best[q], least.get(q, 0))
        rows = [(q, None if null else d, -s) for q, found in best.items() for s, null, d in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(3)],
                                         names=["q", "doc_id", "score"])

    return blocks.mapInArrow(run, "q long, doc_id long, score long")


def search(blocks: DataFrame, items: DataFrame, k: int = K, chunk_chars: int = CHUNK_CHARS,
           look_ahead: bool = True) -> DataFrame:
    """(item_id, rank from 1, doc_id, score): the best ``k`` documents of an
    index for each row of ``items`` (item_id, text). ``blocks`` is a written
    :func:`index`. With ``look_ahead`` the blocks of its first file are searched
    beforehand for scores to beat."""
    spark = blocks.sparkSession
    asked = items.select(items["item_id"], items["text"]).filter("text IS NOT NULL").distinct()
    asked = written(numbered(asked.withColumn("size", F.length("text").cast("long")), ["item_id", "text"],
                             "search-items", ["size"]), "search-queries")
    total = blocks.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("t")).first()
    last = asked.agg(F.max("size_before").alias("m")).first()["m"]
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    parts = [spark.createDataFrame([], "q long, doc_id long, score long")]
    for chunk in range(0 if last is None or not total["n"] else last // chunk_chars + 1):
        # Bounded: at most chunk_chars characters and one more query.
        rows = asked.filter(F.expr(f"size_before div {chunk_chars} = {chunk}")).select("n", "text").collect()
        counts = {r["n"]: {t.decode(): c for t, c in _counted(r["text"]).items()} for r in rows}
        df = _frequencies(blocks, {t for c in counts.values() for t in c})
        queries = [(q, {t: n * weight(df[t], total["n"]) for t, n in c.items() if t in df})
                   for q, c in sorted(counts.items())]
        least = {}
        if look_ahead:
            # A document's score is a proof for its query, whichever blocks come first.
            ahead = _searched(spark.read.schema(blocks.schema).parquet(min(blocks.inputFiles())), queries, total["n"],
                              total["t"], k, {})
            least = {r["q"]: r["least"] for r in ahead.withColumn("rank", rank).filter(F.col("rank") == k)
                     .select("q", F.col("score").alias("least")).collect()}
        parts.append(written(_searched(blocks, queries, total["n"], total["t"], k, least), "search-found"))
    found = reduce(DataFrame.union, parts).withColumn("rank", rank).filter(F.col("rank") <= k)
    return (found.join(asked.select(F.col("n").alias("q"), "item_id"), "q")
            .select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
