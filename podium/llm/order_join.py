"""N-gram Jaccard self-join by multiple-global-order filtering, and its
connected components.

A document's set holds its distinct word n-grams as 64-bit hashes. Equal sets
form one class; the join runs between classes. If two sets reach the
threshold, then under *any* one order of all tokens the first
``n - ceil(t * n) + 1`` tokens of each (its prefix) have one in common. The
filter uses several orders at once. All put frequent tokens last, so that
passages shared by many documents seldom reach a prefix; among the rest the
first order takes ascending hashes, the others ascending remixed hashes.
Candidates are pairs with a common token in their prefixes under the first
order, at positions that leave the threshold open (none of the tokens before
the first common one is shared, so the overlap is at most what follows it in
either set), and parity bitmaps near enough (the bits in which two bitmaps
differ never outnumber the tokens in which the sets do); then their
prefixes must also meet under every other order, and only then is the overlap
counted, on the n-grams themselves.

The result needs components, not every link inside one. Lists of a common
prefix token with up to ``list_rows`` classes give all their pairs. Longer
lists, such as a large family of near copies makes, first give each member
its pairs with pivots of the list; what is then still in different components
is paired in full, so no link that would join two components is missed.

Scale: only hashes, sizes and bitmaps are shuffled; texts are fetched for
candidates that pass all cheap filters. Equal sets, a third of all rows
perhaps, are one class. Components are found by alternating star contractions
on distributed edges. How many frequent tokens are ranked (``frequent``) and
what may be broadcast (``broadcast_rows``) are bounded parameters that change
the plan, never the result.

Cases: NULL text counts as ''; a document without words has the empty set, is
linked with nothing and is its own component. With fewer words than n, the
whole sequence is the one n-gram. Rows that repeat are documents of their own
with equal sets. NULL doc_id: such a row never names a component unless the
component has no other. Empty input gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import free_name, row_key, written

WORDS = 4
PERCENT = 85
FREQUENT = 1 << 18
FREQUENT_IN_WINDOW = 2  # a window's tokens in so many of its sets are counted as frequent
WINDOW_TOKENS = 4_000_000
LIST_ROWS = 64
ROWS_A_TASK = 100_000  # of tables of two or three numbers a row
PAIRS_A_TASK = 10_000  # with their texts
ORDERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # the further orders' remixing factors
BROADCAST_ROWS = 500_000


class Shingler(dict):
    """n-gram hashes of texts; word hashes are remembered."""

    MOST = 1_000_000

    def __init__(self, words: int):
        self.words = words

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def tokens(self, text: str) -> np.ndarray:
        """The sorted distinct n-gram hashes. Bytes lower only A-Z and split
        at exactly the six white-space characters."""
        said = text.encode("utf-8", "surrogatepass").lower().split()
        n, k = len(said), min(len(said), self.words)
        if not n:
            return np.zeros(0, np.uint64)
        word = np.fromiter(map(self.__getitem__, said), np.uint64, n)
        h = np.full(n - k + 1, k, np.uint64)
        for j in range(k):
            h = (h ^ word[j:j + n - k + 1]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return np.unique(h)


def grams(text: str, words: int) -> set[tuple[bytes, ...]]:
    """The n-grams themselves."""
    said = text.encode("utf-8", "surrogatepass").lower().split()
    k = min(len(said), words)
    return {tuple(said[i:i + k]) for i in range(len(said) - k + 1)} if said else set()


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _parity(tokens: np.ndarray) -> bytes:
    """One bit per cell: whether an odd number of tokens fall in it. A power
    of two of cells, at least one per token."""
    cells = max(64, 1 << (len(tokens) - 1).bit_length())
    odd = np.bincount((tokens >> np.uint64(9)).astype(np.int64) & (cells - 1), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _may_link(a: bytes, b: bytes, n: int, m: int, percent: int) -> bool:
    """False only if the bitmaps prove the Jaccard index below the threshold."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) != len(y):  # halves folded on each other: the same cells, fewer
        if len(x) > len(y):
            x = x[:len(x) // 2] ^ x[len(x) // 2:]
        else:
            y = y[:len(y) // 2] ^ y[len(y) // 2:]
    apart = int(np.bitwise_count(x ^ y).sum())
    # apart <= union - overlap, and overlap + union = n + m
    overlap = (n + m - apart) // 2
    return 100 * overlap >= percent * (n + m - overlap)


def _name(tokens: np.ndarray, salt: int) -> tuple[int, int]:
    """Two 64-bit numbers of a set: its class and a check on it."""
    raw = xxhash.xxh3_128_digest(tokens.tobytes(), seed=salt)
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def document_classes(docs: DataFrame, words: int, salt: int) -> DataFrame:
    """One pass: rows (k1, k2, doc_id, n, cid, check, parity) per document and
    rows (token, seen) of tokens frequent in a window of one task."""
    k1, k2 = row_key(docs)
    narrow = docs.select(k1.alias("k1"), k2.alias("k2"), docs["doc_id"], docs["text"])
    schema = ("k1 long, k2 long, " + StructType([narrow.schema["doc_id"]]).simpleString()[7:-1].replace(":", " ", 1)
              + ", n int, cid long, check long, parity binary, token long, seen long")
    names = ["k1", "k2", "doc_id", "n", "cid", "check", "parity", "token", "seen"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, window, held, known = Shingler(words), [], 0, set()
        kind = pa.int64()

        def frequent() -> pa.RecordBatch:
            token, seen = np.unique(np.concatenate(window), return_counts=True)
            token, seen = token[seen >= FREQUENT_IN_WINDOW], seen[seen >= FREQUENT_IN_WINDOW]
            none = [pa.nulls(len(token), t) for t in (pa.int64(), pa.int64(), kind, pa.int32(), pa.int64(), pa.int64(),
                                                      pa.binary())]
            return pa.RecordBatch.from_arrays([*none, pa.array(token.view(np.int64)), pa.array(seen, pa.int64())],
                                              names=names)

        for whole in batches:
            kind = whole.schema.field("doc_id").type
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                n, cid, check, parity = [], [], [], []
                for text in batch.column("text"):
                    tokens = shingler.tokens(text.as_py() or "")
                    a, b = _name(tokens, salt)
                    n.append(len(tokens))
                    cid.append(a)
                    check.append(b)
                    parity.append(_parity(tokens) if len(tokens) else b"")
                    if len(tokens) and a not in known:
                        known.add(a)
                        window.append(tokens)
                        held += len(tokens)
                        if held >= WINDOW_TOKENS:
                            yield frequent()
                            window, held, known = [], 0, set()
                rows = len(n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("k1"), batch.column("k2"), batch.column("doc_id"), pa.array(n, pa.int32()),
                     pa.array(cid, pa.int64()), pa.array(check, pa.int64()), pa.array(parity, pa.binary()),
                     pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.int64())], names=names)
        if window:
            yield frequent()

    return narrow.mapInArrow(run, schema)


def _frequent_tokens(pass1: DataFrame, most: int) -> np.ndarray:
    """The most frequent tokens, at most ``most`` of them, sorted: all those
    seen at least so often that there are no more."""
    seen = written(pass1.filter("token is not null").groupBy("token").agg(F.sum("seen").alias("seen")), "join-seen")
    least, above = 0, 0
    # One row for each number of times that some token was seen.
    for r in seen.groupBy("seen").agg(F.count(F.lit(1)).alias("tokens")).orderBy(F.col("seen").desc()).toLocalIterator():
        above += r["tokens"]
        if above > most:
            break
        least = r["seen"]
    top = seen.filter(F.col("seen") >= least) if least else seen.limit(0)
    return np.sort(top.select("token").toPandas()["token"].to_numpy(np.int64).view(np.uint64))


def _split(tokens: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens that are not among the frequent ones, and those that are."""
    if not len(frequent):
        return tokens, tokens[:0]
    at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
    is_in = frequent[at] == tokens
    return tokens[~is_in], tokens[is_in]


def _prefix(light: np.ndarray, heavy: np.ndarray, percent: int, factor: int | None) -> np.ndarray:
    """The prefix under one order: light tokens before frequent ones, each in
    order of the hash (factor None) or of the remixed hash."""
    p = prefix_length(len(light) + len(heavy), percent)
    if factor is not None:
        mixed = [(x ^ (x >> np.uint64(32))) * np.uint64(factor) for x in (light, heavy)]
        light, heavy = (x[np.argsort(m, kind="stable")] for x, m in zip((light, heavy), mixed))
    return light[:p] if p <= len(light) else np.concatenate([light, heavy[:p - len(light)]])


def _prefix_rows(docs: DataFrame, words: int, percent: int, salt: int, frequent: np.ndarray) -> DataFrame:
    """(token, cid, n, pos) for each class and each token of its prefix under
    the first order, ``pos`` being its place there; a class that several tasks
    see comes once from each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, known = Shingler(words), set()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                token, cid, n, pos = [], [], [], []
                for text in batch.column("text").slice(at, 500):
                    tokens = shingler.tokens(text.as_py() or "")
                    if not len(tokens):
                        continue
                    a, _ = _name(tokens, salt)
                    if a in known:
                        continue
                    known.add(a)
                    first = _prefix(*_split(tokens, frequent), percent, None)
                    token.append(first.view(np.int64))
                    cid.append(np.full(len(first), a, np.int64))
                    n.append(np.full(len(first), len(tokens), np.int32))
                    pos.append(np.arange(len(first), dtype=np.int32))
                if token:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (token, cid, n, pos)],
                                                     names=["token", "cid", "n", "pos"])

    return docs.select(docs["text"]).mapInArrow(run, "token long, cid long, n int, pos int")


def _open(n: str, i: str, m: str, j: str, percent: int):
    """Whether two sets of n and m tokens can reach the threshold if their
    first common prefix token stands at i and j. False only where it can't: a
    pair above the threshold passes at its first common token."""
    most = F.least(F.col(n) - F.col(i), F.col(m) - F.col(j))
    return most * 100 >= (F.col(n) + F.col(m) - most) * percent


def _filtered(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (x, y) whose bitmaps leave the threshold open."""
    one = classes.select(F.col("cid").alias("x"), F.col("n").alias("n"), F.col("parity").alias("p"))
    two = classes.select(F.col("cid").alias("y"), F.col("n").alias("m"), F.col("parity").alias("q"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [_may_link(*r, percent) for r in zip(*(b.column(c).to_pylist() for c in ("p", "q", "n", "m")))]
            yield pa.RecordBatch.from_arrays([b.column("x"), b.column("y")], names=["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return (pairs.select("x", "y").distinct().join(one, "x").join(two, "y")
            .mapInArrow(run, "x long, y long"))


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, words: int, percent: int,
              frequent: np.ndarray, broadcast_rows: int) -> DataFrame:
    """The linked pairs among written ``pairs`` of classes: prefixes meet under
    every further order, and the n-grams reach the threshold."""
    many = pairs.count()
    pairs = _gathered(pairs, many, PAIRS_A_TASK)
    needed = pairs.select(F.col("x").alias("cid")).union(pairs.select(F.col("y").alias("cid"))).distinct()
    needed = written(classes.join(needed, "cid").select("cid", "k1", "k2"), "join-needed")
    few = needed.count() <= broadcast_rows
    k1, k2 = row_key(docs)
    texts = docs.select(k1.alias("k1"), k2.alias("k2"), docs["text"])
    texts = written(texts.join(F.broadcast(needed) if few else needed, ["k1", "k2"]).dropDuplicates(["cid"])
                    .select("cid", "text"), "join-texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        read: dict[int, tuple] = {}

        def of(cid: int, text: str) -> tuple:
            if cid not in read:
                if len(read) >= 500:
                    read.clear()
                split = _split(shingler.tokens(text or ""), frequent)
                read[cid] = ([_prefix(*split, percent, f) for f in ORDERS], grams(text or "", words))
            return read[cid]

        for b in batches:
            keep = []
            for x, y, s, t in zip(*(b.column(c).to_pylist() for c in ("x", "y", "s", "t"))):
                (fx, gx), (fy, gy) = of(x, s), of(y, t)
                if not all(len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(fx, fy)):
                    keep.append(False)
                    continue
                both = len(gx & gy)
                keep.append(100 * both >= percent * (len(gx) + len(gy) - both))
            yield pa.RecordBatch.from_arrays([b.column("x"), b.column("y")], names=["x", "y"]).filter(pa.array(keep, pa.bool_()))

    texts = _gathered(texts, many, PAIRS_A_TASK)
    one = texts.select(F.col("cid").alias("x"), F.col("text").alias("s"))
    two = texts.select(F.col("cid").alias("y"), F.col("text").alias("t"))
    return written(pairs.join(one, "x").join(two, "y").sortWithinPartitions("x").mapInArrow(run, "x long, y long"),
                   "join-links")


def _gathered(df: DataFrame, rows: int, per_task: int) -> DataFrame:
    """A written table of so many rows, read by as few tasks as that needs."""
    return df.coalesce(max(1, -(-rows // per_task)))


def components(links: DataFrame) -> DataFrame:
    """(cid, comp): for every node of the links (x, y) the smallest node that
    it is connected with. Alternates large-star and small-star steps, each an
    aggregate (combined map-side) and a join whose hot keys Spark splits,
    until the edges stand still as stars."""
    def state(e: DataFrame):
        return e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()

    edges = written(links.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).filter("u <> v")
                    .distinct(), "star-edges")
    last = state(edges)
    while last["n"]:
        edges = _gathered(edges, last["n"], ROWS_A_TASK)
        # Large star: neighbours above u move to the smallest around u.
        both = _gathered(edges.union(edges.select("v", "u")), last["n"], ROWS_A_TASK)
        low = written(both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low")),
                      "star-low")
        low = _gathered(low, last["n"], ROWS_A_TASK)
        edges = written(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
                        .filter("u <> v").distinct(), "star-large")
        edges = _gathered(edges, last["n"], ROWS_A_TASK)
        # Small star: u and its neighbours below move to the smallest of them.
        low = _gathered(written(edges.groupBy("u").agg(F.min("v").alias("low")), "star-low"), last["n"], ROWS_A_TASK)
        moved = edges.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        edges = written(_gathered(moved.union(low.select("u", "low")), last["n"], ROWS_A_TASK)
                        .filter("u <> v").distinct(), "star-small")
        now = state(edges)
        if now == last:
            break
        last = now
    edges = _gathered(edges, last["n"], ROWS_A_TASK)
    return _gathered(edges.select(F.col("u").alias("cid"), F.col("v").alias("comp")).union(
        edges.select(F.col("v").alias("cid"), F.col("v").alias("comp")).distinct()), last["n"], ROWS_A_TASK)


def _long_list_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of each member with the pivots of its lists: one pivot for each
    list and size band, the member with the fewest tokens before this one."""
    pivots = rows.groupBy("token", "band").agg(
        F.min(F.struct("pos", F.xxhash64("token", "cid").alias("c"), "cid", "n")).alias("p"))
    pivots = pivots.select("token", "band", F.col("p.cid").alias("pivot"), F.col("p.n").alias("m"),
                           F.col("p.pos").alias("at"))
    return (rows.withColumn("band", F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)))
            .join(written(pivots, "join-pivots"), ["token", "band"])
            .filter((F.col("cid") != F.col("pivot")) & _open("n", "pos", "m", "at", percent))
            .select(F.least("cid", "pivot").alias("x"), F.greatest("cid", "pivot").alias("y")))


def _rest_of_long_lists(rows: DataFrame, percent: int) -> DataFrame:
    """All pairs of long lists that still lie in different components: the
    members outside a list's largest component, with all others."""
    of = rows.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("rows"))
    main = (of.groupBy("token").agg(F.max(F.struct("rows", "comp")).alias("m"), F.count(F.lit(1)).alias("comps"))
            .filter("comps > 1").select("token", F.col("m.comp").alias("main")))
    rows = written(rows.join(written(main, "join-main"), "token"), "join-rest")
    outside = rows.filter("comp <> main").select(
        "token", F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)).alias("band"),
        F.col("cid").alias("other"), F.col("n").alias("m"), F.col("pos").alias("at"), F.col("comp").alias("other_comp"))
    return (rows.join(outside, ["token", "band"])
            .filter((F.col("comp") != F.col("other_comp")) & _open("n", "pos", "m", "at", percent)
                    & ((F.col("comp") == F.col("main")) | (F.col("cid") < F.col("other"))))
            .select(F.least("cid", "other").alias("x"), F.greatest("cid", "other").alias("y")))


def similar_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, frequent: int = FREQUENT,
                       list_rows: int = LIST_ROWS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per document: ``k1``, ``k2`` (row key), ``doc_id``,
    ``n_shingles``, ``cid`` (class of equal sets) and ``component_id`` (the
    smallest doc_id connected by links, or its own)."""
    salt = 0
    while True:
        pass1 = written(document_classes(docs, words, salt), "join-documents")
        members = pass1.filter("token is null").drop("token", "seen")
        clash = members.groupBy("cid").agg(F.min("check").alias("a"), F.max("check").alias("b")).filter("a <> b")
        if clash.isEmpty():
            break
        salt += 1  # two different sets under one 64-bit name: name them anew
    common = _frequent_tokens(pass1, frequent)
    # Of each class one row: its text is the one that is compared.
    classes = written(members.filter("n > 0").groupBy("cid").agg(F.min(F.struct("k1", "k2", "n", "parity")).alias("c"))
                      .select("cid", "c.*"), "join-classes")

    prefixes = written(_prefix_rows(docs, words, percent, salt, common), "join-prefixes")
    shared = written(prefixes.groupBy("token").agg(F.min("cid").alias("a"), F.max("cid").alias("b"))
                     .filter("a <> b").select("token"), "join-shared")
    rows = prefixes.join(shared, "token").dropDuplicates(["token", "cid"])
    # Sizes within one band or the next can meet; others can't (a band is a
    # hair wider than the ratio, so that rounding can't part them).
    width = -math.log(percent / 100) * (1 + 1e-9) if percent < 100 else 1.0
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(width))
    rows = written(rows.withColumn("band", band.cast("int")), "join-rows")
    lists = written(rows.groupBy("token").agg(F.count(F.lit(1)).alias("members")), "join-lists")
    short = lists.filter(F.col("members") <= list_rows).select("token")
    long = written(rows.join(lists.filter(F.col("members") > list_rows).select("token"), "token"), "join-long")

    a = rows.join(short, "token")
    b = a.select("token", F.col("cid").alias("other"), F.col("n").alias("m"), F.col("pos").alias("at"))
    pairs = (a.join(b, "token").filter((F.col("cid") < F.col("other")) & _open("n", "pos", "m", "at", percent))
             .select(F.col("cid").alias("x"), F.col("other").alias("y")))
    any_long = not long.isEmpty()
    if any_long:
        pairs = pairs.union(_long_list_pairs(long, percent))

    def link(pairs: DataFrame) -> DataFrame:
        near = written(_filtered(pairs, classes, percent), "join-candidates")
        return _verified(near, docs, classes, words, percent, common, broadcast_rows)

    links = link(pairs)
    found = written(components(links), "join-components")
    if any_long:
        by_now = written(long.join(found, "cid", "left").withColumn("comp", F.coalesce("comp", "cid")),
                         "join-long-components")
        more = link(_rest_of_long_lists(by_now, percent))
        if not more.isEmpty():
            found = written(components(links.union(more)), "join-components")
    named = written(members.filter("n > 0").groupBy("cid").agg(F.min("doc_id").alias("least"))
                    .join(found, "cid", "left").withColumn("comp", F.coalesce("comp", "cid")), "join-named")
    ids = written(named.groupBy("comp").agg(F.min("least").alias("component_id")), "join-ids")
    named = written(named.join(ids, "comp").select("cid", "component_id"), "join-names")
    return (members.join(named, "cid", "left")
            .select("k1", "k2", "doc_id", F.col("n").cast("long").alias("n_shingles"), "cid",
                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` (all columns) that stay: of each component the
    document with the smallest doc_id, and every document without words."""
    found = written(similar_components(docs, words, percent), "join-result")
    best = (found.filter("n_shingles > 0").groupBy("component_id")
            .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")).alias("b"))
            .select("b.k1", "b.k2"))
    n1, n2 = free_name(docs, "k1"), free_name(docs, "k2")
    stay = best.union(found.filter("n_shingles = 0").select("k1", "k2"))
    stay = stay.groupBy(F.col("k1").alias(n1), F.col("k2").alias(n2)).agg(F.count(F.lit(1)).alias("times"))
    k1, k2 = row_key(docs)
    kept = docs.withColumns({n1: k1, n2: k2}).join(stay.drop("times"), [n1, n2], "left_semi")
    # Repeats of a whole row share a key: one stays, unless they hold no words.
    words_in = F.regexp_count(F.coalesce(docs["text"], F.lit("")), F.lit(r"[^\x20\x09-\x0D]")) > 0
    return (kept.filter(words_in).dropDuplicates([n1, n2]).unionByName(kept.filter(~words_in))).drop(n1, n2)
