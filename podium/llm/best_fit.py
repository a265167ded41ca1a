"""Best-fit packing of token sequences, bounded-space and online.

Documents are tokenised (ids of a public vocabulary, then one end id), cut
into window-long pieces only if longer than the window (the first piece takes
the remainder), and the pieces are packed. Pieces reach a packer one by one;
it holds at most ``open_bins`` open sequences. A bitset has one bit for each
amount of free space that some open sequence has: the lowest set bit at or
above a piece's length is its best fit. Where none fits, a new sequence is
opened, and if too many are open the fullest closes first.

Pieces arrive in an order drawn by a hash, so the order of the input does no
harm, and in runs of ``look_ahead`` pieces, each longest first: small pieces
then find the gaps that large ones of their run left.

Scale: tokenising is a map over the input; only piece lengths move on, in one
shuffle. Pieces are dealt by a hash into groups of about ``group_pieces`` (the
number of groups grows with the input). A group is a stream in Spark's sort
order, of which a task holds one run and the open sequences, whatever the
group's size. Pieces that fill a window stand alone and are never shuffled.
The order is fixed by the written pieces, so a task that is run again packs
alike.

Cases: NULL text counts as ''; an empty text is one piece holding the end id.
A text of any length is cut into as many pieces as it takes. Pieces of equal
length arrive in the drawn order; of open sequences with equal free space the
one used last is taken. Rows that repeat are packed like others. NULL doc_id
is kept. Columns beyond ``doc_id`` and ``text`` are not read, whatever their
names. Empty input gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import written
from .token_ids import byte_bpe

WINDOW = 2048
END_ID = 0
OPEN_BINS = 1024
LOOK_AHEAD = 1024
GROUP_PIECES = 65_536

_PIECES = "piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False,
                 json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """One row per piece: ``doc_id``, ``piece``, ``start``, ``length``,
    ``ids_crc32`` and, if asked for, ``ids`` (little-endian unsigned 32-bit)."""
    narrow = docs.select(docs["doc_id"], docs["text"])
    schema = StructType([narrow.schema["doc_id"]]).simpleString()[7:-1].replace(":", " ", 1) + ", " + _PIECES
    schema += ", ids binary" if with_ids else ""
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(json_path, ranks_path)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):  # bounds what one output batch holds
                batch = whole.slice(at, 1000)
                of, piece, start, length, crc, kept = [], [], [], [], [], []
                for i, text in enumerate(batch.column("text")):
                    ids = bpe.encode(text.as_py() or "") + end
                    n = len(ids) // 4
                    edges = [0, *range(n % window or window, n + 1, window)] if n > window else [0, n]
                    for j, (a, b) in enumerate(zip(edges, edges[1:])):
                        part = ids[4 * a:4 * b]
                        of.append(i)
                        piece.append(j)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            kept.append(part)
                columns = {"doc_id": batch.column("doc_id").take(pa.array(of, pa.int64())),
                           "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()),
                           "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
                if with_ids:
                    columns["ids"] = pa.array(kept, pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    return narrow.mapInArrow(cut, schema)


class Packer:
    """Open sequences of one group: lists by free space, and a bitset of the
    amounts of free space that some open sequence has."""

    def __init__(self, window: int, open_bins: int):
        self.window, self.open_bins = window, open_bins
        self.waiting: list[list[int]] = [[] for _ in range(window + 1)]
        self.bits = self.is_open = self.made = self.closed = 0

    def _take(self, free: int) -> int:
        s = self.waiting[free].pop()
        if not self.waiting[free]:
            self.bits &= ~(1 << free)
        return s

    def place(self, n: int) -> tuple[int, int]:
        """The sequence a piece of ``n`` tokens goes to, and its offset."""
        fits = self.bits >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            s = self._take(free)
        else:
            if self.is_open == self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.is_open -= 1
                self.closed += 1
            s, free = self.made, self.window
            self.made += 1
            self.is_open += 1
        left = free - n
        if left:
            self.waiting[left].append(s)
            self.bits |= 1 << left
        else:
            self.is_open -= 1
        return s, self.window - free


def best_fit(lengths, window: int, open_bins: int) -> tuple[list[int], list[int]]:
    """Place pieces in order of arrival; returns each piece's sequence number
    and its offset there."""
    packer = Packer(window, open_bins)
    placed = [packer.place(n) for n in lengths]
    return [s for s, _ in placed], [at for _, at in placed]


def arrivals(lengths: Sequence[int], look_ahead: int = LOOK_AHEAD) -> Iterator[int]:
    """Places in ``lengths`` in the order in which a packer takes them: runs
    of ``look_ahead`` pieces, each longest first."""
    for at in range(0, len(lengths), look_ahead):
        yield from sorted(range(at, min(at + look_ahead, len(lengths))), key=lambda i: -lengths[i])


def packed(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, open_bins: int = OPEN_BINS,
           group_pieces: int = GROUP_PIECES, look_ahead: int = LOOK_AHEAD, with_ids: bool = False,
           json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """One row per piece with its ``sequence_id`` and ``offset``."""
    pieces = written(token_pieces(docs, window, end_id, with_ids, json_path, ranks_path)
                     .withColumn("place", F.monotonically_increasing_id()), "pack-pieces")
    full = (pieces.filter(F.col("length") == window)
            .withColumns({"sequence_id": -F.col("place") - 1, "offset": F.lit(0).cast("long")}).drop("place"))
    short = pieces.filter(F.col("length") < window)
    groups = max(1, -(-short.count() // group_pieces))
    columns = [c for c in pieces.columns if c != "place"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group, packer = [], None, None  # less than one run, of the group being packed

        def run(rows: pa.Table) -> pa.RecordBatch:
            lengths = rows.column("length").to_pylist()
            order = list(arrivals(lengths, look_ahead))
            placed = [packer.place(lengths[i]) for i in order]
            rows = rows.take(pa.array(order, pa.int64())).select(columns).combine_chunks()
            return pa.RecordBatch.from_arrays(
                [*(rows.column(c).combine_chunks() for c in columns),
                 pa.array([(group << 32) + s for s, _ in placed], pa.int64()),
                 pa.array([at for _, at in placed], pa.int64())], names=[*columns, "sequence_id", "offset"])

        for batch in batches:
            of = batch.column("group").to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)] if len(of) else []
            for a, b in zip(edges, edges[1:]):
                if int(of[a]) != group:
                    if held:
                        yield run(pa.Table.from_batches(held))
                    held, group, packer = [], int(of[a]), Packer(window, open_bins)
                while a < b:
                    part = batch.slice(a, min(b - a, look_ahead - sum(x.num_rows for x in held)))
                    a += part.num_rows
                    held.append(part)
                    if sum(x.num_rows for x in held) == look_ahead:
                        yield run(pa.Table.from_batches(held))
                        held = []
        if held:
            yield run(pa.Table.from_batches(held))

    arrival = (short.withColumns({"group": F.expr(f"pmod(xxhash64(place), {groups})"),
                                  "arrival": F.expr("xxhash64(place, 1)")})
               .repartition("group").sortWithinPartitions("group", "arrival", "place")
               .select("group", *columns))
    placed = arrival.mapInArrow(pack, StructType([*(pieces.schema[c] for c in columns),
                                                  StructField("sequence_id", LongType()),
                                                  StructField("offset", LongType())]))
    return full.unionByName(placed)


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pieces that carry ``ids``:
    ``sequence_id``, ``ids`` (concatenated) and ``pieces`` (doc_id, piece,
    offset, length). A sequence is at most one window long."""
    return (pieces.groupBy("sequence_id")
            .agg(F.sort_array(F.collect_list(F.struct("offset", "length", "doc_id", "piece", "ids"))).alias("p"))
            .select("sequence_id",
                    F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
                    F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["piece"].alias("piece"),
                                                        x["offset"].alias("offset"), x["length"].alias("length")))
                    .alias("pieces")))
