"""Chat formatting as a prefix tree of turns.

A conversation is the path of its turns. Conversations that begin with the
same turns share those nodes of the tree; a node's tokens are emitted once,
depth-first, with position ids that continue its parent's and with the
intervals of the emission that it may attend to: its ancestors' and its own.

Template of a turn: ``<|im_start|>role\\ntext<|im_end|>\\n``. A text can't
hold a control string once escaped: each ``\\`` is doubled and ``<|`` becomes
``<\\|``; in a role a line feed becomes ``\\n``. Assistant texts are under
the loss mask.

Depth-first order is the sort order of the paths, each turn hashed. The paths
are range-partitioned (path, then conv_id), so a first turn shared by a third
of all conversations, or copies of one conversation, spread over many tasks.
Each task emits its stream in blocks of at most ``block_tokens`` tokens (a
longer conversation gets a block of its own): a block is one training
sequence, complete in itself, so a new block begins with its first
conversation's whole path. Neighbours are compared by role and text, so equal
hashes can't merge different turns. A conversation is one row of the grouped
table, as a document is.

Cases: NULL role or text counts as ''. Turns are ordered by (turn, role,
text), NULL first; repeated rows are turns of their own. A NULL conv_id is one
conversation. Empty input gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .token_ids import byte_bpe

# Fixed values of the template.
START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"

BLOCK_TOKENS = 32_768

# Rows of a row group at most: conversations, and blocks.
GROUP_PATHS, GROUP_BLOCKS = 256, 4

BLOCKS = ("ids array<int>, positions array<int>, "
          "nodes array<struct<parent:int,start:int,end:int,loss_start:int,loss_end:int,attends:array<int>>>, "
          "conversations array<struct<conv_id:bigint,node:int>>")

_turn = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + r"\n", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text) if "\\" in text else text


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    return [(unescape(m[1]), unescape(m[2])) for m in _turn.finditer(formatted)]


def paths(conversations: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id``, ``roles``, ``texts`` in order
    and ``path``, the hash of each turn."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = (conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
             .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")))
    return turns.select("conv_id", F.col("t.role").alias("roles"), F.col("t.text").alias("texts"),
                        F.transform("t", lambda t: F.xxhash64(t["role"], t["text"])).alias("path"))


class _Block:
    """One sequence under construction."""

    def __init__(self):
        self.ids, self.positions, self.nodes, self.leaves = array("i"), array("i"), [], []

    def add(self, parent: int, pieces: tuple[bytes, bytes, bytes], loss: bool) -> int:
        head, body, tail = (array("i", p) for p in pieces)
        start = len(self.ids)
        above = self.nodes[parent] if parent >= 0 else None
        # The next position id is how many tokens the node may look back on.
        seen = list(above["attends"]) if above else []
        first = sum(b - a for a, b in zip(seen[::2], seen[1::2]))
        end = start + len(head) + len(body) + len(tail)
        if seen and seen[-1] == start:
            seen[-1] = end
        else:
            seen += [start, end]
        for part in (head, body, tail):
            self.ids.extend(part)
        self.positions.extend(range(first, first + end - start))
        at = start + len(head)
        self.nodes.append({"parent": parent, "start": start, "end": end, "loss_start": at if loss else None,
                           "loss_end": at + len(body) if loss else None, "attends": seen})
        return len(self.nodes) - 1

    def row(self) -> dict:
        return {"ids": self.ids, "positions": self.positions, "nodes": self.nodes, "conversations": self.leaves}


def tree_blocks(conversations: DataFrame, block_tokens: int = BLOCK_TOKENS, json_path: str | None = None,
                ranks_path: str | None = None) -> DataFrame:
    """The formatted conversations as tree blocks: ``ids``, ``positions``,
    ``nodes`` (parent, token interval, loss interval, intervals attended to)
    and ``conversations`` (conv_id, last node). Written to the shared folder."""
    sorted_paths = (written(paths(conversations), "chat-paths", GROUP_PATHS)
                    .repartitionByRange(F.col("path").asc(), F.col("conv_id").asc())
                    .sortWithinPartitions("path", "conv_id"))
    kind = pa.schema([
        ("ids", pa.list_(pa.int32())), ("positions", pa.list_(pa.int32())),
        ("nodes", pa.list_(pa.struct([("parent", pa.int32()), ("start", pa.int32()), ("end", pa.int32()),
                                      ("loss_start", pa.int32()), ("loss_end", pa.int32()),
                                      ("attends", pa.list_(pa.int32()))]))),
        ("conversations", pa.list_(pa.struct([("conv_id", pa.int64()), ("node", pa.int32())])))])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(json_path, ranks_path)
        tail = bpe.encode(f"{END}\n")

        def ready(block: _Block) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([block.row()], schema=kind)

        block, above = _Block(), []  # above: (role, text, node) from the root to the last leaf
        for batch in batches:
            for i in range(batch.num_rows):
                turns = list(zip(batch.column("roles")[i].as_py(), batch.column("texts")[i].as_py()))
                shared = 0
                while shared < min(len(turns), len(above)) and above[shared][:2] == turns[shared]:
                    shared += 1
                made = [(bpe.encode(f"{START}{escape_role(r)}\n"), bpe.encode(escape(t)), tail)
                        for r, t in turns[shared:]]
                if block.leaves and len(block.ids) + sum(len(p) // 4 for m in made for p in m) > block_tokens:
                    yield ready(block)
                    made = [(bpe.encode(f"{START}{escape_role(r)}\n"), bpe.encode(escape(t)), tail)
                            for r, t in turns[:shared]] + made
                    block, above, shared = _Block(), [], 0
                del above[shared:]
                for (role, text), pieces in zip(turns[shared:], made):
                    node = block.add(above[-1][2] if above else -1, pieces, role == LOSS_ROLE)
                    above.append((role, text, node))
                block.leaves.append({"conv_id": batch.column("conv_id")[i].as_py(), "node": above[-1][2]})
        if block.leaves:
            yield ready(block)

    return written(sorted_paths.select("conv_id", "roles", "texts").mapInArrow(emit, BLOCKS), "chat-blocks",
                   GROUP_BLOCKS)


def read_back(blocks: DataFrame, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """From the blocks alone, one row per conversation: ``conv_id``,
    ``n_turns``, ``turns_sha256``, ``loss_chars``, ``loss_sha256`` and
    ``formatted_chars``."""
    kind = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                      ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(json_path, ranks_path)
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column("ids")[i].values.to_numpy()
                nodes = batch.column("nodes")[i].as_py()
                # A token's text depends on no token before it, so an interval
                # of whole nodes is decoded once and shared by its conversations.
                text: dict[int, str] = {}
                loss: dict[int, str] = {}
                done: dict[int, dict] = {}
                out = []
                for leaf in batch.column("conversations")[i].as_py():
                    if leaf["node"] not in done:
                        chain, n = [], leaf["node"]
                        while n >= 0:
                            chain.append(n)
                            n = nodes[n]["parent"]
                        for n in chain:
                            if n not in text:
                                node = nodes[n]
                                text[n] = bpe.decode(ids[node["start"]:node["end"]].tolist())
                                loss[n] = ("" if node["loss_start"] is None else
                                           unescape(bpe.decode(ids[node["loss_start"]:node["loss_end"]].tolist())))
                        formatted = "".join(text[n] for n in reversed(chain))
                        masked = "".join(loss[n] for n in reversed(chain))
                        turns = parse(formatted)
                        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                        done[leaf["node"]] = {
                            "n_turns": len(turns), "turns_sha256": hashlib.sha256(whole.encode()).hexdigest(),
                            "loss_chars": len(masked), "loss_sha256": hashlib.sha256(masked.encode()).hexdigest(),
                            "formatted_chars": len(formatted)}
                    out.append({"conv_id": leaf["conv_id"], **done[leaf["node"]]})
                yield pa.RecordBatch.from_pylist(out, schema=kind)

    return blocks.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                                   "loss_sha256 string, formatted_chars long")
