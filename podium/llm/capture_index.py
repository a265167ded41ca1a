"""WARC archives and a two-level capture index.

Writing: each page becomes a gzipped WARC record. Of pages with equal payloads
of at least ``least_bytes`` bytes the one with the smallest page_id is a
response, the others are revisits that refer to it. Tasks write archive files
to the shared folder and return a capture line for each record (key, file,
offset, length).

Index: capture lines are sorted by key, the URL with its host reversed
(``http://a.example.com/x`` is ``com,example,a)/x``), and written as gzipped
blocks of ``block_lines`` lines, one index file for each range of keys. Beside
each lies its sparse directory: the first key, offset and length of each
block. The ranges' first and last keys form the top level.

Look-up: a key is routed to its index files by binary search in the top level
(one entry per index file of about a million captures, fewer while there are
less files than shuffle partitions), to its blocks by binary search in that
file's directory; a block is then read by one range read, and each of its
matching captures by another. Keys reach the directories as sorted streams,
and the number of tasks that fetch follows the number of blocks.

Scale: records move once (to meet the first page of their payload), in a join
whose hot keys Spark splits. A URL with a third of all captures spreads over
several ranges and many blocks, and blocks are the unit of work. A task that
is run again writes files of its own under new names; only files named by the
committed capture table are ever read.

Cases: NULL html is an empty payload, NULL url an empty key. Payloads are
equal when their SHA-256 digests are. A NULL page_id is never the first page
if there is another; rows that repeat a page_id with the same payload are both
responses. Empty input gives an empty result.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_path, written

LEAST_BYTES = 100
BLOCK_LINES = 1000
LEAST_LINES, MOST_LINES = 1 << 14, 1 << 20  # about, of an index file
TASK_BLOCKS = 64
FILE_BYTES = 1 << 30
DATE = "1970-01-01T00:00:00Z"  # pages carry no capture date

CAPTURES = "key string, page_id long, file string, offset long, length long"


def url_key(url: str | None) -> str:
    """The sortable key of a URL: host parts reversed, then port, path and
    query; scheme and fragment are left out. No spaces or control characters."""
    url = quote(url or "", safe="%:/?#[]@!$&'()*+,;=~-._|^{}\"<>\\`", encoding="utf-8")
    try:
        parts = urlsplit(url)
        host, port = parts.hostname, parts.port
    except ValueError:
        return url
    if not host:
        return url.partition("#")[0]
    return (",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (parts.path or "/")
            + (f"?{parts.query}" if parts.query else ""))


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page_id(record_id: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+|none)>", record_id)[1]
    return None if found == "none" else int(found)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None,
           revisit: bool) -> bytes:
    """One gzipped WARC record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {DATE}",
            f"WARC-Target-URI: {quote(url or '', safe=chr(37) + ':/?#[]@!$&()*+,;=~')}",
            f"WARC-Payload-Digest: sha256:{digest}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {_record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", compresslevel=1, mtime=0)


def parse_record(member: bytes) -> dict:
    """Type, ids, digest and payload of one gzipped record."""
    raw = zlib.decompress(member, wbits=31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[:int(warc["Content-Length"])].partition(b"\r\n\r\n")
    length = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    digest = warc["WARC-Payload-Digest"].removeprefix("sha256:")
    revisit = warc["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"record {warc['WARC-Record-ID']}: payload does not match its digest")
    return {"page_id": _page_id(warc["WARC-Record-ID"]), "url": warc["WARC-Target-URI"],
            "record_type": warc["WARC-Type"], "payload": payload, "payload_bytes": length, "payload_digest": digest,
            "refers_to": _page_id(warc["WARC-Refers-To"]) if revisit else None}


def write_archives(pages: DataFrame, least_bytes: int = LEAST_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the records; returns the committed captures (key, page_id, file,
    offset, length)."""
    html = F.coalesce(pages["html"], F.lit(""))
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"], html.cast("binary").alias("payload"),
                        F.sha2(html, 256).alias("digest"))
    firsts = (rows.filter(F.octet_length("payload") >= least_bytes).groupBy("digest")
              .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("pages"))
              .filter("pages > 1").drop("pages"))
    rows = rows.join(firsts, "digest", "left")
    folder = shared_path(pages, "warc")
    kind = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()),
                      ("length", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(folder)
        out = name = None
        at = 0
        for batch in batches:
            lines = {c: [] for c in kind.names}
            for page_id, url, payload, digest, first in zip(*(batch.column(c).to_pylist() for c in (
                    "page_id", "url", "payload", "digest", "first_id"))):
                if out is None or at >= file_bytes:
                    if out is not None:
                        out.close()
                    system.create_dir(base, recursive=True)
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{base}/{name}", compression=None)
                revisit = first is not None and page_id != first
                member = record(page_id, url, payload, digest, first, revisit)
                out.write(member)
                for c, v in zip(kind.names, (url_key(url), page_id, name, at, len(member))):
                    lines[c].append(v)
                at += len(member)
            yield pa.RecordBatch.from_pydict(lines, schema=kind)
        if out is not None:
            out.close()

    captures = written(rows.mapInArrow(write, CAPTURES), "captures")
    return captures.withColumn("file", F.concat(F.lit(folder + "/"), "file"))


def build_index(captures: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Write the index files; returns the top level: ``file``, ``directory``,
    ``first_key``, ``last_key``, ``blocks``."""
    order = ["key", "page_id", "file", "offset"]
    folder = shared_path(captures, "capture-index")
    kind = pa.schema([("file", pa.string()), ("directory", pa.string()), ("first_key", pa.string()),
                      ("last_key", pa.string()), ("blocks", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(folder)
        name = uuid.uuid4().hex
        out, at, directory, lines, last = None, 0, [], [], None

        def flush() -> None:
            nonlocal out, at, lines
            if out is None:
                system.create_dir(base, recursive=True)
                out = system.open_output_stream(f"{base}/{name}.cdx.gz", compression=None)
            member = gzip.compress("".join(x for _, x in lines).encode(), mtime=0)
            out.write(member)
            directory.append([lines[0][0], at, len(member)])
            at += len(member)
            lines = []

        for batch in batches:
            for key, page_id, file, offset, length in zip(*(batch.column(c).to_pylist() for c in (
                    "key", "page_id", "file", "offset", "length"))):
                lines.append((key, json.dumps([key, page_id, file, offset, length]) + "\n"))
                last = key
                if len(lines) == block_lines:
                    flush()
        if lines:
            flush()
        if out is not None:
            out.close()
            with system.open_output_stream(f"{base}/{name}.idx") as fh:
                fh.write("".join(json.dumps(x) + "\n" for x in directory).encode())
            yield pa.RecordBatch.from_pylist([{
                "file": f"{folder}/{name}.cdx.gz", "directory": f"{folder}/{name}.idx", "first_key": directory[0][0],
                "last_key": last, "blocks": len(directory)}], schema=kind)

    lines = captures.count()
    files = max(1, -(-lines // MOST_LINES), min(
        int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")), lines // LEAST_LINES))
    return written(captures.repartitionByRange(files, *order).sortWithinPartitions(*order).select(*order, "length")
                   .mapInArrow(write, "file string, directory string, first_key string, last_key string, blocks long"),
                   "capture-ranges")


def blocks_of(keys: list[str], directory: list[list]) -> list[list[str]]:
    """For each block of a sorted directory the (sorted, distinct) keys that
    may lie in it. A key that begins a block may also end the one before."""
    firsts = [d[0] for d in directory]
    wanted: list[list[str]] = [[] for _ in directory]
    for key in keys:
        for b in range(max(0, bisect.bisect_left(firsts, key) - 1), bisect.bisect_right(firsts, key)):
            wanted[b].append(key)
    return wanted


def look_up(urls: DataFrame, ranges: DataFrame) -> DataFrame:
    """All records captured under the keys of ``urls`` (column ``url``), read
    from the archives: ``page_id``, ``url``, ``record_type``, ``payload``,
    ``payload_bytes``, ``payload_digest``, ``refers_to``."""
    found = ranges.collect()
    top = sorted((r["first_key"], r["last_key"], r["file"], r["directory"]) for r in found)
    total, tasks = sum(r["blocks"] for r in found), int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    firsts, lasts = [t[0] for t in top], [t[1] for t in top]

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, k) for k in sorted({url_key(u) for u in batch["url"]})
                    for i in range(bisect.bisect_left(lasts, k), bisect.bisect_right(firsts, k))]
            yield pd.DataFrame(rows, columns=["range", "key"])

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, directory = None, []  # keys come sorted by range: one directory is held at a time
        for batch in batches:
            rows = []
            for at, keys in batch.groupby("range", sort=True)["key"]:
                if at != number:
                    system, path = _open(top[at][3])
                    with system.open_input_stream(path) as fh:
                        number, directory = at, [json.loads(x) for x in fh.read().decode().splitlines()]
                rows += [(at, d[1], d[2], k) for d, k in zip(directory, blocks_of(sorted(keys), directory)) if k]
            yield pd.DataFrame(rows, columns=["range", "offset", "length", "keys"])

    kind = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                      ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                      ("refers_to", pa.int64())])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict[str, pa.NativeFile] = {}

        def read(uri: str, offset: int, length: int) -> bytes:
            if uri not in files:
                system, path = _open(uri)
                files[uri] = system.open_input_file(path)
            return files[uri].read_at(length, offset)

        for batch in batches:
            for row in batch.to_pylist():
                keys = set(row["keys"])
                block = gzip.decompress(read(top[row["range"]][2], row["offset"], row["length"]))
                lines = [x for x in map(json.loads, block.splitlines()) if x[0] in keys]
                for at in range(0, len(lines), 100):
                    yield pa.RecordBatch.from_pylist([parse_record(read(x[2], x[3], x[4])) for x in lines[at:at + 100]],
                                                     schema=kind)
        for fh in files.values():
            fh.close()

    keys = urls.select("url").mapInPandas(route, "range int, key string").distinct()
    blocks = (keys.repartition(max(1, min(len(top), tasks)), "range").sortWithinPartitions("range", "key")
              .mapInPandas(find, "range int, offset long, length long, keys array<string>"))
    return blocks.repartition(max(1, min(total, max(tasks, total // TASK_BLOCKS))), "range", "offset").mapInArrow(
        fetch, "page_id long, url string, record_type string, payload binary, payload_bytes long, "
               "payload_digest string, refers_to long")
