"""Secret scan with a recursive decoding worklist.

Each text is scanned by the base rules. Then its layers are unwrapped: URL
escapes, Unicode escapes (and full-width letters), base64 tokens and what
compression they hold. Each layer found is scanned by the same rules and goes
on the worklist itself, until nothing new turns up; a layer seen before (same
content at the same place) is not opened again, so a layer that decodes to
itself ends. There is no limit on depth.

Every layer carries, for each of its characters, the interval of the original
text it comes from: exact for URL and Unicode escapes, to the base64 characters
that hold a character's bits, and the whole token for compressed content. The
spans reported are those of the original text, in code points.

Bytes that are not clean UTF-8 are read with each invalid byte as one lone
surrogate, so that it can be told again; with NULs among them, as UTF-16 too.
Base64 tokens are tried from each of their first four characters. Compressed
bytes are found anywhere in percent-escaped and base64 tokens.

Scale: one map over the documents, no shuffle. Hostile texts do not make it
quadratic: a long run of one escape is undone whole, escapes nested more than
``STEPS`` deep are undone together in one pass (the result is scanned, the
layers between are not), and bytes that merely look like the beginning of
compressed content are refused without a copy.

Cases: NULL text counts as ''. Texts of any length are scanned whole. What a
compressed layer holds is read as a stream through all compression nested at
its beginning, whatever its size, in pieces of ``max_layer_bytes`` that end at
line ends, where no rule's match can lie. A piece without any line end is cut
inside, with an overlap; as a match or a layer wider than the overlap may then
be missed, it is counted in ``n_unopened``. Compressed content that begins
inside one piece and ends in another is read up to the end of its piece. Rows
that repeat are scanned like others. Empty input gives an empty result.
Columns beyond ``doc_id`` and ``text`` are not read, whatever their names.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import itertools
import lzma
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

MAX_LAYER_BYTES = 1 << 24
OVERLAP = 1 << 16
STEP = 1 << 20
STEPS = 64
ZSTD = b"\x28\xb5\x2f\xfd"
LEAST_BYTES = 12

# The base rules.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.I | re.A)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

# A run of an escape's own first character, escaped again and again ("%252525"),
# is undone whole when long: layer by layer it would take the square of its length.
_url = re.compile(r"(?P<run>%(?:25){8,})|(?:%[0-9A-Fa-f]{2})+")
_unicode = re.compile(r"(?P<run>\\(?:u005[cC]){8,}|\\(?:x5[cC]){8,}|\\(?:u\{5[cC]\}){8,}|\\(?:U0000005[cC]){8,}"
                      r"|%(?:u0025){8,}|&(?:#38;){8,}|&(?:#[xX]26;){8,})|(?:\\u[0-9A-Fa-f]{4}|%u[0-9A-Fa-f]{4})+|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}"
                      r"|\\x[0-9A-Fa-f]{2}|&#[xX][0-9A-Fa-f]{1,6};|&#[0-9]{1,7};|[！-～]")
_base64 = re.compile(r"[A-Za-z0-9+/_-]{12,}={0,2}")
_wrapped = re.compile(r"(?:[A-Za-z0-9+/]{60,76}\r?\n[\x20\t]*)+[A-Za-z0-9+/]+={0,2}")
_form = re.compile(r"(?P<run>\+)|(?:%[0-9A-Fa-f]{2})+")
_nested = re.compile(r"(?:%([0-7][0-9A-Fa-f])|(?:%u00|\\u00|\\u\{|\\x|\\U000000|&\#[xX])([0-7][0-9A-Fa-f])[;}]?|&\#([0-9]{2,3});)\Z")
_closing = frozenset("0123456789abcdefABCDEF;}")
_wrapped_line = re.compile(rb"[A-Za-z0-9+/]{60,76}")
_wide = re.compile(r"[！-～]")
# First bytes of gzip, bzip2, xz, zstd and zlib, with what must follow them: no
# reserved flag, a block's or the end's mark, no reserved flag, a block type.
_block_type = b"".join(re.escape(bytes((x,))) for x in range(256) if x & 6 != 6)
_magic = re.compile(rb"\x1f\x8b\x08[\x00-\x1f]|BZh[1-9](?:1AY&SY|\x17rE8P\x90)|\xfd7zXZ\x00\x00|\x28\xb5\x2f\xfd"
                    rb"|\x78[\x01\x5e\x9c\xda][" + _block_type + rb"]")
_token = re.compile(r'[^\s"<>]+')
_cell = re.compile(r"%[0-9A-Fa-f]{2}|.", re.S)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base rules in a text, sorted."""
    found = []
    lower = text.lower()
    if any(w in lower for w in ASSIGN_WORDS):
        # Failing matches are consumed, as the rule matches greedily and then drops.
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class _Layer:
    """Decoded text (or bytes) with the original interval of each position;
    ``starts`` is None for the original itself."""

    __slots__ = ("content", "starts", "ends", "steps")

    def __init__(self, content, starts=None, ends=None, steps=0):
        self.content, self.starts, self.ends, self.steps = content, starts, ends, steps

    def interval(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.starts is None else (int(self.starts[a]), int(self.ends[b - 1]))

    def maps(self) -> tuple[np.ndarray, np.ndarray]:
        if self.starts is None:
            n = np.arange(len(self.content) + 1)
            return n[:-1], n[1:]
        return self.starts, self.ends

    def key(self) -> tuple:
        raw = self.content.encode("utf-8", "surrogatepass") if isinstance(self.content, str) else self.content
        edges = (0, 0) if self.starts is None or not len(self.starts) else (int(self.starts[0]), int(self.ends[-1]))
        return edges, hashlib.sha256(raw).digest()


def _characters(raw: bytes) -> tuple[str, np.ndarray]:
    """UTF-8 text, invalid bytes as lone surrogates, and the byte at which
    each character begins."""
    text = raw.decode("utf-8", "surrogateescape")
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    escaped = (code >= 0xDC80) & (code <= 0xDCFF)
    width = np.where(escaped, 1, 1 + (code >= 0x80) + (code >= 0x800).astype(np.int64) + (code >= 0x10000))
    return text, np.cumsum(width) - width


_RUNS = {"%": "%", "\\": "\\", "&": "&", "+": " "}


def _settled(layer: _Layer) -> _Layer:
    """The layer with all escapes of ASCII characters undone, and those that
    appear by it, in one pass: a character that completes an escape at the end
    of what is read replaces it, and may complete another."""
    starts, ends = layer.maps()
    out, first, last = [], [], []
    for i, c in enumerate(layer.content):
        a, b = int(starts[i]), int(ends[i])
        out.append(c)
        first.append(a)
        last.append(b)
        while out[-1] in _closing and (m := _nested.search("".join(out[-10:]))):
            code = int(m[3]) if m[3] else int(m[1] or m[2], 16)
            token = m[0]
            if code > 127 or ("{" in token) != token.endswith("}") or (token[0] == "&") != token.endswith(";"):
                break
            at = len(out) - len(token)
            out[at:], first[at:], last[at:] = [chr(code)], [first[at]], [b]
    return _Layer("".join(out), np.array(first, np.int64), np.array(last, np.int64))


def _rewritten(layer: _Layer, pattern: re.Pattern, decode) -> _Layer | None:
    """The layer with each match replaced by what ``decode`` makes of it:
    (text, begin of each character in the match) or None to leave it."""
    text, (starts, ends) = layer.content, layer.maps()
    out, s, e, at = [], [], [], 0
    for m in pattern.finditer(text):
        made = (_RUNS[m[0][0]], [0]) if m["run"] else decode(m[0])
        if made is None or made[0] == m[0]:
            continue
        new, begins = made
        a, b = m.span()
        cuts = np.array([*begins, b - a], np.int64) + a
        out += [text[at:a], new]
        s += [starts[at:a], starts[cuts[:-1]]]
        e += [ends[at:a], ends[cuts[1:] - 1]]
        at = b
    if not out:
        return None
    return _Layer("".join([*out, text[at:]]), np.concatenate([*s, starts[at:]]), np.concatenate([*e, ends[at:]]),
                  layer.steps + 1)


def _from_url(token: str):
    made = _characters(bytes.fromhex(token.replace("%", "")))
    return made[0], 3 * made[1]


def _from_unicode(token: str):
    if len(token) == 1:
        return chr(ord(token) - 0xFEE0), [0]
    if token[:2] in ("\\u", "%u") and token[2] != "{":
        units = [int(token[i + 2:i + 6], 16) for i in range(0, len(token), 6)]
        raw = b"".join(u.to_bytes(2, "little") for u in units)
        text = raw.decode("utf-16-le", "surrogatepass")
        begins, at = [], 0
        for c in text:
            begins.append(6 * at)
            at += 2 if c > "￿" else 1
        return text, begins
    digits = token.strip("\\uUx{}&#X;")
    value = int(digits, 10 if token.startswith("&#") and token[2] not in "xX" else 16)
    return (chr(value), [0]) if value < 0xD800 or 0xDFFF < value < 0x110000 else None


def _coder(raw):
    """A decompressor for what the bytes begin with, or None."""
    if raw[:2] == b"\x1f\x8b" or (raw[:1] == b"\x78" and len(raw) > 2 and (raw[0] * 256 + raw[1]) % 31 == 0):
        return zlib.decompressobj(47)
    if raw[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if raw[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor(lzma.FORMAT_XZ)
    return None


class _Reader:
    """Chunks as a file that can be read."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.held = chunks, b""

    def read(self, n: int) -> bytes:
        self.held = self.held or next(self.chunks, b"")
        part, self.held = self.held[:n], self.held[n:]
        return bytes(part)


def _stream(given: Iterator[bytes]) -> Iterator[bytes]:
    """One layer of compression taken off, in chunks: all members or frames,
    up to the first that can't be read."""
    raw = next(given, b"")
    try:
        if raw[:4] == ZSTD:
            import zstandard

            source = _Reader(itertools.chain((memoryview(raw),), given))
            reader = zstandard.ZstdDecompressor().stream_reader(source, read_across_frames=True)
            while chunk := reader.read(STEP):
                yield chunk
            return
        while True:
            while len(raw) < 6 and (more := next(given, b"")):
                raw = bytes(raw) + bytes(more)
            coder = _coder(raw)
            if coder is None:
                return
            while not coder.eof:
                chunk = coder.decompress(raw, STEP)
                if chunk:
                    yield chunk
                raw = getattr(coder, "unconsumed_tail", b"")
                if not chunk and not raw and not coder.eof:
                    raw = next(given, b"")
                    if not raw:
                        return
            raw = coder.unused_data
            if raw[:1] == b"\0":  # xz pads between streams
                raw = raw.lstrip(b"\0")
    except (zlib.error, OSError, ValueError, lzma.LZMAError, EOFError):
        return
    except Exception as e:
        if type(e).__name__ != "ZstdError":
            raise


def _unpacked(raw: bytes) -> Iterator[bytes]:
    """What lies inside all the compression that bytes begin with, in chunks:
    decompressors chained as streams, so that a layer of any size inside a
    layer of any size is read. Content that repeats itself ends the chain."""
    chunks, seen = _stream(iter((raw,))), set()
    while True:
        head = b""
        while len(head) < STEP and (chunk := next(chunks, b"")):
            head += chunk
        chunks = itertools.chain((head,), chunks)
        if not _is_packed(head) or (key := hashlib.sha256(head).digest()) in seen:
            return chunks
        seen.add(key)
        chunks = _stream(chunks)


def _cut(held: bytes, limit: int) -> int:
    """The last line end in the first ``limit`` bytes that no wrapped base64
    crosses; 0 if there is none."""
    at = limit
    while (at := held.rfind(b"\n", 0, at)) > 0:
        line = held[held.rfind(b"\n", 0, at) + 1:at].strip(b" \t\r")
        if not _wrapped_line.fullmatch(line):
            return at + 1
    return 0


def _pieces(raw: bytes, limit: int) -> Iterator[tuple[bytes, bool]]:
    """What a layer decompresses to, in pieces of at most ``limit`` bytes, and
    whether a piece was cut inside a line."""
    held = bytearray()
    for chunk in _unpacked(raw):
        held += chunk
        while len(held) > limit:
            cut = _cut(held, limit)
            yield bytes(held[:cut or limit]), not cut
            del held[:cut or max(limit - OVERLAP, limit // 2, 1)]
    if held:
        yield bytes(held), False


def _is_packed(raw: bytes) -> bool:
    """Whether bytes are compressed content from the first on. Their text and
    their other alignments would be noise, in which repeats look like keys."""
    return bool(_magic.match(raw)) and next(_stream(iter((raw,))), None) is not None


def _streams(raw: bytes) -> Iterator[int]:
    """Where compressed content begins: the first bytes of a format that its
    decoder takes. Nothing is copied for a place that it refuses."""
    view = memoryview(raw)
    for m in _magic.finditer(raw):
        if next(_stream(iter((view[m.start():],))), None) is not None:
            yield m.start()


def _opened(raw: bytes, starts, ends) -> Iterator[_Layer]:
    """Bytes as layers: what may be compressed, and text."""
    if _is_packed(raw):
        yield _Layer(raw, starts, ends)
        return
    for at in _streams(raw):
        yield _Layer(raw[at:], starts[at:], ends[at:])
    text, begins = _characters(raw)
    edges = np.append(begins, len(raw))
    yield _Layer(text, starts[edges[:-1]], ends[edges[1:] - 1])
    if b"\0" in raw:
        for coding in ("utf-16-le", "utf-16-be"):
            for at in (0, 1):
                n = (len(raw) - at) // 2 * 2
                text = raw[at:at + n].decode(coding, "surrogatepass")
                wide = np.array([c > "\uffff" for c in text], np.int64)
                edges = np.append(0, np.cumsum(2 + 2 * wide)) + at
                if text:
                    yield _Layer(text, starts[edges[:-1]], ends[edges[1:] - 1])


def _packed_escapes(layer: _Layer) -> Iterator[_Layer]:
    """Compressed bytes in percent-escaped tokens."""
    for m in _token.finditer(layer.content):
        if "%" not in m[0]:
            continue
        cells = list(_cell.finditer(m[0]))
        raws = [bytes((int(c[0][1:], 16),)) if len(c[0]) == 3 else c[0].encode("utf-8", "surrogatepass") for c in cells]
        raw = b"".join(raws)
        if not _magic.search(raw):
            continue
        starts, ends = layer.maps()
        of = np.repeat(np.arange(len(cells)), [len(r) for r in raws])
        first = np.array([c.start() for c in cells], np.int64)[of] + m.start()
        last = np.array([c.end() for c in cells], np.int64)[of] + m.start() - 1
        for at in _streams(raw):
            yield _Layer(raw[at:], starts[first[at:]], ends[last[at:]])


def _base64_layers(layer: _Layer) -> Iterator[_Layer]:
    text = layer.content
    maps = None
    tokens = list(_base64.finditer(text))
    if any(m.end() - m.start() >= 60 for m in tokens):
        tokens += _wrapped.finditer(text)
    for m in tokens:
        token = m[0].rstrip("=")
        every = "".join(token.split()).replace("-", "+").replace("_", "/")
        place = np.flatnonzero(np.frombuffer(token.encode("ascii"), np.uint8) > 32) + m.start()
        maps = maps or layer.maps()
        for skip in range(4):
            chars = every[skip:]
            chars = chars[:len(chars) - 1] if len(chars) % 4 == 1 else chars
            raw = binascii.a2b_base64(chars + "=" * (-len(chars) % 4))
            # The shortest match of any rule has twelve characters.
            if len(raw) < LEAST_BYTES:
                continue
            k = np.arange(len(raw)) // 3 * 4 + np.arange(len(raw)) % 3 + skip
            first, last = place[k], place[np.minimum(k + 1, len(place) - 1)]
            yield from _opened(raw, maps[0][first], maps[1][last])
            if _is_packed(raw):
                break


def scan(text: str, max_layer_bytes: int = MAX_LAYER_BYTES) -> tuple[list, list, int, int]:
    """(base spans, all spans, layers opened, layers not opened)."""
    base = base_spans(text)
    found = set(base)
    root = _Layer(text)
    seen, layers, unopened = {root.key()} if "%" in text or "\\" in text else set(), 0, 0

    def within(layer: _Layer) -> Iterator[_Layer | None]:
        nonlocal unopened
        if isinstance(layer.content, bytes):
            whole, refused = layer.interval(0, len(layer.content)), False
            for raw, inside in _pieces(layer.content, max_layer_bytes):
                refused |= inside
                n = len(raw)
                yield from _opened(raw, np.broadcast_to(np.int64(whole[0]), n), np.broadcast_to(np.int64(whole[1]), n))
            unopened += refused
            return
        if layer.steps >= STEPS:
            yield _settled(layer)
            return
        if "%" in layer.content:
            yield _rewritten(layer, _url, _from_url)
            if layer is root and "+" in layer.content:
                yield _rewritten(layer, _form, _from_url)
            yield from _packed_escapes(layer)
        if "\\" in layer.content or "%u" in layer.content or "&#" in layer.content or _wide.search(layer.content):
            yield _rewritten(layer, _unicode, _from_unicode)
        yield from _base64_layers(layer)

    # Depth first, so that one piece of each level is held at a time.
    work = [within(root)]
    while work:
        new = next(work[-1], work)
        if new is work:
            work.pop()
            continue
        if new is None or (key := new.key()) in seen:
            continue
        seen.add(key)
        layers += 1
        if isinstance(new.content, str):
            for a, kind, b in base_spans(new.content):
                start, end = new.interval(a, b)
                found.add((start, kind, end))
        work.append(within(new))
    return base, sorted(found), layers, unopened


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secrets(docs: DataFrame, max_layer_bytes: int = MAX_LAYER_BYTES) -> DataFrame:
    """One row per document: ``doc_id``, ``n_assign``, ``n_access``, ``n_hex``
    (base spans), ``base`` and ``spans`` (kind:start:end, comma-joined, of the
    base rules and of all layers), ``n_layers``, ``n_unopened``."""
    narrow = docs.select(docs["doc_id"], docs["text"])
    schema = (StructType([narrow.schema["doc_id"]]).simpleString()[7:-1].replace(":", " ", 1)
              + ", n_assign long, n_access long, n_hex long, base string, spans string, n_layers long, n_unopened long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                counts, base, spans, layers, unopened = ([], [], []), [], [], [], []
                for text in batch.column("text"):
                    first, every, opened, left = scan(text.as_py() or "", max_layer_bytes)
                    for k in range(3):
                        counts[k].append(sum(1 for x in first if x[1] == k))
                    base.append(joined(first))
                    spans.append(joined(every))
                    layers.append(opened)
                    unopened.append(left)
                longs = [pa.array(x, pa.int64()) for x in (*counts, layers, unopened)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *longs[:3], pa.array(base, pa.string()), pa.array(spans, pa.string()),
                     *longs[3:]],
                    names=["doc_id", "n_assign", "n_access", "n_hex", "base", "spans", "n_layers", "n_unopened"])

    return narrow.mapInArrow(run, schema)
