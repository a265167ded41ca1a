"""Token ids of a public byte-level BPE vocabulary, for use inside tasks."""

from __future__ import annotations

import base64
import re
from array import array

import public_tokenizers

END_OF_TEXT = "<|endoftext|>"
_LOADED: dict[tuple[str, str], "ByteBpe"] = {}


def byte_bpe(json_path: str | None = None, ranks_path: str | None = None) -> "ByteBpe":
    """The vocabulary at ``json_path`` (tokenizers) and ``ranks_path`` (the
    same vocabulary as ranks); loaded once for each Python worker."""
    key = (json_path or public_tokenizers.path("byte_bpe_50k.json"),
           ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    if key not in _LOADED:
        _LOADED[key] = ByteBpe(*key)
    return _LOADED[key]


class ByteBpe(dict):
    """Encodes texts as the tokenizers library does with
    ``add_special_tokens=False``.

    The vocabulary never joins characters across a space that stands before a
    non-space, so a text is the concatenation of such units. Each distinct
    unit is encoded once and remembered; ordinary units take the faster of
    the two libraries. Units beyond Latin letters, very long units, texts with
    the end-of-text string and texts with spaces before white space go to
    ``tokenizers`` as they are.
    """

    MOST_UNITS = 400_000  # remembered units, then the memory starts anew
    LONGEST_UNIT = 1000
    _unsafe = re.compile(r" (?=\s|\Z)")

    def __init__(self, json_path: str, ranks_path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self._whole = Tokenizer.from_file(json_path)
        with open(ranks_path, "rb") as fh:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, fh)}
        self._ranks = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                        special_tokens={END_OF_TEXT: len(ranks)})

    def __missing__(self, unit: str) -> bytes:
        if len(self) >= self.MOST_UNITS:
            self.clear()
        self[unit] = ids = self._unit(" " + unit)
        return ids

    def _unit(self, text: str) -> bytes:
        if len(text) <= self.LONGEST_UNIT and (text.isascii() or max(text) < "ɐ"):
            return array("I", self._ranks.encode_ordinary(text)).tobytes()
        return array("I", self._whole.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit numbers."""
        if END_OF_TEXT in text or self._unsafe.search(text):
            return array("I", self._whole.encode(text, add_special_tokens=False).ids).tobytes()
        first, *units = text.split(" ")
        return self._unit(first) + b"".join(map(self.__getitem__, units))

    def decode(self, ids) -> str:
        """The text of ids that were encoded from whole strings."""
        return self._ranks.decode_bytes(list(ids)).decode("utf-8")
