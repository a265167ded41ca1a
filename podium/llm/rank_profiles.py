"""Language identification by rank-order profiles.

Each language's profile is the list of its most frequent letter n-grams (one
to three letters, words set apart by one blank), the most frequent first. A
document's own most frequent n-grams are ranked alike and compared with every
profile by the out-of-place distance: for each n-gram of the document the
difference of the two ranks, or ``most`` if the profile lacks it. The nearest
profile names the language; ``score`` is 1 - d1 / d2, how much nearer it is
than the next (1.0 where there is one profile only).

Scale: counting is one map over the learnt rows whose tasks add up their own
counts, so that a row per task, language and n-gram is shuffled, however many
documents a language has; the best ``most`` of a language are picked behind a
partial top-k. Scoring is one map over the documents. What the tasks get is
languages x ``most`` ranks; the number of languages is checked against
``most_languages`` and more are an error, never cut.

Cases: letters are Unicode letters and the marks that go with them, in lower
case; everything else parts words. A NULL text, or one without any letter, is
``und`` with score 0.0; without learnt rows every text is. A NULL lang is not
learnt. Ties between n-grams go to the shorter one, then by code points; ties
between languages to the first by code points. Whole texts count, long ones in
pieces of 2^20 letters that overlap, so that memory follows the distinct
n-grams. Rows that repeat are learnt as often and get equal results. Further
columns, whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

MOST = 400
MOST_LANGUAGES = 4096
FOLDS, HELD_OUT = 3, 1
UNKNOWN = "und"
BLANK = 32
PIECE = 1 << 20
_KINDS: list[np.ndarray] = []


def _kinds() -> np.ndarray:
    """For each code point 2 for a letter, 1 for a mark, 0 for the rest;
    worked out once for each Python worker."""
    if not _KINDS:
        kinds = {"L": 2, "M": 1}
        _KINDS.append(np.array([kinds.get(unicodedata.category(chr(c))[0], 0) for c in range(sys.maxunicode + 1)],
                               np.uint8))
    return _KINDS[0]


def letters(text: str) -> np.ndarray:
    """The words of a text as code points in lower case, a blank before, after
    and between words; empty without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _kinds()[codes]
    if not (kind == 2).any():
        return np.zeros(0, np.int64)
    word = np.append(kind > 0, False)
    # Of the signs behind a word, the first stands as its blank.
    keep = word.copy()
    keep[1:] |= word[:-1]
    at = np.flatnonzero(keep)
    out = np.full(len(at) + 1, BLANK, np.int64)
    out[1:][word[at]] = codes[at[word[at]]]
    return out


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Several counts (sorted n-grams, numbers) as one."""
    if len(parts) == 1:
        return parts[0]
    grams, place = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    total = np.zeros(len(grams), np.int64)
    np.add.at(total, place, np.concatenate([n for _, n in parts]))
    return grams, total


def counted(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of :func:`letters`, ascending, and how often each
    occurs. An n-gram is its code points in 21 bits each, so that a shorter
    one comes before a longer one; blanks stand at its ends only."""
    parts = []
    for start in range(0, max(len(symbols), 1), PIECE):
        s = symbols[start:start + PIECE + 2]
        n = min(PIECE, len(symbols) - start)
        one, two, three = s[:n], s[:-1][:n], s[:-2][:n]
        pair = (two << 21) | s[1:][:n]
        inner = s[1:-1][:n] != BLANK
        parts.append(np.unique(np.concatenate([
            one[one != BLANK], pair, (pair[:len(three)][inner] << 21) | s[2:][:n][inner]]), return_counts=True))
    return _added(parts)


def _top(grams: np.ndarray, n: np.ndarray, most: int) -> np.ndarray:
    return grams[np.argsort(-n, kind="stable")[:most]]


def profiles(docs: DataFrame, lang: str = "lang", most: int = MOST) -> DataFrame:
    """(lang, rank from 0, gram, code, n): the ``most`` most frequent n-grams
    of each language over all texts of ``docs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        waiting: dict[str, list[np.ndarray]] = {}
        size: dict[str, int] = {}

        def settle(name: str) -> None:
            # Each text begins and ends with a blank: no n-gram spans two.
            new = counted(np.concatenate(waiting.pop(name)))
            del size[name]
            blanks = new[0] == (BLANK << 21 | BLANK)
            new = (new[0][~blanks], new[1][~blanks])
            held[name] = _added([held[name], new]) if name in held else new

        def rows() -> Iterator[pa.RecordBatch]:
            for name in sorted(held):
                grams, n = held.pop(name)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(grams), pa.string()), pa.array(grams), pa.array(n)],
                    names=["lang", "code", "n"])

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                symbols = letters(text.as_py() or "")
                if not len(symbols):
                    continue
                waiting.setdefault(name, []).append(symbols)
                size[name] = size.get(name, 0) + len(symbols)
                if size[name] > PIECE:
                    settle(name)
                    if sum(len(g) for g, _ in held.values()) > 4 * PIECE:
                        yield from rows()
        for name in list(waiting):
            settle(name)
        yield from rows()

    texts = docs.select(docs[lang].alias("lang"), docs["text"]).filter("lang IS NOT NULL AND text IS NOT NULL")
    total = (texts.mapInArrow(count, "lang string, code long, n long")
             .groupBy("lang", "code").agg(F.sum("n").alias("n")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    best = total.withColumn("rank", rank - 1).filter(F.col("rank") < most)
    parts = [F.shiftright("code", 42), F.shiftright("code", 21).bitwiseAND(F.lit(0x1FFFFF)),
             F.col("code").bitwiseAND(F.lit(0x1FFFFF))]
    # A code point as text: its four bytes in UTF-32.
    gram = F.concat(*[F.when(c == 0, F.lit("")).otherwise(
        F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32")) for c in parts])
    return best.select("lang", "rank", gram.alias("gram"), "code", "n")


class Profiles:
    """Profiles as a task needs them: a rank for each language and n-gram."""

    def __init__(self, rows: list, most: int = MOST):
        self.most = most
        self.names = sorted({r["lang"] for r in rows})
        self.grams = np.array(sorted({r["code"] for r in rows}), np.int64)
        self.ranks = np.full((len(self.names), len(self.grams)), -1, np.int64)
        at = {name: i for i, name in enumerate(self.names)}
        if rows:
            self.ranks[[at[r["lang"]] for r in rows], np.searchsorted(self.grams, [r["code"] for r in rows])] = [
                r["rank"] for r in rows]

    def distances(self, grams: np.ndarray) -> np.ndarray:
        """Out-of-place distance of ranked n-grams to each language."""
        place = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        there = self.ranks[:, place]
        known = (self.grams[place] == grams) & (there >= 0)
        return np.where(known, np.abs(there - np.arange(len(grams))), self.most).sum(axis=1)

    def predict(self, text: str | None) -> tuple[str, float]:
        symbols = letters(text or "")
        if not len(symbols) or not self.names:
            return UNKNOWN, 0.0
        d = self.distances(_top(*counted(symbols), self.most))
        best = int(d.argmin())
        if len(d) == 1:
            return self.names[0], 1.0
        second = int(np.delete(d, best).min())
        return self.names[best], 1.0 - int(d[best]) / second if second else 0.0


def held_out(doc_id):
    """Whether a doc_id belongs to the fold that is never learnt from; a NULL
    doc_id does not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def fit(docs: DataFrame, most: int = MOST, most_languages: int = MOST_LANGUAGES) -> Profiles:
    """Profiles of the languages of ``docs``, learnt from all rows outside the
    held-out fold (rows without a doc_id belong to no fold and are left out)."""
    learnt = docs.filter(docs["doc_id"].isNotNull() & ~held_out(docs["doc_id"]))
    found = written(profiles(learnt, "lang", most), "language-profiles")
    n = found.filter("rank = 0").count()
    if n > most_languages:
        raise ValueError(f"{n} languages; the profiles of at most {most_languages} are sent to the tasks")
    return Profiles(found.select("lang", "rank", "code").collect(), most)


def identified(docs: DataFrame, fitted: Profiles) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                found = [fitted.predict(text.as_py()) for text in batch.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([f[0] for f in found], pa.string()),
                     pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(docs["doc_id"], docs["text"]).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
