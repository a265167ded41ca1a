"""Toxicity with noisy-channel deobfuscation.

A character language model (trigrams over 28 classes: word boundary, a to z,
other letters) is counted over all documents. Tokens that look disguised (signs
or digits among letters, doubled letters, letters set apart by separators or by
any blanks) are read as a lattice: each observed character may stand for
itself, for the letters it resembles, or for nothing (a repeat, a separator),
and a separator for a word boundary, each at a cost. A Viterbi pass finds the
likeliest original under the language model, of one or several words, and the
restored text is scored. Signs at the edges of a token are read both as
punctuation and as letters, doubled letters both as they are and as one, and
letters set apart as one word, as the words that the model finds in them, and
as a word that begins at any of them.

The score is a logistic regression over words and word beginnings (4 to 8
letters) of the restored text. It is fitted on at most ``max_rows`` labelled
documents (the first in the order of a hash of doc_id), one of each family of
near copies (connected by a Jaccard index of 0.8 or more over five-word
shingles, compared exactly, or equal texts) and label, so that the private words of a text copied often do not become
evidence. Rows whose crc32(doc_id) mod 3 is 1 are held out of the fit. Labels,
lang, source and doc_id never enter a score.

Scale: counting the model and scoring are maps over the documents; what moves
is bounded (trigram counts, the training sample, 4096 features), but for the
join of near copies among the labelled documents (see ``order_join``).

Cases: NULL text counts as ''; an empty text gets the score of a text without
evidence. NULL doc_id is never labelled and counts as not held out. A doc_id
labelled twice is toxic if one label says so. Without labels of both kinds the
score is the share of toxic labels (0 without any). Rows that repeat get equal
scores. Empty input gives an empty result.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Container, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import free_name, written
from .order_join import similar_components

MAX_ROWS = 20_000
MAX_FEATURES = 4096
LEAST_TOXIC = 4
LEAST_RATIO = 10
LEAST_G2 = 18.0
THRESHOLD = 0.7
BEGINNINGS = (4, 5, 6, 7, 8)
FOLDS, HELD_OUT = 3, 1
NEAR_WORDS, NEAR_PERCENT = 5, 80  # near copies, as in the pipeline

CLASSES = 28
OTHER = 27  # letters beyond a to z; 0 is the word boundary

# Fixed values of the channel: what a sign may stand for.
LOOKS_LIKE = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
    "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "¢": "c", "(": "c", "*": "aeiou", "#": "aeiou",
}
SEPARATORS = " .-_*'~·,:/"
COST_LOOKS_LIKE, COST_SEPARATOR, COST_REPEAT, COST_UNKNOWN, COST_DROP = 0.5, 0.5, 1.0, 2.0, 12.0
COST_BOUNDARY = 0.5  # a separator that parts two words

_spaced = re.compile(r"(?<!\S)\S(?:\s++\S(?!\S))+")
_edge = ".,;:!?\"'()[]{}*%&#$|~"
_lead = ".,;:?\"'()[]{}*%&#|~"
_plain_edge = "".join(c for c in _edge if c not in LOOKS_LIKE)  # never a letter
_plain_lead = "".join(c for c in _lead if c not in LOOKS_LIKE)
_run = re.compile(r"([a-z])\1\1")
_double = re.compile(r"([^\W\d_])\1")
_part = re.compile(r"[^ .\-_*'~·,:/]+")
_parted = re.compile(r"[^\W_][ .\-_*'~·,:/]+[^\W_]")


def _classes() -> np.ndarray:
    lut = np.zeros(0x250, np.uint8)
    for c in range(0x250):
        ch = chr(c).lower()[0]
        lut[c] = ord(ch) - 96 if "a" <= ch <= "z" else OTHER if ch.isalpha() else 0
    return lut


_LUT = _classes()


def _symbols(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(code < 0x250, _LUT[np.minimum(code, 0x24F)], OTHER).astype(np.int64)


def corpus_counts(docs: DataFrame) -> DataFrame:
    """One pass over all documents: each task's trigram counts as rows
    (trigram, n)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES ** 3, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                texts = [x or "" for x in batch.column("text").slice(at, 500).to_pylist()]
                s = np.concatenate([np.zeros(2, np.int64), _symbols("\n\n".join(texts)), np.zeros(1, np.int64)])
                total += np.bincount(s[:-2] * CLASSES ** 2 + s[1:-1] * CLASSES + s[2:], minlength=CLASSES ** 3)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())],
                                         names=["trigram", "n"])

    return docs.select(docs["text"]).mapInArrow(count, "trigram int, n long")


def language_model(counts: DataFrame) -> np.ndarray:
    """Log-probabilities [two before, one before, class]; at most 28^3
    numbers, whatever the corpus."""
    n = np.zeros(CLASSES ** 3)
    for r in counts.groupBy("trigram").agg(F.sum("n").alias("n")).collect():
        n[r["trigram"]] = r["n"]
    n = n.reshape(CLASSES, CLASSES, CLASSES) + 0.5
    return np.log(n / n.sum(axis=2, keepdims=True)).astype(np.float32)


def suspicious(token: str) -> bool:
    """Whether a lower-case token without its outer punctuation looks
    disguised. Tokens without any letter never do."""
    if token.isalpha():
        return bool(_run.search(token))
    if not any(c.isalpha() for c in token):
        return False
    return (any(c in LOOKS_LIKE for c in token) or bool(_run.search(token)) or bool(_parted.search(token)))


def readings(observed: str, model: list, ends: Container[int] = (), boundaries: bool = True,
             repeats: bool = True) -> list[str]:
    """The likeliest original of each beginning of an observed (lower-case)
    string that ``ends`` names, and last of the whole: Viterbi over states of
    the last two classes. ``model`` is the table as nested lists. Originals
    are words with blanks between; without ``boundaries`` one word. Without
    ``repeats`` no doubled letter is dropped."""
    # Each text is a chain (chain before, letter), so that a step costs the same at any length.
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    made, before = [], ""
    inside = any(c.isalpha() for c in observed)
    for at, c in enumerate(observed):
        if at in ends:
            made.append(_likeliest(best, model))
        apart = None
        if "a" <= c <= "z":
            ways = [(ord(c) - 96, c, 0.0)]
            skip = COST_REPEAT if c == before and repeats else None
        elif c.isalpha():
            ways, skip = [(OTHER, c, 0.0)], COST_REPEAT if c == before and repeats else None
        else:
            ways = [(ord(x) - 96, x, COST_LOOKS_LIKE) for x in LOOKS_LIKE.get(c, "")]
            skip = (COST_SEPARATOR if c in SEPARATORS else COST_REPEAT if c == before and (repeats or not ways)
                    else COST_DROP if ways else COST_UNKNOWN)
            apart = COST_BOUNDARY if c in SEPARATORS and boundaries else None
        if c not in SEPARATORS:
            before = c
        step: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, text) in best.items():
            if skip is not None and inside:
                now = score - skip
                if (a, b) not in step or step[a, b][0] < now:
                    step[a, b] = (now, text)
            row = model[a][b]
            if apart is not None and inside and b:
                now = score + row[0] - apart
                if (b, 0) not in step or step[b, 0][0] < now:
                    step[b, 0] = (now, (text, " "))
            for k, letter, cost in ways:
                now = score + row[k] - cost
                if (b, k) not in step or step[b, k][0] < now:
                    step[b, k] = (now, (text, letter))
        best = step or best
    return [*made, _likeliest(best, model)]


def _likeliest(best: dict, model: list) -> str:
    # A trailing boundary is already paid for.
    _, _, text = max((score + (model[a][b][0] if b else 0.0), (a, b), text) for (a, b), (score, text) in best.items())
    letters = []
    while text is not None:
        text, letter = text
        letters.append(letter)
    return "".join(reversed(letters)).strip()


def restore(observed: str, model: list) -> str:
    """The likeliest original of an observed (lower-case) string."""
    return readings(observed, model)[-1]


def _cuts(token: str, core_end: int) -> tuple[int, ...]:
    """Where the signs behind a token's core may part into letters and
    punctuation: wherever the sign changes."""
    return tuple(i for i in range(core_end, len(token)) if i == core_end or token[i] != token[i - 1])


def _word_features(word: str) -> tuple[str, ...]:
    return (word, *(word[:n] + "-" for n in BEGINNINGS if len(word) >= n)) if len(word) >= 3 else ()


class Trie:
    """The letters of a set of features, to tell whether any reading of an
    observed string can have one of them."""

    def __init__(self, features):
        self.next: list[dict[str, int]] = [{}]
        self.last = set()
        for feature in features:
            at = 0
            for c in feature.removesuffix("-"):
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                at = self.next[at][c]
            self.last.add(at)

    def reached(self, observed: str) -> bool:
        """Whether some path through the lattice of ``observed`` spells a
        feature from where a word may begin. Costs are left out, so every
        reading of :func:`readings`, of any part of the string, is among the
        paths, and a string without such a path cannot change a score."""
        step, last, at, before = self.next, self.last, {0}, ""
        for c in observed:
            if c.isalpha():
                to = {step[s][c] for s in at if c in step[s]}
                if c == before:
                    to |= at
                before = c
            else:
                to = {step[s][x] for x in LOOKS_LIKE.get(c, "") for s in at if x in step[s]} | at
                if c in SEPARATORS:
                    to.add(0)
                else:
                    before = c
            if not to.isdisjoint(last):
                return True
            at = to
        return False


class Reader(dict):
    """Features of a text's tokens; each distinct token is worked out once.
    With ``keep``, only features in it, as their numbers."""

    MOST = 400_000

    def __init__(self, model: np.ndarray, keep: dict[str, int] | None = None):
        self.model, self.keep = model.tolist(), keep
        self.trie = None if keep is None else Trie(keep)

    def __missing__(self, token: str) -> tuple:
        if len(self) >= self.MOST:
            self.clear()
        self[token] = found = self._features(token)
        return found

    def _features(self, token: str) -> tuple:
        core = token.lower().rstrip(_edge).lstrip(_lead)
        plain = core.strip(_edge + "@!")
        found = _word_features(plain) if plain.isalpha() else ()
        texts = set()
        if suspicious(core) or _double.search(core):
            texts.update(self._texts(core, ()))
        # Signs at the edges may be letters too.
        whole = token.lower().rstrip(_plain_edge).lstrip(_plain_lead)
        if whole != core and any(c.isalpha() for c in whole):
            for start in {whole, whole.lstrip(_lead)}:
                texts.update(self._texts(start, _cuts(start, len(start.rstrip(_edge)))))
        for word in {w for t in texts for w in t.split()}:
            found += _word_features(word)
        if self.keep is not None:
            found = tuple({self.keep[f] for f in found if f in self.keep})
        return found

    def _texts(self, observed: str, ends: tuple[int, ...]) -> Iterator[str]:
        """What an observed string may have been, in all readings that can
        hold a feature."""
        if self.trie is not None and not self.trie.reached(observed):
            return
        parts = [m.span() for m in _part.finditer(observed)] if _parted.search(observed) else []
        for repeats in (True, False):
            yield from readings(observed, self.model, ends, True, repeats)
            if parts:
                yield from readings(observed, self.model, ends, False, repeats)
            # Words that begin at any part; those of more parts show in their beginnings.
            for i, (a, _) in enumerate(parts):
                near = [e - a for _, e in parts[i:i + max(BEGINNINGS)]]
                yield from readings(observed[a:a + near[-1]], self.model, near, False, repeats)

    def features(self, text: str) -> set:
        tokens = set(text.split())
        if not tokens:
            return set()
        tokens.update(" ".join(m[0].split()) for m in _spaced.finditer(text))
        return set().union(*filter(None, map(self.__getitem__, tokens)))

    def restored(self, text: str) -> str:
        """The text itself, disguised tokens restored."""
        def put(m: re.Match) -> str:
            core = m[0].lower().rstrip(_edge).lstrip(_lead)
            return restore(" ".join(core.split()), self.model) if suspicious(core) else m[0]

        return re.sub(r"\S+", put, _spaced.sub(put, text))


_READERS: dict[str, Reader] = {}


def _reader(fitted: dict) -> Reader:
    """The reader of a fit, kept for the next tasks of a Python worker."""
    if fitted["name"] not in _READERS:
        _READERS.clear()
        _READERS[fitted["name"]] = Reader(fitted["model"], fitted["keep"])
    return _READERS[fitted["name"]]


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, toxic, text): at most ``max_rows`` labelled documents outside
    the held-out fold, one of each family of near copies and label."""
    known = (labels.filter(F.col("toxic").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % FOLDS != HELD_OUT))
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    rows = written(docs.select(docs["doc_id"], docs["text"]).join(known, "doc_id").dropDuplicates(["doc_id"]),
                   "toxicity-labelled")
    # Of equal texts one is compared; a text without shingles is a family of its own.
    rows = (rows.groupBy(F.coalesce("text", F.lit("")).alias("text"), "toxic").agg(F.min("doc_id").alias("doc_id")))
    rows = written(rows, "toxicity-distinct")
    families = similar_components(rows.select("doc_id", "text"), NEAR_WORDS, NEAR_PERCENT)
    picked = (families.select("doc_id", F.col("component_id").alias("family"))
              .join(rows.select("doc_id", "toxic"), "doc_id")
              .groupBy("family", "toxic").agg(F.min("doc_id").alias("doc_id"))
              .select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    picked = written(picked, "toxicity-sample")
    # At most max_rows rows of one number.
    return written(rows.join(F.broadcast(picked), "doc_id"), "toxicity-texts")


def _choose(counted: list, n_toxic: int, n_clean: int, most: int) -> list[str]:
    """Features more frequent in toxic texts, by log-likelihood ratio."""
    def g2(a: int, b: int) -> float:
        n, out = n_toxic + n_clean, 0.0
        for seen, of_class in ((a, n_toxic), (b, n_clean)):
            for k, share in ((seen, (a + b) / n), (of_class - seen, 1 - (a + b) / n)):
                if k > 0 and share > 0:
                    out += 2 * k * math.log(k / (of_class * share))
        return out

    scored = [(g2(r["toxic"], r["clean"]), r["feature"]) for r in counted
              if r["toxic"] * n_clean > LEAST_RATIO * r["clean"] * n_toxic]
    return [f for g, f in sorted(scored, key=lambda x: (-x[0], x[1])) if g >= LEAST_G2][:most]


def _logistic(rows: list[tuple[list[int], int]], width: int, steps: int = 400, ridge: float = 1.0) -> np.ndarray:
    """Weights and (last) bias of a ridge logistic regression on sparse 0/1
    rows, by full-batch gradient steps with a per-weight scale. The rarer
    class weighs more, by the root of the classes' ratio."""
    at = np.array([i for i, (f, _) in enumerate(rows) for _ in f], np.int64)
    of = np.array([k for f, _ in rows for k in f], np.int64)
    y = np.array([t for _, t in rows], np.float64)
    weigh = np.where(y > 0, math.sqrt(max(len(y) - y.sum(), 1) / max(y.sum(), 1)), 1.0)
    w, b = np.zeros(width), 0.5 * math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    past, past_b = np.full(width, 1e-6), 1e-6
    for _ in range(steps):
        z = b + np.bincount(at, w[of], minlength=len(y))
        d = weigh * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        g, gb = np.bincount(of, d[at], minlength=width) + ridge * w * 0.1, d.sum()
        past, past_b = past + g * g, past_b + gb * gb
        w, b = w - 0.5 * g / np.sqrt(past), b - 0.5 * gb / math.sqrt(past_b)
    return np.append(w, b)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES) -> dict:
    """The language model and classifier: ``model``, ``keep`` (feature to
    number), ``weights`` (bias last) and a ``name`` of its own."""
    counts = written(corpus_counts(docs), "toxicity-counts")
    model = language_model(counts)
    rows = training_rows(docs, labels, max_rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, seen = Reader(model), (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                seen[toxic].update(reader.features(text or ""))
        names = list(seen[0].keys() | seen[1].keys())
        for at in range(0, len(names), 50_000):
            part = names[at:at + 50_000]
            yield pa.RecordBatch.from_pydict({
                "feature": pa.array(part, pa.string()), "toxic": pa.array([seen[1][f] for f in part], pa.int64()),
                "clean": pa.array([seen[0][f] for f in part], pa.int64())})

    size = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = size.get(1, 0), size.get(0, 0)
    if not n_toxic or not n_clean:
        return {"name": uuid.uuid4().hex, "model": model, "keep": {}, "weights": np.array([40.0 if n_toxic else -40.0])}
    counted = (rows.select("text", "toxic").mapInArrow(count, "feature string, toxic long, clean long")
               .groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
               .filter((F.col("toxic") >= LEAST_TOXIC) & (F.col("toxic") * n_clean > F.col("clean") * LEAST_RATIO * n_toxic))
               # The most telling first: what the driver gets is bounded.
               .orderBy((F.col("toxic") - F.col("clean") * (n_toxic / n_clean)).desc(), "feature")
               .limit(8 * max_features).collect())
    keep = {f: i for i, f in enumerate(_choose(counted, n_toxic, n_clean, max_features))}

    def active(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model, keep)
        for batch in batches:
            found = [sorted(reader.features(t or "")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column("toxic")],
                                             names=["found", "toxic"])

    sample = rows.select("text", "toxic").mapInArrow(active, "found array<int>, toxic int").collect()
    sample = sorted((list(r["found"]), r["toxic"]) for r in sample)
    return {"name": uuid.uuid4().hex, "model": model, "keep": keep, "weights": _logistic(sample, len(keep))}


def scored(docs: DataFrame, fitted: dict, threshold: float = THRESHOLD, columns: list[str] | None = None,
           score: str = "score", predicted: str = "predicted") -> DataFrame:
    """The given columns of ``docs`` (doc_id alone, if none are given), with
    the score and the prediction under the given names."""
    columns = columns or ["doc_id"]
    apart = "text" not in columns
    narrow = docs.select(*[docs[f"`{c}`"] for c in columns], *([docs["text"]] if apart else []))
    kept = narrow.schema.fields[:len(columns)]
    schema = StructType(list(kept)).add(score, "double").add(predicted, "integer")
    at_text = len(columns) if apart else columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, weights = _reader(fitted), fitted["weights"]
        bias = float(weights[-1])
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                scores = []
                for text in batch.column(at_text):
                    z = bias + sum(float(weights[k]) for k in sorted(reader.features(text.as_py() or "")))
                    scores.append(1 / (1 + math.exp(-max(-40.0, min(40.0, z)))))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:len(columns)], pa.array(scores, pa.float64()),
                     pa.array([int(s >= threshold) for s in scores], pa.int32())],
                    names=[*columns, score, predicted])

    return narrow.mapInArrow(run, schema)


def without_toxic(docs: DataFrame, fitted: dict, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` (all columns) that score below the threshold."""
    score, predicted = free_name(docs, "score"), free_name(docs, "predicted")
    return (scored(docs, fitted, threshold, docs.columns, score, predicted)
            .filter(F.col(predicted) == 0).drop(score, predicted))


def held_out(doc_id):
    """Whether a doc_id belongs to the fold that is never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))
