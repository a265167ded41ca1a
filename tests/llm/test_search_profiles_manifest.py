"""Language profiles, hybrid ranked search and the Merkle manifest against
brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from podium.llm import hybrid_rank as H
from podium.llm import merkle_climb as M
from podium.llm import queries as Q
from podium.llm import rank_profiles as R
from podium.llm.common import written

from .helpers import DOCS, awkward_rows, docs, group_sizes, with_clashes

# --- language profiles ------------------------------------------------------------


def grams_of(text: str | None) -> Counter:
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    s = " " + " ".join(words) + " " if words else ""
    return Counter(g for i in range(len(s)) for k in (1, 2, 3)
                   if len(g := s[i:i + k]) == k and g != " " and (k < 3 or g[1] != " "))


def ranked(counts: Counter, most: int) -> list[str]:
    return sorted(counts, key=lambda g: (-counts[g], len(g), g))[:most]


def brute_languages(rows, most: int) -> list[tuple]:
    total: dict[str, Counter] = {}
    for doc_id, text, lang, *_ in rows:
        if doc_id is not None and lang is not None and zlib.crc32(str(doc_id).encode()) % 3 != 1 and grams_of(text):
            total.setdefault(lang, Counter()).update(grams_of(text))
    best = {lang: {g: i for i, g in enumerate(ranked(c, most))} for lang, c in total.items()}
    out = []
    for doc_id, text, *_ in rows:
        mine = ranked(grams_of(text), most)
        if not mine or not best:
            out.append((doc_id, "und", 0.0))
            continue
        d = sorted((sum(abs(p[g] - i) if g in p else most for i, g in enumerate(mine)), lang)
                   for lang, p in best.items())
        score = 1.0 if len(d) == 1 else 1 - d[0][0] / d[1][0] if d[1][0] else 0.0
        out.append((doc_id, d[0][1], score))
    return out


def key(row):
    return tuple((x is not None, x or 0) for x in row)


@pytest.mark.parametrize("most", [400, 25])
def test_languages_equal_brute_force(spark, most):
    rows = awkward_rows() + [(500 + i, f"Ça été là où l'été {i} naïve forêt", "fr", "s1", 1) for i in range(9)]
    rows += [(600 + i, f"Öl über größe weiß{i} straße STRASSE", "de", None, 1) for i in range(9)]
    rows += [(700, "1234 !!", "en", "s1", 1), (701, "é", None, "s1", 1), (702, "日本語 の 文", "ja", "s1", 1)]
    df = with_clashes(docs(spark, rows))
    found = R.identified(df, R.fit(df, most)).collect()
    assert sorted(map(tuple, found), key=key) == sorted(brute_languages(rows, most), key=key)


def test_profiles_name_their_grams(spark):
    df = spark.createDataFrame([(0, "aba aß", "x")], "doc_id long, text string, lang string")
    found = {r["gram"]: r["n"] for r in R.profiles(df).collect()}
    assert found == dict(grams_of("aba aß"))


def test_pieces_of_long_texts_count_as_the_whole(monkeypatch):
    text = "abc défg h " * 50
    whole = R.counted(R.letters(text))
    monkeypatch.setattr(R, "PIECE", 7)
    pieces = R.counted(R.letters(text))
    assert all(np.array_equal(a, b) for a, b in zip(whole, pieces))


def test_languages_without_rows_labels_or_letters(spark):
    empty = docs(spark, [])
    assert R.identified(empty, R.fit(empty)).collect() == []
    unlabelled = docs(spark, [(1, "abc", None, "s", 1), (None, "abc", "en", "s", 1)])
    assert {tuple(r) for r in R.identified(unlabelled, R.fit(unlabelled)).collect()} == {
        (1, "und", 0.0), (None, "und", 0.0)}
    many = docs(spark, [(i, "abc", f"l{i}", "s", 1) for i in range(30)])
    with pytest.raises(ValueError):
        R.fit(many, most_languages=3)


# --- hybrid ranked search ------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[str]:
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in TERM.findall(text or "")]


def brute_ranking(rows, items, k: int) -> list[tuple]:
    held = [(doc_id, Counter(words_of(text))) for doc_id, text, *_ in rows]
    held = [(doc_id, c, sum(c.values())) for doc_id, c in held if c]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item_id, text in dict.fromkeys(items):
        asked = Counter(words_of(text))
        scored = []
        for doc_id, c, n in held:
            m = 25 + (75 * n * n_docs) // n_terms
            score = sum(q * H.weight(df[t], n_docs) * ((10 ** 9 * c[t]) // (1000 * c[t] + 8 * m))
                        for t, q in asked.items() if t in c)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, i + 1, None if null else d, -s) for i, (s, null, d) in enumerate(sorted(scored)[:k])]
    return out


def skewed_rows(n: int = 700) -> list[tuple]:
    r = random.Random(5)
    return [(i, " ".join(f"T{min(int(r.paretovariate(0.6)), 900)}é" for _ in range(r.randrange(1, 60))), "en", "s", 1)
            for i in range(n)]


ITEMS = [(0, "T1é t2é T3é t40é"), (1, "t1é t1é t1é t300é t7é"), (2, None), (3, ""), (4, "absent words"),
         (5, "same row"), (5, "same row"), (6, "w1x w2x w3x tail3"), (6, "one"), (7, "😀 É é"),
         *[(10 + i, " ".join(f"t{i * 7 % j + 1}é" for j in range(1, 40))) for i in range(12)]]


@pytest.mark.parametrize("k, chunk_chars, look_ahead", [(10, 1 << 22, True), (3, 60, False)])
def test_ranking_equals_brute_force(spark, k, chunk_chars, look_ahead):
    rows = skewed_rows() + [(1000 + (r[0] or 0), *r[1:]) if r[0] is not None else r for r in awkward_rows()]
    df = with_clashes(docs(spark, rows)).repartition(3)
    items = with_clashes(spark.createDataFrame(ITEMS, "item_id long, text string"))
    blocks = written(H.index(df, block_docs=150, block_terms=3000), "test-index")
    assert blocks.count() > 4
    found = H.search(blocks, items, k, chunk_chars, look_ahead).collect()
    assert sorted(map(tuple, found), key=key) == sorted(brute_ranking(rows, ITEMS, k), key=key)


def test_index_blocks_in_row_groups_of_their_own(spark, tmp_path, monkeypatch):
    """A task reads a row group's lists at once: one block, however many a file has."""
    docs(spark).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    items = spark.createDataFrame([(1, "w1x w2x same row")], "item_id long, text string")
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    index, kept = H.index, []
    monkeypatch.setattr(H, "index", lambda table: index(table, block_docs=16))
    monkeypatch.setattr(Q, "written", lambda *a: kept.append(written(*a)) or kept[-1])
    found = Q.op12_hybrid_rank(spark, str(tmp_path)).collect()
    sizes = [n for file in group_sizes(kept[0]) for n in file]
    assert len(sizes) == -(-len(awkward_rows()) // 16) and set(sizes) == {1}
    whole = H.search(written(index(docs(spark)), "whole-index"), items).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, whole))


def test_ranking_of_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    nothing = written(H.index(docs(spark, [])), "test-index")
    assert H.search(nothing, items).collect() == []
    wordless = written(H.index(docs(spark, [(1, None, "en", "s", 1), (2, " .. ", "en", "s", 1)])), "test-index")
    assert H.search(wordless, items).collect() == []
    some = written(H.index(docs(spark, skewed_rows(30))), "test-index")
    assert H.search(some, items.limit(0)).collect() == []


def test_windows_below_the_score_to_beat_are_skipped():
    block = H._Block()
    for i in range(4000):
        block.add(i, "often here too" + " rare" * (1000 <= i < 1016) + " more" * (i % 7))
    row = H._row(block.row(), 0)
    query = {"often": 1, "here": 1, "too": 2, "rare": 50}
    lists = H.Lists(row, pa.array(sorted(query)), 4000, block.n_terms)
    assert set(lists.at) - set(lists.long) == {"rare"}
    best, read = H.best_of_block(lists, query, 10, [], 0)
    assert len(best) == 10 and all(1000 <= d < 1016 for *_, d in best)
    # The short list, and the long ones only where it is.
    assert read <= 16 + 3 * 2 * lists.window
    assert sum(len(docs) for docs, _ in lists.at.values()) == 12_016


def test_terms_are_runs_of_letters_digits_and_all_beyond_ascii():
    for text in ("aB-C_d É9é\x7f😀x[Z]`q{", "", None, "...", " x y"):
        assert sorted(t.decode() for t in H._counted(text).elements()) == sorted(words_of(text))


# --- Merkle manifest ------------------------------------------------------------------

def h(*inputs: str) -> str:
    return hashlib.sha256("".join(inputs).encode()).hexdigest()


def leaf(row) -> str:
    doc_id, text, lang, source, n_chars = row
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def fold_up(nodes: list[str]) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i:i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def path(levels: list[list[str]], at: int, claim: str) -> tuple[list[str], str]:
    proof = []
    for level in levels[:-1]:
        start = at // 8 * 8
        run = level[start:start + 8]
        proof += run[:at - start] + run[at - start + 1:]
        claim = h(*run[:at - start], claim, *run[at - start + 1:])
        at //= 8
    return proof, claim


def brute_manifest(rows) -> list[tuple]:
    def tampered(row):
        if row[0] is None or row[1] is None or zlib.crc32(str(row[0]).encode()) % 3:
            return row
        return (row[0], re.sub("[A-Z]", lambda m: m[0].lower(), row[1]), *row[2:])

    trees: dict = {}
    for row in rows:
        trees.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf(row), leaf(tampered(row)), row[0]))
    order = sorted(trees, key=lambda lang: (lang is not None, (lang or "").encode()))
    lower = {lang: fold_up([x[2] for x in sorted(trees[lang], key=lambda x: x[:4])]) for lang in order}
    upper = fold_up([lower[lang][-1][0] for lang in order])
    out = []
    for i, lang in enumerate(order):
        for j, (_, _, own, claim, doc_id) in enumerate(sorted(trees[lang], key=lambda x: x[:4])):
            first, claim = path(lower[lang], j, claim)
            then, claim = path(upper, i, claim)
            root = upper[-1][0]
            out.append((doc_id, own, lower[lang][-1][0], root, h(*first, *then), claim, claim == root))
    return out


def manifest_rows(spark, rows):
    df = with_clashes(spark.createDataFrame(rows, DOCS))
    return list(map(tuple, M.verified(M.build(df, {"text": M.lower_cased_sample(df["doc_id"], df["text"])})).collect()))


def test_manifest_equals_brute_force(spark):
    rows = awkward_rows() + [(1000 + i, f"Text {i}", f"l{i % 11}", None, i) for i in range(200)]
    rows += [(2000, "X" * 300_000, "zz", "s", 1)]
    found = manifest_rows(spark, rows)
    assert sorted(found, key=key) == sorted(brute_manifest(rows), key=key)
    assert {r[-1] for r in found} == {True, False}


def test_manifest_of_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(M, "BUCKET_LEVELS", 1)
    monkeypatch.setattr(M, "BUCKET", 8)
    rows = [(i, f"A{i}", "en" if i % 10 else f"l{i % 7}", "s", i) for i in range(700)]
    assert sorted(manifest_rows(spark, rows)) == sorted(brute_manifest(rows))


@pytest.mark.parametrize("rows", [[], [(1, "A", "en", "s", 1)], [(None, None, None, None, None)],
                                  [(1, "A", "en", "s", 1), (1, "A", "en", "s", 1)],
                                  [(1, "A", "en", "s", 1), (2, "A", None, "s", 1)],
                                  [(i, "A", "en", "s", 1) for i in range(9)]])
def test_small_manifests(spark, rows):
    assert sorted(manifest_rows(spark, rows), key=key) == sorted(brute_manifest(rows), key=key)


def test_manifest_keeps_the_row_limit_of_recursive_queries(spark):
    name = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(name)
    manifest_rows(spark, [(1, "A", "en", "s", 1), (2, "B", "en", "s", 1)])
    assert spark.conf.get(name) == before
