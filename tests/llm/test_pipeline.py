"""The pipeline, stage by stage, against brute force on a small corpus, and the
registered queries against their oracle SQL."""

import math
import os
from collections import Counter, defaultdict

import pytest

import __spark_entry__ as E
import corpus_pipeline as P
from oracle.compare import canonical, duckdb_connection, run_oracle

from .helpers import DOCS, awkward_rows, docs, prose, with_clashes
from .test_native import _targets
from .test_text_ops import _brute_components, _check_packing, _family

SF = "/root/testdata/sf0.001"


def _corpus():
    rows = awkward_rows() + _family(25)
    clean = [(5000 + i, prose(700 + i, 40), "en", f"s{i % 3}", 1) for i in range(120)]
    toxic = [(6000 + i, f"{prose(900 + i, 20)} vorgul{'aeiou'[i % 5]} {prose(950 + i, 20)} brutzel", "en", "s1", 1)
             for i in range(60)]
    labels = [(d, 1, 0) for d, *_ in clean if d % 2] + [(d, 1, 1) for d, *_ in toxic if d % 3] + [(None, 0, 1), (7, 1, None)]
    return rows + clean + toxic, labels, {d for d, *_ in toxic}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    rows, labels, toxic = _corpus()
    with_clashes(docs(spark, rows)).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows, toxic


def test_stages_in_order():
    assert [name for name, _ in P.STAGES] == ["toxicity", "exact dedup", "n-gram Jaccard join",
                                              "mixing to target weights", "best-fit packing"]


def test_each_stage_against_brute_force(spark, corpus):
    folder, rows, toxic = corpus
    stage = dict(P.STAGES)
    read = spark.read.parquet(f"{folder}/documents.parquet")
    columns = read.columns

    def run(name, given):
        out = P.written(stage[name](spark, given, folder), "test-stage")
        if name != "best-fit packing":
            assert out.columns == columns
        return out

    def plain(df):
        return [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect()]

    kept = run("toxicity", read)
    rows = plain(kept)
    assert not toxic & {r[0] for r in rows}  # caught, held-out ones too
    assert Counter(r[0] for r in rows) == Counter(r.doc_id for r in read.collect() if r.doc_id not in toxic)

    kept = run("exact dedup", kept)
    largest = {}
    for d, t, *_ in rows:
        known = largest.get(t or "")
        largest[t or ""] = d if known is None else known if d is None else max(d, known)
    rows = plain(kept)
    assert Counter((r[1] or "", r[0]) for r in rows) == Counter(largest.items())

    kept = run("n-gram Jaccard join", kept)
    parts = _brute_components(rows, P.NEAR_WORDS, P.NEAR_PERCENT)
    expected = {c for d, n, c in parts if n} | {d for d, n, c in parts if not n}
    rows = plain(kept)
    assert Counter(r[0] for r in rows) == Counter(expected)

    kept = run("mixing to target weights", kept)
    import re

    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, longest = defaultdict(int), defaultdict(int)
    for _, t, _, s, _ in rows:
        sizes[s] += count(t)
        longest[s] = max(longest[s], count(t))
    target, taken = _targets(sizes), defaultdict(int)
    out = plain(kept)
    for _, t, _, s, _ in out:
        taken[s] += count(t)
    assert all(abs(taken[s] - target[s]) <= longest[s] + 1e-6 for s in sizes)
    assert max(Counter(r[0] for r in out).values()) <= 2
    assert {r[:2] for r in out} <= {r[:2] for r in rows}

    packed = run("best-fit packing", kept)
    made, total = _check_packing(packed.collect(), out, 2048)
    assert made <= math.ceil(total / 2048) + 1


def test_run_equals_the_stages(spark, corpus):
    folder, _, _ = corpus
    a, b = P.run(spark, folder), P.run(spark, folder)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, a.select(*key).collect()), key=str) == sorted(map(tuple, b.select(*key).collect()), key=str)


def test_empty_table(spark, tmp_path):
    docs(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0


def test_registered_names():
    names = [k for k in E.queries() if k.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in E.queries() and set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no sf0.001 data")
@pytest.mark.parametrize("key", sorted(k for k in E.oracle_sql() if k.startswith("op")))
def test_query_matches_oracle(spark, key):
    df = E.queries()[key](spark, SF)
    columns, rows = run_oracle(duckdb_connection(SF), E.oracle_sql()[key])
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(columns, rows)
