"""Block naming, systematic mixing and byte shards against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from podium.llm import block_naming, byte_shards, systematic_mix

from .helpers import DOCS, awkward_rows, docs, with_clashes


def _dedup_expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        out += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return Counter(out)


@pytest.mark.parametrize("block_chars", [3, 4096])
def test_exact_copies(spark, block_chars):
    rows = awkward_rows()[:-40] + awkward_rows()[-12:] if block_chars == 3 else awkward_rows()
    rows = [r for r in rows if len(r[1] or "") < 2000] if block_chars == 3 else rows
    got = block_naming.exact_copies(with_clashes(docs(spark, rows)), block_chars).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == _dedup_expected(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r[1] or "" for r in rows})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_blocks_with_one_fingerprint_are_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = [(i, f"text {i % 4}", "en", "s", 1) for i in range(12)]
    honest = block_naming._fingerprint

    def clashing(block, salt):
        return honest(F.lit("same"), salt) if salt == 0 else honest(block, salt)

    monkeypatch.setattr(block_naming, "_fingerprint", clashing)
    got = block_naming.exact_copies(docs(spark, rows)).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == _dedup_expected(rows)


def test_drop_copies_keeps_whole_rows(spark):
    df = with_clashes(docs(spark))
    got = block_naming.drop_copies(df)
    assert got.columns == df.columns
    rows = got.collect()
    assert sorted(r.text or "" for r in rows) == sorted({r[1] or "" for r in awkward_rows()})
    assert {r.doc_id for r in rows if r.text == awkward_rows()[60][1]} == {129}


def _targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, open_ = {}, share * sum(sizes.values()), set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if cap * sizes[s] <= level * weight[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: float(cap * sizes[s]) for s in full}
        left -= sum(cap * sizes[s] for s in full)
        open_ -= full
    return target


def test_mix_meets_targets(spark):
    rows = awkward_rows()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += count(r[1])
    target = _targets(sizes)
    got = systematic_mix.copies_plan(with_clashes(docs(spark))).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], count(r[1])) for r in rows)
    assert all(r.taken <= 2 * r.size and r.taken == r.copies * r.size for r in got)
    by = defaultdict(list)
    source_of = defaultdict(set)
    for r in rows:
        source_of[r[0]].add(r[3])
    for r in got:
        (s,) = source_of[r.doc_id]
        by[s].append(r)
    for s, members in by.items():
        assert all(r.source_size == sizes[s] and math.isclose(r.target, target[s], abs_tol=1e-6) for r in members)
        longest = max(r.size for r in members)
        assert abs(sum(r.taken for r in members) - target[s]) <= longest
    again = systematic_mix.copies_plan(with_clashes(docs(spark)).repartition(7)).collect()
    key = lambda rows: Counter((r.doc_id, r.size, r.taken) for r in rows)
    assert key(again) == key(got)


def test_mixed_rows_follow_the_plan(spark):
    df = with_clashes(docs(spark))
    taken = Counter()
    for r in systematic_mix.copies_plan(df).collect():
        taken[r.doc_id] += r.copies
    out = systematic_mix.mixed(df)
    assert out.columns == df.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({k: v for k, v in taken.items() if v})


def test_byte_shards(spark):
    rows = awkward_rows()
    got = byte_shards.shard_plan(with_clashes(docs(spark)), shards=5).collect()
    sized = lambda t: len((t or "").encode()) + 16
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (r[0], sized(r[1]), zlib.crc32((r[1] or "").encode())) for r in rows)
    total, longest = sum(r.size for r in got), max(r.size for r in got)
    for s in range(5):
        members = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in members) == list(range(len(members)))
        assert abs(sum(r.size for r in members) - total / 5) <= longest
    # equal texts lie in neighbouring shards
    copies = sorted({r.shard for r in got if r.doc_id is not None and 100 <= r.doc_id < 130})
    assert copies == list(range(copies[0], copies[-1] + 1))


def test_write_shards(spark, tmp_path):
    df = docs(spark)
    path = str(tmp_path / "shards")
    byte_shards.write_shards(df, path, shards=4)
    back = spark.read.parquet(path)
    assert back.count() == df.count()
    assert Counter(r.doc_id for r in back.collect()) == Counter(r[0] for r in awkward_rows())


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert block_naming.exact_copies(none).count() == 0
    assert block_naming.drop_copies(none).count() == 0
    assert systematic_mix.copies_plan(none).count() == 0
    assert systematic_mix.mixed(none).count() == 0
    assert byte_shards.shard_plan(none).count() == 0


def test_native_plans_hold_no_python(spark):
    df = docs(spark)
    for out in (block_naming.exact_copies(df), systematic_mix.copies_plan(df), systematic_mix.mixed(df)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)


def test_rows_that_differ_in_a_map_only_are_rows_of_their_own(spark):
    from pyspark.sql import functions as F

    rows = docs(spark, [(1, "same words here", "en", "s", 1)]).crossJoin(
        spark.createDataFrame([({"a": 1},), ({"a": 2},), (None,), ({},)], "extra map<string,int>"))
    rows = rows.withColumn("deep", F.struct(F.array("extra").alias("maps")))
    out = systematic_mix.mixed(rows)
    taken = systematic_mix.copies_plan(rows).agg(F.sum("copies")).first()[0]
    assert out.count() == taken and taken > 1
    assert len({str(r["extra"]) for r in out.collect()}) > 1
    assert sum(r["kept"] for r in block_naming.exact_copies(rows).collect()) == 1
