"""The tables kept beside the fact: batches that count as a whole, the name
index and the kept counts."""

from __future__ import annotations

import dataclasses
import os
import uuid

import pytest
from pyspark.sql import functions as F

from podium import session
from podium.functions.search import literal_runs
from podium.plans import dashboard as D
from podium.plans import drilldowns as R
from podium.plans import listings as L
from podium.session import scratch_dir
from podium.sources import companions, sinks
from podium.sources.lake import write_tables
from podium.sources.schemas import SCHEMAS
from podium.sources.sinks import append, append_results
from podium.sources.tables import load_tables

from helpers import make_tables

NAMES = ["Ann SMITH", "ann smith", "Bob SMITHSON", "Ça ÉTÉ", "çA été", "100% Sure", "100 Sure", "a_b c", "axb c", "Al",
         "", None, "back\\slash", "İstanbul", "Kelvin Ken", "ΟΔΟΣ ΟΔΟΣΑ"]


def results(first: int, n: int) -> list[tuple]:
    return [(first + i, i % 5 + 1, None if i % 3 == 0 else i % 4 + 1, NAMES[i % len(NAMES)], "SGP", i % 9,
             None if i % 7 == 0 else "" if i % 11 == 0 else "9.9", 1.0, 2.0, False) for i in range(n)]


@pytest.fixture(scope="module")
def base(spark):
    return make_tables(
        spark, countries=[("SGP", "Singapore")], ranking_categories=[(1, "A")], disciplines=[("D", "Dash", "Sprints")],
        events=[(1, "100m", "100m", "D")],
        athletes=[(i, "F", "G", f"G F{i}", None, "M", "SGP", None) for i in range(1, 5)],
        competitions=[(i, f"Meet {i}", "Hall", "A", "SGP", 1, None, None, 2001, True, None) for i in range(1, 4)],
        races=[(i, i % 3 + 1, 1, None, None) for i in range(1, 6)], results=results(1, 120))


def lake(spark, base) -> str:
    return write_tables(base, scratch_dir(spark, f"test-companions-{uuid.uuid4().hex[:8]}"), results_files=2)


def batch(spark, first: int, n: int):
    return spark.createDataFrame(results(first, n), SCHEMAS["results"])


def all_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def reads_results(df) -> bool:
    return any("/results" in f for f in df.inputFiles())


TERMS = ["smith", "%SMITH%", "nn s", "100% Sure", "100\\% sure", "a_b", "a\\_b", "été", "ÇA", "al", "zzz", "%%", "__",
         "back\\\\slash", "stanbul", "ken", "οδος", "mith_on"]


@pytest.fixture(scope="module")
def appended(spark, base):
    path = lake(spark, base)
    for first in (1000, 2000):
        assert append_results(batch(spark, first, 70), path, batch=f"b{first}") == 70
    return load_tables(spark, path), load_tables(spark, path, with_athlete_layout=False, with_companions=False)


@pytest.mark.parametrize("term", TERMS)
def test_name_index_finds_what_the_scan_finds(appended, term, monkeypatch):
    kept, plain = appended
    assert plain.athlete_names is None and kept.athlete_names is not None
    expected = all_rows(plain.results.filter(F.col("athlete_name").ilike(R._name_pattern(term))
                                             & (F.coalesce("mark", F.lit("")) != "")))
    assert all_rows(R._results_named(kept, term)) == expected == all_rows(R._results_named(plain, term))
    count = R.athlete_results_by_name_count(kept, term)
    assert count.first()["total"] == len(expected) and not reads_results(count)
    monkeypatch.setattr(R, "NAMES_PUSHED", 0)  # as a semi join
    assert all_rows(R._results_named(kept, term)) == expected


def test_literal_runs():
    assert literal_runs("%given7 %", 3) == ["given7 "]
    assert literal_runs("%a\\%Bc_déjà vu%", 3) == ["a%bc", " vu"]
    assert literal_runs("%ab%", 3) == []


def test_kept_counts_stand_for_the_fact(spark, appended):
    kept, plain = appended
    for report in (lambda t: L.competitions_list(t, None), lambda t: L.competitions_with_results_count(t, "meet"),
                   lambda t: L.competitions_page_info(t, None), lambda t: L.competitions_count(t, "meet"),
                   lambda t: D.timeline(t, "SGP", "2001-01-01")):
        assert all_rows(report(kept)) == all_rows(report(plain))
        assert not reads_results(report(kept)) and reads_results(report(plain))


def test_kept_counts_are_left_when_the_fact_is_written_to(spark, base):
    path = lake(spark, base)
    append(batch(spark, 5000, 40), os.path.join(path, "results"))
    t = load_tables(spark, path)
    assert t.race_counts is None and t.athlete_names is None and t.results_by_athlete is None
    assert sum(r["result_count"] for r in L.competitions_list(t, None).collect()) == t.results.filter(
        "coalesce(mark, '') <> ''").count()


def test_a_batch_counts_once_and_as_a_whole(spark, base, monkeypatch):
    path = lake(spark, base)
    more = batch(spark, 1000, 50)
    with monkeypatch.context() as m:
        # Interrupted when the fact's part lies there and one copy of it too.
        write = companions.write_companions

        def stop(written, folder, names, fmt):
            write(written, folder, names[:1], fmt)
            raise RuntimeError("lost")

        m.setattr(sinks.companions, "write_companions", stop)
        with pytest.raises(RuntimeError):
            append_results(more, path, batch="b1")
    before = load_tables(spark, path)
    assert all_rows(before.results) == all_rows(base.results) == all_rows(before.results_by_athlete)
    assert append_results(more, path, batch="b1") == 50
    assert append_results(more, path, batch="b1") == 0
    after = load_tables(spark, path)
    assert all_rows(after.results) == sorted(all_rows(base.results) + all_rows(more), key=str)
    assert all_rows(after.results_by_athlete) == all_rows(after.results)
    assert after.race_counts.agg(F.sum("n")).first()[0] == after.results.filter("coalesce(mark, '') <> ''").count()
    # Tables loaded before keep their snapshot.
    assert before.results.count() == 120
    with pytest.raises(ValueError):
        append_results(more, path, batch="../b1")


def test_empty_tables_and_batches(spark):
    t = make_tables(spark)
    path = lake(spark, t)
    assert append_results(batch(spark, 1, 0), path, batch="none") == 0
    loaded = load_tables(spark, path)
    assert loaded.results.count() == 0 and L.competitions_list(loaded, None).count() == 0
    assert R.athlete_results_by_name_count(loaded, "ann").first()["total"] == 0
    assert R.athlete_results_by_name(loaded, "ann").collect() == []


def rows_of_files(t, table: str) -> list[int]:
    return [r["count"] for r in t.table(table).groupBy(F.input_file_name()).count().collect()]


def test_tasks_that_write_a_lake_follow_its_rows(spark, base, monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_TASK", 100, raising=False)
    n, held = 4000, ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled",
                     "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = {k: spark.conf.get(k, None) for k in held}
    spark.conf.set(held[0], "2")
    spark.conf.set(held[1], "false")
    try:
        # Dealt out by a shuffle of the session's size, as a join would be.
        many = batch(spark, 1, n).repartition("id")
        tables = dataclasses.replace(base, results=many, results_expected=n)
        path = write_tables(tables, scratch_dir(spark, f"test-tasks-{uuid.uuid4().hex[:8]}"))
        append_results(batch(spark, n + 1, n).repartition("id"), path, expected=n)
        t = load_tables(spark, path)
        for table, rows in (("results", 2 * n), ("results_by_athlete", 2 * n), ("results_by_name", t.results_by_name.count())):
            files = rows_of_files(t, table)
            assert sum(files) == rows and max(files) < 500, (table, files)
        assert (spark.conf.get(held[0]), spark.conf.get(held[1])) == ("2", "false")
        assert spark.conf.get(held[2], None) == before[held[2]]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_companions_are_the_same_with_and_without_the_athlete_copy(spark, base):
    made = []
    for copy in (True, False):
        path = write_tables(base, scratch_dir(spark, f"test-copy-{uuid.uuid4().hex[:8]}"), athlete_layout=copy)
        append_results(batch(spark, 1000, 70), path, batch="more")
        made.append(load_tables(spark, path))
    assert made[0].results_by_athlete is not None and made[1].results_by_athlete is None
    for name in companions.COMPANIONS:
        if name != "results_by_athlete":
            # Counts add up over the batches; how they lie in files is free.
            assert all_rows(made[0].table(name)) == all_rows(made[1].table(name)), name
    for f in made[0].results.inputFiles() + made[0].results_by_name.inputFiles():
        assert f.endswith(".zstd.parquet")
