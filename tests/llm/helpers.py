"""Small tables with awkward rows."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}x" for _ in range(words))


def awkward_rows() -> list[tuple]:
    """NULLs in every column, empty and long texts, copies, a hot source,
    repeated rows and words split by several kinds of white space."""
    rows = [(i, prose(i, 5 + i * 3 % 60), "en", "hot" if i % 3 else f"s{i % 7}", 1) for i in range(60)]
    rows += [(100 + i, prose(7, 40), "en", "hot", 1) for i in range(30)]            # copies
    rows += [(200 + i, prose(7, 40) + f" tail{i}", "en", "s1", 1) for i in range(12)]  # near copies
    rows += [(300, None, None, None, None), (301, "", "en", "s2", 0), (302, " \t\n ", "en", None, 3)]
    rows += [(303, "one", "en", "s2", 3), (304, "ONE", "en", "s2", 3), (305, "a b\tc\x0bd\x0ce\rf", "fr", "s3", 9)]
    rows += [(306, "é 😀 ñ x" * 400, "fr", "s3", 9), (307, prose(8, 9000), "de", "s4", 9)]
    rows += [(308, "same row", "en", "s5", 1)] * 3 + [(None, "no id", "en", "s5", 1), (None, None, "en", "s5", 1)]
    return rows


def docs(spark, rows=None):
    return spark.createDataFrame(awkward_rows() if rows is None else rows, DOCS)


def with_clashes(df):
    """Extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    for name in ("k1", "k2", "row", "name", "pos", "part", "at", "n", "size", "copies", "copy", "shard", "slot",
                 "score", "predicted", "cid", "token", "piece", "group", "place", "scored text"):
        df = df.withColumn(name, F.lit("x"))
    return df


def group_sizes(df):
    """The rows of each row group of the files that ``df`` reads, file by file."""
    import pyarrow.parquet as pq

    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in df.inputFiles()]
    return [[m.row_group(i).num_rows for i in range(m.num_row_groups)] for m in files]
