"""Sorting with explicit NULL placement, pages, and page metadata.

PostgreSQL puts NULLs last ascending and first descending; Spark does the
opposite by default, so every sort key here spells its placement out. A page
that ends within the first :data:`TOP_K_ROWS` rows is
``orderBy(..).offset(o).limit(n)``, which Spark plans as one
``TakeOrderedAndProject``: each task keeps its best ``o + n`` rows and only
those reach the final merge. A page further on, or a larger one, is cut out of
a distributed sort by row position, so no task ever holds ``o + n`` rows; the
sorted rows are kept (:class:`KeptOrder`), and every later page of the same
list is read from them. Both give the same rows; :func:`seek_page` (``after=``
of every paged report) costs the same however deep the page is.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import c
from ..session import scratch_dir

# ---- fixed values -----------------------------------------------------------
LIST_PAGE_CAP = 200          # v2 lists and competition participants
AUTOCOMPLETE_CAP = 50
AUTOCOMPLETE_DEFAULT = 10
LIST_PAGE_SIZE = 50
RESULTS_PAGE_SIZE = 100
ATHLETE_SORT_FIELDS = ("full_name", "family_name", "given_name", "country_code", "birth_date")
# Rows that one task merges for a top-k page; pages that end beyond are cut
# out of a distributed sort instead.
TOP_K_ROWS = 10_000
# -----------------------------------------------------------------------------


def asc(x: str | Column) -> Column:
    """Ascending, NULLs last (PostgreSQL's default)."""
    return c(x).asc_nulls_last()


def desc(x: str | Column) -> Column:
    """Descending, NULLs first (PostgreSQL's default)."""
    return c(x).desc_nulls_first()


def athlete_sort_keys(sort_by: str = "full_name", sort_order: str = "ASC") -> list[tuple[str, bool]]:
    """Allow-listed dynamic sort; anything not listed falls back to
    ``full_name ASC``. ``id`` breaks ties so pages are stable."""
    field = sort_by if sort_by in ATHLETE_SORT_FIELDS else "full_name"
    return [(field, sort_order == "DESC"), ("id", False)]


def athlete_sort(sort_by: str = "full_name", sort_order: str = "ASC") -> list[Column]:
    return [desc(name) if descending else asc(name) for name, descending in athlete_sort_keys(sort_by, sort_order)]


@dataclass(frozen=True)
class PageSpec:
    page: int = 1
    per_page: int = LIST_PAGE_SIZE
    cap: int | None = None

    def __post_init__(self) -> None:
        if int(self.page) < 1:
            raise ValueError("page must be >= 1")
        if int(self.per_page) < 1:
            raise ValueError("per_page must be >= 1")

    @property
    def size(self) -> int:
        return min(self.per_page, self.cap) if self.cap else self.per_page

    @property
    def offset(self) -> int:
        return (self.page - 1) * self.size


Key = tuple[str, bool]  # (column, descending)


def order_of(keys: list[Key] | list[Column]) -> list[Column]:
    """The sort expressions of ``keys`` (sort expressions stay as they are)."""
    return [k if isinstance(k, Column) else desc(k[0]) if k[1] else asc(k[0]) for k in keys]


@dataclass(frozen=True)
class KeptOrder:
    """A list's rows in their order, written once to the shared folder, range
    part by range part: ``parts`` holds (part, position of its first row, rows)
    for each part that has rows, one entry per task of the sort."""
    rows: DataFrame
    parts: tuple[tuple[int, int, int], ...]

    def cut(self, offset: int, size: int) -> DataFrame:
        """Rows ``offset`` to ``offset + size``, in order. Only the parts that
        the page touches are read; a page inside one part is a range of places
        that reaches the scan."""
        end = offset + size
        touched = [(part, first) for part, first, n in self.parts if first < end and first + n > offset]
        if not touched:
            return self.rows.drop("_part", "_at").limit(0)
        near = self.rows.filter(F.col("_part").between(touched[0][0], touched[-1][0]))
        if len(touched) == 1:
            first = touched[0][1]
            near = near.filter(F.col("_at").between(offset - first, end - 1 - first))
        else:
            # One row per touched part, and those lie side by side.
            firsts = self.rows.sparkSession.createDataFrame(touched, "_part long, _first long")
            at = F.col("_first") + F.col("_at")
            near = near.join(F.broadcast(firsts), "_part").filter(at.between(offset, end - 1)).drop("_first")
        return near.orderBy("_part", "_at").drop("_part", "_at")


# The orders kept for a set of tables: (columns, plan hash) -> (sorted frame, its kept rows).
Orders = dict[tuple, list[tuple[DataFrame, KeptOrder]]]


def keep_order(df: DataFrame, order: list[Column]) -> KeptOrder:
    """Sort ``df`` once over all tasks and write it with each row's part and
    place; one count per part then gives the position of its first row."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    path = scratch_dir(df.sparkSession, f"order-{uuid.uuid4().hex}")
    # The low 33 bits number the rows inside a partition, in sorted order.
    at = F.monotonically_increasing_id()
    ranged.withColumns({"_part": F.shiftright(at, 33), "_at": at.bitwiseAND(F.lit((1 << 33) - 1))}).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    first, parts = 0, []
    for r in rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect():
        parts.append((r["_part"], first, r["n"]))
        first += r["n"]
    return KeptOrder(rows, tuple(parts))


def _order_kept(df: DataFrame, order: list[Column], orders: Orders, make: bool) -> KeptOrder | None:
    """The kept order of a list with the same plan, order and column names, or
    else (``make``) a new one."""
    if not (make or orders):
        return None
    wanted = df.orderBy(*order)
    key = (tuple(df.columns), wanted.semanticHash())
    for frame, kept in orders.get(key, []):
        if frame.sameSemantics(wanted):
            return kept
    if not make:
        return None
    kept = keep_order(df, order)
    orders.setdefault(key, []).append((wanted, kept))
    return kept


def page(df: DataFrame, keys: list[Key] | list[Column], spec: PageSpec, after: tuple | None = None,
         orders: Orders | None = None) -> DataFrame:
    """One page of ``df`` sorted by ``keys`` (which should end in a unique
    key). With ``after`` (the sort-key values of the last row seen; needs keys
    by name) the page that follows that row, whatever ``spec.page`` says.

    ``orders`` (``Tables.kept_orders``) remembers the sorted lists that deep
    pages needed: the next page of such a list sorts nothing. They show the
    tables as loaded, as every report over them does.
    """
    if after is not None:
        return seek_page(df, keys, after, spec.size)
    order = order_of(keys)
    deep = spec.offset + spec.size > TOP_K_ROWS
    kept = _order_kept(df, order, {} if orders is None else orders, make=deep)
    if kept is not None:
        return kept.cut(spec.offset, spec.size)
    out = df.orderBy(*order)
    if spec.offset:
        out = out.offset(spec.offset)
    return out.limit(spec.size)


def page_info(total: DataFrame, spec: PageSpec, total_col: str = "total") -> DataFrame:
    """Page metadata from a one-row total: page, per_page, total, pages and
    the ``from``-``to`` range shown under a table."""
    t = F.col(total_col)
    n = F.lit(spec.size).cast("long")
    return total.select(
        F.lit(spec.page).cast("long").alias("page"),
        n.alias("per_page"),
        t.cast("long").alias("total"),
        F.floor((t + n - 1) / n).cast("long").alias("pages"),
        F.lit(spec.offset + 1).cast("long").alias("first_row"),
        F.least(F.lit(spec.page * spec.size).cast("long"), t.cast("long")).alias("last_row"))


def _after(col: Column, value, descending: bool) -> Column:
    """Rows strictly after ``value`` in one sort key, PostgreSQL placement
    (ASC: NULLs last; DESC: NULLs first)."""
    if descending:
        return col.isNotNull() if value is None else (col < F.lit(value))
    return F.lit(False) if value is None else ((col > F.lit(value)) | col.isNull())


def seek_page(df: DataFrame, keys: list[tuple[str, bool]], after: tuple | None,
              size: int) -> DataFrame:
    """Keyset page: the ``size`` rows following the row whose sort-key values
    are ``after`` (None for the first page).

    ``keys`` is ``[(column, descending), ...]`` and must end in a unique key.
    The predicate ``(k1, k2, ...) > after`` (lexicographic, NULL placement as
    in :func:`asc`/:func:`desc`) is a plain filter, so each task keeps only
    ``size`` rows however deep the page is — unlike OFFSET, whose cost grows
    with the page number.
    """
    if size < 1:
        raise ValueError("size must be >= 1")
    out = df
    if after is not None:
        if len(after) != len(keys):
            raise ValueError("after must hold one value per sort key")
        pred = None
        for i, (name, descending) in enumerate(keys):
            term = _after(F.col(name), after[i], descending)
            for j, (pname, _) in enumerate(keys[:i]):
                term = term & F.col(pname).eqNullSafe(F.lit(after[j]))
            pred = term if pred is None else pred | term
        out = out.filter(pred)
    order = order_of(keys)
    return keep_order(out, order).cut(0, size) if size > TOP_K_ROWS else out.orderBy(*order).limit(size)
