"""Search predicates: wildcard (ILIKE) searches with the reference's gates and
mode switch, and literal case-insensitive contains.

The search term is a driver-side parameter; it is turned into a pattern once
and the predicate runs on executors like any other filter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import c

LIKE_SPECIAL = "%_\\"


def like_pattern(term: str) -> str:
    """``'%' || term || '%'`` for Spark's ILIKE (escape character ``\\``).

    ``%`` and ``_`` inside the term stay wildcards, as in the reference.
    PostgreSQL reads a backslash before an ordinary character as that
    character, while Spark rejects it, so such backslashes are dropped.
    """
    out, i = [], 0
    while i < len(term):
        ch = term[i]
        if ch == "\\" and i + 1 < len(term):
            nxt = term[i + 1]
            out.append(ch + nxt if nxt in LIKE_SPECIAL else nxt)
            i += 2
            continue
        out.append(ch)
        i += 1
    return "%" + "".join(out) + "%"


def literal_runs(pattern: str, least: int) -> list[str]:
    """The ASCII pieces, in lower case, that a text must hold to match an ILIKE
    pattern: what stands between wildcards, ``least`` characters or longer.
    Other characters part the pieces (their case is the engine's matter)."""
    runs, i = [""], 0
    while i < len(pattern):
        ch = pattern[i]
        escaped = ch == "\\" and i + 1 < len(pattern)
        if escaped:
            i += 1
            ch = pattern[i]
        if ch.isascii() and (escaped or ch not in "%_"):
            runs[-1] += ch.lower()
        else:
            runs.append("")
        i += 1
    return [r for r in runs if len(r) >= least]


def ilike_any(cols: list[str | Column], term: str) -> Column:
    """OR of ``col ILIKE '%term%'`` over ``cols`` (NULL columns never match)."""
    pat = like_pattern(term)
    return reduce(lambda a, b: a | b, [c(x).ilike(pat) for x in cols])


def gate(term: str | None, min_len: int = 1, strip: bool = False) -> str | None:
    """The term to search for, or None when the search is switched off.

    ``strip`` removes surrounding blanks first; terms shorter than
    ``min_len`` switch the search off (list gates then return everything).
    """
    if term is None:
        return None
    t = term.strip() if strip else term
    if len(t) < max(min_len, 1):
        return None
    return t


def looks_like_country_code(term: str) -> bool:
    """Python's rule as the reference applies it: at most three characters
    and ``str.isupper()`` ('A1' yes, '12' no, 'sgp' no)."""
    return len(term) <= 3 and term.isupper()


ATHLETE_NAME_COLS = ["full_name", "family_name", "given_name"]


def athlete_search(term: str | None, min_len: int = 2) -> Column | None:
    """v2 athlete search: stripped term, at least two characters; codes-like
    terms also search country code and country name, others names only."""
    t = gate(term, min_len=min_len, strip=True)
    if t is None:
        return None
    cols = list(ATHLETE_NAME_COLS)
    if looks_like_country_code(t):
        cols += ["country_code", "country_name"]
    return ilike_any(cols, t)


def athlete_search_basic(term: str | None) -> Column | None:
    """v1 athlete search: any non-empty raw term over three names and the
    country name."""
    t = gate(term, min_len=1, strip=False)
    return None if t is None else ilike_any(ATHLETE_NAME_COLS + ["country_name"], t)


COMPETITION_SEARCH_COLS = ["name", "venue", "country_name"]


def competition_search(term: str | None, min_len: int = 1, strip: bool = False) -> Column | None:
    """Competition search over name, venue and country name. The list takes
    any non-empty raw term; the reference's count strips and needs two."""
    t = gate(term, min_len=min_len, strip=strip)
    return None if t is None else ilike_any(COMPETITION_SEARCH_COLS, t)


def contains_literal(cols: list[str | Column], term: str) -> Column:
    """Case-insensitive literal contains (no wildcards), OR-ed over ``cols``;
    a NULL column does not match."""
    t = term.lower()
    return reduce(lambda a, b: a | b, [F.lower(c(x)).contains(t) for x in cols])
