"""podium — competition-results analytics as composable PySpark DataFrame
operators over an eight-table star schema (competitions, ranking categories,
countries, athletes, disciplines, events, races and the results fact).

Entry points: :func:`podium.sources.tables.load_tables` (lake),
:func:`podium.sources.tables.load_jdbc` (live database), and the reports in
:mod:`podium.plans`.
"""

from .sources.tables import Tables, from_frames, load_jdbc, load_tables  # noqa: F401
