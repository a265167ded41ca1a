"""The reports: listings, drill-downs, country dashboard, overview."""

from . import dashboard, drilldowns, listings, overview, responses  # noqa: F401
