"""All queries of the panel engine by name, with their SQL."""

from .plans import anomalies, cleaning, features, forecasts, learning, overviews, reports, selection, tournament  # noqa: F401  they register their queries
from .plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
