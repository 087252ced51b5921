"""All registered queries."""

from workload import profiling, cleaning, text  # noqa: F401  (registering)
from workload.catalog import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
