"""Named analyses (Spark) and their SQL oracles.

Importing this package registers every analysis in ``catalog.QUERIES`` and
``catalog.ORACLE``.
"""

from . import catalog
from . import order_queries, line_queries, report_queries  # noqa: F401  (registers)

QUERIES = catalog.QUERIES
ORACLE = catalog.ORACLE

__all__ = ["QUERIES", "ORACLE", "catalog"]
