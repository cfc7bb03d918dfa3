"""marginlens: marketplace margin and returns analytics as Spark DataFrame queries.

Layout:
  sources/    schemas, CSV and test-table loaders, the load (materialize) step
  functions/  shared measures as Column builders (DIV0, contribution margin, ...)
  operators/  the queries, each ``Tables -> DataFrame`` and lazy
  plans/      the query registry, session settings and the DuckDB oracle text
  streaming/  intentionally empty: the reference has no streaming
"""

from .sources.tables import Tables

__all__ = ["Tables"]
