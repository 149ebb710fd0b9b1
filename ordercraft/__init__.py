"""ordercraft: retail order analytics as composable Spark DataFrame transforms.

Every public transform has the shape ``f(df, ..., params) -> DataFrame`` so it
chains with ``df.transform``. Everything is expressed with built-in Spark SQL
expressions (no Python UDFs), so Catalyst can push filters and prune columns
into the scans and whole-stage codegen covers the hot paths.

Sub-packages
------------
sources     fixture views over the test tables, CSV export scans, sinks
functions   scalar column expressions (dates, text)
operators   cleaning, enrichment, order margin, shipping, customers,
            calendar buckets, subtotals, statistics, packaging
plans       the catalogue of named analyses and their SQL oracles
streaming   incremental ship-log feed (Structured Streaming)
"""

__version__ = "0.1.0"
