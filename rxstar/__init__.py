"""rxstar: a Spark-native drug-sales star schema and open-data loader.

Sub-packages
------------
functions  column-level helpers (cleaning, exact arithmetic, numbering, joins)
sources    scans of the input tables, test-table mappings and openFDA flatteners
operators  staging, dimensions, fact load, upserts, integrity checks, sinks
plans      dashboard filters, star join, aggregates, rankings and views
streaming  incremental load of landed openFDA pages
"""

__all__ = ["session"]
