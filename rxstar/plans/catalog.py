"""The stored tables as session views under the reference's table names.

With the views registered, the dashboard's SQL runs through ``spark.sql``
(ANSI SQL: LEFT JOINs, COALESCE, CASE, ORDER BY ... LIMIT) and Catalyst plans
it exactly like the DataFrame builders: predicate pushdown, pruning, broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.raw import scan_full_table

from ..operators.fact import Star


def register_star(spark: SparkSession, star: Star, sources: dict[str, DataFrame] | None = None) -> list[str]:
    """Create or replace temp views factDrug, dimCity ... dimTime (and the source tables)."""
    names = []
    star.fact.createOrReplaceTempView("factDrug")
    names.append("factDrug")
    for name, df in star.dims.items():
        df.createOrReplaceTempView(name)
        names.append(name)
    for name, df in (sources or {}).items():
        df.createOrReplaceTempView(name)
        names.append(name)
    return names


def export_tables(spark: SparkSession, out: str, names: list[str] | None = None) -> list[str]:
    """S3: write whole tables under ``out`` as the session's catalog lists them, each with all of its columns.

    ``names`` restricts the export; a name that the catalog does not have is a KeyError.  Returns
    the names written.  Nothing is known here of a table but its name: columns come from the catalog.
    """
    listed = {t.name.lower(): t.name for t in spark.catalog.listTables()}
    wanted = names if names is not None else sorted(listed.values())
    unknown = [n for n in wanted if n.lower() not in listed]
    if unknown:
        raise KeyError(f"not in the catalog: {', '.join(unknown)}")
    for name in wanted:
        scan_full_table(spark, name).write.mode("overwrite").parquet(f"{out}/{name}")
    return wanted
