"""The stored star: run the ETL once, write Parquet to the shared folder, read it back.

Dashboard queries read the stored tables, as the reference's dashboard reads
its database: dimension sizes are counted once at load (one small aggregate)
so every broadcast of a dimension is size-checked, and the fact is
partitioned by ``fact_year`` so a year filter prunes files.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable

from pyspark.sql import SparkSession, functions as F

from ..functions.collation import BINARY
from ..operators.fact import Star, read_dimensions, read_stored, run_etl, write_dimensions, write_fact
from ..operators.sinks import commit_version, latest_version, version_path
from ..schemas import FACT_STORED, NAME_DIMENSIONS
from ..functions.once import once
from ..session import shared_dir
from ..sources.fixtures import landed_raw_sales as raw_sales

_STARS: dict[tuple, Star] = {}
_OPEN: dict[tuple, tuple] = {}


def warehouse_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/rxstar-warehouse/{spark.sparkContext.applicationId}"


def write_star(star: Star, path: str) -> None:
    """Full reload of every table, as a new version that becomes current when it is whole."""
    spark = star.fact.sparkSession
    version = latest_version(spark, path) + 1
    root = version_path(path, version)
    names = None
    for name in NAME_DIMENSIONS:
        part = star.dims[name].select(F.lit(name).alias("dim"), "id", "dimName")
        names = part if names is None else names.unionByName(part)
    write_dimensions(names, star.dims["dimTime"], root)
    write_fact(star.fact, root)
    commit_version(spark, path, version)


def read_star(spark: SparkSession, path: str, collation: str = BINARY) -> Star:
    """The current version of the star under ``path``; one version's own folder can be given too.

    ``collation`` is the one that the star was loaded with.
    """
    version = latest_version(spark, path)
    root = version_path(path, version) if version else path
    dims, rows, text = read_dimensions(spark, root)
    return Star(read_stored(spark, f"{root}/factDrug", FACT_STORED), dims, rows, text, root, collation)


def sales_star(spark: SparkSession, sf_dir: str, kind: str = "A", collation: str = BINARY) -> Star:
    """The star loaded from mapping ``kind`` of ``sf_dir``; built once per application."""
    key = (spark.sparkContext.applicationId, os.path.abspath(sf_dir), kind, collation)

    def build() -> Star:
        tag = hashlib.sha1(f"{os.path.abspath(sf_dir)}|{kind}|{collation}".encode()).hexdigest()[:12]
        return run_etl(raw_sales(spark, sf_dir, kind), out=f"{warehouse_root(spark)}/star-{kind}-{tag}", collation=collation)

    return once(_STARS, key, build)


def open_table(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], tuple]) -> tuple:
    """One stored openFDA source table, loaded once per application, and what else its load gave.

    ``build`` is its load: the table and anything beside it.  The table is written as Parquet and read
    back, as the reference stores its source tables before the dashboard reads them.
    """
    key = (spark.sparkContext.applicationId, os.path.abspath(sf_dir), name)

    def load() -> tuple:
        tag = hashlib.sha1(os.path.abspath(sf_dir).encode()).hexdigest()[:12]
        path = f"{warehouse_root(spark)}/sources-{tag}/{name}"
        df, beside = build()
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path), beside

    return once(_OPEN, key, load)
