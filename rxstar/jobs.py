"""Batch jobs for spark-submit: load the star and the openFDA source tables from landed inputs.

    spark-submit --conf spark.checkpoint.dir=hdfs:///tmp/ck rxstar/jobs.py etl \\
        --raw hdfs:///landing/import_raw --out hdfs:///warehouse/star [--existing hdfs:///warehouse/star]
    spark-submit rxstar/jobs.py openfda --ndc hdfs:///landing/ndc --events hdfs:///landing/event \\
        --out hdfs:///warehouse/sources --fetched-at 2026-06-01T09:00:00+00:00

The session comes from the cluster's configuration (``getOrCreate``); the jobs
set nothing on it.  Intermediate tables go to ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

if __package__ in (None, ""):  # run as a script by spark-submit
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from rxstar.operators.fact import run_etl
    from rxstar.functions.collation import BINARY, LCASE
    from rxstar.operators.load import load_source
    from rxstar.plans.warehouse import read_star
    from rxstar.schemas import IMPORT_RAW
    from rxstar.sources import openfda as S
    from rxstar.functions.materialize import scratch_scope
    from rxstar.operators.staging import load_rejects
    from rxstar.sources.raw import scan_import_raw, scan_import_raw_checked
else:
    from .operators.fact import run_etl
    from .functions.collation import BINARY, LCASE
    from .operators.load import load_source
    from .plans.warehouse import read_star
    from .schemas import IMPORT_RAW
    from .sources import openfda as S
    from .functions.materialize import scratch_scope
    from .operators.staging import load_rejects
    from .sources.raw import scan_import_raw, scan_import_raw_checked


def etl(
    spark: SparkSession, raw_path: str, out: str, existing: str | None = None, fmt: str = "parquet",
    rejects: str | None = None, collation: str = BINARY,
) -> dict:
    """Landed ``import_raw`` -> star under ``out``; dimension ids of ``existing`` are kept.

    ``existing`` may be ``out`` itself: the load writes a new version beside the one it reads.
    With ``rejects`` the lines that the scan cannot read and the rows that the staging drops are
    stored there (CSV input: nothing is lost).
    """
    broken = spark.createDataFrame([], "Transaction_ID string, reason string")
    if fmt == "csv" and rejects:
        raw, broken = scan_import_raw_checked(spark, raw_path)
    elif fmt == "csv":
        raw = scan_import_raw(spark, raw_path)
    else:
        raw = spark.read.schema(IMPORT_RAW).format(fmt).load(raw_path)
    if rejects:
        load_rejects(broken, raw).write.mode("overwrite").parquet(rejects)
    star = run_etl(raw, existing=read_star(spark, existing, collation) if existing else None, out=out, collation=collation)
    return {"fact_rows": star.fact.count(), **star.dim_rows}


def openfda(spark: SparkSession, ndc_path: str, events_path: str, out: str, fetched_at: str) -> dict:
    """S4/S6 + U2 + U3: landed pages -> source_ndc_products, source_drug_events, source_metadata."""
    with scratch_scope(spark):
        ndc = load_source(S.read_pages(spark, ndc_path, "ndc"), S.flatten_ndc, "openfda_ndc", ["product_ndc"], fetched_at)
        events = load_source(
            S.read_pages(spark, events_path, "event"), S.flatten_events, "openfda_event", ["safetyreportid"], fetched_at)
        ndc.current.write.mode("overwrite").parquet(f"{out}/source_ndc_products")
        events.current.write.mode("overwrite").parquet(f"{out}/source_drug_events")
        ndc.metadata.unionByName(events.metadata).write.mode("overwrite").parquet(f"{out}/source_metadata")
    return {name: spark.read.parquet(f"{out}/{name}").count()
            for name in ("source_ndc_products", "source_drug_events", "source_metadata")}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    parser = argparse.ArgumentParser(prog="rxstar.jobs")
    sub = parser.add_subparsers(dest="job", required=True)
    p_etl = sub.add_parser("etl")
    p_etl.add_argument("--raw", required=True)
    p_etl.add_argument("--out", required=True)
    p_etl.add_argument("--existing")
    p_etl.add_argument("--format", default="parquet")
    p_etl.add_argument("--rejects")
    p_etl.add_argument("--collation", default=BINARY, choices=[BINARY, LCASE])
    p_fda = sub.add_parser("openfda")
    p_fda.add_argument("--ndc", required=True)
    p_fda.add_argument("--events", required=True)
    p_fda.add_argument("--out", required=True)
    p_fda.add_argument("--fetched-at", required=True)
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"rxstar-{args.job}").getOrCreate()
    if args.job == "etl":
        result = etl(spark, args.raw, args.out, args.existing, args.format, args.rejects, args.collation)
    else:
        result = openfda(spark, args.ndc, args.events, args.out, args.fetched_at)
    print(result)
    return result


if __name__ == "__main__":
    main()
