"""Landed openFDA-shaped pages built from the test tables (stand-in input, mapping J).

The reference fetches JSON pages over HTTP; here the pages are landed as
JSON-lines files in the shared folder, one line per page:
``{"skip": s, "meta": {"results": {"total": n}}, "results": [...]}``.
``skip`` is the offset the page was requested with, which is the only order
information the loaders use.  These builders shape nested input only: the
flattening, first-element picks, limits and keep-last are the loaders' job.

Event reports: one per order; ``patient.drug`` holds the order's lines in
(l_linenumber, l_suppkey, p_name, l_returnflag) order.  An order has at most
a handful of lines (TPC-H bounds it), and a page at most 100 reports, so each
collected group is bounded by the schema.
NDC products: one per part, 1000 per page; ``product_ndc`` is brand + size, so
several parts share a code and the keep-last rule has real work.
"""

from __future__ import annotations

import hashlib
import os
import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schemas import EVENT_PAGE, NDC_PAGE
from ..functions.once import once
from ..session import shared_dir
from .tables import read_table

EVENT_PAGE_SIZE = 100
NDC_PAGE_SIZE = 1000

# Column expressions of mapping J (Spark SQL text, mirrored by the oracle).
EVENT_FIELDS = {
    # on every second page each tenth report is a re-issue of one of the page before
    "safetyreportid": "cast(CASE WHEN o_orderkey % 10 = 9 AND o_orderkey % 200 >= 100 THEN o_orderkey - 100 ELSE o_orderkey END AS string)",
    "receivedate": "date_format(add_months(o_orderdate, 300), 'yyyyMMdd')",
    "serious": "CASE WHEN o_orderstatus = 'F' THEN '1' ELSE '2' END",
    "patientsex": "CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE cast(o_custkey % 2 + 1 AS string) END",
}
DRUG_FIELDS = {
    "medicinalproduct": "p_name",
    "brand_name": "CASE WHEN l_linestatus = 'O' THEN array() ELSE array(upper(p_name), p_brand) END",
    "manufacturer_name": "CASE WHEN l_returnflag = 'R' THEN array() ELSE array(concat('Supplier-', cast(l_suppkey AS string))) END",
    "reactionmeddrapt": "CASE WHEN l_returnflag = 'N' AND l_linenumber % 2 = 0 THEN '' WHEN l_linenumber % 3 = 0 THEN upper(concat(p_type, ' ', get(split(p_name, ' '), 1))) ELSE concat(lower(p_type), ' ', get(split(p_name, ' '), 1)) END",
}
NDC_FIELDS = {
    "product_ndc": "concat(p_brand, '-', lpad(cast(p_size AS string), 3, '0'))",
    "product_type": "CASE WHEN p_size < 25 THEN 'HUMAN OTC DRUG' ELSE 'HUMAN PRESCRIPTION DRUG' END",
    "product_type_name": "CASE WHEN p_partkey % 9 = 0 THEN 'LEGACY TYPE' ELSE NULL END",
    "brand_name": "CASE WHEN p_partkey % 7 = 0 THEN '' WHEN p_partkey % 11 = 0 THEN NULL ELSE p_name END",
    "proprietary_name": "upper(p_name)",
    "generic_name": "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_type END",
    "nonproprietary_name": "lower(p_type)",
    "labeler_name": "CASE WHEN p_partkey % 50 = 0 THEN '' WHEN p_partkey % 6 = 0 THEN upper(p_brand) ELSE p_brand END",
    "dosage_form": "CASE WHEN p_size % 2 = 0 THEN 'TABLET' ELSE 'CAPSULE' END",
    "route": "CASE WHEN p_size % 13 = 0 THEN NULL WHEN p_size % 3 = 0 THEN array('ORAL', p_type) ELSE array('ORAL') END",
    "marketing_category": "p_type",
    "marketing_start_date": "CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE concat('20', lpad(cast(p_size % 25 AS string), 2, '0'), '0101') END",
    "start_marketing_date": "'19990101'",
    "listing_expiration_date": "CASE WHEN p_size > 45 THEN NULL ELSE '20271231' END",
}

_LANDED: dict[tuple, str] = {}
_BROKEN: dict[tuple, str] = {}


def _on_line(expr: str) -> str:
    """``expr`` on the line ``x`` of an array of them."""
    return re.sub(r"\b([lp]_\w+)", r"x.\1", expr)


# the sort key of a line, then the line as a drug and as a reaction
_LINE = _on_line(
    "named_struct('k1', l_linenumber, 'k2', l_suppkey, 'k3', p_name, 'k4', l_returnflag, "
    f"'drug', named_struct('medicinalproduct', {DRUG_FIELDS['medicinalproduct']}, 'openfda', "
    f"named_struct('brand_name', {DRUG_FIELDS['brand_name']}, 'manufacturer_name', {DRUG_FIELDS['manufacturer_name']})), "
    f"'reaction', named_struct('reactionmeddrapt', {DRUG_FIELDS['reactionmeddrapt']}))"
)


def event_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event pages.  Orders and lines are dealt by page once, as the columns that they have in the tables;
    reports and pages are made of them where they are then."""
    orders = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"])
    lines = read_table(
        spark, sf_dir, "lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"],
        spread_out=True,
    )
    part = read_table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_brand", "p_type"])

    def paged(df: DataFrame, key: str, value: str, columns: list[str]) -> DataFrame:
        page = (F.col(key) - F.col(key) % EVENT_PAGE_SIZE).alias("skip")
        return df.select(page, F.col(key).alias("o_orderkey"), F.struct(*columns).alias(value))

    drugs = lines.where(F.col("l_orderkey").isNotNull()).join(part, F.col("l_partkey") == F.col("p_partkey"))
    line = ["l_linenumber", "l_suppkey", "l_returnflag", "l_linestatus", "p_name", "p_brand", "p_type"]
    heads = paged(orders, "o_orderkey", "order", ["o_custkey", "o_orderstatus", "o_orderdate"])
    dealt = heads.unionByName(paged(drugs, "l_orderkey", "line", line), allowMissingColumns=True).repartition("skip")
    per_order = dealt.groupBy("skip", "o_orderkey").agg(F.collect_list("order").alias("orders"), F.collect_list("line").alias("lines"))
    # lines without an order drop out, an order without lines has no list of them
    found = per_order.select("skip", "o_orderkey", F.inline("orders"), F.when(F.size("lines") > 0, F.col("lines")).alias("lines"))
    found = found.withColumn("lines", F.expr(f"array_sort(transform(lines, x -> {_LINE}))"))
    reports = found.select(
        "skip",
        F.col("o_orderkey").alias("_k"),
        F.struct(
            *[F.expr(e).alias(n) for n, e in EVENT_FIELDS.items() if n != "patientsex"],
            F.struct(
                F.expr(EVENT_FIELDS["patientsex"]).alias("patientsex"),
                F.transform("lines", lambda x: x["drug"]).alias("drug"),
                F.transform("lines", lambda x: x["reaction"]).alias("reaction"),
            ).alias("patient"),
        ).alias("report"),
    )
    return _pages(reports, orders.select(F.count(F.lit(1))).scalar())


def ndc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_brand", "p_type", "p_size"])
    page = F.col("p_partkey") - F.col("p_partkey") % NDC_PAGE_SIZE
    reports = part.withColumn("skip", page).repartition("skip").select(
        "skip",
        F.col("p_partkey").alias("_k"),
        F.struct(*[F.expr(e).alias(n) for n, e in NDC_FIELDS.items()]).alias("report"),
    )
    return _pages(reports, part.select(F.count(F.lit(1))).scalar())


def _pages(reports: DataFrame, total) -> DataFrame:
    """One row per page: records of the page in key order (at most one page size of them)."""
    pages = reports.groupBy("skip").agg(F.array_sort(F.collect_list(F.struct("_k", "report"))).alias("r"))
    return pages.select(
        "skip",
        F.struct(F.struct(total.alias("total")).alias("results")).alias("meta"),
        F.transform("r", lambda x: x["report"]).alias("results"),
    )


def landed_page_set(spark: SparkSession, sf_dir: str, kind: str) -> str:
    """Land the pages of one source ('ndc' or 'event') once per application; returns the folder.

    The lines are compressed: a page repeats its field names for each record.
    """
    key = (spark.sparkContext.applicationId, os.path.abspath(sf_dir), kind)

    def land() -> str:
        tag = hashlib.sha1(os.path.abspath(sf_dir).encode()).hexdigest()[:12]
        path = f"{shared_dir(spark)}/rxstar-landing/{spark.sparkContext.applicationId}/{tag}/{kind}"
        build = {"ndc": ndc_pages, "event": event_pages}[kind]
        build(spark, sf_dir).write.mode("overwrite").json(path, compression="gzip")
        return path

    return once(_LANDED, key, land)


def landed_pages(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """Land both page sets once per application; returns {'ndc': path, 'event': path}."""
    return {kind: landed_page_set(spark, sf_dir, kind) for kind in ("ndc", "event")}


#: Pages are counted from 0; of eleven, one line is cut off and one has text in place of its results.
CUT_PAGE, WRONG_PAGE, PAGE_CYCLE = 3, 7, 11


def broken_event_pages(spark: SparkSession, sf_dir: str) -> str:
    """Land the event pages with planted faults, as lines of text; returns the folder."""
    key = (spark.sparkContext.applicationId, os.path.abspath(sf_dir))

    def land() -> str:
        path = f"{landed_page_set(spark, sf_dir, 'event')}-broken"
        line = F.to_json(F.struct("skip", "meta", "results"))
        at = (F.col("skip") / EVENT_PAGE_SIZE).cast("long") % PAGE_CYCLE
        wrong = F.to_json(F.struct("skip", "meta", F.lit("unavailable").alias("results")))
        text = F.when(at == CUT_PAGE, F.left(line, F.floor(F.length(line) / 2).cast("int"))).when(at == WRONG_PAGE, wrong).otherwise(line)
        pages = spark.read.schema(page_schema("event")).json(landed_page_set(spark, sf_dir, "event"))
        pages.select(text.alias("value")).write.mode("overwrite").text(path, compression="gzip")
        return path

    return once(_BROKEN, key, land)


def page_schema(kind: str):
    from pyspark.sql import types as T

    base = NDC_PAGE if kind == "ndc" else EVENT_PAGE
    return T.StructType([T.StructField("skip", T.LongType(), True), *base.fields])
