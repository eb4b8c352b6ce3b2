"""openFDA loaders (S4-S11): landed JSON pages -> flat source tables.

Pages are read with an explicit schema (never inferred), records are
exploded with their position, and every record carries ``seq`` = page offset
+ position: the order in which the reference would have inserted it, used by
limits and by keep-last.  Everything is per-record column work or a bounded
aggregate, so it runs spread over the pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ..functions.cleaning import first_of_list, first_present, list_to_text, truncate_text
from ..schemas import NDC_RECORD
from .landing import EVENT_PAGE_SIZE, page_schema
from .raw import BROKEN

# Fixed values of the reference's loaders.
EVENT_DATE_FROM = "20240101"
EVENT_DATE_TO = "20261231"
NDC_LOAD_CAP = 1000
EVENT_LOAD_CAP = 100

#: Parts that the reports of one month are dealt into.
EVENT_STORE_FILES = 16


def read_pages(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Landed pages with the declared schema."""
    return spark.read.schema(page_schema(kind)).json(path)


def read_pages_checked(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """The pages that can be read, and a reject row for each line that cannot: skip, reason, line.

    A line that is no JSON comes in the corrupt-record column of the parsed page; one that is, but
    has no list of results of the declared type, is no page.  Lines are read as text, so a rejected one is
    whole, and its offset is taken from the text where it is still there (the page can be fetched
    again).  Blank lines are no lines.
    """
    schema = T.StructType([*page_schema(kind).fields, T.StructField(BROKEN, T.StringType(), True)])
    lines = spark.read.text(path).where(F.trim("value") != "")
    pages = lines.select("value", F.from_json("value", schema, {"columnNameOfCorruptRecord": BROKEN}).alias("page"))
    # a line can be a reject for one reason only; a page that was read has neither
    readable = F.coalesce(F.col(f"page.{BROKEN}").isNull() & F.col("page.results").isNotNull(), F.lit(False))
    reason = F.when(F.try_parse_json("value").isNull(), F.lit("not JSON")).otherwise(F.lit("not a page"))
    skip = F.regexp_extract("value", r'"skip"\s*:\s*([0-9]+)', 1).try_cast(T.LongType())
    rejects = pages.where(~readable).select(skip.alias("skip"), reason.alias("reason"), F.col("value").alias("line"))
    return pages.where(readable).select(*[F.col(f"page.{f.name}") for f in page_schema(kind).fields]), rejects


def records(pages: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per record: ``seq`` (global insert position), ``skip``, ``total`` and the record struct ``r``.

    ``carry``: columns of the page that its records keep.
    """
    return pages.select(
        *carry, "skip", F.col("meta.results.total").alias("total"), F.posexplode("results").alias("pos", "r")
    ).select(*carry, (F.col("skip") + F.col("pos")).alias("seq"), "skip", "total", "r")


def paged_records(pages: DataFrame, limit: int, page_size: int = EVENT_PAGE_SIZE) -> DataFrame:
    """Records in insert order up to ``limit``; pages after the first short page are not read.

    The first short page is found with an aggregate over page sizes (one
    scalar), so no page list passes through the driver.
    """
    sized = pages.withColumn("_n", F.coalesce(F.size("results"), F.lit(0)))
    last_read = sized.where(F.col("_n") < page_size).select(
        F.coalesce(F.min("skip"), F.lit(2**63 - 1).cast("long"))
    ).scalar()
    kept = sized.where(F.col("skip") <= last_read).drop("_n")
    return records(kept).where(F.col("seq") < limit)


def total_available(pages: DataFrame) -> DataFrame:
    """``meta.results.total`` of the last page read (largest offset)."""
    return pages.agg(F.max_by("meta.results.total", "skip").alias("total_available"))


def flatten_ndc(recs: DataFrame) -> DataFrame:
    """NDC record -> 10 columns with the alias fallbacks (``a or b``)."""
    r = lambda n: F.col(f"r.{n}")
    route_type = NDC_RECORD["route"].dataType
    return recs.select(
        "seq",
        r("product_ndc").alias("product_ndc"),
        F.coalesce(r("product_type"), r("product_type_name")).alias("product_type_name"),
        first_present(r("brand_name"), r("proprietary_name")).alias("proprietary_name"),
        first_present(r("generic_name"), r("nonproprietary_name")).alias("nonproprietary_name"),
        r("labeler_name").alias("labeler_name"),
        r("dosage_form").alias("dosage_form"),
        list_to_text(r("route"), route_type).alias("route"),
        r("marketing_category").alias("marketing_category"),
        first_present(r("marketing_start_date"), r("start_marketing_date")).alias("start_marketing_date"),
        r("listing_expiration_date").alias("listing_expiration_date"),
    )


def flatten_ndc_strict(recs: DataFrame) -> DataFrame:
    """The second loader's names, no fallbacks, text cut to 1000 characters."""
    r = lambda n: F.col(f"r.{n}")
    route_type = NDC_RECORD["route"].dataType
    cols = {
        "product_ndc": r("product_ndc"),
        "product_type_name": r("product_type"),
        "proprietary_name": r("brand_name"),
        "nonproprietary_name": r("generic_name"),
        "labeler_name": r("labeler_name"),
        "dosage_form": r("dosage_form"),
        "route": list_to_text(r("route"), route_type),
        "marketing_category": r("marketing_category"),
        "start_marketing_date": r("marketing_start_date"),
        "listing_expiration_date": r("listing_expiration_date"),
    }
    return recs.select("seq", *[truncate_text(c).alias(n) for n, c in cols.items()])


def _first_drug() -> Column:
    return first_of_list(F.col("r.patient.drug"))


def flatten_events(recs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Report -> first drug, first reaction, first brand, first manufacturer.

    K1: ``serious_code`` is the report's code as INT (0 when missing), ``serious`` is 1 for code 1 alone.
    """
    drug = _first_drug()
    code = F.coalesce(F.nullif(F.col("r.serious"), F.lit("")), F.lit("0")).try_cast(T.IntegerType())
    return recs.select(
        *carry,
        "seq",
        F.col("r.safetyreportid").alias("safetyreportid"),
        F.col("r.receivedate").alias("receivedate"),
        code.alias("serious_code"),
        F.coalesce((code == 1).cast(T.IntegerType()), F.lit(0)).alias("serious"),
        F.col("r.patient.patientsex").alias("patientsex"),
        first_of_list(F.col("r.patient.reaction"))["reactionmeddrapt"].alias("reaction"),
        drug["medicinalproduct"].alias("medicinalproduct"),
        first_of_list(drug["openfda"]["brand_name"]).alias("brand_name"),
        first_of_list(drug["openfda"]["manufacturer_name"]).alias("manufacturer_name"),
    )


def flatten_events_blank(recs: DataFrame) -> DataFrame:
    """Serious is 1 only for code '1'; missing brand/manufacturer become ''; text cut to 1000."""
    drug = _first_drug()
    blank = lambda c: F.coalesce(c, F.lit(""))
    return recs.select(
        "seq",
        truncate_text(F.col("r.safetyreportid")).alias("safetyreportid"),
        truncate_text(F.col("r.receivedate")).alias("receivedate"),
        F.when(F.col("r.serious") == "1", F.lit(1)).otherwise(F.lit(0)).alias("serious"),
        truncate_text(F.col("r.patient.patientsex")).alias("patientsex"),
        truncate_text(first_of_list(F.col("r.patient.reaction"))["reactionmeddrapt"]).alias("reaction"),
        truncate_text(drug["medicinalproduct"]).alias("medicinalproduct"),
        truncate_text(blank(first_of_list(drug["openfda"]["brand_name"]))).alias("brand_name"),
        truncate_text(blank(first_of_list(drug["openfda"]["manufacturer_name"]))).alias("manufacturer_name"),
    )


def event_date_range(events: DataFrame, start: str = EVENT_DATE_FROM, end: str = EVENT_DATE_TO) -> DataFrame:
    """Receivedate within [start, end]; fixed-width yyyyMMdd text sorts as dates."""
    return events.where(F.col("receivedate").between(F.lit(start), F.lit(end)))


def write_event_store(events: DataFrame, path: str) -> None:
    """Store flattened reports by the month they were received in.

    Months that ``events`` has are replaced, all others stay (dynamic overwrite), so a range can be
    loaded again by itself.  Rows are dealt by month and a hash of the report: a month that holds a
    third of all reports is several tasks and files.
    """
    month = F.substring("receivedate", 1, 6)
    spread = F.pmod(F.xxhash64("safetyreportid"), F.lit(EVENT_STORE_FILES))
    dealt = events.withColumn("received_month", month).repartition("received_month", spread)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("received_month").parquet(path)


def read_event_range(spark: SparkSession, path: str, start: str = EVENT_DATE_FROM, end: str = EVENT_DATE_TO) -> DataFrame:
    """S10 on the event store: only the folders of the months from ``start`` to ``end`` are read."""
    stored = spark.read.option("basePath", path).parquet(path)
    months = F.col("received_month").cast("string").between(start[:6], end[:6])
    return event_date_range(stored.where(months), start, end).drop("received_month")


def load_limit(recs: DataFrame, limit: int, cap: int) -> DataFrame:
    """The first ``min(limit, cap)`` records in insert order (a top-k on ``seq``)."""
    n = max(min(limit, cap), 0)
    return recs.orderBy("seq").limit(n)
