"""Raw text rows -> typed staging rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import cleaning as C


def typed_columns(raw: DataFrame) -> list:
    """T1-T4 on the landing columns; eight staging columns, Transaction_ID dropped."""
    return [
        C.parse_sale_timestamp(F.col("Sale_Timestamp")).alias("Sale_Timestamp"),
        C.trim_spaces(F.col("Manufacturer")).alias("Manufacturer"),
        C.trim_spaces(F.col("Drug_Name")).alias("Drug_Name"),
        C.parse_price(F.col("Price")).alias("Price"),
        C.trim_spaces(F.col("Drug_Type")).alias("Drug_Type"),
        C.normalize_flag(F.col("Is_Refunded")).alias("Is_Refunded"),
        C.trim_spaces(F.col("Condition_Treated")).alias("Condition_Treated"),
        C.trim_spaces(F.col("City")).alias("City"),
    ]


def keep_predicate() -> F.Column:
    """T5: drug, manufacturer, city and (parsed) price present."""
    return (
        F.col("Drug_Name").isNotNull()
        & F.col("Manufacturer").isNotNull()
        & F.col("City").isNotNull()
        & F.col("Price").isNotNull()
    )


def stage_sales(raw: DataFrame) -> DataFrame:
    """One narrow select + filter; duplicates kept, null condition/type/timestamp kept."""
    return raw.select(*typed_columns(raw)).filter(keep_predicate())


def load_rejects(broken: DataFrame, raw: DataFrame) -> DataFrame:
    """T7 for a whole load: lines the scan could not read, and rows the staging drops (Transaction_ID, stage, reason)."""
    lines = broken.select("Transaction_ID", F.lit("scan").alias("stage"), "reason")
    return lines.unionByName(stage_rejects(raw).select("Transaction_ID", F.lit("staging").alias("stage"), "reason"))


def stage_rejects(raw: DataFrame) -> DataFrame:
    """Rows the staging drops, or whose timestamp cannot be parsed, with the first reason."""
    ts = C.parse_sale_timestamp(F.col("Sale_Timestamp"))
    price = C.parse_price(F.col("Price"))
    reason = (
        F.when(F.col("Drug_Name").isNull(), F.lit("missing drug"))
        .when(F.col("Manufacturer").isNull(), F.lit("missing manufacturer"))
        .when(F.col("City").isNull(), F.lit("missing city"))
        .when(F.col("Price").isNull(), F.lit("missing price"))
        .when(price.isNull(), F.lit("bad price"))
        .when(F.col("Sale_Timestamp").isNull(), F.lit("missing timestamp"))
        .when(ts.isNull(), F.lit("bad timestamp"))
    )
    return raw.select("Transaction_ID", reason.alias("reason")).filter(F.col("reason").isNotNull())
