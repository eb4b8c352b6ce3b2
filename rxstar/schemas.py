"""Declared schemas of the warehouse tables (never inferred)."""

from __future__ import annotations

from pyspark.sql import types as T

S = T.StringType()

# Landing table: every column is text, nothing is cast yet.
IMPORT_RAW = T.StructType(
    [
        T.StructField(name, S, True)
        for name in (
            "Transaction_ID",
            "Sale_Timestamp",
            "Manufacturer",
            "Drug_Name",
            "Price",
            "Drug_Type",
            "Is_Refunded",
            "Condition_Treated",
            "City",
        )
    ]
)

# Typed staging table.  Transaction_ID is dropped; duplicates are kept.
TEMP_STD = T.StructType(
    [
        T.StructField("Sale_Timestamp", T.TimestampNTZType(), True),
        T.StructField("Manufacturer", S, True),
        T.StructField("Drug_Name", S, True),
        T.StructField("Price", T.DecimalType(10, 2), True),
        T.StructField("Drug_Type", S, True),
        T.StructField("Is_Refunded", T.IntegerType(), False),
        T.StructField("Condition_Treated", S, True),
        T.StructField("City", S, True),
    ]
)

NAME_DIM = T.StructType([T.StructField("id", T.IntegerType(), False), T.StructField("dimName", S, False)])

TIME_DIM = T.StructType(
    [
        T.StructField("id", T.IntegerType(), False),
        T.StructField("timeDay", T.DateType(), False),
        T.StructField("timeWeekDay", T.IntegerType(), False),
        T.StructField("timeWeekNum", T.IntegerType(), False),
        T.StructField("timeMonth", S, True),
        T.StructField("timeYear", T.IntegerType(), True),
    ]
)

# The five name dimensions: table name -> staging column it is built from.
NAME_DIMENSIONS = {
    "dimCity": "City",
    "dimConTh": "Condition_Treated",
    "dimDrug": "Drug_Name",
    "dimDrugType": "Drug_Type",
    "dimMan": "Manufacturer",
}

# Fact foreign key -> dimension table.
FACT_KEYS = {
    "dimCity_id": "dimCity",
    "dimConTh_id": "dimConTh",
    "dimDrug_id": "dimDrug",
    "dimDrugType_id": "dimDrugType",
    "dimMan_id": "dimMan",
    "dimTime_id": "dimTime",
}

FACT_GRAIN = list(FACT_KEYS) + ["is_refunded"]

# Stored fact (exact measures) as it reads back: partition column last.
FACT_STORED = T.StructType(
    [T.StructField(k, T.IntegerType(), True) for k in FACT_KEYS]
    + [
        T.StructField("is_refunded", T.IntegerType(), True),
        T.StructField("cntDrug", T.LongType(), True),
        T.StructField("sumDrug", T.DecimalType(20, 2), True),
        T.StructField("minDrug", T.DecimalType(10, 2), True),
        T.StructField("maxDrug", T.DecimalType(10, 2), True),
        T.StructField("avgDrug", T.DoubleType(), True),
        T.StructField("id", T.LongType(), True),
        T.StructField("fact_year", T.IntegerType(), True),
    ]
)
FACT_MEASURES = ["cntDrug", "sumDrug", "avgDrug", "minDrug", "maxDrug"]
FACT_COLUMNS = ["id"] + FACT_GRAIN + FACT_MEASURES

SOURCE_METADATA = T.StructType(
    [
        T.StructField("source_key", S, False),
        T.StructField("source_name", S, False),
        T.StructField("source_url", S, False),
        T.StructField("records_loaded", T.LongType(), False),
        T.StructField("total_available", T.LongType(), True),
        T.StructField("fetched_at", S, True),
    ]
)

NDC_COLUMNS = [
    "product_ndc",
    "product_type_name",
    "proprietary_name",
    "nonproprietary_name",
    "labeler_name",
    "dosage_form",
    "route",
    "marketing_category",
    "start_marketing_date",
    "listing_expiration_date",
]

EVENT_COLUMNS = [
    "safetyreportid",
    "receivedate",
    "serious",
    "patientsex",
    "reaction",
    "medicinalproduct",
    "brand_name",
    "manufacturer_name",
]

_META = T.StructType(
    [T.StructField("results", T.StructType([T.StructField("total", T.LongType(), True)]), True)]
)

NDC_RECORD = T.StructType(
    [
        T.StructField(name, T.ArrayType(S) if name == "route" else S, True)
        for name in (
            "product_ndc",
            "product_type",
            "product_type_name",
            "brand_name",
            "proprietary_name",
            "generic_name",
            "nonproprietary_name",
            "labeler_name",
            "dosage_form",
            "route",
            "marketing_category",
            "marketing_start_date",
            "start_marketing_date",
            "listing_expiration_date",
        )
    ]
)

# One landed page of the NDC endpoint.
NDC_PAGE = T.StructType(
    [
        T.StructField("meta", _META, True),
        T.StructField("results", T.ArrayType(NDC_RECORD), True),
    ]
)

EVENT_DRUG = T.StructType(
    [
        T.StructField("medicinalproduct", S, True),
        T.StructField(
            "openfda",
            T.StructType(
                [
                    T.StructField("brand_name", T.ArrayType(S), True),
                    T.StructField("manufacturer_name", T.ArrayType(S), True),
                ]
            ),
            True,
        ),
    ]
)

EVENT_RECORD = T.StructType(
    [
        T.StructField("safetyreportid", S, True),
        T.StructField("receivedate", S, True),
        T.StructField("serious", S, True),
        T.StructField(
            "patient",
            T.StructType(
                [
                    T.StructField("patientsex", S, True),
                    T.StructField("drug", T.ArrayType(EVENT_DRUG), True),
                    T.StructField(
                        "reaction",
                        T.ArrayType(T.StructType([T.StructField("reactionmeddrapt", S, True)])),
                        True,
                    ),
                ]
            ),
            True,
        ),
    ]
)

# One landed page of the adverse-event endpoint.
EVENT_PAGE = T.StructType(
    [
        T.StructField("meta", _META, True),
        T.StructField("results", T.ArrayType(EVENT_RECORD), True),
    ]
)
