"""Landing-table and warehouse-table scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ..schemas import IMPORT_RAW

# CSV settings that keep text exactly: no trimming, NULL (\\N) distinct from '' (written quoted).
CSV_OPTIONS = {
    "header": "true",
    "nullValue": "\\N",
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "escape": '"',
}

# without emptyValue '' is written as "", which the scan tells from a missing value
WRITE_OPTIONS = {k: v for k, v in CSV_OPTIONS.items() if k != "emptyValue"}


def land_csv(df: DataFrame, path: str) -> None:
    """Write a landing table as CSV text files."""
    df.write.mode("overwrite").options(**WRITE_OPTIONS).csv(path)


#: Where the reader puts the text of a line that does not fit the schema.
BROKEN = "_broken"


def scan_import_raw_checked(spark: SparkSession, path: str, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """S1 where nothing is lost: the rows that have nine fields, and a reject row for each other line.

    Lines are read as text, so a rejected one is whole.  With ``header`` lines that are the
    header's names are no data.  Rejects: Transaction_ID (the line's first field), reason, line.
    """
    schema = T.StructType([*IMPORT_RAW.fields, T.StructField(BROKEN, T.StringType(), True)])
    options = {k: v for k, v in CSV_OPTIONS.items() if k != "header"} | {"columnNameOfCorruptRecord": BROKEN}
    lines = spark.read.text(path).where(F.col("value") != "")
    if header:
        lines = lines.where(F.col("value") != ",".join(IMPORT_RAW.names))
    rows = lines.select("value", F.from_csv("value", ", ".join(f"{f.name} string" for f in schema), options).alias("row"))
    broken = F.col(f"row.{BROKEN}")
    # separators outside quotes
    fields = F.length(F.regexp_replace(F.regexp_replace("value", '"([^"]|"")*"', ""), "[^,]", "")) + 1
    reason = (
        F.when(fields < len(IMPORT_RAW), F.lit("too few fields"))
        .when(fields > len(IMPORT_RAW), F.lit("too many fields"))
        .otherwise(F.lit("broken line"))
    )
    rejects = rows.where(broken.isNotNull()).select("row.Transaction_ID", reason.alias("reason"), F.col("value").alias("line"))
    return rows.where(broken.isNull()).select(*[F.col(f"row.{c}") for c in IMPORT_RAW.names]), rejects


def scan_import_raw(spark: SparkSession, path: str) -> DataFrame:
    """Landed sales text with the fixed 9-column text schema; nothing is cast."""
    return spark.read.schema(IMPORT_RAW).options(**CSV_OPTIONS).csv(path)


def scan_projection(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fixed column list, ordered by ``id`` when present, else by the first column."""
    key = "id" if "id" in columns else columns[0]
    return df.select(*columns).orderBy(key)


def scan_full_table(spark: SparkSession, name: str) -> DataFrame:
    """S3: every column of a table that the catalog knows by ``name``."""
    columns = [c.name for c in spark.catalog.listColumns(name)]
    return spark.table(name).select(*[f"`{c}`" for c in columns])
