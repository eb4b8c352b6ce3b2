"""Fact load (D1-D7) and the ETL that chains staging, dimensions and fact.

Plan at scale: the staged rows are read once and aggregated at the fact grain
expressed in names (five names, day, refund flag), with map-side partial
aggregation, so a hot key costs one row per task.  Dimensions are derived
from that much smaller grain table, and the name -> id lookups run on it, not
on the staged rows.  Grouping by name equals grouping by id because every
dimension maps names to ids one to one.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, functions as F
from pyspark.sql import types as T

from ..functions.collation import BINARY, fold, representatives
from ..functions.exact import ratio
from ..functions.joins import bounded_broadcast
from ..functions.materialize import exists, materialize, scratch_path, scratch_scope
from ..functions.numbering import number_rows
from ..schemas import FACT_GRAIN, FACT_KEYS, FACT_MEASURES, NAME_DIM, NAME_DIMENSIONS
from ..schemas import TIME_DIM as TIME_DIM_SCHEMA
from .dimensions import time_attributes
from .sinks import commit_version, latest_version, version_path
from .staging import stage_sales
from .upsert import merge_rows

NAME_KEYS = list(NAME_DIMENSIONS.values())
TIME_DIM = "dimTime"


@dataclass
class Star:
    """The loaded star: fact plus six dimensions, with counted dimension sizes."""

    fact: DataFrame
    dims: dict[str, DataFrame]
    dim_rows: dict[str, int | None] = field(default_factory=dict)
    dim_bytes: dict[str, int | None] = field(default_factory=dict)
    path: str | None = None  # the folder of the version that is read
    collation: str = BINARY  # how names are compared (K3)
    measured: dict = field(default_factory=dict)  # figures of the stored tables, taken once

    def largest(self, dim: str) -> int:
        """The largest id of a dimension."""
        key = "largest", dim
        if key not in self.measured:
            self.measured[key] = int(self.dims[dim].agg(F.max("id")).first()[0] or 0)
        return self.measured[key]

    def largest_keys(self) -> dict[str, int]:
        """The largest id of each foreign key in the fact."""
        if "keys" not in self.measured:
            row = self.fact.agg(*[F.max(k).alias(k) for k in FACT_KEYS]).first()
            self.measured["keys"] = {k: int(row[k] or 0) for k in FACT_KEYS}
        return self.measured["keys"]

    def year_rows(self) -> dict[int | None, int]:
        """Fact rows of each stored year: read from file footers, one row for each year."""
        if "years" not in self.measured:
            counts = self.fact.groupBy("fact_year").agg(F.count(F.lit(1)).alias("n")).collect()
            self.measured["years"] = {r["fact_year"]: r["n"] for r in counts}
        return self.measured["years"]

    def dim(self, name: str, broadcast: bool = True) -> DataFrame:
        """A dimension, marked for broadcast when its measured rows and bytes are within bounds."""
        df = self.dims[name]
        if not broadcast:
            return df
        return bounded_broadcast(df, self.dim_rows.get(name), self.dim_bytes.get(name))


def grain_aggregate(staged: DataFrame, measure: str = "decimal") -> DataFrame:
    """Group staged rows by the five names, sale day and refund flag.

    ``measure='decimal'`` keeps exact DECIMAL sums, whose mean is left to
    ``with_mean``; ``'double'`` converts the price to DOUBLE first (D4, the SQL
    Server variant).
    """
    price = F.col("Price") if measure == "decimal" else F.col("Price").cast(T.DoubleType())
    aggs = [
        F.count(F.lit(1)).alias("cntDrug"),
        F.sum(price).alias("sumDrug"),
        F.min(price).alias("minDrug"),
        F.max(price).alias("maxDrug"),
    ]
    if measure != "decimal":
        aggs.append(F.avg(price).alias("avgDrug"))
    return staged.groupBy(
        *NAME_KEYS, F.to_date("Sale_Timestamp").alias("saleDay"), F.col("Is_Refunded").alias("is_refunded")
    ).agg(*aggs)


def with_mean(fact: DataFrame) -> DataFrame:
    """``avgDrug`` of exact sums, in its place among the measures; where it is there it stays.

    It follows from sum and count, so it is made when the fact is stored and not dealt with the rows.
    """
    if "avgDrug" in fact.columns:
        return fact
    mean = ratio(F.col("sumDrug"), F.col("cntDrug")).alias("avgDrug")
    measures = [mean if c == "avgDrug" else c for c in FACT_MEASURES]
    return fact.select(*FACT_GRAIN, *measures, *[c for c in fact.columns if c not in (*FACT_GRAIN, *FACT_MEASURES)])


DAY_TEXT = "yyyy-MM-dd"  # ISO day text sorts like the date (years 0000-9999)


def dimension_members(grain: DataFrame, existing: dict[str, DataFrame] | None = None, collation: str = BINARY) -> DataFrame:
    """M1-M9 in one distributed pass: (dim, id, dimName) for all six dimensions.

    The five name dimensions take the distinct non-null names; dimTime takes
    the distinct sale days as ISO text, so numbering by text is numbering by
    day.  Existing members keep their ids; new ones are appended after each
    dimension's current maximum (insert-if-absent, and for days the
    insert-or-update of the reference, whose other attributes are functions
    of the day and are derived again from it).  Names that the collation takes
    for equal are one member: the existing spelling, else the smallest.
    """
    members = [F.struct(F.lit(dim).alias("dim"), F.col(col).alias("dimName")) for dim, col in NAME_DIMENSIONS.items()]
    members.append(F.struct(F.lit(TIME_DIM).alias("dim"), F.date_format("saleDay", DAY_TEXT).alias("dimName")))
    found = grain.select(F.explode(F.array(*members)).alias("m")).select("m.dim", "m.dimName")
    found = representatives(found.where(F.col("dimName").isNotNull()), ["dim"], "dimName", collation)
    if not existing:
        numbered = number_rows(found, ["dimName"], id_type=T.IntegerType(), group_cols=["dim"])
        return numbered.select("dim", "id", "dimName")
    old = None
    for dim, df in existing.items():
        name = F.date_format("timeDay", DAY_TEXT) if dim == TIME_DIM else F.col("dimName")
        part = df.select(F.lit(dim).alias("dim"), "id", name.alias("dimName"))
        old = part if old is None else old.unionByName(part)
    return merge_rows(old, found, ["dim", "dimName"], number="id", groups=["dim"], match=lambda c: fold(c, collation))


def split_members(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The five name dimensions as (dim, id, dimName), and dimTime with its day attributes."""
    names = members.where(F.col("dim") != TIME_DIM)
    day = F.to_date(F.col("dimName"), DAY_TEXT)
    days = members.where(F.col("dim") == TIME_DIM).select("id", *time_attributes(day))
    return names, days


def _names(star_dims: Star, dim: str, value: F.Column) -> DataFrame:
    """One name dimension by its key: _key and ``value``."""
    return star_dims.dim(dim).select(fold(F.col("dimName"), star_dims.collation).alias("_key"), value)


def _join_names(df: DataFrame, star_dims: Star, value, how: str) -> DataFrame:
    """``df`` joined with each name dimension on the key of its name column."""
    for dim, col in NAME_DIMENSIONS.items():
        on = fold(F.col(col), star_dims.collation) == F.col("_key")
        df = df.join(_names(star_dims, dim, value(dim)), on, how).drop("_key")
    return df


def _id_of(dim: str) -> F.Column:
    return F.col("id").alias(f"{dim}_id")


def lookup_ids(grain: DataFrame, star_dims: Star) -> DataFrame:
    """D1 on the grain table: names and day replaced by surrogate ids (inner joins)."""
    df = _join_names(grain, star_dims, _id_of, "inner")
    t = star_dims.dim(TIME_DIM).select(
        F.col("id").alias("dimTime_id"), F.col("timeDay").alias("saleDay"), F.col("timeYear").alias("fact_year")
    )
    return df.join(t, "saleDay", "inner")


def key_lookup(staged: DataFrame, star_dims: Star) -> DataFrame:
    """D1 on staged rows: every staged row with its six dimension ids (rows without a match are dropped)."""
    df = _join_names(staged, star_dims, _id_of, "inner")
    t = star_dims.dim(TIME_DIM).select(F.col("id").alias("dimTime_id"), F.col("timeDay").alias("_day"))
    df = df.join(t, F.to_date("Sale_Timestamp") == F.col("_day"), "inner").drop("_day")
    return df


def lookup_rejects(staged: DataFrame, star_dims: Star) -> DataFrame:
    """D3: staged rows that some dimension lookup drops (null or unknown name, no day)."""
    df = _join_names(staged, star_dims, lambda dim: F.lit(True).alias(f"_{dim}"), "left")
    checks = [(F.col(f"_{dim}").isNull(), f"no {dim}") for dim in NAME_DIMENSIONS]
    t = star_dims.dim(TIME_DIM).select(F.col("timeDay").alias("_day"), F.lit(True).alias("_dimTime"))
    df = df.join(t, F.to_date("Sale_Timestamp") == F.col("_day"), "left")
    checks.append((F.col("_dimTime").isNull(), "no dimTime"))
    reason = F.when(checks[0][0], F.lit(checks[0][1]))
    for cond, label in checks[1:]:
        reason = reason.when(cond, F.lit(label))
    out = df.withColumn("reason", reason).where(F.col("reason").isNotNull())
    return out.select(*staged.columns, "reason")


def fact_rows(grain: DataFrame, star_dims: Star) -> DataFrame:
    """Fact rows without ids (grain ids + measures + the partition year).

    Where names are not compared by bytes, several grain rows may have the same ids; they are
    added up by their ids.
    """
    measures = [c for c in FACT_MEASURES if c in grain.columns]
    found = lookup_ids(grain, star_dims).select(*FACT_GRAIN, *measures, "fact_year")
    if star_dims.collation == BINARY:
        return found
    sums = [F.sum("cntDrug").alias("cntDrug"), F.sum("sumDrug").cast(found.schema["sumDrug"].dataType).alias("sumDrug")]
    whole = found.groupBy(*FACT_GRAIN, "fact_year").agg(*sums, F.min("minDrug").alias("minDrug"), F.max("maxDrug").alias("maxDrug"))
    if "avgDrug" in found.columns:
        whole = whole.withColumn("avgDrug", F.col("sumDrug") / F.col("cntDrug"))
    return whole.select(found.columns)


def with_fact_ids(fact: DataFrame, start: int = 0) -> DataFrame:
    """Fact ids numbered in grain-key order.

    The rows are not stored before they are dealt by ranges of the grain: the sample for the ranges reads
    the stored grain (and what a shuffled lookup has dealt) a second time, which writes nothing.
    """
    return number_rows(fact, FACT_GRAIN, id_col="id", start=start, id_type=T.LongType())


def write_dimensions(names: DataFrame, days: DataFrame, path: str) -> tuple[dict[str, int], dict[str, int]]:
    """Store the dimensions: the five name dimensions in one table partitioned by ``dim``, and dimTime.

    Returns the rows and name bytes of each, which are metrics of the two writes (their last stage has
    no shuffle after it, so a task that runs twice counts once).
    """
    seen, dated = Observation(), Observation()
    of = {d: F.col("dim") == d for d in NAME_DIMENSIONS}
    sizes = [F.count_if(c).alias(f"{d}_rows") for d, c in of.items()]
    sizes += [F.sum(F.when(c, F.octet_length("dimName"))).alias(f"{d}_bytes") for d, c in of.items()]
    names.observe(seen, *sizes).write.mode("overwrite").partitionBy("dim").parquet(f"{path}/names")
    days = days.observe(dated, F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("timeMonth")).alias("b"))
    days.write.mode("overwrite").parquet(f"{path}/{TIME_DIM}")
    rows = {d: int(seen.get[f"{d}_rows"] or 0) for d in NAME_DIMENSIONS} | {TIME_DIM: int(dated.get["n"] or 0)}
    return rows, {d: int(seen.get[f"{d}_bytes"] or 0) for d in NAME_DIMENSIONS} | {TIME_DIM: int(dated.get["b"] or 0)}


#: Ids of a run: of each year one file, or a part of one.
ROWS_PER_RUN = 20_000_000


def write_fact(fact: DataFrame, path: str) -> None:
    """Store the fact partitioned by ``fact_year``.

    Rows are dealt by year and run of ids, so a year has about as many files as its size needs.
    A mean that is not there yet is made of the dealt rows.
    Ids follow the grain, which begins with the city: files and row groups hold narrow ranges of
    it.  A run is known from the id alone, so no ranges have to be sampled.
    """
    run = F.floor(F.col("id") / ROWS_PER_RUN)
    fact = fact.repartition("fact_year", run).sortWithinPartitions("fact_year", "id")
    with_mean(fact).write.mode("overwrite").partitionBy("fact_year").parquet(f"{path}/factDrug")


def read_stored(spark, path: str, schema: T.StructType) -> DataFrame:
    """A stored table; one that is not there (no rows have been written) reads as no rows."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def stored_dimensions(spark, path: str) -> dict[str, DataFrame]:
    """Stored dimensions.

    Each name dimension is the ``names`` table filtered on its partition
    column (the filter prunes to one folder); a dimension without members has
    no folder and reads as empty.
    """
    names = read_stored(spark, f"{path}/names", T.StructType([*NAME_DIM.fields, T.StructField("dim", T.StringType())]))
    dims = {dim: names.where(F.col("dim") == dim).select("id", "dimName") for dim in NAME_DIMENSIONS}
    dims[TIME_DIM] = read_stored(spark, f"{path}/{TIME_DIM}", TIME_DIM_SCHEMA)
    return dims


def read_dimensions(spark, path: str) -> tuple[dict[str, DataFrame], dict[str, int], dict[str, int]]:
    """Stored dimensions, their row counts and name bytes (one small aggregate per table)."""
    dims = stored_dimensions(spark, path)
    names = functools.reduce(DataFrame.unionByName, [dims[d].select("dimName", F.lit(d).alias("dim")) for d in NAME_DIMENSIONS])
    sizes = names.groupBy("dim").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("dimName")), F.lit(0)).alias("b")
    )
    measured = {r["dim"]: (int(r["n"]), int(r["b"])) for r in sizes.collect()}  # one row per dimension
    rows = {dim: measured.get(dim, (0, 0))[0] for dim in NAME_DIMENSIONS}
    text = {dim: measured.get(dim, (0, 0))[1] for dim in NAME_DIMENSIONS}
    t = dims[TIME_DIM].agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("timeMonth")), F.lit(0)).alias("b")).first()
    rows[TIME_DIM], text[TIME_DIM] = int(t["n"]), int(t["b"])
    return dims, rows, text


def run_etl(
    raw: DataFrame, existing: Star | None = None, measure: str = "decimal", out: str | None = None, collation: str = BINARY
) -> Star:
    """Stage -> grain aggregate -> dimensions (upserted) -> fact with ids, stored under ``out``.

    The grain table is written once to the shared folder: it is read by the
    dimension builds and by the fact, and the write cuts the lineage back to
    the raw scan.  Dimensions and fact are each written once, as a new version
    under ``out`` (a fresh folder in the shared folder when not given), and
    read back.  The version becomes the current one only when it is whole, and
    no earlier version is touched, so ``existing`` may be the star at ``out``
    itself (D6).  Earlier versions stay until somebody removes them; scratch
    tables are removed at the end.
    """
    spark = raw.sparkSession
    base = out or scratch_path(spark, "etl")
    version = latest_version(spark, base) + 1
    root = version_path(base, version)
    with scratch_scope(spark):
        grain = materialize(grain_aggregate(stage_sales(raw), measure), "grain")
        names, days = split_members(dimension_members(grain, existing.dims if existing else None, collation))
        rows, text = write_dimensions(names, days, root)
        dims = stored_dimensions(spark, root)
        star_dims = Star(fact=None, dims=dims, dim_rows=rows, dim_bytes=text, collation=collation)  # type: ignore[arg-type]
        fact = with_fact_ids(fact_rows(grain, star_dims))
        write_fact(fact, root)
        whole = with_mean(fact).schema
        stored = T.StructType([f for f in whole.fields if f.name != "fact_year"] + [whole["fact_year"]])
    commit_version(spark, base, version)
    return Star(read_stored(spark, f"{root}/factDrug", stored), dims, rows, text, root, collation)
