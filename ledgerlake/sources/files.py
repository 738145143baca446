"""File sources and sinks: raw CSV inputs, the Parquet feature store and published outputs.

* Raw CSVs are read with a declared schema (no inference pass); date columns
  arrive as text and are parsed with ``try_to_date`` / ``try_to_timestamp`` so
  a malformed value becomes null instead of failing the job under ANSI mode.
* Derived tables are Parquet, partitioned by a low-cardinality column
  (``feature_date`` for features, ``source_module`` for forecasts), so readers
  prune partitions and push filters into the scan.
* Optional inputs: a missing path is skipped (or replaced by an empty frame
  with the declared schema), never an error.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# raw-input date columns (parsed with coercion to null)
DATE_COLUMNS = {
    "invoices": ["invoice_date", "due_date"],
    "payments": ["payment_date"],
    "collections_events": ["event_date", "promise_to_pay_date"],
    "non_invoice_payments": ["payment_date"],
    "bills": ["bill_date", "due_date"],
    "purchase_orders": ["po_date", "expected_invoice_date"],
}
TIMESTAMP_COLUMNS = {"collections_events": ["event_date"]}


def parse_dates(df: DataFrame, table: str) -> DataFrame:
    """SRC-2: text dates -> DATE (TIMESTAMP for the event log); bad values -> null."""
    ts = set(TIMESTAMP_COLUMNS.get(table, []))
    for c in DATE_COLUMNS.get(table, []):
        if c in df.columns:
            txt = F.col(c).cast("string")
            df = df.withColumn(c, F.try_to_timestamp(txt) if c in ts else F.to_date(F.try_to_timestamp(txt)))
    return df


def read_raw_csv(spark: SparkSession, path: str, schema: T.StructType, table: str) -> DataFrame:
    """SRC-1/SRC-4: CSV with header and a declared schema (date columns declared as strings)."""
    text_schema = T.StructType([T.StructField(f.name, T.StringType() if f.name in DATE_COLUMNS.get(table, [])
                                              else f.dataType, True) for f in schema.fields])
    return parse_dates(spark.read.schema(text_schema).option("header", True).csv(path), table)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_optional(spark: SparkSession, paths: dict[str, str], schema: T.StructType | None = None,
                  fmt: str = "parquet") -> dict[str, DataFrame | None]:
    """SRC-5: read each present source; absent -> None (skip) or an empty frame of ``schema``."""
    out = {}
    for name, path in paths.items():
        if exists(spark, path):
            out[name] = spark.read.format(fmt).load(path)
        else:
            out[name] = spark.createDataFrame([], schema) if schema is not None else None
    return out


def read_feature_tables(spark: SparkSession, root: str, names: list[str]) -> dict[str, DataFrame]:
    """SRC-3: the configured feature tables from the Parquet feature store."""
    out = {}
    for n in names:
        df = spark.read.parquet(f"{root}/{n}")
        for part in ("feature_date", "score_date"):          # partition values come back typed; keep text
            if part in df.columns:
                df = df.withColumn(part, F.date_format(part, "yyyy-MM-dd"))
        out[n] = df
    return out


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """SNK-1..SNK-4: overwrite a Parquet table (optionally partitioned)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def write_dated(df: DataFrame, path: str, date_col: str) -> str:
    """SNK-1: a table with one partition a date.  A run replaces the partitions of its own dates, when all its rows are
    written, and leaves every other date as it is, so features of several dates stay side by side."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date_col).parquet(path)
    return path


def write_csv(df: DataFrame, path: str) -> str:
    """CSV export (header, one part file per task; no single-file coalesce), timestamps to the microsecond."""
    df.write.mode("overwrite").option("header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").option(
        "timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path)
    return path
