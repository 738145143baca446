"""SRC-1 / SRC-2 with nothing lost in silence: every line of a raw file is kept, or quarantined with its reason.

``scan_csv`` parses a CSV folder once, all fields as text, and writes that scan to the shared folder.  From it come

* ``kept``: typed rows.  A value that does not parse is null, as the plain reader has it;
* ``rejected``: (file, record, column, value, reason), one row for each value that was there and became null;
* ``quarantined``: (file, record, reason), the lines that are no row: a wrong number of fields, or no usable key.

Lines read = rows kept + lines quarantined.  Empty fields are nulls, not rejects.  An empty folder gives empty frames.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.session import cut_lineage
from ledgerlake.sources.files import DATE_COLUMNS, TIMESTAMP_COLUMNS

CORRUPT, FILE, SHAPE, KEY = "_corrupt", "_file", "wrong number of fields", "no key"


@dataclass
class RawScan:
    kept: DataFrame
    rejected: DataFrame
    quarantined: DataFrame
    raw: DataFrame


def _typed(name: str, kind: T.DataType, table: str) -> Column:
    c = F.col(name)
    if name in TIMESTAMP_COLUMNS.get(table, []) or isinstance(kind, T.TimestampType):
        return F.try_to_timestamp(c)
    if name in DATE_COLUMNS.get(table, []) or isinstance(kind, T.DateType):
        return F.to_date(F.try_to_timestamp(c))
    return c if isinstance(kind, T.StringType) else c.try_cast(kind)


def scan_csv(spark: SparkSession, path: str, schema: T.StructType, table: str, key: str | None = None,
             header: bool = True) -> RawScan:
    """``key`` (the first column by default) has to be there and to parse; other columns may be null."""
    key = key or schema.fields[0].name
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields] + [T.StructField(CORRUPT, T.StringType())])
    read = (spark.read.schema(text).option("header", header).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT).csv(path))
    raw = cut_lineage(read.withColumn(FILE, F.col("_metadata.file_name")), f"raw_{table}")
    typed = {f.name: _typed(f.name, f.dataType, table) for f in schema.fields}
    record = F.coalesce(F.col(CORRUPT), F.to_csv(F.struct(*[F.col(f.name) for f in schema.fields])))
    reason = F.when(F.col(CORRUPT).isNotNull(), SHAPE).when(typed[key].isNull(), KEY)
    marked = raw.withColumn("_reason", reason)
    good = marked.filter(F.col("_reason").isNull())
    checks = [F.when(F.col(f.name).isNotNull() & typed[f.name].isNull(), F.struct(
        F.lit(f.name).alias("column"), F.col(f.name).alias("value"), F.lit(f"not a {f.dataType.simpleString()}").alias("reason")))
        for f in schema.fields]
    return RawScan(
        kept=good.select(*[typed[f.name].alias(f.name) for f in schema.fields]),
        rejected=good.select(F.col(FILE).alias("file"), record.alias("record"), F.explode(F.array_compact(F.array(*checks))).alias("r"))
        .select("file", "record", "r.*"),
        quarantined=marked.filter(F.col("_reason").isNotNull())
        .select(F.col(FILE).alias("file"), record.alias("record"), F.col("_reason").alias("reason")),
        raw=raw)
