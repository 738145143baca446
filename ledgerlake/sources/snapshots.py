"""SNK-1 / SNK-2 published all at once: data folders per run, and a manifest written last that readers follow.

``publish`` writes every table of a run into folders of that run, then one manifest: the run that holds each
(table, date).  A manifest counts when its job has committed (``_SUCCESS``), so a run that stops half way leaves
readers on the version before, for all tables together.  A rerun replaces exactly the dates it wrote; other dates stay.
One publisher at a time; readers need no lock.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.sources.files import exists

SCHEMA = "table string, date_col string, date string, run string"


def _versions(spark: SparkSession, root: str) -> list[int]:
    base = f"{root}/manifests"
    if not exists(spark, base):
        return []
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    listed = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    found = [s.getPath().getName() for s in listed]
    return sorted(int(n) for n in found if n.isdigit() and exists(spark, f"{base}/{n}/_SUCCESS"))


def manifest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """(table, date_col, date, run) of the newest (or a given) version; empty before the first publication."""
    have = _versions(spark, root)
    if not have:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).json(f"{root}/manifests/{have[-1] if version is None else version}")


def publish(spark: SparkSession, root: str, tables: dict[str, tuple[DataFrame, str]], run: str) -> int:
    """Write ``{name: (rows, date column)}`` as version n + 1, which is returned.  ``run`` names this run's folders."""
    new = None
    for name, (df, date_col) in tables.items():
        path = f"{root}/data/{name}/{run}"
        df.write.mode("overwrite").partitionBy(date_col).parquet(path)
        # the dates a table holds: read from its folders, a few
        dates = spark.read.parquet(path).select(
            F.lit(name).alias("table"), F.lit(date_col).alias("date_col"), F.col(date_col).cast("string").alias("date"),
            F.lit(run).alias("run")).distinct()
        new = dates if new is None else new.unionByName(dates)
    old = manifest(spark, root)
    kept = old.join(new.select("table", "date"), ["table", "date"], "left_anti")
    version = max(_versions(spark, root), default=0) + 1
    # an unfinished manifest of this number has no _SUCCESS: overwrite it
    kept.unionByName(new).coalesce(1).write.mode("overwrite").json(f"{root}/manifests/{version}")
    return version


def read(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """The table as published, with its date column as text; every date from the run that wrote it last."""
    rows = manifest(spark, root, version).filter(F.col("table") == name).collect()       # one row a date
    if not rows:
        raise FileNotFoundError(f"{name}: nothing published under {root}")
    date_col, base = rows[0].date_col, f"{root}/data/{name}"
    out = None
    for run in sorted({r.run for r in rows}):
        dates = [r.date for r in rows if r.run == run]
        part = spark.read.parquet(f"{base}/{run}").withColumn(date_col, F.col(date_col).cast("string"))
        part = part.filter(F.col(date_col).isin(dates))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
