"""QY-2, QY-3, QY-10, QY-11: point lookups on tables clustered by id.

``write_clustered`` range-partitions and sorts a table by its id and writes narrow row groups with a Parquet bloom filter on the id.
``lookup`` then reads, for a batch of ids, the row groups that can hold one of them: the ids go to the scan as equalities, which
Parquet holds against row group bounds, page bounds and bloom filters.  (An IN list of more than ten values would reach it as one
range only.)  A batch above ``MAX_IDS`` distinct ids is joined instead: with that many, most row groups hold one.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_IDS = 1000
ROW_GROUP = 1 << 20


def write_clustered(df: DataFrame, path: str, key: str, files: int | None = None, row_group: int = ROW_GROUP,
                    ids_per_file: int = 1_000_000) -> str:
    """``files`` is the number of ranges (the shuffle partitions by default); ``ids_per_file`` sizes the bloom filters."""
    ranged = df.repartitionByRange(files, key) if files else df.repartitionByRange(key)
    (ranged.sortWithinPartitions(key).write.mode("overwrite").option("parquet.block.size", row_group)
     .option("parquet.page.size", 64 << 10).option("parquet.page.row.count.limit", 2000)
     .option(f"parquet.bloom.filter.enabled#{key}", "true")
     .option(f"parquet.bloom.filter.expected.ndv#{key}", ids_per_file).parquet(path))
    return path


def _any(conditions: list[Column]) -> Column:
    """A balanced OR, so that a thousand equalities don't nest a thousand deep."""
    while len(conditions) > 1:
        conditions = [reduce(Column.__or__, conditions[i:i + 2]) for i in range(0, len(conditions), 2)]
    return conditions[0]


def lookup(spark: SparkSession, path: str, key: str, ids: DataFrame) -> DataFrame:
    """Rows of the table whose key is in the first column of ``ids`` (repeats and nulls there don't matter)."""
    wanted = ids.select(F.col(ids.columns[0]).alias(key)).filter(F.col(key).isNotNull()).distinct()
    table = spark.read.parquet(path)
    some = [r[0] for r in wanted.limit(MAX_IDS + 1).collect()]            # at most MAX_IDS + 1 ids
    if not some:
        return table.limit(0)
    if len(some) > MAX_IDS:
        return table.join(wanted, key, "left_semi")
    return table.filter(_any([F.col(key) == F.lit(i) for i in sorted(some)]))


def scanned_rows(df: DataFrame) -> int:
    """Rows that the scans of ``df`` handed on when it last ran (the plan's own metric): those of row groups that were read."""
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))
