"""Exact global quantile (linear interpolation, as pandas/numpy) without one giant task.

Spark's exact ``percentile`` merges a map of every distinct value in a single final task.  Here the rows
are counted per value (partial aggregation, so ties cost nothing), the distinct values are range-partitioned, and
prefix counts per partition plus partition offsets give every value the ranks it covers.  The two neighbours of
the fractional rank are then picked by one partially aggregated ``max``.  One path for every size.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.operators.ranking import group_value_ranks


def exact_quantile(df: DataFrame, col: str, p: float, out: str = "quantile") -> DataFrame:
    """One row: the ``p`` quantile of the non-null values of ``col`` (null if there are none)."""
    x = df.select(F.lit(0).alias("_all"), F.col(col).cast("double").alias("_x"))
    ranks = group_value_ranks(x, "_all", "_x")
    h = (F.col("_n") - 1) * F.lit(float(p))

    def at(i):                                        # the value that covers 0-based rank i
        return F.max(F.when((F.col("_less") <= i) & (i < F.col("_less") + F.col("_eq")), F.col("_x")))
    picked = ranks.agg(at(F.floor(h)).alias("_a"), at(F.ceil(h)).alias("_b"), F.max(h).alias("_h"))
    t = F.col("_h") - F.floor("_h")
    diff = F.col("_b") - F.col("_a")
    value = F.when(t >= 0.5, F.col("_b") - diff * (F.lit(1.0) - t)).otherwise(F.col("_a") + diff * t)
    return picked.select(value.alias(out))
