"""Skew-safe ordering operators.

``Window.partitionBy(g).orderBy(v)`` sends every row of a group to one task:
a group that holds a third of the data becomes one third of the job in a
single task.  The operators here never do that.  They range-partition the
(pre-aggregated) rows on ``(g, v)`` -- range bounds are sampled, so a hot
group is spread over many contiguous partitions -- compute prefix counts
inside each partition, and fix them up with per-partition offsets.  The
offsets table has at most two rows a partition (its first and last group:
all between lie in it whole), so it is broadcast and every remaining window
is bounded by the partition count.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ledgerlake.session import cut_lineage


def _parts(df: DataFrame, partitions: int | None) -> int:
    if partitions:
        return partitions
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def global_position(df: DataFrame, order_cols: list[str], partitions: int | None = None,
                    out: str = "_pos", count_out: str | None = None) -> DataFrame:
    """0-based position of each row in the total order ``order_cols`` (ties broken
    by the listed columns only; make them unique for a strict order), and on request the number of rows."""
    p = _parts(df, partitions)
    ranged = df.repartitionByRange(p, *order_cols).withColumn("_pid", F.spark_partition_id())
    # materialised once (reliable checkpoint): the partition ids are then data, so the two
    # consumers below agree on them whatever adaptive execution or a task retry does
    local = cut_lineage(ranged.withColumn(
        "_local", F.row_number().over(Window.partitionBy("_pid").orderBy(*order_cols)) - 1))
    counts = local.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # at most `p` rows: size bounded by the partition count, broadcast
    total = F.sum("_n").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    offsets = counts.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off"),
                            *([total.alias(count_out)] if count_out else []))
    return (local.join(F.broadcast(offsets), "_pid")
            .withColumn(out, F.col("_off") + F.col("_local")).drop("_pid", "_local", "_off"))


def group_value_ranks(df: DataFrame, group: str, value: str, partitions: int | None = None) -> DataFrame:
    """Per distinct (group, value): ``_less`` (rows of the group with a smaller value),
    ``_eq`` (rows with this value), ``_n`` (rows in the group) and ``_sum``
    (sum of the group's values).  Rows with a null value are ignored, as pandas does."""
    p = _parts(df, partitions)
    number = isinstance(df.schema[value].dataType, NumericType)
    product = F.col("_eq") * F.col(value) if number else F.lit(None).cast("double")
    # partial aggregation, skew-safe; the sampling for the range bounds reads the aggregate's shuffle files a second time
    pairs = (df.filter(F.col(group).isNotNull() & F.col(value).isNotNull())
             .groupBy(group, value).agg(F.count(F.lit(1)).alias("_eq")))
    ranged = pairs.repartitionByRange(p, group, value).withColumn("_pid", F.spark_partition_id())
    w_part = Window.partitionBy("_pid", group)
    w_local = w_part.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = cut_lineage(ranged.withColumn("_lless", F.coalesce(F.sum("_eq").over(w_local), F.lit(0)))
                        .withColumn("_pn", F.sum("_eq").over(w_part)).withColumn("_psum", F.sum(product).over(w_part)))
    # only a partition's first and last group go on in others; all between lie in it whole, so their own figures stand
    ends = local.groupBy("_pid").agg(F.array_distinct(F.array(F.min(group), F.max(group))).alias("_ends"))
    ends = F.broadcast(ends.select("_pid", F.explode("_ends").alias(group)))              # at most 2p rows
    edges = local.join(ends, ["_pid", group]).groupBy("_pid", group).agg(F.max("_pn").alias("_en"), F.max("_psum").alias("_es"))
    wg = Window.partitionBy(group)
    offsets = F.broadcast(edges.select(
        "_pid", group,
        (F.sum("_en").over(wg.orderBy("_pid")) - F.col("_en")).alias("_off"),
        F.sum("_en").over(wg).alias("_gn"),
        F.sum("_es").over(wg).alias("_gs"),
    ))
    return (local.join(offsets, ["_pid", group], "left")
            .select(group, value, "_eq", (F.coalesce(F.col("_off"), F.lit(0)) + F.col("_lless")).alias("_less"),
                    F.coalesce("_gn", "_pn").alias("_n"), F.coalesce("_gs", "_psum").alias("_sum")))


def avg_rank_pct(df: DataFrame, group: str, value: str, out: str = "avg_rank_pct",
                 mean_out: str | None = None, partitions: int | None = None) -> DataFrame:
    """pandas ``groupby(g)[v].rank(pct=True)`` (average method) and optionally the group mean,
    attached to every row with one join on (group, value)."""
    r = group_value_ranks(df, group, value, partitions)
    avg_rank = F.col("_less") + (F.col("_eq") + F.lit(1)) / F.lit(2.0)
    cols = [group, value, (avg_rank / F.col("_n")).alias(out)]
    if mean_out:
        cols.append((F.col("_sum") / F.col("_n")).alias(mean_out))
    return df.join(r.select(*cols), [group, value], "left")
