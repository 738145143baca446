"""CF-2, CF-7, CF-8, CF-10, CF-12 and VF-2 to VF-5 from mergeable states: a load adds its own payments, history isn't reread.

A state row is (entity, payment day, days to pay, days late) with counts and sums of its payments: everything those
features need adds up over such rows, medians and standard deviations included, as values are kept with their counts.  Rows are
stored per load (``load=...``), so a load that runs again replaces what it wrote.  Its own documents are the only ones
joined with payments.  Documents paid in several loads are counted once, by an index of the documents seen.

``compact`` merges old days into months, which is lossless for every feature.  A hot customer's rows are bounded by
days x distinct values, whatever its payments.

A payment may come late, in any load.  Where a load that runs again has lost payments, run the later loads again, too: the document
index of the first one may have stood for them.  Null payment dates and payments without a document are left out.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.config import DEFAULT, Settings
from ledgerlake.functions.columns import half_even, lit_date
from ledgerlake.operators.features import MONTHS
from ledgerlake.sources import files
from ledgerlake.sources.files import exists


@dataclass(frozen=True)
class Side:
    """Documents of one side of the ledger: receivables or payables."""
    kind: str
    doc: str
    entity: str
    date: str
    amount: str


AR = Side("AR", "invoice_id", "customer_id", "invoice_date", "invoice_amount")
AP = Side("AP", "bill_id", "vendor_id", "bill_date", "bill_amount")
KEYS = ("day", "days", "late")
SUMS = ("n", "amount_sum", "amount_n", "paid_sum", "docs")


def load_states(docs: DataFrame, payments: DataFrame, seen: DataFrame | None, side: Side) -> tuple[DataFrame, DataFrame]:
    """(state rows, documents seen for the first time) of one load's payments."""
    pay = (payments.filter((F.col("reference_type") == side.kind) & F.col("payment_date").isNotNull())
           .select(F.col("reference_id").alias(side.doc), "payment_date", "payment_amount"))
    j = pay.join(docs.select(side.doc, side.entity, side.date, "due_date", side.amount), side.doc)
    fresh = j.select(side.doc, side.entity).distinct()
    if seen is not None:
        fresh = fresh.join(seen.select(side.doc), side.doc, "left_anti")
    states = (j.groupBy(side.entity, F.col("payment_date").alias("day"), F.datediff("payment_date", side.date).alias("days"),
                        F.datediff("payment_date", "due_date").alias("late"))
              .agg(F.count(F.lit(1)).alias("n"), F.sum(side.amount).alias("amount_sum"), F.count(side.amount).alias("amount_n"),
                   F.sum("payment_amount").alias("paid_sum")).withColumn("docs", F.lit(0).cast("long")))
    return states, fresh


def add_load(spark: SparkSession, root: str, docs: DataFrame, payments: DataFrame, load: str, side: Side = AR) -> DataFrame:
    """Merge one load into the store and return all states.  Running it again replaces the load."""
    index, path = f"{root}/{side.kind}/documents", f"{root}/{side.kind}/states"
    ids = docs.select(side.doc, side.entity).schema.add("load", "string")
    seen = spark.read.schema(ids).parquet(index).filter(F.col("load") != load) if exists(spark, index) else None
    states, fresh = load_states(docs, payments, seen, side)
    # a load's folder is replaced as a whole, also by a load without rows
    files.write_table(fresh, f"{index}/load={load}")
    counted = (spark.read.schema(ids).parquet(index).filter(F.col("load") == load)
               .groupBy(side.entity).agg(F.count(F.lit(1)).alias("docs")))
    rows = states.unionByName(counted, allowMissingColumns=True).fillna(0, ["n", "amount_n", "docs"])
    files.write_table(rows.select(side.entity, *KEYS, *SUMS), f"{path}/load={load}")
    return spark.read.schema(rows.schema).parquet(path).select(side.entity, *KEYS, *SUMS)


def compact(states: DataFrame, before: str, side: Side = AR) -> DataFrame:
    """States with days before ``before`` merged by month (each month keeps its last day); features don't change as long as
    ``before`` is not inside the trend's 30 days."""
    old = F.col("day") < F.lit(before).cast("date")
    grain = F.when(old, F.trunc("day", "month")).otherwise(F.col("day"))
    return (states.groupBy(side.entity, grain.alias("_g"), old.alias("_old"), "days", "late")
            .agg(F.max("day").alias("day"), *[F.sum(c).alias(c) for c in SUMS]).select(side.entity, *KEYS, *SUMS))


def _weighted(c: str, when: Column | None = None) -> tuple[Column, Column]:
    """(sum, count) of the non-null values of ``c`` over payments."""
    has = F.col(c).isNotNull() if when is None else F.col(c).isNotNull() & when
    return F.sum(F.when(has, F.col(c) * F.col("n"))), F.sum(F.when(has, F.col("n")))


def _mean(c: str, when: Column | None = None) -> Column:
    s, n = _weighted(c, when)
    return F.when(n > 0, s / n)


def _spread(c: str) -> Column:
    """Sample standard deviation from exact integer sums; fewer than two values: 0."""
    s, n = _weighted(c)
    sq = F.sum(F.col(c) * F.col(c) * F.col("n"))
    wide = lambda x: x.cast("decimal(19,0)")
    var = (wide(n) * wide(sq) - wide(s) * wide(s)).cast("double") / (n.cast("double") * (n - 1))
    return F.when(n > 1, F.sqrt(var)).otherwise(F.lit(0.0))


def _share(cond: Column) -> Column:
    return F.sum(F.when(cond, F.col("n")).otherwise(0)) / F.sum("n")


def customer_payment_stats(states: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """The columns of ``features.customer_payment_stats``, from states."""
    ref = lit_date(cfg.reference_date)
    recent = F.col("day") >= F.date_sub(ref, 30)
    month = F.month("day")
    sums = []
    for k in MONTHS:
        s, n = _weighted("days", month == k)
        sums += [s.alias(f"_ms{k}"), F.coalesce(n, F.lit(0)).alias(f"_mc{k}")]
    total, count = _weighted("days")
    return states.groupBy(AR.entity).agg(
        _mean("late").alias("avg_payment_delay"), F.percentile("late", 0.5, F.col("n")).alias("median_payment_delay"),
        _share(F.col("late") > 0).alias("late_payment_ratio"), _spread("days").alias("payment_volatility"),
        (F.sum("amount_sum") / F.sum("amount_n")).alias("avg_invoice_amount"), F.sum("docs").alias("invoice_count"),
        F.datediff(ref, F.max("day")).alias("days_since_last_payment"),
        (_mean("days", recent) - _mean("days")).alias("payment_trend_30d"), F.sum("paid_sum").alias("_total_paid"),
        total.alias("_ts"), F.coalesce(count, F.lit(0)).alias("_tc"), *sums)


def vendor_payment_stats(states: DataFrame) -> DataFrame:
    """The columns of ``features.vendor_payment_stats``, from states."""
    months = F.size(F.collect_set(F.year("day") * 12 + F.month("day")))
    return states.groupBy(AP.entity).agg(
        _mean("days").alias("avg_payment_cycle_days"), _spread("days").alias("payment_volatility"),
        _share(F.col("late") > 0).alias("late_payment_ratio"),
        (F.sum("amount_sum") / F.sum("amount_n")).alias("avg_invoice_amount"), F.sum("docs").alias("invoice_count"),
        _share(F.col("late") < 0).alias("discount_capture_ratio"),
        half_even(F.sum("n") / months, 0).cast("long").alias("vendor_chase_frequency"),
        F.max("day").alias("last_payment_date"), F.sum("paid_sum").alias("_total_paid"))
