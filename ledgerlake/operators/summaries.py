"""Forecast summaries and profiles: small group-bys over forecast outputs.

Multi-dimension summaries use ``groupingSets`` so one scan (an ``Expand``)
feeds every dimension instead of one job per dimension.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.session import cut_lineage
from ledgerlake.functions.columns import half_even, month_label, week_label


def by_dimensions(df: DataFrame, dims: list[str], measures: dict[str, F.Column]) -> DataFrame:
    """One pass over ``df`` grouped by each dimension separately: (dimension, key, measures...)."""
    g = df.groupingSets([[d] for d in dims], *dims).agg(*[m.alias(n) for n, m in measures.items()],
                                                         *[F.grouping(d).alias(f"_g_{d}") for d in dims])
    dim = None
    key = None
    for d in dims:
        cond = F.col(f"_g_{d}") == 0
        dim = F.when(cond, F.lit(d)) if dim is None else dim.when(cond, F.lit(d))
        key = F.when(cond, F.col(d).cast("string")) if key is None else key.when(cond, F.col(d).cast("string"))
    return g.select(dim.alias("dimension"), key.alias("key"), *measures.keys())


def _count_total(amount: str = "forecast_amount", absolute: bool = False):
    total = F.sum(amount)
    if absolute:
        total = F.abs(total)
    return {"count": F.count(F.lit(1)), "total_amount": half_even(total, 2)}


def wip_summary(s3: DataFrame) -> DataFrame:
    """S3-7 totals."""
    return s3.agg(F.count(F.lit(1)).alias("total_milestones"),
                  F.countDistinct("project_id").alias("total_projects"),
                  F.countDistinct("customer_id").alias("total_customers"),
                  half_even(F.sum("forecast_amount"), 2).alias("total_forecast_amount"),
                  half_even(F.avg("forecast_amount"), 2).alias("avg_forecast_amount"))


def wip_breakdown(s3: DataFrame) -> DataFrame:
    """S3-7 by confidence tier and by project type."""
    return by_dimensions(s3, ["confidence_tier", "project_type"], _count_total())


def weekly_timeline(detail: DataFrame, date_col: str = "expected_cash_date") -> DataFrame:
    """S3-8: cash per Monday-Sunday week."""
    return detail.groupBy(week_label(F.col(date_col)).alias("cash_week")).agg(
        half_even(F.sum("forecast_amount"), 2).alias("forecast_amount"))


def monthly_timeline(detail: DataFrame, date_col: str = "expected_cash_date") -> DataFrame:
    """S4-8 monthly timeline."""
    return detail.groupBy(month_label(F.col(date_col)).alias("cash_month")).agg(
        half_even(F.sum("forecast_amount"), 2).alias("forecast_amount"))


def stage_mix(deals: DataFrame) -> DataFrame:
    """S4-1: open deals per stage and their total value."""
    return deals.filter(F.col("crm_stage") != "Closed Won").groupBy("crm_stage").agg(
        F.count(F.lit(1)).alias("deals"), half_even(F.sum("deal_value"), 2).alias("total_value"))


def cohort_stats(invoices: DataFrame, payments: DataFrame) -> DataFrame:
    """S4-3: paid invoices x AR payments (inner), per-customer stats, then global median/means."""
    from ledgerlake.operators.quantiles import exact_quantile
    ar = payments.filter(F.col("reference_type") == "AR").select("reference_id", "payment_date")
    paid = invoices.join(ar, invoices["invoice_id"] == ar["reference_id"], "inner")
    # one row per customer, written once: the means and the median read it instead of the join
    per = cut_lineage(paid.groupBy("customer_id").agg(
        F.count("invoice_id").alias("milestone_count"),
        F.sum("invoice_amount").alias("total_billed"),
        F.avg("invoice_amount").alias("avg_invoice_amount"),
        F.avg(F.datediff("payment_date", "invoice_date")).alias("avg_days_to_pay")), "cohort")
    g = per.agg(F.avg("avg_invoice_amount").alias("global_avg_invoice_amount"),
                F.avg("avg_days_to_pay").alias("global_avg_days_to_pay"),
                F.count(F.lit(1)).alias("total_closed_deals"))
    med = exact_quantile(per, "milestone_count", 0.5, out="_m")
    return g.crossJoin(F.broadcast(med)).select(F.col("_m").cast("long").alias("global_milestone_count"), *g.columns)


def pipeline_summary(s4: DataFrame) -> DataFrame:
    """S4-8 totals."""
    return s4.agg(F.count(F.lit(1)).alias("total_records"),
                  F.countDistinct("opportunity_id").alias("total_deals"),
                  F.countDistinct("customer_id").alias("total_customers"),
                  half_even(F.sum("forecast_amount"), 2).alias("total_forecast_amount"),
                  half_even(F.avg("forecast_amount"), 2).alias("avg_per_milestone"))


def pipeline_breakdown(s4: DataFrame) -> DataFrame:
    """S4-8 by stage and by deal type."""
    return by_dimensions(s4, ["crm_stage", "deal_type"], _count_total())


def inflow_breakdown(s5: DataFrame) -> DataFrame:
    """S5-4 / QY-13: by category, confidence and approval status."""
    return by_dimensions(s5, ["category", "confidence_tier", "approval_status"], _count_total())


def expense_breakdown(s6: DataFrame) -> DataFrame:
    """S6-4 / QY-13: absolute sums by category, recurrence and confidence."""
    return by_dimensions(s6, ["category", "recurrence_type", "confidence_tier"], _count_total(absolute=True))


def module_totals(detail: DataFrame, absolute: bool = False) -> DataFrame:
    """S5-4 / S6-4 totals."""
    total = F.sum("forecast_amount")
    if absolute:
        total = F.abs(total)
    return detail.agg(F.count(F.lit(1)).alias("total_records"), half_even(total, 2).alias("total_forecast"))


def cash_timeline(s5: DataFrame, s6: DataFrame) -> DataFrame:
    """QY-16: inflow and absolute outflow per expected cash date."""
    i = s5.groupBy("expected_cash_date").agg(F.sum("forecast_amount").alias("inflow"))
    o = s6.groupBy("expected_cash_date").agg(F.abs(F.sum("forecast_amount")).alias("outflow"))
    return i.join(o, "expected_cash_date", "full").select(
        "expected_cash_date", F.coalesce("inflow", F.lit(0.0)).alias("inflow"),
        F.coalesce("outflow", F.lit(0.0)).alias("outflow"))
