"""Rule-based forecasts: WIP milestones (S3), sales pipeline (S4),
contingent inflows (S5) and planned expenses (S6).

Each forecast is a narrow projection of its input (no shuffle) except the
customer-delay lookup, a join on ``customer_id`` that Catalyst plans as a
broadcast when the feature table is small and as a sort-merge join otherwise.
Outputs: a detail table plus the unified ``forecast_outputs`` record.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.config import (DEFAULT, EXPENSE_CONFIDENCE, INFLOW_CONFIDENCE, PIPELINE_OFFSETS,
                               PIPELINE_WEIGHTS, STAGE_PROBABILITY, Settings)
from ledgerlake.functions.columns import half_even, clip, lit_date, lookup, stable_id

FORECAST_COLUMNS = ["forecast_id", "forecast_date", "forecast_type", "target_date", "forecast_amount",
                    "confidence_low", "confidence_high", "source_module", "forecast_run_id"]


def unified(detail: DataFrame, module: str, ftype: str, low: float, high: float,
            cfg: Settings = DEFAULT, date_col: str = "expected_cash_date") -> DataFrame:
    """Project a detail table onto the unified forecast record (PP-5, S4-7, S5-3, S6-3)."""
    return detail.select(
        F.col("forecast_id"),
        F.lit(str(cfg.reference_date)).alias("forecast_date"),
        F.lit(ftype).alias("forecast_type"),
        F.col(date_col).alias("target_date"),
        F.col("forecast_amount"),
        (F.col("forecast_amount") * low).alias("confidence_low"),
        (F.col("forecast_amount") * high).alias("confidence_high"),
        F.lit(module).alias("source_module"),
        F.lit(cfg.run_id).alias("forecast_run_id"),
    )


# ---------------------------------------------------------------- S5 -------
def inflow_horizon(inflows: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """S5-1: receipt date (before lag) inside [ref, ref+horizon]; pushed into the scan."""
    return inflows.filter(F.col("expected_receipt_date").between(lit_date(cfg.reference_date), lit_date(cfg.horizon_end)))


def inflow_forecast(inflows: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """S5-2/S5-3: cash date = receipt + lag (null lag = 0), tier from approval status."""
    lag = F.coalesce(F.col("hist_receipt_lag_days"), F.lit(0)).cast("int")
    df = inflow_horizon(inflows, cfg)
    notes = F.col("notes") if "notes" in df.columns else F.lit("")
    return df.select(
        stable_id(F.lit("S5"), F.col("inflow_id"), F.lit(cfg.run_id)).alias("forecast_id"),
        "inflow_id", "category", "amount",
        F.col("expected_receipt_date"),
        F.date_add("expected_receipt_date", lag).alias("expected_cash_date"),
        lag.alias("receipt_lag_days"),
        "approval_status",
        lookup("approval_status", INFLOW_CONFIDENCE, "LOW").alias("confidence_tier"),
        F.col("source_document_ref"),
        F.col("amount").alias("forecast_amount"),
        F.lit("S5").alias("source_module"),
        F.lit("INFLOW").alias("forecast_type"),
        F.lit(str(cfg.reference_date)).alias("forecast_date"),
        notes.alias("notes"),
    )


def inflow_outputs(detail: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    return unified(detail, "S5", "INFLOW", 0.8, 1.2, cfg)


# ---------------------------------------------------------------- S6 -------
def expense_horizon(expenses: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """S6-1: obligation date (before lag) inside the horizon."""
    return expenses.filter(F.col("obligation_date").between(lit_date(cfg.reference_date), lit_date(cfg.horizon_end)))


def expense_forecast(expenses: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """S6-2/S6-3: cash date = obligation + lag, tier by category, amount negated."""
    lag = F.coalesce(F.col("payment_lag_days"), F.lit(0)).cast("int")
    df = expense_horizon(expenses, cfg)
    notes = F.col("notes") if "notes" in df.columns else F.lit("")
    approved = F.col("approved_by") if "approved_by" in df.columns else F.lit("")
    return df.select(
        stable_id(F.lit("S6"), F.col("expense_id"), F.lit(cfg.run_id)).alias("forecast_id"),
        "expense_id", "category", "recurrence_type", "amount",
        F.col("obligation_date"),
        F.date_add("obligation_date", lag).alias("expected_cash_date"),
        lag.alias("payment_lag_days"),
        lookup("category", EXPENSE_CONFIDENCE, "LOW").alias("confidence_tier"),
        F.col("source_document_ref"),
        approved.alias("approved_by"),
        (-F.abs(F.col("amount"))).alias("forecast_amount"),
        F.lit("S6").alias("source_module"),
        F.lit("EXPENSE").alias("forecast_type"),
        F.lit(str(cfg.reference_date)).alias("forecast_date"),
        notes.alias("notes"),
    )


def expense_outputs(detail: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    return unified(detail, "S6", "EXPENSE", 1.1, 0.9, cfg)


# ---------------------------------------------------------------- S3 -------
def forecastable_milestones(milestones: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """S3-1: active projects, not complete, near completion or due within the look-forward window."""
    days = F.datediff("expected_completion_date", lit_date(cfg.reference_date))
    cond = (F.col("project_status").isin(*cfg.wip_statuses)
            & (F.col("completion_status") != "COMPLETE")
            & ((F.col("completion_pct") >= cfg.completion_threshold)
               | ((days >= 0) & (days <= cfg.lookforward_days))))
    if "billing_trigger" in milestones.columns:
        cond = cond & (F.col("billing_trigger") == F.lit(True))
    return milestones.filter(cond)


def attach_delay(df: DataFrame, customer_features: DataFrame, cfg: Settings = DEFAULT,
                 out: str = "customer_payment_delay") -> DataFrame:
    """S3-2 / S4-2: customer's avg delay (absent customer -> fallback), floored at 0."""
    delays = customer_features.select("customer_id", F.col("avg_payment_delay").alias("_delay"))
    d = F.coalesce(F.col("_delay"), F.lit(float(cfg.fallback_delay_days)))
    return df.join(delays, "customer_id", "left").withColumn(out, clip(d, lo=0.0)).drop("_delay")


def wip_forecast(milestones: DataFrame, customer_features: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """S3-3..S3-6: projected completion, invoice and cash dates, horizon, tier, 19 columns."""
    ref = lit_date(cfg.reference_date)
    df = attach_delay(forecastable_milestones(milestones, cfg), customer_features, cfg)
    pct = F.col("completion_pct")
    overdue_nearly_done = ((F.col("completion_status") == "IN_PROGRESS")
                           & (F.col("expected_completion_date") < ref) & (pct >= 0.8))
    remaining = F.greatest(F.lit(1), ((F.lit(1.0) - pct) * 14).cast("int"))
    projected = F.when(overdue_nearly_done, F.date_add(ref, remaining)).otherwise(F.col("expected_completion_date"))
    df = (df.withColumn("projected_completion_date", projected)
          .withColumn("expected_invoice_date", F.date_add("projected_completion_date", cfg.invoice_lag_days))
          .withColumn("expected_cash_date",
                      F.date_add("expected_invoice_date", F.col("customer_payment_delay").cast("int")))
          .filter(F.col("expected_cash_date") <= lit_date(cfg.wip_horizon_end)))
    tier = F.when(pct >= 0.95, "HIGH").when(pct >= 0.80, "MEDIUM").otherwise("LOW")
    return df.select(
        stable_id(F.lit("S3"), F.col("milestone_id"), F.lit(cfg.run_id)).alias("forecast_id"),
        "project_id", "milestone_id", "customer_id", "project_type", "milestone_name",
        "completion_pct", "completion_status", "billing_amount",
        F.col("projected_completion_date").alias("expected_completion_date"),
        "expected_invoice_date", "expected_cash_date",
        F.col("billing_amount").alias("forecast_amount"),
        F.lit(cfg.invoice_lag_days).alias("invoice_lag_days"),
        F.col("customer_payment_delay").cast("int").alias("customer_payment_delay_days"),
        tier.alias("confidence_tier"),
        F.lit("S3").alias("source_module"),
        F.lit("WIP").alias("forecast_type"),
        F.lit(str(cfg.reference_date)).alias("forecast_date"),
    )


# ---------------------------------------------------------------- S4 -------
def open_pipeline(deals: DataFrame) -> DataFrame:
    """S4-1: deals not yet won."""
    return deals.filter(F.col("crm_stage") != "Closed Won")


def stage_probability(deals: DataFrame) -> F.Column:
    """S4-4: configured stage probability, else the deal's own, else 0.5."""
    own = F.col("stage_probability") if "stage_probability" in deals.columns else F.lit(None).cast("double")
    return F.coalesce(lookup("crm_stage", STAGE_PROBABILITY), own, F.lit(0.5))


def milestone_plan() -> F.Column:
    """S4-5: normalised billing weights and offsets as an array of structs (posexplode-ready)."""
    total = sum(PIPELINE_WEIGHTS)
    return F.array(*[F.struct(F.lit(w / total).alias("weight"), F.lit(o).alias("offset"))
                     for w, o in zip(PIPELINE_WEIGHTS, PIPELINE_OFFSETS)])


def pipeline_forecast(deals: DataFrame, customer_features: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """S4-2..S4-6: one row per deal milestone inside [ref, ref+horizon]."""
    ref = lit_date(cfg.reference_date)
    # delay is floored when the feature table is read and again after the join (fallback 30)
    cf = customer_features.select(
        "customer_id",
        clip(F.coalesce(F.col("avg_payment_delay"), F.lit(float(cfg.fallback_delay_days))), lo=0.0)
        .alias("avg_payment_delay"))
    df = attach_delay(open_pipeline(deals), cf, cfg, out="deal_delay")
    df = df.withColumn("stage_prob", stage_probability(deals))
    df = df.select("*", F.posexplode(milestone_plan()).alias("ms_idx", "ms"))
    amount = half_even(F.col("deal_value") * F.col("stage_prob") * F.col("ms.weight"), 2)
    invoice_date = F.date_add(F.date_add("expected_close_date", F.col("ms.offset")), cfg.invoice_lag_days)
    df = (df.withColumn("expected_invoice_date", invoice_date)
          .withColumn("expected_cash_date", F.date_add("expected_invoice_date", F.col("deal_delay").cast("int")))
          .filter(F.col("expected_cash_date").between(ref, lit_date(cfg.horizon_end))))
    band = F.col("deal_size_band") if "deal_size_band" in deals.columns else F.lit("")
    return df.select(
        stable_id(F.lit("S4"), F.col("opportunity_id"), F.col("ms_idx"), F.lit(cfg.run_id)).alias("forecast_id"),
        "opportunity_id", "customer_id", "deal_value", "deal_type", band.alias("deal_size_band"), "crm_stage",
        F.col("stage_prob").alias("stage_probability"),
        (F.col("ms_idx") + 1).alias("milestone_sequence"),
        half_even(F.col("ms.weight"), 3).alias("milestone_weight"),
        amount.alias("forecast_amount"),
        "expected_close_date", "expected_invoice_date", "expected_cash_date",
        F.lit(cfg.invoice_lag_days).alias("invoice_lag_days"),
        F.col("deal_delay").cast("int").alias("customer_payment_delay_days"),
        F.when(F.col("stage_prob") >= 0.75, "MEDIUM").otherwise("LOW").alias("confidence_tier"),
        F.lit("S4").alias("source_module"),
        F.lit("PIPELINE").alias("forecast_type"),
        F.lit(str(cfg.reference_date)).alias("forecast_date"),
    )


def pipeline_outputs(detail: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """S4-7: unified record, +/-30 %."""
    return unified(detail, "S4", "PIPELINE", 0.7, 1.3, cfg)
