"""Payment-prediction tables (S1 AR, S2 AP) and their unified forecast records.

A prediction frame carries ``primary`` and ``baseline`` model outputs next to
the document metadata; it is produced either by the MLlib models
(``operators.models``) or by ``pseudo_predictions`` (deterministic, for
checks that must not depend on model training).
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.config import DEFAULT, Settings
from ledgerlake.functions.columns import half_even, clip, stable_id

PREDICTION_COLUMNS = ["transaction_id", "transaction_type", "predicted_payment_date", "baseline_predicted_date",
                      "prob_pay_0_30", "prob_pay_30_60", "prob_pay_60_plus", "expected_payment_amount",
                      "trigger_event", "confidence_tier", "prediction_date", "model_version"]


def pseudo_predictions(labelled: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """Deterministic stand-in for model output: label + (id % 11) - 5 and label + (id % 7) - 3."""
    return labelled.withColumn("pred_primary", (F.col(label_col) + F.col(id_col) % 11 - 5).cast("double")) \
                   .withColumn("pred_baseline", (F.col(label_col) + F.col(id_col) % 7 - 3).cast("double"))


def _as_days(c):
    return clip(c, lo=0.0).cast("int")


def predicted_dates(scored: DataFrame) -> DataFrame:
    """Scored invoices with the date on which PP-1 expects their payment."""
    return scored.withColumn("predicted_payment_date", F.date_add("invoice_date", _as_days(half_even(F.col("pred_primary"), 1))))


def ar_predictions(scored: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """PP-1..PP-3: S1 ``payment_predictions`` from scored invoices
    (invoice_id, invoice_date, invoice_amount, primary, baseline)."""
    days = half_even(F.col("pred_primary"), 1)
    div = F.abs(F.col("pred_primary") - F.col("pred_baseline"))
    tier = F.when(F.col("pred_baseline").isNull(), "MEDIUM").when(div < 3, "HIGH").when(div < 7, "MEDIUM").otherwise("LOW")
    return scored.select(
        F.col("invoice_id").alias("transaction_id"),
        F.lit("AR").alias("transaction_type"),
        F.date_add("invoice_date", _as_days(days)).alias("predicted_payment_date"),
        F.date_add("invoice_date", _as_days(half_even(F.col("pred_baseline"), 0))).alias("baseline_predicted_date"),
        (days <= 30).cast("double").alias("prob_pay_0_30"),
        ((days > 30) & (days <= 60)).cast("double").alias("prob_pay_30_60"),
        (days > 60).cast("double").alias("prob_pay_60_plus"),
        F.col("invoice_amount").alias("expected_payment_amount"),
        F.lit("BATCH_PREDICTION").alias("trigger_event"),
        tier.alias("confidence_tier"),
        F.lit(str(cfg.reference_date)).alias("prediction_date"),
        F.lit("lgbm-v1.0").alias("model_version"),
    )


def ap_predictions(scored: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """PP-4: S2 ``payment_predictions`` from scored bills
    (bill_id, bill_date, bill_amount, payment_terms_days, primary, baseline)."""
    delta = half_even(F.col("pred_primary"), 1)
    terms = F.col("payment_terms_days")
    div = F.abs(F.col("pred_primary") - F.col("pred_baseline"))
    tier = F.when(F.col("pred_baseline").isNull(), "MEDIUM").when(div < 3, "HIGH").when(div < 5, "MEDIUM").otherwise("LOW")
    return scored.select(
        F.col("bill_id").alias("transaction_id"),
        F.lit("AP").alias("transaction_type"),
        F.date_add("bill_date", _as_days(terms + delta)).alias("predicted_payment_date"),
        F.date_add("bill_date", _as_days(terms + half_even(F.col("pred_baseline"), 0))).alias("baseline_predicted_date"),
        (F.abs(delta) <= 5).cast("double").alias("prob_pay_0_30"),
        ((F.abs(delta) > 5) & (F.abs(delta) <= 15)).cast("double").alias("prob_pay_30_60"),
        (F.abs(delta) > 15).cast("double").alias("prob_pay_60_plus"),
        F.col("bill_amount").alias("expected_payment_amount"),
        F.lit("BATCH_PREDICTION").alias("trigger_event"),
        tier.alias("confidence_tier"),
        F.lit(str(cfg.reference_date)).alias("prediction_date"),
        F.lit("lgbm-v1.0").alias("model_version"),
    )


def prediction_outputs(preds: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """PP-5: unified record; AR +/-10 %, AP negated with low = -1.1x, high = -0.9x."""
    is_ap = F.col("transaction_type") == "AP"
    amt = F.when(is_ap, -F.col("expected_payment_amount")).otherwise(F.col("expected_payment_amount"))
    module = F.when(is_ap, F.lit("S2")).otherwise(F.lit("S1"))
    return preds.select(
        stable_id(module, F.col("transaction_id"), F.lit(cfg.run_id)).alias("forecast_id"),
        F.lit(str(cfg.reference_date)).alias("forecast_date"),
        F.col("transaction_type").alias("forecast_type"),
        F.col("predicted_payment_date").alias("target_date"),
        amt.alias("forecast_amount"),
        (F.when(is_ap, F.lit(1.1)).otherwise(F.lit(0.9)) * amt).alias("confidence_low"),
        (F.when(is_ap, F.lit(0.9)).otherwise(F.lit(1.1)) * amt).alias("confidence_high"),
        module.alias("source_module"),
        F.lit(cfg.run_id).alias("forecast_run_id"),
    )
