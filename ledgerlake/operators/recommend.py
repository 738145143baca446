"""Recommendation engine: collections acceleration, vendor deferral, expense deferral.

Each lever scores its candidates with built-in expressions; normalisers
(max impact, max days overdue, max amount) are one-row aggregates joined by
broadcast.  Top-k selection is ``orderBy(...).limit(k)``, which Spark plans
as a distributed ``TakeOrderedAndProject`` (per-partition top-k, then a merge
of k rows per partition), so no lever ever sorts or collects its full input.
The final ranking runs over at most 10 + 5 + 3 rows.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.config import DEFAULT, RECOMMENDATION_WEIGHTS as W, Settings
from ledgerlake.functions.columns import clip, half_even, lit_date, stable_id
from ledgerlake.session import cut_lineage

REC_COLUMNS = ["recommendation_id", "lever", "priority", "entity_type", "entity_id", "customer_id", "action",
               "channel", "description", "cash_impact", "days_accelerated", "risk_segment", "score", "confidence"]

# The lever, action and description texts below are fixed values: they must read the same everywhere.

def money0(c) -> F.Column:
    """``f"{x:,.0f}"``."""
    return F.format_number(c, 0)


def overdue_view(invoice_features: DataFrame, collections_features: DataFrame, scores: DataFrame,
                 s1_predictions: DataFrame) -> DataFrame:
    """RE-1: overdue invoices (days_past_due > 0) with collections, score and S1 prediction context."""
    preds = s1_predictions.select(F.col("transaction_id").alias("invoice_id"), "predicted_payment_date",
                                  F.col("confidence_tier").alias("prediction_confidence"))
    return (invoice_features.filter(F.col("days_past_due") > 0)
            .join(collections_features, "invoice_id", "left")
            .join(scores.select("customer_id", "payment_score", "risk_segment"), "customer_id", "left")
            .join(preds, "invoice_id", "left"))


def overdue_scores(invoice_features: DataFrame, scores: DataFrame) -> DataFrame:
    """The columns of overdue invoices that the collections lever scores: no collections history, no ranks, no predictions."""
    return (invoice_features.filter(F.col("days_past_due") > 0)
            .select("invoice_id", "customer_id", "invoice_amount", "days_past_due")
            .join(scores.select("customer_id", "payment_score", "risk_segment"), "customer_id", "left"))


def collections_candidates(overdue: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """RE-2/RE-3: response probability, expected impact and weighted score for every overdue invoice."""
    prob = clip(F.coalesce(F.col("payment_score"), F.lit(0.5)), 0.1, 0.95)
    c = (overdue.withColumn("response_probability", prob)
         .withColumn("expected_cash_impact", F.col("invoice_amount") * F.col("response_probability")))
    norm = F.broadcast(c.agg(F.max("expected_cash_impact").alias("_mi"), F.max("days_past_due").alias("_mo")))
    score_cash = F.when(F.col("_mi") > 0, F.col("expected_cash_impact") / F.col("_mi")).otherwise(F.lit(0.0))
    score_risk = clip(F.col("days_past_due") / F.greatest(F.col("_mo"), F.lit(1)), 0, 1)
    total = (W["cash"] * score_cash + W["risk"] * score_risk + W["target"] * F.col("response_probability")
             + F.lit(W["feasibility"] * 0.8))
    return c.crossJoin(norm).withColumn("total_score", half_even(total, 4))


def collections_lever(overdue: DataFrame, s1_predictions: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """RE-4/RE-5: top-k overdue invoices as collection recommendations.  The candidates are scored narrow and written once (the
    normalisers and the ranking both read them); only the k chosen invoices meet their predictions."""
    top = (collections_candidates(cut_lineage(overdue, "overdue"), cfg)
           .orderBy(F.col("total_score").desc(), F.col("invoice_id")).limit(cfg.collections_top))
    preds = s1_predictions.select(F.col("transaction_id").alias("invoice_id"),
                                  F.col("confidence_tier").alias("prediction_confidence"))
    # at most collections_top rows: a bounded broadcast, so the predictions are scanned and not shuffled
    found = preds.join(F.broadcast(top.select("invoice_id")), "invoice_id", "left_semi")
    top = top.join(F.broadcast(found), "invoice_id", "left")
    risk = F.col("risk_segment")
    action = (F.when(risk == "HIGH", "Formal notice + phone call").when(risk == "MEDIUM", "Email reminder + follow-up call")
              .otherwise("Portal nudge + email"))
    channel = F.when(risk == "HIGH", "FORMAL").otherwise("REMINDER")
    s = F.col("total_score")
    desc = F.concat(
        F.lit("Escalate "), F.col("invoice_id").cast("string"), F.lit(" ($"), money0(F.col("invoice_amount")),
        F.lit(", "), F.col("days_past_due").cast("int").cast("string"), F.lit(f" days overdue) — est. accelerate by "),
        F.lit(str(cfg.accel_days)), F.lit(" days, expected cash impact $"), money0(F.col("expected_cash_impact")))
    return top.select(
        stable_id(F.lit("COLLECTIONS"), F.col("invoice_id"), F.lit(cfg.run_id)).alias("recommendation_id"),
        F.lit("COLLECTIONS").alias("lever"),
        F.when(s > 0.7, "HIGH").when(s > 0.4, "MEDIUM").otherwise("LOW").alias("priority"),
        F.lit("INVOICE").alias("entity_type"),
        F.col("invoice_id").alias("entity_id"),
        F.col("customer_id"),
        action.alias("action"), channel.alias("channel"), desc.alias("description"),
        half_even(F.col("expected_cash_impact"), 2).alias("cash_impact"),
        F.lit(cfg.accel_days).alias("days_accelerated"),
        risk.alias("risk_segment"),
        s.alias("score"),
        F.col("prediction_confidence").alias("confidence"),
    )


def vendor_deferral_lever(s2_predictions: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """RE-6: AP payments predicted within the next 14 days, scored by amount, top 5."""
    ref = lit_date(cfg.reference_date)
    up = s2_predictions.filter(F.col("predicted_payment_date").between(ref, F.date_add(ref, cfg.vendor_window_days)))
    mx = F.broadcast(up.agg(F.max("expected_payment_amount").alias("_mx")))
    score = half_even(W["cash"] * (F.col("expected_payment_amount") / F.greatest(F.col("_mx"), F.lit(1.0)))
                      + F.lit(W["feasibility"] * 0.7), 4)
    top = (up.crossJoin(mx).withColumn("score", score)
           .orderBy(F.col("score").desc(), F.col("transaction_id")).limit(cfg.vendor_top))
    amt = money0(F.col("expected_payment_amount"))
    d = cfg.vendor_defer_days
    return top.select(
        stable_id(F.lit("VENDOR_DEFERRAL"), F.col("transaction_id"), F.lit(cfg.run_id)).alias("recommendation_id"),
        F.lit("VENDOR_DEFERRAL").alias("lever"), F.lit("MEDIUM").alias("priority"), F.lit("BILL").alias("entity_type"),
        F.col("transaction_id").alias("entity_id"), F.lit(None).cast("long").alias("customer_id"),
        F.lit(f"Defer payment by {d} days (no penalty)").alias("action"), F.lit("TREASURY").alias("channel"),
        F.concat(F.lit("Defer "), F.col("transaction_id").cast("string"), F.lit(" ($"), amt,
                 F.lit(f") by {d} days — improves short-term cash by $"), amt).alias("description"),
        half_even(F.col("expected_payment_amount"), 2).alias("cash_impact"),
        F.lit(-d).alias("days_accelerated"), F.lit(None).cast("string").alias("risk_segment"),
        F.col("score"), F.col("confidence_tier").alias("confidence"),
    )


def expense_deferral_lever(s6_detail: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """RE-7: deferrable expense categories, top 3 by amount; score relative to the largest of the three."""
    d = cfg.expense_defer_days
    top = (s6_detail.filter(F.col("category").isin(*cfg.expense_categories))
           .withColumn("cash_freed", F.abs("amount"))
           .orderBy(F.col("cash_freed").desc(), F.col("expense_id")).limit(cfg.expense_top))
    mx = F.broadcast(top.agg(F.max("cash_freed").alias("_mx")))        # over the (<= 3) selected rows
    label = F.when(F.coalesce(F.col("notes"), F.lit("")) != "", F.col("notes")).otherwise(F.col("expense_id").cast("string"))
    amt = money0(F.col("cash_freed"))
    return top.crossJoin(mx).select(
        stable_id(F.lit("EXPENSE_DEFERRAL"), F.col("expense_id"), F.lit(cfg.run_id)).alias("recommendation_id"),
        F.lit("EXPENSE_DEFERRAL").alias("lever"), F.lit("LOW").alias("priority"), F.lit("EXPENSE").alias("entity_type"),
        F.col("expense_id").alias("entity_id"), F.lit(None).cast("long").alias("customer_id"),
        F.concat(F.lit("Defer "), F.lower("category"), F.lit(f" expense by {d} days")).alias("action"),
        F.lit("FINANCE").alias("channel"),
        F.concat(F.lit("Defer "), label, F.lit(" ($"), amt, F.lit(f") by {d} days — frees $"), amt,
                 F.lit(" during the period")).alias("description"),
        half_even(F.col("cash_freed"), 2).alias("cash_impact"),
        F.lit(-d).alias("days_accelerated"), F.lit(None).cast("string").alias("risk_segment"),
        half_even(F.lit(0.3) + F.lit(0.1) * (F.col("cash_freed") / F.greatest(F.col("_mx"), F.lit(1.0))), 4).alias("score"),
        F.lit("LOW").alias("confidence"),
    )


def rank_recommendations(levers: list[DataFrame], cfg: Settings = DEFAULT) -> DataFrame:
    """RE-8: union of the levers (<= 18 rows), global rank by score, top N."""
    allrec = reduce(DataFrame.unionByName, levers)
    # at most collections_top + vendor_top + expense_top rows: a single ordered window is bounded
    w = Window.orderBy(F.col("score").desc(), F.col("lever"), F.col("entity_id"))
    return allrec.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= cfg.top_n)


def recommendation_summary(recs: DataFrame) -> DataFrame:
    """RE-9: count and cash impact by lever and by priority (grouping sets, one pass)."""
    return (recs.groupingSets([["lever"], ["priority"]], "lever", "priority")
            .agg(F.count(F.lit(1)).alias("recommendations"), half_even(F.sum("cash_impact"), 2).alias("cash_impact")))
