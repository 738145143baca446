"""Query catalogue: serving-side lookups over request batches derived from the tables."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.operators import lookups as lk
from ledgerlake.operators import metrics as me
from ledgerlake.operators import summaries as su
from ledgerlake.operators.position import monthly_position, weekly_position
from ledgerlake.plans.queries_core import DAILY, REC, S6D
from ledgerlake.plans.registry import pipe, reg

CB = " ".join(f"{c}:d" for c in lk.CUSTOMER_BEHAVIOUR)
VB = " ".join(f"{c}:d" for c in lk.VENDOR_BEHAVIOUR)
S1V = " ".join(f"{c}:d" for c in lk.S1_FEATURES)
S2V = " ".join(f"{c}:d" for c in lk.S2_FEATURES)


@reg("QY-1", CB, "qy1_customer")
def q_defaults_customer(spark, d):
    return lk.customer_defaults(pipe(spark, d).customer_features)


@reg("QY-1:vendor", VB, "qy1_vendor")
def q_defaults_vendor(spark, d):
    return lk.vendor_defaults(pipe(spark, d).vendor_features)


@reg("QY-1:scores", "payment_score:d expected_delay:d risk_segment", "qy1_scores")
def q_defaults_scores(spark, d):
    return lk.score_defaults(pipe(spark, d).payment_scores)


@reg("QY-2", "invoice_id:i " + S1V, "qy2")
def q_s1_lookup(spark, d):
    p = pipe(spark, d)
    ids = p.t["collections_events"].select("invoice_id")          # invoices a collector has touched
    return lk.s1_lookup(ids, p.invoice_features, p.customer_features, p.collections_features, p.payment_scores)


@reg("QY-3", "bill_id:i " + S2V, "qy3")
def q_s2_lookup(spark, d):
    p = pipe(spark, d)
    ids = p.t["bills"].filter(F.col("bill_status").isin("OPEN", "APPROVED")).select("bill_id")   # unpaid bills
    return lk.s2_lookup(ids, p.bill_features, p.vendor_features)


@reg("QY-3:risk", "customer_id:i " + CB, "qy3_risk")
def q_risk_lookup(spark, d):
    p = pipe(spark, d)
    ids = p.invoice_features.filter(F.col("days_past_due") > 0).select("customer_id")   # customers with overdue AR
    return lk.risk_lookup(ids, p.customer_features)


def invoice_requests(p) -> DataFrame:
    """New-invoice requests: every WIP milestone billed on its expected completion date."""
    m = p.t["project_milestones"]
    return m.select(F.col("milestone_id").alias("request_id"), "customer_id",
                    F.col("billing_amount").alias("invoice_amount"),
                    F.col("expected_completion_date").alias("invoice_date"),
                    F.date_add("expected_completion_date", 30).alias("due_date"),
                    F.lit("NET30").alias("payment_terms"), F.lit(False).alias("dispute_flag"),
                    F.lit(0.0).alias("partial_payment_amount"))


@reg("QY-4", "request_id:i customer_source " + S1V, "qy4")
def q_new_invoices(spark, d):
    p = pipe(spark, d)
    return lk.new_invoice_vectors(invoice_requests(p), p.customer_features, p.payment_scores)


def bill_requests(p) -> DataFrame:
    """New-bill requests: every purchase order billed on its expected invoice date."""
    po = p.t["purchase_orders"]
    return po.select(F.col("po_id").alias("request_id"), "vendor_id", F.col("po_amount").alias("bill_amount"),
                     F.col("expected_invoice_date").alias("bill_date"),
                     F.date_add("expected_invoice_date", 30).alias("due_date"),
                     F.lit("PENDING").alias("approval_status"))


@reg("QY-5", "request_id:i vendor_source " + S2V, "qy5")
def q_new_bills(spark, d):
    p = pipe(spark, d)
    return lk.new_bill_vectors(bill_requests(p), p.vendor_features)


@reg("QY-6", "request_id:i " + CB, "qy6")
def q_new_customers(spark, d):
    p = pipe(spark, d)
    req = p.customer_features.select(F.col("customer_id").alias("request_id"), "avg_payment_delay",
                                     "late_payment_ratio", "payment_volatility", "dispute_ratio", "ptp_kept_ratio",
                                     "days_sales_outstanding", "invoice_count")
    return lk.new_customer_vectors(req, p.customer_features)


SCORE = "id:i prediction:d baseline_prediction:d model_divergence:d confidence"


@reg("QY-7", SCORE, "qy7")
def q_score_s1(spark, d):
    return lk.score_regression(pipe(spark, d).ar_scored, "invoice_id", "S1")


@reg("QY-7:s2", SCORE + " direction", "qy7_s2")
def q_score_s2(spark, d):
    return lk.score_regression(pipe(spark, d).ap_scored, "bill_id", "S2")


@reg("QY-8", "customer_id:i risk_segment baseline_segment prob_LOW:d prob_MEDIUM:d prob_HIGH:d max_probability:d "
             "confidence model_agreement", "qy8")
def q_score_risk(spark, d):
    return lk.score_risk(pipe(spark, d).risk_eval)


@reg("QY-9", "project_id:i count:i", "qy9_projects")
def q_list_projects(spark, d):
    return lk.id_listing(pipe(spark, d).s3_detail, "project_id", 50, distinct=True)


@reg("QY-9:deals", "opportunity_id:i count:i", "qy9_deals")
def q_list_deals(spark, d):
    return lk.id_listing(pipe(spark, d).s4_detail, "opportunity_id", 50, distinct=True)


@reg("QY-9:invoices", "invoice_id:i count:i", "qy9_invoices")
def q_list_invoices(spark, d):
    return lk.id_listing(pipe(spark, d).invoice_features, "invoice_id", 50)


@reg("QY-10", "project_id:i customer_id:i project_type milestones:i total_forecast:d first_cash_date last_cash_date",
     "qy10")
def q_projects(spark, d):
    return lk.project_lookup(pipe(spark, d).s3_detail)


@reg("QY-11", "opportunity_id:i customer_id:i deal_value:d crm_stage stage_probability:d milestones:i "
              "total_weighted_forecast:d first_cash_date last_cash_date", "qy11")
def q_deals(spark, d):
    return lk.deal_lookup(pipe(spark, d).s4_detail)


@reg("QY-12", "total_milestones:i total_projects:i total_customers:i total_forecast_amount:d avg_forecast_amount:d",
     "s3_summary")
def q_s3_api_summary(spark, d):
    return su.wip_summary(pipe(spark, d).s3_detail)


@reg("QY-12:s4", "total_records:i total_deals:i total_customers:i total_forecast_amount:d avg_per_milestone:d",
     "s4_summary")
def q_s4_api_summary(spark, d):
    return su.pipeline_summary(pipe(spark, d).s4_detail)


@reg("QY-13", "module dimension key count:i total_amount:d", "qy13")
def q_s5_s6_summary(spark, d):
    p = pipe(spark, d)
    return (su.inflow_breakdown(p.s5_detail).withColumn("module", F.lit("S5"))
            .unionByName(su.expense_breakdown(p.s6_detail).withColumn("module", F.lit("S6"))))


@reg("QY-14", "source_module total_events:i active_events:i suppressed_events:i active_amount:d", "qy14")
def q_s7_status(spark, d):
    return lk.source_status(pipe(spark, d).source_days)


@reg("QY-15", "total_recommendations:i total_cash_impact:d high_priority:i collections:i vendor_deferrals:i "
              "expense_deferrals:i", "qy15")
def q_rec_overview(spark, d):
    return lk.recommendation_overview(pipe(spark, d).recommendations)


@reg("QY-17", "mae:d rmse:d r2:d mape:d median_ae:d", "qy17")
def q_metric_pivot(spark, d):
    e = pipe(spark, d).s1_eval.filter(~F.col("is_train"))
    return lk.metric_pivot(me.long_report(me.regression_metrics(e)), ["mae", "rmse", "r2", "mape", "median_ae"])


@reg("QY-18", "forecast_id inflow_id:i category amount:d expected_receipt_date expected_cash_date "
              "receipt_lag_days:i approval_status confidence_tier source_document_ref forecast_amount:d "
              "source_module forecast_type forecast_date notes", "s5_detail")
def q_whole_s5(spark, d):
    return pipe(spark, d).s5_detail


@reg("QY-19", "module records:i entities:i total_amount:d first_date last_date", "qy19")
def q_profile(spark, d):
    p = pipe(spark, d)
    parts = [lk.module_profile("S3", p.s3_detail, "project_id", "forecast_amount", "expected_cash_date"),
             lk.module_profile("S4", p.s4_detail, "opportunity_id", "forecast_amount", "expected_cash_date"),
             lk.module_profile("S5", p.s5_detail, "inflow_id", "forecast_amount", "expected_cash_date"),
             lk.module_profile("S6", p.s6_detail, "expense_id", "forecast_amount", "expected_cash_date"),
             lk.module_profile("invoices", p.t["invoices"], "customer_id", "invoice_amount", "invoice_date")]
    return reduce(DataFrame.unionByName, parts)


MIXES = {"S3": ("s3_detail", ["project_type", "confidence_tier"]), "S4": ("s4_detail", ["crm_stage", "deal_type"]),
         "S5": ("s5_detail", ["category", "approval_status", "confidence_tier"]),
         "S6": ("s6_detail", ["category", "recurrence_type", "confidence_tier"])}
INPUT_MIXES = {"invoices": ["invoice_status"], "bills": ["bill_status"], "payments": ["reference_type"],
               "customers": ["industry", "credit_terms"]}


@reg("QY-19:mix", "module attribute value records:i", " UNION ALL ".join(
    f"SELECT '{m}' AS module, '{c}' AS attribute, CAST({c} AS VARCHAR) AS value, count(*) AS records FROM {t} GROUP BY {c}"
    for m, t, cols in [(m, t, cols) for m, (t, cols) in MIXES.items()] + [(t, t, cols) for t, cols in INPUT_MIXES.items()]
    for c in cols))
def q_value_mixes(spark, d):
    p = pipe(spark, d)
    parts = [lk.value_mix(m, getattr(p, t), cols) for m, (t, cols) in MIXES.items()]
    parts += [lk.value_mix(t, p.t[t], cols) for t, cols in INPUT_MIXES.items()]
    return reduce(DataFrame.unionByName, parts)


@reg("QY-18:s6", S6D, "s6_detail")
def q_whole_s6(spark, d):
    return pipe(spark, d).s6_detail


@reg("QY-18:s7_daily", DAILY, "daily_position")
def q_whole_daily(spark, d):
    return pipe(spark, d).daily


@reg("QY-18:s7_weekly", "week gross_inflow:d gross_outflow:d net_flow:d closing_position:d", "weekly_position")
def q_whole_weekly(spark, d):
    return weekly_position(pipe(spark, d).daily)


@reg("QY-18:s7_monthly", "month gross_inflow:d gross_outflow:d net_flow:d closing_position:d", "monthly_position")
def q_whole_monthly(spark, d):
    return monthly_position(pipe(spark, d).daily)


@reg("QY-18:recommendations", REC + " rank:i", "recommendations")
def q_whole_recommendations(spark, d):
    return pipe(spark, d).recommendations


@reg("QY-3:clustered", "customer_id:i avg_payment_delay:d payment_volatility:d invoice_count:i",
     "SELECT * FROM customer_features WHERE customer_id % 100 = 0")
def q_clustered_lookup(spark, d):
    """Features of a batch of customers from the store clustered by customer."""
    import uuid

    from ledgerlake.plans.jobs import store_root
    from ledgerlake.sources import clustered
    cf = pipe(spark, d).customer_features
    path = clustered.write_clustered(cf, f"{store_root(spark, 'clustered')}/{uuid.uuid4().hex[:8]}", "customer_id")
    return clustered.lookup(spark, path, "customer_id", pipe(spark, d).t["customers"].select("customer_id").filter("customer_id % 100 = 0"))
