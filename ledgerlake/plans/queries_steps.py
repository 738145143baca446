"""Query catalogue: the individual steps behind the assembled tables.

Each step is registered on its own so its result is checked by itself, not
only through the table it feeds.  The Spark side reuses the same operator
functions as the pipeline; the oracle side selects from the same SQL blocks.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.config import DEFAULT as CFG, S1_ORDINAL
from ledgerlake.functions.columns import lit_date
from ledgerlake.operators import features as fe
from ledgerlake.operators import forecasts as fc
from ledgerlake.operators import position as po
from ledgerlake.operators import recommend as rc
from ledgerlake.operators import training as tr
from ledgerlake.operators.quantiles import exact_quantile
from ledgerlake.plans.registry import pipe, reg


def step(key, spec, sql, fn):
    reg(key, spec, sql)(fn)


def _t(spark, d):
    return pipe(spark, d).t


# ------------------------------------------------------------------ customer features
step("CF-1", "invoice_id:i customer_id:i payment_date days_to_pay:i days_late:i",
     "SELECT invoice_id, customer_id, payment_date, days_to_pay, days_late FROM inv_pay",
     lambda s, d: fe.invoice_payments(_t(s, d)["invoices"], _t(s, d)["payments"]))
_pay = lambda s, d: fe.customer_payment_stats(fe.invoice_payments(_t(s, d)["invoices"], _t(s, d)["payments"]), CFG)
step("CF-2", "customer_id:i avg_payment_delay:d median_payment_delay:d late_payment_ratio:d payment_volatility:d "
             "avg_invoice_amount:d invoice_count:i", "cf_pay", _pay)
step("CF-3", "customer_id:i dispute_ratio:d", "cf_inv", lambda s, d: fe.customer_invoice_stats(_t(s, d)["invoices"]))
step("CF-4", "customer_id:i ptp_kept_ratio:d", "cf_ptp",
     lambda s, d: fe.ptp_kept(_t(s, d)["collections_events"], _t(s, d)["payments"]))
step("CF-5", "customer_id:i recent_reminder_velocity:i", "cf_rem",
     lambda s, d: fe.reminder_velocity(_t(s, d)["collections_events"], CFG))
step("CF-6", "customer_id:i open_dispute_count:i", "SELECT * FROM cf_inv WHERE open_dispute_count > 0",
     lambda s, d: fe.customer_invoice_stats(_t(s, d)["invoices"]).filter(F.col("open_dispute_count").isNotNull()))
step("CF-7", "customer_id:i days_since_last_payment:i", "cf_pay", _pay)
step("CF-8", "customer_id:i payment_trend_30d:d", "SELECT * FROM cf_pay WHERE payment_trend_30d IS NOT NULL",
     lambda s, d: _pay(s, d).filter(F.col("payment_trend_30d").isNotNull()))
step("CF-9", "customer_id:i days_sales_outstanding:d", "SELECT * FROM cf_inv WHERE days_sales_outstanding IS NOT NULL",
     lambda s, d: fe.customer_invoice_stats(_t(s, d)["invoices"]).filter(F.col("days_sales_outstanding").isNotNull()))
step("CF-10", "customer_id:i seasonality_index:d", "cf_season",
     lambda s, d: fe.seasonality(fe.invoice_payments(_t(s, d)["invoices"], _t(s, d)["payments"])))
step("CF-11", "customer_id:i non_invoice_payment_count:i", "cf_nip",
     lambda s, d: fe.non_invoice_stats(_t(s, d)["non_invoice_payments"], "CUSTOMER", "customer_id"))
step("CF-12", "customer_id:i advance_payment_ratio:d", "customer_features",
     lambda s, d: pipe(s, d).customer_features)

# ------------------------------------------------------------------ scores
step("PS-1", "vol_q95:d",
     "SELECT greatest(quantile_cont(payment_volatility, 0.95), 1.0) AS vol_q95 FROM customer_features",
     lambda s, d: exact_quantile(pipe(s, d).customer_features, "payment_volatility", 0.95, out="_q")
     .select(F.greatest(F.col("_q"), F.lit(1.0)).alias("vol_q95")))
step("PS-2", "customer_id:i payment_score:d", "payment_scores", lambda s, d: pipe(s, d).payment_scores)

# ------------------------------------------------------------------ invoice / collections / vendor / bill
_if = lambda s, d: pipe(s, d).invoice_features
step("IF-1", "invoice_id:i invoice_age_days:i days_past_due:i", "invoice_features", _if)
step("IF-2", "invoice_id:i amount_percentile_customer:d", "invoice_features", _if)
step("IF-3", "invoice_id:i invoice_amount_bucket", "invoice_features", _if)
step("IF-4", "invoice_id:i payment_terms", "invoice_features", _if)
step("IF-5", "invoice_id:i partial_payment_amount:d partial_payment_flag", "invoice_features", _if)
_co = lambda s, d: pipe(s, d).collections_features
step("CO-1", "invoice_id:i reminder_count:i call_count:i", "collections_features", _co)
step("CO-2", "invoice_id:i promise_to_pay_flag promise_to_pay_date", "collections_features", _co)
step("CO-3", "invoice_id:i days_since_last_contact:i", "collections_features", _co)
step("CO-4", "invoice_id:i escalation_status", "collections_features", _co)
step("VF-1", "bill_id:i vendor_id:i payment_date payment_cycle_days:i days_late:i",
     "SELECT bill_id, vendor_id, payment_date, payment_cycle_days, days_late FROM bill_pay",
     lambda s, d: fe.bill_payments(_t(s, d)["bills"], _t(s, d)["payments"]))
_vf = lambda s, d: pipe(s, d).vendor_features
step("VF-2", "vendor_id:i avg_payment_cycle_days:d payment_volatility:d late_payment_ratio:d avg_invoice_amount:d "
             "invoice_count:i", "vendor_features", _vf)
step("VF-3", "vendor_id:i discount_capture_ratio:d", "vendor_features", _vf)
step("VF-4", "vendor_id:i vendor_chase_frequency:i", "vendor_features", _vf)
step("VF-5", "vendor_id:i last_payment_date", "vendor_features", _vf)
step("VF-6", "vendor_id:i po_to_bill_lag:d", "vf_lag",
     lambda s, d: fe.po_to_bill_lag(_t(s, d)["purchase_orders"], _t(s, d)["bills"]))
step("VF-7", "vendor_id:i advance_payment_ratio:d", "vendor_features", _vf)
_bf = lambda s, d: pipe(s, d).bill_features
step("BF-1", "bill_id:i bill_age_days:i days_past_due:i", "bill_features", _bf)
step("BF-2", "bill_id:i amount_percentile_vendor:d bill_amount_bucket", "bill_features", _bf)
step("BF-3", "bill_id:i approval_status", "bill_features", _bf)
step("BF-4", "bill_id:i early_payment_eligible penalty_accruing", "bill_features", _bf)


# ------------------------------------------------------------------ training-set assembly
def _s1_frame(s, d):
    p = pipe(s, d)
    return tr.s1_training_frame(p.invoice_features, p.customer_features, p.collections_features, p.payment_scores)


step("TS-1", "invoice_id:i customer_id:i avg_payment_delay:d reminder_count:i payment_score:d risk_segment",
     "s1_frame", _s1_frame)
step("TS-2", "invoice_id:i payment_terms_days:i", "s1_frame", _s1_frame)
step("TS-3", "invoice_id:i days_until_ptp:i", "s1_frame", _s1_frame)
step("TS-4", "bill_id:i vendor_id:i avg_payment_cycle_days:d payment_terms_days:i bill_date bill_status", "s2_frame",
     lambda s, d: tr.s2_training_frame(pipe(s, d).bill_features, pipe(s, d).vendor_features, _t(s, d)["vendors"],
                                       _t(s, d)["bills"]))
step("TS-5", "customer_id:i risk_segment target:i", "risk_base",
     lambda s, d: tr.risk_training_frame(pipe(s, d).customer_features, pipe(s, d).payment_scores))
step("TS-6", "reference_id:i first_payment_date",
     "SELECT reference_id, min(payment_date) AS first_payment_date FROM payments WHERE reference_type = 'AR' "
     "GROUP BY reference_id", lambda s, d: tr.first_payment(_t(s, d)["payments"], "AR"))
step("TS-10", "invoice_id:i invoice_amount_bucket_enc:i risk_segment_enc:i escalation_status_enc:i", "s1_encoded",
     lambda s, d: tr.ordinal_encode(_s1_frame(s, d), S1_ORDINAL))
step("TS-11", "invoice_id:i dispute_flag:i partial_payment_flag:i promise_to_pay_flag:i", "s1_encoded",
     lambda s, d: tr.bools_to_int(_s1_frame(s, d), ["dispute_flag", "partial_payment_flag", "promise_to_pay_flag"]))


def _s1_design(s, d):
    from ledgerlake.operators.lookups import S1_FEATURES
    f = tr.bools_to_int(tr.ordinal_encode(_s1_frame(s, d), S1_ORDINAL),
                        ["dispute_flag", "partial_payment_flag", "promise_to_pay_flag"])
    return tr.select_features(f, S1_FEATURES, keep=["invoice_id"])


from ledgerlake.operators.lookups import S1_FEATURES as _S1F  # noqa: E402

step("TS-12", "invoice_id:i " + " ".join(f"{c}:d" for c in _S1F), "s1_design", _s1_design)

# ------------------------------------------------------------------ prediction outputs
_s1p = lambda s, d: pipe(s, d).s1_predictions
step("PP-1", "transaction_id:i predicted_payment_date baseline_predicted_date", "s1_predictions", _s1p)
step("PP-2", "transaction_id:i prob_pay_0_30:d prob_pay_30_60:d prob_pay_60_plus:d", "s1_predictions", _s1p)

# ------------------------------------------------------------------ forecasts steps
step("S3-1", "milestone_id:i project_id:i completion_pct:d completion_status expected_completion_date",
     "SELECT * FROM project_milestones WHERE milestone_id IN (SELECT milestone_id FROM s3_base)",
     lambda s, d: fc.forecastable_milestones(_t(s, d)["project_milestones"], CFG))
_s3b = lambda s, d: fc.attach_delay(fc.forecastable_milestones(_t(s, d)["project_milestones"], CFG),
                                    pipe(s, d).customer_features, CFG)
step("S3-2", "milestone_id:i customer_payment_delay:d", "s3_base", _s3b)
_s3 = lambda s, d: pipe(s, d).s3_detail
step("S3-3", "milestone_id:i expected_completion_date", "s3_detail", _s3)
step("S3-4", "milestone_id:i expected_invoice_date expected_cash_date", "s3_detail", _s3)
step("S3-5", "milestone_id:i confidence_tier", "s3_detail", _s3)
_s4 = lambda s, d: pipe(s, d).s4_detail
step("S4-2", "opportunity_id:i deal_delay:d", "s4_base",
     lambda s, d: fc.attach_delay(fc.open_pipeline(_t(s, d)["crm_pipeline"]),
                                  pipe(s, d).customer_features.select(
                                      "customer_id", fe.clip(F.col("avg_payment_delay"), lo=0.0)
                                      .alias("avg_payment_delay")), CFG, out="deal_delay"))
step("S4-4", "opportunity_id:i stage_prob:d", "s4_base",
     lambda s, d: fc.open_pipeline(_t(s, d)["crm_pipeline"]).withColumn(
         "stage_prob", fc.stage_probability(_t(s, d)["crm_pipeline"])))
step("S4-5", "opportunity_id:i ms_idx:i weight:d offset_days:i",
     "SELECT opportunity_id, ms_idx, weight, off AS offset_days FROM s4_exploded",
     lambda s, d: fc.open_pipeline(_t(s, d)["crm_pipeline"])
     .select("opportunity_id", F.posexplode(fc.milestone_plan()).alias("ms_idx", "ms"))
     .select("opportunity_id", "ms_idx", F.col("ms.weight").alias("weight"), F.col("ms.offset").alias("offset_days")))
step("S5-1", "inflow_id:i expected_receipt_date", "SELECT * FROM contingent_inflows WHERE expected_receipt_date "
     "BETWEEN DATE '2001-08-02' AND DATE '2002-01-29'", lambda s, d: fc.inflow_horizon(_t(s, d)["contingent_inflows"]))
step("S6-1", "expense_id:i obligation_date", "SELECT * FROM expense_schedule WHERE obligation_date "
     "BETWEEN DATE '2001-08-02' AND DATE '2002-01-29'", lambda s, d: fc.expense_horizon(_t(s, d)["expense_schedule"]))

# ------------------------------------------------------------------ cash aggregation steps
EVR = ("event_id source_module forecast_type direction target_date forecast_amount:d confidence_tier forecast_date "
       "forecast_run_id original_file")
step("S7-1", EVR, "SELECT * FROM events_raw WHERE source_module = 'S3'",
     lambda s, d: po.standardise(pipe(s, d).s3_detail, "S3", CFG))
step("S7-2", "event_id direction", "events_raw", lambda s, d: po.event_store(pipe(s, d).forecast_sources(), CFG))
step("S7-3", "event_id confidence_tier", "events_raw", lambda s, d: po.event_store(pipe(s, d).forecast_sources(), CFG))
step("S7-4", "source_module events:i", "SELECT source_module, count(*) AS events FROM events_raw GROUP BY 1",
     lambda s, d: po.event_store(pipe(s, d).forecast_sources(), CFG).groupBy("source_module")
     .agg(F.count(F.lit(1)).alias("events")))
step("S7-5", EVR, "events_raw", lambda s, d: po.event_store(pipe(s, d).forecast_sources(), CFG))
step("S7-8", "target_date gross_inflow:d gross_outflow:d", """
SELECT target_date, coalesce(sum(forecast_amount) FILTER (WHERE forecast_amount > 0), 0.0) AS gross_inflow,
       abs(coalesce(sum(forecast_amount) FILTER (WHERE forecast_amount < 0), 0.0)) AS gross_outflow
FROM active_events GROUP BY target_date""",
     lambda s, d: po.active(pipe(s, d).event_store).groupBy("target_date").agg(
         F.coalesce(F.sum(F.when(F.col("forecast_amount") > 0, F.col("forecast_amount"))), F.lit(0.0)).alias("gross_inflow"),
         F.abs(F.coalesce(F.sum(F.when(F.col("forecast_amount") < 0, F.col("forecast_amount"))), F.lit(0.0)))
         .alias("gross_outflow")))
step("S7-9", "date gross_inflow:d gross_outflow:d net_flow:d", "daily_position", lambda s, d: pipe(s, d).daily)

# ------------------------------------------------------------------ recommendation steps
_ov = lambda s, d: pipe(s, d).overdue
step("RE-1", "invoice_id:i customer_id:i days_past_due:i payment_score:d risk_segment prediction_confidence",
     "overdue", _ov)
_cc = lambda s, d: rc.collections_candidates(
    rc.overdue_scores(pipe(s, d).invoice_features, pipe(s, d).payment_scores), CFG)
step("RE-2", "invoice_id:i response_probability:d expected_cash_impact:d", "coll_cand", _cc)
step("RE-3", "invoice_id:i total_score:d", "coll_cand", _cc)
step("RE-4", "invoice_id:i total_score:d",
     "SELECT invoice_id, total_score FROM coll_cand ORDER BY total_score DESC, invoice_id LIMIT 10",
     lambda s, d: _cc(s, d).orderBy(F.col("total_score").desc(), F.col("invoice_id")).limit(CFG.collections_top))
