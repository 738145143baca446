"""Query catalogue: feature store, forecasts, predictions, cash position."""
from __future__ import annotations

from ledgerlake.plans.registry import pipe, reg

CF = ("customer_id:i avg_payment_delay:d median_payment_delay:d late_payment_ratio:d payment_volatility:d "
      "dispute_ratio:d ptp_kept_ratio:d recent_reminder_velocity:i open_dispute_count:i days_since_last_payment:i "
      "payment_trend_30d:d days_sales_outstanding:d seasonality_index:d avg_invoice_amount:d invoice_count:i "
      "non_invoice_payment_count:i advance_payment_ratio:d feature_date feature_version")


@reg("CF-13", CF, "customer_features")
def q_customer_features(spark, d):
    return pipe(spark, d).customer_features


PS = "customer_id:i payment_score:d expected_delay:d risk_segment score_date model_version"


@reg("PS-3", PS, "payment_scores")
def q_scores(spark, d):
    return pipe(spark, d).payment_scores


IF = ("invoice_id:i customer_id:i invoice_date due_date invoice_amount:d invoice_age_days:i days_past_due:i "
      "invoice_amount_bucket amount_percentile_customer:d payment_terms dispute_flag partial_payment_flag "
      "partial_payment_amount:d feature_date")


@reg("IF-6", IF, "invoice_features")
def q_invoice_features(spark, d):
    return pipe(spark, d).invoice_features


CO = ("invoice_id:i reminder_count:i call_count:i promise_to_pay_flag promise_to_pay_date days_since_last_contact:i "
      "escalation_status ptp_kept_ratio_customer:d")


@reg("CO-5", CO, "collections_features")
def q_collections_features(spark, d):
    return pipe(spark, d).collections_features


VF = ("vendor_id:i avg_payment_cycle_days:d payment_volatility:d late_payment_ratio:d avg_invoice_amount:d "
      "invoice_count:i discount_capture_ratio:d vendor_chase_frequency:i last_payment_date po_to_bill_lag:d "
      "advance_payment_ratio:d feature_date feature_version")


@reg("VF-8", VF, "vendor_features")
def q_vendor_features(spark, d):
    return pipe(spark, d).vendor_features


BF = ("bill_id:i vendor_id:i bill_age_days:i days_past_due:i bill_amount:d bill_amount_bucket "
      "amount_percentile_vendor:d approval_status early_payment_eligible penalty_accruing feature_date")


@reg("BF-5", BF, "bill_features")
def q_bill_features(spark, d):
    return pipe(spark, d).bill_features


# ----------------------------------------------------------------- targets & predictions
@reg("TS-7", "invoice_id:i customer_id:i invoice_date due_date invoice_amount:d first_payment_date days_to_pay:i",
     "ar_labelled")
def q_ar_labelled(spark, d):
    return pipe(spark, d).ar_labelled


@reg("TS-8", "bill_id:i vendor_id:i bill_date due_date bill_amount:d payment_terms_days:i first_payment_date "
             "actual_payment_days:i adjustment_delta:i", "ap_labelled")
def q_ap_labelled(spark, d):
    return pipe(spark, d).ap_labelled


PRED = ("transaction_id:i transaction_type predicted_payment_date baseline_predicted_date prob_pay_0_30:d "
        "prob_pay_30_60:d prob_pay_60_plus:d expected_payment_amount:d trigger_event confidence_tier "
        "prediction_date model_version")


@reg("PP-3", PRED, "s1_predictions")
def q_s1_predictions(spark, d):
    return pipe(spark, d).s1_predictions


@reg("PP-4", PRED, "s2_predictions")
def q_s2_predictions(spark, d):
    return pipe(spark, d).s2_predictions


FO = ("forecast_id forecast_date forecast_type target_date forecast_amount:d confidence_low:d confidence_high:d "
      "source_module forecast_run_id")


@reg("PP-5", FO, "SELECT * FROM s1_fo UNION ALL SELECT * FROM s2_fo")
def q_pp_outputs(spark, d):
    srcs = pipe(spark, d).forecast_sources(("S1", "S2"))
    return srcs["S1"].unionByName(srcs["S2"])


# ----------------------------------------------------------------- rule-based forecasts
S3D = ("forecast_id project_id:i milestone_id:i customer_id:i project_type milestone_name completion_pct:d "
       "completion_status billing_amount:d expected_completion_date expected_invoice_date expected_cash_date "
       "forecast_amount:d invoice_lag_days:i customer_payment_delay_days:i confidence_tier source_module "
       "forecast_type forecast_date")


@reg("S3-6", S3D, "s3_detail")
def q_s3(spark, d):
    return pipe(spark, d).s3_detail


S4D = ("forecast_id opportunity_id:i customer_id:i deal_value:d deal_type deal_size_band crm_stage "
       "stage_probability:d milestone_sequence:i milestone_weight:d forecast_amount:d expected_close_date "
       "expected_invoice_date expected_cash_date invoice_lag_days:i customer_payment_delay_days:i confidence_tier "
       "source_module forecast_type forecast_date")


@reg("S4-6", S4D, "s4_detail")
def q_s4(spark, d):
    return pipe(spark, d).s4_detail


@reg("S4-7", FO, "s4_fo")
def q_s4_fo(spark, d):
    return pipe(spark, d).forecast_sources(("S4",))["S4"]


S5D = ("forecast_id inflow_id:i category amount:d expected_receipt_date expected_cash_date receipt_lag_days:i "
       "approval_status confidence_tier source_document_ref forecast_amount:d source_module forecast_type "
       "forecast_date notes")


@reg("S5-2", S5D, "s5_detail")
def q_s5(spark, d):
    return pipe(spark, d).s5_detail


@reg("S5-3", FO, "s5_fo")
def q_s5_fo(spark, d):
    return pipe(spark, d).forecast_sources(("S5",))["S5"]


S6D = ("forecast_id expense_id:i category recurrence_type amount:d obligation_date expected_cash_date "
       "payment_lag_days:i confidence_tier source_document_ref approved_by forecast_amount:d source_module "
       "forecast_type forecast_date notes")


@reg("S6-2", S6D, "s6_detail")
def q_s6(spark, d):
    return pipe(spark, d).s6_detail


@reg("S6-3", FO, "s6_fo")
def q_s6_fo(spark, d):
    return pipe(spark, d).forecast_sources(("S6",))["S6"]


# ----------------------------------------------------------------- cash position
EV = ("event_id source_module forecast_type direction target_date forecast_amount:d confidence_tier forecast_date "
      "forecast_run_id original_file suppressed suppression_reason")


@reg("S7-7", EV, "event_store")
def q_event_store(spark, d):
    return pipe(spark, d).event_store


DAILY = "date gross_inflow:d gross_outflow:d net_flow:d cumulative_position:d"


@reg("S7-10", DAILY, "daily_position")
def q_daily(spark, d):
    return pipe(spark, d).daily


@reg("S7-11", "week gross_inflow:d gross_outflow:d net_flow:d closing_position:d", "weekly_position")
def q_weekly(spark, d):
    from ledgerlake.operators.position import weekly_position
    return weekly_position(pipe(spark, d).daily)


@reg("S7-12", "month gross_inflow:d gross_outflow:d net_flow:d closing_position:d", "monthly_position")
def q_monthly(spark, d):
    from ledgerlake.operators.position import monthly_position
    return monthly_position(pipe(spark, d).daily)


# ----------------------------------------------------------------- recommendations
REC = ("recommendation_id lever priority entity_type entity_id:i customer_id:i action channel description "
       "cash_impact:d days_accelerated:i risk_segment score:d confidence")


@reg("RE-5", REC, "rec_coll")
def q_rec_collections(spark, d):
    return pipe(spark, d).lever_collections


@reg("RE-6", REC, "rec_vendor")
def q_rec_vendor(spark, d):
    return pipe(spark, d).lever_vendor


@reg("RE-7", REC, "rec_expense")
def q_rec_expense(spark, d):
    return pipe(spark, d).lever_expense


@reg("RE-8", REC + " rank:i", "recommendations")
def q_recommendations(spark, d):
    return pipe(spark, d).recommendations
