"""Query catalogue: forecast summaries, cash-position reports, recommendation summaries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.config import DEFAULT as CFG
from ledgerlake.operators import position as po
from ledgerlake.operators import summaries as su
from ledgerlake.operators.ranking import global_position
from ledgerlake.plans.registry import pipe, reg

BREAK = "dimension key count:i total_amount:d"


@reg("S3-7", "total_milestones:i total_projects:i total_customers:i total_forecast_amount:d avg_forecast_amount:d",
     "s3_summary")
def q_s3_summary(spark, d):
    return su.wip_summary(pipe(spark, d).s3_detail)


@reg("S3-7:breakdown", BREAK, "s3_breakdown")
def q_s3_breakdown(spark, d):
    return su.wip_breakdown(pipe(spark, d).s3_detail)


@reg("S3-8", "cash_week forecast_amount:d", "s3_weekly")
def q_s3_weekly(spark, d):
    return su.weekly_timeline(pipe(spark, d).s3_detail)


@reg("S4-1", "crm_stage deals:i total_value:d", "s4_stage_mix")
def q_stage_mix(spark, d):
    return su.stage_mix(pipe(spark, d).t["crm_pipeline"])


@reg("S4-3", "global_milestone_count:i global_avg_invoice_amount:d global_avg_days_to_pay:d total_closed_deals:i",
     "s4_cohort")
def q_cohort(spark, d):
    t = pipe(spark, d).t
    return su.cohort_stats(t["invoices"], t["payments"])


@reg("S4-8", "total_records:i total_deals:i total_customers:i total_forecast_amount:d avg_per_milestone:d",
     "s4_summary")
def q_s4_summary(spark, d):
    return su.pipeline_summary(pipe(spark, d).s4_detail)


@reg("S4-8:breakdown", BREAK, "s4_breakdown")
def q_s4_breakdown(spark, d):
    return su.pipeline_breakdown(pipe(spark, d).s4_detail)


@reg("S4-8:monthly", "cash_month forecast_amount:d", "s4_monthly")
def q_s4_monthly(spark, d):
    return su.monthly_timeline(pipe(spark, d).s4_detail)


@reg("S5-4", BREAK, "s5_breakdown")
def q_s5_breakdown(spark, d):
    return su.inflow_breakdown(pipe(spark, d).s5_detail)


@reg("S5-4:totals", "total_records:i total_forecast:d", "s5_totals")
def q_s5_totals(spark, d):
    return su.module_totals(pipe(spark, d).s5_detail)


@reg("S6-4", BREAK, "s6_breakdown")
def q_s6_breakdown(spark, d):
    return su.expense_breakdown(pipe(spark, d).s6_detail)


@reg("S6-4:totals", "total_records:i total_forecast:d", "s6_totals")
def q_s6_totals(spark, d):
    return su.module_totals(pipe(spark, d).s6_detail, absolute=True)


@reg("S7-6", "source_module direction confidence_tier events:i", "s7_profile")
def q_s7_profile(spark, d):
    return po.profile(pipe(spark, d).event_store)


@reg("S7-13", "total_inflows:d total_outflows:d net_position_change:d closing_balance:d min_cash_position:d "
              "min_cash_date forecast_days:i total_events:i active_events:i suppressed_events:i opening_balance:d",
     "s7_summary")
def q_s7_summary(spark, d):
    p = pipe(spark, d)
    return po.position_summary(p.daily, p.source_days, CFG)


@reg("S7-14", "forecast_id forecast_date forecast_type target_date forecast_amount:d confidence_low:d "
              "confidence_high:d source_module forecast_run_id", "s7_cash_fo")
def q_s7_cash(spark, d):
    return po.cash_outputs(pipe(spark, d).daily, CFG)


@reg("S7-15", "source_module event_count:i total:d flow_direction abs_total:d", "s7_by_source")
def q_s7_by_source(spark, d):
    return po.by_source(pipe(spark, d).source_days)


@reg("RE-9", "lever priority recommendations:i cash_impact:d", "re_summary")
def q_re_summary(spark, d):
    from ledgerlake.operators.recommend import recommendation_summary
    return recommendation_summary(pipe(spark, d).recommendations)


@reg("RE-10", "invoice_id:i customer_id:i days_past_due:i total_score:d prob_pay_0_30:d prob_pay_30_60:d "
              "prob_pay_60_plus:d priority_rank:i", "re_prioritised")
def q_re_prioritised(spark, d):
    """Collections prioritisation: every overdue invoice ranked by score, with payment-timing buckets."""
    from ledgerlake.operators.recommend import collections_candidates, overdue_scores
    p = pipe(spark, d)
    cand = collections_candidates(overdue_scores(p.invoice_features, p.payment_scores), CFG)
    b = p.s1_predictions.select(F.col("transaction_id").alias("invoice_id"), "prob_pay_0_30", "prob_pay_30_60",
                                "prob_pay_60_plus")
    j = cand.join(b, "invoice_id", "left").withColumn("_neg", -F.col("total_score"))
    return global_position(j, ["_neg", "invoice_id"]).withColumn("priority_rank", F.col("_pos") + 1)


@reg("QY-16", "expected_cash_date inflow:d outflow:d", "qy16")
def q_cash_timeline(spark, d):
    p = pipe(spark, d)
    return su.cash_timeline(p.s5_detail, p.s6_detail)
