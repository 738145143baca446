"""Query catalogue: training sets, splits and evaluation metrics (on deterministic pseudo-predictions)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.config import DEFAULT as CFG
from ledgerlake.operators import metrics as me
from ledgerlake.operators import training as tr
from ledgerlake.plans.registry import pipe, reg


def _s1(spark, d, train=False):
    e = pipe(spark, d).s1_eval
    return e.filter(F.col("is_train") == train)


def _s2(spark, d, train=False):
    e = pipe(spark, d).s2_eval
    return e.filter(F.col("is_train") == train)


def _risk_test(spark, d):
    return pipe(spark, d).risk_eval.filter(~F.col("is_train"))


@reg("TS-13", "invoice_id:i invoice_date days_to_pay:i is_train", "s1_split")
def q_time_split(spark, d):
    return pipe(spark, d).s1_eval


@reg("TS-14", "invoice_id:i is_train", "s1_random_split")
def q_random_split(spark, d):
    return tr.random_split(pipe(spark, d).ar_labelled, "invoice_id", CFG.test_size, CFG.seed)


@reg("TS-16", "bill_id:i is_train", "s2_seq_split")
def q_seq_split(spark, d):
    return tr.sequential_split(pipe(spark, d).ap_labelled, "bill_id", CFG.test_size)


@reg("TS-15", "target:i is_train n:i", "risk_split_counts")
def q_stratified(spark, d):
    return pipe(spark, d).risk_eval.groupBy("target", "is_train").agg(F.count(F.lit(1)).alias("n"))


@reg("TS-17", "n:i mean:d std:d median:d", "s1_target_summary")
def q_target_summary(spark, d):
    return tr.target_summary(_s1(spark, d, True), "days_to_pay")


@reg("TS-9", "target:i count:i pct:d", "risk_class_dist")
def q_class_dist(spark, d):
    return tr.class_distribution(pipe(spark, d).risk_eval, "target")


@reg("ML-5", "customer_id:i target:i class_weight:d", "risk_weights")
def q_class_weights(spark, d):
    tr_rows = pipe(spark, d).risk_eval.filter(F.col("is_train")).select("customer_id", "target")
    return tr.class_weights(tr_rows, "target")


@reg("ME-1", "mae:d rmse:d r2:d mape:d median_ae:d", "me1")
def q_me1(spark, d):
    return me.regression_metrics(_s1(spark, d))


@reg("ME-2", "overfit_ratio:d overfit_warning", "me2")
def q_me2(spark, d):
    return me.overfit_check(me.regression_metrics(_s1(spark, d, True)), me.regression_metrics(_s1(spark, d)),
                            CFG.overfit_threshold)


@reg("ME-3", "best_model improvement_pct:d", "me3")
def q_me3(spark, d):
    t = _s1(spark, d)
    return me.compare_models(me.regression_metrics(t), me.regression_metrics(t, p="pred_baseline"))


@reg("ME-4", "divergence_mean:d divergence_max:d divergence_above:i divergence_above_pct:d divergence_median:d",
     "me4")
def q_me4(spark, d):
    return me.divergence(_s1(spark, d), "pred_primary", "pred_baseline", CFG.s1_divergence_threshold)


@reg("ME-5", " ".join(f"error_pct_within_{b}d:d" for b in CFG.s1_error_buckets)
     + f" error_pct_over_{CFG.s1_error_buckets[-1]}d:d", "me5")
def q_me5(spark, d):
    return me.error_buckets(_s1(spark, d), CFG.s1_error_buckets)


ACC = ("accuracy_within_3d:d accuracy_within_5d:d accuracy_within_7d:d accuracy_within_10d:d "
       "directional_accuracy:d explained_variance:d mean_bias_error:d")


@reg("ME-6", ACC, "me6")
def q_me6(spark, d):
    mean = F.broadcast(_s1(spark, d, True).agg(F.avg("label").alias("_ym")))     # one row
    return me.accuracy_metrics(_s1(spark, d).crossJoin(mean), F.col("_ym"))


@reg("ME-6:s2", ACC, "me6_s2")
def q_me6_s2(spark, d):
    return me.accuracy_metrics(_s2(spark, d), F.lit(0.0))


@reg("ME-7", "thin_vendor_mae:d rich_vendor_mae:d", "me7")
def q_me7(spark, d):
    return me.segment_mae(_s2(spark, d), F.col("invoice_count") < CFG.thin_vendor_invoices)


@reg("ML-10", "thin_vendor_mae:d rich_vendor_mae:d", "ml10")
def q_ml10(spark, d):
    return me.segment_mae(_s2(spark, d, True), F.col("invoice_count") < CFG.thin_vendor_invoices)


@reg("ML-9", "divergence_mean:d divergence_max:d divergence_above:i divergence_above_pct:d divergence_median:d",
     "ml9")
def q_ml9(spark, d):
    return me.divergence(pipe(spark, d).s1_eval, "pred_primary", "pred_baseline", CFG.s1_divergence_threshold)


CLS = ("accuracy:d precision_macro:d recall_macro:d f1_macro:d precision_weighted:d recall_weighted:d "
       "f1_weighted:d f1_LOW:d f1_MEDIUM:d f1_HIGH:d")


@reg("ME-8", CLS, "me8")
def q_me8(spark, d):
    return me.classification_metrics(_risk_test(spark, d))


@reg("ME-9", "auc_roc_ovr:d", "me9")
def q_me9(spark, d):
    return me.auc_ovr_macro(_risk_test(spark, d), {0: "prob_0", 1: "prob_1", 2: "prob_2"})


@reg("ME-10", "actual:i pred_0:i pred_1:i pred_2:i", "me10")
def q_me10(spark, d):
    return me.confusion_matrix(_risk_test(spark, d))


@reg("ME-10:report", "class_name precision:d recall:d f1:d support:i", "me10r")
def q_me10r(spark, d):
    return me.classification_report(_risk_test(spark, d))


@reg("ME-11", "agreement_pct:d", "me11")
def q_me11(spark, d):
    return me.agreement(_risk_test(spark, d), "prediction", "baseline_class")


@reg("SNK-5", "metric value:d", "snk5")
def q_snk5(spark, d):
    return me.long_report(me.regression_metrics(_s1(spark, d)))


@reg("TS-17:s2", "n:i mean:d std:d median:d", "SELECT count(*) AS n, avg(adjustment_delta) AS mean, "
     "stddev_samp(adjustment_delta) AS std, quantile_cont(adjustment_delta, 0.5) AS median FROM s2_train")
def q_target_summary_s2(spark, d):
    return tr.target_summary(_s2(spark, d, True), "adjustment_delta")


@reg("SNK-5:risk", "metric value:d text", "SELECT metric, value, CAST(NULL AS VARCHAR) AS text FROM (SELECT * FROM me8) UNPIVOT "
     "(value FOR metric IN (accuracy, precision_macro, recall_macro, f1_macro, precision_weighted, recall_weighted, "
     "f1_weighted, f1_LOW, f1_MEDIUM, f1_HIGH))")
def q_risk_report(spark, d):
    return me.long_report(me.classification_metrics(_risk_test(spark, d)))


@reg("SNK-5:models", "metric value:d text", "SELECT 'best_model' AS metric, CAST(NULL AS DOUBLE) AS value, best_model AS text FROM me3 "
     "UNION ALL SELECT 'improvement_pct', CAST(improvement_pct AS DOUBLE), NULL FROM me3")
def q_model_report(spark, d):
    t = _s1(spark, d)
    return me.long_report(me.compare_models(me.regression_metrics(t), me.regression_metrics(t, p="pred_baseline")))


@reg("SNK-5:s7", "metric value:d text", """
SELECT metric, value, CAST(NULL AS VARCHAR) AS text FROM (SELECT CAST(total_inflows AS DOUBLE) AS total_inflows,
  CAST(total_outflows AS DOUBLE) AS total_outflows, CAST(closing_balance AS DOUBLE) AS closing_balance,
  CAST(total_events AS DOUBLE) AS total_events FROM s7_summary)
  UNPIVOT (value FOR metric IN (total_inflows, total_outflows, closing_balance, total_events))
UNION ALL SELECT 'min_cash_date', NULL, CAST(min_cash_date AS VARCHAR) FROM s7_summary""")
def q_position_report(spark, d):
    from ledgerlake.operators import position as po
    p = pipe(spark, d)
    return me.long_report(po.position_summary(p.daily, p.source_days, CFG).select(
        "total_inflows", "total_outflows", "closing_balance", "total_events", "min_cash_date"))
