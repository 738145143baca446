"""Model evaluation metrics as distributed aggregates.

Every metric is computed by one aggregation over a scored frame
(``label``, ``prediction`` columns), partially aggregated map-side; medians use
the exact quantile from value counts.  Nothing is collected: results are one-row
DataFrames that ``long_report`` unpivots into (metric, value) rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.functions.columns import half_even
from ledgerlake.operators.quantiles import exact_quantile
from ledgerlake.operators.ranking import group_value_ranks


def regression_metrics(df: DataFrame, y: str = "label", p: str = "prediction", prefix: str = "") -> DataFrame:
    """ME-1: MAE, RMSE, R2, MAPE (label != 0, x100) and median AE, rounded to 3 places."""
    err = F.col(y) - F.col(p)
    base = df.agg(
        F.avg(F.abs(err)).alias("_mae"),
        F.sqrt(F.avg(err * err)).alias("_rmse"),
        F.sum(err * err).alias("_sse"),
        (F.var_pop(y) * F.count(F.lit(1))).alias("_sst"),
        F.avg(F.when(F.col(y) != 0, F.abs(err / F.col(y)))).alias("_mape"),
    )
    med = exact_quantile(df.select(F.abs(err).alias("_ae")), "_ae", 0.5, out="_medae")
    out = base.crossJoin(med)
    r2 = F.when(F.col("_sst") > 0, F.lit(1.0) - F.col("_sse") / F.col("_sst")).otherwise(F.lit(0.0))
    return out.select(
        half_even(F.col("_mae"), 3).alias(f"{prefix}mae"),
        half_even(F.col("_rmse"), 3).alias(f"{prefix}rmse"),
        half_even(r2, 3).alias(f"{prefix}r2"),
        half_even(F.coalesce(F.col("_mape") * 100, F.lit(0.0)), 3).alias(f"{prefix}mape"),
        half_even(F.col("_medae"), 3).alias(f"{prefix}median_ae"),
    )


def overfit_check(train_mae: DataFrame, test_mae: DataFrame, threshold: float = 1.5) -> DataFrame:
    """ME-2: test/train MAE ratio (1.0 when train MAE is 0), and the warning flag."""
    j = train_mae.select(F.col("mae").alias("_tr")).crossJoin(F.broadcast(test_mae.select(F.col("mae").alias("_te"))))
    ratio = F.when(F.col("_tr") > 0, F.col("_te") / F.col("_tr")).otherwise(F.lit(1.0))
    return j.select(half_even(ratio, 3).alias("overfit_ratio"), (ratio > threshold).alias("overfit_warning"))


def compare_models(primary: DataFrame, baseline: DataFrame, metric: str = "mae", lower_is_better: bool = True,
                   names=("GBT", "RandomForest")) -> DataFrame:
    """ME-3: best model and improvement percentage (ties go to the baseline)."""
    j = primary.select(F.col(metric).alias("_a")).crossJoin(F.broadcast(baseline.select(F.col(metric).alias("_b"))))
    a, b = F.col("_a"), F.col("_b")
    wins = (a < b) if lower_is_better else (a > b)
    if lower_is_better:                               # equal zero errors: no improvement
        imp = F.coalesce(F.when(wins, F.try_divide(b - a, b)).otherwise(F.try_divide(a - b, a)), F.lit(0.0)) * 100
    else:
        imp = F.when(wins, F.when(b > 0, (a - b) / b * 100).otherwise(F.lit(0.0))) \
               .otherwise(F.when(a > 0, (b - a) / a * 100).otherwise(F.lit(0.0)))
    return j.select(F.when(wins, names[0]).otherwise(names[1]).alias("best_model"),
                    half_even(imp, 2).alias("improvement_pct"))


def divergence(df: DataFrame, a: str, b: str, threshold: float) -> DataFrame:
    """ME-4 / ML-9: |primary - baseline|: mean, median, max, count and share above the threshold."""
    d = df.select(F.abs(F.col(a) - F.col(b)).alias("_d"))
    base = d.agg(F.avg("_d").alias("divergence_mean"), F.max("_d").alias("divergence_max"),
                 F.count_if(F.col("_d") > threshold).alias("divergence_above"),
                 (F.avg(F.when(F.col("_d") > threshold, 1.0).otherwise(0.0)) * 100).alias("divergence_above_pct"))
    return base.crossJoin(exact_quantile(d, "_d", 0.5, out="divergence_median"))


def error_buckets(df: DataFrame, buckets, y: str = "label", p: str = "prediction") -> DataFrame:
    """ME-5: % of absolute errors within each bucket, and beyond the last."""
    ae = F.abs(F.col(y) - F.col(p))
    cols = [(F.avg(F.when(ae <= b, 1.0).otherwise(0.0)) * 100).alias(f"error_pct_within_{b}d") for b in buckets]
    cols.append((F.avg(F.when(ae > buckets[-1], 1.0).otherwise(0.0)) * 100).alias(f"error_pct_over_{buckets[-1]}d"))
    return df.agg(*cols)


def accuracy_metrics(df: DataFrame, direction_ref: F.Column, y: str = "label", p: str = "prediction") -> DataFrame:
    """ME-6: tolerance accuracy (3/5/7/10 days), directional accuracy against ``direction_ref``
    (S1: the train mean, S2: 0), explained variance, mean bias error."""
    err = F.col(y) - F.col(p)
    ae = F.abs(err)
    tol = [half_even(F.avg(F.when(ae <= t, 1.0).otherwise(0.0)) * 100, 1).alias(f"accuracy_within_{t}d")
           for t in (3, 5, 7, 10)]
    same_dir = (F.col(y) > direction_ref) == (F.col(p) > direction_ref)
    ev = F.when(F.var_pop(y) > 0, F.lit(1.0) - F.var_pop(err) / F.var_pop(y)).otherwise(F.lit(0.0))
    return df.agg(*tol,
                  half_even(F.avg(F.when(same_dir, 1.0).otherwise(0.0)) * 100, 1).alias("directional_accuracy"),
                  half_even(ev, 4).alias("explained_variance"),
                  half_even(F.avg(F.col(p) - F.col(y)), 3).alias("mean_bias_error"))


def segment_mae(df: DataFrame, cond: F.Column, y: str = "label", p: str = "prediction",
                names=("thin_vendor_mae", "rich_vendor_mae")) -> DataFrame:
    """ME-7 / ML-10: MAE inside and outside a segment (e.g. vendors with < 10 invoices)."""
    ae = F.abs(F.col(y) - F.col(p))
    return df.agg(half_even(F.avg(F.when(cond, ae)), 3).alias(names[0]),
                  half_even(F.avg(F.when(~cond, ae)), 3).alias(names[1]))


def confusion_counts(df: DataFrame, y: str = "label", p: str = "prediction") -> DataFrame:
    return df.groupBy(F.col(y).alias("actual"), F.col(p).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def classification_metrics(df: DataFrame, classes=(0, 1, 2), names=("LOW", "MEDIUM", "HIGH"),
                           y: str = "label", p: str = "prediction") -> DataFrame:
    """ME-8: accuracy, macro and weighted precision / recall / F1 (zero division -> 0), per-class F1,
    from one confusion-count aggregate (<= k*k rows)."""
    cc = confusion_counts(df, y, p)
    aggs = [F.sum("n").alias("_tot"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n"))).alias("_hit")]
    for c in classes:
        aggs += [F.sum(F.when((F.col("actual") == c) & (F.col("predicted") == c), F.col("n"))).alias(f"_tp{c}"),
                 F.sum(F.when(F.col("predicted") == c, F.col("n"))).alias(f"_pp{c}"),
                 F.sum(F.when(F.col("actual") == c, F.col("n"))).alias(f"_ap{c}")]
    a = cc.agg(*aggs).na.fill(0)

    def z(num, den):
        return F.when(den > 0, num / den).otherwise(F.lit(0.0))

    prec = {c: z(F.col(f"_tp{c}"), F.col(f"_pp{c}")) for c in classes}
    rec = {c: z(F.col(f"_tp{c}"), F.col(f"_ap{c}")) for c in classes}
    f1 = {c: z(2 * prec[c] * rec[c], prec[c] + rec[c]) for c in classes}
    k = float(len(classes))
    sup = {c: F.col(f"_ap{c}") for c in classes}

    def macro(m):
        return sum(m[c] for c in classes) / k

    def weighted(m):
        return z(sum(m[c] * sup[c] for c in classes), F.col("_tot"))

    cols = [half_even(z(F.col("_hit"), F.col("_tot")), 4).alias("accuracy"),
            half_even(macro(prec), 4).alias("precision_macro"), half_even(macro(rec), 4).alias("recall_macro"),
            half_even(macro(f1), 4).alias("f1_macro"),
            half_even(weighted(prec), 4).alias("precision_weighted"),
            half_even(weighted(rec), 4).alias("recall_weighted"), half_even(weighted(f1), 4).alias("f1_weighted")]
    cols += [half_even(f1[c], 4).alias(f"f1_{n}") for c, n in zip(classes, names)]
    return a.select(*cols)


def auc_ovr_macro(df: DataFrame, prob_cols: dict[int, str], y: str = "label") -> DataFrame:
    """ME-9: one-vs-rest AUC per class by the rank-sum (Mann-Whitney) formula with average ranks
    for ties, averaged over classes.

    Rows are counted per (class, score), with how many are positive; ranks come from the skew-safe
    ``group_value_ranks`` on those counts.  So no row is joined back on its score, and tied or null scores (left out)
    cost nothing.  A class without positives or without negatives has no AUC and is left out of the mean."""
    s = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("_cls"), F.col(col).cast("double").alias("_s"),
                                               (F.col(y) == c).alias("_pos")) for c, col in prob_cols.items()])).alias("r")
                  ).select("r.*").filter(F.col("_s").isNotNull())
    pos = s.groupBy("_cls", "_s").agg(F.count_if("_pos").alias("_hits"))
    ranked = group_value_ranks(s, "_cls", "_s").join(pos, ["_cls", "_s"])
    rank = F.col("_less") + (F.col("_eq") + 1) / 2.0
    per = ranked.groupBy("_cls").agg(F.sum(F.col("_hits") * rank).alias("_rs"), F.sum("_hits").alias("_np"),
                                     F.sum(F.col("_eq") - F.col("_hits")).alias("_nn"))
    auc = F.try_divide(F.col("_rs") - F.col("_np") * (F.col("_np") + 1) / 2.0, (F.col("_np") * F.col("_nn")).cast("double"))
    return per.agg(half_even(F.avg(auc), 4).alias("auc_roc_ovr"))


def confusion_matrix(df: DataFrame, classes=(0, 1, 2), y: str = "label", p: str = "prediction") -> DataFrame:
    """ME-10: actual x predicted counts, zero-filled (pivot with explicit values: no extra pass)."""
    return (df.groupBy(F.col(y).alias("actual")).pivot(p, list(classes)).agg(F.count(F.lit(1))).na.fill(0)
            .select("actual", *[F.col(str(c)).alias(f"pred_{c}") for c in classes]))


def classification_report(df: DataFrame, classes=(0, 1, 2), names=("LOW", "MEDIUM", "HIGH"),
                          y: str = "label", p: str = "prediction") -> DataFrame:
    """ME-10: per-class precision, recall, F1 and support."""
    cc = confusion_counts(df, y, p)
    per = cc.groupBy().agg(*[
        F.struct(F.sum(F.when((F.col("actual") == c) & (F.col("predicted") == c), F.col("n"))).alias("tp"),
                 F.sum(F.when(F.col("predicted") == c, F.col("n"))).alias("pp"),
                 F.sum(F.when(F.col("actual") == c, F.col("n"))).alias("ap")).alias(f"c{c}") for c in classes])
    rows = per.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("class_name"), F.col(f"c{c}.tp").alias("tp"), F.col(f"c{c}.pp").alias("pp"),
                 F.col(f"c{c}.ap").alias("ap")) for c, n in zip(classes, names)])).alias("r")).select("r.*")
    rows = rows.na.fill(0)
    prec = F.when(F.col("pp") > 0, F.col("tp") / F.col("pp")).otherwise(F.lit(0.0))
    rec = F.when(F.col("ap") > 0, F.col("tp") / F.col("ap")).otherwise(F.lit(0.0))
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    return rows.select("class_name", half_even(prec, 4).alias("precision"), half_even(rec, 4).alias("recall"),
                       half_even(f1, 4).alias("f1"), F.col("ap").cast("long").alias("support"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """ME-11: share of rows where two models agree, in percent."""
    return df.agg(half_even(F.avg(F.when(F.col(a) == F.col(b), 1.0).otherwise(0.0)) * 100, 2).alias("agreement_pct"))


def long_report(wide: DataFrame) -> DataFrame:
    """SNK-5: one-row metrics frame -> (metric, value, text) rows: numbers in ``value``, names and dates in ``text``."""
    numeric = {f.name for f in wide.schema.fields if isinstance(f.dataType, (T.NumericType, T.BooleanType))}
    rows = [F.struct(F.lit(c).alias("metric"), (F.col(c) if c in numeric else F.lit(None)).cast("double").alias("value"),
                     (F.lit(None) if c in numeric else F.col(c)).cast("string").alias("text")) for c in wide.columns]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
