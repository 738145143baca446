"""Serving-side queries re-aimed as batch DataFrame functions.

An HTTP handler that answered one id (or one new document) at a time becomes a
join of a *batch* of requests against the feature store: requests are
semi-joined / left-joined on the entity key, global defaults are a one-row
aggregate joined by broadcast, and every rule is a column expression.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.config import DEFAULT, RISK_CLASS, S1_ORDINAL, TERMS_DAYS, Settings
from ledgerlake.functions.columns import half_even, lit_date, lookup

# fixed values: serving-side encodings and feature orders
BUCKET_MAP, RISK_MAP, ESC_MAP = S1_ORDINAL["invoice_amount_bucket"], RISK_CLASS, S1_ORDINAL["escalation_status"]
APPROVAL_MAP = {"PENDING": 0, "APPROVED": 1}
RISK_LABELS = {0: "LOW", 1: "MEDIUM", 2: "HIGH"}

CUSTOMER_BEHAVIOUR = ["avg_payment_delay", "median_payment_delay", "late_payment_ratio", "payment_volatility",
                      "dispute_ratio", "ptp_kept_ratio", "recent_reminder_velocity", "open_dispute_count",
                      "days_since_last_payment", "payment_trend_30d", "days_sales_outstanding", "seasonality_index",
                      "avg_invoice_amount", "invoice_count", "non_invoice_payment_count", "advance_payment_ratio"]
S1_FEATURES = (["invoice_amount", "invoice_age_days", "days_past_due", "amount_percentile_customer",
                "payment_terms_days", "dispute_flag", "partial_payment_flag", "partial_payment_amount"]
               + CUSTOMER_BEHAVIOUR + ["payment_score", "expected_delay"]
               + ["reminder_count", "call_count", "promise_to_pay_flag", "days_since_last_contact",
                  "ptp_kept_ratio_customer", "days_until_ptp"]
               + ["invoice_amount_bucket_enc", "risk_segment_enc", "escalation_status_enc"])
VENDOR_BEHAVIOUR = ["avg_payment_cycle_days", "payment_volatility", "discount_capture_ratio", "late_payment_ratio",
                    "vendor_chase_frequency", "avg_invoice_amount", "invoice_count", "po_to_bill_lag",
                    "advance_payment_ratio"]
S2_FEATURES = VENDOR_BEHAVIOUR + ["bill_age_days", "days_past_due", "bill_amount", "amount_percentile_vendor",
                                  "early_payment_eligible", "penalty_accruing", "bill_amount_bucket_enc",
                                  "approval_status_enc"]
CR_FEATURES = CUSTOMER_BEHAVIOUR


def _mean_defaults(features: DataFrame, cols: list[str], min_active: int = 50) -> DataFrame:
    """Mean of each column over entities with history (invoice_count > 0) when there are
    more than ``min_active`` of them, else over all; one pass, one row."""
    active = F.col("invoice_count") > 0
    aggs = [F.count_if(active).alias("_na")]
    for c in cols:
        aggs += [F.avg(F.when(active, F.col(c))).alias(f"_a_{c}"), F.avg(c).alias(f"_all_{c}")]
    m = features.agg(*aggs)
    return m.select(*[half_even(F.when(F.col("_na") > min_active, F.col(f"_a_{c}")).otherwise(F.col(f"_all_{c}")), 3)
                      .alias(c) for c in cols])


def customer_defaults(cf: DataFrame) -> DataFrame:
    """QY-1: customer defaults (seasonality pinned to 1.0)."""
    d = _mean_defaults(cf, CUSTOMER_BEHAVIOUR)
    return d.withColumn("seasonality_index", F.lit(1.0))


def vendor_defaults(vf: DataFrame) -> DataFrame:
    """QY-1: vendor defaults."""
    return _mean_defaults(vf, VENDOR_BEHAVIOUR)


def score_defaults(scores: DataFrame) -> DataFrame:
    """QY-1: score defaults."""
    return scores.agg(half_even(F.avg("payment_score"), 3).alias("payment_score"),
                      half_even(F.avg("expected_delay"), 3).alias("expected_delay"),
                      F.lit("MEDIUM").alias("risk_segment"))


def s1_lookup(ids: DataFrame, invoice_features: DataFrame, cf: DataFrame, collections: DataFrame,
              scores: DataFrame) -> DataFrame:
    """QY-2: S1 feature vectors for a batch of invoice ids (serving encodings: unknown -> 1 / 1 / 0)."""
    inv = invoice_features.join(ids.select("invoice_id").distinct(), "invoice_id", "left_semi")
    j = (inv.join(cf.drop("feature_date", "feature_version"), "customer_id", "left")
         .join(collections, "invoice_id", "left")
         .join(scores.select("customer_id", "payment_score", "expected_delay", "risk_segment"), "customer_id", "left"))
    enc = {
        "payment_terms_days": F.coalesce(lookup("payment_terms", TERMS_DAYS), F.lit(30)),
        "days_until_ptp": F.coalesce(F.datediff("promise_to_pay_date", F.to_date("feature_date")), F.lit(-1)),
        "invoice_amount_bucket_enc": F.coalesce(lookup("invoice_amount_bucket", BUCKET_MAP), F.lit(1)),
        "risk_segment_enc": F.coalesce(lookup("risk_segment", RISK_MAP), F.lit(1)),
        "escalation_status_enc": F.coalesce(lookup("escalation_status", ESC_MAP), F.lit(0)),
    }
    for k, v in enc.items():
        j = j.withColumn(k, v)
    for b in ("dispute_flag", "partial_payment_flag", "promise_to_pay_flag"):
        j = j.withColumn(b, F.col(b).cast("int"))
    return j.select("invoice_id", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in S1_FEATURES])


def s2_lookup(ids: DataFrame, bill_features: DataFrame, vf: DataFrame) -> DataFrame:
    """QY-3: S2 feature vectors for a batch of bill ids."""
    b = bill_features.join(ids.select("bill_id").distinct(), "bill_id", "left_semi")
    j = b.join(vf.drop("feature_date", "feature_version", "last_payment_date"), "vendor_id", "left")
    j = (j.withColumn("bill_amount_bucket_enc", F.coalesce(lookup("bill_amount_bucket", BUCKET_MAP), F.lit(1)))
          .withColumn("approval_status_enc", F.coalesce(lookup("approval_status", APPROVAL_MAP), F.lit(0)))
          .withColumn("early_payment_eligible", F.col("early_payment_eligible").cast("int"))
          .withColumn("penalty_accruing", F.col("penalty_accruing").cast("int")))
    return j.select("bill_id", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in S2_FEATURES])


def risk_lookup(ids: DataFrame, cf: DataFrame) -> DataFrame:
    """QY-3: credit-risk feature vectors for a batch of customer ids."""
    c = cf.join(ids.select("customer_id").distinct(), "customer_id", "left_semi")
    return c.select("customer_id", *[F.coalesce(F.col(x).cast("double"), F.lit(0.0)).alias(x) for x in CR_FEATURES])


def _bucket_pct(amount: F.Column, avg: F.Column):
    bucket = (F.when(avg > 0, F.when(amount <= avg * 0.5, "SMALL").when(amount <= avg * 1.5, "MEDIUM")
                     .otherwise("LARGE")).otherwise("MEDIUM"))
    pct = F.when(avg > 0, F.least(F.lit(1.0), amount / (avg * 2))).otherwise(F.lit(0.5))
    return bucket, half_even(pct, 3)


def new_invoice_vectors(requests: DataFrame, cf: DataFrame, scores: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """QY-4: vectors for new invoices (request_id, customer_id, invoice_amount, invoice_date, due_date,
    payment_terms, dispute_flag, partial_payment_amount): the customer's stored features when it
    exists, else the global defaults; amount bucket/percentile against the customer's average."""
    ref = lit_date(cfg.reference_date)
    dflt = F.broadcast(customer_defaults(cf).select(*[F.col(c).alias(f"_d_{c}") for c in CUSTOMER_BEHAVIOUR])
                       .crossJoin(score_defaults(scores).select(F.col("payment_score").alias("_d_payment_score"),
                                                                F.col("expected_delay").alias("_d_expected_delay"))))
    store = cf.select("customer_id", *[F.col(c).alias(f"_s_{c}") for c in CUSTOMER_BEHAVIOUR]) \
              .withColumn("_known", F.lit(True))
    sc = scores.select("customer_id", F.col("payment_score").alias("_s_payment_score"),
                       F.col("expected_delay").alias("_s_expected_delay"), F.col("risk_segment").alias("_s_risk"),
                       F.lit(True).alias("_scored"))
    j = requests.join(store, "customer_id", "left").join(sc, "customer_id", "left").crossJoin(dflt)
    known = F.col("_known").isNotNull()
    scored = F.col("_scored").isNotNull()
    feat = {c: F.when(known, F.col(f"_s_{c}")).otherwise(F.col(f"_d_{c}")) for c in CUSTOMER_BEHAVIOUR}
    amount = F.col("invoice_amount")
    bucket, pct = _bucket_pct(amount, feat["avg_invoice_amount"])
    risk = F.when(scored, F.col("_s_risk")).otherwise(F.lit("MEDIUM"))
    cols = {
        "invoice_amount": amount,
        "invoice_age_days": F.datediff(ref, "invoice_date"),
        "days_past_due": F.greatest(F.lit(0), F.datediff(ref, "due_date")),
        "amount_percentile_customer": pct,
        "payment_terms_days": F.coalesce(lookup("payment_terms", TERMS_DAYS), F.lit(30)),
        "dispute_flag": F.col("dispute_flag").cast("int"),
        "partial_payment_flag": (F.col("partial_payment_amount") > 0).cast("int"),
        "partial_payment_amount": F.col("partial_payment_amount"),
        **feat,
        "payment_score": F.when(scored, F.col("_s_payment_score")).otherwise(F.col("_d_payment_score")),
        "expected_delay": F.when(scored, F.col("_s_expected_delay")).otherwise(F.col("_d_expected_delay")),
        "reminder_count": F.lit(0), "call_count": F.lit(0), "promise_to_pay_flag": F.lit(0),
        "days_since_last_contact": F.lit(-1),
        "ptp_kept_ratio_customer": feat["ptp_kept_ratio"],
        "days_until_ptp": F.lit(-1),
        "invoice_amount_bucket_enc": lookup(bucket, BUCKET_MAP),
        "risk_segment_enc": F.coalesce(lookup(risk, RISK_MAP), F.lit(1)),
        "escalation_status_enc": F.lit(0),
    }
    return j.select("request_id", F.when(known, "feature_store").otherwise("global_defaults").alias("customer_source"),
                    *[cols[c].cast("double").alias(c) for c in S1_FEATURES])


def new_bill_vectors(requests: DataFrame, vf: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """QY-5: vectors for new bills (request_id, vendor_id, bill_amount, bill_date, due_date, approval_status).
    Penalty rule here is ``status != PAID`` (differs from the batch bill features)."""
    ref = lit_date(cfg.reference_date)
    dflt = F.broadcast(vendor_defaults(vf).select(*[F.col(c).alias(f"_d_{c}") for c in VENDOR_BEHAVIOUR]))
    store = vf.select("vendor_id", *[F.col(c).alias(f"_s_{c}") for c in VENDOR_BEHAVIOUR]) \
              .withColumn("_known", F.lit(True))
    j = requests.join(store, "vendor_id", "left").crossJoin(dflt)
    known = F.col("_known").isNotNull()
    feat = {c: F.when(known, F.col(f"_s_{c}")).otherwise(F.col(f"_d_{c}")) for c in VENDOR_BEHAVIOUR}
    amount = F.col("bill_amount")
    bucket, pct = _bucket_pct(amount, feat["avg_invoice_amount"])
    dpd = F.greatest(F.lit(0), F.datediff(ref, "due_date"))
    to_due = F.datediff("due_date", ref)
    cols = {
        **feat,
        "bill_age_days": F.datediff(ref, "bill_date"),
        "days_past_due": dpd,
        "bill_amount": amount,
        "amount_percentile_vendor": pct,
        "early_payment_eligible": ((to_due > 0) & (to_due <= 10)).cast("int"),
        "penalty_accruing": ((dpd > 0) & (F.col("approval_status") != "PAID")).cast("int"),
        "bill_amount_bucket_enc": lookup(bucket, BUCKET_MAP),
        "approval_status_enc": F.coalesce(lookup("approval_status", APPROVAL_MAP), F.lit(1)),
    }
    return j.select("request_id", F.when(known, "feature_store").otherwise("global_defaults").alias("vendor_source"),
                    *[cols[c].cast("double").alias(c) for c in S2_FEATURES])


def new_customer_vectors(requests: DataFrame, cf: DataFrame) -> DataFrame:
    """QY-6: risk vectors from manual inputs (request_id, avg_payment_delay, late_payment_ratio,
    payment_volatility, dispute_ratio, ptp_kept_ratio, days_sales_outstanding, invoice_count)."""
    d = F.broadcast(customer_defaults(cf).select("recent_reminder_velocity", "days_since_last_payment",
                                                 "avg_invoice_amount"))
    j = requests.crossJoin(d)
    cols = {
        "avg_payment_delay": F.col("avg_payment_delay"),
        "median_payment_delay": F.col("avg_payment_delay") * 0.9,
        "late_payment_ratio": F.col("late_payment_ratio"),
        "payment_volatility": F.col("payment_volatility"),
        "dispute_ratio": F.col("dispute_ratio"),
        "ptp_kept_ratio": F.col("ptp_kept_ratio"),
        "recent_reminder_velocity": F.col("recent_reminder_velocity"),
        "open_dispute_count": F.lit(0),
        "days_since_last_payment": F.col("days_since_last_payment"),
        "payment_trend_30d": F.lit(0.0),
        "days_sales_outstanding": F.col("days_sales_outstanding"),
        "seasonality_index": F.lit(1.0),
        "avg_invoice_amount": F.col("avg_invoice_amount"),
        "invoice_count": F.col("invoice_count"),
        "non_invoice_payment_count": F.lit(0),
        "advance_payment_ratio": F.lit(0.0),
    }
    return j.select("request_id", *[cols[c].cast("double").alias(c) for c in CR_FEATURES])


def score_regression(scored: DataFrame, id_col: str, kind: str = "S1") -> DataFrame:
    """QY-7: primary / baseline / divergence tier for a scored batch (S1 floors at 0; S2 adds a
    LATER / EARLIER label).  A zero divergence reports null, as the service did."""
    p, b = F.col("pred_primary"), F.col("pred_baseline")
    div = F.abs(p - b)
    conf = F.when(b.isNull(), "UNKNOWN").when(div < 3, "HIGH").when(div < 7, "MEDIUM").otherwise("LOW")
    pred = F.greatest(F.lit(0.0), half_even(p, 1)) if kind == "S1" else half_even(p, 1)
    out = scored.select(F.col(id_col).alias("id"), pred.alias("prediction"), half_even(b, 1).alias("baseline_prediction"),
                        F.when(div != 0, half_even(div, 2)).alias("model_divergence"), conf.alias("confidence"))
    if kind == "S2":
        out = out.withColumn("direction", F.when(F.col("prediction") > 0, "LATER than scheduled")
                             .otherwise("EARLIER than scheduled"))
    return out


def score_risk(scored: DataFrame) -> DataFrame:
    """QY-8: risk label, per-class probabilities, tier by max probability, agreement with the baseline."""
    mx = F.greatest(F.col("prob_0"), F.col("prob_1"), F.col("prob_2"))
    label = lookup(F.col("prediction"), RISK_LABELS, "UNKNOWN")
    base = lookup(F.col("baseline_class"), RISK_LABELS, "UNKNOWN")
    return scored.select(
        "customer_id", label.alias("risk_segment"), base.alias("baseline_segment"),
        *[half_even(F.col(f"prob_{c}"), 4).alias(f"prob_{RISK_LABELS[c]}") for c in (0, 1, 2)],
        half_even(mx, 4).alias("max_probability"),
        F.when(mx >= 0.7, "HIGH").when(mx >= 0.5, "MEDIUM").otherwise("LOW").alias("confidence"),
        (label == base).alias("model_agreement"))


def id_listing(df: DataFrame, id_col: str, limit: int = 50, distinct: bool = False) -> DataFrame:
    """QY-9: the first ``limit`` ids (id order) and the total count; ``limit`` is the feature here."""
    ids = df.select(id_col).distinct() if distinct else df.select(id_col)
    total = F.broadcast(ids.agg(F.count(F.lit(1)).alias("count")))
    return ids.orderBy(id_col).limit(limit).crossJoin(total)


def project_lookup(s3: DataFrame) -> DataFrame:
    """QY-10 (batch form): per project: customer, type, milestones, total and cash-date range."""
    return s3.groupBy("project_id").agg(
        F.min("customer_id").alias("customer_id"), F.min("project_type").alias("project_type"),
        F.count(F.lit(1)).alias("milestones"), half_even(F.sum("forecast_amount"), 2).alias("total_forecast"),
        F.min("expected_cash_date").alias("first_cash_date"), F.max("expected_cash_date").alias("last_cash_date"))


def deal_lookup(s4: DataFrame) -> DataFrame:
    """QY-11 (batch form): per opportunity."""
    return s4.groupBy("opportunity_id").agg(
        F.min("customer_id").alias("customer_id"), F.min("deal_value").alias("deal_value"),
        F.min("crm_stage").alias("crm_stage"), F.min("stage_probability").alias("stage_probability"),
        F.count(F.lit(1)).alias("milestones"), half_even(F.sum("forecast_amount"), 2).alias("total_weighted_forecast"),
        F.min("expected_cash_date").alias("first_cash_date"), F.max("expected_cash_date").alias("last_cash_date"))


def source_status(days: DataFrame) -> DataFrame:
    """QY-14: per source: total, active and suppressed events, active amount, from the marked source days."""
    n, out = F.col("_events"), F.col("suppressed")
    return days.groupBy("source_module").agg(
        F.sum(n).alias("total_events"), F.coalesce(F.sum(F.when(~out, n)), F.lit(0)).alias("active_events"),
        F.coalesce(F.sum(F.when(out, n)), F.lit(0)).alias("suppressed_events"),
        half_even(F.sum(F.when(~out, F.col("_net"))), 2).alias("active_amount"))


def recommendation_overview(recs: DataFrame) -> DataFrame:
    """QY-15: totals of the published recommendations."""
    return recs.agg(F.count(F.lit(1)).alias("total_recommendations"),
                    half_even(F.sum("cash_impact"), 2).alias("total_cash_impact"),
                    F.count_if(F.col("priority") == "HIGH").alias("high_priority"),
                    F.count_if(F.col("lever") == "COLLECTIONS").alias("collections"),
                    F.count_if(F.col("lever") == "VENDOR_DEFERRAL").alias("vendor_deferrals"),
                    F.count_if(F.col("lever") == "EXPENSE_DEFERRAL").alias("expense_deferrals"))


def metric_pivot(long: DataFrame, metrics: list[str]) -> DataFrame:
    """QY-17: (metric, value) rows -> one row, one column per metric (explicit pivot values)."""
    return long.groupBy().pivot("metric", metrics).agg(F.first("value"))


def value_mix(name: str, df: DataFrame, columns: list[str]) -> DataFrame:
    """QY-19: how many rows hold each value of the given columns (one pass, grouping sets)."""
    which = F.coalesce(*[F.when(F.grouping(c) == 0, F.lit(c)) for c in columns])
    value = F.coalesce(*[F.when(F.grouping(c) == 0, F.col(c).cast("string")) for c in columns])
    return (df.groupingSets([[c] for c in columns], *columns)
            .agg(F.lit(name).alias("module"), which.alias("attribute"), value.alias("value"), F.count(F.lit(1)).alias("records"))
            .select("module", "attribute", "value", "records"))


def module_profile(name: str, df: DataFrame, entity: str, amount: str, date_col: str) -> DataFrame:
    """QY-19: rows, distinct entities, amount total and date range of one module's output."""
    return df.agg(F.lit(name).alias("module"), F.count(F.lit(1)).alias("records"),
                  F.countDistinct(entity).alias("entities"), half_even(F.sum(amount), 2).alias("total_amount"),
                  F.min(date_col).alias("first_date"), F.max(date_col).alias("last_date"))
