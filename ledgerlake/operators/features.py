"""Feature store: customer, payment-score, invoice, collections, vendor and bill features.

Plan shape (what to expect in ``explain``):
* every per-entity aggregate is ONE ``groupBy(entity)`` with conditional
  aggregates (aggregate fusion), partially aggregated map-side, so a hot
  customer/vendor costs no more than a cold one;
* aggregates keyed by the same column come out hash-partitioned on it, so the
  spine joins that assemble a feature table add no further exchange;
* global scalars (95th percentile, re-centring mean) are 1-row aggregates
  joined by broadcast (size exactly one row), never collected to the driver;
* per-group ranks use the skew-safe operator in ``ranking``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.config import DEFAULT, ESCALATION_LABEL, ESCALATION_RANK, SCORE_WEIGHTS, Settings
from ledgerlake.functions.columns import half_even, bool_ratio, clip, floor_days, lit_date, lookup, safe_ratio
from ledgerlake.session import cut_lineage
from ledgerlake.operators.quantiles import exact_quantile
from ledgerlake.operators.ranking import avg_rank_pct


def _ref(cfg):
    return lit_date(cfg.reference_date)


# ======================================================================= customer
def payments_of(t, kind: str) -> DataFrame:
    """The payments of one kind (AR, AP): staged inputs give them without the other kind, plain tables by a filter."""
    if hasattr(t, "payments_of"):
        return t.payments_of(kind)
    return t["payments"].filter(F.col("reference_type") == kind)


def ar_payments(payments: DataFrame) -> DataFrame:
    return payments.filter(F.col("reference_type") == "AR").select("reference_id", "payment_date", "payment_amount")


def invoice_payments(invoices: DataFrame, payments: DataFrame) -> DataFrame:
    """CF-1: invoices left-joined to their AR payments (one row per payment)."""
    ar = ar_payments(payments)
    j = invoices.join(ar, invoices["invoice_id"] == ar["reference_id"], "left").drop("reference_id")
    return (j.withColumn("days_to_pay", F.datediff("payment_date", "invoice_date"))
             .withColumn("days_late", F.datediff("payment_date", "due_date")))


def customer_payment_stats(inv_pay: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """CF-2, CF-7, CF-8 and the AR total for CF-12 in one fused aggregate over paid rows."""
    paid = inv_pay.filter(F.col("payment_date").isNotNull())
    recent = F.col("payment_date") >= F.date_sub(_ref(cfg), 30)
    return paid.groupBy("customer_id").agg(
        F.avg("days_late").alias("avg_payment_delay"),
        F.percentile(F.col("days_late"), 0.5).alias("median_payment_delay"),
        bool_ratio(F.col("days_late") > 0).alias("late_payment_ratio"),
        F.coalesce(F.stddev_samp("days_to_pay"), F.lit(0.0)).alias("payment_volatility"),
        F.avg("invoice_amount").alias("avg_invoice_amount"),
        F.countDistinct("invoice_id").alias("invoice_count"),
        F.datediff(_ref(cfg), F.max("payment_date")).alias("days_since_last_payment"),
        (F.avg(F.when(recent, F.col("days_to_pay"))) - F.avg("days_to_pay")).alias("payment_trend_30d"),
        F.sum("payment_amount").alias("_total_paid"),
        F.sum("days_to_pay").alias("_ts"), F.count("days_to_pay").alias("_tc"),
        *month_sums(),
    )


def customer_invoice_stats(invoices: DataFrame) -> DataFrame:
    """CF-3, CF-6, CF-9 over invoices (not fanned out by payments)."""
    open_amt = F.when(F.col("invoice_status").isin("OPEN", "PARTIAL", "DISPUTED"), F.col("invoice_amount"))
    g = invoices.groupBy("customer_id").agg(
        F.avg(F.col("dispute_flag").cast("double")).alias("dispute_ratio"),
        F.count_if(F.col("dispute_flag")).alias("_disputes"),
        F.sum(open_amt).alias("_outstanding"),
        F.sum("invoice_amount").alias("_revenue"),
    )
    dso = F.when(F.col("_outstanding").isNull(), F.lit(None).cast("double")).otherwise(
        safe_ratio(F.col("_outstanding"), F.col("_revenue") / 365))
    return g.select("customer_id", "dispute_ratio",
                    F.when(F.col("_disputes") > 0, F.col("_disputes")).alias("open_dispute_count"),
                    dso.alias("days_sales_outstanding"))


def ptp_kept(collections: DataFrame, payments: DataFrame) -> DataFrame:
    """CF-4: share of promises kept (payment on or before the promised date; unpaid = not kept)."""
    ar = ar_payments(payments).select("reference_id", "payment_date")
    ptp = collections.filter(F.col("event_type") == "PTP")
    j = ptp.join(ar, ptp["invoice_id"] == ar["reference_id"], "left")
    return j.groupBy("customer_id").agg(
        bool_ratio(F.col("payment_date") <= F.col("promise_to_pay_date")).alias("ptp_kept_ratio"))


def reminder_velocity(collections: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """CF-5: reminders since ref-14d (no upper bound)."""
    cutoff = F.date_sub(_ref(cfg), 14).cast("timestamp")
    return (collections.filter((F.col("event_type") == "REMINDER") & (F.col("event_date") >= cutoff))
            .groupBy("customer_id").agg(F.count(F.lit(1)).alias("recent_reminder_velocity")))


MONTHS = range(1, 13)


def month_sums() -> list:
    """Per calendar month (1-12): sum and count of days_to_pay, as aggregate columns (fixed width)."""
    m = F.month("payment_date")
    cols = []
    for k in MONTHS:
        cols += [F.sum(F.when(m == k, F.col("days_to_pay"))).alias(f"_ms{k}"),
                 F.count(F.when(m == k, F.col("days_to_pay"))).alias(f"_mc{k}")]
    return cols


def seasonality_raw(per: DataFrame) -> DataFrame:
    """Sample std over pay-months of (month mean / customer mean) from the 12 month sums (columns
    ``_ts``, ``_tc``, ``_ms1..12``, ``_mc1..12``); null when fewer than two months or a zero mean.
    Three small projections (ratios, mean, spread) keep each generated method small."""
    cust_avg = F.col("_ts") / F.col("_tc")
    r = per.select("customer_id", *[F.when((F.col(f"_mc{k}") > 0) & (cust_avg != 0),
                                           (F.col(f"_ms{k}") / F.col(f"_mc{k}")) / cust_avg).alias(f"_r{k}")
                                    for k in MONTHS])
    n = sum(F.when(F.col(f"_r{k}").isNotNull(), F.lit(1)).otherwise(F.lit(0)) for k in MONTHS)
    m = r.withColumn("_n", n).withColumn(
        "_mean", sum(F.coalesce(F.col(f"_r{k}"), F.lit(0.0)) for k in MONTHS) / F.col("_n"))
    ss = sum(F.when(F.col(f"_r{k}").isNotNull(), (F.col(f"_r{k}") - F.col("_mean")) * (F.col(f"_r{k}") - F.col("_mean")))
             .otherwise(F.lit(0.0)) for k in MONTHS)
    return m.select("customer_id", F.when(F.col("_n") >= 2, F.sqrt(ss / (F.col("_n") - 1))).alias("_raw"))


def seasonality(inv_pay: DataFrame) -> DataFrame:
    """CF-10: std over calendar pay-months of (month mean / customer mean), null -> 1.0,
    re-centred on the mean over customers, clipped to [0.5, 2.0].

    One groupBy(customer) with 12 month-sum/count columns (the month domain is fixed), no
    second shuffle by (customer, month)."""
    paid = inv_pay.filter(F.col("payment_date").isNotNull())
    per = paid.groupBy("customer_id").agg(F.sum("days_to_pay").alias("_ts"), F.count("days_to_pay").alias("_tc"),
                                          *month_sums())
    return recentre_seasonality(seasonality_raw(per))


def recentre_seasonality(per: DataFrame) -> DataFrame:
    per = per.select("customer_id", F.coalesce(F.col("_raw"), F.lit(1.0)).alias("_si"))
    mean = F.broadcast(per.agg(F.avg("_si").alias("_m")))        # exactly one row
    return per.crossJoin(mean).select(
        "customer_id", clip(F.lit(1.0) + (F.col("_si") - F.col("_m")), 0.5, 2.0).alias("seasonality_index"))


def non_invoice_stats(nip: DataFrame, party_type: str, key: str) -> DataFrame:
    """CF-11 / VF-7 inputs: count of non-invoice payments and ADVANCE amount per party."""
    return (nip.filter(F.col("party_type") == party_type).groupBy(F.col("party_id").alias(key)).agg(
        F.count(F.lit(1)).alias("non_invoice_payment_count"),
        F.sum(F.when(F.col("payment_type") == "ADVANCE", F.col("amount"))).alias("_advance")))


def customer_features(t: dict[str, DataFrame], cfg: Settings = DEFAULT) -> DataFrame:
    """CF-13: customers spine + all aggregates, defaults, version stamps (19 columns)."""
    ar = payments_of(t, "AR")
    inv_pay = invoice_payments(t["invoices"], ar)
    # CF-10 fused: the seasonality inputs come out of the same aggregate as CF-2/7/8, which is written once at
    # customer grain: its spread, the mean over customers and the assembly read it, not the invoice join
    pay = cut_lineage(customer_payment_stats(inv_pay, cfg), "customer_pay")
    season = recentre_seasonality(seasonality_raw(pay))
    pay = pay.drop("_ts", "_tc", *[f"_ms{k}" for k in MONTHS], *[f"_mc{k}" for k in MONTHS])
    nip = non_invoice_stats(t["non_invoice_payments"], "CUSTOMER", "customer_id")
    cf = (t["customers"].select("customer_id")
          .join(pay, "customer_id", "left")
          .join(customer_invoice_stats(t["invoices"]), "customer_id", "left")
          .join(ptp_kept(t["collections_events"], ar), "customer_id", "left")
          .join(reminder_velocity(t["collections_events"], cfg), "customer_id", "left")
          .join(season, "customer_id", "left")
          .join(nip, "customer_id", "left"))
    # CF-12: advance ratio exists only for parties with ADVANCE payments
    adv = F.when(F.col("_advance").isNotNull(),
                 safe_ratio(F.col("_advance"), F.coalesce(F.col("_total_paid"), F.lit(0.0))))
    cf = cf.withColumn("advance_payment_ratio", adv)
    d0 = lambda c, v=0.0: F.coalesce(F.col(c).cast("double"), F.lit(v)).alias(c)
    l0 = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c)
    return cf.select(
        "customer_id",
        d0("avg_payment_delay"), d0("median_payment_delay"), d0("late_payment_ratio"), d0("payment_volatility"),
        d0("dispute_ratio"), d0("ptp_kept_ratio"), l0("recent_reminder_velocity"), l0("open_dispute_count"),
        l0("days_since_last_payment"), d0("payment_trend_30d"), d0("days_sales_outstanding"),
        d0("seasonality_index", 1.0), d0("avg_invoice_amount"), l0("invoice_count"),
        l0("non_invoice_payment_count"), d0("advance_payment_ratio"),
        F.lit(str(cfg.reference_date)).alias("feature_date"),
        F.lit(cfg.feature_version).alias("feature_version"),
    )


def customer_delays(t: dict[str, DataFrame]) -> DataFrame:
    """(customer_id, avg_payment_delay) exactly as in customer_features (customers without paid
    invoices get 0), computed from the AR join alone -- for consumers that need only the delay."""
    paid = invoice_payments(t["invoices"], payments_of(t, "AR")).filter(F.col("payment_date").isNotNull())
    d = paid.groupBy("customer_id").agg(F.avg("days_late").alias("avg_payment_delay"))
    return (t["customers"].select("customer_id").join(d, "customer_id", "left")
            .select("customer_id", F.coalesce(F.col("avg_payment_delay").cast("double"), F.lit(0.0))
                    .alias("avg_payment_delay")))


# ======================================================================= scores
def payment_scores(cf: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """PS-1..PS-3: composite score, risk segment, expected delay."""
    q95 = exact_quantile(cf, "payment_volatility", 0.95, out="_q")
    vol_q = F.greatest(F.col("_q"), F.lit(1.0))
    late = F.lit(1.0) - clip(F.col("late_payment_ratio"), 0, 1)
    vol = F.lit(1.0) - clip(F.col("payment_volatility") / vol_q, 0, 1)
    disp = F.lit(1.0) - clip(F.col("dispute_ratio"), 0, 1)
    ptp = clip(F.col("ptp_kept_ratio"), 0, 1)
    trend = F.lit(1.0) - (clip(F.col("payment_trend_30d"), -30, 30) + 30) / 60
    w = SCORE_WEIGHTS
    score = half_even(w["late"] * late + w["volatility"] * vol + w["dispute"] * disp + w["ptp"] * ptp
                     + w["trend"] * trend, 3)
    s = cf.crossJoin(F.broadcast(q95)).withColumn("payment_score", score)   # q95 is one row
    seg = (F.when((F.col("payment_score") > -0.01) & (F.col("payment_score") <= 0.4), "HIGH")
           .when((F.col("payment_score") > 0.4) & (F.col("payment_score") <= 0.7), "MEDIUM")
           .when((F.col("payment_score") > 0.7) & (F.col("payment_score") <= 1.01), "LOW"))
    return s.select(
        "customer_id", "payment_score",
        half_even(F.col("avg_payment_delay"), 2).alias("expected_delay"),
        seg.alias("risk_segment"),
        F.lit(str(cfg.reference_date)).alias("score_date"),
        F.lit(cfg.score_model_version).alias("model_version"),
    )


# ======================================================================= invoice
def invoice_features(t: dict[str, DataFrame], cfg: Settings = DEFAULT) -> DataFrame:
    """IF-1..IF-6."""
    ref = _ref(cfg)
    inv = avg_rank_pct(t["invoices"], "customer_id", "invoice_amount", out="_pct", mean_out="_mean")
    amt = F.col("invoice_amount")
    bucket = (F.when(amt <= F.col("_mean") * 0.5, "SMALL").when(amt <= F.col("_mean") * 1.5, "MEDIUM")
              .otherwise("LARGE"))
    terms = t["customers"].select("customer_id", F.col("credit_terms").alias("payment_terms"))
    partial = (ar_payments(payments_of(t, "AR")).groupBy("reference_id")
               .agg(F.sum("payment_amount").alias("_paid")))
    out = (inv.join(terms, "customer_id", "left")
           .join(partial, inv["invoice_id"] == partial["reference_id"], "left"))
    paid_amt = F.coalesce(F.col("_paid"), F.lit(0.0))
    return out.select(
        "invoice_id", "customer_id", "invoice_date", "due_date", "invoice_amount",
        F.datediff(ref, "invoice_date").alias("invoice_age_days"),
        clip(F.datediff(ref, "due_date"), lo=0).alias("days_past_due"),
        bucket.alias("invoice_amount_bucket"),
        half_even(F.col("_pct"), 3).alias("amount_percentile_customer"),
        "payment_terms", "dispute_flag",
        (paid_amt > 0).alias("partial_payment_flag"),
        paid_amt.alias("partial_payment_amount"),
        F.lit(str(cfg.reference_date)).alias("feature_date"),
    )


# ======================================================================= collections
def collections_features(t: dict[str, DataFrame], cf: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """CO-1..CO-5: one fused groupBy(invoice_id) over the event log."""
    ev = t["collections_events"]
    et = F.col("event_type")
    esc_rank = F.coalesce(lookup(et, ESCALATION_RANK), F.lit(0))
    per_inv = ev.groupBy("invoice_id").agg(
        F.count_if(et == "REMINDER").alias("reminder_count"),
        F.count_if(et == "CALL").alias("call_count"),
        F.count_if(et == "PTP").alias("_ptp"),
        F.max(F.when(et == "PTP", F.col("promise_to_pay_date"))).alias("promise_to_pay_date"),
        F.max("event_date").alias("_last"),
        F.max(esc_rank).alias("_esc"),
    )
    spine = t["invoices"].select("invoice_id", "customer_id").dropDuplicates(["invoice_id"])
    out = (spine.join(per_inv, "invoice_id", "left")
           .join(cf.select("customer_id", F.col("ptp_kept_ratio").alias("_pk")), "customer_id", "left"))
    return out.select(
        "invoice_id",
        F.coalesce(F.col("reminder_count"), F.lit(0)).cast("int").alias("reminder_count"),
        F.coalesce(F.col("call_count"), F.lit(0)).cast("int").alias("call_count"),
        F.coalesce(F.col("_ptp") > 0, F.lit(False)).alias("promise_to_pay_flag"),
        "promise_to_pay_date",
        F.coalesce(floor_days(lit_date(cfg.reference_date), F.col("_last")), F.lit(-1)).cast("int")
        .alias("days_since_last_contact"),
        F.coalesce(lookup(F.col("_esc"), ESCALATION_LABEL), F.lit("NONE")).alias("escalation_status"),
        F.coalesce(F.col("_pk"), F.lit(0.0)).alias("ptp_kept_ratio_customer"),
    )


# ======================================================================= vendor
def bill_payments(bills: DataFrame, payments: DataFrame) -> DataFrame:
    """VF-1."""
    ap = payments.filter(F.col("reference_type") == "AP").select("reference_id", "payment_date", "payment_amount")
    j = bills.join(ap, bills["bill_id"] == ap["reference_id"], "left").drop("reference_id")
    return (j.withColumn("payment_cycle_days", F.datediff("payment_date", "bill_date"))
             .withColumn("days_late", F.datediff("payment_date", "due_date")))


def vendor_payment_stats(bill_pay: DataFrame) -> DataFrame:
    """VF-2..VF-5 fused."""
    paid = bill_pay.filter(F.col("payment_date").isNotNull())
    return paid.groupBy("vendor_id").agg(
        F.avg("payment_cycle_days").alias("avg_payment_cycle_days"),
        F.coalesce(F.stddev_samp("payment_cycle_days"), F.lit(0.0)).alias("payment_volatility"),
        bool_ratio(F.col("days_late") > 0).alias("late_payment_ratio"),
        F.avg("bill_amount").alias("avg_invoice_amount"),
        F.countDistinct("bill_id").alias("invoice_count"),
        bool_ratio(F.col("days_late") < 0).alias("discount_capture_ratio"),
        # distinct pay months as a set, which the calendar bounds: one distinct aggregate only, so no Expand
        half_even(F.count(F.lit(1)) / F.size(F.collect_set(F.year("payment_date") * 12 + F.month("payment_date"))), 0)
        .cast("long").alias("vendor_chase_frequency"),
        F.max("payment_date").alias("last_payment_date"),
        F.sum("payment_amount").alias("_total_paid"),
    )


def po_to_bill_lag(pos: DataFrame, bills: DataFrame) -> DataFrame:
    """VF-6: mean of (bill_date - po_date) over all same-vendor (PO, bill) pairs with a positive lag.

    Linear rewrite of the many-to-many join: pre-aggregate POs and bills per
    (vendor, date) -- the date domain per vendor is bounded by the calendar,
    not by the row count -- then a running count/sum of PO dates strictly
    before each bill date gives, per bill date d with b bills,
    pairs = b * n_before and lag_sum = b * (n_before * d - sum_before)."""
    po = pos.groupBy("vendor_id", F.unix_date("po_date").alias("_d")).agg(
        F.count(F.lit(1)).alias("_np"), F.lit(0).cast("long").alias("_nb"))
    bl = bills.groupBy("vendor_id", F.unix_date("bill_date").alias("_d")).agg(
        F.lit(0).cast("long").alias("_np"), F.count(F.lit(1)).alias("_nb"))
    u = po.unionByName(bl).groupBy("vendor_id", "_d").agg(F.sum("_np").alias("_np"), F.sum("_nb").alias("_nb"))
    w = Window.partitionBy("vendor_id").orderBy("_d").rangeBetween(Window.unboundedPreceding, -1)
    u = (u.withColumn("_cnt", F.coalesce(F.sum("_np").over(w), F.lit(0)))
          .withColumn("_sum", F.coalesce(F.sum(F.col("_np") * F.col("_d")).over(w), F.lit(0))))
    agg = u.filter(F.col("_nb") > 0).groupBy("vendor_id").agg(
        F.sum(F.col("_nb") * F.col("_cnt")).alias("_pairs"),
        F.sum(F.col("_nb") * (F.col("_cnt") * F.col("_d") - F.col("_sum"))).alias("_lag"))
    return agg.filter(F.col("_pairs") > 0).select(
        "vendor_id", (F.col("_lag").cast("double") / F.col("_pairs")).alias("po_to_bill_lag"))


def vendor_features(t: dict[str, DataFrame], cfg: Settings = DEFAULT) -> DataFrame:
    """VF-8: vendors spine + aggregates (13 columns)."""
    stats = vendor_payment_stats(bill_payments(t["bills"], payments_of(t, "AP")))
    nip = non_invoice_stats(t["non_invoice_payments"], "VENDOR", "vendor_id").select("vendor_id", "_advance")
    vf = (t["vendors"].select("vendor_id")
          .join(stats, "vendor_id", "left")
          .join(po_to_bill_lag(t["purchase_orders"], t["bills"]), "vendor_id", "left")
          .join(nip, "vendor_id", "left"))
    adv = F.when(F.col("_advance").isNotNull(),
                 safe_ratio(F.col("_advance"), F.coalesce(F.col("_total_paid"), F.lit(0.0))))
    d0 = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    return vf.select(
        "vendor_id", d0("avg_payment_cycle_days"), d0("payment_volatility"), d0("late_payment_ratio"),
        d0("avg_invoice_amount"),
        F.coalesce(F.col("invoice_count"), F.lit(0)).cast("long").alias("invoice_count"),
        d0("discount_capture_ratio"),
        F.coalesce(F.col("vendor_chase_frequency"), F.lit(0)).cast("long").alias("vendor_chase_frequency"),
        "last_payment_date", d0("po_to_bill_lag"),
        F.coalesce(adv, F.lit(0.0)).alias("advance_payment_ratio"),
        F.lit(str(cfg.reference_date)).alias("feature_date"),
        F.lit(cfg.feature_version).alias("feature_version"),
    )


# ======================================================================= bill
def bill_features(t: dict[str, DataFrame], cfg: Settings = DEFAULT) -> DataFrame:
    """BF-1..BF-5."""
    ref = _ref(cfg)
    b = avg_rank_pct(t["bills"], "vendor_id", "bill_amount", out="_pct", mean_out="_mean")
    amt = F.col("bill_amount")
    bucket = (F.when(amt <= F.col("_mean") * 0.5, "SMALL").when(amt <= F.col("_mean") * 1.5, "MEDIUM")
              .otherwise("LARGE"))
    dpd = clip(F.datediff(ref, "due_date"), lo=0)
    to_due = F.datediff("due_date", ref)
    return b.select(
        "bill_id", "vendor_id",
        F.datediff(ref, "bill_date").alias("bill_age_days"),
        dpd.alias("days_past_due"),
        "bill_amount",
        bucket.alias("bill_amount_bucket"),
        half_even(F.col("_pct"), 3).alias("amount_percentile_vendor"),
        F.when(F.col("bill_status").isin("PAID", "DEFERRED"), "APPROVED").otherwise("PENDING").alias("approval_status"),
        F.coalesce((to_due > 0) & (to_due <= 10), F.lit(False)).alias("early_payment_eligible"),
        F.coalesce((dpd > 0) & F.col("bill_status").isin("OPEN", "APPROVED"), F.lit(False)).alias("penalty_accruing"),
        F.lit(str(cfg.reference_date)).alias("feature_date"),
    )
