"""Training-set assembly: targets, joins, encodings, splits, class weights."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.config import DEFAULT, DEFAULT_TERMS_DAYS, TERMS_DAYS, Settings
from ledgerlake.functions.columns import lookup


def first_payment(payments: DataFrame, ref_type: str) -> DataFrame:
    """TS-6: earliest payment date per document (map-side partial min, skew-safe)."""
    return (payments.filter(F.col("reference_type") == ref_type)
            .groupBy("reference_id").agg(F.min("payment_date").alias("first_payment_date")))


def terms_days(col: str) -> F.Column:
    """TS-2: NET15..NET90 to days, anything else 30."""
    return F.coalesce(lookup(col, TERMS_DAYS), F.lit(DEFAULT_TERMS_DAYS))


def ar_target(docs: DataFrame, payments: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """TS-7: days_to_pay = first AR payment - invoice date; unpaid dropped; kept in [0, 365]."""
    lo, hi = cfg.s1_target_range
    fp = first_payment(payments, "AR")
    return (docs.join(fp, docs["invoice_id"] == fp["reference_id"], "inner").drop("reference_id")
            .withColumn("days_to_pay", F.datediff("first_payment_date", "invoice_date"))
            .filter(F.col("days_to_pay").between(lo, hi)))


def ap_target(docs: DataFrame, payments: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """TS-8: adjustment_delta = (first AP payment - bill date) - terms days; kept in [-60, 60]."""
    lo, hi = cfg.s2_target_range
    fp = first_payment(payments, "AP")
    return (docs.join(fp, docs["bill_id"] == fp["reference_id"], "inner").drop("reference_id")
            .withColumn("actual_payment_days", F.datediff("first_payment_date", "bill_date"))
            .withColumn("adjustment_delta", F.col("actual_payment_days") - F.col("payment_terms_days"))
            .filter(F.col("adjustment_delta").between(lo, hi)))


def ap_documents(bills: DataFrame, vendors: DataFrame) -> DataFrame:
    """Bills with the vendor's payment-terms days (the S2 metadata)."""
    v = vendors.select("vendor_id", terms_days("payment_terms").alias("payment_terms_days"))
    return (bills.join(v, "vendor_id", "left")
            .withColumn("payment_terms_days", F.coalesce(F.col("payment_terms_days"), F.lit(DEFAULT_TERMS_DAYS))))


# ----------------------------------------------------------------------------- joins
def s1_training_frame(invoice_features: DataFrame, customer_features: DataFrame, collections_features: DataFrame,
                      scores: DataFrame, customer_cols: list[str] | None = None) -> DataFrame:
    """TS-1..TS-3: invoice_features + customer behaviour + collections + scores, terms days, days to PTP."""
    cf = customer_features.select("customer_id", *(customer_cols or [c for c in customer_features.columns
                                                                     if c not in ("customer_id", "feature_date",
                                                                                  "feature_version")]))
    sc = scores.select("customer_id", "payment_score", "expected_delay", "risk_segment")
    # invoices meet their collections while rows are narrow, and the customer's columns in one join; a key on one side
    # only stays (full), so repeated keys multiply as in two left joins
    customer = cf.join(sc, "customer_id", "full")
    col = [c for f in (invoice_features, cf, collections_features, sc) for c in f.columns]
    df = (invoice_features.join(collections_features, "invoice_id", "left").join(customer, "customer_id", "left")
          .select(*dict.fromkeys(["invoice_id", "customer_id", *col])))
    return (df.withColumn("payment_terms_days", terms_days("payment_terms"))
              .withColumn("days_until_ptp", F.coalesce(F.datediff("promise_to_pay_date", F.to_date("feature_date")),
                                                       F.lit(-1))))


def s2_training_frame(bill_features: DataFrame, vendor_features: DataFrame, vendors: DataFrame,
                      bills: DataFrame) -> DataFrame:
    """TS-4: bill_features + vendor behaviour + vendor terms + bill dates/status."""
    vf = vendor_features.drop("feature_date", "feature_version", "last_payment_date")
    v = vendors.select("vendor_id", terms_days("payment_terms").alias("payment_terms_days"))
    b = bills.select("bill_id", "bill_date", "due_date", "bill_status")
    return (bill_features.join(vf, "vendor_id", "left").join(v, "vendor_id", "left")
            .withColumn("payment_terms_days", F.coalesce(F.col("payment_terms_days"), F.lit(DEFAULT_TERMS_DAYS)))
            .join(b, "bill_id", "left"))


def risk_training_frame(customer_features: DataFrame, scores: DataFrame) -> DataFrame:
    """TS-5 + TS-9: customer features with the score's risk segment (inner), encoded LOW 0 / MEDIUM 1 / HIGH 2."""
    from ledgerlake.config import RISK_CLASS
    j = customer_features.join(scores.select("customer_id", "risk_segment"), "customer_id", "inner")
    return j.filter(F.col("risk_segment").isNotNull()).withColumn("target", lookup("risk_segment", RISK_CLASS))


# ----------------------------------------------------------------------------- encodings
def ordinal_encode(df: DataFrame, mapping: dict[str, dict], unknown: str = "middle") -> DataFrame:
    """TS-10: config ordinal maps; unknown -> the middle value of the mapping (batch) or 0."""
    for col, m in mapping.items():
        if col not in df.columns:
            continue
        vals = list(m.values())
        default = vals[len(vals) // 2] if unknown == "middle" else 0
        df = df.withColumn(f"{col}_enc", F.coalesce(lookup(col, m), F.lit(default)))
    return df


def bools_to_int(df: DataFrame, cols: list[str]) -> DataFrame:
    """TS-11."""
    for c in cols:
        if c in df.columns:
            df = df.withColumn(c, F.col(c).cast("int"))
    return df


def select_features(df: DataFrame, features: list[str], keep: list[str] = ()) -> DataFrame:
    """TS-12: keep configured features that exist, nulls -> 0."""
    avail = [c for c in features if c in df.columns]
    return df.select(*keep, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in avail])


# ----------------------------------------------------------------------------- splits
def time_split(df: DataFrame, order_cols: list[str], test_size: float = 0.2, partitions: int | None = None) -> DataFrame:
    """TS-13: first floor(n * (1 - test_size)) rows in (date, id) order are train.

    Positions and n come from the range-partitioned ``global_position`` operator (no
    single-partition window over rows, and the input is evaluated once)."""
    from ledgerlake.operators.ranking import global_position
    pos = global_position(df, order_cols, partitions, count_out="_n")
    cut = F.floor(F.col("_n") * F.lit(1.0 - test_size))
    return pos.withColumn("is_train", F.col("_pos") < cut).drop("_n")


def hashed_order(id_col: str, seed: int = 42) -> F.Column:
    """Repeatable pseudo-random order key (sha-256 of id|seed): same in any engine, unlike ``rand``."""
    return F.sha2(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed))), 256)


def random_split(df: DataFrame, id_col: str, test_size: float = 0.2, seed: int = 42,
                 partitions: int | None = None) -> DataFrame:
    """TS-14: shuffle by a repeatable hash, then the first floor(n*(1-test)) are train."""
    return time_split(df.withColumn("_h", hashed_order(id_col, seed)), ["_h", id_col], test_size, partitions).drop("_h")


def sequential_split(df: DataFrame, id_col: str, test_size: float = 0.2, partitions: int | None = None) -> DataFrame:
    """TS-16: no sort key given: order by the document id."""
    return time_split(df, [id_col], test_size, partitions)


def stratified_split(df: DataFrame, label: str, id_col: str, test_size: float = 0.2, seed: int = 42,
                     partitions: int | None = None) -> DataFrame:
    """TS-15: per class, the first ceil(n_c * test_size) rows in hash order are test.

    Per-class positions use the skew-safe ``group_value_ranks`` (a class may hold
    most rows), not ``row_number`` over a class partition."""
    from ledgerlake.operators.ranking import group_value_ranks
    h = df.withColumn("_h", hashed_order(id_col, seed))
    r = group_value_ranks(h, label, "_h", partitions).select(label, "_h", "_less", "_n")
    out = h.join(r, [label, "_h"], "left")
    return out.withColumn("is_train", F.col("_less") >= F.ceil(F.col("_n") * F.lit(test_size))) \
              .drop("_h", "_less", "_n")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """ML-5: balanced weight n / (k * n_c) per row, from a per-class count (<= k rows, broadcast)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    tot = counts.agg(F.sum("_nc").alias("_n"), F.count(F.lit(1)).alias("_k"))
    w = counts.crossJoin(tot).select(label, (F.col("_n") / (F.col("_k") * F.col("_nc"))).alias("class_weight"))
    return df.join(F.broadcast(w), label, "left")


def target_summary(df: DataFrame, target: str) -> DataFrame:
    """TS-17 (regression): count, mean, median, sample std of the target."""
    from ledgerlake.operators.quantiles import exact_quantile
    base = df.agg(F.count(F.lit(1)).alias("n"), F.avg(target).alias("mean"), F.stddev_samp(target).alias("std"))
    return base.crossJoin(exact_quantile(df, target, 0.5, out="median"))


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """TS-17 (classification): count and percentage per class."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    tot = F.broadcast(c.agg(F.sum("count").alias("_t")))
    return c.crossJoin(tot).select(label, "count", (F.col("count") * 100.0 / F.col("_t")).alias("pct"))
