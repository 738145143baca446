"""Query catalogue: windows answered from stored daily sketches, each next to the exact answer."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ledgerlake.config import DEFAULT as CFG
from ledgerlake.operators import predictions as pp
from ledgerlake.operators import sketches as sk
from ledgerlake.plans.registry import pipe, reg
from ledgerlake.session import cut_lineage

REF = CFG.reference_date
TRAILING = {n: (str(REF - dt.timedelta(n)), str(REF)) for n in (365, 1460, 2920)} | {0: (None, None)}
HORIZONS = {n: (None, str(REF + dt.timedelta(n))) for n in (0, 90, 180)}
PS = [0.5, 0.9, 0.95]
COLS = "span:i p:d n:i exact:d sketch_holds"

_WINDOW = " OR ".join(f"(w = {n} AND {{day}} BETWEEN DATE '{b[0]}' AND DATE '{b[1]}')" if b[0] else f"w = {n}"
                      for n, b in TRAILING.items())


def _quantile_sql(table, day, value):
    return f"""
SELECT w AS span, p, count(*) AS n, CASE p {' '.join(f"WHEN {p} THEN quantile_cont(x, {p})" for p in PS)} END AS exact, TRUE AS sketch_holds
FROM (SELECT w, p, CAST({value} AS DOUBLE) AS x FROM {table}, unnest([{', '.join(map(str, TRAILING))}]) q(w),
             unnest([{', '.join(f'{p}::DOUBLE' for p in PS)}]) r(p)
      WHERE {day} IS NOT NULL AND {value} IS NOT NULL AND ({_WINDOW.format(day=day)}))
GROUP BY w, p"""


def _both_ways(df, day, value):
    daily = cut_lineage(sk.daily_quantiles(df, day, value), "daily_quantiles")
    ranks = cut_lineage(sk.window_value_ranks(df, day, value, TRAILING), "window_value_ranks")
    got = sk.measured_rank_error(sk.window_quantiles(daily, TRAILING, PS), ranks)
    exact = sk.exact_window_quantiles(ranks, PS)
    # the stated error holds with 99 % confidence, twice the error practically always
    holds = F.coalesce(F.col("rank_error") <= 2 * sk.rank_error(), F.lit(False))
    return got.join(exact, ["span", "p"]).withColumn("sketch_holds", holds)


@reg("TS-17:sketch", COLS, _quantile_sql("ar_labelled", "invoice_date", "days_to_pay"))
def q_target_sketch(spark, d):
    """Days to pay over trailing windows: merged daily sketches against the exact quantiles."""
    return _both_ways(pipe(spark, d).ar_labelled, "invoice_date", "days_to_pay")


@reg("ME-1:sketch", COLS, _quantile_sql("(SELECT invoice_date, abs(days_to_pay - pred_primary) AS e FROM ar_scored)",
                                        "invoice_date", "e"))
def q_error_sketch(spark, d):
    """Absolute errors of the S1 predictions by invoice day."""
    s = pipe(spark, d).ar_scored
    return _both_ways(s.withColumn("e", F.abs(F.col("days_to_pay") - F.col("pred_primary"))), "invoice_date", "e")


@reg("ME-4:sketch", COLS, _quantile_sql("(SELECT bill_date, abs(pred_primary - pred_baseline) AS e FROM ap_scored)",
                                        "bill_date", "e"))
def q_divergence_sketch(spark, d):
    """Divergence of the S2 models by bill day."""
    s = pipe(spark, d).ap_scored
    return _both_ways(s.withColumn("e", F.abs(F.col("pred_primary") - F.col("pred_baseline"))), "bill_date", "e")


@reg("PS-1:sketch", COLS, _quantile_sql("(SELECT invoice_date, invoice_amount FROM invoices)", "invoice_date", "invoice_amount"))
def q_amount_sketch(spark, d):
    """Invoice amounts (few ties) over trailing windows."""
    return _both_ways(pipe(spark, d).t["invoices"], "invoice_date", "invoice_amount")


def _module_customers(p):
    """(module, customer_id, day): customers with cash expected from invoices, milestones and deals."""
    days = pp.predicted_dates(p.ar_scored).select(F.lit("S1").alias("module"), "customer_id", F.col("predicted_payment_date").alias("day"))
    for m, df in (("S3", p.s3_detail), ("S4", p.s4_detail)):
        days = days.unionByName(df.select(F.lit(m).alias("module"), "customer_id", F.col("expected_cash_date").alias("day")))
    return days


_SETS = f"""
WITH_ROWS AS (SELECT w AS span, c AS customer_id, max(m = 'S1') AS s1, max(m = 'S3') AS s3, max(m = 'S4') AS s4
  FROM (SELECT 'S1' AS m, a.customer_id AS c, s.predicted_payment_date AS d FROM s1_predictions s
          JOIN ar_labelled a ON a.invoice_id = s.transaction_id
        UNION ALL SELECT 'S3', customer_id, expected_cash_date FROM s3_detail
        UNION ALL SELECT 'S4', customer_id, expected_cash_date FROM s4_detail), unnest([0, 90, 180]) q(w)
  WHERE c IS NOT NULL AND d <= DATE '{REF}' + CAST(w AS INTEGER) GROUP BY 1, 2)"""


def _pair(a, b):
    return f"""SELECT span, '{a}' AS left_key, '{b}' AS right_key, count(*) FILTER ({a} AND {b}) AS shared,
 count(*) FILTER ({a} AND NOT {b}) AS only_left, count(*) FILTER (NOT {a} AND {b}) AS only_right,
 count(*) FILTER ({a} OR {b}) AS either, TRUE AS sketch_holds FROM WITH_ROWS GROUP BY span
 HAVING bool_or({a}) AND bool_or({b})"""


@reg("QY-9:customer_sets", "span:i left_key right_key shared:i only_left:i only_right:i either:i sketch_holds",
     "SELECT span, upper(left_key) AS left_key, upper(right_key) AS right_key, shared, only_left, only_right, either, sketch_holds FROM ("
     + "WITH " + _SETS.strip() + " " + " UNION ALL ".join(_pair(a, b) for a, b in (("s1", "s3"), ("s1", "s4"), ("s3", "s4"))) + ") z")
def q_customer_sets(spark, d):
    """Customers that two forecast modules share, or that only one has, by horizon."""
    rows = cut_lineage(_module_customers(pipe(spark, d)), "module_customers")
    daily = cut_lineage(sk.daily_entities(rows, ["module"], "day", "customer_id"), "daily_entities")
    est = sk.sketch_set_counts(sk.window_entities(daily, "module", HORIZONS), "module")
    exact = sk.exact_set_counts(rows, "module", "day", "customer_id", ["S1", "S3", "S4"], HORIZONS)
    names = ("shared", "only_left", "only_right", "either")
    j = exact.join(est.select("span", "left_key", "right_key", *[F.col(n).alias(f"_{n}") for n in names]),
                   ["span", "left_key", "right_key"], "left")
    holds = [sk.set_counts_hold(F.col(n), F.col(f"_{n}"), F.col("either")) for n in names]
    return j.withColumn("sketch_holds", F.coalesce(holds[0] & holds[1] & holds[2] & holds[3], F.lit(False)))
