"""Query catalogue: payment features from states that were merged load by load, equal to the full rebuild."""
from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from ledgerlake.config import DEFAULT as CFG
from ledgerlake.operators import features as fe
from ledgerlake.operators import incremental as inc
from ledgerlake.plans.jobs import store_root
from ledgerlake.plans.registry import pipe, reg


def merged_states(spark, d, side, docs):
    """History, a year and the last weeks as three loads; some old payments come late; the last load runs twice."""
    t = pipe(spark, d).t
    root = f"{store_root(spark, 'states')}/{uuid.uuid4().hex[:8]}"
    year, weeks = (F.lit(str(CFG.reference_date - dt.timedelta(n))).cast("date") for n in (365, 20))
    day, late = F.col("payment_date"), F.col("reference_id") % 11 == 0
    loads = [("1", (day < year) & ~late), ("2", ((day >= year) & (day < weeks)) | ((day < year) & late)), ("3", day >= weeks),
             ("3", day >= weeks)]
    for load, rows in loads:
        states = inc.add_load(spark, root, t[docs], t["payments"].filter(rows), load, side)
    before = str(CFG.reference_date - dt.timedelta(60))
    return inc.compact(states, before, side)


@reg("CF-2:incremental", "customer_id:i avg_payment_delay:d median_payment_delay:d late_payment_ratio:d payment_volatility:d "
     "avg_invoice_amount:d invoice_count:i days_since_last_payment:i payment_trend_30d:d total_paid:d", "cf_pay")
def q_customer_states(spark, d):
    return inc.customer_payment_stats(merged_states(spark, d, inc.AR, "invoices"), CFG).withColumnRenamed("_total_paid", "total_paid")


@reg("CF-10:incremental", "customer_id:i seasonality_index:d", "cf_season")
def q_seasonality_states(spark, d):
    per = inc.customer_payment_stats(merged_states(spark, d, inc.AR, "invoices"), CFG)
    return fe.recentre_seasonality(fe.seasonality_raw(per))


@reg("VF-2:incremental", "vendor_id:i avg_payment_cycle_days:d payment_volatility:d late_payment_ratio:d avg_invoice_amount:d "
     "invoice_count:i discount_capture_ratio:d vendor_chase_frequency:i last_payment_date total_paid:d", "vf_pay")
def q_vendor_states(spark, d):
    return inc.vendor_payment_stats(merged_states(spark, d, inc.AP, "bills")).withColumnRenamed("_total_paid", "total_paid")
