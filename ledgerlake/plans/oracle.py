"""DuckDB oracle SQL.

Independent ANSI-SQL formulations of every registered query, run by the
verification driver against the same Parquet files.  Shared building blocks
are named CTEs; ``compose(select, deps)`` emits ``WITH`` + the transitive
closure of the needed blocks in definition order + the final SELECT.
"""
from __future__ import annotations

import re

REF = "DATE '2001-08-02'"
HORIZON_END = "DATE '2002-01-29'"
WIP_END = "DATE '2001-10-31'"

_BLOCKS: dict[str, str] = {}
_ORDER: list[str] = []


def block(name: str, sql: str) -> None:
    _BLOCKS[name] = sql
    if name not in _ORDER:
        _ORDER.append(name)


def _deps(sql: str) -> set[str]:
    words = set(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", sql))
    return {w for w in words if w in _BLOCKS}


def compose(select: str) -> str:
    need: set[str] = set()
    stack = list(_deps(select))
    while stack:
        n = stack.pop()
        if n in need:
            continue
        need.add(n)
        stack.extend(d for d in _deps(_BLOCKS[n]) if d != n)
    ordered = [n for n in _ORDER if n in need]
    if not ordered:
        return select
    return "WITH " + ",\n".join(f"{n} AS ({_BLOCKS[n]})" for n in ordered) + "\n" + select


def _case(expr: str, values) -> str:
    whens = " ".join(f"WHEN {expr} = {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {whens} END"


TERMS = ("NET15", "NET30", "NET45", "NET60", "NET90", "COD")


def _days(k: str) -> str:
    return f"CASE {k} % 6 WHEN 0 THEN 15 WHEN 1 THEN 30 WHEN 2 THEN 45 WHEN 3 THEN 60 WHEN 4 THEN 90 ELSE 30 END"


# ---------------------------------------------------------------------------
# fixture mapping (driver tables -> finance inputs)
# ---------------------------------------------------------------------------
block("scal", "SELECT (SELECT count(*) FROM customer) AS n_cust, (SELECT count(*) FROM supplier) AS n_supp")
block("customers", f"""
SELECT c_custkey AS customer_id, c_name AS customer_name, c_mktsegment AS industry,
       {_case('c_custkey % 6', TERMS)} AS credit_terms
FROM customer""")
block("invoices", f"""
SELECT o_orderkey AS invoice_id, o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS invoice_date,
       CAST(o_orderdate AS DATE) + CAST({_days('o_custkey')} AS INTEGER) AS due_date,
       o_totalprice AS invoice_amount, (o_orderkey % 13 = 0) AS dispute_flag,
       CASE WHEN o_orderkey % 13 = 0 AND o_orderstatus <> 'F' THEN 'DISPUTED'
            WHEN o_orderstatus = 'O' THEN 'OPEN' WHEN o_orderstatus = 'P' THEN 'PARTIAL'
            WHEN o_orderstatus = 'F' THEN 'PAID' END AS invoice_status
FROM orders""")
block("vendors", f"""
SELECT s_suppkey AS vendor_id, s_name AS vendor_name, {_case('s_suppkey % 6', TERMS)} AS payment_terms
FROM supplier""")
block("bills", f"""
SELECT l_orderkey * 100000 + l_suppkey AS bill_id, l_suppkey AS vendor_id,
       CAST(min(l_shipdate) AS DATE) AS bill_date,
       CAST(min(l_shipdate) AS DATE) + CAST({_days('l_suppkey')} AS INTEGER) AS due_date,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS bill_amount,
       {_case('(l_orderkey + l_suppkey) % 5', ('OPEN', 'APPROVED', 'DEFERRED', 'PAID', 'PAID'))} AS bill_status
FROM lineitem GROUP BY l_orderkey, l_suppkey""")
block("payments", """
SELECT 'AR-' || CAST(invoice_id AS VARCHAR) || '-1' AS payment_id, 'AR' AS reference_type, invoice_id AS reference_id,
       invoice_date + CAST(5 + (invoice_id * 37 + customer_id * 11) % (20 + (customer_id % 7) * 15) AS INTEGER) AS payment_date,
       CASE WHEN invoice_status = 'PARTIAL' THEN invoice_amount * 0.5 ELSE invoice_amount END AS payment_amount
FROM invoices WHERE invoice_status IN ('PAID', 'PARTIAL')
UNION ALL
SELECT 'AR-' || CAST(invoice_id AS VARCHAR) || '-2', 'AR', invoice_id,
       invoice_date + CAST(35 + (invoice_id * 17) % 60 AS INTEGER), invoice_amount * 0.25
FROM invoices WHERE invoice_status = 'PARTIAL' AND invoice_id % 2 = 0
UNION ALL
SELECT 'AP-' || CAST(bill_id AS VARCHAR), 'AP', bill_id,
       bill_date + CAST(10 + (bill_id * 29) % (20 + (vendor_id % 5) * 25) AS INTEGER), bill_amount
FROM bills WHERE bill_status IN ('PAID', 'DEFERRED')""")
block("collections_events", """
SELECT e.event_id, o.o_orderkey AS invoice_id, o.o_custkey AS customer_id,
       CASE e.event_type WHEN 'click' THEN 'REMINDER' WHEN 'view' THEN 'CALL' WHEN 'signup' THEN 'PTP'
            WHEN 'error' THEN 'DISPUTE'
            WHEN 'purchase' THEN CASE WHEN e.value > 100 THEN 'ESCALATION' WHEN e.value > 50 THEN 'INVOICE_VIEWED'
                                      ELSE 'PARTIAL_PAYMENT' END END AS event_type,
       e.ts - INTERVAL '8219' DAY AS event_date,
       CASE WHEN e.event_type = 'signup' THEN CAST(o.o_orderdate AS DATE) + CAST(10 + e.event_id % 80 AS INTEGER) END
         AS promise_to_pay_date
FROM events e JOIN orders o ON floor(e.event_id / 4) = o.o_orderkey""")
block("non_invoice_payments", f"""
SELECT event_id AS payment_id,
       CASE WHEN event_id % 2 = 0 THEN event_id % n_cust ELSE event_id % n_supp END AS party_id,
       CASE WHEN event_id % 2 = 0 THEN 'CUSTOMER' ELSE 'VENDOR' END AS party_type,
       {_case('event_id % 3', ('ADVANCE', 'RETAINER', 'REFUND'))} AS payment_type,
       CASE WHEN event_id % 5 = 0 THEN 'OUTFLOW' ELSE 'INFLOW' END AS direction,
       value * 100 AS amount, CAST(ts - INTERVAL '8219' DAY AS DATE) AS payment_date
FROM events, scal WHERE event_type IN ('click', 'view')""")
block("purchase_orders", """
SELECT p_partkey AS po_id, p_partkey % n_supp AS vendor_id,
       DATE '1998-01-01' + CAST(p_partkey * 17 % 1000 AS INTEGER) AS po_date,
       DATE '1998-01-01' + CAST(p_partkey * 17 % 1000 AS INTEGER) + 30 AS expected_invoice_date,
       p_retailprice AS po_amount, p_brand AS po_category
FROM part, scal""")
block("project_milestones", """
SELECT floor(p_partkey / 4) AS project_id, p_partkey AS milestone_id, p_partkey % (n_cust + 10) AS customer_id,
       p_type AS project_type, p_name AS milestone_name,
       CASE WHEN p_partkey % 20 < 4 THEN 'ON_HOLD' ELSE 'ACTIVE' END AS project_status,
       CASE WHEN p_partkey * 11 % 21 = 20 THEN 'COMPLETE' WHEN p_partkey * 11 % 21 = 0 THEN 'NOT_STARTED'
            ELSE 'IN_PROGRESS' END AS completion_status,
       CAST(p_partkey * 11 % 21 AS DOUBLE) / 20 AS completion_pct,
       DATE '2001-07-13' + CAST(p_partkey * 13 % 80 AS INTEGER) AS expected_completion_date,
       (p_partkey % 6 <> 0) AS billing_trigger, p_retailprice AS billing_amount
FROM part, scal""")
block("crm_pipeline", f"""
SELECT o_orderkey AS opportunity_id, o_custkey AS customer_id,
       {_case('o_orderkey % 7', ('Prospecting', 'Qualification', 'Proposal', 'Negotiation', 'Verbal Commit', 'Closed Won', 'Discovery'))} AS crm_stage,
       0.35::DOUBLE AS stage_probability, o_totalprice AS deal_value, o_orderpriority AS deal_type,
       CASE WHEN o_totalprice < 100000 THEN 'SMALL' WHEN o_totalprice < 300000 THEN 'MEDIUM' ELSE 'LARGE' END AS deal_size_band,
       DATE '2001-06-03' + CAST(o_orderkey * 31 % 200 AS INTEGER) AS expected_close_date
FROM orders WHERE o_orderstatus = 'O'""")
block("contingent_inflows", f"""
SELECT event_id AS inflow_id, {_case('event_id % 3', ('Loan', 'Grant', 'Tax Refund'))} AS category,
       value * 100 AS amount, DATE '2001-07-23' + CAST(event_id * 3 % 220 AS INTEGER) AS expected_receipt_date,
       CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(event_id % 15 AS INTEGER) END AS hist_receipt_lag_days,
       {_case('event_id % 5', ('COMMITTED', 'APPROVED', 'PENDING', 'CONTINGENT', 'UNKNOWN'))} AS approval_status,
       'EV-' || CAST(event_id AS VARCHAR) AS source_document_ref
FROM events WHERE event_type IN ('purchase', 'signup')""")
block("expense_schedule", f"""
SELECT event_id AS expense_id,
       {_case('event_id % 7', ('Salary', 'Statutory Tax', 'Renewal', 'PO-based', 'Seasonal', 'One-time', 'Other'))} AS category,
       {_case('event_id % 3', ('MONTHLY', 'QUARTERLY', 'ONE_TIME'))} AS recurrence_type,
       value * 100 AS amount, DATE '2001-07-23' + CAST(event_id * 7 % 220 AS INTEGER) AS obligation_date,
       CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(event_id % 10 AS INTEGER) END AS payment_lag_days,
       'EV-' || CAST(event_id AS VARCHAR) AS source_document_ref
FROM events WHERE event_type IN ('view', 'error')""")

FIXTURE_TABLES = (
    "customers", "invoices", "payments", "collections_events", "non_invoice_payments", "vendors",
    "bills", "purchase_orders", "project_milestones", "crm_pipeline", "contingent_inflows", "expense_schedule",
)


def rnd(x: str, n: int) -> str:
    """NumPy-style rounding of a double (scale, round half to even, unscale)."""
    return f"round_even(CAST({x} AS DOUBLE), {n})"


def clip(x: str, lo=None, hi=None) -> str:
    out = x
    if lo is not None:
        out = f"(CASE WHEN {out} < {lo} THEN {lo} ELSE {out} END)"
    if hi is not None:
        out = f"(CASE WHEN {out} > {hi} THEN {hi} ELSE {out} END)"
    return out


def sid(*parts: str) -> str:
    """Deterministic id: sha256 of '|'-joined parts (matches ``functions.stable_id``)."""
    return "sha256(concat_ws('|', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + "))"


RUN = "'run-0001'"

# ---------------------------------------------------------------------------
# feature store
# ---------------------------------------------------------------------------
block("ar", """
SELECT invoice_id AS reference_id,
       invoice_date + CAST(5 + (invoice_id * 37 + customer_id * 11) % (20 + (customer_id % 7) * 15) AS INTEGER) AS payment_date,
       CASE WHEN invoice_status = 'PARTIAL' THEN invoice_amount * 0.5 ELSE invoice_amount END AS payment_amount
FROM invoices WHERE invoice_status IN ('PAID', 'PARTIAL')
UNION ALL
SELECT invoice_id, invoice_date + CAST(35 + (invoice_id * 17) % 60 AS INTEGER), invoice_amount * 0.25
FROM invoices WHERE invoice_status = 'PARTIAL' AND invoice_id % 2 = 0""")
block("inv_pay", """
SELECT i.*, a.payment_date, a.payment_amount,
       datediff('day', i.invoice_date, a.payment_date) AS days_to_pay,
       datediff('day', i.due_date, a.payment_date) AS days_late
FROM invoices i LEFT JOIN ar a ON i.invoice_id = a.reference_id""")
block("cf_pay", f"""
SELECT customer_id, avg(days_late) AS avg_payment_delay, quantile_cont(days_late, 0.5) AS median_payment_delay,
       avg(CASE WHEN days_late > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS late_payment_ratio,
       coalesce(stddev_samp(days_to_pay), 0.0) AS payment_volatility, avg(invoice_amount) AS avg_invoice_amount,
       count(DISTINCT invoice_id) AS invoice_count, datediff('day', max(payment_date), {REF}) AS days_since_last_payment,
       avg(CASE WHEN payment_date >= {REF} - 30 THEN days_to_pay END) - avg(days_to_pay) AS payment_trend_30d,
       sum(payment_amount) AS total_paid
FROM inv_pay WHERE payment_date IS NOT NULL GROUP BY customer_id""")
block("cf_inv", """
SELECT customer_id, avg(CAST(dispute_flag AS DOUBLE)) AS dispute_ratio,
       count(*) FILTER (WHERE dispute_flag) AS open_dispute_count,
       CASE WHEN sum(invoice_amount) FILTER (WHERE invoice_status IN ('OPEN', 'PARTIAL', 'DISPUTED')) IS NULL THEN NULL
            WHEN sum(invoice_amount) > 0
            THEN sum(invoice_amount) FILTER (WHERE invoice_status IN ('OPEN', 'PARTIAL', 'DISPUTED')) / (sum(invoice_amount) / 365)
            ELSE 0.0 END AS days_sales_outstanding
FROM invoices GROUP BY customer_id""")
block("cf_ptp", """
SELECT c.customer_id,
       avg(CASE WHEN a.payment_date <= c.promise_to_pay_date THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS ptp_kept_ratio
FROM collections_events c LEFT JOIN ar a ON c.invoice_id = a.reference_id
WHERE c.event_type = 'PTP' GROUP BY c.customer_id""")
block("cf_rem", f"""
SELECT customer_id, count(*) AS recent_reminder_velocity FROM collections_events
WHERE event_type = 'REMINDER' AND event_date >= CAST({REF} - 14 AS TIMESTAMP) GROUP BY customer_id""")
block("cf_months", """
SELECT customer_id, month(payment_date) AS pay_month, sum(days_to_pay) AS s, count(days_to_pay) AS c
FROM inv_pay WHERE payment_date IS NOT NULL GROUP BY 1, 2""")
block("cf_si", """
SELECT customer_id, coalesce(stddev_samp(r), 1.0) AS si FROM (
  SELECT customer_id, CASE WHEN sum(s) OVER w / sum(c) OVER w <> 0 THEN (s / c) / (sum(s) OVER w / sum(c) OVER w) END AS r
  FROM cf_months WINDOW w AS (PARTITION BY customer_id)) GROUP BY customer_id""")
block("cf_season", f"""
SELECT customer_id, {clip('(1.0 + (si - (SELECT avg(si) FROM cf_si)))', 0.5, 2.0)} AS seasonality_index FROM cf_si""")
block("cf_nip", """
SELECT party_id AS customer_id, count(*) AS non_invoice_payment_count,
       sum(amount) FILTER (WHERE payment_type = 'ADVANCE') AS advance
FROM non_invoice_payments WHERE party_type = 'CUSTOMER' GROUP BY party_id""")
block("customer_features", f"""
SELECT c.customer_id,
       coalesce(p.avg_payment_delay, 0.0) AS avg_payment_delay, coalesce(p.median_payment_delay, 0.0) AS median_payment_delay,
       coalesce(p.late_payment_ratio, 0.0) AS late_payment_ratio, coalesce(p.payment_volatility, 0.0) AS payment_volatility,
       coalesce(i.dispute_ratio, 0.0) AS dispute_ratio, coalesce(t.ptp_kept_ratio, 0.0) AS ptp_kept_ratio,
       CAST(coalesce(r.recent_reminder_velocity, 0) AS BIGINT) AS recent_reminder_velocity,
       CAST(coalesce(i.open_dispute_count, 0) AS BIGINT) AS open_dispute_count,
       CAST(coalesce(p.days_since_last_payment, 0) AS BIGINT) AS days_since_last_payment,
       coalesce(p.payment_trend_30d, 0.0) AS payment_trend_30d,
       coalesce(i.days_sales_outstanding, 0.0) AS days_sales_outstanding,
       coalesce(s.seasonality_index, 1.0) AS seasonality_index,
       coalesce(p.avg_invoice_amount, 0.0) AS avg_invoice_amount,
       CAST(coalesce(p.invoice_count, 0) AS BIGINT) AS invoice_count,
       CAST(coalesce(n.non_invoice_payment_count, 0) AS BIGINT) AS non_invoice_payment_count,
       coalesce(CASE WHEN n.advance IS NOT NULL THEN
                  CASE WHEN coalesce(p.total_paid, 0) > 0 THEN n.advance / p.total_paid ELSE 0.0 END END, 0.0)
         AS advance_payment_ratio,
       '2001-08-02' AS feature_date, 'v1.0.0' AS feature_version
FROM customers c LEFT JOIN cf_pay p USING (customer_id) LEFT JOIN cf_inv i USING (customer_id)
LEFT JOIN cf_ptp t USING (customer_id) LEFT JOIN cf_rem r USING (customer_id)
LEFT JOIN cf_season s USING (customer_id) LEFT JOIN cf_nip n USING (customer_id)""")

_late = clip("late_payment_ratio", 0, 1)
_vol = clip("payment_volatility / q", 0, 1)
_disp = clip("dispute_ratio", 0, 1)
_ptp = clip("ptp_kept_ratio", 0, 1)
_trend = clip("payment_trend_30d", -30, 30)
block("payment_scores", f"""
SELECT customer_id, payment_score, expected_delay,
       CASE WHEN payment_score > -0.01 AND payment_score <= 0.4 THEN 'HIGH'
            WHEN payment_score > 0.4 AND payment_score <= 0.7 THEN 'MEDIUM'
            WHEN payment_score > 0.7 AND payment_score <= 1.01 THEN 'LOW' END AS risk_segment,
       '2001-08-02' AS score_date, 'cbm-v1.0' AS model_version
FROM (
  SELECT customer_id,
         {rnd(f"0.3 * (1.0 - {_late}) + 0.2 * (1.0 - {_vol}) + 0.15 * (1.0 - {_disp}) + 0.2 * {_ptp} + 0.15 * (1.0 - ({_trend} + 30) / 60)", 3)} AS payment_score,
         {rnd('avg_payment_delay', 2)} AS expected_delay
  FROM customer_features,
       (SELECT greatest(quantile_cont(payment_volatility, 0.95), 1.0) AS q FROM customer_features))""")

block("invoice_features", f"""
SELECT i.invoice_id, i.customer_id, i.invoice_date, i.due_date, i.invoice_amount,
       datediff('day', i.invoice_date, {REF}) AS invoice_age_days,
       {clip(f"datediff('day', i.due_date, {REF})", 0)} AS days_past_due,
       CASE WHEN i.invoice_amount <= cmean * 0.5 THEN 'SMALL' WHEN i.invoice_amount <= cmean * 1.5 THEN 'MEDIUM'
            ELSE 'LARGE' END AS invoice_amount_bucket,
       {rnd('pct', 3)} AS amount_percentile_customer,
       c.credit_terms AS payment_terms, i.dispute_flag,
       coalesce(pp.paid, 0.0) > 0 AS partial_payment_flag, coalesce(pp.paid, 0.0) AS partial_payment_amount,
       '2001-08-02' AS feature_date
FROM (SELECT *, (rank() OVER (PARTITION BY customer_id ORDER BY invoice_amount)
                 + (count(*) OVER (PARTITION BY customer_id, invoice_amount) - 1) / 2.0::DOUBLE)
                / count(*) OVER (PARTITION BY customer_id) AS pct,
             avg(invoice_amount) OVER (PARTITION BY customer_id) AS cmean FROM invoices) i
LEFT JOIN customers c ON i.customer_id = c.customer_id
LEFT JOIN (SELECT reference_id, sum(payment_amount) AS paid FROM ar GROUP BY reference_id) pp
  ON i.invoice_id = pp.reference_id""")

block("collections_features", f"""
SELECT s.invoice_id,
       CAST(coalesce(e.reminder_count, 0) AS INTEGER) AS reminder_count,
       CAST(coalesce(e.call_count, 0) AS INTEGER) AS call_count,
       coalesce(e.ptp > 0, false) AS promise_to_pay_flag, e.promise_to_pay_date,
       CAST(coalesce(floor((epoch_us(CAST({REF} AS TIMESTAMP)) - epoch_us(e.last_contact)) / 86400000000), -1) AS INTEGER)
         AS days_since_last_contact,
       coalesce(CASE e.esc WHEN 0 THEN 'NONE' WHEN 1 THEN 'REMINDER' WHEN 2 THEN 'FORMAL' WHEN 3 THEN 'LEGAL' END, 'NONE')
         AS escalation_status,
       coalesce(cf.ptp_kept_ratio, 0.0) AS ptp_kept_ratio_customer
FROM (SELECT DISTINCT invoice_id, customer_id FROM invoices) s
LEFT JOIN (
  SELECT invoice_id, count(*) FILTER (WHERE event_type = 'REMINDER') AS reminder_count,
         count(*) FILTER (WHERE event_type = 'CALL') AS call_count,
         count(*) FILTER (WHERE event_type = 'PTP') AS ptp,
         max(promise_to_pay_date) FILTER (WHERE event_type = 'PTP') AS promise_to_pay_date,
         max(event_date) AS last_contact,
         max(CASE event_type WHEN 'REMINDER' THEN 1 WHEN 'CALL' THEN 1 WHEN 'PTP' THEN 1 WHEN 'DISPUTE' THEN 2
                             WHEN 'ESCALATION' THEN 3 ELSE 0 END) AS esc
  FROM collections_events GROUP BY invoice_id) e ON s.invoice_id = e.invoice_id
LEFT JOIN customer_features cf ON s.customer_id = cf.customer_id""")

block("ap", "SELECT reference_id, payment_date, payment_amount FROM payments WHERE reference_type = 'AP'")
block("bill_pay", """
SELECT b.*, a.payment_date, a.payment_amount,
       datediff('day', b.bill_date, a.payment_date) AS payment_cycle_days,
       datediff('day', b.due_date, a.payment_date) AS days_late
FROM bills b LEFT JOIN ap a ON b.bill_id = a.reference_id""")
block("vf_pay", f"""
SELECT vendor_id, avg(payment_cycle_days) AS avg_payment_cycle_days,
       coalesce(stddev_samp(payment_cycle_days), 0.0) AS payment_volatility,
       avg(CASE WHEN days_late > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS late_payment_ratio,
       avg(bill_amount) AS avg_invoice_amount, count(DISTINCT bill_id) AS invoice_count,
       avg(CASE WHEN days_late < 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS discount_capture_ratio,
       CAST({rnd("count(*) / count(DISTINCT strftime(payment_date, '%Y-%m'))", 0)} AS BIGINT) AS vendor_chase_frequency,
       max(payment_date) AS last_payment_date, sum(payment_amount) AS total_paid
FROM bill_pay WHERE payment_date IS NOT NULL GROUP BY vendor_id""")
block("vf_lag", """
SELECT p.vendor_id, avg(datediff('day', p.po_date, b.bill_date)) AS po_to_bill_lag
FROM purchase_orders p JOIN bills b ON p.vendor_id = b.vendor_id
WHERE b.bill_date > p.po_date GROUP BY p.vendor_id""")
block("vendor_features", """
SELECT v.vendor_id,
       coalesce(p.avg_payment_cycle_days, 0.0) AS avg_payment_cycle_days,
       coalesce(p.payment_volatility, 0.0) AS payment_volatility,
       coalesce(p.late_payment_ratio, 0.0) AS late_payment_ratio,
       coalesce(p.avg_invoice_amount, 0.0) AS avg_invoice_amount,
       CAST(coalesce(p.invoice_count, 0) AS BIGINT) AS invoice_count,
       coalesce(p.discount_capture_ratio, 0.0) AS discount_capture_ratio,
       CAST(coalesce(p.vendor_chase_frequency, 0) AS BIGINT) AS vendor_chase_frequency,
       p.last_payment_date, coalesce(l.po_to_bill_lag, 0.0) AS po_to_bill_lag,
       coalesce(CASE WHEN n.advance IS NOT NULL THEN
                  CASE WHEN coalesce(p.total_paid, 0) > 0 THEN n.advance / p.total_paid ELSE 0.0 END END, 0.0)
         AS advance_payment_ratio,
       '2001-08-02' AS feature_date, 'v1.0.0' AS feature_version
FROM vendors v LEFT JOIN vf_pay p USING (vendor_id) LEFT JOIN vf_lag l USING (vendor_id)
LEFT JOIN (SELECT party_id AS vendor_id, sum(amount) FILTER (WHERE payment_type = 'ADVANCE') AS advance
           FROM non_invoice_payments WHERE party_type = 'VENDOR' GROUP BY party_id) n USING (vendor_id)""")

block("bill_features", f"""
SELECT bill_id, vendor_id, datediff('day', bill_date, {REF}) AS bill_age_days,
       {clip(f"datediff('day', due_date, {REF})", 0)} AS days_past_due, bill_amount,
       CASE WHEN bill_amount <= vmean * 0.5 THEN 'SMALL' WHEN bill_amount <= vmean * 1.5 THEN 'MEDIUM'
            ELSE 'LARGE' END AS bill_amount_bucket,
       {rnd('pct', 3)} AS amount_percentile_vendor,
       CASE WHEN bill_status IN ('PAID', 'DEFERRED') THEN 'APPROVED' ELSE 'PENDING' END AS approval_status,
       coalesce(datediff('day', {REF}, due_date) > 0 AND datediff('day', {REF}, due_date) <= 10, false)
         AS early_payment_eligible,
       coalesce({clip(f"datediff('day', due_date, {REF})", 0)} > 0 AND bill_status IN ('OPEN', 'APPROVED'), false)
         AS penalty_accruing,
       '2001-08-02' AS feature_date
FROM (SELECT *, (rank() OVER (PARTITION BY vendor_id ORDER BY bill_amount)
                 + (count(*) OVER (PARTITION BY vendor_id, bill_amount) - 1) / 2.0::DOUBLE)
                / count(*) OVER (PARTITION BY vendor_id) AS pct,
             avg(bill_amount) OVER (PARTITION BY vendor_id) AS vmean FROM bills)""")

# ---------------------------------------------------------------------------
# targets, pseudo-predictions, prediction tables
# ---------------------------------------------------------------------------
_TERMS_DAYS = ("CASE {c} WHEN 'NET15' THEN 15 WHEN 'NET30' THEN 30 WHEN 'NET45' THEN 45 "
               "WHEN 'NET60' THEN 60 WHEN 'NET90' THEN 90 ELSE 30 END")
block("ar_labelled", """
SELECT i.invoice_id, i.customer_id, i.invoice_date, i.due_date, i.invoice_amount, f.fp AS first_payment_date,
       datediff('day', i.invoice_date, f.fp) AS days_to_pay
FROM invoices i JOIN (SELECT reference_id, min(payment_date) AS fp FROM payments WHERE reference_type = 'AR'
                      GROUP BY reference_id) f ON i.invoice_id = f.reference_id
WHERE datediff('day', i.invoice_date, f.fp) BETWEEN 0 AND 365""")
block("ap_docs", f"""
SELECT b.bill_id, b.vendor_id, b.bill_date, b.due_date, b.bill_amount,
       coalesce({_TERMS_DAYS.format(c='v.payment_terms')}, 30) AS payment_terms_days
FROM bills b LEFT JOIN vendors v ON b.vendor_id = v.vendor_id""")
block("ap_labelled", """
SELECT d.*, f.fp AS first_payment_date, datediff('day', d.bill_date, f.fp) AS actual_payment_days,
       datediff('day', d.bill_date, f.fp) - d.payment_terms_days AS adjustment_delta
FROM ap_docs d JOIN (SELECT reference_id, min(payment_date) AS fp FROM payments WHERE reference_type = 'AP'
                     GROUP BY reference_id) f ON d.bill_id = f.reference_id
WHERE datediff('day', d.bill_date, f.fp) - d.payment_terms_days BETWEEN -60 AND 60""")
block("ar_scored", """
SELECT *, CAST(days_to_pay + invoice_id % 11 - 5 AS DOUBLE) AS pred_primary,
       CAST(days_to_pay + invoice_id % 7 - 3 AS DOUBLE) AS pred_baseline FROM ar_labelled""")
block("ap_scored", """
SELECT *, CAST(adjustment_delta + bill_id % 11 - 5 AS DOUBLE) AS pred_primary,
       CAST(adjustment_delta + bill_id % 7 - 3 AS DOUBLE) AS pred_baseline FROM ap_labelled""")


def _days(x: str) -> str:
    return f"CAST(trunc({clip(x, '0.0')}) AS INTEGER)"


block("s1_predictions", f"""
SELECT invoice_id AS transaction_id, 'AR' AS transaction_type,
       invoice_date + {_days(rnd('pred_primary', 1))} AS predicted_payment_date,
       invoice_date + {_days(rnd('pred_baseline', 0))} AS baseline_predicted_date,
       CASE WHEN {rnd('pred_primary', 1)} <= 30 THEN 1.0 ELSE 0.0 END AS prob_pay_0_30,
       CASE WHEN {rnd('pred_primary', 1)} > 30 AND {rnd('pred_primary', 1)} <= 60 THEN 1.0 ELSE 0.0 END AS prob_pay_30_60,
       CASE WHEN {rnd('pred_primary', 1)} > 60 THEN 1.0 ELSE 0.0 END AS prob_pay_60_plus,
       invoice_amount AS expected_payment_amount, 'BATCH_PREDICTION' AS trigger_event,
       CASE WHEN pred_baseline IS NULL THEN 'MEDIUM' WHEN abs(pred_primary - pred_baseline) < 3 THEN 'HIGH'
            WHEN abs(pred_primary - pred_baseline) < 7 THEN 'MEDIUM' ELSE 'LOW' END AS confidence_tier,
       '2001-08-02' AS prediction_date, 'lgbm-v1.0' AS model_version
FROM ar_scored""")
block("s2_predictions", f"""
SELECT bill_id AS transaction_id, 'AP' AS transaction_type,
       bill_date + {_days(f"payment_terms_days + {rnd('pred_primary', 1)}")} AS predicted_payment_date,
       bill_date + {_days(f"payment_terms_days + {rnd('pred_baseline', 0)}")} AS baseline_predicted_date,
       CASE WHEN abs({rnd('pred_primary', 1)}) <= 5 THEN 1.0 ELSE 0.0 END AS prob_pay_0_30,
       CASE WHEN abs({rnd('pred_primary', 1)}) > 5 AND abs({rnd('pred_primary', 1)}) <= 15 THEN 1.0 ELSE 0.0 END AS prob_pay_30_60,
       CASE WHEN abs({rnd('pred_primary', 1)}) > 15 THEN 1.0 ELSE 0.0 END AS prob_pay_60_plus,
       bill_amount AS expected_payment_amount, 'BATCH_PREDICTION' AS trigger_event,
       CASE WHEN pred_baseline IS NULL THEN 'MEDIUM' WHEN abs(pred_primary - pred_baseline) < 3 THEN 'HIGH'
            WHEN abs(pred_primary - pred_baseline) < 5 THEN 'MEDIUM' ELSE 'LOW' END AS confidence_tier,
       '2001-08-02' AS prediction_date, 'lgbm-v1.0' AS model_version
FROM ap_scored""")
block("s1_fo", f"""
SELECT {sid("'S1'", 'transaction_id', RUN)} AS forecast_id, '2001-08-02' AS forecast_date, 'AR' AS forecast_type,
       predicted_payment_date AS target_date, expected_payment_amount AS forecast_amount,
       0.9 * expected_payment_amount AS confidence_low, 1.1 * expected_payment_amount AS confidence_high,
       'S1' AS source_module, {RUN} AS forecast_run_id FROM s1_predictions""")
block("s2_fo", f"""
SELECT {sid("'S2'", 'transaction_id', RUN)} AS forecast_id, '2001-08-02' AS forecast_date, 'AP' AS forecast_type,
       predicted_payment_date AS target_date, -expected_payment_amount AS forecast_amount,
       1.1 * -expected_payment_amount AS confidence_low, 0.9 * -expected_payment_amount AS confidence_high,
       'S2' AS source_module, {RUN} AS forecast_run_id FROM s2_predictions""")

# ---------------------------------------------------------------------------
# rule-based forecasts
# ---------------------------------------------------------------------------
block("s5_detail", f"""
SELECT {sid("'S5'", 'inflow_id', RUN)} AS forecast_id, inflow_id, category, amount, expected_receipt_date,
       expected_receipt_date + CAST(coalesce(hist_receipt_lag_days, 0) AS INTEGER) AS expected_cash_date,
       CAST(coalesce(hist_receipt_lag_days, 0) AS INTEGER) AS receipt_lag_days, approval_status,
       CASE approval_status WHEN 'COMMITTED' THEN 'HIGH' WHEN 'APPROVED' THEN 'MEDIUM' WHEN 'PENDING' THEN 'LOW'
            WHEN 'CONTINGENT' THEN 'LOW' ELSE 'LOW' END AS confidence_tier,
       source_document_ref, amount AS forecast_amount, 'S5' AS source_module, 'INFLOW' AS forecast_type,
       '2001-08-02' AS forecast_date, '' AS notes
FROM contingent_inflows WHERE expected_receipt_date BETWEEN {REF} AND {HORIZON_END}""")
block("s6_detail", f"""
SELECT {sid("'S6'", 'expense_id', RUN)} AS forecast_id, expense_id, category, recurrence_type, amount, obligation_date,
       obligation_date + CAST(coalesce(payment_lag_days, 0) AS INTEGER) AS expected_cash_date,
       CAST(coalesce(payment_lag_days, 0) AS INTEGER) AS payment_lag_days,
       CASE category WHEN 'Salary' THEN 'HIGH' WHEN 'Statutory Tax' THEN 'HIGH' WHEN 'Renewal' THEN 'MEDIUM'
            WHEN 'PO-based' THEN 'MEDIUM' WHEN 'Seasonal' THEN 'LOW' WHEN 'One-time' THEN 'LOW' ELSE 'LOW' END
         AS confidence_tier,
       source_document_ref, '' AS approved_by, -abs(amount) AS forecast_amount, 'S6' AS source_module,
       'EXPENSE' AS forecast_type, '2001-08-02' AS forecast_date, '' AS notes
FROM expense_schedule WHERE obligation_date BETWEEN {REF} AND {HORIZON_END}""")


def _fo(src: str, module: str, ftype: str, low: float, high: float) -> str:
    return f"""
SELECT forecast_id, '2001-08-02' AS forecast_date, '{ftype}' AS forecast_type, expected_cash_date AS target_date,
       forecast_amount, forecast_amount * {low} AS confidence_low, forecast_amount * {high} AS confidence_high,
       '{module}' AS source_module, {RUN} AS forecast_run_id FROM {src}"""


block("s5_fo", _fo("s5_detail", "S5", "INFLOW", 0.8, 1.2))
block("s6_fo", _fo("s6_detail", "S6", "EXPENSE", 1.1, 0.9))

block("cust_delay", """
SELECT c.customer_id, coalesce(p.avg_payment_delay, 0.0) AS avg_payment_delay
FROM customers c LEFT JOIN cf_pay p ON c.customer_id = p.customer_id""")
block("s3_base", f"""
SELECT m.*, {clip('coalesce(cf.avg_payment_delay, 30.0)', '0.0')} AS customer_payment_delay
FROM project_milestones m LEFT JOIN cust_delay cf ON m.customer_id = cf.customer_id
WHERE m.project_status IN ('ACTIVE') AND m.completion_status <> 'COMPLETE'
  AND (m.completion_pct >= 0.8::DOUBLE OR (datediff('day', {REF}, m.expected_completion_date) >= 0
                                            AND datediff('day', {REF}, m.expected_completion_date) <= 30))
  AND m.billing_trigger = true""")
block("s3_dates", f"""
SELECT *, projected + 7 + CAST(trunc(customer_payment_delay) AS INTEGER) AS expected_cash_date,
       projected + 7 AS expected_invoice_date FROM (
  SELECT *, CASE WHEN completion_status = 'IN_PROGRESS' AND expected_completion_date < {REF}
                      AND completion_pct >= 0.8::DOUBLE
                 THEN {REF} + greatest(1, CAST(trunc((1.0::DOUBLE - completion_pct) * 14) AS INTEGER))
                 ELSE expected_completion_date END AS projected
  FROM s3_base)""")
block("s3_detail", f"""
SELECT {sid("'S3'", 'milestone_id', RUN)} AS forecast_id, project_id, milestone_id, customer_id, project_type,
       milestone_name, completion_pct, completion_status, billing_amount, projected AS expected_completion_date,
       expected_invoice_date, expected_cash_date, billing_amount AS forecast_amount, 7 AS invoice_lag_days,
       CAST(trunc(customer_payment_delay) AS INTEGER) AS customer_payment_delay_days,
       CASE WHEN completion_pct >= 0.95::DOUBLE THEN 'HIGH' WHEN completion_pct >= 0.8::DOUBLE THEN 'MEDIUM'
            ELSE 'LOW' END AS confidence_tier,
       'S3' AS source_module, 'WIP' AS forecast_type, '2001-08-02' AS forecast_date
FROM s3_dates WHERE expected_cash_date <= {WIP_END}""")

_STAGE = ("CASE crm_stage WHEN 'Prospecting' THEN 0.1 WHEN 'Qualification' THEN 0.25 WHEN 'Proposal' THEN 0.5 "
          "WHEN 'Negotiation' THEN 0.75 WHEN 'Verbal Commit' THEN 0.9 WHEN 'Closed Won' THEN 1.0 END")
block("s4_base", f"""
SELECT p.*, coalesce(CAST({_STAGE} AS DOUBLE), p.stage_probability, 0.5) AS stage_prob,
       {clip('coalesce(d.delay, 30.0)', '0.0')} AS deal_delay
FROM crm_pipeline p LEFT JOIN (
  SELECT customer_id, {clip('coalesce(avg_payment_delay, 30.0)', '0.0')} AS delay FROM cust_delay) d
  ON p.customer_id = d.customer_id
WHERE p.crm_stage <> 'Closed Won'""")
block("s4_exploded", """
SELECT b.*, m.ms_idx, m.weight, m.off,
       b.expected_close_date + m.off + 7 AS expected_invoice_date,
       b.expected_close_date + m.off + 7 + CAST(trunc(b.deal_delay) AS INTEGER) AS expected_cash_date
FROM s4_base b CROSS JOIN (VALUES (0, 0.3::DOUBLE, 0), (1, 0.4::DOUBLE, 30), (2, 0.3::DOUBLE, 60)) m(ms_idx, weight, off)""")
block("s4_detail", f"""
SELECT {sid("'S4'", 'opportunity_id', 'ms_idx', RUN)} AS forecast_id, opportunity_id, customer_id, deal_value,
       deal_type, deal_size_band, crm_stage, stage_prob AS stage_probability, ms_idx + 1 AS milestone_sequence,
       {rnd('weight', 3)} AS milestone_weight, {rnd('deal_value * stage_prob * weight', 2)} AS forecast_amount,
       expected_close_date, expected_invoice_date, expected_cash_date, 7 AS invoice_lag_days,
       CAST(trunc(deal_delay) AS INTEGER) AS customer_payment_delay_days,
       CASE WHEN stage_prob >= 0.75::DOUBLE THEN 'MEDIUM' ELSE 'LOW' END AS confidence_tier,
       'S4' AS source_module, 'PIPELINE' AS forecast_type, '2001-08-02' AS forecast_date
FROM s4_exploded WHERE expected_cash_date BETWEEN {REF} AND {HORIZON_END}""")
block("s4_fo", _fo("s4_detail", "S4", "PIPELINE", 0.7, 1.3))

# ---------------------------------------------------------------------------
# cash position (S7)
# ---------------------------------------------------------------------------
_FILES = {"S1": "s1_ar_forecast.csv", "S2": "s2_ap_forecast.csv", "S3": "s3_wip_forecast.csv",
          "S4": "s4_pipeline_forecast.csv", "S5": "s5_contingent_forecast.csv", "S6": "s6_expense_forecast.csv"}
_SRC_TIER = {"S1": "MEDIUM", "S2": "MEDIUM", "S3": "LOW", "S4": "LOW", "S5": "LOW", "S6": "MEDIUM"}


def _std(src: str, module: str) -> str:
    tier = "confidence_tier" if module == "S3" else f"'{_SRC_TIER[module]}'"
    tgt = "expected_cash_date" if module == "S3" else "target_date"
    return f"""
SELECT {sid(f"'{module}'", 'forecast_id', RUN)} AS event_id, concat(source_module, '') AS source_module,
       concat(forecast_type, '') AS forecast_type,
       CASE WHEN forecast_type IN ('AP', 'EXPENSE') THEN 'OUTFLOW' ELSE 'INFLOW' END AS direction,
       CAST({tgt} AS DATE) AS target_date, CAST(forecast_amount AS DOUBLE) AS forecast_amount,
       concat({tier}, '') AS confidence_tier, concat(forecast_date, '') AS forecast_date, {RUN} AS forecast_run_id,
       '{_FILES[module]}' AS original_file
FROM {src} WHERE CAST({tgt} AS DATE) BETWEEN {REF} AND {HORIZON_END}"""


def event_store_sql(mods=("S1", "S2", "S3", "S4", "S5", "S6")) -> str:
    srcs = {"S1": "s1_fo", "S2": "s2_fo", "S3": "s3_detail", "S4": "s4_fo", "S5": "s5_fo", "S6": "s6_fo"}
    return "\nUNION ALL\n".join(_std(srcs[m], m) for m in mods)


block("events_raw", event_store_sql())
# the days that a winner covers come from one window over the events, which are read once
block("event_store", """
SELECT e.*, reason <> '' AS suppressed, reason AS suppression_reason FROM (
  SELECT e.* EXCLUDE (s1_day, s2_day), CASE
      WHEN source_module = 'S6' AND s2_day THEN 'DEDUP_S6_TO_S2'
      WHEN source_module = 'S3' AND s1_day THEN 'DEDUP_S3_TO_S1'
      WHEN source_module = 'S4' AND s1_day THEN 'DEDUP_S4_TO_S1'
      ELSE '' END AS reason
  FROM (SELECT r.*, bool_or(source_module = 'S1') OVER (PARTITION BY target_date) AS s1_day,
               bool_or(source_module = 'S2') OVER (PARTITION BY target_date) AS s2_day FROM events_raw r) e) e""")
block("active_events", "SELECT * FROM event_store WHERE NOT suppressed")
block("daily_position", f"""
SELECT date, gross_inflow, gross_outflow, net_flow,
       5000000.0 + sum(net_flow) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
         AS cumulative_position
FROM (
  SELECT CAST(cal.d AS DATE) AS date, coalesce(x.pi, 0.0) AS gross_inflow, abs(coalesce(x.po, 0.0)) AS gross_outflow,
         coalesce(x.pi, 0.0) - abs(coalesce(x.po, 0.0)) AS net_flow
  FROM (SELECT unnest(generate_series(CAST({REF} AS TIMESTAMP),
                                      CAST((SELECT max(target_date) FROM active_events) AS TIMESTAMP),
                                      INTERVAL 1 DAY)) AS d) cal
  LEFT JOIN (SELECT target_date, sum(forecast_amount) FILTER (WHERE forecast_amount > 0) AS pi,
                    sum(forecast_amount) FILTER (WHERE forecast_amount < 0) AS po
             FROM active_events GROUP BY target_date) x ON CAST(cal.d AS DATE) = x.target_date)""")


def _rollup_sql(label: str, name: str) -> str:
    return f"""
SELECT {label} AS {name}, {rnd('sum(gross_inflow)', 2)} AS gross_inflow, {rnd('sum(gross_outflow)', 2)} AS gross_outflow,
       {rnd('sum(net_flow)', 2)} AS net_flow, {rnd('arg_max(cumulative_position, date)', 2)} AS closing_position
FROM daily_position GROUP BY 1"""


block("weekly_position", _rollup_sql(
    "strftime(date_trunc('week', date), '%Y-%m-%d') || '/' || strftime(CAST(date_trunc('week', date) AS DATE) + 6, '%Y-%m-%d')",
    "week"))
block("monthly_position", _rollup_sql("strftime(date, '%Y-%m')", "month"))

# ---------------------------------------------------------------------------
# recommendations
# ---------------------------------------------------------------------------
block("overdue", """
SELECT i.*, c.reminder_count, c.call_count, c.promise_to_pay_flag, c.promise_to_pay_date, c.days_since_last_contact,
       c.escalation_status, c.ptp_kept_ratio_customer, s.payment_score, s.risk_segment,
       p.predicted_payment_date, p.confidence_tier AS prediction_confidence
FROM invoice_features i LEFT JOIN collections_features c ON i.invoice_id = c.invoice_id
LEFT JOIN payment_scores s ON i.customer_id = s.customer_id
LEFT JOIN s1_predictions p ON i.invoice_id = p.transaction_id
WHERE i.days_past_due > 0""")
block("coll_cand", f"""
SELECT o.*, round_even(0.4 * (CASE WHEN mi > 0 THEN expected_cash_impact / mi ELSE 0.0 END)
                       + 0.3 * {clip('days_past_due / greatest(mo, 1)', 0, 1)} + 0.2 * response_probability
                       + (0.1::DOUBLE * 0.8::DOUBLE), 4) AS total_score
FROM (SELECT *, invoice_amount * response_probability AS expected_cash_impact FROM (
        SELECT *, {clip('coalesce(payment_score, 0.5)', 0.1, 0.95)} AS response_probability FROM overdue)) o,
     (SELECT max(invoice_amount * {clip('coalesce(payment_score, 0.5)', 0.1, 0.95)}) AS mi, max(days_past_due) AS mo
      FROM overdue) n""")
block("rec_coll", f"""
SELECT {sid("'COLLECTIONS'", 'invoice_id', RUN)} AS recommendation_id, 'COLLECTIONS' AS lever,
       CASE WHEN total_score > 0.7 THEN 'HIGH' WHEN total_score > 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS priority,
       'INVOICE' AS entity_type, invoice_id AS entity_id, customer_id,
       CASE WHEN risk_segment = 'HIGH' THEN 'Formal notice + phone call'
            WHEN risk_segment = 'MEDIUM' THEN 'Email reminder + follow-up call' ELSE 'Portal nudge + email' END AS action,
       CASE WHEN risk_segment = 'HIGH' THEN 'FORMAL' ELSE 'REMINDER' END AS channel,
       'Escalate ' || CAST(invoice_id AS VARCHAR) || ' ($' || format('{{:,.0f}}', invoice_amount) || ', '
         || CAST(days_past_due AS VARCHAR) || ' days overdue) — est. accelerate by 5 days, expected cash impact $'
         || format('{{:,.0f}}', expected_cash_impact) AS description,
       round_even(expected_cash_impact, 2) AS cash_impact, 5 AS days_accelerated, risk_segment,
       total_score AS score, prediction_confidence AS confidence
FROM coll_cand ORDER BY total_score DESC, invoice_id LIMIT 10""")
block("rec_vendor", f"""
SELECT {sid("'VENDOR_DEFERRAL'", 'transaction_id', RUN)} AS recommendation_id, 'VENDOR_DEFERRAL' AS lever,
       'MEDIUM' AS priority, 'BILL' AS entity_type, transaction_id AS entity_id, CAST(NULL AS BIGINT) AS customer_id,
       'Defer payment by 10 days (no penalty)' AS action, 'TREASURY' AS channel,
       'Defer ' || CAST(transaction_id AS VARCHAR) || ' ($' || format('{{:,.0f}}', expected_payment_amount)
         || ') by 10 days — improves short-term cash by $' || format('{{:,.0f}}', expected_payment_amount) AS description,
       round_even(expected_payment_amount, 2) AS cash_impact, -10 AS days_accelerated,
       CAST(NULL AS VARCHAR) AS risk_segment, score, confidence_tier AS confidence
FROM (SELECT u.*, round_even(0.4 * (expected_payment_amount / greatest(mx, 1.0)) + (0.1::DOUBLE * 0.7::DOUBLE), 4) AS score
      FROM (SELECT * FROM s2_predictions WHERE predicted_payment_date BETWEEN {REF} AND {REF} + 14) u,
           (SELECT max(expected_payment_amount) AS mx FROM s2_predictions
            WHERE predicted_payment_date BETWEEN {REF} AND {REF} + 14) m)
ORDER BY score DESC, transaction_id LIMIT 5""")
block("rec_expense", f"""
SELECT {sid("'EXPENSE_DEFERRAL'", 'expense_id', RUN)} AS recommendation_id, 'EXPENSE_DEFERRAL' AS lever,
       'LOW' AS priority, 'EXPENSE' AS entity_type, expense_id AS entity_id, CAST(NULL AS BIGINT) AS customer_id,
       'Defer ' || lower(category) || ' expense by 21 days' AS action, 'FINANCE' AS channel,
       'Defer ' || CASE WHEN coalesce(notes, '') <> '' THEN notes ELSE CAST(expense_id AS VARCHAR) END
         || ' ($' || format('{{:,.0f}}', cash_freed) || ') by 21 days — frees $' || format('{{:,.0f}}', cash_freed)
         || ' during the period' AS description,
       round_even(cash_freed, 2) AS cash_impact, -21 AS days_accelerated, CAST(NULL AS VARCHAR) AS risk_segment,
       round_even(0.3 + 0.1 * (cash_freed / greatest(max(cash_freed) OVER (), 1.0)), 4) AS score, 'LOW' AS confidence
FROM (SELECT *, abs(amount) AS cash_freed FROM s6_detail WHERE category IN ('Seasonal', 'One-time')
      ORDER BY cash_freed DESC, expense_id LIMIT 3)""")
block("recommendations", """
SELECT * FROM (
  SELECT *, row_number() OVER (ORDER BY score DESC, lever, entity_id) AS rank FROM (
    SELECT * FROM rec_coll UNION ALL SELECT * FROM rec_vendor UNION ALL SELECT * FROM rec_expense))
WHERE rank <= 10""")

# ---------------------------------------------------------------------------
# splits and metrics (pseudo-predictions)
# ---------------------------------------------------------------------------
block("s1_split", """
SELECT *, CAST(days_to_pay AS DOUBLE) AS label, pred_primary AS prediction,
       row_number() OVER (ORDER BY invoice_date, invoice_id) - 1 < floor(count(*) OVER () * 0.8::DOUBLE) AS is_train
FROM ar_scored""")
block("s1_test", "SELECT * FROM s1_split WHERE NOT is_train")
block("s1_train", "SELECT * FROM s1_split WHERE is_train")
block("s1_random_split", """
SELECT invoice_id, row_number() OVER (ORDER BY sha256(CAST(invoice_id AS VARCHAR) || '|42'), invoice_id) - 1
         < floor(count(*) OVER () * 0.8::DOUBLE) AS is_train FROM ar_labelled""")
block("s2_seq_split", """
SELECT bill_id, row_number() OVER (ORDER BY bill_id) - 1 < floor(count(*) OVER () * 0.8::DOUBLE) AS is_train
FROM ap_labelled""")
block("s2_split", """
SELECT s.*, v.invoice_count, CAST(adjustment_delta AS DOUBLE) AS label, pred_primary AS prediction,
       row_number() OVER (ORDER BY bill_date, bill_id) - 1 < floor(count(*) OVER () * 0.8::DOUBLE) AS is_train
FROM ap_scored s LEFT JOIN vendor_features v ON s.vendor_id = v.vendor_id""")
block("s2_test", "SELECT * FROM s2_split WHERE NOT is_train")
block("s2_train", "SELECT * FROM s2_split WHERE is_train")
block("risk_base", """
SELECT cf.*, s.risk_segment, CASE s.risk_segment WHEN 'LOW' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'HIGH' THEN 2 END AS target
FROM customer_features cf JOIN payment_scores s ON cf.customer_id = s.customer_id WHERE s.risk_segment IS NOT NULL""")
block("risk_eval", """
SELECT *, target AS label, (target + CASE WHEN customer_id % 4 = 0 THEN 1 ELSE 0 END) % 3 AS prediction,
       (target + CASE WHEN customer_id % 5 = 0 THEN 2 ELSE 0 END) % 3 AS baseline_class,
       CASE WHEN (target + CASE WHEN customer_id % 4 = 0 THEN 1 ELSE 0 END) % 3 = 0 THEN 0.6 ELSE 0.2 END
         + (customer_id % 5) * 0.01 AS prob_0,
       CASE WHEN (target + CASE WHEN customer_id % 4 = 0 THEN 1 ELSE 0 END) % 3 = 1 THEN 0.6 ELSE 0.2 END
         + (customer_id % 5) * 0.01 AS prob_1,
       CASE WHEN (target + CASE WHEN customer_id % 4 = 0 THEN 1 ELSE 0 END) % 3 = 2 THEN 0.6 ELSE 0.2 END
         + (customer_id % 5) * 0.01 AS prob_2,
       (rank() OVER (PARTITION BY target ORDER BY sha256(CAST(customer_id AS VARCHAR) || '|42')) - 1)
         >= ceil(count(*) OVER (PARTITION BY target) * 0.2::DOUBLE) AS is_train
FROM risk_base""")
block("risk_test", "SELECT * FROM risk_eval WHERE NOT is_train")
block("risk_split_counts", "SELECT target, is_train, count(*) AS n FROM risk_eval GROUP BY 1, 2")
block("risk_class_dist", """
SELECT target, count(*) AS count, count(*) * 100.0 / sum(count(*)) OVER () AS pct FROM risk_eval GROUP BY target""")
block("risk_weights", """
SELECT customer_id, target, (SELECT count(*) FROM risk_eval WHERE is_train)
         / ((SELECT count(DISTINCT target) FROM risk_eval WHERE is_train) * count(*) OVER (PARTITION BY target))
         AS class_weight
FROM risk_eval WHERE is_train""")
block("s1_target_summary", """
SELECT count(*) AS n, avg(days_to_pay) AS mean, stddev_samp(days_to_pay) AS std,
       quantile_cont(days_to_pay, 0.5) AS median FROM s1_train""")


def _reg_metrics(src: str, p: str = "prediction") -> str:
    e = f"(label - {p})"
    return f"""
SELECT round_even(avg(abs({e})), 3) AS mae, round_even(sqrt(avg({e} * {e})), 3) AS rmse,
       round_even(CASE WHEN var_pop(label) * count(*) > 0 THEN 1.0 - sum({e} * {e}) / (var_pop(label) * count(*))
                       ELSE 0.0 END, 3) AS r2,
       round_even(coalesce(avg(CASE WHEN label <> 0 THEN abs({e} / label) END) * 100, 0.0), 3) AS mape,
       round_even(quantile_cont(abs({e}), 0.5), 3) AS median_ae
FROM {src}"""


block("me1", _reg_metrics("s1_test"))
block("me1_train", _reg_metrics("s1_train"))
block("me1_base", _reg_metrics("s1_test", "pred_baseline"))
block("me2", """
SELECT round_even(CASE WHEN tr.mae > 0 THEN te.mae / tr.mae ELSE 1.0 END, 3) AS overfit_ratio,
       CASE WHEN tr.mae > 0 THEN te.mae / tr.mae ELSE 1.0 END > 1.5 AS overfit_warning
FROM me1_train tr, me1 te""")
block("me3", """
SELECT CASE WHEN a.mae < b.mae THEN 'GBT' ELSE 'RandomForest' END AS best_model,
       round_even(CASE WHEN a.mae < b.mae THEN (b.mae - a.mae) / b.mae * 100 ELSE (a.mae - b.mae) / a.mae * 100 END, 2)
         AS improvement_pct
FROM me1 a, me1_base b""")


def _div(src: str, thr: int) -> str:
    d = "abs(pred_primary - pred_baseline)"
    return f"""
SELECT avg({d}) AS divergence_mean, max({d}) AS divergence_max, count(*) FILTER (WHERE {d} > {thr}) AS divergence_above,
       avg(CASE WHEN {d} > {thr} THEN 1.0 ELSE 0.0 END) * 100 AS divergence_above_pct,
       quantile_cont({d}, 0.5) AS divergence_median FROM {src}"""


block("me4", _div("s1_test", 10))
block("ml9", _div("s1_split", 10))
block("me5", """
SELECT avg(CASE WHEN abs(label - prediction) <= 3 THEN 1.0 ELSE 0.0 END) * 100 AS error_pct_within_3d,
       avg(CASE WHEN abs(label - prediction) <= 7 THEN 1.0 ELSE 0.0 END) * 100 AS error_pct_within_7d,
       avg(CASE WHEN abs(label - prediction) <= 14 THEN 1.0 ELSE 0.0 END) * 100 AS error_pct_within_14d,
       avg(CASE WHEN abs(label - prediction) <= 30 THEN 1.0 ELSE 0.0 END) * 100 AS error_pct_within_30d,
       avg(CASE WHEN abs(label - prediction) > 30 THEN 1.0 ELSE 0.0 END) * 100 AS error_pct_over_30d
FROM s1_test""")


def _acc(src: str, ref: str) -> str:
    ae = "abs(label - prediction)"
    tol = ", ".join(f"round_even(avg(CASE WHEN {ae} <= {t} THEN 1.0 ELSE 0.0 END) * 100, 1) AS accuracy_within_{t}d"
                    for t in (3, 5, 7, 10))
    return f"""
SELECT {tol},
       round_even(avg(CASE WHEN (label > {ref}) = (prediction > {ref}) THEN 1.0 ELSE 0.0 END) * 100, 1)
         AS directional_accuracy,
       round_even(CASE WHEN var_pop(label) > 0 THEN 1.0 - var_pop(label - prediction) / var_pop(label) ELSE 0.0 END, 4)
         AS explained_variance,
       round_even(avg(prediction - label), 3) AS mean_bias_error
FROM {src}"""


block("me6", _acc("s1_test", "(SELECT avg(label) FROM s1_train)"))
block("me6_s2", _acc("s2_test", "0"))
block("me7", """
SELECT round_even(avg(CASE WHEN invoice_count < 10 THEN abs(label - prediction) END), 3) AS thin_vendor_mae,
       round_even(avg(CASE WHEN NOT (invoice_count < 10) THEN abs(label - prediction) END), 3) AS rich_vendor_mae
FROM s2_test""")
block("ml10", """
SELECT round_even(avg(CASE WHEN invoice_count < 10 THEN abs(label - prediction) END), 3) AS thin_vendor_mae,
       round_even(avg(CASE WHEN NOT (invoice_count < 10) THEN abs(label - prediction) END), 3) AS rich_vendor_mae
FROM s2_train""")
block("me_pc", """
SELECT c, count(*) FILTER (WHERE label = c AND prediction = c) AS tp, count(*) FILTER (WHERE prediction = c) AS pp,
       count(*) FILTER (WHERE label = c) AS ap,
       CASE WHEN count(*) FILTER (WHERE prediction = c) > 0
            THEN count(*) FILTER (WHERE label = c AND prediction = c) / count(*) FILTER (WHERE prediction = c)
            ELSE 0.0 END AS prec,
       CASE WHEN count(*) FILTER (WHERE label = c) > 0
            THEN count(*) FILTER (WHERE label = c AND prediction = c) / count(*) FILTER (WHERE label = c)
            ELSE 0.0 END AS rec
FROM risk_test, (VALUES (0), (1), (2)) k(c) GROUP BY c""")
block("me_pcf", "SELECT *, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END AS f1 FROM me_pc")
block("me8", """
SELECT round_even((SELECT avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) FROM risk_test), 4) AS accuracy,
       round_even(avg(prec), 4) AS precision_macro, round_even(avg(rec), 4) AS recall_macro,
       round_even(avg(f1), 4) AS f1_macro,
       round_even(sum(prec * ap) / sum(ap), 4) AS precision_weighted,
       round_even(sum(rec * ap) / sum(ap), 4) AS recall_weighted, round_even(sum(f1 * ap) / sum(ap), 4) AS f1_weighted,
       round_even(max(f1) FILTER (WHERE c = 0), 4) AS f1_LOW, round_even(max(f1) FILTER (WHERE c = 1), 4) AS f1_MEDIUM,
       round_even(max(f1) FILTER (WHERE c = 2), 4) AS f1_HIGH
FROM me_pcf""")
block("me10", """
SELECT label AS actual, count(*) FILTER (WHERE prediction = 0) AS pred_0, count(*) FILTER (WHERE prediction = 1) AS pred_1,
       count(*) FILTER (WHERE prediction = 2) AS pred_2 FROM risk_test GROUP BY label""")
block("me10r", """
SELECT CASE c WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' ELSE 'HIGH' END AS class_name, round_even(prec, 4) AS precision,
       round_even(rec, 4) AS recall, round_even(f1, 4) AS f1, ap AS support FROM me_pcf""")
block("me11", """
SELECT round_even(avg(CASE WHEN prediction = baseline_class THEN 1.0 ELSE 0.0 END) * 100, 2) AS agreement_pct
FROM risk_test""")
block("me9", """
SELECT round_even(avg(auc), 4) AS auc_roc_ovr FROM (
  SELECT c, (sum(r) FILTER (WHERE pos) - count(*) FILTER (WHERE pos) * (count(*) FILTER (WHERE pos) + 1) / 2.0)
            / (count(*) FILTER (WHERE pos) * count(*) FILTER (WHERE NOT pos)) AS auc
  FROM (SELECT k.c, t.label = k.c AS pos,
               rank() OVER (PARTITION BY k.c ORDER BY CASE k.c WHEN 0 THEN prob_0 WHEN 1 THEN prob_1 ELSE prob_2 END)
               + (count(*) OVER (PARTITION BY k.c, CASE k.c WHEN 0 THEN prob_0 WHEN 1 THEN prob_1 ELSE prob_2 END) - 1)
                 / 2.0 AS r
        FROM risk_test t, (VALUES (0), (1), (2)) k(c))
  GROUP BY c)""")
block("snk5", """
SELECT metric, value FROM (SELECT * FROM me1) UNPIVOT (value FOR metric IN (mae, rmse, r2, mape, median_ae))""")

# ---------------------------------------------------------------------------
# summaries
# ---------------------------------------------------------------------------
def _breakdown(src: str, dims: list[str], absolute: bool = False) -> str:
    total = "abs(sum(forecast_amount))" if absolute else "sum(forecast_amount)"
    parts = [f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS key, count(*) AS count, "
             f"round_even({total}, 2) AS total_amount FROM {src} GROUP BY {d}" for d in dims]
    return "\nUNION ALL\n".join(parts)


block("s3_summary", """
SELECT count(*) AS total_milestones, count(DISTINCT project_id) AS total_projects,
       count(DISTINCT customer_id) AS total_customers, round_even(sum(forecast_amount), 2) AS total_forecast_amount,
       round_even(avg(forecast_amount), 2) AS avg_forecast_amount FROM s3_detail""")
block("s3_breakdown", _breakdown("s3_detail", ["confidence_tier", "project_type"]))
_WEEK = ("strftime(date_trunc('week', {c}), '%Y-%m-%d') || '/' || "
         "strftime(CAST(date_trunc('week', {c}) AS DATE) + 6, '%Y-%m-%d')")
block("s3_weekly", f"""
SELECT {_WEEK.format(c='expected_cash_date')} AS cash_week, round_even(sum(forecast_amount), 2) AS forecast_amount
FROM s3_detail GROUP BY 1""")
block("s4_stage_mix", """
SELECT crm_stage, count(*) AS deals, round_even(sum(deal_value), 2) AS total_value FROM crm_pipeline
WHERE crm_stage <> 'Closed Won' GROUP BY crm_stage""")
block("s4_cohort", """
SELECT CAST(trunc(quantile_cont(milestone_count, 0.5)) AS BIGINT) AS global_milestone_count,
       avg(avg_invoice_amount) AS global_avg_invoice_amount, avg(avg_days_to_pay) AS global_avg_days_to_pay,
       count(*) AS total_closed_deals
FROM (SELECT i.customer_id, count(i.invoice_id) AS milestone_count, avg(i.invoice_amount) AS avg_invoice_amount,
             avg(datediff('day', i.invoice_date, a.payment_date)) AS avg_days_to_pay
      FROM invoices i JOIN ar a ON i.invoice_id = a.reference_id GROUP BY i.customer_id)""")
block("s4_summary", """
SELECT count(*) AS total_records, count(DISTINCT opportunity_id) AS total_deals,
       count(DISTINCT customer_id) AS total_customers, round_even(sum(forecast_amount), 2) AS total_forecast_amount,
       round_even(avg(forecast_amount), 2) AS avg_per_milestone FROM s4_detail""")
block("s4_breakdown", _breakdown("s4_detail", ["crm_stage", "deal_type"]))
block("s4_monthly", """
SELECT strftime(expected_cash_date, '%Y-%m') AS cash_month, round_even(sum(forecast_amount), 2) AS forecast_amount
FROM s4_detail GROUP BY 1""")
block("s5_breakdown", _breakdown("s5_detail", ["category", "confidence_tier", "approval_status"]))
block("s5_totals", "SELECT count(*) AS total_records, round_even(sum(forecast_amount), 2) AS total_forecast FROM s5_detail")
block("s6_breakdown", _breakdown("s6_detail", ["category", "recurrence_type", "confidence_tier"], absolute=True))
block("s6_totals", "SELECT count(*) AS total_records, round_even(abs(sum(forecast_amount)), 2) AS total_forecast FROM s6_detail")
block("s7_profile", """
SELECT source_module, direction, confidence_tier, count(*) AS events FROM event_store
GROUP BY GROUPING SETS ((source_module), (direction), (confidence_tier))""")
block("s7_summary", """
SELECT round_even(sum(gross_inflow), 2) AS total_inflows, round_even(sum(gross_outflow), 2) AS total_outflows,
       round_even(sum(net_flow), 2) AS net_position_change,
       round_even(arg_max(cumulative_position, date), 2) AS closing_balance,
       round_even(min(cumulative_position), 2) AS min_cash_position,
       min(date) FILTER (WHERE cumulative_position = (SELECT min(cumulative_position) FROM daily_position))
         AS min_cash_date,
       count(*) AS forecast_days,
       (SELECT count(*) FROM event_store) AS total_events,
       (SELECT count(*) FROM event_store WHERE NOT suppressed) AS active_events,
       (SELECT count(*) FROM event_store WHERE suppressed) AS suppressed_events,
       5000000.0 AS opening_balance
FROM daily_position""")
block("s7_cash_fo", f"""
SELECT {sid("'S7'", 'date', RUN)} AS forecast_id, '2001-08-02' AS forecast_date, 'CASH' AS forecast_type,
       date AS target_date, net_flow AS forecast_amount, net_flow * 0.85 AS confidence_low,
       net_flow * 1.15 AS confidence_high, 'S7' AS source_module, {RUN} AS forecast_run_id FROM daily_position""")
block("s7_by_source", """
SELECT source_module, count(*) AS event_count, round_even(sum(forecast_amount), 2) AS total,
       CASE WHEN round_even(sum(forecast_amount), 2) > 0 THEN 'inflow' ELSE 'outflow' END AS flow_direction,
       abs(round_even(sum(forecast_amount), 2)) AS abs_total
FROM active_events GROUP BY source_module""")
block("re_summary", """
SELECT lever, priority, count(*) AS recommendations, round_even(sum(cash_impact), 2) AS cash_impact
FROM recommendations GROUP BY GROUPING SETS ((lever), (priority))""")
block("re_prioritised", """
SELECT c.invoice_id, c.customer_id, c.days_past_due, c.total_score, p.prob_pay_0_30, p.prob_pay_30_60,
       p.prob_pay_60_plus, row_number() OVER (ORDER BY c.total_score DESC, c.invoice_id) AS priority_rank
FROM coll_cand c LEFT JOIN s1_predictions p ON c.invoice_id = p.transaction_id""")
block("qy16", """
SELECT coalesce(i.expected_cash_date, o.expected_cash_date) AS expected_cash_date, coalesce(i.inflow, 0.0) AS inflow,
       coalesce(o.outflow, 0.0) AS outflow
FROM (SELECT expected_cash_date, sum(forecast_amount) AS inflow FROM s5_detail GROUP BY 1) i
FULL OUTER JOIN (SELECT expected_cash_date, abs(sum(forecast_amount)) AS outflow FROM s6_detail GROUP BY 1) o
  ON i.expected_cash_date = o.expected_cash_date""")

# ---------------------------------------------------------------------------
# serving-side lookups
# ---------------------------------------------------------------------------
_CB = ["avg_payment_delay", "median_payment_delay", "late_payment_ratio", "payment_volatility", "dispute_ratio",
       "ptp_kept_ratio", "recent_reminder_velocity", "open_dispute_count", "days_since_last_payment",
       "payment_trend_30d", "days_sales_outstanding", "seasonality_index", "avg_invoice_amount", "invoice_count",
       "non_invoice_payment_count", "advance_payment_ratio"]
_VB = ["avg_payment_cycle_days", "payment_volatility", "discount_capture_ratio", "late_payment_ratio",
       "vendor_chase_frequency", "avg_invoice_amount", "invoice_count", "po_to_bill_lag", "advance_payment_ratio"]
_S1F = (["invoice_amount", "invoice_age_days", "days_past_due", "amount_percentile_customer", "payment_terms_days",
         "dispute_flag", "partial_payment_flag", "partial_payment_amount"] + _CB + ["payment_score", "expected_delay"]
        + ["reminder_count", "call_count", "promise_to_pay_flag", "days_since_last_contact", "ptp_kept_ratio_customer",
           "days_until_ptp", "invoice_amount_bucket_enc", "risk_segment_enc", "escalation_status_enc"])
_S2F = _VB + ["bill_age_days", "days_past_due", "bill_amount", "amount_percentile_vendor", "early_payment_eligible",
              "penalty_accruing", "bill_amount_bucket_enc", "approval_status_enc"]


def _defaults(src: str, cols: list[str]) -> str:
    inner = ", ".join(f"avg({c}) FILTER (WHERE invoice_count > 0) AS a_{c}, avg({c}) AS all_{c}" for c in cols)
    outer = ", ".join(f"round_even(CASE WHEN na > 50 THEN a_{c} ELSE all_{c} END, 3) AS {c}" for c in cols)
    return f"SELECT {outer} FROM (SELECT count(*) FILTER (WHERE invoice_count > 0) AS na, {inner} FROM {src})"


block("qy1_customer", f"SELECT * REPLACE (1.0 AS seasonality_index) FROM ({_defaults('customer_features', _CB)})")
block("qy1_vendor", _defaults("vendor_features", _VB))
block("qy1_scores", """
SELECT round_even(avg(payment_score), 3) AS payment_score, round_even(avg(expected_delay), 3) AS expected_delay,
       'MEDIUM' AS risk_segment FROM payment_scores""")
_BK = "CASE {c} WHEN 'SMALL' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'LARGE' THEN 2 END"
_RK = "CASE {c} WHEN 'LOW' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'HIGH' THEN 2 END"
_EK = "CASE {c} WHEN 'NONE' THEN 0 WHEN 'REMINDER' THEN 1 WHEN 'FORMAL' THEN 2 WHEN 'LEGAL' THEN 3 END"
block("qy2_base", f"""
SELECT i.*, {', '.join('cf.' + c for c in _CB)}, c.reminder_count, c.call_count, c.promise_to_pay_flag,
       c.promise_to_pay_date, c.days_since_last_contact, c.escalation_status, c.ptp_kept_ratio_customer,
       s.payment_score, s.expected_delay, s.risk_segment,
       coalesce({_TERMS_DAYS.format(c='i.payment_terms')}, 30) AS payment_terms_days,
       coalesce(datediff('day', CAST(i.feature_date AS DATE), c.promise_to_pay_date), -1) AS days_until_ptp,
       coalesce({_BK.format(c='i.invoice_amount_bucket')}, 1) AS invoice_amount_bucket_enc,
       coalesce({_RK.format(c='s.risk_segment')}, 1) AS risk_segment_enc,
       coalesce({_EK.format(c='c.escalation_status')}, 0) AS escalation_status_enc
FROM invoice_features i LEFT JOIN customer_features cf ON i.customer_id = cf.customer_id
LEFT JOIN collections_features c ON i.invoice_id = c.invoice_id
LEFT JOIN payment_scores s ON i.customer_id = s.customer_id
WHERE i.invoice_id IN (SELECT invoice_id FROM collections_events)""")
block("qy2", "SELECT invoice_id, " + ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0.0) AS {c}" for c in _S1F)
      + " FROM qy2_base")
block("qy3", "SELECT bill_id, " + ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0.0) AS {c}" for c in _S2F) + f"""
FROM (SELECT b.*, {', '.join('v.' + c for c in _VB if c not in ('payment_volatility', 'late_payment_ratio'))},
             v.payment_volatility, v.late_payment_ratio,
             coalesce({_BK.format(c='b.bill_amount_bucket')}, 1) AS bill_amount_bucket_enc,
             coalesce(CASE b.approval_status WHEN 'PENDING' THEN 0 WHEN 'APPROVED' THEN 1 END, 0) AS approval_status_enc
      FROM bill_features b LEFT JOIN vendor_features v ON b.vendor_id = v.vendor_id
      WHERE b.bill_id IN (SELECT bill_id FROM bills WHERE bill_status IN ('OPEN', 'APPROVED')))""")
block("qy3_risk", "SELECT customer_id, " + ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0.0) AS {c}" for c in _CB)
      + " FROM customer_features WHERE customer_id IN (SELECT customer_id FROM invoice_features WHERE days_past_due > 0)")


def _pct(amount: str, avg: str) -> str:
    return f"CASE WHEN {avg} > 0 THEN round_even(least(1.0, {amount} / ({avg} * 2)), 3) ELSE 0.5 END"


def _bucket(amount: str, avg: str) -> str:
    return (f"CASE WHEN {avg} > 0 THEN CASE WHEN {amount} <= {avg} * 0.5 THEN 0 WHEN {amount} <= {avg} * 1.5 THEN 1 "
            f"ELSE 2 END ELSE 1 END")


_qy4_feat = {c: f"CASE WHEN cf.customer_id IS NOT NULL THEN cf.{c} ELSE d.{c} END" for c in _CB}
_qy4_feat["seasonality_index"] = "CASE WHEN cf.customer_id IS NOT NULL THEN cf.seasonality_index ELSE 1.0 END"
block("qy4_req", """
SELECT milestone_id AS request_id, customer_id, billing_amount AS invoice_amount,
       expected_completion_date AS invoice_date, expected_completion_date + 30 AS due_date, 'NET30' AS payment_terms,
       false AS dispute_flag, 0.0 AS partial_payment_amount FROM project_milestones""")
block("qy4_j", "SELECT r.*, " + ", ".join(f"{v} AS f_{c}" for c, v in _qy4_feat.items()) + """,
       CASE WHEN cf.customer_id IS NOT NULL THEN 'feature_store' ELSE 'global_defaults' END AS customer_source,
       CASE WHEN s.customer_id IS NOT NULL THEN s.payment_score ELSE sd.payment_score END AS f_payment_score,
       CASE WHEN s.customer_id IS NOT NULL THEN s.expected_delay ELSE sd.expected_delay END AS f_expected_delay,
       CASE WHEN s.customer_id IS NOT NULL THEN s.risk_segment ELSE 'MEDIUM' END AS f_risk
FROM qy4_req r LEFT JOIN customer_features cf ON r.customer_id = cf.customer_id
LEFT JOIN payment_scores s ON r.customer_id = s.customer_id, qy1_customer d, qy1_scores sd""")
_qy4_cols = {
    "invoice_amount": "invoice_amount",
    "invoice_age_days": f"datediff('day', invoice_date, {REF})",
    "days_past_due": f"greatest(0, datediff('day', due_date, {REF}))",
    "amount_percentile_customer": _pct("invoice_amount", "f_avg_invoice_amount"),
    "payment_terms_days": _TERMS_DAYS.format(c="payment_terms"),
    "dispute_flag": "CAST(dispute_flag AS INTEGER)",
    "partial_payment_flag": "CASE WHEN partial_payment_amount > 0 THEN 1 ELSE 0 END",
    "partial_payment_amount": "partial_payment_amount",
    **{c: f"f_{c}" for c in _CB},
    "payment_score": "f_payment_score", "expected_delay": "f_expected_delay",
    "reminder_count": "0", "call_count": "0", "promise_to_pay_flag": "0", "days_since_last_contact": "-1",
    "ptp_kept_ratio_customer": "f_ptp_kept_ratio", "days_until_ptp": "-1",
    "invoice_amount_bucket_enc": _bucket("invoice_amount", "f_avg_invoice_amount"),
    "risk_segment_enc": f"coalesce({_RK.format(c='f_risk')}, 1)",
    "escalation_status_enc": "0",
}
block("qy4", "SELECT request_id, customer_source, "
      + ", ".join(f"CAST({_qy4_cols[c]} AS DOUBLE) AS {c}" for c in _S1F) + " FROM qy4_j")
block("qy5_j", """
SELECT p.po_id AS request_id, p.vendor_id, p.po_amount AS bill_amount, p.expected_invoice_date AS bill_date,
       p.expected_invoice_date + 30 AS due_date, 'PENDING' AS approval_status,
       CASE WHEN v.vendor_id IS NOT NULL THEN 'feature_store' ELSE 'global_defaults' END AS vendor_source, """
      + ", ".join(f"CASE WHEN v.vendor_id IS NOT NULL THEN v.{c} ELSE d.{c} END AS f_{c}" for c in _VB) + """
FROM purchase_orders p LEFT JOIN vendor_features v ON p.vendor_id = v.vendor_id, qy1_vendor d""")
_qy5_cols = {
    **{c: f"f_{c}" for c in _VB},
    "bill_age_days": f"datediff('day', bill_date, {REF})",
    "days_past_due": f"greatest(0, datediff('day', due_date, {REF}))",
    "bill_amount": "bill_amount",
    "amount_percentile_vendor": _pct("bill_amount", "f_avg_invoice_amount"),
    "early_payment_eligible": f"CASE WHEN datediff('day', {REF}, due_date) > 0 AND datediff('day', {REF}, due_date) <= 10 "
                              "THEN 1 ELSE 0 END",
    "penalty_accruing": f"CASE WHEN greatest(0, datediff('day', due_date, {REF})) > 0 AND approval_status <> 'PAID' "
                        "THEN 1 ELSE 0 END",
    "bill_amount_bucket_enc": _bucket("bill_amount", "f_avg_invoice_amount"),
    "approval_status_enc": "coalesce(CASE approval_status WHEN 'PENDING' THEN 0 WHEN 'APPROVED' THEN 1 END, 1)",
}
block("qy5", "SELECT request_id, vendor_source, "
      + ", ".join(f"CAST({_qy5_cols[c]} AS DOUBLE) AS {c}" for c in _S2F) + " FROM qy5_j")
_qy6 = {"avg_payment_delay": "c.avg_payment_delay", "median_payment_delay": "c.avg_payment_delay * 0.9",
        "late_payment_ratio": "c.late_payment_ratio", "payment_volatility": "c.payment_volatility",
        "dispute_ratio": "c.dispute_ratio", "ptp_kept_ratio": "c.ptp_kept_ratio",
        "recent_reminder_velocity": "d.recent_reminder_velocity", "open_dispute_count": "0",
        "days_since_last_payment": "d.days_since_last_payment", "payment_trend_30d": "0.0",
        "days_sales_outstanding": "c.days_sales_outstanding", "seasonality_index": "1.0",
        "avg_invoice_amount": "d.avg_invoice_amount", "invoice_count": "c.invoice_count",
        "non_invoice_payment_count": "0", "advance_payment_ratio": "0.0"}
block("qy6", "SELECT c.customer_id AS request_id, " + ", ".join(f"CAST({_qy6[x]} AS DOUBLE) AS {x}" for x in _CB)
      + " FROM customer_features c, qy1_customer d")


def _score(src: str, idc: str, s1: bool) -> str:
    pred = "greatest(0.0, round_even(pred_primary, 1))" if s1 else "round_even(pred_primary, 1)"
    extra = "" if s1 else (", CASE WHEN round_even(pred_primary, 1) > 0 THEN 'LATER than scheduled' "
                           "ELSE 'EARLIER than scheduled' END AS direction")
    return f"""
SELECT {idc} AS id, {pred} AS prediction, round_even(pred_baseline, 1) AS baseline_prediction,
       CASE WHEN abs(pred_primary - pred_baseline) <> 0 THEN round_even(abs(pred_primary - pred_baseline), 2) END
         AS model_divergence,
       CASE WHEN pred_baseline IS NULL THEN 'UNKNOWN' WHEN abs(pred_primary - pred_baseline) < 3 THEN 'HIGH'
            WHEN abs(pred_primary - pred_baseline) < 7 THEN 'MEDIUM' ELSE 'LOW' END AS confidence{extra}
FROM {src}"""


block("qy7", _score("ar_scored", "invoice_id", True))
block("qy7_s2", _score("ap_scored", "bill_id", False))
_LBL = "CASE {c} WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' ELSE 'UNKNOWN' END"
block("qy8", f"""
SELECT customer_id, {_LBL.format(c='prediction')} AS risk_segment, {_LBL.format(c='baseline_class')} AS baseline_segment,
       round_even(prob_0, 4) AS prob_LOW, round_even(prob_1, 4) AS prob_MEDIUM, round_even(prob_2, 4) AS prob_HIGH,
       round_even(greatest(prob_0, prob_1, prob_2), 4) AS max_probability,
       CASE WHEN greatest(prob_0, prob_1, prob_2) >= 0.7 THEN 'HIGH'
            WHEN greatest(prob_0, prob_1, prob_2) >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
       {_LBL.format(c='prediction')} = {_LBL.format(c='baseline_class')} AS model_agreement
FROM risk_eval""")
block("qy9_projects", """
SELECT project_id, (SELECT count(DISTINCT project_id) FROM s3_detail) AS count
FROM (SELECT DISTINCT project_id FROM s3_detail) ORDER BY project_id LIMIT 50""")
block("qy9_deals", """
SELECT opportunity_id, (SELECT count(DISTINCT opportunity_id) FROM s4_detail) AS count
FROM (SELECT DISTINCT opportunity_id FROM s4_detail) ORDER BY opportunity_id LIMIT 50""")
block("qy9_invoices", """
SELECT invoice_id, (SELECT count(*) FROM invoices) AS count FROM invoices ORDER BY invoice_id LIMIT 50""")
block("qy10", """
SELECT project_id, min(customer_id) AS customer_id, min(project_type) AS project_type, count(*) AS milestones,
       round_even(sum(forecast_amount), 2) AS total_forecast, min(expected_cash_date) AS first_cash_date,
       max(expected_cash_date) AS last_cash_date FROM s3_detail GROUP BY project_id""")
block("qy11", """
SELECT opportunity_id, min(customer_id) AS customer_id, min(deal_value) AS deal_value, min(crm_stage) AS crm_stage,
       min(stage_probability) AS stage_probability, count(*) AS milestones,
       round_even(sum(forecast_amount), 2) AS total_weighted_forecast, min(expected_cash_date) AS first_cash_date,
       max(expected_cash_date) AS last_cash_date FROM s4_detail GROUP BY opportunity_id""")
block("qy13", "SELECT 'S5' AS module, * FROM s5_breakdown UNION ALL SELECT 'S6' AS module, * FROM s6_breakdown")
block("qy14", """
SELECT source_module, count(*) AS total_events, count(*) FILTER (WHERE NOT suppressed) AS active_events,
       count(*) FILTER (WHERE suppressed) AS suppressed_events,
       round_even(sum(forecast_amount) FILTER (WHERE NOT suppressed), 2) AS active_amount
FROM event_store GROUP BY source_module""")
block("qy15", """
SELECT count(*) AS total_recommendations, round_even(sum(cash_impact), 2) AS total_cash_impact,
       count(*) FILTER (WHERE priority = 'HIGH') AS high_priority,
       count(*) FILTER (WHERE lever = 'COLLECTIONS') AS collections,
       count(*) FILTER (WHERE lever = 'VENDOR_DEFERRAL') AS vendor_deferrals,
       count(*) FILTER (WHERE lever = 'EXPENSE_DEFERRAL') AS expense_deferrals FROM recommendations""")
block("qy17", "SELECT * FROM me1")


def _prof(name: str, src: str, ent: str, amt: str, dt: str) -> str:
    return (f"SELECT '{name}' AS module, count(*) AS records, count(DISTINCT {ent}) AS entities, "
            f"round_even(sum({amt}), 2) AS total_amount, min({dt}) AS first_date, max({dt}) AS last_date FROM {src}")


block("qy19", "\nUNION ALL\n".join([
    _prof("S3", "s3_detail", "project_id", "forecast_amount", "expected_cash_date"),
    _prof("S4", "s4_detail", "opportunity_id", "forecast_amount", "expected_cash_date"),
    _prof("S5", "s5_detail", "inflow_id", "forecast_amount", "expected_cash_date"),
    _prof("S6", "s6_detail", "expense_id", "forecast_amount", "expected_cash_date"),
    _prof("invoices", "invoices", "customer_id", "invoice_amount", "invoice_date")]))

# ---------------------------------------------------------------------------
# training-frame steps
# ---------------------------------------------------------------------------
block("s1_frame", f"""
SELECT i.*, {', '.join('cf.' + c for c in _CB)}, c.reminder_count, c.call_count, c.promise_to_pay_flag,
       c.promise_to_pay_date, c.days_since_last_contact, c.escalation_status, c.ptp_kept_ratio_customer,
       s.payment_score, s.expected_delay, s.risk_segment,
       coalesce({_TERMS_DAYS.format(c='i.payment_terms')}, 30) AS payment_terms_days,
       coalesce(datediff('day', CAST(i.feature_date AS DATE), c.promise_to_pay_date), -1) AS days_until_ptp
FROM invoice_features i LEFT JOIN customer_features cf ON i.customer_id = cf.customer_id
LEFT JOIN collections_features c ON i.invoice_id = c.invoice_id
LEFT JOIN payment_scores s ON i.customer_id = s.customer_id""")
block("s1_encoded", f"""
SELECT * REPLACE (CAST(dispute_flag AS INTEGER) AS dispute_flag, CAST(partial_payment_flag AS INTEGER) AS partial_payment_flag,
                  CAST(promise_to_pay_flag AS INTEGER) AS promise_to_pay_flag),
       coalesce({_BK.format(c='invoice_amount_bucket')}, 1) AS invoice_amount_bucket_enc,
       coalesce({_RK.format(c='risk_segment')}, 1) AS risk_segment_enc,
       coalesce({_EK.format(c='escalation_status')}, 2) AS escalation_status_enc
FROM s1_frame""")
block("s1_design", "SELECT invoice_id, " + ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0.0) AS {c}" for c in _S1F)
      + " FROM s1_encoded")
block("s2_frame", f"""
SELECT b.*, {', '.join('v.' + c for c in _VB if c not in ('payment_volatility', 'late_payment_ratio', 'avg_invoice_amount', 'invoice_count'))},
       coalesce({_TERMS_DAYS.format(c='vd.payment_terms')}, 30) AS payment_terms_days, r.bill_date, r.due_date, r.bill_status
FROM bill_features b LEFT JOIN vendor_features v ON b.vendor_id = v.vendor_id
LEFT JOIN vendors vd ON b.vendor_id = vd.vendor_id LEFT JOIN bills r ON b.bill_id = r.bill_id""")

# ---------------------------------------------------------------------------
# streaming (final state)
# ---------------------------------------------------------------------------
block("st1", f"""
SELECT invoice_id, reminder_count, call_count, promise_to_pay_flag, promise_to_pay_date, days_since_last_contact,
       escalation_status FROM collections_features
WHERE invoice_id IN (SELECT invoice_id FROM collections_events)""")
block("st2", """
SELECT CAST(date_trunc('day', event_date) AS DATE) AS day, customer_id, count(*) AS reminders
FROM collections_events WHERE event_type = 'REMINDER' GROUP BY 1, 2""")
