"""Finance input tables derived from the driver's star-schema Parquet files.

The driver ships TPC-H-like tables; each finance input (customers, invoices,
payments, ...) is a pure projection/aggregation of them.  All columns are
computed with built-in expressions, so Catalyst prunes the scans to the
columns each downstream query needs and pushes filters into Parquet.
"""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
)

# fixed values of the fixture mapping
TERMS_BY_MOD6 = ("NET15", "NET30", "NET45", "NET60", "NET90", "COD")
DAYS_BY_MOD6 = (15, 30, 45, 60, 90, 30)
BILL_STATUS_BY_MOD5 = ("OPEN", "APPROVED", "DEFERRED", "PAID", "PAID")
NIP_TYPE_BY_MOD3 = ("ADVANCE", "RETAINER", "REFUND")
STAGE_BY_MOD7 = ("Prospecting", "Qualification", "Proposal", "Negotiation",
                 "Verbal Commit", "Closed Won", "Discovery")
INFLOW_CATEGORY_BY_MOD3 = ("Loan", "Grant", "Tax Refund")
APPROVAL_BY_MOD5 = ("COMMITTED", "APPROVED", "PENDING", "CONTINGENT", "UNKNOWN")
EXPENSE_CATEGORY_BY_MOD7 = ("Salary", "Statutory Tax", "Renewal", "PO-based", "Seasonal", "One-time", "Other")
RECURRENCE_BY_MOD3 = ("MONTHLY", "QUARTERLY", "ONE_TIME")
EVENT_SHIFT_DAYS = 8219


def _pick(values, idx):
    """values[idx] for a small literal list, as a CASE expression."""
    expr = None
    for i, v in enumerate(values):
        expr = F.when(idx == i, F.lit(v)) if expr is None else expr.when(idx == i, F.lit(v))
    return expr


def read_driver(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in DRIVER_TABLES}


def _add_days(d, n):
    return F.date_add(d, n.cast("int"))


def collections_from(events: DataFrame, orders: DataFrame) -> DataFrame:
    """Collections event log from the driver's event stream (works on a batch or a streaming ``events``)."""
    shifted = F.col("ts") - F.expr(f"INTERVAL {EVENT_SHIFT_DAYS} DAYS")
    ev_type = (F.when(F.col("event_type") == "click", "REMINDER")
               .when(F.col("event_type") == "view", "CALL")
               .when(F.col("event_type") == "signup", "PTP")
               .when(F.col("event_type") == "error", "DISPUTE")
               .when(F.col("event_type") == "purchase",
                     F.when(F.col("value") > 100, "ESCALATION")
                     .when(F.col("value") > 50, "INVOICE_VIEWED")
                     .otherwise("PARTIAL_PAYMENT")))
    return events.join(
        orders.select("o_orderkey", "o_custkey", "o_orderdate"),
        F.floor(F.col("event_id") / 4) == F.col("o_orderkey"),
    ).select(
        F.col("event_id"),
        F.col("o_orderkey").alias("invoice_id"),
        F.col("o_custkey").alias("customer_id"),
        ev_type.alias("event_type"),
        shifted.alias("event_date"),
        F.when(F.col("event_type") == "signup",
               _add_days(F.to_date("o_orderdate"), F.lit(10) + F.col("event_id") % 80)).alias("promise_to_pay_date"),
    )


def ar_payments_from(invoices: DataFrame) -> DataFrame:
    """Customer payments of the given invoices."""
    paid_inv = invoices.filter(F.col("invoice_status").isin("PAID", "PARTIAL"))
    ar_first = paid_inv.select(
        F.concat(F.lit("AR-"), F.col("invoice_id").cast("string"), F.lit("-1")).alias("payment_id"),
        F.lit("AR").alias("reference_type"),
        F.col("invoice_id").alias("reference_id"),
        _add_days(F.col("invoice_date"),
                  F.lit(5) + (F.col("invoice_id") * 37 + F.col("customer_id") * 11)
                  % (F.lit(20) + (F.col("customer_id") % 7) * 15)).alias("payment_date"),
        F.when(F.col("invoice_status") == "PARTIAL", F.col("invoice_amount") * 0.5)
        .otherwise(F.col("invoice_amount")).alias("payment_amount"),
    )
    ar_second = invoices.filter((F.col("invoice_status") == "PARTIAL") & (F.col("invoice_id") % 2 == 0)).select(
        F.concat(F.lit("AR-"), F.col("invoice_id").cast("string"), F.lit("-2")).alias("payment_id"),
        F.lit("AR").alias("reference_type"),
        F.col("invoice_id").alias("reference_id"),
        _add_days(F.col("invoice_date"), F.lit(35) + (F.col("invoice_id") * 17) % 60).alias("payment_date"),
        (F.col("invoice_amount") * 0.25).alias("payment_amount"),
    )
    return ar_first.unionByName(ar_second)


def ap_payments_from(bills: DataFrame) -> DataFrame:
    """Vendor payments of the given bills."""
    return bills.filter(F.col("bill_status").isin("PAID", "DEFERRED")).select(
        F.concat(F.lit("AP-"), F.col("bill_id").cast("string")).alias("payment_id"),
        F.lit("AP").alias("reference_type"),
        F.col("bill_id").alias("reference_id"),
        _add_days(F.col("bill_date"),
                  F.lit(10) + (F.col("bill_id") * 29) % (F.lit(20) + (F.col("vendor_id") % 5) * 25)).alias("payment_date"),
        F.col("bill_amount").alias("payment_amount"),
    )


def payments_from(invoices: DataFrame, bills: DataFrame) -> DataFrame:
    """Customer and vendor payments of the given documents."""
    return ar_payments_from(invoices).unionByName(ap_payments_from(bills))


def finance_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All twelve raw finance inputs, lazily defined over the driver tables."""
    t = read_driver(spark, sf_dir)
    customer, supplier, part, orders, lineitem, events = (
        t["customer"], t["supplier"], t["part"], t["orders"], t["lineitem"], t["events"])

    # one-row scalars, attached with a broadcast cross join (size is exactly 1 row)
    n_cust = F.broadcast(customer.agg(F.count(F.lit(1)).alias("n_cust")))
    n_supp = F.broadcast(supplier.agg(F.count(F.lit(1)).alias("n_supp")))

    customers = customer.select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_name").alias("customer_name"),
        F.col("c_mktsegment").alias("industry"),
        _pick(TERMS_BY_MOD6, F.col("c_custkey") % 6).alias("credit_terms"),
    )

    inv_date = F.to_date(F.col("o_orderdate"))
    invoices = orders.select(
        F.col("o_orderkey").alias("invoice_id"),
        F.col("o_custkey").alias("customer_id"),
        inv_date.alias("invoice_date"),
        _add_days(inv_date, _pick(DAYS_BY_MOD6, F.col("o_custkey") % 6)).alias("due_date"),
        F.col("o_totalprice").alias("invoice_amount"),
        (F.col("o_orderkey") % 13 == 0).alias("dispute_flag"),
        F.when((F.col("o_orderkey") % 13 == 0) & (F.col("o_orderstatus") != "F"), "DISPUTED")
        .when(F.col("o_orderstatus") == "O", "OPEN")
        .when(F.col("o_orderstatus") == "P", "PARTIAL")
        .when(F.col("o_orderstatus") == "F", "PAID").alias("invoice_status"),
    )

    vendors = supplier.select(
        F.col("s_suppkey").alias("vendor_id"),
        F.col("s_name").alias("vendor_name"),
        _pick(TERMS_BY_MOD6, F.col("s_suppkey") % 6).alias("payment_terms"),
    )

    bill_date = F.to_date(F.min("l_shipdate"))
    bills = (
        lineitem.groupBy("l_orderkey", "l_suppkey")
        .agg(bill_date.alias("bill_date"),
             F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("bill_amount"))
        .select(
            (F.col("l_orderkey") * 100000 + F.col("l_suppkey")).alias("bill_id"),
            F.col("l_suppkey").alias("vendor_id"),
            F.col("bill_date"),
            _add_days(F.col("bill_date"), _pick(DAYS_BY_MOD6, F.col("l_suppkey") % 6)).alias("due_date"),
            F.col("bill_amount"),
            _pick(BILL_STATUS_BY_MOD5, (F.col("l_orderkey") + F.col("l_suppkey")) % 5).alias("bill_status"),
        )
    )

    payments = payments_from(invoices, bills)

    shifted = F.col("ts") - F.expr(f"INTERVAL {EVENT_SHIFT_DAYS} DAYS")
    collections_events = collections_from(events, orders)

    even = F.col("event_id") % 2 == 0
    non_invoice_payments = events.filter(F.col("event_type").isin("click", "view")).crossJoin(n_cust).crossJoin(n_supp).select(
        F.col("event_id").alias("payment_id"),
        F.when(even, F.col("event_id") % F.col("n_cust")).otherwise(F.col("event_id") % F.col("n_supp")).alias("party_id"),
        F.when(even, "CUSTOMER").otherwise("VENDOR").alias("party_type"),
        _pick(NIP_TYPE_BY_MOD3, F.col("event_id") % 3).alias("payment_type"),
        F.when(F.col("event_id") % 5 == 0, "OUTFLOW").otherwise("INFLOW").alias("direction"),
        (F.col("value") * 100).alias("amount"),
        F.to_date(shifted).alias("payment_date"),
    )

    po_date = F.date_add(F.lit("1998-01-01").cast("date"), (F.col("p_partkey") * 17 % 1000).cast("int"))
    purchase_orders = part.crossJoin(n_supp).select(
        F.col("p_partkey").alias("po_id"),
        (F.col("p_partkey") % F.col("n_supp")).alias("vendor_id"),
        po_date.alias("po_date"),
        F.date_add(po_date, 30).alias("expected_invoice_date"),
        F.col("p_retailprice").alias("po_amount"),
        F.col("p_brand").alias("po_category"),
    )

    pct_num = F.col("p_partkey") * 11 % 21
    project_milestones = part.crossJoin(n_cust).select(
        F.floor(F.col("p_partkey") / 4).alias("project_id"),
        F.col("p_partkey").alias("milestone_id"),
        (F.col("p_partkey") % (F.col("n_cust") + 10)).alias("customer_id"),
        F.col("p_type").alias("project_type"),
        F.col("p_name").alias("milestone_name"),
        F.when(F.col("p_partkey") % 20 < 4, "ON_HOLD").otherwise("ACTIVE").alias("project_status"),
        F.when(pct_num == 20, "COMPLETE").when(pct_num == 0, "NOT_STARTED").otherwise("IN_PROGRESS").alias("completion_status"),
        (pct_num.cast("double") / 20).alias("completion_pct"),
        F.date_add(F.lit("2001-07-13").cast("date"), (F.col("p_partkey") * 13 % 80).cast("int")).alias("expected_completion_date"),
        (F.col("p_partkey") % 6 != 0).alias("billing_trigger"),
        F.col("p_retailprice").alias("billing_amount"),
    )

    crm_pipeline = orders.filter(F.col("o_orderstatus") == "O").select(
        F.col("o_orderkey").alias("opportunity_id"),
        F.col("o_custkey").alias("customer_id"),
        _pick(STAGE_BY_MOD7, F.col("o_orderkey") % 7).alias("crm_stage"),
        F.lit(0.35).alias("stage_probability"),
        F.col("o_totalprice").alias("deal_value"),
        F.col("o_orderpriority").alias("deal_type"),
        F.when(F.col("o_totalprice") < 100000, "SMALL").when(F.col("o_totalprice") < 300000, "MEDIUM")
        .otherwise("LARGE").alias("deal_size_band"),
        F.date_add(F.lit("2001-06-03").cast("date"), (F.col("o_orderkey") * 31 % 200).cast("int")).alias("expected_close_date"),
    )

    contingent_inflows = events.filter(F.col("event_type").isin("purchase", "signup")).select(
        F.col("event_id").alias("inflow_id"),
        _pick(INFLOW_CATEGORY_BY_MOD3, F.col("event_id") % 3).alias("category"),
        (F.col("value") * 100).alias("amount"),
        F.date_add(F.lit("2001-07-23").cast("date"), (F.col("event_id") * 3 % 220).cast("int")).alias("expected_receipt_date"),
        F.when(F.col("event_id") % 7 == 0, F.lit(None).cast("int"))
        .otherwise((F.col("event_id") % 15).cast("int")).alias("hist_receipt_lag_days"),
        _pick(APPROVAL_BY_MOD5, F.col("event_id") % 5).alias("approval_status"),
        F.concat(F.lit("EV-"), F.col("event_id").cast("string")).alias("source_document_ref"),
    )

    expense_schedule = events.filter(F.col("event_type").isin("view", "error")).select(
        F.col("event_id").alias("expense_id"),
        _pick(EXPENSE_CATEGORY_BY_MOD7, F.col("event_id") % 7).alias("category"),
        _pick(RECURRENCE_BY_MOD3, F.col("event_id") % 3).alias("recurrence_type"),
        (F.col("value") * 100).alias("amount"),
        F.date_add(F.lit("2001-07-23").cast("date"), (F.col("event_id") * 7 % 220).cast("int")).alias("obligation_date"),
        F.when(F.col("event_id") % 11 == 0, F.lit(None).cast("int"))
        .otherwise((F.col("event_id") % 10).cast("int")).alias("payment_lag_days"),
        F.concat(F.lit("EV-"), F.col("event_id").cast("string")).alias("source_document_ref"),
    )

    return {
        "customers": customers, "invoices": invoices, "payments": payments,
        "collections_events": collections_events, "non_invoice_payments": non_invoice_payments,
        "vendors": vendors, "bills": bills, "purchase_orders": purchase_orders,
        "project_milestones": project_milestones, "crm_pipeline": crm_pipeline,
        "contingent_inflows": contingent_inflows, "expense_schedule": expense_schedule,
    }


class StagedInputs(Mapping):
    """The twelve finance inputs by name, each written once as Parquet under ``root`` when it is first read.

    Downstream jobs then start from real input tables (as they would in production) instead of re-deriving every
    input from the driver tables in each plan; a query stages the inputs it reads and no others.  The payments are
    derived from the staged bills, so the largest aggregate runs once.  Readers of one kind of payments take ``payments_of``:
    a payment is a projection of its document, so neither kind is written again, nor are bills made for customer payments."""

    def __init__(self, spark: SparkSession, sf_dir: str, root: str):
        self.spark, self.root = spark, root
        self.lazy, self.staged = finance_tables(spark, sf_dir), {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.staged:
            df = self.lazy[name]
            if name == "payments":
                df = payments_from(self.lazy["invoices"], self["bills"])
            df.write.mode("overwrite").parquet(f"{self.root}/{name}")
            self.staged[name] = self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")
        return self.staged[name]

    def payments_of(self, kind: str) -> DataFrame:
        """The payments whose ``reference_type`` is ``kind`` (AR or AP), row by row from their documents."""
        return {"AR": lambda: ar_payments_from(self.lazy["invoices"]), "AP": lambda: ap_payments_from(self["bills"])}[kind]()

    def __iter__(self):
        return iter(self.lazy)

    def __len__(self):
        return len(self.lazy)
