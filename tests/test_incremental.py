"""Payment features from merged loads against the full rebuild."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerlake.config import DEFAULT as CFG
from ledgerlake.operators import features as fe
from ledgerlake.operators import incremental as inc


@pytest.fixture(scope="module")
def ledger(spark):
    """40 customers, one with a third of the invoices; up to three payments an invoice, some without date or invoice."""
    ref = F.lit(str(CFG.reference_date)).cast("date")
    h = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    inv = (spark.range(3000).withColumn("invoice_id", F.col("id")).withColumn("customer_id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 40).cast("long"))
           .withColumn("invoice_date", F.when(F.col("id") % 50 != 0, F.date_sub(ref, h(1, 600) + 5)))
           .withColumn("due_date", F.date_add("invoice_date", 30))
           .withColumn("invoice_amount", F.when(F.col("id") % 9 != 0, h(2, 100000) / 100.0)).drop("id"))
    pay = (spark.range(7000).withColumn("reference_type", F.when(F.col("id") % 10 == 0, "AP").otherwise("AR"))
           .withColumn("reference_id", (F.col("id") * 7 % 3100)).withColumn("payment_date", F.when(F.col("id") % 40 != 1, F.date_sub(ref, h(3, 500))))
           .withColumn("payment_amount", h(4, 5000) / 10.0))
    return inv.cache(), pay.cache()


def _rows(df):
    cols = sorted(df.columns)
    return {r["customer_id"]: {c: r[c] for c in cols} for r in df.select(*cols).collect()}


def _same(got, want):
    a, b = _rows(got), _rows(want)
    assert set(a) == set(b)
    for k in a:
        for c, x in b[k].items():
            assert a[k][c] == (pytest.approx(x, abs=1e-6) if isinstance(x, float) else x), (k, c)


def test_loads_equal_the_full_rebuild(spark, ledger, tmp_path):
    inv, pay = ledger
    want = fe.customer_payment_stats(fe.invoice_payments(inv, pay), CFG)
    for load in ("a", "b", "c", "b", "c"):                       # arbitrary loads; two of them run again
        n = "abc".index(load)
        states = inc.add_load(spark, f"{tmp_path}/s", inv, pay.filter(F.col("id") % 3 == n), load)
    _same(inc.customer_payment_stats(states, CFG), want)
    small = inc.compact(states, str(CFG.reference_date - dt.timedelta(31)))
    assert small.count() < states.count()
    _same(inc.customer_payment_stats(small, CFG), want)
    assert small.agg(F.sum("n")).first()[0] == states.agg(F.sum("n")).first()[0]


def test_a_corrected_last_load_replaces_its_rows(spark, ledger, tmp_path):
    inv, pay = ledger
    root = f"{tmp_path}/s"
    inc.add_load(spark, root, inv, pay.filter("id % 2 = 0"), "1")
    inc.add_load(spark, root, inv, pay.filter("id % 2 = 1"), "2")
    states = inc.add_load(spark, root, inv, pay.filter("id % 4 = 1"), "2")          # half of its payments withdrawn
    _same(inc.customer_payment_stats(states, CFG), fe.customer_payment_stats(fe.invoice_payments(inv, pay.filter("id % 4 IN (0, 1, 2)")), CFG))


def test_empty_loads(spark, ledger, tmp_path):
    inv, pay = ledger
    root = f"{tmp_path}/s"
    assert inc.add_load(spark, root, inv, pay.limit(0), "0").count() == 0
    states = inc.add_load(spark, root, inv, pay, "1")
    inc.add_load(spark, root, inv, pay.filter("id < 50"), "2")
    inc.add_load(spark, root, inv, pay.limit(0), "2")                               # runs again without rows: its old ones go
    states = inc.add_load(spark, root, inv, pay.limit(0), "3")
    _same(inc.customer_payment_stats(states, CFG), fe.customer_payment_stats(fe.invoice_payments(inv, pay), CFG))
