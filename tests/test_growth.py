"""What the ranks, the payments' readers and the S1 frame write and shuffle, and that their rows stay."""
import os

from pyspark.sql import functions as F

from ledgerlake.operators.ranking import group_value_ranks
from ledgerlake.session import run_dir


def _tables(spark):
    at = f"{run_dir(spark)}/tables"
    return set(os.listdir(at)) if os.path.isdir(at) else set()


def test_ranks_write_one_table_and_groups_may_span_partitions(spark):
    rows = [(1, float(i % 50)) for i in range(400)] + [(g, float(g)) for g in range(2, 60)] + [(None, 1.0), (7, None)]
    before = _tables(spark)
    r = group_value_ranks(spark.createDataFrame(rows, "g int, v double"), "g", "v", partitions=9)
    assert len(_tables(spark) - before) == 1                 # the ranked pairs; the pairs themselves are not written before
    got = {(x.g, x.v): (x._less, x._eq, x._n, x._sum) for x in r.collect()}
    vals = {}
    for g, v in rows:
        if g is not None and v is not None:
            vals.setdefault(g, []).append(v)
    assert got == {(g, v): (sum(y < v for y in x), x.count(v), len(x), sum(x)) for g, x in vals.items() for v in x}


def test_ranks_of_text_values(spark):
    df = spark.createDataFrame([(0, "b"), (0, "a"), (0, "b"), (1, "c")], "g int, v string").withColumn("v", F.concat("v", F.lit("x")))
    got = {(r.g, r.v): (r._less, r._eq, r._n) for r in group_value_ranks(df, "g", "v", partitions=3).collect()}
    assert got == {(0, "ax"): (0, 1, 3), (0, "bx"): (1, 2, 3), (1, "cx"): (0, 1, 1)}


def test_customer_payments_stage_no_bills(spark, tmp_path):
    from ledgerlake.operators import features as fe
    from ledgerlake.sources.driver import StagedInputs
    t = StagedInputs(spark, "/root/testdata/sf0.001", str(tmp_path / "in"))
    fe.customer_delays(t).count()
    assert not {"bills", "payments"} & set(os.listdir(tmp_path / "in"))
    parts = {k: fe.payments_of(t, k) for k in ("AR", "AP")}
    assert "payments" not in os.listdir(tmp_path / "in")     # a kind is a projection of its documents, not written again
    for k, part in parts.items():                            # the same rows as the whole table's
        whole = t["payments"].filter(F.col("reference_type") == k)
        assert part.columns == whole.columns and part.count() == whole.count() > 0
        assert part.exceptAll(whole).count() == 0
    plain = {"payments": t["payments"]}
    assert fe.payments_of(plain, "AP").count() == parts["AP"].count()


def test_s1_frame_joins_customers_once_and_keeps_repeated_and_null_keys(spark):
    from ledgerlake.operators.training import s1_training_frame
    inv = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 3), (5, 9), (6, None), (7, 4)], "invoice_id int, customer_id int") \
        .withColumn("payment_terms", F.lit("NET15")).withColumn("feature_date", F.lit("2001-01-01"))
    cf = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 3.0), (3, 4.0), (None, 5.0)], "customer_id int, late double")
    sc = spark.createDataFrame([(1, .5), (1, .6), (3, .7), (4, .8), (None, .9)], "customer_id int, payment_score double") \
        .withColumn("expected_delay", F.lit(1.0)).withColumn("risk_segment", F.lit("LOW"))
    co = spark.createDataFrame([(1, 2), (3, 1), (3, 4), (None, 7)], "invoice_id int, reminder_count int") \
        .withColumn("promise_to_pay_date", F.lit(None).cast("date"))
    got = s1_training_frame(inv, cf, co, sc)
    assert "full" in got._jdf.queryExecution().analyzed().toString().lower()      # scores meet the features, not the wide frame
    want = inv.join(cf, "customer_id", "left").join(co, "invoice_id", "left").join(sc, "customer_id", "left")
    names = ["invoice_id", "customer_id", "late", "reminder_count", "payment_score", "risk_segment"]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, got.select(*names).collect())) == sorted(map(key, want.select(*names).collect()))
    assert set(got.columns) == {*want.columns, "payment_terms_days", "days_until_ptp"} and len(got.columns) == len(set(got.columns))
