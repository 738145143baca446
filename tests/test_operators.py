"""Micro golden tests for the semantic traps and the custom operators."""
import datetime as dt
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.config import Settings
from ledgerlake.functions.columns import clip, floor_days, half_even, week_label
from ledgerlake.operators import features as fe
from ledgerlake.operators import metrics as me
from ledgerlake.operators import position as po
from ledgerlake.operators.quantiles import exact_quantile
from ledgerlake.operators.ranking import avg_rank_pct, global_position, group_value_ranks
from ledgerlake.plans import registry
from ledgerlake.session import checkpoint_dir
from ledgerlake.sources import files
from ledgerlake.sources.driver import StagedInputs

D = dt.date


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(-3,), (None,), (5,)], "x int")
    got = [r[0] for r in df.select(clip(F.col("x"), lo=0)).collect()]
    assert got == [0, None, 5]


def test_avg_rank_pct_matches_pandas_with_ties_and_skew(spark):
    rng = np.random.default_rng(7)
    g = np.where(rng.random(3000) < 0.4, 1, rng.integers(2, 50, 3000))   # one hot group
    v = rng.integers(0, 40, 3000).astype(float)
    pdf = pd.DataFrame({"g": g, "v": v, "id": range(3000)})
    exp = pdf.groupby("g")["v"].rank(pct=True)
    got = (avg_rank_pct(spark.createDataFrame(pdf), "g", "v", out="p", partitions=7)
           .toPandas().set_index("id").sort_index()["p"])
    assert np.allclose(got.values, exp.values)


def test_global_position_is_a_permutation(spark):
    df = spark.range(0, 5000).withColumn("k", (F.col("id") * 7919) % 5000)
    out = global_position(df, ["k", "id"], partitions=6).toPandas()
    assert sorted(out["_pos"]) == list(range(5000))
    assert (out.sort_values("_pos")["k"].diff().dropna() >= 0).all()


def test_exact_quantile_matches_numpy(spark):
    x = np.random.default_rng(3).normal(size=20001)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    for p in (0.5, 0.95, 0.0, 1.0):
        small = exact_quantile(df.limit(150), "x", p, out="q").collect()[0]["q"]
        assert abs(small - np.quantile(df.limit(150).toPandas()["x"], p)) < 1e-12
        got = exact_quantile(df, "x", p, out="q").collect()[0]["q"]
        assert abs(got - np.quantile(x, p)) < 1e-12


def test_floor_days_vs_datediff(spark):
    df = spark.createDataFrame([(dt.datetime(2001, 7, 29, 16, 5),)], "ts timestamp")
    r = df.select(floor_days(F.lit("2001-08-02").cast("date"), F.col("ts")).alias("f"),
                  F.datediff(F.lit("2001-08-02").cast("date"), F.col("ts")).alias("d")).collect()[0]
    assert (r.f, r.d) == (3, 4)


def test_half_even_like_numpy(spark):
    vals = [0.125, 2.675, 1296.295, 2.5, 3.5, -2.5, 6326.475]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(half_even(F.col("x"), 2)).collect()]
    assert got == [float(np.round(v, 2)) for v in vals]
    got0 = [r[0] for r in df.select(half_even(F.col("x"), 0)).collect()]
    assert got0 == [float(np.round(v)) for v in vals]


def test_week_label_monday_to_sunday(spark):
    df = spark.createDataFrame([(D(2026, 4, 15),), (D(2026, 4, 19),), (D(2026, 4, 20),)], "d date")
    got = [r[0] for r in df.select(week_label(F.col("d"))).collect()]
    assert got == ["2026-04-13/2026-04-19", "2026-04-13/2026-04-19", "2026-04-20/2026-04-26"]


def _po_lag_pairs(pos, bills):
    """The literal theta join (every same-vendor PO x bill pair): quadratic, test reference only."""
    j = pos.select("vendor_id", "po_date").join(bills.select("vendor_id", "bill_date"), "vendor_id")
    lag = F.datediff("bill_date", "po_date")
    return j.filter(lag > 0).groupBy("vendor_id").agg(F.avg(lag).alias("po_to_bill_lag"))


def test_po_lag_linear_rewrite_equals_pairs(spark):
    rng = np.random.default_rng(11)
    base = D(2000, 1, 1)
    pos = pd.DataFrame({"vendor_id": rng.integers(0, 5, 400),
                        "po_date": [base + dt.timedelta(days=int(x)) for x in rng.integers(0, 300, 400)]})
    bills = pd.DataFrame({"vendor_id": rng.integers(0, 6, 500),
                          "bill_date": [base + dt.timedelta(days=int(x)) for x in rng.integers(0, 300, 500)]})
    p, b = spark.createDataFrame(pos), spark.createDataFrame(bills)
    lin = fe.po_to_bill_lag(p, b).toPandas().set_index("vendor_id").sort_index()
    quad = _po_lag_pairs(p, b).toPandas().set_index("vendor_id").sort_index()
    assert list(lin.index) == list(quad.index)
    assert np.allclose(lin["po_to_bill_lag"], quad["po_to_bill_lag"])


def _events(spark, rows):
    return spark.createDataFrame(rows, "forecast_id string, source_module string, forecast_type string, "
                                       "target_date date, forecast_amount double")


def test_dedup_suppresses_loser_on_shared_date_only(spark):
    cfg = Settings()
    d1, d2 = D(2001, 8, 5), D(2001, 8, 6)
    src = {
        "S1": _events(spark, [("a", "S1", "AR", d1, 100.0)]),
        "S4": _events(spark, [("b", "S4", "PIPELINE", d1, 50.0), ("c", "S4", "PIPELINE", d2, 70.0)]),
        "S2": _events(spark, [("d", "S2", "AP", d2, -30.0)]),
        "S6": _events(spark, [("e", "S6", "EXPENSE", d2, -5.0), ("f", "S6", "EXPENSE", d1, -7.0)]),
    }
    ev = po.dedup(po.event_store(src, cfg)).toPandas()
    sup = dict(zip(zip(ev.source_module, ev.target_date), ev.suppression_reason))
    assert sup[("S4", d1)] == "DEDUP_S4_TO_S1" and sup[("S4", d2)] == ""
    assert sup[("S6", d2)] == "DEDUP_S6_TO_S2" and sup[("S6", d1)] == ""
    assert ev.suppressed.sum() == 2


def test_daily_position_dense_calendar_and_running_balance(spark):
    cfg = Settings()
    ref = cfg.reference_date
    ev = _events(spark, [("a", "S5", "INFLOW", ref + dt.timedelta(days=2), 100.0),
                         ("b", "S6", "EXPENSE", ref + dt.timedelta(days=2), -40.0),
                         ("c", "S6", "EXPENSE", ref + dt.timedelta(days=4), -10.0),
                         ("z", "S6", "EXPENSE", ref + dt.timedelta(days=4), 0.0)])
    daily = po.daily_position(po.active(po.source_days(po.event_store({"S5": ev}, cfg))), cfg).toPandas()
    assert len(daily) == 5                                    # ref .. last active date, gaps filled
    assert list(daily.gross_inflow) == [0, 0, 100, 0, 0]
    assert list(daily.gross_outflow) == [0, 0, 40, 0, 10]
    assert daily.cumulative_position.iloc[-1] == cfg.opening_balance + 50
    weekly = po.weekly_position(spark.createDataFrame(daily)).toPandas()
    assert abs(weekly.net_flow.sum() - daily.net_flow.sum()) < 1e-6


def test_single_payment_std_is_zero_and_seasonality_default(spark):
    inv = spark.createDataFrame([(1, 10, D(2001, 1, 1), D(2001, 1, 31), 100.0)],
                                "invoice_id long, customer_id long, invoice_date date, due_date date, invoice_amount double")
    pay = spark.createDataFrame([("AR", 1, D(2001, 2, 10), 100.0)],
                                "reference_type string, reference_id long, payment_date date, payment_amount double")
    ip = fe.invoice_payments(inv, pay)
    stats = fe.customer_payment_stats(ip, Settings()).collect()[0]
    assert stats.payment_volatility == 0.0 and stats.avg_payment_delay == 10.0
    season = fe.seasonality(ip).collect()[0]
    assert season.seasonality_index == 1.0


def test_exact_quantile_with_ties_orders_distinct_values_only(spark):
    df = spark.range(0, 100_000).select((F.col("id") * 7919 % 6).cast("double").alias("x"))
    got = exact_quantile(df, "x", 0.5, out="q")
    assert got.collect()[0]["q"] == np.median(np.arange(100_000) * 7919 % 6)
    assert group_value_ranks(df.withColumn("g", F.lit(0)), "g", "x").count() == 6      # what is ranked: six rows
    assert exact_quantile(df.limit(0), "x", 0.5, out="q").collect()[0]["q"] is None


def test_metrics_do_not_fail_on_zero_error_absent_class_or_empty_input(spark):
    perfect = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0)], "label double, prediction double")
    m = me.regression_metrics(perfect)
    assert tuple(me.compare_models(m, m).first()) == ("RandomForest", 0.0)
    two = spark.createDataFrame([(0, 0.9, 0.1, 0.0), (1, 0.2, 0.8, 0.0), (0, 0.6, 0.4, 0.0), (1, None, 0.7, 0.0)],
                                "label int, prob_0 double, prob_1 double, prob_2 double")
    assert me.auc_ovr_macro(two, {0: "prob_0", 1: "prob_1", 2: "prob_2"}).first()[0] == 1.0
    empty = spark.createDataFrame([], "label int, prediction int")
    assert me.classification_metrics(empty).first()["accuracy"] == 0.0


def test_auc_matches_pair_counting_with_ties(spark):
    rng = np.random.default_rng(5)
    y, s = rng.integers(0, 2, 500), rng.integers(0, 8, 500) / 8
    df = spark.createDataFrame(pd.DataFrame({"label": y, "p": s}))
    pairs = [(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]]
    assert abs(me.auc_ovr_macro(df, {1: "p"}).first()[0] - round(float(np.mean(pairs)), 4)) < 1e-4


def test_long_report_holds_dates_and_names(spark):
    wide = spark.createDataFrame([(1.5, 2, D(2001, 8, 2), "GBT", None)], "a double, b int, c date, d string, e double")
    assert {r.metric: (r.value, r.text) for r in me.long_report(wide).collect()} == {
        "a": (1.5, None), "b": (2.0, None), "c": (None, "2001-08-02"), "d": (None, "GBT"), "e": (None, None)}


def test_source_days_agree_with_event_level_dedup(spark):
    cfg = Settings()
    ref = cfg.reference_date
    rows = [(f"{s}{k}", s, "AP" if s in ("S2", "S6") else "AR", ref + dt.timedelta(days=k % 9), (-1.0 if s in ("S2", "S6") else 1.0) * k)
            for s in ("S1", "S2", "S4", "S6") for k in range(1, 40 if s < "S3" else 60, 2 if s == "S1" else 3)]
    ev = po.event_store({"S": _events(spark, rows)}, cfg)
    marked = po.dedup(ev)
    by_event = {(r[0], r[1], r[2]): r[3] for r in marked.groupBy("source_module", "target_date", "suppressed").count().collect()}
    by_day = {(r[0], r[1], r[2]): r[3] for r in po.source_days(ev).select("source_module", "target_date", "suppressed", "_events").collect()}
    assert by_event == by_day


def test_checkpoint_folder_is_demanded_on_a_cluster():
    class Conf:
        def get(self, *a):
            return None

    class Fake:
        conf = Conf()
        sparkContext = type("C", (), {"master": "local-cluster[2,1,1024]"})
    with pytest.raises(RuntimeError):
        checkpoint_dir(Fake)


def test_inputs_are_staged_on_first_read_only(spark, tmp_path):
    t = StagedInputs(spark, "/root/testdata/sf0.001", str(tmp_path / "a"))
    t["expense_schedule"].count()
    assert os.listdir(tmp_path / "a") == ["expense_schedule"]
    n = t["payments"].count()
    assert sorted(os.listdir(tmp_path / "a")) == ["bills", "expense_schedule", "payments"] and n > 0


def test_equal_base_names_do_not_meet(spark, tmp_path):
    import shutil
    for k, rows in (("a", 5), ("b", 7)):
        shutil.copytree("/root/testdata/sf0.001", tmp_path / k / "sf", copy_function=shutil.copyfile)
        (tmp_path / k / "sf").chmod(0o755)
        spark.read.parquet("/root/testdata/sf0.001/customer.parquet").limit(rows).toPandas().to_parquet(tmp_path / k / "sf/customer.parquet")
    frames = [registry.tables(spark, str(tmp_path / k / "sf"))["customers"] for k in ("a", "b")]
    assert [f.count() for f in frames] == [5, 7]


@pytest.mark.parametrize("table", ["payments", "bills"])
def test_malformed_csv_dates_become_null(spark, tmp_path, table):
    col = files.DATE_COLUMNS[table][0]
    (tmp_path / "x.csv").write_text(f"{col}\n2001-01-31\n2001-02-30\nsoon\n\n")
    got = files.read_raw_csv(spark, str(tmp_path / "x.csv"), T.StructType([T.StructField(col, T.DateType())]), table)
    assert [r[0] for r in got.collect()] == [D(2001, 1, 31), None, None]


def test_feature_dates_stay_side_by_side(spark, tmp_path):
    path = str(tmp_path / "features")
    first = spark.createDataFrame([(1, "a", "2001-08-01"), (2, "b", "2001-08-01")], "id long, x string, feature_date string")
    second = spark.createDataFrame([(1, "c", "2001-08-02")], first.schema)
    again = spark.createDataFrame([(3, "d", "2001-08-01")], first.schema)
    for df in (first, second, again):
        files.write_dated(df, path, "feature_date")
    got = {(r.id, r.x, str(r.feature_date)) for r in spark.read.parquet(path).collect()}
    assert got == {(1, "c", "2001-08-02"), (3, "d", "2001-08-01")}
    files.write_dated(first.filter("false"), path, "feature_date")
    assert spark.read.parquet(path).count() == 2


def test_two_reference_dates_of_the_job(spark, tmp_path):
    import datetime as dt
    from dataclasses import replace
    from ledgerlake.config import DEFAULT
    from ledgerlake.plans.jobs import publish_features
    from ledgerlake.plans.pipeline import Pipeline
    t = StagedInputs(spark, "/root/testdata/sf0.001", str(tmp_path / "in"))
    n = {}
    for day in (DEFAULT.reference_date, DEFAULT.reference_date + dt.timedelta(days=1)):
        p = Pipeline(t, replace(DEFAULT, reference_date=day), predictions="pseudo")
        out = publish_features(p, str(tmp_path / "out"))
        n[str(day)] = p.invoice_features.count()
    got = spark.read.parquet(out["invoice_features"]).groupBy("feature_date").count().collect()
    assert {str(r["feature_date"]): r["count"] for r in got} == n and len(n) == 2
