"""Daily sketches: merged windows against exact answers, incremental days, set algebra below and beyond the capacity."""
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import sketches as sk
from ledgerlake.operators.quantiles import exact_quantile
from ledgerlake.sources import files

D0 = dt.date(2001, 1, 1)
WINDOWS = {7: ("2001-01-04", "2001-01-10"), 0: (None, None), 99: ("2030-01-01", None)}
PS = [0.1, 0.5, 0.95]


@pytest.fixture(scope="module")
def ledger(spark):
    """60,000 rows over ten days; one day holds half of them, values with and without ties, some nulls."""
    return (spark.range(60_000).withColumn("day", F.date_add(F.lit(D0), F.when(F.col("id") % 2 == 0, 3).otherwise(F.col("id") % 10).cast("int")))
            .withColumn("value", F.when(F.col("id") % 101 == 0, None).otherwise(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 7.0))
            .withColumn("tied", F.pmod(F.xxhash64("id"), F.lit(5)).cast("double")))


@pytest.mark.parametrize("value", ["value", "tied"])
def test_merged_windows_keep_the_stated_rank_error(spark, ledger, value):
    daily = sk.daily_quantiles(ledger, "day", value)
    ranks = sk.window_value_ranks(ledger, "day", value, WINDOWS)
    got = sk.measured_rank_error(sk.window_quantiles(daily, WINDOWS, PS), ranks).collect()
    pdf = ledger.select("day", value).toPandas().dropna()
    assert {r.span for r in got} == {7, 0}                      # a window without rows is not returned
    for r in got:
        x = pdf if r.span == 0 else pdf[(pdf.day >= dt.date(2001, 1, 4)) & (pdf.day <= dt.date(2001, 1, 10))]
        assert r.n == len(x)
        assert r.rank_error <= 2 * sk.rank_error()
        lo, hi = (x[value] < r.quantile).mean(), (x[value] <= r.quantile).mean()
        assert r.rank_error == pytest.approx(max(lo - r.p, r.p - hi, 0.0))


def test_exact_window_quantiles_are_those_of_numpy(spark, ledger):
    ranks = sk.window_value_ranks(ledger, "day", "value", WINDOWS)
    pdf = ledger.select("value").toPandas().dropna()
    got = {r.p: r.exact for r in sk.exact_window_quantiles(ranks, PS).filter("span = 0").collect()}
    for p in PS:
        assert got[p] == pytest.approx(np.quantile(pdf.value, p))
    assert got[0.5] == pytest.approx(exact_quantile(ledger, "value", 0.5).first()[0])


def test_a_new_day_adds_its_own_rows_only(spark, ledger, tmp_path):
    path = f"{tmp_path}/daily"
    early, late = ledger.filter("day < '2001-01-06'"), ledger.filter("day >= '2001-01-06'")
    files.write_dated(sk.daily_quantiles(early, "day", "tied"), path, "day")
    files.write_dated(sk.daily_quantiles(late, "day", "tied"), path, "day")
    files.write_dated(sk.daily_quantiles(late, "day", "tied"), path, "day")         # run twice: nothing counted twice
    stored = spark.read.parquet(path)
    r = sk.window_quantiles(stored, {0: (None, None)}, [0.5]).first()
    assert stored.count() == ledger.select("day").distinct().count()
    assert (r.n, r.quantile) == (60_000, 2.0)


def test_small_sketches_are_exact_and_empty_tables_give_no_rows(spark):
    df = spark.createDataFrame([(D0, 1.0), (D0, 2.0), (D0, 3.0), (None, 9.0), (D0, None)], "day date, value double")
    r = sk.window_quantiles(sk.daily_quantiles(df, "day", "value"), {0: (None, None)}, [0.5]).first()
    assert (r.n, r.quantile) == (3, 2.0)
    empty = df.filter("value > 100")
    assert sk.window_quantiles(sk.daily_quantiles(empty, "day", "value"), {0: (None, None)}, [0.5]).count() == 0


@pytest.mark.parametrize("n", [500, 60_000])
def test_set_algebra_of_stored_days(spark, n):
    lg = 12                                                     # 500 entities are below the capacity, 60,000 far beyond
    ids = spark.range(n).withColumn("day", F.date_add(F.lit(D0), (F.col("id") % 9).cast("int")))
    rows = (ids.filter("id % 2 = 0").withColumn("m", F.lit("A"))
            .unionByName(ids.filter("id % 3 = 0").withColumn("m", F.lit("B")))
            .unionByName(ids.filter("id % 2 = 0").withColumn("m", F.lit("A")))      # repeated rows count once
            .unionByName(ids.limit(0).withColumn("m", F.lit("C"))))
    daily = sk.daily_entities(rows, ["m"], "day", "id", lg)
    windows = {0: (None, None), 4: (str(D0), "2001-01-04")}
    est = {r.span: r for r in sk.sketch_set_counts(sk.window_entities(daily, "m", windows, lg), "m").collect()}
    exact = {r.span: r for r in sk.exact_set_counts(rows, "m", "day", "id", ["A", "B", "C"], windows).collect()}
    for span, days in ((0, 9), (4, 4)):
        a = {i for i in range(0, n, 2) if i % 9 < days}
        b = {i for i in range(0, n, 3) if i % 9 < days}
        want = (len(a & b), len(a - b), len(b - a), len(a | b))
        e = exact[span]
        assert (e.left_key, e.right_key, e.shared, e.only_left, e.only_right, e.either) == ("A", "B", *want)
        g = est[span]
        room = 0 if len(a | b) < 2 ** lg else 5 / 2 ** (lg / 2) * len(a | b) + 1
        assert all(abs(x - y) <= room for x, y in zip((g.shared, g.only_left, g.only_right, g.either), want))
