"""Raw lines with faults, and publication of several tables behind one manifest."""
import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.sources import quarantine, snapshots

SCHEMA = T.StructType([T.StructField("invoice_id", T.LongType()), T.StructField("invoice_date", T.DateType()),
                       T.StructField("invoice_amount", T.DoubleType()), T.StructField("dispute_flag", T.BooleanType()),
                       T.StructField("invoice_status", T.StringType())])


def _write(tmp_path, name, text):
    folder = tmp_path / "raw"
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text, encoding="utf-8")
    return str(folder)


def test_every_line_is_kept_or_quarantined(spark, tmp_path):
    head = "invoice_id,invoice_date,invoice_amount,dispute_flag,invoice_status\n"
    _write(tmp_path, "a.csv", head + "1,2001-02-03,10.5,true,OPEN\n2,2001-02-30,x,maybe,\"PAID, late\"\n3,,,,\n")
    path = _write(tmp_path, "b.csv", head + "4,2001-02-03\n5,2001-02-03,1,true,OPEN,more\n" + head + ",2001-02-03,1,true,OPEN\n6,soon,2,false,é😀\n")
    s = quarantine.scan_csv(spark, path, SCHEMA, "invoices")
    kept = {r.invoice_id: r for r in s.kept.collect()}
    assert sorted(kept) == [1, 2, 3, 6]
    assert tuple(kept[1]) == (1, dt.date(2001, 2, 3), 10.5, True, "OPEN")
    assert tuple(kept[2]) == (2, None, None, None, "PAID, late") and tuple(kept[3]) == (3, None, None, None, None)
    bad = sorted((r.file, r.reason) for r in s.quarantined.collect())
    assert bad == [("b.csv", quarantine.KEY)] * 2 + [("b.csv", quarantine.SHAPE)] * 2         # a second header is no row
    assert "4,2001-02-03" in {r.record for r in s.quarantined.collect()}
    rej = sorted((r.file, r["column"], r.value, r.reason) for r in s.rejected.collect())
    assert rej == [("a.csv", "dispute_flag", "maybe", "not a boolean"), ("a.csv", "invoice_amount", "x", "not a double"),
                   ("a.csv", "invoice_date", "2001-02-30", "not a date"), ("b.csv", "invoice_date", "soon", "not a date")]
    assert s.raw.count() == s.kept.count() + s.quarantined.count() == 8


def test_scan_without_rows(spark, tmp_path):
    s = quarantine.scan_csv(spark, _write(tmp_path, "a.csv", "invoice_id,invoice_date,invoice_amount,dispute_flag,invoice_status\n"), SCHEMA, "invoices")
    assert (s.kept.count(), s.rejected.count(), s.quarantined.count()) == (0, 0, 0)
    assert s.kept.schema.simpleString() == SCHEMA.simpleString()


def _table(spark, date, value, n=3):
    return spark.range(n).withColumn("v", F.lit(value)).withColumn("feature_date", F.lit(date))


def test_dates_side_by_side_and_a_rerun_replaces_its_own(spark, tmp_path):
    root = f"{tmp_path}/store"
    with pytest.raises(FileNotFoundError):
        snapshots.read(spark, root, "a")
    both = lambda date, v: {"a": (_table(spark, date, v), "feature_date"), "b": (_table(spark, date, v * 10), "feature_date")}
    assert snapshots.publish(spark, root, both("2001-01-01", 1), "r1") == 1
    assert snapshots.publish(spark, root, both("2001-01-02", 2), "r2") == 2
    assert snapshots.publish(spark, root, {"a": both("2001-01-01", 3)["a"]}, "r3") == 3
    rows = lambda name, version=None: {(r.feature_date, r.v) for r in snapshots.read(spark, root, name, version).collect()}
    assert rows("a") == {("2001-01-01", 3), ("2001-01-02", 2)} and rows("b") == {("2001-01-01", 10), ("2001-01-02", 20)}
    assert rows("a", 2) == {("2001-01-01", 1), ("2001-01-02", 2)}                   # earlier versions can still be read


def test_a_publication_that_stops_half_way_changes_nothing(spark, tmp_path):
    root = f"{tmp_path}/store"
    good = {"a": (_table(spark, "2001-01-01", 1), "feature_date"), "b": (_table(spark, "2001-01-01", 1), "feature_date")}
    snapshots.publish(spark, root, good, "r1")
    broken = _table(spark, "2001-01-01", 2).withColumn("v", F.expr("cast(raise_error('lost') AS int)"))
    with pytest.raises(Exception, match="lost"):
        snapshots.publish(spark, root, {"a": (_table(spark, "2001-01-01", 2), "feature_date"), "b": (broken, "feature_date")}, "r2")
    # a manifest without its commit mark does not count either
    (tmp_path / "store" / "manifests" / "2").mkdir()
    (tmp_path / "store" / "manifests" / "2" / "part-0.json").write_text('{"table":"a","date_col":"feature_date","date":"2001-01-01","run":"r2"}\n')
    assert {r.v for r in snapshots.read(spark, root, "a").collect()} == {1}
    assert snapshots.publish(spark, root, {"a": (_table(spark, "2001-01-01", 5), "feature_date")}, "r3") == 2
    assert {r.v for r in snapshots.read(spark, root, "a").collect()} == {5}
    assert {r.v for r in snapshots.read(spark, root, "b").collect()} == {1}
