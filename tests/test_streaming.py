"""Streaming semantics: late events are dropped by the watermark; state is the latest update per key."""
import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from ledgerlake.streaming import collections as st

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _write(spark, folder, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(os.path.join(folder, name))


def test_reminder_windows_drop_late_events(spark):
    base = tempfile.mkdtemp(prefix="st-test-")
    src, out, ckpt = os.path.join(base, "events"), os.path.join(base, "out"), os.path.join(base, "ckpt")
    os.makedirs(src)
    orders = spark.createDataFrame([(k, 7, dt.datetime(2001, 1, 1)) for k in range(10)],
                                   "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz")
    t0 = dt.datetime(2024, 3, 1, 12, 0)
    # batch 1: two clicks (REMINDER) on day D and one 30 days later -> watermark moves to D+30-14
    _write(spark, src, "b1", [(4, t0, 1, "click", 1.0, ""), (5, t0, 1, "click", 1.0, ""),
                              (8, t0 + dt.timedelta(days=30), 1, "click", 1.0, "")])
    events_schema = spark.read.parquet(os.path.join(src, "b1")).schema

    def run():
        ev = (spark.readStream.schema(events_schema).option("maxFilesPerTrigger", 1)
              .parquet(os.path.join(src, "*")))
        agg = st.reminder_windows(st.collections_from(ev, orders))
        st.run_to_completion(agg, out, ckpt)

    run()
    # batch 2 (a restart resumes from the checkpoint): one on-time click and one click older than the watermark
    _write(spark, src, "b2", [(9, t0 + dt.timedelta(days=29), 1, "click", 1.0, ""),
                              (6, t0 + dt.timedelta(days=2), 1, "click", 1.0, "")])
    run()
    got = {(r.window.start.date(), r.reminders) for r in st.latest(spark, out, ["window", "customer_id"]).collect()}
    shift = dt.timedelta(days=8219)                       # the event log is shifted onto the ledger calendar
    day = lambda k: (t0 + dt.timedelta(days=k) - shift).date()
    assert got == {(day(0), 2), (day(29), 1), (day(30), 1)}   # the day-2 click arrived after the watermark


def test_invoice_state_is_latest_update(spark):
    base = tempfile.mkdtemp(prefix="st-test-")
    src, out, ckpt = os.path.join(base, "events"), os.path.join(base, "out"), os.path.join(base, "ckpt")
    os.makedirs(src)
    orders = spark.createDataFrame([(1, 7, dt.datetime(2001, 1, 1))], "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz")
    t0 = dt.datetime(2024, 3, 1, 12, 0)
    _write(spark, src, "b1", [(4, t0, 1, "click", 1.0, ""), (5, t0, 1, "view", 1.0, "")])
    schema = spark.read.parquet(os.path.join(src, "b1")).schema

    def run():
        ev = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(src, "*"))
        st.run_to_completion(st.invoice_state(st.collections_from(ev, orders)), out, ckpt)

    run()
    _write(spark, src, "b2", [(6, t0, 1, "click", 1.0, ""), (7, t0, 1, "error", 1.0, "")])
    run()
    r = st.latest(spark, out, ["invoice_id"]).collect()
    assert len(r) == 1
    assert (r[0].reminder_count, r[0].call_count, r[0].esc_rank) == (2, 1, 2)
    assert spark.read.parquet(out).select(F.countDistinct("_batch")).collect()[0][0] == 2
