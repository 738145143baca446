"""Streams whose state ends: timers close idle invoices, restarts go on, promises are settled when the watermark has passed."""
import datetime as dt

import pytest

from ledgerlake.streaming import collections as st
from ledgerlake.streaming import keyed

EVENTS = "event_id long, invoice_id long, customer_id long, event_type string, event_date timestamp, promise_to_pay_date date"
T0 = dt.datetime(2001, 1, 1, 9)


def _day(n):
    return T0 + dt.timedelta(days=n)


def _run(spark, base, rows, n):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{base}/in/{n}")
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{base}/in/*")
    return keyed.run_episodes(spark, keyed.episodes(stream, idle=30, watermark="5 days"), f"{base}/out", f"{base}/ckpt")


def _state_rows(progress):
    return sum(o.numRowsTotal for o in progress.stateOperators)


def test_idle_invoices_are_closed_and_evicted(spark, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    base = str(tmp_path)
    _run(spark, base, [(1, 1, 7, "REMINDER", _day(0), None), (2, 1, 7, "PTP", _day(1), dt.date(2001, 2, 1)),
                       (3, 2, 7, "CALL", _day(0), None), (4, None, 7, "CALL", _day(0), None), (5, 3, 7, "CALL", None, None)], 1)
    rows = {r.invoice_id: r for r in keyed.episode_rows(spark, f"{base}/out").collect()}
    assert set(rows) == {1, 2} and not any(r.closed for r in rows.values())
    # a restart from the checkpoint: invoice 2 is contacted again, the watermark passes day 31 (invoice 1: last contact on day 1)
    _run(spark, base, [(6, 2, 7, "REMINDER", _day(20), None), (7, 4, 7, "CALL", _day(40), None)], 2)
    rows = {r.invoice_id: r for r in keyed.episode_rows(spark, f"{base}/out").collect()}
    assert rows[1].closed and (rows[1].reminder_count, rows[1].ptp_events) == (1, 1)
    assert not rows[2].closed and (rows[2].reminder_count, rows[2].call_count) == (1, 1)
    # contact after closing opens a second episode; an event older than the watermark (day 35) is dropped
    p = _run(spark, base, [(8, 1, 7, "REMINDER", _day(41), None), (9, 2, 7, "CALL", _day(3), None)], 3)
    one = sorted((r.opened, r.reminder_count, r.closed) for r in keyed.episode_rows(spark, f"{base}/out").filter("invoice_id = 1").collect())
    assert [x[1:] for x in one] == [(1, True), (1, False)]
    got = {r.invoice_id: r for r in keyed.collections_features(spark, f"{base}/out").collect()}
    assert (got[1].reminder_count, got[1].call_count, got[1].promise_to_pay_flag) == (2, 0, True)
    assert got[1].promise_to_pay_date == dt.date(2001, 2, 1) and (got[2].reminder_count, got[2].call_count) == (1, 1)
    # long after: every invoice but the newest has left the state
    p = _run(spark, base, [(10, 99, 7, "CALL", _day(400), None)], 4)
    left = {r.invoice_id for r in keyed.episode_rows(spark, f"{base}/out").filter("NOT closed").collect()}
    assert left == {99}
    assert _state_rows(p) <= 2                                   # its episode and its timer
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before


PROMISES = "event_id long, invoice_id long, customer_id long, promise_to_pay_date date, event_date timestamp"
PAYMENTS = "reference_id long, payment_date date"


@pytest.mark.parametrize("late", [False, True])
def test_promises_settle_when_the_watermark_passes(spark, tmp_path, late):
    base = str(tmp_path)
    d = lambda n: (T0 + dt.timedelta(days=n)).date()             # noqa: E731

    def step(promises, payments, n):
        for name, rows, schema in (("p", promises, PROMISES), ("y", payments, PAYMENTS)):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{base}/{name}/{n}")
        src = [spark.readStream.schema(s).parquet(f"{base}/{x}/*") for x, s in (("p", PROMISES), ("y", PAYMENTS))]
        st.run_appended(keyed.promise_outcomes(*src, horizon=60, delay="10 days"), f"{base}/out", f"{base}/ckpt")
        return {(r.event_id, r.payment_date) for r in spark.read.parquet(f"{base}/out").filter("customer_id IS NOT NULL").collect()}

    # invoice 1 is paid in time, 2 late (after the promise), 3 never; 4 was promised without a date
    got = step([(1, 1, 7, d(10), T0), (2, 2, 7, d(10), T0), (3, 3, 7, d(10), T0), (4, 4, 8, None, T0)], [(1, d(9)), (9, d(9))], 1)
    assert got == {(1, d(9))}                                    # nothing is said of the others yet
    got = step([(5, 5, 7, d(30), _day(12))], [(2, d(25)), (2, d(26))], 2)
    assert got == {(1, d(9)), (2, d(25)), (2, d(26))}
    if late:                                                     # a payment within the watermark's delay still counts
        got = step([], [(3, d(18))], 3)
        assert (3, d(18)) in got
    got = step([(90, -1, None, d(500), _day(500))], [(-2, d(500))], 4)
    assert got == {(1, d(9)), (2, d(25)), (2, d(26)), (3, d(18) if late else None), (4, None), (5, None)}
    ratio = {r.customer_id: r.ptp_kept_ratio for r in keyed.kept_ratio(spark.read.parquet(f"{base}/out").filter("customer_id IS NOT NULL")).collect()}
    assert ratio == {7: pytest.approx(1 / 5), 8: 0.0}
