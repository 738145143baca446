"""Collections streams whose state ends: keyed state with timers (ST-1) and an outer stream-stream join (CF-4).

ST-1, with timers: an invoice's state is one row in RocksDB.  An event-time timer, moved with each contact, closes
the invoice after ``idle`` days without one: its episode is emitted as closed and the state evicted, so state holds only invoices
that are being worked on.  Contact after that opens a new episode; episodes of an invoice add up.  Events older
than the watermark are dropped, as in every stateful stream.

CF-4, as a join of promises with payments: both sides carry watermarks, a payment meets a promise of its invoice when its date lies
within ``horizon`` days of the promised date, and a promise without such a payment is emitted once the watermark has passed.
State is bounded by the horizon.  With a horizon over the ledger's longest delay the ratios equal the batch's.
"""
from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ledgerlake.config import DEFAULT, ESCALATION_LABEL, ESCALATION_RANK, Settings
from ledgerlake.functions.columns import bool_ratio, floor_days, lit_date, lookup

# instants are microseconds since 1970 in state, so no worker's time zone matters
STATE = "opened long, reminders long, calls long, ptp long, promise date, last long, esc int, timer long"
EPISODE = ("invoice_id long, opened long, reminder_count long, call_count long, ptp_events long, "
           "promise_to_pay_date date, last_contact long, esc_rank int, closed boolean")
COLUMNS = [c.split()[0] for c in EPISODE.split(", ")]
DAY_MS = 86_400_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _later(a, b):
    return b if a is None else a if b is None else max(a, b)


class InvoiceEpisodes(StatefulProcessor):
    """One open episode per invoice; a timer closes it ``idle`` days after its last contact."""

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle):
        self.handle = handle
        self.state = handle.getValueState("episode", STATE)

    def _row(self, key, s, closed):
        return Row(**dict(zip(COLUMNS, (key[0], *s[:7], closed))))

    def handleInputRows(self, key, rows, timerValues):
        known = self.state.exists()
        opened, reminders, calls, ptp, promise, last, esc, timer = self.state.get() if known else (
            None, 0, 0, 0, None, None, 0, None)
        for r in rows:                                           # an iterator: a hot invoice's events are not gathered
            if not known:                                        # afterwards it names the episode and stays
                opened = r.at if opened is None else min(opened, r.at)
            last = _later(last, r.at)
            reminders += r.event_type == "REMINDER"
            calls += r.event_type == "CALL"
            ptp += r.event_type == "PTP"
            if r.event_type == "PTP":
                promise = _later(promise, r.promise_to_pay_date)
            esc = max(esc, r.esc_rank)
        due = last // 1000 + self.idle * DAY_MS
        if timer != due:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        s = (opened, reminders, calls, ptp, promise, last, esc, due)
        self.state.update(s)
        yield self._row(key, s, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.state.exists():
            s = self.state.get()
            self.state.clear()
            yield self._row(key, s, True)

    def close(self):
        pass


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries started inside keep their state in RocksDB; the session's setting is put back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def episodes(stream: DataFrame, idle: int = 60, watermark: str = "14 days") -> DataFrame:
    """Collections events -> updates of invoice episodes (columns of ``EPISODE``); events without a date are left out."""
    e = (stream.filter(F.col("event_date").isNotNull() & F.col("invoice_id").isNotNull())
         .select("invoice_id", "event_type", F.col("promise_to_pay_date").cast("date").alias("promise_to_pay_date"),
                 F.coalesce(lookup(F.col("event_type"), ESCALATION_RANK), F.lit(0)).cast("int").alias("esc_rank"),
                 F.col("event_date").cast("timestamp").alias("event_date"))
         .withColumn("at", F.unix_micros("event_date")).withWatermark("event_date", watermark))
    return e.groupBy("invoice_id").transformWithState(InvoiceEpisodes(idle), EPISODE, "Update", "EventTime")


def run_episodes(spark: SparkSession, updates: DataFrame, out: str, ckpt: str):
    """All available input; each batch writes a folder of its own, so a repeated batch replaces its rows.  Returns the last progress."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    with rocksdb(spark):
        q = (updates.writeStream.outputMode("update").foreachBatch(sink)
             .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
        q.awaitTermination()
    return q.lastProgress


def episode_rows(spark: SparkSession, out: str) -> DataFrame:
    """The newest update of each episode: open ones and closed ones."""
    df = spark.read.schema(EPISODE + ", batch int").parquet(out)
    # within a batch an episode is updated and then closed: the closing row counts
    newest = F.max_by(F.struct(*[c for c in df.columns if c not in ("invoice_id", "opened", "batch")]),
                      F.struct("batch", "closed")).alias("s")
    return df.groupBy("invoice_id", "opened").agg(newest).select("invoice_id", "opened", "s.*")


def collections_features(spark: SparkSession, out: str, cfg: Settings = DEFAULT) -> DataFrame:
    """CO-1 to CO-4 from the episodes."""
    s = episode_rows(spark, out).groupBy("invoice_id").agg(
        F.sum("reminder_count").alias("r"), F.sum("call_count").alias("c"), F.sum("ptp_events").alias("p"),
        F.max("promise_to_pay_date").alias("promise_to_pay_date"), F.timestamp_micros(F.max("last_contact")).alias("l"), F.max("esc_rank").alias("e"))
    return s.select("invoice_id", F.col("r").cast("int").alias("reminder_count"), F.col("c").cast("int").alias("call_count"),
                    (F.col("p") > 0).alias("promise_to_pay_flag"), "promise_to_pay_date",
                    floor_days(lit_date(cfg.reference_date), F.col("l")).cast("int").alias("days_since_last_contact"),
                    F.coalesce(lookup(F.col("e"), ESCALATION_LABEL), F.lit("NONE")).alias("escalation_status"))


# ---------------------------------------------------------------- promises kept
def promise_outcomes(promises: DataFrame, payments: DataFrame, horizon: int, delay: str = "30 days") -> DataFrame:
    """Streams of promises (event_id, invoice_id, customer_id, promise_to_pay_date, event_date) and AR payments (reference_id,
    payment_date) -> one row for each promise and payment of its invoice, or for a promise that the watermark found unpaid."""
    p = (promises.withColumn("promised", F.coalesce(F.col("promise_to_pay_date"), F.col("event_date")).cast("timestamp"))
         .withWatermark("promised", delay))
    y = (payments.select(F.col("reference_id").alias("paid_invoice"), F.col("payment_date").cast("timestamp").alias("paid"))
         .withWatermark("paid", delay))
    near = F.expr(f"paid_invoice = invoice_id AND paid >= promised - INTERVAL {horizon} DAYS AND paid <= promised + INTERVAL {horizon} DAYS")
    return p.join(y, near, "leftOuter").select(
        "event_id", "customer_id", "promise_to_pay_date", F.to_date("paid").alias("payment_date"))


def kept_ratio(outcomes: DataFrame) -> DataFrame:
    """CF-4 from the outcomes."""
    return outcomes.groupBy("customer_id").agg(
        bool_ratio(F.col("payment_date") <= F.col("promise_to_pay_date")).alias("ptp_kept_ratio"))


__all__ = ["episodes", "run_episodes", "episode_rows", "collections_features", "promise_outcomes", "kept_ratio", "rocksdb"]
