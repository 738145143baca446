"""Structured Streaming over the collections event log.

ST-1  incremental collections features: the per-invoice aggregates behind the
      collections feature table (counts, last contact, latest promise, max
      escalation) are commutative, so a plain streaming ``groupBy`` keeps them
      in state; no custom state operator is needed.
ST-2  daily reminder velocity: tumbling one-day event-time windows per
      customer with a 14-day watermark; events later than the watermark are
      dropped.

Both run in update mode.  Each micro-batch appends its updated rows, tagged
with the batch id, to a Parquet folder through ``foreachBatch``; the current
state is the latest row per key (``max_by`` on the batch id).  Checkpoints
and outputs live in the shared folder named by ``spark.checkpoint.dir``, so a
restarted query resumes exactly where it stopped.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.config import DEFAULT, ESCALATION_LABEL, ESCALATION_RANK, Settings
from ledgerlake.functions.columns import floor_days, lit_date, lookup
from ledgerlake.session import checkpoint_dir
from ledgerlake.sources.driver import collections_from


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """The driver's event file as a file stream, mapped onto the collections log (stream-static join)."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
              .parquet(f"{sf_dir}/events*.parquet"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return collections_from(events, orders)


def invoice_state(stream: DataFrame) -> DataFrame:
    """ST-1 aggregate (streaming groupBy, partial aggregation per micro-batch)."""
    et = F.col("event_type")
    return stream.groupBy("invoice_id").agg(
        F.count_if(et == "REMINDER").alias("reminder_count"),
        F.count_if(et == "CALL").alias("call_count"),
        F.count_if(et == "PTP").alias("ptp_events"),
        F.max(F.when(et == "PTP", F.col("promise_to_pay_date"))).alias("promise_to_pay_date"),
        F.max("event_date").alias("last_contact"),
        F.max(F.coalesce(lookup(et, ESCALATION_RANK), F.lit(0))).alias("esc_rank"),
    )


def reminder_windows(stream: DataFrame, watermark: str = "14 days") -> DataFrame:
    """ST-2 aggregate: reminders per customer per day, late data bounded by the watermark."""
    r = (stream.filter(F.col("event_type") == "REMINDER")
         .withColumn("event_date", F.col("event_date").cast("timestamp"))     # watermarks need TIMESTAMP (UTC)
         .withWatermark("event_date", watermark))
    return r.groupBy(F.window("event_date", "1 day"), "customer_id").agg(F.count(F.lit(1)).alias("reminders"))


def run_to_completion(agg: DataFrame, out: str, ckpt: str) -> None:
    """Drive an update-mode aggregate over all available input; every batch appends its updates."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("append").parquet(out)

    q = (agg.writeStream.outputMode("update").foreachBatch(sink)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()


def run_appended(rows: DataFrame, out: str, ckpt: str) -> None:
    """Drive an append-mode query over all available input into a Parquet sink (exactly once)."""
    q = (rows.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def latest(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """Current state = the most recent update per key."""
    df = spark.read.parquet(out)
    vals = [c for c in df.columns if c not in keys and c != "_batch"]
    return df.groupBy(*keys).agg(*[F.max_by(c, "_batch").alias(c) for c in vals])


def paths(spark: SparkSession, name: str) -> tuple[str, str]:
    run = uuid.uuid4().hex[:12]
    base = f"{checkpoint_dir(spark)}/streams/{name}/{run}"
    return f"{base}/out", f"{base}/checkpoint"


def collections_stream_features(spark: SparkSession, sf_dir: str, cfg: Settings = DEFAULT) -> DataFrame:
    """ST-1: run the stream, then express the state as collections features."""
    out, ckpt = paths(spark, "collections")
    run_to_completion(invoice_state(event_stream(spark, sf_dir)), out, ckpt)
    s = latest(spark, out, ["invoice_id"])
    return s.select(
        "invoice_id", F.col("reminder_count").cast("int").alias("reminder_count"),
        F.col("call_count").cast("int").alias("call_count"),
        (F.col("ptp_events") > 0).alias("promise_to_pay_flag"), "promise_to_pay_date",
        floor_days(lit_date(cfg.reference_date), F.col("last_contact")).cast("int").alias("days_since_last_contact"),
        F.coalesce(lookup(F.col("esc_rank"), ESCALATION_LABEL), F.lit("NONE")).alias("escalation_status"))


def reminder_velocity_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-2: run the windowed stream and return (day, customer_id, reminders)."""
    out, ckpt = paths(spark, "reminders")
    run_to_completion(reminder_windows(event_stream(spark, sf_dir)), out, ckpt)
    s = latest(spark, out, ["window", "customer_id"])
    return s.select(F.to_date(F.col("window.start")).alias("day"), "customer_id", "reminders")
