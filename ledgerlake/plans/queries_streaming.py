"""Query catalogue: Structured Streaming operators (final state compared with the batch result)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.operators import features as fe
from ledgerlake.plans.registry import pipe, reg
from ledgerlake.streaming import collections as st
from ledgerlake.streaming import keyed


@reg("ST-1", "invoice_id:i reminder_count:i call_count:i promise_to_pay_flag promise_to_pay_date "
             "days_since_last_contact:i escalation_status", "st1")
def q_stream_collections(spark, d):
    return st.collections_stream_features(spark, d)


@reg("ST-2", "day customer_id:i reminders:i", "st2")
def q_stream_reminders(spark, d):
    return st.reminder_velocity_stream(spark, d)


@reg("ST-1:episodes", "invoice_id:i reminder_count:i call_count:i promise_to_pay_flag promise_to_pay_date "
                      "days_since_last_contact:i escalation_status", "st1")
def q_stream_episodes(spark, d):
    """ST-1 with timers: idle invoices are closed and leave the state; their episodes add up to the batch's features."""
    out, ckpt = st.paths(spark, "episodes")
    keyed.run_episodes(spark, keyed.episodes(st.event_stream(spark, d)), out, ckpt)
    return keyed.collections_features(spark, out)


@reg("CF-4:stream", "customer_id:i ptp_kept_ratio:d", "cf_ptp")
def q_stream_promises(spark, d):
    """Promises joined with payments as two streams.  A last row far in the future on either side moves the watermarks past
    every promise, so that the unpaid ones come out."""
    t = pipe(spark, d).t
    ptp = t["collections_events"].filter("event_type = 'PTP'").select(
        "event_id", "invoice_id", "customer_id", "promise_to_pay_date", F.col("event_date").cast("timestamp").alias("event_date"))
    pay = fe.ar_payments(fe.payments_of(t, "AR")).select("reference_id", "payment_date")
    out, ckpt = st.paths(spark, "promises")
    end = F.lit("2200-01-01")
    sources = []
    for name, df, col in (("promises", ptp, "promise_to_pay_date"), ("payments", pay, "payment_date")):
        # its keys meet nothing and aren't null: rows without a key are filtered before the watermark sees them
        row = {col: end, "invoice_id": F.lit(-1), "reference_id": F.lit(-2)}
        last = spark.range(1).select(*[row.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema.fields])
        path = f"{out}_{name}"
        df.write.parquet(f"{path}/1")
        last.write.parquet(f"{path}/2")
        # the first batch holds the table, the second the far row: files are taken in the order of their times
        files = len(spark.read.parquet(f"{path}/1").inputFiles())
        sources.append(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", max(files, 1)).parquet(f"{path}/*"))
    st.run_appended(keyed.promise_outcomes(*sources, horizon=3650), out, ckpt)
    return keyed.kept_ratio(spark.read.parquet(out).filter(F.col("customer_id").isNotNull()))
