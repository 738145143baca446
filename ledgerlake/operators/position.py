"""Cash aggregation (S7): normalised event store, source-priority dedup,
daily / weekly / monthly cash position.

Scale notes
-----------
* The event store is the union of the six forecast sources; it is never
  shuffled by date.  Dedup only needs the *set of dates* on which each winner
  source has an event: after the horizon filter that set has at most
  ``horizon_days + 1`` rows per winner, a bound that does not grow with the
  data, so it is broadcast and every rule is a broadcast hash join.
* The daily position groups by ``target_date`` with map-side partial
  aggregation, so at most ``horizon_days + 1`` groups reach the reducer
  whatever the event count (a hot date costs nothing extra).  The calendar,
  running balance and roll-ups then work on <= ``horizon_days + 1`` rows.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.config import DEDUP_RULES, DEFAULT, SOURCE_CONFIDENCE, Settings
from ledgerlake.functions.columns import half_even, lit_date, lookup, month_label, stable_id, week_label

EVENT_COLUMNS = ["event_id", "source_module", "forecast_type", "direction", "target_date", "forecast_amount",
                 "confidence_tier", "forecast_date", "forecast_run_id", "original_file"]

# fixed values: the file each source publishes
SOURCE_FILES = {
    "S1": "s1_ar_forecast.csv", "S2": "s2_ap_forecast.csv", "S3": "s3_wip_forecast.csv",
    "S4": "s4_pipeline_forecast.csv", "S5": "s5_contingent_forecast.csv", "S6": "s6_expense_forecast.csv",
}


def standardise(df: DataFrame, source: str, cfg: Settings = DEFAULT) -> DataFrame:
    """S7-1..S7-4 for one source: unified columns, direction, default tier, horizon."""
    cols = set(df.columns)
    target = F.col("target_date") if "target_date" in cols else F.col("expected_cash_date")
    module = F.col("source_module") if "source_module" in cols else F.lit(source.upper())
    if "forecast_type" in cols:
        ftype = F.col("forecast_type")
        direction = F.when(ftype.isin("AP", "EXPENSE"), "OUTFLOW").otherwise("INFLOW")
    else:
        ftype = F.lit(source.upper())
        direction = F.when(F.col("forecast_amount") < 0, "OUTFLOW").otherwise("INFLOW")
    tier = F.col("confidence_tier") if "confidence_tier" in cols else lookup(module, SOURCE_CONFIDENCE, "LOW")
    fdate = F.col("forecast_date") if "forecast_date" in cols else F.lit(str(cfg.reference_date))
    # without an id the row's own columns name the event: the same on every retry
    key = F.col("forecast_id") if "forecast_id" in cols else F.xxhash64(*sorted(cols))
    out = df.select(
        stable_id(F.lit(source), key, F.lit(cfg.run_id)).alias("event_id"),
        module.alias("source_module"),
        ftype.alias("forecast_type"),
        direction.alias("direction"),
        F.to_date(target).alias("target_date"),
        F.col("forecast_amount").cast("double").alias("forecast_amount"),
        tier.alias("confidence_tier"),
        fdate.cast("string").alias("forecast_date"),
        F.lit(cfg.run_id).alias("forecast_run_id"),
        F.lit(SOURCE_FILES.get(source, f"{source.lower()}.csv")).alias("original_file"),
    )
    return out.filter(F.col("target_date").between(lit_date(cfg.reference_date), lit_date(cfg.horizon_end)))


def event_store(sources: dict[str, DataFrame], cfg: Settings = DEFAULT) -> DataFrame:
    """S7-5: UNION ALL of all present sources (absent ones are simply skipped)."""
    parts = [standardise(df, src, cfg) for src, df in sources.items() if df is not None]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _mark(df: DataFrame, source_dates: DataFrame, rules) -> DataFrame:
    """``suppressed`` and ``suppression_reason`` for rows with a source and a day; one date table per winner source."""
    out, reason = df, F.lit(None).cast("string")
    for winner in dict.fromkeys(w for _, w, _ in rules):
        dates = (source_dates.filter(F.col("source_module") == winner)
                 .select(F.col("target_date").alias(f"_d_{winner}")).distinct().withColumn(f"_hit_{winner}", F.lit(True)))
        # <= horizon_days+1 rows: size bounded by the horizon filter, safe to broadcast
        out = out.join(F.broadcast(dates), F.col("target_date") == F.col(f"_d_{winner}"), "left").drop(f"_d_{winner}")
    for loser, winner, why in rules:
        reason = F.when((F.col("source_module") == loser) & F.col(f"_hit_{winner}").isNotNull(), F.lit(why)).otherwise(reason)
    return (out.withColumn("suppression_reason", F.coalesce(reason, F.lit("")))
            .withColumn("suppressed", F.col("suppression_reason") != "").drop(*[f"_hit_{w}" for _, w, _ in rules]))


def dedup(events: DataFrame, rules=DEDUP_RULES) -> DataFrame:
    """S7-7: mark loser rows on dates where the winner source also has an event.

    Evaluated on all events (not on survivors of an earlier rule); a later
    rule overwrites the reason of an earlier one.
    """
    return _mark(events, events, rules).select(*EVENT_COLUMNS, "suppressed", "suppression_reason")


def active(events_marked: DataFrame) -> DataFrame:
    return events_marked.filter(~F.col("suppressed"))


def source_days(events: DataFrame, rules=DEDUP_RULES) -> DataFrame:
    """The event store at (source, day) grain with the dedup verdict: at most ``horizon_days + 1`` rows per source,
    whatever the number of events.  The verdict depends on source and day only, so every S7 figure below event level comes
    from this one aggregate and one scan of the store."""
    amt = F.col("forecast_amount")
    per = events.groupBy("source_module", "target_date").agg(
        F.sum(F.when(amt > 0, amt)).alias("_in"), F.sum(F.when(amt < 0, amt)).alias("_out"),
        F.sum(amt).alias("_net"), F.count(F.lit(1)).alias("_events"))
    return _mark(per, per, rules).drop("suppression_reason")


def daily_position(days: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """S7-8..S7-10 from the active source days: gross in/out by amount sign per day, dense calendar from the
    reference date to the last active event, running balance."""
    per_day = days.groupBy("target_date").agg(F.sum("_in").alias("_in"), F.sum("_out").alias("_out"))
    span = days.agg(F.max("target_date").alias("_last"))
    calendar = span.select(F.explode(F.sequence(lit_date(cfg.reference_date), F.col("_last"))).alias("date"))
    # both sides hold at most horizon_days+1 rows
    daily = calendar.join(F.broadcast(per_day), calendar["date"] == per_day["target_date"], "left").select(
        "date",
        F.coalesce(F.col("_in"), F.lit(0.0)).alias("gross_inflow"),
        F.abs(F.coalesce(F.col("_out"), F.lit(0.0))).alias("gross_outflow"),
    ).withColumn("net_flow", F.col("gross_inflow") - F.col("gross_outflow"))
    # single ordered window over <= horizon_days+1 rows
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn("cumulative_position", F.lit(cfg.opening_balance) + F.sum("net_flow").over(w))


def _rollup(daily: DataFrame, label: F.Column, name: str) -> DataFrame:
    g = daily.groupBy(label.alias(name)).agg(
        F.sum("gross_inflow").alias("gross_inflow"),
        F.sum("gross_outflow").alias("gross_outflow"),
        F.sum("net_flow").alias("net_flow"),
        F.max_by("cumulative_position", "date").alias("closing_position"),
    )
    return g.select(name, *[half_even(c, 2).alias(c) for c in
                            ("gross_inflow", "gross_outflow", "net_flow", "closing_position")])


def weekly_position(daily: DataFrame) -> DataFrame:
    """S7-11: Monday-Sunday weeks, closing = last day's position, rounded to cents."""
    return _rollup(daily, week_label(F.col("date")), "week")


def monthly_position(daily: DataFrame) -> DataFrame:
    """S7-12."""
    return _rollup(daily, month_label(F.col("date")), "month")


def position_summary(daily: DataFrame, days: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """S7-13 / QY-14: one row of headline figures from the daily position and the marked source days."""
    d = daily.agg(
        half_even(F.sum("gross_inflow"), 2).alias("total_inflows"),
        half_even(F.sum("gross_outflow"), 2).alias("total_outflows"),
        half_even(F.sum("net_flow"), 2).alias("net_position_change"),
        half_even(F.max_by("cumulative_position", "date"), 2).alias("closing_balance"),
        half_even(F.min("cumulative_position"), 2).alias("min_cash_position"),
        # first date of the minimum: smallest (position, date) pair
        F.min(F.struct("cumulative_position", "date"))["date"].alias("min_cash_date"),
        F.count(F.lit(1)).alias("forecast_days"),
    )
    n, out = F.col("_events"), F.col("suppressed")
    e = days.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("total_events"),
        F.coalesce(F.sum(F.when(~out, n)), F.lit(0)).alias("active_events"),
        F.coalesce(F.sum(F.when(out, n)), F.lit(0)).alias("suppressed_events"),
    )
    return d.crossJoin(F.broadcast(e)).withColumn("opening_balance", F.lit(cfg.opening_balance))


def cash_outputs(daily: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """S7-14: unified CASH forecast, net x0.85 / x1.15."""
    return daily.select(
        stable_id(F.lit("S7"), F.col("date"), F.lit(cfg.run_id)).alias("forecast_id"),
        F.lit(str(cfg.reference_date)).alias("forecast_date"),
        F.lit("CASH").alias("forecast_type"),
        F.col("date").alias("target_date"),
        F.col("net_flow").alias("forecast_amount"),
        (F.col("net_flow") * 0.85).alias("confidence_low"),
        (F.col("net_flow") * 1.15).alias("confidence_high"),
        F.lit("S7").alias("source_module"),
        F.lit(cfg.run_id).alias("forecast_run_id"),
    )


def by_source(days: DataFrame) -> DataFrame:
    """S7-15: active-event count and total per source, with direction label and absolute amount."""
    a = active(days).groupBy("source_module").agg(
        F.sum("_events").alias("event_count"),
        half_even(F.sum("_net"), 2).alias("total"),
    )
    return a.withColumn("flow_direction", F.when(F.col("total") > 0, "inflow").otherwise("outflow")) \
            .withColumn("abs_total", F.abs("total"))


def profile(events_marked: DataFrame) -> DataFrame:
    """S7-6: counts by source, direction and confidence tier in one pass (grouping sets)."""
    return (events_marked.groupingSets([["source_module"], ["direction"], ["confidence_tier"]],
                                       "source_module", "direction", "confidence_tier")
            .agg(F.count(F.lit(1)).alias("events")))
