"""Query catalogue: sources and sinks, exercised as write -> read round trips in the shared folder."""
from __future__ import annotations

import hashlib
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.plans import jobs
from ledgerlake.plans.registry import FIXTURE_KINDS, pipe, reg
from ledgerlake.sources import files, quarantine


def _root(spark, d):
    return f"{jobs.store_root(spark)}/{hashlib.sha256(d.encode()).hexdigest()[:16]}"


INV_SCHEMA = T.StructType([
    T.StructField("invoice_id", T.LongType()), T.StructField("customer_id", T.LongType()),
    T.StructField("invoice_date", T.DateType()), T.StructField("due_date", T.DateType()),
    T.StructField("invoice_amount", T.DoubleType()), T.StructField("dispute_flag", T.BooleanType()),
    T.StructField("invoice_status", T.StringType())])


@reg("SRC-2", "invoice_id:i customer_id:i invoice_date due_date invoice_amount:d dispute_flag invoice_status",
     "invoices")
def q_csv_dates(spark, d):
    """Invoices exported to CSV and read back with a declared schema and coercing date parsing."""
    path = files.write_csv(pipe(spark, d).t["invoices"], f"{_root(spark, d)}/raw/invoices_csv")
    return files.read_raw_csv(spark, path, INV_SCHEMA, "invoices")


@reg("SRC-3", "customer_id:i avg_payment_delay:d payment_volatility:d invoice_count:i seasonality_index:d "
              "feature_date", "customer_features")
def q_feature_store(spark, d):
    """Feature tables published (SNK-1) and read back from the store (SRC-3)."""
    root = _root(spark, d)
    jobs.publish_features(pipe(spark, d), root)
    return files.read_feature_tables(spark, f"{root}/features", ["customer_features"])["customer_features"]


@reg("SNK-1", "table_name rows:i", """
SELECT 'customer_features' AS table_name, count(*) AS rows FROM customer_features UNION ALL
SELECT 'customer_payment_scores', count(*) FROM payment_scores UNION ALL
SELECT 'invoice_features', count(*) FROM invoice_features UNION ALL
SELECT 'collections_features', count(*) FROM collections_features UNION ALL
SELECT 'vendor_features', count(*) FROM vendor_features UNION ALL
SELECT 'bill_features', count(*) FROM bill_features""")
def q_published_features(spark, d):
    root = _root(spark, d)
    paths = jobs.publish_features(pipe(spark, d), root)
    parts = [spark.read.parquet(p).agg(F.count(F.lit(1)).alias("rows")).withColumn("table_name", F.lit(n))
             for n, p in paths.items()]
    return reduce(DataFrame.unionByName, parts)


@reg("SRC-5", "source_module events:i", "SELECT source_module, count(*) AS events FROM events_raw "
                                         "WHERE source_module <> 'S3' GROUP BY 1")
def q_optional_sources(spark, d):
    """Forecast outputs published per module (SNK-2) and read back as optional sources; an absent
    source (no bank feed is published) is skipped."""
    from ledgerlake.operators import position as po
    root = _root(spark, d)
    base = jobs.publish_forecasts(pipe(spark, d), root)
    paths = {m: f"{base}/source_module={m}" for m in ("S1", "S2", "S4", "S5", "S6")}
    paths["BANK"] = f"{base}/source_module=BANK"
    srcs = files.read_optional(spark, paths)
    srcs = {k: v.withColumn("source_module", F.lit(k)) for k, v in srcs.items() if v is not None}
    return po.event_store(srcs).groupBy("source_module").agg(F.count(F.lit(1)).alias("events"))


@reg("SNK-3", "date gross_inflow:d gross_outflow:d net_flow:d cumulative_position:d", "daily_position")
def q_published_position(spark, d):
    out = jobs.publish_position(pipe(spark, d), _root(spark, d))
    return spark.read.parquet(out["daily"])


REC = ("recommendation_id lever priority entity_type entity_id:i customer_id:i action channel description "
       "cash_impact:d days_accelerated:i risk_segment score:d confidence rank:i")


@reg("SNK-4", REC, "recommendations")
def q_published_recs(spark, d):
    return spark.read.parquet(jobs.publish_recommendations(pipe(spark, d), _root(spark, d)))


@reg("SNK-2", "source_module rows:i", "SELECT source_module, count(*) AS rows FROM ("
     "SELECT * FROM s1_fo UNION ALL SELECT * FROM s2_fo UNION ALL SELECT * FROM s4_fo UNION ALL "
     "SELECT * FROM s5_fo UNION ALL SELECT * FROM s6_fo) GROUP BY 1")
def q_published_forecasts(spark, d):
    base = jobs.publish_forecasts(pipe(spark, d), _root(spark, d))
    return spark.read.parquet(base).groupBy("source_module").agg(F.count(F.lit(1)).alias("rows"))


@reg("SRC-4", "input rows:i amount:d", """
SELECT 'project_milestones' AS input, count(*) AS rows, round_even(sum(billing_amount), 2) AS amount FROM project_milestones
UNION ALL SELECT 'crm_pipeline', count(*), round_even(sum(deal_value), 2) FROM crm_pipeline
UNION ALL SELECT 'contingent_inflows', count(*), round_even(sum(amount), 2) FROM contingent_inflows
UNION ALL SELECT 'expense_schedule', count(*), round_even(sum(amount), 2) FROM expense_schedule""")
def q_forecast_inputs(spark, d):
    """Milestone, CRM, contingent-inflow and expense scans (one pass each)."""
    from ledgerlake.functions.columns import half_even
    t = pipe(spark, d).t
    parts = [t[n].agg(F.lit(n).alias("input"), F.count(F.lit(1)).alias("rows"), half_even(F.sum(c), 2).alias("amount"))
             for n, c in (("project_milestones", "billing_amount"), ("crm_pipeline", "deal_value"),
                          ("contingent_inflows", "amount"), ("expense_schedule", "amount"))]
    return reduce(DataFrame.unionByName, parts)


def _csv(spark, d, name, df=None):
    """One raw table as CSV files, read back with a declared schema and coercing date parsing."""
    df = pipe(spark, d).t[name] if df is None else df
    schema = pipe(spark, d).t[name].schema
    return files.read_raw_csv(spark, files.write_csv(df, f"{_root(spark, d)}/raw/{name}_{uuid.uuid4().hex[:8]}"), schema, name)


RAW = ("customers", "invoices", "payments", "collections_events", "non_invoice_payments", "vendors", "bills", "purchase_orders")


def _register_csv(name):
    spec = " ".join(c if k == "s" else f"{c}:{k}" for c, k in FIXTURE_KINDS[name])

    @reg(f"SRC-1:csv_{name}", spec, name)
    def q_csv(spark, d):
        return _csv(spark, d, name)

    dates = files.DATE_COLUMNS.get(name)
    if dates:
        key, c = FIXTURE_KINDS[name][0][0], dates[0]
        row = f"{key} % 10" if FIXTURE_KINDS[name][0][1] == "i" else "reference_id % 10"

        @reg(f"SRC-2:{name}", spec, f"SELECT * REPLACE (CASE WHEN {row} IN (0, 1, 2) THEN NULL ELSE {c} END AS {c}) FROM {name}")
        def q_malformed(spark, d):
            """Words, impossible days and empty text among the dates: null after parsing."""
            t = pipe(spark, d).t[name]
            k = F.expr(row)
            bad = F.when(k == 0, "soon").when(k == 1, "2001-02-30").when(k == 2, "").otherwise(F.col(c).cast("string"))
            return _csv(spark, d, name, t.withColumn(c, bad))


for _name in RAW:
    _register_csv(_name)


# --- bad lines and values, with their reasons -----------------------------------------------
# What the dirty export does to a row, by its key k: a field missing (k % 13 = 1), one too many (2), a key that is no number
# (k % 11 = 5), a date in words (k % 10 = 0), an amount in words (k % 7 = 3).
def _row_key(name):
    key, kind = FIXTURE_KINDS[name][0]
    return "reference_id" if kind != "i" else key


def _dirty(spark, d, name):
    """The table's rows as CSV text with faults in them, scanned with quarantine."""
    t = pipe(spark, d).t[name]
    k, kinds = F.col(_row_key(name)), dict(FIXTURE_KINDS[name])
    cols = []
    for i, c in enumerate(t.columns):
        x = F.col(c).cast("string")
        if i == 0 and kinds[c] == "i":
            x = F.when(k % 11 == 5, "n/a").otherwise(x)
        elif c in files.DATE_COLUMNS.get(name, [])[:1]:
            x = F.when(k % 10 == 0, "soon").otherwise(x)
        elif kinds[c] == "d":
            x = F.when(k % 7 == 3, "much").otherwise(x)
        cols.append(x.alias(c))
    line = F.when(k % 13 == 1, F.to_csv(F.struct(*cols[:-1]))).when(k % 13 == 2, F.concat(F.to_csv(F.struct(*cols)), F.lit(",more")))
    path = f"{_root(spark, d)}/raw/dirty_{name}_{uuid.uuid4().hex[:8]}"
    t.select(line.otherwise(F.to_csv(F.struct(*cols))).alias("value")).write.text(path)
    return quarantine.scan_csv(spark, path, t.schema, name, header=False)


def _dirty_sql(name):
    k, (first, kind) = _row_key(name), FIXTURE_KINDS[name][0]
    dates, amounts = files.DATE_COLUMNS.get(name, [])[:1], [c for c, x in FIXTURE_KINDS[name] if x == "d"]
    shape = f"{k} % 13 IN (1, 2)"
    no_key = f"{k} % 11 = 5" if kind == "i" else "FALSE"
    return k, shape, no_key, dates, amounts


def _quarantine_sql(name):
    k, shape, no_key, dates, amounts = _dirty_sql(name)
    return f"""SELECT '{name}' AS table_name, count(*) AS rows_read, count(*) FILTER (NOT ({shape} OR {no_key})) AS kept,
      count(*) FILTER ({shape}) AS bad_shape, count(*) FILTER (NOT ({shape}) AND {no_key}) AS bad_key FROM {name}"""


@reg("SRC-1:quarantine", "table_name rows_read:i kept:i bad_shape:i bad_key:i", " UNION ALL ".join(_quarantine_sql(n) for n in RAW))
def q_quarantine(spark, d):
    """Every line of the eight raw tables is kept or quarantined."""
    parts = []
    for name in RAW:
        s = _dirty(spark, d, name)
        rows = (s.raw.select(F.lit("read").alias("what")).unionAll(s.kept.select(F.lit("kept")))
                .unionAll(s.quarantined.select("reason")))
        parts.append(rows.agg(F.lit(name).alias("table_name"), F.count_if(F.col("what") == "read").alias("rows_read"),
                              F.count_if(F.col("what") == "kept").alias("kept"),
                              F.count_if(F.col("what") == quarantine.SHAPE).alias("bad_shape"),
                              F.count_if(F.col("what") == quarantine.KEY).alias("bad_key")))
    return reduce(DataFrame.unionByName, parts)


def _rejects_sql(name):
    k, shape, no_key, dates, amounts = _dirty_sql(name)
    return [f"SELECT '{name}' AS table_name, '{c}' AS column_name, '{v}' AS value, count(*) AS rejected FROM {name} "
            f"WHERE NOT ({shape} OR {no_key}) AND {k} % {m} = {r} HAVING count(*) > 0"
            for cs, v, m, r in ((dates, "soon", 10, 0), (amounts, "much", 7, 3)) for c in cs]


@reg("SRC-2:rejects", "table_name column_name value rejected:i", " UNION ALL ".join(q for n in RAW for q in _rejects_sql(n)))
def q_rejects(spark, d):
    """Values that became null, by table, column and text."""
    parts = [_dirty(spark, d, n).rejected.groupBy(F.lit(n).alias("table_name"), F.col("column").alias("column_name"), "value")
             .agg(F.count(F.lit(1)).alias("rejected")) for n in RAW]
    return reduce(DataFrame.unionByName, parts)


@reg("SNK-1:snapshot", "customer_id:i feature_date payment_volatility:d invoice_count:i version:i", """
SELECT customer_id, '2001-08-01' AS feature_date, payment_volatility + 1 AS payment_volatility, invoice_count, 3 AS version FROM customer_features
UNION ALL SELECT customer_id, feature_date, payment_volatility + 2, invoice_count, 3 FROM customer_features""")
def q_snapshot(spark, d):
    """Two dates published, the second again with other values: readers see the first date and the second's last run."""
    from ledgerlake.sources import snapshots
    cf = pipe(spark, d).customer_features.select("customer_id", "feature_date", "payment_volatility", "invoice_count")
    root = f"{_root(spark, d)}/snapshots_{uuid.uuid4().hex[:8]}"
    runs = [("a", F.lit("2001-08-01"), 1), ("b", F.col("feature_date"), 0), ("c", F.col("feature_date"), 2)]
    for run, date, plus in runs:
        df = cf.withColumn("feature_date", date).withColumn("payment_volatility", F.col("payment_volatility") + plus)
        version = snapshots.publish(spark, root, {"customer_features": (df, "feature_date")}, run)
    return snapshots.read(spark, root, "customer_features").withColumn("version", F.lit(version))
