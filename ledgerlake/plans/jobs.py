"""Batch job: build everything and publish it to a store folder.

``publish_all`` is the one job entry point (it replaces the reference's
multi-process orchestration): every table is written once to Parquet under
``root``; downstream stages read the written tables, which also cuts the
lineage between stages (a lost executor recomputes from the last written
table, not from the raw inputs).
"""
from __future__ import annotations

from pyspark.sql import SparkSession

from ledgerlake.operators import position as po
from ledgerlake.plans.pipeline import Pipeline
from ledgerlake.session import run_dir
from ledgerlake.sources import files
from ledgerlake.sources.driver import StagedInputs

FEATURE_TABLES = ("customer_features", "customer_payment_scores", "invoice_features", "collections_features",
                  "vendor_features", "bill_features")


def store_root(spark: SparkSession, name: str = "store") -> str:
    return f"{run_dir(spark)}/{name}"


def publish_features(p: Pipeline, root: str) -> dict[str, str]:
    """SNK-1: the six feature tables, partitioned by feature_date; earlier dates stay."""
    tables = {
        "customer_features": p.customer_features, "customer_payment_scores": p.payment_scores,
        "invoice_features": p.invoice_features, "collections_features": p.collections_features,
        "vendor_features": p.vendor_features, "bill_features": p.bill_features,
    }
    out = {}
    for name, df in tables.items():
        date = next((c for c in ("feature_date", "score_date") if c in df.columns), None)
        path = f"{root}/features/{name}"
        out[name] = files.write_dated(df, path, date) if date else files.write_table(df, path)
    return out


def publish_forecasts(p: Pipeline, root: str) -> str:
    """SNK-2: unified forecast outputs of S1, S2, S4, S5, S6 partitioned by source_module; details per module."""
    srcs = p.forecast_sources(("S1", "S2", "S4", "S5", "S6"))
    union = None
    for df in srcs.values():
        union = df if union is None else union.unionByName(df)
    files.write_table(union, f"{root}/forecast_outputs", ["source_module"])
    for name, df in {"s3_detail": p.s3_detail, "s4_detail": p.s4_detail, "s5_detail": p.s5_detail,
                     "s6_detail": p.s6_detail, "s1_predictions": p.s1_predictions,
                     "s2_predictions": p.s2_predictions}.items():
        files.write_table(df, f"{root}/details/{name}")
    return f"{root}/forecast_outputs"


def publish_position(p: Pipeline, root: str) -> dict[str, str]:
    """SNK-3: the marked event store; daily from the source-day aggregate; weekly and monthly from the written daily."""
    ev_path = files.write_table(p.event_store, f"{root}/s7/event_store", ["source_module"])
    d_path = files.write_table(p.daily, f"{root}/s7/daily_position")
    daily = p.daily.sparkSession.read.parquet(d_path)
    return {"event_store": ev_path, "daily": d_path,
            "weekly": files.write_table(po.weekly_position(daily), f"{root}/s7/weekly_position"),
            "monthly": files.write_table(po.monthly_position(daily), f"{root}/s7/monthly_position")}


def publish_risk(p: Pipeline, root: str) -> str:
    """The risk model's classes and probabilities per customer."""
    return files.write_table(p.risk_scored, f"{root}/risk_predictions")


def publish_recommendations(p: Pipeline, root: str) -> str:
    """SNK-4."""
    return files.write_table(p.recommendations, f"{root}/recommendations")


def publish_all(spark: SparkSession, sf_dir: str, root: str | None = None, p: Pipeline | None = None) -> dict:
    """The whole job.  S1, S2 and customer risk are scored by models that this run trains on the labelled documents, saves under
    ``root`` and loads again for scoring."""
    root = root or store_root(spark)
    p = p or Pipeline(StagedInputs(spark, sf_dir, f"{root}/inputs"))
    if p.predictions == "model" and p.model_root is None:
        p.model_root = f"{root}/models"
    out = {"features": publish_features(p, root), "forecasts": publish_forecasts(p, root),
           "position": publish_position(p, root), "recommendations": publish_recommendations(p, root)}
    if p.predictions == "model":
        out["risk"] = publish_risk(p, root)
    return out


__all__ = ["publish_all", "publish_features", "publish_forecasts", "publish_position", "publish_recommendations", "publish_risk",
           "store_root"]
