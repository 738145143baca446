"""The whole batch job as one object graph of stages.

``Pipeline(tables, cfg)`` exposes every stage as a property built on first
use, so a query that needs only the cash position builds only what it depends
on.  Stages that several consumers read (the six feature tables and the event
store, which the dedup rules read three times) are materialised once as
Parquet in the shared checkpoint folder -- the feature-store contract of the
original design -- so each consumer scans a table instead of recomputing its
lineage, and a lost executor recomputes from the last written stage only.
Single-consumer stages (prediction tables, forecasts) stay lazy and are
fused into their consumer's plan; ``publish_all`` writes them as outputs.
"""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.config import DEFAULT, Settings
from ledgerlake.operators import features as fe
from ledgerlake.operators import forecasts as fc
from ledgerlake.operators import models
from ledgerlake.operators import position as po
from ledgerlake.operators import predictions as pp
from ledgerlake.operators import training as tr
from ledgerlake.session import cut_lineage
from ledgerlake.sources.driver import finance_tables


class Pipeline:
    def __init__(self, tables: dict[str, DataFrame], cfg: Settings = DEFAULT, predictions: str = "model",
                 materialize: bool = True):
        self.t = tables
        self.cfg = cfg
        # "model": trained MLlib models, what a job publishes.  "pseudo": deterministic numbers made from the true
        # labels, which only the queries that are compared with an oracle ask for
        if predictions not in ("model", "pseudo"):
            raise ValueError(predictions)
        self.predictions = predictions
        self.model_root: str | None = None   # where trained models are saved and loaded again for scoring
        self.s1_params, self.s2_params, self.risk_params = models.S1_PARAMS, models.S2_PARAMS, models.RISK_PARAMS
        self.materialize = materialize   # False: one lazy plan end to end (for explain / plan review)

    def _stage(self, df: DataFrame, name: str) -> DataFrame:
        return cut_lineage(df, name) if self.materialize else df

    @classmethod
    def from_driver(cls, spark: SparkSession, sf_dir: str, cfg: Settings = DEFAULT, **kw) -> "Pipeline":
        return cls(finance_tables(spark, sf_dir), cfg, **kw)

    # ---------------------------------------------------------------- features
    @cached_property
    def customer_features(self) -> DataFrame:
        return self._stage(fe.customer_features(self.t, self.cfg), "customer_features")

    @cached_property
    def payment_scores(self) -> DataFrame:
        return self._stage(fe.payment_scores(self.customer_features, self.cfg), "payment_scores")

    @cached_property
    def invoice_features(self) -> DataFrame:
        return self._stage(fe.invoice_features(self.t, self.cfg), "invoice_features")

    @cached_property
    def collections_features(self) -> DataFrame:
        return self._stage(fe.collections_features(self.t, self.customer_features, self.cfg), "collections_features")

    @cached_property
    def vendor_features(self) -> DataFrame:
        return self._stage(fe.vendor_features(self.t, self.cfg), "vendor_features")

    @cached_property
    def bill_features(self) -> DataFrame:
        return self._stage(fe.bill_features(self.t, self.cfg), "bill_features")

    @cached_property
    def customer_delays(self) -> DataFrame:
        """Average payment delay per customer, from the AR join alone (S3/S4 need nothing else of the feature table)."""
        return fe.customer_delays(self.t)

    # ---------------------------------------------------------------- targets
    @cached_property
    def ar_labelled(self) -> DataFrame:
        """Paid invoices with ``days_to_pay`` (the S1 population)."""
        inv = self.t["invoices"].select("invoice_id", "customer_id", "invoice_date", "due_date", "invoice_amount")
        return tr.ar_target(inv, fe.payments_of(self.t, "AR"), self.cfg)

    @cached_property
    def ap_labelled(self) -> DataFrame:
        docs = tr.ap_documents(self.t["bills"].select("bill_id", "vendor_id", "bill_date", "due_date", "bill_amount"),
                               self.t["vendors"])
        return tr.ap_target(docs, fe.payments_of(self.t, "AP"), self.cfg)

    # ---------------------------------------------------------------- predictions
    @cached_property
    def ar_scored(self) -> DataFrame:
        if self.predictions == "pseudo":
            return pp.pseudo_predictions(self.ar_labelled, "invoice_id", "days_to_pay")
        return self._stage(models.score_ar(self, self.s1_params), "ar_scored")

    @cached_property
    def ap_scored(self) -> DataFrame:
        if self.predictions == "pseudo":
            return pp.pseudo_predictions(self.ap_labelled, "bill_id", "adjustment_delta")
        return self._stage(models.score_ap(self, self.s2_params), "ap_scored")

    @cached_property
    def risk_scored(self) -> DataFrame:
        """Customers' risk classes and class probabilities by the trained risk models."""
        return self._stage(models.score_risk(self, self.risk_params), "risk_scored")

    @cached_property
    def s1_predictions(self) -> DataFrame:
        return pp.ar_predictions(self.ar_scored, self.cfg)

    @cached_property
    def s2_predictions(self) -> DataFrame:
        return pp.ap_predictions(self.ap_scored, self.cfg)

    # ---------------------------------------------------------------- forecasts
    @cached_property
    def s3_detail(self) -> DataFrame:
        return fc.wip_forecast(self.t["project_milestones"], self.customer_delays, self.cfg)

    @cached_property
    def s4_detail(self) -> DataFrame:
        return fc.pipeline_forecast(self.t["crm_pipeline"], self.customer_delays, self.cfg)

    @cached_property
    def s5_detail(self) -> DataFrame:
        return fc.inflow_forecast(self.t["contingent_inflows"], self.cfg)

    @cached_property
    def s6_detail(self) -> DataFrame:
        return fc.expense_forecast(self.t["expense_schedule"], self.cfg)

    def forecast_sources(self, which=("S1", "S2", "S3", "S4", "S5", "S6")) -> dict[str, DataFrame]:
        src = {
            "S1": lambda: pp.prediction_outputs(self.s1_predictions, self.cfg),
            "S2": lambda: pp.prediction_outputs(self.s2_predictions, self.cfg),
            "S3": lambda: self.s3_detail,
            "S4": lambda: fc.pipeline_outputs(self.s4_detail, self.cfg),
            "S5": lambda: fc.inflow_outputs(self.s5_detail, self.cfg),
            "S6": lambda: fc.expense_outputs(self.s6_detail, self.cfg),
        }
        return {k: src[k]() for k in which}

    # ---------------------------------------------------------------- cash position
    @cached_property
    def raw_events(self) -> DataFrame:
        """Normalised event store, written once to the shared folder."""
        return self._stage(po.event_store(self.forecast_sources(), self.cfg), "event_store")

    @cached_property
    def event_store(self) -> DataFrame:
        """The events, marked by the dedup rules."""
        return po.dedup(self.raw_events)

    @cached_property
    def source_days(self) -> DataFrame:
        """The marked event store at (source, day) grain: all S7 figures below event level read this small table."""
        return self._stage(po.source_days(self.raw_events), "source_days")

    @cached_property
    def daily(self) -> DataFrame:
        return po.daily_position(po.active(self.source_days), self.cfg)

    # ---------------------------------------------------------------- recommendations
    @cached_property
    def overdue(self) -> DataFrame:
        from ledgerlake.operators import recommend as re_
        return re_.overdue_view(self.invoice_features, self.collections_features, self.payment_scores,
                                self.s1_predictions)

    @cached_property
    def lever_collections(self) -> DataFrame:
        from ledgerlake.operators import recommend as re_
        return re_.collections_lever(re_.overdue_scores(self.invoice_features, self.payment_scores), self.s1_predictions,
                                     self.cfg)

    @cached_property
    def lever_vendor(self) -> DataFrame:
        from ledgerlake.operators import recommend as re_
        return re_.vendor_deferral_lever(self.s2_predictions, self.cfg)

    @cached_property
    def lever_expense(self) -> DataFrame:
        from ledgerlake.operators import recommend as re_
        return re_.expense_deferral_lever(self.s6_detail, self.cfg)

    @cached_property
    def recommendations(self) -> DataFrame:
        from ledgerlake.operators import recommend as re_
        return re_.rank_recommendations([self.lever_collections, self.lever_vendor, self.lever_expense], self.cfg)

    # ---------------------------------------------------------------- evaluation frames
    @cached_property
    def s1_eval(self) -> DataFrame:
        """S1 scored rows with the time-based split (label = days_to_pay)."""
        s = self.ar_scored.withColumn("label", F.col("days_to_pay").cast("double")) \
                          .withColumn("prediction", F.col("pred_primary"))
        return tr.time_split(s, ["invoice_date", "invoice_id"], self.cfg.test_size)

    @cached_property
    def s2_eval(self) -> DataFrame:
        vf = self.vendor_features.select("vendor_id", "invoice_count")
        s = (self.ap_scored.join(vf, "vendor_id", "left")
             .withColumn("label", F.col("adjustment_delta").cast("double"))
             .withColumn("prediction", F.col("pred_primary")))
        return tr.time_split(s, ["bill_date", "bill_id"], self.cfg.test_size)

    @cached_property
    def risk_eval(self) -> DataFrame:
        """Risk classes with a stratified split and deterministic pseudo class predictions/probabilities."""
        df = tr.risk_training_frame(self.customer_features, self.payment_scores)
        df = tr.stratified_split(df, "target", "customer_id", self.cfg.test_size, self.cfg.seed)
        cid = F.col("customer_id")
        pred = (F.col("target") + F.when(cid % 4 == 0, 1).otherwise(0)) % 3
        base = (F.col("target") + F.when(cid % 5 == 0, 2).otherwise(0)) % 3
        df = df.withColumn("label", F.col("target")).withColumn("prediction", pred).withColumn("baseline_class", base)
        for c in (0, 1, 2):
            df = df.withColumn(f"prob_{c}", F.when(F.col("prediction") == c, 0.6).otherwise(0.2) + (cid % 5) * 0.01)
        return df
