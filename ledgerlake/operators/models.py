"""Payment-timing and customer-risk models.

The primary models are leaf-wise histogram boosters (``operators/boosting.py``): a regression, and for the risk classes a joint
softmax model.  The baselines are random forests (``operators/forests.py``); class imbalance is a per-row weight column.  Training
only ever pulls sums over rows to the driver.  MLlib's boosted trees and forests remain as alternatives.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline as MLPipeline
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.operators import boosting, forests
from ledgerlake.session import cut_lineage


@dataclass(frozen=True)
class ModelParams:
    """fixed values: hyper-parameters of the primary booster and the baseline forest."""
    gbt_iter: int = 500
    gbt_depth: int = 8
    gbt_step: float = 0.05
    gbt_min_instances: int = 20
    gbt_subsample: float = 1.0        # row subsampling is inactive without a bagging frequency, and none is set
    gbt_feature_subset: str = "0.8"
    rf_trees: int = 300
    rf_depth: int = 12
    rf_min_instances: int = 5
    seed: int = 42
    folds: int = 5
    leaves: int = 63
    alpha: float = 0.1
    lambda_: float = 0.1

    @property
    def booster(self) -> boosting.BoosterParams:
        return boosting.BoosterParams(
            rounds=self.gbt_iter, depth=self.gbt_depth, leaves=self.leaves, rate=self.gbt_step, min_rows=self.gbt_min_instances,
            alpha=self.alpha, lambda_=self.lambda_, feature_share=float(self.gbt_feature_subset), seed=self.seed)

    @property
    def forest(self) -> forests.ForestParams:
        return forests.ForestParams(trees=self.rf_trees, depth=self.rf_depth, min_rows=self.rf_min_instances, seed=self.seed)


S1_PARAMS = ModelParams()
S2_PARAMS = ModelParams(gbt_iter=400, gbt_depth=6, rf_depth=10, leaves=31)
RISK_PARAMS = ModelParams(gbt_iter=400, gbt_depth=6, rf_depth=10, leaves=31)
RISK_CLASSES = 3


def assembler(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")


def gbt_regressor(p: ModelParams, label: str = "label") -> GBTRegressor:
    """ML-1."""
    return GBTRegressor(labelCol=label, featuresCol="features", predictionCol="prediction", maxIter=p.gbt_iter,
                        maxDepth=p.gbt_depth, stepSize=p.gbt_step, minInstancesPerNode=p.gbt_min_instances,
                        subsamplingRate=p.gbt_subsample, featureSubsetStrategy=p.gbt_feature_subset, seed=p.seed,
                        checkpointInterval=20)


def rf_regressor(p: ModelParams, label: str = "label") -> RandomForestRegressor:
    """ML-2."""
    return RandomForestRegressor(labelCol=label, featuresCol="features", predictionCol="prediction",
                                 numTrees=p.rf_trees, maxDepth=p.rf_depth, minInstancesPerNode=p.rf_min_instances,
                                 featureSubsetStrategy="sqrt", seed=p.seed)


def gbt_multiclass(p: ModelParams, label: str = "label", weight: str | None = "class_weight") -> OneVsRest:
    """ML-3: one-vs-rest over binary GBTs, balanced class weights."""
    base = GBTClassifier(featuresCol="features", maxIter=p.gbt_iter, maxDepth=p.gbt_depth, stepSize=p.gbt_step,
                         minInstancesPerNode=p.gbt_min_instances, subsamplingRate=p.gbt_subsample,
                         featureSubsetStrategy=p.gbt_feature_subset, seed=p.seed, checkpointInterval=20)
    ovr = OneVsRest(classifier=base, labelCol=label, featuresCol="features", predictionCol="prediction",
                    rawPredictionCol="rawPrediction", parallelism=3)
    if weight:
        ovr = ovr.setWeightCol(weight)
    return ovr


def rf_classifier(p: ModelParams, label: str = "label", weight: str | None = "class_weight_squared") -> RandomForestClassifier:
    """ML-4.  The forest takes the balanced sample weights and balanced class weights: they multiply."""
    rf = RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=p.rf_trees, maxDepth=p.rf_depth,
                                minInstancesPerNode=p.rf_min_instances, featureSubsetStrategy="sqrt", seed=p.seed)
    if weight:
        rf = rf.setWeightCol(weight)
    return rf


ROWS_PER_TASK = 100_000


def compact(train: DataFrame) -> DataFrame:
    """The design matrix in as many partitions as its rows ask for, and no fewer than there are cores: every round is several
    jobs over it."""
    spark = train.sparkSession
    return train.repartition(max(spark.sparkContext.defaultParallelism, -(-train.count() // ROWS_PER_TASK)))


def primary_regressor(train: DataFrame, feats: list[str], p: ModelParams) -> boosting.Booster:
    """ML-1."""
    return boosting.train(train, feats, p.booster)[0]


def primary_classifier(train: DataFrame, feats: list[str], p: ModelParams, weight: str | None = "class_weight") -> boosting.Booster:
    """ML-3: one softmax model of all classes, balanced class weights."""
    return boosting.train(train, feats, p.booster, boosting.SOFTMAX, RISK_CLASSES, weight=weight)[0]


def baseline_regressor(train: DataFrame, feats: list[str], p: ModelParams) -> forests.Forest:
    """ML-2."""
    return forests.train(train, feats, p.forest)


def baseline_classifier(train: DataFrame, feats: list[str], p: ModelParams, weight: str | None = "class_weight_squared") -> forests.Forest:
    """ML-4.  The forest takes the balanced sample weights and balanced class weights: they multiply."""
    return forests.train(train, feats, p.forest, RISK_CLASSES, weight=weight)


def class_scores(model: PipelineModel, df: DataFrame, keep: list[str]) -> DataFrame:
    """ML-3/ML-8: one-vs-rest class scores: each class's own probability, normalised to sum 1, and the class with
    the largest (the smallest of equals)."""
    ovr = model.stages[-1]
    x = model.stages[0].transform(df)
    for k, m in enumerate(ovr.models):
        out = m.transform(x.select("*"))
        x = out.withColumn(f"_p{k}", vector_to_array("probability")[1]).drop("rawPrediction", "probability", m.getPredictionCol())
    ps = [F.col(f"_p{k}") for k in range(len(ovr.models))]
    total = sum(ps[1:], ps[0])
    scores = F.array(*[F.when(total > 0, p / total).otherwise(F.lit(1.0 / len(ps))) for p in ps])
    return x.withColumn("probability", scores).select(
        *keep, (F.array_position("probability", F.array_max("probability")) - 1).cast("double").alias("prediction"), "probability")


def macro_f1(scored: DataFrame, label: str = "label") -> float:
    """Macro F1 from the confusion counts (k*k rows)."""
    from ledgerlake.operators.metrics import classification_metrics
    return classification_metrics(scored, y=label).first()["f1_macro"]


def fit(train: DataFrame, features: list[str], estimator) -> PipelineModel:
    return MLPipeline(stages=[assembler(features), estimator]).fit(train)


def cross_validate(train: DataFrame, features: list[str], estimator, metric: str = "mae", folds: int = 5,
                   seed: int = 42, label: str = "label", id_col: str | None = None) -> DataFrame:
    """ML-6: k-fold CV; mean and standard deviation (over the folds) of MAE or macro F1, as one row.

    A row's fold comes from a hash of its id, so folds are the same on every run."""
    row = F.col(id_col) if id_col else F.xxhash64(*features)
    data = train.withColumn("_fold", F.pmod(F.xxhash64(row, F.lit(seed)), F.lit(folds)))
    got = []
    for k in range(folds):
        m = fit(data.filter(F.col("_fold") != k), features, estimator)
        held = m.transform(data.filter(F.col("_fold") == k))
        if metric == "f1_macro":
            got.append(macro_f1(held, label))
        else:
            got.append(held.agg(F.avg(F.abs(F.col(label) - F.col("prediction")))).first()[0])
    got = [float(x) for x in got if x is not None]
    mean = sum(got) / len(got) if got else None
    std = (sum((x - mean) ** 2 for x in got) / len(got)) ** 0.5 if got else None
    return train.sparkSession.createDataFrame([(metric, mean, std, folds)],
                                              "metric string, cv_mean double, cv_std double, folds int")


def importances(model: PipelineModel, features: list[str], top: int = 10) -> DataFrame:
    """ML-7: feature importance ranking (the vector has one entry per feature: bounded)."""
    m = model.stages[-1]
    if hasattr(m, "featureImportances"):
        imp = m.featureImportances.toArray()
    else:                                                       # one-vs-rest: average over the binary models
        arrs = [sub.featureImportances.toArray() for sub in m.models]
        imp = sum(arrs) / len(arrs)
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    rows = sorted(zip(features, [float(x) for x in imp]), key=lambda r: (-r[1], r[0]))[:top]
    return spark.createDataFrame([(f, v, i + 1) for i, (f, v) in enumerate(rows)],
                                 "feature string, importance double, rank int")


def predict(model: PipelineModel, df: DataFrame, keep: list[str], out: str = "prediction") -> DataFrame:
    """ML-8: batch prediction; class probabilities (if any) as an array column."""
    p = model.transform(df)
    cols = [*keep, F.col("prediction").alias(out)]
    if "probability" in p.columns:
        cols.append(vector_to_array("probability").alias("probability"))
    return p.select(*cols)


def save(model: PipelineModel, path: str) -> str:
    """SNK-6."""
    model.write().overwrite().save(path)
    return path


def load(path: str) -> PipelineModel:
    """SRC-6."""
    return PipelineModel.load(path)


# ------------------------------------------------------------------ pipeline hooks
def _s1_design_labelled(p):
    from ledgerlake.operators import training as tr
    from ledgerlake.operators.lookups import S1_FEATURES
    from ledgerlake.config import S1_ORDINAL
    f = tr.s1_training_frame(p.invoice_features, p.customer_features, p.collections_features, p.payment_scores)
    f = tr.bools_to_int(tr.ordinal_encode(f, S1_ORDINAL), ["dispute_flag", "partial_payment_flag", "promise_to_pay_flag"])
    x = tr.select_features(f, S1_FEATURES, keep=["invoice_id"])
    lab = p.ar_labelled.select("invoice_id", "invoice_date", "days_to_pay")
    d = lab.join(x, "invoice_id", "inner").withColumn("label", F.col("days_to_pay").cast("double"))
    # materialised once: every boosting/forest pass then scans the checkpoint, not the feature pipeline
    return cut_lineage(tr.time_split(d, ["invoice_date", "invoice_id"], p.cfg.test_size)), S1_FEATURES


def _trained(p, name: str, model: forests.Forest) -> forests.Forest:
    """Save below the job's folder and load again: scoring uses what was persisted."""
    if not p.model_root:
        return model
    spark = p.t["customers"].sparkSession
    return forests.load(spark, forests.save(model, spark, f"{p.model_root}/{name}"))


def _kept(p, name: str, model: boosting.Booster) -> boosting.Booster:
    """Save below the job's folder and load again, likewise."""
    if not p.model_root:
        return model
    spark = p.t["customers"].sparkSession
    return boosting.load(spark, boosting.save(model, spark, f"{p.model_root}/{name}"))


def score_ar(p, params: ModelParams = S1_PARAMS) -> DataFrame:
    """S1 scoring with trained models: pred_primary (GBT) and pred_baseline (RF) for every paid invoice."""
    d, feats = _s1_design_labelled(p)
    train = compact(d.filter(F.col("is_train")))
    primary = _kept(p, "s1_primary", primary_regressor(train, feats, params))
    a = boosting.predict(d, primary, ["invoice_id"], "pred_primary")
    b = forests.predict(d, _trained(p, "s1_baseline", baseline_regressor(train, feats, params)), ["invoice_id"], "pred_baseline")
    return p.ar_labelled.join(a, "invoice_id").join(b, "invoice_id")


def _s2_design_labelled(p):
    from ledgerlake.operators import training as tr
    from ledgerlake.operators.lookups import S2_FEATURES
    f = tr.s2_training_frame(p.bill_features, p.vendor_features, p.t["vendors"], p.t["bills"])
    f = (f.withColumn("bill_amount_bucket_enc", F.coalesce(tr.lookup("bill_amount_bucket",
                                                                     {"SMALL": 0, "MEDIUM": 1, "LARGE": 2}), F.lit(1)))
          .withColumn("approval_status_enc", F.coalesce(tr.lookup("approval_status", {"PENDING": 0, "APPROVED": 1}),
                                                        F.lit(1))))
    f = tr.bools_to_int(f, ["early_payment_eligible", "penalty_accruing"])
    x = tr.select_features(f, S2_FEATURES, keep=["bill_id"])
    d = p.ap_labelled.join(x.drop("bill_amount"), "bill_id", "inner").withColumn(
        "label", F.col("adjustment_delta").cast("double"))
    feats = [c for c in S2_FEATURES if c != "bill_amount"] + ["bill_amount"]
    return cut_lineage(tr.time_split(d, ["bill_date", "bill_id"], p.cfg.test_size)), feats


def score_ap(p, params: ModelParams = S2_PARAMS) -> DataFrame:
    """S2 scoring: the adjustment in days to the vendor's terms, for every paid bill."""
    d, feats = _s2_design_labelled(p)
    train = compact(d.filter(F.col("is_train")))
    primary = _kept(p, "s2_primary", primary_regressor(train, feats, params))
    a = boosting.predict(d, primary, ["bill_id"], "pred_primary")
    b = forests.predict(d, _trained(p, "s2_baseline", baseline_regressor(train, feats, params)), ["bill_id"], "pred_baseline")
    return p.ap_labelled.join(a, "bill_id").join(b, "bill_id")


def risk_design(p):
    from ledgerlake.operators import training as tr
    from ledgerlake.operators.lookups import CR_FEATURES
    f = tr.risk_training_frame(p.customer_features, p.payment_scores)
    f = tr.stratified_split(f, "target", "customer_id", p.cfg.test_size, p.cfg.seed)
    x = f.select("customer_id", "is_train", F.col("target").cast("double").alias("label"),
                 *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in CR_FEATURES])
    x = cut_lineage(x)
    train = tr.class_weights(x.filter(F.col("is_train")), "label")
    train = cut_lineage(train.withColumn("class_weight_squared", F.col("class_weight") * F.col("class_weight")))
    return x, train, CR_FEATURES


def score_risk(p, params: ModelParams = RISK_PARAMS) -> DataFrame:
    """Every customer's risk class by the trained models: customer_id, label, is_train, prediction, prob_0.. (primary), baseline_class."""
    x, train, feats = risk_design(p)
    train = compact(train)
    primary = _kept(p, "risk_primary", primary_classifier(train, feats, params))
    a = boosting.predict(x, primary, ["customer_id", "label", "is_train"])
    a = a.select("customer_id", "label", "is_train", "prediction",
                 *[F.get("probability", F.lit(c)).alias(f"prob_{c}") for c in range(RISK_CLASSES)])
    baseline = _trained(p, "risk_baseline", baseline_classifier(train, feats, params))
    return a.join(forests.predict(x, baseline, ["customer_id"], "baseline_class").drop("probability"), "customer_id")
