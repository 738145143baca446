"""Query catalogue: the models at their configured sizes.

Model numbers can't be stated in SQL: the queries that return them (``:predictions``, ``:scores``, ``:importances``, ...) have no oracle.
Beside them each query returns the rows its model covers with properties that must
hold (finite, class scores sum to 1, a saved model predicts the same, better than a constant), and the oracle has the
same rows with all properties true.  A model that several queries use is fitted once per application and input folder.
"""
from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.operators import boosting as bo
from ledgerlake.operators import forests as fo
from ledgerlake.operators import models as ml
from ledgerlake.plans.registry import pipe, reg
from ledgerlake.session import cut_lineage, run_dir


def _kept(spark, d, name, make):
    """Designs and fitted models live with the pipeline object of the application and folder."""
    store = pipe(spark, d).__dict__.setdefault("fitted", {})
    if name not in store:
        store[name] = make()
    return store[name]


def _s1(spark, d) -> tuple[DataFrame, DataFrame, list[str]]:
    def make():
        data, feats = ml._s1_design_labelled(pipe(spark, d))
        return data, ml.compact(data.filter(F.col("is_train"))), feats
    return _kept(spark, d, "s1", make)


def _s2(spark, d) -> tuple[DataFrame, DataFrame, list[str]]:
    def make():
        data, feats = ml._s2_design_labelled(pipe(spark, d))
        return data, ml.compact(data.filter(F.col("is_train"))), feats
    return _kept(spark, d, "s2", make)


def _risk(spark, d) -> tuple[DataFrame, DataFrame, list[str]]:
    def make():
        x, train, feats = ml.risk_design(pipe(spark, d))
        return x, ml.compact(train), feats
    return _kept(spark, d, "risk", make)


def _model(spark, d, name) -> fo.Forest:
    design, fit = {
        "s1_rf": (_s1, lambda t, f: ml.baseline_regressor(t, f, ml.S1_PARAMS)),
        "s2_rf": (_s2, lambda t, f: ml.baseline_regressor(t, f, ml.S2_PARAMS)),
        "risk_rf": (_risk, lambda t, f: ml.baseline_classifier(t, f, ml.RISK_PARAMS)),
    }[name]

    def make():
        _, train, feats = design(spark, d)
        return fit(train, feats)
    return _kept(spark, d, name, make)


def _booster(spark, d, name) -> bo.Booster:
    design, make = {"s1": (_s1, lambda t, f: ml.primary_regressor(t, f, ml.S1_PARAMS)),
                    "s2": (_s2, lambda t, f: ml.primary_regressor(t, f, ml.S2_PARAMS)),
                    "risk": (_risk, lambda t, f: ml.primary_classifier(t, f, ml.RISK_PARAMS))}[name]

    def made():
        _, train, feats = design(spark, d)
        return make(train, feats)
    return _kept(spark, d, f"{name}_booster", made)


def _boosted(spark, d, name, id_col, rows=None) -> DataFrame:
    """Scored rows by the primary model: id, label, is_train, prediction (and probability)."""
    data, _, _ = {"s1": _s1, "s2": _s2, "risk": _risk}[name](spark, d)
    got = bo.predict(data if rows is None else data.filter(rows), _booster(spark, d, name), [id_col, "label", "is_train"])
    return got.withColumn("finite", _finite("prediction"))


def _finite(c: str) -> Column:
    x = F.col(c)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def _scored(spark, d, design, name, id_col) -> DataFrame:
    data, _, _ = design(spark, d)
    return fo.predict(data, _model(spark, d, name), [id_col, "label", "is_train"]).withColumn("finite", _finite("prediction"))


def _quality(scored: DataFrame) -> DataFrame:
    """Is the held-out absolute error below that of the training mean?"""
    mean = F.broadcast(scored.filter("is_train").agg(F.avg("label").alias("_m")))       # one row
    return scored.crossJoin(mean).agg(
        F.count(F.lit(1)).alias("rows"), F.every("finite").alias("all_finite"),
        (F.avg(F.when(~F.col("is_train"), F.abs(F.col("label") - F.col("prediction"))))
         < F.avg(F.when(~F.col("is_train"), F.abs(F.col("label") - F.col("_m"))))).alias("beats_constant"))


ROWS = "SELECT invoice_id, label, is_train, true AS finite FROM s1_split"
QUALITY = "SELECT count(*) AS rows, true AS all_finite, true AS beats_constant FROM s1_split"


@reg("ML-1", "invoice_id:i label:d is_train finite", ROWS)
def q_gbt(spark, d):
    return _boosted(spark, d, "s1", "invoice_id")


@reg("ML-1:predictions", "invoice_id:i label:d is_train prediction:d")
def q_gbt_predictions(spark, d):
    return _boosted(spark, d, "s1", "invoice_id")


@reg("ML-1:s2", "rows:i all_finite beats_constant", QUALITY.replace("s1_split", "s2_split"))
def q_gbt_s2(spark, d):
    return _quality(_boosted(spark, d, "s2", "bill_id"))


@reg("ML-1:s2_predictions", "bill_id:i label:d is_train prediction:d")
def q_gbt_s2_predictions(spark, d):
    return _boosted(spark, d, "s2", "bill_id")


@reg("ML-1:quality", "rows:i all_finite beats_constant", QUALITY)
def q_gbt_quality(spark, d):
    return _quality(_boosted(spark, d, "s1", "invoice_id"))


@reg("ML-2", "invoice_id:i label:d is_train finite", ROWS)
def q_rf(spark, d):
    return _scored(spark, d, _s1, "s1_rf", "invoice_id")


@reg("ML-2:quality", "rows:i all_finite beats_constant", QUALITY)
def q_rf_quality(spark, d):
    return _quality(_scored(spark, d, _s1, "s1_rf", "invoice_id"))


@reg("ML-2:s2", "rows:i all_finite beats_constant", QUALITY.replace("s1_split", "s2_split"))
def q_rf_s2(spark, d):
    return _quality(_scored(spark, d, _s2, "s2_rf", "bill_id"))


def _sound(scored: DataFrame) -> DataFrame:
    """Class scores sum to 1; the predicted class has the largest."""
    p = F.col("probability")
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    return (scored.withColumn("sums_to_one", F.abs(total - 1) < 1e-9)
            .withColumn("label_is_largest", F.get(p, F.col("prediction").cast("int")) >= F.array_max(p) - 1e-12))


RISK = "SELECT customer_id, CAST(target AS DOUBLE) AS label, true AS sums_to_one, true AS label_is_largest FROM {}"


@reg("ML-3", "customer_id:i label:d sums_to_one label_is_largest", RISK.format("risk_test"))
def q_ovr(spark, d):
    return _sound(_boosted(spark, d, "risk", "customer_id", ~F.col("is_train")))


def _with_chances(scored: DataFrame) -> DataFrame:
    return scored.select("*", *[F.get("probability", F.lit(c)).alias(f"prob_{c}") for c in range(ml.RISK_CLASSES)])


@reg("ML-3:predictions", "customer_id:i label:d is_train prediction:d prob_0:d prob_1:d prob_2:d")
def q_softmax_predictions(spark, d):
    return _with_chances(_boosted(spark, d, "risk", "customer_id"))


@reg("ML-2:predictions", "invoice_id:i label:d is_train prediction:d")
def q_rf_predictions(spark, d):
    return _scored(spark, d, _s1, "s1_rf", "invoice_id")


@reg("ML-4:predictions", "customer_id:i label:d prediction:d prob_0:d prob_1:d prob_2:d")
def q_rfc_predictions(spark, d):
    x, _, _ = _risk(spark, d)
    return _with_chances(fo.predict(x, _model(spark, d, "risk_rf"), ["customer_id", "label"]))


@reg("ML-4", "customer_id:i label:d sums_to_one label_is_largest", RISK.format("risk_test"))
def q_rfc(spark, d):
    x, _, _ = _risk(spark, d)
    return _sound(fo.predict(x.filter(~F.col("is_train")), _model(spark, d, "risk_rf"), ["customer_id", "label"]))


def _folds(spark, d, name) -> DataFrame:
    """Held-out scores of the primary model, one row a fold (bounded), all folds trained in the same passes."""
    def make():
        if name == "s1":
            _, train, feats = _s1(spark, d)
            p = ml.S1_PARAMS
            got = bo.cross_validate(train, feats, p.booster, "mae", p.folds, "invoice_id")
        else:
            _, train, feats = _risk(spark, d)
            p = ml.RISK_PARAMS
            got = bo.cross_validate(train, feats, p.booster, "f1_macro", p.folds, "customer_id", bo.SOFTMAX, ml.RISK_CLASSES)
        return cut_lineage(got, f"cv_{name}")
    return _kept(spark, d, f"{name}_folds", make)


def _summary(folds: DataFrame, metric: str) -> DataFrame:
    return folds.agg(F.lit(metric).alias("metric"), F.avg("score").alias("cv_mean"), F.stddev_pop("score").alias("cv_std"),
                     F.count(F.lit(1)).alias("folds"))


@reg("ML-6", "metric folds:i finite", "SELECT 'mae' AS metric, 5 AS folds, true AS finite")
def q_cv(spark, d):
    return _summary(_folds(spark, d, "s1"), "mae").withColumn("finite", _finite("cv_mean") & _finite("cv_std"))


@reg("ML-6:scores", "metric cv_mean:d cv_std:d folds:i")
def q_cv_scores(spark, d):
    return _summary(_folds(spark, d, "s1"), "mae").unionByName(_summary(_folds(spark, d, "risk"), "f1_macro"))


@reg("ML-6:folds", "fold:i rows:i score:d")
def q_cv_folds(spark, d):
    return _folds(spark, d, "s1")


@reg("ML-6:f1", "metric folds:i better_than_chance", "SELECT 'f1_macro' AS metric, 5 AS folds, true AS better_than_chance")
def q_cv_f1(spark, d):
    return _summary(_folds(spark, d, "risk"), "f1_macro").withColumn("better_than_chance", F.col("cv_mean") > 1 / 3)


@reg("ML-7:importances", "model feature importance:d rank:i")
def q_importances(spark, d):
    """Top ten features of the three boosters by how often they split a leaf, and of the S1 forest.  The four are fitted side by side,
    as a fit in one task leaves the other cores free."""
    for design in (_s1, _s2, _risk):
        design(spark, d)
    with ThreadPoolExecutor(4) as pool:
        fits = [pool.submit(_booster, spark, d, name) for name in ("s2", "s1", "risk")] + [pool.submit(_model, spark, d, "s1_rf")]
    for fit in fits:
        fit.result()
    rows = []
    for name in ("s1", "s2", "risk"):
        m = _booster(spark, d, name)
        top = sorted(zip(m.features, m.importance()), key=lambda r: (-r[1], r[0]))[:10]
        rows += [(name, f, float(v), i + 1) for i, (f, v) in enumerate(top)]
    forest = fo.importances(_model(spark, d, "s1_rf"), spark, 10).withColumn("model", F.lit("s1_forest"))
    return spark.createDataFrame(rows, "model string, feature string, importance double, rank int").unionByName(forest)


@reg("ML-7", "rank:i known ordered", "SELECT i + 1 AS rank, true AS known, true AS ordered FROM range(10) r(i)")
def q_importance(spark, d):
    from pyspark.sql import Window
    _, _, feats = _s1(spark, d)
    top = fo.importances(_model(spark, d, "s1_rf"), spark, 10)                          # ten rows
    above = F.lag("importance").over(Window.orderBy("rank"))
    return (top.withColumn("known", F.col("feature").isin(feats))
            .withColumn("ordered", F.coalesce(above >= F.col("importance"), F.lit(True)) & (F.col("importance") >= 0)))


@reg("ML-8", "customer_id:i label:d sums_to_one label_is_largest", RISK.format("risk_eval"))
def q_predict_proba(spark, d):
    return _sound(_boosted(spark, d, "risk", "customer_id"))


@reg("QY-8:model", "customer_id:i known_class", "SELECT customer_id, true AS known_class FROM risk_eval")
def q_score_by_model(spark, d):
    """Risk scoring by the trained forest (QY-8 on model output)."""
    x, _, _ = _risk(spark, d)
    return fo.predict(x, _model(spark, d, "risk_rf"), ["customer_id"]).withColumn("known_class", F.col("prediction").isin(0.0, 1.0, 2.0))


def _reloaded(spark, d, name) -> fo.Forest:
    return fo.load(spark, fo.save(_model(spark, d, name), spark, f"{run_dir(spark)}/models/{name}"))


@reg("SNK-6", "invoice_id:i same", "SELECT invoice_id, true AS same FROM s1_split")
def q_model_roundtrip(spark, d):
    """A model saved to the run's shared folder and loaded back predicts the same (SNK-6 + SRC-6)."""
    data, _, _ = _s1(spark, d)
    a = fo.predict(data, _model(spark, d, "s1_rf"), ["invoice_id"], "one")
    b = fo.predict(data, _reloaded(spark, d, "s1_rf"), ["invoice_id"], "two")
    return a.join(b, "invoice_id").withColumn("same", F.col("one") == F.col("two"))


@reg("SRC-6", "customer_id:i label:d sums_to_one label_is_largest", RISK.format("risk_eval"))
def q_model_load(spark, d):
    """Risk classifier saved to and loaded from the shared folder, then used for batch scoring."""
    x, _, _ = _risk(spark, d)
    return _sound(fo.predict(x, _reloaded(spark, d, "risk_rf"), ["customer_id", "label"]))
