"""Models in the job, with small ensembles (the registered queries use the configured sizes)."""
from dataclasses import replace

from pyspark.sql import functions as F

from ledgerlake.operators import models as ml
from ledgerlake.plans.jobs import publish_all
from ledgerlake.plans.pipeline import Pipeline
from ledgerlake.sources.driver import StagedInputs

SMALL = "/root/testdata/sf0.001"


def _few(p):
    return replace(p, gbt_iter=3, rf_trees=3, gbt_depth=3, rf_depth=4)


def test_the_job_trains_saves_and_scores_models(spark, tmp_path):
    p = Pipeline(StagedInputs(spark, SMALL, str(tmp_path / "in")))
    assert p.predictions == "model"
    p.s1_params, p.s2_params, p.risk_params = _few(p.s1_params), _few(p.s2_params), _few(p.risk_params)
    out = publish_all(spark, SMALL, str(tmp_path / "out"), p)
    assert {x.name for x in (tmp_path / "out/models").iterdir()} == {
        f"{x}_{y}" for x in ("s1", "s2", "risk") for y in ("primary", "baseline")}
    risk = spark.read.parquet(out["risk"])
    assert risk.count() == p.risk_eval.count() and risk.filter("abs(prob_0 + prob_1 + prob_2 - 1) > 1e-9").count() == 0
    fo = spark.read.parquet(out["forecasts"])
    assert {r[0] for r in fo.select("source_module").distinct().collect()} >= {"S1", "S2"}
    scored = p.ar_scored
    n = scored.count()
    assert n == p.ar_labelled.count() and scored.filter("pred_primary is null or isnan(pred_primary)").count() == 0
    # forecasts come from the models, not from the labels
    assert scored.filter(F.col("pred_primary") != F.col("days_to_pay") + F.col("invoice_id") % 11 - 5).count() > n / 2
    assert spark.read.parquet(out["recommendations"]).count() > 0


def test_class_scores_and_cross_validation(spark):
    rows = [(float(i % 3), i % 3 + (i * 7 % 10) / 20, (i * 13 % 17) / 17, 1.0, 1.0, i) for i in range(300)]
    df = spark.createDataFrame(rows, "label double, a double, b double, class_weight double, class_weight_squared double, id long")
    p = _few(ml.RISK_PARAMS)
    got = ml.class_scores(ml.fit(df, ["a", "b"], ml.gbt_multiclass(p)), df, ["id", "label"]).toPandas()
    assert all(abs(sum(x) - 1) < 1e-9 and max(x) == x[int(c)] for x, c in zip(got.probability, got.prediction))
    assert (got.label == got.prediction).mean() > 0.9
    cv = ml.cross_validate(df, ["a", "b"], ml.rf_classifier(p), "f1_macro", 3, id_col="id").first()
    assert cv.folds == 3 and cv.cv_mean > 0.8 and cv.cv_std >= 0
    again = ml.cross_validate(df, ["a", "b"], ml.rf_classifier(p), "f1_macro", 3, id_col="id").first()
    assert tuple(cv) == tuple(again)


def _forest_rows(spark, n=4000):
    import numpy as np
    rng = np.random.default_rng(3)
    x = rng.random((n, 4))
    rows = [(i, float(a), None if i % 50 == 0 else float(b), float(c), float(d), 3.0 * (a > 0.5) + b + 0.1 * d, float(int(3 * a)), 1.0 + (i % 2))
            for i, (a, b, c, d) in enumerate(x.tolist())]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, d double, label double, cls double, w double")


def test_forests_over_blocks_and_passes(spark, tmp_path, monkeypatch):
    """Trees of one task and of passes are equal; over many blocks the forest is as good; a saved one predicts the same."""
    from ledgerlake.operators import forests as fo
    df, feats = _forest_rows(spark), ["a", "b", "c", "d"]
    p = fo.ForestParams(trees=12, depth=6, min_rows=5)
    one = fo.train(df, feats, p)
    assert len(one.trees) == 12 and one.importance[0] > 0.8 and abs(sum(one.importance) - 1) < 1e-9
    both = []

    def twice(units, n, shares, classes, p):
        both.append([whole(units, n, shares, classes, p), fo._in_passes(spark, units, n, shares, 1, classes, p)])
        return both[0][1]
    whole = fo._one_block
    monkeypatch.setattr(fo, "_one_block", twice)
    fo.train(df, feats, p)
    monkeypatch.undo()
    assert len(both[0][0]) == 12 and both[0][0] == both[0][1]
    many = fo.train(df, feats, replace(p, block_rows=700))
    for m in (one, many):
        got = fo.predict(df, m, ["id", "label"]).toPandas()
        assert len(got) == 4000 and (got.prediction - got.label).abs().mean() < 0.15
    # every leaf holds min_rows draws, no tree is deeper than asked, children follow their parents
    for t in many.trees:
        depth = {0: 0}
        for n, c in enumerate(t.child):
            assert c == n and t.cut[n] == fo.LEAF or c > n
            if c > n:
                depth[c] = depth[c + 1] = depth[n] + 1
        assert max(depth.values()) <= 6 and len(depth) == len(t.child)
    again = fo.load(spark, fo.save(many, spark, str(tmp_path / "m")))
    two = fo.predict(df, again, ["id"], "two").join(fo.predict(df, many, ["id"], "one"), "id")
    assert two.filter("one <> two").count() == 0 and again.importance == many.importance
    empty = fo.predict(df, fo.train(df.limit(0), feats, p), ["id"]).first()
    assert empty.prediction == 0


def test_forest_classes_and_weights(spark):
    from ledgerlake.operators import forests as fo
    df, feats = _forest_rows(spark), ["a", "b"]
    p = fo.ForestParams(trees=10, depth=5, min_rows=5)
    for block_rows in (1_000_000, 900):
        m = fo.train(df, feats, replace(p, block_rows=block_rows), 3, label="cls", weight="w")
        got = fo.predict(df, m, ["id", "cls"]).toPandas()
        assert (got.cls == got.prediction).mean() > 0.95
        assert all(abs(sum(x) - 1) < 1e-9 and max(x) == x[int(c)] for x, c in zip(got.probability, got.prediction))
    # one node's cut by hand: bins of one feature, Gini times weight
    import numpy as np
    sums = np.array([[[[4., 0., 0.]]], [[[0., 6., 2.]]], [[[4., 6., 2.]]]])
    f, cut, gain, value = fo.best_cuts(sums, np.array([[7]]), replace(p, min_rows=1), 2, False)
    assert f[0] == 7 and cut[0] == 0 and abs(gain[0] - (12 - (16 + 64) / 12)) < 1e-9 and value[0].tolist() == [4 / 12, 8 / 12]
    # the trees' stage is no MLlib model: the registered queries fit this forest
    assert isinstance(ml.baseline_classifier(df.withColumn("class_weight_squared", F.col("w")).withColumn("label", F.col("cls")), feats,
                                             replace(ml.RISK_PARAMS, rf_trees=2, rf_depth=2)), fo.Forest)


def test_forest_rows_are_worked_on_by_chunks(monkeypatch):
    """F2, F13 to F17: sums and descents hold temporaries of a chunk, not of a block, and give what plain loops give."""
    import tracemalloc

    import numpy as np
    from ledgerlake.operators import forests as fo
    rng = np.random.default_rng(6)
    x, rows, at = rng.integers(0, 8, (5, 900)).astype(np.uint8), np.flatnonzero(rng.random(900) < 0.6), rng.integers(0, 3, 900)
    at, values, picks = at[rows], [rng.normal(size=len(rows)), np.ones(len(rows))], np.array([[0, 2], [1, 4], [2, 3]])
    tree = fo.Tree(np.array([1, 0, 3, 0, 0]), np.array([3, fo.LEAF, 2, fo.LEAF, fo.LEAF]), np.array([1, 1, 3, 3, 4]), np.zeros((5, 1)))
    for chunk in (64, 1 << 16):
        monkeypatch.setattr(fo, "CHUNK", chunk)
        got = fo.level_sums(x, rows, at, values, picks, 8)
        want = [[[[v[(at == n) & (x[f, rows] == b)].sum() for b in range(8)] for f in picks[n]] for n in range(3)] for v in values]
        assert np.abs(got - np.array(want)).max() < 1e-12
        ends = np.where(x[1, rows] <= 3, 1, np.where(x[3, rows] <= 2, 3, 4))
        root = np.zeros(len(rows), np.int64)
        assert (fo.descend(tree, x, rows, root) == ends).all() and (fo.descend(tree, x, rows, root, 1) == np.minimum(ends, 2)).all()
    big, n = rng.integers(0, 8, (5, 1 << 20)).astype(np.uint8), 1 << 20
    rows, zero, values = np.arange(n), np.zeros(n, np.int64), [np.ones(n)]
    tracemalloc.start()
    fo.level_sums(big, rows, zero, values, np.array([[0, 1]]), 8)
    assert tracemalloc.get_traced_memory()[1] < 4 * n              # a block's worth of one temporary is 8 bytes a row
    fo.descend(tree, big, rows, zero, 2)
    assert tracemalloc.get_traced_memory()[1] < 12 * n             # the nodes returned, and a chunk's
    tracemalloc.stop()
