"""The histogram booster against a plain one on small tables."""
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import boosting as bo


def plain_side(g, h, p):
    return max(abs(g) - p.alpha, 0) ** 2 / (h + p.lambda_)


def plain_tree(x, g, h, features, p):
    """Leaf-wise growth, one split at a time, each leaf's rows held: list of (rows, value) and the tree's splits by falling gain."""
    def best(rows, depth):
        top = None
        if depth < p.depth:
            for f in features:
                for cut in range(p.bins - 1):
                    left = rows[x[rows, f] <= cut]
                    right = rows[x[rows, f] > cut]
                    if min(len(left), len(right)) < p.min_rows or min(h[left].sum(), h[right].sum()) < p.min_hessian:
                        continue
                    gain = (plain_side(g[left].sum(), h[left].sum(), p) + plain_side(g[right].sum(), h[right].sum(), p)
                            - plain_side(g[rows].sum(), h[rows].sum(), p))
                    if gain > 1e-10 and (top is None or gain > top[0] + 1e-9):
                        top = (gain, left, right)
        return top
    leaves = [(np.arange(len(x)), 0, best(np.arange(len(x)), 0))]
    while len(leaves) < p.leaves:
        can = [i for i, leaf in enumerate(leaves) if leaf[2]]
        if not can:
            break
        i = max(can, key=lambda i: leaves[i][2][0])
        _, depth, (_, left, right) = leaves.pop(i)
        leaves += [(r, depth + 1, best(r, depth + 1)) for r in (left, right)]
    value = np.zeros(len(x))
    for rows, _, _ in leaves:
        total = g[rows].sum()
        value[rows] = -np.sign(total) * max(abs(total) - p.alpha, 0) / (h[rows].sum() + p.lambda_) * p.rate
    return value, len(leaves)


def plain_booster(x, y, w, p, objective, classes, held=None):
    """Raw scores of all rows by models of the rows that are not ``held``."""
    use = np.flatnonzero(~held) if held is not None else np.arange(len(y))
    if objective == bo.REGRESSION:
        score = np.full((len(y), 1), np.average(y[use], weights=w[use]))
    else:
        share = np.array([w[use][y[use] == c].sum() for c in range(classes)])
        score = np.tile(np.log(share / share.sum()), (len(y), 1))
    return score, use


def data(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 5)).round(2)
    x[:, 3] = rng.integers(0, 3, n)
    y = 3 * x[:, 0] + np.where(x[:, 1] > 0.3, 5, 0) * x[:, 3] + rng.normal(size=n)
    grade = np.digitize(y, np.quantile(y, [0.5, 0.85]))
    rows = [(i, float(y[i]), int(grade[i]), float(1 + rng.random()), *map(float, x[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, y double, grade int, w double, a double, b double, c double, d double, e double").repartition(5)


FEATURES = ["a", "b", "c", "d", "e"]


@pytest.mark.parametrize("task_rows", [90, 1000])      # passes over blocks; one block
@pytest.mark.parametrize("objective", [bo.REGRESSION, bo.SOFTMAX])
def test_booster_equals_a_plain_one(spark, objective, task_rows):
    df = data(spark)
    p = bo.BoosterParams(rounds=11, depth=4, leaves=9, rate=0.3, min_rows=12, bins=16, feature_share=0.8,
                         rows_per_task=task_rows)
    classes, label = (1, "y") if objective == bo.REGRESSION else (3, "grade")
    model, = bo.train(df, FEATURES, p, objective, classes, label, "w")
    rows = df.toPandas()
    x, y, w = model.binned([rows[c] for c in FEATURES]), rows[label].to_numpy(float), rows.w.to_numpy()
    score, _ = plain_booster(x, y, w, p, objective, classes)
    rng = np.random.default_rng(p.seed)
    assert len(model.trees) == p.rounds
    for n in range(p.rounds):
        g, h = bo.slopes(objective, score, y, w, classes)
        for k in range(classes):
            features = np.sort(rng.permutation(5)[:4])
            value, leaves = plain_tree(x, g[:, k], h[:, k], features, p)
            tree = model.trees[n][k]
            assert sum(f < 0 for f in tree.feature) == leaves <= p.leaves
            score[:, k] += value
    assert np.abs(model.raw(x) - score).max() < 1e-8
    got = bo.predict(df, model, ["id"]).toPandas().set_index("id").loc[rows.id]
    if objective == bo.REGRESSION:
        assert np.abs(got.prediction.to_numpy() - score[:, 0]).max() < 1e-8
        assert np.abs(got.prediction.to_numpy() - y).mean() < 0.5 * np.abs(y - y.mean()).mean()
    else:
        chance = np.array(got.probability.tolist())
        assert np.abs(chance.sum(axis=1) - 1).max() < 1e-12
        assert (got.prediction.to_numpy() == chance.argmax(axis=1)).all() and (got.prediction.to_numpy() == y).mean() > 0.8


def test_folds_in_one_pass_equal_separate_fits(spark):
    df = data(spark)
    p = bo.BoosterParams(rounds=10, depth=3, leaves=6, rate=0.3, min_rows=15, bins=16, feature_share=1.0)
    folded = df.withColumn("k", F.pmod(F.xxhash64("id"), F.lit(3)).cast("int"))
    for objective, classes, label in ((bo.REGRESSION, 1, "y"), (bo.SOFTMAX, 3, "grade")):
        together = bo.train(folded, FEATURES, p, objective, classes, label, fold="k", folds=3)
        passes = bo.train(folded, FEATURES, replace(p, rows_per_task=70), objective, classes, label, fold="k", folds=3)
        rows = folded.toPandas()
        x = together[0].binned([rows[c] for c in FEATURES])
        for k in range(3):
            assert np.abs(passes[k].raw(x) - together[k].raw(x)).max() < 1e-8
            alone = bo.train(folded.withColumn("part", F.when(F.col("k") == k, 0).otherwise(1)), FEATURES, p, objective, classes, label,
                             fold="part", folds=2)
            # fold 0 of this split holds out the same rows, and bins are cut from the same table
            assert np.abs(alone[0].raw(x) - together[k].raw(x)).max() < 1e-8


def test_cross_validation_scores(spark):
    df = data(spark)
    p = bo.BoosterParams(rounds=12, depth=3, leaves=6, rate=0.3, min_rows=10, bins=32)
    got = bo.cross_validate(df, FEATURES, p, "mae", 4, "id", label="y").toPandas()
    assert sorted(got.fold) == [0, 1, 2, 3] and got.rows.sum() == 400 and (got.score < 3).all() and (got.score > 0.5).all()
    got = bo.cross_validate(df, FEATURES, p, "f1_macro", 4, "id", bo.SOFTMAX, 3, "grade").toPandas()
    assert got.rows.sum() == 400 and got.score.between(0.6, 1).all()


def test_model_round_trip_and_odd_rows(spark, tmp_path):
    df = data(spark)
    odd = df.unionAll(spark.createDataFrame([(900, None, None, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0), (901, 1.0, 1, 1.0, None, float("nan"), 1e300, -1e300, 0.0)],
                                            df.schema))
    p = bo.BoosterParams(rounds=9, depth=3, leaves=5, min_rows=10)
    model, = bo.train(odd, FEATURES, p, label="y")
    again = bo.load(spark, bo.save(model, spark, str(tmp_path / "m")))
    one, two = (bo.predict(odd, m, ["id"]).orderBy("id").toPandas() for m in (model, again))
    assert one.equals(two) and len(one) == 402 and one.prediction.notna().all()
    assert sum(model.importance()) > 0
    none, = bo.train(df.filter("false"), FEATURES, p, label="y")
    assert bo.predict(df, none, ["id"]).filter("prediction = 0").count() == 400
    same, = bo.train(df.withColumn("y", F.lit(7.0)), FEATURES, p, label="y")
    assert bo.predict(df, same, ["id"]).filter("abs(prediction - 7) < 1e-9").count() == 400


def test_passes_use_every_core(spark, monkeypatch):
    seen = []

    def passes(blocks, tasks, *rest):
        seen.append((tasks, blocks.count()))
        return [[]]
    monkeypatch.setattr(bo, "_in_passes", passes)
    bo.train(data(spark), FEATURES, bo.BoosterParams(rounds=1, rows_per_task=399), label="y")
    assert seen and seen[0][0] == spark.sparkContext.defaultParallelism <= seen[0][1]


def test_sums_of_pairs_of_features_equal_plain_sums():
    rng = np.random.default_rng(3)
    x, g, h = rng.integers(0, 16, (5, 4000)).astype(np.uint8), rng.normal(size=(1, 4000)), rng.random((1, 4000))
    tree = tuple(map(np.array, ([2, -1, 0, -1, -1], [7, 0, 3, 0, 0], [1, 0, 3, 0, 0], [2, 0, 4, 0, 0], [0.0, 1.0, 0.0, 2.0, 3.0])))
    features = np.array([0, 2, 4])
    for n in (4000, 200):                             # pairs of features; one feature at a time
        got, = bo.pass_sums(x[:, :n], g[:, :n], h[:, :n], np.full(n, -1), 1, 1, [(tree, [4, 1], features)], 16)
        at = {1: x[2, :n] <= 7, 4: (x[2, :n] > 7) & (x[0, :n] > 3)}
        for i, node in enumerate((4, 1)):
            for j, f in enumerate(features):
                for c, v in enumerate((g[0, :n], np.ones(n), h[0, :n])):
                    want = [v[at[node] & (x[f, :n] == b)].sum() for b in range(16)]
                    assert np.abs(got[c, i, j] - want).max() < 1e-9
    score = bo.add_rounds([[tree]], x, np.zeros((1, 4000)))[0]
    assert (score == np.where(x[2] <= 7, 1, np.where(x[0] <= 3, 2, 3))).all()


def test_one_block_splits_rows_where_the_node_is(monkeypatch):
    """F3 to F12: in one block a node's rows are kept, not dealt down from the root for each pass; trees are the passes' trees."""
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 16, (6, 3000)).astype(np.uint8), rng.normal(size=3000)
    y += x[0] * (x[1] > 5) - x[2]
    p, features = bo.BoosterParams(depth=6, leaves=20, min_rows=8, bins=16), np.array([0, 1, 2, 4])
    for h in (None, rng.random(3000) + 0.5):
        one, passes = bo.GrowingTree(features, p), bo.GrowingTree(features, p)
        while passes.wanted:
            bo._taken([passes], bo.pass_sums(x, y[None], None if h is None else h[None], np.full(3000, -1), 1, 1,
                                             [(passes.open_arrays(), passes.wanted, features)], 16))
        want = passes.finished()
        with monkeypatch.context() as m:
            m.setattr(bo, "rows_at", None)               # not used
            at = bo._grow(one, x, y, h, p)
        got = one.finished()
        assert got == want and sum(f < 0 for f in got.feature) == 20
        score = np.zeros(3000)
        for n, value in one.ends.items():
            score[at[n]] += value
        assert (score == bo.add_rounds([[got.arrays()]], x, np.zeros((1, 3000)))[0]).all()


def test_rows_in_one_tasks_reach_take_no_pass(spark, monkeypatch):
    """F4 to F8: tables of some hundred thousand rows are grown by one task; a job a pass took longer than the work."""
    assert bo.BoosterParams().rows_per_task >= 1_500_000
    monkeypatch.setattr(bo, "_in_passes", None)
    wide = spark.range(0, 250_000, 1, 8).select((F.col("id") % 97).alias("a"), F.col("id").cast("double").alias("y"))
    model, = bo.train(wide, ["a"], bo.BoosterParams(rounds=2, leaves=4), label="y")
    assert len(model.trees) == 2 and bo.predict(wide, model, ["y"]).count() == 250_000
