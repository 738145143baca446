"""Leaf-wise histogram gradient boosting, trained as Spark jobs over a binned matrix (ML-1, ML-3, ML-6).

Features are cut once into quantile bins of one byte.  A pass adds up, per partition, the gradients, second derivatives and
rows by (tree, leaf, feature, bin); only those sums reach the driver, whose size does not depend on the number of rows.  The
driver splits the leaf of the largest gain until a tree has ``leaves`` leaves.  A pass serves all open leaves that
may still be split, of all trees of the round: one tree for a regression, one a class for the softmax loss, and that for every
fold of a cross-validation, so five folds cost the same passes as one model.
"""
from __future__ import annotations

import heapq
import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.session import checkpoint_dir, cut_lineage, ship_package

REGRESSION, SOFTMAX = "regression", "softmax"
# Sums of a pass: gradient, second derivative, rows.
CHANNELS = 3
# Rounds between reliable checkpoints of the scores; rows that a task of a pass has at most.
CHECKPOINT, TASK_ROWS = 32, 1_000_000


@dataclass(frozen=True)
class BoosterParams:
    rounds: int = 500
    depth: int = 8
    leaves: int = 63
    rate: float = 0.05
    min_rows: int = 20
    min_hessian: float = 1e-3
    alpha: float = 0.1                 # L1
    lambda_: float = 0.1               # L2
    feature_share: float = 0.8         # of each tree
    bins: int = 64
    seed: int = 42
    rows_per_task: int = 2_000_000     # so many rows are one task's (some 100 bytes each), beyond them all cores share each pass


@dataclass
class Tree:
    """Nodes as parallel lists; a leaf has feature -1.  Rows with bin <= cut go left."""
    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self) -> int:
        for c, v in zip((self.feature, self.cut, self.left, self.right, self.value, self.gain), (-1, 0, 0, 0, 0.0, 0.0)):
            c.append(v)
        return len(self.feature) - 1

    def arrays(self):
        return tuple(np.array(c) for c in (self.feature, self.cut, self.left, self.right, self.value))


def rows_at(tree, x: np.ndarray, rows: np.ndarray, ends) -> dict[int, np.ndarray]:
    """The ``rows`` of the binned matrix ``x`` (features x rows) that lie in each of the nodes ``ends``.  Rows are dealt down from
    the root, only towards these nodes; children have larger numbers than their parents."""
    feature, cut, left, right, _ = tree
    open_ = np.zeros(len(feature), bool)
    open_[list(ends)] = True
    for n in range(len(feature) - 1, -1, -1):
        if feature[n] >= 0:
            open_[n] = open_[left[n]] or open_[right[n]]
    out, todo = {}, [(0, rows)]
    while todo:
        n, r = todo.pop()
        if feature[n] < 0:
            out[n] = r
            continue
        low = x[feature[n]].take(r) <= cut[n]
        todo += [(child, r[side]) for child, side in ((left[n], low), (right[n], ~low)) if open_[child]]
    return {n: out[n] for n in ends}


def add_rounds(trees, x: np.ndarray, score: np.ndarray) -> np.ndarray:
    """``score`` (outputs x rows) with the trees' values added: ``trees`` has one list of outputs for each round."""
    rows = np.arange(x.shape[1])
    for round_ in trees:
        for k, tree in enumerate(round_):
            for n, r in rows_at(tree, x, rows, np.flatnonzero(tree[0] < 0).tolist()).items():
                score[k][r] += tree[4][n]
    return score


def slopes(objective: str, score: np.ndarray, y: np.ndarray, weight: np.ndarray, classes: int):
    """First and second derivatives of the loss by every output (columns: fold by fold, class by class)."""
    if objective == REGRESSION:
        return (score - y[:, None]) * weight[:, None], np.repeat(weight[:, None], score.shape[1], axis=1)
    g, h = np.empty_like(score), np.empty_like(score)
    truth = np.eye(classes)[y.astype(np.int64)]
    for at in range(0, score.shape[1], classes):
        z = score[:, at:at + classes]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g[:, at:at + classes] = (p - truth) * weight[:, None]
        h[:, at:at + classes] = classes / (classes - 1) * p * (1 - p) * weight[:, None]
    return g, h


class GrowingTree:
    """One tree while the leaf of largest gain is split.  ``wanted`` are the leaves whose sums the next pass must bring."""

    def __init__(self, features: np.ndarray, p: BoosterParams):
        self.p, self.features, self.tree = p, features, Tree()
        root = self.tree.add()
        self.depth, self.sums, self.best = {root: 0}, {}, {}
        self.wanted, self.pairs, self.heap, self.leaves = [root], {}, [], 1
        self.final: set[int] = set()

    def _side(self, s: np.ndarray) -> np.ndarray:
        g = np.sign(s[..., 0]) * np.maximum(np.abs(s[..., 0]) - self.p.alpha, 0)
        return g * g / (s[..., 1] + self.p.lambda_ + 1e-300)

    def _find(self, node: int) -> None:
        """The best cut of a leaf: of equal gains the first feature, then the lowest cut."""
        s = self.sums[node]
        total = s[0].sum(axis=0)
        left = np.cumsum(s, axis=1)[:, :-1]
        right = total - left
        gain = self._side(left) + self._side(right) - self._side(total)
        ok = ((np.minimum(left[..., 2], right[..., 2]) >= self.p.min_rows - 0.5)
              & (np.minimum(left[..., 1], right[..., 1]) >= self.p.min_hessian))
        gain = np.where(ok, gain, -np.inf)
        top = gain.max(initial=-np.inf)
        if top > 1e-10 and self.depth[node] < self.p.depth:
            # gains that differ by rounding alone are equal, in whatever order partitions were added up
            same = 1e-10 * (1.0 + self._side(total) + top)
            f, cut = divmod(int((gain >= top - same).argmax()), gain.shape[1])
            self.best[node] = (float(f"{top:.8g}"), f, cut, left[f, cut, 2] <= right[f, cut, 2])

    def take(self, sums: list[np.ndarray]) -> None:
        """The sums of the wanted leaves (of a pair of children the smaller one; the other is the difference)."""
        for node, s in zip(self.wanted, sums):
            self.sums[node] = s
            if node in self.pairs:
                other, parent = self.pairs[node]
                self.sums[other] = self.sums[parent] - s
        fresh = [n for node in self.wanted for n in ((node, self.pairs[node][0]) if node in self.pairs else (node,))]
        for node in fresh:
            self._find(node)
        if not self.final:
            self._offer(0)
        self._split()

    def _offer(self, node: int) -> None:
        if node in self.best and all(n != node for _, n in self.heap):
            heapq.heappush(self.heap, (-self.best[node][0], node))

    def _split(self) -> None:
        """Split leaves by falling gain while their children's sums are known; then want those of all leaves that may follow."""
        self.wanted = []
        t = self.tree
        while self.heap and self.leaves < self.p.leaves:
            _, node = self.heap[0]
            if t.left[node] == 0:
                break
            heapq.heappop(self.heap)
            t.feature[node] = int(self.features[self.best[node][1]])
            t.gain[node] = self.best[node][0]
            self.final.add(node)
            self.leaves += 1
            self._offer(t.left[node])
            self._offer(t.right[node])
        if self.leaves >= self.p.leaves:
            return
        # all known leaves, tried ones below them too, that have the gain to be among those still to come
        known = [(-gain, node) for node, (gain, *_) in self.best.items() if node not in self.final]
        # (the first of the heap is next in any case, however many tried ones below it gain more)
        for _, node in self.heap[:1] + heapq.nsmallest(self.p.leaves - self.leaves, known):
            if t.left[node] == 0:
                _, _, cut, left_smaller = self.best[node]
                t.cut[node], t.left[node], t.right[node] = cut, t.add(), t.add()
                small, large = (t.left[node], t.right[node]) if left_smaller else (t.right[node], t.left[node])
                self.depth[small] = self.depth[large] = self.depth[node] + 1
                self.pairs[small] = (large, node)
                self.wanted.append(small)

    def open_arrays(self):
        """The tree with all tried splits, committed or not: where the wanted leaves are."""
        t = self.tree
        feature = [int(self.features[self.best[n][1]]) if t.left[n] else -1 for n in range(len(t.feature))]
        return np.array(feature), np.array(t.cut), np.array(t.left), np.array(t.right), np.array(t.value)

    def finished(self) -> Tree:
        """The committed part, with its leaves' values, numbered anew from the root.  ``ends`` keeps the values by the old numbers."""
        out, old = Tree(), self.tree
        self.ends: dict[int, float] = {}
        todo = [(0, out.add())]
        while todo:
            n, k = todo.pop()
            if n in self.final:
                out.feature[k], out.cut[k], out.gain[k] = old.feature[n], old.cut[n], old.gain[n]
                out.left[k], out.right[k] = out.add(), out.add()
                todo += [(old.left[n], out.left[k]), (old.right[n], out.right[k])]
            else:
                g, h, _ = self.sums[n][0].sum(axis=0)
                g = np.sign(g) * max(abs(g) - self.p.alpha, 0.0)
                out.value[k] = self.ends[n] = float(-g / (h + self.p.lambda_) * self.p.rate) if h + self.p.lambda_ > 0 else 0.0
        return out


def _histograms(x, rows, sizes, values, features, bins) -> np.ndarray:
    """Sums of ``values`` (None counts rows) by (value, node, feature, bin).  ``rows`` lie node by node, ``sizes`` rows each.

    Where nodes are large, two features are added up at once, by pairs of bins, and the pairs' table is summed to each side."""
    nodes, n = len(sizes), len(features)
    out = np.zeros((len(values), nodes, n, bins))
    values = [v if v is None else v.take(rows) for v in values]
    pair = bins if 2 * len(rows) > nodes * bins * bins else 1
    node = np.repeat(np.arange(nodes) * bins * pair, sizes)
    for f in range(0, n, 2 if pair > 1 else 1):
        both = pair > 1 and f + 1 < n
        slot = x[features[f]].take(rows).astype(np.int64)
        if pair > 1:
            slot *= pair
        slot += node
        if both:
            slot += x[features[f + 1]].take(rows)
        for c, v in enumerate(values):
            got = np.bincount(slot, v, nodes * bins * pair).reshape(nodes, bins, pair)
            out[c, :, f] = got.sum(axis=2)
            if both:
                out[c, :, f + 1] = got.sum(axis=1)
    return out


def pass_sums(x, g, h, fold, classes, folds, growing, bins) -> list[np.ndarray]:
    """One block's share of a pass: for each tree its wanted leaves' sums by feature and bin.  Of fold k's models the rows
    of fold k are left out.  Without ``h`` (all second derivatives are 1) they are the rows' counts, and are not sent."""
    out = []
    for k, (tree, wanted, features) in enumerate(growing):
        if not wanted:
            out.append(np.zeros((0,)))
            continue
        rows = np.flatnonzero(fold != k // classes) if folds > 1 else np.arange(x.shape[1])
        at = rows_at(tree, x, rows, wanted)
        values = [g[k], None] if h is None else [g[k], None, h[k]]
        out.append(_histograms(x, np.concatenate([at[n] for n in wanted]), [len(at[n]) for n in wanted], values, features, bins))
    return out


def _grow(t: GrowingTree, x, g, h, p: BoosterParams) -> dict[int, np.ndarray]:
    """Grow one tree over a block that holds all rows: the passes' sums, but each node's rows are kept, and split where the node is, not
    dealt down from the root for every pass.  Returns the rows of each node."""
    at = {0: np.arange(x.shape[1])}
    values = [g, None] if h is None else [g, None, h]
    while t.wanted:
        for node in t.wanted:
            if node in t.pairs:
                parent = t.pairs[node][1]
                rows = at[parent]
                low = x[t.features[t.best[parent][1]]].take(rows) <= t.tree.cut[parent]
                at[t.tree.left[parent]], at[t.tree.right[parent]] = rows[low], rows[~low]
        rows = [at[n] for n in t.wanted]
        _taken([t], [_histograms(x, np.concatenate(rows), [len(r) for r in rows], values, t.features, p.bins)])
    return at


def _taken(growing: list[GrowingTree], sums: list[np.ndarray]) -> None:
    """Hand a pass's sums to its trees, by (node, feature, bin, channel)."""
    for t, s in zip(growing, sums):
        if t.wanted:
            t.take(list(np.stack([s[0], s[2] if len(s) > 2 else s[1], s[1]], axis=-1)))


@dataclass
class Booster:
    """The trees (one list of outputs a round), bin edges, start scores and loss of one model."""
    features: list[str]
    edges: list[list[float]]
    start: list[float]
    objective: str
    trees: list[list[Tree]]

    def binned(self, columns) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, np.nan_to_num(np.asarray(c, np.float64)), side="left")
                                for e, c in zip(self.edges, columns)]).astype(np.uint8)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return add_rounds([[t.arrays() for t in r] for r in self.trees], np.ascontiguousarray(x.T),
                          np.repeat(np.array(self.start, float)[:, None], len(x), axis=1)).T

    def importance(self) -> list[float]:
        """How often each feature splits a leaf."""
        count = np.zeros(len(self.features))
        for round_ in self.trees:
            for t in round_:
                for f in t.feature:
                    if f >= 0:
                        count[f] += 1
        return count.tolist()


def bin_edges(data: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """Up to bins - 1 upper edges a feature: quantiles of its values (one pass, a bounded sketch a feature)."""
    got = data.approxQuantile(features, [(i + 1) / bins for i in range(bins - 1)], 1 / (8 * bins))
    top = data.agg(*[F.max(c) for c in features]).first()
    return [sorted({float(v) for v in e if v is not None and v < m}) if m is not None else [] for e, m in zip(got, top)]


def train(data: DataFrame, features: list[str], p: BoosterParams, objective: str = REGRESSION, classes: int = 1, label: str = "label",
          weight: str | None = None, fold: str | None = None, folds: int = 1) -> list[Booster]:
    """The boosters of ``data``: one, or one for each of ``folds`` folds (column ``fold``), trained without the fold's rows.

    Null or NaN features count as 0; rows without a label are left out.  The binned matrix is written once to the shared folder and kept
    in executor memory or disk; every round carries the scores and slopes forward, and every CHECKPOINT rounds a reliable
    checkpoint cuts their lineage, so a lost executor repeats a bounded number of rounds.  An empty table gives constants."""
    spark = data.sparkSession
    checkpoint_dir(spark)
    ship_package(spark)
    cols = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"f{i}") for i, c in enumerate(features)]
    rows = data.filter(F.col(label).isNotNull()).select(
        F.col(label).cast("double").alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"),
        (F.col(fold).cast("int") if fold else F.lit(-1)).alias("k"), *cols)
    rows = cut_lineage(rows, "design")
    names = [f"f{i}" for i in range(len(features))]
    edges = bin_edges(rows, names, p.bins)
    sums = _start_sums(rows, objective, classes, folds)
    outputs = classes * folds
    start = np.array([_start(objective, classes, sums, k) for k in range(folds)]).reshape(outputs)
    empty = Booster(features, edges, start.tolist(), objective, [])
    if sums[0] == 0:
        return [Booster(features, edges, start[k * classes:(k + 1) * classes].tolist(), objective, []) for k in range(folds)]
    one = sums[0] <= p.rows_per_task
    tasks = 1 if one else max(spark.sparkContext.defaultParallelism, -(-sums[0] // TASK_ROWS))
    rng = np.random.default_rng(p.seed)
    picked = max(1, round(p.feature_share * len(features)))
    picks = [[np.sort(rng.permutation(len(features))[:picked]) for _ in range(outputs)] for _ in range(p.rounds)]

    def block(batches):
        for b in batches:
            x = empty.binned([b.column(c).to_numpy(zero_copy_only=False) for c in names])
            yield pa.RecordBatch.from_pylist([{"x": x.tobytes(), **{
                c: b.column(c).to_numpy(zero_copy_only=False).astype(np.float64).tobytes() for c in ("y", "w", "k")}}])
    blocks = cut_lineage((rows if one else rows.repartition(tasks)).mapInArrow(block, "x binary, y binary, w binary, k binary"), "binned")

    unit = objective == REGRESSION and weight is None
    if one:
        done = _one_block(blocks, start, objective, classes, folds, p, picks, unit)
    else:
        done = _in_passes(blocks, tasks, start, objective, classes, folds, p, picks, unit)
    return [Booster(features, edges, start[k * classes:(k + 1) * classes].tolist(), objective, done[k]) for k in range(folds)]


def _joined(parts):
    """One block of packed ones: the binned matrix (features x rows), labels, weights and folds."""
    y, w, k = (np.concatenate([np.frombuffer(r[c]) for r in parts]) for c in ("y", "w", "k"))
    x = np.concatenate([np.frombuffer(r["x"], np.uint8).reshape(len(r["y"]) // 8, -1) for r in parts])
    return np.ascontiguousarray(x.T), y, w, k


def _sloped(objective, score, y, w, classes, unit):
    """``slopes`` of scores by (output, row); no second derivatives where all are 1."""
    if unit:
        return score - y, None
    return tuple(np.ascontiguousarray(v.T) for v in slopes(objective, score.T, y, w, classes))


def _in_passes(blocks: DataFrame, tasks: int, start, objective, classes, folds, p, picks, unit) -> list[list[list[Tree]]]:
    """The trees of each fold, round and class, from passes over many blocks, one a task."""
    def first(parts):
        parts = list(parts)
        if parts:
            x, y, w, k = _joined(parts)
            score = np.repeat(start[:, None], len(y), axis=1)
            yield x, y, w, k, score, *_sloped(objective, score, y, w, classes, unit)

    def carried(state, trees, cut):
        def one(b):
            x, y, w, k, score = b[:5]
            score = add_rounds([trees], x, score)
            return x, y, w, k, score, *_sloped(objective, score, y, w, classes, unit)
        new = state.map(one).persist(StorageLevel.MEMORY_AND_DISK)
        if cut:
            new.checkpoint()
        return new

    def add(a, b):
        return [u + v for u, v in zip(a, b)]

    state, old = blocks.repartition(tasks).rdd.mapPartitions(first).persist(StorageLevel.MEMORY_AND_DISK), None
    done = []
    for n, pick in enumerate(picks):
        growing = [GrowingTree(f, p) for f in pick]
        while any(t.wanted for t in growing):
            ask = [(t.open_arrays(), t.wanted, t.features) for t in growing]
            mapped = state.map(lambda b, ask=ask: pass_sums(b[0], b[5], b[6], b[3], classes, folds, ask, p.bins))
            _taken(growing, mapped.treeReduce(add, 2) if tasks > 64 else mapped.reduce(add))
            if old is not None:                       # the round's first pass has made its state
                old.unpersist()
                old = None
        done.append([t.finished() for t in growing])
        if n + 1 < p.rounds:
            old, state = state, carried(state, [t.arrays() for t in done[-1]], (n + 1) % CHECKPOINT == 0)
    state.unpersist()
    return [[r[k * classes:(k + 1) * classes] for r in done] for k in range(folds)]


def _one_block(blocks: DataFrame, start, objective, classes, folds, p, picks, unit) -> list[list[list[Tree]]]:
    """The same trees where all rows are in one task's reach (rows_per_task, a bound): its sums are the passes' sums, so the task grows
    the trees itself, one task a fold, and no job is run for each pass.  Below the bound this takes less time than passes on all cores,
    as a pass is a job of some 0.2 s and its rows are dealt down from the root."""
    def grow(batches):
        for b in batches:
            for r in b.to_pylist():
                x, y, w, k = _joined(r["parts"])
                mine = slice(r["fold"] * classes, (r["fold"] + 1) * classes)
                keep = k != r["fold"] if folds > 1 else np.ones(len(y), bool)
                x, y, w, k = np.ascontiguousarray(x[:, keep]), y[keep], w[keep], k[keep]
                score, rounds = np.repeat(start[mine][:, None], len(y), axis=1), []
                for pick in picks:
                    g, h = _sloped(objective, score, y, w, classes, unit)
                    rounds.append([])
                    for c, features in enumerate(pick[mine]):
                        t = GrowingTree(features, p)
                        at = _grow(t, x, g[c], h if h is None else h[c], p)
                        rounds[-1].append(t.finished())
                        for n, value in t.ends.items():
                            score[c][at[n]] += value
                yield pa.RecordBatch.from_arrays([pa.array([r["fold"]], pa.int32()), pa.array([pickle.dumps(rounds)], pa.binary())],
                                                 names=["fold", "trees"])
    whole = blocks.agg(F.collect_list(F.struct("x", "y", "w", "k")).alias("parts"))            # rows_per_task rows at most
    each = whole.select(F.explode(F.array(*[F.lit(k) for k in range(folds)])).alias("fold"), "parts").repartition(folds)
    got = cut_lineage(each.mapInArrow(grow, "fold int, trees binary"), "trees").collect()
    return [pickle.loads(r["trees"]) for r in sorted(got, key=lambda r: r["fold"])]


def _start_sums(rows: DataFrame, objective: str, classes: int, folds: int):
    """(rows, {fold: [weight and weighted label sum] or [weight a class]}) in one aggregation."""
    values = ([F.sum("w"), F.sum(F.col("w") * F.col("y"))] if objective == REGRESSION
              else [F.sum(F.when(F.col("y") == c, F.col("w")).otherwise(0.0)) for c in range(classes)])
    got = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.array(*values).alias("v")).collect()     # one row a fold
    return sum(r["n"] for r in got), {r["k"]: np.array(r["v"]) for r in got}


def _start(objective: str, classes: int, sums, held_out: int) -> list[float]:
    """The constant score of least loss (without the held-out fold)."""
    total = sum((v for k, v in sums[1].items() if k != held_out or k < 0), np.zeros(2 if objective == REGRESSION else classes))
    if objective == REGRESSION:
        return [float(total[1] / total[0])] if total[0] else [0.0]
    share = np.maximum(total / total.sum(), 1e-15) if total.sum() else np.full(classes, 1 / classes)
    return np.log(share).tolist()


def predict(data: DataFrame, models: Booster | list[Booster], keep: list[str], out: str = "prediction", fold: str | None = None) -> DataFrame:
    """``keep`` and ``out``: the regression's value or the most likely class (the first of equals), then with ``probability`` (array).
    With several models each row is scored by the one of its ``fold``, which has not seen it."""
    spark = data.sparkSession
    ship_package(spark)
    many = models if isinstance(models, list) else [models]
    first = many[0]
    shipped = spark.sparkContext.broadcast(many)
    names = [f"_f{i}" for i in range(len(first.features))]
    src = data.select(*keep, *([F.col(fold).cast("int").alias("_of")] if fold else []),
                      *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(n) for c, n in zip(first.features, names)])
    softmax, kept = first.objective == SOFTMAX, data.select(*keep).columns
    schema = data.select(*keep, F.lit(0.0).alias(out), *([F.array(F.lit(0.0)).alias("probability")] if softmax else [])).schema

    def run(batches):
        for b in batches:
            x = first.binned([b.column(n).to_numpy(zero_copy_only=False) for n in names])
            each = np.zeros((len(x), len(first.start)))
            of = b.column("_of").to_numpy(zero_copy_only=False) if fold else np.zeros(len(x), int)
            for k, m in enumerate(shipped.value):
                rows = np.flatnonzero(of == k)
                if len(rows):
                    each[rows] = m.raw(x[rows])
            if softmax:
                e = np.exp(each - each.max(axis=1, keepdims=True))
                e /= e.sum(axis=1, keepdims=True)
                extra = [pa.array(e.argmax(axis=1).astype(np.float64)), pa.array(e.tolist(), pa.list_(pa.float64()))]
            else:
                extra = [pa.array(each[:, 0])]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *extra], names=schema.names)
    return src.mapInArrow(run, schema)


def cross_validate(data: DataFrame, features: list[str], p: BoosterParams, metric: str, folds: int, id_col: str,
                   objective: str = REGRESSION, classes: int = 1, label: str = "label", weight: str | None = None) -> DataFrame:
    """ML-6: one row a fold (fold, rows, score) and its held-out MAE or macro F1; all folds' models are trained in the same passes.
    A row's fold comes from a hash of its id, so folds are the same on every run."""
    data = cut_lineage(data.withColumn("_fold", F.pmod(F.xxhash64(F.col(id_col), F.lit(p.seed)), F.lit(folds)).cast("int")), "folds")
    models = train(data, features, p, objective, classes, label, weight, "_fold", folds)
    held = predict(data, models, ["_fold", label], fold="_fold").filter(F.col(label).isNotNull())
    if metric == "mae":
        return held.groupBy(F.col("_fold").alias("fold")).agg(F.count(F.lit(1)).alias("rows"),
                                                              F.avg(F.abs(F.col(label) - F.col("prediction"))).alias("score"))
    per = []
    for c in range(classes):
        hit = F.count_if((F.col(label) == c) & (F.col("prediction") == c))
        both = F.count_if(F.col(label) == c) + F.count_if(F.col("prediction") == c)
        per.append((F.coalesce(F.try_divide(2.0 * hit, both), F.lit(0.0)), F.when(both > 0, 1).otherwise(0)))
    total, present = per[0]
    for x, s in per[1:]:
        total, present = total + x, present + s
    return held.groupBy(F.col("_fold").alias("fold")).agg(F.count(F.lit(1)).alias("rows"), (total / present).alias("score"))


def save(model: Booster, spark: SparkSession, path: str) -> str:
    """The model as one Parquet table of its nodes (a size set by the parameters, not by the data)."""
    rows = [(r, k, i, *(getattr(t, c)[i] for c in ("feature", "cut", "left", "right", "value", "gain")))
            for r, round_ in enumerate(model.trees) for k, t in enumerate(round_) for i in range(len(t.feature))]
    spark.createDataFrame(rows, "round int, output int, node int, feature int, cut int, left int, right int, value double, gain double"
                          ).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    spark.createDataFrame([(model.features, model.edges, model.start, model.objective)],
                          "features array<string>, edges array<array<double>>, start array<double>, objective string"
                          ).coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
    return path


def load(spark: SparkSession, path: str) -> Booster:
    head = spark.read.parquet(f"{path}/model").first()
    model = Booster(list(head["features"]), [list(e) for e in head["edges"]], list(head["start"]), head["objective"], [])
    for n in spark.read.parquet(f"{path}/nodes").orderBy("round", "output", "node").toLocalIterator():
        while len(model.trees) <= n["round"]:
            model.trees.append([Tree() for _ in model.start])
        t = model.trees[n["round"]][n["output"]]
        k = t.add()
        t.feature[k], t.cut[k], t.left[k], t.right[k], t.value[k], t.gain[k] = (
            n[c] for c in ("feature", "cut", "left", "right", "value", "gain"))
    return model
