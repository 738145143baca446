"""Random forests grown as Spark jobs over a binned matrix (ML-2, ML-4, ML-7, SNK-6).

Features are cut once into quantile bins of one byte.  Every tree sees each row as often as its bootstrap draw (Poisson, mean
1, drawn from the seed, the tree and the block) says, and tries a fresh random choice of features at every node.  All trees grow level by level in
the same passes: tasks sum weights and labels by (tree, node, feature, bin) over their block of rows, the sums of a tree meet
in one task, which finds its nodes' best cuts, and only those cuts reach the driver: a size set by the parameters.
"""
from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.operators.boosting import bin_edges
from ledgerlake.session import checkpoint_dir, cut_lineage, ship_package


@dataclass(frozen=True)
class ForestParams:
    trees: int = 300
    depth: int = 12
    min_rows: int = 5
    bins: int = 32
    seed: int = 42
    block_rows: int = 1_000_000        # rows that a task holds at most; up to so many, tasks share the trees and not the rows


@dataclass
class Tree:
    """Nodes by level as parallel arrays; the children of a node are ``child`` and the next.  A leaf is its own child: its
    cut lets no bin pass.  Rows with bin <= cut go left.  ``value`` has one column, or the share of each class."""
    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    value: np.ndarray


@dataclass
class Forest:
    features: list[str]
    edges: list[list[float]]
    classes: int                       # 0: regression
    trees: list[Tree]
    importance: list[float]            # impurity taken away by each feature, a share of 1

    def binned(self, columns) -> np.ndarray:
        """Bins by (feature, row)."""
        return np.stack([np.searchsorted(e, np.nan_to_num(np.asarray(c, np.float64)), side="left")
                         for e, c in zip(self.edges, columns)]).astype(np.uint8)

    def values(self, x: np.ndarray) -> np.ndarray:
        """The trees' mean by (row, output)."""
        rows = np.arange(x.shape[1])
        total = np.zeros((x.shape[1], max(self.classes, 1)))
        for t in self.trees:
            total += t.value[descend(t, x, rows, np.zeros(len(rows), np.int64))]
        return total / max(len(self.trees), 1)


LEAF = 255


# Rows that are worked on at once: what they need lies in a core's cache.
CHUNK = 1 << 16


def descend(tree: Tree, x: np.ndarray, rows: np.ndarray, node: np.ndarray, levels: int | None = None) -> np.ndarray:
    """The nodes that ``rows``, now at ``node``, reach: at a leaf, or so many levels further down."""
    start, flat = tree.feature * x.shape[1], x.reshape(-1)
    out = np.empty(len(rows), np.int64)
    for lo in range(0, len(rows), CHUNK):
        r, at, left = rows[lo:lo + CHUNK], node[lo:lo + CHUNK], levels
        while left is None or left > 0:
            place = start.take(at)
            place += r
            below = tree.child.take(at) + (flat.take(place) > tree.cut.take(at))
            if left is None:
                if np.array_equal(below, at):
                    break
            else:
                left -= 1
            at = below
        out[lo:lo + CHUNK] = at
    return out


# Poisson draws of mean 1 by a 16-bit number
_DRAWS = np.searchsorted(np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 9)])), (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


def drawn(p: ForestParams, tree: int, block: int, n: int) -> np.ndarray:
    """How often the tree sees each row of the block."""
    return _DRAWS[np.random.default_rng([p.seed, tree, block]).integers(0, 1 << 16, n, dtype=np.uint16)]


def tried(p: ForestParams, tree: int, level: int, nodes: int, features: int) -> np.ndarray:
    """The features that each node of a level tries: the square root of all, rounded up."""
    k = int(np.ceil(np.sqrt(features)))
    return np.sort(np.random.default_rng([p.seed, tree, 1 << 20, level]).random((nodes, features)).argsort(axis=1)[:, :k], axis=1)


def level_sums(x, rows, at, values, picks, bins) -> np.ndarray:
    """Sums of ``values`` by (value, node, tried feature, bin) of rows at the nodes ``at`` of a level."""
    nodes, k = picks.shape
    flat, start = x.reshape(-1), np.ascontiguousarray(picks.T) * x.shape[1]
    out = np.zeros((len(values), k, nodes * bins))
    for lo in range(0, len(rows), CHUNK):
        r, a = rows[lo:lo + CHUNK], at[lo:lo + CHUNK]
        base = a * bins
        for j in range(k):
            slot = start[j].take(a)
            slot += r
            slot = base + flat.take(slot)
            for c, v in enumerate(values):
                out[c, j] += np.bincount(slot, v[lo:lo + CHUNK], nodes * bins)
    return np.ascontiguousarray(out.reshape(len(values), k, nodes, bins).transpose(0, 2, 1, 3))


def best_cuts(sums: np.ndarray, picks: np.ndarray, p: ForestParams, classes: int, last: bool):
    """(feature or -1, cut, gain, value) for the nodes of a level.  The sums are of labels or of each class, then of draws.
    Gains are of variance or Gini impurity, times the rows' weight; of equal gains the first feature, then the lowest cut."""
    label, count = sums[:-1], sums[-1]
    left, low = np.cumsum(label, axis=3), np.cumsum(count, axis=2)
    total, n = left[:, :, :1, -1:], low[:, :1, -1:]

    def purity(s, m):
        w = s.sum(axis=0) if classes else m
        return np.divide((s * s).sum(axis=0), w, out=np.zeros(w.shape), where=w > 0)
    right, high = total - left, n - low
    gain = purity(left, low) + purity(right, high) - purity(total, n)
    scale = 1e-6 * (1e-9 + np.abs(purity(total, n)[:, 0, 0])) if not classes else 1e-6 * (1e-9 + purity(total, n)[:, 0, 0])
    gain = np.where(np.minimum(low, high) >= max(p.min_rows, 1) - 0.5, gain, -np.inf).reshape(len(picks), -1)
    at = gain.argmax(axis=1)
    top = gain[np.arange(len(at)), at]
    split = (top > scale) & (not last)
    node = np.arange(len(at))
    f, cut = np.divmod(at, sums.shape[3])
    whole, m = total[:, :, 0, 0].T, n[:, 0, 0]
    base = whole.sum(axis=1) if classes else m
    value = np.divide(whole, base[:, None], out=np.full(whole.shape, 1.0 / max(classes, 1) if classes else 0.0), where=base[:, None] > 0)
    return np.where(split, picks[node, f], -1), cut, np.where(split, top, 0.0), value


class Growing:
    """One tree level by level: nodes from ``lo`` on are the open level."""

    def __init__(self, features: int, outputs: int):
        self.tree = Tree(np.zeros(1, np.int64), np.full(1, LEAF), np.zeros(1, np.int64), np.zeros((1, outputs)))
        self.lo, self.level, self.gains = 0, 0, np.zeros(features)

    @property
    def open(self) -> int:
        return len(self.tree.child) - self.lo

    def take(self, feature, cut, gain, value) -> None:
        t, size = self.tree, len(self.tree.child)
        split = feature >= 0
        t.value[self.lo:] = value
        t.feature[self.lo:] = np.where(split, feature, 0)
        t.cut[self.lo:] = np.where(split, cut, LEAF)
        t.child[self.lo:] = np.where(split, size + 2 * (np.cumsum(split) - 1), np.arange(self.lo, size))
        np.add.at(self.gains, feature[split], gain[split])
        new = 2 * int(split.sum())
        self.lo, self.level = size, self.level + 1
        self.tree = Tree(np.append(t.feature, np.zeros(new, np.int64)), np.append(t.cut, np.full(new, LEAF)),
                         np.append(t.child, np.arange(size, size + new)), np.vstack([t.value, np.zeros((new, t.value.shape[1]))]))

    def packed(self) -> tuple:
        t = self.tree
        return (t.feature.astype(np.uint16).tobytes(), t.cut.astype(np.uint8).tobytes(), t.child.astype(np.int32).tobytes(),
                t.value.tobytes(), self.gains.tobytes())


def unpacked(row, outputs: int) -> Tree:
    return Tree(np.frombuffer(row[0], np.uint16).astype(np.int64), np.frombuffer(row[1], np.uint8), np.frombuffer(row[2], np.int32),
                np.frombuffer(row[3]).reshape(-1, outputs))


def _weights(y, w, rows, draws, classes):
    """The values to sum of the drawn rows: labels or each class's weight, then the draws."""
    n = draws[rows].astype(np.float64)
    return [n * (w[rows] * (y[rows] == c)) for c in range(classes)] + [n] if classes else [n * y[rows], n]


def _block(r):
    y, w = np.frombuffer(r["y"]), np.frombuffer(r["w"])
    return r["block"], np.frombuffer(r["x"], np.uint8).reshape(-1, len(y)), y, w


def train(data: DataFrame, features: list[str], p: ForestParams, classes: int = 0, label: str = "label", weight: str | None = None) -> Forest:
    """The forest of ``data``.  Null or NaN features count as 0; rows without a label are left out; an empty table gives trees of one
    leaf.  The binned matrix is written once to the shared folder, in blocks of at most ``block_rows`` rows."""
    spark = data.sparkSession
    checkpoint_dir(spark)
    ship_package(spark)
    names = [f"f{i}" for i in range(len(features))]
    rows = cut_lineage(data.filter(F.col(label).isNotNull()).select(
        F.col(label).cast("double").alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"),
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(n) for c, n in zip(features, names)]), "design")
    count, outputs = rows.count(), max(classes, 1)
    model = Forest(features, bin_edges(rows, names, p.bins), classes, [], [])
    blocks = -(-count // p.block_rows)
    if count == 0:
        growing = [Growing(len(features), outputs) for _ in range(p.trees)]
        for g in growing:
            g.tree.value[:] = 1.0 / classes if classes else 0.0
        return _forest(model, [g.packed() for g in growing])

    def packed(batches):
        from pyspark import TaskContext
        parts = [(model.binned([b.column(c).to_numpy(zero_copy_only=False) for c in names]),
                  *(b.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("y", "w"))) for b in batches]
        if parts:
            x, y, w = np.concatenate([q[0] for q in parts], axis=1), *(np.concatenate([q[i] for q in parts]) for i in (1, 2))
            yield pa.RecordBatch.from_pylist([{"block": TaskContext.get().partitionId(), "x": x.tobytes(), "y": y.tobytes(), "w": w.tobytes()}],
                                             schema=pa.schema([("block", pa.int32()), *((c, pa.binary()) for c in ("x", "y", "w"))]))
    # in one order, as the draws go by a row's place in its block
    dealt = rows.repartition(blocks).sortWithinPartitions("y", "w", *names)
    binned = cut_lineage(dealt.mapInArrow(packed, "block int, x binary, y binary, w binary"), "binned")
    cores = spark.sparkContext.defaultParallelism
    # each block is dealt to so many tasks, which have a share of the trees; passes wait for their last task, so theirs are smaller
    shares = min(p.trees, -(-(2 if blocks == 1 else 4) * cores // blocks))
    units = binned.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).repartition(blocks * shares, "block", "share")
    return _forest(model, _one_block(units, len(features), shares, classes, p) if blocks == 1
                   else _in_passes(spark, units, len(features), shares, blocks, classes, p))


def _forest(model: Forest, trees: list[tuple]) -> Forest:
    model.trees = [unpacked(t, max(model.classes, 1)) for t in trees]
    total = np.zeros(len(model.features))
    for t in trees:
        gains = np.frombuffer(t[4])
        total += gains / gains.sum() if gains.sum() > 0 else 0.0
    model.importance = (total / total.sum() if total.sum() > 0 else total).tolist()
    return model


_FIELDS = "tree int, feature binary, cut binary, child binary, value binary, gains binary"


def _one_block(units: DataFrame, features: int, shares: int, classes: int, p: ForestParams) -> list[tuple]:
    """The trees where all rows are one block: its sums are the passes' sums, so each task grows its share of the trees."""
    def grow(batches):
        for b in batches:
            for r in b.to_pylist():
                block, x, y, w = _block(r)
                for t in range(r["share"], p.trees, shares):
                    g, draws = Growing(features, max(classes, 1)), drawn(p, t, block, len(y))
                    rows = np.flatnonzero(draws != 0)
                    node, values = np.zeros(len(rows), np.int64), _weights(y, w, rows, draws, classes)
                    while g.open:
                        picks = tried(p, t, g.level, g.open, features)
                        sums = level_sums(x, rows, node - g.lo, values, picks, p.bins).astype(np.float32).astype(np.float64)
                        g.take(*best_cuts(sums, picks, p, classes, g.level == p.depth))
                        below = descend(g.tree, x, rows, node, 1)
                        on = below >= g.lo                       # rows in a leaf are done
                        rows, node, values = rows[on], below[on], [v[on] for v in values]
                    yield pa.RecordBatch.from_pylist([dict(zip(("tree", "feature", "cut", "child", "value", "gains"), (t, *g.packed())))],
                                                     schema=pa.schema([("tree", pa.int32()), *((c, pa.binary()) for c in (
                                                         "feature", "cut", "child", "value", "gains"))]))
    got = cut_lineage(units.mapInArrow(grow, _FIELDS), "trees").orderBy("tree").toLocalIterator()
    return [tuple(r)[1:] for r in got]


def _in_passes(spark: SparkSession, units: DataFrame, features: int, shares: int, blocks: int, classes: int, p: ForestParams) -> list[tuple]:
    """The trees from one pass a level over many blocks.  A tree's sums from all blocks meet in one task, block by block."""
    state = units.rdd.map(lambda r: (r["share"], *_block(r))).persist(StorageLevel.MEMORY_AND_DISK)
    growing = [Growing(features, max(classes, 1)) for _ in range(p.trees)]
    partitions = min(p.trees, 4 * spark.sparkContext.defaultParallelism)
    while any(g.open for g in growing):
        shipped = spark.sparkContext.broadcast({t: g for t, g in enumerate(growing) if g.open})

        def sums(unit):
            share, block, x, y, w = unit
            for t, g in shipped.value.items():
                if t % shares == share:
                    draws, kept = drawn(p, t, block, len(y)), []
                    for lo in range(0, len(y), CHUNK):
                        rows = np.flatnonzero(draws[lo:lo + CHUNK] != 0) + lo
                        node = descend(g.tree, x, rows, np.zeros(len(rows), np.int64), g.level)
                        on = node >= g.lo                        # rows in a leaf are done
                        kept.append((rows[on], node[on] - g.lo))
                    rows, at = (np.concatenate(c) for c in zip(*kept))
                    got = level_sums(x, rows, at, _weights(y, w, rows, draws, classes), tried(p, t, g.level, g.open, features), p.bins)
                    yield t, got.astype(np.float32).tobytes()

        def cuts(parts):
            total = {}
            for t, got in parts:
                total[t] = total.get(t, 0.0) + np.frombuffer(got, np.float32).astype(np.float64)
            for t, s in total.items():
                g = shipped.value[t]
                picks = tried(p, t, g.level, g.open, features)
                s = s.reshape(-1, *picks.shape, p.bins)
                yield t, pickle.dumps(best_cuts(s, picks, p, classes, g.level == p.depth))
        for t, got in state.flatMap(sums).partitionBy(partitions).mapPartitions(cuts).collect():
            growing[t].take(*pickle.loads(got))
        shipped.unpersist()
    state.unpersist()
    return [g.packed() for g in growing]


def predict(data: DataFrame, model: Forest, keep: list[str], out: str = "prediction") -> DataFrame:
    """``keep`` and ``out``: the regression's value or the most likely class (the first of equals), then with ``probability`` (array)."""
    spark = data.sparkSession
    ship_package(spark)
    shipped = spark.sparkContext.broadcast(model)
    names, kept = [f"_f{i}" for i in range(len(model.features))], data.select(*keep).columns
    src = data.select(*keep, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(n) for c, n in zip(model.features, names)])
    schema = data.select(*keep, F.lit(0.0).alias(out), *([F.array(F.lit(0.0)).alias("probability")] if model.classes else [])).schema

    def run(batches):
        for b in batches:
            m = shipped.value
            got = m.values(m.binned([b.column(n).to_numpy(zero_copy_only=False) for n in names]))
            if m.classes:
                got /= got.sum(axis=1, keepdims=True)
                extra = [pa.array(got.argmax(axis=1).astype(np.float64)), pa.array(got.tolist(), pa.list_(pa.float64()))]
            else:
                extra = [pa.array(got[:, 0])]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *extra], names=schema.names)
    return src.mapInArrow(run, schema)


def importances(model: Forest, spark: SparkSession, top: int = 10) -> DataFrame:
    """ML-7: feature importance ranking (one entry a feature: bounded)."""
    rows = sorted(zip(model.features, model.importance), key=lambda r: (-r[1], r[0]))[:top]
    return spark.createDataFrame([(f, v, i + 1) for i, (f, v) in enumerate(rows)], "feature string, importance double, rank int")


def save(model: Forest, spark: SparkSession, path: str) -> str:
    """SNK-6: one Parquet row a tree (packed nodes: a size set by the parameters, not by the data) and one for the model."""
    rows = ((i, t.feature.astype(np.uint16).tobytes(), t.cut.astype(np.uint8).tobytes(), t.child.astype(np.int32).tobytes(), t.value.tobytes())
            for i, t in enumerate(model.trees))
    spark.createDataFrame(spark.sparkContext.parallelize(rows, 8), "tree int, feature binary, cut binary, child binary, value binary"
                          ).write.mode("overwrite").parquet(f"{path}/trees")
    spark.createDataFrame([(model.features, model.edges, model.classes, model.importance)],
                          "features array<string>, edges array<array<double>>, classes int, importance array<double>"
                          ).coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
    return path


def load(spark: SparkSession, path: str) -> Forest:
    """SRC-6."""
    head = spark.read.parquet(f"{path}/model").first()
    trees = [unpacked(tuple(r)[1:], max(head["classes"], 1)) for r in spark.read.parquet(f"{path}/trees").orderBy("tree").toLocalIterator()]
    return Forest(list(head["features"]), [list(e) for e in head["edges"]], head["classes"], trees, list(head["importance"]))
