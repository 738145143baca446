"""Operator 10: embedding near-duplicates by an epsilon grid order join.

For unit vectors, cosine >= c is Euclidean distance <= eps = sqrt(2 - 2c).  Vectors are sorted by the grid cells (side eps / 2)
of their leading principal coordinates, and cut into sequence intervals.  The join starts from the pair (whole sequence,
whole sequence) and replaces each pair of intervals by the pairs of their parts, dropping those whose boxes in the leading
coordinates are further apart than eps: no link can cross them.  The pairs of smallest intervals are joined in tasks, which go
on splitting them before they compare vectors.  A task takes the pairs of a tile, strips of intervals in a row against each other, so
an interval is shuffled once for each strip and not once for each interval.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import components, prepare_python
from ledgerlake.session import cut_lineage

MIN_COSINE, LEADING, INTERVAL, FAN_OUT, LEAF, PCA_SAMPLE = 0.9, 8, 2048, 4, 128, 4_000
# Bytes of vectors that the task of a tile holds at most (one interval at least).
STRIP_BYTES = 64 << 20


def unit_vectors(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(row, id, raw): raw is the unit vector's doubles, null for vectors that link with nothing (null, empty, zero, or with null
    or non-finite components)."""
    prepare_python(table.sparkSession)
    src = table.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
                       F.col(vec_col).cast("array<double>").alias("v"))
    schema = src.select("row", "id", F.lit(None).cast("binary").alias("raw")).schema

    def raw(v):
        if not v or None in v:
            return None
        x = np.array(v, dtype=np.float64)
        top = np.abs(x).max()
        if not np.isfinite(top) or top == 0:
            return None
        x = x / top                                   # no overflow or underflow of the squares
        return (x / math.sqrt(x @ x)).tobytes()

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("id"), pa.array(
                [raw(v) for v in b.column("v").to_pylist()], pa.binary())], names=["row", "id", "raw"])
    return src.mapInArrow(run, schema)


def principal_axes(classes: DataFrame, leading: int, sample: int) -> dict[int, np.ndarray]:
    """Per vector length, the leading principal axes of a bounded sample (first by hash): they set the order of the
    sequence only, no result depends on them."""
    rows = classes.select("raw").orderBy(F.xxhash64("raw")).limit(sample).collect()
    by_length: dict[int, list] = {}
    for r in rows:
        by_length.setdefault(len(r["raw"]) // 8, []).append(np.frombuffer(r["raw"]))
    return {d: np.linalg.eigh(np.cov(np.array(v).T).reshape(d, d) if len(v) > 1 else np.eye(d))[1][:, ::-1][:, :leading]
            for d, v in by_length.items()}


def intervals(classes: DataFrame, eps: float, leading: int, interval: int, sample: int) -> DataFrame:
    """(block, dim, data, weight, low, lo0.., hi0..): the grid-ordered sequence cut into intervals of up to ``interval`` vectors,
    with their boxes in the leading coordinates."""
    spark = classes.sparkSession
    axes = spark.sparkContext.broadcast(principal_axes(classes, leading, sample))
    cells = [f"c{i}" for i in range(leading)]
    placed = classes.select("raw", "weight", "low").schema

    def cell_rows(batches):
        for b in batches:
            raws = b.column("raw").to_pylist()
            out = np.zeros((len(raws), leading))
            for i, r in enumerate(raws):
                v = np.frombuffer(r)
                ax = axes.value.get(len(v))
                k = min(leading, len(v))
                out[i, :k] = v @ ax[:, :k] if ax is not None else v[:k]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in placed.names), pa.array([len(r) // 8 for r in raws], pa.int32()),
                 *(pa.array(np.floor(out[:, j] / (eps / 2)).astype(np.int32)) for j in range(leading)),
                 pa.array(out.tolist(), pa.list_(pa.float64()))], names=[*placed.names, "dim", *cells, "y"])
    schema = classes.select(*placed.names, F.lit(0).alias("dim"), *[F.lit(0).alias(c) for c in cells],
                            F.array(F.lit(0.0)).alias("y")).schema
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # raw last: equal cells, however many, are spread over partitions too
    ordered = (cut_lineage(classes.select(*placed.names).mapInArrow(cell_rows, schema), "ego_cells")
               .repartitionByRange(parts, "dim", *cells, "raw").sortWithinPartitions("dim", *cells, "raw"))
    bounds = [f"{s}{i}" for s in ("lo", "hi") for i in range(leading)]
    block_schema = ordered.select(F.lit(0).alias("part"), F.lit(0).alias("nth"), "dim", F.lit(b"").alias("data"),
                                  F.array("weight").alias("weight"), F.array("low").alias("low"),
                                  *[F.lit(0.0).alias(c) for c in bounds]).schema
    low_type = pa.int64() if dict(classes.dtypes)["low"] == "bigint" else None

    def cut(batches):
        from pyspark import TaskContext
        part, nth, held, dim = TaskContext.get().partitionId(), 0, [], None

        def block():
            y = np.array([h[3] for h in held])
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([nth], pa.int32()), pa.array([dim], pa.int32()),
                 pa.array([b"".join(h[0] for h in held)], pa.binary()), pa.array([[h[1] for h in held]], pa.list_(pa.int64())),
                 pa.array([[h[2] for h in held]], pa.list_(low_type) if low_type else None),
                 *(pa.array([x]) for x in [*y.min(axis=0), *y.max(axis=0)])], names=block_schema.names)
        for b in batches:
            for raw, weight, low, d, y in zip(*(b.column(c).to_pylist() for c in ("raw", "weight", "low", "dim", "y"))):
                if held and (d != dim or len(held) == interval):
                    yield block()
                    nth, held = nth + 1, []
                dim = d
                held.append((raw, weight, low, y))
        if held:
            yield block()
    got = cut_lineage(ordered.select("raw", "weight", "low", "dim", "y").mapInArrow(cut, block_schema), "ego_blocks")
    # one row per interval: numbered along the sequence
    number = got.select("part", "nth", (F.row_number().over(Window.orderBy("part", "nth")) - 1).cast("long").alias("block"))
    return cut_lineage(got.join(number, ["part", "nth"]).drop("part", "nth"), "ego_intervals")


def _near_boxes(a: str, b: str, leading: int, eps: float) -> Column:
    gaps = [F.greatest(F.lit(0.0), F.col(f"{a}.lo{i}") - F.col(f"{b}.hi{i}"), F.col(f"{b}.lo{i}") - F.col(f"{a}.hi{i}"))
            for i in range(leading)]
    return sum((g * g for g in gaps), F.lit(0.0)) <= eps * eps * (1 + 1e-9)


def near_intervals(blocks: DataFrame, eps: float, leading: int, fan_out: int = FAN_OUT) -> DataFrame:
    """(a, b), a <= b: the pairs of intervals that may hold links, found by descending from the whole sequence."""
    bounds = [f"lo{i}" for i in range(leading)] + [f"hi{i}" for i in range(leading)]
    boxes = blocks.select(F.col("block").alias("node"), *bounds)
    levels, n = [boxes], blocks.count()
    while n > 1:
        n = -(-n // fan_out)
        levels.append(levels[-1].groupBy(F.floor(F.col("node") / fan_out).alias("node")).agg(
            *[(F.min if c.startswith("lo") else F.max)(c).alias(c) for c in bounds]))
    levels = [levels[0], *[cut_lineage(x, "ego_boxes") for x in levels[1:]]]
    pairs = levels[-1].select(F.col("node").alias("a"), F.col("node").alias("b"))
    for level in levels[-2::-1]:
        box = F.struct(*bounds)
        up = F.floor(F.col("node") / fan_out)
        left = level.select(up.alias("a"), F.col("node").alias("na"), box.alias("x"))
        right = level.select(up.alias("b"), F.col("node").alias("nb"), box.alias("y"))
        pairs = (pairs.join(left, "a").join(right, "b").filter("na <= nb").filter(_near_boxes("x", "y", leading, eps))
                 .select(F.col("na").alias("a"), F.col("nb").alias("b")))
        pairs = cut_lineage(pairs, "ego_pairs")
    return pairs


def join_interval(x: np.ndarray, y: np.ndarray, same: bool, min_cosine: float, found) -> None:
    """Recursively join two sequence intervals of unit vectors; ``found(i, j)`` gets the links' row numbers, leaf by leaf.
    With ``same`` each link is found once (i < j)."""
    eps2 = (2 - 2 * min_cosine) * (1 + 1e-9)
    k = min(16, x.shape[1])
    fast_x, fast_y = x.astype(np.float32), y.astype(np.float32)

    def box(v):
        return v[:, :k].min(axis=0), v[:, :k].max(axis=0)
    leaves_x = [(i, min(len(x), i + LEAF)) for i in range(0, len(x), LEAF)]
    leaves_y = [(i, min(len(y), i + LEAF)) for i in range(0, len(y), LEAF)]
    box_x, box_y = [box(x[a:b]) for a, b in leaves_x], [box(y[a:b]) for a, b in leaves_y]

    def outer(boxes, lo, hi):
        return np.min([b[0] for b in boxes[lo:hi]], axis=0), np.max([b[1] for b in boxes[lo:hi]], axis=0)

    def go(xl, xh, yl, yh):
        if same and yh <= xl:
            return
        (alo, ahi), (blo, bhi) = outer(box_x, xl, xh), outer(box_y, yl, yh)
        gap = np.maximum(0, np.maximum(alo - bhi, blo - ahi))
        if gap @ gap > eps2:
            return
        if xh - xl > 1 or yh - yl > 1:
            xm, ym = (xl + xh + 1) // 2, (yl + yh + 1) // 2
            for a, b in ((xl, xm), (xm, xh)):
                for c, d in ((yl, ym), (ym, yh)):
                    if a < b and c < d:
                        go(a, b, c, d)
            return
        (a, b), (c, d) = leaves_x[xl], leaves_y[yl]
        if (fast_x[a:b] @ fast_y[c:d].T).max() < min_cosine - 1e-4:      # single precision only rules out
            return
        i, j = np.nonzero(x[a:b] @ y[c:d].T >= min_cosine)
        i, j = i + a, j + c
        if same:
            i, j = i[i < j], j[i < j]
        if len(i):
            found(i, j)
    go(0, len(leaves_x), 0, len(leaves_y))


def forest(n: int, links: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest number reachable from each of 0..n-1."""
    root = np.arange(n)
    while True:
        before = root.copy()
        for i, j in links:
            low = np.minimum(root[i], root[j])
            np.minimum.at(root, i, low)
            np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            return root


_IN_BLOCK = 1 << 20


def tile_side(blocks: DataFrame, tasks: int) -> int:
    """How many intervals in a row make a strip: as many as give some two tiles (pairs of strips) a task, and no more than
    STRIP_BYTES hold, as the task of a tile holds one strip."""
    n, most = blocks.agg(F.count(F.lit(1)), F.max(F.length("data"))).first()
    return max(1, min(math.ceil(n / math.ceil(math.sqrt(4 * tasks))), STRIP_BYTES // max(most or 1, 1)))


def tiles(blocks: DataFrame, pairs: DataFrame, side: int) -> DataFrame:
    """(ti, tj, held, block, dim, data, weight, mates): the intervals of each tile that has pairs, strip ``ti`` to be held and strip ``tj``
    to be read against it; ``mates`` are the held intervals to compare one that is read with.

    An interval is sent once to each tile, not once to each pair, so the bytes sent grow by the number of strips."""
    strip = {c: F.floor(F.col(c) / side).cast("long") for c in ("a", "b")}
    held = pairs.select(F.col("a").alias("block"), strip["a"].alias("ti"), strip["b"].alias("tj")).distinct().select(
        "block", "ti", "tj", F.lit(True).alias("held"), F.array().cast("array<long>").alias("mates"))
    read = pairs.groupBy(F.col("b").alias("block"), strip["a"].alias("ti")).agg(F.collect_list("a").alias("mates")).select(   # a strip's at most
        "block", "ti", F.floor(F.col("block") / side).cast("long").alias("tj"), F.lit(False).alias("held"), "mates")
    places = held.unionByName(read).groupBy("block").agg(F.collect_list(F.struct("ti", "tj", "held", "mates")).alias("at"))
    return blocks.select("block", "dim", "data", "weight").join(places, "block").select(
        "block", "dim", "data", "weight", F.explode("at").alias("at")).select("at.ti", "at.tj", "at.held", "block", "dim", "data", "weight", "at.mates")


def links(blocks: DataFrame, pairs: DataFrame, min_cosine: float, side: int | None = None) -> DataFrame:
    """(node, other, weight): per vector with links in a pair of intervals, how many rows it links to there, and a vector
    of its local component (which spans the component: no pairs are returned)."""
    cores = blocks.sparkSession.sparkContext.defaultParallelism
    side = side or tile_side(blocks, cores)

    def joined(a, x, wx, b, y, wy):
        same, n = a == b, len(x)
        shift = 0 if same else n
        total, found, size = np.zeros(n + (0 if same else len(y)), dtype=np.int64), [], 0

        def add(i, j):
            nonlocal size
            np.add.at(total, i, wy[j])
            np.add.at(total, j + shift, wx[i])
            found.append((i, j + shift))
            size += len(i)
            if size > 1 << 20:                            # bounded: fold what was found into a forest
                root = forest(len(total), found)
                k = np.flatnonzero(root != np.arange(len(root)))
                found[:], size = [(k, root[k])], len(k)
        join_interval(x, y, same, min_cosine, add)
        hit = np.flatnonzero(total)
        root = forest(len(total), found)
        name = np.concatenate([a * _IN_BLOCK + np.arange(n), b * _IN_BLOCK + np.arange(len(y))])
        return pa.RecordBatch.from_arrays([pa.array(name[hit], pa.int64()), pa.array(name[root[hit]], pa.int64()),
                                           pa.array(total[hit], pa.int64())], names=["node", "other", "weight"])

    def run(batches):
        tile, strip = None, {}
        for batch in batches:
            for r in batch.to_pylist():
                if (r["ti"], r["tj"]) != tile:
                    tile, strip = (r["ti"], r["tj"]), {}
                d = r["dim"]
                y, wy = np.frombuffer(r["data"]).reshape(-1, d), np.array(r["weight"])
                if r["held"]:
                    strip[r["block"]] = (d, y, wy)
                    continue
                for a in r["mates"]:
                    dim, x, wx = strip[a]
                    if dim == d:
                        yield joined(a, x, wx, r["block"], y, wy)
    # a tile's held strip comes before what is read against it
    strips = -(-blocks.count() // side)
    dealt = (tiles(blocks, pairs, side).withColumn("later", ~F.col("held")).repartition(max(8 * cores, strips * (strips + 1) // 2), "ti", "tj")
             .sortWithinPartitions("ti", "tj", "later", "block"))
    return dealt.select("ti", "tj", "held", "block", "dim", "data", "weight", "mates").mapInArrow(run, "node long, other long, weight long")


def near_duplicates(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", min_cosine: float = MIN_COSINE,
                    leading: int = LEADING, interval: int = INTERVAL, sample: int = PCA_SAMPLE) -> DataFrame:
    """Per row of ``table``: id, ``n_links`` (other rows linked directly), ``component`` (smallest id reachable), ``kept``.

    Equal vectors are folded into one weighted vector first (partial aggregation), so a vector that a third of all rows hold
    costs one comparison.  Vectors of different lengths, and vectors that are null, empty, zero or hold null or non-finite components
    link with nothing.  Rows with equal ids stay rows of their own; an empty table gives an empty result."""
    eps = math.sqrt(2 - 2 * min_cosine)
    rows = cut_lineage(unit_vectors(table, id_col, vec_col), "unit_vectors")
    classes = cut_lineage(rows.filter("raw is not null").groupBy("raw").agg(
        F.count(F.lit(1)).alias("weight"), F.min("id").alias("low")), "vector_classes")
    blocks = intervals(classes, eps, leading, interval, sample)
    found = cut_lineage(links(blocks, near_intervals(blocks, eps, leading), min_cosine), "ego_links")
    comp = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    nodes = blocks.select("block", "dim", "data", F.posexplode(F.arrays_zip("weight", "low")).alias("i", "z")).select(
        (F.col("block") * _IN_BLOCK + F.col("i")).alias("node"), F.expr("substring(data, i * dim * 8 + 1, dim * 8)").alias("raw"),
        F.col("z.weight").alias("weight"), F.col("z.low").alias("low"))
    per = (nodes.join(found.groupBy("node").agg(F.sum("weight").alias("linked")), "node", "left").join(comp, "node", "left")
           .withColumn("root", F.coalesce("root", "node")))
    lowest = per.groupBy("root").agg(F.min("low").alias("component"))
    by_raw = per.join(lowest, "root").select(
        "raw", (F.col("weight") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), "component")
    return rows.join(by_raw, "raw", "left").select(
        "id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component")).alias("component")).withColumn(
        "kept", F.col("id").eqNullSafe(F.col("component")))


def contract(spark, vectors: DataFrame) -> DataFrame:
    return near_duplicates(vectors).select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


ORACLE = r"""
WITH RECURSIVE ok AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM ok),
l AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
      AND list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.9),
r AS (SELECT x, x AS z FROM (SELECT DISTINCT x FROM l) UNION SELECT r.x, l.y FROM r JOIN l ON r.z = l.x),
c AS (SELECT x, min(z) AS component_id FROM r GROUP BY x),
n AS (SELECT x, count(*) AS n_links FROM l GROUP BY x)
SELECT e.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, coalesce(c.component_id, e.vec_id) AS component_id,
       coalesce(c.component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN n ON n.x = e.vec_id LEFT JOIN c ON c.x = e.vec_id
"""
