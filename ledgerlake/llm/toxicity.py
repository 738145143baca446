"""Operator 13: toxicity by a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

A text's features are its hashed character n-grams; a feature's value is log(1 + count) times the log of how much more often
toxic than harmless training texts hold it.  Each text's values are scaled to length 1, and a logistic regression is
fitted on them.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import output_schema, prepare_python
from ledgerlake.llm.optimise import minimise
from ledgerlake.session import cut_lineage

GRAMS, BITS, SMOOTHING, RIDGE, TOLERANCE = (4, 6), 18, 1.0, 0.02, 1e-3
SAMPLE, FIT_PARTS, THRESHOLD = 4_000, 6, 0.5
# Characters hashed at once: bounds a task's memory, whatever the lengths of texts.
BLOCK = 1 << 18
LOG_COUNT = np.log1p(np.arange(256))


@dataclass
class Model:
    weights: np.ndarray                               # of the scaled features
    ratio: np.ndarray                                 # log-count ratios
    bias: float
    prior: float                                      # share of toxic training rows: the score of a text without n-grams


def hashed(points: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The slots of all windows of ``n`` code points."""
    m = len(points) - n + 1
    if m <= 0:
        return np.empty(0, np.int64)
    h = np.full(m, n, np.uint64)
    for k in range(n):
        h = (h ^ points[k:k + m]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def code_points(text: str) -> np.ndarray:
    """The lower-cased text between blanks, so that its edges are n-grams too."""
    return np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), np.uint32).astype(np.uint64) if text else np.empty(0, np.uint64)


def _long(points: np.ndarray, grams: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots and counts of one text of any length, block by block."""
    count = np.zeros(1 << bits, np.int64)
    for n in grams:
        for at in range(0, len(points), BLOCK):
            count += np.bincount(hashed(points[at:at + BLOCK + n - 1], n, bits), minlength=1 << bits)
    ids = np.flatnonzero(count)
    return ids, count[ids]


def _short(group: list[np.ndarray], grams: tuple[int, ...], bits: int):
    """Slots and counts of several texts, sorted together."""
    if not group:
        return
    points = np.concatenate(group)
    sizes = np.array([len(g) for g in group])
    ends = np.repeat(np.cumsum(sizes), sizes)
    owner = np.repeat(np.arange(len(group)), sizes)
    keys = []
    for n in grams:
        slots = hashed(points, n, bits)
        inside = np.arange(len(slots)) + n <= ends[:len(slots)]
        keys.append((owner[:len(slots)][inside] << bits) | slots[inside])
    keys, count = np.unique(np.concatenate(keys), return_counts=True)
    cut = np.searchsorted(keys, np.arange(1, len(group)) << bits)
    ids = keys & ((1 << bits) - 1)
    yield from zip(np.split(ids, cut), np.split(count, cut))


def features(texts, grams: tuple[int, ...] = GRAMS, bits: int = BITS):
    """(slots, counts up to 255) of each text, in order."""
    group, size = [], 0
    def clipped(got):
        for ids, count in got:
            yield ids, np.minimum(count, 255).astype(np.uint8)
    for t in texts:
        points = code_points(t or "")
        if size + len(points) > BLOCK:
            yield from clipped(_short(group, grams, bits))
            group, size = [], 0
        if len(points) > BLOCK:
            yield from clipped([_long(points, grams, bits)])
        else:
            group.append(points)
            size += len(points)
    yield from clipped(_short(group, grams, bits))


def log_count_ratio(toxic: np.ndarray, harmless: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """The naive Bayes log-count ratios from the summed values of each slot in both classes; 0 where neither has any."""
    p, q = toxic + smoothing, harmless + smoothing
    return np.where(toxic + harmless > 0, np.log(p / p.sum()) - np.log(q / q.sum()), 0.0)


def scaled(ids: np.ndarray, counts: np.ndarray, owner: np.ndarray, rows: int, ratio: np.ndarray) -> np.ndarray:
    """The rows' feature values: log counts times ratios, each row scaled to length 1."""
    x = LOG_COUNT[counts] * ratio[ids]
    length = np.sqrt(np.bincount(owner, weights=x * x, minlength=rows))
    return x / np.where(length > 0, length, 1.0)[owner]


def loss_and_gradient(theta, ids, x, owner, y, weight) -> tuple[float, np.ndarray]:
    """Weighted log loss of the logistic regression and its gradient; the bias is ``theta``'s last entry."""
    dims = len(theta) - 1
    z = np.bincount(owner, weights=theta[ids] * x, minlength=len(y)) + theta[-1]
    signed = np.where(y == 1, z, -z)
    loss = float((weight * np.logaddexp(0.0, -signed)).sum())
    off = weight * (1 / (1 + np.exp(-np.clip(z, -700, 700))) - y)
    return loss, np.append(np.bincount(ids, weights=off[owner] * x, minlength=dims), off.sum())


def labelled_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id",
                       text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(text, label) of the labelled documents: about ``sample`` of each class at most, chosen by a hash of their ids (a documented
    bound, for the fit only).  An id that is labelled more than once counts as toxic if any of its labels says so."""
    one = (labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("l_id"))
           .agg(F.max(label_col).cast("int").alias("label")))
    sizes = {r["label"]: r["n"] for r in one.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0)
    for label, n in sizes.items():
        share = F.when(F.col("label") == label, int(min(1.0, sample / n) * (1 << 20))).otherwise(share)
    chosen = one.filter(F.pmod(F.xxhash64("l_id"), F.lit(1 << 20)) < share)
    # distinct ids, so the sample's bound is the broadcast's
    return docs.select(F.col(id_col).alias("l_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "l_id").select("text", "label")


def fit(labelled: DataFrame, grams: tuple[int, ...] = GRAMS, bits: int = BITS, ridge: float = RIDGE) -> Model:
    """The model from rows with a text and a label 0 or 1 (null texts: empty), both classes weighted to equal totals.

    Hashed rows are written once; each evaluation is one Spark job whose FIT_PARTS tasks (the sample is bounded) return
    one sum each.  Without rows of both classes all weights are 0 and every score is the share of toxic rows (no rows: 0)."""
    spark = labelled.sparkSession
    prepare_python(spark)
    dims = 1 << bits

    def make(batches):
        for b in batches:
            got = list(features(b.column("text").to_pylist(), grams, bits))
            yield pa.RecordBatch.from_arrays(
                [b.column("y"), pa.array([i.astype(np.int32).tobytes() for i, _ in got], pa.binary()),
                 pa.array([c.tobytes() for _, c in got], pa.binary())], names=["y", "ids", "counts"])
    rows = cut_lineage(labelled.select(F.col("label").cast("int").alias("y"), "text")
                       .mapInArrow(make, "y int, ids binary, counts binary").repartition(FIT_PARTS), "labelled")
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    prior = sizes.get(1, 0) / total if total else 0.0
    if len(sizes) < 2:
        return Model(np.zeros(dims), np.zeros(dims), float(np.log((prior + 1e-9) / (1 - prior + 1e-9))), prior)

    def gather(one):
        """The sum over the tasks of what ``one(ids, counts, owner, y)`` returns: one row for each of the few tasks."""
        def part(batches):
            got = list(batches)
            ids, counts = ([r for b in got for r in b.column(c).to_pylist()] for c in ("ids", "counts"))
            y = np.array([v for b in got for v in b.column("y").to_pylist()], np.int64)
            owner = np.repeat(np.arange(len(y)), [len(c) for c in counts])
            out = one(np.frombuffer(b"".join(ids), np.int32), np.frombuffer(b"".join(counts), np.uint8), owner, y)
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["out"])
        # however small the splits in which the written rows are read, no more than FIT_PARTS sums reach the driver
        return sum(np.frombuffer(r["out"]) for r in rows.coalesce(FIT_PARTS).mapInArrow(part, "out binary").collect())

    def class_sums(ids, counts, owner, y):
        value, toxic = LOG_COUNT[counts], y[owner] == 1
        return np.concatenate([np.bincount(ids[k], weights=value[k], minlength=dims) for k in (toxic, ~toxic)])
    sums = gather(class_sums)
    ratio = log_count_ratio(sums[:dims], sums[dims:])
    shipped_ratio = spark.sparkContext.broadcast(ratio)
    share = np.array([total / (2 * sizes[k]) for k in (0, 1)])

    def evaluate(theta):
        shipped = spark.sparkContext.broadcast(theta)

        def one(ids, counts, owner, y):
            x = scaled(ids, counts, owner, len(y), shipped_ratio.value)
            loss, g = loss_and_gradient(shipped.value, ids, x, owner, y, share[y])
            return np.concatenate([[loss], g])
        out = gather(one)
        shipped.destroy()
        w, grad = theta[:-1], out[1:].copy()
        grad[:-1] += ridge * w
        return out[0] + 0.5 * ridge * float(w @ w), grad
    theta = minimise(evaluate, np.zeros(dims + 1), TOLERANCE)
    shipped_ratio.destroy()
    return Model(theta[:-1], ratio, float(theta[-1]), prior)


def scores(texts, model: Model, grams: tuple[int, ...] = GRAMS, bits: int = BITS) -> np.ndarray:
    out = []
    for ids, counts in features(texts, grams, bits):
        if len(ids):
            x = scaled(ids, counts, np.zeros(len(ids), np.int64), 1, model.ratio)
            out.append(1 / (1 + np.exp(-np.clip(x @ model.weights[ids] + model.bias, -40, 40))))
        else:
            out.append(model.prior)
    return np.array(out, dtype=np.float64)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", grams: tuple[int, ...] = GRAMS,
          bits: int = BITS, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: id, ``score`` (probability of the label), ``predicted`` (1 where score >= threshold).

    Texts without n-grams (null, empty, one character) get the share of toxic rows in training; repeated rows the same
    score; an empty table gives an empty result.  Whole texts are read in blocks, so their length is no limit."""
    spark = docs.sparkSession
    prepare_python(spark)
    shipped = spark.sparkContext.broadcast(model)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = output_schema(src.select("id", F.lit(0.0).alias("score")))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(scores(b.column("text").to_pylist(), shipped.value, grams, bits),
                                                                       pa.float64())], names=schema.names)
    return src.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def is_held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def contract(spark, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels are learned from ids that are not held out (a null id is never labelled)."""
    model = fit(labelled_documents(docs, labels.filter(~is_held_out("doc_id"))))
    return score(docs, model).select(F.col("id").alias("doc_id"), is_held_out("id").alias("held_out"), "score", "predicted")
