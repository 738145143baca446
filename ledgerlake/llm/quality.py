"""Operator 3: quality classifier by ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered thresholds cut its score into grades:
P(grade > k) = sigmoid(score - threshold_k).  The model gives the expected grade and the tail probability by which
documents are selected.
"""
from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import prepare_python, worker_memo
from ledgerlake.llm.optimise import minimise
from ledgerlake.session import cut_lineage

BITS, SAMPLE, FIT_PARTS, MEMO = 17, 40_000, 6, 1_000_000
TOLERANCE, RIDGE, RARE = 2e-3, 1.0, 50.0
MIN_TAIL, PREFIXES, DAMPING = 0.5, (5,), 0.5
FEATURE = re.compile(r"\w+")


class Features:
    """Hashed features of a whole text: its distinct lower-cased words, the beginnings of those words, and as coarse steps how
    often a word follows itself, the share of marks and the share of capitals."""

    def __init__(self, bits: int = BITS):
        self.mask, self.memo = (1 << bits) - 1, {}

    def slot(self, name: str) -> int:
        return zlib.crc32(name.encode()) & self.mask

    def of_word(self, word: str) -> tuple[int, ...]:
        return self.slot(word), *(self.slot(f"{word[:k]}-") for k in PREFIXES if len(word) >= k)

    def split(self, text: str | None) -> tuple[set[str], list[int]]:
        """The distinct words, and the slots of the steps."""
        text = text or ""
        words = FEATURE.findall(text.lower())
        raw = text.encode()
        steps = {"again": sum(map(str.__eq__, words, words[1:])) / max(1, len(words)),
                 "marks": 1 - len(raw.translate(None, b"#*$%&|<>!")) / max(1, len(raw)),
                 "upper": 1 - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")) / max(1, len(raw))}
        return set(words), [self.slot(f"<{name}>{k}") for name, x in steps.items() for k in range(1, int(min(x, 0.4) * 50) + 1)]

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The features' slots and values: 1 for a step; for a word less in texts of many words (DAMPING)."""
        words, ids = self.split(text)
        steps = len(ids)
        for w in words:
            ids += self.of_word(w)
        values = np.full(len(ids), damped(len(words)), dtype=np.float32)
        values[:steps] = 1
        return np.array(ids, dtype=np.int32), values

    def total(self, text: str | None, w: np.ndarray, memo: dict[str, float]) -> float:
        """The sum of the text's feature weights; ``memo`` holds the words' (bounded)."""
        words, ids = self.split(text)
        try:
            score = sum([memo[x] for x in words])
        except KeyError:
            if len(memo) > MEMO:
                memo.clear()
            for x in words:
                if x not in memo:
                    memo[x] = float(sum(w[i] for i in self.of_word(x)))
            score = sum([memo[x] for x in words])
        return score * damped(len(words)) + float(w[ids].sum())


def damped(words: int) -> float:
    return 4 * max(1, words) ** -DAMPING


@worker_memo
def features(bits: int) -> Features:
    return Features(bits)


def loss_and_gradient(theta: np.ndarray, ids: np.ndarray, values: np.ndarray, sizes: np.ndarray, y: np.ndarray,
                      weight: np.ndarray, dims: int) -> tuple[float, np.ndarray]:
    """Weighted log loss of the cumulative-link model and its gradient.  ``theta`` is the weights, the first threshold
    and the logarithms of the thresholds' distances; ``ids`` and ``values`` the rows' features one after the other, ``sizes`` how many each has."""
    w, cuts = theta[:dims], thresholds(theta[dims:])
    n, k = len(y), len(cuts)
    owner = np.repeat(np.arange(n), sizes)
    score = np.bincount(owner, weights=w[ids] * values, minlength=n)
    above = 1 / (1 + np.exp(-np.clip(score[:, None] - cuts[None, :], -40, 40)))      # P(grade > j)
    full = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], axis=1)
    slope = np.concatenate([np.zeros((n, 1)), above * (1 - above), np.zeros((n, 1))], axis=1)
    i = np.arange(n)
    p = np.maximum(full[i, y] - full[i, y + 1], 1e-12)
    d_score = -weight * (slope[i, y] - slope[i, y + 1]) / p
    g_cut = (np.bincount(y, weights=weight * slope[i, y] / p, minlength=k + 2)
             - np.bincount(y + 1, weights=weight * slope[i, y + 1] / p, minlength=k + 2))[1:k + 1]
    later = np.cumsum(g_cut[::-1])[::-1]             # a distance moves all later thresholds
    g = np.concatenate([np.bincount(ids, weights=d_score[owner] * values, minlength=dims),
                        later * np.concatenate([[1.0], np.exp(theta[dims + 1:])])])
    return float(-(weight * np.log(p)).sum()), g


def thresholds(free: np.ndarray) -> np.ndarray:
    return free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))])


def rated_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, grade) of about ``sample`` labelled documents at most, chosen by a hash of their ids (a documented bound, for the fit
    only).  The graded rating: 2 good and harmless, 1 good or harmless only, 0 neither."""
    graded = labels.select("doc_id", (F.col("quality") + 1 - F.col("toxic")).cast("int").alias("grade")).filter(
        "grade is not null and doc_id is not null")
    # a repeated id's lowest grade, so that ids are distinct and the sample's bound is the broadcast's
    graded = graded.groupBy("doc_id").agg(F.min("grade").alias("grade"))
    share = min(1.0, sample / max(1, graded.count()))
    chosen = graded.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "grade")


def fit(rated: DataFrame, grades: int, text_col: str = "text", grade_col: str = "grade", bits: int = BITS,
        tolerance: float = TOLERANCE) -> np.ndarray:
    """Weights and free thresholds from rows with a text and a grade 0..grades-1, by L-BFGS until the gradient's norm is
    ``tolerance`` times that at the start.

    Grades are weighted to equal totals, and rare features are held back more (RARE).  Each evaluation is one Spark job over the
    hashed rows; its FIT_PARTS tasks (the sample is bounded) return one gradient each.  Without rows the weights are 0 and
    all grades equally likely."""
    prepare_python(rated.sparkSession)
    dims = 1 << bits

    def hashed(batches):
        make = features(bits)
        for b in batches:
            got = [make(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("y"), *(pa.array([g[k].tobytes() for g in got], pa.binary()) for k in (0, 1))], names=["y", "ids", "values"])
    rows = cut_lineage(rated.filter(F.col(grade_col).between(0, grades - 1))
                       .select(F.col(grade_col).cast("int").alias("y"), F.col(text_col).alias("text"))
                       .mapInArrow(hashed, "y int, ids binary, values binary").repartition(FIT_PARTS), "rated")
    totals = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    # start: equally likely grades
    even = [np.log(k / (grades - k)) for k in range(1, grades)]
    start = [even[0], *np.log(np.diff(even))]
    if not totals:
        return np.concatenate([np.zeros(dims), start])
    size = sum(totals.values())
    share = {y: size / (len(totals) * n) for y, n in totals.items()}
    context = rows.sparkSession.sparkContext

    def gather(one):
        """The sum over the tasks of what ``one(ids, values, sizes, y)`` returns: one row for each of the few tasks."""
        def part(batches):
            got = list(batches)
            raw, values = ([r for b in got for r in b.column(c).to_pylist()] for c in ("ids", "values"))
            y = np.array([v for b in got for v in b.column("y").to_pylist()], dtype=np.int64)
            out = one(np.frombuffer(b"".join(raw), dtype=np.int32), np.frombuffer(b"".join(values), dtype=np.float32),
                      np.array([len(r) // 4 for r in raw], dtype=np.int64), y)
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["out"])
        # however small the splits in which the written rows are read, no more than FIT_PARTS sums reach the driver
        return sum(np.frombuffer(r["out"]) for r in rows.coalesce(FIT_PARTS).mapInArrow(part, "out binary").collect())

    seen = gather(lambda ids, values, sizes, y: np.bincount(ids, minlength=dims).astype(float))
    ridge = RIDGE * (1 + RARE / np.maximum(1.0, seen))

    def evaluate(theta):
        shipped = context.broadcast(theta)

        def one(ids, values, sizes, y):
            loss, g = loss_and_gradient(shipped.value, ids, values, sizes, y, np.array([share[int(v)] for v in y]), dims)
            return np.concatenate([[loss], g])
        out = gather(one)
        shipped.destroy()
        w, grad = theta[:dims], out[1:].copy()
        grad[:dims] += ridge * w
        return out[0] + 0.5 * float(ridge * w @ w), grad

    # in units in which the penalty is the same for all weights the search is better conditioned
    unit = np.concatenate([1 / np.sqrt(ridge), np.ones(grades - 1)])

    def scaled(u):
        loss, grad = evaluate(u * unit)
        return loss, grad * unit
    return minimise(scaled, np.concatenate([np.zeros(dims), start]), tolerance) * unit


def score(docs: DataFrame, theta: np.ndarray, grades: int, id_col: str = "doc_id", text_col: str = "text",
          bits: int = BITS, min_tail: float = MIN_TAIL) -> DataFrame:
    """Per row of ``docs``: id, ``expected_grade``, ``tail_probability`` (of the best grade), ``kept`` (tail >= min_tail).

    Null texts are empty; repeated rows get the same grade; an empty table gives an empty result."""
    spark = docs.sparkSession
    prepare_python(spark)
    dims = 1 << bits
    shipped = spark.sparkContext.broadcast(theta)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = src.select("id", F.lit(0.0).alias("expected_grade"), F.lit(0.0).alias("tail_probability")).schema

    def run(batches):
        make, w, cuts, memo = features(bits), shipped.value[:dims], thresholds(shipped.value[dims:]), {}
        for b in batches:
            z = np.array([make.total(t, w, memo) for t in b.column("text").to_pylist()])
            above = 1 / (1 + np.exp(-np.clip(z.reshape(-1, 1) - cuts[None, :], -40, 40)))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(above.sum(axis=1)), pa.array(above[:, -1])],
                                             names=schema.names)
    return src.mapInArrow(run, schema).withColumn("kept", F.col("tail_probability") >= min_tail)


def contract(spark, docs: DataFrame, labels: DataFrame) -> DataFrame:
    theta = fit(rated_documents(docs, labels), 3)
    return score(docs, theta, 3).withColumnRenamed("id", "doc_id")
