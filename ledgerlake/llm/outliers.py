"""Operator 7: quality rules by robust multivariate outliers.

Per language and source, the minimum covariance determinant: from several starts, concentration steps keep the three quarters of the
documents that lie closest to the current estimate and re-estimate centre and covariance from them, as long as the covariance's
determinant falls; the start with the smallest determinant gives the group's estimate.  A document is rejected when its transformed
statistics lie too far from its group's centre in Mahalanobis distance.
"""
from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import join_small, output_schema, prepare_python, release_memos
from ledgerlake.session import cut_lineage

SYMBOLS, BLANKS = "#*$%&|<>", " \t\n\x0b\f\r"
MIN_WORDS = 50
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_word_lines", "n_upper"]
DIMS = ["x_words", "x_length", "x_symbols", "x_lines", "x_repeats", "x_upper"]
D = len(DIMS)
KEPT_SHARE, PRIOR, TAIL_Z = 0.75, 50.0, 4.0
# A step counts as progress if the logarithm of the determinant falls by more than this.
LEAST_FALL = 1e-3
STARTS = ["quartiles", "moments", "pool"]


def text_stats(text: str | None) -> tuple[int, ...]:
    """STATS of one whole text (null: empty)."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, BLANKS))
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    repeats = 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        times, covered = Counter(windows), bytearray(n)
        for i, x in enumerate(windows):
            if times[x] > 1:
                covered[i:i + 3] = b"\1\1\1"
        repeats = sum(covered)
    return (n, chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeats, len(lines),
            len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")))


def statistics(docs: DataFrame, id_col: str, text_col: str, group_cols: list[str], whole_rows: bool = False) -> DataFrame:
    """(id, text_hash, g0.., STATS, DIMS): the statistics of every row and their transforms; on request with all its
    columns in a struct ``row``."""
    prepare_python(docs.sparkSession)
    keys = [f"g{i}" for i in range(len(group_cols))]
    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"),
                      *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(k)
                        for c, k in zip(group_cols, keys)],
                      *([F.struct("*").alias("row")] if whole_rows else []), F.col(text_col).alias("text"))
    carried = src.columns[:-1]
    schema = output_schema(src.select(*carried, *[F.lit(0).cast("long").alias(s) for s in STATS]))

    def run(batches):
        release_memos()
        for b in batches:
            cols = list(zip(*map(text_stats, b.column("text").to_pylist()))) or [()] * len(STATS)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carried), *(pa.array(c, pa.int64()) for c in cols)],
                                             names=schema.names)
    got = src.mapInArrow(run, schema)

    def share(part, whole):
        return F.sqrt(F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col(part), F.col(whole)), F.lit(0.0))))
    x = [F.log1p("n_words"), F.log(F.greatest(F.coalesce(F.try_divide("word_chars", "n_words"), F.lit(1.0)), F.lit(1.0))),
         share("n_symbols", "word_chars"), share("n_dup_lines", "n_word_lines"), share("n_repeat_words", "n_words"),
         share("n_upper", "word_chars")]
    return got.select("*", *[c.cast("double").alias(d) for c, d in zip(x, DIMS)])


# ---- chi-square with an even number of degrees ---------------------------------------------------------------

def chi2_cdf(x: float, d: int) -> float:
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(d // 2))


def chi2_quantile(p: float, d: int) -> float:
    low, high = 0.0, 1e3
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, d) < p else (low, mid)
    return (low + high) / 2


def consistency(share: float = KEPT_SHARE) -> float:
    """By how much the covariance of the ``share`` of a normal sample that lies closest to its centre is too small."""
    return share / chi2_cdf(chi2_quantile(share, D), D + 2)


def limit(tail_z: float = TAIL_Z) -> float:
    """The squared distance beyond which a normal variable of D dimensions lies as often as a single one beyond ``tail_z``."""
    return chi2_quantile(1 - math.erfc(tail_z / math.sqrt(2)) / 2, D)


# ---- the estimate --------------------------------------------------------------------------------------------

def resolution(n_words: float, word_chars: float, n_word_lines: float, n_upper: float) -> np.ndarray:
    """What one more word, character, symbol, repeated line, repeated window or capital changes in a document with
    these statistics: no spread is taken to be smaller."""
    n, chars, lines, upper = (max(1.0, float(v or 0)) for v in (n_words, word_chars, n_word_lines, n_upper))
    return np.array([math.log1p(1 / n), math.log1p(1 / chars), math.sqrt(1 / chars), math.sqrt(1 / lines),
                     math.sqrt(min(1.0, 3 / n)), math.sqrt((upper + 1) / chars) - math.sqrt(upper / chars)])


def moments_of(n: int, s, ss) -> tuple[np.ndarray, np.ndarray]:
    m = np.asarray(s, float) / n
    c = np.zeros((D, D))
    c[np.triu_indices(D)] = np.asarray(ss, float) / n
    return m, c + np.triu(c, 1).T - np.outer(m, m)


def shape(n: float, mean: np.ndarray, cov: np.ndarray, pool, floor: np.ndarray):
    """(centre, precision, log determinant) of an estimate from ``n`` documents.

    It is drawn towards the pool of all documents with the weight of PRIOR documents, at every n alike; the floor bounds the
    spread in every direction from below (in units of the floor no eigenvalue is under 1)."""
    if pool is not None:
        a = n / (n + PRIOR)
        mean, cov = a * mean + (1 - a) * pool[0], a * cov + (1 - a) * pool[1]
    e, u = np.linalg.eigh(cov / np.outer(floor, floor))
    e = np.maximum(e, 1.0)
    half = u / np.sqrt(e)
    return mean, (half @ half.T) / np.outer(floor, floor), float(np.log(e).sum() + 2 * np.log(floor).sum())


def _distance(precision: str, centre: str) -> Column:
    off = [F.col(x) - F.col(centre)[i] for i, x in enumerate(DIMS)]
    total = F.lit(0.0)
    for i in range(D):
        for j in range(i, D):
            total = total + F.col(precision)[i * D + j] * off[i] * off[j] * (1.0 if i == j else 2.0)
    return F.greatest(total, F.lit(0.0))


def _level(d2: Column) -> Column:
    """Distances on a grid of their logarithms (steps of 1 %), so that a quantile of any number of them takes a bounded table."""
    return F.round(F.log(d2 + 1e-6), 2)


_ESTIMATE = "centre array<double>, prec array<double>, logdet double, done boolean"


def _solve(moments: DataFrame, keys: list[str], names: list[str], pool) -> DataFrame:
    """One row per group from the moments of each start's core: the new estimate of each start, unless the determinant did
    not fall.  ``before`` holds the estimates the cores came from (null at first)."""
    schema = output_schema(moments.select(*keys, "floor", *[F.from_json(F.lit("{}"), _ESTIMATE).alias(s) for s in names]))
    scale = consistency()

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                floor, row = np.array(r["floor"]), {k: r[k] for k in [*keys, "floor"]}
                for s in names:
                    old, n = r[f"{s}_old"], r[f"{s}_n"]
                    if old is not None and (old["done"] or not n):
                        row[s] = old | {"done": True}
                        continue
                    m, c = moments_of(n, r[f"{s}_s"], r[f"{s}_ss"])
                    centre, prec, logdet = shape(n, m, scale * c, pool, floor)
                    if old is not None and logdet > old["logdet"] - LEAST_FALL:
                        row[s] = old | {"done": True}
                    else:
                        row[s] = {"centre": centre.tolist(), "prec": prec.ravel().tolist(), "logdet": logdet, "done": False}
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(
                [b.schema.field(k) for k in keys] + [pa.field("floor", pa.list_(pa.float64()))] + [pa.field(s, pa.struct(
                    [("centre", pa.list_(pa.float64())), ("prec", pa.list_(pa.float64())), ("logdet", pa.float64()),
                     ("done", pa.bool_())])) for s in names]))
    return moments.mapInArrow(run, schema)


def _sums(stats: DataFrame, keys: list[str], inside: dict[str, Column], old: DataFrame | None) -> DataFrame:
    """Per group and start the moments of the rows that are ``inside``: one aggregation, partial before the shuffle."""
    aggs = []
    for s, c in inside.items():
        x = [F.when(c, F.col(d)) for d in DIMS]
        aggs += [F.count(F.when(c, 1)).alias(f"{s}_n"), F.array(*[F.sum(v) for v in x]).alias(f"{s}_s"),
                 F.array(*[F.sum(x[i] * F.col(DIMS[j])) for i in range(D) for j in range(i, D)]).alias(f"{s}_ss")]
    got = stats.groupBy(*keys).agg(*aggs)
    return got if old is None else got.join(old, keys) if keys else got.crossJoin(old)     # one row each without keys


def concentrate(stats: DataFrame, keys: list[str], pool) -> DataFrame:
    """(keys, centre, prec) of every group of ``stats`` (one row without ``keys``).  All documents take part in each step; no
    task gathers a group: quantiles come from tables of counts, moments from partial sums.

    Starts: medians with the quartiles' spreads; mean and covariance; the pool's estimate (if there is one).  A start goes on while
    its determinant falls, so the steps end by themselves."""
    names = STARTS if pool is not None else STARTS[:2]
    first = stats.groupBy(*keys).agg(
        *[F.percentile(c, F.lit(0.5)).alias(f"m_{c}") for c in ("n_words", "word_chars", "n_word_lines", "n_upper")],
        *[F.percentile(F.round(d, 3), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q_{d}") for d in DIMS])
    whole = _sums(stats, keys, {"moments": F.lit(True)}, None)
    start = cut_lineage(first.join(whole, keys) if keys else first.crossJoin(whole), "mcd_start")
    schema = output_schema(start.select(*keys, F.array(F.lit(0.0)).alias("floor"),
                                        *[F.from_json(F.lit("{}"), _ESTIMATE).alias(s) for s in names]))

    def begin(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                if not r["moments_n"]:
                    continue
                floor = resolution(r["m_n_words"], r["m_word_chars"], r["m_n_word_lines"], r["m_n_upper"])
                q = np.array([r[f"q_{d}"] for d in DIMS])
                m, c = moments_of(r["moments_n"], r["moments_s"], r["moments_ss"])
                tries = {"quartiles": (q[:, 1], np.diag(((q[:, 2] - q[:, 0]) / 1.349) ** 2)), "moments": (m, c)}
                if pool is not None:
                    tries["pool"] = pool
                row = {k: r[k] for k in keys} | {"floor": floor.tolist()}
                for s in names:
                    centre, prec, _ = shape(1.0, *tries[s], None, floor)
                    # a start is no estimate of a core: the first one always counts as progress
                    row[s] = {"centre": centre.tolist(), "prec": prec.ravel().tolist(), "logdet": math.inf, "done": False}
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(
                [b.schema.field(k) for k in keys] + [pa.field("floor", pa.list_(pa.float64()))] + [pa.field(s, pa.struct(
                    [("centre", pa.list_(pa.float64())), ("prec", pa.list_(pa.float64())), ("logdet", pa.float64()),
                     ("done", pa.bool_())])) for s in names]))
    est = cut_lineage(start.mapInArrow(begin, schema), "mcd")
    while True:
        near = _joined(stats, est, keys)
        for s in names:
            near = near.withColumn(f"l_{s}", _level(_distance(f"{s}.prec", f"{s}.centre")))
        cut = cut_lineage(near.groupBy(*keys).agg(*[F.percentile(f"l_{s}", F.lit(KEPT_SHARE)).alias(f"c_{s}") for s in names]),
                          "mcd_cut")
        core = _joined(near.select(*keys, *DIMS, *[f"l_{s}" for s in names]), cut, keys)
        old = est.select(*keys, "floor", *[F.col(s).alias(f"{s}_old") for s in names])
        sums = _sums(core, keys, {s: F.col(f"l_{s}") <= F.col(f"c_{s}") for s in names}, old)
        est = cut_lineage(_solve(sums, keys, names, pool), "mcd")
        if not est.filter(~F.col(names[0])["done"] | ~F.col(names[1])["done"] | ~F.col(names[-1])["done"]).limit(1).count():
            break
    best = F.array_sort(F.array(*[F.struct(F.col(s)["logdet"].alias("logdet"), F.lit(k).alias("k"), F.col(s)["centre"].alias("centre"),
                                           F.col(s)["prec"].alias("prec")) for k, s in enumerate(names)]))[0]
    return cut_lineage(est.select(*keys, best.alias("b")).select(*keys, "b.centre", "b.prec"), "mcd")


def _joined(rows: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    return join_small(rows, small, keys) if keys else rows.crossJoin(F.broadcast(small))      # one row


def estimates(stats: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, centre, prec) of every group; the pool is the same estimate over all documents as one group."""
    used = stats.select(*keys, *DIMS, "n_words", "word_chars", "n_word_lines", "n_upper")
    one = concentrate(used, [], None).first()
    if one is None:
        pool = (np.zeros(D), np.eye(D))
    else:
        pool = (np.array(one["centre"]), np.linalg.inv(np.array(one["prec"]).reshape(D, D)))
    return concentrate(used, keys, pool)


def judged(docs: DataFrame, id_col: str, text_col: str, group_cols: tuple[str, ...], tail_z: float, whole_rows: bool) -> DataFrame:
    keys = [f"g{i}" for i in range(len(group_cols))]
    stats = cut_lineage(statistics(docs, id_col, text_col, list(group_cols), whole_rows), "text_stats")
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (join_small(stats, estimates(stats, keys), keys).withColumn("distance2", _distance("prec", "centre"))
            .withColumn("base_failed", base).withColumn("kept", ~base & (F.col("distance2") <= limit(tail_z))))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          group_cols: tuple[str, ...] = ("lang", "source"), tail_z: float = TAIL_Z) -> DataFrame:
    """Per row of ``docs``: id, text_hash, STATS, ``base_failed`` (under 50 words, or over half of the words in repeated
    three-word windows), ``distance2`` and ``kept``.

    Null languages and sources are groups of their own; null and empty texts fail the base rule; repeated rows get the same
    verdict; an empty table gives an empty result."""
    return judged(docs, id_col, text_col, group_cols, tail_z, False).select(
        "id", "text_hash", *STATS, "base_failed", "distance2", "kept")


def keep_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   group_cols: tuple[str, ...] = ("lang", "source"), tail_z: float = TAIL_Z) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns.  Rows are written beside their statistics and judged there: no text is
    shuffled."""
    return judged(docs, id_col, text_col, group_cols, tail_z, True).filter("kept").select("row.*")


def contract(spark, docs: DataFrame) -> DataFrame:
    return judge(docs).select(F.col("id").alias("doc_id"), *STATS[:5], "base_failed", "kept", "distance2")
