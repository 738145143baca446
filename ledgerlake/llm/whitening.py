"""Operator 11: embedding whitening by incremental eigendecomposition.

Every partition keeps the spectrum (eigenvalues and eigenvectors) of the scatter of what it has read and updates it by centred
rank-one terms: each solves the secular equation for the new eigenvalues, after deflation.  Two spectra are combined by
one rank-one update for each eigenpair of the second and one for the distance of the means, in a tree of bounded groups.
A distributed Rayleigh-Ritz step over all vectors, centred at the exact mean, then refines the combined basis to double precision.
"""
from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import output_schema, prepare_python
from ledgerlake.session import cut_lineage

SCALE, COMPONENTS = 256, 4
# Vectors read at once: their triangular factor (as many rows as dimensions) has their scatter and takes fewer updates.
BLOCK, BLOCK_BYTES = 8192, 32 << 20
FAN_IN, RANK_TOLERANCE = 32, 1e-13
_EPS = np.finfo(np.float64).eps


# ---- rank-one updates --------------------------------------------------------------------------------------

def secular_roots(d: np.ndarray, z2: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """The roots of 1 + rho * sum(z2 / (d - x)), d strictly ascending, z2 > 0, as (nearest pole's index, distance from it).

    All roots at once: one lies between each pole and the next, the last within rho * sum(z2) above the last pole.  Each step
    fits a rational function with the two poles around the root; a bracket guards it by bisection."""
    n = len(d)
    i = np.arange(n)
    upper = np.append(d[1:], d[-1] + rho * z2.sum())
    width = upper - d
    if n == 1:
        return i, rho * z2
    # the sign at the middle of the interval says which pole is nearer
    at_middle = 1 + rho * (z2[None, :] / ((d[None, :] - d[:, None]) - (width / 2)[:, None])).sum(axis=1)
    near = np.where((at_middle >= 0) | (i == n - 1), i, i + 1)
    delta = d[None, :] - d[near][:, None]             # poles seen from the origin pole
    own = near == i
    low = np.where(own, 0.0, -width / 2)
    high = np.where(own, np.where((i == n - 1) & (at_middle < 0), width, width / 2), 0.0)
    low = np.where((i == n - 1) & (at_middle < 0), width / 2, low)
    left, right = np.where(own, 0.0, d - d[near]), upper - d[near]
    tau = (low + high) / 2
    below = i[None, :] <= i[:, None]
    for step in range(200):
        gap = delta - tau[:, None]
        term = rho * z2[None, :] / gap
        f = 1 + term.sum(axis=1)
        done = np.abs(f) <= 4 * n * _EPS * (1 + np.abs(term).sum(axis=1))
        low, high = np.where(f < 0, tau, low), np.where(f < 0, high, tau)
        done |= high - low <= 2 * _EPS * np.maximum(np.abs(low), np.abs(high))
        if done.all():
            break
        slope = term / gap
        psi, phi = (slope * below).sum(axis=1), (slope * ~below).sum(axis=1)
        dl, dr = left - tau, right - tau
        c = f - dl * psi - dr * phi
        a = (dl + dr) * f - dl * dr * (psi + phi)
        b = dl * dr * f
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0.0))
        with np.errstate(divide="ignore", invalid="ignore"):
            eta = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        new = tau + eta
        safe = np.isfinite(new) & (new > low) & (new < high) & (step % 6 != 5)
        tau = np.where(done, tau, np.where(safe, new, (low + high) / 2))
    return near, tau


def rank_one(values: np.ndarray, basis: np.ndarray, x: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """The spectrum (ascending eigenvalues, columns of ``basis``) of basis * values * basis' + rho * x x', rho > 0.

    Deflation: directions without a share in x stay; of (nearly) equal eigenvalues one direction takes x's whole share.
    Vectors are formed from weights recomputed from the roots (Gu and Eisenstat), so they stay orthogonal."""
    z = basis.T @ x
    norm = math.sqrt(z @ z)
    if norm == 0:
        return values, basis
    rho, z = rho * norm * norm, z / norm
    order = np.argsort(values, kind="stable")
    d, z, u = values[order], z[order], basis[:, order].copy()
    tol = 8 * _EPS * max(np.abs(d).max(), rho)
    held = -1                                          # the last direction that takes part
    active = np.ones(len(d), bool)
    for j in range(len(d)):
        if rho * abs(z[j]) <= tol:
            active[j] = False
            continue
        if held >= 0:
            r = math.hypot(z[held], z[j])
            c, s = z[j] / r, z[held] / r
            if abs((d[j] - d[held]) * c * s) <= tol:   # rotate the pair: all of z to j
                u[:, [held, j]] = u[:, [held, j]] @ np.array([[c, s], [-s, c]])
                d[held], d[j] = d[held] * c * c + d[j] * s * s, d[held] * s * s + d[j] * c * c
                z[held], z[j], active[held] = 0.0, r, False
        held = j
    k = np.flatnonzero(active)
    if len(k) == 0:
        return d, u
    k = k[np.argsort(d[k], kind="stable")]
    p, zz = d[k], z[k]
    near, tau = secular_roots(p, zz * zz, rho)
    gap = (p[near][:, None] - p[None, :]) + tau[:, None]        # root i minus pole j
    n = len(k)
    poles = p[:, None] - p[None, :]
    i = np.arange(n)
    # product over the roots of (root - pole j), each but the last divided by the pole distance that brackets it
    ratio = np.ones((n, n))
    ratio[:-1] = gap[:-1] / np.where(i[:-1, None] < i[None, :], poles[:-1], poles[1:])
    weight = np.sqrt(np.abs(ratio[:-1].prod(axis=0) * gap[-1] / rho)) * np.sign(zz)
    vectors = weight[None, :] / -gap
    vectors /= np.sqrt((vectors * vectors).sum(axis=1))[:, None]
    u[:, k] = u[:, k] @ vectors.T
    d[k] = p[near] + tau
    return d, u


@dataclass
class Spectrum:
    """Count, exact sums, mean and spectrum of the scatter (sum of centred squares) of a set of vectors."""
    dim: int
    n: int = 0
    sums: list[int] = field(default_factory=list)
    mean: np.ndarray = None
    values: np.ndarray = None
    basis: np.ndarray = None

    def __post_init__(self):
        if self.mean is None:
            self.sums, self.mean = [0] * self.dim, np.zeros(self.dim)
            self.values, self.basis = np.zeros(self.dim), np.eye(self.dim)

    def update(self, x: np.ndarray, rho: float = 1.0) -> None:
        self.values, self.basis = rank_one(self.values, self.basis, x, rho)

    def join(self, n: int, sums: list[int], mean: np.ndarray, terms: np.ndarray) -> None:
        """Add ``n`` vectors with this mean, whose scatter is the sum of the squares of ``terms``' rows."""
        if not n:
            return
        for x in terms:
            self.update(x)
        if self.n:
            self.update(mean - self.mean, self.n * n / (self.n + n))
        self.mean = self.mean + (mean - self.mean) * (n / (self.n + n))
        self.n, self.sums = self.n + n, [a + b for a, b in zip(self.sums, sums)]

    def add_block(self, x: np.ndarray) -> None:
        """Read whole-number vectors: the block is centred at its mean and, where it has more rows than dimensions, replaced
        by the rows of its triangular factor, which have the same scatter.  A block of one row is a plain rank-one update."""
        exact = x.astype(object) if np.abs(x).max(initial=0) > 1 << 40 else x
        real = x.astype(np.float64)
        mean = real.mean(axis=0)
        off = real - mean
        self.join(len(x), [int(v) for v in exact.sum(axis=0)], mean, np.linalg.qr(off, mode="r") if len(off) > self.dim else off)

    def merge(self, other: Spectrum) -> None:
        positive = other.values > 0
        self.join(other.n, other.sums, other.mean, np.sqrt(other.values[positive])[:, None] * other.basis[:, positive].T)

    def row(self) -> dict:
        return {"n": self.n, "sums": [str(v) for v in self.sums],
                "state": np.concatenate([self.mean, self.values, self.basis.ravel()]).tobytes()}

    @staticmethod
    def of_row(n: int, sums: list[str], state: bytes) -> Spectrum:
        d = len(sums)
        raw = np.frombuffer(state)
        return Spectrum(d, n, [int(v) for v in sums], raw[:d].copy(), raw[d:2 * d].copy(), raw[2 * d:].reshape(d, d).copy())


_ROW = "n long, sums array<string>, state binary"
_TYPES = pa.schema([("n", pa.int64()), ("sums", pa.list_(pa.string())), ("state", pa.binary())])


def _matrix(column, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), dim)


def _blocks(batches, dim: int, block: int):
    """The vectors of a task in matrices of ``block`` rows (the last may be shorter)."""
    held, size = [], 0
    for b in batches:
        held.append(_matrix(b.column("x"), dim))
        size += len(held[-1])
        if size >= block:
            rows = np.concatenate(held)
            for at in range(0, size - block + 1, block):
                yield rows[at:at + block]
            held, size = [rows[size - size % block:]], size % block
    if size:
        yield np.concatenate(held)


def block_rows(dim: int) -> int:
    return max(dim, min(BLOCK, BLOCK_BYTES // (8 * dim)))


def partition_spectra(fit_list: DataFrame, dim: int, block: int) -> DataFrame:
    """One row for each partition that has vectors."""
    def run(batches):
        held = Spectrum(dim)
        for x in _blocks(batches, dim, block):
            held.add_block(x)
        if held.n:
            yield pa.RecordBatch.from_pylist([held.row()], schema=_TYPES)
    return fit_list.select("x").mapInArrow(run, _ROW)


def tree(level: DataFrame, merge, schema: str, types: pa.Schema):
    """The one row (None without rows) that ``merge`` makes of all rows: each task merges some FAN_IN of them, in the order
    of their contents, and each level is written, so neither a task nor the driver holds more."""
    level = cut_lineage(level, "spectra")
    count = level.count()
    while count > 1:
        groups = -(-count // FAN_IN)
        level = cut_lineage(
            level.withColumn("g", F.pmod(F.xxhash64("state"), F.lit(groups))).groupBy("g").applyInArrow(
                lambda t: pa.Table.from_pylist([merge(sorted(t.drop_columns(["g"]).to_pylist(), key=lambda r: r["state"]))],
                                               schema=types), schema), "spectra")
        count = level.count()
    return level.first()


def combine(spectra: DataFrame) -> Spectrum | None:
    """All partitions' spectra as one (None without any)."""
    def merge(rows):
        total = Spectrum.of_row(**rows[0])
        for r in rows[1:]:
            total.merge(Spectrum.of_row(**r))
        return total.row()
    row = tree(spectra, merge, _ROW, _TYPES)
    return None if row is None else Spectrum.of_row(**row.asDict())


# ---- refinement --------------------------------------------------------------------------------------------

def projected_moments(fit_list: DataFrame, dim: int, centre: np.ndarray, basis: np.ndarray, block: int) -> np.ndarray:
    """The covariance (divisor n) of basis' (x - centre) over the fit list.

    Every block is centred at its own mean before it is multiplied; blocks, tasks and levels are merged by the distance of
    their means.  The driver gets one row of some dim**2 numbers."""
    spark = fit_list.sparkSession
    shipped = spark.sparkContext.broadcast((centre, basis))
    k = basis.shape[1]
    types = pa.schema([("n", pa.int64()), ("state", pa.binary())])

    def merged(parts):
        n, mean, square = 0, np.zeros(k), np.zeros((k, k))
        for m, other, more in parts:
            off = other - mean
            square += more + np.outer(off, off) * (n * m / (n + m))
            mean, n = mean + off * (m / (n + m)), n + m
        return {"n": n, "state": np.concatenate([mean, square.ravel()]).tobytes()}

    def stored(rows):
        for r in rows:
            raw = np.frombuffer(r["state"])
            yield r["n"], raw[:k], raw[k:].reshape(k, k)

    def own(batches):
        def parts():
            middle, axes = shipped.value
            for x in _blocks(batches, dim, block):
                y = (x - middle) @ axes
                m = y.mean(axis=0)
                yield len(y), m, (y - m).T @ (y - m)
        got = merged(parts())
        if got["n"]:
            yield pa.RecordBatch.from_pylist([got], schema=types)
    schema = "n long, state binary"
    row = tree(fit_list.select("x").mapInArrow(own, schema), lambda rows: merged(stored(rows)), schema, types)
    shipped.destroy()
    return np.frombuffer(row["state"])[k:].reshape(k, k) / row["n"]


@dataclass
class Whitening:
    """The fitted transform: n, exact sums, eigenvalues (falling) and unit eigenvectors (columns), trace of the covariance."""
    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def centre(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def rank(self) -> int:
        """Components with variance: those above the rounding error of the largest."""
        return int((self.values > RANK_TOLERANCE * max(self.values[0], 0.0)).sum()) if len(self.values) else 0

    def project(self, x: np.ndarray, components: int) -> np.ndarray:
        """The whitened coordinates; 0 on components without variance."""
        e = self.values[:components]
        scale = np.where(np.arange(len(e)) < self.rank, 1 / np.sqrt(np.where(e > 0, e, 1.0)), 0.0)
        return (x - self.centre) @ self.axes[:, :components] * scale


def fit(fit_list: DataFrame, dim: int, components: int = COMPONENTS, block: int | None = None) -> Whitening | None:
    """The whitening of the fit list's vectors (whole numbers, column x, all of ``dim`` entries); None for an empty list.

    Rayleigh-Ritz: the covariance is projected on the combined basis in one pass over all vectors, and the small projected
    matrix's eigenvectors turn the basis; repeated until that matrix is diagonal, or as near as rounding lets it be."""
    block = block or block_rows(dim)
    total = combine(partition_spectra(fit_list, dim, block))
    if total is None:
        return None
    centre = np.array([s / total.n for s in total.sums])
    basis, before = total.basis, math.inf
    while True:
        basis, _ = np.linalg.qr(basis)
        h = projected_moments(fit_list, dim, centre, basis, block)
        off = np.abs(h - np.diag(np.diag(h))).max()
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, basis = values[::-1], (basis @ turn)[:, ::-1]
        if off <= 8 * dim * _EPS * max(values[0], 0.0) or off > before / 2:
            break
        before = off
    made = Whitening(total.n, total.sums, np.maximum(values, 0.0), basis, max(float(np.trace(h)), 0.0))
    k = min(components, dim, made.rank)
    if k:
        cov = projected_moments(fit_list, dim, centre, basis[:, :k] / np.sqrt(made.values[:k]), block)
        made.identity_error = float(np.abs(cov - np.eye(k)).max())
    return made


# ---- the operator ------------------------------------------------------------------------------------------

def whole_vectors(table: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """(id, x): floor(scale * entry) of the vectors that are neither null nor empty and hold finite entries only."""
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return (table.filter(F.col(vec_col).isNotNull() & (F.size(v) > 0) & ~bad)
            .select(F.col(id_col).alias("id"), F.transform(v, lambda c: F.floor(c * F.lit(float(scale)))).alias("x")))


def main_length(rows: DataFrame) -> int:
    """The length that most vectors have (ties: the longest); 0 for an empty table."""
    top = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return top["d"] if top else 0


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """sum((n * x - S)**2) of each row, exact; null beyond a long."""
    top = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if top * top * x.shape[1] < 1 << 63:
        off = n * x - np.array(sums, np.int64)
        return (off * off).sum(axis=1).tolist()
    exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def whiten(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS,
           scale: int = SCALE, block: int | None = None) -> DataFrame:
    """Per row of ``table`` that has a usable vector: id, n, deviation, ``whitened`` (array, one number a component), ``explained``
    (each component's share of the variance), identity_error (how far the whitened fit list's covariance is from the identity).

    Left out: vectors that are null, empty, or hold null or non-finite entries, and those that are not of the length most
    vectors have.  The fit list holds each distinct vector once (partial aggregation), so repeated rows do not weigh more; rows
    that repeat an id stay rows.  Components without variance are whitened to 0.  An empty table gives an empty result."""
    spark = table.sparkSession
    prepare_python(spark)
    rows = cut_lineage(whole_vectors(table, id_col, vec_col, scale), "whole_vectors")
    dim = main_length(rows)
    rows = rows.filter(F.size("x") == dim)
    fit_list = cut_lineage(rows.select("x").distinct(), "fit_list")
    made = fit(fit_list, dim, components, block) if dim else None
    numbers = F.array(F.lit(0.0))
    schema = output_schema(rows.select("id", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"),
                         numbers.alias("whitened"), numbers.alias("explained"), F.lit(0.0).alias("identity_error")))
    if made is None:
        return rows.filter("false").select("id", *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields[1:]])
    shipped = spark.sparkContext.broadcast(made)

    def run(batches):
        m = shipped.value
        k = min(components, dim)
        explained = (m.values[:k] / m.trace if m.trace > 0 else np.zeros(k)).tolist()
        for b in batches:
            x = _matrix(b.column("x"), dim)
            size = len(x)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array([m.n] * size, pa.int64()), pa.array(deviations(x, m.n, m.sums), pa.int64()),
                 pa.array(m.project(x, k).tolist(), pa.list_(pa.float64())),
                 pa.array([explained] * size, pa.list_(pa.float64())), pa.array([m.identity_error] * size, pa.float64())],
                names=schema.names)
    return rows.mapInArrow(run, schema)


def contract(spark, vectors: DataFrame) -> DataFrame:
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c")
    return whiten(vectors).select("id", "n", "deviation", "identity_error", each).select(
        F.col("id").alias("vec_id"), (F.col("at") + 1).cast("int").alias("component"), "n", "deviation",
        F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")
