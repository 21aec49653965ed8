"""Whitening of vectors by principal components, found in float32 and refined in higher precision.

The covariance is gathered in tasks: integer products of rounded-mean-centred vectors, so their sums are exact and
the same however rows are dealt. The driver holds d x d only. Eigenvectors of the covariance in float32 are the
start; Ogita and Aishima's iteration, matrix products in extended precision, corrects them until it settles. Where
eigenvalues lie closer together than the iteration can tell, the cluster's span is right but not the vectors in it: the
matrix is then projected on the span, less the cluster's mean, and solved there.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh
from .vector_codes import _arrow
from .vectors import stored, usable

SCALE, SHIFT = 1024, 100_000
#: Extended precision where the machine has it.
WIDE = np.longdouble
ROWS = 4096  # that a product takes at once


def refined(a: np.ndarray, x: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, eigenvectors as columns) of the symmetric matrix a, from the approximate vectors x.

    A round takes the vectors' errors of length and direction from two products, r = I - x'x and s = x'ax:
    the correction of x_j along x_i is (s_ij + e_j r_ij) / (e_j - e_i), or r_ij / 2 where e_i and e_j are closer than
    what r and s leave open. Errors fall quadratically. Clusters that stay are solved in their own span."""
    a, x = a.astype(WIDE), x.astype(WIDE)
    n = len(a)
    eye, eps = np.eye(n, dtype=WIDE), np.finfo(WIDE).eps
    before, solved = np.inf, False
    for _ in range(rounds):
        r, s = eye - x.T @ x, x.T @ (a @ x)
        s = (s + s.T) / 2  # else rounding, over a small gap, costs orthogonality
        e = np.diag(s) / (1 - np.diag(r))
        off = np.sqrt(((s - np.diag(np.diag(s))) ** 2).sum()) + np.abs(e).max(initial=0) * np.sqrt((r**2).sum())
        gap = e[None, :] - e[:, None]
        apart = np.abs(gap) > 2 * off
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(apart, (s + e[None, :] * r) / gap, r / 2)
        x = x + x @ step
        size = float(np.abs(step).max(initial=0))
        close = _clusters(e, apart)
        if (size <= 4 * n * eps or (size < 1e-12 and size >= before / 2)) and (not close or solved):
            break
        solved = bool(close) and size < 1e-3
        if solved:
            x = _solved_apart(a, x, close)
        before = size
    e = np.diag(x.T @ (a @ x)) / np.diag(x.T @ x)
    order = np.argsort(-e, kind="stable")
    return e[order], x[:, order]


def _clusters(e: np.ndarray, apart: np.ndarray) -> list[np.ndarray]:
    """Groups of neighbouring eigenvalues that can't be told apart, each of two at least."""
    order = np.argsort(-e, kind="stable")
    joined = ~apart[order[:-1], order[1:]]
    groups = np.split(order, np.flatnonzero(~joined) + 1)
    return [g for g in groups if len(g) > 1]


def _solved_apart(a: np.ndarray, x: np.ndarray, clusters: list[np.ndarray]) -> np.ndarray:
    """x with the vectors of each cluster turned within their span: a less the cluster's mean, projected, has no
    large common part, so that double precision resolves the differences."""
    x = x.copy()
    for g in clusters:
        v = x[:, g]
        mean = np.trace(v.T @ (a @ v)) / len(g)
        small = v.T @ (a @ v) - mean * (v.T @ v)
        size = np.abs(small).max()
        if size > 0:
            _, turn = np.linalg.eigh((small / size).astype(float))
            x[:, g] = v @ turn[:, ::-1].astype(WIDE)
    return x


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) in double precision of a symmetric matrix in WIDE."""
    if not len(a):
        return np.zeros(0), np.zeros((0, 0))
    size = np.abs(a).max()
    if size == 0:
        return np.zeros(len(a)), np.eye(len(a))
    _, x = np.linalg.eigh((a / size).astype(np.float32))
    e, x = refined(a / size, x)
    x = x / np.sqrt((x**2).sum(0))
    return (e * size).astype(float), x.astype(float)


@dataclass
class Fit:
    n: int
    sums: list[int]  # of the integers, by dimension
    values: np.ndarray  # of the components kept, falling
    vectors: np.ndarray  # (dimensions, components)
    trace: float


def _whole(batch: pa.RecordBatch) -> np.ndarray:
    """The vectors of a batch as integers (rows, dimensions)."""
    flat = batch["v"].flatten().to_numpy(zero_copy_only=False)
    x = np.floor(SCALE * flat)
    if len(x) and np.abs(x).max() >= 1 << 61:
        raise ValueError("vectors are too large for whole numbers of 64 bits")
    return (x.astype(np.int64) + SHIFT).reshape(len(batch), -1)


def _sums(types: pa.Schema):
    """By dimension: rows, sum, least and greatest value in a task."""

    def run(batches):
        fresh()
        n, total, lo, hi = 0, None, None, None
        for b in batches:
            if not len(b):
                continue
            x = _whole(b)
            part = x.astype(object).sum(0) if np.abs(x).max() > (1 << 62) // len(x) else x.sum(0).astype(object)
            total = part if total is None else total + part
            lo, hi = (x.min(0), x.max(0)) if lo is None else (np.minimum(lo, x.min(0)), np.maximum(hi, x.max(0)))
            n += len(x)
        if n:
            import decimal

            d = len(lo)
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([decimal.Decimal(int(t)) for t in total], pa.decimal128(38, 0)), pa.array(lo), pa.array(hi)], schema=types)

    return run


def _products(centre: np.ndarray, reach: int, types: pa.Schema):
    """Sums over a task of the products of centred entries, upper triangle.

    Products of whole numbers are exact in float64 while a block's sums stay below 2 ** 53; larger numbers
    are multiplied as Python integers."""
    import decimal

    exact = reach * reach * ROWS < 1 << 53

    def run(batches):
        fresh()
        d = len(centre)
        total = np.zeros((d, d), object)
        for b in batches:
            x = _whole(b) - centre
            for i in range(0, len(x), ROWS):
                y = x[i : i + ROWS].astype(float if exact else object)
                total = total + ((y.T @ y).astype(np.int64).astype(object) if exact else y.T.dot(y))
        i, j = np.triu_indices(d)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([decimal.Decimal(int(t)) for t in total[i, j]], pa.decimal128(38, 0))], schema=types)

    return run


def covariance(n: int, sums: list[int], centre: list[int], products: dict[tuple[int, int], int]) -> np.ndarray:
    """The covariance, divisor n, each entry the exact fraction rounded once to WIDE."""
    d = len(sums)
    rest = [s - n * c for s, c in zip(sums, centre, strict=True)]
    v = np.zeros((d, d), WIDE)
    for (i, j), p in products.items():
        v[i, j] = v[j, i] = _wide(Fraction(n * p - rest[i] * rest[j], n * n))
    return v


def _wide(q: Fraction) -> np.longdouble:
    high = float(q)
    return WIDE(high) + WIDE(float(q - Fraction(high)))


def fit(rows: DataFrame, components: int) -> Fit | None:
    """Components of the rows' vectors `v` (all of one length), None without rows."""
    sums = "i int, n long, s decimal(38,0), lo long, hi long"
    got = rows.mapInArrow(_sums(_arrow(sums)), sums).groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("i").collect()
    if not got:
        return None
    n, total = got[0]["n"], [int(x["s"]) for x in got]
    centre = [(2 * s + n) // (2 * n) for s in total]
    reach = max(max(x["hi"] - c, c - x["lo"]) for x, c in zip(got, centre, strict=True))
    pairs = "i int, j int, p decimal(38,0)"
    products = rows.mapInArrow(_products(np.array(centre, np.int64), reach, _arrow(pairs)), pairs).groupBy("i", "j").agg(F.sum("p").alias("p")).collect()
    v = covariance(n, total, centre, {(x["i"], x["j"]): int(x["p"]) for x in products})
    values, vectors = eigen(v)
    return Fit(n, total, values[:components], vectors[:, :components], float(np.trace(v)))


def _projector(f: Fit):
    """(batch) -> (deviations, whitened (rows, components)); whitened is NaN for components without spread."""
    sums, d = f.sums, len(f.sums)
    floor = max(f.values.max(initial=0.0), 0.0) * d * 1e-15
    spread = np.where(f.values > floor, f.values, np.nan)
    basis = f.vectors / np.sqrt(spread)

    def of(batch: pa.RecordBatch):
        x = _whole(batch)
        if _narrow(x, f.n, sums):
            y = f.n * x - np.array(sums, np.int64)
            return (y * y).sum(1), (y / f.n) @ basis
        y = f.n * x.astype(object) - np.array(sums, object)
        dev = [int(t) if t < 1 << 63 else None for t in (y * y).sum(1)]
        return dev, (y.astype(float) / f.n) @ basis

    return of


def _narrow(x: np.ndarray, n: int, sums: list[int]) -> bool:
    """Whether n * x - sums and its squares' sums fit 64 bits."""
    if not len(x):
        return True
    lo, hi = x.min(0).tolist(), x.max(0).tolist()
    far = max(max(abs(n * a - s), abs(n * b - s)) for a, b, s in zip(lo, hi, sums, strict=True))
    return far * far * len(sums) < 1 << 63 and max(map(abs, sums)) < 1 << 62 and max(n * abs(v) for v in (*lo, *hi)) < 1 << 62


def _moments(f: Fit, types: pa.Schema):
    """Sums over a task of whitened values (j = -1) and of their products."""
    of = _projector(f)

    def run(batches):
        fresh()
        k = len(f.values)
        one, two = np.zeros(k), np.zeros((k, k))
        for b in batches:
            w = of(b)[1]
            one += w.sum(0)
            two += w.T @ w
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_arrays([pa.array([*range(k), *i], pa.int32()), pa.array([-1] * k + list(j), pa.int32()), pa.array([*one, *two[i, j]], pa.float64())], schema=types)

    return run


def identity_error(rows: DataFrame, f: Fit) -> float | None:
    """The largest entry of the whitened vectors' measured covariance less the identity, components without spread apart."""
    kind = "i int, j int, s double"
    got = rows.mapInArrow(_moments(f, _arrow(kind)), kind).groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    m = {(x["i"], x["j"]): x["s"] / f.n for x in got}
    errors = [abs(s - m[i, -1] * m[j, -1] - (i == j)) for (i, j), s in m.items() if j >= 0 and not np.isnan(s)]
    return max(errors, default=None)


def _rows(f: Fit, error: float | None, types: pa.Schema):
    of, k = _projector(f), len(f.values)

    def run(batches):
        fresh()
        for b in batches:
            for i in range(0, len(b), ROWS):
                part = b.slice(i, ROWS)
                n = len(part)
                dev, w = of(part)
                at = pa.array(np.repeat(np.arange(n), k))
                share = f.values / f.trace if f.trace > 0 else np.full(k, np.nan)
                none = lambda x: pa.array(x, pa.float64(), mask=np.isnan(x))
                yield pa.RecordBatch.from_arrays(
                    [part["id"].take(at), pa.array(np.tile(np.arange(1, k + 1), n), pa.int32()), pa.array(np.full(n * k, f.n), pa.int64()), pa.array(dev, pa.int64()).take(at), none(w.ravel()), none(np.tile(share, n)), pa.array([error] * (n * k), pa.float64())], schema=types
                )

    return run


def whitened(vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per row that takes part (see vectors.usable) and component up to `components`: id_col, component, n,
    deviation, whitened, explained, identity_error.

    An entry c is the whole number x = floor(1024 c) + 100000; n counts the rows and S sums them by dimension. deviation
    is the exact sum over dimensions of (n x - S) ** 2, null where it exceeds 64 bits. whitened is x - S/n projected
    on the component over the square root of its eigenvalue e, null for components without spread (e zero to double
    precision); explained is e over the covariance's trace, null if that is zero. identity_error is measured on all
    whitened rows. Repeated rows count each and give repeated rows; vectors of fewer dimensions than `components` have
    so many components; an empty table gives no rows; other columns are ignored."""
    rows, d = usable(vectors, vector, [F.col(id_col).alias("id")])
    rows = rows.withColumnRenamed("__v", "v")
    own = rows.schema["id"].dataType.simpleString()
    kind = f"{id_col} {own}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    f = fit(rows, components) if d else None
    if f is None:
        return rows.mapInArrow(lambda batches: iter(()), kind)
    return rows.mapInArrow(_rows(f, identity_error(rows, f), _arrow(kind)), kind)
