"""Whitening of embeddings by the leading eigenvectors of their covariance, found by Jacobi-Davidson.

The covariance is never formed. A product with it is one distributed pass: every task centres its
vectors, multiplies and sums, and only as many numbers as a few vectors have come back. Around such
products the driver runs Jacobi-Davidson on vectors of the embedding's length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbflow.llm.common import written

Product = Callable[[np.ndarray], np.ndarray]

# Scaled components beyond this have no exact place among doubles that are summed.
RANGE = 1 << 40
RESIDUAL = 1e-14  # of the largest eigenvalue: what double precision leaves of a residual


def scaled_integers(vector: Column, factor: int = 256) -> Column:
    """Every component c as the integer floor(factor * c)."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * factor).cast("long"))


def finite(vector: Column) -> Column:
    """True for vectors without null and non-finite components."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return vector.isNotNull() & ~bad


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, dim)


def _summed(df: DataFrame, one_batch: Callable[[np.ndarray], np.ndarray], dim: int, kind: str = "double") -> np.ndarray:
    """The sum over all vectors of what ``one_batch`` gives for a batch, as a flat array.

    A task adds its batches up and sends one array; Spark adds the tasks' arrays by place.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                found = one_batch(_matrix(batch, dim))
                total = found if total is None else total + found
        if total is not None:
            flat = total.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["at", "value"])

    rows = df.select("x").mapInArrow(partial, f"at long, value {kind}").groupBy("at").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(len(rows), np.int64 if kind == "long" else np.float64)
    for row in rows:
        out[row["at"]] = row["value"]
    return out


@dataclass(frozen=True)
class Fitted:
    """Mean and count of the fit list, its leading eigenpairs, their share of all variance, and how
    far the whitened fit list's covariance is from the identity."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float


def _orthonormal(block: np.ndarray, basis: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """As many columns as ``block`` (or as there is room for), orthonormal among themselves and to
    ``basis``; a column that vanishes is replaced by a random one."""
    dim = len(block)
    kept = basis
    for column in block.T[: dim - basis.shape[1]]:
        for _ in range(4):
            size = np.linalg.norm(column)
            column = column / size if size > 0 else rng.standard_normal(dim)
            left = column - kept @ (kept.T @ column)
            if np.linalg.norm(left) > 1e-8 * np.linalg.norm(column):
                left -= kept @ (kept.T @ left)
                left /= np.linalg.norm(left)
                left -= kept @ (kept.T @ left)
                kept = np.column_stack([kept, left / np.linalg.norm(left)])
                break
            column = rng.standard_normal(dim)
    return kept[:, basis.shape[1] :]


def _corrections(product: Product, shifts: np.ndarray, ritz: np.ndarray, residuals: np.ndarray, steps: int, accuracy: float) -> np.ndarray:
    """MINRES for every unlocked pair's projected correction equation, side by side.

    Each equation is (I - QQ')(A - shift I)(I - QQ') t = -r with Q all Ritz vectors of the wanted
    pairs. All of them take a step together, so a step costs one pass over the data.
    """

    def project(block: np.ndarray) -> np.ndarray:
        return block - ritz @ (ritz.T @ block)

    right = project(-residuals)
    size = np.linalg.norm(right, axis=0)
    solution = np.zeros_like(right)
    live = size > 0
    v_old, w, w_old = np.zeros_like(right), np.zeros_like(right), np.zeros_like(right)
    v = np.divide(right, size, out=np.zeros_like(right), where=live)
    beta, eta = np.zeros(len(size)), size.copy()
    c, c_old, s, s_old = np.ones(len(size)), np.ones(len(size)), np.zeros(len(size)), np.zeros(len(size))
    for _ in range(steps):
        if not live.any():
            break
        full = np.zeros_like(v)
        full[:, live] = product(v[:, live])
        ahead = project(full - v * shifts)
        alpha = (v * ahead).sum(0)
        ahead = project(ahead - v * alpha - v_old * beta)
        grown = np.linalg.norm(ahead, axis=0)
        # One Givens rotation a step turns the tridiagonal matrix into a triangle.
        rho0 = c * alpha - c_old * s * beta
        rho1 = np.hypot(rho0, grown)
        rho2, rho3 = s * alpha + c_old * c * beta, s_old * beta
        fine = live & (rho1 > 0)
        safe = np.where(fine, rho1, 1.0)
        c_old, s_old = c, s
        c, s = np.where(fine, rho0 / safe, 1.0), np.where(fine, grown / safe, 0.0)
        w, w_old = np.where(fine, (v - w_old * rho3 - w * rho2) / safe, 0.0), w
        solution += np.where(fine, w * (c * eta), 0.0)
        eta = np.where(fine, -s * eta, 0.0)
        live = fine & (np.abs(eta) > accuracy * size) & (grown > 1e-300)
        v_old, v = v, np.divide(ahead, grown, out=np.zeros_like(ahead), where=live)
        beta = grown
    return project(solution)


def jacobi_davidson(
    product: Product, dim: int, wanted: int, steps: int = 4, room: int = 24, tolerance: float = RESIDUAL,
    most: int = 200, seed: int = 11,
) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues and unit eigenvectors of a symmetric matrix known by products.

    Rayleigh-Ritz over a growing subspace gives Ritz pairs. Leading pairs whose residual is down to
    rounding are locked, and the corrections of the others extend the subspace; at ``room`` columns
    it is cut to the best. Pairs stay in the subspace when locked, so Ritz vectors stay orthonormal.
    """
    rng = np.random.default_rng(seed)
    wanted = min(wanted, dim)
    room = min(dim, max(room, 4 * wanted))
    basis = _orthonormal(rng.standard_normal((dim, min(dim, wanted + 4))), np.zeros((dim, 0)), rng)
    image = product(basis)
    best, stalled = np.inf, 0
    for turn in range(most):
        small = basis.T @ image
        values, mixing = np.linalg.eigh((small + small.T) / 2)
        values, mixing = values[::-1], mixing[:, ::-1]
        ritz = basis @ mixing[:, :wanted]
        residuals = image @ mixing[:, :wanted] - ritz * values[:wanted]
        scale = max(float(np.abs(values).max()), np.finfo(float).tiny)
        sizes = np.linalg.norm(residuals, axis=0) / scale
        locked = int(np.argmax(np.append(sizes > tolerance, True)))
        # What rounding leaves may lie above the tolerance: then no turn brings it further down.
        stalled = stalled + 1 if sizes.max() > 0.5 * best else 0
        best = min(best, float(sizes.max()))
        if locked == wanted or basis.shape[1] == dim or (best < 100 * tolerance and stalled >= 3):
            return values[:wanted], ritz
        if basis.shape[1] + wanted - locked > room:
            kept = mixing[:, : min(2 * wanted, basis.shape[1])]
            basis, image = basis @ kept, image @ kept
        found = _corrections(product, values[locked:wanted], ritz, residuals[:, locked:], steps, 0.5 ** (turn + 2))
        added = _orthonormal(found, basis, rng)
        basis, image = np.column_stack([basis, added]), np.column_stack([image, product(added)])
    raise ArithmeticError(f"no convergence in {most} turns: largest residual {best:.1e} of the first eigenvalue")


def fit_whitening(fit: DataFrame, dim: int, wanted: int = 4) -> Fitted:
    """Leading components of a list of integer vectors ``x`` of one length.

    A component counts if its eigenvalue is above rounding (1e-12 of the first). A list without
    variance has none.
    """
    n = fit.count()
    sums = _summed(fit, lambda x: x.sum(0), dim, "long")
    mean = sums / n
    trace = float(_summed(fit, lambda x: ((x - mean) ** 2).sum(0), dim).sum()) / n
    if trace <= 0:
        return Fitted(n, sums, np.zeros(0), np.zeros((dim, 0)), np.zeros(0), 0.0)

    def product(block: np.ndarray) -> np.ndarray:
        def centred(x: np.ndarray) -> np.ndarray:
            z = x - mean
            return z.T @ (z @ block)

        return _summed(fit, centred, dim).reshape(block.shape) / n

    values, vectors = jacobi_davidson(product, dim, wanted)
    good = values > 1e-12 * values[0]
    values, vectors = values[good], vectors[:, good]
    scale = vectors / np.sqrt(values)
    # The whitened list is centred on its own mean, as any covariance here, before it is multiplied.
    middle = _summed(fit, lambda x: ((x - mean) @ scale).sum(0), dim) / n

    def spread(x: np.ndarray) -> np.ndarray:
        w = (x - mean) @ scale - middle
        return w.T @ w

    identity = _summed(fit, spread, dim).reshape(len(values), -1) / n
    return Fitted(n, sums, values, vectors, values / trace, float(np.abs(identity - np.eye(len(values))).max()))


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """The exact sum over dimensions of (n x - S)^2 of each row; null where no long holds it."""
    reach = n * int(np.abs(x).max(initial=0)) + int(np.abs(sums).max(initial=0))
    if x.shape[1] * reach * reach < 1 << 63:
        return ((n * x - sums) ** 2).sum(1).tolist()
    exact = [sum((n * c - s) ** 2 for c, s in zip(row, sums.tolist(), strict=True)) for row in x.tolist()]
    return [value if value < 1 << 63 else None for value in exact]


def whiten(
    df: DataFrame, components: int = 4, factor: int = 256, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """Whitened coordinates of every vector on the leading components of all distinct vectors.

    Components c become integers x = floor(factor * c). The fit list is each distinct x once, n of
    them with sums S. Gives per row and component: ``component`` (from 1, by falling eigenvalue e),
    ``n``, ``deviation`` (exact sum of (n x - S)^2), ``whitened`` (x - S/n on the component, over
    sqrt(e)), ``explained`` (e over the whole variance) and ``identity_error`` (largest entry of the
    whitened fit list's covariance minus the identity).

    Rows whose vector is null, empty, or holds null, non-finite or (scaled) above 2^40 components
    take no part. Vectors of another length are another fit of their own, so a table of mixed
    lengths takes one run a length. Equal rows count once in the fit and each have their results;
    null keys are kept. A component without variance is left out, so a list of one distinct vector
    gives no rows, as an empty table does. Only the two named columns are read.
    """
    spark = df.sparkSession
    rows = written(
        df.filter(finite(F.col(vector)))
        .select(F.col(key).alias("_key"), scaled_integers(F.col(vector), factor).alias("x"))
        .filter(F.forall("x", lambda c: F.abs(c) <= RANGE))
        .withColumn("_dim", F.size("x")),
        "whitening-rows",
    )
    kind = rows.schema["_key"].dataType.simpleString()
    schema = (
        f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
    out = spark.createDataFrame([], schema)
    for (dim,) in rows.filter("_dim > 0").select("_dim").distinct().orderBy("_dim").collect():
        of_length = rows.filter(F.col("_dim") == dim)
        fit = fit_whitening(written(of_length.select("x").distinct(), "whitening-fit"), dim, components)
        if len(fit.values):
            out = out.unionByName(_coordinates(of_length, fit, key, schema))
    return out


def _coordinates(rows: DataFrame, fit: Fitted, key: str, schema: str) -> DataFrame:
    mean, scale = fit.sums / fit.n, fit.vectors / np.sqrt(fit.values)
    dim, k = scale.shape

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, dim)
            rows_in = len(x)
            each = np.repeat(np.arange(rows_in), k)
            columns = [
                batch.column("_key").take(pa.array(each)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows_in)),
                pa.array(np.full(rows_in * k, fit.n)),
                pa.array(deviations(x, fit.n, fit.sums), pa.int64()).take(pa.array(each)),
                pa.array(((x - mean) @ scale).ravel()),
                pa.array(np.tile(fit.explained, rows_in)),
                pa.array(np.full(rows_in * k, fit.identity_error)),
            ]
            names = [key, "component", "n", "deviation", "whitened", "explained", "identity_error"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.select("_key", "x").mapInArrow(project, schema)
