"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation of the centred rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Entries of this size or more are treated as not finite: beyond it, a double has no fractions of 1 / SCALE.
LARGEST = float(1 << 46)
#: Rows that are multiplied at once in a task.
ROWS = 4096
#: A direction is null when its part of the rows is this much smaller than the largest.
NULL = 1e-11


@dataclass(frozen=True)
class Centre:
    """Rows of the fit list and the exact sums of each dimension; the mean is whole + part / n."""

    n: int
    sums: tuple[int, ...]

    @property
    def whole(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def part(self) -> np.ndarray:
        return np.array([s % self.n for s in self.sums], np.int64)

    def rows(self, x: np.ndarray) -> np.ndarray:
        """x - S/n: the difference of whole numbers is exact, and only what is left of the mean is rounded."""
        return (x - self.whole).astype(np.float64) - self.part / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums over dimensions of (n*x - S)^2; None where a long cannot hold one."""
        d = x - self.whole
        most = self.n * (int(np.abs(d).max(initial=0)) + 1)
        if most * most * max(1, x.shape[1]) < 1 << 63:
            return ((self.n * d - self.part) ** 2).sum(axis=1).tolist()
        parts = [int(p) for p in self.part]
        exact = [sum((self.n * int(c) - p) ** 2 for c, p in zip(row, parts, strict=True)) for row in d]
        return [v if v < 1 << 63 else None for v in exact]


@dataclass(frozen=True)
class Whitening:
    """centre: of the fit list. axes: unit eigenvectors in columns. variances, explained: by component. identity_error: of the fit."""

    centre: Centre
    axes: np.ndarray
    variances: np.ndarray
    explained: np.ndarray
    identity_error: float


def quantised(embeddings: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, x) of the rows whose vector has only finite entries, x as whole numbers.

    Vectors of another length than the commonest one (the longest, if several are) go too.
    """
    entry = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < LARGEST)
    rows = embeddings.select(F.col(key), F.col(vector).alias("_v")).where(F.col("_v").isNotNull() & F.coalesce(F.forall("_v", entry), F.lit(False)))
    common = rows.groupBy(F.size("_v").alias("d")).count().agg(F.max(F.struct("count", "d")).alias("m")).select("m.d").first()
    d = common["d"] if common and common["d"] is not None else 0
    whole = F.transform("_v", lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT)
    return rows.where((F.size("_v") == d) & (F.size("_v") > 0)).select(F.col(key), whole.alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield _matrix(batch.column("x").slice(at, ROWS))


def _total(fit: DataFrame, measure: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> list:
    """Sums over all rows of measure(block), a vector: each task adds up its blocks, and Spark adds up by position."""
    number = np.int64 if kind == "long" else np.float64

    def partial(batches):
        total = None
        for block in _blocks(batches):
            out = measure(block)
            total = out if total is None else total + out
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total.astype(number))], ["at", "value"])

    sums = fit.mapInArrow(partial, f"at int, value {kind}").groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)") if kind == "long" else F.col("value")).alias("value"))
    return [r["value"] for r in sorted(sums.collect(), key=lambda r: r["at"])]


def centre_of(fit: DataFrame) -> Centre | None:
    """Rows and exact sums; None without rows. Two parts of 2^20 keep a task's sums within a long."""

    def halves(x: np.ndarray) -> np.ndarray:
        return np.concatenate([[len(x)], (x >> 20).sum(axis=0), (x & ((1 << 20) - 1)).sum(axis=0)])

    found = [int(v) for v in _total(fit, halves, "long")]
    d = (len(found) - 1) // 2
    return Centre(found[0], tuple(found[1 + i] * (1 << 20) + found[1 + d + i] for i in range(d))) if found else None


def bidiagonalise(fit: DataFrame, centre: Centre, steps: int | None = None, seed: int = 11) -> tuple[np.ndarray, np.ndarray, float]:
    """(V, B, squared norm) with X V = U B for the centred rows X, V orthonormal and B upper bidiagonal.

    A step is one job over the rows. It takes w = X v less its part along the last u, and returns Xᵀw, |w|² and the
    remains of w along every earlier u, which are then taken off (full reorthogonalisation; the v are few numbers
    and are made orthogonal twice on the driver). The vectors u have an entry for each row and are never stored:
    U = X P for a small matrix P, so a task computes its part of them from its rows, and a lost executor loses
    nothing. Where a direction is used up, a random one orthogonal to all before takes its place, so that equal
    eigenvalues keep all their vectors. All d steps run unless `steps` says less: stopping when the largest values
    stand still could miss a copy of an equal value. What stays on the driver is d x steps numbers.
    """
    d = len(centre.sums)
    steps = min(d, steps or d)
    draw = np.random.default_rng(seed)
    v_all, p_all, g_all = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))
    b = np.zeros((steps, steps))
    norm = beta = 0.0
    largest = 0.0

    def fresh() -> np.ndarray:
        return orthogonal(draw.standard_normal(d))

    def orthogonal(z: np.ndarray) -> np.ndarray:
        for _ in range(2):
            z = z - v_all @ (v_all.T @ z)
        return z

    v = fresh()
    v /= np.linalg.norm(v)
    for j in range(steps):
        along = np.zeros(j)
        if j:
            along[-1] = beta

        def step(x: np.ndarray, v=v, p=p_all, along=along) -> np.ndarray:
            a = centre.rows(x)
            u = a @ p
            w = a @ v - u @ along
            return np.concatenate([u.T @ w, a.T @ w, [w @ w, (a * a).sum()]])

        told = np.array(_total(fit, step))
        rest, g, square, norm = told[:j], told[j : j + d], told[j + d], told[-1]
        v_all = np.column_stack([v_all, v])
        alpha = float(np.sqrt(max(0.0, square - rest @ rest)))
        largest = max(largest, alpha, beta)
        if alpha > NULL * max(largest, np.sqrt(norm)):
            p = (v - p_all @ (along + rest)) / alpha
            g = (g - g_all @ rest) / alpha
        else:
            alpha, p, g = 0.0, np.zeros(d), np.zeros(d)
        p_all, g_all = np.column_stack([p_all, p]), np.column_stack([g_all, g])
        b[j, j] = alpha
        if j:
            b[j - 1, j] = beta
        z = orthogonal(g - alpha * v)
        beta = float(np.linalg.norm(z))
        if beta <= NULL * max(largest, np.sqrt(norm)) and j + 1 < steps:
            beta, z = 0.0, fresh()
        v = z / max(np.linalg.norm(z), 1e-300)
    return v_all, b, float(norm)


def fit_whitening(fit: DataFrame, components: int = 16, steps: int | None = None) -> Whitening | None:
    """Components of the rows x of fit, each a row of the fit list; None without rows. Null directions have no component."""
    centre = centre_of(fit)
    if centre is None:
        return None
    v, b, norm = bidiagonalise(fit, centre, steps)
    _, sigma, turned = np.linalg.svd(b)
    keep = [i for i in range(min(components, len(sigma))) if sigma[i] > NULL * 10 * max(sigma[0], 1e-300)]
    axes = (v @ turned.T)[:, keep]
    if keep:
        axes = axes / np.linalg.norm(axes, axis=0)
        axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(len(keep))])
    variances = sigma[keep] ** 2 / centre.n
    scaled = axes / np.sqrt(variances)
    k = len(keep)
    error = 0.0
    if k:

        def moments(x: np.ndarray) -> np.ndarray:
            z = centre.rows(x) @ scaled
            return np.concatenate([z.sum(axis=0), (z.T @ z).ravel()])

        told = np.array(_total(fit, moments)) / centre.n
        error = float(np.abs(told[k:].reshape(k, k) - np.outer(told[:k], told[:k]) - np.eye(k)).max())
    return Whitening(centre, axes, variances, variances / (norm / centre.n) if k else variances, error)


def whiten(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 16, steps: int | None = None) -> DataFrame:
    """Key, component (from 1), n, deviation, whitened, explained and identity_error of each row with a finite vector.

    The fit list holds each distinct vector once. Rows without a vector, with a null, infinite or NaN entry, with an
    entry of 2^46 or more, or of another length than the commonest go; so do empty vectors. A null key stays; repeated
    rows give repeated results, and equal vectors ones that agree but for rounding. Directions along which all vectors agree have no
    component, so a single vector gives no rows, like an empty table. Other columns are not read, whatever their names.
    """
    rows = quantised(embeddings, key, vector)
    fit = materialize(rows.select("x").distinct(), "fit-list")
    model = fit_whitening(fit, components, steps)
    release(fit)
    kind = embeddings.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not model.axes.shape[1]:
        return embeddings.sparkSession.createDataFrame([], schema)
    k, centre, scaled = model.axes.shape[1], model.centre, model.axes / np.sqrt(model.variances)
    explained, error = model.explained, model.identity_error

    def project(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = _matrix(part.column("x"))
                z = centre.rows(x) @ scaled
                ids = pa.array(np.repeat(np.arange(len(x)), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(ids),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(x) * k, centre.n, np.int64)),
                        pa.array(centre.deviations(x), pa.int64()).take(ids),
                        pa.array(z.ravel()),
                        pa.array(np.tile(explained, len(x))),
                        pa.array(np.full(len(x) * k, error)),
                    ],
                    [key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(project, schema)
