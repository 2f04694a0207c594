"""Whitening of embeddings: a randomised range finder over all centred rows, then Rayleigh-Ritz.

The covariance is never a table: a pass over the fit list multiplies it by a
thin basis, row by row, and gives one small matrix a task; those are added in
two steps, so the driver gets about the square root of the tasks' number of
them.  The basis starts at random, with more columns than components are
wanted, and each further pass is a power step.  After each step the residuals
of the Ritz pairs are looked at; if they are not at rounding level after the
last one, as with a flat spectrum, the basis grows to full dimension and one
more pass gives the exact Rayleigh-Ritz problem.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import isqrt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import finite_vectors, of_common_width, stored

#: Grid of the fit: an entry c becomes floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Columns of the basis beyond the components, and power passes before the basis grows to full dimension.
OVERSAMPLE, PASSES, SEED = 16, 3, 20
#: Residuals, and eigenvalues that count as zero, in units of the largest eigenvalue.
RESIDUAL, ZERO = 1e-13, 1e-12
#: Rows a task holds as numbers at once, in bytes of doubles.
BLOCK_BYTES = 8_000_000


@dataclass(frozen=True)
class Whitening:
    """A fit: ``sums`` exact, components as columns of ``vectors`` by falling ``values``; ``passes`` over the list it took, ``expanded`` whether the basis grew."""

    n: int
    sums: tuple[int, ...]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    identity_error: float
    passes: int = 0
    expanded: bool = False

    @property
    def width(self) -> int:
        return len(self.sums)

    def projection(self) -> np.ndarray:
        """What centred rows are multiplied by; columns of eigenvalues that are zero hold NaN."""
        held = self.values > ZERO * max(self.values.max(initial=0.0), 0.0)
        return self.vectors / np.sqrt(np.where(held, self.values, np.nan))


def lattice(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``id, x``: the kept vectors as integers, those of the commonest width."""
    return of_common_width(finite_vectors(df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("x")), "x", SCALE, OFFSET), "x")


def _blocks(batches, width: int):
    """(batch, rows x width int64) in slices of bounded size."""
    step = max(1, BLOCK_BYTES // (8 * max(width, 1)))
    for whole in batches:
        for at in range(0, whole.num_rows, step):
            batch = whole.slice(at, step)
            yield batch, np.asarray(batch.column("x").flatten(), dtype=np.int64).reshape(batch.num_rows, width)


def _summed(fit: DataFrame, width: int, length: int, work, integers: bool = False) -> np.ndarray:
    """The sum over all blocks of ``work(block)``, an array of ``length`` numbers; in the order of tasks, so that reruns agree."""
    kind = np.int64 if integers else np.float64

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        total = np.zeros(length, dtype=kind)
        for _, block in _blocks(batches, width):
            total += work(block)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["part", "sums"])

    def added(key, parts):
        import pandas as pd

        total = np.zeros(length, dtype=kind)
        for one in parts.sort_values("part")["sums"]:
            total += np.frombuffer(one, dtype=kind)
        return pd.DataFrame({"part": [key[0]], "sums": [total.tobytes()]})

    groups = max(1, isqrt(fit.rdd.getNumPartitions()))
    parts = fit.select("x").mapInArrow(run, "part long, sums binary")
    rows = parts.groupBy((F.col("part") % groups).alias("group")).applyInPandas(added, "part long, sums binary").collect()
    total = np.zeros(length, dtype=object if integers else kind)
    for row in sorted(rows, key=lambda r: r["part"]):
        total = total + np.frombuffer(bytes(row["sums"]), dtype=kind).astype(total.dtype)
    return total


def _centre(n: int, sums) -> tuple[np.ndarray, np.ndarray]:
    """The mean as whole and broken part, so that large offsets cost no digits."""
    return np.array([s // n for s in sums], dtype=np.int64), np.array([(s % n) / n for s in sums])


def fit_whitening(fit: DataFrame, width: int, components: int = 16, oversample: int = OVERSAMPLE, passes: int = PASSES, seed: int = SEED) -> Whitening | None:
    """The leading eigenvectors of the covariance (divisor n) of ``fit``, whose column ``x`` holds integer vectors of ``width``; None for an empty list."""
    counted = _summed(fit, width, width + 1, lambda x: np.append(x.sum(axis=0), len(x)), integers=True)
    n, sums = int(counted[-1]), tuple(int(s) for s in counted[:-1])
    if not n:
        return None
    if not width:
        return Whitening(n, (), 0.0, np.zeros(0), np.zeros((0, 0)), 0.0)
    whole, broken = _centre(n, sums)

    def times(basis: np.ndarray) -> tuple[np.ndarray, float]:
        """The covariance times ``basis``, and its trace: one pass."""

        def work(x):
            a = (x - whole) - broken
            return np.append((a.T @ (a @ basis)).ravel(), np.vdot(a, a))

        made = _summed(fit, width, basis.size + 1, work) / n
        return made[:-1].reshape(basis.shape), float(made[-1])

    def ritz(basis, image):
        inner = basis.T @ image
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        off = np.linalg.norm(image @ turn - (basis @ turn) * values, axis=0)
        return values, basis @ turn, off

    wanted = min(components, width)
    rng = np.random.default_rng(seed)
    basis = np.linalg.qr(rng.standard_normal((width, min(width, wanted + oversample))))[0]
    for done in range(1, passes + 2):
        image, trace = times(basis)
        values, vectors, off = ritz(basis, image)
        exact = basis.shape[1] == width or off[:wanted].max() <= RESIDUAL * max(values[0], 0.0)
        if exact or done > passes:
            break
        basis = np.linalg.qr(image)[0]
    expanded = not exact
    if expanded:
        more = rng.standard_normal((width, width - basis.shape[1]))
        basis = np.linalg.qr(np.hstack([vectors, more]))[0]
        image, trace = times(basis)
        done += 1
        values, vectors, off = ritz(basis, image)
    values, vectors = np.maximum(values[:wanted], 0.0), vectors[:, :wanted]
    # Of the two signs that which makes the largest entry positive.
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(wanted)] < 0, -1.0, 1.0)
    found = Whitening(n, sums, trace, values, vectors, 0.0, done + 1, expanded)
    onto = found.projection()
    held = ~np.isnan(onto).any(axis=0)
    error = 0.0
    if held.any():

        def outer(x):
            p = ((x - whole) - broken) @ onto[:, held]
            return (p.T @ p).ravel()

        error = float(np.abs(_summed(fit, width, int(held.sum()) ** 2, outer) / n - np.eye(int(held.sum())).ravel()).max())
    return Whitening(n, sums, trace, values, vectors, error, done + 2, expanded)


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 16) -> DataFrame:
    """``<id>, component, n, deviation, whitened, explained, identity_error`` for each kept row of ``df`` and each component, at most as many as the vectors are wide.

    Rows whose vector is null or holds a null, NaN or infinite entry go.  Of
    vectors of unlike widths those of the commonest width stay (of ties the
    widest).  Equal vectors count once in the fit, but each row, repeated or
    with a null id, has its own result.  A component whose eigenvalue is zero
    has a null ``whitened`` and is left out of ``identity_error``; a table
    without a kept row, or with vectors of no entries, has no result.  Other
    columns are left out, so none can clash.  Entries beyond 2^40 in size, or a
    ``deviation`` that no long can hold, raise a ValueError.
    """
    spark = df.sparkSession
    rows = stored(lattice(df, id_col, vec_col), "lattice")
    first = rows.select(F.size("x").alias("w")).first()
    ddl = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    plain = rows.select(F.col("id").alias(id_col)).schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {plain}, {ddl}"
    found = fit_whitening(stored(rows.select("x").distinct(), "fit"), first["w"], components) if first else None
    if not found or not found.width:
        return spark.createDataFrame([], schema)
    whole, broken = _centre(found.n, found.sums)
    onto, n, sums, k = found.projection(), found.n, np.array(found.sums, dtype=object), len(found.values)
    explained = np.where(found.trace > 0, found.values / (found.trace or 1.0), 0.0)
    identity_error, width = found.identity_error, found.width
    far = max(abs(int(s)) for s in sums)

    def run(batches):
        import pyarrow as pa

        for batch, x in _blocks(batches, width):
            centred = (x - whole) - broken
            most = float(np.abs(centred).max(initial=0.0)) * n
            if most * most * width >= 2**63 or (float(np.abs(x).max(initial=0)) * n + far) >= 2**63:
                raise ValueError("deviation does not fit a long")
            off = n * x - sums.astype(np.int64)
            deviation = (off * off).sum(axis=1)
            whitened = (centred @ onto).ravel()
            m = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n, dtype=np.int64)),
                    pa.array(np.repeat(deviation, k)),
                    pa.array(whitened, mask=np.isnan(whitened)),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, identity_error)),
                ],
                [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)
