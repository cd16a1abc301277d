"""Whitening of embeddings by a block Lanczos method that never forms the covariance.

The distinct vectors are written once; each step is one pass over them, in which every task adds up
Xᵀ(Xv) for the centred rows it has and a block of vectors v, and Spark sums these by dimension. The
driver holds the basis: dimensions times basis vectors, whatever the number of rows.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import _buffers, _scratch

#: Vectors of a block, beyond the wanted components: near-equal eigenvalues converge together.
BLOCK = 8
#: A component is done once its residual is this share of the largest eigenvalue.
TOLERANCE = 1e-13
#: Columns shorter than this share of the largest have nothing new (breakdown).
DEPENDENT = 1e-12
SCALE = 256


def usable(vector: str) -> Column:
    """Whether a vector is there and has finite entries only."""
    fine = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    return F.coalesce(fine, F.lit(False))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of a list column as an array of d columns."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def summed(fit: DataFrame, d: int, width: int, each: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray:
    """The sum over all rows of each(x): for a batch x of rows an array of `width` columns. One row
    for each task and line of that array is shuffled, and what the driver gets has its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = each(matrix(batch.column(0), d))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(list(total))], names=["i", "y"])

    parts = fit.select("x").mapInArrow(_buffers.tidy(run), f"i int, y array<{kind}>")
    rows = parts.groupBy("i").agg(*(F.sum(F.get("y", F.lit(k))).alias(f"y{k}") for k in range(width))).orderBy("i").collect()
    return np.array([list(r)[1:] for r in rows], np.int64 if kind == "bigint" else np.float64).reshape(-1, width)


def orthonormal(new: np.ndarray, basis: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, bool]:
    """An orthonormal block orthogonal to basis that spans `new`, and whether columns of it broke down;
    random ones take their place. No more columns than there are dimensions left."""
    d, m = basis.shape
    scale, out, broke = max(np.linalg.norm(new, axis=0).max(initial=0.0), 1e-300), [], False
    for k in range(min(new.shape[1], d - m)):
        v, least = new[:, k], DEPENDENT * scale
        while True:
            done = np.column_stack([basis, *out])
            for _ in range(2):  # once more, for what rounding left
                v = v - done @ (done.T @ v)
            if (length := np.linalg.norm(v)) > least:
                break
            broke, v = True, rng.standard_normal(d)
            least = 1e-8
        out.append(v / length)
    return np.column_stack(out) if out else np.zeros((d, 0)), broke


def leading(apply: Callable[[np.ndarray], np.ndarray], d: int, wanted: int, block: int = BLOCK, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns) of the symmetric operator, the largest first.

    Every new block is orthogonalised against the whole basis. When the space is exhausted before the
    dimensions are, random vectors restart it once before the result counts; at d vectors it is exact."""
    rng = np.random.default_rng(seed)
    basis = image = np.zeros((d, 0))
    new, fresh = orthonormal(rng.standard_normal((d, min(block, d))), basis, rng)[0], False
    while True:
        applied = apply(new)
        basis, image = np.column_stack([basis, new]), np.column_stack([image, applied])
        small = basis.T @ image
        values, inner = np.linalg.eigh((small + small.T) / 2)
        values, inner = values[::-1][:wanted], inner[:, ::-1][:, :wanted]
        vectors = basis @ inner
        residuals = np.linalg.norm(image @ inner - vectors * values, axis=0)
        close = len(values) == min(wanted, d) and (residuals <= TOLERANCE * max(values[0], 0)).all()
        if basis.shape[1] == d:
            break
        new, broke = orthonormal(applied, basis, rng)
        if close and (fresh or not broke):
            break
        fresh = broke
    return values, vectors / np.linalg.norm(vectors, axis=0)


def whiten(rows: DataFrame, components: int = 4, scale: int = SCALE, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id_col, component, n, deviation, whitened, explained, identity_error for each row with a usable
    vector and each component from 1.

    A vector that is null or has an entry that is null or not finite gives no row. Entries become
    floor(scale * entry); the covariance is over the distinct vectors, n in number. Components without
    variance (fewer distinct vectors than components, equal entries) can't be whitened and give no rows,
    so one distinct vector, or none, gives an empty result. Vectors shorter than the longest end in
    zeros. A deviation beyond 64 bits is null. Repeated rows and null ids each give their rows; other
    columns are ignored."""
    _scratch.small_batches(rows)
    names = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    schema = f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    held = rows.where(usable(vector_col)).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    d = held.agg(F.max(F.size("v"))).first()[0]
    if not d:
        return rows.sparkSession.createDataFrame([], schema)
    x = F.transform("v", lambda c: F.floor(c.cast("double") * scale).cast("long"))
    used = held.select("id", F.concat(x, F.array_repeat(F.lit(0).cast("long"), d - F.size("v"))).alias("x"))
    fit = _scratch.written(used.select("x").distinct(), "whitening-fit")
    n = fit.count()
    sums = summed(fit, d, 1, lambda v: v.sum(axis=0, dtype=np.int64)[:, None], "bigint")[:, 0]
    mean = sums / n

    def spread(v: np.ndarray) -> np.ndarray:
        return (v.astype(np.float64) * n - sums) ** 2

    trace = summed(fit, d, 1, lambda v: spread(v).sum(keepdims=True).reshape(1, 1))[0, 0] / n**3
    if trace <= 0:
        return rows.sparkSession.createDataFrame([], schema)

    def passed(v: np.ndarray) -> np.ndarray:
        def each(batch: np.ndarray) -> np.ndarray:
            centred = batch - mean
            return centred.T @ (centred @ v)

        return summed(fit, d, v.shape[1], each) / n

    values, vectors = leading(passed, d, components, block)
    real = values > d * np.finfo(float).eps * max(values[0], 0)
    values, to = values[real], vectors[:, real] / np.sqrt(values[real])
    k = len(values)

    def moments(batch: np.ndarray) -> np.ndarray:
        w = (batch - mean) @ to
        return np.vstack([w.T @ w, w.sum(axis=0)])

    total = summed(fit, d, k, moments) / n
    identity_error = float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())
    shares = values / trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column(1), d)
            fits = spread(v).sum(axis=1) < 9.2e18
            with np.errstate(over="ignore"):
                exact = ((v * np.int64(n) - sums) ** 2).sum(axis=1)
            m = len(v)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)),
                    pa.array(np.repeat(exact, k), mask=np.repeat(~fits, k)), pa.array(((v - mean) @ to).ravel()), pa.array(np.tile(shares, m)), pa.array(np.full(m * k, identity_error)),
                ],
                names=names,
            )

    return used.mapInArrow(_buffers.tidy(run), schema)
