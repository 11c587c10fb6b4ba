"""Whitening of embeddings by their principal components, found without forming the covariance matrix."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, packed

#: Rows that are multiplied at once.
BLOCK = 4096
#: Passes after which components that have not converged are an error.
MOST_PASSES = 300


class Components(NamedTuple):
    """n distinct vectors with sums by dimension; unit components as columns, their eigenvalues, the trace."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    passes: int


def whole(vector: Column) -> Column:
    """True for vectors with at least one entry, all of them finite numbers."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf)), F.lit(False))


def gridded(vector: Column, steps: int, offset: int) -> Column:
    """floor(steps * c) + offset of each entry, as long.  Beyond the range of a long this is an error."""
    return F.transform(vector, lambda c: F.floor(F.lit(float(steps)) * c.cast("double")).cast("long") + F.lit(offset))


def summed(fit: DataFrame, part: Callable[[np.ndarray], np.ndarray], like: np.ndarray) -> np.ndarray:
    """The sum of part(block) over all blocks of rows of fit; each is an array like `like`.

    A task adds up its own blocks, then about the root of the number of tasks are added up by each of some further tasks,
    and one adds the rest: the driver gets a single array.
    """
    shape, kind = like.shape, like.dtype
    groups = math.isqrt(fit.rdd.getNumPartitions()) + 1

    def blocks(batches):
        total = np.zeros(shape, kind)
        for batch in batches:
            column = batch.column(0)
            if len(column):
                x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
                for a in range(0, len(x), BLOCK):
                    total += part(x[a : a + BLOCK])
        yield pa.RecordBatch.from_pydict({"g": pa.array([TaskContext.get().partitionId() % groups], pa.int32()), "m": pa.array([total.tobytes()], pa.binary())})

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(shape, kind)
        for m in rows["m"]:
            total += np.frombuffer(m, kind).reshape(shape)
        return pd.DataFrame({"g": [0], "m": [total.tobytes()]})

    out = fit.mapInArrow(blocks, "g int, m binary")
    for _ in range(2):
        out = out.groupBy("g").applyInPandas(added, "g int, m binary")
    row = out.first()
    return np.frombuffer(bytes(row["m"]), kind).reshape(shape) if row else np.zeros(shape, kind)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n; the subtraction is exact."""
    return (x * n - sums) / n


def components(fit: DataFrame, n: int, d: int, k: int, seed: int = 1) -> Components:
    """The k leading components of the n rows of fit, one column of d longs.

    Block subspace iteration: a pass over the rows gives V Q for an orthonormal block Q, V the covariance, as the sum of
    X'(X Q) over blocks of centred rows.  The eigenvectors of Q'VQ turn Q to Ritz vectors, with their residuals from the
    same pass.  The block has some columns more than k.  A spectrum so flat that the ratio of the last Ritz value of the
    block to the k-th promises slow progress gets a block twice as wide, all d dimensions at most.  It ends when each
    residual is below 1e-10 of the distance to the next eigenvalue, or at the level of rounding.  Components without
    variance are left out.
    """
    sums = summed(fit, lambda x: x.sum(axis=0), np.zeros(d, np.int64))
    rng = np.random.default_rng(seed)
    k = min(k, d)
    q = np.linalg.qr(rng.standard_normal((d, min(d, k + 8))))[0]
    for passes in range(1, MOST_PASSES + 1):
        b = q.shape[1]

        def part(x: np.ndarray, q: np.ndarray = q) -> np.ndarray:
            c = centred(x, n, sums)
            return np.vstack([c.T @ (c @ q), np.full((1, q.shape[1]), np.square(c).sum())])

        got = summed(fit, part, np.zeros((d + 1, b))) / n
        y, trace = got[:d], float(got[d, 0])
        small = q.T @ y
        theta, w = np.linalg.eigh((small + small.T) / 2)
        theta, w = theta[::-1], w[:, ::-1]
        u, vu = q @ w, y @ w
        rank = int((theta[:k] > 1e-12 * max(trace, 1e-300)).sum())
        residual = np.linalg.norm(vu - u * theta, axis=0)[:rank]
        gaps = np.abs(np.diff(theta))
        near = np.minimum(np.append(np.inf, gaps)[:rank], np.append(gaps, np.inf)[:rank])
        floor = 1e-12 * max(float(theta[0]), 0.0)
        if b == d and (residual <= floor).all() or b < d and (residual <= np.maximum(1e-10 * near, 1e-3 * floor)).all():
            signs = np.sign(u[np.abs(u).argmax(axis=0), np.arange(b)])
            return Components(n, sums, (u * signs)[:, :rank], theta[:rank], trace, passes)
        ratio = theta[-1] / theta[k - 1] if theta[k - 1] > 0 else 0.0
        if b < d and ratio > 0.1:  # ten rounds or more for ten digits
            q = np.linalg.qr(np.hstack([vu, rng.standard_normal((d, min(b, d - b)))]))[0]
        else:
            q = np.linalg.qr(vu)[0]
    raise RuntimeError(f"components have not converged after {MOST_PASSES} passes")


def whiten(vectors: DataFrame, column: str = "embedding", k: int = 16, steps: int = 64, offset: int = 1_000_000) -> DataFrame:
    """A row for each vector and component up to k, with all columns of vectors and with component, n, deviation,
    whitened, explained and identity_error.

    Entries are put on a grid of 1/steps (see gridded).  The components are those of the distinct gridded vectors, so a
    vector that a third of the rows repeat counts once.  Their list is written to the shared folder, as every pass reads
    it.  whitened has mean 0 and variance 1 over that list; identity_error is how far its covariance is from the
    identity, measured in a pass of its own.  deviation is the sum of squares of n * x - sums, exact; where it leaves the
    range of a long, an error.

    Null and empty vectors and those with a null or non-finite entry are left out.  Of vectors of several lengths only
    those of the most frequent length among the distinct ones stay (ties: the longest).  Repeated rows each get their own.
    Long vectors are used whole.  Components without variance are left out: an empty table, one vector or equal vectors
    give no rows.  Columns of vectors named like new ones are replaced.
    """
    new = ("component", "n", "deviation", "whitened", "explained", "identity_error")
    rows = packed(vectors, new).select("_row", F.col("_row")[column].alias("_v"))
    rows = rows.where(whole(F.col("_v"))).select("_row", gridded(F.col("_v"), steps, offset).alias("_x"))
    listed = cut(rows.select("_x").distinct())
    sizes = listed.groupBy(F.size("_x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    n, d = (sizes["n"], sizes["d"]) if sizes else (0, 0)
    fit = listed.where(F.size("_x") == d)
    found = components(fit, n, d, k) if n else Components(0, np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0), 0.0, 0)
    turn = found.vectors / np.sqrt(found.values)
    sums, r = found.sums, len(found.values)

    def moments(x: np.ndarray) -> np.ndarray:
        z = centred(x, n, sums) @ turn
        return np.vstack([z.T @ z, z.sum(axis=0)])

    error = 0.0
    if r:
        m = summed(fit, moments, np.zeros((r + 1, r))) / n
        error = float(np.abs(m[:r] - np.outer(m[r], m[r]) - np.eye(r)).max())
    drop(listed)

    @F.pandas_udf("deviation long, whitened array<double>")
    def project(x: pd.Series) -> pd.DataFrame:
        if not len(x):
            return pd.DataFrame({"deviation": pd.Series(dtype="int64"), "whitened": pd.Series(dtype=object)})
        apart = np.vstack(x.to_numpy()) * n - sums
        if (np.square(apart.astype(np.float64)).sum(axis=1) > 9.2e18).any():
            raise OverflowError("a deviation leaves the range of a long")
        return pd.DataFrame({"deviation": np.square(apart).sum(axis=1), "whitened": list((apart / n) @ turn)})

    each = rows.where(F.size("_x") == d).select("_row", project("_x").alias("_p"))
    each = each.select("_row", F.col("_p.deviation").alias("_d"), F.posexplode("_p.whitened").alias("_i", "_w"))
    share = F.array(*[F.lit(float(e / found.trace)) for e in found.values]) if r else F.array(F.lit(0.0))
    kept = [F.col("_row")[c].alias(c) for c in vectors.columns if c not in new]
    made = [(F.col("_i") + 1).alias("component"), F.lit(n).cast("long").alias("n"), F.col("_d").alias("deviation"), F.col("_w").alias("whitened"), F.get(share, F.col("_i")).alias("explained"), F.lit(error).alias("identity_error")]
    return each.select(*kept, *made)
