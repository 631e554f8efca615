"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Method. The rows are centred by their exact integer sums before anything is multiplied, so a large common offset costs no digits. From a random unit vector v
the bidiagonalisation alternates products Xv and X'u of the centred table X: X V = U B with B upper bidiagonal. Each new u is made orthogonal to all earlier ones
and each new v as well (full reorthogonalisation). A left vector has a component for every row and is never stored: it is X c for a short vector c that the
driver keeps, so a task has the u's of its rows by one small product. One pass over the table gives X'(Xv), U'(Xv) and |Xv|^2 together; where most of Xv cancels in the
reorthogonalisation, the rest is measured by a second pass. The singular values of the small B are the components' deviations, its right vectors, turned by V, the components.
The iteration ends when all wanted triplets have converged and no direction that is left can hold more than the least of them (what is left of the sum of squares bounds it),
or when all dimensions are used up; equal values and rank deficiency therefore lose nothing: after an exhausted subspace it goes on from a fresh vector.

Scale. Each step is one scan of a compact table of integers with a sum of d + k + 1 numbers from each task, added up by a shuffle of those numbers. The driver holds
matrices of d x d at most. A pass depends on the table and on the driver's small vectors alone, so a lost executor costs its tasks of one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialise, small_batches

#: Scaled components are cut to this size, so that a long holds them after the offset and sums stay exact.
LARGEST = 2.0**53
#: Share of the largest deviation below which a component counts as none.
NOTHING = 1e-10


def integer_rows(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0, offset: int = 1_000_000) -> DataFrame:
    """vec_id and x = floor(scale * component) + offset of each row whose vector is given and has only finite components; null ids stay."""
    v = F.col(vector_col)
    good = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    cut = lambda c: F.least(F.greatest(F.lit(scale) * c.cast("double"), F.lit(-LARGEST)), F.lit(LARGEST))
    return vectors.where(good).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda c: F.floor(cut(c)).cast("long") + F.lit(offset)).alias("x"))


def _matrix(column: pa.Array, dim: int, fill: int) -> np.ndarray:
    """Rows of longs; shorter ones are filled up."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.full((len(sizes), dim), fill, np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Centred:
    """The table of integer rows with its exact means: n rows, dim columns, mean = whole + part."""

    def __init__(self, rows: DataFrame, fill: int):
        shape = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("dim")).first()
        self.rows, self.fill, self.n, self.dim = rows, fill, shape.n, shape.dim or 0
        if self.n and self.dim:
            # a batch is a matrix: a million numbers at a time
            small_batches(rows.sparkSession, max(1, min(10_000, 1_000_000 // self.dim)))
            self.sums = self._whole_sums()
            self.whole = np.array([s // self.n for s in self.sums], np.int64)
            self.rest = np.array([s % self.n for s in self.sums], np.int64)
            self.part = self.rest / self.n

    def _whole_sums(self) -> list[int]:
        dim, fill = self.dim, self.fill

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = [0] * dim
            for batch in batches:
                x = _matrix(batch.column(0), dim, fill)
                # in two halves, as a sum of many longs is none
                high, low = (x >> 32).sum(0).tolist(), (x & 0xFFFFFFFF).sum(0).tolist()
                total = [t + (h << 32) + v for t, h, v in zip(total, high, low, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([t >> 32 for t in total]), pa.array([t & 0xFFFFFFFF for t in total])], names=["at", "high", "low"])

        found = self.rows.select("x").mapInArrow(add, "at int, high long, low long").groupBy("at").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
        out = [0] * dim
        for r in found:
            out[r["at"]] = (r.high << 32) + r.low
        return out

    def blocks(self) -> Callable[[pa.Array], np.ndarray]:
        """What a task makes centred rows of doubles with: each is x - mean, the whole part taken off as integers."""
        dim, fill, whole, part = self.dim, self.fill, self.whole, self.part
        return lambda column: (_matrix(column, dim, fill) - whole).astype(np.float64) - part

    def total(self, size: int, measure: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """Sum of measure(centred rows), `size` numbers, over the table. Each task adds its own, then they are added up by number."""
        centred = self.blocks()

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for batch in batches:
                total += measure(centred(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["at", "value"])

        out = np.zeros(size)
        for r in self.rows.select("x").mapInArrow(add, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
            out[r["at"]] = r.value
        return out


def _product(table: Centred) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, float]]:
    """X'(Xv), U'(Xv) and |Xv|^2 for a vector v and left vectors U = X c, from one pass."""

    def product(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        def measure(x: np.ndarray) -> np.ndarray:
            p = x @ v
            return np.concatenate([x.T @ p, (x @ c).T @ p, [p @ p]])

        d, k = c.shape
        out = table.total(d + k + 1, measure)
        return out[:d], out[d:-1], float(out[-1])

    return product


def bidiagonalise(product: Callable, dim: int, squares: float, wanted: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` largest singular values and right vectors (as columns) of X; squares: the sum of the squares of X."""
    rng, eps = np.random.default_rng(seed), np.finfo(float).eps
    wanted = min(wanted, dim)
    right, short, back = np.empty((dim, 0)), np.empty((dim, 0)), np.empty((dim, 0))  # v's; c's of the left vectors u = X c; X'u
    alphas, betas, held = [], [], 0.0
    floor = 100 * eps * np.sqrt(squares)

    def apart(r: np.ndarray) -> np.ndarray:
        for _ in range(2):
            r = r - right @ (right.T @ r)
        return r

    v = rng.standard_normal(dim)
    v /= np.linalg.norm(v)
    while True:
        xtp, utp, pp = product(v, short)
        held += pp
        c, t, left = v - short @ utp, xtp - back @ utp, pp - utp @ utp
        if short.shape[1] and left < 0.01 * pp:
            xtp, utp, pp = product(c, short)
            c, t, left = c - short @ utp, xtp - back @ utp, pp - utp @ utp
        alpha = np.sqrt(max(left, 0.0))
        if alpha <= floor:  # Xv lies in the span of the earlier ones
            alpha, c, t = 0.0, np.zeros(dim), np.zeros(dim)
        else:
            c, t = c / alpha, t / alpha
        right, short, back = np.column_stack([right, v]), np.column_stack([short, c]), np.column_stack([back, t])
        alphas.append(alpha)
        r = apart(t - alpha * v)
        beta = float(np.linalg.norm(r))
        small = np.diag(alphas) + np.diag(betas, 1)
        p, s, qt = np.linalg.svd(small)
        k = len(alphas)
        if k == dim:
            break
        if k >= wanted and (beta * np.abs(p[-1, :wanted])).max() <= 10 * eps * s[0] and squares - held + 100 * eps * squares < s[wanted - 1] ** 2:
            break
        if beta <= floor:
            beta, r = 0.0, apart(rng.standard_normal(dim))
            r /= np.linalg.norm(r)
            r = apart(r)
        v = r / np.linalg.norm(r)
        betas.append(beta)
    return s[:wanted], (right @ qt.T)[:, :wanted]


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32, scale: float = 64.0, offset: int = 1_000_000, seed: int = 0) -> DataFrame:
    """vec_id, n, deviation, whitened, explained, identity_error of every usable row.

    x = floor(scale * component) + offset. n: usable rows. deviation: sum over the dimensions of (n*x - S)^2, S the sum of x over all rows, exact, decimal(38,0). whitened: the centred row on
    each component over its standard deviation. explained: the share of each component in the trace of the covariance. identity_error: largest absolute entry of
    whitened's covariance less the identity. Components go by falling deviation; each one's sign is free, and the same for all rows.

    Rows whose vector is null or has a null or non-finite component take no part; rows that repeat and rows without id do. Shorter vectors, empty ones too, count as
    filled up with zeros. Scaled components beyond 2**53 are cut to it. Components without any deviation (below 1e-10 of the largest) are left out, so rows that are all equal, or
    a single one, have none; an empty table gives no rows. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    schema = "vec_id long, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
    table = Centred(materialise(integer_rows(vectors, id_col=id_col, vector_col=vector_col, scale=scale, offset=offset), "integers"), offset)
    if not table.n or not table.dim:
        return spark.createDataFrame([], schema)
    squares = float(table.total(1, lambda x: np.array([(x * x).sum()]))[0])
    if squares > 0:
        s, v = bidiagonalise(_product(table), table.dim, squares, components, seed)
        s, v = s[s > NOTHING * s[0]], v[:, s > NOTHING * s[0]]
    else:
        s, v = np.empty(0), np.empty((table.dim, 0))
    k = len(s)
    weights = v / (s / np.sqrt(table.n)) if k else v

    def second(x: np.ndarray) -> np.ndarray:
        w = x @ weights
        return np.concatenate([w.sum(0), (w.T @ w).ravel()])

    error = 0.0
    if k:
        moments = table.total(k + k * k, second) / table.n
        error = float(np.abs(moments[k:].reshape(k, k) - np.outer(moments[:k], moments[:k]) - np.eye(k)).max())
    share = (s * s / squares).tolist() if k else []
    dim, fill, n, whole, rest, centred = table.dim, table.fill, table.n, table.whole, table.rest, table.blocks()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = _matrix(batch.column(1), dim, fill) - whole
            if n * (int(np.abs(y).max(initial=0)) + 1) * dim**0.5 < 2**31:  # squares and their sum are longs
                y = y * n - rest
                deviation = pa.array((y * y).sum(1)).cast(pa.decimal128(38, 0))
            else:
                y = y.astype(object) * n - rest.astype(object)
                deviation = pa.array([int(d) if d < 10**38 else None for d in (y * y).sum(1)], pa.decimal128(38, 0))
            w = centred(batch.column(1)) @ weights
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * k), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), deviation, lists], names=["vec_id", "deviation", "whitened"])

    out = table.rows.mapInArrow(project, "vec_id long, deviation decimal(38,0), whitened array<double>")
    return out.select("vec_id", F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.array(*map(F.lit, share)).cast("array<double>").alias("explained"), F.lit(error).alias("identity_error"))


def by_component(whitened: DataFrame) -> DataFrame:
    """One row for each row and component, numbered from 1; explained and whitened are those of the component."""
    pairs = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "pair")
    return whitened.select("vec_id", "n", "deviation", "identity_error", pairs).select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("pair.whitened").alias("whitened"), F.col("pair.explained").alias("explained"), "identity_error")
