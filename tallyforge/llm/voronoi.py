"""Exact top-k inner-product search as a Voronoi kNN join.

Method. Pivots (a bounded number of data rows) cut the space into cells. Queries are grouped by nearest pivot;
a group keeps its largest distance to the pivot and its lowest threshold, the k-th best score that a query of the group
already has among the pivots themselves. Data rows are assigned to cells as well, and a summary holds each cell's count,
radius and largest norm. From the summaries alone follows which cells a group can close: for q in group i and x in
cell j, q.x <= c_i.p_j + |c_i| r_j + rho_i |x|max. Rows of open cells are tested once more with their own bound
c_i.x + rho_i |x| and are sent only to the groups that need them. There the search is solved locally in blocks.

In many dimensions without clusters the bounds close little; then the search is the plain one, queries against all rows in blocks,
and a row is sent once for every `block_queries` queries.

Scale. What goes to the driver and the executors is a few numbers for each pivot. A group's data and queries are
cut into blocks of bounded size, so no task holds a whole group or a vector that many rows share; each block gives k rows a query at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .scratch import materialise, small_batches

_MOST = (1 << 63) - 1
RESULT = "query_id long, rank int, vec_id long, score long"


def integer_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """vec_id and x = floor(scale * component) of every usable row.

    Rows whose vector is null or has a null or non-finite component take no part, nor do rows without id. Shorter vectors count as if filled up with zeros.
    """
    v = F.col(vector_col)
    good = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & good).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("x"))


def _dense(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = (x**2).sum(1)[:, None] - 2 * x @ pivots.T + (pivots**2).sum(1)
    j = d.argmin(1)
    return j, np.sqrt(((x - pivots[j]) ** 2).sum(1))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products: in doubles where those are exact, else in Python integers."""
    if q.size and x.size and np.abs(q).max() * np.abs(x).max() * q.shape[1] >= 2.0**53:
        whole = lambda a: np.clip(a, -(2.0**62), 2.0**62).astype(np.int64).astype(object)
        return whole(q) @ whole(x).T
    return q @ x.T


def knn_join(vectors: DataFrame, is_query: Column, *, k: int = 10, pivots: int | None = None, block_rows: int = 8_192, block_queries: int = 1_000) -> DataFrame:
    """The k highest inner products of each query row with all other rows: query_id, rank, vec_id, score; ties go to the smaller vec_id.

    vectors: vec_id, x (see integer_vectors). A row is no candidate of a query with the same vec_id. Query rows that repeat get a list each;
    an empty table or query set gives no rows; fewer than k candidates give fewer rows. Components are exact up to 2**53; a score beyond a long is cut to its range.
    """
    small_batches(vectors.sparkSession)
    spark = vectors.sparkSession
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("dim"), F.count(F.when(is_query, 1)).alias("queries")).first()
    if not size.queries:
        return spark.createDataFrame([], RESULT)
    dim = max(1, size.dim)
    wanted = pivots or int(min(256, max(4 * k, np.ceil(np.sqrt(size.n) / 4))))
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "x").limit(wanted).collect()
    ids = np.array([r.vec_id for r in rows])
    centre = _dense(pa.array([r.x for r in rows], pa.list_(pa.int64())), dim)
    norm = np.sqrt((centre**2).sum(1))
    # as few groups as hold the queries: every further group is one more copy of the rows that its bound can't keep out
    n_groups = min(len(centre), -(-size.queries // block_queries))
    sent = spark.sparkContext.broadcast((centre, ids))

    def group_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        c, own = sent.value
        n0 = TaskContext.get().partitionId() << 40
        for batch in batches:
            q = _dense(batch.column(1), dim)
            g, d = _nearest(q, c[:n_groups])
            s = products(q, c).astype(float)
            s[batch.column(0).to_numpy()[:, None] == own[None, :]] = -np.inf
            floor = np.sort(s, axis=1)[:, -k] if s.shape[1] >= k else np.full(len(q), -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n0, n0 + len(q))), batch.column(0), batch.column(1), pa.array(g.astype(np.int32)), pa.array(d), pa.array(floor)], names=["row", "vec_id", "x", "g", "d", "floor"])
            n0 += len(q)

    queries = materialise(vectors.where(is_query).mapInArrow(group_queries, "row long, vec_id long, x array<long>, g int, d double, floor double"), "queries")
    groups = queries.groupBy("g").agg(F.count("*").alias("n"), F.max("d").alias("rho"), F.min("floor").alias("floor")).collect()

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, _ = sent.value
        n, r, m = np.zeros(len(c), np.int64), np.zeros(len(c)), np.zeros(len(c))
        for batch in batches:
            x = _dense(batch.column(1), dim)
            j, d = _nearest(x, c)
            n += np.bincount(j, minlength=len(c))
            np.maximum.at(r, j, d)
            np.maximum.at(m, j, np.sqrt((x**2).sum(1)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(c), dtype=np.int32)), pa.array(n), pa.array(r), pa.array(m)], names=["cell", "n", "r", "m"])

    cells = vectors.mapInArrow(summarise, "cell int, n long, r double, m double").groupBy("cell").agg(F.sum("n").alias("n"), F.max("r").alias("r"), F.max("m").alias("m")).collect()
    slack = 1e-6  # the bounds are in floating point
    open_cells: dict[int, list[int]] = {c.cell: [] for c in cells}
    plan = {}
    for g in groups:
        held = 0
        for c in cells:
            most = float(centre[g.g] @ centre[c.cell]) + norm[g.g] * c.r + g.rho * c.m
            if c.n and most * (1 + slack * np.sign(most)) + slack >= g.floor:
                open_cells[c.cell].append(g.g)
                held += c.n
        plan[g.g] = (max(1, -(-held // block_rows)), max(1, -(-g.n // block_queries)), g.rho, g.floor)
    shared = spark.sparkContext.broadcast((open_cells, plan))

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, _ = sent.value
        opened, how = shared.value
        of_cell = {j: np.array(gs, int) for j, gs in opened.items()}
        for batch in batches:
            x = _dense(batch.column(1), dim)
            vec, (j, _d) = batch.column(0).to_numpy(), _nearest(x, c)
            length = np.sqrt((x**2).sum(1))
            score = x @ c.T
            for g, (blocks, query_blocks, rho, floor) in how.items():
                member = np.isin(j, [cell for cell, gs in of_cell.items() if g in gs])
                most = score[:, g] + rho * length
                take = np.flatnonzero(member & (most + slack * np.abs(most) + slack >= floor))
                if not len(take):
                    continue
                block = (vec[take].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % blocks
                for part in range(query_blocks):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(take), g, np.int32)), pa.array(np.full(len(take), part, np.int32)), pa.array(block.astype(np.int32)), pa.array(np.full(len(take), -1, np.int64)), pa.array(vec[take]), pa.array(batch.column(1).take(pa.array(take)))], names=["g", "part", "block", "row", "vec_id", "x"])

    need = "g int, part int, block int, row long, vec_id long, x array<long>"
    data = vectors.mapInArrow(replicate, need)
    blocks = F.create_map(*[y for g, (b, _, _, _) in plan.items() for y in (F.lit(g), F.lit(int(b)))])
    parts = F.create_map(*[y for g, (_, p, _, _) in plan.items() for y in (F.lit(g), F.lit(int(p)))])
    asked = queries.select("g", F.pmod(F.hash("row"), F.element_at(parts, F.col("g"))).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.element_at(blocks, F.col("g")) - 1)).alias("block"), "row", "vec_id", "x")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        ask = pdf["row"].to_numpy() >= 0
        out: list[tuple] = []
        if ask.any() and not ask.all():
            rows_, own, at = pdf["row"].to_numpy()[ask], pdf["vec_id"].to_numpy()[ask], pdf["vec_id"].to_numpy()[~ask]
            order = np.argsort(at, kind="stable")
            at = at[order]
            x = _dense(pa.array(pdf["x"].to_numpy()[~ask][order], pa.list_(pa.int64())), dim)
            q = _dense(pa.array(pdf["x"].to_numpy()[ask], pa.list_(pa.int64())), dim)
            for lo in range(0, len(q), 256):
                s = products(q[lo : lo + 256], x)
                for i, line in enumerate(s):
                    keep = np.flatnonzero(at != own[lo + i])
                    score = line[keep]
                    if len(keep) > k:
                        least = np.partition(score, len(score) - k)[len(score) - k]
                        keep, score = keep[score >= least], score[score >= least]
                    best = np.argsort(-score, kind="stable")[:k]  # at is sorted, so ties keep to the smaller id
                    out += [(int(rows_[lo + i]), int(own[lo + i]), int(at[keep[b]]), max(-_MOST - 1, min(_MOST, int(score[b])))) for b in best]
        return pd.DataFrame(out, columns=["row", "query_id", "vec_id", "score"]).astype("int64")

    best = asked.unionByName(data).groupBy("g", "part", "block").applyInPandas(solve, "row long, query_id long, vec_id long, score long")
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("row").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast(T.IntegerType()).alias("rank"), "vec_id", "score")
