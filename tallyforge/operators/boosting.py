"""Gradient boosting of regression trees over histograms, many ensembles at once.

Features are cut into bins at quantiles of each fit's own training rows. A tree grows level by level: every task sums gradient and number of its rows by (node, feature,
bin), the sums of all tasks are added, and from the same totals each task takes the same splits: those of largest second-order gain under L1 and L2 penalties. Missing values go to the side that
gains more. With `leaves`, growth is by the best leaf: as a node's split does not depend on other nodes, the level-wise tree is cut back to the splits that
best-first growth would have made. Rows of a tree are drawn by a digest of their key, columns by the seed: the same in every run and partitioning.

Each level of a tree is one pass over blocks of bins, for all fits together: the tasks' sums are added on the executors, and the driver sees histograms, cuts and trees only. Blocks are
numpy arrays in a persisted RDD, as a pass is imperative work on a partition and hundreds of passes follow each other; they come from a table that is written once. Every `chunk` rounds the rows'
margins are moved on by the new trees, so a pass applies few of them. A lost executor's blocks are made again from the table and the trees. A table that is a single block's worth of rows
needs no passes: the task that holds it has the totals and runs the same rounds by itself.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written_once

#: Rows of a block, or so: a table of no more is one task's.
ROWS_A_TASK = 100_000
#: Blocks of a task at most, or so. There are as many tasks as the session runs at once, and more only for what these don't hold: each tells the driver something in every pass.
BLOCKS_A_TASK = 4


@dataclass(frozen=True)
class Boosting:
    """rounds trees of a depth; rows and columns: share of them that each tree sees; least: rows of a leaf at least; leaves: grow by the best leaf up to so many."""

    rounds: int = 300
    depth: int = 3
    rate: float = 0.05
    rows: float = 1.0
    columns: float = 1.0
    l1: float = 0.0
    l2: float = 1.0
    least: int = 1
    leaves: int | None = None
    bins: int = 128
    seed: int = 42


@dataclass(frozen=True)
class Fit:
    """One ensemble: features, label and the rows it learns from (all, without where)."""

    features: tuple[str, ...]
    label: str = "label"
    where: Column | None = None
    how: Boosting = field(default_factory=Boosting)


@dataclass
class Tree:
    """A tree as arrays: node i has the children 2i + 1 (value at most cut, bin at most place) and 2i + 2; feature is -1 at a leaf. value: shrunk leaf value of every node."""

    feature: np.ndarray
    cut: np.ndarray
    place: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Values of the rows of x; NaN is missing."""
        node = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while True:
            f = self.feature[node]
            inner = f >= 0
            if not inner.any():
                return self.value[node]
            v = x[rows, np.maximum(f, 0)]
            left = np.where(np.isnan(v), self.missing_left[node], v <= self.cut[node])
            node = np.where(inner, 2 * node + np.where(left, 1, 2), node)

    def node_of(self, bins: np.ndarray, missing: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins; missing: the bin of each feature that stands for a missing value. A comparison of one column for each inner node, from the top."""
        node = np.zeros(len(bins), np.uint8 if len(self.feature) < 256 else np.int64)
        for i in np.flatnonzero(self.feature >= 0).tolist():
            b = bins[:, self.feature[i]]
            left = b <= int(self.place[i])
            if self.missing_left[i]:
                left |= b == int(missing[self.feature[i]])
            if i == 0:
                node = 2 - left.astype(node.dtype)
            else:
                node = np.where(node == i, 2 * i + 2 - left.astype(node.dtype), node)
        return node


@dataclass
class Trees:
    """A fitted ensemble. base is the mean label, None where no row was there to learn from."""

    features: tuple[str, ...]
    base: float | None
    trees: list[Tree]

    def apply(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), np.nan if self.base is None else self.base)
        for t in self.trees:
            out += t.apply(x)
        return out

    def transform(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """df with the prediction, null where the ensemble has not learnt from any row. Arrow batches, trees broadcast."""
        sent = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def predict(*columns: pd.Series) -> pd.Series:
            return pd.Series(sent.value.apply(np.column_stack([c.to_numpy(np.float64, na_value=np.nan) for c in columns])))

        p = predict(*[_finite(c) for c in self.features])
        return df.withColumn(name, F.when(~F.isnan(p), p))

    def importance(self) -> dict[str, float]:
        """Share of each feature in the total gain."""
        total = np.zeros(len(self.features))
        for t in self.trees:
            inner = t.feature >= 0
            np.add.at(total, t.feature[inner], t.gain[inner])
        return dict(zip(self.features, (total / (total.sum() or 1.0)).tolist(), strict=True))


def _finite(c: str) -> Column:
    """The column as double, null where it is no finite number."""
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def drawn(key: np.ndarray, share: float, seed: int, tree: int) -> np.ndarray:
    """Rows of one tree: those whose mixed key lies below the share."""
    if share >= 1:
        return np.ones(len(key), bool)
    h = key + np.uint64((seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return ((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) < share * 2.0**53


def columns_of(how: Boosting, tree: int, features: int) -> np.ndarray:
    """Features of one tree."""
    if how.columns >= 1:
        return np.arange(features)
    return np.sort(np.random.default_rng([how.seed, tree]).choice(features, max(1, round(how.columns * features)), replace=False))


def _score(g: np.ndarray, h: np.ndarray, how: Boosting) -> np.ndarray:
    t = np.sign(g) * np.maximum(np.abs(g) - how.l1, 0.0)
    return t * t / (h + how.l2 + 1e-300)


def leaf_value(g: float, h: float, how: Boosting) -> float:
    t = np.sign(g) * max(abs(g) - how.l1, 0.0)
    return float(-how.rate * t / (h + how.l2 + 1e-300))


def best_split(g: np.ndarray, h: np.ndarray, how: Boosting) -> tuple[float, int, bool, tuple[float, float, float, float]] | None:
    """gain, cut, whether missing goes left, and (G, H) of both sides, of one feature's histogram (the last bin: missing); None if nothing is gained."""
    total_g, total_h = g.sum(), h.sum()
    before, best = _score(total_g, total_h, how), None
    run_g, run_h = np.cumsum(g[:-2]), np.cumsum(h[:-2])
    for missing_left in (True, False) if h[-1] > 0 else (True,):
        left_g, left_h = (run_g + g[-1], run_h + h[-1]) if missing_left else (run_g, run_h)
        right_g, right_h = total_g - left_g, total_h - left_h
        gain = np.where((left_h >= max(how.least, 1)) & (right_h >= max(how.least, 1)), _score(left_g, left_h, how) + _score(right_g, right_h, how) - before, -np.inf)
        if len(gain) and gain.max() > (best[0] if best else 1e-9 * (abs(before) + 1e-12)):
            c = int(gain.argmax())
            best = float(gain[c]), c, missing_left, (float(left_g[c]), float(left_h[c]), float(right_g[c]), float(right_h[c]))
    return best


class Grower:
    """One tree of one fit, grown on the driver from the sums of all rows."""

    def __init__(self, how: Boosting, cuts: list[np.ndarray], number: int):
        self.how, self.cuts, self.number = how, cuts, number
        self.columns = columns_of(how, number, len(cuts))
        size = 2 ** (how.depth + 1) - 1
        self.tree = Tree(np.full(size, -1, np.int32), np.zeros(size), np.zeros(size, np.int64), np.zeros(size, bool), np.zeros(size), np.zeros(size))
        self.open = [0] if how.depth > 0 and len(cuts) else []

    def size(self) -> int:
        return len(self.open) * sum(len(self.cuts[j]) + 2 for j in self.columns) * 2

    def histograms(self, part: Part) -> np.ndarray:
        """Gradient sums and counts by open node, feature and bin, of one block of rows."""
        used = drawn(part.key, self.how.rows, self.how.seed, self.number)
        slot = np.full(len(self.tree.feature), -1)
        slot[self.open] = np.arange(len(self.open))
        at = slot[self.tree.node_of(part.bins, part.missing)]
        rows = np.flatnonzero((at >= 0) & used)
        at, g = at[rows], (part.margin - part.y)[rows]
        out = []
        for j in self.columns:
            width = len(self.cuts[j]) + 2
            cell, n = at * width + part.bins[rows, j], len(self.open) * width
            out += [np.bincount(cell, g, n), np.bincount(cell, minlength=n).astype(np.float64)]
        return np.concatenate(out)

    def split(self, total: np.ndarray) -> None:
        """Split the open nodes by the totals; their children are open then."""
        best: dict[int, tuple] = {}
        at = 0
        for j in self.columns.tolist():
            width = len(self.cuts[j]) + 2
            n = len(self.open) * width
            g, h = total[at : at + n].reshape(-1, width), total[at + n : at + 2 * n].reshape(-1, width)
            at += 2 * n
            for i, node in enumerate(self.open):
                if node == 0 and j == self.columns[0]:
                    self.tree.value[0] = leaf_value(g[i].sum(), h[i].sum(), self.how)
                found = best_split(g[i], h[i], self.how)
                if found and (node not in best or found[0] > best[node][0][0]):
                    best[node] = found, j
        t, children = self.tree, []
        for node, ((gain, cut, missing_left, sums), j) in best.items():
            t.feature[node], t.cut[node], t.place[node], t.missing_left[node], t.gain[node] = j, self.cuts[j][cut], cut, missing_left, gain
            t.value[2 * node + 1], t.value[2 * node + 2] = leaf_value(*sums[:2], self.how), leaf_value(*sums[2:], self.how)
            children += [2 * node + 1, 2 * node + 2]
        self.open = [c for c in sorted(children) if 2 * c + 2 < len(t.feature)]

    def finish(self) -> Tree:
        """The tree, cut back to `leaves`."""
        t = self.tree
        if self.how.leaves:
            ready, kept = [(-t.gain[0], 0)] if t.feature[0] >= 0 else [], set()
            while ready and len(kept) + 1 < self.how.leaves:
                _, node = heapq.heappop(ready)
                kept.add(node)
                for c in (2 * node + 1, 2 * node + 2):
                    if c < len(t.feature) and t.feature[c] >= 0:
                        heapq.heappush(ready, (-t.gain[c], c))
            for node in np.flatnonzero(t.feature >= 0).tolist():
                if node not in kept:
                    t.feature[node] = -1
        return t


@dataclass
class Part:
    """What a block holds of one fit: bins, labels, keys and margins of its rows."""

    bins: np.ndarray
    missing: np.ndarray
    y: np.ndarray
    key: np.ndarray
    margin: np.ndarray

    @classmethod
    def of(cls, cuts: list[np.ndarray], x: np.ndarray, y: np.ndarray, key: np.ndarray, base: float) -> Part:
        bins = np.empty(x.shape, np.uint8 if max(map(len, cuts), default=0) < 254 else np.uint16, order="F")  # a column after the other, as it is read
        for j, c in enumerate(cuts):
            bins[:, j] = np.where(np.isnan(x[:, j]), len(c) + 1, np.searchsorted(c, x[:, j], "left"))
        return cls(bins, np.array([len(c) + 1 for c in cuts]), y, key, np.full(len(y), base))

    def moved(self, trees: list[Tree]) -> Part:
        """With the margins that follow from some trees more."""
        margin = self.margin.copy()
        for t in trees:
            margin += t.value[t.node_of(self.bins, self.missing)]
        return Part(self.bins, self.missing, self.y, self.key, margin)


Blocks = dict[int, Part]


def moved(block: Blocks, trees: dict[int, list[Tree]]) -> Blocks:
    return {i: p.moved(trees[i]) if trees.get(i) else p for i, p in block.items()}


def measured(block: Blocks, growers: dict[int, Grower]) -> np.ndarray:
    return np.concatenate([g.histograms(block[i]) for i, g in growers.items()])


def grow(growers: dict[int, Grower], total: Callable[[dict[int, Grower]], np.ndarray]) -> dict[int, Tree]:
    """One tree for each fit; total gives the sums over all rows for those that grow on."""
    while growing := {i: g for i, g in growers.items() if g.open}:
        sums, at = total(growing), 0
        for g in growing.values():
            n = g.size()
            g.split(sums[at : at + n])
            at += n
    return {i: g.finish() for i, g in growers.items()}


def quantile_cuts(values: list[float] | None) -> np.ndarray:
    """Cuts from quantiles of a feature: distinct and in order; above the last one lies a bin of its own."""
    return np.unique(np.array(values or [], np.float64))


def fit_all(df: DataFrame, fits: dict[str, Fit], key: list[str], *, chunk: int = 20) -> dict[str, Trees]:
    """All ensembles by name, trained side by side. key: columns that tell rows apart, for drawing them.

    Rows without a finite label, or outside a fit's `where`, are not learnt from. Features that are no finite number are missing. A fit without rows has no trees and no base.
    """
    names = list(fits)
    features = sorted({f for x in fits.values() for f in x.features})
    labels = sorted({x.label for x in fits.values()})
    learns = [F.coalesce(x.where if x.where is not None else F.lit(True), F.lit(False)) & _finite(x.label).isNotNull() for x in fits.values()]
    flat = df.select(F.xxhash64(*key).alias("key"), *[_finite(f).alias(f"f{i}") for i, f in enumerate(features)], *[_finite(y).alias(f"y{i}") for i, y in enumerate(labels)], *[m.alias(f"m{i}") for i, m in enumerate(learns)])
    table = written_once(flat.where(" OR ".join(f"m{i}" for i in range(len(names)))), "boosting")
    wanted = []
    for i, x in enumerate(fits.values()):
        own = lambda c, i=i: F.when(F.col(f"m{i}"), F.col(c))
        at = [k / x.how.bins for k in range(1, x.how.bins)]
        wanted += [F.avg(own(f"y{labels.index(x.label)}")).alias(f"b{i}"), F.array(*[F.percentile_approx(own(f"f{features.index(f)}"), at, 20 * x.how.bins) for f in x.features]).alias(f"c{i}")]
    facts = table.agg(F.count("*").alias("n"), *wanted).first()
    bases = [facts[f"b{i}"] for i in range(len(names))]
    cuts = [[quantile_cuts(v) for v in facts[f"c{i}"]] for i in range(len(names))]
    trees: list[list[Tree]] = [[] for _ in names]
    plan = {i: (x.how, cuts[i], [features.index(f) for f in x.features], labels.index(x.label), bases[i]) for i, x in enumerate(fits.values()) if bases[i] is not None}
    if not plan:
        return {name: Trees(fits[name].features, None, []) for name in names}
    blocks = max(1, -(-facts.n // ROWS_A_TASK))
    tasks = max(-(-blocks // BLOCKS_A_TASK), min(blocks, df.sparkSession.sparkContext.defaultParallelism))
    train = _in_one_task if blocks == 1 else _in_passes
    for i, tree in train(table.repartition(tasks), plan, chunk):
        trees[i].append(tree)
    return {name: Trees(fits[name].features, bases[i], trees[i]) for i, name in enumerate(names)}


#: Of each fit: parameters, cuts, number of each feature and of the label among the columns, base.
Plan = dict[int, tuple[Boosting, list[np.ndarray], list[int], int, float]]


def _block(batch: pa.RecordBatch, plan: Plan) -> Blocks:
    number = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64)
    block = {}
    for i, (_, own, f, y, base) in plan.items():
        m = batch.column(f"m{i}").to_numpy(zero_copy_only=False).astype(bool)
        block[i] = Part.of(own, np.column_stack([number(f"f{j}")[m] for j in f]), number(f"y{y}")[m], batch.column("key").to_numpy()[m].astype(np.uint64), base)
    return block


def _growers(plan: Plan, r: int) -> dict[int, Grower]:
    return {i: Grower(how, own, r) for i, (how, own, *_) in plan.items() if r < how.rounds}


def _rounds(plan: Plan) -> int:
    return max(how.rounds for how, *_ in plan.values())


def _in_one_task(table: DataFrame, plan: Plan, chunk: int) -> Iterator[tuple[int, Tree]]:
    """Where all rows are one task's (ROWS_A_TASK at most), their sums are the totals: that task runs the rounds itself, five chunks to a job. Trees are those of the passes."""
    grown: dict[int, list[Tree]] = {i: [] for i in plan}
    for lo in range(0, _rounds(plan), 5 * chunk):
        sent = table.sparkSession.sparkContext.broadcast((plan, grown))

        def train(batches: Iterator[pa.RecordBatch], sent=sent, lo=lo) -> Iterator[pa.RecordBatch]:
            plan, grown = sent.value
            blocks = [moved(_block(batch, plan), grown) for batch in batches]
            out = []
            for r in range(lo, min(_rounds(plan), lo + 5 * chunk)):
                trees = grow(_growers(plan, r), lambda g: sum(measured(block, g) for block in blocks))
                blocks = [moved(block, {i: [t] for i, t in trees.items()}) for block in blocks]
                out += trees.items()
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(out)], pa.binary())], names=["trees"])

        for row in table.mapInArrow(train, "trees binary").collect():
            for i, tree in pickle.loads(row.trees):
                grown[i].append(tree)
                yield i, tree
        sent.destroy()


def _added(sums: Iterator[tuple[int, tuple[int, np.ndarray]]]) -> Iterator[tuple[int, np.ndarray]]:
    """Each slice with the sum of all tasks' parts of it."""
    by: dict[int, list[tuple[int, np.ndarray]]] = {}
    for i, one in sums:
        by.setdefault(i, []).append(one)
    for i, some in by.items():
        yield i, sum(own for _, own in sorted(some, key=lambda s: s[0]))


def _in_passes(table: DataFrame, plan: Plan, chunk: int) -> Iterator[tuple[int, Tree]]:
    """A pass over all blocks for each level."""
    sent = table.sparkSession.sparkContext.broadcast(plan)

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        for batch in pa.Table.from_batches(held).combine_chunks().to_batches(ROWS_A_TASK) if held else ():
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(_block(batch, sent.value))], pa.binary())], names=["block"])

    blocks = table.mapInArrow(to_blocks, "block binary").rdd.map(lambda r: pickle.loads(r.block)).persist(StorageLevel.MEMORY_AND_DISK)
    slices = min(4, blocks.getNumPartitions())
    fresh: dict[int, list[Tree]] = {i: [] for i in plan}  # trees that the blocks' margins don't hold yet

    def total(growers: dict[int, Grower]) -> np.ndarray:
        late = {i: list(fresh[i]) for i in growers}

        def add(part: int, some: Iterator[Blocks]) -> Iterator[tuple[int, tuple[int, np.ndarray]]]:
            out = np.zeros(sum(g.size() for g in growers.values()))
            for block in some:
                out += measured(moved(block, late), growers)
            yield from ((i, (part, own)) for i, own in enumerate(np.array_split(out, slices)))

        # the tasks' sums are added on executors, in the order of the tasks, so that the driver gets them once however many tasks there are
        sums = blocks.mapPartitionsWithIndex(add).partitionBy(slices, int).mapPartitions(_added)
        return np.concatenate([own for _, own in sorted(sums.collect(), key=lambda s: s[0])])

    for r in range(_rounds(plan)):
        for i, tree in grow(_growers(plan, r), total).items():
            fresh[i].append(tree)
            yield i, tree
        if (r + 1) % chunk == 0:  # the margins move on; the older blocks go when the new ones are there
            held, done = blocks, fresh
            blocks = held.map(lambda block, done=done: moved(block, done)).persist(StorageLevel.MEMORY_AND_DISK)
            fresh = {i: [] for i in plan}
            blocks.count()
            held.unpersist()
    blocks.unpersist()
