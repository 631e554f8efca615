"""Multivariate outlier scores."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.shared import written_once
from .windows import quantiles

#: Places in space that a box holds at most, which is what a search task holds.
BLOCK = 32_768
#: Places that ask a box at once, or so.
ASKED = 32_768
#: Places of a leaf of the tree that a task grows over its box, and askers that go through it together.
LEAF = 256


class Boxes:
    """Space cut into boxes of at most `block` distinct places, by as many rounds of splits as that takes.

    Each round cuts every cell that holds more at quantiles of a feature (sketches of all cells and features in one aggregation): the one whose bulk is widest, as whole ranges are those of a few strange places. As
    places are distinct, each cut leaves something on either side, so clusters and ties only take more rounds. levels: for each round a table of parent, cell, lo, hi: the boxes around the places of each cell, unsplit cells as their own children. Nothing of it is collected;
    tables by cell are joined, which Spark does by broadcast only where it sees that they are small.
    """

    FAN = 16

    def __init__(self, places: DataFrame, dims: int, block: int):
        self.dims, self.levels = dims, []
        at = places.withColumn("cell", F.lit(0).cast("long"))
        own = lambda f, name: [f(F.col("x")[i]).alias(f"{name}{i}") for i in range(dims)]
        for level in range(64):
            large = at.groupBy("cell").agg(F.count("*").alias("n"), *own(F.min, "lo"), *own(F.max, "hi"), *[F.percentile_approx(F.col("x")[i], [k / self.FAN for k in range(1, self.FAN)], 200).alias(f"q{i}") for i in range(dims)]).where(F.col("n") > block)
            bulk = lambda i: F.col(f"q{i}")[self.FAN - 3] - F.col(f"q{i}")[1]  # noqa: E731  where three quarters of the places lie
            wide = F.array_max(F.array(*[F.struct(bulk(i).alias("b"), (F.col(f"hi{i}") - F.col(f"lo{i}")).alias("w"), F.lit(-i).alias("i")) for i in range(dims)]))
            pick = lambda c: F.element_at(F.array(*[F.col(f"{c}{i}") for i in range(dims)]), 1 - F.col("w")["i"])
            step = F.when(1.25 * F.col("n") > 2 * block, self.FAN // 4).otherwise(self.FAN // 2)  # four parts or two, so that several features are cut
            cuts = F.array_distinct(F.filter(pick("q"), lambda v, i: (v < F.col("top")) & ((i + 1) % F.col("step") == 0)))
            large = large.withColumn("w", wide).withColumn("top", pick("hi")).withColumn("step", step).select("cell", (-F.col("w")["i"]).alias("dim"), F.when(F.size(cuts) > 0, cuts).otherwise(F.array(pick("lo"))).alias("cuts"))
            large = written_once(large, "splits")
            if large.isEmpty():
                break
            part = F.size(F.filter("cuts", lambda v: v < F.element_at("x", F.col("dim") + 1)))
            moved = at.join(large, "cell", "left").select(*places.columns, F.col("cell").alias("parent"), F.when(F.col("cuts").isNull(), F.col("cell")).otherwise(F.xxhash64("cell", part, F.lit(level))).alias("cell"))
            moved = written_once(moved, "cells")
            boxes = moved.groupBy("parent", "cell").agg(*own(F.min, "lo"), *own(F.max, "hi"))
            sides = lambda c: F.array(*[F.col(f"{c}{i}") for i in range(dims)]).alias(c)
            self.levels.append(written_once(boxes.select("parent", "cell", sides("lo"), sides("hi")), "boxes"))
            at = moved.drop("parent")
        self.places = at

    def visited(self, asked: DataFrame) -> DataFrame:
        """asked (x and radius among its columns) with each cell whose box the ball meets, found from the widest boxes down."""
        out = asked.withColumn("cell", F.lit(0).cast("long"))
        for boxes in self.levels:
            gap = F.aggregate(F.zip_with("x", F.arrays_zip("lo", "hi"), lambda v, b: F.greatest(b["lo"] - v, v - b["hi"], F.lit(0.0))), F.lit(0.0), lambda a, g: a + g * g)
            out = out.withColumnRenamed("cell", "parent").join(boxes, "parent").where(gap <= F.col("radius") * F.col("radius") * (1 + 1e-12)).select(*asked.columns, "cell")
        return out


def _leaves(x: np.ndarray) -> list[np.ndarray]:
    """Rows of x in parts of at most LEAF that lie close together: halved at the middle of the feature whose bulk is widest."""
    todo, done = [np.arange(len(x))], []
    while todo:
        at = todo.pop()
        if len(at) <= LEAF:
            done.append(at)
            continue
        some = x[at]
        low, high = np.quantile(some[:: max(1, len(some) // 128)], [0.125, 0.875], axis=0)
        wide = high - low if (high > low).any() else np.ptp(some, axis=0)
        at = at[np.argpartition(some[:, int(np.argmax(wide))], len(at) // 2)]
        todo += [at[len(at) // 2 :], at[: len(at) // 2]]
    return done


def _kth(part: np.ndarray, places: np.ndarray, counts: np.ndarray, want: int) -> np.ndarray:
    """No less than the distance of each of part to its want-th point, and hardly more; counts: points at each place."""
    few = min(len(places), want)
    square = (part**2).sum(1)[:, None] - 2 * part @ places.T + (places**2).sum(1)
    at = np.argpartition(square, few - 1, axis=1)[:, :few]
    d = np.sqrt(((part[:, None, :] - places[at]) ** 2).sum(2))
    order = np.argsort(d, axis=1)
    upto = np.cumsum(np.take_along_axis(counts[at], order, 1), axis=1)
    d = np.take_along_axis(d, order, 1)
    return np.where(upto[:, -1] >= want, np.take_along_axis(d, (upto >= want).argmax(1)[:, None], 1)[:, 0], np.inf)


def _nearest(x: np.ndarray, radius: np.ndarray, places: np.ndarray, ids: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k + 1 nearest points of each query place within its radius: its row, their ids and distances, by row. Equal distances (nine decimals) by id. counts: ids at each place.

    Places lie in the leaves of a tree. Queries that are close go together: the leaves nearest to them narrow their radius, then those that a ball meets are searched.
    Squares by a matrix product tell which places can be among them, with room for their rounding; distances of those are then taken exactly.
    """
    want, leaves = k + 1, _leaves(places)
    order, sizes = np.concatenate(leaves), np.array([len(v) for v in leaves])
    begin = (np.cumsum(counts) - counts)[order]
    places, counts = places[order], counts[order]
    first = np.cumsum(sizes) - sizes
    low, high = np.minimum.reduceat(places, first), np.maximum.reduceat(places, first)
    leaf = np.repeat(np.arange(len(sizes)), sizes)
    out: list[tuple] = []
    for asks in _leaves(x):
        part, reach = x[asks], radius[asks]
        gap = np.zeros((len(part), len(sizes)))
        for f in range(x.shape[1]):
            side = part[:, f, None]
            gap += np.maximum(np.maximum(low[:, f] - side, side - high[:, f]), 0.0) ** 2
        if not np.isfinite(reach).all():
            close = np.argsort(gap.mean(0), kind="stable")
            close = close[: np.searchsorted(np.cumsum(sizes[close]), 4 * LEAF + want) + 1]
            some = np.isin(leaf, close)
            reach = np.minimum(reach, _kth(part - part[0], places[some] - part[0], counts[some], want) + 2e-9)
        met = gap <= (reach**2 * (1 + 1e-12))[:, None]
        rows, at, far = [], [], []
        by = np.argsort(met.sum(1), kind="stable")
        for few in (by[lo : lo + 32] for lo in range(0, len(by), 32)):  # those that meet few leaves don't go through the many of others
            some = np.flatnonzero(met[few].any(0)[leaf])
            about, near = part[few] - part[few[0]], places[some] - part[few[0]]  # close to nothing, so squares lose little
            own, norms = (about**2).sum(1), (near**2).sum(1)
            left = np.column_stack([-2 * about, np.ones(len(about))]) @ np.vstack([near.T, norms])  # square distance less the asker's own square
            hit = np.flatnonzero(left <= (reach[few] ** 2 - own + 1e-12 * (own + norms.max(initial=0.0)))[:, None])
            row, place = few[hit // max(len(some), 1)], some[hit % max(len(some), 1)]
            d = np.sqrt(((part[row] - places[place]) ** 2).sum(1))
            inside = d <= reach[row]
            rows.append(row[inside])
            at.append(place[inside])
            far.append(d[inside])
        row, place, d = np.concatenate(rows), np.concatenate(at), np.concatenate(far)
        # the points of these places
        size = counts[place]
        point = ids[np.repeat(begin[place] - np.cumsum(size) + size, size) + np.arange(size.sum())]
        row, d = np.repeat(row, size), np.repeat(d, size)
        by = np.lexsort((point, np.round(d, 9), row))
        row, d, point = row[by], d[by], point[by]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < want
        out.append((asks[row[keep]], point[keep], d[keep]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    rows, found, d = (np.concatenate(v) for v in zip(*out, strict=True))
    by = np.argsort(rows, kind="stable")
    return rows[by], found[by], d[by]


def _matrix(table: pa.Table, name: str, dims: int) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy() for c in table.column(name).chunks] or [np.zeros(0)]).reshape(-1, dims)


def _lists(values: np.ndarray, rows: np.ndarray, n: int) -> pa.Array:
    """One list for each of n rows; values come by row."""
    return pa.ListArray.from_arrays(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32), values)


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """An explicit exchange into as many parts as the session shuffles into: adaptive execution would merge them by their bytes, and what follows is much work on few bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def local_outlier_factor(df: DataFrame, key: str, features: list[str], k: int, block: int = BLOCK) -> DataFrame:
    """key and lof: mean local density of the k nearest neighbours over the own one. Exact; distances in space, ties (nine decimals) by key.

    Points are numbered in the order of their keys. Points at the same place are searched for once: a place keeps its k + 1 smallest numbers, which is all that any neighbour list can hold of it.
    Places lie in boxes of at most `block`, and a task searches a box by a tree. Each place is first searched for in its own box; the distance to the last one found there bounds the search, and a place then
    visits just the other boxes that its ball meets. Those who ask a box come in parts of bounded size. The driver holds nothing of the points.
    """
    dims = len(features)
    pts = df.select(F.col(key).cast("string").alias("id"), F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]).alias("x"))
    pts = written_once(pts.orderBy("id").select("id", "x", F.monotonically_increasing_id().alias("n")), "points")
    alike = W.partitionBy("x")
    placed = written_once(pts.select("n", "x", F.min("n").over(alike).alias("p"), F.row_number().over(alike.orderBy("n")).alias("rn")), "placed")
    places = placed.where(F.col("rn") <= k + 1).groupBy("p").agg(F.first("x").alias("x"), F.array_sort(F.collect_list("n")).alias("ids"))
    boxes = Boxes(written_once(places, "places"), dims, block)

    def held(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = table.column("ids").combine_chunks()
        return _matrix(table, "x", dims), ids.flatten().to_numpy(), ids.value_lengths().to_numpy().astype(np.int64)

    def at_home(table: pa.Table) -> pa.Table:
        x, ids, counts = held(table)
        rows, o, d = _nearest(x, np.full(len(x), np.inf), x, ids, counts, k)
        upto = np.searchsorted(rows, np.arange(len(x) + 1))
        full = np.diff(upto) > k
        radius = np.where(full, d[np.maximum(upto[1:] - 1, 0)] + 2e-9 if len(d) else np.inf, np.inf)
        return pa.table({"p": table.column("p"), "x": table.column("x"), "radius": radius, "own": table.column("cell"), "o": _lists(o, rows, len(x)), "d": _lists(d, rows, len(x))})

    home = written_once(_spread(boxes.places, "cell").groupBy("cell").applyInArrow(at_home, "p long, x array<double>, radius double, own long, o array<long>, d array<double>"), "home")
    asked = written_once(boxes.visited(home.select("p", "x", "radius", "own")).where("cell <> own").select("p", "x", "radius", "cell"), "asked")
    parts = asked.groupBy("cell").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("parts"))
    asked = asked.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("p"), F.col("parts")).cast("int"))
    there = boxes.places.join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def away(asks: pa.Table, table: pa.Table) -> pa.Table:
        n = asks.num_rows
        rows, o, d = _nearest(_matrix(asks, "x", dims), asks.column("radius").to_numpy(), *held(table), k) if n and table.num_rows else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        found = np.unique(rows)
        rows = np.searchsorted(found, rows)
        return pa.table({"p": asks.column("p").take(pa.array(found)), "o": _lists(o, rows, len(found)), "d": _lists(d, rows, len(found))})

    more = _spread(asked.select("p", "x", "radius", "cell", "part"), "cell", "part").groupBy("cell", "part").cogroup(_spread(there.select("x", "ids", "cell", "part"), "cell", "part").groupBy("cell", "part")).applyInArrow(away, "p long, o array<long>, d array<double>")
    zipped = F.transform(F.arrays_zip("o", "d"), lambda v: F.struct(F.round(v["d"], 9).alias("r"), v["o"].alias("o"), v["d"].alias("d")))
    found = home.select("p", "o", "d").unionByName(more).groupBy("p").agg(F.slice(F.array_sort(F.flatten(F.collect_list(zipped))), 1, k + 1).alias("list"))
    own = F.slice(F.filter("list", lambda v: v["o"] != F.col("n")), 1, k)
    lists = placed.select("n", "p").join(found, "p").select("n", F.transform(own, lambda v: F.struct(v["o"].alias("o"), v["d"].alias("d"))).alias("list"))
    lists = written_once(lists.select("n", "list", F.array_max("list.d").alias("kd")), "neighbours")
    near = lists.select("n", F.explode("list").alias("v")).select("n", "v.o", "v.d")
    reach = near.join(lists.select(F.col("n").alias("o"), "kd"), "o")
    density = written_once(reach.groupBy("n").agg((1 / (F.avg(F.greatest("kd", "d")) + 1e-10)).alias("lrd")), "density")
    other = near.join(density.select(F.col("n").alias("o"), F.col("lrd").alias("their")), "o").groupBy("n").agg(F.avg("their").alias("m"))
    return other.join(density, "n").join(pts.select("n", "id"), "n").select(F.col("id").alias(key), (F.col("m") / F.col("lrd")).alias("lof"))


def _c(n: int) -> float:
    return 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else float(n == 2)


def _grow(x: np.ndarray, rng: np.random.Generator, depth: int, limit: int) -> tuple:
    if depth >= limit or len(x) <= 1 or (x == x[0]).all():
        return (depth + _c(len(x)),)
    spread = np.flatnonzero(x.max(0) > x.min(0))
    f = int(rng.choice(spread))
    at = float(rng.uniform(x[:, f].min(), x[:, f].max()))
    left = x[:, f] < at
    return f, at, _grow(x[left], rng, depth + 1, limit), _grow(x[~left], rng, depth + 1, limit)


class _Flat:
    """A grown tree as arrays, so that rows go down it a level at a time."""

    def __init__(self, tree: tuple):
        self.feature, self.cut, self.left, self.right, self.length = [], [], [], [], []
        self._add(tree)
        self.feature, self.left, self.right = np.array(self.feature), np.array(self.left), np.array(self.right)
        self.cut, self.length = np.array(self.cut), np.array(self.length)

    def _add(self, tree: tuple) -> int:
        at = len(self.feature)
        leaf = len(tree) == 1
        for values, v in ((self.feature, -1 if leaf else tree[0]), (self.cut, 0.0 if leaf else tree[1]), (self.left, at), (self.right, at), (self.length, tree[0] if leaf else 0.0)):
            values.append(v)
        if not leaf:
            self.left[at], self.right[at] = self._add(tree[2]), self._add(tree[3])
        return at

    def path(self, x: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while True:
            f = self.feature[node]
            if (f < 0).all():
                return self.length[node]
            node = np.where(x[rows, np.maximum(f, 0)] < self.cut[node], self.left[node], self.right[node])  # a leaf's children are itself


def isolation_forests(df: DataFrame, features: list[str], forests: dict[str, int], *, sample: int = 256, seed: int = 0) -> DataFrame:
    """df with one column for each forest (0 to 1, higher is stranger); forests: number of trees by column name.

    One pass draws the rows of all trees: a row's hash gives it a number for each tree, a task keeps the `sample` smallest numbers of each tree and the merge of the tasks' lists keeps the
    smallest of all. Each tree is grown where its rows meet; the trees, of bounded size, come to the driver and go out to score all forests in one pass. Trees of a smaller forest are the first ones
    of a larger. Rows whose features are alike are drawn each on its own (rows alike in all columns together); a null feature counts as 0.
    """
    trees, spark = max(forests.values()), df.sparkSession
    vector = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])
    rows = df.select(vector.alias("x"), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns], F.lit(seed)).alias("h"))
    layout = "tree int, rank double, x array<double>"

    def smallest(rank: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(rank) <= sample:
            return rank, x
        at = np.argpartition(rank, sample - 1)[:sample]
        return rank[at], x[at]

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[tuple[np.ndarray, np.ndarray] | None] = [None] * trees
        for pdf in batches:
            if not len(pdf):
                continue
            x, h = np.stack(pdf["x"].to_numpy()), pdf["h"].to_numpy().astype(np.uint64)
            for t in range(trees):
                rank = _uniform(h, seed, t)
                # of a batch only those below the largest kept rank can come in
                if kept[t] is not None and len(kept[t][0]) >= sample:
                    low = np.flatnonzero(rank < kept[t][0].max())
                    if not len(low):
                        continue
                    rank, some = rank[low], x[low]
                else:
                    some = x
                kept[t] = smallest(rank, some) if kept[t] is None else smallest(np.concatenate([kept[t][0], rank]), np.concatenate([kept[t][1], some]))
        for t, k in enumerate(kept):
            if k is not None:
                yield pd.DataFrame({"tree": np.full(len(k[0]), t, np.int32), "rank": k[0], "x": list(k[1])})

    def plant(pdf: pd.DataFrame) -> pd.DataFrame:
        rank, x = pdf["rank"].to_numpy(), np.stack(pdf["x"].to_numpy())
        x = x[np.lexsort((*x.T, rank))[:sample]]
        t = int(pdf["tree"].iloc[0])
        tree = _grow(x, np.random.default_rng([seed, t]), 0, math.ceil(math.log2(max(min(sample, len(x)), 2))))
        return pd.DataFrame({"tree": [t], "size": [len(x)], "grown": [pickle.dumps(tree)]})

    # a task's lists meet again by tree: sample rows of each task and tree at most
    drawn = rows.mapInPandas(draw, layout)
    grown = {r.tree: (r.size, pickle.loads(r.grown)) for r in _spread(drawn, "tree").groupBy("tree").applyInPandas(plant, "tree int, size int, grown binary").collect()}
    sent = spark.sparkContext.broadcast([_Flat(grown[t][1] if t in grown else (0.0,)) for t in range(trees)])
    scale = _c(max((n for n, _ in grown.values()), default=1)) or 1.0
    names = list(forests)

    @F.pandas_udf("array<double>")
    def score(x: pd.Series) -> pd.Series:
        m = np.stack(x.to_numpy())
        paths = np.cumsum([t.path(m) for t in sent.value], axis=0)
        return pd.Series(list(np.column_stack([2 ** (-paths[forests[n] - 1] / forests[n] / scale) for n in names])))

    scored = _spread(df).withColumn("_scores", score(vector))
    return scored.select(*df.columns, *[F.element_at("_scores", i + 1).alias(n) for i, n in enumerate(names)])


def _uniform(h: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """A number in 0..1 for each row hash and tree."""
    h = h + np.uint64((seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return ((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def isolation_scores(df: DataFrame, features: list[str], *, trees: int = 200, sample: int = 256, seed: int = 0) -> DataFrame:
    """df with column isolation (0 to 1, higher is stranger), by one forest."""
    return isolation_forests(df, features, {"isolation": trees}, sample=sample, seed=seed)


def _moments(df: DataFrame, features: list[str]) -> tuple[np.ndarray, np.ndarray]:
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    r = df.agg(*[F.avg(c) for c in features], *[F.covar_pop(a, b) for a, b in pairs]).first()
    n = len(features)
    cov = np.zeros((n, n))
    for (a, b), v in zip(pairs, r[n:], strict=True):
        i, j = features.index(a), features.index(b)
        cov[i, j] = cov[j, i] = v or 0.0
    return np.array([v or 0.0 for v in r[:n]]), cov


def _distance(features: list[str], mean: np.ndarray, cov: np.ndarray) -> Column:
    p = np.linalg.pinv(cov)
    d = [F.col(c) - float(m) for c, m in zip(features, mean, strict=True)]
    terms = [d[i] * d[j] * float(p[i, j]) for i in range(len(d)) for j in range(len(d))]
    return F.sqrt(F.greatest(sum(terms[1:], terms[0]), F.lit(0.0)))


def robust_mahalanobis(df: DataFrame, features: list[str], *, support: float = 0.9, steps: int = 3) -> DataFrame:
    """df with column distance. Each step refits mean and covariance (one aggregation) to the share of rows nearest so far."""
    mean, cov = _moments(df, features)
    for _ in range(steps):
        near = df.withColumn("_d", _distance(features, mean, cov))
        cut = quantiles(near, "_d", {"q": support}).first().q
        if cut is None:
            break
        mean, cov = _moments(near.where(F.col("_d") <= cut), features)
    return df.withColumn("distance", _distance(features, mean, cov))


