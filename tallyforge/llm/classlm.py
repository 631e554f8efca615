"""Class-based n-gram language model: exchange clustering of words, class transitions, word emissions.

Method. Exchange clustering moves words between classes while the likelihood of class bigrams grows. It starts from the `top_words` most frequent
words and the endings (last two bytes) of all others, on a table of their bigrams. Then every listed word is moved by its counts of neighbours
in each class, gathered by one more scan. Only words that are not on the list keep the class of their ending. A text's probability is the product of
P(class | class before) and P(word | class); the latter is (c + d) / (N_class + d (V_class + 1)) with the word's exact training count c.

Exact counts. Words of a bounded list of frequent ones are counted map-side with one row a word and task. All others
go, by hash, to buckets: packed arrays of (word hash, row, class), about `bucket_words` a bucket. A bucket counts its words exactly and returns
the sum of log10(c + d) for each row. The same sum serves the unigram base score, as its denominator is the same for all words.

Scale. Five scans, one shuffle of rare words and one of per-row sums; both grow with the corpus and are even, as frequent words do not
take part. The driver holds `list_words` counts, a type-by-type table of fixed size, and at most 2 * (classes + 1) counts of neighbours a listed word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import CODES, Step, text_steps
from .scratch import materialise, small_batches

ENDINGS = 256
#: Rows whose numbers agree above these bits get their sums in one place; a scan task numbers its rows from a multiple of 2**40.
ROW_BITS = 16
_FOLD = np.arange(256, dtype=np.int64)
_FOLD[65:91] = _FOLD[97:123]


def _endings(step: Step, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number below ENDINGS from the last two bytes of each word."""
    last = CODES[step.data[end - 1]]
    before = np.where(end - begin > 1, CODES[step.data[np.maximum(end - 2, 0)]], np.uint64(0))
    return ((last * np.uint64(3) + before * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.int64)


def _compact(keys: list[np.ndarray], counts: list[np.ndarray], extra: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k, n, e = np.concatenate(keys), np.concatenate(counts), np.concatenate(extra)
    u, first, inverse = np.unique(k, return_index=True, return_inverse=True)
    return u, np.bincount(inverse, n, len(u)).astype(np.int64), e[first]


def frequent_words(docs: DataFrame, list_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and endings of about the list_words most frequent words of the rows to learn from, most frequent first.

    A task passes on the words that make up a millionth of its words; which words end up on the list has no bearing on any count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, extra, pending = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
        for batch in batches:
            learn = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for step in text_steps(batch.column(1)):
                w = step.words("space")
                ok = learn[step.lo : step.hi][w.rows()]
                u, first, n = np.unique(w.hashes()[ok], return_index=True, return_counts=True)
                keys.append(u)
                counts.append(n)
                extra.append(_endings(step, w.begin[ok], w.end[ok])[first])
                pending += len(u)
                if pending > 2_000_000:
                    k, n, e = _compact(keys, counts, extra)
                    keys, counts, extra, pending = [k], [n], [e], 0
        k, n, e = _compact(keys, counts, extra)
        take = n >= max(2, int(n.sum() * 1e-6))
        yield pa.RecordBatch.from_arrays([pa.array(k[take].view(np.int64)), pa.array(n[take]), pa.array(e[take].astype(np.int32))], names=["h", "n", "e"])

    found = docs.mapInArrow(run, "h long, n long, e int").groupBy("h").agg(F.sum("n").alias("n"), F.min("e").alias("e")).orderBy(F.desc("n"), "h").limit(list_words).toArrow()
    return found["h"].to_numpy().view(np.uint64), found["e"].to_numpy().astype(np.int64)


class Typer:
    """Types of words: 0..top-1 frequent words, then endings, last the end of a text.

    of_place and of_ending: class of each listed word (in the list's order here) and of each ending, once there are classes.
    """

    def __init__(self, hashes: np.ndarray, endings: np.ndarray, top: int):
        order = np.argsort(hashes)
        self.hashes, self.endings, self.top = hashes[order], endings[order], min(top, len(hashes))
        rank = np.empty(len(hashes), np.int64)
        rank[:] = order
        self.type = np.where(rank < self.top, rank, self.top + self.endings)
        self.size = self.top + ENDINGS + 1
        self.of_place = self.of_ending = np.empty(0, np.int64)

    def places(self, h: np.ndarray) -> np.ndarray:
        """Index in the list, -1 for words that are not on it."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        i = np.searchsorted(self.hashes, h)
        i[i == len(self.hashes)] = 0
        return np.where(self.hashes[i] == h, i, -1)

    def sequence(self, step: Step, classes: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Types with an end after each row (or classes, of which there are so many before that of the end); the row of each; list places and
        hashes of the words; where the words stand."""
        w = step.words("space")
        h, rows, n = w.hashes(), w.rows(), len(step.at) - 1
        place = self.places(h)
        on, ending = place >= 0, _endings(step, w.begin, w.end)
        kind = self.top + ending if classes is None else self.of_ending[ending]
        kind[on] = (self.type if classes is None else self.of_place)[place[on]]
        at = np.arange(len(h)) + rows
        out = np.full(len(h) + n, self.size - 1 if classes is None else classes)
        out[at] = kind
        of = np.empty(len(out), np.int64)
        of[at] = rows
        of[w.of[1:] + np.arange(n)] = np.arange(n)
        return out, of, place, h, at


def exchange(table: np.ndarray, classes: int, rounds: int = 6) -> np.ndarray:
    """Class of each type: exchange clustering on a table of type bigrams. The last type keeps a class of its own, the last."""
    t = len(table)
    mass = table.sum(1) + table.sum(0)
    order = np.argsort(-mass[: t - 1], kind="stable")
    cls = np.zeros(t, np.int64)
    cls[order] = np.arange(t - 1) % classes
    cls[t - 1] = classes
    c = classes + 1
    f = lambda x: x * np.log(np.maximum(x, 1e-300))
    hot = np.zeros((t, c))
    hot[np.arange(t), cls] = 1
    grid, to, fro = hot.T @ table @ hot, table @ hot, table.T @ hot
    for _ in range(rounds):
        moved = 0
        for w in order:
            if not mass[w]:
                continue
            k, own = cls[w], float(table[w, w])
            a, b = to[w].copy(), fro[w].copy()
            a[k] -= own
            b[k] -= own
            grid[k] -= a
            grid[:, k] -= b
            grid[k, k] -= own
            left, right, fg = grid.sum(1) + b, grid.sum(0) + a, f(grid)
            rows, cols = f(grid + a) - fg, f(grid + b[:, None]) - fg
            d = np.diag(grid)
            gain = rows.sum(1) - np.diag(rows) + cols.sum(0) - np.diag(cols) + f(d + a + b + own) - f(d)
            gain -= f(left + a.sum() + own) - f(left) + f(right + b.sum() + own) - f(right)
            gain[classes] = -np.inf
            best = int(gain.argmax())
            if gain[best] <= gain[k] + 1e-9:
                best = k
            grid[best] += a
            grid[:, best] += b
            grid[best, best] += own
            if best != k:
                moved += 1
                cls[w] = best
                to[:, k] -= table[:, w]
                to[:, best] += table[:, w]
                fro[:, k] -= table[w]
                fro[:, best] += table[w]
        if not moved:
            break
    return cls


def _placed(grid: np.ndarray, k: np.ndarray, a: np.ndarray, b: np.ndarray, own: np.ndarray) -> np.ndarray:
    """For each word and class, what the word's counts a add to that class's row of the grid, which holds the word in class k until now.

    Only cells with a count in a are looked at: most words have few neighbours.
    """
    w, j = np.nonzero(a)
    out = np.zeros(a.shape)
    if len(w):
        cell = grid.T[j]
        same = j == k[w]
        cell[same] -= b[w[same]]
        cell[same, k[w[same]]] -= own[w[same]]
        cell[np.arange(len(w)), k[w]] -= a[w, j]
        np.maximum(cell, 0, out=cell)  # moves of other words leave small errors where a neighbour has moved since
        more = cell + a[w, j][:, None]
        term = more * np.log(more) - cell * np.log(np.maximum(cell, 1e-300))
        first = np.flatnonzero(np.diff(w, prepend=-1))
        out[w[first]] = np.add.reduceat(term, first)
    return out


def exchange_by_neighbours(grid: np.ndarray, cls: np.ndarray, right: np.ndarray, left: np.ndarray, own: np.ndarray, rounds: int = 2) -> np.ndarray:
    """Classes of words after moves that make class bigrams likelier. The last class is the end's; no word moves there.

    right, left: counts of the classes after and before each word; own: of the word itself after itself. A neighbour counts under the class it had
    when these were gathered. Words are moved most frequent first, a block at a time: 16 words at first, up to 256 further down.
    """
    c, cls, grid = len(grid), cls.copy(), grid.astype(float)
    f = lambda x: x * np.log(np.maximum(x, 1e-300))
    mass = right.sum(1) + left.sum(1)
    order = np.argsort(-mass, kind="stable")
    order = order[mass[order] > 0]
    cuts = [0]
    while cuts[-1] < len(order):
        cuts.append(cuts[-1] + int(np.clip(cuts[-1] // 16, 16, 256)))
    home = cls.copy()  # under which right and left count the word itself
    for _ in range(rounds):
        moved = 0
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            w = order[lo:hi]
            i, k, o = np.arange(len(w)), cls[w], own[w].astype(float)
            a, b = right[w].astype(float), left[w].astype(float)
            a[i, home[w]] -= o
            b[i, home[w]] -= o
            gain = _placed(grid, k, a, b, o) + _placed(grid.T, k, b, a, o)
            # the cell of a class with itself takes both sides at once
            d = np.repeat(np.diag(grid)[None], len(w), 0)
            d[i, k] = np.maximum(d[i, k] - a[i, k] - b[i, k] - o, 0)
            gain += f(d + a + b + o[:, None]) - f(d + a) - f(d + b) + f(d)
            for sums, n in ((grid.sum(1), a.sum(1) + o), (grid.sum(0), b.sum(1) + o)):
                left_over = np.repeat(sums[None], len(w), 0)
                left_over[i, k] = np.maximum(left_over[i, k] - n, 0)
                gain -= f(left_over + n[:, None]) - f(left_over)
            gain[:, c - 1] = -np.inf
            best = gain.argmax(1)
            go = gain[i, best] > gain[i, k] + 1e-9
            moved += int(go.sum())
            for j in np.flatnonzero(go):
                q = best[j]
                grid[k[j]] -= a[j]
                grid[:, k[j]] -= b[j]
                grid[k[j], k[j]] -= o[j]
                grid[q] += a[j]
                grid[:, q] += b[j]
                grid[q, q] += o[j]
                cls[w[j]] = q
            np.maximum(grid, 0, out=grid)
        if not moved:
            break
    return cls


@dataclass
class ClassModel:
    """What the corpus has taught: classes (typer), counts of the listed words, class bigrams and how many words of the corpus are not listed."""

    typer: Typer
    listed: np.ndarray
    grid: np.ndarray
    n_rare: int
    classes: int


def _rows(docs: DataFrame, learn, id_col: str, text_col: str) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))


def fit_classes(docs: DataFrame, learn, *, id_col: str = "doc_id", text_col: str = "text", list_words: int = 65_536, top_words: int = 512, classes: int = 32) -> ClassModel:
    """Cluster the words of the rows to learn from."""
    spark, rows = docs.sparkSession, _rows(docs, learn, id_col, text_col)
    typer = Typer(*frequent_words(rows, list_words), top_words)
    sent = spark.sparkContext.broadcast(typer)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ty = sent.value
        listed, pairs, rare = np.zeros(len(ty.hashes), np.int64), np.zeros(ty.size * ty.size, np.int64), 0
        for batch in batches:
            flags = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for step in text_steps(batch.column(1)):
                kind, of, place, _, at = ty.sequence(step)
                ok = flags[step.lo : step.hi][of]
                pair = np.concatenate([[ty.size - 1], kind[:-1]]) * ty.size + kind
                pairs += np.bincount(pair[ok], minlength=len(pairs))
                on = place >= 0
                listed += np.bincount(place[on & ok[at]], minlength=len(listed))
                rare += int((~on).sum())
        for kind, a in ((0, listed), (1, pairs), (2, np.array([rare]))):
            i = np.flatnonzero(a)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), kind, np.int32)), pa.array(i.astype(np.int32)), pa.array(a[i])], names=["kind", "i", "n"])

    got = rows.mapInArrow(count, "kind int, i int, n long").groupBy("kind", "i").agg(F.sum("n").alias("n")).toArrow()
    kind, i, n = (got[c].to_numpy() for c in ("kind", "i", "n"))
    listed, pairs = np.zeros(len(typer.hashes), np.int64), np.zeros(typer.size * typer.size, np.int64)
    listed[i[kind == 0]] = n[kind == 0]
    pairs[i[kind == 1]] = n[kind == 1]
    table = pairs.reshape(typer.size, typer.size)
    cls = exchange(table.astype(float), classes)
    hot = np.zeros((typer.size, classes + 1))
    hot[np.arange(typer.size), cls] = 1
    typer.of_place, typer.of_ending = cls[typer.type], cls[typer.top : -1]
    right, left, own = _neighbours(rows, typer, classes)
    typer.of_place = exchange_by_neighbours(hot.T @ table @ hot, typer.of_place, right, left, own)
    return ClassModel(typer, listed, _class_bigrams(rows, typer, classes), int(n[kind == 2].sum()), classes)


def score_texts(docs: DataFrame, learn, model: ClassModel | None = None, *, id_col: str = "doc_id", text_col: str = "text", delta: float = 0.1, bucket_words: int = 2_000_000, **options) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability) and perplexity a token of every row.

    learn: boolean column, the rows to learn from (null: no). Tokens are lower-cased (A-Z) runs without ASCII white space and one end; null and
    empty texts have the end alone. Rows that repeat are scored, and counted, each on its own. With nothing to learn from all words are unknown.
    model: from fit_classes on the same rows; options are those of fit_classes.
    """
    spark, rows = docs.sparkSession, _rows(docs, learn, id_col, text_col)
    model = model or fit_classes(docs, learn, id_col=id_col, text_col=text_col, **options)
    typer, listed, grid, classes = model.typer, model.listed, model.grid, model.classes
    c = classes + 1
    step_log = np.log10((grid + 0.5) / (grid.sum(1, keepdims=True) + 0.5 * c))
    tokens = grid.sum(0)  # training tokens of each class
    ends = int(tokens[-1])
    buckets = max(1, -(-model.n_rare // bucket_words))
    sent = spark.sparkContext.broadcast((typer, step_log, np.log10(listed + delta), listed > 0, float(np.log10(ends + delta)), ends > 0))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ty, moves, logs, known, end_log, end_known = sent.value
        row = base = TaskContext.get().partitionId() << 40
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        pending = 0

        def packed() -> Iterator[pa.RecordBatch]:
            if pending:
                h, r, k = (np.concatenate(x) for x in zip(*held, strict=True))
                bucket = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                h, r, k, bucket = h[order], r[order], k[order], bucket[order]
                cut = np.flatnonzero(np.diff(bucket)) + 1
                parts = [(int(bucket[lo]), h[lo:hi].tobytes(), (r[lo:hi] - base).astype(np.uint32).tobytes(), k[lo:hi].tobytes()) for lo, hi in zip([0, *cut], [*cut, len(h)], strict=True)]
                m = len(parts)
                yield pa.RecordBatch.from_pydict({"row": [base] * m, "doc_id": [None] * m, "n_tokens": [None] * m, "n_known": [None] * m, "logs": [None] * m, "moves": [None] * m, "of_class": [None] * m, "bucket": [p[0] for p in parts], "h": [p[1] for p in parts], "r": [p[2] for p in parts], "k": [p[3] for p in parts]}, schema=layout)

        layout = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("logs", pa.float64()), ("moves", pa.float64()), ("of_class", pa.list_(pa.int32())), ("bucket", pa.int32()), ("h", pa.binary()), ("r", pa.binary()), ("k", pa.binary())])
        for batch in batches:
            ids, flags = batch.column(0), batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for step in text_steps(batch.column(1)):
                k, of, place, h, at = ty.sequence(step, classes)
                n = step.hi - step.lo
                move = moves[np.concatenate([[c - 1], k[:-1]]), k]
                on = place >= 0
                mine = of[at]
                logs_ = np.bincount(mine[on], logs[place[on]], n) + end_log
                known_ = np.bincount(mine[on], known[place[on]], n).astype(np.int64) + end_known
                grid_ = np.bincount(of * c + k, minlength=n * c).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * c + 1, c, dtype=np.int32)), pa.array(grid_))
                none = lambda t, n=n: pa.nulls(n, t)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + n)), ids.slice(step.lo, n).cast(pa.int64()), pa.array(np.bincount(of, minlength=n).astype(np.int64)), pa.array(known_), pa.array(logs_), pa.array(np.bincount(of, move, n)), lists, none(pa.int32()), none(pa.binary()), none(pa.binary()), none(pa.binary())], schema=layout)
                off = ~on
                flag = flags[step.lo : step.hi][mine[off]].astype(np.uint8)
                held.append((h[off], row + mine[off], (k[at][off].astype(np.uint8) << 1) | flag))
                pending += len(held[-1][0])
                row += n
                if pending > 1_000_000:
                    yield from packed()
                    held, pending, base = [], 0, row
        yield from packed()

    schema = "row long, doc_id long, n_tokens long, n_known long, logs double, moves double, of_class array<int>, bucket int, h binary, r binary, k binary"
    scanned = materialise(rows.mapInArrow(scan, schema), "lm-scan")

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        h = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["h"]])
        r = np.concatenate([np.frombuffer(x, np.uint32).astype(np.int64) + b for x, b in zip(pdf["r"], pdf["row"], strict=True)])
        k = np.concatenate([np.frombuffer(x, np.uint8) for x in pdf["k"]])
        train = (k & 1).astype(bool)
        words, first, counts = np.unique(h[train], return_index=True, return_counts=True)
        i = np.searchsorted(words, h)
        i[i == len(words)] = 0
        c = np.where(words[i] == h, counts[i], 0) if len(words) else np.zeros(len(h), np.int64)
        u, inverse = np.unique(r, return_inverse=True)
        kinds = np.bincount(k[train][first] >> 1, minlength=classes + 1)
        logs, known = np.bincount(inverse, np.log10(c + delta), len(u)), np.bincount(inverse, c > 0, len(u)).astype(np.int64)
        cut = np.flatnonzero(np.diff(u >> ROW_BITS)) + 1
        parts = [(int(u[lo]) >> ROW_BITS, u[lo:hi].tobytes(), logs[lo:hi].tobytes(), known[lo:hi].tobytes(), None) for lo, hi in zip([0, *cut], [*cut, len(u)], strict=True)]
        return pd.DataFrame([*parts, (None, None, None, None, kinds)], columns=["block", "r", "logs", "known", "kinds"]).astype({"block": "Int64"})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        r, logs, known = (np.concatenate([np.frombuffer(x, t) for x in pdf[c]]) for c, t in (("r", np.int64), ("logs", np.float64), ("known", np.int64)))
        u, inverse = np.unique(r, return_inverse=True)
        return pd.DataFrame({"row": u, "rare_logs": np.bincount(inverse, logs, len(u)), "rare_known": np.bincount(inverse, known, len(u)).astype(np.int64)})

    sums = materialise(scanned.where("bucket is not null").select("bucket", "row", "h", "r", "k").groupBy("bucket").applyInPandas(settle, "block long, r binary, logs binary, known binary, kinds array<long>"), "lm-sums")
    distinct = np.bincount(typer.of_place[listed > 0], minlength=classes + 1).astype(float)
    distinct[classes] += ends > 0
    for x in sums.where("block is null").select(F.posexplode("kinds").alias("c", "n")).groupBy("c").agg(F.sum("n").alias("n")).collect():
        distinct[x.c] += x.n
    total, vocabulary = int(tokens.sum()), float(distinct.sum())
    fall = F.array(*[F.lit(float(np.log10(a + delta * (v + 1)))) for a, v in zip(tokens, distinct, strict=True)])
    rare = sums.where("block is not null").groupBy("block").applyInPandas(add, "row long, rare_logs double, rare_known long")
    out = scanned.where("bucket is null").select("row", "doc_id", "n_tokens", "n_known", "logs", "moves", "of_class").join(rare, "row", "left")
    logs = F.col("logs") + F.coalesce("rare_logs", F.lit(0.0))
    emitted = F.aggregate(F.zip_with("of_class", fall, lambda m, v: m * v), F.lit(0.0), lambda a, x: a + x)
    return out.select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (logs - F.col("n_tokens") * float(np.log10(total + delta * (vocabulary + 1)))).alias("base_score"), (F.col("moves") + logs - emitted).alias("score")).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def _neighbours(rows: DataFrame, typer: Typer, classes: int, blocks: int = 128) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each listed word the training counts of classes after and before it, and of itself after itself.

    A task sends packed counts, a row for each block of words; blocks are added up on the executors.
    """
    sent = rows.sparkSession.sparkContext.broadcast(typer)
    c, words = classes + 1, len(typer.hashes)
    wide = 2 * c + 1

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ty = sent.value
        sums, held, pending = np.zeros(words * wide, np.int64), [], 0
        for batch in batches:
            flags = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for step in text_steps(batch.column(1)):
                k, of, place, _, at = ty.sequence(step, classes)
                ok = flags[step.lo : step.hi][of[at]] & (place >= 0)
                p, q = at[ok], place[ok] * wide
                # before the first token of a row stands the end of another one
                held += [q + k[p + 1], q + c + np.where(p > 0, k[p - 1], classes)]
                listed = np.full(len(k), -1)
                listed[at] = place
                twice = listed[p + 1] == place[ok]
                held.append(q[twice] + 2 * c)
                pending += 2 * len(p)
                if pending > 2_000_000:
                    sums += np.bincount(np.concatenate(held), minlength=len(sums))
                    held, pending = [], 0
        if held:
            sums += np.bincount(np.concatenate(held), minlength=len(sums))
        of_block = np.array_split(np.arange(words), blocks)
        for b, some in enumerate(of_block):
            part = sums[some[0] * wide : (some[-1] + 1) * wide] if len(some) else sums[:0]
            i = np.flatnonzero(part)
            if len(i):
                yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int32()), "i": pa.array([i.astype(np.int32).tobytes()], pa.binary()), "n": pa.array([part[i].tobytes()], pa.binary())})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        i, n = (np.concatenate([np.frombuffer(x, t) for x in pdf[col]]) for col, t in (("i", np.int32), ("n", np.int64)))
        u, inverse = np.unique(i, return_inverse=True)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "i": [u.tobytes()], "n": [np.bincount(inverse, n, len(u)).astype(np.int64).tobytes()]})

    out = np.zeros((words, wide), np.int64)
    starts = [some[0] if len(some) else 0 for some in np.array_split(np.arange(words), blocks)]
    layout = "block int, i binary, n binary"
    for r in rows.mapInArrow(gather, layout).groupBy("block").applyInPandas(add, layout).collect():
        out.reshape(-1)[np.frombuffer(r.i, np.int32) + starts[r.block] * wide] = np.frombuffer(r.n, np.int64)
    return out[:, :c], out[:, c : 2 * c], out[:, 2 * c]


def _class_bigrams(rows: DataFrame, typer: Typer, classes: int) -> np.ndarray:
    """Training counts of class bigrams; before the first token of a text stands an end."""
    sent = rows.sparkSession.sparkContext.broadcast(typer)
    c = classes + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ty, pairs = sent.value, np.zeros(c * c, np.int64)
        for batch in batches:
            flags = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for step in text_steps(batch.column(1)):
                k, of, _, _, _ = ty.sequence(step, classes)
                ok = flags[step.lo : step.hi][of]
                pairs += np.bincount((np.concatenate([[classes], k[:-1]]) * c + k)[ok], minlength=c * c)
        i = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(pairs[i])], names=["i", "n"])

    out = np.zeros(c * c, np.int64)
    for r in rows.mapInArrow(count, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
        out[r.i] = r.n
    return out.reshape(c, c)
