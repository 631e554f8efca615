"""Benchmark decontamination by winnowing.

Method. Every text becomes a sequence of 64-bit word hashes. Of the `gram`-word hashes in
each run of `window - gram + 1` the smallest is kept (ties: all). Two texts that share
`window` words share such a run and so its minimum: joining the kept fingerprints finds every
shared span of `window` words. Each joint fingerprint is then extended to both sides while
words agree, and spans of at least `window` words become hits. Test items shorter than
`window` words have no full run; each is looked up by the hash of all its words.

Scale. Documents are read once for each block of test items and never shuffled. The fingerprints
of a block are sent to the executors; a block holds `block_words` words at most (or one item),
so what is sent has a fixed bound, and a larger test set is worked off in several blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import grams, text_steps
from .scratch import materialise, small_batches

HITS = T.StructType(
    [
        T.StructField("row", T.LongType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)
_ARROW = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int32()))), ("items", pa.list_(pa.string()))])


def winnow(h: np.ndarray, span: int) -> np.ndarray:
    """Mask of the values that are the smallest of some `span` consecutive ones."""
    n = len(h) - span + 1
    keep = np.zeros(len(h), bool)
    if n <= 0:
        return keep
    least = h[:n].copy()
    for j in range(1, span):
        np.minimum(least, h[j : j + n], out=least)
    for j in range(span):
        keep[j : j + n] |= h[j : j + n] == least
    return keep


class Index:
    """Fingerprints of a block of test items."""

    def __init__(self, items: list[tuple[str | None, str]], window: int, gram: int):
        self.window, self.gram, self.ids, words = window, gram, [], []
        for item, text in items:
            for step in text_steps(pa.array([text], pa.large_string())):
                h = step.words("alnum").hashes()
                if len(h):
                    self.ids.append(item)
                    words.append(h)
        self.words = words
        self.short: dict[int, dict[int, list[int]]] = {}
        prints: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i, h in enumerate(words):
            if len(h) < window:
                self.short.setdefault(len(h), {}).setdefault(int(grams(h, len(h))[0]), []).append(i)
            else:
                g = grams(h, gram)
                at = np.flatnonzero(winnow(g, window - gram + 1))
                prints.append((g[at], np.full(len(at), i), at))
        self.hash = np.concatenate([p[0] for p in prints]) if prints else np.empty(0, np.uint64)
        order = np.argsort(self.hash, kind="stable")
        self.hash = self.hash[order]
        self.item = (np.concatenate([p[1] for p in prints]) if prints else np.empty(0, np.int64))[order]
        self.at = (np.concatenate([p[2] for p in prints]) if prints else np.empty(0, np.int64))[order]
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.hash >> np.uint64(44)).astype(np.int64)] = True
        self.short_keys = {m: np.sort(np.array(list(x), np.uint64)) for m, x in self.short.items()}

    def hits(self, h: np.ndarray, of: np.ndarray) -> dict[int, tuple[set[tuple[int, int]], set[int]]]:
        """Hit spans (words of the row) and item numbers of the rows that have any. h: word hashes; of: word range of each row."""
        found: dict[int, tuple[set, set]] = {}
        at_row, seen = -1, {}
        if len(self.hash) and len(h) >= self.window:
            g = grams(h, self.gram)
            keep = self.sieve[(g >> np.uint64(44)).astype(np.int64)]  # the sieve first: most k-grams end here
            pos = np.flatnonzero(keep)
            if len(pos):
                lo = np.searchsorted(self.hash, g[pos])
                ok = lo < len(self.hash)
                ok[ok] = self.hash[lo[ok]] == g[pos[ok]]
                pos, lo = pos[ok], lo[ok]
                pos, lo = self._winnowed(g, of, pos, lo)
                for p, first in zip(pos.tolist(), lo.tolist(), strict=True):
                    row = int(np.searchsorted(of, p, "right")) - 1
                    if row != at_row:
                        at_row, seen = row, {}
                    key, j = self.hash[first], first
                    while j < len(self.hash) and self.hash[j] == key:
                        item, q = int(self.item[j]), int(self.at[j])
                        if p >= seen.get((item, p - q), -1):  # else an earlier extension on this diagonal went past here
                            seen[item, p - q] = self._extend(h, int(of[row]), int(of[row + 1]), p, item, q, found.setdefault(row, (set(), set())))
                        j += 1
        for m, keys in self.short_keys.items():
            if len(h) < m:
                continue
            g = grams(h, m)
            at = np.searchsorted(keys, g)
            at[at == len(keys)] = 0
            for p in np.flatnonzero(keys[at] == g).tolist():
                row = int(np.searchsorted(of, p, "right")) - 1
                if p + m <= of[row + 1]:
                    spans, items = found.setdefault(row, (set(), set()))
                    spans.add((p - int(of[row]), p - int(of[row]) + m))
                    items.update(self.short[m][int(g[p])])
        return {r: x for r, x in found.items() if x[0]}

    def _winnowed(self, g: np.ndarray, of: np.ndarray, pos: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the candidate positions those that winnowing keeps within their row."""
        span, keep = self.window - self.gram + 1, np.zeros(len(pos), bool)
        row = np.searchsorted(of, pos, "right") - 1
        first, last = of[row], of[row + 1] - self.gram  # k-grams that lie within the row
        for shift in range(span):  # the run that begins `shift` before the position
            a = pos - shift
            ok = (a >= first) & (a + span - 1 <= last)
            if ok.any():
                runs = g[a[ok][:, None] + np.arange(span)]
                keep[ok] |= runs.min(axis=1) == g[pos[ok]]
        return pos[keep], lo[keep]

    def _extend(self, h: np.ndarray, begin: int, end: int, p: int, item: int, q: int, to: tuple[set, set]) -> int:
        other = self.words[item]
        left = 0
        while p - left > begin and q - left > 0 and h[p - left - 1] == other[q - left - 1]:
            left += 1
        right = 0
        while p + right < end and q + right < len(other) and h[p + right] == other[q + right]:
            right += 1
        if left + right >= self.window:
            to[0].add((p - left - begin, p + right - begin))
            to[1].add(item)
        return p + right


def _merged(spans: set[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[str | None, str]]]:
    """Blocks of test items, each of bounded length, fetched one row group after the other."""
    block, room = [], block_words
    rows = benchmark.select(F.col(id_col).cast("string"), F.col(text_col)).where(F.col(text_col).isNotNull())
    for item, text in rows.toLocalIterator():
        n = len(text) // 2 + 1  # words at most
        if block and n > room:
            yield block
            block, room = [], block_words
        block.append((item, text))
        room -= n
    yield block


def benchmark_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    gram: int = 5,
    block_words: int = 4_000_000,
) -> DataFrame:
    """One row per document row: doc_id, n_words, spans (word ranges that occur in test items, merged), items (sorted distinct ids).

    Null and empty texts have no words, no spans and no items; rows that repeat are all returned;
    a null document id stays null. Items without text or words have no windows; those of an item without id count as hits but give no item;
    an empty test set leaves no hits. Several blocks need documents that give the same rows at each read (a table, not a random order).
    Other columns of either table are not looked at. block_words bounds what is sent to an executor at once.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    parts = []
    blocks = _blocks(benchmark, item_col, item_text_col, block_words)
    block = next(blocks)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    while block is not None:
        following = next(blocks, None)
        index = spark.sparkContext.broadcast(Index(block, window, gram))

        def scan(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            row = TaskContext.get().partitionId() << 40
            for batch in batches:
                ids = batch.column(0)
                for step in text_steps(batch.column(1)):
                    w = step.words("alnum")
                    found = index.value.hits(w.hashes(), w.of)
                    n = step.hi - step.lo
                    names = [sorted({index.value.ids[i] for i in found[r][1]} - {None}) if r in found else [] for r in range(n)]
                    spans = [_merged(found[r][0]) if r in found else [] for r in range(n)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.arange(row, row + n)), ids.slice(step.lo, n).cast(pa.int64()), pa.array(np.diff(w.of).astype(np.int64)), pa.array(spans, _ARROW.field("spans").type), pa.array(names, _ARROW.field("items").type)], schema=_ARROW
                    )
                    row += n

        part = source.mapInArrow(scan, HITS)
        if following is not None or parts:  # one block at a time: its fingerprints go before the next ones come
            part = materialise(part, "decontam")
            index.destroy()
        parts.append(part)
        block = following
    if len(parts) == 1:
        return parts[0].drop("row")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    out = out.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = F.aggregate(
        "s",
        F.array().cast("array<array<int>>"),
        lambda a, x: F.when(
            (F.size(a) > 0) & (F.element_at(F.element_at(a, -1), 2) >= x[0]),
            F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.array(F.element_at(a, -1)[0], F.greatest(F.element_at(a, -1)[1], x[1])))),
        ).otherwise(F.concat(a, F.array(x))),
    )
    return out.select("doc_id", "n_words", joined.alias("spans"), "items")


def clean_rows(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, gram: int = 5, block_words: int = 4_000_000) -> DataFrame:
    """The rows of docs, all columns, in which no window of a test item occurs. Rows without words stay; see benchmark_hits."""
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    where = docs.columns.index(text_col)
    blocks = _blocks(benchmark, item_col, item_text_col, block_words)
    block = next(blocks)
    while block is not None:
        following = next(blocks, None)
        index = spark.sparkContext.broadcast(Index(block, window, gram))

        def scan(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for step in text_steps(batch.column(where)):
                    w = step.words("alnum")
                    clean = np.ones(step.hi - step.lo, bool)
                    clean[list(index.value.hits(w.hashes(), w.of))] = False
                    yield batch.slice(step.lo, step.hi - step.lo).filter(pa.array(clean))

        docs = docs.mapInArrow(scan, docs.schema)
        if following is not None:  # one block at a time
            docs = materialise(docs, "decontam")
            index.destroy()
        block = following
    return docs


def n_hit(spans: str = "spans"):
    """Column: words within any span."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + (x[1] - x[0]).cast("long"))


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
