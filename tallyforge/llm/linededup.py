"""Substring dedup by hashing lines and the sentences within them.

Method. A unit is a sentence within a line (a line without sentence ends is one unit; very long ones are cut by their content), normalised to
its lower-cased words of letters and digits. Digests (128 bits) of units of `unit_words` words or more are grouped over the whole corpus; the earliest ranked occurrence
(doc_id, then text, then place) stays. Later occurrences that follow on each other make a run - shorter units between them
go along - and a run of `run_words` words or more is removed. What is removed is reported with its offsets in the original text.
Passages are found by their inner sentences wherever they stand in a line.

Scale. A scan task sends only its first occurrence of each digest, so a line that a third of all documents share comes to its bucket once for each
task. Buckets hold `bucket_units` units or so as packed arrays. Only the places of later occurrences go on, joined back to the texts by an
equi-join on the document (the one shuffle of texts).

Lines. With `lines` every unit is hashed, whatever its length: a short piece together with its neighbours in the line, a short line alone. Each character
of a script without spaces is a word then (half a one in sizes), and only later occurrences go, nothing between them. A run also goes if it has a
whole line and either two units or `line_chars` characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import WORD_CLASSES, Step, Words, mix, text_steps
from .scratch import materialise, small_batches

_LAST = (1 << 63) - 1


#: Sentences of more words than this are cut further, after word pairs whose hash says so (one in eight), so that equal stretches are cut alike.
LONG = 24


class Units:
    """Units of a step: row, place in the row, words, line, byte range and digest of each. Units without words are none.

    With lines, pieces of less than unit_words words have the digest of themselves and the pieces beside them in the line.
    """

    def __init__(self, step: Step, lines: bool = False, unit_words: int = 0):
        data, w = step.data, step.words("alnum")
        n = len(data)
        half, marks = _single_characters(w) if lines else (None, np.empty(0, np.int64))
        after = np.zeros(n, bool)
        after[:-1] = WORD_CLASSES["alnum"][data[1:]]
        ends = ((data == 46) | (data == 33) | (data == 63)) & ~after
        stop = np.flatnonzero(ends | (data == 10) | (data == 13)) + 1
        stop = np.union1d(stop, np.concatenate([step.at[1:], marks]))  # and where a row ends
        part = np.searchsorted(stop, w.begin, "right")
        h = w.hashes()
        opens = np.ones(len(part), bool)
        opens[1:] = part[1:] != part[:-1]
        size = np.diff(np.concatenate([np.flatnonzero(opens), [len(part)]]))
        cut = np.zeros(len(part), bool)
        cut[1:] = mix(h[:-1] + np.uint64(3) * h[1:]) & np.uint64(7) == 0
        first = np.flatnonzero(opens | (cut & np.repeat(size > LONG, size)))
        self.row = np.searchsorted(w.of, first, "right") - 1
        self.words = np.diff(np.concatenate([first, [len(part)]]))
        self.place = np.arange(len(first)) - np.searchsorted(first, w.of)[self.row]
        self.begin, self.end = w.begin[first], stop[part[first]]
        inner = np.flatnonzero(part[first[1:]] == part[first[:-1]])  # a cut sentence goes on: up to the next word
        self.end[inner] = self.begin[inner + 1]
        order = np.arange(len(h)) - np.repeat(first, self.words) + 1
        lanes = []
        for seed in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            v = mix(h + order.astype(np.uint64) * np.uint64(seed))
            lanes.append(mix(np.add.reduceat(v, first) + self.words.astype(np.uint64)) if len(first) else h[:0])
        self.a, self.b = lanes
        breaks = np.union1d(np.flatnonzero((data == 10) | (data == 13)) + 1, step.at[1:])
        self.line = np.searchsorted(breaks, self.begin, "right")
        self.line_at = np.concatenate([[0], breaks])
        self.size = self.words if half is None or not len(first) else self.words - np.add.reduceat(half, first) / 2
        if lines and len(first):
            self.a, self.b = self._in_context(unit_words)

    def _in_context(self, unit_words: int) -> list[np.ndarray]:
        """Digests in which pieces of less than unit_words words have further pieces of their line, next ones first, until there are so many words."""
        n, lanes, size = len(self.line), [self.a.copy(), self.b.copy()], np.array(self.size, float)
        for way in [*range(1, int(unit_words) + 1), *range(-1, -int(unit_words) - 1, -1)]:
            i = np.flatnonzero(size < unit_words)
            i = i[(i + way >= 0) & (i + way < n)]
            i = i[self.line[i + way] == self.line[i]]
            for x, own in zip(lanes, (self.a, self.b), strict=True):
                x[i] = mix(x[i] + np.uint64(3) * own[i + way] + np.uint64(way + 2 * int(unit_words)))
            size[i] += self.size[i + way]
        return lanes

    def widened(self, a: int, b: int, i: int, j: int, offset: int, lo: int, hi: int) -> tuple[int, int]:
        """lo and hi, moved to where the lines of units i and j begin and end if all their units are among i to j. a, b: units of the row."""
        start, stop = np.searchsorted(self.line[a:b], self.line[[i, j]], "left") + a, np.searchsorted(self.line[a:b], self.line[[i, j]], "right") + a
        if start[0] == i and stop[0] <= j + 1:
            lo = int(self.line_at[self.line[i]] - offset)
        if stop[1] == j + 1 and start[1] >= i:
            hi = int(self.line_at[self.line[j] + 1] - offset)
        return lo, hi


def _single_characters(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Make each character of a script without spaces (Han, kana, Thai, Lao, Burmese, Khmer) a word of its own, and each mark of their punctuation.

    Returns which words are such, and where sentences end by a full-width mark.
    """
    data, n = w.step.data, len(w.step.data)
    if not (data >= 0xE0).any():
        return np.zeros(len(w.begin), bool), np.empty(0, np.int64)
    x, y, z = data, np.append(data[1:], np.uint8(0)), np.append(data[2:], np.zeros(min(n, 2), np.uint8))[:n]
    han4 = (x == 0xF0) & (y >= 0xA0)
    lead = han4 | ((x >= 0xE3) & (x <= 0xE9)) | ((x == 0xE0) & (y >= 0xB8) & (y <= 0xBB)) | ((x == 0xE1) & ((y >= 0x80) & (y <= 0x82) | (y >= 0x9E) & (y <= 0x9F))) | ((x == 0xEF) & ((y == 0xBC) | (y == 0xBD)))
    at = np.flatnonzero(lead)
    forced = np.zeros(n + 1, bool)
    forced[at] = True
    forced[np.minimum(at + np.where(han4[at], 4, 3), n)] = True
    opens, closes = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    opens[w.begin], closes[w.end] = True, True
    inside = np.cumsum(opens[:n].astype(np.int8) - closes[:n].astype(np.int8), dtype=np.int64) > 0
    new = forced[:n] & inside
    w.begin = np.flatnonzero(opens[:n] | new)
    w.end = np.union1d(w.end, np.flatnonzero(new[1:] & inside[:-1]) + 1)
    w.of = np.searchsorted(w.begin, w.step.at)
    ends = ((x == 0xE3) & (y == 0x80) & (z == 0x82)) | ((x == 0xEF) & (y == 0xBC) & ((z == 0x81) | (z == 0x9F)))
    return lead[w.begin], np.flatnonzero(ends) + 3


def _firsts(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the keys (the first two are the digest) and a mask of the first entry of each digest in that order."""
    order = np.lexsort(keys[::-1])
    a, b = keys[0][order], keys[1][order]
    first = np.ones(len(order), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, first


def repeated_places(docs: DataFrame, unit_words: int, bucket_units: int, lines: bool = False) -> DataFrame:
    """rank, mark and places (array of unit places) of later occurrences. docs: rank, text, mark (hash of the text)."""
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(1, -(-int(size) // (40 * bucket_units)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        pending = 0

        def packed() -> Iterator[pa.RecordBatch]:
            if not pending:
                return
            a, b, rank, mark, place = (np.concatenate(x) for x in zip(*held, strict=True))
            order, first = _firsts(a, b, rank, mark, place)
            rank_, mark_ = rank[order], mark[order]
            lead = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
            same = (rank_ == rank_[lead]) & (mark_ == mark_[lead]) & (place[order] == place[order][lead])
            later = order[~first & ~same]
            for r, m, p in _by_document(rank[later], mark[later], place[later]):
                out.append((None, r, m, p, None))
            keep = order[first]
            bucket = ((a[keep] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            keep = keep[np.argsort(bucket, kind="stable")]
            bucket = np.sort(bucket)
            cut = np.flatnonzero(np.diff(bucket)) + 1
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(keep)], strict=True):
                i = keep[lo:hi]
                out.append((int(bucket[lo]), None, None, None, b"".join(x[i].tobytes() for x in (a, b, rank, mark, place.astype(np.int64)))))
            for lo in range(0, len(out), 2000):
                part = out[lo : lo + 2000]
                yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in part], t) for j, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary()))], names=["bucket", "rank", "mark", "places", "data"])
            out.clear()

        out: list[tuple] = []
        for batch in batches:
            ranks, marks = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for step in text_steps(batch.column(1)):
                u = Units(step, lines, unit_words)
                ok = u.words >= (1 if lines else unit_words)
                row = step.lo + u.row[ok]
                held.append((u.a[ok], u.b[ok], ranks[row], marks[row], u.place[ok]))
                pending += int(ok.sum())
                if pending > 400_000:
                    yield from packed()
                    held, pending = [], 0
        yield from packed()

    scanned = materialise(docs.select("rank", "text", "mark").mapInArrow(scan, "bucket int, rank long, mark long, places array<int>, data binary"), "units")

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(x, np.uint64).reshape(5, -1) for x in pdf["data"]]
        a, b, rank, mark, place = np.concatenate(parts, axis=1)
        rank, mark, place = rank.view(np.int64), mark.view(np.int64), place.view(np.int64)
        order, first = _firsts(a, b, rank, mark, place)
        lead = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        rank, mark, place = rank[order], mark[order], place[order]
        later = ~first & ((rank != rank[lead]) | (mark != mark[lead]) | (place != place[lead]))
        return pd.DataFrame(_by_document(rank[later], mark[later], place[later]), columns=["rank", "mark", "places"])

    found = scanned.where("bucket is not null").select("bucket", "data").groupBy("bucket").applyInPandas(settle, "rank long, mark long, places array<int>")
    return scanned.where("bucket is null").select("rank", "mark", "places").union(found).groupBy("rank", "mark").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))


def _by_document(rank: np.ndarray, mark: np.ndarray, place: np.ndarray) -> list[tuple[int, int, list[int]]]:
    if not len(rank):
        return []
    order = np.lexsort((place, mark, rank))
    rank, mark, place = rank[order], mark[order], place[order]
    cut = np.flatnonzero((np.diff(rank) != 0) | (np.diff(mark) != 0)) + 1
    return [(int(rank[lo]), int(mark[lo]), place[lo:hi].tolist()) for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(rank)], strict=True)]


def runs(places: np.ndarray, words: np.ndarray, unit_words: int, run_words: int) -> list[tuple[int, int]]:
    """First and last unit of each run to remove. words: of every unit of the text; places: later occurrences."""
    eligible = np.flatnonzero(words >= unit_words)
    later = np.isin(eligible, places)
    out, i = [], 0
    while i < len(eligible):
        if later[i]:
            j = i
            while j + 1 < len(eligible) and later[j + 1]:
                j += 1
            if words[eligible[i : j + 1]].sum() >= run_words:
                out.append((int(eligible[i]), int(eligible[j])))
            i = j
        i += 1
    return out


def _characters(step: Step, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Characters of each byte range; the ranges are of one row and in order."""
    if not len(begin):
        return begin
    starts = np.concatenate([[0], np.cumsum((step.data[begin[0] : end[-1]] & 0xC0) != 0x80)])
    return starts[end - begin[0]] - starts[begin - begin[0]]


def line_runs(places: np.ndarray, size: np.ndarray, chars: np.ndarray, line: np.ndarray, run_words: int, line_chars: int) -> list[tuple[int, int]]:
    """First and last unit of each run of later occurrences of run_words words, or with a whole line and two units or line_chars characters."""
    n = len(size)
    later = np.zeros(n + 1, bool)
    later[places] = True
    turn = np.flatnonzero(np.diff(later.astype(np.int8), prepend=0))
    first, last = np.append(True, line[1:] != line[:-1]), np.append(line[1:] != line[:-1], True)
    out = []
    for i, j in zip(turn[::2].tolist(), (turn[1::2] - 1).tolist(), strict=True):
        s = np.flatnonzero(first[i : j + 1])
        whole = len(s) and last[i + s[0] : j + 1].any()
        if size[i : j + 1].sum() >= run_words or (whole and (j > i or chars[i] >= line_chars)):
            out.append((i, j))
    return out


def dedup_units(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", unit_words: int = 4, run_words: int = 10, bucket_units: int = 500_000, lines: bool = False, line_chars: int = 16) -> DataFrame:
    """doc_id, n_units, n_removed (units), text (what stays), spans: array of (start, stop) removed from the original, in code points.

    Null texts stay null without units; empty texts have none. Rows that repeat (same id and text) are one document and get the same result.
    A row without id ranks after all others. Ties cannot arise: the rank is (doc_id, hash of the text, place).
    """
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    base = base.withColumns({"rank": F.coalesce("doc_id", F.lit(_LAST)), "mark": F.xxhash64(F.coalesce("text", F.lit("")))})
    places = repeated_places(base, unit_words, bucket_units, lines)
    joined = base.join(places.withColumnsRenamed({"rank": "rank_", "mark": "mark_"}), (F.col("rank") == F.col("rank_")) & (F.col("mark") == F.col("mark_")), "left").select("doc_id", "text", "places")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
        for batch in batches:
            ids, texts, marked = batch.column(0), batch.column(1), batch.column(2)
            for step in text_steps(texts):
                u, n = Units(step, lines, unit_words), step.hi - step.lo
                of = np.searchsorted(u.row, np.arange(n + 1))
                kept, spans, removed = texts.slice(step.lo, n).to_pylist(), [[] for _ in range(n)], [0] * n
                for r, where in enumerate(marked.slice(step.lo, n).to_pylist()):
                    if where:
                        a, b = of[r], of[r + 1]
                        raw, at, parts = step.raw(r), 0, []
                        offset = step.at[r]
                        found = line_runs(np.array(where), u.size[a:b], _characters(step, u.begin[a:b], u.end[a:b]), u.line[a:b], run_words, line_chars) if lines else runs(np.array(where), u.words[a:b], unit_words, run_words)
                        for i, j in found:
                            lo, hi = int(u.begin[a + i] - offset), int(u.end[a + j] - offset)
                            if lines:
                                lo, hi = u.widened(a, b, a + i, a + j, offset, lo, hi)
                            removed[r] += j - i + 1
                            spans[r].append({"start": len(raw[:lo].decode("utf-8", "replace")), "stop": len(raw[:hi].decode("utf-8", "replace"))})
                            parts.append(raw[at:lo])
                            at = hi
                        if parts:
                            kept[r] = b"".join([*parts, raw[at:]]).decode("utf-8", "replace")
                yield pa.RecordBatch.from_arrays([ids.slice(step.lo, n), pa.array(np.diff(of).astype(np.int64)), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(kept, pa.string())], names=["doc_id", "n_units", "n_removed", "spans", "text"])

    return joined.mapInArrow(cut, "doc_id long, n_units long, n_removed long, spans array<struct<start:int,stop:int>>, text string")
