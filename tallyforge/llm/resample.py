"""Resampling of documents towards a target distribution by hashed n-gram importance weights.

Method. The words of a text are lower-cased and joined by one space, and that stream is scanned once for its running CRC-32. The CRC of
any run of words follows from the running values at its two ends: over GF(2) the CRC of a prefix, moved on by the bytes of the run (a product
with a power of x), cancels out of the CRC of the longer prefix. So runs of one word or of many cost the same, whatever their length.
A feature's bucket is its CRC modulo `buckets`; the gain of a bucket is the logarithm of its smoothed share in the target over that in the
documents; a document's weight is the mean gain of its features, and Gumbel noise from a digest of its id makes the draw of the highest
scores a draw without replacement by weight.

Scale. Two scans of the documents and one of the target. The first adds up a histogram inside each task and sends `buckets` counts at most;
the driver holds two histograms and broadcasts `buckets` gains. Scores are whole numbers, so the draw needs the number of rows of each score only
(their range is bounded by the logarithms); rows of one score are put in order by their ids, each score in a partition of its own. Noise spreads rows
of one weight over some thousand scores, so no score holds more than about one row in 2,700, hot sources and copies or not.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .kernel import Step, text_steps
from .scratch import materialise, small_batches

#: The generator of CRC-32 (fixed value), bits in reflected order: the top bit is the coefficient of 1, the lowest that of x**31.
POLYNOMIAL = 0xEDB88320
_ONE = 0x80000000
#: Stretches of the stream that are scanned side by side.
LANES = 4096


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), t >> np.uint32(1)).astype(np.uint32)
    return t


_TABLE = _byte_table()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials over GF(2) modulo the generator, element by element."""
    a, b = np.broadcast_arrays(np.asarray(a, np.uint32), np.asarray(b, np.uint32))
    out, b = np.zeros(a.shape, np.uint32), b.copy()
    for bit in range(31, -1, -1):
        out ^= b * ((a >> np.uint32(bit)) & np.uint32(1))
        b = (b >> np.uint32(1)) ^ (np.uint32(POLYNOMIAL) * (b & np.uint32(1)))
    return out


def moves(n: int) -> np.ndarray:
    """x**(8 * i) for i below n at least: what a CRC is multiplied by when i bytes follow. Kept between calls, doubled when more are wanted."""
    while len(moves.known) < n:
        known = moves.known
        step = product(known[-1:], moves.byte)
        moves.known = np.concatenate([known, product(known, step)])
    return moves.known


moves.byte = np.array([_ONE >> 8], np.uint32)
moves.known = np.array([_ONE], np.uint32)


def shifted(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Each CRC moved on by so many bytes. Short moves are looked up, a byte of the CRC at a time."""
    out = np.empty(len(crc), np.uint32)
    short = by < SHORT
    c, at = crc[short], by[short] * 1024
    flat = _short_moves()
    out[short] = flat[at + (c & np.uint32(255))] ^ flat[at + 256 + ((c >> np.uint32(8)) & np.uint32(255))] ^ flat[at + 512 + ((c >> np.uint32(16)) & np.uint32(255))] ^ flat[at + 768 + (c >> np.uint32(24))]
    if not short.all():
        far = by[~short]
        out[~short] = product(crc[~short], moves(int(far.max()) + 1)[far])
    return out


#: Bytes below which a move is looked up.
SHORT = 256


@cache
def _short_moves() -> np.ndarray:
    """For each move below SHORT and each of the four bytes of a CRC, the 256 products."""
    byte = np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], np.uint32)
    return product(byte[None], moves(SHORT)[:SHORT, None, None]).reshape(-1)


def running_crc(data: np.ndarray) -> np.ndarray:
    """CRC (register from zero, not inverted) of each prefix of the bytes: n + 1 values.

    The stream is cut into lanes that are scanned side by side: first for their own sums, which then give what each lane begins with.
    """
    n = len(data)
    out = np.zeros(n + 1, np.uint32)
    if not n:
        return out
    lanes = min(LANES, max(1, n // 64))
    size = -(-n // lanes)
    padded = np.zeros(lanes * size, np.uint8)
    padded[:n] = data
    columns = np.ascontiguousarray(padded.reshape(lanes, size).T)
    low, eight = np.uint32(255), np.uint32(8)
    state = np.zeros(lanes, np.uint32)
    for column in columns:
        state = _TABLE[(state ^ column) & low] ^ (state >> eight)
    # what came before each lane: the earlier lanes' sums, each moved on by the lanes between, by doubling
    state = np.concatenate([np.zeros(1, np.uint32), state[:-1]])
    reach, move = 1, moves(size + 1)[size]
    while reach < lanes:
        state[reach:] ^= product(state[:-reach].copy(), move)
        reach, move = 2 * reach, product(move, move)
    inside = np.empty((size, lanes), np.uint32)
    for i, column in enumerate(columns):
        state = _TABLE[(state ^ column) & low] ^ (state >> eight)
        inside[i] = state
    out[1:] = inside.T.reshape(-1)[:n]
    return out


def ngram_crcs(step: Step, least: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a step of texts: number of words of each row, and row and CRC-32 (as zlib gives it) of every run of `least` to `most` words."""
    w = step.words("alnum")
    rows, sizes = w.rows(), w.end - w.begin
    count = np.diff(w.of)
    if not len(sizes):
        return count, np.empty(0, np.int64), np.empty(0, np.uint32)
    # the stream of all words of the step, each followed by one space; what stands before a run cancels out, so rows need no cut
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    end = begin + sizes
    stream = np.full(int(end[-1]) + 1, 0x20, np.uint8)
    total = int(sizes.sum())
    inside = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    stream[np.repeat(begin, sizes) + inside] = _LOWER[step.data[np.repeat(w.begin, sizes) + inside]]
    crc = running_crc(stream)
    found_rows, found = [], []
    for n in range(least, min(most, int(count.max())) + 1):
        first = np.flatnonzero(rows[: len(rows) - n + 1] == rows[n - 1 :])
        a, b = begin[first], end[first + n - 1]
        # the register begins with ones, which the bytes move on too, and is inverted at the end
        found.append(crc[b] ^ shifted(crc[a] ^ np.uint32(0xFFFFFFFF), b - a) ^ np.uint32(0xFFFFFFFF))
        found_rows.append(rows[first])
    return count, np.concatenate(found_rows) if found else np.empty(0, np.int64), np.concatenate(found) if found else np.empty(0, np.uint32)


def histogram(texts: DataFrame, *, text_col: str = "text", least: int = 1, most: int = 1, buckets: int = 10_000) -> np.ndarray:
    """Features of all texts by bucket. Summed inside each task first, so a task sends `buckets` rows at most; null texts have none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for step in text_steps(batch.column(0)):
                total += np.bincount(ngram_crcs(step, least, most)[2] % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    small_batches(texts.sparkSession)
    out = np.zeros(buckets, np.int64)
    for r in texts.select(F.col(text_col).cast("string")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Whole thousandths of the log ratio of each bucket's smoothed shares, floored."""
    k = len(target)
    t, s = float(target.sum()) + k, float(source.sum()) + k
    return np.array([math.floor(1000 * math.log((float(a) + 1) * s / ((float(b) + 1) * t))) for a, b in zip(target.tolist(), source.tolist(), strict=True)], np.int64)


def noise(id_: Column, seed: int) -> Column:
    """Gumbel noise in whole thousandths, from the first 32 bits of a digest of seed and id: the same in every run. A null id counts as empty text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def weigh(docs: DataFrame, gain: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text", least: int = 1, most: int = 1) -> DataFrame:
    """doc_id, n_words, n_features and weight (floored mean gain of the features, 0 without any) of every row."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(gain)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = sent.value
        for batch in batches:
            for step in text_steps(batch.column(1)):
                words, rows, crc = ngram_crcs(step, least, most)
                n = np.bincount(rows, minlength=len(words)).astype(np.int64)
                total = np.zeros(len(words), np.int64)
                np.add.at(total, rows, g[crc % np.uint32(len(g))])
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(step.lo, step.hi - step.lo), pa.array(words.astype(np.int64)), pa.array(n), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scan, "doc_id long, n_words long, n_features long, weight long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    least: int = 1,
    most: int = 1,
    buckets: int = 10_000,
    percent: int = 10,
    least_words: int = 20,
    seed: int = 2024,
) -> DataFrame:
    """Every row of docs: doc_id, n_words, n_features, weight, score, rank. rank is 1, 2, ... for the drawn `percent` of the rows with `least_words` words, else null.

    Features are all runs of `least` to `most` consecutive words. Ranks go by falling score, then id (null first), number of features and words; rows alike in all of
    that are drawn in any order. Null and empty texts have no words, weight 0 and a score, and are not drawn unless least_words is 0. Rows that repeat are scored, and
    may be drawn, each. Empty tables give no rows; an empty target leaves all gains to the documents' own shares. Other columns of either table are not looked at.
    """
    if not 0 < least <= most or buckets < 1 or not 0 <= percent <= 100:
        raise ValueError("least must be 1 or more and not above most, buckets 1 or more, percent within 0 and 100")
    options = {"least": least, "most": most}
    gain = gains(histogram(target, text_col=target_text_col, buckets=buckets, **options), histogram(docs, text_col=text_col, buckets=buckets, **options))
    rows = weigh(docs, gain, id_col=id_col, text_col=text_col, **options)
    rows = materialise(rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "weights")
    able = F.col("n_words") >= least_words
    counts = sorted(((r.score, r.n) for r in rows.where(able).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    wanted = percent * sum(n for _, n in counts) // 100
    before, seen = [], 0  # rows of higher scores, for each score that is drawn from
    for score, n in counts:
        if seen >= wanted:
            break
        before.append((score, seen))
        seen += n
    no_rank = F.lit(None).cast("long").alias("rank")
    if not before:
        return rows.select("*", no_rank)
    cut = F.lit(before[-1][0])
    # at most one row a score, and scores are whole thousandths of logarithms: a bounded table
    higher = F.broadcast(rows.sparkSession.createDataFrame(before, "score long, higher long"))
    place = F.row_number().over(W.partitionBy("score").orderBy("doc_id", "n_features", "n_words"))
    ranked = rows.where(able & (F.col("score") >= cut)).withColumn("place", place).join(higher, "score")
    rank = F.col("higher") + F.col("place")
    drawn = ranked.select(*rows.columns, F.when(rank <= wanted, rank).alias("rank"))
    return drawn.unionByName(rows.where(~able | (F.col("score") < cut)).select("*", no_rank))
