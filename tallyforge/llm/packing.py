"""Packing into optimal length buckets.

Method. Texts longer than the context are cut into pieces of at most `max_tokens` tokens. A global histogram of piece lengths has one row for
each length, max_tokens at most. Dynamic programming over it chooses `buckets` boundaries so that padding every piece up to its bucket's boundary costs the
fewest tokens. In each bucket batches of token_budget // boundary pieces form in the order of a digest of document id, piece and text.

Scale. The histogram is an aggregation with map-side combine. Batch numbers are global places in a bucket without a global sort: pieces are
dealt to slices by that digest, slices have `slice_rows` rows or so, and a prefix sum over the small table of slice sizes gives each slice its first place.
Rows that repeat (also without id) are counted map-side, take one row of a slice together, and are written out `COPIES` at a time.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .scratch import materialise

COPIES = 10_000


def choose_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Boundaries (ascending, the last is the largest length) that minimise the padding; of equal ones the smallest boundaries, from the last bucket down.

    Fewer lengths than buckets: every length is a boundary.
    """
    order = np.argsort(lengths)
    x, c = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    n = len(x)
    if n <= buckets:
        return x.tolist()
    total, mass = np.concatenate([[0], np.cumsum(c)]), np.concatenate([[0], np.cumsum(c * x)])
    big = np.iinfo(np.int64).max // 4
    best, back = np.full(n + 1, big), np.zeros((buckets + 1, n + 1), np.int64)
    best[0] = 0
    for k in range(1, buckets + 1):
        now = np.full(n + 1, big)
        for j in range(k, n + 1):  # the bucket ends with length j - 1
            i = np.arange(k - 1, j)
            cost = best[i] + x[j - 1] * (total[j] - total[i]) - (mass[j] - mass[i])
            at = int(cost.argmin())
            now[j], back[k, j] = cost[at], i[at]
        best = now
    out, j = [], n
    for k in range(buckets, 0, -1):
        out.append(int(x[j - 1]))
        j = int(back[k, j])
    return out[::-1]


def word_count(text: Column) -> Column:
    """Tokens as runs without ASCII white space; 0 for null and empty texts."""
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return F.length(F.regexp_replace(squeezed, r"[\x20\x09-\x0D]+", "")).cast("long")


def pack(docs: DataFrame, n_tokens: Column | None = None, *, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 2048, buckets: int = 8, token_budget: int = 16_384, slice_rows: int = 4_000) -> DataFrame:
    """One row for each piece: doc_id, piece, start, n_tokens, bucket, bucket_tokens, batch_id, slot.

    n_tokens: tokens of a text (default: words). Every token is in exactly one piece; texts without tokens (null, empty) have one piece of
    length 0. Rows that repeat are packed each on its own. Slots count from 0 in a batch; only the last batch of a bucket can be short.
    Equal pieces (same id and text) may swap places, which does not show. An empty table gives no rows.
    """
    count = F.coalesce(n_tokens if n_tokens is not None else word_count(F.col(text_col)), F.lit(0)).cast("long")
    whole = docs.select(F.col(id_col).cast("long").alias("doc_id"), count.alias("tokens"), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("mark"))
    whole = materialise(whole.groupBy("doc_id", "tokens", "mark").agg(F.count("*").alias("copies")), "lengths")
    pieces = whole.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("tokens") / max_tokens) - 1, F.lit(0))))).withColumn("start", F.col("piece") * max_tokens)
    pieces = pieces.select("doc_id", "mark", "copies", F.col("piece").cast("int").alias("piece"), "start", F.least(F.col("tokens") - F.col("start"), F.lit(max_tokens)).cast("int").alias("n_tokens"))
    histogram = pieces.groupBy("n_tokens").agg(F.sum("copies").alias("n")).toPandas()
    if not len(histogram):
        return pieces.select("doc_id", "piece", "start", "n_tokens", F.lit(0).alias("bucket"), F.lit(0).alias("bucket_tokens"), F.lit(0).cast("long").alias("batch_id"), F.lit(0).alias("slot"))
    lengths, counts = histogram["n_tokens"].to_numpy(), histogram["n"].to_numpy()
    bounds = choose_boundaries(lengths, counts, buckets)
    which = np.searchsorted(bounds, lengths)
    held = [int(counts[which == b].sum()) for b in range(len(bounds))]
    edges, slices = F.array(*map(F.lit, bounds)), F.array(*[F.lit(max(1, -(-h // slice_rows))) for h in held])
    per_batch = F.array(*[F.lit(max(1, token_budget // max(1, b))) for b in bounds])
    bucket = F.size(F.filter(edges, lambda e: e < F.col("n_tokens")))
    # the first 32 bits of the digest are uniform, so equal parts of their range are slices of about equal size, in order
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "piece", "mark"))
    dealt = pieces.withColumn("bucket", bucket).withColumn("h", F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")).withColumn("part", F.floor(F.col("h") * F.element_at(slices, F.col("bucket") + 1) / 4294967296).cast("int"))
    earlier = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    sizes = dealt.groupBy("bucket", "part").agg(F.sum("copies").alias("rows"))
    before = sizes.withColumn("before", F.coalesce(F.sum("rows").over(earlier(W.partitionBy("bucket").orderBy("part"))), F.lit(0))).select("bucket", "part", "before")
    here = F.coalesce(F.sum("copies").over(earlier(W.partitionBy("bucket", "part").orderBy("h", "doc_id", "piece", "mark"))), F.lit(0))
    placed = dealt.withColumn("here", here).join(before, ["bucket", "part"]).withColumn("first", F.col("before") + F.col("here"))
    some = placed.withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long"))))
    each = some.withColumn("at", F.explode(F.sequence(F.col("first") + F.col("lo"), F.col("first") + F.least(F.col("lo") + COPIES, F.col("copies")) - 1)))
    capacity = F.element_at(per_batch, F.col("bucket") + 1)
    return each.select("doc_id", "piece", "start", "n_tokens", "bucket", F.element_at(edges, F.col("bucket") + 1).alias("bucket_tokens"), F.floor(F.col("at") / capacity).cast("long").alias("batch_id"), (F.col("at") % capacity).cast("int").alias("slot"))
