"""Quality classifier by compression.

Method. Two zstandard dictionaries are trained, one on good and one on bad labelled text. A text
is compressed with each; the difference of the two sizes, normalised by the text's length, says
which dictionary knows it better. A logistic calibration over that difference and the plain
compressed ratio, fitted on labelled rows that did not go into the dictionaries, gives the score.

Scale. Fitting sees a bounded sample (`sample_per_class` rows of at most `sample_chars` characters
per class, the smallest hashes of doc_id). Scoring is one map over the table: no shuffle; the two dictionaries
(`dict_bytes` each) and a few numbers go to the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import small_batches

LEVEL = 3


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray


class _Sizer:
    def __init__(self, model: QualityModel):
        self.good, self.bad = (zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(d), level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False) for d in (model.good, model.bad))
        self.plain = zstd.ZstdCompressor(level=LEVEL, write_content_size=False)

    def features(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros((len(texts), 3))
        for i, t in enumerate(texts):
            out[i] = len(self.good.compress(t)), len(self.bad.compress(t)), len(t)
        good, bad, n = out.T
        n1 = np.maximum(n, 1)
        diff, ratio = (bad - good) / n1, good / n1
        size = np.log1p(n)
        rel = (bad - good) / (bad + good)
        return np.column_stack([diff, rel, ratio, bad / n1, size, diff * size, ratio * size, rel * size, ratio**2, diff**2 * np.sign(diff), size**2])


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method; the ridge leaves the intercept alone."""
    x = np.column_stack([np.ones(len(x)), x])
    w, r = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    r[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(r)
        step = np.linalg.solve(h, x.T @ (p - y) + r * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_quality(labelled: DataFrame, share: float | None = None, *, text_col: str = "text", label_col: str = "label", order_col: str = "doc_id", sample_per_class: int = 1500, sample_chars: int = 40_000, dict_bytes: int = 112_640) -> QualityModel:
    """Fit on a bounded sample of labelled rows (label 1 good, 0 bad; others and null texts are left out).

    Bound: sample_per_class rows a class, each of at most sample_chars characters (longer rows are not drawn).
    share: part of good rows among all labelled ones, by default counted over the rows given. The sample has about as many rows of either
    class, whatever their shares; the intercept is moved from the sample's odds to those of all, so scores mean the same at every size.
    With a class missing, the model knows no difference and scores the share of good rows.
    """
    rows = labelled.select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label"), F.xxhash64(F.col(order_col).cast("string")).alias("h"), F.col(order_col).alias("o")).where(F.col("text").isNotNull() & (F.length("text") <= sample_chars))
    classes = {}
    for label in (0, 1):
        got = rows.where(F.col("label") == label).orderBy("h", "o", "text").limit(sample_per_class).collect()
        classes[label] = [r.text.encode() for r in got]
    share = good_share(labelled, label_col) if share is None else min(max(share, 1e-6), 1 - 1e-6)
    half = {k: (v[::2], v[1::2]) for k, v in classes.items()}
    if min(len(v) for v in classes.values()) < 8:
        return QualityModel(b"", b"", np.array([np.log(share / (1 - share))]), np.zeros(0), np.ones(0))
    dicts = {k: _dictionary(v[0], dict_bytes) for k, v in half.items()}
    model = QualityModel(dicts[1], dicts[0], np.zeros(0), np.zeros(0), np.ones(0))
    sizer = _Sizer(model)
    x = np.concatenate([sizer.features(half[0][1]), sizer.features(half[1][1])])
    y = np.concatenate([np.zeros(len(half[0][1])), np.ones(len(half[1][1]))])
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-9
    model.weights = _logistic((x - model.mean) / model.scale, y)
    model.weights[0] += np.log(share / (1 - share)) - np.log(y.sum() / (len(y) - y.sum()))
    return model


def good_share(labelled: DataFrame, label_col: str = "label") -> float:
    """Part of good rows among all labelled ones, smoothed by one of each class."""
    label = F.col(label_col).cast("int")
    r = labelled.agg(F.count(F.when(label == 1, 1)).alias("good"), F.count(F.when(label == 0, 1)).alias("bad")).first()
    return (r.good + 1) / (r.good + r.bad + 2)


def _dictionary(texts: list[bytes], size: int) -> bytes:
    parts = [t[i : i + 4096] for t in texts for i in range(0, len(t), 4096)]
    total = sum(map(len, parts))
    try:
        return zstd.train_dictionary(max(256, min(size, total // 8)), parts).as_bytes()
    except zstd.ZstdError:  # too little text for the trainer: plain content is a dictionary as well
        return b"".join(parts)[-size:]


def score_quality(docs: DataFrame, model: QualityModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1, higher is better) of every row, whole texts; null texts count as empty."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        sizer = _Sizer(m) if m.good else None
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                if sizer:
                    x = sizer.features([(t or "").encode("utf-8", "surrogatepass") for t in part.column(1).to_pylist()])
                    z = m.weights[0] + ((x - m.mean) / m.scale) @ m.weights[1:]
                else:
                    z = np.full(part.num_rows, m.weights[0])
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
