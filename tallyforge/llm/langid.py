"""Language identification with error-correcting output codes.

Method. Every language gets a codeword of bits. For each bit a binary classifier over hashed byte
2- and 3-grams is trained to predict it. A text's language is the codeword nearest to the
classifiers' outputs under logistic loss, each bit weighted by how well its classifier does on
training rows that it was not fitted on; a small gap to the second codeword flags the text as ambiguous.

Scale. One aggregation counts the languages, one filtered scan fetches a bounded sample, the rows with the smallest hashes of each language
(`sample_total` rows in all, `sample_per_lang` a language, none above `sample_chars` characters);
scoring is one map with a weight matrix of fixed size, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .kernel import Step, text_steps
from .scratch import small_batches

UNDETERMINED = "und"
#: Rows of counts that are held at a time.
STEP_ROWS = 256
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


@dataclass
class LangModel:
    langs: list[str]
    codes: np.ndarray  # languages x bits, -1 or 1
    weights: np.ndarray  # features x bits
    bias: np.ndarray
    bit_weight: np.ndarray
    features: int


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """n rows of -1 and 1: all distinct splits up to 5 languages, else the best of some random codes."""
    if n <= 1:
        return np.ones((n, 1), np.float32)
    if n <= 5:
        bits = 2 ** (n - 1) - 1
        return np.array([[1 if i == 0 or (b >> (i - 1)) & 1 == 0 else -1 for b in range(1, bits + 1)] for i in range(n)], np.float32)
    bits, rng, best = max(15, int(np.ceil(10 * np.log2(n)))), np.random.default_rng(seed), None
    for _ in range(50):
        c = rng.integers(0, 2, (n, bits)) * 2 - 1
        if (np.abs(c.sum(0)) == n).any():
            continue
        d = bits - np.abs(c @ c.T)
        least = (d + np.eye(n) * 2 * bits).min()
        if best is None or least > best[0]:
            best = least, c
    return best[1].astype(np.float32)


def gram_counts(step: Step, features: int) -> np.ndarray:
    """Rows x features: square roots of hashed 2- and 3-gram counts, scaled to length 1."""
    rows, n = len(step.at) - 1, len(step.data)
    out = np.zeros(rows * features)
    if n > 1:
        x = _FOLD[step.data].astype(np.uint32)
        of = np.repeat(np.arange(rows, dtype=np.int32), np.diff(step.at))
        for k in (2, 3):
            if n < k:
                continue
            m = n - k + 1
            g, low = x[:m].copy(), x[:m] == 32
            for j in range(1, k):
                g = g * np.uint32(257) + x[j : j + m]
                low &= x[j : j + m] == 32
            g = (g * np.uint32(2654435769)) >> np.uint32(32 - int(features).bit_length() + 1)
            ok = ~low & (of[:m] == of[k - 1 :])
            out += np.bincount(of[:m][ok].astype(np.int64) * features + g[ok], minlength=rows * features)
    out = np.sqrt(out.reshape(rows, features).astype(np.float32))
    return out / np.maximum(np.sqrt((out**2).sum(1, keepdims=True)), 1e-6)


def draw(rows: DataFrame, counts: dict[str, int], each: int) -> dict[str, list[str]]:
    """The texts of the `each` rows with the smallest h of each language, all rows of a language that has fewer. rows: text, lang, h (62 bits).

    Each language has a hash limit of its own, below which `each` rows are nearly sure to be; one with less (rows that repeat share a hash) is read again with a wider limit.
    """
    top, open_, wide = (1 << 62) - 1, dict(counts), 1
    texts: dict[str, list[str]] = {}
    place = F.row_number().over(W.partitionBy("lang").orderBy("h"))
    while open_:
        limits = F.create_map(*[x for k, n in open_.items() for x in (F.lit(k), F.lit(min(top, top * wide * (13 * each + 640) // (10 * n))))])
        got: dict[str, list] = {k: [] for k in open_}
        for r in rows.where(F.col("h") <= F.element_at(limits, F.col("lang"))).withColumn("i", place).where(F.col("i") <= each).collect():
            got[r.lang].append((r.i, r.text))
        texts |= {k: [t for _, t in sorted(v)] for k, v in got.items() if len(v) >= min(each, open_[k])}
        open_, wide = {k: n for k, n in open_.items() if k not in texts}, wide * 16
    return texts


def fit_langid(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", order_col: str = "doc_id", sample_per_lang: int = 400, sample_total: int = 8000, sample_chars: int = 20_000, features: int = 4096, rounds: int = 120) -> LangModel:
    """Fit on a bounded sample; rows without text or language are left out.

    Bound: sample_total rows, sample_per_lang a language, none of more than sample_chars characters (longer ones are not drawn).
    """
    h = F.shiftrightunsigned(F.xxhash64(F.col(order_col).cast("string"), F.col(text_col), F.lit(9)), 2)
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), h.alias("h")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= sample_chars) & (F.length("text") > 0))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return LangModel([], np.ones((0, 1), np.float32), np.zeros((features, 1), np.float32), np.zeros(1, np.float32), np.ones(1), features)
    texts = draw(rows, counts, max(8, min(sample_per_lang, sample_total // len(langs))))
    codes = codewords(len(langs))
    x = np.concatenate([gram_counts(s, features) for k in langs for s in text_steps(pa.array(texts[k], pa.large_string()), step_rows=STEP_ROWS)])
    y = np.concatenate([np.full(len(texts[k]), i) for i, k in enumerate(langs)])
    fit = np.arange(len(y)) % 5 != 0
    w, b = _bits(x[fit], codes[y[fit]], rounds)
    right = ((x[~fit] @ w + b) * codes[y[~fit]] > 0).mean(0) if (~fit).any() else np.ones(codes.shape[1])
    weight = np.log((right + 0.01) / (1.01 - right)).clip(0.05, None)
    return LangModel(langs, codes, w, b, weight / weight.sum(), features)


def _bits(x: np.ndarray, y: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """One logistic regression a bit, by gradient steps with momentum."""
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    vw, vb, rate = np.zeros_like(w), np.zeros_like(b), 8.0
    for _ in range(rounds):
        g = (-y / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30)))).astype(np.float32) / len(x)
        vw, vb = 0.9 * vw - rate * (x.T @ g + 1e-5 * w), 0.9 * vb - rate * g.sum(0)
        w, b = w + vw, b + vb
    return w, b


def decode(model: LangModel, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language number, score and gap to the second best of each row."""
    f = x @ model.weights + model.bias
    loss = np.zeros((len(x), len(model.langs)))
    for i, code in enumerate(model.codes):
        loss[:, i] = (np.log1p(np.exp(-np.clip(f * code, -30, 30))) * model.bit_weight).sum(1)
    fit = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
    fit /= fit.sum(1, keepdims=True)
    best = fit.argmax(1)
    score = fit.max(1)
    second = np.where(np.arange(fit.shape[1]) == best[:, None], 0, fit).max(1)
    return best, score, score - second


def has_letter(raw: bytes) -> bool:
    if any(65 <= c <= 90 or 97 <= c <= 122 for c in raw[:64]):
        return True
    return any(c.isalpha() for c in raw.decode("utf-8", "replace"))


def _judge(sent, ids: int, text: int, gap: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        names = np.array([*m.langs, UNDETERMINED], object)
        for batch in batches:
            for step in text_steps(batch.column(text), 1 << 19, STEP_ROWS):
                n = step.hi - step.lo
                some = np.array([bool(m.langs) and has_letter(step.raw(i)) for i in range(n)], bool)
                best, score, margin = decode(m, gram_counts(step, m.features)) if m.langs else (np.zeros(n, int), np.zeros(n), np.zeros(n))
                best = np.where(some, best, len(m.langs))
                part = batch.slice(step.lo, n)
                yield pa.RecordBatch.from_arrays([*part.columns[ids:], pa.array(names[best], pa.string()), pa.array(np.where(some, score, 0.0).astype(float)), pa.array(~some | (margin < gap))], names=[*batch.schema.names[ids:], "lang_pred", "score", "ambiguous"])

    return run


def predict_lang(docs: DataFrame, model: LangModel, *, id_col: str = "doc_id", text_col: str = "text", ambiguous_gap: float = 0.2) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous of every row, whole texts.

    Null texts and texts without a letter get 'und' with score 0 (so does all if the model knows no language);
    ambiguous: the two nearest codewords differ by less than ambiguous_gap in score.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("doc_id"))
    return rows.mapInArrow(_judge(sent, 1, 0, ambiguous_gap), "doc_id long, lang_pred string, score double, ambiguous boolean")


def predict_rows(docs: DataFrame, model: LangModel, *, text_col: str = "text", ambiguous_gap: float = 0.2) -> DataFrame:
    """As predict_lang, with all columns of docs before lang_pred, score and ambiguous (docs must not have columns of these names)."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    new = {"lang_pred", "score", "ambiguous"}
    if new & set(docs.columns):
        raise ValueError(f"docs has columns named {sorted(new & set(docs.columns))}")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "lang_pred string, score double, ambiguous boolean"])
    return docs.mapInArrow(_judge(sent, 0, docs.columns.index(text_col), ambiguous_gap), schema)
