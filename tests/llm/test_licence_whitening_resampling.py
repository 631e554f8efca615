"""Licence scan, whitening and resampling against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyforge.llm import kernel, licences, queries, resample, whitening

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return ALNUM.findall((text or "").translate(LOW))


# --- resampling ------------------------------------------------------------------------------------
@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=700), st.integers(0, 700))
def test_running_crc_of_each_prefix(data, k):
    k = min(k, len(data))
    crc = resample.running_crc(np.frombuffer(data, np.uint8))
    ones = resample.shifted(np.array([0xFFFFFFFF], np.uint32), np.array([k]))[0]
    assert int(crc[k] ^ ones) ^ 0xFFFFFFFF == zlib.crc32(data[:k])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB1 \n\té.😀-", max_size=40)), max_size=8), st.integers(1, 3), st.integers(0, 3))
def test_ngram_crcs_are_those_of_the_joined_words(texts, least, more):
    got = []
    for step in kernel.text_steps(pa.array(texts, pa.string()), 32, 3):
        count, rows, crc = resample.ngram_crcs(step, least, least + more)
        assert count.tolist() == [len(words(t)) for t in texts[step.lo : step.hi]]
        got += zip((rows + step.lo).tolist(), crc.tolist(), strict=True)
    want = [(i, zlib.crc32(" ".join(w[j : j + n]).encode())) for i, t in enumerate(texts) for w in [words(t)] for n in range(least, least + more + 1) for j in range(len(w) - n + 1)]
    assert sorted(got) == sorted(want)


def test_long_runs_move_by_products():
    """Runs longer than the table of short moves."""
    text = "y" * 300 + " " + "z" * 100_000 + " end"
    (step,) = kernel.text_steps(pa.array([text]))
    _, _, crc = resample.ngram_crcs(step, 1, 3)
    w = text.split()
    assert crc.tolist() == [zlib.crc32(" ".join(w[j : j + n]).encode()) for n in (1, 2, 3) for j in range(4 - n)]


def brute_resample(rows, target, least=1, most=1, buckets=10_000, percent=10, least_words=20, seed=2024):
    feats = lambda t: [zlib.crc32(" ".join(w[j : j + n]).encode()) % buckets for w in [words(t)] for n in range(least, most + 1) for j in range(len(w) - n + 1)]
    s, t = Counter(b for _, x in rows for b in feats(x)), Counter(b for x in target for b in feats(x))
    sn, tn = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * sn / ((s[b] + 1) * tn)))
    out = []
    for i, x in rows:
        f = feats(x)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(words(x)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= least_words), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2], r[1]))
    drawn = [(*r, k) for k, r in enumerate(able[: len(able) * percent // 100], 1)]
    rest = [(*r, None) for r in out if r[1] < least_words] + [(*r, None) for r in able[len(drawn) :]]
    return sorted(drawn + rest, key=str)


TEXTS = [None, "", " .,; ", "one", "Alpha beta gamma delta", "the quick brown fox " * 6, "alpha beta " * 11, "the quick brown fox " * 6, "x" * 50_000 + " " + "long words " * 3000]


@pytest.mark.parametrize("options", [{}, {"most": 3, "buckets": 97, "percent": 50, "least_words": 4}, {"least": 2, "most": 2, "percent": 100, "least_words": 0, "seed": 7}, {"percent": 0}])
def test_resample_equals_brute_force(spark, options):
    rows = [(i % 37, TEXTS[i % len(TEXTS)]) for i in range(90)] + [(None, TEXTS[5]), (None, None)] + [(1000 + i, f"alpha item{i % 7} " * 12) for i in range(60)]
    target = ["Alpha beta gamma " * 5, None, "", "item3"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS rank", "'x' AS score", "2 AS bucket", "3 AS weight").repartition(3)
    bench = spark.createDataFrame([(t,) for t in target], "text string").selectExpr("*", "1 AS doc_id", "2 AS n")
    got = resample.resample(docs, bench, **options)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_resample(rows, target, **options)


def test_resample_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c " * 10), (2, None)], "doc_id long, text string")
    assert resample.resample(none, some).count() == 0
    assert sorted(map(tuple, resample.resample(some, none, percent=50).collect()), key=str) == brute_resample([(1, "a b c " * 10), (2, None)], [], percent=50)
    with pytest.raises(ValueError):
        resample.resample(some, some, least=0)


# --- whitening -------------------------------------------------------------------------------------
def brute_whiten(vectors, k=32, scale=64.0, offset=1_000_000):
    dim = max(map(len, vectors))
    x = [[math.floor(scale * float(np.float32(c))) + offset for c in v] + [offset] * (dim - len(v)) for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    xc = np.array([[(n * c - s) / n for c, s in zip(row, sums, strict=True)] for row in x])
    e, v = np.linalg.eigh(xc.T @ xc / n)
    order = np.argsort(-e)[:k]
    return n, deviation, xc, e[order], v[:, order], e.sum()


def check_whitened(spark, vectors, components=32):
    rows = [(i, v) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS x", "2 AS n", "3 AS deviation").repartition(3)
    got = sorted(whitening.whiten(df, components=components).collect(), key=lambda r: r.vec_id)
    n, deviation, xc, e, v, trace = brute_whiten(vectors, components)
    assert [r.vec_id for r in got] == list(range(len(vectors)))
    assert {r.n for r in got} == {n} and [int(r.deviation) for r in got] == deviation
    w = np.array([r.whitened for r in got])
    k = w.shape[1]
    assert k == int((e > 1e-18 * e[0]).sum())
    assert np.abs(np.array(got[0].explained) / (e[:k] / trace) - 1).max() < 1e-9
    cov = (w - w.mean(0)).T @ (w - w.mean(0)) / n
    assert np.abs(cov - np.eye(k)).max() < 1e-9 and got[0].identity_error < 1e-9
    return w, xc, e[:k], v[:, :k]


def test_whitening_equals_the_eigenvectors(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.standard_normal((300, 24)) * np.geomspace(8, 0.2, 24)).tolist()
    for components in (4, 32):
        w, xc, e, v = check_whitened(spark, vectors, components)
        want = xc @ v / np.sqrt(e)
        assert np.abs(w * np.sign((w * want).sum(0)) - want).max() < 1e-7


def test_whitening_of_rank_deficient_and_repeated_spectra(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((50, 3))
    check_whitened(spark, np.hstack([base, np.zeros((50, 9))]).tolist())  # three of twelve dimensions
    corners = [[float((i >> j) & 1) for j in range(6)] for i in range(64)]
    check_whitened(spark, corners, 4)  # all variances equal: the covariance is a multiple of the identity
    check_whitened(spark, [[1.0, 2.0], [1.0, 2.0], [3.0, 2.0], [0.5]])  # repeated rows, a shorter one


def test_whitening_edge_cases(spark):
    schema = "vec_id long, embedding array<float>"
    rows = [(1, [1.0, 2.0]), (None, [3.0, -1.0]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [float("inf"), 0.0]), (1, [1.0, 2.0])]
    got = whitening.by_component(whitening.whiten(spark.createDataFrame(rows, schema))).collect()
    assert sorted((r.vec_id or 0, r.component, r.n) for r in got) == [(0, 1, 3), (1, 1, 3), (1, 1, 3)]
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    alone = whitening.whiten(spark.createDataFrame([(7, [5.0, 6.0])], schema)).collect()
    assert [(r.vec_id, r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in alone] == [(7, 1, 0, [], [], 0.0)]
    empty = whitening.whiten(spark.createDataFrame([(7, [])], schema))
    assert empty.count() == 0
    far = whitening.whiten(spark.createDataFrame([(1, [1e30]), (2, [-1e30]), (3, [0.0])], schema)).collect()
    assert sorted(int(r.deviation) for r in far)[0] == 0 and max(int(r.deviation) for r in far) == (3 * 2**53) ** 2


# --- licences --------------------------------------------------------------------------------------
def brute_licences(text, base=licences.BASE, templates=licences.TEMPLATES, slack=licences.SLACK):
    w = words(text)
    at = lambda p: [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    starts = [i for p in base for i in at(p.split())]
    own = {label for p, label in base.items() if at(p.split())}
    found = set(own)
    for label, whole, keys in templates:
        t, phrases, lo = words(whole), [], 0
        for key in keys or (whole,):
            k = words(key)
            lo = next(i for i in range(lo, len(t)) if t[i : i + len(k)] == k)
            phrases.append((k, lo))
            lo += len(k)

        def holds(start, i, behind, phrases=phrases):
            if i == len(phrases):
                return True
            k, where = phrases[i]
            near = sorted((p for p in at(k) if p >= behind), key=lambda p: (abs(p - start - where), p))[:1]
            return any(abs(p - start - where) <= slack and holds(p - where, i + 1, p + len(k)) for p in near)

        if any(holds(p - phrases[0][1], 1, p + len(phrases[0][0])) for p in at(phrases[0][0])):
            found.add(label)
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), sorted(own), sorted(found)


def licence_texts():
    whole = {label + str(i): t for i, (label, t, _) in enumerate(licences.TEMPLATES)}
    grant = next(t for label, t, k in licences.TEMPLATES if label == "mit" and k)
    gpl = next(t for label, t, k in licences.TEMPLATES if label == "gpl-3" and k)
    return [
        *whole.values(),
        *(f"Intro words. {t} More of it." for t in whole.values()),
        " ".join(whole.values()),
        grant.replace("this software", "this fine piece of software"),
        grant.replace("without restriction", "with some restriction"),
        gpl.replace("either version 3", "either " + "filler " * 20 + "version 3"),
        "UNDER the MIT-License! under the mit license, Apache License version 2; CC BY NC cc by nc",
        "under the mit", "the mit license", "version 2 license apache", "mit", "MIT " * 500 + "under the mit license",
        "cc by " * 3000 + "nc", None, "", "...", "é😀", "Licensed under CC BY-NC-SA 4.0",
    ]


def test_licences_equal_brute_force(spark):
    texts = licence_texts() * 2
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "cc by nc")], "doc_id long, text string").selectExpr("*", "1 AS n_base", "'x' AS labels", "2 AS score", "3 AS n").repartition(4)
    got = {r.doc_id: r for r in licences.licence_spans(df).collect()}
    assert len(got) == len(texts) + 1 and got[None].labels == ["cc-by-nc"]
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == brute_licences(t), t
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels) == bool(r.spans)
    for i, (label, _, _) in enumerate(licences.TEMPLATES):
        assert label in got[i].labels and got[i].score == pytest.approx(1)


def test_licence_scores_and_spans(spark):
    whole = next(t for label, t, k in licences.TEMPLATES if label == "mit" and k)
    cut = " ".join(whole.split()[: len(words(whole)) // 2 + 12])
    df = spark.createDataFrame([(0, "a b " + whole), (1, "c " + whole.replace("associated documentation files", "related papers")), (2, cut.replace("Software", "thing"))], "doc_id long, text string")
    r = {x.doc_id: x for x in licences.licence_spans(df).collect()}
    (span,) = [s for s in r[0].spans if s.label == "mit"]
    assert (span.start, span.stop) == (2, 2 + len(words(whole))) and r[0].score == pytest.approx(1)
    assert 0.5 < r[1].score < 1 and r[1].labels == ["mit"]
    assert r[2].labels == [] and r[2].score == 0


def test_licences_of_empty_tables_and_wrong_templates(spark):
    assert licences.licence_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        licences.Index.of({}, (("x", "some words", ("other",)),))
    with pytest.raises(ValueError):
        licences.Index.of({"": "x"}, ())


# --- the queries over their tables -----------------------------------------------------------------
def test_queries_return_their_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scan = queries.QUERIES["op11_licence_scan"](spark, sf_dir)
    assert scan.dtypes == [("doc_id", "bigint"), ("n_words", "bigint"), ("n_base", "bigint"), ("first_word", "bigint"), ("last_word", "bigint"), ("base_labels", "string"), ("labels", "string"), ("score", "double")]
    got, texts = {r.doc_id: r for r in scan.collect()}, {r.doc_id: r.text for r in docs.collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        n, k, lo, hi, own, found = brute_licences(t)
        assert tuple(got[i])[1:7] == (n, k, lo, hi, ",".join(own), ",".join(found))
    white = queries.QUERIES["op12_embedding_whitening"](spark, sf_dir)
    assert white.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    assert white.count() == 32 * spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    drawn = queries.QUERIES["op13_importance_resampling"](spark, sf_dir)
    assert {t for _, t in drawn.dtypes} == {"bigint"}
    assert drawn.where(F.col("rank").isNotNull()).count() == drawn.where("n_features >= 20").count() // 10
