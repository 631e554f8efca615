"""The opN_ queries over the synthetic tables and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classlm, decontam, jaccard, langid, licences, linededup, packing, quality, resample, secretscan, voronoi, warc, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(n: int, col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo n; null ids give null."""
    return F.crc32(F.col(col).cast("string")) % n


def held_out(n: int, remainder: int = 0) -> Column:
    return F.coalesce(crc_mod(n) == remainder, F.lit(False))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).where(crc_mod(5) != 0)
    # the sample's ids are chosen from the labels alone, so only its texts are looked up
    size = 1500
    ids = [labels.where(F.col("label") == k).orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(2 * size) for k in (0, 1)]
    model = quality.fit_quality(docs.join(F.broadcast(ids[0].unionByName(ids[1])), "doc_id"), quality.good_share(labels), sample_per_class=size)
    return quality.score_quality(docs, model).select("doc_id", held_out(5).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit_langid(docs.where(crc_mod(3) != 1))
    return langid.predict_lang(docs, model).select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score", "ambiguous")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secretscan.secret_spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["rank"] < 3)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(secretscan.listed(base), 256).alias("base_sha256"), secretscan.listed(F.col("spans")).alias("spans"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontam.benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = decontam.n_hit()
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op4_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_units(table(spark, sf_dir, "documents"), lines=True)


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi.knn_join(voronoi.integer_vectors(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_groups(table(spark, sf_dir, "documents"), k=3, num=90)


def op8_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = classlm.score_texts(table(spark, sf_dir, "documents"), crc_mod(10) != 0)
    return scored.select("doc_id", held_out(10).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op10_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive(table(spark, sf_dir, "pages"))
    return warc.read_bundles(index).drop("payload")


def op11_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.licence_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.by_component(whitening.whiten(table(spark, sf_dir, "embeddings")))
    return rows.withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_secret_scan": op2_secret_scan,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_length_packing": op4_length_packing,
    "op5_line_dedup": op5_line_dedup,
    "op6_topk_search": op6_topk_search,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_class_lm": op8_class_lm,
    "op9_language_id": op9_language_id,
    "op10_warc_bundles": op10_warc_bundles,
    "op11_licence_scan": op11_licence_scan,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_importance_resampling": op13_importance_resampling,
}


def _located_sql(pattern: str, group: int, least: int) -> str:
    """DuckDB: list of {start, stop, hit} of the leftmost matches in t."""
    return f"""list_filter(list_transform(range(1, len(regexp_extract_all(t, '{pattern}')) + 1), lambda i: {{
      'start': CAST(coalesce(list_sum(list_transform(string_split_regex(t, '{pattern}')[1:i], lambda x: len(x))), 0) + coalesce(list_sum(list_transform(regexp_extract_all(t, '{pattern}')[1:i - 1], lambda x: len(x))), 0) AS BIGINT),
      'hit': regexp_extract_all(t, '{pattern}')[i], 'part': regexp_extract_all(t, '{pattern}', {group})[i]}}), lambda x: len(x.part) >= {least})"""


def _op2_sql() -> str:
    q = lambda p: p.replace("'", "''")
    words = r"^[A-Za-z]+([-_/+][A-Za-z]+)*[-_/+]?$"
    allow = q("|".join(f"(?:{p})" for p in (words, *secretscan.ALLOW)))
    w, th = secretscan.WINDOW, secretscan.THRESHOLDS
    # entropy of a window, from plain counts
    entropy = f"list_entropy(string_split(substr(c.hit, i, {w}), ''))"
    limit = f"(CASE WHEN regexp_matches(c.hit, '^[0-9a-fA-F]+$') THEN {th['hex']} WHEN regexp_matches(c.hit, '^[0-9A-Za-z]+$') THEN {th['alnum']} ELSE {th['token']} END)"
    hot = f"list_filter(range(1, len(c.hit) - {w} + 2), lambda i: {entropy} >= {limit})"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT r, doc_id,
  {_located_sql(q(secretscan.ASSIGN), 1, 6)} AS a,
  {_located_sql(q(secretscan.ACCESS), 0, 0)} AS k,
  {_located_sql(q(secretscan.HEX), 0, 0)} AS h,
  {_located_sql(q(secretscan.CANDIDATE), 0, 0)} AS c FROM d),
base AS (
  SELECT r, x.start AS s, x.start + len(x.hit) AS e, 0 AS rank, 'assign' AS kind FROM (SELECT r, unnest(a) AS x FROM m)
  UNION ALL SELECT r, x.start, x.start + len(x.hit), 1, 'access' FROM (SELECT r, unnest(k) AS x FROM m)
  UNION ALL SELECT r, x.start, x.start + len(x.hit), 2, 'hex' FROM (SELECT r, unnest(h) AS x FROM m)),
cand AS (SELECT r, c, {hot} AS w FROM (SELECT r, unnest(c) AS c FROM m) WHERE NOT regexp_matches(c.hit, '{allow}')),
hot AS (SELECT r, c.start + list_min(w) - 1 AS s, c.start + list_max(w) - 1 + {w} AS e, 3 AS rank, 'entropy' AS kind FROM cand WHERE len(w) > 0),
al AS (SELECT * FROM base UNION ALL SELECT * FROM hot WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = hot.r AND b.s < hot.e AND hot.s < b.e)),
s AS (SELECT r, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) AS spans,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) FILTER (rank < 3) AS base FROM al GROUP BY r)
SELECT doc_id, len(a) AS n_assign, len(k) AS n_access, len(h) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM m LEFT JOIN s USING (r)"""


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _op4_sql(max_tokens: int = 2048, buckets: int = 8, token_budget: int = 16_384) -> str:
    """The bucket bounds by dynamic programming, one common table for each bucket; for more lengths than buckets."""
    levels = ["b1 AS (SELECT j, x * t - m AS cost, 0 AS i FROM l WHERE j > 0)"]
    for k in range(2, buckets + 1):
        # cost and the earlier bound in one number: the least cost, then the smallest bound
        levels.append(f"""b{k} AS (SELECT j, v // 100000 AS cost, v % 100000 AS i FROM (
  SELECT l.j, min((b.cost + l.x * (l.t - a.t) - (l.m - a.m)) * 100000 + a.j) AS v FROM l JOIN l a ON a.j < l.j JOIN b{k - 1} b ON b.j = a.j GROUP BY l.j))""")
    ends = [f"e{buckets} AS (SELECT max(j) AS j FROM l)"]
    ends += [f"e{k} AS (SELECT i AS j FROM b{k + 1} JOIN e{k + 1} USING (j))" for k in range(buckets - 1, 0, -1)]
    every = " UNION ALL ".join(f"SELECT j FROM e{k}" for k in range(1, buckets + 1))
    return rf"""
WITH d AS (SELECT doc_id, md5(coalesce(text, '')) AS mark, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens FROM documents),
p AS (SELECT doc_id, mark, piece, piece * {max_tokens} AS start, least(tokens - piece * {max_tokens}, {max_tokens}) AS n_tokens
  FROM (SELECT *, unnest(range(0, greatest((tokens + {max_tokens - 1}) // {max_tokens}, 1))) AS piece FROM d)),
h AS (SELECT n_tokens AS x, CAST(count(*) AS HUGEINT) AS c FROM p GROUP BY x),
l AS (SELECT row_number() OVER (ORDER BY x) AS j, x, sum(c) OVER (ORDER BY x) AS t, sum(c * x) OVER (ORDER BY x) AS m FROM h UNION ALL SELECT 0, 0, 0, 0),
{", ".join(levels)}, {", ".join(ends)},
bound AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS bucket FROM l WHERE j IN ({every})),
o AS (SELECT *, md5(concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), ''), piece, mark)) AS digest, (SELECT min(x) FROM bound WHERE x >= n_tokens) AS x FROM p),
a AS (SELECT o.*, bucket, row_number() OVER (PARTITION BY bucket ORDER BY substr(digest, 1, 8), doc_id NULLS FIRST, piece, mark) - 1 AS place, greatest({token_budget} // greatest(o.x, 1), 1) AS capacity FROM o JOIN bound USING (x))
SELECT doc_id, CAST(piece AS INT) AS piece, CAST(start AS BIGINT) AS start, CAST(n_tokens AS INT) AS n_tokens, CAST(bucket AS INT) AS bucket, CAST(x AS INT) AS bucket_tokens,
  CAST(place // capacity AS BIGINT) AS batch_id, CAST(place % capacity AS INT) AS slot FROM a"""


def _op13_sql(buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> str:
    """CRC-32 of each distinct word byte by byte, then the sums, gains and ranks as plain SQL."""
    words = lambda t: rf"SELECT row_number() OVER () AS r, *, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {t}"
    return f"""
WITH d AS ({words("documents")}), b AS ({words("benchmark")}),
dw AS (SELECT r, doc_id, unnest(w) AS word FROM d), bw AS (SELECT unnest(w) AS word FROM b),
tab AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(range(0, 8), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, {resample.POLYNOMIAL}) ELSE v >> 1 END, i)) AS t),
hexed AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
crc AS (SELECT word, xor(list_reduce(list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)),
  lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % {buckets} AS bucket FROM hexed, tab),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN crc USING (word) GROUP BY 1), t AS (SELECT bucket, count(*) AS n FROM bw JOIN crc USING (word) GROUP BY 1),
tot AS (SELECT CAST((SELECT coalesce(sum(n), 0) FROM s) + {buckets} AS DOUBLE) AS sn, CAST((SELECT coalesce(sum(n), 0) FROM t) + {buckets} AS DOUBLE) AS tn),
g AS (SELECT s.bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + CAST(1 AS DOUBLE)) * sn / ((s.n + CAST(1 AS DOUBLE)) * tn))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), tot),
w AS (SELECT r, count(*) AS n, CAST(floor(CAST(sum(gain) AS BIGINT) / count(*)) AS BIGINT) AS weight FROM dw JOIN crc USING (word) JOIN g USING (bucket) GROUP BY r),
sc AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
  + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN w USING (r)),
ranked AS (SELECT *, CASE WHEN n_features >= {least_words} THEN row_number() OVER (PARTITION BY n_features >= {least_words} ORDER BY score DESC, doc_id NULLS FIRST, n_features) END AS k,
  count(*) FILTER (n_features >= {least_words}) OVER () * {percent} // 100 AS wanted FROM sc)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= wanted THEN k END AS rank FROM ranked"""


ORACLE_SQL: dict[str, str] = {
    "op2_secret_scan": _op2_sql(),
    "op3_benchmark_decontamination": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT m FROM bw), dw AS (
  SELECT r, i, m, array_to_string(w[i : i + m - 1], ' ') AS g
  FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, lens WHERE len(w) >= m)
), hit AS (SELECT DISTINCT r, i, dw.m, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.m = bw.m),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS p FROM hit) GROUP BY r),
it AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS s FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN it USING (r)""",
    "op4_length_packing": _op4_sql(),
    "op13_importance_resampling": _op13_sql(),
    "op7_jaccard_join": rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i : i + 2], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
common AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY ALL),
link AS (SELECT x, y FROM common JOIN n p ON p.r = x JOIN n q ON q.r = y WHERE 100 * c >= 90 * (p.n + q.n - c)),
reach AS (SELECT r AS x, r AS y FROM d UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM d LEFT JOIN n USING (r) JOIN (SELECT x AS r, min(doc_id) AS component_id FROM reach JOIN d ON d.r = y GROUP BY x) m USING (r)""",
    "op6_topk_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""",
    "op10_warc_bundles": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS f FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST(('0x' || substr(x, CAST(i // 4 * 5 + 1 AS INT), 5)) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = f OR f IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = f THEN NULL ELSE f END AS refers_to
FROM d""",
}
