"""Corpus pipeline: language ID, n-gram Jaccard join, benchmark decontamination, secret scan, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before has kept, and returns a DataFrame. All but the last return the
columns of documents. run() writes each stage's result to the shared folder and reads it back as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import decontam, jaccard, langid, packing, secretscan
from tallyforge.llm.queries import table
from tallyforge.llm.scratch import materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that the classifier can tell; those without a letter go. lang becomes the predicted language.

    The classifier learns from labelled rows of the documents given. Without any labelled row no language is known and all documents go.
    """
    model = langid.fit_langid(docs)
    judged = langid.predict_rows(docs.select(*COLUMNS), model)
    return judged.where(F.col("lang_pred") != langid.UNDETERMINED).select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near copies (five-word shingles, similarity 0.8 or more): that with the smallest id, then digest of its text.

    Rows are told by id and text, so an id that repeats with another text is judged by that text; rows without id come last in their group.
    Of rows that repeat one stays. Documents without words are no one's copies: all of them stay.
    """
    groups = jaccard.near_groups(docs, k=5, num=80, den=100, mark=F.md5(F.col("text")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark"))
    kept = groups.where("n_shingles > 0").groupBy("group").agg(first.alias("x")).select(_row_key(F.col("x.doc_id"), F.col("x.mark")).alias("key"))
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    # one shuffle of the texts: rows that repeat go before it as far as a task sees them, and the join finds its keys in place
    rows = docs.where(worded).select(*COLUMNS, _row_key(F.col("doc_id"), F.md5("text")).alias("key")).dropDuplicates(["key"])
    return rows.join(kept, "key", "left_semi").select(*COLUMNS).unionByName(docs.where(~worded).select(*COLUMNS))


def _row_key(doc_id: Column, mark: Column) -> Column:
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), mark)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which a ten-word window of a benchmark item (or a whole shorter item) occurs."""
    return decontam.clean_rows(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret by a mark; all documents stay. n_chars follows the text."""
    found = secretscan.secret_spans(docs, keep=("lang", "source", "n_chars"), overlapping=True, thresholds=secretscan.FULL_THRESHOLDS)
    text = secretscan.redacted(F.col("text"), F.col("spans"))
    return found.select("doc_id", text.alias("text"), "lang", "source", F.when(F.size("spans") > 0, F.length(text)).otherwise(F.col("n_chars")).cast("long").alias("n_chars"))


def length_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 words in eight optimal length buckets, with batch and slot."""
    return packing.pack(docs)


STAGES = [("language ID", language_id), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("secret scans", secrets), ("packing", length_packing)]

#: Language ID is a trained classifier, so SQL can't express the rows; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{i}")
    return docs
