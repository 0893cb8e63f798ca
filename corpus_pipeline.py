"""Documents to training pieces in five stages, each one of the operators of ``tessera.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.

Nulls and edges, beside those of the operators: a null or empty text is judged by the classifier as an empty one, has no
lines, no shingles and no words, so only the classifier may drop it, and it gets null or no pieces; a row with a null id
is kept by every stage that keeps its text; rows equal in id and text count as one document, of which near-dedup leaves
one row; n_chars is counted anew where lines were removed; further columns go along. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, line_dedup, minhash, pieces, quality
from tessera.llm.common import staged, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without later repeated runs of lines, and without documents that had text of which nothing is left."""
    out = line_dedup.line_dedup(docs).where((F.col("lines_removed") == 0) | (F.col("lines_removed") < F.col("lines_before")))
    changed = F.when(F.col("lines_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", changed).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With one document of each group of near copies (shingles of five words, similarity 0.8 or more)."""
    return minhash.near_dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a window of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Document ids with their pieces, and whether these decode to the text."""
    out = pieces.encode(docs.select("doc_id", "text"), check="lossless")
    return out.select("doc_id", F.size("pieces").alias("n_pieces"), "pieces", "lossless")


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("minhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("sentencepiece", to_pieces),
]

#: The classifier and the sampled pieces can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if i == 0 else staged(docs), sf_dir)
    return docs
