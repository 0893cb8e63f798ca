"""One query for each operator, with production parameters, over the whole of its tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archives, collocations, decontaminate, line_dedup, minhash, pieces, quality, repeats, rp_forest, secrets, sharding, token_counts, variants
from .common import shared_dir, table

#: Bytes of text in a shard at most: shards that are read at random, one at a time. Small tables split too.
SHARD_BYTES = 256 << 10


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.histogram(token_counts.encoded_lengths(table(spark, sf_dir, "documents")))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind_no"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind_no"] == k)).cast("bigint")
    return out.select(F.col("key").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"), count(3).alias("n_random"))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("key", "doc_id")


def op5_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp_forest.nearest(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(100)) == 0)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    units = F.filter(F.split("text", "\n", -1), line_dedup.is_unit)
    return out.select("doc_id", "lines_before", "lines_removed", F.sha2(F.coalesce(F.array_join(units, "\n"), F.lit("")), 256).alias("kept_sha256"))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), check="lossless")
    return out.select("doc_id", F.size("pieces").alias("n_pieces"), F.sha2(F.array_join("pieces", " "), 256).alias("pieces_sha256"), "lossless")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), SHARD_BYTES).select("doc_id", "n_bytes", "depth", "shard", "overflow", "shard_bytes")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash.near_components(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=4, percent=80)
    return out.select(F.col("key").alias("doc_id"), "n_shingles", "component_id", (F.col("key") == F.col("component_id")).alias("kept"))


def op11_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = archives.write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}")
    return archives.read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = variants.variants(variants.vocabulary(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return out.select("word", "form", "root", "n", "n_near", "form_n")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(*collocations.phrase_counts(table(spark, sf_dir, "documents").select("lang", "text")))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_secrets, op3_repeats, op4_quality, op5_rp_forest, op6_decontaminate, op7_line_dedup, op8_pieces, op9_sharding, op10_minhash, op11_archives, op12_variants, op13_collocations)}

ORACLES = {"op10_minhash": minhash.SQL, "op11_archives": archives.SQL, "op12_variants": variants.SQL, "op13_collocations": collocations.SQL, "op6_decontaminate": decontaminate.SQL, "op7_line_dedup": line_dedup.SQL, "op9_sharding": sharding.SQL.format(limit=SHARD_BYTES)}
