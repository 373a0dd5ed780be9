"""One registered query for each operator of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm import alignment, bpe, exact_dedup, importance, language_id, license_scan, mixing, quality_model, quality_rules, secret_scan, simhash, sql, toxicity, warc
from memlake.llm.tables import shared_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    warc.write_archives(_table(spark, sf_dir, "pages"), path)
    return warc.merge_index(warc.read_index(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "captured")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.scheduled(_table(spark, sf_dir, "documents").select("doc_id", "source")).select("doc_id", "source", "block", "release", "deadline", "slot")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = bpe.decode_ids(bpe.encode_texts(_table(spark, sf_dir, "documents")))
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_model.score_quality(docs, quality_model.train(docs, _table(spark, sf_dir, "labels")))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(_table(spark, sf_dir, "documents")).drop("text_hash", "distance")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(_table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in secret_scan.BASE]))
    return found.select("doc_id", *[count(r.kind).alias(f"n_{r.kind}") for r in secret_scan.BASE], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.find_licenses(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("licenses", ",").alias("licenses"), "n_passages", "best_license", F.round("best_dice", 6).alias("best_dice"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.importance_sample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.cross_tokens(_table(spark, sf_dir, "documents"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs))


_ALL = (op1_toxicity, op2_warc, op3_mixing, op4_byte_bpe, op5_exact_dedup, op6_quality_model, op7_quality_rules, op8_simhash, op9_secret_scan, op10_license_scan, op11_importance, op12_alignment, op13_language_id)
QUERIES = {f.__name__: f for f in _ALL}

ORACLE_SQL = {
    "op3_mixing": sql.mixing(),
    "op5_exact_dedup": sql.EXACT_DEDUP,
    "op7_quality_rules": sql.quality_rules(),
    "op9_secret_scan": sql.secret_scan_sql(),
    "op10_license_scan": sql.license_scan_sql(),
    "op11_importance": sql.importance_sql(),
}
