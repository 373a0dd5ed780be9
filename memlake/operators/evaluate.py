"""Retrieval evaluation against gold sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.functions import text as T


def evaluate_retrieval(corpus: DataFrame, ranked: DataFrame) -> DataFrame:
    """(query_id, gold, exact_hits, doc_hits, recall, primary_rank, primary_doc_rank) for corpus (query_id, gold, primary_gold, n) and ranked (query_id, chunk_ids).

    Lists count each id once, in order, and are cut at n, or 10 where that is missing; rows without gold are left out.
    """
    rows = corpus.join(ranked, "query_id", "left").withColumn("gold", F.array_distinct("gold")).filter("size(gold) > 0")
    n = F.when(F.coalesce("n", F.lit(0)) > 0, F.col("n")).otherwise(10)
    rows = rows.withColumn("got", F.slice(F.array_distinct(F.coalesce("chunk_ids", F.array().cast("array<string>"))), F.lit(1), n))
    docs = F.transform("got", T.doc_of_chunk)
    rows = rows.withColumns({"exact": F.size(F.array_intersect("gold", "got")), "docs": F.size(F.filter("gold", lambda g: F.array_contains(docs, T.doc_of_chunk(g))))})
    return rows.select(
        "query_id", F.size("gold").cast("long").alias("gold"), F.col("exact").cast("long").alias("exact_hits"), F.col("docs").cast("long").alias("doc_hits"),
        F.round(F.col("exact") / F.size("gold"), 6).alias("recall"), F.nullif(F.array_position("got", F.col("primary_gold")), F.lit(0)).alias("primary_rank"),
        F.nullif(F.array_position(docs, T.doc_of_chunk(F.col("primary_gold"))), F.lit(0)).alias("primary_doc_rank"),
    )


def gold_provenance(corpus: DataFrame, candidates: DataFrame, pool: DataFrame, uncapped: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, streams, in_pool): for each gold id the streams that brought it, sorted, and whether it came into the pool.

    With uncapped (query_id, chunk_id), what the entity branch found before its cap, also entity_pre_cap_only: whether the
    branch found the id and the cap then took it away.
    """
    gold = corpus.select("query_id", F.explode(F.array_distinct("gold")).alias("chunk_id"))
    brought = candidates.groupBy("query_id", "chunk_id").agg(F.sort_array(F.collect_set("stream")).alias("streams"))
    pooled = pool.select("query_id", "chunk_id").distinct().withColumn("p", F.lit(True))
    rows = gold.join(brought, ["query_id", "chunk_id"], "left").join(pooled, ["query_id", "chunk_id"], "left")
    rows = rows.select("query_id", "chunk_id", F.coalesce("streams", F.array().cast("array<string>")).alias("streams"), F.coalesce("p", F.lit(False)).alias("in_pool"))
    if uncapped is None:
        return rows
    found = uncapped.select("query_id", "chunk_id").distinct().withColumn("f", F.lit(True))
    rows = rows.join(found, ["query_id", "chunk_id"], "left")
    return rows.withColumn("entity_pre_cap_only", F.coalesce("f", F.lit(False)) & ~F.array_contains("streams", "entity")).drop("f")


def stage_timings(timings: DataFrame) -> DataFrame:
    """(stage, queries, median_ms) of timings (query_id, stage, ms); missing times don't count."""
    return timings.filter("ms IS NOT NULL").groupBy("stage").agg(F.count(F.lit(1)).alias("queries"), F.round(F.percentile("ms", 0.5), 2).alias("median_ms"))


def evaluation_summary(results: DataFrame) -> DataFrame:
    """One row: macro and micro recall, document recall and the share of primary hits."""
    return results.agg(
        F.count(F.lit(1)).alias("queries"), F.round(F.avg("recall"), 6).alias("macro_recall"), F.round(F.sum("exact_hits") / F.sum("gold"), 6).alias("micro_recall"),
        F.round(F.sum("doc_hits") / F.sum("gold"), 6).alias("doc_recall"), F.round(F.count("primary_rank") / F.count(F.lit(1)), 6).alias("primary_hits"),
    )


def gold_missing(corpus: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, missing): gold ids that the store doesn't have."""
    rows = corpus.select("query_id", F.explode("gold").alias("chunk_id")).join(chunks.select("chunk_id"), "chunk_id", "left_anti")
    return rows.groupBy("query_id").agg(F.sort_array(F.collect_set("chunk_id")).alias("missing"))


def corpus_violations(corpus: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """(query_id, rule) for every rule that a gold row breaks."""
    rules = {
        "no query": F.coalesce(F.trim("query"), F.lit("")) == "",
        "category": ~F.coalesce(F.col("category").isin(*categories), F.lit(False)),
        "n": ~F.coalesce(F.col("n").isin(3, 5, 10), F.lit(False)),
        "no gold": F.coalesce(F.size("gold"), F.lit(0)) <= 0,
        "gold type": F.col("gold_type") != F.when(F.size("gold") > 1, "multi").otherwise("single"),
        "primary": ~F.array_contains("gold", F.col("primary_gold")),
    }
    broken = F.array_compact(F.array(*[F.when(c, name) for name, c in rules.items()]))
    rows = corpus.select("query_id", F.explode(broken).alias("rule"))
    repeated = corpus.groupBy("query_id").count().filter("count > 1").select("query_id", F.lit("repeated id").alias("rule"))
    return rows.unionByName(repeated)
