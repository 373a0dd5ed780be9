"""Entity extraction results and the entity index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Types of entities.
TYPES = ("person", "company", "project", "amount", "location", "date_ref")


def valid_entities(parsed: DataFrame) -> DataFrame:
    """(chunk_id, entities, entity_types): as far as the shorter list goes, known types and non-blank names."""
    n = F.least(F.size("entities"), F.size("types"))
    pairs = F.filter(F.arrays_zip(F.slice("entities", 1, n).alias("e"), F.slice("types", 1, n).alias("t")), lambda p: p["t"].isin(*TYPES) & (F.trim(p["e"]) != ""))
    rows = parsed.filter("size(entities) > 0 AND size(types) > 0").select("chunk_id", pairs.alias("p"))
    return rows.select("chunk_id", F.transform("p", lambda x: x["e"]).alias("entities"), F.transform("p", lambda x: x["t"]).alias("entity_types"))


def mark_entities(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """chunks with what was found; others as they are."""
    rows = chunks.join(found.withColumnsRenamed({"entities": "e", "entity_types": "t"}), "chunk_id", "left")
    hit = F.col("e").isNotNull()
    return rows.withColumns({"entities": F.coalesce("e", "entities"), "entity_types": F.coalesce("t", "entity_types"), "entities_extracted": F.when(hit, 1).otherwise(F.col("entities_extracted"))}).drop("e", "t")


def needs_extraction(chunks: DataFrame) -> DataFrame:
    return chunks.filter(F.coalesce("entities_extracted", F.lit(0)) != 1)


def build_entity_index(chunks: DataFrame) -> DataFrame:
    """(entity, entity_type, chunk_id) of chunks with extracted entities, trimmed, without blanks."""
    n = F.least(F.size("entities"), F.size("entity_types"))
    rows = chunks.filter("entities_extracted = 1 AND size(entities) > 0 AND size(entity_types) > 0")
    rows = rows.select("chunk_id", F.explode(F.arrays_zip(F.slice("entities", 1, n).alias("e"), F.slice("entity_types", 1, n).alias("t"))).alias("p"))
    return rows.select(F.trim("p.e").alias("entity"), F.col("p.t").alias("entity_type"), "chunk_id").filter("entity <> ''").distinct()


def entity_stats(index: DataFrame) -> DataFrame:
    """(entity_type, n, entities, chunks) and a row for all types."""
    agg = [F.count(F.lit(1)).alias("n"), F.countDistinct("entity").alias("entities"), F.countDistinct("chunk_id").alias("chunks")]
    return index.groupBy("entity_type").agg(*agg).unionByName(index.agg(*agg).select(F.lit("all").alias("entity_type"), "n", "entities", "chunks"))


def top_entities(index: DataFrame, n: int = 30) -> DataFrame:
    """The most frequent entities, in any case, by type."""
    return index.groupBy(F.lower("entity").alias("entity"), "entity_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "entity", "entity_type").limit(n)
