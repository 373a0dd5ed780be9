"""From raw documents to token ids: five stages, each over all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result to the shared folder as Parquet and
gives what is read from there to the next. All but the last return the columns of documents. An empty table goes through
all stages as one; further columns of any names are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm import bpe, exact_dedup, mixing, near_copies, quality_rules, simhash
from memlake.llm.tables import saved


def good_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: null and empty texts among them, as they have too few words. A null language or source is a value of its own."""
    return quality_rules.keep_good_texts(docs)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays; null texts count as empty, and repeated rows as one."""
    return exact_dedup.drop_exact_duplicates(docs)


def distant_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts tied by operator 8's SimHash links or by a Jaccard similarity of 0.8 or more in five words the document with the smallest id stays, and all without an id do."""
    return near_copies.drop_similar(docs, also=simhash.text_links)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which blocks of their sources follow each other; a null source is a source."""
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, slot (the place in the mix, which files don't keep), ids, and the count and digests that decoding the ids gives; no ids for null and empty texts."""
    placed = mixing.scheduled(docs).select(F.struct("doc_id", "slot").alias("place"), "text")
    encoded = bpe.with_digests(bpe.encode_texts(placed, "place"), "place")
    return encoded.select("place.doc_id", "place.slot", "ids", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality rules", good_texts),
    ("exact dedup", distinct_texts),
    ("near-dedup", distant_texts),
    ("mixing sources", mixed_sources),
    ("byte-level BPE", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = saved(stage(spark, docs, sf_dir), f"stage{n}")
    return docs


#: SimHash components and BPE merges have no SQL form; tests compare run() with a plain version of all stages.
ORACLE_SQL = None
