"""Keeping a store in order: reconcile, orphans, realignment, purges, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memlake.functions import text as T
from memlake.operators.search import top
from memlake.operators.vectors import likely_older_neighbours, older_neighbours, vector_rows

BROKEN = "broken-index-row"


class ChurnTooHigh(RuntimeError):
    """A reconcile plan that would change too much of an index."""


def pivot_metadata(eav: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(id, key, string_value) rows to one row per id; a key that an id lacks is empty."""
    return eav.filter(F.col("key").isin(*keys)).groupBy("id").agg(*[F.coalesce(F.max(F.when(F.col("key") == k, F.col("string_value"))), F.lit("")).alias(k) for k in keys])


def fts_cardinality(meta: DataFrame, index: DataFrame) -> DataFrame:
    """(chunk_id, fingerprint) of an index: what has not exactly one row on either side gets a sentinel."""
    rows = index.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"))
    both = meta.join(rows, "chunk_id", "full_outer")
    return both.select("chunk_id", F.when(F.col("fingerprint").isNotNull() & (F.col("n") == 1), F.col("fingerprint")).otherwise(BROKEN).alias("fingerprint"))


def reconcile_plan(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """(chunk_id, action) from fingerprints on both sides: insert, delete, update or unchanged."""
    both = wanted.select("chunk_id", F.col("fingerprint").alias("w")).join(held.select("chunk_id", F.col("fingerprint").alias("h")), "chunk_id", "full_outer")
    return both.select("chunk_id", F.when(F.col("h").isNull(), "insert").when(F.col("w").isNull(), "delete").when(F.col("w") != F.col("h"), "update").otherwise("unchanged").alias("action"))


def churn(plan: DataFrame, most: float = 0.2) -> DataFrame:
    """One row: counts of a plan, its churn against the larger side, and whether that is too much. An empty index may be filled."""
    n = lambda *a: F.count(F.when(F.col("action").isin(*a), 1))
    row = plan.agg(n("insert").alias("inserted"), n("delete").alias("deleted"), n("update").alias("updated"), n("unchanged").alias("unchanged"))
    wanted, held = F.col("inserted") + F.col("updated") + F.col("unchanged"), F.col("deleted") + F.col("updated") + F.col("unchanged")
    ratio = (F.col("inserted") + F.col("deleted") + F.col("updated")) / F.greatest(wanted, held, F.lit(1))
    return row.withColumn("churn", F.round(ratio, 6)).withColumn("abort", (held > 0) & (ratio > most))


def apply_reconcile(plan: DataFrame, index: DataFrame, rows: DataFrame, most: float = 0.2) -> DataFrame:
    """The index after the plan: kept rows of index and new rows of rows. Raises ChurnTooHigh."""
    report = churn(plan, most).first()
    if report["abort"]:
        raise ChurnTooHigh(str(report.asDict()))
    kept = index.join(plan.filter("action = 'unchanged'").select("chunk_id"), "chunk_id", "left_semi")
    return kept.unionByName(rows.join(plan.filter("action IN ('insert', 'update')").select("chunk_id"), "chunk_id", "left_semi"))


def orphan_chunks(registry: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(filepath, chunk_id, tier) of registered files that are gone: chunks by path, summaries by title and folder, and by title and source where those find nothing.

    What is found by path and by title has the tier path.
    """
    gone = registry.join(files.select("filepath"), "filepath", "left_anti").select("filepath", "filename", T.folder_of(F.col("filepath"), "kb").alias("folder"))
    c = chunks.select("chunk_id", "file_path", "title", F.col("folder").alias("c_folder"), "source")
    by_path = gone.join(c, F.col("filepath") == F.col("file_path")).select("filepath", "chunk_id", F.lit("path").alias("tier"))
    summaries = c.filter(F.col("chunk_id").startswith("doc_summary_"))
    by_title = gone.join(summaries, (F.col("filename") == F.col("title")) & (F.col("folder") == F.col("c_folder"))).select("filepath", "chunk_id", F.lit("title").alias("tier"))
    found = by_path.unionByName(by_title)
    rest = gone.join(found.select("filepath").distinct(), "filepath", "left_anti")
    fallback = rest.join(c, (F.col("filename") == F.col("title")) & (F.col("source") == "document")).select("filepath", "chunk_id", F.lit("fallback").alias("tier"))
    found = found.groupBy("filepath", "chunk_id").agg(F.when(F.bool_or(F.col("tier") == "path"), "path").otherwise("title").alias("tier"))
    return found.unionByName(fallback.distinct())


def realign_plan(registry: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(filepath, verdict, target): where each registered file is now.

    aligned or modified by path; else by hash: realign to the one file with it, or why not: several, registered
    already, no chunks, or wanted by another; orphan without any.
    """
    reg = registry.select("filepath", F.col("hash").alias("r_hash"))
    here = files.select("filepath", F.col("hash").alias("f_hash"))
    by_hash = files.groupBy("hash").agg(F.count(F.lit(1)).alias("places"), F.min("filepath").alias("target"))
    rows = reg.join(here, "filepath", "left").join(by_hash.withColumnRenamed("hash", "r_hash"), "r_hash", "left")
    rows = rows.join(reg.select(F.col("filepath").alias("target"), F.lit(True).alias("taken")), "target", "left")
    rows = rows.join(chunks.groupBy(F.col("file_path").alias("filepath")).agg(F.count(F.lit(1)).alias("held")), "filepath", "left")
    moved = F.col("f_hash").isNull() & (F.col("places") == 1) & F.col("taken").isNull() & F.col("held").isNotNull()
    wanted = rows.filter(moved).groupBy("target").agg(F.count(F.lit(1)).alias("wanted"))
    rows = rows.join(wanted, "target", "left")
    verdict = (
        F.when(F.col("f_hash") == F.col("r_hash"), "aligned").when(F.col("f_hash").isNotNull(), "modified").when(F.col("places").isNull(), "orphan")
        .when(F.col("places") > 1, "skipped: several").when(F.col("taken"), "skipped: registered").when(F.col("held").isNull(), "skipped: no chunks")
        .when(F.col("wanted") > 1, "skipped: wanted twice").otherwise("realign")
    )
    return rows.select("filepath", verdict.alias("verdict"), F.when(verdict == "realign", F.col("target")).alias("target"))


def purge_plan(facts: DataFrame, doc_hashes: DataFrame) -> DataFrame:
    """(id, action, docs, kept_refs, lost) for facts touched by removing documents (hash).

    victim: from a chunk of one; quarantine: derived from a victim, with the references that stay; reset: superseded by a victim.
    """
    key = F.regexp_extract("chunk_id", "^doc_(.+)_chunk_[0-9]+$", 1)
    victims = facts.withColumn("hash", key).join(doc_hashes.select("hash").distinct(), "hash").select("id", "hash")
    none = F.array().cast("array<bigint>")
    base = victims.select("id", F.lit("victim").alias("action"), F.array("hash").alias("docs"), none.alias("kept_refs"), F.lit(0).cast("long").alias("lost"))
    refs = facts.filter("relation_type = 'derived'").select("id", "derived_from", F.explode("derived_from").alias("ref"))
    hit = refs.join(victims.select(F.col("id").alias("ref"), "hash"), "ref").groupBy("id").agg(F.first("derived_from").alias("d"), F.sort_array(F.collect_set("hash")).alias("docs"), F.collect_set("ref").alias("gone"))
    held = hit.select("id", F.lit("quarantine").alias("action"), "docs", F.array_except("d", "gone").alias("kept_refs"), F.size("gone").cast("long").alias("lost"))
    reset = facts.select("id", "superseded_by").join(victims.select(F.col("id").alias("superseded_by"), "hash"), "superseded_by")
    reset = reset.join(victims.select("id"), "id", "left_anti").select("id", F.lit("reset").alias("action"), F.array("hash").alias("docs"), none.alias("kept_refs"), F.lit(0).cast("long").alias("lost"))
    return base.unionByName(held.join(victims.select("id"), "id", "left_anti")).unionByName(reset)


def apply_purge(facts: DataFrame, plan: DataFrame) -> DataFrame:
    """facts without victims; quarantined ones marked and cut to the references that stay, resets live again."""
    held = plan.filter("action = 'quarantine'").select("id", "kept_refs", F.lit(True).alias("q"))
    reset = plan.filter("action = 'reset'").select("id", F.lit(True).alias("r")).distinct()
    rows = facts.join(plan.filter("action = 'victim'").select("id"), "id", "left_anti").join(held, "id", "left").join(reset, "id", "left")
    return rows.withColumns({
        "relation_type": F.when(F.col("q"), "derived_purged_source").otherwise(F.col("relation_type")),
        "derived_from": F.when(F.col("q"), F.col("kept_refs")).otherwise(F.col("derived_from")),
        "superseded_by": F.when(F.col("r"), None).otherwise(F.col("superseded_by")),
    }).drop("q", "r", "kept_refs")


def invalidate_sidecars(table: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Rows of a table but those of chunks with the prefixes (prefix), taken literally."""
    keyed = table.withColumn("prefix", F.regexp_extract("chunk_id", "^(.*)_chunk_[^_]*$", 1))
    return keyed.join(prefixes.select("prefix").distinct(), "prefix", "left_anti").drop("prefix")


#: A chunk is superseded only by one of its own rank or a higher one; sources not named have the least.
SOURCE_RANK = {"document": 3, "doc_summary": 2, "conv_summary": 1}


def apply_chunk_relations(chunks: DataFrame, verdicts: DataFrame, least: float = 0.7) -> DataFrame:
    """chunks with superseded_by, supersedes, extends and extended_by as sorted comma lists, from verdicts (new_id, old_id, relation, confidence) that are sure enough and don't go against the sources' ranks."""
    rank = lambda c: F.coalesce(F.create_map(*[F.lit(x) for kv in SOURCE_RANK.items() for x in kv])[c], F.lit(0))
    ids = chunks.select("chunk_id", "source")
    v = verdicts.filter(F.col("confidence") >= least).join(ids.select(F.col("chunk_id").alias("new_id"), F.col("source").alias("ns")), "new_id").join(ids.select(F.col("chunk_id").alias("old_id"), F.col("source").alias("os")), "old_id")
    v = v.filter(rank(F.col("ns")) >= rank(F.col("os")))

    def side(relation: str, key: str, value: str, name: str) -> DataFrame:
        return v.filter(F.col("relation") == relation).groupBy(F.col(key).alias("chunk_id")).agg(F.array_join(F.sort_array(F.collect_set(value)), ",").alias(name))

    for args in (("SUPERSEDES", "old_id", "new_id", "new_superseded_by"), ("SUPERSEDES", "new_id", "old_id", "supersedes"), ("EXTENDS", "new_id", "old_id", "extends"), ("EXTENDS", "old_id", "new_id", "extended_by")):
        chunks = chunks.join(side(*args), "chunk_id", "left")
    return chunks.withColumn("superseded_by", F.coalesce("new_superseded_by", "superseded_by")).drop("new_superseded_by")


def chunk_supersession_candidates(chunks: DataFrame, k: int = 5, least: float = 0.82, tables: int = 0, bits: int = 10, probes: int = 4) -> DataFrame:
    """(chunk_id, older_id, score, rank): for each chunk, the nearest older live chunks of 50 characters or more.

    All chunks meet all older ones, in parts cut by time, so that of two parts that don't overlap in time only one order is
    computed: exact, and quadratic in the chunks. With tables, only chunks that share a cell of so many tables of
    random hyperplanes meet: some neighbours near least are missed, and the work grows with the cells' sizes.
    """
    rows = vector_rows(chunks, "chunk_id", times="create_time").filter("t IS NOT NULL")
    old = chunks.filter("coalesce(superseded_by, '') = '' AND length(text) >= 50")
    older, names = vector_rows(old, "chunk_id", times="create_time").filter("t IS NOT NULL"), ("chunk_id", "older_id")
    found = likely_older_neighbours(rows, older, k, least, names, tables, bits, probes) if tables else older_neighbours(rows, older, k, least, names)
    return top(found, ["chunk_id"], [F.desc("score"), F.col("older_id")], k)


def audit_vectors(stored: DataFrame, expected: DataFrame, least: float = 0.9999) -> DataFrame:
    """(chunk_id, verdict) for stored vectors against expected ones and those of the prefixed text (alternative)."""
    rows = expected.join(stored.select("chunk_id", F.col("embedding").alias("s")), "chunk_id", "left")
    a, b = T.cosine(F.col("s"), F.col("embedding")), T.cosine(F.col("s"), F.col("alternative"))
    return rows.select("chunk_id", F.when(F.col("s").isNull(), "missing").when(a >= least, "healthy").when((b >= least) & (b > a), "violator").otherwise("irreproducible").alias("verdict"))


def conversations_without_summary(chunks: DataFrame) -> DataFrame:
    """(conv_id, date, title) without a summary chunk; the first chunk of each, newest first."""
    done = chunks.filter(F.col("chunk_id").startswith("conv_summary_")).select("conv_id").distinct()
    rows = chunks.filter(~T.is_derived_chunk(F.col("chunk_id"))).join(done, "conv_id", "left_anti")
    first = rows.groupBy("conv_id").agg(F.min_by(F.struct("date", "title"), F.struct("chunk_index", "chunk_id")).alias("f"))
    return first.select("conv_id", "f.date", "f.title").orderBy(F.desc_nulls_last("date"), "conv_id")


def documents_without_summary(registry: DataFrame, chunks: DataFrame) -> DataFrame:
    """Registered files with chunks and no summary of their title and folder."""
    done = chunks.filter(F.col("chunk_id").startswith("doc_summary_")).select(F.col("title").alias("filename"), "folder").distinct()
    return registry.filter("chunks > 0").withColumn("folder", T.folder_of(F.col("filepath"), "kb")).join(done, ["filename", "folder"], "left_anti")


def classify_files(files: DataFrame, registry: DataFrame, tries: int = 3) -> DataFrame:
    """(filepath, verdict): duplicate beyond the first path of a hash, failed too often, new, modified or unchanged."""
    rows = files.withColumn("nth", F.row_number().over(W.partitionBy("hash").orderBy("filepath")))
    rows = rows.join(registry.select("filepath", F.col("hash").alias("known"), "fail_count"), "filepath", "left")
    verdict = F.when(F.col("nth") > 1, "duplicate").when(F.col("fail_count") >= tries, "failed").when(F.col("known").isNull(), "new").when(F.col("known") != F.col("hash"), "modified").otherwise("unchanged")
    return rows.select("filepath", verdict.alias("verdict"))


def prune_checkpoint(checkpoint: DataFrame, todo: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stale, kept): ids of a checkpoint that are to be done again, and the others."""
    return checkpoint.intersect(todo), checkpoint.subtract(todo)


def known_ids(*sources: DataFrame) -> DataFrame:
    out = sources[0]
    for s in sources[1:]:
        out = out.union(s)
    return out.distinct()


def new_ids(ids: DataFrame, known: DataFrame) -> DataFrame:
    return ids.join(known, ids.columns, "left_anti")


def merged_streams(streams: list[DataFrame], key: str) -> DataFrame:
    """Ordered union of streams (with position): the first occurrence of a key stays."""
    rows = None
    for n, s in enumerate(streams):
        s = s.withColumn("stream", F.lit(n))
        rows = s if rows is None else rows.unionByName(s)
    first = F.row_number().over(W.partitionBy(key).orderBy("stream", "position"))
    return rows.withColumn("nth", first).filter("nth = 1").drop("nth")


def deduped(items: Column) -> Column:
    """(items, dropped): each item once, in order, and how many went."""
    return F.struct(F.array_distinct(items).alias("items"), (F.size(items) - F.size(F.array_distinct(items))).alias("dropped"))
