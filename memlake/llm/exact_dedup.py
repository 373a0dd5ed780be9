"""Exact deduplication by skew-safe combining."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.llm.tables import join_to_groups, packed, saved, unpacked

#: A group of copies is merged in as many parts as this before its winners meet.
SALTS = 64
#: Rows that repeat an id and its text are counted out in runs of so many.
RUN = 10_000


def normalised(text: Column) -> Column:
    """A-Z in lower case, all else as it is; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _counted_out(rows: DataFrame) -> DataFrame:
    """As many rows as copies says for each of rows, the first of them marked; no array grows past RUN or copies / RUN."""
    runs = rows.withColumn("run", F.explode(F.sequence(F.lit(0), F.expr(f"(copies - 1) div {RUN}"))))
    each = runs.withColumn("nth", F.explode(F.sequence(F.lit(0), F.least(F.lit(RUN), F.expr(f"copies - run * {RUN}")) - 1)))
    return each.withColumn("first", (F.col("run") == 0) & (F.col("nth") == 0))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256_hex) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256.

    Texts are grouped by digest and full text in two steps. First each input partition merges its own copies and
    the partitions' results are merged per (digest, text, salt), the salt being the partition's number; then at most
    SALTS winners of each text are combined. Neither step holds a group's rows together, and text equality decides
    in both. Rows then take their group by digest alone, unless two texts share a digest: then by text as well. The
    rows of a large group meet it in many parts.

    Null texts are empty ones. The largest id of a group stays; null ids lose to any other. Rows that repeat an id
    and its text count one by one, and one of them stays. An empty table gives an empty table. Other columns of docs
    are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"))
    keyed = rows.withColumn("digest", digest(F.col("norm")))
    local = keyed.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))).groupBy("digest", "norm", "salt").agg(F.max("id").alias("id"), F.count(F.lit(1)).alias("n"))
    groups = local.groupBy("digest", "norm").agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"))

    classes = saved(groups.select("digest", "keep_id", "group_size"), "classes")
    clashes = classes.groupBy("digest").count().filter("count > 1")
    if clashes.isEmpty():
        found = join_to_groups(keyed.groupBy("id", "digest").agg(F.count(F.lit(1)).alias("copies")), classes, "digest", "group_size", "id")
    else:
        found = keyed.groupBy("id", "digest", "norm").agg(F.count(F.lit(1)).alias("copies")).join(groups, ["digest", "norm"])
    return _counted_out(found).select(
        F.col("id").alias(id_col), "keep_id", "group_size", (F.col("first") & F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"), F.col("digest").alias("text_sha256")
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows that repeat an id and its text, one.

    Which stays, and what null ids and texts count as, is exact_duplicates()'s: null texts are empty ones, so one row of
    all null and empty texts stays. Columns of any names are kept as they are. An empty table gives an empty table.
    """
    # as a struct, a null id equals a null id, and dropDuplicates() finds the rows where the join has put them: texts travel once
    kept = exact_duplicates(docs, id_col, text_col).filter("kept").select(F.struct(F.col(id_col).alias("id"), F.col("text_sha256").alias("digest")).alias("key"))
    rows = packed(docs, key=F.struct(docs[id_col].alias("id"), sha256_hex(normalised(docs[text_col])).alias("digest")))
    return unpacked(rows.join(kept, "key", "left_semi").dropDuplicates(["key"]), docs.columns)
