"""Statistics of a store, and metric series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memlake.operators.search import top


def kb_stats(chunks: DataFrame) -> DataFrame:
    """Per source and for all: chunks, conversations, characters, tokens, first and last date, undated."""
    dated = F.nullif(F.coalesce("date", F.lit("")), F.lit(""))
    agg = [F.count(F.lit(1)).alias("chunks"), F.countDistinct("conv_id").alias("conversations"), F.sum("char_count").alias("chars"), F.floor(F.sum("char_count") / 4).cast("long").alias("tokens"), F.min(dated).alias("first_date"), F.max(dated).alias("last_date"), F.count(F.when(dated.isNull(), 1)).alias("undated")]
    return chunks.groupBy("source").agg(*agg).unionByName(chunks.agg(*agg).withColumn("source", F.lit("all")))


#: Bits of a sketch's buckets. The relative standard error of merged sketches is 1.04 divided by the root of the buckets, 0.8 %.
SKETCH_BITS = 14
#: The relative error that no count is to have: over four of those standard errors.
SKETCH_ERROR = 3 * 0.83 / 2**6


def sketched(rows: DataFrame, keys: tuple[str, ...], counted: dict[str, str]) -> DataFrame:
    """(keys, n, a sketch for each of counted): rows, and distinct values of columns as sketches of some kilobytes, to be kept as a table.

    The sketch of a day or a source is made once, from that day's rows; merged_sketches() adds what comes later.
    """
    sketches = [F.hll_sketch_agg(F.col(c).cast("string"), SKETCH_BITS).alias(name) for name, c in counted.items()]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sketches)


def _sketch_names(sketches: DataFrame) -> list[str]:
    return [f.name for f in sketches.schema.fields if f.dataType.simpleString() == "binary"]


def merged_sketches(*tables: DataFrame) -> DataFrame:
    """One table of sketches out of several that have the same columns; a value in many of them counts once."""
    every = reduce(DataFrame.unionByName, tables)
    names = _sketch_names(every)
    keys = [c for c in every.columns if c not in (*names, "n")]
    return every.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.hll_union_agg(name).alias(name) for name in names])


def distinct_counts(sketches: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, about how many distinct values each sketch has seen), rolled up to some of the keys, or to one row; the raw rows aren't read."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.hll_sketch_estimate(F.hll_union_agg(name)).alias(name) for name in _sketch_names(sketches)])


def rows_by(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, n): chunks by source or folder, orphans by folder, index rows by source, chunks by model and the like; a missing value counts as empty."""
    return df.groupBy(*[F.coalesce(F.col(k), F.lit("")).alias(k) for k in keys]).agg(F.count(F.lit(1)).alias("n"))


def top_models(chunks: DataFrame, n: int = 5) -> DataFrame:
    """The models with the most chunks; unknown where there is none."""
    named = chunks.select(F.coalesce(F.nullif("model", F.lit("")), F.lit("unknown")).alias("model"))
    return rows_by(named, "model").orderBy(F.desc("n"), "model").limit(n)


def coverage_stats(chunks: DataFrame, facts: DataFrame, log: DataFrame) -> DataFrame:
    """One row: chunks, facts by kind, chunks with an extracted fact, skipped and finally failed ones, and what could be covered."""
    c = chunks.agg(F.count(F.lit(1)).alias("chunks"))
    f = facts.agg(F.count(F.lit(1)).alias("facts"), F.count(F.when(F.col("relation_type") == "derived", 1)).alias("derived"), F.count(F.when(F.col("superseded_by").isNotNull(), 1)).alias("superseded"), F.countDistinct(F.when(F.col("relation_type") == "extracted", F.col("chunk_id"))).alias("covered"))
    g = log.agg(F.count(F.when(F.col("model").startswith("skipped_"), 1)).alias("skipped"), F.count(F.when(F.col("model") == "failed_persistent", 1)).alias("failed"))
    row = c.crossJoin(f).crossJoin(g)
    return row.withColumn("coverable", F.greatest(F.lit(0), F.col("chunks") - F.col("skipped") - F.col("failed")))


def list_conversations(chunks: DataFrame, n: int) -> DataFrame:
    """Per conversation the title, date and source of its first chunk, chunks and characters; newest first."""
    rows = chunks.groupBy("conv_id").agg(F.min_by(F.struct("title", "date", "source"), F.struct("chunk_index", "chunk_id")).alias("f"), F.count(F.lit(1)).alias("chunks"), F.sum("char_count").alias("chars"))
    return rows.select("conv_id", "f.title", "f.date", "f.source", "chunks", "chars").orderBy(F.desc_nulls_last("date"), "conv_id").limit(n)


def supersession_stats(facts: DataFrame, judged: DataFrame) -> DataFrame:
    """(name, n): facts, superseded, affected chunks, and verdicts by kind."""
    f = facts.agg(F.count(F.lit(1)).alias("facts"), F.count("superseded_by").alias("superseded"), F.countDistinct(F.when(F.col("superseded_by").isNotNull(), F.col("chunk_id"))).alias("affected_chunks"))
    rows = f.unpivot([], ["facts", "superseded", "affected_chunks"], "name", "n")
    return rows.unionByName(judged.groupBy(F.concat(F.lit("verdict_"), "verdict").alias("name")).agg(F.count(F.lit(1)).alias("n")))


def reuse_rate(facts: DataFrame, judged: DataFrame) -> DataFrame:
    """One row: verdicts, those later than both of their facts, and their share in percent."""
    side = lambda c: facts.select(F.col("id").alias(f"fact_id_{c}"), F.col("created_at").alias(c))
    both = judged.join(side("a"), "fact_id_a", "left").join(side("b"), "fact_id_b", "left")
    good = F.count(F.when((F.col("a") < F.col("judged_at")) & (F.col("b") < F.col("judged_at")), 1))
    return both.agg(F.count(F.lit(1)).alias("judged"), good.alias("reusable")).withColumn("percent", F.round(100 * F.col("reusable") / F.greatest("judged", F.lit(1)), 1))


def fact_totals(facts: DataFrame, log: DataFrame) -> DataFrame:
    """One row: facts, superseded ones, chunks worked on, and the mean number of facts of chunks that gave any."""
    f = facts.agg(F.count(F.lit(1)).alias("facts"), F.count("superseded_by").alias("superseded"))
    g = log.agg(F.count(F.lit(1)).alias("chunks"), F.round(F.coalesce(F.avg(F.when(F.col("facts_count") > 0, F.col("facts_count"))), F.lit(0.0)), 6).alias("mean_facts"))
    return f.crossJoin(g)


def fact_stats(facts: DataFrame, n: int = 15) -> DataFrame:
    """The most frequent categories with their facts, chunks and mean facts a chunk."""
    rows = facts.groupBy("category").agg(F.count(F.lit(1)).alias("facts"), F.countDistinct("chunk_id").alias("chunks"))
    return rows.withColumn("per_chunk", F.round(F.col("facts") / F.col("chunks"), 6)).orderBy(F.desc("facts"), "category").limit(n)


def relation_stats(chunks: DataFrame) -> DataFrame:
    filled = lambda c: F.count(F.when(F.coalesce(F.col(c), F.lit("")) != "", 1))
    return chunks.agg(*[filled(c).alias(c) for c in ("superseded_by", "supersedes", "extends", "extended_by")], F.count(F.lit(1)).alias("checked"))


def run_delta(facts: DataFrame, since: str) -> DataFrame:
    """One row: what a run brought since a time."""
    new = F.col("created_at") >= since
    return facts.agg(
        F.count(F.when(new & (F.col("relation_type") != "derived"), 1)).alias("extracted"), F.count(F.when(new & (F.col("relation_type") == "derived"), 1)).alias("derived"),
        F.count(F.when(F.col("superseded_at") >= since, 1)).alias("superseded"), F.countDistinct(F.when(new, F.col("chunk_id"))).alias("chunks"),
    )


def size_profile(df: DataFrame, size: Column, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("total"), F.round(F.avg(size), 6).alias("mean"), F.min(size).alias("least"), F.max(size).alias("most"))


def rows_by_marker(chunks: DataFrame) -> DataFrame:
    """Chunk and summary rows per path."""
    summary = F.col("chunk_id").startswith("doc_summary_")
    return chunks.groupBy("file_path").agg(F.sum(F.when(summary, 0).otherwise(1)).alias("chunks"), F.sum(F.when(summary, 1).otherwise(0)).alias("summaries"))


def last_messages(messages: DataFrame, n: int) -> DataFrame:
    """The newest n messages of each session with their order, oldest first."""
    rows = top(messages, ["conv_id"], [F.desc("turn")], n, "back")
    return rows.withColumn("place", F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))).drop("back")


def session_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), F.count(F.when(F.col("role") == "user", 1)).alias("user_messages"), F.max("turn").alias("last_turn"))


def list_sessions(messages: DataFrame, n: int) -> DataFrame:
    """The sessions with the latest turns."""
    return session_counts(messages).orderBy(F.desc("last_turn"), "conv_id").limit(n)


def conversation_text(chunks: DataFrame, parts: int = 8, chars: int = 8000) -> DataFrame:
    """(conv_id, text): the first parts of each conversation, up to the one that reaches chars, joined and cut."""
    w = W.partitionBy("conv_id").orderBy("chunk_index")
    rows = chunks.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= parts)
    rows = rows.withColumn("before", F.coalesce(F.sum(F.length("text")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).filter(F.col("before") < chars)
    joined = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("nth", "text"))).alias("t"))
    return joined.select("conv_id", F.substring(F.array_join(F.transform("t", lambda x: x["text"]), "\n---\n"), 1, chars).alias("text"))


def recent_summaries(chunks: DataFrame, category: str, since: str, n: int) -> DataFrame:
    rows = chunks.filter((F.col("category") == category) & (F.col("date") >= since))
    return rows.select("chunk_id", "date", F.substring("text", 1, 2000).alias("text")).orderBy(F.desc_nulls_last("date"), "chunk_id").limit(n)


def extraction_priority(chunks: DataFrame) -> DataFrame:
    """chunks with place: conversation summaries, document summaries, the rest; each by date."""
    kind = F.when(F.col("chunk_id").startswith("conv_summary_"), 0).when(F.col("chunk_id").startswith("doc_summary_"), 1).otherwise(2)
    return chunks.withColumn("tier", kind).orderBy("tier", F.asc_nulls_first("date"), "chunk_id")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


#: Buckets that a window of time is cut into; it reaches over these, and over parts of one more at either end.
WINDOW_BUCKETS = 16


def _looking_back(series: DataFrame, seconds: int, keys: tuple[str, ...]) -> DataFrame:
    """series (ts, value) with anchor, the latest value at least so many seconds older, and lowest, the least value since that time, as of each row.

    A key's time is cut into buckets, WINDOW_BUCKETS to a window, and a task has rows of one bucket and those of the bucket
    that lies a window before it: the first look up their anchor among the second, and the lowest of those that are
    young enough. What lies between, and before, comes from one row for each bucket, its last value and its least. So a
    key with many rows is many tasks' work. Of rows at one time the greatest value counts as the latest.
    """
    length, m = seconds * 1_000_000 // WINDOW_BUCKETS, WINDOW_BUCKETS
    names = [f"k{n}" for n in range(len(keys))]
    rows = series.select(F.struct(*[F.col(f"`{c}`") for c in series.columns]).alias("r"), *[F.col(k).alias(n) for k, n in zip(keys, names)], micros(F.col("ts")).alias("us"), F.col("value").alias("v"))
    rows = rows.filter("us IS NOT NULL").withColumn("b", F.expr(f"(us - pmod(us, {length}L)) div {length}L"))
    asking = rows.select("r", *names, "b", (F.col("us") - seconds * 1_000_000).alias("at"), F.lit(None).cast(rows.schema["v"].dataType).alias("old"), "v", F.lit(False).alias("told"))
    telling = rows.select(F.lit(None).cast(rows.schema["r"].dataType).alias("r"), *names, (F.col("b") + m).alias("b"), F.col("us").alias("at"), F.col("v").alias("old"), F.lit(None).cast(rows.schema["v"].dataType).alias("v"), F.lit(True).alias("told"))
    place = W.partitionBy(*names, "b")
    up, down = (place.orderBy(o).rangeBetween(W.unboundedPreceding, 0) for o in (F.asc("at"), F.desc("at")))
    met = asking.unionByName(telling).select("r", *names, "b", "told", F.max(F.when(F.col("told"), F.struct("at", "old"))).over(up).alias("near"), F.min("v").over(up).alias("own"), F.min("old").over(down).alias("young"))

    order = W.partitionBy(*names).orderBy("b")
    buckets = rows.groupBy(*names, "b").agg(F.max(F.struct("us", "v")).alias("last"), F.min("v").alias("low"))
    buckets = buckets.select(*[F.col(n).alias(f"_{n}") for n in names], F.col("b").alias("_b"), F.max("last").over(order.rangeBetween(W.unboundedPreceding, -m - 1)).alias("far"), F.min("low").over(order.rangeBetween(1 - m, -1)).alias("between"))
    same = [F.col("b") == F.col("_b"), *[F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names]]
    joined = met.filter("NOT told").join(buckets, reduce(lambda x, y: x & y, same))
    anchor = F.when(F.col("near").isNotNull(), F.col("near.old")).otherwise(F.col("far.v"))
    return joined.select("r.*", anchor.alias("anchor"), F.least("own", "young", "between").alias("lowest"))


def at_or_before(series: DataFrame, seconds: int, keys: tuple[str, ...] = ("key",)) -> DataFrame:
    """series (ts, value) with anchor: the latest value at least so many seconds older, as of each row."""
    return _looking_back(series, seconds, keys).drop("lowest")


def sustained_breach(series: DataFrame, threshold: float, seconds: int, keys: tuple[str, ...] = ("key",)) -> DataFrame:
    """series with breach: at the threshold or above now, at the anchor, and at every point of the window between."""
    rows = _looking_back(series.filter(F.col("value").isNotNull()), seconds, keys)
    return rows.withColumn("breach", F.coalesce((F.col("value") >= threshold) & (F.col("anchor") >= threshold) & (F.col("lowest") >= threshold), F.lit(False)))


def non_decreasing_backlog(series: DataFrame, warn: float, seconds: int, keys: tuple[str, ...] = ("key",)) -> DataFrame:
    rows = at_or_before(series, seconds, keys)
    return rows.withColumn("aging", F.coalesce((F.col("value") >= warn) & (F.col("value") >= F.col("anchor")), F.lit(False)))


#: Seconds of a bucket of a key's events.
SESSION_BUCKET = 86_400


def sessionize(events: DataFrame, seconds: float, key: str = "user_id") -> DataFrame:
    """events with session: a gap of so many seconds or more begins another.

    Gaps are found, and sessions counted, within buckets of a key's time; the last event and the count of each bucket
    carry over to the next ones, so that a key with many events is many tasks' work.
    """
    rows = events.select(F.struct(*[F.col(f"`{c}`") for c in events.columns]).alias("r"), F.col(key).alias("k"), F.struct("ts", "event_id").alias("o"), micros(F.col("ts")).alias("us"))
    length = SESSION_BUCKET * 1_000_000
    rows = rows.withColumn("b", F.expr(f"(us - pmod(us, {length}L)) div {length}L"))
    inside, along = W.partitionBy("k", "b").orderBy("o"), W.partitionBy("k").orderBy("b")
    begins = lambda before: F.when(F.col("us") - before >= int(seconds * 1_000_000), 1).otherwise(0)
    rows = rows.withColumn("fresh", begins(F.lag("us").over(inside))).withColumn("so_far", F.sum("fresh").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    buckets = rows.groupBy("k", "b").agg(F.min("us").alias("first"), F.max("us").alias("last"), F.sum("fresh").alias("n"))
    before = F.lag("last").over(along)
    buckets = buckets.withColumn("opens", F.when(before.isNull() | (F.col("first") - before >= int(seconds * 1_000_000)), 1).otherwise(0))
    carried = F.sum(F.col("n") + F.col("opens")).over(along.rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    buckets = buckets.select(F.col("k").alias("k2"), F.col("b").alias("b2"), carried.alias("carried"))
    joined = rows.join(buckets, F.col("k").eqNullSafe(F.col("k2")) & F.col("b").eqNullSafe(F.col("b2")))
    return joined.select("r.*", (F.col("carried") + F.col("so_far")).alias("session"))


def ban_triggers(events: DataFrame, failure: str, tries: int, seconds: int, key: str = "user_id") -> DataFrame:
    """Failures that are at least the tries-th within so many seconds."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.filter(F.col("event_type") == failure).withColumn("us", micros)
    w = W.partitionBy(key).orderBy("us").rangeBetween(-seconds * 1_000_000 + 1, 0)
    return rows.withColumn("failures", F.count(F.lit(1)).over(w)).filter(F.col("failures") >= tries).drop("us")
