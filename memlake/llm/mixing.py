"""Mixing sources to target weights: Pfair blocks, scheduled earliest deadline first."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memlake.llm.tables import Scratch, packed, saved, unpacked

#: Rows to a block.
BLOCK = 16
#: Slots that are scheduled together.
FRAME = 128
#: About so many rows of a source are ranked in one task.
RANKED = 50_000
#: What whole-number weights may add up to, so that products with slots stay within 64 bits.
MOST_WEIGHT = 1_000_000_000
#: Columns that scheduled() adds.
ADDED = ("block", "release", "deadline", "slot")


def whole_weights(weights: dict[str, int | float | Fraction]) -> dict[str, int]:
    """The same proportions in whole numbers, exactly; a float counts as the decimal number that it is written as."""
    exact = {k: Fraction(str(v)) for k, v in weights.items()}
    if any(v < 0 for v in exact.values()) or not any(exact.values()):
        raise ValueError("weights must not be negative, and one at least must be positive")
    scale = math.lcm(*[v.denominator for v in exact.values()])
    whole = {k: int(v * scale) for k, v in exact.items()}
    common = math.gcd(*whole.values())
    whole = {k: v // common for k, v in whole.items()}
    if sum(whole.values()) > MOST_WEIGHT:
        raise ValueError(f"the weights have no common measure of {MOST_WEIGHT} parts or fewer")
    return whole


def target_weights(sizes: DataFrame, weights: dict[str, int | float | Fraction] | None = None) -> DataFrame:
    """sizes (src, source, n) with w, the whole-number target weight: as given, 0 for sources not named; else the whole root of n."""
    if weights is None:
        return sizes.withColumn("w", F.floor(F.sqrt(F.col("n").cast("double"))).cast("long"))
    given = F.create_map(*[F.lit(x) for kv in whole_weights(weights).items() for x in kv])
    return sizes.withColumn("w", F.coalesce(given[F.col("source")].cast("long"), F.lit(0).cast("long")))


#: s: the sources by name, each with its weight w and its n blocks; q: the sum of weights; t: the frame's first slot.
_DUE = "least(x.n, x.w * t div q)"
#: The next block of each source that isn't due by t, where it is released before t, latest first.
_OPEN = f"""array_sort(filter(
    transform(s, (x, i) -> struct(-({_DUE} * q div x.w) AS late, (({_DUE} + 1) * q + x.w - 1) div x.w AS due, i AS i, {_DUE} < x.n AS more)),
    o -> o.more AND -o.late < t))"""
#: Slots from the release of o up to t that blocks released then and due by t leave free.
_FREE = f"t + o.late - aggregate(s, 0L, (c, x) -> c + greatest(0L, {_DUE} - (x.w * -o.late + q - 1) div q))"
#: Of those blocks the ones that have had a slot by t, at a guess: as many as fit, those due first.
_EARLY = f"""slice(aggregate({_OPEN}, CAST(array() AS array<struct<due:bigint,i:int>>), (kept, o) ->
    slice(array_sort(array_append(kept, struct(o.due AS due, o.i AS i))), 1, CAST({_FREE} AS int))), 1, CAST(t - aggregate(s, 0L, (c, x) -> c + {_DUE}) AS int))"""
#: Which block comes next of each source that has any left.
_GUESS = f"""transform(array({_EARLY}), early ->
    filter(transform(s, (x, i) -> struct(i AS i, {_DUE} + IF(exists(early, e -> e.i = i), 1L, 0L) AS j)), h -> h.j < s[h.i].n))[0]"""


def _head(i: str, j: str) -> str:
    return f"struct((({j} + 1) * q + s[{i}].w - 1) div s[{i}].w AS due, {i} AS i, {j} AS j, {j} * q div s[{i}].w AS release)"


def _run(frames: DataFrame, frame: int) -> DataFrame:
    """frames (f, s, q, state) with picks, the blocks of its slots, and after, the state at its end.

    Slot by slot, of the next blocks of all sources the released one that is due first is picked, of equals the first source's.
    """
    picked = f"""aggregate(sequence(f * {frame}, (f + 1) * {frame} - 1), struct(transform(state, h -> {_head("h.i", "h.j")}) AS heads, CAST(array() AS array<struct<i:int,block:bigint,slot:bigint>>) AS picks), (acc, slot) ->
      transform(array(array_min(filter(acc.heads, h -> h.release <= slot))), pick -> IF(pick IS NULL, acc, struct(
        filter(transform(acc.heads, h -> IF(h.i = pick.i, {_head("h.i", "(h.j + 1)")}, h)), h -> h.j < s[h.i].n) AS heads,
        array_append(acc.picks, struct(pick.i AS i, pick.j AS block, slot AS slot)) AS picks)))[0])"""
    rows = frames.withColumn("out", F.expr(picked))
    return rows.select("f", "state", F.col("out.picks").alias("picks"), F.expr("transform(out.heads, h -> struct(h.i AS i, h.j AS j))").alias("after"))


def edf_schedule(sizes: DataFrame, frame: int = FRAME) -> DataFrame:
    """(src, block, release, deadline, slot) of every block of sizes (src, w, blocks).

    Block j of a source with weight w of q in all is released at floor(j * q / w) and due at ceil((j + 1) * q / w); each
    slot goes to the released block that is due first, of equals the first source's. Time is cut into frames that are
    worked out side by side, each from a guess, by the weights alone, at which blocks had a slot before it. A frame
    whose guess differs from how the frame before it ends is worked out again from there, until none does: the schedule
    is then that of one run through all slots. A frame holds the list of sources, so that these may be some ten
    thousand. Sources of weight 0 follow after all others, one by one, without release and deadline.
    """
    spark, scratch = sizes.sparkSession, Scratch(sizes.sparkSession)
    positive, rest = sizes.filter("w > 0 AND blocks > 0"), sizes.filter("w <= 0 AND blocks > 0")
    q = positive.agg(F.sum("w")).first()[0] or 1
    if q > MOST_WEIGHT:
        raise ValueError("target weights add up to too much")
    last = positive.agg(F.max(F.expr(f"(blocks * {q} + w - 1) div w"))).first()[0] or 0
    sources = scratch.saved(positive.groupBy().agg(F.array_sort(F.collect_list(F.struct("src", "w", F.col("blocks").alias("n")))).alias("s"), F.lit(q).cast("long").alias("q")), "sources")

    frames = -(-last // frame)
    dealt = max(1, min(frames, max(int(spark.conf.get("spark.sql.shuffle.partitions")), frames // 64)))
    at = spark.range(0, frames, 1, dealt).select(F.col("id").alias("f"), (F.col("id") * frame).alias("t"))
    guessed = scratch.saved(at.crossJoin(F.broadcast(sources)).select("f", F.expr(_GUESS).alias("state")), "guesses")
    done = scratch.saved(_run(guessed.crossJoin(F.broadcast(sources)), frame), "frames")
    scratch.drop(guessed)
    while True:
        ends = done.select((F.col("f") + 1).alias("f"), F.col("after").alias("now"))
        wrong = scratch.saved(done.select("f", "state").join(ends, "f").filter("state <> now").select("f", F.col("now").alias("state")), "wrong")
        if wrong.isEmpty():
            break
        again = scratch.saved(_run(wrong.repartition(dealt, "f").crossJoin(F.broadcast(sources)), frame), "again")
        before, done = done, scratch.saved(done.join(wrong.select("f"), "f", "left_anti").unionByName(again), "frames")
        scratch.drop(before, wrong, again)

    x = F.get("s", F.col("p.i"))
    picked = done.select(F.explode("picks").alias("p")).crossJoin(F.broadcast(sources)).select(x["src"].alias("src"), F.col("p.block").alias("block"), x["w"].alias("w"), "q", F.col("p.slot").alias("slot"))
    timed = picked.select("src", "block", F.expr("block * q div w").alias("release"), F.expr("((block + 1) * q + w - 1) div w").alias("deadline"), "slot")
    after = F.coalesce(F.sum("blocks").over(W.orderBy("src").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + last
    none = F.lit(None).cast("long")
    each = rest.withColumn("start", after).select("src", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "start")
    return timed.unionByName(each.select("src", "block", none.alias("release"), none.alias("deadline"), (F.col("start") + F.col("block")).alias("slot")))


def _placed(docs: DataFrame, id_col: str, source_col: str, weights: dict | None, block: int, ranked: int) -> DataFrame:
    """(doc, block, release, deadline, slot)."""
    src: Column = F.coalesce(F.concat(F.lit("="), docs[source_col].cast("string")), F.lit(""))
    key = F.md5(F.coalesce(docs[id_col].cast("string"), F.lit("")).cast("binary"))
    sizes = docs.groupBy(src.alias("src"), docs[source_col].cast("string").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    sizes = saved(target_weights(sizes, weights).withColumn("blocks", F.expr(f"(n + {block - 1}) div {block}")), "sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    digits = max(1, math.ceil(math.log(max(1, total / ranked), 16)))
    schedule = saved(edf_schedule(sizes), "schedule")

    rows = packed(docs, src=src, key=key, bucket=F.substring(key, 1, digits), id=docs[id_col])
    counts = rows.groupBy("src", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("src").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("src", "bucket", before.alias("before"))
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("src", "bucket").orderBy("key", "id")))
    rows = rows.join(offsets, ["src", "bucket"]).withColumn("block", F.floor((F.col("before") + F.col("rank") - 1) / block).cast("long"))
    return rows.join(schedule, ["src", "block"]).select("doc", *ADDED)


def scheduled(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: dict[str, int | float | Fraction] | None = None, block: int = BLOCK, ranked: int = RANKED) -> DataFrame:
    """All rows and columns of docs, and block, release, deadline, slot (long): the mix is docs in the order of slot.

    A source's rows are ranked by the MD5 of their ids, which shuffles them, and cut into blocks. While all sources
    last, each has had its weight of the blocks up to any slot, to less than one block; the slots of one that has
    ended go to blocks that are released, or stay empty, and no row is dropped or repeated. Weights are exact; without
    any a source weighs the whole root of its rows, and with some a source that they don't name weighs nothing and
    comes last. Ranks come from counts per hash prefix, so that a hot source is ranked in many tasks. A null source is
    a source of its own; null ids rank like empty text, repeated ids in either order. An empty table gives an empty
    table. The four columns replace those of docs with the same names.
    """
    rows = _placed(docs, id_col, source_col, weights, block, ranked)
    return rows.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns if c not in ADDED], *ADDED)


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: dict[str, int | float | Fraction] | None = None, block: int = BLOCK, ranked: int = RANKED) -> DataFrame:
    """docs in the order of the mix: ranges of slots to each partition, sorted within.

    Rows, columns and edge cases are those of scheduled(); the order is that of its slot.
    """
    rows = _placed(docs, id_col, source_col, weights, block, ranked).select("slot", "doc")
    return unpacked(rows.repartitionByRange("slot").sortWithinPartitions("slot"), docs.columns)
