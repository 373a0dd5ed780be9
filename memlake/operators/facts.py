"""Facts: validation, coverage, supersession, derivation."""

from __future__ import annotations

import difflib
from collections.abc import Iterable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memlake.functions import text as T
from memlake.operators.search import containing, top

ARRAY = "array<struct<fact:string,category:string,tags:array<string>,event_date:string,expires:string>>"


def active_facts(facts: DataFrame, as_of: str) -> DataFrame:
    """Facts that nothing supersedes and that haven't expired; dates compare as text."""
    return facts.filter(F.col("superseded_by").isNull() & ((F.coalesce("expires_at", F.lit("")) == "") | (F.col("expires_at") > as_of)))


def valid_facts(raw: DataFrame) -> DataFrame:
    """Facts of ten characters or more, cut to fixed lengths; an expiry that isn't a date is dropped."""
    fact, expires = F.trim("fact"), F.coalesce("expires", F.lit(""))
    return raw.filter(F.length(fact) >= 10).select(
        "chunk_id", F.substring(fact, 1, 500).alias("fact"), F.lower(F.substring("category", 1, 50)).alias("category"), F.slice("tags", 1, 10).alias("entity_tags"),
        F.when(expires.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), expires).otherwise("").alias("expires_at"), F.lit(1.0).alias("confidence"), F.col("date").alias("document_date"),
    )


def parsed_facts(responses: DataFrame) -> DataFrame:
    """(chunk_id, facts, ok) from model responses: fenced or bare JSON, a list, {"facts": list} or one fact. A list that was cut off fails as a whole."""
    s = F.trim(F.regexp_replace(F.coalesce("response", F.lit("")), "(?s)^\\s*```(?:json)?|```\\s*$", ""))
    body = F.when(s.startswith("["), s).otherwise(F.regexp_extract(s, "(?s)(\\[.*\\])", 1))
    opened = F.length(F.regexp_replace(s, "[^\\[]", "")) > F.length(F.regexp_replace(s, "[^\\]]", ""))
    wrapped = F.from_json(s, f"struct<facts:{ARRAY}>")["facts"]
    one = F.from_json(s, ARRAY.removeprefix("array<").removesuffix(">"))
    listed = F.coalesce(F.when(s.startswith("{"), wrapped), F.when(s.startswith("{") & one["fact"].isNotNull(), F.array(one)), F.from_json(body, ARRAY))
    facts = F.when(~opened, F.filter(listed, lambda f: f["fact"].isNotNull()))
    return responses.select("chunk_id", F.coalesce(facts, F.from_json(F.lit("[]"), ARRAY)).alias("facts"), facts.isNotNull().alias("ok"))


#: What a line of code or markup has.
CODE_LINE = (
    r'<[a-z/][^>]*>|[{}];|class="|style="|function\s|const\s|let\s|var\s'
    r"|import\s.+from|def\s|return\s|console\.|addEventListener|querySelector"
    r"|getElementById|onClick|onChange|padding:|margin:|font-|border:|display:"
    r"|background:|width:|height:|\.(css|js|py|html)$"
)


def classify_coverable(chunks: DataFrame) -> DataFrame:
    """chunks with verdict: empty (hardly a letter or digit among all characters), short, code (over 60 % of three lines or more) or extractable; the first that fits."""
    text = F.coalesce("text", F.lit(""))
    alnum = F.length(F.regexp_replace(text, "[^\\p{L}\\p{N}]", "")) / F.greatest(F.length(text), F.lit(1))
    lines = F.split(text, "\n")
    code = F.filter(lines, lambda x: x.rlike(CODE_LINE))
    verdict = F.when(alnum < 0.05, "empty").when(F.length(F.trim(text, F.lit(T.BLANKS))) < 50, "short").when((F.size(lines) >= 3) & (F.size(code) > 0.6 * F.size(lines)), "code").otherwise("extractable")
    return chunks.withColumn("verdict", verdict)


def pending_chunks(chunks: DataFrame, log: DataFrame) -> DataFrame:
    """Chunks without a log row, or whose row is a failure that may be tried again."""
    done = log.filter((F.col("model") == "failed_persistent") | ~F.coalesce(F.col("model").startswith("failed_"), F.lit(False)))
    return chunks.join(done.select("chunk_id").distinct(), "chunk_id", "left_anti")


def failure_state(failed: DataFrame, log: DataFrame, tries: int = 3) -> DataFrame:
    """(chunk_id, facts_count, model) after one more failure: the counter goes down, and the last try persists."""
    before = F.least(F.coalesce("facts_count", F.lit(0)), F.lit(0))
    rows = failed.select("chunk_id").distinct().join(log.select("chunk_id", "facts_count"), "chunk_id", "left").select("chunk_id", (before - 1).alias("facts_count"))
    return rows.withColumn("model", F.when(F.col("facts_count") <= -tries, "failed_persistent").otherwise(F.concat(F.lit("failed_"), (-F.col("facts_count")).cast("string"))))


def facts_for_chunks(chunks: DataFrame, facts: DataFrame, as_of: str) -> DataFrame:
    """(chunk_id, facts): active facts of each chunk in the order of their ids; an empty list without any."""
    mine = active_facts(facts, as_of).groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("id", "fact"))).alias("f"))
    return chunks.select("chunk_id").join(mine, "chunk_id", "left").select("chunk_id", F.coalesce(F.transform("f", lambda x: x["fact"]), F.array().cast("array<string>")).alias("facts"))


def derived_facts_for_query(queries: DataFrame, facts: DataFrame, as_of: str, n: int = 5) -> DataFrame:
    """(query_id, fact, confidence, rank): derived facts whose tags contain a capitalised word of the query or two next to each other; n a term, n in all."""
    words = F.regexp_extract_all(F.col("query"), F.lit("[A-Z][A-Za-z0-9]+"), F.lit(0))
    pairs = F.when(F.size("w") > 1, F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w")), lambda a, b: F.concat_ws(" ", a, b)))
    terms = queries.select("query_id", words.alias("w")).select("query_id", F.explode(F.array_distinct(F.concat("w", F.coalesce(pairs, F.array().cast("array<string>"))))).alias("term"))
    tags = active_facts(facts, as_of).filter("relation_type = 'derived'").select("id", "fact", "confidence", F.explode("entity_tags").alias("tag"))
    known = containing(tags.select("tag").distinct(), terms.select("term").distinct(), "tag", "term")
    hits = known.join(tags, "tag").select("term", "id", "fact", "confidence").distinct()
    best = top(hits, ["term"], [F.desc("confidence"), F.col("id")], n, "at").join(terms, "term")
    once = best.groupBy("query_id", "fact").agg(F.max("confidence").alias("confidence"))
    return top(once, ["query_id"], [F.desc("confidence"), F.col("fact")], n)


def similarity(a: str, against: Iterable[str]) -> float:
    """The greatest Ratcliff-Obershelp ratio of a to other texts, empty ones aside, to six digits; 0 without any."""
    return round(max((difflib.SequenceMatcher(None, a, x).ratio() for x in against if x), default=0.0), 6)


#: Characters that a fuzzy ratio looks at.
COMPARED = 100


def _compared(c: Column) -> Column:
    return F.lower(F.substring(F.coalesce(c, F.lit("")), 1, COMPARED))


def fuzzy_ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp similarity of the first 100 characters in lower case; 0 where the second is empty."""

    @F.pandas_udf("double")
    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        # a matcher keeps an index of its second text, so texts that come again go through it in a row
        out, tool = np.zeros(len(left)), difflib.SequenceMatcher()
        for y, x, k in sorted((y, x, k) for k, (x, y) in enumerate(zip(left, right, strict=True)) if y):
            if y != tool.b:
                tool.set_seq2(y)
            tool.set_seq1(x)
            out[k] = tool.ratio()
        return pd.Series(out)

    return ratio(_compared(a), _compared(b))


def common_characters(left: list[str], right: list[str]) -> np.ndarray:
    """For each pair of texts of up to 128 characters, at least the length of their longest common subsequence.

    All pairs advance together, a character of the right text at a step, as bits in two words each. Characters count as
    equal where their codes are, modulo 251, so that the result can only be too large.
    """

    def codes(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), 128), np.uint8)
        for k, t in enumerate(texts):
            c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
            out[k, : len(c)] = 1 + c % 251
        return out

    a, b = codes(left), codes(right)
    low, high = (np.full(len(left), ~np.uint64(0)) for _ in range(2))
    for t in range(int(max(map(len, right), default=0))):
        same = np.packbits((a == b[:, t : t + 1]) & (b[:, t : t + 1] > 0), axis=1, bitorder="little").view(np.uint64)
        y, z = low & same[:, 0], high & same[:, 1]
        added = low + y
        high = (high + z + (added < low)) | (high & ~z)
        low = added | (low & ~y)
    return (128 - np.bitwise_count(low).astype(int) - np.bitwise_count(high)).astype(int)


def _subsequence(a: str, b: str) -> int:
    """The length of the longest common subsequence."""
    at: dict[str, int] = {}
    for k, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << k
    every = v = (1 << len(a)) - 1
    for c in b:
        y = v & at.get(c, 0)
        v = (v + y | v - y) & every
    return len(a) - v.bit_count()


def _matched(tool: difflib.SequenceMatcher, least: float) -> int:
    """Characters in the matching blocks of tool's texts, or 0 as soon as they can't become least any more.

    The longest block leaves what lies left and right of it in both texts, which can't match more than its longest
    common subsequence.
    """
    a, b = tool.a, tool.b
    done, left = 0, [(_subsequence(a, b), 0, len(a), 0, len(b))]
    possible = left[0][0]
    while left and possible >= least:
        most, alo, ahi, blo, bhi = left.pop()
        i, j, k = tool.find_longest_match(alo, ahi, blo, bhi)
        done, possible = done + k, possible - most + k
        for part in ((alo, i, blo, j), (i + k, ahi, j + k, bhi)) if k else ():
            if n := _subsequence(a[part[0] : part[1]], b[part[2] : part[3]]):
                possible += n
                left.append((n, *part))
    return done if possible >= least else 0


def fuzzy_ratio_from(a: Column, b: Column, least: float) -> Column:
    """fuzzy_ratio() where it is least or more, else 0: pairs whose longest common subsequence is too short aren't compared."""

    @F.pandas_udf("double")
    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        x, y = left.tolist(), right.tolist()
        total = np.array(list(map(len, x))) + np.array(list(map(len, y)))
        out, tool = np.zeros(len(x)), difflib.SequenceMatcher()
        needed = least * total / 2 - 1e-9
        able = np.flatnonzero((common_characters(x, y) >= needed) & (np.array(list(map(len, y))) > 0))
        # a matcher keeps an index of its second text, so texts that come again go through it in a row
        for k in sorted(able.tolist(), key=lambda k: y[k]):
            if y[k] != tool.b:
                tool.set_seq2(y[k])
            tool.set_seq1(x[k])
            out[k] = 2 * _matched(tool, needed[k]) / total[k]
        return pd.Series(np.where(out >= least, out, 0.0))

    # a filter on a deterministic ratio would move, and compute it a second time
    ratio = ratio.asNondeterministic()
    return ratio(_compared(a), _compared(b))


def ranked_in_parts(rows: DataFrame, key: str, order: str, parts: int = 1000) -> DataFrame:
    """rows with rn, the place by order (a unique whole number) under key from 1 on. A large key is ranked in up to so many tasks."""
    ends = rows.agg(F.min(order).alias("low"), F.max(order).alias("high"))
    rows = rows.crossJoin(F.broadcast(ends)).withColumn("part", F.expr(f"({order} - low) div greatest(1L, (high - low) div {parts})")).drop("low", "high")
    counts = rows.groupBy(key, "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select(key, "part", F.coalesce(F.sum("n").over(W.partitionBy(key).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = rows.withColumn("rn", F.row_number().over(W.partitionBy(key, "part").orderBy(order))).join(before, [key, "part"])
    return placed.withColumn("rn", F.col("rn") + F.col("before")).drop("part", "before")


#: A fact is paired with those less than so many places after it.
BAND = 20


def clustered(facts: DataFrame, user_names: tuple[str, ...] = ()) -> DataFrame:
    """(cluster, id, fact, created_at) of live facts with a key, which is category and first tag; the user's own name gives way to the second tag."""
    tag = F.lower(F.trim(F.get("entity_tags", F.lit(0))))
    second = F.coalesce(F.nullif(F.lower(F.trim(F.get("entity_tags", F.lit(1)))), F.lit("")), F.lit("general"))
    key = F.when(tag.isin(*user_names), F.concat(F.lit("user_"), second)).otherwise(tag) if user_names else tag
    rows = facts.filter(F.coalesce(F.col("superseded_by").cast("string"), F.lit("")) == "").filter((F.coalesce(tag, F.lit("")) != "") & (F.coalesce("category", F.lit("")) != ""))
    return rows.select(F.concat_ws("|", "category", key).alias("cluster"), "id", "fact", "created_at")


def with_verdicts(rows: DataFrame, memo: DataFrame) -> DataFrame:
    """rows with judged, the (b, judged_at) of verdicts on pairs whose first fact is theirs."""
    judged = memo.groupBy(F.col("fact_id_a").alias("id")).agg(F.collect_list(F.struct(F.col("fact_id_b").alias("b"), "judged_at")).alias("judged"))
    return rows.join(judged, "id", "left")


def paired(ranked: DataFrame, band: int = BAND) -> DataFrame:
    """(cluster, ra, a, b, fact_a, fact_b, created_a, created_b) of rows that are less than band places rn apart, without pairs that a verdict in judged later than both has settled.

    Places are cut into runs of band; a fact meets those of its own run and the next, so that no task holds a cluster.
    Verdicts come with the facts, so that pairs, some twenty times as many, are never dealt out.
    """
    run = F.floor((F.col("rn") - 1) / band)
    a = ranked.select("cluster", run.alias("run"), F.col("rn").alias("ra"), F.col("id").alias("a"), F.col("fact").alias("fact_a"), F.col("created_at").alias("created_a"), "judged")
    b = ranked.select("cluster", F.explode(F.array(run, run - 1)).alias("run"), F.col("rn").alias("rb"), F.col("id").alias("b"), F.col("fact").alias("fact_b"), F.col("created_at").alias("created_b"))
    pairs = a.join(b, ["cluster", "run"]).filter(f"rb > ra AND rb - ra < {band}")
    settled = F.exists("judged", lambda v: (v["b"] == F.col("b")) & (F.col("created_a") < v["judged_at"]) & (F.col("created_b") < v["judged_at"]))
    return pairs.filter(~F.coalesce(settled, F.lit(False))).select("cluster", "ra", "a", "b", "fact_a", "fact_b", "created_a", "created_b")


def candidate_pairs(facts: DataFrame, memo: DataFrame, user_names: tuple[str, ...] = (), band: int = BAND) -> DataFrame:
    """(cluster, a, b, fact_a, fact_b, created_a, created_b) of live facts under one key less than band places apart by id, that no verdict later than both has judged."""
    ranked = ranked_in_parts(with_verdicts(clustered(facts, user_names), memo), "cluster", "id")
    return paired(ranked, band).drop("ra")


#: Pairs that are compared first, for each pair that is wanted; clusters that a round takes at most; facts of a cluster that are paired first.
FIRST, ROUND, DEPTH = 8, 10_000, 128


def supersession_candidates(facts: DataFrame, memo: DataFrame, user_names: tuple[str, ...] = (), least: float = 0.45, per_cluster: int = 500, overall: int = 15_000) -> DataFrame:
    """(cluster, a, b, ratio): likely supersessions for judging, newest clusters first; the two limits are the judges' budget.

    Pairs are compared from the newest clusters on, in rounds that reach as far as the share found so far says, until
    there are enough: older clusters can't be among the first then. A cluster's facts are paired by their places, up to
    DEPTH first and then up to eight times as many, until it has its pairs or no more facts. What is found is cached.
    """
    spark = facts.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = clustered(facts, user_names).withColumn("fact", _compared(F.col("fact")))
    clusters = rows.groupBy("cluster").agg(F.max("id").alias("newest"), F.count(F.lit(1)).alias("n")).filter("n > 1").persist()
    kinds = f"cluster string, newest {clusters.schema['newest'].dataType.simpleString()}"

    def compared(some: DataFrame, after: int, upto: int) -> DataFrame:
        ranked = ranked_in_parts(some, "cluster", "id").filter(f"rn > {after} AND rn < {upto + BAND}")
        x, y = F.length("fact_a"), F.length("fact_b")
        pairs = paired(ranked).filter(f"ra <= {upto}").filter(2.0 * F.least(x, y) >= least * (x + y)).repartition(tasks, "b")
        return pairs.select("cluster", "a", "b", fuzzy_ratio_from(F.col("fact_a"), F.col("fact_b"), least).alias("ratio")).filter(F.col("ratio") >= least)

    reach, done, count, last, found = FIRST * overall, 0, 0, None, []
    while count < overall:
        left = clusters if last is None else clusters.filter((F.col("newest") < last.newest) | ((F.col("newest") == last.newest) & (F.col("cluster") > last.cluster)))
        chosen, work = left.orderBy(F.desc("newest"), "cluster").limit(ROUND).collect(), 0
        for k, r in enumerate(chosen):
            work += sum(min(BAND - 1, r.n - 1 - place) for place in range(min(r.n, DEPTH)))
            if work >= reach:
                chosen = chosen[: k + 1]
                break
        if not chosen:
            break
        newest = F.broadcast(spark.createDataFrame([(r.cluster, r.newest) for r in chosen], kinds))  # at most ROUND rows
        mine = with_verdicts(rows.join(newest.select("cluster"), "cluster", "left_semi"), memo).persist()
        after, upto, open_, got, steps = 0, DEPTH, {r.cluster: r.n for r in chosen}, {}, []
        while open_:
            some = mine if not after else mine.join(F.broadcast(spark.createDataFrame([(c,) for c in open_], "cluster string")), "cluster", "left_semi")
            steps.append(compared(some, after, upto).persist())
            for r in steps[-1].groupBy("cluster").count().collect():
                got[r.cluster] = got.get(r.cluster, 0) + r["count"]
            open_ = {c: n for c, n in open_.items() if n > upto + 1 and got.get(c, 0) < per_cluster}
            after, upto = upto, 8 * upto
        mine.unpersist()
        found.append(top(reduce(DataFrame.unionByName, steps), ["cluster"], [F.col("a"), F.col("b")], per_cluster, "at").join(newest, "cluster"))
        count, done, last = count + sum(min(n, per_cluster) for n in got.values()), done + work, chosen[-1]
        reach = max(reach, int(1.2 * done * (overall - count) / max(count, 1)))
    clusters.unpersist()
    if not found:
        return rows.select("cluster", F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("ratio")).limit(0)
    every = reduce(DataFrame.unionByName, found)
    return every.orderBy(F.desc("newest"), "cluster", "a", "b").limit(overall).select("cluster", "a", "b", F.round("ratio", 6).alias("ratio"))


def superseded_chain(facts: DataFrame) -> DataFrame:
    old, new = facts.alias("o"), facts.alias("n")
    return old.join(new, F.col("o.superseded_by") == F.col("n.id")).select(F.col("o.id").alias("old_id"), F.col("n.id").alias("new_id"), F.col("o.fact").alias("old_fact"), F.col("n.fact").alias("new_fact"))


def apply_supersession(facts: DataFrame, verdicts: DataFrame, day: str) -> DataFrame:
    """facts with superseded_by and superseded_at from the last verdict on each (old_id, new_id, seq)."""
    last = verdicts.groupBy("old_id").agg(F.max_by("new_id", "seq").alias("v"))
    rows = facts.join(last, facts["id"] == last["old_id"], "left")
    return rows.withColumn("superseded_at", F.when(F.col("v").isNotNull(), day).otherwise(F.col("superseded_at"))).withColumn("superseded_by", F.coalesce("v", "superseded_by")).drop("v", "old_id")


def entity_fact_groups(facts: DataFrame, least: int = 5) -> DataFrame:
    """(entity, names, facts, newest): active facts by normalised tag, each text once by its first id; names without noise and with enough facts."""
    live = facts.filter(F.coalesce(F.col("superseded_by").cast("string"), F.lit("")) == "")
    rows = live.select("id", "fact", "created_at", "relation_type", F.explode("entity_tags").alias("name")).withColumn("entity", T.normal_entity(F.col("name")))
    rows = rows.filter((F.col("entity") != "") & T.entity_noise(F.col("entity")).isNull())
    per_text = rows.groupBy("entity", "fact").agg(F.min("id").alias("id"), F.collect_set("name").alias("names"), F.max(F.when(F.col("relation_type") != "derived", F.col("created_at"))).alias("newest"))
    groups = per_text.groupBy("entity").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names"), F.count(F.lit(1)).alias("facts"), F.max("newest").alias("newest"))
    return groups.filter(F.col("facts") >= least)


def facts_for_derivation(facts: DataFrame, n: int = 50) -> DataFrame:
    """The n latest facts of each entity by event date."""
    rows = facts.select("id", "event_date", F.explode("entity_tags").alias("name")).select("id", "event_date", T.normal_entity(F.col("name")).alias("entity")).filter("entity <> ''").distinct()
    return top(rows, ["entity"], [F.desc_nulls_last("event_date"), F.col("id")], n)


def derivation_queue(groups: DataFrame, marks: DataFrame, last_run: str) -> DataFrame:
    """(entity, tier, place): entities with facts newer than their mark; what came since the last run newest first, then the backlog by size."""
    due = groups.join(marks, "entity", "left").filter(F.col("newest") > F.coalesce("watermark", F.lit("")))
    rows = due.withColumn("tier", F.when(F.col("newest") > last_run, 1).otherwise(2))
    order = [F.col("tier"), F.when(F.col("tier") == 1, F.col("newest")).desc_nulls_last(), F.when(F.col("tier") == 2, F.col("facts")).desc_nulls_last(), F.col("entity")]
    return rows.orderBy(*order).select("entity", "tier", "newest", "facts")


def advance_marks(marks: DataFrame, done: DataFrame) -> DataFrame:
    """Marks after a run: each drained entity (entity, newest) moves to its newest source fact and never back."""
    rows = marks.select("entity", "watermark").unionByName(done.select("entity", F.col("newest").alias("watermark")))
    return rows.groupBy("entity").agg(F.max("watermark").alias("watermark"))


def derived_rows(responses: DataFrame, known: DataFrame, least: float = 0.5) -> DataFrame:
    """(entity, fact, confidence, derived_from) of the first five derivations per response (entity, ids, response): sure enough and not yet known."""
    shape = "array<struct<fact:string,confidence:double,sources:array<int>>>"
    body = F.regexp_extract(F.regexp_replace("response", "```(json)?", ""), "(?s)(\\[.*\\])", 1)
    rows = responses.select("entity", "ids", F.explode(F.slice(F.from_json(body, shape), 1, 5)).alias("d")).filter(F.col("d.confidence") >= least)
    refs = F.filter(F.transform("d.sources", lambda i: F.get("ids", i - 1)), lambda x: x.isNotNull())
    rows = rows.select("entity", F.trim("d.fact").alias("fact"), F.col("d.confidence").alias("confidence"), refs.alias("derived_from"))
    seen = known.select("entity", F.lower(F.trim("fact")).alias("f"))
    return rows.join(seen, (rows.entity == seen.entity) & (F.lower("fact") == F.col("f")), "left_anti")
