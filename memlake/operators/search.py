"""Hybrid retrieval for whole tables of queries: vectors, entities and BM25, merged under quotas.

Query tables are joined without hints: Spark broadcasts a side where its measured size allows, and shuffles it else.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memlake.functions import text as T
from memlake.operators.vectors import nearest

#: Fetch limits of the entity branch, for a candidate and for a query.
ENTITY_CAP = 700
K1, B = 1.2, 0.75


def top(df: DataFrame, keys: list[str], order: list[Column], n: int | Column, rank: str = "rank") -> DataFrame:
    """The first n rows per key, ranked from 1. Spark limits groups before the shuffle."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= n)


def filter_source(df: DataFrame, source: str = "") -> DataFrame:
    """Rows of a source, verbatim; all rows for no source."""
    return df.filter(F.col("source") == source) if source else df


def filter_docs(df: DataFrame, folder: str = "", doc_type: str = "") -> DataFrame:
    for name, value in (("folder", folder), ("doc_type", doc_type)):
        df = df.filter(F.col(name) == value) if value else df
    return df


def filter_title_contains(df: DataFrame, part: str) -> DataFrame:
    return df.filter(F.col("title").contains(part))


def live(df: DataFrame) -> DataFrame:
    """Rows that nothing supersedes."""
    return df.filter(F.coalesce("superseded_by", F.lit("")) == "")


def drop_superseded(ranked: DataFrame, n: int) -> DataFrame:
    """The first n live rows of each query, ranked again."""
    return top(live(ranked).withColumnRenamed("rank", "before"), ["query_id"], [F.col("before"), F.col("chunk_id")], n).drop("before")


def query_chunks(chunks: DataFrame, source: str = "", after: str = "", before: str = "", ascending: bool = False, limit: int = 10) -> DataFrame:
    """Live chunks by source and inclusive date bounds, by date, at most 50."""
    df = filter_source(live(chunks), source)
    df = df.filter(F.col("date") >= after.replace("/", "-")) if after else df
    df = df.filter(F.col("date") <= before.replace("/", "-")) if before else df
    order = F.col("date").asc_nulls_first() if ascending else F.col("date").desc_nulls_last()
    return df.orderBy(order, "chunk_id").limit(max(1, min(50, limit)))


def lookup_chunks(ids: DataFrame, chunks: DataFrame) -> DataFrame:
    """chunks of the ids; ids that aren't there drop out."""
    return ids.join(chunks, "chunk_id")


def vector_topk(queries: DataFrame, chunks: DataFrame, k: int, source: str = "") -> DataFrame:
    """(query_id, chunk_id, score, rank): the k nearest chunks by cosine, at least 0; a zero vector is at 0 from all.

    Parts of the queries meet parts of the chunks as matrices, each pair in a task; of each only the k best per query are
    shuffled. Null and empty vectors, and those of another size than the query's, have no place.
    """
    found = nearest(queries.select("query_id", "embedding"), filter_source(chunks, source).select("chunk_id", "embedding"), k)
    return top(found, ["query_id"], [F.desc("score"), F.col("chunk_id")], k)


#: Columns of chunks that hold a column of the lexical index under another name.
HELD = {"document": "text"}


def _indexed(column: str) -> Column:
    return T.tokens(F.col(HELD.get(column, column)))


def postings(chunks: DataFrame, columns: tuple[str, ...] = T.LEXICAL_COLUMNS) -> DataFrame:
    """(chunk_id, source, field, term, tf); made once for a store and kept as a table."""
    fields = F.array(*[F.struct(F.lit(c).alias("field"), _indexed(c).alias("terms")) for c in columns])
    rows = chunks.select("chunk_id", "source", F.explode(fields).alias("f")).select("chunk_id", "source", "f.field", F.explode("f.terms").alias("term"))
    return rows.groupBy("chunk_id", "source", "field", "term").agg(F.count(F.lit(1)).alias("tf"))


def doc_lengths(chunks: DataFrame, columns: tuple[str, ...] = T.LEXICAL_COLUMNS) -> DataFrame:
    return chunks.select("chunk_id", sum(F.size(_indexed(c)) for c in columns).cast("long").alias("len"))


#: Rows that are counted at a time.
COUNTED = 1_000


def term_index(chunks: DataFrame, columns: tuple[str, ...] = T.LEXICAL_COLUMNS) -> DataFrame:
    """(chunk_id, source, len, terms, fields, tfs): a row for each chunk, with its length and its terms; made once for a store and kept as a table.

    terms are the distinct terms of each column in turn, parted by blanks; fields and tfs tell, packed, for each of them
    the column (a byte) and the count (four). Terms are counted where the chunk is read: nothing is shuffled.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, COUNTED):
                batch = whole.slice(start, COUNTED)
                lists = batch.column("found").flatten()
                words = lists.flatten().dictionary_encode()
                place = np.repeat(np.arange(len(lists), dtype=np.int64), lists.value_lengths().to_numpy())  # of a chunk's column
                many = max(len(words.dictionary), 1)
                keys, tfs = np.unique(place * many + words.indices.to_numpy(), return_counts=True)
                fields = (keys // many % len(columns)).astype(np.uint8)
                bounds = np.searchsorted(keys // many // len(columns), np.arange(batch.num_rows + 1)).astype(np.int32)
                terms = pa.ListArray.from_arrays(bounds, words.dictionary.take(pa.array(keys % many)))
                packed = [pa.array([x[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:])], pa.binary()) for x in (fields, tfs.astype("<i4"))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("chunk_id", "source", "len")), pc.binary_join(terms, " "), *packed], ["chunk_id", "source", "len", "terms", "fields", "tfs"])

    found = F.array(*[_indexed(c) for c in columns]).alias("found")
    rows = chunks.select("chunk_id", "source", sum(F.size(_indexed(c)) for c in columns).cast("long").alias("len"), found)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:3])
    return rows.mapInArrow(counted, f"{kinds}, terms string, fields binary, tfs binary")


#: Queries and chunks that a task holds at most, about, and chunks at least where there are fewer tasks than could run.
ASKED, SCORED, LEAST_SCORED = 20_000, 4_000, 256


def _scores(asked: pa.Table, chunks: pa.Table, mean: float, k: int) -> tuple[list, list, list]:
    """Query ids, places in chunks and scores: for each query of asked (query_id, mode, field, wanted, term, idf) its k best chunks, of equals those of least id."""
    words = pc.unique(asked["term"].combine_chunks())
    split = pc.split_pattern(chunks["terms"].combine_chunks(), " ")
    term = pc.fill_null(pc.index_in(split.flatten(), value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(split)), split.value_lengths().to_numpy())
    field, tf = (np.frombuffer(b"".join(chunks[c].to_pylist()), t) for c, t in (("fields", np.uint8), ("tfs", "<i4")))
    kept = np.flatnonzero(term >= 0)
    term, row, field, tf = term[kept], row[kept], field[kept].astype(np.int64), tf[kept].astype(np.float64)
    norm = K1 * (1 - B + B * chunks["len"].to_numpy().astype(np.float64) / mean)
    idf = np.zeros(len(words))
    term_of = pc.index_in(asked["term"].combine_chunks(), value_set=words).to_numpy()
    idf[term_of] = asked["idf"].to_numpy()

    def postings_of(some: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows and parts of scores by term, over all columns or some entries, and where each term's begin."""
        t, r, f = (term, row, tf) if some is None else (term[some], row[some], tf[some])
        keys, at = np.unique(t * len(split) + r, return_inverse=True)
        sums = np.bincount(at, weights=f, minlength=len(keys))
        t, r = keys // len(split), keys % len(split)
        return r, idf[t] * sums * (K1 + 1) / (sums + norm[r]), np.searchsorted(t, np.arange(len(words) + 1))

    held: dict[int, tuple] = {}
    ids = np.array(chunks["chunk_id"].to_pylist(), object)
    query, modes, wanted = asked["query_id"].to_pylist(), asked["mode"].to_pylist(), asked["wanted"].to_pylist()
    fields = [0 if m == "or" else f for m, f in zip(modes, asked["field"].to_pylist())]
    of: dict = {}
    for n, q in enumerate(query):
        of.setdefault(q, []).append(n)
    out: tuple[list, list, list] = [], [], []
    for q, entries in of.items():
        f = fields[entries[0]]
        if f not in held:
            held[f] = postings_of(None if f == 0 else np.flatnonzero(field == f - 1))
        r, parts, first = held[f]
        total, met = np.zeros(len(split)), np.zeros(len(split), np.int32)
        for t in term_of[entries].tolist():
            i, j = first[t], first[t + 1]
            total[r[i:j]] += parts[i:j]
            met[r[i:j]] += 1
        hits = np.flatnonzero(met >= (1 if f == 0 else wanted[entries[0]]))
        score = np.floor(total[hits] * 1e6 + 0.5) / 1e6
        if len(hits) > k:
            best = score >= np.partition(score, -k)[-k]
            hits, score = hits[best], score[best]
        order = sorted(range(len(hits)), key=lambda n: (-score[n], ids[hits[n]]))[:k]
        out[0].extend([q] * len(order))
        out[1].extend(hits[order].tolist())
        out[2].extend(score[order].tolist())
    return out


def bm25(queries: DataFrame, index: DataFrame, lengths: DataFrame, k: int, source: str = "", derived: bool = False, columns: tuple[str, ...] = T.LEXICAL_COLUMNS) -> DataFrame:
    """(query_id, chunk_id, score, rank) for queries (query_id, query), by the published formula over all columns of a term_index().

    Derived chunks and other sources go before ranking. Terms in half of the chunks or more weigh next to nothing,
    not less than it. `column:value` asks for all its terms in that column. Parts of the queries meet parts of the
    chunks, each pair in a task that adds up all of a chunk's terms; of each only the k best per query are shuffled.
    """
    asked = queries.select("query_id", T.lexical_query(F.col("query"), columns).alias("m")).filter("m.mode <> 'skip'")
    asked = asked.select("query_id", "m.mode", F.array_position(F.array(*map(F.lit, columns)), F.col("m.column")).cast("int").alias("field"), F.size("m.terms").alias("wanted"), F.explode("m.terms").alias("term"))
    index = filter_source(index, source).filter("len > 0")
    if not derived:
        index = index.filter(~T.is_derived_chunk(F.col("chunk_id")))
    n, mean = lengths.agg(F.count(F.lit(1)), F.avg("len")).first()
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wide, high = (max(1, -(-many // share)) for many, share in ((n, max(LEAST_SCORED, min(SCORED, -(-n // tasks)))), (queries.count(), ASKED)))
    counts = index.select(F.explode(F.array_distinct(F.split("terms", " "))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.greatest(F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    terms = asked.join(counts, "term").select("query_id", "mode", "field", "wanted", "term", idf.alias("idf"))
    kinds = f"query_id {terms.schema['query_id'].dataType.simpleString()}, chunk_id {index.schema['chunk_id'].dataType.simpleString()}, score double"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        some = left.num_rows and right.num_rows
        query, at, score = _scores(left, right, mean, k) if some else ([], [], [])
        return pa.table([pa.array(query, left.schema.field("query_id").type), right["chunk_id"].take(pa.array(at, pa.int64())), pa.array(score, pa.float64())], ["query_id", "chunk_id", "score"])

    part = lambda c, parts: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    a = terms.withColumn("i", part("query_id", high)).withColumn("j", every(wide))
    b = index.select("chunk_id", "len", "terms", "fields", "tfs").withColumn("j", part("chunk_id", wide)).withColumn("i", every(high))
    scored = a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInArrow(run, kinds)
    return top(scored, ["query_id"], [F.desc("score"), F.col("chunk_id")], k)


def _grams(text: Column, n: int) -> Column:
    """Distinct runs of n characters; none for shorter text."""
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(n))))


def containing(names: DataFrame, probes: DataFrame, name: str, probe: str) -> DataFrame:
    """(name, probe) where a name contains a probe, in any case. Names are indexed by runs of one to three characters; a probe looks up its rarest."""
    n, p = F.lower(F.col(name)), F.lower(F.col(probe))
    every = F.flatten(F.array(*[_grams(n, k) for k in (1, 2, 3)]))
    index = names.select(name, F.explode(every).alias("gram"))
    counts = index.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    own = F.when(F.length(p) >= 3, _grams(p, 3)).otherwise(F.array(p))
    asked = probes.select(probe, F.explode(own).alias("gram")).join(counts, "gram", "left")
    rarest = asked.groupBy(probe).agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), F.col("gram"))).alias("gram"))
    return index.join(rarest, "gram").filter(n.contains(p)).select(name, probe)


def entity_matches(queries: DataFrame, entities: DataFrame, cap: int = ENTITY_CAP) -> DataFrame:
    """(query_id, chunk_id, candidate, place, nth): chunks of entities that contain a candidate of the query, in any case, per candidate the last cap ids."""
    asked = queries.select("query_id", F.posexplode(T.entity_candidates(F.col("query"))).alias("place", "candidate"))
    met = containing(entities.select("entity").distinct(), asked.select("candidate").distinct(), "entity", "candidate")
    rows = met.join(entities, "entity").select("candidate", "chunk_id").distinct()
    rows = top(rows, ["candidate"], [F.desc("chunk_id")], cap, "nth")
    return rows.join(asked, "candidate").select("query_id", "chunk_id", "candidate", "place", "nth")


def entity_counts(queries: DataFrame, entities: DataFrame, seen: DataFrame, cap: int = ENTITY_CAP) -> DataFrame:
    """(query_id, appended, unique, duplicates, lost, saturated) of the entity branch before its cap: rows of all candidates,
    new chunks among them, repeated ones, new ones beyond the cap, and the candidates that met their own limit, sorted."""
    rows = entity_matches(queries, entities, cap)
    fresh = rows.join(seen.select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"], "left_anti")
    n = fresh.groupBy("query_id").agg(F.count(F.lit(1)).alias("appended"), F.countDistinct("chunk_id").alias("unique"))
    full = rows.groupBy("query_id", "candidate").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= cap).groupBy("query_id").agg(F.sort_array(F.collect_list("candidate")).alias("saturated"))
    both = n.join(full, "query_id", "left")
    return both.select("query_id", "appended", "unique", (F.col("appended") - F.col("unique")).alias("duplicates"), F.greatest(F.col("unique") - cap, F.lit(0)).alias("lost"), F.coalesce("saturated", F.array().cast("array<string>")).alias("saturated"))


def entity_stream(queries: DataFrame, entities: DataFrame, seen: DataFrame, cap: int = ENTITY_CAP) -> DataFrame:
    """(query_id, chunk_id): each chunk once, by candidate then id, without those already seen, at most cap per query."""
    rows = entity_matches(queries, entities, cap).groupBy("query_id", "chunk_id").agg(F.min(F.struct("place", "nth")).alias("o"))
    fresh = rows.join(seen.select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"], "left_anti")
    return top(fresh, ["query_id"], [F.col("o"), F.col("chunk_id")], cap).select("query_id", "chunk_id")


def search_by_entity(entity: str, entities: DataFrame, chunks: DataFrame, kind: str = "", n: int = 10, superseded: bool = False) -> DataFrame:
    """Chunks of entities that contain a name, newest first."""
    hits = entities.filter(F.lower("entity").contains(entity.lower()))
    hits = hits.filter(F.col("entity_type") == kind) if kind else hits
    rows = chunks.join(hits.select("chunk_id").distinct(), "chunk_id", "left_semi")
    return (rows if superseded else live(rows)).orderBy(F.desc_nulls_last("date"), "chunk_id").limit(n)


def compose_pool(candidates: DataFrame, n: int) -> DataFrame:
    """candidates (query_id, chunk_id, stream, score, date) under quotas: 3n semantic, n entity and n lexical, in that order.

    Within a stream by score, then older first; a chunk in several streams stays in the first.
    """
    order = F.create_map(*[F.lit(x) for kv in {"semantic": 0, "entity": 1, "lexical": 2}.items() for x in kv])[F.col("stream")]
    quota = F.when(F.col("stream") == "semantic", 3 * n).otherwise(n)
    rows = candidates.withColumn("o", order)
    rows = top(rows, ["query_id", "stream"], [F.desc("score"), F.asc_nulls_first("date"), F.col("chunk_id")], quota, "place")
    first = rows.withColumn("again", F.row_number().over(W.partitionBy("query_id", "chunk_id").orderBy("o"))).filter("again = 1")
    return first.withColumn("position", F.row_number().over(W.partitionBy("query_id").orderBy("o", "place"))).drop("o", "again", "place")


def rerank(pool: DataFrame, n: int, scorer: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """The n best of each pool by scorer(query, first 1000 characters); in pool order without one."""
    order = [F.col("position")] if scorer is None else [F.desc(scorer(F.col("query"), F.substring("text", 1, 1000))), F.col("position")]
    return top(pool, ["query_id"], order, n)


def hybrid_candidates(queries: DataFrame, chunks: DataFrame, entities: DataFrame, n: int, source: str = "", columns: tuple[str, ...] = T.LEXICAL_COLUMNS, index: DataFrame | None = None, lengths: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, stream, score, date, superseded_by) of all three streams, before pooling; index and lengths are kept tables of term_index() and doc_lengths(), made here where there are none."""
    n = max(1, min(30, n))
    k = min(3 * n, 30)
    meta = filter_source(chunks, source).select("chunk_id", "date", "superseded_by")
    semantic = vector_topk(queries, chunks, k, source).select("query_id", "chunk_id", F.lit("semantic").alias("stream"), "score")
    found = entity_stream(queries, entities, semantic)
    vectors = filter_source(chunks, source).select("chunk_id", "embedding")
    scored = found.join(vectors, "chunk_id").join(queries.select("query_id", F.col("embedding").alias("q")), "query_id")
    entity = scored.select("query_id", "chunk_id", F.lit("entity").alias("stream"), F.round(T.cosine(F.col("q"), F.col("embedding")), 6).alias("score"))
    index = term_index(chunks, columns) if index is None else index
    lengths = doc_lengths(chunks, columns) if lengths is None else lengths
    lexical = bm25(queries, index, lengths, k, source, columns=columns).select("query_id", "chunk_id", F.lit("lexical").alias("stream"), "score")
    # what another stream has found leaves the lexical one, told by rows side by side: a join would compute the other streams twice
    others = F.max(F.col("stream") != "lexical").over(W.partitionBy("query_id", "chunk_id"))
    every = semantic.unionByName(entity).unionByName(lexical).withColumn("others", others)
    return every.filter("stream <> 'lexical' OR NOT others").drop("others").join(meta, "chunk_id")


def hybrid_search(
    queries: DataFrame, chunks: DataFrame, entities: DataFrame, n: int = 10, source: str = "", superseded: bool = False, scorer=None,
    columns: tuple[str, ...] = T.LEXICAL_COLUMNS, index: DataFrame | None = None, lengths: DataFrame | None = None,
) -> DataFrame:
    """(query_id, chunk_id, stream, score, rank) for queries (query_id, query, embedding): the n best of each pool.

    Superseded chunks leave after the streams' limits, so that a stream may come back short.
    """
    found = hybrid_candidates(queries, chunks, entities, n, source, columns, index, lengths)
    pool = compose_pool(found if superseded else live(found), max(1, min(30, n)))
    return _reranked(pool, queries, chunks, max(1, min(30, n)), scorer).select("query_id", "chunk_id", "stream", "score", "rank")


def _reranked(pool: DataFrame, queries: DataFrame, chunks: DataFrame, n: int, scorer) -> DataFrame:
    if scorer is not None:
        pool = pool.join(chunks.select("chunk_id", "text"), "chunk_id").join(queries.select("query_id", "query"), "query_id")
    return rerank(pool, n, scorer)


def kb_search(queries: DataFrame, chunks: DataFrame, n: int = 5, source: str = "", superseded: bool = False, scorer=None, fetch: int = 3) -> DataFrame:
    """(query_id, chunk_id, score, rank) by vectors alone: fetch times n, of those the first n that are live, and these n put in the scorer's order.

    n is 1 to 20. With superseded, the first n as they are.
    """
    n = max(1, min(20, n))
    found = vector_topk(queries, chunks, fetch * n, source)
    if not superseded:
        found = drop_superseded(found.join(chunks.select("chunk_id", "superseded_by"), "chunk_id"), n)
    pool = found.filter(F.col("rank") <= n).withColumnRenamed("rank", "position")
    return _reranked(pool, queries, chunks, n, scorer).select("query_id", "chunk_id", "score", "rank")


def result_columns(ranked: DataFrame, chunks: DataFrame, facts: DataFrame, base: str = "kb://chunk/", most: int = 10, chars: int = 500) -> DataFrame:
    """ranked (query_id, chunk_id, score, rank) as shown: title with folder, type and category, date, relevance of three digits, url, snippet, first facts and their number.

    facts: (chunk_id, facts) of the chunks that have any.
    """
    known = lambda c: F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit(""))
    extra = F.concat_ws(", ", known("folder"), known("doc_type"), known("category"))
    title = F.coalesce("title", F.lit("N/A"))
    rows = ranked.join(chunks, "chunk_id").join(facts, "chunk_id", "left")
    return rows.select(
        "query_id", "chunk_id", "rank", F.when(extra != "", F.concat(title, F.lit(" ("), extra, F.lit(")"))).otherwise(title).alias("title"), F.coalesce("date", F.lit("")).alias("date"), "source",
        F.round("score", 3).alias("relevance"), F.concat(F.lit(base), "chunk_id").alias("url"),
        F.when(F.length("text") > chars, F.concat(F.substring("text", 1, chars), F.lit("..."))).otherwise(F.col("text")).alias("snippet"),
        F.slice(F.coalesce("facts", F.array().cast("array<string>")), 1, most).alias("facts"), F.coalesce(F.size("facts"), F.lit(0)).cast("long").alias("n_facts"),
    )


def document_url(path: Column, base: str = "") -> Column:
    """The address under which a document is fetched; empty without a path."""
    escaped = F.replace(F.url_encode(path), F.lit("+"), F.lit("%20"))
    return F.when(F.coalesce(path, F.lit("")) != "", F.concat(F.lit(base.rstrip("/") + "/api/kb/document?path="), escaped)).otherwise("")


def find_documents(queries: DataFrame, chunks: DataFrame, n: int = 10) -> DataFrame:
    """(query_id, file_path, title, folder, tier, ratio, last_date, chunks, rank): the n documents whose names fit each query best.

    Tier 3: the title contains the query, 2: the folder, 1: the path, 0: none; then by Ratcliff-Obershelp ratio, then by
    path. Case, and runs of blanks, underscores and hyphens, don't count. Documents of which all chunks are superseded
    are left out.
    """
    plain = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[\\s_-]+", " "))
    filled = lambda c: F.min_by(c, F.when(F.coalesce(c, F.lit("")) != "", F.col("chunk_id")))
    rows = chunks.filter((F.col("source") == "document") & (F.coalesce("file_path", F.lit("")) != ""))
    first = lambda c: F.min_by(F.coalesce(c, F.lit("")), "chunk_id")
    docs = rows.groupBy("file_path").agg(
        F.coalesce(filled("title"), F.lit("")).alias("title"), F.coalesce(filled("folder"), F.lit("")).alias("folder"), first("title").alias("t"), first("folder").alias("f"),
        F.coalesce(F.max("date"), F.lit("")).alias("last_date"), F.count(F.lit(1)).alias("chunks"), F.min((F.coalesce("superseded_by", F.lit("")) != "").cast("int")).alias("gone"),
    ).filter("gone = 0")
    docs = docs.withColumns({"t": plain(F.col("t")), "f": plain(F.col("f")), "p": plain(F.col("file_path"))})
    asked = queries.select(F.col("query_id").alias("k"), plain(F.col("query")).alias("q"))
    found = _best_names(asked, docs.select(F.col("file_path").alias("k"), "t", "f", "p"), n)
    best = top(found, ["query_id"], [F.desc("tier"), F.desc("ratio"), F.col("file_path")], n)
    return best.join(docs.select("file_path", "title", "folder", "last_date", "chunks"), "file_path").select("query_id", "file_path", "title", "folder", "tier", "ratio", "last_date", "chunks", "rank")


#: Documents, and queries, that a task compares at most, about.
NAMES = 5_000


def _best_names(asked: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """(query_id, file_path, tier, ratio): for queries (k, q) the n best of documents (k, t, f, p) out of each part of them, and all that tie with the last.

    Parts of the queries meet parts of the documents, each pair in a task. Ratios of documents that contain the query
    come first; if they are too few, the others follow from the highest bound on, by common subsequences, until no bound
    reaches the n-th ratio.
    """
    from memlake.operators.facts import common_characters, similarity
    from memlake.operators.vectors import _grid

    def bounds(q: str, names: list[str]) -> np.ndarray:
        total = np.array([len(q) + len(x) for x in names])
        short = np.array([max(len(q), len(x)) <= 128 for x in names])
        matched = np.array([min(len(q), len(x)) for x in names])
        at = np.flatnonzero(short)
        if len(at):
            matched[at] = common_characters([q] * len(at), [names[k] for k in at])
        return np.where(total > 0, 2 * matched / np.maximum(total, 1), 0.0) * np.array([bool(x) for x in names])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        paths, names = right["k"].to_pylist(), list(zip(*(right[c].to_pylist() for c in "tfp")))
        out: list[tuple] = []
        for key, q in zip(left["k"].to_pylist(), left["q"].to_pylist()):
            tiers = [3 if q in t else 2 if q in f else 1 if q in p else 0 for t, f, p in names] if q else [0] * len(names)
            hits = [k for k, tier in enumerate(tiers) if tier]
            out += [(key, paths[k], tiers[k], similarity(q, (names[k][3 - tiers[k]],))) for k in hits]
            if len(hits) >= n or not names:
                continue
            rest = np.flatnonzero(np.array(tiers) == 0)
            most = np.max([bounds(q, [names[k][c] for k in rest.tolist()]) for c in range(3)], axis=0)
            best: list[float] = []
            for place in np.argsort(-most, kind="stable").tolist():
                if len(best) >= n and round(most[place], 6) < best[0]:
                    break
                k = int(rest[place])
                ratio = similarity(q, names[k])
                out.append((key, paths[k], 0, ratio))
                (heapq.heappushpop if len(best) >= n else heapq.heappush)(best, ratio)
        columns = list(zip(*out)) or [[]] * 4
        return pa.table([pa.array(columns[0], left.schema.field("k").type), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.float64())], ["query_id", "file_path", "tier", "ratio"])

    one = {"cell": F.lit(0).cast("long"), "t": F.lit(0.0)}  # a grid over all of both sides
    sides = _grid(asked.withColumns(one), docs.withColumnRenamed("t", "name").withColumns(one), NAMES)
    a = sides[0].select("cell", "i", "j", "k", "q").groupBy("cell", "i", "j")
    b = sides[1].select("cell", "i", "j", "k", F.col("name").alias("t"), "f", "p").groupBy("cell", "i", "j")
    return a.cogroup(b).applyInArrow(run, f"query_id {asked.schema['k'].dataType.simpleString()}, file_path string, tier int, ratio double")


def stage_counts(candidates: DataFrame, n: int) -> DataFrame:
    """(query_id, stream, found, superseded, pooled): what each stream brought, lost and put in the pool."""
    pool = compose_pool(live(candidates), n).select("query_id", "chunk_id", "stream", F.lit(1).alias("p"))
    rows = candidates.join(pool, ["query_id", "chunk_id", "stream"], "left")
    gone = F.coalesce("superseded_by", F.lit("")) != ""
    return rows.groupBy("query_id", "stream").agg(F.count(F.lit(1)).alias("found"), F.count(F.when(gone, 1)).alias("superseded"), F.count("p").alias("pooled"))


def derived_dropped(ranked: DataFrame, limit: int) -> DataFrame:
    """Per query, how many of the first rows of an unfiltered ranking are derived chunks."""
    return ranked.filter(F.col("rank") <= limit).groupBy("query_id").agg(F.count(F.when(T.is_derived_chunk(F.col("chunk_id")), 1)).alias("derived"))
