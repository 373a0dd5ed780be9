"""Registered queries of the search operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.functions import text as T
from memlake.operators import evaluate, search
from memlake.plans.fixtures import oracle, table

N = 5
QUERIES: dict = {}
ORACLE_SQL: dict = {}
COLUMNS = {c: search.HELD.get(c, c) for c in T.LEXICAL_COLUMNS}


def register(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = oracle(sql)


def _tables(*names):
    def wrap(f):
        return lambda spark, sf_dir: f(*[table(spark, sf_dir, n) for n in names])

    return wrap


_TOKENS = "regexp_extract_all(translate(lower(coalesce({0}, '')), '" + T.MARKED + "', '" + T.PLAIN + "'), '[\\p{{L}}\\p{{N}}]+')"
_tok = _TOKENS.format
_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"
_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"
_COS = f"round(coalesce(greatest({_DOT.format('{0}', '{1}')} / nullif(sqrt({_DOT.format('{0}', '{0}')}) * sqrt({_DOT.format('{1}', '{1}')}), 0.0), 0.0), 0.0), 6)"
_DERIVED = " OR ".join(f"starts_with(chunk_id, '{p}')" for p in T.DERIVED_PREFIXES)


def _vector(k: int, source: str = "") -> str:
    where = f"WHERE c.source = '{source}'" if source else ""
    return f"""SELECT query_id, chunk_id, score, rank FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
      SELECT q.query_id, c.chunk_id, {_COS.format("q.embedding", "c.embedding")} AS score
      FROM queries q, chunks c {where or "WHERE true"} AND len(c.embedding) = len(q.embedding))) WHERE rank <= {k}"""


def _bm25(k: int) -> str:
    fields = " UNION ALL ".join(f"SELECT chunk_id, '{c}' AS field, unnest({_tok(held)}) AS term FROM chunks" for c, held in COLUMNS.items())
    lens = " + ".join(f"len({_tok(held)})" for held in COLUMNS.values())
    return f"""
      lens AS (SELECT chunk_id, ({lens})::BIGINT AS len FROM chunks), size AS (SELECT count(*) AS n, avg(len) AS mean FROM lens),
      asked AS (SELECT query_id, unnest(list_filter(list_distinct({_tok("query")}), lambda x: NOT list_contains({_STOP}, x))) AS term FROM queries),
      post AS (SELECT chunk_id, term, count(*) AS tf FROM ({fields}) WHERE term IN (SELECT term FROM asked) AND NOT ({_DERIVED}) GROUP BY ALL),
      dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
      lex AS (SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
        SELECT query_id, chunk_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * {search.K1 + 1} / (tf + {search.K1} * ({1 - search.B} + {search.B} * len / mean))), 6) AS score
        FROM asked JOIN post USING (term) JOIN dfs USING (term) JOIN lens USING (chunk_id), size GROUP BY query_id, chunk_id)) WHERE rank <= {k})"""


_ENTITY = """
  words AS (SELECT query_id, list_transform(list_filter(string_split_regex(query, '\\s+'), lambda w: w <> ''), lambda w: regexp_replace(w, '[^\\p{L}\\p{N}_]', '', 'g')) AS w FROM queries),
  cands AS (SELECT query_id, list_sort(list_distinct(list_filter(list_concat(
      list_filter(w, lambda x: regexp_matches(x, '^\\p{Lu}') AND length(x) >= 2),
      list_transform(list_filter(range(1, len(w)), lambda i: regexp_matches(w[i], '^\\p{Lu}') AND regexp_matches(w[i + 1], '^\\p{Lu}')), lambda i: w[i] || ' ' || w[i + 1]),
      list_transform(list_filter(range(1, len(w) - 1), lambda i: regexp_matches(w[i], '^\\p{Lu}') AND w[i + 2] <> ''), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])),
    lambda g: NOT list_contains(CANDIDATE_STOP, lower(string_split(g, ' ')[1]))))) AS c FROM words),
  asked_e AS (SELECT query_id, unnest(c) AS candidate, unnest(range(0, len(c))) AS place FROM cands),
  met AS (SELECT DISTINCT candidate, chunk_id FROM (SELECT DISTINCT candidate FROM asked_e) JOIN entity_index ON contains(lower(entity), lower(candidate))),
  capped AS (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY chunk_id DESC) AS nth FROM met QUALIFY nth <= 700)""".replace("CANDIDATE_STOP", "[" + ", ".join(f"'{w}'" for w in T.CANDIDATE_STOPWORDS) + "]")


def _hybrid(n: int, tail: str) -> str:
    k = min(3 * n, 30)
    cos = f"CASE WHEN len(c.embedding) = len(q.embedding) THEN {_COS.format('q.embedding', 'c.embedding')} ELSE 0.0 END"
    return f"""WITH sem AS ({_vector(k)}), {_bm25(k)}, {_ENTITY},
      ent0 AS (SELECT query_id, chunk_id, min({{'place': place, 'nth': nth}}) AS o FROM capped JOIN asked_e USING (candidate) WHERE (query_id, chunk_id) NOT IN (SELECT (query_id, chunk_id) FROM sem) GROUP BY ALL),
      ent AS (SELECT query_id, chunk_id FROM ent0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY o, chunk_id) <= 700),
      ents AS (SELECT e.query_id, e.chunk_id, {cos} AS score FROM ent e JOIN chunks c USING (chunk_id) JOIN queries q USING (query_id)),
      held AS (SELECT query_id, chunk_id FROM sem UNION SELECT query_id, chunk_id FROM ents),
      streams AS (SELECT query_id, chunk_id, 'semantic' AS stream, 0 AS o, score FROM sem UNION ALL SELECT query_id, chunk_id, 'entity', 1, score FROM ents
        UNION ALL SELECT query_id, chunk_id, 'lexical', 2, score FROM lex WHERE (query_id, chunk_id) NOT IN (SELECT (query_id, chunk_id) FROM held)),
      cand AS (SELECT s.*, c.date, c.superseded_by FROM streams s JOIN chunks c USING (chunk_id)),
      quota AS (SELECT *, row_number() OVER (PARTITION BY query_id, stream ORDER BY score DESC, date NULLS FIRST, chunk_id) AS place FROM cand WHERE superseded_by = '' QUALIFY place <= CASE stream WHEN 'semantic' THEN {3 * n} ELSE {n} END),
      pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY o, place) AS position FROM (SELECT * FROM quota QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY o) = 1))
      {tail}"""


register("hybrid_search", _tables("queries", "chunks", "entity_index")(lambda q, c, e: search.hybrid_search(q, c, e, N)), _hybrid(N, f"SELECT query_id, chunk_id, stream, score, position AS rank FROM pool WHERE position <= {N}"))
register("hybrid_stage_counts", _tables("queries", "chunks", "entity_index")(lambda q, c, e: search.stage_counts(search.hybrid_candidates(q, c, e, N), N)), _hybrid(N, "SELECT c.query_id, c.stream, count(*) AS found, count(*) FILTER (c.superseded_by <> '') AS superseded, count(p.chunk_id) AS pooled FROM cand c LEFT JOIN pool p ON c.query_id = p.query_id AND c.chunk_id = p.chunk_id AND c.stream = p.stream GROUP BY c.query_id, c.stream"))


def _provenance(g, q, c, e):
    found = search.hybrid_candidates(q, c, e, N)
    return evaluate.gold_provenance(g, found, search.compose_pool(search.live(found), N)).withColumn("streams", F.array_join("streams", ","))


register("gold_provenance", _tables("gold", "queries", "chunks", "entity_index")(_provenance), _hybrid(N, """, gs AS (SELECT query_id, unnest(list_distinct(gold)) AS chunk_id FROM gold), st AS (SELECT query_id, chunk_id, string_agg(DISTINCT stream, ',' ORDER BY stream) AS streams FROM cand GROUP BY ALL)
  SELECT gs.query_id, gs.chunk_id, coalesce(streams, '') AS streams, (gs.query_id, gs.chunk_id) IN (SELECT (query_id, chunk_id) FROM pool) AS in_pool FROM gs LEFT JOIN st ON gs.query_id = st.query_id AND gs.chunk_id = st.chunk_id"""))
register("vector_topk", _tables("queries", "chunks")(lambda q, c: search.vector_topk(q, c, 10)), _vector(10))
register("vector_topk_source", _tables("queries", "chunks")(lambda q, c: search.vector_topk(q, c, 3, "src1")), _vector(3, "src1"))
register("bm25", _tables("queries", "chunks")(lambda q, c: search.bm25(q, search.term_index(c), search.doc_lengths(c), 10)), f"WITH {_bm25(10)} SELECT * FROM lex")
register(
    "bm25_scoped", _tables("queries", "chunks")(lambda q, c: search.bm25(q.select("query_id", F.concat(F.lit("title:file"), (F.col("query_id") % 50).cast("string"), F.lit(" md")).alias("query")), search.term_index(c), search.doc_lengths(c), 3).select("query_id", "chunk_id", "rank")),
    """WITH lens AS (SELECT chunk_id, (""" + " + ".join(f"len({_tok(c)})" for c in COLUMNS.values()) + f""")::BIGINT AS len FROM chunks)
    SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY len, chunk_id) AS rank FROM queries JOIN chunks ON title = 'file' || (query_id % 50) || '.md' JOIN lens USING (chunk_id) WHERE NOT ({_DERIVED}) QUALIFY rank <= 3""",
)
register("entity_matches", _tables("queries", "entity_index")(lambda q, e: search.entity_matches(q, e).select("query_id", "candidate", "place", "chunk_id", "nth")), f"WITH {_ENTITY} SELECT query_id, candidate, place, chunk_id, nth FROM capped JOIN asked_e USING (candidate)")
register("search_by_entity", _tables("entity_index", "chunks")(lambda e, c: search.search_by_entity("erin", e, c, "company", 10).select("chunk_id", "date")), "SELECT chunk_id, date FROM chunks WHERE superseded_by = '' AND chunk_id IN (SELECT chunk_id FROM entity_index WHERE contains(lower(entity), 'erin') AND entity_type = 'company') ORDER BY date DESC NULLS LAST, chunk_id LIMIT 10")
register("query_chunks", _tables("chunks")(lambda c: search.query_chunks(c, "src1", "2024/02/01", "2024/10/31", limit=20).select("chunk_id", "date")), "SELECT chunk_id, date FROM chunks WHERE superseded_by = '' AND source = 'src1' AND date >= '2024-02-01' AND date <= '2024-10-31' ORDER BY date DESC NULLS LAST, chunk_id LIMIT 20")
register("filter_docs", _tables("chunks")(lambda c: search.filter_title_contains(search.filter_docs(search.filter_source(c, "src2"), "en", "note"), "file1").select("chunk_id")), "SELECT chunk_id FROM chunks WHERE source = 'src2' AND folder = 'en' AND doc_type = 'note' AND contains(title, 'file1')")
register("drop_superseded", _tables("queries", "chunks")(lambda q, c: search.drop_superseded(search.vector_topk(q, c, 15).join(c.select("chunk_id", "superseded_by"), "chunk_id"), 5).select("query_id", "chunk_id", "rank")), f"WITH v AS ({_vector(15)}) SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY v.rank, chunk_id) AS rank FROM v JOIN chunks USING (chunk_id) WHERE superseded_by = '' QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY v.rank, chunk_id) <= 5")
register("derived_dropped", _tables("queries", "chunks")(lambda q, c: search.derived_dropped(search.vector_topk(q, c, 10), 10)), f"WITH v AS ({_vector(10)}) SELECT query_id, count(*) FILTER ({_DERIVED}) AS derived FROM v GROUP BY query_id")
register("lookup_chunks", _tables("gold", "chunks")(lambda g, c: search.lookup_chunks(g.select(F.col("primary_gold").alias("chunk_id")).distinct(), c).select("chunk_id", "char_count")), "SELECT chunk_id, char_count FROM chunks WHERE chunk_id IN (SELECT primary_gold FROM gold)")
register("tokenize", _tables("documents")(lambda d: d.select(F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))), f"SELECT term, count(*) AS n FROM (SELECT unnest({_tok('text')}) AS term FROM documents) GROUP BY term")
_RANKED = f"WITH v AS ({_vector(10)}), r AS (SELECT query_id, list(chunk_id ORDER BY rank) AS got FROM v GROUP BY query_id), "
_EVAL = """e AS (SELECT query_id, gold, primary_gold, list_slice(coalesce(got, []), 1, n) AS got FROM gold LEFT JOIN r USING (query_id)),
  m AS (SELECT query_id, len(gold) AS gold, len(list_intersect(gold, got)) AS exact_hits, len(list_filter(gold, lambda g: list_contains(list_transform(got, lambda x: regexp_replace(x, '_chunk_[0-9]+$', '')), regexp_replace(g, '_chunk_[0-9]+$', '')))) AS doc_hits,
    round(len(list_intersect(gold, got)) / len(gold), 6) AS recall, nullif(coalesce(list_position(got, primary_gold), 0), 0)::BIGINT AS primary_rank,
    nullif(coalesce(list_position(list_transform(got, lambda x: regexp_replace(x, '_chunk_[0-9]+$', '')), regexp_replace(primary_gold, '_chunk_[0-9]+$', '')), 0), 0)::BIGINT AS primary_doc_rank FROM e)"""


def _evaluated(g, q, c):
    ranked = search.vector_topk(q, c, 10).groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("chunk_ids"))
    return evaluate.evaluate_retrieval(g, ranked)


register("evaluate_retrieval", _tables("gold", "queries", "chunks")(_evaluated), _RANKED + _EVAL + " SELECT * FROM m")
register("evaluation_summary", _tables("gold", "queries", "chunks")(lambda g, q, c: evaluate.evaluation_summary(_evaluated(g, q, c))), _RANKED + _EVAL + " SELECT count(*) AS queries, round(avg(recall), 6) AS macro_recall, round(sum(exact_hits) / sum(gold), 6) AS micro_recall, round(sum(doc_hits) / sum(gold), 6) AS doc_recall, round(count(primary_rank) / count(*), 6) AS primary_hits FROM m")
register("gold_missing", _tables("gold", "chunks")(evaluate.gold_missing), "SELECT query_id, list_sort(list(g)) AS missing FROM (SELECT query_id, unnest(gold) AS g FROM gold) WHERE g NOT IN (SELECT chunk_id FROM chunks) GROUP BY query_id")
register("corpus_violations", _tables("gold")(lambda g: evaluate.corpus_violations(g, ("fact", "other"))), "SELECT query_id, 'no query' AS rule FROM gold WHERE trim(query) = '' UNION ALL SELECT query_id, 'category' FROM gold WHERE category NOT IN ('fact', 'other') UNION ALL SELECT query_id, 'n' FROM gold WHERE n NOT IN (3, 5, 10) UNION ALL SELECT query_id, 'gold type' FROM gold WHERE gold_type <> 'multi'")
