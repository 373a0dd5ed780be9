"""Registered queries of facts, entities, lifecycle, mail, statistics, chunking and series."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.functions import text as T
from memlake.operators import chunking, entities, facts, lifecycle, mail, stats
from memlake.plans.fixtures import oracle, table
from memlake.plans.search_queries import _COS
from memlake.sources import exports

QUERIES: dict = {}
ORACLE_SQL: dict = {}
DAY = "2024-05-20"


def register(name: str, names: str, run, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: run(*[table(spark, sf_dir, n) for n in names.split()])
    if sql:
        ORACLE_SQL[name] = oracle(sql)


def listed(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_ACTIVE = f"superseded_by IS NULL AND (expires_at = '' OR expires_at > '{DAY}')"
_DERIVED = " OR ".join(f"starts_with(chunk_id, '{p}')" for p in T.DERIVED_PREFIXES)

# facts
register("active_facts", "facts", lambda f: facts.active_facts(f, DAY).select("id", "expires_at"), f"SELECT id, expires_at FROM facts WHERE {_ACTIVE}")
register("facts_for_chunks", "chunks facts", lambda c, f: facts.facts_for_chunks(c, f, DAY), f"SELECT chunk_id, coalesce(fs, []) AS facts FROM chunks LEFT JOIN (SELECT chunk_id, list(fact ORDER BY id) AS fs FROM facts WHERE {_ACTIVE} GROUP BY chunk_id) USING (chunk_id)")
register("derived_facts_for_query", "queries facts", lambda q, f: facts.derived_facts_for_query(q, f, DAY), f"""
  WITH caps AS (SELECT query_id, regexp_extract_all(query, '[A-Z][A-Za-z0-9]+') AS w FROM queries),
  terms AS (SELECT DISTINCT query_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM caps),
  tags AS (SELECT id, fact, confidence, unnest(entity_tags) AS tag FROM facts WHERE {_ACTIVE} AND relation_type = 'derived'),
  hits AS (SELECT DISTINCT term, id, fact, confidence FROM (SELECT DISTINCT term FROM terms) JOIN tags ON contains(lower(tag), lower(term))),
  best AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY term ORDER BY confidence DESC, id) <= 5),
  once AS (SELECT query_id, fact, max(confidence) AS confidence FROM best JOIN terms USING (term) GROUP BY ALL)
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, fact) AS rank FROM once QUALIFY rank <= 5""")
register("valid_facts", "facts", lambda f: facts.valid_facts(f.select("chunk_id", F.when(F.col("id") % 8 == 0, " short ").otherwise(F.concat(F.lit("  "), "fact")).alias("fact"), F.concat(F.lit("CAT-"), "category").alias("category"), F.array_repeat("category", 12).alias("tags"), F.when(F.col("id") % 3 == 0, "soon").when(F.col("id") % 3 == 1, F.col("event_date")).alias("expires"), F.col("event_date").alias("date"))), """
  SELECT chunk_id, substr(trim(fact), 1, 500) AS fact, 'cat-' || category AS category, list_resize([category], 10, category) AS entity_tags, CASE WHEN id % 3 = 1 THEN event_date ELSE '' END AS expires_at, 1.0::DOUBLE AS confidence, event_date AS document_date
  FROM facts WHERE id % 8 <> 0 AND length(trim(fact)) >= 10""")
register("classify_coverable", "chunks", lambda c: facts.classify_coverable(c).select("chunk_id", "verdict"), rf"""
  WITH l AS (SELECT chunk_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS ls FROM chunks)
  SELECT chunk_id, CASE WHEN length(regexp_replace(t, '[^\p{{L}}\p{{N}}]', '', 'g')) < 0.05 * greatest(length(t), 1) THEN 'empty' WHEN length(trim(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) < 50 THEN 'short'
    WHEN len(ls) >= 3 AND len(list_filter(ls, lambda x: regexp_matches(x, '{facts.CODE_LINE}'))) > 0.6 * len(ls) THEN 'code' ELSE 'extractable' END AS verdict FROM l""")
register("pending_chunks", "chunks extraction_log", lambda c, g: facts.pending_chunks(c, g).select("chunk_id"), "SELECT chunk_id FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM extraction_log WHERE model = 'failed_persistent' OR NOT starts_with(model, 'failed_'))")
register("failure_state", "chunks extraction_log", lambda c, g: facts.failure_state(c, g), "SELECT chunk_id, n AS facts_count, CASE WHEN n <= -3 THEN 'failed_persistent' ELSE 'failed_' || -n END AS model FROM (SELECT chunk_id, (least(coalesce(facts_count, 0), 0) - 1)::INT AS n FROM chunks LEFT JOIN extraction_log USING (chunk_id))")
_PAIRS = """k AS (SELECT category || '|' || lower(trim(entity_tags[1])) AS cluster, id, fact, created_at, row_number() OVER (PARTITION BY category, lower(trim(entity_tags[1])) ORDER BY id) AS rn FROM facts WHERE superseded_by IS NULL)"""
register("candidate_pairs", "facts judged_pairs", lambda f, j: facts.candidate_pairs(f, j).select("cluster", "a", "b"), f"""WITH {_PAIRS}
  SELECT x.cluster, x.id AS a, y.id AS b FROM k x JOIN k y ON x.cluster = y.cluster AND y.rn > x.rn AND y.rn - x.rn < 20
  WHERE NOT EXISTS (SELECT 1 FROM judged_pairs WHERE fact_id_a = x.id AND fact_id_b = y.id AND x.created_at < judged_at AND y.created_at < judged_at)""")
register("supersession_candidates", "facts judged_pairs", facts.supersession_candidates)
register("superseded_chain", "facts", facts.superseded_chain, "SELECT o.id AS old_id, n.id AS new_id, o.fact AS old_fact, n.fact AS new_fact FROM facts o JOIN facts n ON o.superseded_by = n.id")
register("apply_supersession", "facts judged_pairs", lambda f, j: facts.apply_supersession(f, j.select(F.col("fact_id_a").alias("old_id"), F.col("fact_id_b").alias("new_id"), F.col("fact_id_a").alias("seq")), "2024-12-01").select("id", "superseded_by", "superseded_at"), "SELECT id, coalesce(fact_id_b, superseded_by) AS superseded_by, CASE WHEN fact_id_b IS NOT NULL THEN '2024-12-01' ELSE superseded_at END AS superseded_at FROM facts LEFT JOIN judged_pairs ON id = fact_id_a")
_ENDED = "list_reduce(list_concat([lower(trim(name))], " + listed(T.COMPANY_ENDINGS) + "), lambda s, e: CASE WHEN ends_with(s, e) THEN trim(s[:length(s) - length(e)]) ELSE s END)"
_BARE = f"regexp_replace({_ENDED}, '[.,;:!?()\\[\\]{{}}''\"]+', '', 'g')"
_WORDS = f"list_filter(string_split_regex({_BARE}, '\\s+'), lambda w: w <> '')"
_NORM = f"CASE WHEN len({_WORDS}) <= 3 THEN array_to_string(list_sort({_WORDS}[1:2]), ' ') ELSE {_BARE} END"
_MONTH = "(" + "|".join(T.MONTHS) + ")"
_NOISE = f"""CASE WHEN {{0}} IN ({listed(T.NOISE_WORDS)[1:-1]}) THEN 'noise_token' WHEN regexp_full_match({{0}}, '[0-9\\s]+') THEN 'numeric' WHEN {{0}} IN ({listed(T.UI_FRAGMENTS)[1:-1]}) THEN 'ui_fragment'
  WHEN regexp_full_match({{0}}, '{_MONTH} (19|20)[0-9][0-9]|(19|20)[0-9][0-9] {_MONTH}') THEN 'temporal' WHEN regexp_full_match({{0}}, '[a-z][a-z][0-9][0-9][0-9][0-9]+') THEN 'vat_id'
  WHEN regexp_full_match({{0}}, '[a-z]{{{{6}}}}[0-9][0-9][a-z][0-9][0-9][a-z][0-9][0-9][0-9][a-z]') THEN 'tax_code' WHEN regexp_full_match({{0}}, '[0-9a-f]{{{{8}}}}(-[0-9a-f]{{{{4}}}}){{{{3}}}}-[0-9a-f]{{{{12}}}}') THEN 'uuid' END"""
register("entity_fact_groups", "facts", facts.entity_fact_groups, f"""
  WITH r AS (SELECT id, fact, created_at, relation_type, name, {_NORM} AS entity FROM (SELECT *, unnest(entity_tags) AS name FROM facts WHERE superseded_by IS NULL) WHERE {_NOISE.format('(' + _NORM + ')')} IS NULL),
  t AS (SELECT entity, fact, list(DISTINCT name) AS names, max(created_at) FILTER (relation_type <> 'derived') AS newest FROM r GROUP BY entity, fact)
  SELECT entity, list_sort(list_distinct(flatten(list(names)))) AS names, count(*) AS facts, max(newest) AS newest FROM t GROUP BY entity HAVING count(*) >= 5""")
register("facts_for_derivation", "facts", lambda f: facts.facts_for_derivation(f, 5), f"SELECT entity, id, event_date, row_number() OVER (PARTITION BY entity ORDER BY event_date DESC NULLS LAST, id) AS rank FROM (SELECT DISTINCT id, event_date, {_NORM} AS entity FROM (SELECT id, event_date, unnest(entity_tags) AS name FROM facts)) WHERE entity <> '' QUALIFY rank <= 5")
_GROUPS = f"g AS (SELECT entity, count(*) AS facts, max(newest) AS newest FROM (SELECT {_NORM} AS entity, fact, max(created_at) FILTER (relation_type <> 'derived') AS newest FROM (SELECT *, unnest(entity_tags) AS name FROM facts WHERE superseded_by IS NULL) WHERE {_NOISE.format('(' + _NORM + ')')} IS NULL GROUP BY ALL) GROUP BY entity HAVING count(*) >= 5)"
_MARKS = "m AS (SELECT entity, '2024-04-01T00:00:00' AS watermark FROM g WHERE length(entity) % 2 = 0)"


def _marks(groups):
    return groups.filter(F.length("entity") % 2 == 0).select("entity", F.lit("2024-04-01T00:00:00").alias("watermark"))


register("derivation_queue", "facts", lambda f: facts.derivation_queue(g := facts.entity_fact_groups(f), _marks(g), "2024-08-01"), f"WITH {_GROUPS}, {_MARKS} SELECT entity, CASE WHEN newest > '2024-08-01' THEN 1 ELSE 2 END AS tier, newest, facts FROM g LEFT JOIN m USING (entity) WHERE newest > coalesce(watermark, '')")
register("advance_marks", "facts", lambda f: facts.advance_marks(_marks(g := facts.entity_fact_groups(f)), g), f"WITH {_GROUPS}, {_MARKS} SELECT entity, max(w) AS watermark FROM (SELECT entity, newest AS w FROM g UNION ALL SELECT entity, watermark FROM m) GROUP BY entity")
register("derived_rows", "facts", lambda f: facts.derived_rows(f.select(F.concat(F.lit("e"), "id").alias("entity"), F.array(F.col("id"), F.col("id") + 1).alias("ids"), F.concat(F.lit('```json\n[{"fact": "new '), "id", F.lit('", "confidence": '), "confidence", F.lit(', "sources": [2, 9, 1]}, {"fact": " Old ", "confidence": 0.9, "sources": [1]}]\n```')).alias("response")), f.filter("id % 2 = 0").select(F.concat(F.lit("e"), "id").alias("entity"), F.lit("old").alias("fact"))), "SELECT 'e' || id AS entity, 'new ' || id AS fact, confidence, [id + 1, id] AS derived_from FROM facts WHERE confidence >= 0.5 UNION ALL SELECT 'e' || id, 'Old', 0.9, [id] FROM facts WHERE id % 2 = 1")
register("parsed_facts", "facts", lambda f: facts.parsed_facts(f.select("chunk_id", F.when(F.col("id") % 5 == 0, '```json\n[{"fact": "a"}, {"fact": "b"}]\n```').when(F.col("id") % 5 == 1, '{"facts": [{"fact": "c"}]}').when(F.col("id") % 5 == 2, '{"fact": "d"}').when(F.col("id") % 5 == 3, '[{"fact": "e"}, {"fact": "cut').otherwise("Here: [{\"fact\": \"f\"}] done").alias("response"))).select("chunk_id", F.array_join(F.transform("facts", lambda x: x["fact"]), ",").alias("facts"), "ok"), "SELECT chunk_id, CASE id % 5 WHEN 0 THEN 'a,b' WHEN 1 THEN 'c' WHEN 2 THEN 'd' WHEN 3 THEN '' ELSE 'f' END AS facts, id % 5 <> 3 AS ok FROM facts")

# entities
_PARSED = ("doc_id", "entities_extracted")


def _parsed(c):
    return c.select("chunk_id", F.array(F.concat(F.lit("Ann"), (F.col("doc_id") % 9).cast("string")), F.lit(" "), F.lit("Acme "), F.lit("late")).alias("entities"), F.when(F.col("doc_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("person"), F.lit("company"), F.when(F.col("doc_id") % 3 == 0, "ship").otherwise("company"))).alias("types"))


_VALID = "CASE WHEN doc_id % 3 = 0 THEN ['Ann' || doc_id % 9] ELSE ['Ann' || doc_id % 9, 'Acme '] END"
_VALID_T = "CASE WHEN doc_id % 3 = 0 THEN ['person'] ELSE ['person', 'company'] END"


def _with_entities(c):
    return entities.mark_entities(c.withColumns({"entities": F.lit(None).cast("array<string>"), "entity_types": F.lit(None).cast("array<string>")}), entities.valid_entities(_parsed(c.filter("doc_id % 2 = 0"))))


_INDEX = "i AS (SELECT DISTINCT trim(e) AS entity, t AS entity_type, chunk_id FROM (SELECT chunk_id, unnest(" + _VALID + ") AS e, unnest(" + _VALID_T + ") AS t FROM chunks WHERE doc_id % 2 = 0 AND doc_id % 5 <> 0))"
register("valid_entities", "chunks", lambda c: entities.valid_entities(_parsed(c)), f"SELECT chunk_id, {_VALID} AS entities, {_VALID_T} AS entity_types FROM chunks WHERE doc_id % 5 <> 0")
register("mark_entities", "chunks", lambda c: _with_entities(c).select("chunk_id", "entities_extracted", F.size("entities").alias("n")), "SELECT chunk_id, CASE WHEN doc_id % 2 = 0 AND doc_id % 5 <> 0 THEN 1 ELSE entities_extracted END AS entities_extracted, CASE WHEN doc_id % 2 = 0 AND doc_id % 5 <> 0 THEN CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END END AS n FROM chunks")
register("needs_extraction", "chunks", lambda c: entities.needs_extraction(c).select("chunk_id"), "SELECT chunk_id FROM chunks WHERE entities_extracted <> 1")
register("build_entity_index", "chunks", lambda c: entities.build_entity_index(_with_entities(c)), f"WITH {_INDEX} SELECT * FROM i")
register("entity_stats", "entity_index", entities.entity_stats, "SELECT entity_type, count(*) AS n, count(DISTINCT entity) AS entities, count(DISTINCT chunk_id) AS chunks FROM entity_index GROUP BY entity_type UNION ALL SELECT 'all', count(*), count(DISTINCT entity), count(DISTINCT chunk_id) FROM entity_index")
register("top_entities", "entity_index", lambda e: entities.top_entities(e, 15), "SELECT lower(entity) AS entity, entity_type, count(*) AS n FROM entity_index GROUP BY ALL ORDER BY n DESC, 1, 2 LIMIT 15")
_MADE = "concat(entity, CASE length(entity) % 8 WHEN 0 THEN ' 2024' WHEN 1 THEN ' S.p.A.' WHEN 2 THEN ', Gian-Luca & Co' WHEN 3 THEN ' limited' ELSE '' END)"
register("normal_entity", "entity_index", lambda e: e.selectExpr(f"{_MADE} AS name").distinct().select("name", T.normal_entity(F.col("name")).alias("entity")).select("name", "entity", T.entity_noise(F.col("entity")).alias("noise")), f"""
  WITH n AS (SELECT DISTINCT {_MADE} AS name FROM entity_index), e AS (SELECT name, {_NORM} AS entity FROM n) SELECT name, entity, {_NOISE.format('entity')} AS noise FROM e""")

# lifecycle
register("pivot_metadata", "eav", lambda e: lifecycle.pivot_metadata(e, ("name", "brand", "type")), "SELECT id, coalesce(max(CASE WHEN key = 'name' THEN string_value END), '') AS name, coalesce(max(CASE WHEN key = 'brand' THEN string_value END), '') AS brand, coalesce(max(CASE WHEN key = 'type' THEN string_value END), '') AS type FROM eav GROUP BY id")


#: The order of the fields of a fingerprint.
FINGERPRINTED = ("text", "title", "folder", "doc_type", "email_from", "source", "file_path")


def _wanted(c):
    return c.select("chunk_id", "doc_id", T.fingerprint(*[F.col(c) for c in FINGERPRINTED]).alias("fingerprint"))


def _held(c):
    return _wanted(c).filter("doc_id % 13 <> 1").select(F.when(F.col("doc_id") % 17 == 2, F.concat(F.lit("gone_"), "chunk_id")).otherwise(F.col("chunk_id")).alias("chunk_id"), F.when(F.col("doc_id") % 19 == 3, "old").otherwise(F.col("fingerprint")).alias("fingerprint"))


_PLAN = """wanted AS (SELECT chunk_id, doc_id FROM chunks), held AS (SELECT CASE WHEN doc_id % 17 = 2 THEN 'gone_' || chunk_id ELSE chunk_id END AS chunk_id, doc_id % 19 = 3 AS old FROM chunks WHERE doc_id % 13 <> 1),
  plan AS (SELECT coalesce(w.chunk_id, h.chunk_id) AS chunk_id, CASE WHEN h.chunk_id IS NULL THEN 'insert' WHEN w.chunk_id IS NULL THEN 'delete' WHEN old THEN 'update' ELSE 'unchanged' END AS action FROM wanted w FULL JOIN held h ON w.chunk_id = h.chunk_id)"""
_CHURN = ", c AS (SELECT count(*) FILTER (action = 'insert') AS inserted, count(*) FILTER (action = 'delete') AS deleted, count(*) FILTER (action = 'update') AS updated, count(*) FILTER (action = 'unchanged') AS unchanged FROM plan) SELECT *, round((inserted + deleted + updated) / greatest(inserted + updated + unchanged, deleted + updated + unchanged), 6) AS churn, (inserted + deleted + updated) / greatest(inserted + updated + unchanged, deleted + updated + unchanged) > 0.2 AS abort FROM c"
register("reconcile_plan", "chunks", lambda c: lifecycle.reconcile_plan(_wanted(c), _held(c)), f"WITH {_PLAN} SELECT * FROM plan")
register("churn_guard", "chunks", lambda c: lifecycle.churn(lifecycle.reconcile_plan(_wanted(c), _held(c))), f"WITH {_PLAN} {_CHURN}")
register("reconcile_noop", "chunks", lambda c: lifecycle.churn(lifecycle.reconcile_plan(_wanted(c), _wanted(c))), "SELECT 0::BIGINT AS inserted, 0::BIGINT AS deleted, 0::BIGINT AS updated, count(*) AS unchanged, 0.0::DOUBLE AS churn, false AS abort FROM chunks")
_PRINTS = "SELECT chunk_id, sha256(" + " || ".join(f"octet_length(encode(coalesce({c}, '')))::STRING || chr(0) || coalesce({c}, '') || chr(0)" for c in ("text", "title", "folder", "doc_type", "email_from", "source", "file_path")) + ") AS fingerprint FROM chunks"
register("apply_reconcile", "chunks", lambda c: lifecycle.apply_reconcile(lifecycle.reconcile_plan(_wanted(c), _held(c)), _held(c), _wanted(c).drop("doc_id"), most=1.0).select("chunk_id", "fingerprint"), _PRINTS)
register("fingerprint", "chunks", lambda c: _wanted(c).select("chunk_id", "fingerprint"), _PRINTS)
register("fts_cardinality", "chunks", lambda c: lifecycle.fts_cardinality(c.filter("doc_id % 7 <> 0").select("chunk_id", F.lit("f").alias("fingerprint")), c.filter("doc_id % 5 <> 0").select("chunk_id").union(c.filter("doc_id % 11 = 1").select("chunk_id"))), f"""
  WITH i AS (SELECT chunk_id, count(*) AS n FROM (SELECT chunk_id FROM chunks WHERE doc_id % 5 <> 0 UNION ALL SELECT chunk_id FROM chunks WHERE doc_id % 11 = 1) GROUP BY 1), m AS (SELECT chunk_id, 'f' AS f FROM chunks WHERE doc_id % 7 <> 0)
  SELECT coalesce(m.chunk_id, i.chunk_id) AS chunk_id, CASE WHEN f IS NOT NULL AND n = 1 THEN f ELSE '{lifecycle.BROKEN}' END AS fingerprint FROM m FULL JOIN i ON m.chunk_id = i.chunk_id""")
register("orphan_chunks", "registry files chunks", lifecycle.orphan_chunks, """
  WITH gone AS (SELECT filepath, filename, string_split(filepath, '/')[4] AS folder FROM registry WHERE filepath NOT IN (SELECT filepath FROM files)),
  a AS (SELECT filepath, chunk_id FROM gone JOIN chunks ON filepath = file_path)
  SELECT DISTINCT filepath, chunk_id, 'path' AS tier FROM a""")
register("realign_plan", "registry files chunks", lifecycle.realign_plan, """
  WITH h AS (SELECT hash, count(*) AS places, min(filepath) AS target FROM files GROUP BY hash), c AS (SELECT file_path, count(*) AS held FROM chunks GROUP BY 1),
  r AS (SELECT g.filepath, g.hash AS rh, f.hash AS fh, places, h.target, held, h.target IN (SELECT filepath FROM registry) AS taken FROM registry g LEFT JOIN files f USING (filepath) LEFT JOIN h ON h.hash = g.hash LEFT JOIN c ON c.file_path = g.filepath),
  w AS (SELECT *, sum(CASE WHEN fh IS NULL AND places = 1 AND NOT taken AND held IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY target) AS wanted FROM r),
  v AS (SELECT filepath, target, CASE WHEN fh = rh THEN 'aligned' WHEN fh IS NOT NULL THEN 'modified' WHEN places IS NULL THEN 'orphan' WHEN places > 1 THEN 'skipped: several' WHEN taken THEN 'skipped: registered' WHEN held IS NULL THEN 'skipped: no chunks' WHEN wanted > 1 THEN 'skipped: wanted twice' ELSE 'realign' END AS verdict FROM w)
  SELECT filepath, verdict, CASE WHEN verdict = 'realign' THEN target END AS target FROM v""")
_VICTIMS = "vic AS (SELECT id, regexp_extract(chunk_id, '^doc_(.+)_chunk_[0-9]+$', 1) AS hash FROM facts WHERE id // 10000 % 10 = 3 AND starts_with(chunk_id, 'doc_') AND contains(chunk_id, '_chunk_'))"


def _hashes(f):
    return f.filter("id div 10000 % 10 = 3").select(F.regexp_extract("chunk_id", "^doc_(.+)_chunk_[0-9]+$", 1).alias("hash")).filter("hash <> ''").distinct()


register("purge_plan", "facts", lambda f: lifecycle.purge_plan(f, _hashes(f)), f"""
  WITH {_VICTIMS}, q AS (SELECT id, derived_from, unnest(derived_from) AS ref FROM facts WHERE relation_type = 'derived' AND id NOT IN (SELECT id FROM vic)),
  h AS (SELECT q.id, any_value(derived_from) AS d, list_sort(list_distinct(list(hash))) AS docs, list_distinct(list(ref)) AS gone FROM q JOIN vic ON ref = vic.id GROUP BY q.id)
  SELECT id, 'victim' AS action, [hash] AS docs, []::BIGINT[] AS kept_refs, 0::BIGINT AS lost FROM vic UNION ALL SELECT id, 'quarantine', docs, list_filter(d, lambda x: NOT list_contains(gone, x)), len(gone) FROM h
  UNION ALL SELECT f.id, 'reset', [hash], []::BIGINT[], 0::BIGINT FROM facts f JOIN vic ON f.superseded_by = vic.id WHERE f.id NOT IN (SELECT id FROM vic)""")
register("apply_purge", "facts", lambda f: lifecycle.apply_purge(f, lifecycle.purge_plan(f, _hashes(f))).select("id", "relation_type", "superseded_by"), f"""
  WITH {_VICTIMS}, cites AS (SELECT DISTINCT q.id FROM (SELECT id, unnest(derived_from) AS ref FROM facts WHERE relation_type = 'derived') q JOIN vic ON ref = vic.id)
  SELECT f.id, CASE WHEN cites.id IS NOT NULL THEN 'derived_purged_source' ELSE relation_type END AS relation_type, CASE WHEN s.id IS NULL THEN superseded_by END AS superseded_by
  FROM facts f LEFT JOIN cites ON cites.id = f.id LEFT JOIN vic s ON s.id = f.superseded_by WHERE f.id NOT IN (SELECT id FROM vic)""")
register("invalidate_sidecars", "entity_index facts", lambda e, f: lifecycle.invalidate_sidecars(e, _hashes(f).select(F.concat(F.lit("doc_"), "hash").alias("prefix"))), f"WITH {_VICTIMS} SELECT entity, entity_type, chunk_id FROM entity_index WHERE regexp_replace(chunk_id, '_chunk_[^_]*$', '') NOT IN (SELECT 'doc_' || hash FROM vic)")


def _relations(c):
    v = c.filter("doc_id % 6 = 0").select(F.col("chunk_id").alias("new_id"), (F.col("doc_id") - 1).alias("o"), F.when(F.col("doc_id") % 12 == 0, "SUPERSEDES").otherwise("EXTENDS").alias("relation"), ((F.col("doc_id") % 10) / 10).alias("confidence"))
    v = v.join(c.select(F.col("doc_id").alias("o"), F.col("chunk_id").alias("old_id")), "o")
    return lifecycle.apply_chunk_relations(c, v)


_REL = "v AS (SELECT n.chunk_id AS new_id, o.chunk_id AS old_id, n.doc_id % 12 = 0 AS s FROM chunks n JOIN chunks o ON o.doc_id = n.doc_id - 1 WHERE n.doc_id % 6 = 0 AND n.doc_id % 10 / 10 >= 0.7)"
register("apply_chunk_relations", "chunks", lambda c: _relations(c).select("chunk_id", "superseded_by", "supersedes", "extends", "extended_by"), f"WITH {_REL} SELECT chunk_id, coalesce(a.new_id, superseded_by) AS superseded_by, b.old_id AS supersedes, e.old_id AS extends, x.new_id AS extended_by FROM chunks LEFT JOIN v a ON a.old_id = chunk_id AND a.s LEFT JOIN v b ON b.new_id = chunk_id AND b.s LEFT JOIN v e ON e.new_id = chunk_id AND NOT e.s LEFT JOIN v x ON x.old_id = chunk_id AND NOT x.s")
register("relation_stats", "chunks", lambda c: stats.relation_stats(_relations(c)), f"WITH {_REL} SELECT (SELECT count(*) FROM chunks WHERE superseded_by <> '' OR chunk_id IN (SELECT old_id FROM v WHERE s)) AS superseded_by, count(*) FILTER (s) AS supersedes, count(*) FILTER (NOT s) AS extends, count(*) FILTER (NOT s) AS extended_by, (SELECT count(*) FROM chunks) AS checked FROM v")
register("chunk_supersession_candidates", "chunks", lambda c: lifecycle.chunk_supersession_candidates(c, 3, 0.3), f"""
  WITH u AS (SELECT chunk_id, create_time, superseded_by, length(text) AS n, embedding AS v FROM chunks WHERE embedding IS NOT NULL),
  p AS (SELECT a.chunk_id, b.chunk_id AS older_id, {_COS.format("a.v", "b.v")} AS score FROM u a JOIN u b ON b.create_time < a.create_time WHERE b.superseded_by = '' AND b.n >= 50)
  SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY score DESC, older_id) AS rank FROM p WHERE score >= 0.3 QUALIFY rank <= 3""")
register("audit_vectors", "chunks", lambda c: lifecycle.audit_vectors(c.filter("doc_id % 9 <> 0 AND embedding IS NOT NULL").select("chunk_id", F.when(F.col("doc_id") % 4 == 1, F.transform("embedding", lambda x, i: x + i)).when(F.col("doc_id") % 4 == 2, F.transform("embedding", lambda x: x * 2)).when(F.col("doc_id") % 4 == 3, F.transform("embedding", lambda x, i: -x)).otherwise(F.col("embedding")).alias("embedding")), c.filter("embedding IS NOT NULL").select("chunk_id", "embedding", F.transform("embedding", lambda x, i: x + i).alias("alternative"))), "SELECT chunk_id, CASE WHEN doc_id % 9 = 0 THEN 'missing' WHEN doc_id % 4 = 1 THEN 'violator' WHEN doc_id % 4 = 3 OR doc_id % 53 = 0 THEN 'irreproducible' ELSE 'healthy' END AS verdict FROM chunks WHERE embedding IS NOT NULL")
register("conversations_without_summary", "chunks", lifecycle.conversations_without_summary, f"SELECT conv_id, arg_min(date, chunk_index) AS date, arg_min(title, chunk_index) AS title FROM (SELECT conv_id, {{'d': date}} AS d, date, title, chunk_index FROM chunks WHERE NOT ({_DERIVED}) AND conv_id NOT IN (SELECT conv_id FROM chunks WHERE starts_with(chunk_id, 'conv_summary_')) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY chunk_index, chunk_id) = 1) GROUP BY conv_id")
register("documents_without_summary", "registry chunks", lambda r, c: lifecycle.documents_without_summary(r, c).select("filepath"), "SELECT filepath FROM registry WHERE chunks > 0 AND (filename, string_split(filepath, '/')[4]) NOT IN (SELECT (title, folder) FROM chunks WHERE starts_with(chunk_id, 'doc_summary_'))")
register("classify_files", "files registry", lifecycle.classify_files, "SELECT f.filepath, CASE WHEN row_number() OVER (PARTITION BY f.hash ORDER BY f.filepath) > 1 THEN 'duplicate' WHEN fail_count >= 3 THEN 'failed' WHEN r.hash IS NULL THEN 'new' WHEN r.hash <> f.hash THEN 'modified' ELSE 'unchanged' END AS verdict FROM files f LEFT JOIN registry r USING (filepath)")
register("prune_checkpoint", "documents", lambda d: (p := lifecycle.prune_checkpoint(d.filter("doc_id % 2 = 0").select("doc_id"), d.filter("doc_id % 3 = 0").select("doc_id")))[0].select("doc_id", F.lit("stale").alias("side")).union(p[1].select("doc_id", F.lit("kept").alias("side"))), "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'stale' ELSE 'kept' END AS side FROM documents WHERE doc_id % 2 = 0")
register("known_and_new_ids", "documents", lambda d: lifecycle.new_ids(d.select("doc_id"), lifecycle.known_ids(d.filter("doc_id % 2 = 0").select("doc_id"), d.filter("doc_id % 3 = 0").select("doc_id"))), "SELECT doc_id FROM documents WHERE doc_id % 2 <> 0 AND doc_id % 3 <> 0")
register("merge_streams", "documents", lambda d: lifecycle.merged_streams([d.filter("doc_id % 3 < 2").select((F.col("doc_id") % 101).alias("k"), F.col("doc_id").alias("position")), d.select((F.col("doc_id") % 103).alias("k"), (-F.col("doc_id")).alias("position"))], "k").select("k", "stream", "position"), "SELECT k, stream, position FROM (SELECT doc_id % 101 AS k, 0 AS stream, doc_id AS position FROM documents WHERE doc_id % 3 < 2 UNION ALL SELECT doc_id % 103, 1, -doc_id FROM documents) QUALIFY row_number() OVER (PARTITION BY k ORDER BY stream, position) = 1")
register("dedupe_first", "conversations", lambda c: c.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("r")).select("conv_id", lifecycle.deduped(F.col("r")).alias("d")).select("conv_id", F.array_join("d.items", ",").alias("items"), F.col("d.dropped").cast("long").alias("dropped")), "SELECT conv_id, string_agg(role, ',' ORDER BY t) AS items, sum(n)::BIGINT - count(*) AS dropped FROM (SELECT conv_id, role, min(turn) AS t, count(*) AS n FROM conversations GROUP BY ALL) GROUP BY conv_id")
