"""Registered queries of statistics, mail, series, conversations, text functions and the search options."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.functions import text as T
from memlake.operators import chunking, facts, lifecycle, mail, search, stats
from memlake.plans.fixtures import oracle, table
from memlake.plans.search_queries import _COS, _ENTITY, _bm25, _hybrid, _tok, _vector
from memlake.plans.store_queries import _ACTIVE, DAY
from memlake.sources import exports
from memlake.streaming import jobs

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def register(name: str, names: str, run, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: run(*[table(spark, sf_dir, n) for n in names.split()])
    if sql:
        ORACLE_SQL[name] = oracle(sql)


# statistics
_KB = "count(*) AS chunks, count(DISTINCT conv_id) AS conversations, sum(char_count)::BIGINT AS chars, (sum(char_count) // 4)::BIGINT AS tokens, min(date) AS first_date, max(date) AS last_date, count(*) FILTER (date IS NULL) AS undated"
register("kb_stats", "chunks", stats.kb_stats, f"SELECT source, {_KB} FROM chunks GROUP BY source UNION ALL SELECT 'all', {_KB} FROM chunks")
register("top_models", "chunks", stats.top_models, "SELECT coalesce(model, 'unknown') AS model, count(*) AS n FROM chunks GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5")
register("chunks_by_source", "chunks", lambda c: stats.rows_by(c, "source", "folder"), "SELECT source, folder, count(*) AS n FROM chunks GROUP BY ALL")
register("coverage_stats", "chunks facts extraction_log", stats.coverage_stats, """
  SELECT c.n AS chunks, f.*, g.*, greatest(0, c.n - skipped - failed) AS coverable FROM (SELECT count(*) AS n FROM chunks) c,
    (SELECT count(*) AS facts, count(*) FILTER (relation_type = 'derived') AS derived, count(superseded_by) AS superseded, count(DISTINCT chunk_id) FILTER (relation_type = 'extracted') AS covered FROM facts) f,
    (SELECT count(*) FILTER (starts_with(model, 'skipped_')) AS skipped, count(*) FILTER (model = 'failed_persistent') AS failed FROM extraction_log) g""")
register("list_conversations", "chunks", lambda c: stats.list_conversations(c, 20), "SELECT conv_id, arg_min({'t': title}, (chunk_index, chunk_id)).t AS title, arg_min({'d': date}, (chunk_index, chunk_id)).d AS date, arg_min({'s': source}, (chunk_index, chunk_id)).s AS source, count(*) AS chunks, sum(char_count)::BIGINT AS chars FROM chunks GROUP BY conv_id ORDER BY date DESC NULLS LAST, conv_id LIMIT 20")
register("supersession_stats", "facts judged_pairs", stats.supersession_stats, "SELECT 'facts' AS name, count(*) AS n FROM facts UNION ALL SELECT 'superseded', count(superseded_by) FROM facts UNION ALL SELECT 'affected_chunks', count(DISTINCT chunk_id) FROM facts WHERE superseded_by IS NOT NULL UNION ALL SELECT 'verdict_' || verdict, count(*) FROM judged_pairs GROUP BY verdict")
register("reuse_rate", "facts judged_pairs", stats.reuse_rate, "SELECT count(*) AS judged, count(*) FILTER (a.created_at < judged_at AND b.created_at < judged_at) AS reusable, round(100 * count(*) FILTER (a.created_at < judged_at AND b.created_at < judged_at) / count(*), 1) AS percent FROM judged_pairs LEFT JOIN facts a ON a.id = fact_id_a LEFT JOIN facts b ON b.id = fact_id_b")
register("fact_stats", "facts", stats.fact_stats, "SELECT category, count(*) AS facts, count(DISTINCT chunk_id) AS chunks, round(count(*) / count(DISTINCT chunk_id), 6) AS per_chunk FROM facts GROUP BY category ORDER BY facts DESC, category LIMIT 15")
register("fact_totals", "facts extraction_log", stats.fact_totals, "SELECT (SELECT count(*) FROM facts) AS facts, (SELECT count(superseded_by) FROM facts) AS superseded, count(*) AS chunks, round(avg(facts_count) FILTER (facts_count > 0), 6) AS mean_facts FROM extraction_log")
register("chunks_by_model", "extraction_log", lambda g: stats.rows_by(g, "model"), "SELECT model, count(*) AS n FROM extraction_log GROUP BY model")
register("run_delta", "facts", lambda f: stats.run_delta(f, "2024-06-01"), "SELECT count(*) FILTER (created_at >= '2024-06-01' AND relation_type <> 'derived') AS extracted, count(*) FILTER (created_at >= '2024-06-01' AND relation_type = 'derived') AS derived, count(*) FILTER (superseded_at >= '2024-06-01') AS superseded, count(DISTINCT chunk_id) FILTER (created_at >= '2024-06-01') AS chunks FROM facts")
register("size_profile", "documents", lambda d: stats.size_profile(d, F.length("text"), "lang"), "SELECT lang, count(*) AS n, sum(length(text))::BIGINT AS total, round(avg(length(text)), 6) AS mean, min(length(text))::INT AS least, max(length(text))::INT AS most FROM documents GROUP BY lang")
register("id_quality_gate", "conversations", lambda c: mail.id_quality_gate(c.select(F.when(F.col("turn") % 5 > 0, F.concat_ws("-", "conv_id", F.col("turn") % 3)).alias("id"))), "WITH i AS (SELECT CASE WHEN turn % 5 > 0 THEN concat_ws('-', conv_id, turn % 3) ELSE '' END AS id FROM conversations), n AS (SELECT id, count(*) AS n FROM i GROUP BY id) SELECT coalesce(sum(n) FILTER (id = ''), 0)::BIGINT AS missing, count(*) FILTER (id <> '' AND n > 1) AS repeated, false AS passes FROM n")
register("rows_by_marker", "chunks", stats.rows_by_marker, "SELECT file_path, count(*) FILTER (NOT starts_with(chunk_id, 'doc_summary_')) AS chunks, count(*) FILTER (starts_with(chunk_id, 'doc_summary_')) AS summaries FROM chunks GROUP BY file_path")
register("orphans_by_folder", "registry files chunks", lambda r, f, c: stats.rows_by(lifecycle.orphan_chunks(r, f, c).select(T.folder_of(F.col("filepath"), "kb").alias("folder")), "folder"), "SELECT string_split(file_path, '/')[4] AS folder, count(*) AS n FROM chunks WHERE file_path IN (SELECT filepath FROM registry) AND file_path NOT IN (SELECT filepath FROM files) GROUP BY 1")
register("lexical_by_source", "chunks", lambda c: stats.rows_by(search.postings(c), "source", "field"), "SELECT source, field, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT source, '{c}' AS field, unnest(list_distinct({_tok(search.HELD.get(c, c))})) AS t FROM chunks" for c in T.LEXICAL_COLUMNS) + ") GROUP BY ALL")
register("orphan_tiers", "registry files chunks", lambda r, f, c: lifecycle.orphan_chunks(r, f, c.withColumns({"file_path": F.when(F.col("doc_id") % 50 == 3, "elsewhere").when(F.col("doc_id") % 50 == 13, "gone").otherwise(F.col("file_path")), "source": F.when(F.col("doc_id") % 2 == 0, "document").otherwise("email")})).select("filepath", "chunk_id", "tier"), """
  WITH g AS (SELECT filepath, filename, string_split(filepath, '/')[4] AS fo FROM registry WHERE filepath NOT IN (SELECT filepath FROM files)),
  c AS (SELECT chunk_id, title, folder, CASE WHEN doc_id % 50 = 3 THEN 'elsewhere' WHEN doc_id % 50 = 13 THEN 'gone' ELSE file_path END AS fp, doc_id % 2 = 0 AS document FROM chunks),
  a AS (SELECT filepath, chunk_id, 'path' AS tier FROM g JOIN c ON fp = filepath), b AS (SELECT filepath, chunk_id, 'title' AS tier FROM g JOIN c ON title = filename AND folder = fo AND starts_with(chunk_id, 'doc_summary_')),
  t AS (SELECT filepath, chunk_id, min(tier) AS tier FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL)
  SELECT * FROM t UNION ALL SELECT filepath, chunk_id, 'fallback' FROM g JOIN c ON title = filename AND document WHERE filepath NOT IN (SELECT filepath FROM t)""")

# conversations
register("last_messages", "conversations", lambda m: stats.last_messages(m, 3).select("conv_id", "turn", "place"), "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS place FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3)")
register("session_counts", "conversations", stats.session_counts, "SELECT conv_id, count(*) AS messages, count(*) FILTER (role = 'user') AS user_messages, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
register("list_sessions", "conversations", lambda m: stats.list_sessions(m, 10), "SELECT conv_id, count(*) AS messages, count(*) FILTER (role = 'user') AS user_messages, max(turn) AS last_turn FROM conversations GROUP BY conv_id ORDER BY last_turn DESC, conv_id LIMIT 10")
register("conversation_text", "chunks", stats.conversation_text, """
  WITH r AS (SELECT conv_id, text, row_number() OVER w AS nth, coalesce(sum(length(text)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM chunks WINDOW w AS (PARTITION BY conv_id ORDER BY chunk_index))
  SELECT conv_id, substr(string_agg(text, chr(10) || '---' || chr(10) ORDER BY nth), 1, 8000) AS text FROM r WHERE nth <= 8 AND before < 8000 GROUP BY conv_id""")
register("conversations_to_records", "conversations", exports.conversations_to_records, """
  WITH m AS (SELECT conv_id, turn, '[' || upper(role) || ']: ' || trim(text) AS t FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> ''),
  r AS (SELECT conv_id, string_agg(t, chr(10) || chr(10) ORDER BY turn) AS text, count(*) AS message_count FROM m GROUP BY conv_id)
  SELECT *, length(text)::BIGINT AS char_count FROM r WHERE length(text) >= 100""")
register("session_titles", "conversations", lambda m: m.filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("t")).select("conv_id", T.session_title(F.col("t")).alias("title")), r"""
  WITH f AS (SELECT conv_id, trim(regexp_replace(arg_min(text, turn), '\s+', ' ', 'g')) AS s FROM conversations WHERE role = 'user' GROUP BY conv_id),
  c AS (SELECT *, substr(s, 1, 60) AS c, 60 - instr(reverse(substr(s, 1, 60)), ' ') AS p FROM f)
  SELECT conv_id, CASE WHEN s = '' THEN 'New chat' WHEN length(s) <= 60 THEN s ELSE regexp_replace(CASE WHEN contains(c, ' ') AND p >= 20 THEN substr(c, 1, p) ELSE c END, '[ ,.;:]+$', '') END AS title FROM c""")
register("recent_summaries", "chunks", lambda c: stats.recent_summaries(c, "cat3", "2024-03-01", 25), "SELECT chunk_id, date, substr(text, 1, 2000) AS text FROM chunks WHERE category = 'cat3' AND date >= '2024-03-01' ORDER BY date DESC NULLS LAST, chunk_id LIMIT 25")
register("extraction_priority", "chunks", lambda c: stats.extraction_priority(c).select("chunk_id", "tier"), "SELECT chunk_id, CASE WHEN starts_with(chunk_id, 'conv_summary_') THEN 0 WHEN starts_with(chunk_id, 'doc_summary_') THEN 1 ELSE 2 END AS tier FROM chunks")
register("summary_rows", "conversations", lambda m: exports.summary_rows(m.groupBy("conv_id").agg(F.max("turn").alias("ts"), F.min_by("text", "turn").alias("summary")).withColumn("title", F.concat(F.lit("T"), "conv_id"))), "SELECT 'conv_summary_' || conv_id || '_' || max(turn) AS chunk_id, conv_id AS original_conv_id, 'T' || conv_id AS title, '[CONVERSATION SUMMARY] T' || conv_id || chr(10) || chr(10) || arg_min(text, turn) AS text, length('[CONVERSATION SUMMARY] T' || conv_id || chr(10) || chr(10) || arg_min(text, turn))::BIGINT AS char_count FROM conversations GROUP BY conv_id")
register("append_notes", "conversations", lambda m: exports.append_notes(m.select(F.concat(F.lit("N"), "conv_id").alias("title"), F.col("turn").alias("ts"), F.col("text").alias("summary"), F.when(F.col("turn") % 2 == 0, "f").alias("facts"), F.lit("").alias("decisions"), F.lit("go").alias("next_steps"), F.col("role").alias("category"))).select("title", "category", "text", "char_count"), """
  WITH n AS (SELECT 'N' || conv_id AS title, role AS category, concat_ws(chr(10) || chr(10), CASE WHEN text <> '' THEN '## Summary' || chr(10) || text END, CASE WHEN turn % 2 = 0 THEN '## Facts' || chr(10) || 'f' END, '## Next steps' || chr(10) || 'go') AS text FROM conversations) SELECT *, length(text)::BIGINT AS char_count FROM n""")

# mail
_ME = "contains(lower(\"from\"), 'me@home')"
register("keep_useful_emails", "emails", lambda e: mail.keep_useful_emails(e.withColumn("useful", F.col("id").cast("long") % 3 > 0), ("me@home",)).select("id"), f"SELECT id FROM emails WHERE id::BIGINT % 3 > 0 AND ({_ME} OR (\"to\" = 'me@home.org'))")
register("drop_blacklisted_senders", "emails", lambda e: mail.drop_blacklisted_senders(e).select("id"), "SELECT id FROM emails WHERE NOT (contains(\"from\", 'noreply@') OR contains(\"from\", 'mailchimp.com'))")
register("normalize_email_bodies", "emails", lambda e: mail.normalize_email_bodies(e, 50, 3000).select("id", "body", "is_sent"), "SELECT id, CASE WHEN length(body) > 3000 THEN substr(body, 1, 3000) || chr(10) || '[...]' ELSE body END AS body, list_contains(labels, 'SENT') AS is_sent FROM emails WHERE length(trim(body, ' ')) >= 50")
register("new_emails", "emails", lambda e: mail.new_emails(e.select((F.col("id").cast("long") % 400).cast("string").alias("id"), F.col("id").cast("long").alias("position")), e.filter("id % 3 = 0").select("id"), e.filter("id % 5 = 0").select(T.chunk_id(F.col("id"), F.lit(0), "email").alias("chunk_id")), e.filter("id % 7 = 0").select("id")), """
  WITH s AS (SELECT (id::BIGINT % 400)::VARCHAR AS id, id::BIGINT AS position FROM emails), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY position) AS nth, id::BIGINT IN (SELECT id::BIGINT FROM emails) AS known FROM s)
  SELECT id, position, CASE WHEN nth > 1 THEN 'repeated' WHEN known AND id::BIGINT % 3 = 0 THEN 'known_meta' WHEN known AND id::BIGINT % 5 = 0 THEN 'known_chunk' WHEN known AND id::BIGINT % 7 = 0 THEN 'checkpoint' ELSE 'new' END AS reason FROM n""")
_ANSWER = "CASE CAST(id AS BIGINT) % 4 WHEN 0 THEN '{\"choices\": [{\"message\": {\"content\": \"```json\\n{\\\"useful\\\": true}\\n```\"}}]}' WHEN 1 THEN '{\"choices\": [{\"message\": {\"content\": \"no idea\"}}]}' WHEN 2 THEN '{\"error\": 1}' END"
register("parsed_verdicts", "emails", lambda e: mail.parsed_verdicts(e.select("id", F.when(F.col("id").cast("long") % 4 == 0, '{"choices": [{"message": {"content": "```json\\n{\\"useful\\": true}\\n```"}}]}').when(F.col("id").cast("long") % 4 == 1, '{"choices": [{"message": {"content": "no idea"}}]}').when(F.col("id").cast("long") % 4 == 2, '{"error": 1}').alias("response"))), "SELECT id, CASE id::BIGINT % 4 WHEN 0 THEN true WHEN 1 THEN false END AS useful, CASE WHEN id::BIGINT % 4 > 1 THEN 'no content' END AS error FROM emails")


def _answers(e):
    return e.filter("id % 2 = 0").select("id", F.when(F.col("id").cast("long") % 3 > 0, F.col("id").cast("long") % 8 == 0).alias("useful"), F.when(F.col("id").cast("long") % 3 == 0, "bad").alias("error"))


register("merge_verdicts", "emails", lambda e: mail.merge_verdicts(e, _answers(e)).select("id", "useful", "triage_error"), "SELECT id, CASE WHEN id::BIGINT % 2 = 0 AND id::BIGINT % 3 > 0 THEN id::BIGINT % 8 = 0 END AS useful, CASE WHEN id::BIGINT % 6 = 0 THEN 'bad' END AS triage_error FROM emails")
register("triage_todo", "emails", lambda e: mail.triage_todo(e, _answers(e).withColumn("seq", F.lit(2)).unionByName(e.select("id", F.lit(True).alias("useful"), F.lit(None).cast("string").alias("error"), F.lit(1).alias("seq")).filter("id % 5 > 0"))).select("id"), "SELECT id FROM emails WHERE (id::BIGINT % 2 = 0 AND id::BIGINT % 3 = 0) OR (id::BIGINT % 2 = 1 AND id::BIGINT % 5 = 0)")
register("email_ids", "emails", lambda e: e.select("id", T.chunk_id(F.col("id"), F.lit(7), "email").alias("chunk_id"), T.short_name(F.col("from")).alias("name")), "SELECT id, 'email_' || id || '_chunk_0007' AS chunk_id, CASE WHEN contains(\"from\", '<') THEN trim(replace(string_split(\"from\", '<')[1], '\"', '')) ELSE \"from\" END AS name FROM emails")

# series
_ANCHOR = "(SELECT arg_max(b.value, b.ts) FROM metrics b WHERE b.key = a.key AND b.value IS NOT NULL AND b.ts <= a.ts - INTERVAL 1 HOUR)"
_SERIES = f"s AS (SELECT key, ts, event_id, value, {_ANCHOR} AS anchor, (SELECT min(b.value) FROM metrics b WHERE b.key = a.key AND b.ts <= a.ts AND b.ts >= a.ts - INTERVAL 1 HOUR) AS lowest FROM metrics a WHERE value IS NOT NULL)"
_known = lambda m: m.filter("value IS NOT NULL")
register("at_or_before", "metrics", lambda m: stats.at_or_before(_known(m), 3600).select("event_id", "anchor"), f"WITH {_SERIES} SELECT event_id, anchor FROM s")
register("sustained_breach", "metrics", lambda m: stats.sustained_breach(m, 20.0, 3600).select("event_id", "lowest", "breach"), f"WITH {_SERIES} SELECT event_id, lowest, coalesce(value >= 20 AND anchor >= 20 AND lowest >= 20, false) AS breach FROM s")
register("non_decreasing_backlog", "metrics", lambda m: stats.non_decreasing_backlog(_known(m), 30.0, 3600).select("event_id", "aging"), f"WITH {_SERIES} SELECT event_id, coalesce(value >= 30 AND value >= anchor, false) AS aging FROM s")
register("breach_alerts", "metrics", lambda m: jobs.breach_alerts(m, 5.0, 600, 7200).select("key", F.unix_micros("ts").alias("us"), "value"), """
  WITH RECURSIVE s AS (SELECT key, ts, value, (SELECT arg_max(b.value, b.ts) FROM metrics b WHERE b.key = a.key AND b.value IS NOT NULL AND b.ts <= a.ts - INTERVAL 10 MINUTE) AS anchor, (SELECT min(b.value) FROM metrics b WHERE b.key = a.key AND b.ts <= a.ts AND b.ts >= a.ts - INTERVAL 10 MINUTE) AS lowest FROM metrics a WHERE value >= 5),
  h AS (SELECT key, ts, value FROM s WHERE anchor >= 5 AND lowest >= 5),
  p AS (SELECT key, min(ts) AS ts FROM h GROUP BY key UNION ALL SELECT p.key, (SELECT min(h.ts) FROM h WHERE h.key = p.key AND h.ts >= p.ts + INTERVAL 2 HOUR) FROM p WHERE p.ts IS NOT NULL)
  SELECT key, epoch_us(ts) AS us, value FROM h JOIN p USING (key, ts)""")
register("sessionize", "events", lambda e: stats.sessionize(e, 36_000).select("event_id", "session"), "SELECT event_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 10 HOUR THEN 0 ELSE 1 END AS fresh FROM events)")
register("ban_triggers", "events", lambda e: stats.ban_triggers(e, "error", 2, 86_400).select("event_id", "failures"), "SELECT event_id, failures FROM (SELECT a.event_id, (SELECT count(*) FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'error' AND b.ts <= a.ts AND b.ts > a.ts - INTERVAL 1 DAY) AS failures FROM events a WHERE event_type = 'error') WHERE failures >= 2")

# texts
register("pages_to_text", "pages", exports.pages_to_text, r"""
  WITH s AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<(script|style)[^>]*>.*?</(script|style)>', '', 'gis'), '<[^>]+>', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS t FROM pages),
  r AS (SELECT page_id, regexp_replace(t, '^[ \n\t\r]+|[ \n\t\r]+$', '', 'g') AS text FROM s) SELECT * FROM r WHERE length(text) >= 100""")
register("mail_text", "pages", lambda p: p.select("page_id", T.mail_text(F.col("html")).alias("text")), r"SELECT page_id, trim(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages")
register("embedding_text", "documents", lambda d: d.select("doc_id", F.md5(T.embedding_text(F.col("text")).cast("binary")).alias("digest")), "SELECT doc_id, md5(substr(coalesce(text, ''), 1, 4000)) AS digest FROM documents")
register("live_id", "conversations", lambda m: m.select("conv_id", "turn", T.live_id(F.when(F.col("turn") % 2 == 0, F.concat(F.lit("c"), "conv_id")).otherwise(""), F.lit("t"), F.col("turn"), F.col("text")).alias("id")), "SELECT conv_id, turn, substr(sha256(CASE WHEN turn % 2 = 0 THEN 'c' || conv_id ELSE 't|' || turn || '|' || length(text) || '|' || substr(text, 1, 500) END), 1, 16) AS id FROM conversations")
register("redact_tokens", "pages", lambda p: p.select("page_id", T.redact_tokens(F.concat(F.lit("GET /a?Token=s3cr3t"), "page_id", F.lit("&u=1 "), "url")).alias("line")), "SELECT page_id, regexp_replace('GET /a?Token=s3cr3t' || page_id || '&u=1 ' || url, '(token=)[^&\\s\"'']+', '\\1REDACTED', 'gi') AS line FROM pages")
register("infer_doc_type", "documents", lambda d: d.select("doc_id", T.doc_type(F.concat(F.when(F.col("doc_id") % 4 == 0, "Fattura_").when(F.col("doc_id") % 4 == 1, "nota integr ").otherwise("x"), "doc_id", F.when(F.col("doc_id") % 3 == 0, ".XLSX").otherwise(".md")), F.when(F.col("doc_id") % 5 == 2, F.concat(F.lit("Referto del "), "text"))).alias("kind")), "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'fattura' WHEN doc_id % 4 = 1 THEN 'nota_integrativa' WHEN doc_id % 5 = 2 THEN 'referto_medico' WHEN doc_id % 3 = 0 THEN 'spreadsheet' ELSE 'documento' END AS kind FROM documents")
_QUALITY = "CASE WHEN length(text) >= 50 AND {1} > 0 THEN round({0} / {1}, 6) ELSE 0.0 END"
register("text_quality", "documents", lambda d: d.select("doc_id", T.quality_stats(F.col("text"), F.array(*map(F.lit, ("that", "the", "with", "and")))).alias("q")).select("doc_id", F.round("q.alnum", 6).alias("alnum"), F.round("q.mean_word", 6).alias("mean_word"), F.round("q.known", 6).alias("known"), "q.garbage"), rf"""
  WITH p AS (SELECT doc_id, text, regexp_replace(text, '\s', '', 'g') AS solid, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS w, list_filter(regexp_extract_all(lower(text), '\p{{L}}+'), lambda w: length(w) >= 3) AS l FROM documents),
  q AS (SELECT doc_id, text, {_QUALITY.format("length(regexp_replace(solid, '[^\\p{{L}}\\p{{N}}]', '', 'g'))".replace("{{", "{").replace("}}", "}"), "length(solid)")} AS alnum, {_QUALITY.format("length(solid)", "len(w)")} AS mean_word, {_QUALITY.format("len(list_filter(l, lambda x: x IN ('that', 'the', 'with', 'and')))", "len(l)")} AS known FROM p)
  SELECT doc_id, alnum, mean_word, known, length(text) < 50 OR (length(text) >= 200 AND mean_word < 2.5 AND known < 0.5) AS garbage FROM q""")
register("parsed_dates", "events", lambda e: e.select("event_id", F.unix_micros(T.parsed_date(F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "EEE, d MMM yyyy HH:mm:ss '+0000'")).otherwise("soon"))).alias("us")), "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN epoch_us(date_trunc('second', ts)) END AS us FROM events")
register("lexical_queries", "queries", lambda q: q.select("query_id", T.lexical_query(F.when(F.col("query_id") % 3 == 0, F.concat(F.lit("Email_From:u"), "query_id", F.lit("@corp.com"))).when(F.col("query_id") % 3 == 1, "come quando perché").otherwise(F.col("query"))).alias("m")).select("query_id", "m.mode", "m.column", F.array_join("m.terms", " ").alias("terms")), f"""
  WITH t AS (SELECT query_id, list_filter({_tok("query")}, lambda x: NOT list_contains([{", ".join(f"'{w}'" for w in T.STOPWORDS)}], x)) AS t FROM queries)
  SELECT query_id, CASE query_id % 3 WHEN 0 THEN 'and' WHEN 1 THEN 'skip' ELSE 'or' END AS mode, CASE WHEN query_id % 3 = 0 THEN 'email_from' END AS column, CASE query_id % 3 WHEN 0 THEN 'u' || query_id || ' corp com' WHEN 1 THEN '' ELSE array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i), ' ') END AS terms FROM t""")
_GREEDY = "regexp_replace(coalesce(text, ''), '\\s', '', 'g')"
for _name, _most in (("greedy", 1200), ("paragraphs", 1800), ("markdown", 1800), ("headings", 2000)):
    register(f"chunk_{_name}", "documents", lambda d, n=_name, m=_most: d.select("doc_id").join(chunking.cut(d, n).groupBy("doc_id").agg(F.sum(F.length(F.regexp_replace("text", "\\s", ""))).alias("solid"), (F.max(F.length("text")) <= m).alias("fits")), "doc_id", "left").select("doc_id", F.coalesce("solid", F.lit(0)).alias("solid"), F.coalesce("fits", F.lit(True)).alias("fits")), f"SELECT doc_id, length({_GREEDY})::BIGINT AS solid, true AS fits FROM documents")
register("overlap_chunks", "chunks", lambda c: chunking.overlap(c.select(F.col("conv_id").alias("doc_id"), F.col("chunk_index").alias("part"), "text"), 40).select("doc_id", "part", F.md5(F.col("text").cast("binary")).alias("digest")), """
  WITH p AS (SELECT conv_id, chunk_index, text, trim(right(lag(text) OVER (PARTITION BY conv_id ORDER BY chunk_index), 40), ' ') AS t FROM chunks),
  c AS (SELECT *, CASE WHEN contains(t, ' ') THEN substr(t, instr(t, ' ') + 1) ELSE t END AS h FROM p)
  SELECT conv_id AS doc_id, chunk_index AS part, md5(CASE WHEN h <> '' THEN h || chr(10) || text ELSE text END) AS digest FROM c""")
register("rows_to_text", "orders", lambda o: chunking.rows_to_text(o.withColumn("year", F.year("o_orderdate")), "year", "o_orderkey", ["o_orderkey", "o_custkey", "o_orderstatus"]).groupBy("year").agg((F.max(F.length("text")) <= 1200).alias("fits"), F.sum(F.size(F.split("text", "\n")) - 1).alias("rows")), "SELECT year(o_orderdate)::INT AS year, true AS fits, count(*) AS rows FROM orders GROUP BY ALL")

# search options
register("kb_search", "queries chunks", lambda q, c: search.kb_search(q, c, 5).select("query_id", "chunk_id", "score", "rank"), f"WITH v AS ({_vector(15)}), l AS (SELECT v.*, row_number() OVER (PARTITION BY query_id ORDER BY v.rank) AS place FROM v JOIN chunks USING (chunk_id) WHERE superseded_by = '') SELECT query_id, chunk_id, score, place AS rank FROM l WHERE place <= 5")
_LENGTH = lambda q, t: -F.abs(F.length(q) - F.length(t))
register("kb_search_scored", "queries chunks", lambda q, c: search.kb_search(q, c, 5, scorer=_LENGTH).select("query_id", "chunk_id", "rank"), f"WITH v AS ({_vector(15)}), l AS (SELECT v.query_id, v.chunk_id, text, row_number() OVER (PARTITION BY v.query_id ORDER BY v.rank) AS place FROM v JOIN chunks USING (chunk_id) WHERE superseded_by = ''), k AS (SELECT l.*, abs(length(query) - least(length(text), 1000)) AS d FROM l JOIN queries USING (query_id) WHERE place <= 5) SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY d, place) AS rank FROM k")
register("hybrid_search_source", "queries chunks entity_index", lambda q, c, e: search.hybrid_search(q, c, e, 5, source="nowhere"), "SELECT 0::BIGINT AS query_id, '' AS chunk_id, '' AS stream, 0.0::DOUBLE AS score, 0::INT AS rank FROM queries WHERE false")
register("hybrid_search_superseded", "queries chunks entity_index", lambda q, c, e: search.hybrid_search(q, c, e, 4, superseded=True), _hybrid(4, "SELECT query_id, chunk_id, stream, score, position AS rank FROM pool WHERE position <= 4").replace("WHERE superseded_by = '' QUALIFY place", "QUALIFY place"))
register("bm25_source", "queries chunks", lambda q, c: search.bm25(q, search.term_index(c), search.doc_lengths(c), 5, source="src1").select("query_id", "chunk_id", "rank"), f"WITH {_bm25(5)} SELECT query_id, chunk_id, rank FROM lex".replace("WHERE term IN (SELECT term FROM asked)", "WHERE term IN (SELECT term FROM asked) AND chunk_id IN (SELECT chunk_id FROM chunks WHERE source = 'src1')"))
register("bm25_email", "chunks", lambda c: search.bm25(c.filter("doc_id < 20").select(F.col("doc_id").alias("query_id"), F.concat(F.lit("email_from:u"), F.col("doc_id") % 20, F.lit("@corp.com")).alias("query")), search.term_index(c), search.doc_lengths(c), 1000).select("query_id", "chunk_id"), "SELECT q.doc_id AS query_id, c.chunk_id FROM chunks q JOIN chunks c ON c.email_from = 'u' || q.doc_id || '@corp.com' WHERE q.doc_id < 20 AND NOT starts_with(c.chunk_id, 'conv_summary_') AND NOT starts_with(c.chunk_id, 'doc_summary_') AND NOT starts_with(c.chunk_id, 'live_')")
register("result_columns", "queries chunks facts", lambda q, c, f: search.result_columns(search.kb_search(q, c, 3), c, facts.facts_for_chunks(c, f, DAY).filter("size(facts) > 0")).select("query_id", "chunk_id", "rank", "title", "date", "source", "relevance", "url", "snippet", F.size("facts").alias("shown"), "n_facts"), f"""
  WITH v AS ({_vector(9)}), l AS (SELECT v.*, row_number() OVER (PARTITION BY query_id ORDER BY v.rank) AS place FROM v JOIN chunks USING (chunk_id) WHERE superseded_by = ''), n AS (SELECT chunk_id, count(*) AS n FROM facts WHERE {_ACTIVE} GROUP BY chunk_id)
  SELECT query_id, chunk_id, place::INT AS rank, title || ' (' || folder || ', ' || doc_type || ', ' || category || ')' AS title, coalesce(date, '') AS date, source, round(score, 3) AS relevance, 'kb://chunk/' || chunk_id AS url, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS snippet,
    least(coalesce(n, 0), 10)::INT AS shown, coalesce(n, 0)::BIGINT AS n_facts FROM l JOIN chunks USING (chunk_id) LEFT JOIN n USING (chunk_id) WHERE place <= 3""")
register("cosine", "chunks", lambda c: c.select("chunk_id", F.round(T.cosine(F.col("embedding"), F.when(F.col("doc_id") % 5 == 0, F.slice(F.col("embedding").cast("array<double>"), 1, 3)).when(F.col("doc_id") % 5 == 1, F.transform("embedding", lambda x, i: x.cast("double") + i)).when(F.col("doc_id") % 5 == 2, F.array().cast("array<double>")).otherwise(F.reverse(F.col("embedding").cast("array<double>")))), 6).alias("score")), f"SELECT chunk_id, CASE WHEN doc_id % 5 IN (0, 2) OR embedding IS NULL THEN 0.0 WHEN doc_id % 5 = 1 THEN {_COS.format('embedding', 'list_transform(embedding, lambda x, i: x::DOUBLE + i - 1)')} ELSE {_COS.format('embedding', 'list_reverse(embedding)')} END AS score FROM chunks")
register("find_documents", "queries chunks", lambda q, c: search.find_documents(q.select("query_id", F.concat(F.lit("file"), (F.col("query_id") % 20).cast("string"), F.when(F.col("query_id") % 2 == 0, ".md").otherwise("")).alias("query")), c.withColumn("source", F.lit("document")), 5))
register("entity_counts", "queries chunks entity_index", lambda q, c, e: search.entity_counts(q, e, search.vector_topk(q, c, 15), 50).withColumn("saturated", F.array_join("saturated", ",")), f"""
  WITH sem AS ({_vector(15)}), {_ENTITY.replace("nth <= 700", "nth <= 50")},
  met_by AS (SELECT query_id, candidate, chunk_id FROM capped JOIN asked_e USING (candidate)),
  fresh AS (SELECT * FROM met_by WHERE (query_id, chunk_id) NOT IN (SELECT (query_id, chunk_id) FROM sem)),
  full_c AS (SELECT query_id, string_agg(candidate, ',' ORDER BY candidate) AS saturated FROM (SELECT query_id, candidate FROM met_by GROUP BY ALL HAVING count(*) >= 50) GROUP BY query_id)
  SELECT query_id, count(*) AS appended, count(DISTINCT chunk_id) AS "unique", count(*) - count(DISTINCT chunk_id) AS duplicates, greatest(count(DISTINCT chunk_id) - 50, 0) AS lost, coalesce(any_value(saturated), '') AS saturated
  FROM fresh LEFT JOIN full_c USING (query_id) GROUP BY query_id""")


def _sketched(c):
    parts = [stats.sketched(c.filter(F.col("doc_id") % 3 == k), ("date", "source"), {"conversations": "conv_id", "documents": "chunk_id"}) for k in range(3)]
    rows = stats.distinct_counts(stats.merged_sketches(*parts), "source")
    exact = c.groupBy("source").agg(F.countDistinct("conv_id").alias("x"), F.countDistinct("chunk_id").alias("y"))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= F.greatest(F.lit(2), stats.SKETCH_ERROR * F.col(b))
    return rows.join(exact, "source").select("source", "n", (near("conversations", "x") & near("documents", "y")).alias("near"))


register("sketch_rollup", "chunks", _sketched, "SELECT source, count(*) AS n, true AS near FROM chunks GROUP BY source")
