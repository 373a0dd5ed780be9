"""Tables of a store, derived from the given ones by SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

GIVEN = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

_ID = "lpad(CAST(doc_id AS STRING), 9, '0')"
_CHUNK = f"CASE WHEN doc_id % 29 = 0 THEN concat('conv_summary_', doc_id) WHEN doc_id % 31 = 0 THEN concat('doc_summary_', doc_id) ELSE concat('doc_', {_ID}, '_chunk_0000') END"
_DATE = "concat('2024-', lpad(CAST(doc_id % 12 + 1 AS STRING), 2, '0'), '-', lpad(CAST(doc_id % 28 + 1 AS STRING), 2, '0'))"

#: name -> SQL of both engines, or of Spark and DuckDB. LIST[...] is an array, AT an element, NAMES capitalised words, ZEROS a zero vector.
DERIVED: dict[str, str | tuple[str, str]] = {
    "chunks": f"""
        SELECT {_CHUNK} AS chunk_id, doc_id, concat('c', doc_id % 97) AS conv_id, CAST(floor(doc_id / 97) AS INT) AS chunk_index, concat('file', doc_id % 50, '.md') AS title,
          CASE WHEN doc_id % 41 = 0 THEN NULL ELSE {_DATE} END AS date, source, lang AS folder, CASE doc_id % 3 WHEN 0 THEN 'report' WHEN 1 THEN 'note' ELSE 'letter' END AS doc_type,
          concat('/data/kb/', lang, '/file', doc_id % 50, '.md') AS file_path, text, n_chars AS char_count, CAST(doc_id AS DOUBLE) AS create_time,
          CASE WHEN doc_id % 11 = 0 THEN concat('doc_', lpad(CAST(doc_id + 1 AS STRING), 9, '0'), '_chunk_0000') ELSE '' END AS superseded_by, CASE WHEN doc_id % 53 = 0 THEN ZEROS(embedding) ELSE embedding END AS embedding,
          CASE WHEN doc_id % 6 = 0 THEN concat('u', doc_id % 20, '@corp.com') ELSE '' END AS email_from,
          CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 1 END AS entities_extracted, concat('cat', doc_id % 6) AS category, CASE WHEN doc_id % 10 > 0 THEN concat('m', doc_id % 7) END AS model
        FROM documents LEFT JOIN embeddings ON vec_id = doc_id""",
    "sentences": ("SELECT doc_id, lang, pos, sentence FROM documents LATERAL VIEW posexplode(split(text, '[.] ')) AS pos, sentence", "SELECT doc_id, lang, unnest(range(len(l))) AS pos, unnest(l) AS sentence FROM (SELECT doc_id, lang, string_split(text, '. ') AS l FROM documents)"),
    "facts": f"""
        SELECT id, {_CHUNK} AS chunk_id, fact, category, LIST[coalesce(AT(caps, 0) || CASE WHEN doc_id % 5 = 0 THEN ' Ltd' ELSE '' END, concat('Firma', doc_id % 37, ' Ltd')), coalesce(AT(caps, 1), concat('Person', doc_id % 23))] AS entity_tags,
          {_DATE} AS event_date, CAST(id * 7 % 100 AS DOUBLE) / 100 AS confidence, CASE WHEN id % 13 = 0 THEN id + 10000 END AS superseded_by, CASE WHEN id % 13 = 0 THEN '2024-06-01' END AS superseded_at,
          concat('2024-0', id % 9 + 1, '-10T00:00:00') AS created_at, CASE WHEN id % 7 = 0 THEN '2024-05-01' ELSE '' END AS expires_at,
          CASE WHEN id % 11 < 2 THEN 'derived' ELSE 'extracted' END AS relation_type, CASE WHEN id % 11 < 2 THEN LIST[id - 10000, id - 20000] END AS derived_from
        FROM (SELECT doc_id * 10000 + pos AS id, doc_id, sentence AS fact, lang AS category, NAMES(sentence) AS caps FROM sentences) AS s""",
    "extraction_log": f"SELECT {_CHUNK} AS chunk_id, CASE WHEN doc_id % 6 < 3 THEN -(doc_id % 6 + 1) ELSE 4 END AS facts_count, CASE doc_id % 6 WHEN 0 THEN 'failed_1' WHEN 1 THEN 'failed_2' WHEN 2 THEN 'failed_persistent' WHEN 3 THEN 'skipped_short' ELSE 'model' END AS model FROM documents",
    "judged_pairs": "SELECT id AS fact_id_a, id + 4 AS fact_id_b, CASE id % 3 WHEN 0 THEN 'SUPERSEDES' WHEN 1 THEN 'INDEPENDENT' ELSE 'CONTRADICTS' END AS verdict, concat('2024-0', id % 9 + 1, '-20T00:00:00') AS judged_at FROM (SELECT doc_id * 10000 + pos AS id FROM sentences) AS d",
    "names": ("SELECT doc_id, name FROM documents LATERAL VIEW explode(NAMES(text)) AS name", "SELECT doc_id, unnest(NAMES(text)) AS name FROM documents"),
    "entity_index": f"SELECT DISTINCT concat(name, CASE WHEN doc_id % 7 = 0 THEN ' Ltd' ELSE '' END) AS entity, CASE length(name) % 3 WHEN 0 THEN 'person' WHEN 1 THEN 'company' ELSE 'location' END AS entity_type, {_CHUNK} AS chunk_id FROM names",
    "queries": "SELECT item_id AS query_id, concat(text, ' Eriner', chr(CAST(97 + item_id % 26 AS INT)), ' x') AS query, embedding FROM benchmark LEFT JOIN embeddings ON vec_id = item_id",
    "emails": """
        SELECT CAST(doc_id AS STRING) AS id, CASE WHEN doc_id % 9 = 0 THEN '"Me Myself" <me@home.org>' WHEN doc_id % 9 = 1 THEN 'No Reply <noreply@shop.com>' WHEN doc_id % 9 = 2 THEN 'x@news.mailchimp.com' ELSE concat('u', doc_id % 20, '@corp.com') END AS "from",
          CASE WHEN doc_id % 4 = 0 THEN 'me@home.org' ELSE 'me@home.org, b@corp.com' END AS "to", text AS body, CASE WHEN doc_id % 9 = 0 THEN LIST['SENT'] ELSE LIST['INBOX'] END AS labels, CAST(NULL AS BOOLEAN) AS useful, CAST(NULL AS STRING) AS triage_error FROM documents""",
    "registry": "SELECT concat('/data/kb/', lang, '/', filename) AS filepath, filename, hash, fail_count, chunks FROM (SELECT DISTINCT lang, concat('file', doc_id % 50, '.md') AS filename, concat('h', doc_id % 50, lang) AS hash, CASE WHEN doc_id % 50 = 7 THEN 3 ELSE 0 END AS fail_count, CASE WHEN doc_id % 50 = 9 THEN 0 ELSE 2 END AS chunks FROM documents) AS r",
    "files": """
        SELECT concat('/data/kb/', CASE WHEN n % 5 = 1 THEN 'moved' ELSE lang END, '/', 'file', n, '.md') AS filepath, CASE WHEN n % 5 = 2 THEN concat('new', n, lang) WHEN n = 11 THEN concat('h', 10, lang) ELSE concat('h', n, lang) END AS hash
        FROM (SELECT DISTINCT lang, doc_id % 50 AS n FROM documents) AS f WHERE n % 5 <> 3 AND NOT (n % 5 = 1 AND lang = 'fr')""",
    "metrics": "SELECT event_type AS key, CAST(ts AS TIMESTAMP) AS ts, CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS value, event_id FROM events",
    "eav": """
        SELECT p_partkey AS id, 'name' AS key, p_name AS string_value FROM part UNION ALL SELECT p_partkey AS id, 'brand' AS key, p_brand AS string_value FROM part WHERE p_partkey % 3 > 0
        UNION ALL SELECT p_partkey AS id, 'type' AS key, p_type AS string_value FROM part WHERE p_partkey % 2 = 0""",
    "gold": "SELECT query_id, gold, gold[{0}] AS primary_gold, n, gold_type, category, query FROM (SELECT item_id AS query_id, LIST[concat('doc_', lpad(CAST(item_id + 1 AS STRING), 9, '0'), '_chunk_0000'), concat('doc_', lpad(CAST(item_id * 3 + 2 AS STRING), 9, '0'), '_chunk_0000')] AS gold, CASE WHEN item_id % 5 = 0 THEN 7 ELSE 10 END AS n, CASE WHEN item_id % 4 = 0 THEN 'single' ELSE 'multi' END AS gold_type, CASE WHEN item_id % 6 = 0 THEN 'odd' ELSE 'fact' END AS category, CASE WHEN item_id % 7 = 0 THEN ' ' ELSE text END AS query FROM benchmark) AS b",
}


def _form(name: str, engine: int) -> str:
    """The SQL of a derived table for Spark (0) or DuckDB (1)."""
    text = DERIVED[name] if isinstance(DERIVED[name], str) else DERIVED[name][engine]
    for pattern, spark, duck in (
        (r"LIST\[([^\]]*)\]", r"array(\1)", r"[\1]"),
        (r"AT\((\w+), (\d+)\)", r"get(\1, \2)", r"\1[\2 + 1]"),
        (r"NAMES\((\w+)\)", r"regexp_extract_all(\1, '[A-Z][a-z]{3,}', 0)", r"regexp_extract_all(\1, '[A-Z][a-z]{3,}')"),
        (r"ZEROS\((\w+)\)", r"transform(\1, x -> CAST(0 AS FLOAT))", r"list_transform(\1, lambda x: 0::FLOAT)"),
        (r"\{0\}", "0", "1"),
        (r'"(from|to)"', r"`\1`", r'"\1"'),
    ):
        text = re.sub(pattern, (spark, duck)[engine], text)
    return text


def _keyed(vectors: DataFrame) -> DataFrame:
    """vectors; if none repeats a vec_id, as a table of distinct keys, so that Spark leaves out left joins whose vectors nobody reads, with the texts that they would shuffle."""
    repeated = vectors.filter("vec_id IS NOT NULL").groupBy("vec_id").count().filter("count > 1")
    return vectors.dropDuplicates(["vec_id"]) if repeated.isEmpty() else vectors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given or derived table, over all rows of what it is derived from."""
    if name in GIVEN:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text, used = _form(name, 0), {}
    for t in (*GIVEN, *DERIVED):
        if re.search(rf"\b(FROM|JOIN) {t}\b", text):
            text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 <{t}>", text)
            used[t] = _keyed(table(spark, sf_dir, t)) if t == "embeddings" else table(spark, sf_dir, t)
    text = re.sub(r"<(\w+)>", r"{\1}", text.replace("{", "{{").replace("}", "}}"))
    return spark.sql(text, **used)


def oracle(text: str) -> str:
    """text for DuckDB, with the derived tables that it needs in front."""
    needed: list[str] = []

    def need(sql: str, before: str) -> None:
        for n in DERIVED:
            if re.search(rf"\b{before}{n}\b", sql) and n not in needed:
                need(_form(n, 1), "(?:FROM|JOIN) ")
                needed.append(n)

    need(text, "")
    body = text.strip()
    if not needed:
        return body
    ctes = ", ".join(f"{n} AS ({_form(n, 1)})" for n in needed)
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    return f"WITH {ctes}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {ctes} {body}"
