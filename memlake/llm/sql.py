"""DuckDB statements that give the rows of registered queries."""

from memlake.llm import license_scan, mixing as m, quality_rules as q, secret_scan

EXACT_DEDUP = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)
"""


def quality_rules() -> str:
    xs = ", ".join(q.X)
    ctes = [
        ("t", "SELECT doc_id, lang AS k0, source AS k1, coalesce(text, '') AS t FROM documents"),
        ("w", r"""SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
            list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t"""),
        ("five", "SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w)"),
        ("twice", "SELECT doc_id, i FROM five QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1"),
        ("covered", "SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest(range(5)) AS k FROM twice) GROUP BY doc_id"),
        ("c", r"""SELECT doc_id, k0, k1, len(words)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
            length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
            coalesce(n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_upper
            FROM w LEFT JOIN covered USING (doc_id)"""),
        ("b", "SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c"),
        ("x", "SELECT *, " + ", ".join(f"CAST(floor({q.UNITS} * ({s})) AS BIGINT) AS x{i}" for i, s in enumerate(q.STATS)) + " FROM b"),
        ("rows", f"SELECT concat('=', k0, '|=', k1) AS g, {xs} FROM x WHERE NOT base_failed"),
        ("middle", _middle("rows")),
        ("wide", f"SELECT 'all' AS g, {xs} FROM rows UNION ALL SELECT 'within', " + ", ".join(f"(x{i} - m{i})::BIGINT" for i in range(q.P)) + " FROM rows JOIN middle USING (g)"),
        ("wide_middle", _middle("wide")),
        ("wide_starts", _start("wide", "wide_middle")),
        *_concentrated("wide", q.OWN_MEAN, q.OWN_COVARIANCE, ""),
        ("lent", "SELECT " + ", ".join([f"a.m{i} AS t{i}" for i in range(q.P)] + [f"a.c{i}_{j} AS t{i}_{j}, w.c{i}_{j} AS w{i}_{j}" for i, j in q.PAIRS]) + f" FROM (SELECT * FROM wide_e{SQL_STEPS} WHERE g = 'all') a, (SELECT * FROM wide_e{SQL_STEPS} WHERE g = 'within') w"),
        ("rows_starts", _start("rows", "middle") + " UNION ALL SELECT g, " + ", ".join([f"m{i}" for i in range(q.P)] + [f"w{i}_{j}" for i, j in q.PAIRS]) + ", 1 FROM middle, lent"),
        *_concentrated("rows", q.MEAN, q.COVARIANCE, ", lent"),
        ("last", _nested([(f"l{i}_{j}", q.factor_sql(i, j, q.CONSISTENCY)) for i, j in q.PAIRS], f"SELECT g, {', '.join(q.MOMENTS)} FROM rows_e{SQL_STEPS}")),
    ]
    last = _distance("SELECT * FROM (SELECT *, concat('=', k0, '|=', k1) AS g FROM x) LEFT JOIN last USING (g)")
    return "WITH " + ",\n".join(f"{k} AS MATERIALIZED ({v})" for k, v in ctes) + f"\nSELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(d <= {q.CUTOFF}, false) AS kept FROM ({last})"


def _distance(source: str) -> str:
    return f"SELECT *, {q.distance_sql()} AS d FROM (" + _nested([(f"z{i}", q.forward_sql(i)) for i in range(q.P)], source) + ")"


#: Steps that the statement writes out; the operator's own go on until no determinant falls, which a test holds to be before.
SQL_STEPS = 16


def _middle(rows: str) -> str:
    return "SELECT g, " + ", ".join(f"floor(quantile_cont(x{i}::DOUBLE, 0.5)) AS m{i}" for i in range(q.P)) + f" FROM {rows} GROUP BY g"


def _start(rows: str, middle: str) -> str:
    spread = "SELECT g, " + ", ".join(f"quantile_cont(abs(x{i} - m{i}), 0.5) AS s{i}" for i in range(q.P)) + f" FROM {rows} JOIN {middle} USING (g) GROUP BY g"
    return "SELECT g, " + ", ".join([f"m{i}" for i in range(q.P)] + [(f"1.4826::DOUBLE * s{i} * (1.4826::DOUBLE * s{i})" if i == j else "0.0::DOUBLE") + f" AS c{i}_{j}" for i, j in q.PAIRS]) + f", 0 AS start FROM {middle} JOIN ({spread}) USING (g)"


def _concentrated(rows: str, mean: str, covariance: str, lent: str) -> list[tuple[str, str]]:
    """Statements from a table of rows and its starts to the estimates after all steps; a group that has stopped stays as it is."""
    xs, ms, ls, p = ", ".join(q.X), ", ".join(q.MOMENTS), ", ".join(q.FACTORS), f"{rows}_"
    factors = [(f"l{i}_{j}", q.factor_sql(i, j)) for i, j in q.PAIRS]
    ctes = [(f"{p}e0", f"SELECT g, start, {ms}, {ls}, 1e300::DOUBLE AS det FROM (" + _nested(factors, f"SELECT * FROM {p}starts") + ")")]
    for k in range(SQL_STEPS):
        chosen = " QUALIFY row_number() OVER (PARTITION BY o.g ORDER BY least(t.det, o.det), o.start) = 1" if k == 0 else ""
        ctes += [
            (f"{p}d{k}", f"SELECT g, start, {xs}, {q.RANK} AS r FROM (" + _distance(f"SELECT * FROM {rows} JOIN {p}e{k} USING (g)") + ")"),
            (f"{p}h{k}", f"SELECT g, start, quantile_cont(r::DOUBLE, {q.CORE}) AS most FROM {p}d{k} GROUP BY g, start"),
            (f"{p}v{k}", "SELECT g, start, count(*) AS n, " + ", ".join([f"{q.sum_sql(i)} AS a{i}" for i in range(q.P)] + [f"{q.sum_sql(i, j)} AS a{i}_{j}" for i, j in q.PAIRS]) + f" FROM {p}d{k} JOIN {p}h{k} USING (g, start) WHERE r <= most GROUP BY g, start"),
            (f"{p}t{k}", f"SELECT *, {q.DETERMINANT} AS det FROM (" + _nested(factors, "SELECT g, start, " + ", ".join([mean.format(i) + f" AS m{i}" for i in range(q.P)] + [covariance.format(i, j) + f" AS c{i}_{j}" for i, j in q.PAIRS]) + f" FROM (SELECT *, {q.SHARES} FROM {p}v{k}){lent}") + ")"),
            (f"{p}e{k + 1}", ("SELECT o.g, 0 AS start, " if k == 0 else "SELECT o.g, o.start, ") + ", ".join(f"CASE WHEN t.det < o.det THEN t.{c} ELSE o.{c} END AS {c}" for c in (*q.MOMENTS, *q.FACTORS, "det")) + f" FROM {p}e{k} o JOIN {p}t{k} t USING (g, start){chosen}"),
        ]
    return ctes


def _nested(columns: list[tuple[str, str]], source: str) -> str:
    for name, expression in columns:
        source = f"SELECT *, {expression} AS {name} FROM ({source})"
    return source


def mixing() -> str:
    """One run through all slots by recursion, in whole numbers; ids are ranked by one window here."""
    return f"""
WITH RECURSIVE docs AS (SELECT doc_id, source, coalesce('=' || source, '') AS src, md5(coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
sizes AS (SELECT src, floor(sqrt(count(*)::DOUBLE))::BIGINT AS w, (count(*) + {m.BLOCK - 1}) // {m.BLOCK} AS n FROM docs GROUP BY src),
s AS (SELECT list(w ORDER BY src) AS w, list(n ORDER BY src) AS n, list(src ORDER BY src) AS src, sum(w)::BIGINT AS q FROM sizes),
edf(slot, used, pick) AS (
  SELECT -1::BIGINT, list_transform(w, lambda x: 0::BIGINT), 0::BIGINT FROM s
  UNION ALL
  SELECT slot + 1, list_transform(used, lambda x, i: CASE WHEN i = best THEN x + 1 ELSE x END), coalesce(best, 0) FROM (
    SELECT slot, used, list_min(list_filter(list_transform(range(1, len(w) + 1), lambda i:
      CASE WHEN used[i] < n[i] AND used[i] * q // w[i] <= slot + 1 THEN ((used[i] + 1) * q + w[i] - 1) // w[i] * 1000000 + i END), lambda x: x IS NOT NULL)) % 1000000 AS best
    FROM edf, s WHERE list_sum(used) < list_sum(n))
),
turns AS (SELECT s.src[pick] AS src, used[pick] - 1 AS block, s.w[pick] AS w, q, slot FROM edf, s WHERE pick > 0),
blocks AS (SELECT doc_id, source, src, (row_number() OVER (PARTITION BY src ORDER BY k, doc_id) - 1) // {m.BLOCK} AS block FROM docs)
SELECT doc_id, source, block, block * q // w AS release, ((block + 1) * q + w - 1) // w AS deadline, slot FROM blocks JOIN turns USING (src, block)
"""


def secret_scan_kind(order: int, rule: secret_scan.Rule) -> str:
    """Beginnings are sums of the lengths of the parts between the matches and of the matches."""
    pattern = rule.pattern.replace("'", "''")
    value = f"length(regexp_replace(m, '^(?:{secret_scan.ASSIGN.rpartition('[A-Za')[0].replace(chr(39), chr(39) * 2)})', ''))" if rule.tail else "length(m)"
    return f"""
SELECT doc_id, {order} AS o, '{rule.kind}' AS kind, s AS start, s + length(m) AS stop FROM (
  SELECT doc_id, ms[i] AS m, (coalesce(list_sum(list_transform(ps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s FROM (
    SELECT doc_id, ms, ps, unnest(range(1, len(ms) + 1)) AS i FROM (
      SELECT doc_id, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS ps FROM documents)))
WHERE {value} >= {rule.least}"""


def secret_scan_sql() -> str:
    base = len(secret_scan.BASE)
    listed = lambda where: f"coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, o) FILTER ({where}), '')"
    counts = "".join(f"count(*) FILTER (o = {n}) AS n_{r.kind}, " for n, r in enumerate(secret_scan.BASE))
    return f"""
WITH k AS ({" UNION ALL ".join(secret_scan_kind(n, r) for n, r in enumerate(secret_scan.RULES))})
SELECT d.doc_id, {counts}sha256({listed(f"o < {base}")}) AS base_sha256, {listed("o >= 0")} AS spans FROM documents d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id
"""


def license_scan_sql() -> str:
    listed = lambda words: "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"
    templates = ", ".join(f"('{n}', {listed(b)})" for n, b in license_scan.template_bigrams(license_scan.TEMPLATES))
    return rf"""
WITH t(license, b) AS (VALUES {templates}),
c AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g') AS t FROM documents),
p AS (
  SELECT doc_id, unnest(list_concat(string_split(t, chr(10)), list_transform(
    list_filter(string_split_regex(t, '\n ?\n[ \n]*'), lambda x: contains(trim(replace(x, chr(10), '|')), '|')), lambda x: replace(x, chr(10), ' ')))) AS p FROM c
),
w AS (SELECT doc_id, row_number() OVER () AS n, string_split_regex(trim(p), ' +') AS w FROM p),
g AS (SELECT doc_id, n, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w WHERE len(w) > 1),
s AS (SELECT doc_id, n, license, 2.0::DOUBLE * len(list_intersect(g, b)) / (len(g) + len(b)) AS dice FROM g, t),
h AS (SELECT doc_id, n, max({{'dice': dice, 'license': license}}) AS h FROM s WHERE dice >= {license_scan.THRESHOLD} GROUP BY doc_id, n)
SELECT d.doc_id, coalesce(string_agg(DISTINCT h.license, ',' ORDER BY h.license), '') AS licenses, count(h.n) AS n_passages, max(h).license AS best_license, round(max(h).dice, 6) AS best_dice
FROM documents d LEFT JOIN h USING (doc_id) GROUP BY d.doc_id
"""


def importance_sql() -> str:
    """Checksums are taken of each distinct feature's bytes, through a table of the remainders of one byte."""

    def remainder(c: int) -> int:
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        return c

    found = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {found} AS w FROM documents),
b AS (SELECT {found} AS w FROM benchmark),
fd AS (SELECT r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM d),
fb AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM b),
distinct_features AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM fd UNION SELECT f FROM fb)),
crc AS (SELECT f, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT)),
  lambda c, x: xor(c >> 8, ({[remainder(c) for c in range(256)]}::BIGINT[])[xor(c & 255, x) + 1]))) % 10000 AS bucket FROM distinct_features),
s AS (SELECT bucket, count(*) AS s FROM fd JOIN crc USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM fb JOIN crc USING (f) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000)::DOUBLE) / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT r, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM fd JOIN crc USING (f) JOIN g USING (bucket) GROUP BY r),
x AS (SELECT doc_id, len(w) AS n_words, greatest(2 * len(w) - 1, 0) AS n_features, coalesce(weight, 0) AS weight, ('0x' || sha256('7:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT AS h FROM d LEFT JOIN w USING (r)),
y AS (SELECT *, weight + floor(-1000 * ln(-ln((h::DOUBLE + 0.5) / 4294967296::DOUBLE)))::BIGINT AS score FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, 25 * count(*) FILTER (n_words >= 20) OVER () // 100 AS drawn FROM y)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN n_words >= 20 AND place <= drawn THEN place END AS rank FROM z
"""
