"""Column functions over text, identifiers and vectors."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks and their plain forms, from the Unicode decompositions of the Latin blocks.
MARKED, PLAIN = zip(*[(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(c))) > 1], strict=True)
MARKED, PLAIN = "".join(MARKED), "".join(PLAIN)
#: Words that don't inform a lexical query, without diacritics.
STOPWORDS = """
a ad agli ai al all alla alle allo anche c che chi ci come con cosa cui da dai
dal dall dalla dalle dallo degli dei del dell della delle dello di do e ed era
essere fa fare fra gli ha hai hanno ho i il in io la le lei li lo loro ma me mi
ne negli nei nel nell nella nelle nello noi non o per perche piu quale quali
quando quanta quante quanti quanto qual si sia siamo sono su sui sul sull sulla
sulle sullo ti tra tu tuo un una uno vi
""".split()
#: Columns of the lexical index; `column:value` asks in one of them. document is the text.
LEXICAL_COLUMNS = ("document", "title", "folder", "doc_type", "email_from", "file_path")
#: Legal forms that names end with, in the order in which they are taken off.
COMPANY_ENDINGS = (" srl", " s.r.l.", " s.r.l", " ltd", " limited", " inc", " spa", " s.p.a.", " s.p.a", " srls", " gmbh", " ag", " co")
#: Words that, at the front, keep a candidate from being an entity.
CANDIDATE_STOPWORDS = """
mi ti ci vi si lo la le gli il un una uno di da in con su per tra fra al del dal nel
che chi cosa come dove quando quale quali quanto quanta quanti quante perche perché non ho hai ha
sono sei era e ma se o dammi dimmi fammi riassumi elenca trova cerca mostra
spiega vorrei puoi potresti sai devo posso voglio
the what who where when why how which whose give show find list tell can could would is are
do does did my me i a an and or but if
""".split()
DERIVED_PREFIXES = ("conv_summary_", "doc_summary_", "live_")


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, without diacritics."""
    return F.regexp_extract_all(F.translate(F.lower(F.coalesce(text, F.lit(""))), MARKED, PLAIN), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


def informative(terms: Column) -> Column:
    return F.array_except(F.array_distinct(terms), F.lit(STOPWORDS))


def lexical_query(text: Column, columns: tuple[str, ...] = LEXICAL_COLUMNS) -> Column:
    """(mode, column, terms): `column:value` with a known column, in any case, is an AND over its tokens, all else an OR of informative tokens, nothing a skip."""
    known = "(?is)^\\s*(" + "|".join(columns) + "):(.+)$"
    scoped, value = F.lower(F.regexp_extract(text, known, 1)), F.regexp_extract(text, known, 2)
    terms = F.when(scoped != "", F.array_distinct(tokens(value))).otherwise(informative(tokens(text)))
    mode = F.when(F.size(terms) == 0, "skip").when(scoped != "", "and").otherwise("or")
    return F.struct(mode.alias("mode"), F.when(mode == "and", scoped).alias("column"), terms.alias("terms"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, at least 0; 0 for null, empty, zero or unequal ones."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    good = a.isNotNull() & b.isNotNull() & (F.size(a) > 0) & (F.size(a) == F.size(b))
    return F.when(good & (norm > 0), F.greatest(dot(a, b) / norm, F.lit(0.0))).otherwise(0.0)


def is_derived_chunk(chunk_id: Column) -> Column:
    return reduce(lambda a, b: a | b, [chunk_id.startswith(p) for p in DERIVED_PREFIXES])


def chunk_id(prefix: Column, part: Column, kind: str = "") -> Column:
    """<prefix>_chunk_0000, email_<id>_chunk_0000 or doc_<hash>_chunk_0000."""
    return F.format_string((kind + "_" if kind else "") + "%s_chunk_%04d", prefix, part)


def doc_of_chunk(chunk: Column) -> Column:
    return F.regexp_replace(chunk, "_chunk_[0-9]+$", "")


def embedding_text(text: Column) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, 4000)


def entity_candidates(query: Column, stopwords: list[str] = CANDIDATE_STOPWORDS) -> Column:
    """Capitalised words of two letters or more, pairs of capitalised words, and triples that begin with one and have a last; none led by a stopword."""

    def capital(w: Column) -> Column:
        return w.rlike("^\\p{Lu}")

    def grams(words: Column) -> Column:
        at = lambda i: F.get(words, i)
        span = lambda n: F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
        joined = lambda *w: F.concat_ws(" ", *w)
        ones = F.filter(words, lambda w: capital(w) & (F.length(w) >= 2))
        twos = F.transform(F.filter(span(2), lambda i: capital(at(i)) & capital(at(i + 1))), lambda i: joined(at(i), at(i + 1)))
        threes = F.transform(F.filter(span(3), lambda i: capital(at(i)) & (at(i + 2) != "")), lambda i: joined(at(i), at(i + 1), at(i + 2)))
        found = F.array_union(F.array_union(ones, twos), threes)
        return F.sort_array(F.filter(found, lambda g: ~F.lower(F.split(g, " ")[0]).isin(*stopwords)))

    words = F.transform(F.array_remove(F.split(F.coalesce(query, F.lit("")), "\\s+"), ""), lambda w: F.regexp_replace(w, "[^\\p{L}\\p{N}_]", ""))
    return F.transform(F.array(words), grams)[0]


#: Python's blanks, as far as text has them.
BLANKS = " \t\n\r\x0b\x0c"


def normal_entity(name: Column) -> Column:
    """Lower case without legal forms and punctuation, hyphens aside; of three words or fewer, the first two sorted."""
    strip = lambda c: F.trim(c, F.lit(BLANKS))
    bare = F.aggregate(F.lit(list(COMPANY_ENDINGS)), F.lower(strip(name)), lambda s, e: F.when(F.endswith(s, e), strip(F.left(s, F.length(s) - F.length(e)))).otherwise(s))
    plain = F.regexp_replace(bare, "[.,;:!?()\\[\\]{}'\"]+", "")

    def keyed(s: Column) -> Column:
        words = F.array_remove(F.split(s, "\\s+"), "")
        return F.when(F.size(words) <= 3, F.array_join(F.sort_array(F.slice(words, 1, 2)), " ")).otherwise(s)

    return F.transform(F.array(plain), keyed)[0]


#: What marks a normalised name as noise.
NOISE_WORDS = ("", "null", "none", "nan", "n/a", "undefined", "true", "false")
UI_FRAGMENTS = ("bar search", "1 option", "notifiche push", "date form", "container layout")
MONTHS = """
gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre
january february march april may june july august september october november december
gen feb mar apr mag giu lug ago set ott dic jan jun jul aug sep sept oct dec
""".split()


def entity_noise(name: Column) -> Column:
    """The first rule that a normalised name matches, or null: a month counts only with a year beside it, either first."""
    s = F.trim(F.coalesce(name, F.lit("")), F.lit(BLANKS))
    month, year = "(" + "|".join(MONTHS) + ")", "(19|20)[0-9]{2}"
    return (
        F.when(s.isin(*NOISE_WORDS), "noise_token")
        .when(s.rlike("^[0-9\\s]+$"), "numeric")
        .when(s.isin(*UI_FRAGMENTS), "ui_fragment")
        .when(s.rlike(f"^({month}\\s+{year}|{year}\\s+{month})$"), "temporal")
        .when(s.rlike("^[a-z]{2}[0-9]{4,}$"), "vat_id")
        .when(s.rlike("^[a-z]{6}[0-9]{2}[a-z][0-9]{2}[a-z][0-9]{3}[a-z]$"), "tax_code")
        .when(s.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), "uuid")
    )


def parsed_date(text: Column) -> Column:
    """ISO 8601, then RFC 2822, as UTC; null for what is neither."""
    iso = F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))
    mail = F.regexp_replace(F.regexp_replace(text, "^[A-Za-z]{3}, ", ""), " \\([A-Z]+\\)$", "")
    return F.coalesce(iso, F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss z")))


def short_name(address: Column) -> Column:
    """The display name before <, without quotes; the address where there is none."""
    name = F.trim(F.translate(F.split(address, "<")[0], "\"'", ""))
    return F.when(name == "", F.regexp_replace(address, "[<>]", "")).otherwise(name)


def fingerprint(*fields: Column) -> Column:
    """SHA-256 over the fields in order, each after its length in bytes and both before a NUL, so that no two rows run together; null as empty."""
    parts = []
    for f in fields:
        v = F.coalesce(f.cast("string"), F.lit(""))
        parts += [F.octet_length(v).cast("string"), F.lit("\0"), v, F.lit("\0")]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def live_id(conversation: Column, title: Column, ts: Column, text: Column) -> Column:
    """16 hex digits that stay the same when a live conversation is sent again."""
    other = F.concat_ws("|", title, ts.cast("string"), F.length(text).cast("string"), F.substring(text, 1, 500))
    return F.substring(F.sha2(F.when(conversation != "", conversation).otherwise(other).cast("binary"), 256), 1, 16)


def redact_tokens(line: Column) -> Column:
    return F.regexp_replace(line, "(?i)(token=)[^&\\s\"']+", "$1REDACTED")


#: Patterns of file names and texts and the document types that they tell, in order.
DOC_TYPES = (
    (r"nota.integr", "nota_integrativa"),
    (r"bilancio.?(d['\s]esercizio|consolidat|abbreviat|annuale|ordinario)", "bilancio"),
    (r"stato.patrimoniale", "bilancio"),
    (r"conto.economico", "bilancio"),
    (r"xbrl", "bilancio"),
    (r"relazione.?(degli.amministratori|sulla.gestione)", "relazione_gestione"),
    (r"verbale.?(assemblea|cda|consiglio)", "verbale"),
    (r"statuto", "statuto"),
    (r"fattur[ae]", "fattura"),
    (r"invoice", "fattura"),
    (r"ricevut[ae]", "ricevuta"),
    (r"bonifico", "pagamento"),
    (r"estratto.conto", "estratto_conto"),
    (r"rendiconto", "estratto_conto"),
    (r"portafoglio|portfolio", "rendiconto_investimenti"),
    (r"atto.notarile|rogito", "atto_notarile"),
    (r"contratto.?(di.?)?(locazione|affitto|compravendita|fornitura)", "contratto"),
    (r"scrittura.privata", "contratto"),
    (r"visura", "visura_camerale"),
    (r"sentenza|decreto|ordinanza", "atto_legale"),
    (r"ricorso|citazione", "atto_legale"),
    (r"dichiarazione.?(dei.redditi|iva|730|unico)", "dichiarazione_fiscale"),
    (r"\bf24\b|\bf24[_\-]|\bf23\b", "pagamento_fiscale"),
    (r"unico\b", "dichiarazione_fiscale"),
    (r"refert[oi]|diagnos|anamnesi", "referto_medico"),
    (r"esami?.?(del.sangue|clinici|laboratorio)", "referto_medico"),
    (r"cartella.clinica", "referto_medico"),
    (r"ricetta", "prescrizione"),
    (r"polizza|assicuraz", "polizza_assicurativa"),
    (r"sinistro|denuncia.sinistro", "denuncia_sinistro"),
    (r"catasto|planimetria", "documento_catastale"),
    (r"mutuo|ipoteca", "mutuo"),
    (r"presentazione|pitch|deck|slide", "presentazione"),
    (r"piano.?(integrazione|strategico|operativo|marketing)", "piano"),
)
EXTENSION_TYPES = {"xlsx": "spreadsheet", "xls": "spreadsheet", "csv": "csv", "tsv": "csv", "docx": "documento_word", "pptx": "presentazione"}
OTHER_TYPE = "documento"


def doc_type(name: Column, text: Column) -> Column:
    """By file name, then by the first 500 characters, then by extension."""
    rules = [(where, pattern, kind) for where in (F.lower(name), F.lower(F.substring(F.coalesce(text, F.lit("")), 1, 500))) for pattern, kind in DOC_TYPES]
    told = F.coalesce(*[F.when(where.rlike(pattern), kind) for where, pattern, kind in rules])
    extension = F.lower(F.regexp_extract(name, "\\.([^.]+)$", 1))
    by_extension = F.create_map(*[F.lit(x) for kv in EXTENSION_TYPES.items() for x in kv])[extension]
    return F.coalesce(told, by_extension, F.lit(OTHER_TYPE))


def folder_of(path: Column, marker: str, watched: str = "") -> Column:
    """The segment after the marker segment; else the base name of the watched folder; else empty."""
    parts = F.split(path, "/")
    at = F.array_position(parts, marker)
    return F.when((at > 0) & (at < F.size(parts)), F.get(parts, at.cast("int"))).otherwise(F.lit(watched.rstrip("/").rsplit("/", 1)[-1]))


def html_text(html: Column, least: int = 100) -> Column:
    """Text of a page: no script or style, a line end for each tag, at most one empty line in a row; null under least characters."""
    s = F.regexp_replace(F.coalesce(html, F.lit("")), "(?is)<(script|style)[^>]*>.*?</(script|style)>", "")
    s = F.regexp_replace(F.regexp_replace(s, "<[^>]+>", "\n"), "\n{3,}", "\n\n")
    s = F.regexp_replace(s, "^[ \n\t\r]+|[ \n\t\r]+$", "")
    return F.when(F.length(s) >= least, s)


def mail_text(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]+>", " "), "\\s+", " "))


def quality_stats(text: Column, vocabulary: Column) -> Column:
    """(alnum, mean_word, known, garbage) of a text against an array of known words: all 0 and garbage under 50 characters, never garbage under 200."""
    size = F.length(F.coalesce(text, F.lit("")))
    solid = F.regexp_replace(text, "\\s", "")
    words = F.array_remove(F.split(text, "\\s+"), "")
    long = F.filter(F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}]+"), F.lit(0)), lambda w: F.length(w) >= 3)
    share = lambda part, of: F.when((size >= 50) & (of > 0), part / of).otherwise(0.0)
    alnum = share(F.length(F.regexp_replace(solid, "[^\\p{L}\\p{N}]", "")), F.length(solid))
    mean = share(F.length(solid), F.size(words))
    known = share(F.size(F.filter(long, lambda w: F.array_contains(vocabulary, w))), F.size(long))
    garbage = F.when(size < 50, True).when(size < 200, False).otherwise((mean < 2.5) & (known < 0.5))
    return F.struct(alnum.alias("alnum"), mean.alias("mean_word"), known.alias("known"), garbage.alias("garbage"))


def session_title(message: Column, default: str = "New chat") -> Column:
    """Squeezed, cut at a word's end within 60 characters if that leaves 20, a cut one without trailing punctuation; default for none."""
    s = F.trim(F.regexp_replace(F.coalesce(message, F.lit("")), "\\s+", " "))
    cut = F.substring(s, 1, 60)
    at = F.length(cut) - F.instr(F.reverse(cut), " ")
    whole = F.when((F.instr(cut, " ") > 0) & (at >= 20), F.left(cut, at)).otherwise(cut)
    return F.when(s == "", default).when(F.length(s) <= 60, s).otherwise(F.regexp_replace(whole, "[ ,.;:]+$", ""))
