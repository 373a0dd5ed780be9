"""E-mail selection, clean-up and triage."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Senders whose mail isn't kept, by what the part before @ contains or by their domain.
SENDER_TOKENS = """
noreply no-reply donotreply do-not-reply notifications notification mailer-daemon postmaster
newsletter news marketing promo promotions updates update info@github.com builds@travis-ci.org notify alert alerts
""".split()
SENDER_DOMAINS = """
facebookmail.com linkedin.com twitter.com x.com pinterest.com instagram.com tiktok.com
accounts.google.com googleusercontent.com mailchimp.com sendgrid.net mailgun.org amazonses.com bounce.google.com
steampowered.com playstation.com xbox.com spotify.com netflix.com apple.com
""".split()
CUT_MARK = "\n[...]"


def address(header: Column) -> Column:
    return F.regexp_extract(F.lower(header), "[\\w.-]+@[\\w.-]+", 0)


def keep_useful_emails(emails: DataFrame, users: tuple[str, ...]) -> DataFrame:
    """Useful mail that the user sent, or that went to the user alone."""
    mine = lambda c: F.exists(F.array(*map(F.lit, users)), lambda u: F.contains(F.lower(c), F.lower(u)))
    sole = F.size(F.filter(F.split("to", ","), lambda p: F.contains(p, F.lit("@")))) == 1
    return emails.filter(F.col("useful") & (mine(F.col("from")) | (sole & mine(F.col("to")))))


def drop_blacklisted_senders(emails: DataFrame, parts: list[str] = SENDER_TOKENS, domains: list[str] = SENDER_DOMAINS) -> DataFrame:
    """Mail but that of senders whose local part contains a token or whose domain is listed or below a listed one."""
    sender = address(F.col("from"))
    local, domain = F.split(sender, "@")[0], F.regexp_extract(sender, "@(.*)$", 1)
    bad = F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(local, p)) | F.exists(F.array(*map(F.lit, domains)), lambda d: (domain == d) | F.endswith(domain, F.concat(F.lit("."), d)))
    return emails.filter(~F.coalesce(bad, F.lit(False)))


def normalize_email_bodies(emails: DataFrame, least: int = 50, most: int = 10_000) -> DataFrame:
    """Mail with bodies of least trimmed characters or more, cut with a mark at most; is_sent by label."""
    rows = emails.filter(F.length(F.trim(F.coalesce("body", F.lit("")))) >= least)
    cut = F.when(F.length("body") > most, F.concat(F.substring("body", 1, most), F.lit(CUT_MARK))).otherwise(F.col("body"))
    return rows.withColumns({"body": cut, "is_sent": F.array_contains("labels", "SENT")})


#: Lines that are left out, lines that end a mail's own words, and the line before a signature.
QUOTED_LINES = (r">", r"On .+ wrote:\s*$", r"Il .+ ha scritto:\s*$")
END_LINES = (r"-{3,}\s*(Original Message|Forwarded message|Messaggio originale)", r"_{3,}\s*$")
SIGNATURE = r"\n-- ?\n"
#: What closings look like, in the order in which they are tried.
CLOSINGS = (
    r"(?:Questa e-?mail|La presente e-?mail|La presente comunicazione).*(?:destinat[aoi]|riservat[aoi]|intend)",
    r"(?:l'utilizzo e la distribuzione|severamente proibita)",
    r"(?:Se non siete il destinatario|Se ha ricevuto per errore|Se Lei non è il destinatario)",
    r"(?:This e-?mail|This message).*(?:confidential|intended solely|privileged)",
    r"(?:If you are not the intended recipient|If you have received this)",
    r"(?:strictly prohibited|unauthorized use|unauthorized disclosure)",
    r"(?:AVVISO DI RISERVATEZZA|CONFIDENTIALITY NOTICE|DISCLAIMER|AVVERTENZA)",
    r"\[https?://.*?(?:signature|logo|banner).*?\]",
    r"(?:Sent from|Inviato da|Envoyé de) (?:my |Mail for |)(?:iPhone|iPad|Android|Samsung|Outlook|Gmail)",
    r"(?:^|\n)(?:Tel|Phone|Fax|Mobile|Cell|Office|Direct)[.:]?\s*[\+\d\(\)\-\s]{8,}",
)
#: What cuts wherever it stands, tried one after the other once links are gone.
LATE_CLOSINGS = (
    r"(?:Questa e-?mail e tutti i suoi allegati|This e-?mail and any)",
    r"(?:L'utilizzo e la distribuzione|The use and distribution)",
    r"(?:Se non siete il|If you are not the intended)",
    r"(?:Get Outlook for|Scarica Outlook per)",
)
#: Lines of links, and the characters before a closing that make it one.
LINK_LINES = (r"[\s·•\-]*\[?https?://", r"\[.*http", r".*·.*http|.*http.*·", r"[\s·•\-]*\[.*\]\s*$")
OWN_CHARS = 50

_QUOTED, _LINK = re.compile("|".join(QUOTED_LINES)), re.compile("|".join(LINK_LINES))
_END = re.compile("|".join(END_LINES), re.I)


def _before(text: str, pattern: str) -> str | None:
    """What stands before the first match, if it is more than OWN_CHARS."""
    found = re.search(pattern, text, re.I | re.M)
    before = text[: found.start()].strip() if found else ""
    return before if len(before) > OWN_CHARS else None


def own_text(body: str | None, closings: tuple[str, ...] = ()) -> str:
    """A mail's own words: no quoted lines, reply headers, forwarded part, signature, disclaimer or lines of links. closings: further plain texts that closings begin with."""
    own = tuple(map(re.escape, closings))
    lines = []
    for line in (body or "").split("\n"):
        if _END.match(line.strip()):
            break
        if not _QUOTED.match(line.strip()):
            lines.append(line)
    text = re.split(SIGNATURE, "\n".join(lines).strip())[0].strip()
    text = next((cut for p in (*CLOSINGS, *own) if (cut := _before(text, p)) is not None), text)
    kept, linked = [], False
    for line in text.split("\n"):
        link = bool(_LINK.match(line.strip()))
        linked = link or linked and not line.strip()
        if not linked:
            kept.append(line)
    text = "\n".join(kept).strip()
    for p in (*LATE_CLOSINGS, *own):
        cut = _before(text, p)
        text = text if cut is None else cut
    return text


def strip_quoted(emails: DataFrame) -> DataFrame:
    """emails with own_text; one narrow pass in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "own_text": [own_text(x) for x in b["body"]]})

    return emails.select("id", "body").mapInPandas(run, f"id {emails.schema['id'].dataType.simpleString()}, own_text string")


def new_emails(source: DataFrame, by_meta: DataFrame, by_chunk: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """(id, reason) of source (id, position): repeated, known by metadata, by chunk id or by checkpoint, else new."""
    parsed = by_chunk.select(F.regexp_extract("chunk_id", "^email_(.+)_chunk_[0-9]{4}$", 1).alias("id")).filter("id <> ''").distinct()
    rows = source.withColumn("nth", F.row_number().over(W.partitionBy("id").orderBy("position")))
    for name, ids in (("meta", by_meta.select("id").distinct()), ("chunk", parsed), ("done", checkpoint.select("id").distinct())):
        rows = rows.join(ids.withColumn(name, F.lit(True)), "id", "left")
    reason = F.when(F.col("nth") > 1, "repeated").when(F.col("meta"), "known_meta").when(F.col("chunk"), "known_chunk").when(F.col("done"), "checkpoint").otherwise("new")
    return rows.select("id", "position", reason.alias("reason"))


def parsed_verdicts(responses: DataFrame) -> DataFrame:
    """(id, useful, error) from model responses; no content is an error, no verdict not useful."""
    content = F.get_json_object("response", "$.choices[0].message.content")
    body = F.from_json(F.regexp_replace(content, "```(json)?", ""), "struct<useful:boolean>")
    return responses.select("id", F.when(content.isNotNull(), F.coalesce(body["useful"], F.lit(False))).alias("useful"), F.when(content.isNull(), "no content").alias("error"))


def merge_verdicts(emails: DataFrame, results: DataFrame) -> DataFrame:
    rows = emails.join(results.withColumnsRenamed({"useful": "u", "error": "e"}), "id", "left")
    return rows.withColumns({"useful": F.coalesce("u", "useful"), "triage_error": F.coalesce("e", "triage_error")}).drop("u", "e")


def triage_todo(emails: DataFrame, progress: DataFrame) -> DataFrame:
    """Mail without an error-free verdict in its last progress record."""
    last = progress.groupBy("id").agg(F.max_by(F.struct("useful", "error"), "seq").alias("l"))
    return emails.join(last.filter("l.error IS NULL AND l.useful IS NOT NULL").select("id"), "id", "left_anti")


def id_quality_gate(df: DataFrame, key: str = "id") -> DataFrame:
    """One row: rows without an id, ids that repeat, and whether a run may go on."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    missing = F.sum(F.when(F.coalesce(F.col(key).cast("string"), F.lit("")) == "", F.col("n")).otherwise(0))
    repeated = F.count(F.when((F.coalesce(F.col(key).cast("string"), F.lit("")) != "") & (F.col("n") > 1), 1))
    return counts.agg(F.coalesce(missing, F.lit(0)).alias("missing"), repeated.alias("repeated")).withColumn("passes", (F.col("missing") == 0) & (F.col("repeated") == 0))
