"""Streams against their batch twins, readers, cutters and searches on small tables."""

import json
import re
import threading
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from memlake.operators import chunking, evaluate, lifecycle, mail, search, stats
from memlake.sources import exports, pointers
from memlake.streaming import jobs

START = datetime(2024, 1, 1)


def at(minutes):
    return START + timedelta(minutes=minutes)


def streamed(spark, rows, schema, path):
    """rows as a stream of one file each."""
    for n, r in enumerate(rows):
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/in")


QUERIES = {}


def drained(df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(240)
    QUERIES[name] = query
    return df.sparkSession.table(name).collect()


def test_sessions_split_at_the_timeout(spark, tmp_path):
    schema = "event_id long, user_id long, ts timestamp"
    rows = [(1, 1, at(0)), (2, 1, at(9.9)), (3, 1, at(19.9)), (4, 1, at(30)), (5, 2, at(3)), (6, 9, at(900))]
    batch = stats.sessionize(spark.createDataFrame(rows, schema), 600).groupBy("user_id", "session").agg(F.min("ts").alias("s"), F.count("*").alias("n"))
    want = {(r.user_id, r.s, r.n) for r in batch.collect()}
    assert {(1, at(0), 2), (1, at(19.9), 1), (1, at(30), 1)} <= want
    got = drained(jobs.stream_sessions(streamed(spark, rows, schema, str(tmp_path))), "sessions")
    assert {(r.user_id, r.start, r.events) for r in got} == {w for w in want if w[0] != 9}


def test_sessions_over_buckets(spark, monkeypatch):
    import random
    from collections import defaultdict

    monkeypatch.setattr(stats, "SESSION_BUCKET", 1_000)
    rng = random.Random(7)
    rows = [(n, rng.choice([1, 1, 1, 2, None]), START + timedelta(seconds=rng.choice([rng.uniform(-5e3, 1e5), 300 * rng.randint(0, 30)]))) for n in range(500)]
    got = {r.event_id: r.session for r in stats.sessionize(spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp"), 300).collect()}
    want, users = {}, defaultdict(list)
    for n, user, t in rows:
        users[user].append((t, n))
    for events in users.values():
        session, last = 0, None
        for t, n in sorted(events):
            session += last is None or t - last >= timedelta(seconds=300)
            want[n], last = session, t
    assert got == want


@pytest.fixture
def timers(spark):
    spark.conf.set(*jobs.PROVIDER)
    late = jobs.LateRows()
    spark.streams.addListener(late)
    yield late
    spark.streams.removeListener(late)
    spark.conf.unset(jobs.PROVIDER[0])


def state_rows(spark, name):
    """Rows of state that the last progress of the query of this name reported."""
    return [s.numRowsTotal for q in [QUERIES[name]] for s in q.lastProgress.stateOperators]


def test_bans(spark, tmp_path, timers):
    schema = "event_id long, user_id long, event_type string, ts timestamp"
    fails = lambda user, *minutes: [(0, user, "error", at(m)) for m in minutes]
    rows = fails(1, 0, 1, 2, 3, 4) + fails(2, 0, 1, 2, 3) + [(0, 2, "signup", at(3.5))] + fails(2, 4) + fails(3, 0, 1, 2, 3, 4, 40, 41) + fails(4, 0, 4, 8, 12, 16.0000003)
    want = {(1, at(4), at(34)), (3, at(4), at(34))}
    # out of order within the hour that rows may be late, two to a batch; then ones that end all others' windows, and one that is too late
    mixed = sorted(rows, key=lambda r: (r[3].minute % 7, r[1]))
    parts = [mixed[k : k + 8] for k in range(0, len(mixed), 8)] + [fails(9, 600)] + [fails(9, 601)] + [fails(9, 602) + fails(1, 2.5)]
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    assert {tuple(r) for r in drained(jobs.stream_bans(stream), "bans")} == want
    assert timers.counts["bans"] == 1
    # of all users only the last one's rows wait; the others' failures and bans are over
    assert sum(state_rows(spark, "bans")) <= 5
    whole = spark.createDataFrame(sorted(rows, key=lambda r: r[3]), schema)
    first = stats.ban_triggers(whole, "error", 5, 900).groupBy("user_id").agg(F.min("ts").alias("ts"))
    assert {(r.user_id, r.ts) for r in first.collect()} == {(1, at(4)), (3, at(4)), (2, at(4))}


def test_breaches(spark):
    series = lambda key, *points: [(key, at(60 * h), float(v) if v is not None else None) for h, v in points]
    rows = series("long", (0, 9), (24, 9), (48, 9)) + series("dipped", (0, 9), (24, 1), (48, 9)) + series("young", (24, 9), (48, 9)) + series("gap", (0, 9), (24, None), (48, 9))
    df = spark.createDataFrame(rows, "key string, ts timestamp, value double")
    now = {r.key: r.breach for r in stats.sustained_breach(df, 5.0, 48 * 3600).filter(F.col("ts") == F.lit(at(48 * 60))).collect()}
    assert now == {"long": True, "dipped": False, "young": False, "gap": True}
    aging = {r.key: r.aging for r in stats.non_decreasing_backlog(df, 5.0, 24 * 3600).filter(F.col("ts") == F.lit(at(48 * 60))).collect()}
    assert aging == {"long": True, "dipped": True, "young": True, "gap": False}


def test_looking_back_over_buckets(spark):
    import random

    rng = random.Random(6)
    rows = [(n, rng.choice(["hot"] * 8 + ["a", None]), START + timedelta(seconds=rng.choice([rng.uniform(0, 9e4), rng.randint(0, 40) * 225, -rng.uniform(0, 9e5)])), rng.choice([None, *map(float, range(9))])) for n in range(900)]
    # of rows of a key at one time all have the same value
    first = {}
    rows = [(n, k, t, first.setdefault((k, t), v)) for n, k, t, v in rows]
    df = spark.createDataFrame(rows, "event_id long, key string, ts timestamp, value double")
    width = timedelta(seconds=3600)
    got = {r.event_id: r for r in stats._looking_back(df, 3600, ("key",)).collect()}
    assert len(got) == len(rows)
    for n, k, t, v in rows:
        old = [(u, w) for _, j, u, w in rows if j == k and u <= t - width]
        assert got[n].anchor == (max(old, key=lambda x: x[0])[1] if old else None)
        assert got[n].lowest == min((w for _, j, u, w in rows if j == k and t - width <= u <= t and w is not None), default=None)
    assert stats.at_or_before(df, 3600).columns == [*df.columns, "anchor"]


def test_upserts_are_the_same_twice(spark, tmp_path):
    schema = "conversation_id string, title string, ts string, text string, seq long"
    rows = [("a", "t", "1", "one", 1), ("b", "t", "1", "two", 1), ("a", "t", "2", "three", 2), ("", "t", "3", "four", 1), ("a", "t", "1", "late", 0)] + [(f"c{n % 7}", "t", "1", f"text{n}", n) for n in range(12)]
    for n, r in enumerate(rows):
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    tables = []
    for checkpoint in ("one", "one", "two"):  # again from the same point, and all batches again
        jobs.stream_upsert_messages(stream, f"{tmp_path}/table", f"{tmp_path}/{checkpoint}", 4, 2).awaitTermination(240)
        tables.append(sorted(map(tuple, jobs.live_messages(spark, f"{tmp_path}/table").collect())))
    want = jobs.upsert(None, spark.createDataFrame(rows, schema))
    assert tables == [sorted(map(tuple, want.collect()))] * 3 and len(tables[0]) == 10
    counts = jobs.upsert_counts(spark, f"{tmp_path}/table").collect()
    assert len(counts) == len(rows) and sum(r.inserted for r in counts) == 10 and sum(r.updated for r in counts) == len(rows) - 10 - 1
    # what a read opens doesn't grow with the batches
    body = pointers.latest(spark, f"{tmp_path}/table")[1]
    assert len(body["deltas"]) <= 2 and len(body["base"]) <= 4


def test_registry_versions(spark, tmp_path):
    frame = lambda n: spark.createDataFrame([(f"row{k}", n) for k in range(n)], "name string, n int")
    path = f"{tmp_path}/registry"
    assert exports.registry_version(spark, path) == 0 and exports.save_registry(frame(1), path) == 1
    won, lost = [], []

    def writer(n):
        try:
            won.append((exports.save_registry(frame(n), path, base=1), n))
        except pointers.StaleBase:
            lost.append(n)

    threads = [threading.Thread(target=writer, args=(n,)) for n in (2, 3, 4)]
    for t in threads:
        t.start()
    seen = {exports.load_registry(spark, path).count() for _ in range(5)}
    for t in threads:
        t.join()
    assert len(won) == 1 and len(lost) == 2 and won[0][0] == 2 and seen <= {1, won[0][1]}
    assert exports.load_registry(spark, path).count() == won[0][1] and exports.load_registry(spark, path, 1).count() == 1
    # rows without a pointer are no version
    frame(9).write.parquet(f"{path}/data/half")
    assert exports.load_registry(spark, path).count() == won[0][1]
    exports.save_registry(frame(5), path)
    exports.drop_old_versions(spark, path, 1)
    assert pointers.committed(spark, path) == [3] and exports.load_registry(spark, path).count() == 5


def test_alerts_of_a_stream(spark, tmp_path, timers):
    schema = "key string, ts timestamp, value double"
    rows = [("a", at(60 * h), 9.0 if h != 7 else 1.0) for h in range(16)] + [("b", at(60 * h + 7), 8.0) for h in range(6)] + [("b", at(60 * 15), None)]
    want = {(r.key, r.ts) for r in jobs.breach_alerts(spark.createDataFrame(rows, schema), 5.0, 7200, 10800).collect()}
    # neighbours swapped, three to a batch, and a point long after all
    mixed = [rows[k ^ 1] if k ^ 1 < len(rows) else rows[k] for k in range(len(rows))]
    mixed = sorted(mixed, key=lambda r: r[1].hour - (r[1].hour % 3) * 2 % 3)
    for k in range(0, len(mixed), 3):
        spark.createDataFrame(mixed[k : k + 3], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.createDataFrame([("z", at(60 * 200), 1.0)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = jobs.stream_alerts(stream, f"{tmp_path}/alerts", f"{tmp_path}/checkpoint", 5.0, 7200, 10800, "12 hours", 86_400)
    query.awaitTermination(240)
    assert {(r.key, r.ts) for r in spark.read.parquet(f"{tmp_path}/alerts").collect()} == want and len(want) > 2
    # only the last point's key is left: it waits, with its timer
    assert sum(s.numRowsTotal for s in query.lastProgress.stateOperators) <= 4


def write(path, value):
    path.write_text(json.dumps(value))
    return str(path)


def test_exports(spark, tmp_path):
    long = "word " * 40
    gpt = [{"id": "c1", "title": "T", "create_time": 1700000000.0, "mapping": {"x": {"message": {"author": {"role": "assistant"}, "create_time": 2.0, "content": {"parts": [long]}}}, "y": {"message": {"author": {"role": "user"}, "create_time": 1.0, "content": {"parts": ["hi", "there"]}}}, "z": {"message": {"author": {"role": "system"}, "create_time": 0.0, "content": {"parts": ["no"]}}}, "r": {"message": None}}}, {"id": "c2", "title": "S", "create_time": 1.0, "mapping": {}}]
    rows = exports.read_conversation_export(spark, write(tmp_path / "gpt.json", gpt), "chatgpt").collect()
    assert [(r.id, r.message_count, r.text) for r in rows] == [("c1", 2, f"[USER]: hi\nthere\n\n[ASSISTANT]: {long.strip()}")]
    claude = [{"uuid": "u", "name": "N", "summary": "s" * 60, "created_at": "2024-01-02T00:00:00Z", "chat_messages": [{"sender": "human", "text": "", "content": [{"type": "text", "text": long}, {"type": "tool", "text": "x"}]}, {"sender": "assistant", "text": "yes"}]}]
    rows = exports.read_conversation_export(spark, write(tmp_path / "claude.json", claude), "claude").collect()
    assert rows[0].text.startswith("[SUMMARY]: sss") and rows[0].text.endswith("[ASSISTANT]: yes") and rows[0].date == "2024-01-02"
    gemini = [{"id": "g", "title": "G", "create_time": 1.0, "chunkedPrompt": {"chunks": [{"role": "user", "text": long}, {"role": "model", "text": "thought", "isThought": True}, {"role": "model", "text": "answer"}]}}]
    rows = exports.read_conversation_export(spark, write(tmp_path / "gemini.json", gemini), "gemini").collect()
    assert rows[0].message_count == 2 and rows[0].text.endswith("[ASSISTANT]: answer")
    with pytest.raises(ValueError):
        exports.read_conversation_export(spark, "x", "other")


def test_files(spark, tmp_path):
    for name, text in (("work/a.md", "one"), ("work/b.exe", "two"), ("c.CSV", "one"), ("Food Tracker/d.md", "x"), ("e.md", "y"), ("~$f.docx", "z"), ("g.tmp.md", "z"), ("h.markdown", "z"), ("i.txt", "z")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    denied = spark.createDataFrame([(str(tmp_path / "e.md"),)], "filepath string")
    rows = {r.rel_path: r for r in exports.scan_files(spark, str(tmp_path), denied).collect()}
    assert set(rows) == {"work/a.md", "c.CSV", "h.markdown"} and rows["work/a.md"].category == "work" and rows["c.CSV"].category == "" and rows["c.CSV"].hash == rows["work/a.md"].hash


def test_projects_and_memories(spark, tmp_path):
    long = "word " * 40
    projects = [{"uuid": "p", "name": "P", "prompt_template": long, "created_at": "2024-01-02T00:00:00Z", "docs": [{"uuid": "d1", "filename": "a.md", "content": long + "one"}, {"uuid": "d2", "filename": "b.md", "content": "short"}]}, {"uuid": "q", "name": "Q", "prompt_template": None, "created_at": None, "docs": []}]
    rows = {r.id: r for r in exports.read_conversation_export(spark, write(tmp_path / "projects.json", projects), "claude_projects").collect()}
    assert set(rows) == {"project_p", "d1"} and rows["d1"].title == "P / a.md" and rows["d1"].date == "2024-01-02" and rows["d1"].text == long + "one" and rows["project_p"].text == long
    memories = [{"account_uuid": "m", "conversations_memory": long, "project_memories": {"b": "second", "a": "first"}}]
    (row,) = exports.read_conversation_export(spark, write(tmp_path / "memories.json", memories), "claude_memories").collect()
    assert row.id == "memories_m" and row.text == f"{long}\n\nfirst\n\nsecond" and row.date is None


def test_mail_files_and_chunk_tables(spark, tmp_path):
    lines = [{"id": "1", "from": "a@b.org", "to": "me", "body": "x" * 60, "labels": ["SENT"], "extra": 1}, {"id": "2"}]
    (tmp_path / "mail.jsonl").write_text("\n".join(map(json.dumps, lines)))
    mails = exports.read_emails(spark, f"{tmp_path}/mail.jsonl")
    assert [(r.id, r["from"], r.labels) for r in mails.orderBy("id").collect()] == [("1", "a@b.org", ["SENT"]), ("2", None, None)]
    assert [(r.id, r.is_sent) for r in mail.normalize_email_bodies(mails).collect()] == [("1", True)]
    docs = spark.createDataFrame([(1, ("One sentence here. " * 200).strip(), "plan.md", "/data/kb/work/plan.md"), (2, "short note", "n.md", "/data/kb/n.md"), (3, "", "e.md", "/data/kb/e.md"), (4, None, "z.md", "/z.md")], "doc_id int, text string, filename string, file_path string")
    chunks = chunking.build_chunks(docs)
    rows = chunks.orderBy("doc_id", "part").collect()
    parts = chunking.greedy(("One sentence here. " * 200).strip())
    assert [(r.doc_id, r.part) for r in rows] == [(1, n) for n in range(len(parts))] + [(2, 0)] and len({r.chunk_id for r in rows}) == len(rows)
    # each part but the first begins with the end of the one before it, cut at a blank
    assert rows[0].text == parts[0] and all(r.text.endswith(p) and parts[r.part - 1].endswith(r.text[: -len(p)].strip()) and len(r.text) > len(p) for r, p in zip(rows[1:-1], parts[1:]))
    assert {r.folder for r in rows} == {"work", "n.md"} and all(r.char_count == len(r.text) for r in rows)
    exports.write_chunks(chunks, f"{tmp_path}/out", by=("folder",))
    assert spark.read.parquet(f"{tmp_path}/out").filter("folder = 'work'").count() == len(parts)


def test_sketches_merge(spark):
    df = spark.range(30_000).select(F.concat(F.lit("day"), F.col("id") % 5).alias("day"), (F.col("id") % 3).alias("source"), (F.col("id") % 9_000).alias("who"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("what"))
    parts = [stats.sketched(df.filter(f"who % 4 = {k}"), ("day", "source"), {"whos": "who", "whats": "what"}) for k in range(4)]
    merged = stats.merged_sketches(*parts, stats.sketched(df.limit(0), ("day", "source"), {"whos": "who", "whats": "what"}))
    for keys in ((), ("source",), ("day", "source")):
        got = {tuple(r[k] for k in keys): r for r in stats.distinct_counts(merged, *keys).collect()}
        want = {tuple(r[k] for k in keys): r for r in df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("who").alias("whos"), F.countDistinct("what").alias("whats")).collect()}
        assert set(got) == set(want)
        for k, w in want.items():
            assert got[k].n == w.n and abs(got[k].whos - w.whos) <= stats.SKETCH_ERROR * w.whos and abs(got[k].whats - w.whats) <= stats.SKETCH_ERROR * w.whats


def test_no_merged_sketch_is_far_off(spark):
    """Merging costs a sketch part of its precision: of 600 counts none may be beyond the error."""
    df = spark.range(3_000_000).select((F.col("id") % 600).alias("source"), F.expr("id div 600 % 7").alias("day"), (F.col("id") % 3).alias("part"), F.concat(F.lit("doc_"), "id").alias("what"))
    parts = [stats.sketched(df.filter(F.col("part") == k), ("day", "source"), {"whats": "what"}) for k in range(3)]
    counts = stats.distinct_counts(stats.merged_sketches(*parts), "source").collect()
    assert len(counts) == 600 and all(r.n == 5_000 and abs(r.whats - r.n) <= stats.SKETCH_ERROR * r.n for r in counts)


def test_orphans_by_path_and_title(spark, monkeypatch):
    """A summary that path and title find has one row, whichever of them comes first."""
    registry = spark.createDataFrame([("/data/kb/en/a.md", "a.md"), ("/data/kb/en/b.md", "b.md"), ("/data/kb/en/c.md", "c.md")], "filepath string, filename string")
    chunks = spark.createDataFrame(
        [("doc_summary_1", "/data/kb/en/a.md", "a.md", "en", "document"), ("doc_summary_2", "/old/a.md", "a.md", "en", "document"), ("doc_summary_3", "/old/c.md", "c.md", "en", "x"), ("doc_4", "/old/b.md", "b.md", "de", "document"), ("doc_4", "/old/b.md", "b.md", "de", "document")],
        "chunk_id string, file_path string, title string, folder string, source string",
    )
    want = {("/data/kb/en/a.md", "doc_summary_1", "path"), ("/data/kb/en/a.md", "doc_summary_2", "title"), ("/data/kb/en/c.md", "doc_summary_3", "title"), ("/data/kb/en/b.md", "doc_4", "fallback")}
    union = type(chunks).unionByName
    for other in (union, lambda a, b: union(b, a)):
        monkeypatch.setattr(type(chunks), "unionByName", other)
        rows = lifecycle.orphan_chunks(registry, registry.limit(0), chunks).collect()
        assert len(rows) == 4 and {tuple(r) for r in rows} == want


def test_cutters(spark):
    text = "One sentence here. " * 100
    assert all(len(p) <= 300 and p.endswith(".") for p in chunking.greedy(text, 300)) and "".join(chunking.greedy(text, 300)).replace(" ", "") == text.replace(" ", "")
    assert chunking.greedy("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5] and chunking.greedy("", 10) == []
    fenced = "```\n" + "code();\n" * 200 + "```"
    assert any(fenced in p for p in chunking.markdown("intro\n" + fenced + "\nafter"))
    docs = spark.createDataFrame([(1, "before\n# Top\n## A\nbody\n```\n## no\n~~~\n```\n### B ##\nmore\n~~~\n## no\n```\n"), (2, ""), (3, None), (4, "## Only")], "doc_id int, text string")
    got = [tuple(r) for r in chunking.split_markdown_sections(docs).orderBy("doc_id", "section").collect()]
    assert got == [(1, 0, "", "before\n# Top"), (1, 1, "A", "## A\nbody\n```\n## no\n~~~\n```"), (1, 2, "B ##", "### B ##\nmore\n~~~\n## no\n```"), (4, 0, "Only", "## Only")]
    rows = spark.createDataFrame([("f", n, f"row{n}", "v" * (n % 40) if n else None) for n in range(120)], "f string, n int, name string, v string")
    blocks = chunking.rows_to_text(rows, "f", "n", ["name", "v"], 300).orderBy("block").collect()
    assert all(len(b.text) <= 300 and b.text.startswith("name | v\n") for b in blocks)
    assert [line for b in blocks for line in b.text.split("\n")[1:]] == [f"row{n}" + (f": v={'v' * (n % 40)}" if n % 40 else "") for n in range(120)]
    chunking.register_udtfs(spark)
    assert [r.text for r in spark.sql("SELECT part, text FROM cut_greedy('a b')").collect()] == ["a b"]


LEAD = "These are the words that the sender wrote, more than fifty of them in characters."


@pytest.mark.parametrize("tail", """____
--- Original Message ---
-----Forwarded message from x
This message is confidential and privileged
This e-mail and any attachments
Questa email è riservata
La presente comunicazione è destinata a voi
Se ha ricevuto per errore
If you have received this in error
unauthorized use
CONFIDENTIALITY NOTICE
[https://a.b/logo.png]
Sent from my iPhone
Envoyé de iPhone
Inviato da Outlook
Tel: +39 02 1234567890
Get Outlook for Android
The use and distribution
-- """.split("\n"))
def test_tails_of_mail_are_cut(tail):
    assert mail.own_text(f"{LEAD}\n{tail}\nAnn") == LEAD


def test_own_words_of_mail():
    for kept in ("Sent from my notebook", "Sent from home", "Tel: 12", "--- more", "On Monday we wrote", "a\x0bb\u2028c", "begin forwarded message", "The mobile office"):
        assert mail.own_text(f"{LEAD}\n{kept}") == f"{LEAD}\n{kept}"
    body = f"Hello\n> quoted\n  >> twice\nOn {'x' * 100} wrote:\nIl 3 maggio Ann ha scritto: \nbye\nhttp://a http://b\n\n[image]\n \n· http://c\nlast\n-- \nsig"
    assert mail.own_text(body) == "Hello\nbye\nlast" and mail.own_text(None) == "" == mail.own_text("> all")
    # the first pattern with enough before it wins; earlier ones with too little don't cut
    assert mail.own_text(f"Disclaimer: short\n{LEAD}\nSent from my iPad\nx") == f"Disclaimer: short\n{LEAD}"
    assert mail.own_text(f"{LEAD}\nKind regards, Acme+Co\nx", ("Kind regards, Acme+Co",)) == LEAD


def test_headings_as_listed():
    yes = ["Art. 4 Definitions", "Section 2 Terms", "IV. Penalties", "1.2 Reporting", "1. SERVICES", "2) Term", "TERMINATION FOR CAUSE", "TITOLO I"]
    no = ["12345", "1) lower case", "Plain words", "1. " + "S" * 90, "", "article 4", "ABC"]
    assert [h for h in yes if not chunking.is_heading(h + "\nbody")] == [] == [h for h in no if chunking.is_heading(h)]


def test_cut_positions():
    p = lambda n, c="p": c * (n - 1) + "."
    # a heading ends a part of more than 200 characters, not a shorter one; a short last part joins the one before it
    assert chunking.headings("\n\n".join([p(300), "Art. 1 One\nx", p(500), p(600)])) == [p(300), f"Art. 1 One\nx\n\n{p(500)}\n\n{p(600)}"]
    assert chunking.headings("\n\n".join([p(150), "Art. 1 One", p(1000), p(100)])) == [f"{p(150)}\n\nArt. 1 One\n\n{p(1000)}\n\n{p(100)}"]
    assert chunking.headings("\n\n".join([p(1150), "Art. 1 One"])) == [f"{p(1150)}\n\nArt. 1 One"]
    long = " ".join(["S" + "x" * 698 + "."] * 4)
    assert [len(x) for x in chunking.headings(long)] == [700] * 4
    assert [len(x) for x in chunking.headings("y" * 3000)] == [1200, 1200, 600]
    # paragraphs: parts under 300 take more than fits; long ones are cut after the best sign beyond 30 %, and the rest goes on
    assert chunking.paragraphs("\n\n".join([p(290), p(1100)])) == [f"{p(290)}\n\n{p(1100)}"]
    assert chunking.paragraphs("\n\n".join([p(700), p(700)])) == [p(700), p(700)]
    mixed = "a" * 500 + "? " + "b" * 400 + ". " + "c" * 100 + "; " + "d" * 900
    assert [len(x) for x in chunking.paragraphs(mixed)] == [903, 1002]
    assert chunking.paragraphs("e" * 200 + ". " + "f" * 2000)[0] == "e" * 200 + ". " + "f" * 998
    assert chunking.paragraphs("g" * 1000 + " " + "h" * 900 + "\n\n" + p(200)) == ["g" * 1000, f"{'h' * 900}\n\n{p(200)}"]
    # a fence of one sign isn't ended by the other
    fenced = "~~~\n```\n" + "code. " * 400 + "\n~~~"
    assert fenced in chunking.markdown(f"{p(800)}\n\n{fenced}\n\n{p(800)}")


def test_senders(spark):
    rows = [("Ann <ann@corp.com>", True), ("noreply@corp.com", False), ("x@mail.linkedin.com", False), ("x@notlinkedin.com", True), ("My Newsletter <my.newsletter@a.org>", False), (None, True)]
    df = spark.createDataFrame([(n, f) for n, (f, _) in enumerate(rows)], "n int, `from` string")
    assert {r.n for r in mail.drop_blacklisted_senders(df).collect()} == {n for n, (_, keep) in enumerate(rows) if keep}


def test_pool_quotas(spark):
    rows = [(1, f"s{n}", "semantic", 1.0, f"2024-01-{n + 1:02d}") for n in range(14)] + [(1, f"e{n}", "entity", 0.5, None) for n in range(5)] + [(1, "s3", "lexical", 9.0, None)] + [(1, f"l{n}", "lexical", 5.0 - n, None) for n in range(5)]
    pool = search.compose_pool(spark.createDataFrame(rows, "query_id int, chunk_id string, stream string, score double, date string"), 3).orderBy("position").collect()
    assert [r.chunk_id for r in pool] == [f"s{n}" for n in range(9)] + ["e0", "e1", "e2", "l0", "l1"]


def test_scored_pool(spark):
    pool = spark.createDataFrame([(1, "a", 1, "q", "xx"), (1, "b", 2, "q", "xxxx"), (1, "c", 3, "q", "xxx")], "query_id int, chunk_id string, position int, query string, text string")
    assert [r.chunk_id for r in search.rerank(pool, 2, lambda q, t: F.length(t)).orderBy("rank").collect()] == ["b", "c"]
    assert [r.chunk_id for r in search.rerank(pool, 2).orderBy("rank").collect()] == ["a", "b"]


def test_vectors(spark):
    chunks = spark.createDataFrame([("a", "s", [1.0, 0.0]), ("b", "s", [0.0, 2.0]), ("z", "s", [0.0, 0.0]), ("n", "s", None), ("l", "s", [1.0]), ("m", "t", [-1.0, 0.0])], "chunk_id string, source string, embedding array<float>")
    queries = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None)], "query_id int, embedding array<float>")
    got = {(r.query_id, r.rank): (r.chunk_id, r.score) for r in search.vector_topk(queries, chunks, 3).collect()}
    assert got == {(1, 1): ("b", 0.8), (1, 2): ("a", 0.6), (1, 3): ("m", 0.0), (2, 1): ("a", 0.0), (2, 2): ("b", 0.0), (2, 3): ("m", 0.0)}


def test_containing(spark):
    names = ["Acme Corp", "ACME", "Beta", "x", "Macmeth"]
    probes = ["acme", "corp", "zzz", "e", "ac"]
    df = search.containing(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(p,) for p in probes], "probe string"), "name", "probe")
    assert sorted(map(tuple, df.collect())) == sorted((n, p) for n in names for p in probes if p in n.lower())


def test_documents_by_name(spark):
    import difflib

    rows = [("c1", "document", "Piano_Aprile.pdf", "work", "/kb/work/Piano_Aprile.pdf", "2024-01-01", ""), ("c2", "document", "Piano_Aprile.pdf", "work", "/kb/work/Piano_Aprile.pdf", "2024-02-01", "x"), ("c3", "document", "note.md", "piano aprile", "/kb/piano aprile/note.md", None, ""), ("c4", "document", "z.md", "", "/kb/piano-aprile/z.md", None, None), ("c5", "document", "other.md", "misc", "/kb/misc/other.md", None, ""), ("c6", "document", "gone Piano aprile", "", "/kb/gone", None, "y"), ("c7", "email", "piano aprile", "", "/m", None, "")]
    chunks = spark.createDataFrame(rows, "chunk_id string, source string, title string, folder string, file_path string, date string, superseded_by string")
    got = search.find_documents(spark.createDataFrame([(1, "Piano  aprile")], "query_id int, query string"), chunks, 9).orderBy("rank").collect()
    assert [(r.tier, r.file_path) for r in got] == [(3, rows[0][4]), (2, rows[2][4]), (1, rows[3][4]), (0, rows[4][4])]
    assert got[0].chunks == 2 and got[0].last_date == "2024-02-01" and abs(got[0].ratio - difflib.SequenceMatcher(None, "piano aprile", "piano aprile.pdf").ratio()) < 1e-6


@pytest.mark.parametrize("share", [5_000, 7])
def test_documents_by_name_against_all_pairs(spark, monkeypatch, share):
    import difflib
    import random

    monkeypatch.setattr(search, "NAMES", share)
    rng = random.Random(8)
    word = lambda: rng.choice(["piano", "aprile", "note", "rent", "Report", "budget", "tax", "casa", "2024", "final"])
    rows = [(f"c{n}", "document", " ".join(word() for _ in range(rng.randint(0, 3))), word() if n % 3 else "", f"/kb/{word()}/{word()}_{word()}-{n}" + "/long" * (30 * (n % 9 == 0)) + ".md", "2024-01-01", "") for n in range(60)]
    queries = [(n, " ".join(word() for _ in range(rng.randint(1, 3)))) for n in range(12)] + [(90, ""), (91, None), (92, "zzzz"), (93, "re")]
    chunks = spark.createDataFrame(rows, "chunk_id string, source string, title string, folder string, file_path string, date string, superseded_by string")
    got = search.find_documents(spark.createDataFrame(queries, "query_id int, query string"), chunks, 5).orderBy("query_id", "rank").collect()
    plain = lambda x: " ".join(re.sub("[\\s_-]+", " ", (x or "").lower()).split(" ")).strip()
    want = []
    for i, q in queries:
        q, ranked = plain(q), []
        for _, _, *names, path, _, _ in rows:
            names = [plain(x) for x in (*names, path)]
            tier = next((3 - k for k, x in enumerate(names) if q and q in x), 0)
            against = [names[3 - tier]] if tier else names
            ratio = round(max((difflib.SequenceMatcher(None, q, x).ratio() for x in against if x), default=0.0), 6)
            ranked.append((-tier, -ratio, path))
        want += [(i, path, -t, -r) for t, r, path in sorted(ranked)[:5]]
    assert [(r.query_id, r.file_path, r.tier, r.ratio) for r in got] == want


def test_gold_that_a_cap_took_away(spark):
    queries = spark.createDataFrame([(1, "Acme Corp")], "query_id int, query string")
    entities = spark.createDataFrame([("Acme Corp", "company", f"c{n}") for n in range(6)], "entity string, entity_type string, chunk_id string")
    none = spark.createDataFrame([], "query_id int, chunk_id string")
    found = search.entity_stream(queries, entities, none, 2).withColumn("stream", F.lit("entity"))
    corpus = spark.createDataFrame([(1, ["c5", "c0", "x"])], "query_id int, gold array<string>")
    rows = evaluate.gold_provenance(corpus, found, found, search.entity_matches(queries, entities)).collect()
    assert {(r.chunk_id, r.entity_pre_cap_only, r.in_pool) for r in rows} == {("c5", False, True), ("c0", True, False), ("x", False, False)}
    timings = spark.createDataFrame([(1, "lexical", 3.0), (2, "lexical", 5.0), (3, "lexical", None), (1, "rerank", 28.0)], "query_id int, stage string, ms double")
    assert {tuple(r) for r in evaluate.stage_timings(timings).collect()} == {("lexical", 2, 4.0), ("rerank", 1, 28.0)}


def test_older_near_copies(spark):
    rows = [("new", 3.0, "", "t" * 60, [1.0, 0.1]), ("old", 1.0, "", "t" * 60, [1.0, 0.0]), ("short", 2.0, "", "t", [1.0, 0.1]), ("gone", 0.5, "x", "t" * 60, [1.0, 0.1]), ("zero", 0.1, "", "t" * 60, [0.0, 0.0])]
    chunks = spark.createDataFrame(rows, "chunk_id string, create_time double, superseded_by string, text string, embedding array<float>")
    assert {(r.chunk_id, r.older_id) for r in lifecycle.chunk_supersession_candidates(chunks).collect()} == {("new", "old"), ("short", "old")}


def test_churn_guard(spark):
    prints = lambda rows: spark.createDataFrame(rows, "chunk_id string, fingerprint string")
    many = [(f"c{n}", "f") for n in range(8)]
    assert not lifecycle.churn(lifecycle.reconcile_plan(prints(many), prints([]))).first().abort
    plan = lifecycle.reconcile_plan(prints(many), prints([(c, "g" if c in ("c1", "c2") else f) for c, f in many]))
    with pytest.raises(lifecycle.ChurnTooHigh):
        lifecycle.apply_reconcile(plan, prints(many), prints(many))


def test_source_ranks(spark):
    chunks = spark.createDataFrame([("d", "document", ""), ("m", "email", ""), ("s", "doc_summary", "")], "chunk_id string, source string, superseded_by string")
    verdicts = spark.createDataFrame([("m", "d", "SUPERSEDES", 0.9), ("d", "m", "SUPERSEDES", 0.9), ("s", "m", "SUPERSEDES", 0.5), ("s", "m", "EXTENDS", 0.8)], "new_id string, old_id string, relation string, confidence double")
    rows = {r.chunk_id: r for r in lifecycle.apply_chunk_relations(chunks, verdicts).collect()}
    assert (rows["d"].superseded_by, rows["m"].superseded_by, rows["m"].extended_by, rows["s"].extends) == ("", "d", "s", "m")


def test_embedder(spark):
    from memlake.operators.vectors import embedded

    df = spark.createDataFrame([(1, "abc"), (2, None), (3, "x" * 5000)], "n int, text string")
    rows = embedded(df, lambda texts: [[len(t), 1.0] for t in texts]).orderBy("n").collect()
    assert [r.embedding for r in rows] == [[3.0, 1.0], [0.0, 1.0], [4000.0, 1.0]]
