"""Live paths as Structured Streaming jobs, each with a batch twin in operators."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StructField, StructType

from memlake.functions import text as T
from memlake.operators import stats
from memlake.sources import pointers


def upsert(table: DataFrame | None, messages: DataFrame) -> DataFrame:
    """The last row of each live id: table after messages (conversation_id, title, ts, text, seq)."""
    rows = messages.withColumn("id", T.live_id(F.col("conversation_id"), F.col("title"), F.col("ts"), F.col("text")))
    both = rows if table is None else table.select(*rows.columns).unionByName(rows)
    last = both.groupBy("id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "id"]), F.struct("seq", "text")).alias("r"))
    return last.select("id", "r.*").select(*rows.columns)


#: Buckets of a table of live messages, and deltas that a read merges at most.
BUCKETS, DELTAS = 64, 8


def _live(spark: SparkSession, path: str, body: dict, schema: StructType, buckets: set[int] | None = None) -> DataFrame:
    """The rows of a commit, before the last of each id is taken, of all buckets or of some."""
    held = {int(b): name for b, name in body.get("base", {}).items() if buckets is None or int(b) in buckets}
    rows = [spark.read.schema(schema).parquet(*[f"{path}/{name}/bucket={b}" for b, name in held.items()])] if held else []
    for name in body.get("deltas", []):
        delta = spark.read.schema(StructType([*schema.fields, StructField("bucket", IntegerType())])).parquet(f"{path}/{name}")
        rows.append((delta if buckets is None else delta.filter(F.col("bucket").isin(*buckets))).drop("bucket"))
    return reduce(DataFrame.unionByName, rows, spark.createDataFrame([], schema))


def upsert_batch(batch: DataFrame, path: str, number: int, buckets: int = BUCKETS, deltas: int = DELTAS) -> dict[str, int]:
    """Puts a batch (conversation_id, title, ts, text, seq) into the table at path; returns how many ids it inserted and updated.

    The batch's last row of each id is written as a delta, by a hash of the id in buckets. With more than so many deltas,
    the buckets that they touch are merged into new files; others stay where they are. A pointer then commits the
    batch. A batch that is run again finds itself committed, and changes nothing.
    """
    spark, path = batch.sparkSession, path.rstrip("/")
    version, body = pointers.latest(spark, path)
    if body and body["batch"] >= number:
        return body["counts"]
    delta = pointers.new_name(number)
    bucket = F.pmod(F.xxhash64(T.live_id(F.col("conversation_id"), F.col("title"), F.col("ts"), F.col("text"))), F.lit(buckets)).cast("int")
    upsert(None, batch).withColumn("bucket", bucket).write.partitionBy("bucket").parquet(f"{path}/{delta}")
    written = spark.read.schema(StructType([*batch.schema.fields, StructField("bucket", IntegerType())])).parquet(f"{path}/{delta}")
    touched = {r.bucket for r in written.select("bucket").distinct().collect()}

    order, key = F.struct("seq", "text"), T.live_id(F.col("conversation_id"), F.col("title"), F.col("ts"), F.col("text")).alias("id")
    held = upsert(None, _live(spark, path, body, batch.schema, touched)).select(key, order.alias("held"))
    met = written.select(key, order.alias("new")).join(held, "id", "left")
    n = met.agg(F.count(F.when(F.col("held").isNull(), 1)).alias("inserted"), F.count(F.when(F.col("new") > F.col("held"), 1)).alias("updated")).first()

    names, base = [*body.get("deltas", []), delta], dict(body.get("base", {}))
    if len(names) > deltas:
        after = dict(body, deltas=names)
        every = {r.bucket for d in names for r in spark.read.parquet(f"{path}/{d}").select("bucket").distinct().collect()}
        merged = pointers.new_name(number)
        upsert(None, _live(spark, path, after, batch.schema, every)).withColumn("bucket", bucket).write.partitionBy("bucket").parquet(f"{path}/{merged}")
        base, names = base | {str(b): merged for b in every}, []
    counts = {"inserted": n.inserted, "updated": n.updated}
    pointers.commit(spark, path, version + 1, {"batch": number, "base": base, "deltas": names, "counts": counts, "schema": batch.schema.json()})
    return counts


def stream_upsert_messages(messages: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS, deltas: int = DELTAS):
    """upsert_batch() of every micro-batch; live_messages() reads the table, upsert_counts() what each commit did."""

    def put(batch: DataFrame, number: int) -> None:
        upsert_batch(batch, path, number, buckets, deltas)

    return messages.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_messages(spark: SparkSession, path: str) -> DataFrame:
    """The last row of each live id: a file or so for each bucket, and DELTAS deltas at most, however many batches there were."""
    body = pointers.latest(spark, path.rstrip("/"))[1]
    if not body:
        raise ValueError(f"{path} has no batch")
    return upsert(None, _live(spark, path.rstrip("/"), body, StructType.fromJson(json.loads(body["schema"]))))


def upsert_counts(spark: SparkSession, path: str) -> DataFrame:
    """(batch, inserted, updated) of each commit."""
    bodies = [pointers.read(spark, path.rstrip("/"), n) for n in pointers.committed(spark, path.rstrip("/"))]
    return spark.createDataFrame([(b["batch"], b["counts"]["inserted"], b["counts"]["updated"]) for b in bodies], "batch long, inserted long, updated long")


def stream_sessions(events: DataFrame, seconds: int = 600, late: str = "1 hour", key: str = "user_id") -> DataFrame:
    """(key, start, end, events) sessions by event time. Spark joins events whose gap equals the timeout, so its gap is a microsecond less."""
    gap = f"{seconds - 1} seconds 999999 microseconds"
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(key, F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("events"), F.max("ts").alias("last_ts")).select(key, F.col("s.start").alias("start"), "last_ts", "events")


class InOrder(StatefulProcessor):
    """Hands each key's rows (us, value) to a rule in the order of their times, once the watermark has passed them.

    step(state, us, value) gives the next state and an output row or None; until(state) the time in microseconds after
    which the state says nothing any more. Rows wait in a list state. A timer stands at the earliest of them or, if none
    waits, where the state ends: then the key is forgotten.
    """

    def __init__(self, step: Callable, until: Callable, columns: list[str]):
        self.step, self.until, self.columns = step, until, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, value double")
        self.state = handle.getValueState("state", "body string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [pair for batch in rows for pair in zip(batch["us"].tolist(), batch["value"].tolist(), strict=True)]
        yield self._passed(key, new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._passed(key, [], timerValues.getCurrentWatermarkInMs())

    def _passed(self, key, new: list, watermark: int) -> pd.DataFrame:
        rows = sorted([*(self.waiting.get() if self.waiting.exists() else []), *new])
        ready = [r for r in rows if r[0] <= watermark * 1000]
        state, out = json.loads(self.state.get()[0]) if self.state.exists() else None, []
        for us, value in ready:
            state, found = self.step(state, int(us), value)
            out += [] if found is None else [(key[0], *found)]
        rest = rows[len(ready) :]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        end = rest[0][0] if rest else self.until(state) if state is not None else 0
        if not rest and end <= watermark * 1000:
            self.waiting.clear()
            self.state.clear()
        else:
            if rest:
                self.waiting.put([(int(us), float(value)) for us, value in rest])
            else:
                self.waiting.clear()
            if state is not None:
                self.state.update((json.dumps(state),))
            self.handle.registerTimer(max(-(-end // 1000), watermark + 1))
        return pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def in_order(rows: DataFrame, key: str, late: str, rule: tuple[Callable, Callable], output: str) -> DataFrame:
    """The outputs of a rule over rows (key, ts, us, value). The query must run with the state store that PROVIDER names."""
    columns = [c.split()[0] for c in output.split(", ")]
    return rows.withWatermark("ts", late).groupBy(key).transformWithStateInPandas(InOrder(*rule, columns), output, "Append", "EventTime")


#: The setting, and its value, that streams with timers need when they start.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def ban_rule(tries: int, window: int, ban: int) -> tuple[Callable, Callable]:
    """Failures (value 0) within the window and the end of a ban, in microseconds; a success (value 1) clears both."""

    def step(state: dict | None, us: int, value: float) -> tuple[dict, tuple | None]:
        state = state or {"failures": [], "until": 0}
        if value or state["until"] and us >= state["until"]:
            state = {"failures": [], "until": 0}
        if value:
            return state, None
        state["failures"] = [f for f in state["failures"] if f > us - window] + [us]
        if state["until"] or len(state["failures"]) < tries:
            return state, None
        state["until"] = us + ban
        return state, (us, state["until"])

    return step, lambda state: max(state["until"], *(f + window for f in state["failures"]), 0)


def stream_bans(events: DataFrame, failure: str = "error", success: str = "signup", tries: int = 5, window: int = 900, ban: int = 1800, late: str = "1 hour") -> DataFrame:
    """(user_id, ts, banned_until) for each ban: so many failures in a window; a success clears it, and so does its end.

    Rows of a user count in the order of their times, up to late behind the latest. A user's state goes when neither
    failures nor a ban are left. Of events at one time, failures come first.
    """
    rows = events.filter(F.col("event_type").isin(failure, success) & F.col("user_id").isNotNull())
    rows = rows.select("user_id", F.col("ts").cast("timestamp").alias("ts"), stats.micros(F.col("ts")).alias("us"), (F.col("event_type") == success).cast("double").alias("value"))
    found = in_order(rows, "user_id", late, ban_rule(tries, window * 1_000_000, ban * 1_000_000), "user_id long, us long, until long")
    return found.select("user_id", F.timestamp_micros("us").alias("ts"), F.timestamp_micros("until").alias("banned_until"))


def alert_rule(threshold: float, window: int, snooze: int, silence: int) -> tuple[Callable, Callable]:
    """The points of the window, the one before it, and the last alert, in microseconds; all gone after silence and snooze."""

    def step(state: dict | None, us: int, value: float) -> tuple[dict, tuple | None]:
        state = state or {"points": [], "last": None}
        points = [*state["points"], [us, value]]
        before = [p for p in points if p[0] <= us - window]
        state["points"] = before[-1:] + [p for p in points if p[0] > us - window]
        within = [v for t, v in points if t >= us - window]
        if not before or before[-1][1] < threshold or min(within) < threshold or state["last"] is not None and us - state["last"] < snooze:
            return state, None
        state["last"] = us
        return state, (us, value)

    return step, lambda state: max(state["points"][-1][0] + max(window, silence), (state["last"] or 0) + snooze)


#: Seconds without a point after which a stream forgets a key.
SILENCE = 30 * 86_400


def alert_stream(series: DataFrame, threshold: float, seconds: int, snooze: int, late: str = "1 hour", silence: int = SILENCE) -> DataFrame:
    """breach_alerts() of a stream (key, ts, value), up to late behind the latest point.

    A key that is silent for longer than silence, the window and its snooze is forgotten: its next point has none before it.
    """
    rows = series.filter(F.col("value").isNotNull() & F.col("key").isNotNull()).select("key", F.col("ts").cast("timestamp").alias("ts"), stats.micros(F.col("ts")).alias("us"), F.col("value").cast("double").alias("value"))
    found = in_order(rows, "key", late, alert_rule(threshold, seconds * 1_000_000, snooze * 1_000_000, silence * 1_000_000), "key string, us long, value double")
    return found.select("key", F.timestamp_micros("us").alias("ts"), "value")


def stream_alerts(series: DataFrame, path: str, checkpoint: str, threshold: float, seconds: int, snooze: int, late: str = "1 hour", silence: int = SILENCE):
    """alert_stream(), written to path as Parquet."""
    out = alert_stream(series, threshold, seconds, snooze, late, silence)
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


class LateRows(StreamingQueryListener):
    """Counts, by name of the query, the rows that came after the watermark and were dropped. Add it to spark.streams."""

    def __init__(self) -> None:
        self.counts: Counter = Counter()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.counts[event.progress.name or str(event.progress.id)] += sum(s.numRowsDroppedByWatermark for s in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def breach_alerts(series: DataFrame, threshold: float, seconds: int, snooze: int, last: DataFrame | None = None) -> DataFrame:
    """(key, ts, value) of sustained breaches; per key none within the snooze of the alert before, or of last (key, alerted)."""
    hits = stats.sustained_breach(series, threshold, seconds).filter("breach").select("key", F.col("ts").cast("timestamp").alias("ts"), "value")
    if last is not None:
        hits = hits.join(last, "key", "left").filter(F.col("alerted").isNull() | (F.col("ts") >= F.col("alerted") + F.make_interval(secs=F.lit(snooze)))).drop("alerted")

    def spaced(pdf: pd.DataFrame) -> pd.DataFrame:
        kept, at = [], None
        for row in pdf.sort_values("ts").itertuples(index=False):
            if at is None or (row.ts - at).total_seconds() >= snooze:
                kept.append(row)
                at = row.ts
        return pd.DataFrame(kept, columns=pdf.columns)

    return hits.groupBy("key").applyInPandas(spaced, hits.schema)
