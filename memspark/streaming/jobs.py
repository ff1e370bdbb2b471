"""Streaming forms: session checkpoints and triples by keyed state, incremental mining, and triples in micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from memspark.operators.drawers import append_drawers, mine_conversations, mine_project
from memspark.operators.kg import ENTITY, TRIPLE, add_triples, closing_keys, entity_id, predicate_name, triple_id
from memspark.operators.versions import DrawerStore
from memspark.sources.files import write_kg

CHECKPOINT = "session_id string, n bigint, since_last bigint"
#: A state holds the keys of one bucket. Each call of a state costs milliseconds, so a state for each key costs hours where keys are
#: millions; a stream keeps its number of buckets for life, and a task holds what one bucket has.
BUCKETS = 1024
#: Bytes of texts that a Python worker gets at once while files are mined; one longer text is a batch of its own.
ARROW_BYTES = 4 << 20


def session_name(session_id: str = "session_id"):
    return F.regexp_replace(session_id, "[^A-Za-z0-9_-]", "")


def counted_messages(df: DataFrame, marker: str = "<command-message>") -> DataFrame:
    """User messages (session_id, ts, id) without the marker of a command."""
    said = (F.col("role") == "user") & ~F.coalesce("content", F.lit("")).contains(marker)
    return df.where(said).select(session_name().alias("session_id"), "ts", "id")


def save_checkpoints_batch(df: DataFrame, every: int = 15, marker: str = "<command-message>") -> DataFrame:
    """(session_id, n, since_last): one row at each ``every``-th message of a session. A session's messages are numbered by
    the hour, from what the hours before it add up to, so a session with most of the messages isn't one task's. ``ts``
    is a timestamp, seconds or a text that starts with date and hour."""
    kind = dict(df.dtypes)["ts"]
    hour = F.date_trunc("hour", "ts") if kind.startswith("timestamp") else F.substring("ts", 1, 13) if kind == "string" else F.floor(F.col("ts") / 3600)
    rows = counted_messages(df, marker).withColumn("hour", hour)
    earlier = Window.partitionBy("session_id").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = rows.groupBy("session_id", "hour").agg(F.count("*").alias("m")).select("session_id", "hour", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("before"))
    at = F.row_number().over(Window.partitionBy("session_id", "hour").orderBy("ts", "id"))
    both = rows.withColumn("at", at).alias("r").join(hours.alias("h"), F.col("r.session_id").eqNullSafe(F.col("h.session_id")) & F.col("r.hour").eqNullSafe(F.col("h.hour")))
    numbered = both.select("r.session_id", (F.col("before") + F.col("at")).alias("n"))
    return numbered.where(F.col("n") % every == 0).withColumn("since_last", F.lit(every).cast("long"))


class SaveEvery(StatefulProcessor):
    """A session's messages so far, how many there were at the last checkpoint, and when the last message came. With ``idle_ms`` a
    message that comes later than that after the one before begins the count anew, and a timer drops the state once the watermark is
    past: what comes after that would begin anew as well, so results don't depend on how the stream is cut. Within a micro-batch
    messages count in the order of ts and id."""

    def __init__(self, every: int = 15, idle_ms: int | None = None):
        self.every, self.idle_ms = every, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("counts", "n bigint, saved bigint, last bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, saved, last = self.state.get() if self.state.exists() else (0, 0, None)
        out = []
        times = (x for frame in rows for x in frame["ms"]) if not self.idle_ms else iter(pd.concat(list(rows)).sort_values(["ms", "id"])["ms"])
        for ms in times:
            if self.idle_ms and last is not None and ms - last > self.idle_ms:
                n = saved = 0
            last = ms if last is None or not self.idle_ms else max(last, ms)
            n += 1
            if n - saved >= self.every:
                out.append((key[0], n, n - saved))
                saved = n
        self.state.update((n, saved, last))
        if self.idle_ms:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(int(last) + self.idle_ms)
        yield pd.DataFrame(out, columns=["session_id", "n", "since_last"]).astype({"session_id": str, "n": "int64", "since_last": "int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame({"session_id": pd.Series(dtype=str), "n": pd.Series(dtype="int64"), "since_last": pd.Series(dtype="int64")})

    def close(self) -> None:
        pass


class SaveEveryOfMany(StatefulProcessor):
    """`SaveEvery` for the sessions of a bucket, which share a state and a timer. The timer drops those that are idle by then and
    waits for the next."""

    def __init__(self, every: int = 15, idle_ms: int | None = None):
        self.every, self.idle_ms = every, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("sessions", "names array<string>, n array<bigint>, saved array<bigint>, last array<bigint>")

    def counts(self) -> dict[str, tuple[int, int, int]]:
        if not self.state.exists():
            return {}
        names, *counts = self.state.get()
        return dict(zip(names, zip(*counts, strict=True), strict=True))

    def keep(self, counts: dict[str, tuple[int, int, int]]) -> None:
        if counts:
            self.state.update((list(counts), *(list(x) for x in zip(*counts.values(), strict=True))))
        elif self.state.exists():
            self.state.clear()
        if self.idle_ms:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            if counts:
                self.handle.registerTimer(int(min(last for _, _, last in counts.values())) + self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        if self.idle_ms:
            frame = frame.sort_values(["ms", "id"])
        counts, out = self.counts(), []
        for name, ms in zip(frame["session_id"].tolist(), frame["ms"].tolist(), strict=True):
            n, saved, last = counts.get(name, (0, 0, ms))
            if self.idle_ms and ms - last > self.idle_ms:
                n = saved = 0
            n += 1
            if n - saved >= self.every:
                out.append((name, n, n - saved))
                saved = n
            counts[name] = (n, saved, max(last, ms))
        self.keep(counts)
        yield pd.DataFrame(out, columns=["session_id", "n", "since_last"]).astype({"session_id": object, "n": "int64", "since_last": "int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        over = expiredTimerInfo.getExpiryTimeInMs() - self.idle_ms
        self.keep({name: x for name, x in self.counts().items() if x[2] > over})
        yield pd.DataFrame({"session_id": pd.Series(dtype=str), "n": pd.Series(dtype="int64"), "since_last": pd.Series(dtype="int64")})

    def close(self) -> None:
        pass


@contextmanager
def keyed_state(spark: SparkSession):
    """Streams that are started within use the state store that keyed state and timers need; the session's own stays."""
    name = "spark.sql.streaming.stateStore.providerClass"
    kept = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, kept)


def save_checkpoints(stream: DataFrame, every: int = 15, marker: str = "<command-message>", idle_ms: int | None = None, lateness: str = "10 minutes", buckets: int | None = BUCKETS) -> DataFrame:
    """The same over a stream; start it within `keyed_state`. Sessions share the states of ``buckets``, or without a number have one each. Without ``idle_ms`` the count alone decides, so the order doesn't
    matter. With it, ``ts`` is a timestamp and the watermark follows it by ``lateness``; sessions are cut at gaps, as by
    `idle_checkpoints_batch`, and the state of those that ended goes by event-time timers."""
    rows = counted_messages(stream, marker)
    by, kept = ["session_id"], SaveEvery
    if buckets:
        rows, by, kept = rows.withColumn("bucket", F.pmod(F.xxhash64("session_id"), F.lit(buckets)).cast("int")), ["bucket"], SaveEveryOfMany
    if not idle_ms:
        return rows.withColumn("ms", F.lit(0).cast("long")).groupBy(*by).transformWithStateInPandas(kept(every), CHECKPOINT, "Append", "None")
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("ms", F.unix_millis("ts")).withWatermark("ts", lateness)
    return rows.groupBy(*by).transformWithStateInPandas(kept(every, idle_ms), CHECKPOINT, "Append", "EventTime")


def idle_checkpoints_batch(df: DataFrame, idle_ms: int, every: int = 15, marker: str = "<command-message>") -> DataFrame:
    """(session_id, n, since_last) with sessions cut at gaps of over ``idle_ms``, over a table."""
    order = Window.partitionBy("session_id").orderBy("ts", "id")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = counted_messages(df, marker).withColumn("gap", ms - F.lag(ms).over(order))
    cut = rows.withColumn("part", F.count_if(F.col("gap") > idle_ms).over(order))
    n = F.row_number().over(Window.partitionBy("session_id", "part").orderBy("ts", "id")).cast("long")
    return cut.select("session_id", n.alias("n")).where(F.col("n") % every == 0).withColumn("since_last", F.lit(every).cast("long"))


def compaction_checkpoints(df: DataFrame) -> DataFrame:
    """A checkpoint for each compaction event, whatever the count."""
    return df.where("event = 'compaction'").select(session_name().alias("session_id"), "ts")


def mine_stream(files: DataFrame, store: Callable[[], DataFrame], path: str, checkpoint: str, wing: str, conversations: bool = False, **how):
    """Mines each micro-batch of (rel_path, source_file, source_mtime, text) against the store as it is then, and appends the
    drawers of files that changed. ``store`` reads the store."""

    def mined(batch: DataFrame, _: int) -> None:
        append_drawers(drawers_of(batch, store(), wing, conversations, how), path)

    return files.writeStream.foreachBatch(mined).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drawers_of(batch: DataFrame, stored: DataFrame, wing: str, conversations: bool, how: dict) -> DataFrame:
    """The drawers of a micro-batch's changed files. The stream's session, which is a copy of the user's own, hands texts to Python in
    batches of `ARROW_BYTES`; by default a worker gets 10,000 texts or 64 MB at once, and holds them more than once."""
    batch.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    last = F.row_number().over(Window.partitionBy("source_file").orderBy(F.desc("source_mtime")))
    batch = batch.withColumn("__n", last).where("__n = 1").drop("__n")
    return (mine_conversations if conversations else mine_project)(batch, stored, wing, **how)


def mine_into(files: DataFrame, store: DrawerStore, checkpoint: str, wing: str, name: str, conversations: bool = False, **how):
    """The same into a store of versions, each micro-batch exactly once: it is a batch named by the stream and its number, so one
    that runs again, wherever it was broken off, leaves its drawers once. The changed files of a micro-batch are found against the
    version before it, whatever a run that was broken off has left."""

    def mined(batch: DataFrame, n: int) -> None:
        store.append(drawers_of(batch, store.read(), wing, conversations, how), f"{name}-{n}")

    return files.writeStream.foreachBatch(mined).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


CLOSING = T.StructType().add("subject", "string").add("predicate", "string").add("object", "string").add("ended", "string").add("upto", "integer")


def versioned(spark: SparkSession, path: str, versions: list[int] | None = None) -> DataFrame:
    """The triples of some versions (or all) with the number of each one's version."""
    paths = [f"{path}/v{n}/triples" for n in versions] if versions is not None else [f"{path}/v*/triples"]
    rows = spark.read.schema(TRIPLE).parquet(*paths)
    return rows.withColumn("version", F.regexp_extract(F.col("_metadata.file_path"), "/v([0-9]+)/triples/", 1).cast("int"))


def closed(triples: DataFrame, closings: DataFrame) -> DataFrame:
    """Triples with the end of the first closing that came when they were there."""
    ends = closings.groupBy("subject", "predicate", "object").agg(F.array_sort(F.collect_set(F.struct("upto", "ended"))).alias("ends"))
    rows = triples.join(ends, ["subject", "predicate", "object"], "left")
    end = F.get(F.filter("ends", lambda x: x["upto"] >= F.col("version")), F.lit(0))["ended"]
    return rows.withColumn("valid_to", F.coalesce("valid_to", end)).select(*TRIPLE.names)


def latest_kg(spark: SparkSession, path: str, versions: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(entities, triples) of a store that `kg_stream` keeps: the rows of all versions, with the closings applied."""
    paths = [f"{path}/v{n}/entities" for n in versions] if versions is not None else [f"{path}/v*/entities"]
    closings = spark.read.schema(CLOSING).parquet(f"{path}/closed*")
    return spark.read.schema(ENTITY).parquet(*paths), closed(versioned(spark, path, versions), closings)


def kg_stream(triples: DataFrame, path: str, checkpoint: str, closings: bool = False, today: str = "", first: int = 0):
    """Adds (or closes) each micro-batch of triples in the store below ``path``, which has a version ``first``. Micro-batch n
    writes what it adds, and nothing else, as version n + 1, or its closings as a table of their own; a batch that runs
    again writes the same again. `latest_kg` reads the store, `compact_kg` makes one version of many."""
    triples.sparkSession.createDataFrame([], CLOSING).write.mode("ignore").parquet(f"{path}/closed0")

    def added(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        entities, known = latest_kg(spark, path, list(range(first, n + 1)))
        rows = batch.persist()
        all_entities, all_triples, _ = add_triples(entities.limit(0), known, rows)
        # The new ones alone: entities and triples come out behind those of the store.
        new = all_triples.join(known.select("id"), "id", "left_anti")
        write_kg(all_entities.join(entities.select("id"), "id", "left_anti").select(*ENTITY.names), new.select(*TRIPLE.names), f"{path}/v{n + 1}")
        rows.unpersist()

    def ended(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        upto = versioned(spark, path).agg(F.coalesce(F.max("version"), F.lit(first))).first()[0]
        ends = closing_keys(batch, today).withColumn("upto", F.lit(upto))
        ends.select(*CLOSING.names).write.mode("overwrite").parquet(f"{path}/closed{n + 1}")

    return triples.writeStream.foreachBatch(ended if closings else added).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compact_kg(spark: SparkSession, path: str, to: str, version: int) -> None:
    """One version of all of a store, below another path; streams go on there with ``first=version``."""
    entities, triples = latest_kg(spark, path)
    write_kg(entities, triples, f"{to}/v{version}")
    spark.createDataFrame([], CLOSING).write.mode("ignore").parquet(f"{to}/closed0")


#: What the keyed triples write: added triples, and closings by the triple's id.
CHANGE = "event string, id string, subject string, predicate string, object string, valid_from string, valid_to string, confidence double, source_closet string, source_file string, seq bigint"
#: What a state tells of a change; the rest is the same for all.
CHANGED = ["event", "id", "subject", "predicate", "object", "valid_from", "valid_to", "seq"]


class ActiveTriples(StatefulProcessor):
    """The ids of a bucket's triples that are active. Additions of an active one add nothing, a closing ends it; both come in the
    order of ``seq``. The state begins with what the store has."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("actives", "keys array<string>, ids array<string>")

    def active(self) -> dict[str, str]:
        return dict(zip(*self.state.get(), strict=True)) if self.state.exists() else {}

    def keep(self, active: dict[str, str]) -> None:
        if active:
            self.state.update((list(active), list(active.values())))
        elif self.state.exists():
            self.state.clear()

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.keep(self.active() | dict(zip(initialState["key"], initialState["id"], strict=True)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("seq", kind="stable", ignore_index=True)
        active = self.active()
        kept, ids = [], []
        for i, (name, event, own, is_open) in enumerate(zip(frame["key"], frame["event"], frame["id"], frame["valid_to"].isna(), strict=True)):
            held = active.get(name)
            if event == "ended":
                if held is not None:
                    kept.append(i)
                    ids.append(held)
                    del active[name]
            elif held is None:
                kept.append(i)
                ids.append(own)
                if is_open:
                    active[name] = own
        self.keep(active)
        yield frame.iloc[kept].assign(id=pd.Series(ids, index=kept, dtype=object))[CHANGED]

    def close(self) -> None:
        pass


def triple_changes(events: DataFrame, today: str = "") -> DataFrame:
    """Events (seq, subject, predicate, object, valid_from, valid_to, ended), names as given, as rows of the log.
    An event with ``ended`` ('' stands for ``today``) closes a triple, one without adds it."""
    is_end = F.col("ended").isNotNull()
    rows = events.select(
        F.when(is_end, "ended").otherwise("added").alias("event"), entity_id("subject").alias("subject"), predicate_name("predicate").alias("predicate"), entity_id("object").alias("object"),
        F.when(~is_end, F.nullif("valid_from", F.lit(""))).alias("valid_from"), F.when(is_end, F.coalesce(F.nullif("ended", F.lit("")), F.lit(today))).otherwise(F.nullif("valid_to", F.lit(""))).alias("valid_to"),
        F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("source_closet"), F.lit(None).cast("string").alias("source_file"), F.col("seq").cast("long").alias("seq"),
    )
    return rows.withColumn("id", triple_id(F.col("seq"))).select(*(x.split()[0] for x in CHANGE.split(", ")))


def keyed_triples(events: DataFrame, path: str, checkpoint: str, known: DataFrame | None = None, today: str = "", buckets: int = BUCKETS):
    """Applies a stream of events (`triple_changes`) in order, by a state for each bucket of triples, and appends what it changes to the log below
    ``path``, once each, whatever runs again. No micro-batch reads the store: ``known``, its triples, is the first state and is read
    at the very first start alone. Start it within `keyed_state`; `logged_triples` reads the result."""
    # As JSON null is a name of its own, and names with any sign stay apart.
    key = F.to_json(F.array("subject", "predicate", "object"), {"ignoreNullFields": "false"})
    placed = lambda df: df.withColumn("key", key).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
    active = None
    if known is not None:
        active = placed(known.where("valid_to is null")).groupBy("bucket", "key").agg(F.min("id").alias("id")).groupBy("bucket")
    rows = placed(triple_changes(events, today)).select("bucket", "key", *CHANGED)
    kinds = ", ".join(f"{c} {'bigint' if c == 'seq' else 'string'}" for c in CHANGED)
    made = rows.groupBy("bucket").transformWithStateInPandas(ActiveTriples(), kinds, "Append", "None", active)
    made = made.withColumns({"confidence": F.lit(1.0), "source_closet": F.lit(None).cast("string"), "source_file": F.lit(None).cast("string")}).select(*(x.split()[0] for x in CHANGE.split(", ")))
    return made.writeStream.format("parquet").option("path", f"{path}/log").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def logged_triples(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """The triples of a log, and those that were ``known`` before it, with their closings applied: an id is closed once at most."""
    log = spark.read.schema(CHANGE).parquet(f"{path}/log")
    added = log.where("event = 'added'").withColumn("extracted_at", F.lit("")).select(*TRIPLE.names)
    ends = log.where("event = 'ended'").select("id", F.col("valid_to").alias("__end"))
    rows = added if known is None else known.select(*TRIPLE.names).unionByName(added)
    return rows.join(ends, "id", "left").withColumn("valid_to", F.coalesce("valid_to", "__end")).select(*TRIPLE.names)
